"""Graphs as edge tables: lenses, expansion, components, PageRank, random walk with restart, ancestors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.shared import cut

# Rounds that PageRank draws on, and links of a list.
KEPT, FAN = 6, 4096


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered edges u < v without loops."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def degree_centrality(edges: DataFrame) -> DataFrame:
    degrees = both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    n = degrees.agg(F.count("*").alias("n"))
    return degrees.join(F.broadcast(n)).select("node", "degree", F.try_divide("degree", F.col("n") - 1).alias("centrality"))


def rounds(frame: DataFrame, step: Callable[[DataFrame], DataFrame], times: int, every: int = 2) -> DataFrame:
    """``step`` applied repeatedly; lineage is cut every few rounds in the shared checkpoint folder."""
    for i in range(1, times + 1):
        frame = step(frame)
        if i % every == 0 and i < times:
            frame = cut(frame)
    return frame


def until_steady(frame: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], value: str, tol: float, times: int | None = None, every: int = 2, total: bool = False) -> DataFrame:
    """``step`` applied until no value of a key (with ``total``: not their sum) changes by ``tol`` between two cuts, or ``times`` rounds are done."""
    before, done = cut(frame), 0
    while times is None or done < times:
        now = before
        for _ in range(every if times is None else min(every, times - done)):
            now, done = step(now), done + 1
        now = cut(now)
        signed = now.select(*keys, F.col(value).alias("c")).unionByName(before.select(*keys, (-F.col(value)).alias("c")))
        change = signed.groupBy(*keys).agg(F.abs(F.sum("c")).alias("c"))
        moved = change.agg(F.sum("c") if total else F.max("c")).first()[0]
        before = now
        if moved is None or moved < tol:
            break
    return before


def pagerank(edges: DataFrame, src: str, dst: str, damping: float = 0.85, times: int = 10, tol: float | None = None) -> DataFrame:
    """Rank over distinct directed edges; mass of nodes without out-edges is spread evenly.

    With ``tol``, rounds go on until all ranks together are within half of it of the fixed point (see ``_steady_ranks``);
    ``times`` holds without it.
    """
    links = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    if tol is not None:
        links = cut(links)
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    out = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
    base = nodes.join(out, "node", "left").join(F.broadcast(nodes.agg(F.count("*").alias("n"))))
    if tol is not None:
        return _steady_ranks(cut(base), links, damping, tol)

    def step(ranks: DataFrame) -> DataFrame:
        now = base.join(ranks, "node")
        lost = now.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        got = links.join(now.where("out is not null"), links.src == now.node).groupBy(F.col("dst").alias("node")).agg(F.sum(F.expr("rank / out")).alias("got"))
        joined = base.join(got, "node", "left").join(F.broadcast(lost))
        return joined.select("node", ((1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))).alias("rank"))

    return rounds(base.select("node", (1 / F.col("n")).alias("rank")), step, times)


def _steady_ranks(base: DataFrame, links: DataFrame, damping: float, tol: float) -> DataFrame:
    """Ranks whose summed distance from the fixed point is below tol / 2. ``base``: node, out, n; ``links``: src, dst.

    A round changes ranks linearly, so the next ones are the weighted mean of the last KEPT rounds whose summed squared
    change is least (Anderson's acceleration). If that makes the change larger, a plain round follows the last better
    ranks, which shrinks it by ``damping`` at least: rounds end. What is returned is a plain round of the last ranks,
    whose distance is damping / (1 - damping) of their change at most. Links are kept by node, in lists of about
    FAN at most, where they stay in all rounds.
    """
    spark = base.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fans = base.where(F.col("out") > FAN).select(F.col("node").alias("src"), F.ceil(F.col("out") / FAN).alias("fans"))
    dealt = links.repartition(parts, "src").join(fans, "src", "left")
    near = cut(dealt.groupBy("src", F.pmod(F.xxhash64("dst"), F.coalesce("fans", F.lit(1))).alias("fan")).agg(F.collect_list("dst").alias("dsts")).select("src", "dsts"))

    # x: the ranks; g and f: ranks after a round and the changes, of the last rounds, newest first
    none = F.array().cast("array<double>")
    now = base.select("node", "out", "n", (1 / F.col("n")).alias("x"), none.alias("g"), none.alias("f"))
    before = None
    while True:
        now = cut(now)
        sent = near.join(now.where("out IS NOT NULL").select(F.col("node").alias("src"), F.expr("x / out").alias("part")).repartition(parts, "src"), "src").select(F.explode("dsts").alias("node"), "part")
        got = sent.groupBy("node").agg(F.sum("part").alias("got"))
        lost = now.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("x"))), F.lit(0.0)).alias("lost"))
        g = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))
        done = now.join(got, "node", "left").join(F.broadcast(lost)).withColumn("y", g)
        done = cut(done.select("node", "out", "n", "x", *[F.slice(F.concat(F.array(c), old), 1, KEPT).alias(old) for c, old in ((F.col("y"), "g"), (F.col("y") - F.col("x"), "f"))]))
        spark.sparkContext._jvm.System.gc()  # lets Spark remove the shuffles of earlier rounds
        kept = done.select(F.size("f").alias("k")).first()
        if kept is None:
            return done.select("node", F.col("x").alias("rank"))
        k = kept["k"]
        products = [F.sum(F.col("f")[i] * F.col("f")[j]) for i in range(k) for j in range(i, k)]
        change, *products = done.agg(F.sum(F.abs(F.col("f")[0])), *products).first()
        if change * damping / (1 - damping) < tol / 2:
            return done.select("node", F.col("g")[0].alias("rank"))
        if before is not None and change > before:
            now = done.select("node", "out", "n", F.col("g")[1].alias("x"), none.alias("g"), none.alias("f"))
            before = None
            continue
        gram = np.zeros((k, k))
        gram[np.triu_indices(k)] = products
        gram += np.triu(gram, 1).T
        steps = np.hstack([-np.ones((k - 1, 1)), np.eye(k - 1)])  # changes less the newest one
        normal = steps @ gram @ steps.T
        scale = 1 / np.sqrt(np.maximum(np.diag(normal), 1e-300))
        moves = np.linalg.lstsq(normal * np.outer(scale, scale), -(steps @ gram[0]) * scale, rcond=1e-13)[0] * scale if k > 1 else np.zeros(0)
        weights = [1 - moves.sum(), *moves]
        x = reduce(add, [F.lit(float(w)) * F.col("g")[i] for i, w in enumerate(weights)])
        now, before = done.select("node", "out", "n", x.alias("x"), "g", "f"), change


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (u, v): the least node reachable.

    Alternating large-star and small-star rounds: each node points its larger neighbours, then its smaller ones,
    at the least neighbour, until no edge changes. There is no limit of rounds.
    """
    nodes = both_ways(edges).select(F.col("u").alias("node")).distinct()
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        links = cut(links)
        now = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before or not now[0]:
            break
        before = now
        both = both_ways(links)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    return nodes.join(links, nodes.node == links.u, "left").select("node", F.coalesce("v", "node").alias("component"))


def random_walk(edges: DataFrame, left: str, right: str, seeds: DataFrame, restart: float = 0.2, times: int = 12, tol: float | None = None) -> DataFrame:
    """Walk with restart on a bipartite graph: (seed, right, score) after the last hop from left to right.

    ``seeds`` has (seed, left); a seed starts with equal mass on its left nodes. Masses stay in long form.
    With ``tol``, rounds end, at the latest after ``times``, when no mass changes by it between two cuts.
    """
    links = edges.select(F.col(left).alias("l"), F.col(right).alias("r")).distinct()
    to_r = links.withColumn("w", 1 / F.count("*").over(Window.partitionBy("l")))
    to_l = links.withColumn("w", 1 / F.count("*").over(Window.partitionBy("r")))
    start = seeds.distinct().withColumn("m0", 1 / F.count("*").over(Window.partitionBy("seed"))).select("seed", "l", "m0")

    def across(mass: DataFrame) -> DataFrame:
        return mass.join(to_r, "l").groupBy("seed", "r").agg(F.sum(F.expr("m * w")).alias("m"))

    def step(mass: DataFrame) -> DataFrame:
        back = across(mass).join(to_l, "r").groupBy("seed", "l").agg(F.sum(F.expr("m * w")).alias("m"))
        both = back.join(start, ["seed", "l"], "full")
        return both.select("seed", "l", ((1 - restart) * F.coalesce("m", F.lit(0.0)) + restart * F.coalesce("m0", F.lit(0.0))).alias("m"))

    first = start.withColumnRenamed("m0", "m")
    mass = rounds(first, step, times) if tol is None else until_steady(first, step, ["seed", "l"], "m", tol, times)
    return across(mass).toDF("seed", right, "score")


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean and greatest degree of undirected edges (u, v)."""
    degrees = both_ways(edges).groupBy("u").agg(F.count("*").alias("k"))
    out = degrees.agg(F.count("*").alias("nodes"), (F.sum("k") / 2).cast("long").alias("edges"), F.avg("k").alias("mean_degree"), F.max("k").alias("max_degree"))
    return out.select("nodes", "edges", F.try_divide(F.col("edges") * 2.0, F.col("nodes").cast("double") * (F.col("nodes") - 1)).alias("density"), "mean_degree", "max_degree")


def label_propagation(edges: DataFrame, times: int = 20) -> DataFrame:
    """(node, community): each node takes the most frequent label of itself and its neighbours, the least of those as frequent.

    Rounds end when no label changes, or after ``times`` (labels can swing between two states for ever).
    """
    links = cut(both_ways(edges.where("u <> v")).distinct())
    own = cut(links.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())
    for _ in range(times):
        seen = links.join(own, links.v == own.node).select(F.col("u").alias("node"), "label").unionByName(own)
        counts = seen.groupBy("node", "label").agg(F.count("*").alias("n"))
        top = counts.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best")).select("node", F.col("best.label").alias("label"))
        new = cut(top)
        changed = not new.join(own, ["node", "label"], "left_anti").isEmpty()
        own = new
        if not changed:
            break
    return own.withColumnRenamed("label", "community")


def eigenvector(edges: DataFrame, tol: float = 1e-6, times: int = 100) -> DataFrame:
    """(node, centrality): power iteration with A + I, of length 1, until the summed change is under ``tol`` times the nodes."""
    links = cut(both_ways(edges.where("u <> v")).distinct())
    nodes = links.select(F.col("u").alias("node")).distinct()
    count = nodes.count()

    def step(x: DataFrame) -> DataFrame:
        pulled = links.join(x, links.v == x.node).groupBy(F.col("u").alias("node")).agg(F.sum("score").alias("pulled"))
        summed = x.join(pulled, "node", "left").select("node", (F.col("score") + F.coalesce("pulled", F.lit(0.0))).alias("score"))
        norm = summed.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
        return summed.join(F.broadcast(norm)).select("node", (F.col("score") / F.col("norm")).alias("score"))

    start = nodes.select("node", F.lit(1.0 / max(1, count)).alias("score"))
    return until_steady(start, step, ["node"], "score", tol * max(1, count), times, every=4, total=True).toDF("node", "centrality")


def betweenness(edges: DataFrame, most_edges: int = 2_000_000) -> DataFrame:
    """(node, centrality) of undirected edges: the share of shortest paths that pass, by breadth-first sums from every source.

    The edges are broadcast (refused beyond ``most_edges``, 16 bytes each); sources are dealt out, so each task sums its own.
    """
    nodes = both_ways(edges).select(F.col("u").alias("node")).distinct()
    if edges.count() > most_edges:
        raise ValueError("too many edges for exact betweenness")
    names = sorted(r[0] for r in nodes.collect())  # at most twice as many as the edges
    place = {n: i for i, n in enumerate(names)}
    near: list[list[int]] = [[] for _ in names]
    for u, v in edges.select("u", "v").distinct().collect():
        near[place[u]].append(place[v])
        near[place[v]].append(place[u])
    spark, n = edges.sparkSession, len(names)
    shared = spark.sparkContext.broadcast(near)

    def run(batches):
        near = shared.value
        total = [0.0] * len(near)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                far, paths, order, before = [-1] * len(near), [0.0] * len(near), [s], [[] for _ in near]
                far[s], paths[s] = 0, 1.0
                for u in order:  # grows while it is read
                    for v in near[u]:
                        if far[v] < 0:
                            far[v] = far[u] + 1
                            order.append(v)
                        if far[v] == far[u] + 1:
                            paths[v] += paths[u]
                            before[v].append(u)
                passed = [0.0] * len(near)
                for v in reversed(order):
                    for u in before[v]:
                        passed[u] += paths[u] / paths[v] * (1 + passed[v])
                    if v != s:
                        total[v] += passed[v]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(near)), pa.int64()), pa.array(total)], ["i", "passed"])

    sums = spark.range(n).repartition(min(n, 64) or 1).mapInArrow(run, "i long, passed double").groupBy("i").agg(F.sum("passed").alias("passed"))
    named = spark.createDataFrame(list(enumerate(names)), f"i long, node {edges.schema['u'].dataType.simpleString()}")
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return named.join(sums, "i").select("node", (F.col("passed") * scale).alias("centrality"))


def distances(edges: DataFrame) -> DataFrame:
    """One row: mean distance, diameter and ordered pairs that reach each other, over undirected edges (u, v).

    A front (source, node) goes out from every node at once; a level is joined with the edges and what was seen is taken off.
    The work is that of all pairs: for graphs of some thousand nodes.
    """
    links = cut(both_ways(edges).distinct())
    seen = front = cut(links.select(F.col("u").alias("s"), F.col("u").alias("n")).distinct())
    counts, depth = [], 0
    while True:
        depth += 1
        grown = front.join(links, front.n == links.u).select("s", F.col("v").alias("n")).distinct()
        front = cut(grown.join(seen, ["s", "n"], "left_anti"))
        reached = front.count()
        if not reached:
            break
        counts.append((depth, reached))
        seen = seen.unionByName(front)
    total = sum(n for _, n in counts)
    mean = sum(d * n for d, n in counts) / total if total else None
    return edges.sparkSession.createDataFrame([(mean, counts[-1][0] if counts else None, total)], "mean_distance double, diameter long, n_pairs long")


def laplacian_smooth(scores: DataFrame, similar: DataFrame, alpha: float = 0.2, times: int = 2) -> DataFrame:
    """x <- x - alpha (D - A) x over (a, b, weight) in both directions, the diagonal of A at 1."""
    degree = similar.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("d"))

    def step(x: DataFrame) -> DataFrame:
        pull = similar.join(x, similar.b == x.node).groupBy(F.col("a").alias("node")).agg(F.sum(F.expr("weight * score")).alias("pull"))
        out = x.join(degree, "node", "left").join(pull, "node", "left")
        return out.select("node", F.expr(f"score - {alpha}D * ((1 + coalesce(d, 0D)) * score - (score + coalesce(pull, 0D)))").alias("score"))

    return rounds(scores, step, times)


def ancestor_paths(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, root, path): the shortest way up, parents in alphabetical order, as the recursive SQL would find it.

    Levels go down from the roots; each is cut off from those before, so the cost is linear in the depth.
    """
    links = cut(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).distinct())
    roots = links.select(F.col("p").alias("node")).distinct().join(links.select(F.col("c").alias("node")), "node", "left_anti")
    level = found = cut(roots.select("node", F.col("node").alias("root"), F.array("node").alias("path")))
    while True:
        grown = links.join(level, links.p == level.node).select(F.col("c").alias("node"), F.concat(F.array("c"), "path").alias("path"))
        best = grown.groupBy("node").agg(F.min("path").alias("path")).join(found.select("node"), "node", "left_anti")
        level = cut(best.select("node", F.element_at("path", -1).alias("root"), "path"))
        if level.isEmpty():
            return found
        found = found.unionByName(level)


def nearest_slim(paths: DataFrame, slim: DataFrame, depth: int = 2) -> DataFrame:
    """(node, slim): the nearest ancestor on the path that is in ``slim`` (node, priority; least first where two are as near),
    else the ancestor ``depth`` below the root, else the node itself."""
    steps = paths.select("node", "path", F.posexplode("path").alias("far", "step"))
    hits = steps.join(slim.toDF("step", "priority"), "step").groupBy("node").agg(F.min(F.struct("far", "priority", "step")).alias("hit"))
    other = F.when(F.size("path") > depth, F.element_at("path", F.lit(-1 - depth))).otherwise(F.col("node"))
    return paths.join(hits, "node", "left").select("node", F.coalesce("hit.step", other).alias("slim"))


def neighbours(edges: DataFrame, node: object, kind: str | None = None, limit: int = 40) -> DataFrame:
    """Edges at a node in both directions, optionally of one type, ranked by weight, the first ``limit``."""
    out = edges.where((F.col("source_id") == node) | (F.col("target_id") == node))
    if kind:
        out = out.where(F.col("edge_type") == kind)
    other = F.when(F.col("source_id") == node, F.col("target_id")).otherwise(F.col("source_id"))
    return out.select(other.alias("neighbour"), "edge_type", "weight").orderBy(F.desc("weight"), "edge_type", "neighbour").limit(limit)


def similar_by_shared(edges: DataFrame, entity: str, shared: str, least: int = 3, most_degree: int | None = None) -> DataFrame:
    """Pairs a < b with shared count and specificity sum(1 / degree of the shared node); hubs left out beyond ``most_degree``."""
    links = edges.select(F.col(entity).alias("e"), F.col(shared).alias("s")).distinct()
    degree = links.groupBy("s").agg(F.count("*").alias("deg"))
    if most_degree:
        degree = degree.where(F.col("deg") <= most_degree)
    links = links.join(degree, "s")
    pairs = links.toDF("s", "a", "deg").join(links.select("s", F.col("e").alias("b")), "s").where("a < b")
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("n_shared"), F.sum(F.expr("1D / deg")).alias("specificity"))
    return out.where(F.col("n_shared") >= least)
