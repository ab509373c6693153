"""Nearest neighbours over vectors, label transfer, ranking metrics.

Queries and corpus are both dealt into blocks by a hash of the id; each pair of blocks meets in one group on an
executor, is multiplied there and hands on its own top k, and the tops are merged. No block passes through the
driver, and a group's size is bounded by the blocks' sizes whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_neighbours(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", bits: bool = False, block: int = 16_384, query_block: int = 1024, floor: float | None = None) -> DataFrame:
    """(query, neighbour, similarity, rank): cosine, or Tanimoto of 0/1 vectors; a row isn't its own neighbour. Ties by id.

    Null vectors are left out on both sides; zero vectors are similar to nothing (0). With ``floor`` only neighbours of at
    least that similarity count.
    """
    clean = lambda f: f.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec IS NOT NULL AND id IS NOT NULL")
    corpus, queries = clean(corpus), clean(queries)
    n_c, n_q = (max(1, -(-f.count() // size)) for f, size in ((corpus, block), (queries, query_block)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = queries.withColumn("q", place(n_q)).withColumn("c", every(n_c)).withColumn("asks", F.lit(True))
    sides = sides.unionByName(corpus.withColumn("c", place(n_c)).withColumn("q", every(n_q)).withColumn("asks", F.lit(False)))
    kind = corpus.schema["id"].dataType.simpleString()

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("id")
        asks = group["asks"].to_numpy()
        ids, width = group["id"], len(group["vec"][0]) if group.num_rows else 0
        matrix = group["vec"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, width)
        q, own = np.flatnonzero(asks), np.flatnonzero(~asks)
        size = matrix.sum(axis=1) if bits else np.linalg.norm(matrix, axis=1)
        rows, cols, found = [], [], []
        names = ids.to_numpy()
        for low in range(0, len(q), 256):
            part = q[low : low + 256]
            if not len(own):
                break
            inner = matrix[part] @ matrix[own].T
            whole = size[part][:, None] + size[own] - inner if bits else size[part][:, None] * size[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                sim = np.round(np.where(whole > 0, inner / whole, 0.0), 12)
            sim[names[part][:, None] == names[own]] = -np.inf
            if len(own) > 4 * k:  # a cut that keeps all ties of the last place
                least = np.partition(sim, len(own) - k, axis=1)[:, len(own) - k]
                for r in range(len(part)):
                    near = np.flatnonzero(sim[r] >= least[r])
                    best = near[np.argsort(-sim[r][near], kind="stable")[:k]]
                    rows.append(np.full(len(best), part[r]))
                    cols.append(own[best])
                    found.append(sim[r][best])
            else:
                best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                rows.append(np.repeat(part, best.shape[1]))
                cols.append(own[best].ravel())
                found.append(np.take_along_axis(sim, best, axis=1).ravel())
        if not rows:
            return pa.table({"query": ids.slice(0, 0), "neighbour": ids.slice(0, 0), "similarity": pa.array([], pa.float64())})
        rows, cols, found = map(np.concatenate, (rows, cols, found))
        real = np.isfinite(found)
        return pa.table({"query": ids.take(pa.array(rows[real])), "neighbour": ids.take(pa.array(cols[real])), "similarity": pa.array(found[real])})

    tops = sides.groupBy("q", "c").applyInArrow(meet, f"query {kind}, neighbour {kind}, similarity double")
    if floor is not None:
        tops = tops.where(F.col("similarity") >= floor)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return tops.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def band_metrics(hits: DataFrame, band: Column, reliable: float = 0.5) -> DataFrame:
    """By similarity band: queries, mean hit, precision and recall, and whether the hit rate makes it reliable.

    ``hits``: query, similarity (the best neighbour's), hit, precision, recall.
    """
    out = hits.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg("hit").alias("hit"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    return out.withColumn("label", F.when(F.col("hit") >= reliable, "reliable").otherwise("exploratory"))


def similarity_breakdown(neighbours: DataFrame, thresholds: tuple[float, ...] = (0.7, 0.5, 0.3)) -> DataFrame:
    """One row: queries and the shares whose best similarity reaches each threshold."""
    best = neighbours.groupBy("query").agg(F.max("similarity").alias("s"))
    return best.agg(F.count("*").alias("n"), *[F.avg((F.col("s") >= t).cast("double")).alias(f"share_{round(100 * t)}") for t in thresholds])


def withheld(neighbours: DataFrame, floor: float = 0.3) -> DataFrame:
    """(query, best): queries whose best similarity stays below the floor."""
    return neighbours.groupBy("query").agg(F.max("similarity").alias("best")).where(F.col("best") < floor)


def eligible_labels(labels: DataFrame, label: str, least: int, most: int) -> DataFrame:
    """Labels with at least ``least`` rows, the ``most`` most frequent."""
    return labels.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), label).limit(most)


def link_metrics(scores: DataFrame, ks: tuple[int, ...] = (10, 50)) -> DataFrame:
    """One row on scored pairs (source, score, truth 0/1): ROC AUC, average precision, Hits@k of the sources, ranked by ranges.

    Ties in score count by their places in the order of the other columns.
    """
    from weftline.operators.stats import ranked

    order = scores.withColumn("__o", -F.col("score"))
    placed = ranked(order, ["__o", *[c for c in scores.columns if c != "score"]])
    up = placed.withColumn("from_below", F.col("__n") - F.col("__rank") + 1)
    positives = F.sum("truth")
    auc = up.agg(F.sum(F.col("from_below") * F.col("truth")).alias("s"), positives.alias("p"), F.max("__n").alias("n"))
    auc = auc.select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("roc_auc"))
    true_rank = ranked(placed.where("truth = 1").select(F.col("__rank").alias("at")), ["at"])
    ap = true_rank.agg(F.avg(F.col("__rank") / F.col("at")).alias("average_precision"))
    w = Window.partitionBy("source").orderBy(F.desc("score"), *[c for c in scores.columns if c not in ("score", "source")])
    own = scores.withColumn("__r", F.row_number().over(w)).groupBy("source").agg(*[F.max(F.when(F.col("__r") <= k, F.col("truth")).otherwise(0)).alias(f"h{k}") for k in ks])
    hits = own.agg(*[F.avg(f"h{k}").alias(f"hits_at_{k}") for k in ks])
    return auc.join(F.broadcast(ap)).join(F.broadcast(hits))


def random_walks(edges: DataFrame, length: int = 8, walks: int = 4, seed: int = 0) -> DataFrame:
    """(walk, path): random walks from every node of undirected edges (u, v), each step chosen by a hash; lineage is cut by step."""
    from weftline.operators.graph import both_ways
    from weftline.sources.shared import cut

    links = both_ways(edges).distinct()
    near = cut(links.groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("near")))
    state = near.select("u").withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(walks)))).select(F.col("u").alias("start"), "walk", F.col("u").alias("at"), F.array("u").alias("path"))
    for step in range(1, length):
        chosen = F.col("near")[F.pmod(F.xxhash64(F.lit(seed), "start", "walk", F.lit(step)), F.size("near").cast("long")).cast("int")]
        state = state.join(near, F.col("at") == F.col("u")).withColumn("at", chosen).withColumn("path", F.concat("path", F.array("at"))).drop("u", "near")
        if step % 4 == 0:
            state = cut(state)
    return state.select("start", "walk", "path")


def walk_embeddings(edges: DataFrame, size: int = 16, **params) -> DataFrame:
    """(node, vector): skip-gram vectors of random walks."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    walks = random_walks(edges, **params).select(F.transform("path", lambda x: x.cast("string")).alias("path"))
    model = Word2Vec(vectorSize=size, minCount=1, windowSize=3, maxIter=1, seed=7, numPartitions=1, inputCol="path", outputCol="out").fit(walks)
    return model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector").alias("vector"))


def label_votes(neighbours: DataFrame, labels: DataFrame, id_col: str = "id", label: str = "label", floor: float = 0.3) -> DataFrame:
    """By query and label: summed and best similarity and the best neighbour; queries below ``floor`` are withheld."""
    best = neighbours.groupBy("query").agg(F.max("similarity").alias("__best")).where(F.col("__best") >= floor).select("query")
    voted = neighbours.join(best, "query", "left_semi").join(labels.select(F.col(id_col).alias("neighbour"), label), "neighbour")
    return voted.groupBy("query", label).agg(
        F.sum("similarity").alias("score"), F.max("similarity").alias("best_similarity"),
        F.max_by("neighbour", F.struct("similarity", -F.col("neighbour"))).alias("best_neighbour"),
    )


def hit_metrics(votes: DataFrame, truth: DataFrame, k: int, label: str = "label") -> DataFrame:
    """One row: queries, hit, precision and recall at k."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), label)
    ranked = votes.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    hits = truth.join(ranked.select("query", label, F.lit(1).alias("hit")), ["query", label], "left")
    per = hits.groupBy("query").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("h"), F.count("*").alias("t"))
    return per.agg(F.count("*").alias("n"), F.avg((F.col("h") > 0).cast("double")).alias("hit_at_k"), (F.avg("h") / k).alias("precision_at_k"), F.avg(F.col("h") / F.col("t")).alias("recall_at_k"))
