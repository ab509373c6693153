"""Mediation between two ingredients: what they share along compounds, genes and pathways, and what follows from it.

The graph is an edge table (source_id, target_id, edge_type): HAS_COMPOUND from ingredients, TARGETS from compounds,
IN_PATHWAY from genes, MAPS_TO_CATEGORY from pathways. The atlas has a row for each pair and category (a, b,
category). Sets stay in long form; pairs meet them by equi-joins, so nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.stats import quantiles


def hops(edges: DataFrame, *kinds: str) -> DataFrame:
    """(node, reached): distinct ends of the paths along edges of these types, in order."""
    steps = [edges.where(F.col("edge_type") == k).select("source_id", "target_id").distinct() for k in kinds]
    out = steps[0].toDF("node", "reached")
    for step in steps[1:]:
        out = out.join(step.toDF("reached", "next"), "reached").select("node", F.col("next").alias("reached")).distinct()
    return out


def shared(pairs: DataFrame, members: DataFrame, weight: Column | None = None, name: str = "shared") -> DataFrame:
    """Pairs (a, b) with what both reach: its number, or the sum of ``weight`` (a column of ``members``)."""
    left = members.withColumnRenamed("node", "a")
    right = members.select(F.col("node").alias("b"), "reached")
    both = pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", "reached"])
    return both.groupBy("a", "b").agg((F.count("*") if weight is None else F.sum(weight)).alias(name))


def features(atlas: DataFrame, edges: DataFrame, weights: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """The atlas with shared counts, mediated_path_score, mediation_confidence and target evidence.

    ``weights`` (reached, weight) weigh pathways, else 1; ``targets`` (compound, target) are optional evidence, absent and
    empty ones count 0. Where neither side reaches a pathway, those of the category stand in for both.
    """
    compounds, genes, paths = hops(edges, "HAS_COMPOUND"), hops(edges, "HAS_COMPOUND", "TARGETS"), hops(edges, "HAS_COMPOUND", "TARGETS", "IN_PATHWAY")
    weigh = lambda f: f.join(weights, "reached", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))) if weights is not None else f.withColumn("weight", F.lit(1.0))
    of_node = weigh(paths).groupBy("node").agg(F.sum("weight").alias("w"))
    of_category = weigh(hops(edges, "MAPS_TO_CATEGORY").toDF("reached", "category")).groupBy("category").agg(F.count("*").alias("cat_paths"), F.sum("weight").alias("cat_w"))
    out = atlas
    for name, members in (("shared_compounds", compounds), ("shared_genes", genes), ("shared_paths", paths)):
        out = out.join(shared(atlas, members, name=name), ["a", "b"], "left")
    out = out.join(of_node.toDF("a", "w_a"), "a", "left").join(of_node.toDF("b", "w_b"), "b", "left").join(of_category, "category", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    fallback = F.col("w_a").isNull() & F.col("w_b").isNull()
    n_paths = F.when(fallback, zero("cat_paths")).otherwise(zero("shared_paths"))
    score = F.when(fallback, zero("cat_w")).otherwise((zero("w_a") + zero("w_b")) / 2)
    confidence = F.least(F.lit(1.0), zero("shared_genes") / 10 + zero("shared_compounds") / 5 + n_paths / 5)
    if targets is not None:
        known = targets.select(F.col("compound").alias("reached"), "target").distinct()
        counted = compounds.join(known.groupBy("reached").agg(F.count("*").alias("n")), "reached")
        reach = compounds.join(known, "reached").select("node", F.col("target").alias("reached")).distinct()
        out = out.join(shared(atlas, counted, F.col("n"), "target_count"), ["a", "b"], "left").join(shared(atlas, reach, name="target_overlap"), ["a", "b"], "left")
    else:
        out = out.withColumns({"target_count": F.lit(None).cast("long"), "target_overlap": F.lit(None).cast("long")})
    return out.select(
        *atlas.columns, zero("shared_compounds").alias("shared_compounds"), zero("shared_genes").alias("shared_genes"), n_paths.cast("long").alias("shared_pathways"),
        score.cast("double").alias("mediated_path_score"), confidence.alias("mediation_confidence"), zero("target_count").alias("target_count"), zero("target_overlap").alias("target_overlap"),
    )


def graph(atlas: DataFrame, has_compound: DataFrame, targets: DataFrame, in_pathway: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the mediation graph: ingredients only from the atlas, a node for each pair, an edge for each effect.

    Edges have role (HAS_INGREDIENT) and did and q (AFFECTS), null elsewhere; nodes come once by id.
    """
    pair = F.concat_ws("_", F.lit("INT"), F.least("a", "b"), F.greatest("a", "b"))
    pairs = atlas.select(pair.alias("source_id"), "a", "b").distinct()
    none = F.lit(None)

    def edge(frame: DataFrame, kind: str, role: Column = none, did: Column = none, q: Column = none) -> DataFrame:
        return frame.select(F.col("source_id").cast("string"), F.col("target_id").cast("string"), F.lit(kind).alias("edge_type"), role.cast("string").alias("role"), did.cast("double").alias("did"), q.cast("double").alias("q"))

    ends = [edge(pairs.select("source_id", F.col(c).alias("target_id")), "HAS_INGREDIENT", F.lit(c.upper())) for c in "ab"]
    effects = edge(atlas.select(pair.alias("source_id"), F.concat(F.lit("CAT_"), "category").alias("target_id"), "did", "q"), "AFFECTS", did=F.col("did"), q=F.col("q"))
    rest = [edge(f.distinct(), k) for f, k in ((has_compound, "HAS_COMPOUND"), (targets, "TARGETS"), (in_pathway, "IN_PATHWAY"), (maps, "MAPS_TO_CATEGORY"))]
    edges = reduce(DataFrame.unionByName, [*ends, effects, *rest])
    node = lambda f, c, label: f.select(F.col(c).cast("string").alias("node_id"), F.lit(label).alias("label"))
    nodes = [node(pairs, "a", "Ingredient"), node(pairs, "b", "Ingredient"), node(pairs, "source_id", "Interaction"), node(effects, "target_id", "Category"), node(maps, "target_id", "Category")]
    nodes += [node(has_compound, "target_id", "Compound"), node(targets, "source_id", "Compound"), node(targets, "target_id", "Gene"), node(in_pathway, "source_id", "Gene"), node(in_pathway, "target_id", "Pathway"), node(maps, "source_id", "Pathway")]
    return reduce(DataFrame.unionByName, nodes).groupBy("node_id").agg(F.min("label").alias("label")), edges


def mediated_by(scored: DataFrame, maps: DataFrame) -> DataFrame:
    """Edges from pairs with a shared pathway to every pathway of their category, with their score."""
    some = scored.where("shared_pathways > 0").select(F.concat_ws("_", F.lit("INT"), F.least("a", "b"), F.greatest("a", "b")).alias("source_id"), "category", "score")
    return some.join(maps.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("category")).distinct(), "category").select("source_id", "target_id", F.lit("MEDIATED_BY").alias("edge_type"), "score")


def one_hop(seeds: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """Nodes beyond the seeds (column node) that share at least ``least`` members with one of them: node, seed, n_shared."""
    known = members.select("node", "reached").distinct()
    own = known.join(seeds.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("seed"), "reached")
    others = known.join(seeds.select("node").distinct(), "node", "left_anti")
    return others.join(own, "reached").groupBy("node", "seed").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= least)


def dose_proxy(pairs: DataFrame, baskets: DataFrame, compounds: DataFrame) -> DataFrame:
    """Pairs with the dose proxies of both (share of baskets times 1 + a tenth of the compounds, 1e-6 at least) and their geometric mean."""
    n = baskets.agg(F.countDistinct("basket").alias("n"))
    share = baskets.distinct().groupBy("item").agg(F.count("*").alias("k")).join(F.broadcast(n)).select(F.col("item").alias("node"), (F.col("k") / F.col("n")).alias("f"))
    each = share.join(compounds.groupBy("node").agg(F.count("*").alias("c")), "node", "left").select("node", F.greatest(F.lit(1e-6), F.col("f") * (1 + 0.1 * F.coalesce("c", F.lit(0)))).alias("proxy"))
    out = pairs.join(each.toDF("a", "proxy_a"), "a", "left").join(each.toDF("b", "proxy_b"), "b", "left").fillna(1e-6, ["proxy_a", "proxy_b"])
    return out.withColumn("proxy_ab", F.sqrt(F.col("proxy_a") * F.col("proxy_b")))


def triplet_scores(triplets: DataFrame, scored: DataFrame) -> DataFrame:
    """(a, b, c) by category: harmonic mean of its pairs' scores (times .85 with two pairs, .65 with one), sigmoid, times .7 + .3 boost.

    ``scored`` has a < b, category, score and propagated. Categories without any pair give no row.
    """
    key = scored.select(F.col("a").alias("x"), F.col("b").alias("y"), "category", "score", "propagated")
    pairs = triplets.select("a", "b", "c", F.explode(F.array(*[F.struct(F.least(p, q).alias("x"), F.greatest(p, q).alias("y")) for p, q in (("a", "b"), ("a", "c"), ("b", "c"))])).alias("pair"))
    found = pairs.select("a", "b", "c", "pair.*").join(key, ["x", "y"])
    out = found.groupBy("a", "b", "c", "category").agg(F.count("*").alias("n_pairs"), F.sum(1 / (F.col("score") + 1e-12)).alias("inverse"), F.max("score").alias("top"), F.avg(F.when(F.col("propagated") > 0, F.col("propagated"))).alias("boost"))
    mean = F.col("n_pairs") / F.col("inverse")
    pair = F.when(F.col("n_pairs") == 1, F.col("top") * 0.65).when(F.col("n_pairs") == 2, mean * 0.85).otherwise(mean)
    boost = F.least(F.lit(1.0), F.coalesce("boost", F.lit(0.0)))
    return out.select("a", "b", "c", "category", "n_pairs", (1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), pair)))) * (0.7 + 0.3 * boost)).alias("score"))


def pair_propagation(atlas: DataFrame, reach: DataFrame, genes: DataFrame, maps: DataFrame, synonyms: dict[str, str] | None = None, floor: float = 1e-6) -> DataFrame:
    """The atlas with ``propagated``: gene-to-pathway scores of both sides combined over the category's pathways.

    ``reach`` (gene, pathway, score) is scaled by each gene's greatest score, summed over the genes of a node (``genes``:
    node, gene), normalised to 1, combined by 2ab / (a + b) and summed over the pathways (``maps``: pathway, category) of
    the category or of its synonym. 0 becomes ``floor`` where both sides have genes and the category has pathways.
    """
    top = reach.groupBy("gene").agg(F.max("score").alias("top")).where("top > 0")
    scaled = reach.join(top, "gene").select("gene", "pathway", (F.col("score") / F.col("top")).alias("s"))
    sums = genes.distinct().join(scaled, "gene").groupBy("node", "pathway").agg(F.sum("s").alias("s"))
    total = sums.groupBy("node").agg(F.sum("s").alias("t")).where("t > 0")
    share = sums.join(total, "node").select("node", "pathway", (F.col("s") / F.col("t")).alias("s"))
    maps = maps.distinct()
    known = maps.select(F.col("category").alias("resolved")).distinct()
    other = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in (synonyms or {"": ""}).items() for x in p]), F.col("category")), F.col("category"))
    rows = atlas.select("a", "b", "category").distinct().join(known.withColumn("direct", F.lit(True)), F.col("category") == F.col("resolved"), "left").drop("resolved")
    rows = rows.withColumn("resolved", F.when(F.col("direct"), F.col("category")).otherwise(other))
    each = rows.join(maps.withColumnRenamed("category", "resolved"), "resolved").join(share.toDF("a", "pathway", "s_a"), ["a", "pathway"]).join(share.toDF("b", "pathway", "s_b"), ["b", "pathway"])
    score = each.groupBy("a", "b", "category").agg(F.sum(F.expr("2 * s_a * s_b / (s_a + s_b + 1e-12D)")).alias("score"))
    has = genes.select("node").distinct()
    able = rows.join(known, "resolved", "left_semi").join(has.toDF("a"), "a", "left_semi").join(has.toDF("b"), "b", "left_semi").select("a", "b", "category").withColumn("able", F.lit(True))
    out = atlas.join(score, ["a", "b", "category"], "left").join(able, ["a", "b", "category"], "left")
    value = F.coalesce("score", F.lit(0.0))
    return out.select(*atlas.columns, F.when((value == 0) & F.coalesce("able", F.lit(False)), floor).otherwise(value).alias("propagated"))


def zero_reason(rows: DataFrame, checks: list[tuple[str, Column]], score: str = "propagated") -> DataFrame:
    """Rows with the first reason that holds for a score of zero; null where the score isn't zero."""
    chain = reduce(lambda c, t: c.when(t[1], t[0]), checks[1:], F.when(checks[0][1], checks[0][0])).otherwise("unexplained")
    return rows.withColumn("reason", F.when(F.col(score) == 0, chain))


def high_confidence(rows: DataFrame, by: str, confidence: float = 0.8, stability: float = 0.5, quantile: float = 0.75) -> DataFrame:
    """Rows whose confidence and stability pass and whose score is at least the category's quantile."""
    cut = quantiles(rows, [by], "score", [quantile], ["cut"])
    return rows.join(cut, by).where((F.col("confidence") >= confidence) & (F.col("stability") >= stability) & (F.col("score") >= F.col("cut"))).drop("cut")


def missing_evidence(rows: DataFrame, flags: dict[str, Column], limit: int, key: list[str]) -> DataFrame:
    """Rows with score 0 and a flag for each kind of missing evidence, by q, then stability, nulls last: the first ``limit``."""
    out = rows.where("score = 0").withColumns(flags)
    return out.orderBy(F.asc_nulls_last("q"), F.desc_nulls_last("stability"), *key).limit(limit)


def explain_pair(atlas: DataFrame, members: dict[str, DataFrame], a: object, b: object, most: int = 10) -> DataFrame:
    """One row on a pair: its categories by score, and the first ``most`` members that both have of each kind."""
    own = atlas.where((F.col("a") == a) & (F.col("b") == b))
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "category"))), lambda x: x["category"])
    out = own.groupBy("a", "b").agg(ranked.alias("categories"))
    for name, table in members.items():
        both = table.where(F.col("node") == a).select("reached").distinct().join(table.where(F.col("node") == b).select("reached").distinct(), "reached", "left_semi")
        out = out.join(F.broadcast(both.orderBy("reached").limit(most).agg(F.array_sort(F.collect_list("reached")).alias(name))))
    return out
