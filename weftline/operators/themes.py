"""Themes, tissues and recipe messages: rules matched to rows, scores ranked within themes, profiles weighted and rolled up."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.shared import cut

# Limits and weights of the theme ranking.
THIN_GENES, LOW_GENES = 20, 60
THIN_GATE, LOW_GATE = 0.05, 0.5
STRENGTH_CAP, MOA_CAP = 5.0, 4.0
# Entities of a block, and dimensions of one matrix product, when all pairs are met.
BLOCK, DIMS = 2048, 512
ACTIONS = ("INHIBITOR", "AGONIST", "ANTAGONIST")


def match_themes(rows: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """(key, theme): rows named by a rule (explicit ``ids``), or whose text matches its ``pattern``; several themes a row.

    Ids are an equi-join. Patterns meet the distinct texts only, against the rule table, which is made by hand: more than
    1000 rules are refused, not cut.
    """
    if rules.count() > 1000:
        raise ValueError("too many rules to be broadcast")
    by_id = rows.join(rules.select("theme", F.explode("ids").alias(key)), key).select(key, "theme")
    texts = rows.select(text).distinct().join(F.broadcast(rules.select("theme", "pattern")), F.expr(f"regexp_like({text}, concat('(?i)', pattern))")).select(text, "theme")
    return by_id.unionByName(rows.join(texts, text).select(key, "theme")).distinct()


def specificity(rows: DataFrame, feature: str, entity: str, total: DataFrame) -> DataFrame:
    """(feature, specificity): ln(N / n) / ln N within 0 and 1; N is the one column n_all of ``total``."""
    counts = rows.groupBy(feature).agg(F.countDistinct(entity).alias("__n"))
    s = F.try_divide(F.ln(F.col("n_all") / F.col("__n")), F.ln(F.col("n_all").cast("double")))
    return counts.join(F.broadcast(total)).select(feature, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(s, F.lit(0.0)))).alias("specificity"))


def richness_gate(n_genes: Column) -> Column:
    return F.when(n_genes < THIN_GENES, THIN_GATE).when(n_genes < LOW_GENES, LOW_GATE).otherwise(1.0)


def theme_components(hits: DataFrame, spec: DataFrame, sizes: DataFrame) -> DataFrame:
    """By theme and entity: strength, breadth, significance and measured parts, all within 0 and 1.

    ``hits``: theme, entity, pathway, fold, q, n_measured, n_predicted; ``spec``: pathway, specificity; ``sizes``: theme, n_pathways.
    """
    out = hits.join(spec, "pathway").groupBy("theme", "entity").agg(
        F.count("*").alias("breadth"), F.avg(F.least(F.col("fold"), F.lit(STRENGTH_CAP))).alias("strength"), F.avg("specificity").alias("spec"), F.count_if(F.col("q") < 0.1).alias("n_significant"),
        F.sum("n_measured").alias("m"), F.sum(F.col("n_measured") + F.col("n_predicted")).alias("support"), F.max("fold").alias("best_fold"),
    ).join(sizes, "theme")
    breadth = F.coalesce(F.try_divide(F.log1p(F.col("breadth").cast("double")), F.log1p(F.col("n_pathways").cast("double"))), F.lit(0.0))
    return out.select(
        "theme", "entity", "breadth", "n_significant", "best_fold",
        (F.least(F.lit(1.0), F.col("strength") / STRENGTH_CAP) * (0.4 + 0.6 * F.col("spec"))).alias("strength_norm"),
        F.least(F.lit(1.0), breadth * (0.5 + 0.5 * F.col("spec"))).alias("breadth_norm"),
        F.coalesce(F.try_divide("m", "support"), F.lit(0.0)).alias("measured_norm"), (F.col("n_significant") / F.col("breadth")).alias("significance_norm"),
    )


def moa_score(genes: DataFrame, spec: DataFrame) -> DataFrame:
    """By theme and entity: measured genes by confidence, whole with a known action, else .55 (.35 + .65 specificity); capped sum.

    ``genes``: theme, entity, gene, confidence, measured, action.
    """
    known = F.upper("action").isin(*ACTIONS)
    each = F.when(known, F.col("confidence")).otherwise(0.55 * F.col("confidence") * (0.35 + 0.65 * F.col("specificity")))
    out = genes.where("measured").join(spec, ["theme", "gene"]).withColumns({"s": each, "known": known})
    return out.groupBy("theme", "entity").agg(F.least(F.lit(1.0), F.sum("s") / MOA_CAP).alias("moa_norm"), F.count_if("known").alias("n_with_action"))


def ranked_themes(components: DataFrame, weights: DataFrame, gate: DataFrame, parts: list[str], most: int = 100) -> DataFrame:
    """theme, entity, score and place: 100 * gate * sum(w * part), by six keys, the first ``most`` of each theme."""
    out = components.join(weights, "theme").join(gate, "entity")
    score = F.round(100 * F.col("gate") * sum((F.col(p) * F.col(f"w_{p}") for p in parts), F.lit(0.0)), 4)
    out = out.withColumn("score", score)
    order = [F.desc("score"), F.desc("n_with_action"), F.desc("moa_norm"), F.desc("n_significant"), F.desc("measured_norm"), F.desc("best_fold"), "entity"]
    return out.withColumn("place", F.row_number().over(Window.partitionBy("theme").orderBy(*order))).where(F.col("place") <= most).select("theme", "entity", "score", "place")


def regions(scores: DataFrame, members: DataFrame, most: int = 100) -> DataFrame:
    """region, entity with the best score among the region's tissues and that tissue: the first ``most`` of each region.

    ``scores``: tissue, entity, score; ``members``: region, tissue.
    """
    best = scores.join(members, "tissue").groupBy("region", "entity").agg(F.min(F.struct((-F.col("score")).alias("s"), "tissue")).alias("b"))
    out = best.select("region", "entity", (-F.col("b.s")).alias("score"), F.col("b.tissue").alias("tissue"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("score"), "entity"))).where(F.col("place") <= most)


def distinctive_genes(hits: DataFrame, genes: DataFrame, most: int = 75, power: float = 2.0, fallback: float = 0.02) -> DataFrame:
    """entity, gene, weight and tier: pathway weights (fold * -log10 q) times confidence and IDF summed by gene, times how
    rare the gene is among entities, squared, the first ``most``, normalised. Entities without hits at q <= .10 take those
    at .15 by a quarter; those without any, their genes' confidence * IDF by ``fallback``.

    ``hits``: entity, gene, confidence, idf, fold, q (a row for each driver of each pathway); ``genes``: entity, gene, confidence, idf.
    """
    n = hits.agg(F.countDistinct("entity").alias("__n"))
    spread = hits.where("q <= 0.1").groupBy("gene").agg(F.countDistinct("entity").alias("__c"))
    weight = F.greatest(F.lit(0.0), -F.log10(F.greatest(F.col("q"), F.lit(1e-300)))) * F.col("fold") * F.col("confidence") * F.col("idf")
    tiers = [hits.where(f"q <= {q}").groupBy("entity", "gene").agg((F.sum(weight) * mult).alias("raw")).withColumn("tier", F.lit(name)) for q, mult, name in ((0.1, 1.0, "strict"), (0.15, 0.25, "relaxed"))]
    tiers.append(genes.groupBy("entity", "gene").agg((F.sum(F.col("confidence") * F.col("idf")) * fallback).alias("raw")).withColumn("tier", F.lit("fallback")))
    out = tiers[0]
    for tier in tiers[1:]:
        out = out.unionByName(tier.join(out.select("entity").distinct(), "entity", "left_anti"))
    spec = F.when(F.col("__c").isNull(), F.ln(F.col("__n").cast("double"))).otherwise(F.ln(F.col("__n") / F.col("__c")))
    scaled = out.join(spread, "gene", "left").join(F.broadcast(n)).withColumn("s", F.pow(F.col("raw") * spec, F.lit(power))).where("raw > 0")
    top = scaled.withColumn("__r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("s"), "gene"))).where(F.col("__r") <= most)
    share = F.try_divide("s", F.sum("s").over(Window.partitionBy("entity")))
    return top.select("entity", "gene", share.alias("weight"), "tier").where("weight IS NOT NULL")


def tissue_scores(genes: DataFrame, expression: DataFrame) -> DataFrame:
    """entity, tissue, score and share: gene weights times the genes' tissue weights, summed. ``genes``: entity, gene, weight;
    ``expression``: gene, tissue, tissue_weight."""
    s = genes.join(expression, "gene").groupBy("entity", "tissue").agg(F.sum(F.col("weight") * F.col("tissue_weight")).alias("score"))
    return s.withColumn("share", F.try_divide("score", F.sum("score").over(Window.partitionBy("entity"))))


def measured_split(fraction: Column) -> Column:
    """A label for the measured part: mostly predicted below .05, mostly measured above .95, else mixed."""
    return F.when(fraction < 0.05, "predicted").when(fraction > 0.95, "measured").otherwise("mixed")


def hub_suppressed(profiles: DataFrame, entity: str, category: str, value: str) -> DataFrame:
    """Profiles times ln(N / n) of the category over entities, normalised within the entity; categories of all entities go to 0."""
    n = profiles.agg(F.countDistinct(entity).alias("__n"))
    df = profiles.where(F.col(value) > 0).groupBy(category).agg(F.countDistinct(entity).alias("__d"))
    scaled = profiles.join(df, category).join(F.broadcast(n)).withColumn("__v", F.col(value) * F.ln(F.col("__n") / F.col("__d")))
    return scaled.withColumn("share", F.coalesce(F.try_divide("__v", F.sum("__v").over(Window.partitionBy(entity))), F.lit(0.0))).drop("__n", "__d", "__v")


def type_cosines(vectors: DataFrame, entity: str, kind: str, dim: str, value: str) -> DataFrame:
    """By within or across kinds: pairs and the mean, least and greatest cosine of their long-form vectors.

    All pairs of different entities are met by matrix products: entities are dealt into blocks of about BLOCK, a task
    meets two blocks and keeps the figures of its pairs alone. Vectors without a dimension in common have cosine 0.
    """
    rows = vectors.select(F.col(entity).alias("e"), F.col(kind).alias("k"), F.col(dim).alias("d"), F.col(value).cast("double").alias("v")).where("e IS NOT NULL")
    norms = rows.groupBy("e", "k").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")).where("norm > 0")
    blocks = norms.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks"))
    sums = rows.where("d IS NOT NULL").groupBy("e", "d").agg(F.sum("v").alias("v"))
    unit = norms.join(sums, "e", "left").join(F.broadcast(blocks)).select(F.pmod(F.xxhash64("e"), "blocks").cast("int").alias("b"), "blocks", "e", "k", "d", (F.col("v") / F.col("norm")).alias("v"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        e, _ = pd.factorize(part["e"])
        k, kinds = pd.factorize(part["k"])
        d, dims = pd.factorize(part["d"])
        row, _ = pd.factorize(e * (len(kinds) + 1) + k)  # one row for each entity and kind
        at = np.unique(row, return_index=True)[1]
        v, met = part["v"].fillna(0.0).to_numpy(float), d >= 0
        block = pickle.dumps((e[at], k[at], list(kinds), list(dims), row[met], d[met], v[met]), protocol=5)
        return pd.DataFrame({"b": part["b"].iloc[:1], "blocks": part["blocks"].iloc[:1], "block": [block]})

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:  # no entity was dealt into that block
            return pd.DataFrame({c: [] for c in ("scope", "n", "sum", "low", "high")})
        x, y = pickle.loads(left["block"].iloc[0]), pickle.loads(right["block"].iloc[0])
        c, shared = np.zeros((len(x[0]), len(y[0]))), {d: i for i, d in enumerate(set(x[3]) & set(y[3]))}
        places = [np.array([shared.get(d, -1) for d in z[3]], dtype=np.int64)[z[5]] if z[3] else z[5] for z in (x, y)]
        for low in range(0, len(shared), DIMS):
            dense = []
            for z, at in zip((x, y), places, strict=True):
                some = (at >= low) & (at < low + DIMS)
                m = np.zeros((len(z[0]), min(DIMS, len(shared) - low)))
                m[z[4][some], at[some] - low] = z[6][some]
                dense.append(m)
            c += dense[0] @ dense[1].T
        code = {k: i for i, k in enumerate(y[2])}
        same = np.array([*(code.get(k, -2) for k in x[2]), -2])[x[1]][:, None] == y[1][None, :]
        masks = {"within": same, "across": ~same}
        if left["i"].iloc[0] == left["j"].iloc[0]:  # each pair once, and no entity with itself
            once = np.triu(x[0][:, None] != x[0][None, :], 1)
            masks = {s: m & once for s, m in masks.items()}
        found = [(s, c[m]) for s, m in masks.items()]
        return pd.DataFrame([(s, len(v), v.sum(), v.min(), v.max()) for s, v in found if len(v)], columns=["scope", "n", "sum", "low", "high"])

    packed = cut(unit.groupBy("b").applyInPandas(pack, "b int, blocks int, block binary"))
    left = packed.select(F.col("b").alias("i"), F.explode(F.sequence("b", F.col("blocks") - 1)).alias("j"), "block")
    right = packed.select(F.explode(F.sequence(F.lit(0), "b")).alias("i"), F.col("b").alias("j"), "block")
    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(meet, "scope string, n long, sum double, low double, high double")
    return met.groupBy("scope").agg(F.sum("n").alias("n_pairs"), (F.sum("sum") / F.sum("n")).alias("mean"), F.min("low").alias("least"), F.max("high").alias("most"))


def proxy_ratio(rows: DataFrame, group: str, basket: str, item: str, least: float = 1.5) -> DataFrame:
    """group, item and ratio: the item's share of the group's baskets against its share of all, ``least`` or more."""
    d = rows.select(group, basket, item).distinct()
    everywhere = d.groupBy(item).agg(F.countDistinct(basket).alias("g")).join(F.broadcast(d.agg(F.countDistinct(basket).alias("n"))))
    own = d.groupBy(group, item).agg(F.countDistinct(basket).alias("c")).join(d.groupBy(group).agg(F.countDistinct(basket).alias("m")), group)
    return own.join(everywhere, item).select(group, item, ((F.col("c") / F.col("m")) / (F.col("g") / F.col("n"))).alias("ratio")).where(F.col("ratio") >= least)


def blended(profiles: DataFrame, parts: DataFrame, feature: str, value: str) -> DataFrame:
    """blend and feature: the weighted sum of the constituents' values. ``parts``: blend, entity, weight; ``profiles``: entity, feature, value."""
    total = F.sum("weight").over(Window.partitionBy("blend"))
    return parts.withColumn("weight", F.col("weight") / total).join(profiles, "entity").groupBy("blend", feature).agg(F.sum(F.col("weight") * F.col(value)).alias(value), F.countDistinct("entity").alias("n_constituents"))


def message(scores: DataFrame, whole: str, dim: str, part: str, value: str, drivers: int) -> DataFrame:
    """whole, dim: the summed value, its share and the ``drivers`` parts that give most, as text."""
    own = scores.groupBy(whole, dim, part).agg(F.sum(value).alias("v"))
    place = F.row_number().over(Window.partitionBy(whole, dim).orderBy(F.desc("v"), part))
    listed = own.withColumn("r", place).groupBy(whole, dim).agg(F.sum("v").alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= drivers, F.struct("r", F.col(part).cast("string").alias("p"))))), lambda x: x["p"]), ",").alias("drivers"))
    return listed.withColumn("share", F.try_divide("score", F.sum("score").over(Window.partitionBy(whole))))
