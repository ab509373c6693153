"""Profiles, enrichment, inverted indexes, themes, doses and quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.stats import benjamini_hochberg, hypergeometric_p, normal_tail, ranked


def top_per_group(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def inverted_index(rows: DataFrame, key: str, order: list, entry: list[str], k: int) -> DataFrame:
    """key with its k first entries as an array of structs in order."""
    top = top_per_group(rows, [key], order, k)
    lists = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", *entry))).alias("entries"))
    return lists.withColumn("n", F.size("entries"))


def idf(rows: DataFrame, entity: str, feature: str) -> DataFrame:
    """feature with df and ln(N / df) over distinct entities."""
    n = rows.agg(F.countDistinct(entity).alias("n"))
    df = rows.groupBy(feature).agg(F.countDistinct(entity).alias("df"))
    return df.join(F.broadcast(n)).select(feature, "df", F.ln(F.col("n") / F.col("df")).alias("idf"))


def shares(rows: DataFrame, by: list[str], value: str, name: str = "share") -> DataFrame:
    return rows.withColumn(name, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*by))))


def category_levels(rows: DataFrame, levels: list[str], weight: str = "w", fold: str = "f", measured: str = "m") -> DataFrame:
    """By level and its category: summed weight, weighted mean fold, rows, and the measured and predicted weight."""
    named = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).cast("string").alias("category")) for x in levels])).alias("c")
    long = rows.select(named, weight, fold, measured).select("c.*", weight, fold, measured)
    part = lambda which: F.round(F.coalesce(F.sum(F.when(which, F.col(weight))), F.lit(0.0)), 4)
    return long.groupBy("level", "category").agg(
        F.round(F.sum(weight), 4).alias("weight"), F.round(F.try_divide(F.sum(F.col(fold) * F.col(weight)), F.sum(weight)), 6).alias("mean_fold"), F.count("*").alias("n"),
        part(F.col(measured)).alias("measured"), part(~F.col(measured)).alias("predicted"),
    )


def row_normalized(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """log1p, z over the group (population sd, 1 if tiny), shifted to 0, divided by the sum."""
    w = Window.partitionBy(*by)
    out = rows.withColumn("__l", F.log1p(value))
    sd = F.stddev_pop("__l").over(w)
    out = out.withColumn("z", (F.col("__l") - F.avg("__l").over(w)) / F.when(sd < 1e-8, 1.0).otherwise(sd)).drop("__l")
    out = out.withColumn("__s", F.col("z") - F.min("z").over(w))
    return out.withColumn("weight", F.coalesce(F.try_divide("__s", F.sum("__s").over(w)), F.lit(0.0))).drop("__s")


def enrichment(members: DataFrame, sets: DataFrame, entity: str, gene: str, pathway: str, least: int = 1) -> DataFrame:
    """entity x pathway with k, K, n, M, fold, hypergeometric p and q within the entity; M counts genes in sets."""
    sets = sets.select(gene, pathway).distinct()
    members = members.select(entity, gene).distinct().join(sets.select(gene).distinct(), gene, "left_semi")
    size = sets.groupBy(pathway).agg(F.count("*").alias("pathway_k"))
    drawn = members.groupBy(entity).agg(F.count("*").alias("n"))
    pool = sets.agg(F.countDistinct(gene).alias("pool"))
    hits = members.join(sets, gene).groupBy(entity, pathway).agg(F.count("*").alias("k")).where(F.col("k") >= least)
    out = hits.join(size, pathway).join(drawn, entity).join(F.broadcast(pool))
    out = out.withColumn("fold", F.expr("(cast(k as double) / pathway_k) / (cast(n as double) / pool)"))
    out = out.withColumn("p", hypergeometric_p(F.col("k"), F.col("pool"), F.col("pathway_k"), F.col("n")))
    return benjamini_hochberg(out, "p", [pathway], [entity])


def weighted_enrichment(members: DataFrame, sets: DataFrame, least: int = 3) -> DataFrame:
    """entity x pathway hits of ``least`` genes with the tail p, q within the entity, folds by count, confidence and gene IDF,
    the measured and predicted parts, the drivers (by confidence, then gene), baseline reach, and two more p: with rounded
    weight sums for sizes (``least`` at least), and by a normal approximation of the overlap weight.

    ``members`` has entity, gene, confidence, measured, a gene of an entity once; M counts genes in sets, and the IDF of a
    gene is over pathways.
    """
    sets = sets.select("gene", "pathway").distinct()
    universe = sets.agg(F.countDistinct("gene").cast("double").alias("universe"), F.countDistinct("pathway").cast("double").alias("n_pathways"))
    rare = sets.groupBy("gene").agg(F.count("*").alias("d")).join(F.broadcast(universe)).select("gene", F.ln(F.col("n_pathways") / F.col("d")).alias("idf"))
    own = members.join(rare, "gene")
    entities = own.groupBy("entity").agg(F.count("*").alias("n"), F.sum("confidence").alias("weight"))
    pathways = sets.join(rare, "gene").groupBy("pathway").agg(F.count("*").alias("pathway_k"), F.sum("idf").alias("pathway_idf"))
    measured = F.when(F.col("measured"), F.col("confidence"))
    hits = own.join(sets, "gene").groupBy("entity", "pathway").agg(
        F.count("*").alias("k"), F.sum("confidence").alias("weighted_observed"), F.coalesce(F.sum(measured), F.lit(0.0)).alias("weighted_measured"), F.count(measured).alias("n_measured"),
        F.sum("idf").alias("idf_observed"), F.sum(F.col("confidence") * (1 - F.col("confidence"))).alias("__var"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "gene", "confidence", "measured"))), lambda d: F.struct(d["gene"].alias("gene"), d["confidence"].alias("confidence"), d["measured"].alias("measured"))).alias("drivers"),
    ).where(F.col("k") >= least)
    reach = hits.groupBy("pathway").agg(F.count("*").alias("__r")).join(F.broadcast(members.agg(F.countDistinct("entity").alias("__e")))).select("pathway", (F.col("__r") / F.col("__e")).alias("baseline_fraction"))
    out = hits.join(pathways, "pathway").join(entities, "entity").join(reach, "pathway").join(F.broadcast(universe))
    share = F.col("pathway_k") / F.col("universe")
    mean = F.col("weight") * share
    size = F.greatest(F.lit(least), F.rint(F.round("weight", 6)).cast("long"))
    found = F.least(F.greatest(F.lit(least), F.rint(F.round("weighted_observed", 6)).cast("long")), size, F.col("pathway_k"))
    pool = F.col("universe").cast("long")
    out = out.withColumns({
        "expected": F.col("n") * share, "fold": F.col("k") / (F.col("n") * share), "weighted_fold": F.coalesce(F.try_divide(F.col("weighted_observed"), mean), F.lit(0.0)),
        "idf_weighted_fold": F.coalesce(F.try_divide(F.col("idf_observed"), F.col("weight") / F.col("universe") * F.col("pathway_idf")), F.lit(0.0)),
        "n_predicted": F.col("k") - F.col("n_measured"), "weighted_predicted": F.col("weighted_observed") - F.col("weighted_measured"),
        "p": F.round(hypergeometric_p(F.col("k"), pool, F.col("pathway_k"), F.col("n")), 12), "p_effective": hypergeometric_p(found, pool, F.col("pathway_k"), size),
        "p_normal": normal_tail(F.try_divide(F.col("weighted_observed") - mean, F.sqrt(F.col("__var") + mean * (1 - share))), sides=1),
    })
    out = benjamini_hochberg(out, "p", ["pathway"], ["entity"])
    return out.select("entity", "pathway", "k", "pathway_k", "n", "expected", "fold", "p", "q", "weighted_fold", "idf_weighted_fold", "n_measured", "n_predicted", "weighted_observed", "weighted_measured", "weighted_predicted", "baseline_fraction", "p_effective", "p_normal", "drivers")


def null_calibration(members: DataFrame, sets: DataFrame, threshold: float, least: int, seed: int) -> DataFrame:
    """One row: entities and the share of them with any q under ``threshold`` when their genes are drawn at random.

    Every entity keeps its number of genes and their confidences; which genes carry them goes by a hash with the seed.
    """
    genes = sets.select("gene").distinct()
    numbered = ranked(genes.withColumn("__h", F.xxhash64(F.lit(seed), "gene")), ["__h", "gene"]).select("gene", (F.col("__rank") - 1).alias("place"), F.col("__n").alias("pool"))
    by_hash = Window.partitionBy("entity").orderBy(F.xxhash64(F.lit(seed + 1), "gene"), "gene")
    own = members.join(genes, "gene", "left_semi").withColumn("r", F.row_number().over(by_hash))
    # a step that is odd and prime walks over the pool without meeting a gene twice; each entity starts elsewhere
    pool = numbered.agg(F.max("pool").alias("pool"))
    step = F.pmod(F.xxhash64(F.lit(seed + 2), "entity"), F.col("pool")) + (F.col("r") - 1) * F.lit(1_000_003)
    drawn = own.join(F.broadcast(pool)).withColumn("place", F.pmod(step, F.col("pool"))).drop("gene", "pool").join(numbered.drop("pool"), "place")
    found = weighted_enrichment(drawn.select("entity", "gene", "confidence", "measured"), sets, least)
    hits = found.groupBy("entity").agg(F.min("q").alias("q"))
    return members.select("entity").distinct().join(hits, "entity", "left").agg(F.count("*").alias("entities"), F.avg((F.coalesce("q", F.lit(1.0)) < threshold).cast("double")).alias("share_significant"))


def leave_one_out(rows: DataFrame, whole: str, part: str, dim: str, value: str, unique_at: float = 0.12) -> DataFrame:
    """By part: how far the whole's normalised profile moves without it: half L1, half 1 - cosine."""
    own = rows.groupBy(whole, part, dim).agg(F.sum(value).alias("v"))
    total = own.groupBy(whole, dim).agg(F.sum("v").alias("t"))
    grid = own.select(whole, part).distinct().join(total, whole).join(own, [whole, part, dim], "left")
    grid = grid.withColumn("r", F.col("t") - F.coalesce("v", F.lit(0.0)))
    w = Window.partitionBy(whole, part)
    grid = grid.withColumns({"p": F.try_divide("t", F.sum("t").over(w)), "q": F.coalesce(F.try_divide("r", F.sum("r").over(w)), F.lit(0.0))})
    out = grid.groupBy(whole, part).agg(
        F.sum(F.abs(F.col("p") - F.col("q"))).alias("l1"),
        F.coalesce(F.try_divide(F.sum(F.col("p") * F.col("q")), F.sqrt(F.sum(F.col("p") * F.col("p"))) * F.sqrt(F.sum(F.col("q") * F.col("q")))), F.lit(0.0)).alias("cos"),
    )
    change = 0.5 * F.col("l1") + 0.5 * (1 - F.col("cos"))
    return out.select(whole, part, change.alias("change"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - change)).alias("redundancy"), (change >= unique_at).alias("is_unique"))


def mechanistic_score(genes: Column, compounds: Column, pathways: Column, targets: Column, stability: Column, q: Column) -> Column:
    """Capped log evidence (100, 20, 10; .4, .2, .4) plus .15 of a sigmoid of targets, times stability and 1 - q, in 0..1."""
    ev = lambda x, cap: F.log1p(F.least(x, F.lit(cap)).cast("double")) / F.log1p(F.lit(float(cap)))
    sigmoid = 1 / (1 + F.exp(-F.log1p(F.least(targets, F.lit(500)).cast("double"))))
    raw = 0.4 * ev(genes, 100) + 0.2 * ev(compounds, 20) + 0.4 * ev(pathways, 10) + F.when(targets > 0, 0.15 * sigmoid).otherwise(0.0)
    scored = raw * F.coalesce(stability, F.lit(0.5)) * (1 - F.coalesce(q, F.lit(0.0)))
    return F.when((genes + pathways + targets) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scored)))


def coherence(did: Column, score: Column) -> Column:
    """coherent unless effect and score point apart."""
    bad = ((did > 1e-6) & (score < 0.5)) | ((did < -1e-6) & (score > 0.5))
    return F.when(bad, "incoherent").otherwise("coherent")


def potency(n: Column, mean_fold: Column, measured: Column) -> Column:
    return F.greatest(F.lit(0.01), F.log1p(n.cast("double")) / F.log1p(F.lit(5000.0)) * (0.5 + 0.5 * F.least(F.lit(1.0), mean_fold / 3)) * (1 + 0.25 * measured))


def contribution(mass: Column, potency: Column, theme: Column) -> Column:
    return F.pow(mass, F.lit(0.3)) * F.pow(potency, F.lit(1.1)) * theme


def mass_in_grams(amount: Column, unit: Column, portion: Column, category: Column) -> Column:
    """(grams, method): mass units, else the portion's weight, else the category's, else none."""
    factor = F.when(unit.isin("g", "gram", "grams"), 1.0).when(unit == "kg", 1000.0).when(unit == "mg", 0.001).when(unit.isin("oz", "ounce"), 28.349523125).when(unit.isin("lb", "pound"), 453.59237)
    method = F.when(factor.isNotNull(), "mass_unit").when(portion.isNotNull(), "portion").when(category.isNotNull(), "category").otherwise("unconvertible")
    return F.struct((amount * F.coalesce(factor, portion, category)).alias("grams"), method.alias("method"))


def adaptive_weights(rows: DataFrame, by: list[str], parts: dict[str, float], live: float = 1e-4) -> DataFrame:
    """Weights of score parts by group: parts without spread give theirs to the live ones by variance share."""
    aggs = [f(c).alias(f"{p}_{c}") for c in parts for p, f in (("v", F.var_samp), ("r", lambda x: F.max(x) - F.min(x)))]
    out = rows.groupBy(*by).agg(*aggs)
    alive = {c: (F.coalesce(f"v_{c}", F.lit(0.0)) > live) & (F.col(f"r_{c}") > 0.01) for c in parts}
    dead = sum((F.when(alive[c], 0.0).otherwise(w) for c, w in parts.items()), F.lit(0.0))
    spread = sum((F.when(alive[c], F.col(f"v_{c}")).otherwise(0.0) for c in parts), F.lit(0.0))
    return out.select(*by, *[F.when(alive[c], w + dead * F.try_divide(F.col(f"v_{c}"), spread)).when(spread == 0, w).otherwise(0.0).alias(f"w_{c}") for c, w in parts.items()])


def foreign_key_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    keys = parent.select(F.col(parent_key).alias("key")).distinct()
    missing = child.select(F.col(child_key).alias("key")).where("key is not null").join(keys, "key", "left_anti")
    return missing.groupBy("key").agg(F.count("*").alias("n"))


def id_format_violations(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    return rows.where(~F.coalesce(F.col(column).cast("string").rlike(pattern), F.lit(False)))


def missing_required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, present in the schema, number of nulls."""
    spark = rows.sparkSession
    have = [c for c in columns if c in rows.columns]
    nulls = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in have]).unpivot([], have, "column", "nulls") if have else None
    wanted = spark.createDataFrame([(c, c in have) for c in columns], "column string, present boolean")
    return wanted.join(nulls, "column", "left") if nulls is not None else wanted.withColumn("nulls", F.lit(None).cast("long"))
