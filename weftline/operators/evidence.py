"""Evidence: measured and predicted edges kept apart, rolled up by noisy-OR, guarded against shared neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def noisy_or(weight: Column) -> Column:
    """Aggregate 1 - prod(1 - w), w clipped to 0..1; 0 without rows."""
    return 1 - F.coalesce(F.product(1 - F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0))), F.lit(1.0))


def measured_wins(measured: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Both kinds with ``evidence``; predicted edges that are measured too are dropped."""
    kept = predicted.join(measured.select(keys).distinct(), keys, "left_anti")
    tagged = measured.withColumn("evidence", F.lit("measured"))
    return tagged.unionByName(kept.withColumn("evidence", F.lit("predicted")), allowMissingColumns=True)


def roll_up(edges: DataFrame, by: list[str], support: str, weight: str = "weight", measured: str = "is_measured") -> DataFrame:
    """By key: 1.0 and measured if any edge is, else noisy-OR of the predicted weights; counts of supports."""
    predicted = F.when(~F.col(measured), F.col(weight))
    out = edges.groupBy(*by).agg(
        F.max(measured).alias("__m"),
        noisy_or(predicted).alias("__p"),
        F.countDistinct(support).alias("n_support"),
        F.countDistinct(F.when(F.col(measured), F.col(support))).alias("n_measured"),
    )
    return out.select(
        *by,
        F.when(F.col("__m"), 1.0).otherwise(F.col("__p")).alias("confidence"),
        F.when(F.col("__m"), "measured").otherwise("predicted").alias("evidence"),
        "n_support", "n_measured",
    )


def independence_guard(edges: DataFrame, by: list[str], neighbour: str, own: str, weight: str) -> DataFrame:
    """Predicted weights: the greatest of each nearest neighbour, then noisy-OR over neighbours; also the naive one.

    An edge without neighbour is a group of its own. ``redundant``: the largest group of two or more makes up at
    least half of the naive confidence.
    """
    group = F.coalesce(F.col(neighbour).cast("string"), F.concat(F.lit("own:"), F.col(own).cast("string")))
    clusters = edges.groupBy(*by, group.alias("__g")).agg(
        F.max(weight).alias("top"), noisy_or(F.col(weight)).alias("within"), F.count("*").alias("size"), F.product(1 - F.col(weight)).alias("rest")
    )
    largest = F.max_by("within", F.struct("size", "within"))
    out = clusters.groupBy(*by).agg(noisy_or(F.col("top")).alias("guarded"), (1 - F.product("rest")).alias("naive"), F.count("*").alias("n_groups"), F.max("size").alias("largest"), largest.alias("share"))
    redundant = (F.col("largest") >= 2) & (F.col("share") >= 0.5 * F.col("naive"))
    return out.select(*by, "guarded", "naive", "n_groups", redundant.alias("redundant"))


def signature_collapse(edges: DataFrame, entity: str, member: str) -> DataFrame:
    """One row: entities, distinct member sets, the largest group of entities with one set, singletons, mean size."""
    sets = edges.groupBy(entity).agg(F.array_sort(F.collect_set(member)).alias("signature"))
    groups = sets.groupBy("signature").agg(F.count("*").alias("n"), F.first(F.size("signature")).alias("size"))
    return groups.agg(
        F.sum("n").alias("entities"), F.count("*").alias("unique_sets"), F.max("n").alias("largest_group"),
        F.count_if(F.col("n") == 1).alias("singletons"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size"),
    )


def median_representative(rows: DataFrame, by: list[str], value: str, key: list[str]) -> DataFrame:
    """Median of each group and its row nearest to it, ties by ``key``."""
    medians = rows.groupBy(*by).agg(F.median(value).alias("median"))
    near = Window.partitionBy(*by).orderBy(F.abs(F.col(value) - F.col("median")), *key)
    return rows.join(medians, by).withColumn("__r", F.row_number().over(near)).where("__r = 1").drop("__r")


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes, overlap, both shares, and the gate (share of b >= .2, or 25 in common, or b >= 500 and share of a >= .01)."""
    both = a.select(key).distinct().withColumn("__a", F.lit(1)).join(b.select(key).distinct().withColumn("__b", F.lit(1)), key, "full")
    out = both.agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_overlap"))
    out = out.withColumns({"share_a": F.coalesce(F.try_divide("n_overlap", "n_a"), F.lit(0.0)), "share_b": F.coalesce(F.try_divide("n_overlap", "n_b"), F.lit(0.0))})
    gate = (F.col("n_overlap") > 0) & ((F.col("share_b") >= 0.2) | (F.col("n_overlap") >= 25) | ((F.col("n_b") >= 500) & (F.col("share_a") >= 0.01)))
    return out.withColumn("passes", gate)
