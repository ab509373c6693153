"""Baskets of items: support gates, pair and triplet co-occurrence, eligibility.

Duplicates of an item in a basket count once. Pairs come from a self-join on the basket after rare items are
gone, so the fan-out is that of frequent items only; supports are joined back by broadcast only if Spark's own
size estimate allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.stats import quantiles


def distinct_items(rows: DataFrame, basket: str, item: str) -> DataFrame:
    return rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()


def item_support(items: DataFrame) -> DataFrame:
    return items.groupBy("item").agg(F.count("*").alias("support"))


def frequent(items: DataFrame, least: int) -> DataFrame:
    """Rows of items that are in at least ``least`` baskets."""
    return items.join(item_support(items).where(F.col("support") >= least), "item", "left_semi")


def without_staples(items: DataFrame, share: float) -> DataFrame:
    """Rows without the items whose support reaches the (1 - share) quantile of supports."""
    support = item_support(items)
    cut = quantiles(support.withColumn("all", F.lit(1)), ["all"], "support", [1 - share], ["cut"]).select("cut")
    return items.join(support.join(F.broadcast(cut)).where("support < cut"), "item", "left_semi")


def pair_counts(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """item_a < item_b with the number of baskets that hold both, within ``by`` columns if given."""
    by = by or []
    b = items.select(F.col("basket"), F.col("item").alias("item_b"))
    pairs = items.withColumnRenamed("item", "item_a").join(b, "basket").where("item_a < item_b")
    return pairs.groupBy(*by, "item_a", "item_b").agg(F.count("*").alias("n_ab"))


def pair_scores(items: DataFrame, least_support: int = 1, least_pairs: int = 1) -> DataFrame:
    """Counts, PMI (log2), Jaccard and overlap ratio of pairs; N is the number of baskets of the whole input."""
    total = items.agg(F.countDistinct("basket").alias("n"))
    kept = frequent(items, least_support) if least_support > 1 else items
    support = item_support(kept)
    out = pair_counts(kept).where(F.col("n_ab") >= least_pairs)
    out = out.join(support.toDF("item_a", "n_a"), "item_a").join(support.toDF("item_b", "n_b"), "item_b").join(F.broadcast(total))
    return out.select(
        "item_a", "item_b", "n_ab", "n_a", "n_b",
        F.log2(F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("pmi"),
        (F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))).alias("jaccard"),
        (F.col("n_ab") / F.least("n_a", "n_b")).alias("overlap"),
    )


def skip_reasons(pairs: DataFrame, joint: int, solo: int, overlap: float) -> DataFrame:
    """The pairs with ``eligible`` and the reasons against, joined by "; "."""
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("n_ab") < joint, "few joint"),
        F.when(F.col("n_a") - F.col("n_ab") < solo, "few a-only"),
        F.when(F.col("n_b") - F.col("n_ab") < solo, "few b-only"),
        F.when(F.col("overlap") > overlap, "overlap"),
    )
    return pairs.withColumn("reason", reasons).withColumn("eligible", F.col("reason") == "")


def triplets(items: DataFrame, least_support: int = 1) -> DataFrame:
    """a < b < c with support, lift and PMI (natural logarithm); only frequent pairs are extended."""
    total = items.agg(F.countDistinct("basket").alias("n"))
    pairs = pair_counts(items).where(F.col("n_ab") >= least_support).select("item_a", "item_b")
    first = items.withColumnRenamed("item", "item_a")
    second = items.withColumnRenamed("item", "item_b")
    third = items.withColumnRenamed("item", "item_c")
    both = first.join(second, "basket").where("item_a < item_b").join(pairs, ["item_a", "item_b"], "left_semi")
    out = both.join(third, "basket").where("item_b < item_c").groupBy("item_a", "item_b", "item_c").agg(F.count("*").alias("support"))
    out = out.where(F.col("support") >= least_support)
    single = item_support(items)
    for c in "abc":
        out = out.join(single.toDF(f"item_{c}", f"s_{c}"), f"item_{c}")
    lift = F.expr("support * power(cast(n as double), 2) / (cast(s_a as double) * s_b * s_c)")
    out = out.join(F.broadcast(total)).withColumn("lift", lift)
    return out.select("item_a", "item_b", "item_c", "support", "lift", F.ln("lift").alias("pmi"))
