"""Queries of similarity evaluation, embeddings and fitted models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.operators import models, similarity
from weftline.plans.registry import query, rounded

KNN = """n AS (SELECT vec_id, label, [x::DOUBLE for x in embedding]::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, b.label, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 12) AS similarity FROM n a, n b WHERE a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour)::INT AS rank FROM s QUALIFY rank <= 10)"""


def neighbours(t: Callable) -> DataFrame:
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return similarity.top_neighbours(v, v, 10)


@query(f"WITH {KNN} SELECT query, neighbour, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour)::INT AS rank FROM k WHERE similarity >= 0.3")
def similar_with_floor(t: Callable) -> DataFrame:
    """#85: the most similar above a floor."""
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return rounded(similarity.top_neighbours(v, v, 10, floor=0.3))


@query(f"WITH {KNN}, b AS (SELECT query, max(similarity) AS s FROM k GROUP BY 1) SELECT count(*) AS n, round(avg((s >= 0.7)::INT), 6) AS share_70, round(avg((s >= 0.5)::INT), 6) AS share_50, round(avg((s >= 0.3)::INT), 6) AS share_30 FROM b")
def similarity_breakdown(t: Callable) -> DataFrame:
    """#145: shares of queries by their best similarity."""
    return rounded(similarity.similarity_breakdown(neighbours(t)))


@query(f"WITH {KNN} SELECT query, round(max(similarity), 6) AS best FROM k GROUP BY 1 HAVING max(similarity) < 0.45")
def withheld_queries(t: Callable) -> DataFrame:
    """#147."""
    return rounded(similarity.withheld(neighbours(t), 0.45))


@query(f"""WITH {KNN}, q AS (SELECT query, max(similarity) AS s, avg((k.label = e.label)::INT) AS p, max((k.label = e.label)::INT) AS h, sum((k.label = e.label)::INT) AS c FROM k JOIN embeddings e ON e.vec_id = query GROUP BY 1), x AS (SELECT label, count(*) - 1 AS t FROM embeddings GROUP BY 1),
b AS (SELECT CASE WHEN s >= 0.3 THEN least(floor(round(s * 10, 6)) / 10, 0.9) END AS band, h, p, c / t AS r FROM q JOIN embeddings ON vec_id = query JOIN x USING (label)) SELECT band, count(*) AS n, round(avg(h), 6) AS hit, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, CASE WHEN avg(h) >= 0.95 THEN 'reliable' ELSE 'exploratory' END AS label FROM b GROUP BY 1""")
def metrics_by_band(t: Callable) -> DataFrame:
    """#149."""
    labels = t("embeddings").select(F.col("vec_id").alias("id"), "label")
    rows = neighbours(t).join(labels.select(F.col("id").alias("neighbour"), F.col("label").alias("theirs")), "neighbour").join(labels.withColumnRenamed("id", "query"), "query")
    same = (F.col("theirs") == F.col("label")).cast("double")
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("t"))
    hits = rows.groupBy("query", "label").agg(F.max("similarity").alias("similarity"), F.avg(same).alias("precision"), F.max(same).alias("hit"), F.sum(same).alias("c")).join(sizes, "label").withColumn("recall", F.try_divide("c", "t"))
    return rounded(similarity.band_metrics(hits, C.similarity_band(F.round("similarity", 7)), 0.95))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, label LIMIT 6")
def eligible_labels(t: Callable) -> DataFrame:
    """#150."""
    return similarity.eligible_labels(t("embeddings"), "label", 5, 6)


LINKS = "p AS (SELECT l_suppkey AS source, l_partkey % 50 AS target, round(avg(l_discount), 9) AS score, max((l_returnflag = 'R')::INT) AS truth FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {LINKS}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, source, target, truth) AS i, count(*) OVER () AS n FROM p), t AS (SELECT i, row_number() OVER (ORDER BY i) AS j FROM r WHERE truth = 1),
h AS (SELECT source, max(truth) FILTER (k <= 1) AS h1, max(truth) FILTER (k <= 3) AS h3 FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target, truth) AS k FROM p) GROUP BY 1)
SELECT (SELECT round((sum((n - i + 1) * truth) - sum(truth) * (sum(truth) + 1) / 2) / (sum(truth) * (max(n) - sum(truth))), 6) FROM r) AS roc_auc, (SELECT round(avg(j / i), 6) FROM t) AS average_precision, (SELECT round(avg(h1), 6) FROM h) AS hits_at_1, (SELECT round(avg(h3), 6) FROM h) AS hits_at_3""")
def link_prediction_metrics(t: Callable) -> DataFrame:
    """#151: ROC AUC, average precision and Hits@k of scored pairs."""
    p = t("lineitem").groupBy(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 50).alias("target")).agg(F.round(F.avg("l_discount"), 9).alias("score"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("truth"))
    return rounded(similarity.link_metrics(p.select("source", "target", "score", "truth"), (1, 3)))


@query()
def node_embeddings(t: Callable) -> DataFrame:
    """#152: skip-gram vectors of random walks over brands and nations; rows only, walks are tested."""
    from weftline.operators import graph

    e = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    links = graph.undirected(e.select("p_brand", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("n")), "p_brand", "n")
    return similarity.walk_embeddings(links)


def _features(t: Callable) -> DataFrame:
    return t("lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"), F.avg("l_tax").alias("c"), F.avg("l_extendedprice").alias("y"))


@query()
def cluster_choice(t: Callable) -> DataFrame:
    """#140: k-means by silhouette over k; rows only, tested on separate clouds."""
    return models.cluster_choice(_features(t), ["a", "b", "c"], range(2, 5))


@query()
def hashed_embedding(t: Callable) -> DataFrame:
    """#141: hashed baskets through a truncated decomposition, standardised; rows only, tested by its moments."""
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.array_sort(F.collect_set("p_name")).alias("items"))
    return models.hashed_embedding(rows, "l_suppkey", "items", 64, 4)


@query()
def boosted_regression(t: Callable) -> DataFrame:
    """#142: boosted trees with held-out r2 and rmse and importances; rows only, tested on a known function."""
    return models.boosted_regression(_features(t), "l_suppkey", ["a", "b", "c"], "y")
