"""Queries that write tables to the shared folder, read them back and compute on what was read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.registry import query, rounded
from weftline.sources import io
from weftline.sources.shared import shared_path


def _path(t: Callable, label: str) -> str:
    return shared_path(t("region").sparkSession, label)


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1")
def parquet_round_trip(t: Callable) -> DataFrame:
    """#1-3, #7: written as Parquet and rewritten plainly, read by suffix with two columns only."""
    spark, path = t("region").sparkSession, _path(t, "parquet")
    io.write_table(t("lineitem"), f"{path}/in.parquet")
    io.rewrite_portable(spark, f"{path}/in.parquet", path)
    rows = io.read_any(spark, f"{path}/parquet", ["l_returnflag", "l_quantity"])
    return rounded(rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")), 2)


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, min(c_name) AS first_name FROM customer GROUP BY 1")
def csv_round_trip(t: Callable) -> DataFrame:
    """#4: CSV with a metadata header."""
    spark, path = t("region").sparkSession, _path(t, "table") + ".csv"
    io.write_csv(t("customer"), path, {"table": "customer", "made_by": "csv_round_trip"})
    rows = io.read_any(spark, path, schema=", ".join(f"{c} {k}" for c, k in t("customer").dtypes))
    return rounded(rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"), F.min("c_name").alias("first_name")), 2)


@query("SELECT p_brand, count(DISTINCT p_name) AS n, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY 1")
def json_round_trip(t: Callable) -> DataFrame:
    """#5, #22: an index written as JSON lines and read again."""
    spark, path = t("region").sparkSession, _path(t, "index") + ".json"
    io.write_index(t("part").groupBy("p_brand").agg(F.collect_set("p_name").alias("names"), F.array_sort(F.collect_set("p_type")).alias("types")), path)
    rows = io.read_any(spark, path, schema="p_brand string, names array<string>, types array<string>")
    return rows.select("p_brand", F.size("names").cast("long").alias("n"), F.array_join("types", ",").alias("types"))


@query("SELECT 'nodes' AS part, count(*) AS n FROM (SELECT p_partkey FROM part UNION ALL SELECT s_suppkey FROM supplier) UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def graph_export(t: Callable) -> DataFrame:
    """#19: nodes and edges as CSV for graph loaders, counted from the files by their headers."""
    spark, path = t("region").sparkSession, _path(t, "graph")
    node = lambda f, c, p, label: f.select(F.concat(F.lit(p), F.col(c).cast("string")).alias("node_id"), F.lit(label).alias("label"))
    edges = t("lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target_id"), F.lit("TARGETS").alias("edge_type")).distinct()
    io.graph_csv(node(t("part"), "p_partkey", "P", "Compound").unionByName(node(t("supplier"), "s_suppkey", "S", "Gene")), edges, path)
    read = lambda part, c: spark.read.option("header", True).csv(f"{path}/{part}").where(F.col(f"`{c}`").isNotNull()).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return read("nodes", ":ID").unionByName(read("edges", ":START_ID"))


@query("SELECT o_orderpriority, count(*) AS n, CAST(CASE WHEN o_orderpriority < '3' THEN 1 ELSE 2 END AS INT) AS run FROM orders GROUP BY 1")
def resumed_shards(t: Callable) -> DataFrame:
    """#23-24: shards written in a first run are passed over by the second."""
    spark, path = t("region").sparkSession, _path(t, "shards")
    rows = t("orders").select("o_orderkey", "o_orderpriority")
    io.write_shards(rows.where("o_orderpriority < '3'").withColumn("run", F.lit(1)), path, "o_orderpriority")
    io.write_shards(rows.withColumn("run", F.lit(2)), path, "o_orderpriority")
    return spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("run").alias("run"))


@query("SELECT * FROM (VALUES ('nation', 'different'), ('part', 'new')) v(name, reason)")
def changed_tables(t: Callable) -> DataFrame:
    """#25: what a rerun has to do: one table has grown, one is new, one is as it was."""
    spark, path = t("region").sparkSession, _path(t, "manifest")
    for name in ("nation", "region", "part"):
        io.write_table(t(name), f"{path}/{name}.parquet")
    before = io.manifest(spark, {n: f"{path}/{n}.parquet" for n in ("nation", "region")})
    before = spark.createDataFrame(before.collect(), before.schema)  # three rows
    io.write_table(t("nation").unionByName(t("nation")), f"{path}/nation.parquet", overwrite=True)
    return io.changed(before, io.manifest(spark, {n: f"{path}/{n}.parquet" for n in ("nation", "region", "part")}))


@query("SELECT * FROM (VALUES ('customer.parquet', 'party'), ('part.parquet', 'item'), ('supplier.parquet', 'party')) v(name, kinds)")
def found_sources(t: Callable) -> DataFrame:
    """#8-9, #26, #245: tables found by pattern and told apart by their columns; the best of a kind is in the tests."""
    spark, path = t("region").sparkSession, _path(t, "found")
    io.write_table(t("part"), f"{path}/part.parquet")
    for name, column in (("customer", "c_name"), ("supplier", "s_name")):
        io.write_table(t(name).withColumnRenamed(column, "party_name"), f"{path}/{name}.parquet")
    found = io.inventory(spark, path, {"item": {"p_partkey"}, "party": {"party_name"}})
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.array_join("kinds", ",").alias("kinds"))


@query("SELECT 'T:' || n_nationkey AS id, n_name AS name, 'T:R' || n_regionkey AS parent, n_regionkey < 2 AS slim FROM nation")
def ontology_terms(t: Callable) -> DataFrame:
    """#14-15: an ontology file written from the nations, its terms, parents and slim subset read back."""
    spark, path = t("region").sparkSession, _path(t, "terms")
    block = F.concat(F.lit("[Term]\nid: T:"), F.col("n_nationkey").cast("string"), F.lit("\nname: "), "n_name", F.lit("\nis_a: T:R"), F.col("n_regionkey").cast("string"), F.lit(" ! region"), F.when(F.col("n_regionkey") < 2, "\nsubset: slim\n").otherwise("\n"))
    t("nation").select(block.alias("value")).write.text(path)
    return io.read_ontology(spark, path).select("id", "name", F.element_at("parents", 1).alias("parent"), F.array_contains("subsets", "slim").alias("slim"))
