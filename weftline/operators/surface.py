"""The query surface over a graph in tables (nodes: node_id, label, name; edges: source_id, target_id, edge_type, weight, evidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.texts import LIPID_PREFIXES

# The order in which kinds of neighbours are shown.
TYPE_RANK = ("Gene", "Pathway", "Tissue", "Nutrient", "Ingredient")


def search(nodes: DataFrame, text: str, limit: int = 25) -> DataFrame:
    """Nodes whose name contains the text, case ignored; the first ``limit`` by name and id."""
    return nodes.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("name", "node_id").limit(limit)


def expand(nodes: DataFrame, edges: DataFrame, node: object, evidence: str | None = None, kind: str | None = None) -> DataFrame:
    """Neighbours in both directions: of one evidence along TARGETS (first 40), of one label with lipids last (40), or all by label (28)."""
    if evidence:
        edges = edges.where((F.col("edge_type") == "TARGETS") & (F.col("evidence") == evidence))
    near = edges.where((F.col("source_id") == node) | (F.col("target_id") == node))
    other = F.when(F.col("source_id") == node, F.col("target_id")).otherwise(F.col("source_id"))
    found = near.select(other.alias("node_id"), "edge_type", "weight").join(nodes, "node_id")
    lipid = F.lit(False)
    for prefix in LIPID_PREFIXES:
        lipid = lipid | F.col("name").startswith(prefix)
    place = F.lit(len(TYPE_RANK))
    for i, label in reversed(list(enumerate(TYPE_RANK))):
        place = F.when(F.col("label") == label, i).otherwise(place)
    if evidence:
        first, limit = F.lit(0), 40
    elif kind:
        found, first, limit = found.where(F.col("label") == kind), F.coalesce(lipid, F.lit(False)).cast("int"), 40
    else:
        first, limit = place, 28
    return found.withColumn("place", first).orderBy("place", F.desc("weight"), "edge_type", "node_id").limit(limit).select("node_id", "label", "name", "edge_type", "weight")


def top_lists(rows: DataFrame, by: str, item: str, score: Column, most: int) -> DataFrame:
    """``by`` with its ``most`` first distinct items by descending score, as text in order, and their number."""
    best = rows.groupBy(by, item).agg(score.alias("__s"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("__s"), item))
    top = best.withColumn("__r", place).where(F.col("__r") <= most)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(item).cast("string").alias("i")))), lambda x: x["i"])
    return top.groupBy(by).agg(F.array_join(lists, ",").alias("items"), F.count("*").alias("n"))


def only_unknown(links: DataFrame, interactions: DataFrame, key: str, pathway: str, unknown: str) -> DataFrame:
    """Interactions with only the unknown pathway, or with none, and the reason."""
    known = F.count_if(F.col(pathway) != unknown)
    per = links.groupBy(key).agg(F.count("*").alias("total"), known.alias("known"))
    out = interactions.select(key).distinct().join(per, key, "left")
    reason = F.when(F.col("total").isNull(), "no_mediated_pathway").when(F.col("known") == 0, "only_unknown_pathway")
    return out.select(key, reason.alias("reason")).where("reason IS NOT NULL")


def resolve(queries: DataFrame, names: DataFrame, text: str = "query") -> DataFrame:
    """queries with (found, level): exact, then case-insensitive, then the shortest name that holds the query, ties by name.

    Exact levels are equi-joins; only what is left meets the names by substring, through their distinct words' trigrams.
    """
    q = queries.select(text).distinct()
    known = names.select("name").distinct()
    exact = q.join(known, F.col(text) == F.col("name")).select(text, F.col("name").alias("found"), F.lit("exact").alias("level"))
    left = q.join(exact.select(text), text, "left_anti")
    folded = left.join(known, F.lower(text) == F.lower("name")).groupBy(text).agg(F.min("name").alias("found")).withColumn("level", F.lit("case"))
    left = left.join(folded.select(text), text, "left_anti").where(F.length(text) >= 3)
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(F.lower(c), i, F.lit(3)))
    probe = left.select(text, grams(F.col(text))[0].alias("gram"))
    index = known.select("name", F.explode(F.array_distinct(grams(F.col("name")))).alias("gram"))
    near = probe.join(index, "gram").where(F.contains(F.lower("name"), F.lower(text)))
    part = near.groupBy(text).agg(F.min(F.struct(F.length("name").alias("l"), "name")).alias("m")).select(text, F.col("m.name").alias("found"), F.lit("part").alias("level"))
    found = exact.unionByName(folded).unionByName(part)
    return queries.join(found, text, "left")


def first_alias(aliases: DataFrame, order: list) -> DataFrame:
    """(alias, id): of each alias, trimmed and lower-cased, the id that comes first; empty ones go."""
    key = F.lower(F.trim("alias"))
    out = aliases.withColumn("alias", key).where("alias <> ''")
    return out.withColumn("__r", F.row_number().over(Window.partitionBy("alias").orderBy(*order))).where("__r = 1").select("alias", "id")


def trimmed_graph(layers: list[tuple[str, DataFrame, int | None]]) -> DataFrame:
    """One edge table of layers (type, (source_id, target_id, weight), most edges a source), best weights first."""
    out = None
    for kind, rows, most in layers:
        own = rows.select(F.col("source_id").cast("string"), F.col("target_id").cast("string"), F.col("weight").cast("double").alias("weight"))
        if most:
            place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id"))
            own = own.withColumn("__r", place).where(F.col("__r") <= most).drop("__r")
        own = own.withColumn("edge_type", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return out
