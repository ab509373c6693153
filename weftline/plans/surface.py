"""Queries of the graph surface, indexes and profiles. Brands, suppliers, nations and regions stand in for ingredients,
compounds, genes and pathways."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import graph, profiles, surface
from weftline.plans import mediation as M
from weftline.plans.registry import query, rounded


@query("""WITH n AS (SELECT 'P' || p_partkey AS node_id, 'Compound' AS label, p_name AS name FROM part UNION ALL SELECT 'S' || s_suppkey, 'Gene', s_name FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'Tissue', n_name FROM nation)
SELECT node_id, label, name FROM n WHERE contains(lower(name), 'ion_1') ORDER BY name, node_id LIMIT 25""")
def node_search(t: Callable) -> DataFrame:
    """#170."""
    return surface.search(_nodes(t), "ION_1")


def _nodes(t: Callable) -> DataFrame:
    node = lambda f, c, prefix, label, name: f.select(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("node_id"), F.lit(label).alias("label"), F.col(name).alias("name"))
    return node(t("part"), "p_partkey", "P", "Compound", "p_name").unionByName(node(t("supplier"), "s_suppkey", "S", "Gene", "s_name")).unionByName(node(t("nation"), "n_nationkey", "N", "Tissue", "n_name"))


def _edges(t: Callable) -> DataFrame:
    targets = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("m"))
    targets = targets.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target_id"), F.lit("TARGETS").alias("edge_type"), "weight", F.when(F.col("m") == 1, "measured").otherwise("predicted").alias("evidence"))
    lives = t("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("target_id"), F.lit("EXPRESSED_IN").alias("edge_type"), F.col("s_acctbal").alias("weight"), F.lit(None).cast("string").alias("evidence"))
    return targets.unionByName(lives)


EDGES = """e AS (SELECT 'P' || l_partkey AS source_id, 'S' || l_suppkey AS target_id, 'TARGETS' AS edge_type, sum(l_quantity) AS weight, CASE WHEN bool_or(l_returnflag = 'R') THEN 'measured' ELSE 'predicted' END AS evidence FROM lineitem GROUP BY l_partkey, l_suppkey
UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'EXPRESSED_IN', s_acctbal, NULL FROM supplier), n AS (SELECT 'P' || p_partkey AS node_id, 'Compound' AS label, p_name AS name FROM part UNION ALL SELECT 'S' || s_suppkey, 'Gene', s_name FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'Tissue', n_name FROM nation),
b AS (SELECT CASE WHEN source_id = 'S1' THEN target_id ELSE source_id END AS node_id, edge_type, weight, evidence FROM e WHERE source_id = 'S1' OR target_id = 'S1'), x AS (SELECT node_id, label, name, edge_type, weight, evidence FROM b JOIN n USING (node_id))"""


@query(f"WITH {EDGES} SELECT 'all' AS mode, * FROM (SELECT node_id, label, name, edge_type, weight FROM x ORDER BY CASE label WHEN 'Gene' THEN 0 WHEN 'Tissue' THEN 2 ELSE 5 END, weight DESC, edge_type, node_id LIMIT 28) UNION ALL SELECT 'measured', * FROM (SELECT node_id, label, name, edge_type, weight FROM x WHERE edge_type = 'TARGETS' AND evidence = 'measured' ORDER BY weight DESC, edge_type, node_id LIMIT 40) UNION ALL SELECT 'compounds', * FROM (SELECT node_id, label, name, edge_type, weight FROM x WHERE label = 'Compound' ORDER BY weight DESC, edge_type, node_id LIMIT 40)")
def node_expansion(t: Callable) -> DataFrame:
    """#54, #171, #182: neighbours of a node in the three modes."""
    n, e, out = _nodes(t), _edges(t), None
    for mode, args in (("all", {}), ("measured", {"evidence": "measured"}), ("compounds", {"kind": "Compound"})):
        own = surface.expand(n, e, "S1", **args).withColumn("mode", F.lit(mode))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"WITH {EDGES} SELECT label, count(*) AS n FROM n GROUP BY 1")
def node_counts(t: Callable) -> DataFrame:
    """#172, by label."""
    return _nodes(t).groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT c_nationkey AS food, l_partkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), g AS (SELECT l_partkey AS c, count(DISTINCT l_suppkey) AS genes FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT food, c AS compound, p_name AS name, genes FROM e JOIN g USING (c) JOIN part ON p_partkey = c WHERE p_name NOT LIKE '%phospho%' AND NOT starts_with(p_name, 'PC(') QUALIFY row_number() OVER (PARTITION BY food ORDER BY genes DESC, c) <= 15""")
def curated_compounds(t: Callable) -> DataFrame:
    """#176: named compounds with a gene, the first 15 of each food."""
    from weftline.functions.texts import lipid_like

    e = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("food"), F.col("l_partkey").alias("compound")).distinct()
    genes = t("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("compound")).agg(F.countDistinct("l_suppkey").alias("genes"))
    named = t("part").where(~lipid_like(F.col("p_name"))).select(F.col("p_partkey").alias("compound"), F.col("p_name").alias("name"))
    return profiles.top_per_group(e.join(genes, "compound").join(named, "compound"), ["food"], [F.desc("genes"), "compound"], 15).drop("rank")


LISTS = "SELECT {by}, string_agg({item}, ',' ORDER BY r) AS items, count(*) AS n FROM (SELECT {by}, CAST({item} AS VARCHAR) AS {item}, row_number() OVER (PARTITION BY {by} ORDER BY s DESC, {item}) AS r FROM k) WHERE r <= {most} GROUP BY 1"


@query(f"WITH k AS (SELECT p_brand, l_suppkey, count(DISTINCT l_partkey) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) {LISTS.format(by='p_brand', item='l_suppkey', most=10)}")
def top_genes_per_ingredient(t: Callable) -> DataFrame:
    """#179: by the compounds that lead there, the first 10."""
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return surface.top_lists(rows, "p_brand", "l_suppkey", F.countDistinct("l_partkey"), 10)


@query(f"WITH k AS (SELECT l_suppkey, p_type, count(*) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) {LISTS.format(by='l_suppkey', item='p_type', most=10)}")
def top_pathways_per_gene(t: Callable) -> DataFrame:
    """#179."""
    return surface.top_lists(t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")), "l_suppkey", "p_type", F.count("*"), 10)


@query(f"WITH {M.FEATURES}, i AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, a, b) AS r FROM fs) SELECT category, string_agg('INT_' || a || '_' || b, ',' ORDER BY r) AS items, count(*) AS n FROM i WHERE r <= 15 GROUP BY 1")
def top_interactions_per_category(t: Callable) -> DataFrame:
    """#178-180: the first 15 of each category."""
    rows = M.features_of(t).withColumn("i", F.concat_ws("_", F.lit("INT"), "a", "b"))
    top = profiles.top_per_group(rows, ["category"], [F.desc("score"), "a", "b"], 15)
    return top.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "i"))), lambda x: x["i"]), ",").alias("items"), F.count("*").alias("n"))


@query(f"WITH {M.FEATURES} SELECT 'INT_' || a || '_' || b AS interaction, a || ' + ' || b AS ingredients, category, round(score, 6) AS score FROM fs ORDER BY round(score, 6) DESC, category, a, b LIMIT 25")
def top_interactions(t: Callable) -> DataFrame:
    """#178: interactions with their ingredients and category, by score."""
    rows = M.features_of(t).select(F.concat_ws("_", F.lit("INT"), "a", "b").alias("interaction"), F.concat_ws(" + ", "a", "b").alias("ingredients"), "category", F.round("score", 6).alias("score"), "a", "b")
    return rows.orderBy(F.desc("score"), "category", "a", "b").limit(25).drop("a", "b")


@query(f"""WITH {M.FEATURES}, l AS (SELECT 'INT_' || a || '_' || b AS i, CASE WHEN p = 0 THEN 'Unknown pathway' ELSE 'R' || p END AS p FROM fs JOIN maps USING (category) WHERE shared_pathways > 0 AND score > 0.1), k AS (SELECT i, count(*) AS total, count(*) FILTER (p <> 'Unknown pathway') AS known FROM l GROUP BY 1),
x AS (SELECT DISTINCT 'INT_' || a || '_' || b AS i FROM fs) SELECT i, CASE WHEN total IS NULL THEN 'no_mediated_pathway' ELSE 'only_unknown_pathway' END AS reason FROM x LEFT JOIN k USING (i) WHERE total IS NULL OR known = 0""")
def weak_interactions(t: Callable) -> DataFrame:
    """#178: interactions with only the unknown pathway (region 0 here) or none."""
    rows = M.features_of(t).withColumn("i", F.concat_ws("_", F.lit("INT"), "a", "b"))
    maps = M.edge_tables(t)["MAPS_TO_CATEGORY"].toDF("p", "category").withColumn("p", F.when(F.col("p") == "R0", "Unknown pathway").otherwise(F.col("p")))
    links = rows.where("shared_pathways > 0 AND score > 0.1").join(maps, "category")
    return surface.only_unknown(links, rows, "i", "p", "Unknown pathway")


@query(f"WITH {M.FEATURES}, l AS (SELECT category, 'INT_' || a || '_' || b AS i, 'R' || p AS p, score FROM fs JOIN maps USING (category) WHERE shared_pathways > 0) SELECT p AS pathway, count(*) AS mediations, count(DISTINCT i) AS interactions, count(DISTINCT category) AS categories, round(avg(score), 6) AS mean_score FROM l GROUP BY 1")
def mediation_counts(t: Callable) -> DataFrame:
    """#180: how often each pathway mediates, over how many interactions and categories."""
    rows = M.features_of(t).where("shared_pathways > 0").join(M.edge_tables(t)["MAPS_TO_CATEGORY"].toDF("pathway", "category"), "category").withColumn("i", F.concat_ws("_", F.lit("INT"), "a", "b"))
    return rounded(rows.groupBy("pathway").agg(F.count("*").alias("mediations"), F.countDistinct("i").alias("interactions"), F.countDistinct("category").alias("categories"), F.avg("score").alias("mean_score")))


@query(f"WITH {M.FEATURES} SELECT 'S' || s AS compound, count(DISTINCT a || b) AS interactions FROM pairs JOIN hc ON node = a OR node = b GROUP BY 1")
def compound_reuse(t: Callable) -> DataFrame:
    """#180: in how many interactions each compound takes part."""
    pairs = M.atlas_of(t).select("a", "b").distinct()
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("source_id")).join(M.edge_tables(t)["HAS_COMPOUND"], "source_id")
    return ends.groupBy(F.col("target_id").alias("compound")).agg(F.countDistinct("a", "b").alias("interactions"))


@query(f"WITH {M.ATLAS}, {M.SETS} SELECT DISTINCT node AS ingredient, 'S' || s AS compound, 'N' || s_nationkey AS gene, 'R' || n_regionkey AS pathway, category FROM hc JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = s_nationkey JOIN maps ON p = n_regionkey")
def showcase_paths(t: Callable) -> DataFrame:
    """#181: whole paths from ingredients to categories."""
    e = M.edge_tables(t)
    step = lambda k, a, b: e[k].toDF(a, b)
    return step("HAS_COMPOUND", "ingredient", "compound").join(step("TARGETS", "compound", "gene"), "compound").join(step("IN_PATHWAY", "gene", "pathway"), "gene").join(step("MAPS_TO_CATEGORY", "pathway", "category"), "pathway").select("ingredient", "compound", "gene", "pathway", "category").distinct()


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS e, l_partkey AS s FROM lineitem), d AS (SELECT s, count(*) AS deg FROM e GROUP BY 1), p AS (SELECT a.e AS a, b.e AS b, count(*) AS n, round(sum(1 / deg), 6) AS sp FROM e a JOIN e b ON a.s = b.s AND a.e <> b.e JOIN d ON d.s = a.s GROUP BY ALL HAVING count(*) >= 3)
SELECT a, b, n AS n_shared, sp AS specificity, round(100 * sp / max(sp) OVER (PARTITION BY a), 0)::BIGINT AS percent FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY sp DESC, b) <= 12""")
def similar_items_percent(t: Callable) -> DataFrame:
    """#175: the twelve most similar of each, in percent of the best."""
    pairs = rounded(graph.similar_by_shared(t("lineitem"), "l_suppkey", "l_partkey", 3))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n_shared", "specificity"))
    top = profiles.top_per_group(both, ["a"], [F.desc("specificity"), "b"], 12)
    return top.withColumn("percent", F.round(100 * F.col("specificity") / F.max("specificity").over(Window.partitionBy("a"))).cast("long")).drop("rank")


@query("""WITH a AS (SELECT lower(trim(n)) AS alias, id, o FROM (SELECT p_name AS n, p_brand AS id, p_partkey AS o FROM part UNION ALL SELECT upper(p_type) || ' ', p_brand, p_partkey + 1000000 FROM part UNION ALL SELECT p_brand, p_brand, p_partkey + 2000000 FROM part)) SELECT alias, id FROM a WHERE alias <> '' QUALIFY row_number() OVER (PARTITION BY alias ORDER BY o) = 1""")
def alias_lookup(t: Callable) -> DataFrame:
    """#203: the first that names it wins."""
    p = t("part")
    rows = p.select(F.col("p_name").alias("alias"), F.col("p_brand").alias("id"), F.col("p_partkey").alias("o"))
    rows = rows.unionByName(p.select(F.concat(F.upper("p_type"), F.lit(" ")).alias("alias"), F.col("p_brand").alias("id"), (F.col("p_partkey") + 1_000_000).alias("o")))
    return surface.first_alias(rows.unionByName(p.select(F.col("p_brand").alias("alias"), F.col("p_brand").alias("id"), (F.col("p_partkey") + 2_000_000).alias("o"))), ["o"])


@query("""WITH q AS (SELECT n_name AS query FROM nation UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT 'ation_1' UNION ALL SELECT 'absent' UNION ALL SELECT 'PPLIER#00000000' UNION ALL SELECT 'hot'), k AS (SELECT n_name AS name FROM nation UNION SELECT s_name FROM supplier UNION SELECT p_name FROM part),
l AS (SELECT query, min(name) FILTER (name = query) AS e, min(name) FILTER (lower(name) = lower(query)) AS c, arg_min(name, (length(name), name)) FILTER (contains(lower(name), lower(query))) AS p FROM (SELECT DISTINCT query FROM q), k GROUP BY 1)
SELECT query, coalesce(e, c, p) AS found, CASE WHEN e IS NOT NULL THEN 'exact' WHEN c IS NOT NULL THEN 'case' WHEN p IS NOT NULL THEN 'part' END AS level FROM q JOIN l USING (query)""")
def name_resolution(t: Callable) -> DataFrame:
    """#46, #210-211: exact, then case ignored, then by part; what is left finds names through trigrams, not a nested loop."""
    n = t("nation").select(F.col("n_name").alias("query"))
    extra = n.sparkSession.createDataFrame([("ation_1",), ("absent",), ("PPLIER#00000000",), ("hot",)], "query string")
    queries = n.unionByName(n.select(F.lower("query").alias("query"))).unionByName(extra)
    names = n.toDF("name").unionByName(t("supplier").select(F.col("s_name").alias("name"))).unionByName(t("part").select(F.col("p_name").alias("name")))
    return surface.resolve(queries, names).select("query", "found", "level")


@query("""WITH c AS (SELECT p_brand AS s, 'P' || l_partkey AS t, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), g AS (SELECT 'P' || l_partkey AS s, 'S' || l_suppkey AS t, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
x AS (SELECT s, t, w, 'CONTAINS' AS k, row_number() OVER (PARTITION BY s ORDER BY w DESC, t) AS r, 50 AS m FROM c UNION ALL SELECT s, t, w, 'TARGETS', row_number() OVER (PARTITION BY s ORDER BY w DESC, t), 20 FROM g UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_acctbal, 'EXPRESSED_IN', 1, 12 FROM supplier)
SELECT s AS source_id, t AS target_id, w AS weight, k AS edge_type FROM x WHERE r <= m""")
def trimmed_graph(t: Callable) -> DataFrame:
    """#169: layers with caps of 50, 20 and 12 edges a source."""
    contains = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("source_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target_id")).agg(F.sum("l_quantity").alias("weight"))
    edges = _edges(t)
    return surface.trimmed_graph([("CONTAINS", contains, 50), ("TARGETS", edges.where("edge_type = 'TARGETS'"), 20), ("EXPRESSED_IN", edges.where("edge_type = 'EXPRESSED_IN'"), 12)])


@query("""WITH n AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS id FROM (SELECT DISTINCT 'P' || l_partkey AS x FROM lineitem UNION SELECT 'S' || l_suppkey FROM lineitem)) SELECT DISTINCT a.id AS src, b.id AS dst FROM lineitem JOIN n a ON a.x = 'P' || l_partkey JOIN n b ON b.x = 'S' || l_suppkey""")
def training_graph(t: Callable) -> DataFrame:
    """#168: dense ids in the order of names, numbered by ranges."""
    from weftline.operators.stats import ranked

    e = t("lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("b")).distinct()
    ids = ranked(e.select(F.col("a").alias("x")).union(e.select("b")).distinct(), ["x"]).select("x", (F.col("__rank") - 1).alias("id"))
    return e.join(ids.toDF("a", "src"), "a").join(ids.toDF("b", "dst"), "b").select("src", "dst")


@query("""WITH RECURSIVE e AS (SELECT n_name AS c, r_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey), w(node, path) AS (SELECT DISTINCT p, [p] FROM e WHERE p NOT IN (SELECT c FROM e) UNION ALL SELECT c, list_prepend(c, path) FROM w JOIN e ON p = node),
h AS (SELECT node, path, list_filter(path, lambda x: x IN ('NATION_1', 'NATION_2', 'ASIA')) AS s FROM w) SELECT node, CASE WHEN len(s) > 0 THEN s[1] WHEN len(path) > 1 THEN path[len(path) - 1] ELSE node END AS slim FROM h""")
def slim_ancestors(t: Callable) -> DataFrame:
    """#167: the nearest ancestor in a list, else the one below the root, else itself."""
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("c"), F.col("r_name").alias("p"))
    suppliers = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("c"), F.col("n_name").alias("p"))
    paths = graph.ancestor_paths(nations.unionByName(suppliers), "c", "p")
    return graph.nearest_slim(paths, paths.sparkSession.createDataFrame([("NATION_1", 0), ("NATION_2", 1), ("ASIA", 2)], "node string, priority int"), depth=1)


@query("""WITH g AS (SELECT DISTINCT o_custkey AS u, l_suppkey + 1000000 AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey), b AS (SELECT u AS n FROM g UNION ALL SELECT v FROM g), d AS (SELECT n, count(*) AS k FROM b GROUP BY 1)
SELECT (SELECT count(*) FROM d) AS nodes, (SELECT count(*) FROM g) AS edges, round(2 * (SELECT count(*) FROM g) / ((SELECT count(*) FROM d)::DOUBLE * ((SELECT count(*) FROM d) - 1)), 6) AS density, round((SELECT avg(k) FROM d), 6) AS mean_degree, (SELECT max(k) FROM d) AS max_degree""")
def graph_statistics(t: Callable) -> DataFrame:
    """#157: size, density and degrees (components are in connected_components_all)."""
    e = graph.undirected(t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b")), "a", "b")
    return rounded(graph.statistics(e))


@query()
def label_propagation(t: Callable) -> DataFrame:
    """#156: communities by the most frequent label around; tested on two cliques."""
    from weftline.operators import basket

    pairs = basket.pair_scores(basket.distinct_items(t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_brand"))
    return graph.label_propagation(pairs.where("pmi > 0").select(F.col("item_a").alias("u"), F.col("item_b").alias("v")))


@query()
def eigenvector_centrality(t: Callable) -> DataFrame:
    """#155: by power iteration to a tolerance; tested against numpy."""
    from weftline.operators import basket

    pairs = basket.pair_counts(basket.distinct_items(t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_brand"))
    return graph.eigenvector(pairs.select(F.col("item_a").alias("u"), F.col("item_b").alias("v")))


@query()
def betweenness_centrality(t: Callable) -> DataFrame:
    """#155: Brandes' sums, one task a source; tested by hand. Nations and regions by shared suppliers' brands."""
    e = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).where("l_discount >= 0.1 AND l_returnflag = 'R'")
    return graph.betweenness(graph.undirected(e.select("p_brand", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("n")), "p_brand", "n"))
