"""Mediation queries. Brands stand in for ingredients, suppliers of their most discounted lines for compounds, nations for
genes, regions for pathways, order priorities for categories; a pair's effect is how often it is ordered together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import basket, mediation
from weftline.plans.registry import query, rounded

ATLAS = """items AS (SELECT DISTINCT o_orderpriority AS category, l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey),
atlas AS (SELECT x.category, x.item AS a, y.item AS b, count(*) AS n FROM items x JOIN items y ON x.basket = y.basket AND x.item < y.item GROUP BY ALL),
pairs AS (SELECT DISTINCT a, b FROM atlas)"""
SETS = """hc AS (SELECT DISTINCT p_brand AS node, l_suppkey AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount >= 0.1),
hg AS (SELECT DISTINCT node, s_nationkey AS s FROM hc JOIN supplier ON s = s_suppkey), hp AS (SELECT DISTINCT node, n_regionkey AS s FROM hg JOIN nation ON s = n_nationkey),
maps AS (SELECT DISTINCT r_regionkey AS p, o_orderpriority AS category FROM region JOIN orders ON left(o_orderpriority, 1) = CAST(r_regionkey + 1 AS VARCHAR)),
targets AS (SELECT DISTINCT l_suppkey AS c, l_returnflag || l_linestatus AS target FROM lineitem WHERE l_tax >= 0.08)"""


def _shared_sql(name: str, table: str, what: str = "count(*)") -> str:
    return f"{name} AS (SELECT a, b, {what} AS n FROM pairs JOIN {table} x ON x.node = a JOIN {table} y ON y.node = b AND y.s = x.s GROUP BY 1, 2)"


FEATURES = f"""{ATLAS}, {SETS}, {_shared_sql('sc', 'hc')}, {_shared_sql('sg', 'hg')}, {_shared_sql('sp', 'hp')}, wp AS (SELECT node, sum(1.0 / (s + 1)) AS w FROM hp GROUP BY 1),
wc AS (SELECT category, count(*) AS k, sum(1.0 / (p + 1)) AS w FROM maps GROUP BY 1), nt AS (SELECT c, count(*) AS n FROM targets GROUP BY 1), ht AS (SELECT DISTINCT node, target AS s FROM hc JOIN targets ON c = s),
hn AS (SELECT node, s, n FROM hc JOIN nt ON c = s), {_shared_sql('tc', 'hn', 'sum(x.n)')}, {_shared_sql('tt', 'ht')},
f AS (SELECT atlas.category, atlas.a, atlas.b, atlas.n AS n_ab, coalesce(sc.n, 0) AS shared_compounds, coalesce(sg.n, 0) AS shared_genes,
  CAST(CASE WHEN wa.w IS NULL AND wb.w IS NULL THEN coalesce(wc.k, 0) ELSE coalesce(sp.n, 0) END AS BIGINT) AS shared_pathways,
  CAST(CASE WHEN wa.w IS NULL AND wb.w IS NULL THEN coalesce(wc.w, 0) ELSE (coalesce(wa.w, 0) + coalesce(wb.w, 0)) / 2 END AS DOUBLE) AS path_score,
  CAST(coalesce(tc.n, 0) AS BIGINT) AS target_count, CAST(coalesce(tt.n, 0) AS BIGINT) AS target_overlap FROM atlas LEFT JOIN sc USING (a, b) LEFT JOIN sg USING (a, b) LEFT JOIN sp USING (a, b)
  LEFT JOIN wp wa ON wa.node = atlas.a LEFT JOIN wp wb ON wb.node = atlas.b LEFT JOIN wc ON wc.category = atlas.category LEFT JOIN tc USING (a, b) LEFT JOIN tt USING (a, b)),
fs AS (SELECT *, least(1.0, shared_genes / 10 + shared_compounds / 5 + shared_pathways / 5)::DOUBLE AS confidence, (shared_compounds + target_count) / (1.0 + n_ab) AS score FROM f)"""


def atlas_of(t: Callable) -> DataFrame:
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("category"))
    lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(orders, "l_orderkey")
    items = lines.select("category", F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item")).distinct()
    return basket.pair_counts(items, ["category"]).select("category", F.col("item_a").alias("a"), F.col("item_b").alias("b"), F.col("n_ab").alias("n_ab"))


def edge_tables(t: Callable) -> dict[str, DataFrame]:
    lines = t("lineitem").where("l_discount >= 0.1").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    text = lambda c: F.col(c).cast("string")
    priorities = t("orders").select("o_orderpriority").distinct()
    maps = t("region").join(priorities, F.substring("o_orderpriority", 1, 1) == (F.col("r_regionkey") + 1).cast("string"))
    return {
        "HAS_COMPOUND": lines.select(F.col("p_brand").alias("source_id"), F.concat(F.lit("S"), text("l_suppkey")).alias("target_id")).distinct(),
        "TARGETS": t("supplier").select(F.concat(F.lit("S"), text("s_suppkey")).alias("source_id"), F.concat(F.lit("N"), text("s_nationkey")).alias("target_id")).distinct(),
        "IN_PATHWAY": t("nation").select(F.concat(F.lit("N"), text("n_nationkey")).alias("source_id"), F.concat(F.lit("R"), text("n_regionkey")).alias("target_id")).distinct(),
        "MAPS_TO_CATEGORY": maps.select(F.concat(F.lit("R"), text("r_regionkey")).alias("source_id"), F.col("o_orderpriority").alias("target_id")).distinct(),
    }


def edges_of(t: Callable) -> DataFrame:
    out = None
    for kind, frame in edge_tables(t).items():
        own = frame.withColumn("edge_type", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return out


def features_of(t: Callable) -> DataFrame:
    weights = t("region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("reached"), (1 / (F.col("r_regionkey") + 1)).alias("weight"))
    targets = t("lineitem").where("l_tax >= 0.08").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("compound"), F.concat("l_returnflag", "l_linestatus").alias("target"))
    out = mediation.features(atlas_of(t), edges_of(t), weights, targets)
    return out.withColumn("score", (F.col("shared_compounds") + F.col("target_count")) / (1 + F.col("n_ab")))


@query(f"WITH {FEATURES} SELECT category, a, b, n_ab, shared_compounds, shared_genes, shared_pathways, round(path_score, 6) AS mediated_path_score, round(confidence, 6) AS mediation_confidence, target_count, target_overlap FROM fs")
def mediation_features(t: Callable) -> DataFrame:
    """#183, #48."""
    return rounded(features_of(t).drop("score"))


@query(f"WITH {SETS.split(', targets AS')[0]} SELECT 'compound' AS kind, node, 'S' || s AS reached FROM hc UNION ALL SELECT 'gene', node, 'N' || s FROM hg UNION ALL SELECT 'pathway', node, 'R' || s FROM hp")
def multi_hop_paths(t: Callable) -> DataFrame:
    """#48: what each ingredient reaches in one, two and three steps."""
    edges, out = edges_of(t), None
    for kind, steps in (("compound", 1), ("gene", 2), ("pathway", 3)):
        own = mediation.hops(edges, *("HAS_COMPOUND", "TARGETS", "IN_PATHWAY")[:steps]).select(F.lit(kind).alias("kind"), "node", "reached")
        out = own if out is None else out.unionByName(own)
    return out


def _graph(t: Callable) -> tuple[DataFrame, DataFrame]:
    e = edge_tables(t)
    atlas = atlas_of(t).select("a", "b", "category", (F.col("n_ab") / 1000).alias("did"), (1 / F.col("n_ab")).alias("q"))
    maps = e["MAPS_TO_CATEGORY"].select("source_id", F.concat(F.lit("CAT_"), "target_id").alias("target_id"))
    return mediation.graph(atlas, e["HAS_COMPOUND"], e["TARGETS"], e["IN_PATHWAY"], maps)


GRAPH = f"""{ATLAS}, {SETS}, e AS (SELECT 'INT_' || a || '_' || b AS source_id, a AS target_id, 'HAS_INGREDIENT' AS edge_type, 'A' AS role, NULL::DOUBLE AS did, NULL::DOUBLE AS q FROM pairs UNION ALL SELECT 'INT_' || a || '_' || b, b, 'HAS_INGREDIENT', 'B', NULL, NULL FROM pairs
UNION ALL SELECT 'INT_' || a || '_' || b, 'CAT_' || category, 'AFFECTS', NULL, round(n / 1000, 6), round(1 / n, 6) FROM atlas UNION ALL SELECT node, 'S' || s, 'HAS_COMPOUND', NULL, NULL, NULL FROM hc
UNION ALL SELECT DISTINCT 'S' || s_suppkey, 'N' || s_nationkey, 'TARGETS', NULL, NULL, NULL FROM supplier UNION ALL SELECT DISTINCT 'N' || n_nationkey, 'R' || n_regionkey, 'IN_PATHWAY', NULL, NULL, NULL FROM nation
UNION ALL SELECT 'R' || p, 'CAT_' || category, 'MAPS_TO_CATEGORY', NULL, NULL, NULL FROM maps)"""


@query(f"WITH {GRAPH} SELECT source_id, target_id, edge_type, role, did, q FROM e")
def mediation_graph_edges(t: Callable) -> DataFrame:
    """#159: the edges."""
    return rounded(_graph(t)[1])


@query(f"""WITH {GRAPH}, k AS (SELECT source_id AS node_id, CASE edge_type WHEN 'HAS_INGREDIENT' THEN 'Interaction' WHEN 'TARGETS' THEN 'Compound' WHEN 'IN_PATHWAY' THEN 'Gene' WHEN 'MAPS_TO_CATEGORY' THEN 'Pathway' END AS label FROM e WHERE edge_type NOT IN ('AFFECTS', 'HAS_COMPOUND')
UNION ALL SELECT target_id, CASE edge_type WHEN 'HAS_INGREDIENT' THEN 'Ingredient' WHEN 'AFFECTS' THEN 'Category' WHEN 'HAS_COMPOUND' THEN 'Compound' WHEN 'TARGETS' THEN 'Gene' WHEN 'IN_PATHWAY' THEN 'Pathway' ELSE 'Category' END FROM e) SELECT node_id, min(label) AS label FROM k GROUP BY 1""")
def mediation_graph_nodes(t: Callable) -> DataFrame:
    """#159: the nodes."""
    return _graph(t)[0]


@query(f"WITH {FEATURES} SELECT 'INT_' || a || '_' || b AS source_id, 'R' || p AS target_id, 'MEDIATED_BY' AS edge_type, round(score, 6) AS score FROM fs JOIN maps USING (category) WHERE shared_pathways > 0")
def mediated_by_edges(t: Callable) -> DataFrame:
    """#160."""
    return rounded(mediation.mediated_by(features_of(t), edge_tables(t)["MAPS_TO_CATEGORY"]))


@query(f"WITH {FEATURES} SELECT 'INT_' || a || '_' || b AS source_id, 'CAT_' || category AS target_id, round(n_ab / 1000, 6) AS did, round(score, 6) AS score FROM fs")
def affects_with_score(t: Callable) -> DataFrame:
    """#161: effect edges joined with the pair's score."""
    scored = features_of(t).select(F.concat_ws("_", F.lit("INT"), "a", "b").alias("source_id"), F.concat(F.lit("CAT_"), "category").alias("target_id"), "score")
    return rounded(_graph(t)[1].where("edge_type = 'AFFECTS'").select("source_id", "target_id", "did").join(scored, ["source_id", "target_id"], "left"))


@query(f"""WITH {SETS.split(', hg AS')[0]}, seed AS (SELECT DISTINCT p_brand AS node FROM part WHERE p_retailprice >= (SELECT quantile_cont(p_retailprice, 0.999) FROM part))
SELECT x.node, y.node AS seed, count(*) AS n_shared FROM hc x JOIN hc y ON x.s = y.s WHERE x.node NOT IN (SELECT node FROM seed) AND y.node IN (SELECT node FROM seed) GROUP BY 1, 2 HAVING count(*) >= 2""")
def one_hop_expansion(t: Callable) -> DataFrame:
    """#162: brands that share suppliers with the brands of the dearest parts."""
    cut = t("part").agg(F.percentile("p_retailprice", 0.999).alias("cut"))
    seeds = t("part").join(F.broadcast(cut)).where("p_retailprice >= cut").select(F.col("p_brand").alias("node")).distinct()
    return mediation.one_hop(seeds, mediation.hops(edges_of(t), "HAS_COMPOUND"), 2)


@query(f"""WITH {ATLAS}, {SETS}, n AS (SELECT count(DISTINCT basket) AS n FROM items), f AS (SELECT item, count(DISTINCT basket) / any_value(n.n) AS f FROM items, n GROUP BY 1), c AS (SELECT node, count(*) AS c FROM hc GROUP BY 1),
p AS (SELECT item, greatest(1e-6, f * (1 + 0.1 * coalesce(c, 0))) AS p FROM f LEFT JOIN c ON node = item) SELECT a, b, round(x.p, 6) AS proxy_a, round(y.p, 6) AS proxy_b, round(sqrt(x.p * y.p), 6) AS proxy_ab FROM pairs JOIN p x ON x.item = a JOIN p y ON y.item = b""")
def dose_proxies(t: Callable) -> DataFrame:
    """#186."""
    lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    items = basket.distinct_items(lines, "l_orderkey", "p_brand")
    out = mediation.dose_proxy(atlas_of(t).select("a", "b").distinct(), items, mediation.hops(edges_of(t), "HAS_COMPOUND"))
    return rounded(out.select("a", "b", "proxy_a", "proxy_b", "proxy_ab"))


@query(f"""WITH {FEATURES}, d AS (SELECT DISTINCT basket, item FROM items), tr AS (SELECT x.item AS a, y.item AS b, z.item AS c FROM d x JOIN d y ON x.basket = y.basket AND x.item < y.item JOIN d z ON z.basket = x.basket AND y.item < z.item GROUP BY ALL HAVING count(*) >= 3),
k AS (SELECT tr.a, tr.b, tr.c, fs.category, fs.score, fs.path_score FROM tr JOIN fs ON (fs.a, fs.b) IN ((tr.a, tr.b), (tr.a, tr.c), (tr.b, tr.c))),
g AS (SELECT a, b, c, category, count(*) AS n_pairs, sum(1 / (score + 1e-12)) AS inv, max(score) AS top, least(1.0, avg(path_score) FILTER (path_score > 0)) AS boost FROM k GROUP BY ALL)
SELECT a, b, c, category, n_pairs, round(1 / (1 + exp(-CASE n_pairs WHEN 1 THEN top * 0.65 WHEN 2 THEN n_pairs / inv * 0.85 ELSE n_pairs / inv END)) * (0.7 + 0.3 * coalesce(boost, 0)), 6) AS score FROM g""")
def triplet_category_scores(t: Callable) -> DataFrame:
    """#187."""
    lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    triplets = basket.triplets(basket.distinct_items(lines, "l_orderkey", "p_brand"), 3).select(F.col("item_a").alias("a"), F.col("item_b").alias("b"), F.col("item_c").alias("c"))
    return rounded(mediation.triplet_scores(triplets, features_of(t).withColumn("propagated", F.col("mediated_path_score"))))


@query(f"""WITH {FEATURES}, c AS (SELECT category, quantile_cont(score, 0.75) AS cut FROM fs GROUP BY 1) SELECT category, a, b, round(score, 6) AS score FROM fs JOIN c USING (category) WHERE confidence >= 0.8 AND shared_genes / 25 >= 0.5 AND score >= cut""")
def high_confidence_pairs(t: Callable) -> DataFrame:
    """#188: all three gates."""
    rows = features_of(t).withColumns({"confidence": F.col("mediation_confidence"), "stability": F.col("shared_genes") / 25})
    return rounded(mediation.high_confidence(rows, "category").select("category", "a", "b", "score"))


@query(f"""WITH {FEATURES} SELECT category, a, b, round(1 / n_ab, 6) AS q, shared_compounds = 0 AS no_compound, target_overlap = 0 AS no_target FROM fs WHERE score <= 0.02 ORDER BY 1 / n_ab, shared_genes DESC, category, a, b LIMIT 50""")
def missing_evidence(t: Callable) -> DataFrame:
    """#189: weakest rows with what they lack (scores up to .02 count as zero here)."""
    rows = features_of(t).withColumns({"score": F.when(F.col("score") <= 0.02, 0.0).otherwise(F.col("score")), "q": 1 / F.col("n_ab"), "stability": F.col("shared_genes")})
    flags = {"no_compound": F.col("shared_compounds") == 0, "no_target": F.col("target_overlap") == 0}
    return rounded(mediation.missing_evidence(rows, flags, 50, ["category", "a", "b"]).select("category", "a", "b", "q", "no_compound", "no_target"))


@query(f"""WITH {FEATURES}, p AS (SELECT min(a) AS a FROM pairs), q AS (SELECT a, min(b) AS b FROM pairs JOIN p USING (a) GROUP BY 1)
SELECT q.a, q.b, (SELECT string_agg(category, ',' ORDER BY score DESC, category) FROM fs WHERE fs.a = q.a AND fs.b = q.b) AS categories,
(SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT 'S' || x.s AS s FROM hc x JOIN hc y ON x.s = y.s AND x.node = q.a AND y.node = q.b ORDER BY 1 LIMIT 10)) AS compounds,
(SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT 'N' || x.s AS s FROM hg x JOIN hg y ON x.s = y.s AND x.node = q.a AND y.node = q.b ORDER BY 1 LIMIT 10)) AS genes FROM q""")
def pair_explanation(t: Callable) -> DataFrame:
    """#190, for the first pair."""
    scored, edges = features_of(t), edges_of(t)
    a, b = scored.agg(F.min(F.struct("a", "b"))).first()[0]
    out = mediation.explain_pair(scored, {"compounds": mediation.hops(edges, "HAS_COMPOUND"), "genes": mediation.hops(edges, "HAS_COMPOUND", "TARGETS")}, a, b)
    return out.select("a", "b", *[F.array_join(c, ",").alias(c) for c in ("categories", "compounds", "genes")])


PROPAGATED = f"""{ATLAS}, {SETS}, reach AS (SELECT c_nationkey AS g, s_nationkey % 5 AS p, sum(l_quantity) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
sc AS (SELECT g, p, s / max(s) OVER (PARTITION BY g) AS s FROM reach), sums AS (SELECT node, p, sum(sc.s) AS s FROM hg JOIN sc ON sc.g = hg.s GROUP BY 1, 2), sh AS (SELECT node, p, s / sum(s) OVER (PARTITION BY node) AS s FROM sums),
m2 AS (SELECT p, category FROM maps WHERE p < 4), rs AS (SELECT *, CASE WHEN category IN (SELECT category FROM m2) THEN category WHEN category = '5-LOW' THEN '1-URGENT' ELSE category END AS resolved FROM atlas),
v AS (SELECT rs.category, rs.a, rs.b, sum(2 * x.s * y.s / (x.s + y.s + 1e-12)) AS v FROM rs JOIN m2 ON m2.category = resolved JOIN sh x ON x.node = rs.a AND x.p = m2.p JOIN sh y ON y.node = rs.b AND y.p = m2.p GROUP BY ALL),
pr AS (SELECT rs.category, a, b, resolved, CASE WHEN coalesce(v, 0) = 0 AND resolved IN (SELECT category FROM m2) AND a IN (SELECT node FROM hg) AND b IN (SELECT node FROM hg) THEN 1e-6 ELSE coalesce(v, 0) END AS propagated FROM rs LEFT JOIN v USING (category, a, b))"""


def _propagated(t: Callable) -> DataFrame:
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    reach = lines.groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("gene"), F.concat(F.lit("R"), (F.col("s_nationkey") % 5).cast("string")).alias("pathway")).agg(F.sum("l_quantity").alias("score"))
    genes = mediation.hops(edges_of(t), "HAS_COMPOUND", "TARGETS").withColumnRenamed("reached", "gene")
    maps = edge_tables(t)["MAPS_TO_CATEGORY"].toDF("pathway", "category").where("pathway <> 'R4'")
    return mediation.pair_propagation(atlas_of(t).select("category", "a", "b"), reach, genes, maps, {"5-LOW": "1-URGENT"})


@query(f"WITH {PROPAGATED} SELECT category, a, b, round(propagated, 6) AS propagated FROM pr")
def pair_propagation(t: Callable) -> DataFrame:
    """#164: from given gene-to-pathway scores; the fifth category has no pathway of its own and takes its synonym's."""
    return rounded(_propagated(t))


@query(f"WITH {PROPAGATED} SELECT category, CASE WHEN propagated < 0.2 THEN CASE WHEN resolved <> category THEN 'synonym' WHEN a < 'Brand#2' THEN 'early brand' ELSE 'unexplained' END END AS reason, count(*) AS n FROM pr GROUP BY ALL")
def zero_reasons(t: Callable) -> DataFrame:
    """#235: the first reason that holds for rows without a score (under .2 here), counted."""
    rows = _propagated(t).withColumn("propagated", F.when(F.col("propagated") < 0.2, 0.0).otherwise(F.col("propagated")))
    told = mediation.zero_reason(rows, [("synonym", F.col("category") == "5-LOW"), ("early brand", F.col("a") < "Brand#2")])
    return told.groupBy("category", "reason").agg(F.count("*").alias("n"))
