"""Queries of themes, tissues and recipe messages. Suppliers stand in for ingredients, part sizes for pathways, parts for genes,
part types for tissues, nations for blends and orders for recipes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import profiles, themes
from weftline.plans import designs as D
from weftline.plans.registry import query, rounded

RULES = [("warm", ["hot", "red"], [1]), ("cold", ["cold|blue"], []), ("metal", ["gear", "bolt"], [2, 3]), ("none", ["absent"], [])]
RULE_SQL = "CASE WHEN regexp_matches(p_name, '(?i)hot|red') OR p_size = 1 THEN 'warm' END, CASE WHEN regexp_matches(p_name, '(?i)cold|blue') THEN 'cold' END, CASE WHEN regexp_matches(p_name, '(?i)gear|bolt') OR p_size IN (2, 3) THEN 'metal' END"
THEMED = f"th AS (SELECT DISTINCT p_size AS pathway, unnest(list_filter([{RULE_SQL}], lambda x: x IS NOT NULL)) AS theme FROM part)"


def rules_of(t: Callable) -> DataFrame:
    rows = [(theme, "|".join(patterns), ids) for theme, patterns, ids in RULES]
    return t("region").sparkSession.createDataFrame(rows, "theme string, pattern string, ids array<int>")


def themed(t: Callable) -> DataFrame:
    return themes.match_themes(t("part").select(F.col("p_size").alias("pathway"), "p_name").distinct(), rules_of(t), "pathway", "p_name")


@query(f"WITH {THEMED} SELECT theme, pathway FROM th")
def theme_matches(t: Callable) -> DataFrame:
    """#39: explicit ids, else patterns; several themes a row."""
    return themed(t)


HITS = f"""{D.ENRICHED}, {THEMED}, hit AS (SELECT theme, entity, pathway, wo / we AS fold, q, nm, k - nm AS np FROM q JOIN th USING (pathway)),
na AS (SELECT count(DISTINCT entity) AS na FROM q), sp AS (SELECT pathway, greatest(0, least(1, ln(na / count(DISTINCT entity)) / ln(na))) AS spec FROM q, na GROUP BY pathway, na), sz AS (SELECT theme, count(*) AS n FROM th GROUP BY 1),
co AS (SELECT theme, entity, count(*) AS breadth, avg(least(fold, 5)) AS st, avg(spec) AS spec, count(*) FILTER (q < 0.1) AS ns, sum(nm) AS m, sum(nm + np) AS su, max(fold) AS best FROM hit JOIN sp USING (pathway) GROUP BY 1, 2),
cn AS (SELECT theme, entity, breadth, ns, best, least(1, st / 5) * (0.4 + 0.6 * spec) AS strength_norm, least(1, ln(1 + breadth) / ln(1 + n) * (0.5 + 0.5 * spec)) AS breadth_norm, m / su AS measured_norm, ns / breadth AS significance_norm FROM co JOIN sz USING (theme))"""


def _hits(t: Callable) -> tuple[DataFrame, DataFrame]:
    e = profiles.weighted_enrichment(D.members_of(t), D.sets_of(t), least=3)
    return e, e.join(themed(t), "pathway").select("theme", "entity", "pathway", F.col("weighted_fold").alias("fold"), "q", "n_measured", "n_predicted")


def _components(t: Callable) -> DataFrame:
    e, hits = _hits(t)
    total = e.agg(F.countDistinct("entity").alias("n_all"))
    return themes.theme_components(hits, themes.specificity(e, "pathway", "entity", total), themed(t).groupBy("theme").agg(F.count("*").alias("n_pathways")))


@query(f"WITH {HITS} SELECT theme, entity, breadth, ns AS n_significant, round(best, 6) AS best_fold, round(strength_norm, 6) AS strength_norm, round(breadth_norm, 6) AS breadth_norm, round(measured_norm, 6) AS measured_norm, round(significance_norm, 6) AS significance_norm FROM cn")
def theme_components(t: Callable) -> DataFrame:
    """#204: the parts of the ranking."""
    return rounded(_components(t))


MOA = f"""{D.MEMBERS}, {THEMED}, dg AS (SELECT DISTINCT theme, entity, gene, c, measured, CASE gene % 3 WHEN 0 THEN 'inhibitor' WHEN 1 THEN 'other' END AS action FROM m JOIN part ON p_partkey = gene JOIN th ON pathway = p_size),
nn AS (SELECT count(DISTINCT entity) AS n FROM m), gs AS (SELECT theme, gene, greatest(0, least(1, ln(n / count(DISTINCT entity)) / ln(n))) AS spec FROM dg, nn GROUP BY theme, gene, n),
mo AS (SELECT theme, entity, least(1, sum(CASE WHEN action = 'inhibitor' THEN c ELSE 0.55 * c * (0.35 + 0.65 * spec) END) / 4) AS moa, count(*) FILTER (action = 'inhibitor') AS na FROM dg JOIN gs USING (theme, gene) WHERE measured GROUP BY 1, 2)"""


def _moa(t: Callable) -> DataFrame:
    m = D.members_of(t).join(t("part").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("pathway")), "gene").join(themed(t), "pathway")
    action = F.when(F.col("gene") % 3 == 0, "inhibitor").when(F.col("gene") % 3 == 1, "other")
    genes = m.select("theme", "entity", "gene", "confidence", "measured", action.alias("action")).distinct()
    counts = genes.groupBy("theme", "gene").agg(F.countDistinct("entity").alias("c")).join(F.broadcast(D.members_of(t).agg(F.countDistinct("entity").alias("n"))))
    spec = counts.select("theme", "gene", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.ln(F.col("n") / F.col("c")) / F.ln(F.col("n").cast("double")))).alias("specificity"))
    return themes.moa_score(genes, spec)


@query(f"WITH {MOA} SELECT theme, entity, round(moa, 6) AS moa_norm, na AS n_with_action FROM mo")
def measured_moa(t: Callable) -> DataFrame:
    """#206."""
    return rounded(_moa(t))


@query(f"WITH {MOA} SELECT theme, count(DISTINCT gene) AS n_genes, count(DISTINCT entity) AS n_entities, round(avg(spec), 6) AS mean_specificity FROM dg JOIN gs USING (theme, gene) GROUP BY 1")
def theme_genes(t: Callable) -> DataFrame:
    """#207: genes that drive a theme and in how many entities."""
    m = D.members_of(t).join(t("part").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("pathway")), "gene").join(themed(t), "pathway").select("theme", "entity", "gene").distinct()
    per = m.groupBy("theme", "gene").agg(F.countDistinct("entity").alias("c")).join(F.broadcast(m.agg(F.countDistinct("entity").alias("n"))))
    spec = per.withColumn("s", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.ln(F.col("n") / F.col("c")) / F.ln(F.col("n").cast("double")))))
    out = m.groupBy("theme").agg(F.countDistinct("gene").alias("n_genes"), F.countDistinct("entity").alias("n_entities"))
    weighted = spec.groupBy("theme").agg((F.sum(F.col("s") * F.col("c")) / F.sum("c")).alias("mean_specificity"))
    return rounded(out.join(weighted, "theme"))


PARTS = ["strength_norm", "breadth_norm", "measured_norm", "significance_norm", "moa_norm"]
WEIGHTS = [0.3, 0.2, 0.2, 0.1, 0.2]


@query(f"""WITH {HITS}, dg AS (SELECT DISTINCT theme, entity, gene, c, measured, CASE gene % 3 WHEN 0 THEN 'inhibitor' WHEN 1 THEN 'other' END AS action FROM m JOIN part ON p_partkey = gene JOIN th ON pathway = p_size),
nn AS (SELECT count(DISTINCT entity) AS n FROM m), gs AS (SELECT theme, gene, greatest(0, least(1, ln(n / count(DISTINCT entity)) / ln(n))) AS spec FROM dg, nn GROUP BY theme, gene, n),
mo AS (SELECT theme, entity, least(1, sum(CASE WHEN action = 'inhibitor' THEN c ELSE 0.55 * c * (0.35 + 0.65 * spec) END) / 4) AS moa, count(*) FILTER (action = 'inhibitor') AS na FROM dg JOIN gs USING (theme, gene) WHERE measured GROUP BY 1, 2),
ga AS (SELECT entity, CASE WHEN count(*) < 20 THEN 0.05 WHEN count(*) < 60 THEN 0.5 ELSE 1 END AS gate FROM m GROUP BY 1),
sc AS (SELECT theme, entity, round(100 * gate * (0.3 * strength_norm + 0.2 * breadth_norm + 0.2 * measured_norm + 0.1 * significance_norm + 0.2 * coalesce(moa, 0)), 4) AS score, coalesce(na, 0) AS na, round(coalesce(moa, 0), 9) AS moa, ns, round(measured_norm, 9) AS mn, round(best, 9) AS best FROM cn LEFT JOIN mo USING (theme, entity) JOIN ga USING (entity))
SELECT theme, entity, score, row_number() OVER (PARTITION BY theme ORDER BY score DESC, na DESC, moa DESC, ns DESC, mn DESC, best DESC, entity)::INT AS place FROM sc QUALIFY place <= 100""")
def theme_ranking(t: Callable) -> DataFrame:
    """#204, #86: the ranking by six keys, with fixed weights (#205 adapts them in theme_adaptive_weights)."""
    comp = _components(t).join(_moa(t), ["theme", "entity"], "left").fillna(0.0, ["moa_norm"]).fillna(0, ["n_with_action"])
    comp = comp.withColumns({c: F.round(c, 9) for c in ("moa_norm", "measured_norm", "best_fold")})
    weights = comp.select("theme").distinct().withColumns({f"w_{p}": F.lit(w) for p, w in zip(PARTS, WEIGHTS, strict=True)})
    gate = D.members_of(t).groupBy("entity").agg(themes.richness_gate(F.count("*")).alias("gate"))
    return themes.ranked_themes(comp, weights, gate, PARTS)


EXPRESSION = """ex AS (SELECT l_partkey AS gene, l_returnflag || l_linestatus AS tissue, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2)"""


def _expression(t: Callable) -> DataFrame:
    return t("lineitem").groupBy(F.col("l_partkey").alias("gene"), F.concat("l_returnflag", "l_linestatus").alias("tissue")).agg(F.sum("l_quantity").alias("tissue_weight"))


@query(f"""WITH {D.MEMBERS}, {EXPRESSION}, s AS (SELECT entity, tissue, sum(c * x) AS score, sum(c * x) FILTER (measured) AS ms FROM m JOIN ex USING (gene) GROUP BY 1, 2)
SELECT entity, tissue, round(score, 4) AS score, round(score / sum(score) OVER (PARTITION BY entity), 6) AS share, CASE WHEN coalesce(ms, 0) / score < 0.05 THEN 'predicted' WHEN coalesce(ms, 0) / score > 0.95 THEN 'measured' ELSE 'mixed' END AS evidence FROM s""")
def tissue_profiles(t: Callable) -> DataFrame:
    """#194: confidence times expression, normalised, with the evidence split."""
    genes, ex = D.members_of(t), _expression(t)
    own = genes.join(ex, "gene").groupBy("entity", "tissue").agg(F.sum(F.when(F.col("measured"), F.col("confidence") * F.col("tissue_weight"))).alias("ms"))
    out = themes.tissue_scores(genes.withColumnRenamed("confidence", "weight"), ex).join(own, ["entity", "tissue"])
    return out.select("entity", "tissue", F.round("score", 4).alias("score"), F.round("share", 6).alias("share"), themes.measured_split(F.coalesce("ms", F.lit(0.0)) / F.col("score")).alias("evidence"))


DISTINCT = f"""{D.ENRICHED}, dr AS (SELECT q.entity, gene, c, idf, wo / we AS fold, round(q, 9) AS q FROM q JOIN sets USING (pathway) JOIN m USING (gene) JOIN gi USING (gene) WHERE m.entity = q.entity), ne AS (SELECT count(DISTINCT entity) AS ne FROM dr), sd AS (SELECT gene, count(DISTINCT entity) AS cc FROM dr WHERE q <= 0.7 GROUP BY 1),
t1 AS (SELECT entity, gene, sum(greatest(0, -log10(greatest(q / 7, 1e-300))) * fold * c * idf) AS raw, 'strict' AS tier FROM dr WHERE q <= 0.7 GROUP BY 1, 2), t2 AS (SELECT entity, gene, 0.25 * sum(greatest(0, -log10(greatest(q / 7, 1e-300))) * fold * c * idf) AS raw, 'relaxed' AS tier FROM dr WHERE q / 7 <= 0.15 AND entity NOT IN (SELECT entity FROM t1) GROUP BY 1, 2),
t3 AS (SELECT entity, gene, 0.02 * sum(c * idf) AS raw, 'fallback' AS tier FROM m JOIN gi USING (gene) WHERE entity NOT IN (SELECT entity FROM t1) AND entity NOT IN (SELECT entity FROM t2) GROUP BY 1, 2),
al AS (SELECT *, power(raw * CASE WHEN cc IS NULL THEN ln(ne) ELSE ln(ne / cc) END, 2) AS s FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3) LEFT JOIN sd USING (gene), ne WHERE raw > 0), tp AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY entity ORDER BY round(s, 9) DESC, gene) <= 75)"""


@query(f"WITH {DISTINCT}, w AS (SELECT entity, tier, s / sum(s) OVER (PARTITION BY entity) AS w FROM tp) SELECT entity, min(tier) AS tier, count(w) AS n_genes, round(max(w), 5) AS top_weight, round(sum(w), 5) AS total FROM w WHERE NOT isnan(w) GROUP BY 1")
def distinctive_genes(t: Callable) -> DataFrame:
    """#195: three tiers of pathways, genes weighted by rarity (q over 7 here, so that tiers occur)."""
    e = profiles.weighted_enrichment(D.members_of(t), D.sets_of(t), least=3)
    rare = D.sets_of(t).join(F.broadcast(D.sets_of(t).agg(F.countDistinct("pathway").alias("n")))).groupBy("gene", "n").agg(F.countDistinct("pathway").alias("d")).select("gene", F.ln(F.col("n") / F.col("d")).alias("idf"))
    hits = e.select("entity", F.col("weighted_fold").alias("fold"), (F.round("q", 9) / 7).alias("q"), F.explode("drivers").alias("d")).select("entity", "fold", "q", F.col("d.gene").alias("gene"), F.col("d.confidence").alias("confidence")).join(rare, "gene")
    out = themes.distinctive_genes(hits, D.members_of(t).join(rare, "gene"))
    return rounded(out.groupBy("entity").agg(F.min("tier").alias("tier"), F.count("weight").alias("n_genes"), F.max("weight").alias("top_weight"), F.sum("weight").alias("total")), 5)


@query(f"""WITH {D.MEMBERS}, {EXPRESSION}, s AS (SELECT entity, tissue, sum(c * x) AS score FROM m JOIN ex USING (gene) GROUP BY 1, 2), b AS (SELECT left(tissue, 1) AS region, entity, max(round(score, 6)) AS score FROM s GROUP BY 1, 2),
r AS (SELECT region, s.entity, round(s.score, 6) AS score, min(tissue) AS tissue FROM s JOIN b ON left(s.tissue, 1) = region AND s.entity = b.entity AND round(s.score, 6) = b.score GROUP BY 1, 2, 3) SELECT region, entity, score, tissue, row_number() OVER (PARTITION BY region ORDER BY score DESC, entity)::INT AS place FROM r QUALIFY place <= 100""")
def body_regions(t: Callable) -> DataFrame:
    """#208, #196: the best tissue of each region."""
    scores = themes.tissue_scores(D.members_of(t).withColumnRenamed("confidence", "weight"), _expression(t)).withColumn("score", F.round("score", 6))
    members = scores.select("tissue").distinct().withColumn("region", F.substring("tissue", 1, 1))
    return themes.regions(scores.select("tissue", "entity", "score"), members)


@query(f"""WITH {D.MEMBERS}, i AS (SELECT entity, gene, c, CASE gene % 3 WHEN 0 THEN 'inhibitor' WHEN 1 THEN 'agonist' END AS action FROM m WHERE measured) SELECT entity, gene, c AS confidence, action FROM i WHERE action IS NOT NULL""")
def measured_mechanisms(t: Callable) -> DataFrame:
    """#197: measured edges with a known action, by an inner join; predicted ones never get one."""
    actions = t("part").select(F.col("p_partkey").alias("gene"), F.when(F.col("p_partkey") % 3 == 0, "inhibitor").when(F.col("p_partkey") % 3 == 1, "agonist").alias("action")).where("action IS NOT NULL")
    return D.members_of(t).where("measured").join(actions, "gene").select("entity", "gene", "confidence", "action").distinct()


PROFILE = "p AS (SELECT l_suppkey AS e, p_type AS k, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount >= 0.1 AND l_returnflag = 'R' GROUP BY 1, 2)"


def _profile(t: Callable) -> DataFrame:
    return t("lineitem").where("l_discount >= 0.1 AND l_returnflag = 'R'").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("e"), F.col("p_type").alias("k")).agg(F.sum("l_quantity").alias("v"))


@query(f"WITH {PROFILE}, n AS (SELECT count(DISTINCT e) AS n FROM p), d AS (SELECT k, count(DISTINCT e) AS d FROM p GROUP BY 1), s AS (SELECT e, k, v, v * ln(n / d) AS s FROM p JOIN d USING (k), n) SELECT e, k, round(v, 4) AS v, round(coalesce(s / nullif(sum(s) OVER (PARTITION BY e), 0), 0), 6) AS share FROM s")
def hub_suppression(t: Callable) -> DataFrame:
    """#199: categories weighted by how few entities have them."""
    return rounded(themes.hub_suppressed(_profile(t), "e", "k", "v"))


@query("""WITH v AS (SELECT l_suppkey AS e, s_nationkey % 3 AS k, p_size AS d, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3), n AS (SELECT e, k, sqrt(sum(v * v)) AS n FROM v GROUP BY 1, 2),
c AS (SELECT x.e AS a, y.e AS b, sum(x.v * y.v) AS dot FROM v x JOIN v y ON x.d = y.d AND x.e < y.e GROUP BY 1, 2), r AS (SELECT CASE WHEN x.k = y.k THEN 'within' ELSE 'across' END AS scope, coalesce(dot, 0) / (x.n * y.n) AS r FROM n x JOIN n y ON x.e < y.e LEFT JOIN c ON a = x.e AND b = y.e) SELECT scope, count(*) AS n_pairs, round(avg(r), 6) AS mean, round(min(r), 6) AS least, round(max(r), 6) AS most FROM r GROUP BY 1""")
def type_cosines(t: Callable) -> DataFrame:
    """#200."""
    v = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("l_suppkey").alias("e"), (F.col("s_nationkey") % 3).alias("k"), F.col("p_size").alias("d")).agg(F.sum("l_quantity").alias("v"))
    return rounded(themes.type_cosines(v, "e", "k", "d", "v"))


@query("""WITH r AS (SELECT l_orderkey, o_orderpriority, count(DISTINCT l_suppkey) AS c, count(DISTINCT l_partkey) AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT o_orderpriority, count(*) AS n, round(avg(c / i), 6) AS mean_diversity, round(max(c / i), 6) AS most FROM r GROUP BY 1""")
def molecular_diversity(t: Callable) -> DataFrame:
    """#201: distinct compounds by distinct ingredients of each recipe, by cuisine."""
    r = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("l_orderkey", "o_orderpriority").agg(F.countDistinct("l_suppkey").alias("c"), F.countDistinct("l_partkey").alias("i")).withColumn("d", F.try_divide("c", "i"))
    return rounded(r.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg("d").alias("mean_diversity"), F.max("d").alias("most")))


@query("""WITH d AS (SELECT DISTINCT o_orderpriority AS g, l_orderkey AS b, p_brand AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey), e AS (SELECT i, count(DISTINCT b) AS c FROM d GROUP BY 1), n AS (SELECT count(DISTINCT b) AS n FROM d), m AS (SELECT g, count(DISTINCT b) AS m FROM d GROUP BY 1), o AS (SELECT g, i, count(DISTINCT b) AS c FROM d GROUP BY 1, 2)
SELECT g AS cuisine, i AS item, round((o.c / m) / (e.c / n), 6) AS ratio FROM o JOIN m USING (g) JOIN e USING (i), n WHERE (o.c / m) / (e.c / n) >= 1.02""")
def cuisine_proxy_ratio(t: Callable) -> DataFrame:
    """#209: items more common in a cuisine than everywhere."""
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(themes.proxy_ratio(rows.select(F.col("o_orderpriority").alias("cuisine"), "l_orderkey", F.col("p_brand").alias("item")), "cuisine", "l_orderkey", "item", 1.02))


@query("""WITH p AS (SELECT l_suppkey AS e, p_type AS k, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), b AS (SELECT s_nationkey AS blend, s_suppkey AS e, s_acctbal + 1000 AS w FROM supplier), w AS (SELECT *, w / sum(w) OVER (PARTITION BY blend) AS sw FROM b)
SELECT blend, k, round(sum(sw * v), 4) AS v, count(DISTINCT e) AS n_constituents FROM w JOIN p USING (e) GROUP BY 1, 2""")
def blend_profiles(t: Callable) -> DataFrame:
    """#193: weighted constituents."""
    p = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("entity"), F.col("p_type").alias("k")).agg(F.sum("l_quantity").alias("v"))
    parts = t("supplier").select(F.col("s_nationkey").alias("blend"), F.col("s_suppkey").alias("entity"), (F.col("s_acctbal") + 1000).alias("weight"))
    return rounded(themes.blended(p, parts, "k", "v"), 4)


@query("""WITH o AS (SELECT o_orderpriority AS r, p_type AS d, p_brand AS i, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY r, d ORDER BY v DESC, i) AS n FROM o),
s AS (SELECT r, d, sum(v) AS s, string_agg(i, ',' ORDER BY n) FILTER (n <= 8) AS drivers FROM k GROUP BY 1, 2) SELECT r AS recipe, d AS dim, round(s, 2) AS score, drivers, round(s / sum(s) OVER (PARTITION BY r), 6) AS share FROM s""")
def recipe_messages(t: Callable) -> DataFrame:
    """#212: scores by dimension with the eight parts that drive them."""
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    own = rows.groupBy(F.col("o_orderpriority").alias("recipe"), F.col("p_type").alias("dim"), F.col("p_brand").alias("part")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    out = themes.message(own, "recipe", "dim", "part", "v", 8)
    return out.select("recipe", "dim", F.round("score", 2).alias("score"), "drivers", F.round("share", 6).alias("share"))


@query("""WITH e AS (SELECT o_orderpriority AS r, l_returnflag AS f, sum(l_quantity) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2), n AS (SELECT o_orderpriority AS r, l_suppkey AS s, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT r AS recipe, round(max(q) FILTER (f = 'R') / sum(q), 6) AS measured_share, (SELECT string_agg(s, ',' ORDER BY k) FROM (SELECT s, row_number() OVER (ORDER BY v DESC, s) AS k FROM n WHERE n.r = e.r) WHERE k <= 6) AS notable FROM e GROUP BY 1""")
def evidence_composition(t: Callable) -> DataFrame:
    """#214: the measured share and the six most notable measured parts."""
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).withColumnRenamed("o_orderpriority", "recipe")
    share = rows.groupBy("recipe").agg((F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))) / F.sum("l_quantity")).alias("measured_share"))
    own = rows.where("l_returnflag = 'R'").groupBy("recipe", "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    top = profiles.top_per_group(own, ["recipe"], [F.desc("v"), "l_suppkey"], 6)
    named = top.groupBy("recipe").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("l_suppkey").cast("string").alias("s")))), lambda x: x["s"]), ",").alias("notable"))
    return rounded(share.join(named, "recipe"))


@query("""WITH v AS (SELECT o_custkey AS r, o_orderpriority AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), s AS (SELECT r, k, v / sum(v) OVER (PARTITION BY r) AS s FROM v), t AS (SELECT r, arg_min(k, (-round(s, 9), k)) AS top FROM s GROUP BY 1)
SELECT k AS region, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS sd, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.9), 6) AS p90, round(max(s), 6) AS most, round((SELECT count(*) FROM t WHERE top = k) / (SELECT count(*) FROM t), 6) AS dominance FROM s GROUP BY 1""")
def landscape_statistics(t: Callable) -> DataFrame:
    """#215: the spread of shares and how often each dominates."""
    from weftline.operators import stats

    v = t("orders").groupBy(F.col("o_custkey").alias("r"), F.col("o_orderpriority").alias("region")).agg(F.sum("o_totalprice").alias("v"))
    s = profiles.shares(v, ["r"], "v", "s").select("r", "region", "s")
    top = s.groupBy("r").agg(F.min(F.struct((-F.round("s", 9)).alias("o"), "region")).alias("t")).groupBy(F.col("t.region").alias("region")).agg(F.count("*").alias("c"))
    total = s.agg(F.countDistinct("r").alias("all"))
    plain = s.groupBy("region").agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"), F.max("s").alias("most"))
    out = plain.join(stats.quantiles(s, ["region"], "s", [0.5, 0.9], ["p50", "p90"]), "region").join(top, "region", "left").join(F.broadcast(total))
    return rounded(out.select("region", "n", "mean", "sd", "p50", "p90", "most", (F.coalesce("c", F.lit(0)) / F.col("all")).alias("dominance")))


@query("""WITH e AS (SELECT o_orderpriority, l_returnflag, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT 'edges_' || lower(l_returnflag) AS finding, CAST(sum(n) AS DOUBLE) AS value FROM e GROUP BY 1 UNION ALL SELECT 'share_measured', round(sum(n) FILTER (l_returnflag = 'R') / sum(n), 6) FROM e UNION ALL SELECT 'groups', CAST(count(DISTINCT o_orderpriority) AS DOUBLE) FROM e""")
def showcase_findings(t: Callable) -> DataFrame:
    """#216: one row a finding."""
    e = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority", "l_returnflag").agg(F.count("*").alias("n"))
    counts = e.groupBy(F.concat(F.lit("edges_"), F.lower("l_returnflag")).alias("finding")).agg(F.sum("n").cast("double").alias("value"))
    share = e.agg(F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("n"))) / F.sum("n"), 6).alias("value")).select(F.lit("share_measured").alias("finding"), "value")
    groups = e.agg(F.countDistinct("o_orderpriority").cast("double").alias("value")).select(F.lit("groups").alias("finding"), "value")
    return counts.unionByName(share).unionByName(groups)


@query("""WITH r AS (SELECT l_suppkey AS e, l_partkey AS c, count(*) AS n FROM lineitem GROUP BY 1, 2), d AS (SELECT c, ln((SELECT count(DISTINCT e) FROM r) / count(DISTINCT e)) AS idf FROM r GROUP BY 1), k AS (SELECT e, c, round(idf, 9) AS idf, row_number() OVER (PARTITION BY e ORDER BY round(idf, 9) DESC, c) AS p FROM r JOIN d USING (c)),
g AS (SELECT l_suppkey AS e, l_orderkey AS g, bool_or(l_returnflag = 'R') AS m, round(max(l_discount), 2) AS f, count(*) AS s FROM lineitem GROUP BY 1, 2), h AS (SELECT e, g, row_number() OVER (PARTITION BY e ORDER BY m DESC, f DESC, s DESC, g) AS p FROM g)
SELECT e AS entity, string_agg(c, ',' ORDER BY k.p) AS compounds, count(*) FILTER (idf >= 1) AS n_distinctive, (SELECT string_agg(g, ',' ORDER BY p) FROM h WHERE h.e = k.e AND p <= 15) AS targets FROM k WHERE p <= 15 GROUP BY 1""")
def ingredient_profiles(t: Callable) -> DataFrame:
    """#191: the first compounds by rarity and targets by evidence, confidence and support."""
    lines = t("lineitem")
    rows = lines.select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("c")).distinct()
    idf = profiles.idf(rows, "entity", "c").select("c", F.round("idf", 9).alias("idf"))
    compounds = profiles.top_per_group(rows.join(idf, "c"), ["entity"], [F.desc("idf"), "c"], 15)
    listed = lambda f, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(c).cast("string").alias("x")))), lambda v: v["x"]), ",")
    own = compounds.groupBy("entity").agg(listed(compounds, "c").alias("compounds"), F.count_if(F.col("idf") >= 1).alias("n_distinctive"))
    g = lines.groupBy(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("g")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("m"), F.round(F.max("l_discount"), 2).alias("f"), F.count("*").alias("s"))
    targets = profiles.top_per_group(g, ["entity"], [F.desc("m"), F.desc("f"), F.desc("s"), "g"], 15)
    return own.join(targets.groupBy("entity").agg(listed(targets, "g").alias("targets")), "entity")
