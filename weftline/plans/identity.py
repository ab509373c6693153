"""Queries of identity, quality, doses and nutrients, on strings and amounts built from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import texts as X
from weftline.operators import identity, profiles
from weftline.plans.registry import query, rounded
from weftline.plans.texts import pick


@query("""WITH c AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer), o AS (SELECT o_custkey AS k, min(o_orderkey) AS id FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) = 1), n AS (SELECT n_nationkey AS k, n_name AS id FROM nation WHERE n_regionkey < 2)
SELECT c_custkey, coalesce(CAST(o.id AS VARCHAR), n.id) AS resolved, CASE WHEN o.id IS NOT NULL THEN 'order' WHEN n.id IS NOT NULL THEN 'nation' ELSE 'unresolved' END AS method FROM c LEFT JOIN o ON o.k = c_custkey LEFT JOIN n ON n.k = c_nationkey""")
def ordered_resolution(t: Callable) -> DataFrame:
    """#51, #228: the first table that knows the key alone; keys with several ids are not used."""
    steps = [("order", "c_custkey", t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"))), ("nation", "c_nationkey", t("nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("id")))]
    return identity.resolved(t("customer"), steps).select("c_custkey", "resolved", "method")


@query("""WITH p AS (SELECT DISTINCT p_name AS accession, p_brand AS symbol FROM part WHERE p_size <= 3), s AS (SELECT DISTINCT p_name AS accession, p_brand AS symbol FROM part WHERE p_size > 3), a AS (SELECT DISTINCT p_brand AS symbol FROM part WHERE p_type = 'PROMO' AND p_size = 50)
SELECT accession, symbol, CASE WHEN count(*) OVER (PARTITION BY accession) = 1 THEN 'primary_canonical' ELSE 'ambiguous_multi' END AS kind FROM p UNION ALL SELECT accession, symbol, 'secondary_approved' FROM s WHERE accession NOT IN (SELECT accession FROM p) AND symbol IN (SELECT symbol FROM a)""")
def ambiguity_mapping(t: Callable) -> DataFrame:
    """#52."""
    p = t("part").select(F.col("p_name").alias("accession"), F.col("p_brand").alias("symbol"), "p_size", "p_type")
    return identity.mapping(p.where("p_size <= 3"), p.where("p_size > 3"), p.where("p_type = 'PROMO' AND p_size = 50"))


@query("""WITH a AS (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN p_name END AS name, NULL AS code FROM part), b AS (SELECT l_partkey AS k, min(l_returnflag) AS code, min('line ' || l_returnflag) AS name FROM lineitem GROUP BY 1), c AS (SELECT p_partkey AS k, p_type AS name, p_brand AS code FROM part WHERE p_size < 10)
SELECT k, coalesce(max(a.name), max(b.name), max(c.name)) AS name, coalesce(max(a.code), max(b.code), max(c.code)) AS code, concat_ws('|', CASE WHEN bool_or(a.k IS NOT NULL) THEN '0' END, CASE WHEN bool_or(b.k IS NOT NULL) THEN '1' END, CASE WHEN bool_or(c.k IS NOT NULL) THEN '2' END) AS sources
FROM (SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM c) u LEFT JOIN a USING (k) LEFT JOIN b USING (k) LEFT JOIN c USING (k) GROUP BY 1""")
def merged_master(t: Callable) -> DataFrame:
    """#227: the first value by source that isn't null."""
    a = t("part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("name"), F.lit(None).cast("string").alias("code"))
    b = t("lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_returnflag").alias("code"), F.min(F.concat(F.lit("line "), "l_returnflag")).alias("name"))
    c = t("part").where("p_size < 10").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("name"), F.col("p_brand").alias("code"))
    return identity.merged([a, b, c], "k")


@query("""WITH r AS (SELECT p_partkey, p_name, p_partkey % 5 AS w FROM part), k AS (SELECT p_name AS key, min(p_brand) AS id, count(DISTINCT p_brand) AS n FROM part WHERE p_size = 7 GROUP BY 1)
SELECT p_partkey, CASE WHEN w = 3 THEN 'junk' WHEN w = 2 THEN 'composite' WHEN w < 2 AND n = 1 THEN 'auto' WHEN w < 2 AND n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS bucket, CASE WHEN w < 2 AND n = 1 THEN id END AS match,
CAST(CASE WHEN w = 1 AND n = 1 THEN 1.0 WHEN w = 0 AND n = 1 THEN 0.9 ELSE 0 END AS DOUBLE) AS confidence FROM r LEFT JOIN k ON key = p_name""")
def species_buckets(t: Callable) -> DataFrame:
    """#225-226: exact names, then names without modifiers, into buckets with method and confidence."""
    n = F.col("p_name")
    rows = t("part").select("p_partkey", pick(F.col("p_partkey"), F.concat(F.lit("organic "), n), n, F.concat(n, F.lit(" soup")), "12", F.concat(F.lit("no such "), "p_type")).alias("name"))
    exact = t("part").where("p_size = 7").select(F.col("p_name").alias("key"), F.col("p_brand").alias("id"))
    plain = F.regexp_replace("name", "^organic ", "")
    return identity.bucketed(rows, "name", exact, plain, X.is_junk(F.col("name")), X.is_composite(F.col("name"))).select("p_partkey", "bucket", "match", "confidence")


@query("""WITH q AS (SELECT DISTINCT p_name || CASE p_partkey % 3 WHEN 0 THEN 's' WHEN 1 THEN '' ELSE 'zz' END AS name FROM part), k AS (SELECT DISTINCT p_name AS best FROM part), s AS (SELECT name, best, 1 - levenshtein(lower(name), lower(best)) / greatest(length(name), length(best)) AS r FROM q, k)
SELECT name, best, round(r, 6) AS ratio FROM s WHERE r >= 0.85 QUALIFY row_number() OVER (PARTITION BY name ORDER BY r DESC, best) = 1""")
def fuzzy_links(t: Callable) -> DataFrame:
    """#47, #236: the best name over a threshold, met by blocks rather than all with all."""
    names = t("part").select(F.concat("p_name", pick(F.col("p_partkey"), "s", "", "zz")).alias("name"))
    return rounded(identity.best_link(names, t("part").select(F.col("p_name").alias("name")), 0.85))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, list_extract(['gram', 'pound', 'cup', 'pinch', 'bunch', 'head'], CAST(l_linenumber % 6 AS INT) + 1) AS u, CASE WHEN p_size < 10 THEN CAST(p_size AS DOUBLE) END AS p, CASE WHEN p_type = 'PROMO' THEN 2.5 END AS c FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, round(CASE u WHEN 'gram' THEN a WHEN 'pound' THEN a * 453.59237 WHEN 'pinch' THEN a ELSE coalesce(a * p, a * c, CASE u WHEN 'cup' THEN a * 240 END) END, 4) AS grams,
CASE WHEN u IN ('gram', 'pound') THEN 'mass_unit' WHEN u = 'pinch' THEN 'trace' WHEN p IS NOT NULL THEN 'portion' WHEN c IS NOT NULL THEN 'category' WHEN u = 'cup' THEN 'generic' ELSE 'unconvertible' END AS method FROM x""")
def mass_fallbacks(t: Callable) -> DataFrame:
    """#217: the whole chain, traces and generic weights included."""
    x = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    unit = pick(F.col("l_linenumber"), "gram", "pound", "cup", "pinch", "bunch", "head")
    m = identity.mass(F.col("l_quantity"), unit, F.when(F.col("p_size") < 10, F.col("p_size").cast("double")), F.when(F.col("p_type") == "PROMO", 2.5))
    return rounded(x.select("l_orderkey", "l_linenumber", m.alias("m")).select("l_orderkey", "l_linenumber", "m.grams", "m.method"), 4)


PANEL = """c AS (SELECT p_partkey AS food, n, a, u FROM part, (VALUES ('Iron', 0.02, 'G'), ('Protein', 3.0, 'G'), ('Energy', 12.0, 'KCAL')) v(n, a, u)), d AS (SELECT * FROM (VALUES ('Iron', 18.0, 'MG'), ('Protein', 50.0, 'G'), ('Energy', 2000.0, 'KCAL')) v(n, dv, du)),
x AS (SELECT l_orderkey AS recipe, n, a * l_quantity / 100 AS a, u, dv FROM lineitem JOIN c ON food = l_partkey JOIN d USING (n)), y AS (SELECT recipe, n, dv, CASE WHEN n = 'Iron' THEN CASE WHEN a > 1 THEN a WHEN a > 0.05 THEN a * 1000 ELSE a * 1000 END ELSE a END AS a FROM x)"""


@query(f"WITH {PANEL}, s AS (SELECT recipe, n, sum(a) AS a, any_value(dv) AS dv FROM y GROUP BY 1, 2) SELECT recipe, n AS nutrient, round(a / CASE WHEN recipe % 4 > 0 THEN recipe % 4 ELSE 1 END, 6) AS amount, round(100 * a / CASE WHEN recipe % 4 > 0 THEN recipe % 4 ELSE 1 END / dv, 6) AS percent_dv FROM s")
def nutrient_panel(t: Callable) -> DataFrame:
    """#219, #224: amounts by mass, units mended, a serving's, percent of daily values."""
    spark = t("region").sparkSession
    per = spark.createDataFrame([("Iron", 0.02, "G"), ("Protein", 3.0, "G"), ("Energy", 12.0, "KCAL")], "nutrient string, amount double, unit string")
    content = t("part").select(F.col("p_partkey").alias("food")).join(F.broadcast(per))
    daily = spark.createDataFrame([("Iron", 18.0, "MG"), ("Protein", 50.0, "G"), ("Energy", 2000.0, "KCAL")], "nutrient string, dv double, dv_unit string")
    parts = t("lineitem").select(F.col("l_orderkey").alias("recipe"), F.col("l_partkey").alias("food"), F.col("l_quantity").alias("mass_g"))
    servings = t("orders").select(F.col("o_orderkey").alias("recipe"), (F.col("o_orderkey") % 4).alias("servings"))
    return rounded(identity.nutrient_panel(parts, content, daily, servings))


@query("""WITH x AS (SELECT p_brand, l_suppkey, sum(l_quantity) AS m, count(*) AS n, avg(l_discount) * 30 AS f, avg((l_returnflag = 'R')::INT) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), p AS (SELECT *, greatest(0.01, ln(1 + n) / ln(5001) * (0.5 + 0.5 * least(1, f / 3)) * (1 + 0.25 * r)) AS p FROM x), c AS (SELECT *, m ** 0.3 * p ** 1.1 AS c FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(c, 9) DESC, l_suppkey)::INT AS place, row_number() OVER (PARTITION BY p_brand ORDER BY m DESC, l_suppkey) = 1 AS bulk, row_number() OVER (PARTITION BY p_brand ORDER BY round(p, 9) DESC, l_suppkey) = 1 AS potent FROM c)
SELECT p_brand, l_suppkey, place, CASE WHEN place = 1 THEN 'mechanistic' WHEN bulk THEN 'bulk' WHEN potent THEN 'potency' END AS hero FROM k""")
def contribution_heroes(t: Callable) -> DataFrame:
    """#79, #221: the rank of each contribution, and the heroes by contribution, bulk and potency."""
    from pyspark.sql import Window

    x = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_suppkey").agg(F.sum("l_quantity").alias("m"), F.count("*").alias("n"), (F.avg("l_discount") * 30).alias("f"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    x = x.withColumn("p", profiles.potency(F.col("n"), F.col("f"), F.col("r"))).withColumn("c", profiles.contribution(F.col("m"), F.col("p"), F.lit(1.0)))
    first = lambda c: F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc(c), "l_suppkey"))
    x = x.withColumns({"place": first(F.round("c", 9)), "__b": first("m"), "__p": first(F.round("p", 9))})
    return x.select("p_brand", "l_suppkey", "place", F.when(F.col("place") == 1, "mechanistic").when(F.col("__b") == 1, "bulk").when(F.col("__p") == 1, "potency").alias("hero"))


@query("""WITH r AS (SELECT l_orderkey, CASE WHEN l_linenumber % 6 < 2 THEN 'clean' WHEN l_linenumber % 6 = 3 THEN 'vague' ELSE 'partial' END AS class, l_quantity AS q FROM lineitem) SELECT class, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS share, round(sum(q) / (SELECT sum(q) FROM r), 6) AS mass_share FROM r GROUP BY 1""")
def dose_reconciliation(t: Callable) -> DataFrame:
    """#222, #247: parse classes of quantity lines and the mass each covers."""
    line = F.concat(F.col("l_quantity").cast("int").cast("string"), pick(F.col("l_linenumber"), " cups", " lbs", " xyz", " pinch of", "", " qq"), F.lit(" salt"))
    rows = t("lineitem").select(X.quantity(line)["parse_class"].alias("class"), "l_quantity")
    total = rows.agg(F.count("*").alias("n_all"), F.sum("l_quantity").alias("q_all"))
    out = rows.groupBy("class").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")).join(F.broadcast(total))
    return rounded(out.select("class", "n", (F.col("n") / F.col("n_all")).alias("share"), (F.col("q") / F.col("q_all")).alias("mass_share")))


@query("""WITH c AS (SELECT s_suppkey AS k, n_name AS candidate, s_acctbal / 10000 + CASE WHEN n_regionkey = s_nationkey % 5 THEN 0.2 ELSE 0 END - abs(n_nationkey - s_nationkey) / 100 AS s, CASE WHEN n_regionkey = 4 THEN 'region' WHEN n_nationkey > s_nationkey + 3 THEN 'range' END AS g FROM supplier JOIN nation ON abs(n_nationkey - s_nationkey) <= 5),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY g IS NOT NULL, round(s, 9) DESC, candidate) AS r FROM c) SELECT k, candidate, round(s, 6) AS score, CASE WHEN g IS NOT NULL THEN 'guard:' || g WHEN s >= 0.7 THEN 'auto' WHEN s >= 0.4 THEN 'review' ELSE 'reject' END AS decision FROM b WHERE r = 1""")
def guarded_matching(t: Callable) -> DataFrame:
    """#223: candidates scored, guarded and decided. Nations close by stand in for foods."""
    near = F.explode(F.sequence(F.col("s_nationkey") - 5, F.col("s_nationkey") + 5))
    c = t("supplier").withColumn("n_nationkey", near).join(t("nation"), "n_nationkey").withColumnRenamed("s_suppkey", "k").withColumnRenamed("n_name", "candidate")
    score = F.round(F.col("s_acctbal") / 10000 + F.when(F.col("n_regionkey") == F.col("s_nationkey") % 5, 0.2).otherwise(0.0) - F.abs(F.col("n_nationkey") - F.col("s_nationkey")) / 100, 9)
    guards = {"region": F.col("n_regionkey") == 4, "range": F.col("n_nationkey") > F.col("s_nationkey") + 3}
    return rounded(identity.scored_match(c, ["k"], score, guards, 0.7, 0.4))


@query("""WITH a AS (SELECT p_brand AS k, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS x, string_agg(DISTINCT p_name, ';' ORDER BY p_name) AS y FROM part GROUP BY 1) SELECT DISTINCT p_brand AS k, 'kinds' AS database, p_type AS reference FROM part UNION ALL SELECT DISTINCT p_brand, 'names', p_name FROM part""")
def cross_references(t: Callable) -> DataFrame:
    """#241: separated lists of two databases to rows."""
    a = t("part").groupBy(F.col("p_brand").alias("k")).agg(F.array_join(F.collect_list("p_type"), "; ").alias("x"), F.array_join(F.collect_list("p_name"), " ;").alias("y"))
    return identity.cross_references(a, "k", {"x": "kinds", "y": "names"})


@query("SELECT p_name, p_brand, 'SP_' || lpad(CAST(row_number() OVER (ORDER BY p_name, p_brand) AS VARCHAR), 6, '0') AS id FROM (SELECT DISTINCT p_name, p_brand FROM part)")
def allocated_ids(t: Callable) -> DataFrame:
    """#231, #240: new ids in order."""
    return identity.allocated(t("part").select("p_name", "p_brand").distinct(), ["p_name", "p_brand"], "SP_")


@query("""WITH v AS (SELECT list_extract(['CHEMBL' || l_suppkey, 'FDB' || l_suppkey, 'x' || l_suppkey], CAST(l_linenumber % 3 AS INT) + 1) AS v FROM lineitem), c AS (SELECT CASE WHEN v LIKE 'CHEMBL%' THEN 'chembl' WHEN v LIKE 'FDB%' THEN 'foodb' ELSE 'other' END AS class, v, count(*) AS c FROM v GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY c DESC, v) AS r FROM c) SELECT class, sum(c)::BIGINT AS n, string_agg(v, ',' ORDER BY r) FILTER (r <= 5) AS examples FROM k GROUP BY 1""")
def resolution_gaps(t: Callable) -> DataFrame:
    """#243: values by id pattern, with the most frequent."""
    v = t("lineitem").select(F.concat(pick(F.col("l_linenumber"), "CHEMBL", "FDB", "x"), F.col("l_suppkey").cast("string")).alias("v"))
    return identity.prefix_classes(v, "v", {"chembl": "^CHEMBL[0-9]+$", "foodb": "^FDB[0-9]+$"}, 5)


@query("""WITH s AS (SELECT DISTINCT s_nationkey AS e, l_partkey AS m FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), n AS (SELECT e, count(*) AS n FROM s GROUP BY 1), f AS (SELECT e, n FROM n ORDER BY n DESC, e LIMIT 1),
j AS (SELECT a.e AS x, b.e AS y, count(*) AS c FROM s a JOIN s b USING (m) GROUP BY 1, 2), d AS (SELECT p.e AS x, q.e AS y, round(1 - coalesce(c, 0) / (p.n + q.n - coalesce(c, 0)), 12) AS d FROM n p, n q LEFT JOIN j ON j.x = p.e AND j.y = q.e WHERE p.e <> q.e),
g AS (SELECT x AS e FROM d JOIN f ON y = f.e ORDER BY d DESC, x LIMIT 1), h AS (SELECT x AS e FROM d WHERE (y = (SELECT e FROM f) OR y = (SELECT e FROM g)) AND x <> (SELECT e FROM f) AND x <> (SELECT e FROM g) GROUP BY 1 ORDER BY min(d) DESC, x LIMIT 1)
SELECT 1 AS place, e AS entity FROM f UNION ALL SELECT 2, e FROM g UNION ALL SELECT 3, e FROM h""")
def farthest_ingredients(t: Callable) -> DataFrame:
    """#239: three entities far apart by Jaccard."""
    s = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("e"), F.col("l_partkey").alias("m"))
    return identity.farthest_sets(s, "e", "m", 3)


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS i, l_orderkey AS c, l_partkey AS g FROM lineitem), ci AS (SELECT c, ln((SELECT count(DISTINCT i) FROM c) / count(DISTINCT i)) AS w FROM c GROUP BY 1), gi AS (SELECT p_partkey AS g, ln((SELECT count(DISTINCT p_size) FROM part)) AS w, p_size AS p FROM part),
s AS (SELECT i, p, sum(ci.w * gi.w) AS s FROM c JOIN ci USING (c) JOIN gi USING (g) GROUP BY 1, 2), f AS (SELECT i, p, s / sum(s) OVER (PARTITION BY i) AS f FROM s), b AS (SELECT p, avg(f) AS b FROM f GROUP BY 1) SELECT i AS entity, p AS pathway, round(f, 6) AS fraction, round(ln((f + 1e-12) / (b + 1e-12)), 5) AS log_ratio FROM f JOIN b USING (p)""")
def pathway_strength(t: Callable) -> DataFrame:
    """#239, #121: IDF products summed by pathway, as fractions and log ratios to the mean."""
    c = t("lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_orderkey").alias("c"), F.col("l_partkey").alias("g")).distinct()
    ci = profiles.idf(c, "i", "c").select("c", F.col("idf").alias("wc"))
    gi = t("part").select(F.col("p_partkey").alias("g"), F.col("p_size").alias("p")).join(F.broadcast(t("part").agg(F.ln(F.countDistinct("p_size").cast("double")).alias("wg"))))
    s = c.join(ci, "c").join(gi, "g").groupBy("i", "p").agg(F.sum(F.col("wc") * F.col("wg")).alias("s"))
    f = profiles.shares(s, ["i"], "s", "f")
    out = f.join(f.groupBy("p").agg(F.avg("f").alias("b")), "p")
    return out.select(F.col("i").alias("entity"), F.col("p").alias("pathway"), F.round("f", 6).alias("fraction"), F.round(F.ln((F.col("f") + 1e-12) / (F.col("b") + 1e-12)), 5).alias("log_ratio"))


@query("""WITH g AS (SELECT l_suppkey AS i, p_size AS p, count(DISTINCT l_partkey) AS genes, count(DISTINCT l_orderkey) AS compounds, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS evidence FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) SELECT i AS entity, count(*) AS n_pathways, sum(genes)::BIGINT AS gene_hits, max(compounds) AS most_compounds, (SELECT count(*) FROM (SELECT DISTINCT p_size FROM part WHERE p_size NOT IN (SELECT p FROM g h WHERE h.i = g.i))) AS n_uncovered FROM g GROUP BY 1""")
def mechanism_profiles(t: Callable) -> DataFrame:
    """#238: genes and pathways rolled up in turn, with what isn't covered."""
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    g = rows.groupBy(F.col("l_suppkey").alias("entity"), F.col("p_size").alias("p")).agg(F.countDistinct("l_partkey").alias("genes"), F.countDistinct("l_orderkey").alias("compounds"))
    all_p = t("part").agg(F.countDistinct("p_size").alias("n_all"))
    out = g.groupBy("entity").agg(F.count("*").alias("n_pathways"), F.sum("genes").alias("gene_hits"), F.max("compounds").alias("most_compounds")).join(F.broadcast(all_p))
    return out.select("entity", "n_pathways", "gene_hits", "most_compounds", (F.col("n_all") - F.col("n_pathways")).alias("n_uncovered"))


@query("""WITH d AS (SELECT DISTINCT upper(trim(l_shipdate::DATE::VARCHAR)) AS day, l_suppkey AS s, 'lineitem' AS source FROM lineitem), k AS (SELECT s, count(DISTINCT day) AS days, min(day) AS first_day, any_value(source) AS source FROM d GROUP BY 1) SELECT * FROM k""")
def canonical_sources(t: Callable) -> DataFrame:
    """#17, #237: columns picked and renamed, keys normalised, provenance kept, distinct."""
    d = t("lineitem").select(F.upper(F.trim(F.to_date("l_shipdate").cast("string"))).alias("day"), F.col("l_suppkey").alias("s"), F.lit("lineitem").alias("source")).dropDuplicates(["day", "s"])
    return d.groupBy("s").agg(F.countDistinct("day").alias("days"), F.min("day").alias("first_day"), F.first("source").alias("source"))


@query("""SELECT s_suppkey, CASE WHEN approved THEN symbol WHEN alias IS NOT NULL THEN alias END AS gene, CASE WHEN approved THEN 'approved' WHEN alias IS NOT NULL THEN 'alias' ELSE 'unknown' END AS status FROM (SELECT s_suppkey, 'S' || s_nationkey AS symbol, s_nationkey < 10 AS approved, CASE WHEN s_nationkey BETWEEN 10 AND 19 THEN 'S' || (s_nationkey - 10) END AS alias FROM supplier)""")
def approved_genes(t: Callable) -> DataFrame:
    """#230: approved symbols stay, aliases are replaced, the rest is reported."""
    n = t("nation")
    approved = n.where("n_nationkey < 10").select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("symbol"), F.lit(True).alias("ok"))
    alias = n.where("n_nationkey BETWEEN 10 AND 19").select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("symbol"), F.concat(F.lit("S"), (F.col("n_nationkey") - 10).cast("string")).alias("to"))
    rows = t("supplier").select("s_suppkey", F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("symbol")).join(approved, "symbol", "left").join(alias, "symbol", "left")
    return rows.select("s_suppkey", F.when(F.col("ok"), F.col("symbol")).otherwise(F.col("to")).alias("gene"), F.when(F.col("ok"), "approved").when(F.col("to").isNotNull(), "alias").otherwise("unknown").alias("status"))


@query("""WITH a AS (SELECT l_partkey AS c, l_suppkey AS g, 'direct' AS source FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT p.p_partkey AS c, l_suppkey AS g, 'by name' AS source FROM part p JOIN part q ON p.p_name = q.p_name AND p.p_brand = q.p_brand AND p.p_partkey <> q.p_partkey JOIN lineitem ON l_partkey = q.p_partkey WHERE l_returnflag = 'R'), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT c AS compound, g AS gene, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources, count(*) AS support FROM u GROUP BY 1, 2""")
def expanded_edges(t: Callable) -> DataFrame:
    """#229: edges of a compound and of those of the same name and brand, with their sources."""
    direct = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("compound"), F.col("l_suppkey").alias("gene"))
    return identity.expanded(direct, t("part").withColumnRenamed("p_partkey", "compound"), ["p_name", "p_brand"])


@query("""SELECT l_suppkey, round(coalesce(avg((l_returnflag = 'R')::INT) FILTER (l_discount > 0.05), avg((l_returnflag = 'R')::INT), 0), 6) AS fraction FROM lineitem GROUP BY 1""")
def measured_fractions(t: Callable) -> DataFrame:
    """#248: the measured part of strong evidence, else of all."""
    m = (F.col("l_returnflag") == "R").cast("double")
    return rounded(t("lineitem").groupBy("l_suppkey").agg(F.coalesce(F.avg(F.when(F.col("l_discount") > 0.05, m)), F.avg(m), F.lit(0.0)).alias("fraction")))


@query("""SELECT c_mktsegment, CASE WHEN regexp_matches(n_name, '_1') THEN 'one' WHEN regexp_matches(n_name, '_2') THEN 'two' ELSE 'unknown' END AS bundle, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS n_unknown FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def category_bias(t: Callable) -> DataFrame:
    """#242, #246: categories by keyword bundle, counted, with the unknown part."""
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    bundle = X.first_rule(F.col("n_name"), (("one", ("_1",)), ("two", ("_2",))), "unknown")
    return rows.groupBy("c_mktsegment", bundle.alias("bundle")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("n_unknown"))


@query("""WITH r AS (SELECT p_type AS dataset, count(*) AS files, count(DISTINCT p_brand) AS licenses, bool_and(p_retailprice > 0) AS complete FROM part GROUP BY 1) SELECT dataset, files, licenses, CASE WHEN NOT complete THEN 'missing' WHEN licenses > 24 THEN 'mixed' ELSE 'ok' END AS status FROM r""")
def license_registry(t: Callable) -> DataFrame:
    """#234: a registry checked row by row."""
    r = t("part").groupBy(F.col("p_type").alias("dataset")).agg(F.count("*").alias("files"), F.countDistinct("p_brand").alias("licenses"), F.bool_and(F.col("p_retailprice") > 0).alias("complete"))
    return r.select("dataset", "files", "licenses", F.when(~F.col("complete"), "missing").when(F.col("licenses") > 24, "mixed").otherwise("ok").alias("status"))


@query("""WITH s AS (SELECT count(*) AS n, count(*) FILTER (p_size > 10) AS a, count(DISTINCT p_brand) AS b FROM part) SELECT 'propagation' AS gate, round(a / n, 6) AS value, a / n >= 0.25 AS passes FROM s UNION ALL SELECT 'alignment', round(b / 25, 6), b / 25 >= 0.5 FROM s UNION ALL SELECT 'coverage', round((SELECT count(DISTINCT l_partkey) FROM lineitem) / n, 6), (SELECT count(DISTINCT l_partkey) FROM lineitem) / n >= 0.3 FROM s""")
def readiness_gates(t: Callable) -> DataFrame:
    """#232: shares against their thresholds."""
    s = t("part").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 10).alias("a"), F.countDistinct("p_brand").alias("b")).join(F.broadcast(t("lineitem").agg(F.countDistinct("l_partkey").alias("c"))))
    gate = lambda name, value, least: F.struct(F.lit(name).alias("gate"), value.alias("value"), (value >= least).alias("passes"))
    rows = s.select(F.explode(F.array(gate("propagation", F.col("a") / F.col("n"), 0.25), gate("alignment", F.col("b") / 25, 0.5), gate("coverage", F.col("c") / F.col("n"), 0.3))).alias("g"))
    return rounded(rows.select("g.*"))
