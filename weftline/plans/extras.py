"""Further queries: p values with series in SQL, extraction and parsing of sources, samples, levels, signatures, distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.operators import designs, evidence, graph, profiles, stats
from weftline.plans import designs as D
from weftline.plans.registry import query, rounded
from weftline.sources import io

# two-sided tails: erfc by its series (|z| < 6), Student's t by the finite sums of whole degrees of freedom
NORMAL_P = "(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(greatest(abs({z}) / sqrt(2), 1e-30)) - lgamma(k + 1)) / (2 * k + 1))))"
_EVEN = "sin({a}) * list_sum(list_transform(range(0, {df} // 2), lambda k: exp(lgamma(2 * k + 1) - k * ln(4) - 2 * lgamma(k + 1) + 2 * k * ln(cos({a})))))"
_ODD = "2 / pi() * ({a} + CASE WHEN {df} > 1 THEN sin({a}) * cos({a}) * list_sum(list_transform(range(0, ({df} - 1) // 2), lambda k: exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + 2 * k * ln(cos({a}))))) ELSE 0 END)"


def t_sql(t: str, df: str) -> str:
    a = f"atan(abs({t}) / sqrt({df}))"
    return f"(1 - CASE WHEN ({df}) % 2 = 0 THEN {_EVEN.format(a=a, df=f'({df})')} ELSE {_ODD.format(a=a, df=f'({df})')} END)"


def _did_sql(weight: str) -> str:
    cells = ", ".join(f"avg(y) FILTER (a = {a} AND b = {b}) AS m{a}{b}, var_samp(y) FILTER (a = {a} AND b = {b}) AS v{a}{b}, count(y) FILTER (a = {a} AND b = {b}) AS n{a}{b}" for a in (0, 1) for b in (0, 1))
    return f"""WITH {D.CELLS}, s AS (SELECT o_orderstatus, o_orderpriority, {cells} FROM o GROUP BY 1, 2), d AS (SELECT *, m11 - m10 - m01 + m00 AS d, v11 / n11 + v10 / n10 + v01 / n01 + v00 / n00 AS v FROM s WHERE least(n11, n10, n01, n00) >= 2),
w AS (SELECT *, {weight} AS w FROM d), z AS (SELECT o_orderstatus, sum(w * d) / sum(w) / (sqrt(sum(w * w * v)) / sum(w)) AS z FROM w GROUP BY 1) SELECT o_orderstatus, round(z, 5) AS z, round({NORMAL_P.format(z='z')}, 5) AS p FROM z"""


@query(_did_sql("(n11 + n10 + n01 + n00)::DOUBLE"))
def stratified_did_p(t: Callable) -> DataFrame:
    """#128, #114: z and the normal p."""
    return rounded(stats.stratified_did(D.cells_of(t), ["o_orderstatus"], "o_orderpriority", "a", "b", "y").select("o_orderstatus", "z", "p"), 5)


GROUP = f"""{D.CELLS}, c AS (SELECT o_orderpriority, a, b, avg(y) AS m, var_samp(y) / count(*) AS e, count(*) AS n FROM o GROUP BY ALL), g AS (SELECT o_orderpriority, sum(CASE WHEN a = b THEN m ELSE -m END) / sqrt(sum(e)) AS t, (min(n) - 1)::BIGINT AS df FROM c GROUP BY 1)"""


@query(f"WITH {GROUP} SELECT o_orderpriority, round(t, 5) AS t, round({t_sql('t', 'df')}, 5) AS p FROM g")
def group_did_p(t: Callable) -> DataFrame:
    """#130, #114: t and p with the smallest cell's degrees of freedom."""
    return rounded(designs.group_did_p(D.cells_of(t), ["o_orderpriority"], "a", "b", "y").select("o_orderpriority", "t", "p"), 5)


@query(f"""WITH {D.CELLS}, c AS (SELECT o_orderpriority, a, b, avg(y) AS m, var_pop(y) * count(*) AS q, count(*) AS n FROM o GROUP BY ALL), g AS (SELECT o_orderpriority, sum(CASE WHEN a = b THEN m ELSE -m END) / sqrt(sum(q) / (sum(n) - 4) * sum(1 / n)) AS t, (sum(n) - 4)::BIGINT AS df FROM c GROUP BY 1)
SELECT o_orderpriority, round(t, 5) AS t, round({t_sql('t', 'df')}, 5) AS p FROM g""")
def ols_interaction_p(t: Callable) -> DataFrame:
    """#126, #114: t and p of the interaction."""
    return rounded(stats.ols_interaction(D.cells_of(t), ["o_orderpriority"], "a", "b", "y").select("o_orderpriority", "t", "p"), 5)


@query(f"""WITH d AS (SELECT l_suppkey, avg(l_extendedprice) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') - avg(l_extendedprice) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') - avg(l_extendedprice) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') + avg(l_extendedprice) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS d FROM lineitem GROUP BY 1),
g AS (SELECT s_nationkey, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t, count(d) - 1 AS df FROM d JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) SELECT s_nationkey, round(t, 5) AS t, CASE WHEN df >= 1 AND t IS NOT NULL THEN round({t_sql('t', 'greatest(df, 1)')}, 5) END AS p FROM g""")
def paired_did_p(t: Callable) -> DataFrame:
    """#131, #114."""
    own = lambda r, o: F.avg(F.when(((F.col("l_returnflag") == "R") == F.lit(r)) & (F.col("l_linestatus") == o), F.col("l_extendedprice")))
    means = t("lineitem").groupBy("l_suppkey").agg(own(True, "O").alias("ab"), own(True, "F").alias("a_only"), own(False, "O").alias("b_only"), own(False, "F").alias("none"))
    out = designs.paired_did(means.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")), ["s_nationkey"], "ab", "a_only", "b_only", "none")
    return rounded(out.select("s_nationkey", "t", "p"), 5)


@query()
def mediation_bootstrap(t: Callable) -> DataFrame:
    """#139: the interval and p of the indirect effect; tested by its invariants."""
    rows = t("lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    return designs.mediation_bootstrap(rows, ["l_returnflag"], "key", "l_quantity", "l_discount", "l_extendedprice", 100)


@query("""SELECT l_orderkey, l_linenumber, c_name, n_name, p_brand, l_quantity * 10 AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag IN ('R', 'A') AND l_linestatus = 'F' AND l_quantity * 10 > 0 AND l_quantity * 10 <= 10000""")
def activity_extraction(t: Callable) -> DataFrame:
    """#10-11: five tables joined, kinds and values filtered; from a database the same query is read in ranges (read_jdbc)."""
    rows = t("lineitem").where("l_returnflag IN ('R', 'A') AND l_linestatus = 'F'").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.select("l_orderkey", "l_linenumber", "c_name", "n_name", "p_brand", (F.col("l_quantity") * 10).alias("value")).where("value > 0 AND value <= 10000")


@query("""SELECT l_orderkey, l_linenumber, m AS measure, v AS value FROM (SELECT l_orderkey, l_linenumber, unnest(['flag', 'status', 'returned']) AS m, unnest([l_returnflag, CASE WHEN l_linestatus = 'F' THEN l_linestatus END, CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE ' ' END]) AS v FROM lineitem) WHERE v IS NOT NULL AND trim(v) <> ''""")
def measure_rows(t: Callable) -> DataFrame:
    """#12: a row for each measure that is given."""
    wide = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), F.when(F.col("l_linestatus") == "F", F.col("l_linestatus")).alias("status"), F.when(F.col("l_returnflag") == "R", "yes").otherwise(" ").alias("returned"))
    return io.emit_measures(wide, ["l_orderkey", "l_linenumber"], ["flag", "status", "returned"])


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def kind_counts(t: Callable) -> DataFrame:
    """#6: rows of each kind, a column a kind."""
    return t("lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0).toDF("l_suppkey", "a", "n", "r")


@query("""WITH s AS (SELECT p_type AS tissue, l_suppkey AS gene, sum(l_quantity) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) SELECT gene, tissue, v AS value FROM s WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY gene ORDER BY v DESC, tissue) <= 3""")
def matrix_top(t: Callable) -> DataFrame:
    """#13: a gene by tissue matrix back to rows, the first three of each gene."""
    wide = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("gene")).pivot("p_type", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]).agg(F.sum("l_quantity"))
    rows = wide.unpivot("gene", [c for c in wide.columns if c != "gene"], "tissue", "value").where("value > 0")
    return profiles.top_per_group(rows, ["gene"], [F.desc("value"), "tissue"], 3).drop("rank")


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS recipe, lower(p_name) AS item FROM lineitem JOIN part ON p_partkey = l_partkey")
def recipe_items(t: Callable) -> DataFrame:
    """#18: recipes written with commas, as JSON and with quotes, back to rows."""
    lists = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("recipe")).agg(F.collect_list("p_name").alias("l"))
    forms = [lists.where("recipe % 3 = 0").select("recipe", F.upper(F.array_join("l", " , ")).alias("x")), lists.where("recipe % 3 = 1").select("recipe", F.to_json("l").alias("x")), lists.where("recipe % 3 = 2").select("recipe", F.concat(F.lit("['"), F.array_join("l", "', '"), F.lit("']")).alias("x"))]
    return io.recipes([(forms[0], "x", "commas"), (forms[1], "x", "list"), (forms[2], "x", "list")])


@query("""WITH o AS (SELECT p_partkey AS k, p_name AS v FROM part), n AS (SELECT l_partkey AS k, max(l_returnflag) AS v FROM lineitem WHERE l_discount >= 0.1 GROUP BY 1) SELECT k, coalesce(n.v, o.v) AS v FROM o FULL JOIN n USING (k)""")
def upserted_nodes(t: Callable) -> DataFrame:
    """#21: new rows in place of old ones with the same key."""
    new = t("lineitem").where("l_discount >= 0.1").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_returnflag").alias("v"))
    return io.upsert(t("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v")), new, ["k"])


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha, length(coalesce(text, '')) AS n FROM documents")
def row_hashes(t: Callable) -> DataFrame:
    """#116."""
    text = F.coalesce("text", F.lit(""))
    return t("documents").select("doc_id", F.sha2(text.cast("binary"), 256).alias("sha"), F.char_length(text).cast("long").alias("n"))


KNOTS = [(0.3, 0.1), (0.45, 0.3), (0.6, 0.5), (0.8, 0.9)]


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN c < 0.3 THEN 0 " + " ".join(f"WHEN c < {b} THEN {p} + (c - {a}) * ({q} - {p}) / ({b} - {a})" for (a, p), (b, q) in zip(KNOTS, KNOTS[1:], strict=False)) + " ELSE 0.9 END::DOUBLE, 6) AS weight FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 AS c FROM lineitem)")
def confidence_weights(t: Callable) -> DataFrame:
    """#115: linear between knots, 0 below the first."""
    return rounded(t("lineitem").select("l_orderkey", "l_linenumber", C.interpolated(F.col("l_discount") * 10, KNOTS).alias("weight")))


@query("""WITH v AS (SELECT l_suppkey AS s, [sum(l_quantity) FILTER (l_returnflag = 'R'), sum(l_quantity) FILTER (l_returnflag = 'A'), sum(l_quantity) FILTER (l_returnflag = 'N')] AS a FROM lineitem WHERE l_tax >= 0.08 AND l_discount >= 0.1 GROUP BY 1), w AS (SELECT s, list_transform(a, lambda x: coalesce(x, 0)) AS a FROM v),
p AS (SELECT x.s AS a, y.s AS b, x.a AS u, y.a AS w FROM w x JOIN w y ON y.s = x.s + 1), n AS (SELECT *, sqrt(list_dot_product(u, u)) AS nu, sqrt(list_dot_product(w, w)) AS nw FROM p)
SELECT a, b, round(list_sum(list_transform(list_zip(u, w), lambda z: abs(z[1] - z[2]))), 6) AS l1, round(list_distance(u, w), 6) AS l2, round(list_dot_product(u, w) / (nu * nw), 6) AS cosine, round(CASE WHEN nu = 0 AND nw = 0 THEN 1 WHEN nu = 0 OR nw = 0 THEN 0 ELSE list_dot_product(u, w) / (nu * nw) END, 6) AS ruled FROM n""")
def vector_distances(t: Callable) -> DataFrame:
    """#113: L1, L2, cosine and its rule for zero norms, of neighbours by id."""
    of = lambda f: F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))), F.lit(0.0))
    v = t("lineitem").where("l_tax >= 0.08 AND l_discount >= 0.1").groupBy(F.col("l_suppkey").alias("a")).agg(F.array(of("R"), of("A"), of("N")).alias("u"))
    p = v.join(v.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("u").alias("w")), "a")
    u, w = F.col("u"), F.col("w")
    return rounded(p.select("a", "b", C.l1(u, w).alias("l1"), C.l2(u, w).alias("l2"), C.cosine(u, w).alias("cosine"), C.cosine_or_rule(u, w).alias("ruled")))


LEVELS = "lv AS (SELECT unnest(['region', 'nation', 'supplier']) AS level, unnest([r_name, n_name, s_name]) AS category, l_discount * 10 AS w, l_quantity AS f, l_returnflag = 'R' AS m FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"


@query(f"WITH {LEVELS} SELECT level, category, round(sum(w), 4) AS weight, round(sum(f * w) / sum(w), 6) AS mean_fold, count(*) AS n, round(coalesce(sum(w) FILTER (m), 0), 4) AS measured, round(coalesce(sum(w) FILTER (NOT m), 0), 4) AS predicted FROM lv GROUP BY 1, 2")
def weighted_category_levels(t: Callable) -> DataFrame:
    """#70: weights and weighted folds by three levels of a hierarchy, with the evidence split."""
    rows = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = rows.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("s_name").alias("supplier"), (F.col("l_discount") * 10).alias("w"), F.col("l_quantity").alias("f"), (F.col("l_returnflag") == "R").alias("m"))
    return profiles.category_levels(rows, ["region", "nation", "supplier"])


@query("""WITH e AS (SELECT l_suppkey AS i, p_brand AS g, coalesce(p_type, 'own') AS s, l_discount AS w FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R'), c AS (SELECT i, g, s, max(w) AS top FROM e GROUP BY 1, 2, 3) SELECT i AS l_suppkey, g AS p_brand, round(1 - product(1 - top), 12) AS guarded, count(*) AS n_groups FROM c GROUP BY 1, 2""")
def scaffold_guard(t: Callable) -> DataFrame:
    """#62: the guard with scaffolds (part types) for groups."""
    e = t("lineitem").where("l_returnflag <> 'R'").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(evidence.independence_guard(e, ["l_suppkey", "p_brand"], "p_type", "l_orderkey", "l_discount").select("l_suppkey", "p_brand", "guarded", "n_groups"), 12)


@query("""WITH k AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT sum(least(n, 3)) AS g, sum(n) AS n FROM k) SELECT 'grid' AS how, CAST(g AS BIGINT) AS n FROM g UNION ALL SELECT 'top-up', CAST(least(n - g, 200 - g) AS BIGINT) FROM g""")
def grid_sample_counts(t: Callable) -> DataFrame:
    """#87: three a cell, topped up to 200; which rows is tested by its invariants."""
    return designs.grid_sample(t("orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 3, 200, 5).groupBy("how").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT l_suppkey AS e, p_type AS k, sum(l_quantity) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), f AS (SELECT e, k, v / sum(v) OVER (PARTITION BY e) AS f FROM v), w AS (SELECT o_orderpriority AS r, l_suppkey AS e, sum(l_quantity) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT r AS recipe, k, round(sum(w * f) / any_value(t), 6) AS share FROM w JOIN f USING (e) JOIN (SELECT r, sum(w) AS t FROM w GROUP BY 1) USING (r) GROUP BY 1, 2""")
def recipe_signatures(t: Callable) -> DataFrame:
    """#198: the weighted mean of normalised profiles."""
    v = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("e"), F.col("p_type").alias("k")).agg(F.sum("l_quantity").alias("v"))
    f = profiles.shares(v, ["e"], "v", "f").select("e", "k", "f")
    w = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderpriority").alias("recipe"), F.col("l_suppkey").alias("e")).agg(F.sum("l_quantity").alias("w"))
    total = w.groupBy("recipe").agg(F.sum("w").alias("t"))
    return rounded(w.join(f, "e").groupBy("recipe", "k").agg(F.sum(F.col("w") * F.col("f")).alias("s")).join(total, "recipe").select("recipe", "k", (F.col("s") / F.col("t")).alias("share")))


def _change_sql(dim: str, name: str) -> str:
    return f"""o_{name} AS (SELECT r_name, n_name, {dim} AS d, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL), t_{name} AS (SELECT r_name, d, sum(v) AS t FROM o_{name} GROUP BY ALL),
g_{name} AS (SELECT k.r_name, k.n_name, t.d, t.t, t.t - coalesce(o.v, 0) AS r FROM (SELECT DISTINCT r_name, n_name FROM o_{name}) k JOIN t_{name} t USING (r_name) LEFT JOIN o_{name} o USING (r_name, n_name, d)), p_{name} AS (SELECT *, t / sum(t) OVER w AS p, r / sum(r) OVER w AS q FROM g_{name} WINDOW w AS (PARTITION BY r_name, n_name)),
{name} AS (SELECT r_name, n_name, 0.5 * sum(abs(p - q)) + 0.5 * (1 - sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q)))) AS c FROM p_{name} GROUP BY ALL)"""


@query(f"WITH {_change_sql('o_orderpriority', 'body')}, {_change_sql('c_mktsegment', 'theme')}, x AS (SELECT r_name, n_name, 0.6 * body.c + 0.4 * theme.c AS c FROM body JOIN theme USING (r_name, n_name)) SELECT r_name, n_name, round(c, 5) AS change, round(greatest(0, least(1, 1 - c)), 5) AS redundancy, c >= 0.12 AS is_unique FROM x")
def two_part_redundancy(t: Callable) -> DataFrame:
    """#213: .6 of the change in one profile and .4 of that in another."""
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    part = lambda dim, c: profiles.leave_one_out(joined, "r_name", "n_name", dim, "o_totalprice").select("r_name", "n_name", F.col("change").alias(c))
    out = part("o_orderpriority", "b").join(part("c_mktsegment", "h"), ["r_name", "n_name"]).withColumn("c", 0.6 * F.col("b") + 0.4 * F.col("h"))
    return rounded(out.select("r_name", "n_name", F.col("c").alias("change"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("c"))).alias("redundancy"), (F.col("c") >= 0.12).alias("is_unique")), 5)


@query("""WITH RECURSIVE g AS (SELECT DISTINCT p_type AS u, 'N' || s_nationkey AS v FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey), b AS (SELECT u, v FROM g UNION ALL SELECT v, u FROM g), r(s, n, d) AS (SELECT DISTINCT u, u, 0 FROM b UNION SELECT s, b.v, d + 1 FROM r JOIN b ON b.u = n WHERE d < 4),
m AS (SELECT s, n, min(d) AS d FROM r WHERE s <> n GROUP BY 1, 2) SELECT round(avg(d), 6) AS mean_distance, CAST(max(d) AS BIGINT) AS diameter, count(*) AS n_pairs FROM m""")
def shortest_paths(t: Callable) -> DataFrame:
    """#157: mean distance and diameter, by breadth-first search from every node."""
    e = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return rounded(graph.distances(graph.undirected(e.select("p_type", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("n")), "p_type", "n")))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) <= 5")
def file_order_head(t: Callable) -> DataFrame:
    """#75, #91: the first rows of a group in an explicit order, capped."""
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"))
    return t("lineitem").withColumn("r", place).where("r <= 5").select("l_suppkey", "l_orderkey", "l_linenumber")
