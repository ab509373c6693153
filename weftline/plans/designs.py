"""Queries of the statistics: enrichment with weights, designs around two factors, calibration, gates and splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import designs, profiles, stats
from weftline.plans.registry import query, rounded

SETS = "sets AS (SELECT p_partkey AS gene, p_size AS pathway FROM part)"
MEMBERS = """m AS (SELECT l_suppkey AS entity, l_partkey AS gene, CASE WHEN bool_or(l_returnflag = 'R') THEN 1.0 ELSE round(max(l_discount) * 10, 6) END::DOUBLE AS c, bool_or(l_returnflag = 'R') AS measured FROM lineitem GROUP BY 1, 2)"""
TAIL = "list_sum(list_transform(range({k}, least({K}, {n}) + 1), lambda x: exp(lgamma({K} + 1) - lgamma(x + 1) - lgamma({K} - x + 1) + lgamma({M} - {K} + 1) - lgamma({n} - x + 1) - lgamma({M} - {K} - {n} + x + 1) - lgamma({M} + 1) + lgamma({n} + 1) + lgamma({M} - {n} + 1))))"
ENRICHED = f"""{SETS}, {MEMBERS}, u AS (SELECT count(DISTINCT gene)::DOUBLE AS big, count(DISTINCT pathway)::DOUBLE AS np FROM sets), z AS (SELECT pathway, count(*) AS kk FROM sets GROUP BY 1),
gi AS (SELECT gene, ln(np / count(DISTINCT pathway)) AS idf FROM sets, u GROUP BY gene, np), pi AS (SELECT pathway, sum(idf) AS s FROM sets JOIN gi USING (gene) GROUP BY 1), e AS (SELECT entity, count(*) AS n, sum(c) AS w FROM m JOIN gi USING (gene) GROUP BY 1),
h AS (SELECT entity, pathway, count(*) AS k, sum(c) AS wo, sum(c) FILTER (measured) AS wm, count(*) FILTER (measured) AS nm, sum(idf) AS io, sum(c * (1 - c)) AS cv FROM m JOIN sets USING (gene) JOIN gi USING (gene) GROUP BY 1, 2 HAVING count(*) >= 3),
b AS (SELECT pathway, count(*) / (SELECT count(DISTINCT entity) FROM m)::DOUBLE AS baseline FROM h GROUP BY 1),
x AS (SELECT *, w * kk / big AS we, {TAIL.format(k='k', K='kk', n='n', M='big')} AS p0 FROM h JOIN z USING (pathway) JOIN e USING (entity) JOIN pi USING (pathway) JOIN b USING (pathway), u),
xp AS (SELECT *, least(1.0, p0) AS p FROM x), r AS (SELECT *, count(*) OVER (PARTITION BY entity) AS nt, row_number() OVER (PARTITION BY entity ORDER BY round(least(1.0, p0), 12), pathway) AS rk FROM xp),
q AS (SELECT *, least(1.0, min(round(p, 12) * nt / rk) OVER (PARTITION BY entity ORDER BY rk DESC)) AS q FROM r)"""


def members_of(t: Callable) -> DataFrame:
    measured = F.max((F.col("l_returnflag") == "R").cast("int"))
    m = t("lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("gene")).agg(measured.alias("m"), F.round(F.max("l_discount") * 10, 6).alias("d"))
    return m.select("entity", "gene", F.when(F.col("m") == 1, 1.0).otherwise(F.col("d")).alias("confidence"), (F.col("m") == 1).alias("measured"))


def sets_of(t: Callable) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("pathway"))


@query(f"""WITH {ENRICHED} SELECT entity, pathway, k, kk AS pathway_k, n, round(n * kk / big, 6) AS expected, round(k / (n * kk / big), 6) AS fold, round(p, 6) AS p, round(q, 6) AS q, round(wo / we, 6) AS weighted_fold,
round(CASE WHEN w / big * s > 0 THEN io / (w / big * s) ELSE 0 END, 6) AS idf_weighted_fold, nm AS n_measured, k - nm AS n_predicted, round(coalesce(wm, 0), 6) AS weighted_measured, round(wo - coalesce(wm, 0), 6) AS weighted_predicted, round(baseline, 6) AS baseline_fraction FROM q""")
def weighted_enrichment(t: Callable) -> DataFrame:
    """#117-121: enrichment of every supplier's parts in sizes, with weights, IDF, the evidence split, reach and q."""
    return rounded(profiles.weighted_enrichment(members_of(t), sets_of(t), least=3).drop("drivers", "weighted_observed", "p_effective", "p_normal"))


@query(f"""WITH {ENRICHED}, d AS (SELECT entity, pathway, k, kk, n, big, w, wo, cv, greatest(3, round_even(round(w, 6), 0)) AS ne, w * kk / big AS mu FROM q), f AS (SELECT *, least(greatest(3, round_even(round(wo, 6), 0)), ne, kk)::BIGINT AS ke FROM d),
v AS (SELECT *, least(1.0, {TAIL.format(k='ke', K='kk', n='ne::BIGINT', M='big')}) AS pe FROM f) SELECT entity, pathway, round(pe, 6) AS p_effective FROM v""")
def effective_size_enrichment(t: Callable) -> DataFrame:
    """#122: the tail with rounded weight sums for sizes."""
    return rounded(profiles.weighted_enrichment(members_of(t), sets_of(t), least=3).select("entity", "pathway", "p_effective"))


@query()
def normal_enrichment(t: Callable) -> DataFrame:
    """#123: normal approximation of the overlap weight; tested against math.erfc."""
    return rounded(profiles.weighted_enrichment(members_of(t), sets_of(t), least=3).select("entity", "pathway", "p_normal"))


@query(f"""WITH {ENRICHED}, o AS (SELECT entity, pathway, gene, c, measured, row_number() OVER (PARTITION BY entity, pathway ORDER BY c DESC, gene) AS r FROM m JOIN sets USING (gene)) SELECT entity, pathway,
string_agg(gene || ':' || CASE WHEN measured THEN 'measured' ELSE 'predicted' END, ',' ORDER BY r) AS drivers FROM o SEMI JOIN h USING (entity, pathway) GROUP BY 1, 2""")
def enrichment_drivers(t: Callable) -> DataFrame:
    """#120: the genes behind each hit, by confidence."""
    out = profiles.weighted_enrichment(members_of(t), sets_of(t), least=3)
    return out.select("entity", "pathway", F.array_join(F.transform("drivers", lambda d: F.concat_ws(":", d["gene"].cast("string"), F.when(d["measured"], "measured").otherwise("predicted"))), ",").alias("drivers"))


@query()
def null_calibration(t: Callable) -> DataFrame:
    """#125: random gene sets of the suppliers' sizes; the share with any q under .1. Rows only; reproducible by seed."""
    return profiles.null_calibration(members_of(t), sets_of(t), threshold=0.1, least=3, seed=7)


CELLS = """f AS (SELECT l_orderkey, max((l_returnflag = 'R')::INT) AS a, max((l_quantity > 45)::INT) AS b FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, a, b, o_totalprice AS y FROM orders JOIN f ON o_orderkey = l_orderkey)"""


def cells_of(t: Callable) -> DataFrame:
    flags = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("a"), F.max((F.col("l_quantity") > 45).cast("int")).alias("b"), F.count("*").alias("n_lines"))
    return t("orders").join(flags, "o_orderkey").select("o_orderkey", "o_orderstatus", "o_orderpriority", "a", "b", "n_lines", F.col("o_totalprice").alias("y"))


@query("""WITH d AS (SELECT l_suppkey, avg(l_extendedprice) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') - avg(l_extendedprice) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') - avg(l_extendedprice) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') + avg(l_extendedprice) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS d FROM lineitem GROUP BY 1)
SELECT s_nationkey, round(avg(d), 3) AS did, round(stddev_samp(d) / sqrt(count(d)), 3) AS se, count(d) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 3) AS t FROM d JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def paired_did(t: Callable) -> DataFrame:
    """#131: four means of each supplier, paired; p is tested against known values."""
    own = lambda r, o: F.avg(F.when(((F.col("l_returnflag") == "R") == F.lit(r)) & (F.col("l_linestatus") == o), F.col("l_extendedprice")))
    means = t("lineitem").groupBy("l_suppkey").agg(own(True, "O").alias("ab"), own(True, "F").alias("a_only"), own(False, "O").alias("b_only"), own(False, "F").alias("none"))
    rows = means.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rounded(designs.paired_did(rows, ["s_nationkey"], "ab", "a_only", "b_only", "none").drop("p"), 3)


@query(f"""WITH {CELLS}, c AS (SELECT o_orderpriority, a, b, avg(y) AS m, var_samp(y) / count(*) AS e, count(*) AS n FROM o GROUP BY ALL)
SELECT o_orderpriority, round(sum(CASE WHEN a = b THEN m ELSE -m END), 3) AS did, round(sqrt(sum(e)), 3) AS se, round(sum(CASE WHEN a = b THEN m ELSE -m END) / sqrt(sum(e)), 3) AS t, sum(n) FILTER (a = 1 AND b = 1)::BIGINT AS n_ab, sum(n) FILTER (a = 1 AND b = 0)::BIGINT AS n_a, sum(n) FILTER (a = 0 AND b = 1)::BIGINT AS n_b, sum(n) FILTER (a = 0 AND b = 0)::BIGINT AS n_none FROM c GROUP BY 1""")
def matched_group_did(t: Callable) -> DataFrame:
    """#130 with the counts of #93; p from t with the smallest cell's degrees of freedom is tested against known values."""
    return rounded(designs.group_did_p(cells_of(t), ["o_orderpriority"], "a", "b", "y").drop("p"), 3)


@query()
def greedy_matching(t: Callable) -> DataFrame:
    """#50: treated orders matched one to one from three pools; tested against a plain loop."""
    x = cells_of(t).withColumn("group", F.when((F.col("a") == 1) & (F.col("b") == 1), "ab").when(F.col("a") == 1, "a").when(F.col("b") == 1, "b").otherwise("none"))
    rows = x.join(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey").withColumn("day", F.col("o_custkey").cast("double"))
    return designs.matched(rows.withColumn("size", F.col("n_lines") * 100.0), ["o_orderstatus", "o_orderpriority"], "o_orderkey", "group", ["size", "day"])


@query()
def bootstrap_did(t: Callable) -> DataFrame:
    """#132, #134: replicates within cells; tested by its invariants."""
    return designs.bootstrap_did(cells_of(t), ["o_orderpriority"], "a", "b", "y", 200)


@query()
def null_did(t: Callable) -> DataFrame:
    """#133: outcomes shuffled within strata; tested by its invariants."""
    return designs.null_did(cells_of(t), ["o_orderpriority"], "a", "b", "y", "o_orderkey", 11, ["o_orderstatus"])


@query("""WITH f AS (SELECT l_orderkey, max((l_returnflag = 'R')::INT) AS a, max((l_quantity > 45)::INT) AS b, count(*) AS k FROM lineitem GROUP BY 1), o AS (SELECT o_orderpriority AS g, o_totalprice AS y, k AS x, (a * b)::DOUBLE AS z FROM orders JOIN f ON o_orderkey = l_orderkey),
s AS (SELECT g, count(*) AS n, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM o GROUP BY 1),
b AS (SELECT *, (zy * xx - xy * xz) / (zz * xx - xz * xz) AS bz, (xy * zz - zy * xz) / (zz * xx - xz * xz) AS bx FROM s), e AS (SELECT o.g, any_value(n) AS n, any_value(bz) AS beta, sum((y - my - bx * (x - mx) - bz * (z - mz)) ** 2) AS sse, any_value(zz - xz * xz / xx) AS v FROM o JOIN b USING (g) GROUP BY 1)
SELECT g AS o_orderpriority, round(beta, 2) AS beta, round(sqrt(sse / (n - 3) / (n * v)), 2) AS se, round(beta / sqrt(sse / (n - 3) / (n * v)), 3) AS t, n FROM e""")
def covariate_regression(t: Callable) -> DataFrame:
    """#126: the interaction's effect given a covariate; p and HC3 (#127) are tested against numpy."""
    rows = cells_of(t).withColumn("ab", F.col("a") * F.col("b"))
    out = designs.regression(rows, ["o_orderpriority"], ["n_lines"], "y", "ab")
    return out.select("o_orderpriority", F.round("beta", 2).alias("beta"), F.round("se", 2).alias("se"), F.round("t", 3).alias("t"), "n")


@query("""WITH r AS (SELECT l_suppkey, avg(l_discount) * 8 AS p FROM lineitem GROUP BY 1), k AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p, l_suppkey) AS i FROM r), q AS (SELECT p, least(1.0, min(p * n / i) OVER (ORDER BY i DESC)) AS q FROM k)
SELECT count(*) AS n, round(avg((p <= 0.4)::INT), 6) AS share_p, round(avg((q <= 0.4)::INT), 6) AS share_q, bool_and(q BETWEEN 0 AND 1) AS in_range, bool_and(q >= p - 1e-12) AS not_below_p FROM q""")
def fdr_sanity(t: Callable) -> DataFrame:
    """#136."""
    p = t("lineitem").groupBy("l_suppkey").agg((F.avg("l_discount") * 8).alias("p"))
    return rounded(designs.fdr_sanity(stats.benjamini_hochberg(p, "p", ["l_suppkey"]), alpha=0.4))


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS b, p_brand AS i, year(o_orderdate) < 1998 AS train FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey), c AS (SELECT x.i AS a, y.i AS b, count(*) AS n, count(*) FILTER (x.train) AS k FROM i x JOIN i y ON x.b = y.b AND x.i < y.i GROUP BY 1, 2),
s AS (SELECT * FROM c ORDER BY n DESC, a, b LIMIT 100) SELECT count(*) AS n_top, count(*) FILTER (k >= 3) AS n_train, round(avg((k >= 3)::INT), 6) AS share FROM s""")
def holdout_pairs(t: Callable) -> DataFrame:
    """#135: how many of the strongest pairs the early orders show too."""
    from weftline.operators import basket

    lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    top = basket.pair_counts(basket.distinct_items(lines, "l_orderkey", "p_brand")).orderBy(F.desc("n_ab"), "item_a", "item_b").limit(100)
    train = basket.pair_counts(basket.distinct_items(lines.where(F.year("o_orderdate") < 1998), "l_orderkey", "p_brand")).where("n_ab >= 3")
    return rounded(designs.holdout_share(top, train, ["item_a", "item_b"]))


def _edges_sql(bins: int, value: str, table: str) -> str:
    return "SELECT " + ", ".join(f"quantile_cont({value}, {i / bins}) AS e{i}" for i in range(1, bins)) + f" FROM {table}"


@query(f"""WITH e AS ({_edges_sql(8, 'l_extendedprice', 'lineitem')}), b AS (SELECT greatest(0, least(5, {' + '.join(f'(e{i} <= l_extendedprice)::INT' for i in range(1, 8))} - 1)) AS bin, l_extendedprice AS v FROM lineitem, e) SELECT bin, count(*) AS n, min(v) AS low, max(v) AS high FROM b GROUP BY 1""")
def quantile_bins(t: Callable) -> DataFrame:
    """#37; D4: eight bins asked for give six."""
    return designs.quantile_bins(t("lineitem"), "l_extendedprice", 8).groupBy("bin").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("""SELECT * FROM (SELECT 'l_quantity' AS "column", round(var_samp(l_quantity), 6) AS variance, count(DISTINCT l_quantity) AS n_distinct, var_samp(l_quantity) >= 1e-8 AND count(DISTINCT l_quantity) >= 50 AS kept FROM lineitem
UNION ALL SELECT 'l_tax', round(var_samp(l_tax), 6), count(DISTINCT l_tax), var_samp(l_tax) >= 1e-8 AND count(DISTINCT l_tax) >= 50 FROM lineitem)""")
def column_gate(t: Callable) -> DataFrame:
    """#31."""
    return rounded(designs.column_gate(t("lineitem"), ["l_quantity", "l_tax"]))


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS b, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT x.i AS item_a, y.i AS item_b, count(*) AS n FROM i x JOIN i y ON x.b = y.b AND x.i < y.i GROUP BY 1, 2), m AS (SELECT max(n) AS m FROM c),
s AS (SELECT count(*) FILTER (n >= 0.99 * m) AS k FROM c, m) SELECT item_a, item_b, n AS n_ab, CASE WHEN k >= 10 THEN 'strict' ELSE 'relaxed' END AS rule FROM c, m, s WHERE n >= m * CASE WHEN k >= 10 THEN 0.99 ELSE 0.9 END""")
def relaxed_eligibility(t: Callable) -> DataFrame:
    """#32: where too few pairs pass, the relaxed rule holds."""
    from weftline.operators import basket

    pairs = basket.pair_counts(basket.distinct_items(t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_brand"))
    pairs = pairs.join(F.broadcast(pairs.agg(F.max("n_ab").alias("m"))))
    return designs.relaxed(pairs, F.col("n_ab") >= 0.99 * F.col("m"), F.col("n_ab") >= 0.9 * F.col("m"), 10).drop("m")


@query("""WITH RECURSIVE g AS (SELECT s_nationkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, s_nationkey) AS i FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), t AS (SELECT floor(0.6 * sum(n)) AS t FROM g),
r(i, total, taken, s_nationkey, n) AS (SELECT 0::BIGINT, 0::HUGEINT, false, NULL::INT, 0::BIGINT UNION ALL SELECT g.i, total + CASE WHEN total + g.n <= t THEN g.n ELSE 0 END, total + g.n <= t, g.s_nationkey, g.n FROM r JOIN g ON g.i = r.i + 1, t)
SELECT s_nationkey, n, CASE WHEN taken THEN 'train' ELSE 'test' END AS split FROM r WHERE i > 0""")
def grouped_split(t: Callable) -> DataFrame:
    """#89: whole groups go to one side."""
    groups = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return designs.greedy_split(groups, "s_nationkey", "n", 0.6)


@query("""WITH f AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_discount) * 1000 AS d FROM lineitem GROUP BY 1), c AS (SELECT avg(q) AS mq, avg(d) AS md FROM f) SELECT l_suppkey, round(sqrt((q - mq) ** 2 + (d - md) ** 2), 6) AS distance FROM f, c ORDER BY sqrt((q - mq) ** 2 + (d - md) ** 2) DESC, l_suppkey LIMIT 15""")
def centroid_outliers(t: Callable) -> DataFrame:
    """#90."""
    f = t("lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), (F.avg("l_discount") * 1000).alias("d"))
    return rounded(designs.outliers(f, "l_suppkey", ["q", "d"], 15))


@query("""WITH p AS (SELECT p_type AS x, l_shipdate::DATE - date '1990-01-01' AS k, p_size AS d, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT x, d, sum(q) AS v FROM p GROUP BY 1, 2), g AS (SELECT a.x, b.d, coalesce(s.v, 0) AS v FROM (SELECT DISTINCT x FROM s) a, (SELECT DISTINCT d FROM s) b LEFT JOIN s ON s.x = a.x AND s.d = b.d),
r AS (SELECT u.x, w.x AS y, corr(u.v, w.v) AS r FROM g u JOIN g w ON u.d = w.d AND u.x < w.x GROUP BY 1, 2) SELECT (SELECT count(DISTINCT x) FROM s) AS n, count(*) AS n_pairs, round(avg(r), 6) AS mean_r FROM r""")
def profile_correlation(t: Callable) -> DataFrame:
    """#73."""
    return rounded(designs.mean_correlation(t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")), "p_type", "p_size", "l_quantity"))


POINTS = [(0.35, 0.2), (0.45, 0.32), (0.55, 0.41), (0.65, 0.55), (0.75, 0.7), (0.85, 0.8), (0.95, 0.93)]


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN c <= 0.35 THEN 0.2 " + " ".join(f"WHEN c <= {x1} THEN {y0} + (c - {x0}) * ({y1} - {y0}) / ({x1} - {x0})" for (x0, y0), (x1, y1) in zip(POINTS, POINTS[1:], strict=False)) + " ELSE 0.93 END::DOUBLE, 6) AS rate FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 AS c FROM lineitem)")
def calibrated_confidence(t: Callable) -> DataFrame:
    """#137-138: scores through isotonic points; the fit itself is tested on known points."""
    points = [(x, y) for x, y in stats.isotonic([(x, y, 1.0) for x, y in POINTS])]
    return rounded(t("lineitem").select("l_orderkey", "l_linenumber", designs.calibrated(F.col("l_discount") * 10, points).alias("rate")))


@query("""WITH g AS (SELECT l_suppkey, min(l_discount) AS least, max(l_extendedprice) AS strongest, min(l_quantity) AS lowest, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS first_order FROM lineitem GROUP BY 1) SELECT * FROM g""")
def strongest_values(t: Callable) -> DataFrame:
    """#65: strongest, least and first by an explicit order."""
    return t("lineitem").groupBy("l_suppkey").agg(F.min("l_discount").alias("least"), F.max("l_extendedprice").alias("strongest"), F.min("l_quantity").alias("lowest"), F.min_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("first_order"))


@query("""SELECT o_orderkey, l_linenumber, min(l_discount) OVER (PARTITION BY l_orderkey) AS least, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax, l_suppkey, l_linenumber)::INT AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def group_minimum_and_rank(t: Callable) -> DataFrame:
    """#77, #79, #86: a group's least beside each row, and a rank by six keys."""
    own = Window.partitionBy("l_orderkey")
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    place = F.row_number().over(own.orderBy(F.desc("l_extendedprice"), F.desc("l_quantity"), F.desc("l_discount"), "l_tax", "l_suppkey", "l_linenumber"))
    return rows.select("o_orderkey", "l_linenumber", F.min("l_discount").over(own).alias("least"), place.alias("place"))


@query("""WITH n AS (SELECT l_returnflag, s_nationkey, count(*)::DOUBLE AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) SELECT l_returnflag, round(sum(n * n) / sum(n) ** 2, 6) AS concentration, round(max(n) / sum(n), 6) AS top_share FROM n GROUP BY 1""")
def group_concentration(t: Callable) -> DataFrame:
    """#72."""
    n = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_returnflag", "s_nationkey").agg(F.count("*").cast("double").alias("n"))
    return rounded(n.groupBy("l_returnflag").agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2.0))).alias("concentration"), (F.max("n") / F.sum("n")).alias("top_share")))


@query("""WITH s AS (SELECT l_partkey, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY 1), p AS (SELECT p_partkey, p_brand, s FROM part JOIN s ON l_partkey = p_partkey), f AS (SELECT p_brand, arg_min(s, p_partkey) AS f FROM p GROUP BY 1)
SELECT p_partkey, len(list_intersect(s, f)) AS common, round(len(list_intersect(s, f)) / len(list_distinct(list_concat(s, f))), 6) AS jaccard, len(list_distinct(list_concat(s, f))) - len(list_intersect(s, f)) AS differing FROM p JOIN f USING (p_brand)""")
def signature_sets(t: Callable) -> DataFrame:
    """#94: each part's suppliers against those of its brand's first part."""
    from weftline.functions.columns import set_jaccard

    sets = t("lineitem").groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("s"))
    p = t("part").join(sets, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "p_brand", "s")
    both = p.join(p.groupBy("p_brand").agg(F.min_by("s", "p_partkey").alias("f")), "p_brand")
    common = F.size(F.array_intersect("s", "f"))
    differ = F.size(F.array_union("s", "f")) - common
    return rounded(both.select("p_partkey", common.cast("long").alias("common"), set_jaccard(F.col("s"), F.col("f")).alias("jaccard"), differ.cast("long").alias("differing")))


def _remainder(rows: DataFrame, references: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    out, left = None, rows
    for name, known in references:
        hit = left.join(known, keys, "left_semi").withColumn("validated_by", F.lit(name))
        out = hit if out is None else out.unionByName(hit)
        left = left.join(known, keys, "left_anti")
    return out.unionByName(left.withColumn("validated_by", F.lit(None).cast("string")))


@query("""WITH p AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'N'), a AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'A')
SELECT k, s, CASE WHEN (k, s) IN (SELECT (k, s) FROM a) THEN 'returned' WHEN (k, s) IN (SELECT (k, s) FROM b) THEN 'accepted' END AS validated_by FROM p""")
def validated_predictions(t: Callable) -> DataFrame:
    """#96: predictions found in one reference after another; the rest stays unmatched."""
    of = lambda flag: t("lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s")).distinct()
    return _remainder(of("N"), [("returned", of("R")), ("accepted", of("A"))], ["k", "s"])


@query("""SELECT count(DISTINCT p_partkey) AS parts, round(count(DISTINCT l_partkey) / count(DISTINCT p_partkey), 6) AS with_lines, round(count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') / count(DISTINCT p_partkey), 6) AS with_returns, round(count(DISTINCT l_suppkey) / (SELECT count(*) FROM supplier), 6) AS suppliers_covered FROM part LEFT JOIN lineitem ON l_partkey = p_partkey""")
def coverage_report(t: Callable) -> DataFrame:
    """#71, #244: shares covered, stage by stage."""
    rows = t("part").join(t("lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left")
    n = t("supplier").agg(F.count("*").alias("n_s"))
    out = rows.agg(F.countDistinct("p_partkey").alias("parts"), F.countDistinct("l_partkey").alias("a"), F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("b"), F.countDistinct("l_suppkey").alias("c"))
    return rounded(out.join(F.broadcast(n)).select("parts", (F.col("a") / F.col("parts")).alias("with_lines"), (F.col("b") / F.col("parts")).alias("with_returns"), (F.col("c") / F.col("n_s")).alias("suppliers_covered")))
