"""All registered queries of the library, by name, with the SQL that checks them.

The test tables stand in for the domain: orders are baskets, brands items, parts and suppliers the nodes of an
evidence graph, returned lines measured evidence, discounts predicted weights, order priority a stratum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.operators import basket, evidence, graph, profiles, similarity, stats
from weftline.operators.identity import best_link
from weftline.plans import designs, extras, identity, mediation, models, storage, surface, texts, themes  # noqa: F401  (register their queries)
from weftline.plans.registry import ORACLE_SQL, QUERIES, query, rounded  # noqa: F401
from weftline.streaming.pairs import windowed_counts

def items_of(t: Callable) -> DataFrame:
    return basket.distinct_items(t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_brand")


ITEMS = "items AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
PAIRS = f"""{ITEMS}, s AS (SELECT item, count(*) AS n FROM items GROUP BY item),
c AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM items a JOIN items b ON a.basket = b.basket AND a.item < b.item GROUP BY ALL),
pairs AS (SELECT item_a, item_b, n_ab, x.n AS n_a, y.n AS n_b, log2(n_ab * (SELECT count(DISTINCT basket) FROM items)::DOUBLE / (x.n::DOUBLE * y.n)) AS pmi,
  n_ab / (x.n + y.n - n_ab) AS jaccard, n_ab / least(x.n, y.n) AS overlap FROM c JOIN s x ON item_a = x.item JOIN s y ON item_b = y.item)"""


@query(f"WITH {PAIRS} SELECT item_a, item_b, n_ab, n_a, n_b, round(pmi, 6) AS pmi, round(jaccard, 6) AS jaccard, round(overlap, 6) AS overlap FROM pairs")
def pair_pmi(t):
    """#42-43, #55-57, #59: pair counts, PMI, Jaccard, overlap ratio."""
    return rounded(basket.pair_scores(items_of(t)))


@query(f"WITH {PAIRS} SELECT item_a, item_b, n_ab, round(pmi, 6) AS pmi FROM pairs WHERE n_ab >= 5 ORDER BY round(pmi, 6) DESC, item_a, item_b LIMIT 20")
def strong_pairs(t):
    """#84."""
    top = rounded(basket.pair_scores(items_of(t)).where("n_ab >= 5")).orderBy(F.desc("pmi"), "item_a", "item_b").limit(20)
    return top.select("item_a", "item_b", "n_ab", "pmi")


@query(f"""WITH {PAIRS}, r AS (SELECT item_a, item_b, concat_ws('; ', CASE WHEN n_ab < 40 THEN 'few joint' END, CASE WHEN n_a - n_ab < 1500 THEN 'few a-only' END,
CASE WHEN n_b - n_ab < 1500 THEN 'few b-only' END, CASE WHEN overlap > 0.2 THEN 'overlap' END) AS reason FROM pairs) SELECT item_a, item_b, reason, reason = '' AS eligible FROM r""")
def pair_skip_reasons(t):
    """#32."""
    return basket.skip_reasons(basket.pair_scores(items_of(t)), 40, 1500, 0.2).select("item_a", "item_b", "reason", "eligible")


@query(f"WITH {ITEMS}, k AS (SELECT item FROM items GROUP BY item HAVING count(*) >= 2000) SELECT item, count(*) AS support FROM items WHERE item IN (SELECT item FROM k) GROUP BY item")
def item_support_gate(t):
    """#29, #45."""
    return basket.item_support(basket.frequent(items_of(t), 2000))


@query(f"WITH {ITEMS}, s AS (SELECT item, count(*) AS support FROM items GROUP BY item) SELECT item, support FROM s WHERE support < (SELECT quantile_cont(support, 0.8) FROM s)")
def staple_drop(t):
    """#30."""
    return basket.item_support(basket.without_staples(items_of(t), 0.2))


@query("""WITH items AS (SELECT DISTINCT o_orderpriority AS segment, l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey)
SELECT a.segment, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM items a JOIN items b ON a.basket = b.basket AND a.item < b.item GROUP BY ALL""")
def segment_pair_counts(t):
    """#158."""
    orders = t("orders").select(F.col("o_orderkey").alias("basket"), F.col("o_orderpriority").alias("segment"))
    return basket.pair_counts(items_of(t).join(orders, "basket"), ["segment"])


@query(f"""WITH {ITEMS}, s AS (SELECT item, count(*)::DOUBLE AS n FROM items GROUP BY item), n AS (SELECT count(DISTINCT basket)::DOUBLE AS n FROM items),
x AS (SELECT a.item AS item_a, b.item AS item_b, c.item AS item_c, count(*) AS support FROM items a JOIN items b ON a.basket = b.basket AND a.item < b.item JOIN items c ON a.basket = c.basket AND b.item < c.item GROUP BY ALL HAVING count(*) >= 3)
SELECT item_a, item_b, item_c, support, round(support * n.n * n.n / (p.n * q.n * r.n), 6) AS lift, round(ln(support * n.n * n.n / (p.n * q.n * r.n)), 6) AS pmi FROM x, n, s p, s q, s r WHERE p.item = item_a AND q.item = item_b AND r.item = item_c""")
def triplet_pmi_lift(t):
    """#58; D1: pairs are keys, so the bounded miner finds its triplets."""
    return rounded(basket.triplets(items_of(t), 3))


SUPPLIER_P = "p AS (SELECT l_suppkey, avg(l_discount) * 8 AS p FROM lineitem GROUP BY l_suppkey)"


@query(f"""WITH {SUPPLIER_P}, r AS (SELECT *, least(p, 1.0) AS pp, count(*) OVER () AS n, row_number() OVER (ORDER BY p, l_suppkey) AS i FROM p)
SELECT l_suppkey, round(least(1.0, min(p * n / i) OVER (ORDER BY i DESC)), 6) AS q FROM r""")
def bh_fdr(t):
    """#81; D2: the running minimum goes from the largest p down."""
    p = t("lineitem").groupBy("l_suppkey").agg((F.avg("l_discount") * 8).alias("p"))
    return rounded(stats.benjamini_hochberg(p, "p", ["l_suppkey"]).select("l_suppkey", "q"))


def cells_of(t: Callable) -> DataFrame:
    """Orders with two binary factors, a stratum and an outcome."""
    flags = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("a"), F.max((F.col("l_quantity") > 45).cast("int")).alias("b"))
    return t("orders").join(flags, "o_orderkey").select("o_orderstatus", "o_orderpriority", "a", "b", F.col("o_totalprice").alias("y"))


CELLS = """f AS (SELECT l_orderkey, max((l_returnflag = 'R')::INT) AS a, max((l_quantity > 45)::INT) AS b FROM lineitem GROUP BY 1), o AS (SELECT o_orderstatus, o_orderpriority, a, b, o_totalprice AS y FROM orders JOIN f ON o_orderkey = l_orderkey)"""


def _did_sql(weight: str) -> str:
    cells = ", ".join(f"avg(y) FILTER (a = {a} AND b = {b}) AS m{a}{b}, var_samp(y) FILTER (a = {a} AND b = {b}) AS v{a}{b}, count(y) FILTER (a = {a} AND b = {b}) AS n{a}{b}" for a in (0, 1) for b in (0, 1))
    return f"""WITH {CELLS}, s AS (SELECT o_orderstatus, o_orderpriority, {cells} FROM o GROUP BY 1, 2), d AS (SELECT *, m11 - m10 - m01 + m00 AS d, v11 / n11 + v10 / n10 + v01 / n01 + v00 / n00 AS v FROM s WHERE least(n11, n10, n01, n00) >= 2),
w AS (SELECT *, {weight} AS w FROM d) SELECT o_orderstatus, round(sum(w * d) / sum(w), 3) AS delta, round(sqrt(sum(w * w * v)) / sum(w), 3) AS se, count(*) AS n_strata FROM w GROUP BY 1"""


@query(_did_sql("(n11 + n10 + n01 + n00)::DOUBLE"))
def stratified_did(t):
    """#128-129; D17: strata need two rows in each cell."""
    return rounded(stats.stratified_did(cells_of(t), ["o_orderstatus"], "o_orderpriority", "a", "b", "y").drop("z", "p"), 3)


@query(_did_sql("1 / v"))
def stratified_did_inverse_variance(t):
    """#128."""
    return rounded(stats.stratified_did(cells_of(t), ["o_orderstatus"], "o_orderpriority", "a", "b", "y", inverse_variance=True).drop("z", "p"), 3)


@query(f"""WITH {CELLS}, c AS (SELECT o_orderpriority, a, b, avg(y) AS m, var_samp(y) / count(*) AS e FROM o GROUP BY ALL)
SELECT o_orderpriority, round(sum(CASE WHEN a = b THEN m ELSE -m END), 3) AS did, round(sqrt(sum(e)), 3) AS se, round(sum(CASE WHEN a = b THEN m ELSE -m END) / sqrt(sum(e)), 3) AS t FROM c GROUP BY 1""")
def group_did_welch(t):
    """#130."""
    return rounded(stats.group_did(cells_of(t), ["o_orderpriority"], "a", "b", "y"), 3)


@query(f"""WITH {CELLS}, c AS (SELECT o_orderpriority, a, b, avg(y) AS m, var_pop(y) * count(*) AS q, count(*) AS n FROM o GROUP BY ALL)
SELECT o_orderpriority, round(sum(CASE WHEN a = b THEN m ELSE -m END), 3) AS beta, round(sqrt(sum(q) / (sum(n) - 4) * sum(1 / n)), 3) AS se, round(sqrt(sum(q / (n - 1) ** 2)), 3) AS se_hc3, sum(n)::BIGINT AS n FROM c GROUP BY 1""")
def ols_interaction(t):
    """#126-127 for the saturated model."""
    return rounded(stats.ols_interaction(cells_of(t), ["o_orderpriority"], "a", "b", "y").drop("t", "p"), 3)


@query("""WITH s AS (SELECT l_returnflag, var_pop(l_quantity) AS xx, var_pop(l_discount) AS mm, covar_pop(l_quantity, l_discount) AS xm, covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_discount, l_extendedprice) AS my FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(xm / xx, 6) AS alpha, round((my * xx - xy * xm) / (mm * xx - xm * xm), 3) AS beta, round(xm / xx * (my * xx - xy * xm) / (mm * xx - xm * xm), 3) AS indirect FROM s""")
def mediation_two_ols(t):
    """#139; D5: groups too small give nulls."""
    out = stats.mediation(t("lineitem"), ["l_returnflag"], "l_quantity", "l_discount", "l_extendedprice")
    return out.select("l_returnflag", F.round("alpha", 6).alias("alpha"), F.round("beta", 3).alias("beta"), F.round("indirect", 3).alias("indirect"))


def bootstrap_ci(t):
    """#132, by Poisson weights; rows only."""
    return stats.bootstrap_mean(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", 200)


query()(bootstrap_ci)


def evidence_of(t: Callable) -> DataFrame:
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_suppkey", "l_partkey", "l_orderkey", F.col("l_discount").alias("weight"), (F.col("l_returnflag") == "R").alias("is_measured"))


EDGES = "e AS (SELECT p_brand, l_suppkey, l_partkey, l_orderkey, l_discount AS weight, l_returnflag = 'R' AS m FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"""WITH {EDGES} SELECT p_brand, l_suppkey, round(CASE WHEN bool_or(m) THEN 1.0 ELSE 1 - exp(sum(ln(1 - weight)) FILTER (NOT m)) END::DOUBLE, 6) AS confidence, CASE WHEN bool_or(m) THEN 'measured' ELSE 'predicted' END AS evidence,
count(DISTINCT l_partkey) AS n_support, count(DISTINCT l_partkey) FILTER (m) AS n_measured FROM e GROUP BY 1, 2""")
def evidence_rollup_noisy_or(t):
    """#60-61."""
    return rounded(evidence.roll_up(evidence_of(t), ["p_brand", "l_suppkey"], "l_partkey"))


@query(f"""WITH {EDGES}, c AS (SELECT p_brand, l_suppkey, l_partkey, max(weight) AS top, 1 - product(1 - weight) AS within, count(*) AS size, product(1 - weight) AS rest FROM e WHERE NOT m GROUP BY 1, 2, 3)
SELECT p_brand, l_suppkey, round(1 - product(1 - top), 6) AS guarded, round(1 - product(rest), 6) AS naive, count(*) AS n_groups,
max(size) >= 2 AND max_by(within, size::DOUBLE + within / 2) >= 0.5 * (1 - product(rest)) AS redundant FROM c GROUP BY 1, 2""")
def independence_guard(t):
    """#62-63."""
    return rounded(evidence.independence_guard(evidence_of(t).where("not is_measured"), ["p_brand", "l_suppkey"], "l_partkey", "l_orderkey", "weight"))


@query("""WITH m AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_partkey, l_suppkey, 'measured' AS evidence FROM m UNION ALL SELECT l_partkey, l_suppkey, 'predicted' FROM p ANTI JOIN m USING (l_partkey, l_suppkey)""")
def measured_wins_antijoin(t):
    """#44, #92."""
    keys = ["l_partkey", "l_suppkey"]
    lines = t("lineitem")
    return evidence.measured_wins(lines.where("l_returnflag = 'R'").select(keys).distinct(), lines.where("l_returnflag <> 'R'").select(keys).distinct(), keys)


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS c FROM lineitem) SELECT CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.5 THEN 'moderate' WHEN c >= 0.3 THEN 'low' ELSE 'withheld' END AS tier,
CASE WHEN c >= 0.3 THEN least(floor(round(c * 10, 6)) / 10, 0.9) END AS band, count(*) AS n FROM (SELECT round(c, 6) AS c FROM x) GROUP BY ALL""")
def confidence_tier(t):
    """#35-36."""
    c = F.round(F.col("l_discount") * 10, 6)
    return t("lineitem").select(C.tier(c).alias("tier"), C.similarity_band(c).alias("band")).groupBy("tier", "band").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS sig FROM lineitem GROUP BY 1), g AS (SELECT sig, count(*) AS n FROM s GROUP BY 1)
SELECT sum(n)::BIGINT AS entities, count(*) AS unique_sets, max(n) AS largest_group, count(*) FILTER (n = 1) AS singletons, round(sum(len(sig) * n) / sum(n), 6) AS mean_size FROM g""")
def signature_collapse_metrics(t):
    """#68."""
    return rounded(evidence.signature_collapse(t("lineitem"), "l_orderkey", "l_returnflag"))


@query("""WITH m AS (SELECT l_partkey, median(l_extendedprice) AS median FROM lineitem GROUP BY 1) SELECT l_partkey, l_orderkey, l_linenumber, round(median, 4) AS median FROM lineitem JOIN m USING (l_partkey)
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY abs(l_extendedprice - median), l_orderkey, l_linenumber) = 1""")
def median_potency_representative(t):
    """#64, ties by key."""
    lines = t("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(evidence.median_representative(lines, ["l_partkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"]).drop("l_extendedprice"), 4)


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_type = 'PROMO'), x AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a SEMI JOIN b USING (k)) AS n_overlap)
SELECT *, round(n_overlap / n_a, 6) AS share_a, round(n_overlap / n_b, 6) AS share_b, n_overlap > 0 AND (n_overlap / n_b >= 0.2 OR n_overlap >= 25 OR (n_b >= 500 AND n_overlap / n_a >= 0.01)) AS passes FROM x""")
def set_overlap_gate(t):
    """#53, #232: parts ever returned against promoted parts."""
    return rounded(evidence.key_overlap(t("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), t("part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("k")), "k"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem) WHERE rank <= 5")
def topk_per_group(t):
    """#75-76, #83."""
    lines = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return profiles.top_per_group(lines, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 5).drop("l_extendedprice")


@query("""WITH s AS (SELECT p_brand, l_suppkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, l_suppkey) AS rank FROM s)
SELECT p_brand, string_agg(l_suppkey || ':' || n, ',' ORDER BY rank) AS entries, count(*)::INT AS n FROM r WHERE rank <= 10 GROUP BY 1""")
def inverted_index_topk(t):
    """#202, entries written as text."""
    counts = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_suppkey").agg(F.count("*").alias("n"))
    index = profiles.inverted_index(counts, "p_brand", [F.desc("n"), "l_suppkey"], ["l_suppkey", "n"], 10)
    return index.select("p_brand", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["l_suppkey"].cast("string"), e["n"].cast("string"))), ",").alias("entries"), "n")


@query("SELECT p_brand, count(DISTINCT l_suppkey) AS df, round(ln((SELECT count(DISTINCT l_suppkey) FROM lineitem) / count(DISTINCT l_suppkey)), 6) + 0 AS idf FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def idf_distinctiveness(t):
    """#121, #192, #198."""
    return rounded(profiles.idf(t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")), "l_suppkey", "p_brand"))


TYPE_FLAG = "SELECT p_type, l_returnflag, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"


def type_flag(t: Callable) -> DataFrame:
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "l_returnflag").agg(F.sum("l_quantity").alias("v"))


@query(f"""WITH x AS ({TYPE_FLAG}), z AS (SELECT *, (ln(1 + v) - avg(ln(1 + v)) OVER w) / CASE WHEN stddev_pop(ln(1 + v)) OVER w < 1e-8 THEN 1 ELSE stddev_pop(ln(1 + v)) OVER w END AS z FROM x WINDOW w AS (PARTITION BY p_type)),
s AS (SELECT *, z - min(z) OVER (PARTITION BY p_type) AS s FROM z) SELECT p_type, l_returnflag, round(z, 5) AS z, round(s / sum(s) OVER (PARTITION BY p_type), 5) AS weight FROM s""")
def row_normalize_zscore(t):
    """#82."""
    return rounded(profiles.row_normalized(type_flag(t), ["p_type"], "v").drop("v"), 5)


@query(f"WITH x AS ({TYPE_FLAG}) SELECT p_type, l_returnflag, round(v / sum(v) OVER (PARTITION BY p_type), 6) AS share FROM x")
def weighted_category_profile(t):
    """#70, #80."""
    return rounded(profiles.shares(type_flag(t), ["p_type"], "v").drop("v"))


@query(f"WITH x AS ({TYPE_FLAG}), s AS (SELECT *, v / sum(v) OVER (PARTITION BY p_type) AS p FROM x) SELECT p_type, round(-sum(p * ln(p)), 6) AS entropy FROM s GROUP BY 1")
def entropy(t):
    """#74."""
    return rounded(profiles.shares(type_flag(t), ["p_type"], "v", "p").groupBy("p_type").agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy")))


@query("""WITH o AS (SELECT r_name, n_name, o_orderpriority, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
t AS (SELECT r_name, o_orderpriority, sum(v) AS t FROM o GROUP BY ALL), g AS (SELECT k.r_name, k.n_name, t.o_orderpriority, t.t, t.t - coalesce(o.v, 0) AS r FROM (SELECT DISTINCT r_name, n_name FROM o) k JOIN t USING (r_name) LEFT JOIN o USING (r_name, n_name, o_orderpriority)),
p AS (SELECT *, t / sum(t) OVER w AS p, r / sum(r) OVER w AS q FROM g WINDOW w AS (PARTITION BY r_name, n_name)),
c AS (SELECT r_name, n_name, 0.5 * sum(abs(p - q)) + 0.5 * (1 - sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q)))) AS change FROM p GROUP BY ALL)
SELECT r_name, n_name, round(change, 5) AS change, round(greatest(0, least(1, 1 - change)), 5) AS redundancy, change >= 0.12 AS is_unique FROM c""")
def leave_one_out_redundancy(t):
    """#213."""
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(profiles.leave_one_out(joined, "r_name", "n_name", "o_orderpriority", "o_totalprice"), 5)


@query("""WITH v AS (SELECT l_returnflag, var_samp(l_discount) AS a, var_samp(l_tax) AS b FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(CASE WHEN a > 1e-4 THEN 0.6 + (CASE WHEN b > 1e-4 THEN 0 ELSE 0.4 END) * a / (a + CASE WHEN b > 1e-4 THEN b ELSE 0 END) ELSE 0 END, 6) AS w_l_discount,
round(CASE WHEN b > 1e-4 THEN 0.4 + (CASE WHEN a > 1e-4 THEN 0 ELSE 0.6 END) * b / (b + CASE WHEN a > 1e-4 THEN a ELSE 0 END) ELSE 0 END, 6) AS w_l_tax FROM v""")
def theme_adaptive_weights(t):
    """#205."""
    return rounded(profiles.adaptive_weights(t("lineitem"), ["l_returnflag"], {"l_discount": 0.6, "l_tax": 0.4}))


@query("""SELECT l_returnflag, min(l_extendedprice) AS low, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, max(l_extendedprice) AS high, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS sd FROM lineitem GROUP BY 1""")
def distribution_summary(t):
    """#69: quantiles by rank, as a group's values would not fit one task."""
    x, names = "l_extendedprice", ["p10", "p50", "p90"]
    lines = t("lineitem").select("l_returnflag", x)
    rest = lines.groupBy("l_returnflag").agg(F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
    out = rest.join(stats.quantiles(lines, ["l_returnflag"], x, [0.1, 0.5, 0.9], names), "l_returnflag")
    return out.select("l_returnflag", "low", *[F.round(c, 4).alias(c) for c in names], "high", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS sources, count(DISTINCT l_returnflag)::INT AS n_sources, count(*) FILTER (l_linestatus = 'O') AS n_open FROM lineitem GROUP BY 1")
def source_concat(t):
    """#66-67."""
    s = F.array_sort(F.collect_set("l_returnflag"))
    return t("lineitem").groupBy("l_orderkey").agg(s.alias("s"), F.count_if(F.col("l_linestatus") == "O").alias("n_open")).select("l_orderkey", F.array_join("s", "|").alias("sources"), F.size("s").alias("n_sources"), "n_open")


@query("""WITH e AS (SELECT DISTINCT c_nationkey, l_suppkey, l_partkey, l_returnflag = 'R' AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT c_nationkey, l_suppkey, sum(m::INT)::BIGINT AS measured_hits, count(DISTINCT l_partkey) AS compound_hits, bool_or(m) AS has_measured FROM e GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY measured_hits DESC, compound_hits DESC, l_suppkey) <= 25""")
def lens_food_genes(t):
    """#41, #173."""
    e = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = e.select("c_nationkey", "l_suppkey", "l_partkey", (F.col("l_returnflag") == "R").alias("m")).distinct()
    g = e.groupBy("c_nationkey", "l_suppkey").agg(F.sum(F.col("m").cast("int")).alias("measured_hits"), F.countDistinct("l_partkey").alias("compound_hits"), F.max("m").alias("has_measured"))
    return profiles.top_per_group(g, ["c_nationkey"], [F.desc("measured_hits"), F.desc("compound_hits"), "l_suppkey"], 25).drop("rank")


@query("""SELECT o_orderpriority, s_nationkey, round(sum(coalesce(s_acctbal, 0)), 2) AS path_score, count(DISTINCT s_suppkey) AS n_genes FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(sum(coalesce(s_acctbal, 0)), 2) DESC, s_nationkey) <= 12""")
def lens_food_tissues(t):
    """#174; D14: a node counts once for every path to it."""
    e = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    g = e.groupBy("o_orderpriority", "s_nationkey").agg(F.round(F.sum(F.coalesce("s_acctbal", F.lit(0.0))), 2).alias("path_score"), F.countDistinct("s_suppkey").alias("n_genes"))
    return profiles.top_per_group(g, ["o_orderpriority"], [F.desc("path_score"), "s_nationkey"], 12).drop("rank")


SHARED = """e AS (SELECT DISTINCT l_suppkey AS e, l_partkey AS s FROM lineitem), d AS (SELECT s, count(*) AS deg FROM e GROUP BY 1 {hub}),
p AS (SELECT a.e AS a, b.e AS b, count(*) AS n_shared, round(sum(1 / deg), 6) AS specificity FROM e a JOIN e b ON a.s = b.s AND a.e < b.e JOIN d ON d.s = a.s GROUP BY ALL HAVING count(*) >= 3)"""


@query(f"WITH {SHARED.format(hub='')} SELECT * FROM p")
def lens_similar_items(t):
    """#175, #177."""
    return rounded(graph.similar_by_shared(t("lineitem"), "l_suppkey", "l_partkey", 3))


@query(f"WITH {SHARED.format(hub='HAVING count(*) <= 20')} SELECT * FROM p")
def hub_excluded_pairs(t):
    """#177, hubs left out."""
    return rounded(graph.similar_by_shared(t("lineitem"), "l_suppkey", "l_partkey", 3, 20))


TRADE = "g AS (SELECT DISTINCT o_custkey AS u, l_suppkey + 1000000 AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


def trade(t: Callable) -> DataFrame:
    """All customers and the suppliers of all their lines."""
    e = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return graph.undirected(e.select("c_custkey", (F.col("l_suppkey") + 1_000_000).alias("s")), "c_custkey", "s")


@query(f"WITH {TRADE}, b AS (SELECT u AS node FROM g UNION ALL SELECT v FROM g), d AS (SELECT node, count(*) AS degree FROM b GROUP BY 1) SELECT node, degree, round(degree / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d")
def degree_centrality(t):
    """#153-154 on the whole trade graph."""
    return rounded(graph.degree_centrality(trade(t)))


LABELS = ", ".join(f"l{i + 1} AS (SELECT n, min(c) AS c FROM (SELECT n, c FROM l{i} UNION ALL SELECT b.u, c FROM b JOIN l{i} ON n = b.v) GROUP BY 1)" for i in range(10))


@query(f"WITH {TRADE}, b AS (SELECT u, v FROM g UNION ALL SELECT v, u FROM g), l0 AS (SELECT DISTINCT u AS n, u AS c FROM b), {LABELS} SELECT n AS node, c AS component FROM l10")
def connected_components(t):
    """#157 on the whole trade graph, whose least labels spread within ten steps of the SQL."""
    return graph.components(trade(t))


@query()
def pagerank(t):
    """#155: edges both ways, until the summed change is under the reference's tolerance; tested against converged values."""
    return graph.pagerank(graph.both_ways(trade(t)), "u", "v", tol=1e-6)


@query()
def rwr_bipartite(t):
    """#163; D18: walked once, up to the reference's 50 rounds and tolerance; tested against dense matrices."""
    links = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()
    seeds = t("supplier").select(F.col("s_nationkey").alias("seed"), F.col("s_suppkey").alias("l"))
    return graph.random_walk(links, "l_suppkey", "p_brand", seeds, times=50, tol=1e-6)


@query(f"""WITH {PAIRS}, w AS (SELECT item_a AS a, item_b AS b, jaccard AS w FROM pairs UNION ALL SELECT item_b, item_a, jaccard FROM pairs), d AS (SELECT a, sum(w) AS d FROM w GROUP BY 1), x0 AS (SELECT item AS n, n::DOUBLE AS x FROM s),
x1 AS (SELECT x0.n, x0.x - 0.2 * ((1 + coalesce(d, 0)) * x0.x - (x0.x + coalesce(p, 0))) AS x FROM x0 LEFT JOIN d ON d.a = x0.n LEFT JOIN (SELECT a, sum(w * x) AS p FROM w JOIN x0 ON n = b GROUP BY 1) q ON q.a = x0.n),
x2 AS (SELECT x1.n, x1.x - 0.2 * ((1 + coalesce(d, 0)) * x1.x - (x1.x + coalesce(p, 0))) AS x FROM x1 LEFT JOIN d ON d.a = x1.n LEFT JOIN (SELECT a, sum(w * x) AS p FROM w JOIN x1 ON n = b GROUP BY 1) q ON q.a = x1.n) SELECT n AS node, round(x, 4) AS score FROM x2""")
def laplacian_smooth(t):
    """#165; D8: subtracts, as the code does."""
    pairs = basket.pair_scores(items_of(t)).select(F.col("item_a").alias("a"), F.col("item_b").alias("b"), F.col("jaccard").alias("weight"))
    scores = basket.item_support(items_of(t)).select(F.col("item").alias("node"), F.col("support").cast("double").alias("score"))
    return rounded(graph.laplacian_smooth(scores, pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))), 4)


@query("""WITH RECURSIVE e AS (SELECT n_name AS c, r_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
w(node, root, path) AS (SELECT DISTINCT p, p, [p] FROM e WHERE p NOT IN (SELECT c FROM e) UNION ALL SELECT c, root, list_prepend(c, path) FROM w JOIN e ON p = node) SELECT node, root, array_to_string(path, ' > ') AS path FROM w""")
def hierarchy_path(t):
    """#166."""
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("c"), F.col("r_name").alias("p"))
    suppliers = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("c"), F.col("n_name").alias("p"))
    return graph.ancestor_paths(nations.unionByName(suppliers), "c", "p").select("node", "root", F.array_join("path", " > ").alias("path"))


ENRICHED = f"""WITH m AS (SELECT DISTINCT l_suppkey AS entity, l_partkey AS gene FROM lineitem), s AS (SELECT p_partkey AS gene, p_size AS pathway FROM part), u AS (SELECT count(*)::DOUBLE AS big FROM s), z AS (SELECT pathway, count(*) AS kk FROM s GROUP BY 1), d AS (SELECT entity, count(*) AS n FROM m GROUP BY 1),
h AS (SELECT entity, pathway, count(*) AS k FROM m JOIN s USING (gene) GROUP BY 1, 2), x AS (SELECT *, (k / kk) / (n / big) AS fold, least(1.0, {designs.TAIL.format(k='k', K='kk', n='n', M='big')}) AS p FROM h JOIN z USING (pathway) JOIN d USING (entity), u)"""


@query(f"{ENRICHED} SELECT entity, pathway, k, kk AS pathway_k, n, round(fold, 6) AS fold FROM x")
def enrichment_counts(t):
    """#119: counts and fold."""
    return rounded(_enriched(t).select("entity", "pathway", "k", "pathway_k", "n", "fold"))


def _enriched(t: Callable) -> DataFrame:
    m = t("lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("gene"))
    return profiles.enrichment(m, t("part").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("pathway")), "entity", "gene", "pathway")


@query(f"{ENRICHED}, r AS (SELECT *, count(*) OVER (PARTITION BY entity) AS t, row_number() OVER (PARTITION BY entity ORDER BY round(p, 12), pathway) AS i FROM x) SELECT entity, pathway, round(p, 6) AS p, round(least(1.0, min(round(p, 12) * t / i) OVER (PARTITION BY entity ORDER BY i DESC)), 6) AS q FROM r")
def enrichment_bh(t):
    """#117-119: the tail and q of every supplier's parts in every size."""
    return rounded(_enriched(t).select("entity", "pathway", "p", "q"))


@query()
def permutation_enrichment(t):
    """#124: 999 shuffles of the gene weights of each entity over the universe; rows only."""
    m = t("lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("gene")).agg((F.max("l_discount") * 10).alias("weight"))
    sets = t("part").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("pathway"))
    return stats.pathway_permutation_p(m, sets, "entity", "gene", "pathway", "weight")


def vectors(t: Callable) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


KNN = """n AS (SELECT vec_id, label, [x::DOUBLE for x in embedding]::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, b.label, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 12) AS similarity FROM n a, n b WHERE a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour)::INT AS rank FROM s QUALIFY rank <= 10)"""


@query(f"WITH {KNN} SELECT query, neighbour, rank, round(similarity, 6) AS similarity FROM k")
def knn_cosine_topk(t):
    """#49, #145."""
    return rounded(similarity.top_neighbours(vectors(t), vectors(t), 10))


@query(f"WITH {KNN} SELECT query, label, round(sum(similarity), 6) AS score, round(max(similarity), 6) AS best_similarity, arg_max(neighbour, (similarity, -neighbour)) AS best_neighbour FROM k WHERE query IN (SELECT query FROM k GROUP BY 1 HAVING max(similarity) >= 0.3) GROUP BY 1, 2")
def knn_label_vote(t):
    """#146-147."""
    return rounded(similarity.label_votes(similarity.top_neighbours(vectors(t), vectors(t), 10), vectors(t)))


@query(f"""WITH {KNN}, w AS (SELECT query, label, sum(similarity) AS score FROM k WHERE query IN (SELECT query FROM k GROUP BY 1 HAVING max(similarity) >= 0.3) GROUP BY 1, 2), r AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, label) <= 2),
h AS (SELECT vec_id, count(r.query) AS h FROM embeddings e LEFT JOIN r ON r.query = vec_id AND r.label = e.label GROUP BY 1) SELECT count(*) AS n, round(avg((h > 0)::INT), 6) AS hit_at_k, round(avg(h) / 2, 6) AS precision_at_k, round(avg(h), 6) AS recall_at_k FROM h""")
def hit_precision_recall_at_k(t):
    """#148."""
    votes = similarity.label_votes(similarity.top_neighbours(vectors(t), vectors(t), 10), vectors(t))
    return rounded(similarity.hit_metrics(votes, vectors(t).select(F.col("id").alias("query"), "label"), 2))


@query("""WITH n AS (SELECT vec_id, [(x > 0)::INT for x in embedding]::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_dot_product(a.v, b.v) AS i, list_sum(a.v) + list_sum(b.v) - list_dot_product(a.v, b.v) AS u FROM n a, n b WHERE a.vec_id <> b.vec_id)
SELECT query, neighbour, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 12) DESC, neighbour)::INT AS rank FROM s QUALIFY rank <= 5""")
def tanimoto_topk(t):
    """#144-145."""
    v = vectors(t).withColumn("vec", F.transform("vec", lambda x: (x > 0).cast("int")))
    return rounded(similarity.top_neighbours(v, v, 5, bits=True))


@query("""SELECT l_orderkey, l_linenumber, 'ING_' || lpad(l_partkey::VARCHAR, greatest(6, length(l_partkey::VARCHAR))::INT, '0') AS ingredient_id,
'INT_' || least('S' || l_suppkey, 'P' || l_partkey) || '_' || greatest('S' || l_suppkey, 'P' || l_partkey) AS pair FROM lineitem""")
def canonical_ids(t):
    """#27; D12: six digits, a parameter."""
    pair = C.pair_id(F.concat(F.lit("S"), F.col("l_suppkey")), F.concat(F.lit("P"), F.col("l_partkey")))
    return t("lineitem").select("l_orderkey", "l_linenumber", C.canonical_id(F.col("l_partkey"), "ING_", digits=6).alias("ingredient_id"), pair.alias("pair"))


@query("""SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower('Fresh ' || p_name || ' (raw), cooked!'), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda x: x NOT IN ('fresh', 'dried', 'raw', 'cooked', 'organic', 'whole', '')), ' ') AS name FROM part""")
def name_normalize(t):
    """#97."""
    return t("part").select("p_partkey", C.name_words(F.concat(F.lit("Fresh "), "p_name", F.lit(" (raw), cooked!"))).alias("name"))


@query("SELECT event_id, CASE WHEN (props::JSON->>'k')::DOUBLE BETWEEN 1 AND 50 THEN (props::JSON->>'k')::DOUBLE END AS nm FROM events")
def quantity_parse(t):
    """#33: a number with a comparison sign and thousands commas out of JSON."""
    text = F.concat(F.lit("<= "), F.get_json_object("props", "$.k"))
    return t("events").select("event_id", C.affinity_nm(F.regexp_replace(text, "= ", ""), 50.0).alias("nm"))


@query("""SELECT p_partkey, round(CASE p_size % 5 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice * 1000 WHEN 2 THEN p_retailprice * p_size WHEN 3 THEN p_retailprice * 2.5 END, 4) AS grams, CASE p_size % 5 WHEN 2 THEN 'portion' WHEN 3 THEN 'category' WHEN 4 THEN 'unconvertible' ELSE 'mass_unit' END AS method FROM part""")
def unit_convert_fallback(t):
    """#105, #217."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("g", "kg", "cup", "pinch", "bunch")]), F.col("p_size") % 5 + 1)
    got = C_mass(unit)
    return t("part").select("p_partkey", got.alias("m")).select("p_partkey", F.round("m.grams", 4).alias("grams"), F.col("m.method").alias("method"))


def C_mass(unit: Column) -> Column:
    return profiles.mass_in_grams(F.col("p_retailprice"), unit, F.when(F.col("p_size") % 5 == 2, F.col("p_size").cast("double")), F.when(F.col("p_size") % 5 == 3, F.lit(2.5)))


@query("""WITH x AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS g, count(DISTINCT l_orderkey) AS c, count(DISTINCT l_returnflag) AS p, count(*) AS t, avg(l_discount) AS q FROM lineitem GROUP BY 1),
s AS (SELECT *, greatest(0, least(1, (0.4 * ln(1 + least(g, 100)) / ln(101) + 0.2 * ln(1 + least(c, 20)) / ln(21) + 0.4 * ln(1 + least(p, 10)) / ln(11) + 0.15 / (1 + exp(-ln(1 + least(t, 500))))) * 0.8 * (1 - q))) AS score FROM x)
SELECT l_suppkey, round(score, 6) AS score, CASE WHEN (q - 0.05 > 1e-6 AND score < 0.5) OR (q - 0.05 < -1e-6 AND score > 0.5) THEN 'incoherent' ELSE 'coherent' END AS flag FROM s""")
def mechanistic_score(t):
    """#112, #184-185; D6: no unused parameters."""
    x = t("lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("g"), F.countDistinct("l_orderkey").alias("c"), F.countDistinct("l_returnflag").alias("p"), F.count("*").alias("t"), F.avg("l_discount").alias("q"))
    x = x.withColumn("score", profiles.mechanistic_score(F.col("g"), F.col("c"), F.col("p"), F.col("t"), F.lit(0.8), F.col("q")))
    return rounded(x.select("l_suppkey", "score", profiles.coherence(F.col("q") - 0.05, F.col("score")).alias("flag")))


@query("""WITH x AS (SELECT p_brand, l_suppkey, sum(l_quantity) AS m, count(*) AS n, avg(l_discount) * 30 AS f, avg((l_returnflag = 'R')::INT) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
c AS (SELECT *, m ** 0.3 * greatest(0.01, ln(1 + n) / ln(5001) * (0.5 + 0.5 * least(1, f / 3)) * (1 + 0.25 * r)) ** 1.1 AS c FROM x)
SELECT p_brand, l_suppkey, round(c / sum(c) OVER (PARTITION BY p_brand), 6) AS share FROM c""")
def mechanism_contribution_rank(t):
    """#220-221; D9: the exponents of the code."""
    x = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_suppkey").agg(F.sum("l_quantity").alias("m"), F.count("*").alias("n"), (F.avg("l_discount") * 30).alias("f"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    x = x.withColumn("c", profiles.contribution(F.col("m"), profiles.potency(F.col("n"), F.col("f"), F.col("r")), F.lit(1.0)))
    return rounded(profiles.shares(x, ["p_brand"], "c").select("p_brand", "l_suppkey", "share"))


@query("""WITH n AS (SELECT DISTINCT p_name || p_type AS p_name FROM part), s AS (SELECT a.p_name, b.p_name AS best, 1 - levenshtein(lower(a.p_name), lower(b.p_name)) / greatest(length(a.p_name), length(b.p_name)) AS ratio FROM n a, n b WHERE a.p_name <> b.p_name)
SELECT p_name, best, round(ratio, 6) AS ratio FROM s WHERE ratio >= 0.7 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY ratio DESC, best) = 1""")
def fuzzy_best_match(t):
    """#47: the most similar other name by edit distance, 0.7 at least; names meet by equal blocks, not all with all."""
    n = t("part").select(F.concat("p_name", "p_type").alias("name")).distinct()
    return rounded(best_link(n, n, 0.7, itself=False)).withColumnRenamed("name", "p_name")


@query("SELECT doc_id AS key, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def fk_violations(t):
    """#95, #233: documents that no label knows."""
    return profiles.foreign_key_violations(t("documents"), t("labels"), "doc_id", "doc_id")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT regexp_matches(c_name, '[02468]$')")
def id_format_violations(t):
    """#233."""
    return profiles.id_format_violations(t("customer").select("c_custkey", "c_name"), "c_name", "[02468]$")


@query("SELECT * FROM (VALUES ('o_orderkey', true, (SELECT count(*) FROM orders WHERE o_orderkey IS NULL)), ('absent', false, NULL)) v(\"column\", present, nulls)")
def schema_required_missing(t):
    """#233."""
    return profiles.missing_required(t("orders"), ["o_orderkey", "absent"])


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_event_counts(t):
    """Section 7.2 step 9: the table form of the streaming query."""
    return rounded(windowed_counts(t("events")), 4)


@query("SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) <= 50")
def stratified_sample(t):
    """#87-88: per-cell sample in a hashed order."""
    rows = t("orders").select("o_orderpriority", "o_orderkey", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"))
    return profiles.top_per_group(rows, ["o_orderpriority"], ["h", "o_orderkey"], 50).select("o_orderpriority", "o_orderkey")


@query("""WITH f AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), g AS (SELECT s_nationkey, l_suppkey, n, quantile_cont(n, 0.75) OVER (PARTITION BY s_nationkey) AS cut FROM f JOIN supplier ON l_suppkey = s_suppkey) SELECT s_nationkey, l_suppkey, n FROM g WHERE n >= cut""")
def high_conf_p75(t):
    """#78."""
    f = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    cut = stats.quantiles(f, ["s_nationkey"], "n", [0.75], ["cut"])
    return f.join(cut, "s_nationkey").where("n >= cut").select("s_nationkey", "l_suppkey", "n")


@query("""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), n AS (SELECT n_nationkey, n_name FROM nation)
SELECT c_custkey, coalesce('order:' || o.n, 'nation:' || n_name, c_name) AS key, CASE WHEN o.n IS NOT NULL THEN 'order' WHEN n_name IS NOT NULL THEN 'nation' ELSE 'name' END AS method FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN n ON n_nationkey = c_nationkey""")
def fallback_resolution(t):
    """#51: ordered fallbacks, the method told."""
    o = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    k = t("customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    key = F.coalesce(F.concat(F.lit("order:"), F.col("n").cast("string")), F.concat(F.lit("nation:"), "n_name"), "c_name")
    method = F.when(F.col("n").isNotNull(), "order").when(F.col("n_name").isNotNull(), "nation").otherwise("name")
    return k.select("c_custkey", key.alias("key"), method.alias("method"))
