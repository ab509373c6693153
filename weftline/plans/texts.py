"""Queries of the text functions: ids, names, quantity lines, labels, on strings built from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import texts as X
from weftline.plans.registry import query, rounded


def pick(by: Column, *values: Column | str) -> Column:
    """One of the values by a whole number from 0."""
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), by.cast("int") % len(values) + 1)


def _sql_pick(by: str, *values: str) -> str:
    return f"list_extract([{', '.join(values)}], CAST({by} % {len(values)} AS INT) + 1)"


RAW_ID = _sql_pick("p_partkey", "'  ' || p_name || ' '", "'Ing_' || p_name", "CAST(p_partkey AS VARCHAR)", "' !! '", "p_name || ' (x/y)'", "'GENE_' || p_brand", "'cat_' || p_name || '#'", "upper(p_type)")
PAD = "CASE WHEN regexp_matches({x}, '^[0-9]+$') AND length({x}) < 6 THEN lpad({x}, 6, '0') ELSE {x} END"


def _raw_id() -> Column:
    name = F.col("p_name")
    return pick(F.col("p_partkey"), F.concat(F.lit("  "), name, F.lit(" ")), F.concat(F.lit("Ing_"), name), F.col("p_partkey").cast("string"), " !! ", F.concat(name, F.lit(" (x/y)")), F.concat(F.lit("GENE_"), "p_brand"), F.concat(F.lit("cat_"), name, F.lit("#")), F.upper("p_type"))


@query(f"""WITH r AS (SELECT p_partkey, trim({RAW_ID}) AS t FROM part), c AS (SELECT *, regexp_replace(replace(t, ' ', '_'), '[^A-Za-z0-9_\\-]', '', 'g') AS c FROM r)
SELECT p_partkey, CASE WHEN upper(t) LIKE 'ING\\_%' ESCAPE '\\' THEN t WHEN c = '' THEN 'ING_unknown' ELSE 'ING_' || {PAD.format(x='c')} END AS ingredient_id,
CASE WHEN upper(t) LIKE 'CMP\\_%' ESCAPE '\\' THEN t WHEN c = '' THEN 'CMP_000000' ELSE 'CMP_' || c[1:32] END AS compound_id,
CASE WHEN upper(t) LIKE 'GENE\\_%' ESCAPE '\\' THEN t WHEN c = '' THEN 'GENE_unknown' ELSE 'GENE_' || upper(c) END AS gene_id,
CASE WHEN c = '' THEN 'PATH_unknown' ELSE 'PATH_' || c[1:64] END AS pathway_id,
CASE WHEN c = '' THEN 'CAT_other' WHEN lower(t) LIKE 'cat\\_%' ESCAPE '\\' THEN lower(c) ELSE 'CAT_' || lower(c) END AS category_id FROM c""")
def identifiers(t: Callable) -> DataFrame:
    """#27: ids of all kinds from raw names, with their defaults."""
    raw = _raw_id()
    return t("part").select(
        "p_partkey",
        X.identifier(raw, "ING_", "ING_unknown", digits=6).alias("ingredient_id"),
        X.identifier(raw, "CMP_", "CMP_000000", longest=32).alias("compound_id"),
        X.identifier(raw, "GENE_", "GENE_unknown", case="upper").alias("gene_id"),
        X.identifier(raw, "PATH_", "PATH_unknown", longest=64).alias("pathway_id"),
        X.identifier(raw, "CAT_", "CAT_other", case="lower").alias("category_id"),
    )


@query("""SELECT l_orderkey, l_linenumber, 'INT_' || list_aggregate(list_sort(['S' || l_suppkey, 'P' || l_partkey]), 'string_agg', '_') AS pair_id,
'INT3_' || list_aggregate(list_sort(['S' || l_suppkey, 'P' || l_partkey, 'O' || l_orderkey]), 'string_agg', '_') AS triplet_id FROM lineitem""")
def ordered_ids(t: Callable) -> DataFrame:
    """#27: ids of pairs and triplets, endpoints in order."""
    s, p, o = (F.concat(F.lit(c), F.col(k).cast("string")) for c, k in (("S", "l_suppkey"), ("P", "l_partkey"), ("O", "l_orderkey")))
    return t("lineitem").select("l_orderkey", "l_linenumber", X.ordered_id("INT_", s, p).alias("pair_id"), X.ordered_id("INT3_", s, p, o).alias("triplet_id"))


HEX = "translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789', 'ghijklmnop')"


@query(f"""WITH r AS (SELECT p_partkey, {_sql_pick('p_partkey', f"{HEX}[1:14] || '-' || {HEX}[15:24] || '-n'", f"' ' || {HEX}[1:25]", f"{HEX}", f"{HEX}[1:20]", f"{HEX}[1:26]", "'nan-x'")} AS k,
{_sql_pick('p_partkey', "'FDB000' || p_partkey", "'foodb : ' || p_partkey", "'FDB-00'", "'FD' || p_partkey", "'fdb_' || p_partkey")} AS f,
{_sql_pick('p_partkey', "'COCONUT_CNP' || p_partkey || '.1'", "'coconut_x'", "'CNP.2'")} AS c, {_sql_pick('p_partkey', "' chembl' || p_partkey", "'CHEM' || p_partkey")} AS m FROM part),
x AS (SELECT *, replace(upper(trim(k)), '-', '') AS u FROM r)
SELECT p_partkey, CASE WHEN length(u) = 25 OR length(u) >= 27 THEN u[1:14] || '-' || u[15:24] || '-' || u[25:25] END AS inchikey, regexp_matches(u, '^[A-Z]{{14}}[A-Z0-9]{{10}}[A-Z0-9]+$') AS shaped,
'FDB_' || CAST(nullif(regexp_extract(f, '(?i)^(?:FDB[_\\-]?|FOODB\\s*:\\s*)([0-9]+)$', 1), '') AS BIGINT) AS fdb_id,
CASE WHEN starts_with(upper(c), 'COCONUT_') THEN split_part(c, '.', 1) END AS coconut_id, CASE WHEN starts_with(upper(trim(m)), 'CHEMBL') THEN upper(trim(m)) END AS chembl_id FROM x""")
def identity_normalizers(t: Callable) -> DataFrame:
    """#28: InChIKeys, numbered, versioned and prefixed ids."""
    key = F.translate(F.md5(F.col("p_partkey").cast("string").cast("binary")), "0123456789", "ghijklmnop")
    part, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    k = pick(part, F.concat(F.substring(key, 1, 14), F.lit("-"), F.substring(key, 15, 10), F.lit("-n")), F.concat(F.lit(" "), F.substring(key, 1, 25)), key, F.substring(key, 1, 20), F.substring(key, 1, 26), "nan-x")
    f = pick(part, F.concat(F.lit("FDB000"), n), F.concat(F.lit("foodb : "), n), "FDB-00", F.concat(F.lit("FD"), n), F.concat(F.lit("fdb_"), n))
    c = pick(part, F.concat(F.lit("COCONUT_CNP"), n, F.lit(".1")), "coconut_x", "CNP.2")
    m = pick(part, F.concat(F.lit(" chembl"), n), F.concat(F.lit("CHEM"), n))
    return t("part").select("p_partkey", X.inchikey(k).alias("inchikey"), X.looks_like_inchikey(k).alias("shaped"), X.numbered_id(f).alias("fdb_id"), X.versioned_id(c).alias("coconut_id"), X.prefixed_id(m).alias("chembl_id"))


PLURAL = "p_name || " + _sql_pick("p_partkey", "'s'", "'ies'", "'oes'", "'dishes'", "'glass'", "'roses'", "'leaves'", "'es'")


@query(f"""WITH r AS (SELECT p_partkey, {PLURAL} AS n FROM part), w AS (SELECT *, split_part(n, ' ', 1) AS a, split_part(n, ' ', 2) AS w FROM r)
SELECT p_partkey, a || ' ' || CASE WHEN w LIKE '%ies' THEN w[:-4] || 'y' WHEN w LIKE '%oes' THEN w[:-3] WHEN w LIKE '%es' AND w NOT LIKE '%ses' THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS last_word,
CASE WHEN w LIKE '%ies' THEN w[:-4] || 'y' WHEN w LIKE '%ves' THEN w[:-4] || 'f' WHEN w LIKE '%oes' THEN w[:-3] WHEN w LIKE '%es' AND w NOT LIKE '%ses' THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS token,
CASE WHEN w LIKE '%ies' THEN w[:-4] || 'y' WHEN w LIKE '%es' THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS plain FROM w""")
def singular_names(t: Callable) -> DataFrame:
    """#99: the three ways."""
    name = F.concat("p_name", pick(F.col("p_partkey"), "s", "ies", "oes", "dishes", "glass", "roses", "leaves", "es"))
    word = F.element_at(F.split(name, " "), -1)
    return t("part").select("p_partkey", X.singular_last(name).alias("last_word"), X.singular_token(word).alias("token"), X.singular_plain(word).alias("plain"))


MODS = "(?:" + "|".join(X.MODIFIERS) + ")"
RAW_NAME = _sql_pick("p_partkey", "'Fresh dried ' || p_name || '!'", "p_name || ' soup with salt'", "p_name", "'12 cups'", "'ab'", "'Organic ' || p_name || '-Mix, and  more'", "'Café Größe Ñoquí'", "'Extra virgin olive oils'")


@query(f"""WITH r AS (SELECT p_partkey, {RAW_NAME} AS n FROM part), b AS (SELECT *, trim(regexp_replace(regexp_replace(lower(n), '[^\\p{{L}}\\p{{N}}_\\s\\-]', ' ', 'g'), '\\s+', ' ', 'g')) AS b FROM r),
m AS (SELECT *, trim(regexp_replace(b, '^({MODS}\\s+)+', '')) AS m FROM b), w AS (SELECT *, list_extract(string_split(m, ' '), -1) AS w FROM m),
k AS (SELECT *, NOT regexp_matches(n, '\\p{{L}}') OR length(n) <= 2 OR regexp_matches(n, '(?i)^[0-9\\s./\\-+]+cups?$') AS junk,
regexp_matches(b, '\\b(soup|mix)\\b') OR (regexp_matches(b, '\\b(and|with|or|plus)\\b') AND len(string_split(b, ' ')) >= 3) AS dish FROM w)
SELECT p_partkey, b AS hyphened, m[1:length(m) - length(w)] || CASE WHEN length(w) > 3 AND w LIKE '%es' AND w NOT LIKE '%ses' THEN w[:-3] WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS head,
trim(regexp_replace(strip_accents(replace(lower(n), 'ß', 'ß')), '\\s+', ' ', 'g')) AS folded,
CASE WHEN junk THEN 'junk' WHEN dish THEN 'composite' WHEN regexp_matches(b, '^{MODS}\\s+') THEN 'modified' ELSE 'clean_single' END AS class FROM k""")
def name_classes(t: Callable) -> DataFrame:
    """#98, #100-102: hyphened names, modifiers off, accents off, classes."""
    n = F.col("p_name")
    raw = pick(F.col("p_partkey"), F.concat(F.lit("Fresh dried "), n, F.lit("!")), F.concat(n, F.lit(" soup with salt")), n, "12 cups", "ab", F.concat(F.lit("Organic "), n, F.lit("-Mix, and  more")), "Café Größe Ñoquí", "Extra virgin olive oils")
    return t("part").select("p_partkey", X.words_with_hyphens(raw).alias("hyphened"), X.without_modifiers(raw).alias("head"), X.folded(raw).alias("folded"), X.pre_class(raw).alias("class"))


LINE = _sql_pick("p_partkey", "p_size || ' cups chopped ' || p_name", "'1/2 tsp ground ' || p_name || ', minced'", "'2 1/4 lbs. ' || p_name", "p_name || ' to taste'", "'a pinch of ' || p_name", "'3-4 ' || p_name", "''", "'1.5 xyz ' || p_name")
UNITS_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.UNIT_ALIASES.items()) + "}"


def _line() -> Column:
    n = F.col("p_name")
    return pick(F.col("p_partkey"), F.concat(F.col("p_size").cast("string"), F.lit(" cups chopped "), n), F.concat(F.lit("1/2 tsp ground "), n, F.lit(", minced")), F.concat(F.lit("2 1/4 lbs. "), n), F.concat(n, F.lit(" to taste")), F.concat(F.lit("a pinch of "), n), F.concat(F.lit("3-4 "), n), "", F.concat(F.lit("1.5 xyz "), n))


@query(f"""WITH r AS (SELECT p_partkey, p_size, p_name, p_partkey % 8 AS k FROM part)
SELECT p_partkey, CAST(CASE k WHEN 0 THEN p_size WHEN 1 THEN 0.5 WHEN 2 THEN 2.25 WHEN 3 THEN 0.5 WHEN 4 THEN 0.3 WHEN 5 THEN 3 WHEN 7 THEN 1.5 END AS DOUBLE) AS amount,
CASE k WHEN 0 THEN 'cup' WHEN 1 THEN 'teaspoon' WHEN 2 THEN 'pound' WHEN 3 THEN 'trace' WHEN 4 THEN 'pinch' END AS unit,
CASE k WHEN 4 THEN 'of ' || p_name WHEN 0 THEN 'chopped ' || p_name WHEN 1 THEN 'ground ' || p_name || ', minced' WHEN 6 THEN '' WHEN 7 THEN 'xyz ' || p_name ELSE p_name END AS name,
CASE WHEN k < 3 THEN 'clean' WHEN k < 5 THEN 'vague' WHEN k = 6 THEN 'unparseable' ELSE 'partial' END AS parse_class,
CASE k WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN '. ' || p_name WHEN 3 THEN p_name || ' to taste' WHEN 4 THEN 'a pinch of ' || p_name WHEN 5 THEN p_name WHEN 6 THEN '' ELSE 'xyz ' || p_name END AS cleaned FROM r""")
def quantity_lines(t: Callable) -> DataFrame:
    """#103-105: quantities with fractions, unit aliases and traces, and cleaned lines."""
    q = X.quantity(_line())
    return t("part").select("p_partkey", q.alias("q"), X.cleaned_line(_line()).alias("cleaned")).select("p_partkey", "q.*", "cleaned")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS k, l_extendedprice / 1000 AS a, list_extract(['Iron, Fe', 'Energy', 'Cholesterol', 'Protein'], CAST(l_suppkey % 4 AS INT) + 1) AS n FROM lineitem),
s AS (SELECT *, list_extract(['g', 'mg', 'UG', 'G'], CAST(k AS INT) + 1) AS u FROM r), m AS (SELECT *, upper(u) = 'G' AS g FROM s)
SELECT l_orderkey, l_linenumber, round(CASE WHEN n = 'Iron, Fe' AND g AND a > 0.05 AND a <= 1 THEN a * 1000 ELSE a END, 9) AS amount,
CASE WHEN n = 'Energy' AND g AND a > 20 THEN 'KCAL' WHEN g AND (n = 'Cholesterol' OR (n = 'Iron, Fe' AND a > 0.05)) THEN 'MG' ELSE upper(u) END AS unit,
round(a * CASE upper(u) WHEN 'G' THEN 1000 WHEN 'MG' THEN 1 ELSE 0.001 END, 9) AS milligrams FROM m""")
def nutrient_units(t: Callable) -> DataFrame:
    """#106: mislabelled units mended, and units into each other."""
    a = F.col("l_extendedprice") / 1000
    n, u = pick(F.col("l_suppkey"), "Iron, Fe", "Energy", "Cholesterol", "Protein"), pick(F.col("l_linenumber"), "g", "mg", "UG", "G")
    out = t("lineitem").select("l_orderkey", "l_linenumber", X.sane_nutrient(n, a, u).alias("s"), X.in_unit(a, u, F.lit("MG")).alias("milligrams"))
    return rounded(out.select("l_orderkey", "l_linenumber", "s.amount", "s.unit", "milligrams"), 9)


@query("""WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS m, count(*) FILTER (l_returnflag <> 'R') AS p FROM lineitem GROUP BY 1)
SELECT l_suppkey, CAST(CASE WHEN l_suppkey % 3 = 2 THEN 0 ELSE m END AS INT) AS measured, CAST(CASE WHEN l_suppkey % 3 = 1 THEN 0 ELSE p END AS INT) AS predicted,
round(CASE WHEN l_suppkey % 3 = 1 THEN CASE WHEN m > 0 THEN 1.0 ELSE 0.25 END WHEN l_suppkey % 3 = 2 THEN CASE WHEN p > 0 THEN 0.0 ELSE 0.25 END ELSE m / (m + p) END::DOUBLE, 6) AS fraction FROM c""")
def evidence_splits(t: Callable) -> DataFrame:
    """#107: counts out of text."""
    c = t("lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("m"), F.count_if(F.col("l_returnflag") != "R").alias("p"))
    text = pick(F.col("l_suppkey"), F.format_string("%d measured / %d predicted", "m", "p"), F.format_string(" %d Measured", "m"), F.format_string("%d predicted", "p"))
    return rounded(c.select("l_suppkey", X.evidence_split(text, F.lit(0.25)).alias("e")).select("l_suppkey", "e.*"))


@query(f"""WITH r AS (SELECT p_partkey, p_name, {_sql_pick('p_partkey', "'R-HSA-' || p_partkey", "p_name || ' [GO:000' || p_partkey || ']'", "'GO:' || p_partkey", "' ' || p_name")} AS t FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'GO:000' || p_partkey WHEN 3 THEN p_name ELSE t END AS stable_id, CASE p_partkey % 4 WHEN 1 THEN p_name END AS name,
CASE p_partkey % 4 WHEN 0 THEN 'reactome' WHEN 3 THEN 'other' ELSE 'go' END AS kind, CASE p_name WHEN 'hot rod' THEN 'Hot-rod family' ELSE upper(p_name[1:1]) || p_name[2:9] END AS label FROM r""")
def pathway_ids(t: Callable) -> DataFrame:
    """#108, #111: ids and names of pathways, labels for people."""
    n, k = F.col("p_name"), F.col("p_partkey").cast("string")
    raw = pick(F.col("p_partkey"), F.concat(F.lit("R-HSA-"), k), F.concat(n, F.lit(" [GO:000"), k, F.lit("]")), F.concat(F.lit("GO:"), k), F.concat(F.lit(" "), n))
    label = X.display_name(F.replace(n, F.lit(" "), F.lit("_")), {"hot_rod": "Hot-rod family"}, 9)
    label = F.when(n == "hot rod", "Hot-rod family").otherwise(label)
    return t("part").select("p_partkey", X.pathway_id(raw).alias("i"), label.alias("label")).select("p_partkey", "i.*", "label")


@query("""WITH s AS (SELECT p_brand, list(DISTINCT p_name ORDER BY p_name) AS l FROM part GROUP BY 1) SELECT p_brand, unnest(l) AS item, CAST(generate_subscripts(l, 1) - 1 AS INT) AS place FROM s""")
def list_literals(t: Callable) -> DataFrame:
    """#109: lists written as JSON, with single quotes or bare, back to rows."""
    lists = t("part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("l"))
    text = pick(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int"), F.to_json("l"), F.concat(F.lit("['"), F.array_join("l", "', '"), F.lit("']")), F.array_join("l", ", "))
    return lists.select("p_brand", F.posexplode(X.list_literal(text)).alias("place", "item"))


@query("""WITH s AS (SELECT l_suppkey, l_partkey, round(max(l_discount), 2) AS c, bool_or(l_returnflag = 'R') AS m FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, 'GENE_' || l_partkey AS gene_symbol, c AS confidence, CASE WHEN m THEN 'measured' ELSE 'predicted' END AS evidence FROM s""")
def driver_genes(t: Callable) -> DataFrame:
    """#110: JSON lists of driving genes to rows."""
    s = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.round(F.max("l_discount"), 2).alias("c"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("m"))
    gene = F.struct(F.concat(F.lit("GENE_"), F.col("l_partkey").cast("string")).alias("gene_symbol"), F.col("c").alias("confidence"), F.when(F.col("m") == 1, "measured").otherwise("predicted").alias("evidence"))
    lists = s.groupBy("l_suppkey").agg(F.to_json(F.collect_list(gene)).alias("json"))
    return lists.select("l_suppkey", F.inline(X.drivers(F.col("json"))))


LIPID = _sql_pick("p_partkey", "'PC(' || p_name || ')'", "'pc(' || p_name || ')'", "p_name || '-CoA'", "'CE(' || p_size || ')'", "'CL(1)'", "p_name || ' phosphoate'", "p_name", "'cer(' || p_name")


@query(f"""WITH r AS (SELECT p_partkey, {LIPID} AS n FROM part) SELECT p_partkey, n[1:3] IN ('TG(', 'CL(', 'DG(', 'PE(', 'PC(', 'PS(', 'PA(', 'PI(', 'PG(', 'SM(', 'CE(', 'MG(') OR n LIKE '%-CoA' OR n LIKE '%phospho%' AS lipid FROM r""")
def lipid_names(t: Callable) -> DataFrame:
    """#40: lipid-like names."""
    n = F.col("p_name")
    raw = pick(F.col("p_partkey"), F.concat(F.lit("PC("), n, F.lit(")")), F.concat(F.lit("pc("), n, F.lit(")")), F.concat(n, F.lit("-CoA")), F.concat(F.lit("CE("), F.col("p_size").cast("string"), F.lit(")")), "CL(1)", F.concat(n, F.lit(" phosphoate")), n, F.concat(F.lit("cer("), n))
    return t("part").select("p_partkey", X.lipid_like(raw).alias("lipid"))


COLOURS = (("warmth", ("hot", "red")), ("chill", ("cold", "blue")), ("metal", ("gear", "bolt", "rod", "ring")))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'hot|red') THEN 'warmth' WHEN regexp_matches(p_name, 'cold|blue') THEN 'chill' WHEN regexp_matches(p_name, 'gear|bolt|rod|ring') THEN 'metal' ELSE 'generic' END AS first_label,
array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(p_name, 'hot|red') THEN 'warmth' END, CASE WHEN regexp_matches(p_name, 'cold|blue') THEN 'chill' END, CASE WHEN regexp_matches(p_name, 'gear|bolt|rod|ring') THEN 'metal' END], lambda x: x IS NOT NULL)), ',') AS labels FROM part""")
def keyword_categories(t: Callable) -> DataFrame:
    """#38, #218: the first rule that hits, and all that do."""
    return t("part").select("p_partkey", X.first_rule(F.col("p_name"), COLOURS, "generic").alias("first_label"), F.array_join(X.every_rule(F.col("p_name"), COLOURS), ",").alias("labels"))


@query("""SELECT event_id, v AS value_nm, CASE WHEN v > 0 AND v <= 10000 THEN v END AS potency_nm, CASE WHEN v > 0 THEN round(9 - log10(v), 6) >= 6 ELSE false END AS is_active FROM (SELECT event_id,
CAST(props::JSON->>'k' AS DOUBLE) * CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 END AS v FROM events)""")
def affinities(t: Callable) -> DataFrame:
    """#33-34: signs and commas off, units to nM, range and activity threshold."""
    from weftline.functions.columns import active, affinity_nm, to_nm

    k = F.get_json_object("props", "$.k").cast("int")
    text = F.concat(pick(F.col("event_id"), "< ", ">", "= "), F.format_number(k, 0))
    value = to_nm(affinity_nm(text, float("inf"), zero=True), pick(F.col("event_id"), "nM", "uM", "mg/ml"))
    return t("events").select("event_id", value.alias("value_nm"), F.when((value > 0) & (value <= 10_000), value).alias("potency_nm"), F.coalesce(active(value), F.lit(False)).alias("is_active"))
