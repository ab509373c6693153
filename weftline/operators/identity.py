"""Identity and quality: ordered resolution, merging of sources, gates, diagnoses, doses and nutrients."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.shared import cut

# Nominal grams of traces and of pieces; compounds and genes of a block of edges.
TRACE_GRAMS = {"trace": 0.5, "pinch": 0.3, "dash": 0.4, "handful": 30.0, "garnish": 2.0}
MASS_UNITS = {"gram": 1.0, "kilogram": 1000.0, "ounce": 28.349523125, "pound": 453.59237}
GENERIC_GRAMS = {"cup": 240.0, "tablespoon": 15.0, "teaspoon": 5.0, "milliliter": 1.0, "liter": 1000.0, "clove": 3.0, "slice": 25.0, "egg": 50.0}
BLOCK = 1024


def resolved(rows: DataFrame, steps: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """``rows`` with (resolved, method): the first of the steps (method, column of ``rows``, table (key, id)) that knows its key.

    Keys that name several ids are not used (see ``unique_keys``).
    """
    out = rows
    for i, (_, column, table) in enumerate(steps):
        known = unique_keys(table, "key", "id").select(F.col("key").alias(f"__k{i}"), F.col("id").cast("string").alias(f"__i{i}"))
        out = out.join(known, F.col(column) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    found = F.coalesce(*[F.col(f"__i{i}") for i in range(len(steps))])
    method = reduce(lambda c, i: c.when(F.col(f"__i{i}").isNotNull(), steps[i][0]), range(1, len(steps)), F.when(F.col("__i0").isNotNull(), steps[0][0])).otherwise("unresolved")
    return out.withColumns({"resolved": found, "method": method}).drop(*[f"__i{i}" for i in range(len(steps))])


def unique_keys(table: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys that name one value only."""
    return table.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.countDistinct(value).alias("__n")).where("__n = 1").drop("__n")


def mapping(primary: DataFrame, secondary: DataFrame, approved: DataFrame) -> DataFrame:
    """(accession, symbol, kind): one symbol is primary_canonical, several are each kept as ambiguous; a secondary pair only
    where its accession is new and its symbol approved."""
    p = primary.select("accession", "symbol").distinct()
    n = F.count("*").over(Window.partitionBy("accession"))
    own = p.withColumn("kind", F.when(n == 1, "primary_canonical").otherwise("ambiguous_multi"))
    more = secondary.select("accession", "symbol").distinct().join(p, "accession", "left_anti").join(approved.select("symbol").distinct(), "symbol", "left_semi")
    return own.unionByName(more.select("accession", "symbol").withColumn("kind", F.lit("secondary_approved")))


def merged(sources: list[DataFrame], key: str) -> DataFrame:
    """One row a key: of each other column the first value that isn't null, in the order of the sources; the sources that knew it."""
    columns = list(dict.fromkeys(c for s in sources for c in s.columns if c != key))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("__o", F.lit(i)) for i, s in enumerate(sources)])
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("__o", c))).alias(c) for c in columns]
    return every.groupBy(key).agg(*first, F.array_join(F.array_sort(F.collect_set("__o")), "|").alias("sources"))


def bucketed(rows: DataFrame, name: str, exact: DataFrame, normal: Column, junk: Column, composite: Column) -> DataFrame:
    """``rows`` with (bucket, match, confidence): junk and composite names apart; one exact match or one of the normal name is
    auto, several are ambiguous, none is unmatched. ``exact``: (key, id)."""
    table = exact.groupBy("key").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n"))
    first = table.select(F.col("key").alias("__a"), F.col("id").alias("__ia"), F.col("n").alias("__na"))
    second = table.select(F.col("key").alias("__b"), F.col("id").alias("__ib"), F.col("n").alias("__nb"))
    out = rows.withColumn("__norm", normal).join(first, F.lower(name) == F.col("__a"), "left").join(second, F.col("__norm") == F.col("__b"), "left")
    n = F.coalesce("__na", "__nb")
    bucket = F.when(junk, "junk").when(composite & F.col("__na").isNull(), "composite").when(n == 1, "auto").when(n > 1, "ambiguous").otherwise("unmatched")
    out = out.withColumn("bucket", bucket)
    confidence = F.when(F.col("bucket") != "auto", 0.0).when(F.col("__na").isNotNull(), 1.0).otherwise(0.9)
    return out.withColumns({"match": F.when(F.col("bucket") == "auto", F.coalesce("__ia", "__ib")), "confidence": confidence}).drop("__a", "__b", "__ia", "__ib", "__na", "__nb", "__norm")


def best_link(rows: DataFrame, names: DataFrame, least: float, itself: bool = True) -> DataFrame:
    """(name, best, ratio): the most similar known name by 1 - edits / longer length, at least ``least``; ties by name. Without ``itself`` a name
    is not its own match.

    A ratio of r allows (1 - r) of the longer name's letters to be edited, so of that many blocks and one more, into which
    a name is cut, one stands unchanged in its match: names meet by equal blocks at nearby places, not all with all.
    """
    left = rows.select("name").where(F.length("name") > 0).distinct().withColumn("__low", F.lower("name"))
    right = names.select(F.col("name").alias("best")).where(F.length("best") > 0).distinct().withColumn("__other", F.lower("best"))
    size, other = F.length("__low"), F.length("__other")
    longest = F.floor(size / least).cast("int")  # of a match
    edits = F.floor((1 - least) * longest + 1e-9).cast("int")
    width = F.greatest(F.lit(1), F.floor(size / (edits + 1)).cast("int"))
    cuts = F.filter(F.transform(F.sequence(F.lit(0), edits), lambda i: F.struct((i * width).alias("at"), F.substring("__low", i * width + 1, width).alias("block"))), lambda b: F.length(b["block"]) > 0)
    blocks = left.withColumns({"__e": edits, "__w": width}).withColumn("__c", F.explode(cuts)).select("name", "__low", "__e", "__w", "__c.at", "__c.block")
    widths = blocks.select("__w").distinct()
    grams = right.join(F.broadcast(widths), F.col("__w") <= other)  # as many rows as names have lengths
    places = F.transform(F.sequence(F.lit(0), F.length("__other") - F.col("__w")), lambda i: F.struct(i.alias("place"), F.substring("__other", i + 1, F.col("__w")).alias("block")))
    grams = grams.withColumn("__g", F.explode(places)).select("best", "__other", "__w", "__g.place", "__g.block")
    near = blocks.join(grams, ["__w", "block"]).where("abs(place - at) <= __e").select("name", "best", "__low", "__other").distinct()
    ratio = 1 - F.levenshtein("__low", "__other") / F.greatest(F.length("__low"), F.length("__other"))
    near = near if itself else near.where("name <> best")
    scored = near.withColumn("ratio", ratio).where(F.col("ratio") >= least)
    top = scored.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "best")).alias("t"))
    return top.select("name", F.col("t.best").alias("best"), (-F.col("t.r")).alias("ratio"))


def mass(amount: Column, unit: Column, portion: Column, category: Column) -> Column:
    """(grams, method): mass units, traces, a portion's weight, the category's, a generic weight of the unit, or none."""
    table = lambda d: F.element_at(F.create_map(*[F.lit(x) for p in d.items() for x in p]), unit)
    options = [("mass_unit", amount * table(MASS_UNITS)), ("trace", F.when(unit.isin(*TRACE_GRAMS), amount)), ("portion", amount * portion), ("category", amount * category), ("generic", amount * table(GENERIC_GRAMS))]
    method = reduce(lambda c, o: c.when(o[1].isNotNull(), o[0]), options[1:], F.when(options[0][1].isNotNull(), options[0][0])).otherwise("unconvertible")
    return F.struct(F.coalesce(*[v for _, v in options]).alias("grams"), method.alias("method"))


def nutrient_panel(parts: DataFrame, content: DataFrame, daily: DataFrame, servings: DataFrame | None = None) -> DataFrame:
    """recipe, nutrient: amounts (per 100 g times mass) in the daily value's unit, a serving's if servings are known, and percent of the daily value.

    ``parts``: recipe, food, mass_g; ``content``: food, nutrient, amount, unit; ``daily``: nutrient, dv, dv_unit.
    """
    from weftline.functions.texts import in_unit, sane_nutrient

    rows = parts.where("mass_g > 0").join(content, "food").join(daily, "nutrient")
    rows = rows.withColumn("__s", sane_nutrient(F.col("nutrient"), F.col("amount") * F.col("mass_g") / 100, F.col("unit")))
    total = rows.groupBy("recipe", "nutrient").agg(F.sum(in_unit(F.col("__s.amount"), F.col("__s.unit"), F.col("dv_unit"))).alias("amount"), F.first("dv").alias("dv"))
    if servings is not None:
        total = total.join(servings, "recipe", "left").withColumn("amount", F.col("amount") / F.when(F.col("servings") > 0, F.col("servings")).otherwise(1)).drop("servings")
    return total.select("recipe", "nutrient", "amount", F.try_divide(100 * F.col("amount"), F.col("dv")).alias("percent_dv"))


def scored_match(candidates: DataFrame, key: list[str], score: Column, guards: dict[str, Column], auto: float, review: float) -> DataFrame:
    """The best candidate of each key that no guard rejects, with its score and decision: auto, review or reject; keys whose
    candidates are all rejected tell the first guard."""
    told = reduce(lambda c, g: c.when(g[1], g[0]), list(guards.items())[1:], F.when(list(guards.values())[0], list(guards)[0]))
    rows = candidates.withColumns({"__s": score, "__g": told})
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("__g").isNotNull(), F.desc("__s"), "candidate"))
    best = rows.withColumn("__r", place).where("__r = 1")
    decision = F.when(F.col("__g").isNotNull(), F.concat(F.lit("guard:"), F.col("__g"))).when(F.col("__s") >= auto, "auto").when(F.col("__s") >= review, "review").otherwise("reject")
    return best.select(*key, "candidate", F.col("__s").alias("score"), decision.alias("decision"))


def cross_references(rows: DataFrame, key: str, lists: dict[str, str], sep: str = ";") -> DataFrame:
    """(key, database, reference): the parts of separated lists, a row each, trimmed and distinct."""
    each = [rows.select(key, F.lit(db).alias("database"), F.explode(F.split(F.col(c), sep)).alias("reference")) for c, db in lists.items()]
    return reduce(DataFrame.unionByName, each).withColumn("reference", F.trim("reference")).where("reference <> ''").distinct()


def allocated(rows: DataFrame, order: list[str], prefix: str, digits: int = 6, first: int = 1) -> DataFrame:
    """``rows`` with new ids prefix + number in order, numbered by ranges."""
    from weftline.operators.stats import ranked

    return ranked(rows, order).withColumn("id", F.concat(F.lit(prefix), F.lpad((F.col("__rank") + (first - 1)).cast("string"), digits, "0"))).drop("__part", "__rank", "__n")


def prefix_classes(rows: DataFrame, column: str, classes: dict[str, str], most: int) -> DataFrame:
    """(class, n, examples): values by the first pattern that matches, counted, with the ``most`` most frequent as text."""
    label = reduce(lambda c, p: c.when(F.col(column).rlike(p[1]), p[0]), list(classes.items())[1:], F.when(F.col(column).rlike(list(classes.values())[0]), list(classes)[0])).otherwise("other")
    counts = rows.groupBy(label.alias("class"), F.col(column).alias("v")).agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("c"), "v"))
    return counts.withColumn("r", place).groupBy("class").agg(F.sum("c").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.struct("r", "v")))), lambda x: x["v"]), ",").alias("examples"))


def farthest_sets(sets: DataFrame, entity: str, member: str, k: int) -> DataFrame:
    """(place, entity): the entity with most members, then always the one whose nearest chosen is farthest by Jaccard; ties by name."""
    own = sets.select(F.col(entity).alias("e"), F.col(member).alias("m")).distinct()
    sizes = own.groupBy("e").agg(F.count("*").alias("n"))
    chosen = [sizes.orderBy(F.desc("n"), "e").first()]
    while chosen[-1] is not None and len(chosen) < k:
        picked = own.where(F.col("e").isin(*[c["e"] for c in chosen])).select(F.col("e").alias("c"), "m")
        common = own.join(picked, "m").groupBy("e", "c").agg(F.count("*").alias("both"))
        grid = sizes.where(~F.col("e").isin(*[c["e"] for c in chosen])).join(F.broadcast(sizes.where(F.col("e").isin(*[c["e"] for c in chosen])).select(F.col("e").alias("c"), F.col("n").alias("n_c"))))
        far = 1 - F.coalesce("both", F.lit(0)) / (F.col("n") + F.col("n_c") - F.coalesce("both", F.lit(0)))
        chosen.append(grid.join(common, ["e", "c"], "left").groupBy("e").agg(F.round(F.min(far), 12).alias("far"), F.first("n").alias("n")).orderBy(F.desc("far"), "e").first())
    rows = [(i + 1, c["e"]) for i, c in enumerate(chosen) if c is not None]
    return sets.sparkSession.createDataFrame(rows, f"place int, entity {sets.schema[entity].dataType.simpleString()}")


def expanded(edges: DataFrame, compounds: DataFrame, same: list[str]) -> DataFrame:
    """compound, gene: the sources ("direct", "by name") of an edge, their number and its support in rows.

    ``edges`` has compound and gene, repeats included; edges "by name" are those of every other compound alike in all
    columns ``same`` of ``compounds``, once for each pair of rows alike. A gene's rows in a group are its support with any
    compound of the group, so the pairs are written as they are formed, from blocks of at most about BLOCK compounds
    times BLOCK genes of a group, and are not grouped again. Only compounds in several groups and edges without a gene
    are.
    """
    rows = edges.groupBy("compound", "gene").agg(F.count("*").alias("own"))
    known = compounds.where(" AND ".join(f"`{c}` IS NOT NULL" for c in ["compound", *same])).groupBy("compound", *same).agg(F.count("*").alias("m"))
    known = known.groupBy("compound").agg(F.collect_list(F.struct(*same, "m")).alias("kin"))
    single = known.where(F.size("kin") == 1).select("compound", F.inline("kin"))
    placed = cut(rows.join(known, "compound", "left"))  # group and gene are known of each direct edge from here on

    shared = placed.select("gene", "own", F.inline("kin")).groupBy(*same, "gene").agg(F.sum(F.col("own") * F.col("m")).alias("n"))
    shared = cut(shared)
    sizes = shared.groupBy(*same).agg(F.ceil(F.count("gene") / BLOCK).cast("int").alias("across")).where("across > 0")
    sizes = single.groupBy(*same).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("down")).join(sizes, same)
    col = F.pmod(F.xxhash64("gene"), "across").cast("int").alias("col")

    # single group: what the group adds to each compound, its own genes aside
    genes = shared.where("gene IS NOT NULL").join(sizes, same).select(*same, "down", col, F.struct("gene", "n").alias("g"))
    genes = genes.groupBy(*same, "down", "col").agg(F.collect_list("g").alias("genes")).select(*same, F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("row"), "col", "genes")
    one = F.size("kin") == 1
    held = placed.where(one).where("gene IS NOT NULL").select("compound", "gene", F.inline("kin")).join(sizes, same).groupBy("compound", col).agg(F.collect_list("gene").alias("held"))
    cells = single.join(sizes, same).select(*same, "compound", "m", F.pmod(F.xxhash64("compound"), "down").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("col"))
    cells = cells.join(held, ["compound", "col"], "left").withColumn("held", F.coalesce("held", F.array().cast(held.schema["held"].dataType)))
    pairs = cells.join(genes.hint("merge"), [*same, "row", "col"]).select("compound", "m", "held", F.explode("genes").alias("g"))
    by_name = pairs.where(~F.array_contains("held", F.col("g.gene"))).select("compound", "g.gene", F.lit("by name").alias("sources"), F.lit(1).cast("long").alias("n_sources"), (F.col("m") * F.col("g.n")).alias("support"))

    # a compound's own edges, with what its group adds
    alone = placed.where((one | F.col("kin").isNull()) & F.col("gene").isNotNull()).select("compound", "gene", "own", F.inline_outer("kin"))
    added = F.coalesce(F.col("m") * (F.col("n") - F.col("m") * F.col("own")), F.lit(0))
    own = alone.join(shared, [*same, "gene"], "left").select("compound", "gene", "own", added.alias("more"))

    # several groups, or no gene: grouped by compound and gene
    many = known.withColumn("several", F.size("kin") > 1).select("compound", "several", F.inline("kin"))
    gained = many.where("several").drop("several").join(shared, same).unionByName(many.where("NOT several").drop("several").join(shared.where("gene IS NULL"), same))
    left = placed.where((F.size("kin") > 1) | F.col("gene").isNull()).select("compound", "gene", "own", F.aggregate(F.coalesce("kin", F.array().cast(placed.schema["kin"].dataType)), F.lit(0).cast("long"), lambda s, x: s + x["m"] * x["m"]).alias("squares"))
    parts = gained.select("compound", "gene", F.lit(0).cast("long").alias("own"), (F.col("m") * F.col("n")).alias("more")).unionByName(left.select("compound", "gene", "own", (-F.col("own") * F.col("squares")).alias("more")))
    regrouped = parts.groupBy("compound", "gene").agg(F.sum("own").alias("own"), F.sum("more").alias("more"))

    direct, other = F.col("own") > 0, F.col("more") > 0
    sources = F.when(direct & other, "by name|direct").when(direct, "direct").otherwise("by name")
    told = own.unionByName(regrouped).where(direct | other).select("compound", "gene", sources.alias("sources"), F.when(direct & other, 2).otherwise(1).cast("long").alias("n_sources"), (F.col("own") + F.col("more")).alias("support"))
    return by_name.unionByName(told)
