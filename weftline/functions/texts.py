"""Column expressions on names, ids, quantity lines and labels written as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words before a name that do not tell what it is.
MODIFIERS = (
    "fresh", "dried", "dry", "frozen", "canned", "instant", "low[- ]fat", "fat[- ]free", "reduced[- ]fat", "nonfat", "skim",
    "whole", "organic", "raw", "roasted", "toasted", "smoked", "unsalted", "salted", "granulated", "powdered", "ground",
    "crushed", "minced", "chopped", "diced", "sliced", "shredded", "grated", "peeled", "boneless", "skinless", "lean",
    "extra[- ]virgin", "light", "dark", "large", "small", "medium", "semi[- ]skimmed", "low[- ]sodium", "reduced[- ]sodium",
    "sugar[- ]free", "no[- ]salt", "prepared", "condensed", "evaporated", "unsweetened", "sweetened", "vanilla", "plain",
    "ripe", "mature", "young", "baby", "new", "old", "hot", "cold", "warm", "soft", "hard", "thick", "thin", "finely",
    "coarsely", "roughly", "thinly", "freshly",
)

# Units and cooking terms taken out of ingredient lines.
LINE_UNITS = ("cup", "tablespoon", "teaspoon", "pound", "ounce", "lb", "oz", "tsp", "tbsp", "gram", "kg", "ml", "liter")
COOKING_TERMS = ("chopped", "diced", "minced", "sliced", "ground", "fresh", "dried", "crushed", "grated", "peeled", "canned", "frozen")

# Units and what they are called.
UNIT_ALIASES = {
    "c": "cup", "cup": "cup", "cups": "cup", "tbsp": "tablespoon", "tablespoon": "tablespoon", "tablespoons": "tablespoon",
    "tsp": "teaspoon", "teaspoon": "teaspoon", "teaspoons": "teaspoon", "oz": "ounce", "ounce": "ounce", "ounces": "ounce",
    "lb": "pound", "lbs": "pound", "pound": "pound", "pounds": "pound", "g": "gram", "gram": "gram", "grams": "gram",
    "kg": "kilogram", "ml": "milliliter", "l": "liter", "can": "can", "cans": "can", "clove": "clove", "cloves": "clove",
    "slice": "slice", "slices": "slice", "piece": "piece", "pieces": "piece", "head": "head", "bunch": "bunch", "sprig": "sprig",
    "sprigs": "sprig", "stick": "stick", "sticks": "stick", "egg": "egg", "eggs": "egg", "package": "package", "pkg": "package",
}

# Grams of vague quantities, in the order in which they are looked for.
TRACES = (("pinch", 0.3), ("dash", 0.4), ("handful", 30.0), ("garnish", 2.0))
TRACE_GRAMS = 0.5
VAGUE = r"(?i)\b(to taste|as needed|as desired|for garnish|optional|a pinch|pinch of|a dash|dash of|a handful|handful of|few drops|sprinkle)\b"

# Prefixes and parts of names of lipid classes.
LIPID_PREFIXES = ("TG(", "CL(", "DG(", "PE(", "PC(", "PS(", "PA(", "PI(", "PG(", "SM(", "CE(", "MG(")
LIPID_SUFFIX, LIPID_PART = "-CoA", "phospho"

# Category rules, first hit wins.
CATEGORY_RULES = (
    ("spice", ("turmeric", "cumin", "coriander", "pepper", "spice", "clove", "cardamom", "masala")),
    ("legume", ("lentil", "dal", "bean", "pea", "chickpea")),
    ("flour", ("flour", "wheat")),
    ("sugar", ("sugar", "honey", "syrup")),
    ("fat", ("oil", "butter", "ghee", "fat")),
    ("egg", ("egg",)),
    ("liquid", ("milk", "water", "broth", "sauce", "juice")),
    ("grain", ("rice", "oat", "grain")),
)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def identifier(raw: Column, prefix: str, default: str, digits: int | None = None, longest: int | None = None, case: str | None = None) -> Column:
    """``raw`` under a prefix: kept if it has that (case ignored), else spaces to ``_``, only word characters and ``-``,
    ``case`` upper or lower, cut at ``longest``, plain numbers padded to ``digits``; ``default`` where nothing is left."""
    text = stripped(F.coalesce(raw.cast("string"), F.lit("")))
    clean = F.regexp_replace(F.replace(text, F.lit(" "), F.lit("_")), r"[^A-Za-z0-9_\-]", "")
    clean = {"upper": F.upper, "lower": F.lower}.get(case, lambda c: c)(clean)
    if longest:
        clean = F.substring(clean, 1, longest)
    if digits:
        clean = F.when(clean.rlike("^[0-9]+$") & (F.length(clean) < digits), F.lpad(clean, digits, "0")).otherwise(clean)
    named = F.when(clean == "", default).otherwise(F.concat(F.lit(prefix), clean))
    return F.when(F.upper(text).startswith(prefix.upper()), F.lower(clean) if case == "lower" else text).otherwise(named)


def ordered_id(prefix: str, *ids: Column) -> Column:
    """One id for a pair or triplet of ids, whatever their order."""
    return F.concat(F.lit(prefix), F.array_join(F.array_sort(F.array(*ids)), "_"))


def inchikey(raw: Column) -> Column:
    """14-10-1 blocks of 25 characters or of the first of 27 and more, upper case; else null."""
    clean = F.replace(F.upper(stripped(raw)), F.lit("-"), F.lit(""))
    size = F.length(clean)
    shaped = F.concat_ws("-", F.substring(clean, 1, 14), F.substring(clean, 15, 10), F.substring(clean, 25, 1))
    return F.when((size == 25) | (size >= 27), shaped)


def looks_like_inchikey(raw: Column) -> Column:
    return F.replace(F.upper(stripped(raw)), F.lit("-"), F.lit("")).rlike("^[A-Z]{14}[A-Z0-9]{10}[A-Z0-9]+$")


def numbered_id(raw: Column, pattern: str = r"(?i)^(?:FDB[_\-]?|FOODB\s*:\s*)([0-9]+)$", prefix: str = "FDB_") -> Column:
    """prefix and number without leading zeros; null where the pattern does not hold."""
    number = F.regexp_extract(stripped(raw), pattern, 1)
    return F.when(number != "", F.concat(F.lit(prefix), F.coalesce(F.nullif(F.regexp_replace(number, "^0+", ""), F.lit("")), F.lit("0"))))


def versioned_id(raw: Column, prefix: str = "COCONUT_") -> Column:
    """The id without its version after the dot; null without the prefix."""
    text = stripped(raw)
    return F.when(F.upper(text).startswith(prefix), F.regexp_replace(text, r"\..*$", ""))


def prefixed_id(raw: Column, prefix: str = "CHEMBL") -> Column:
    text = F.upper(stripped(raw))
    return F.when(text.startswith(prefix), text)


def words_with_hyphens(name: Column) -> Column:
    """Lower case, marks but hyphens to spaces, squeezed."""
    return squeezed(F.regexp_replace(F.lower(name), r"(?U)[^\w\s\-]", " "))


def folded(text: Column) -> Column:
    """Without the accents of Latin letters, lower case, squeezed. (What has no plain letter stays.)"""
    with_marks = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
    plain = "aaaaaaceeeeiiiinoooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"
    return squeezed(F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), with_marks, plain))


def _endings(word: Column, rules: list[tuple[str, int, str, str]]) -> Column:
    """The first rule (ending, least length, barred ending, replacement) that holds."""
    out = None
    for ending, least, barred, put in rules:
        holds = word.endswith(ending) & (F.length(word) >= least)
        holds = holds & ~word.endswith(barred) if barred else holds
        value = F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(put))
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out.otherwise(word)


def singular_last(name: Column) -> Column:
    """The last word in the singular: ies to y, oes to o, es but ses, s but ss; words of four letters and more."""
    words = F.split(name, " ")
    last = _endings(F.element_at(words, -1), [("ies", 4, "", "y"), ("oes", 4, "", "o"), ("es", 4, "ses", ""), ("s", 4, "ss", "")])
    return F.concat_ws(" ", F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), last)


def singular_token(word: Column) -> Column:
    """ies (five letters and more) to y, ves to f, oes to o, es but ses, s but ss."""
    return _endings(word, [("ies", 5, "", "y"), ("ves", 3, "", "f"), ("oes", 3, "", "o"), ("es", 4, "ses", ""), ("s", 4, "ss", "")])


def singular_plain(word: Column) -> Column:
    """ies (five letters and more) to y, es dropped, s but ss."""
    return _endings(word, [("ies", 5, "", "y"), ("es", 4, "", ""), ("s", 4, "ss", "")])


def without_modifiers(name: Column) -> Column:
    """Modifiers before the name dropped until none is left, then the singular."""
    return singular_last(F.trim(F.regexp_replace(words_with_hyphens(name), f"^(?:(?:{'|'.join(MODIFIERS)})\\s+)+", "")))


def is_junk(name: Column) -> Column:
    """No letter, two characters or fewer, or a quantity alone."""
    text = stripped(F.coalesce(name, F.lit("")))
    units = r"cup|cups|tbsp|tsp|oz|lb|lbs|pound|teaspoon|tablespoon|ounce|gram|grams|kg|ml|liter|clove|cloves|pinch|dash|can|cans|slice|piece"
    return ~text.rlike(r"\p{L}") | (F.length(text) <= 2) | text.rlike(rf"(?i)^[0-9\s./\-+]+(?:{units})s?$")


def is_composite(name: Column) -> Column:
    """Dishes and mixtures: a dish word, or a connector among three words and more."""
    text = words_with_hyphens(name)
    dish = r"\b(curry|soup|stew|salad|sandwich|pizza|pasta|sauce|pie|cake|bread|broth|stock|mix|blend|seasoning|dressing|juice|extract|concentrate)\b"
    return text.rlike(dish) | (text.rlike(r"\b(and|with|or|plus)\b") & (F.size(F.split(text, " ")) >= 3))


def pre_class(name: Column) -> Column:
    """junk, composite, modified or clean_single."""
    modified = words_with_hyphens(name).rlike(f"^(?:{'|'.join(MODIFIERS)})\\s+")
    return F.when(is_junk(name), "junk").when(is_composite(name), "composite").when(modified, "modified").otherwise("clean_single")


def cleaned_line(line: Column) -> Column:
    """The name in an ingredient line: without numbers, units, cooking terms and marks; lower case, squeezed."""
    out = F.regexp_replace(line, r"[0-9]+[./]?[0-9]*", "")
    out = F.regexp_replace(out, rf"(?i)\b(?:{'|'.join(LINE_UNITS)})s?\b", "")
    out = F.regexp_replace(out, rf"(?i)\b(?:{'|'.join(COOKING_TERMS)})\b", "")
    return F.lower(squeezed(F.regexp_replace(out, r"[,()\-]", " ")))


def unit_name(unit: Column) -> Column:
    """The name of a unit; unknown ones as they are."""
    key = F.regexp_replace(F.lower(stripped(unit)), r"\.+$", "")
    known = F.create_map(*[F.lit(x) for pair in UNIT_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(known, key), key)


def amount_of(text: Column) -> Column:
    """A number written as a decimal, a fraction or a whole number and a fraction; the first of a range."""
    head = F.regexp_extract(stripped(text), r"^([0-9]+(?:\s+[0-9]+/[0-9]+|/[0-9]+|\.[0-9]+)?)", 1)
    whole = F.regexp_extract(head, r"^([0-9]+)\s+[0-9]+/", 1).try_cast("double")
    top = F.regexp_extract(head, r"([0-9]+)/[0-9]+$", 1).try_cast("double")
    bottom = F.regexp_extract(head, r"/([0-9]+)$", 1).try_cast("double")
    return F.coalesce(F.coalesce(whole, F.lit(0.0)) + F.try_divide(top, bottom), head.try_cast("double"))


def quantity(line: Column) -> Column:
    """(amount, unit, name, parse_class) of an ingredient line.

    vague: a trace in grams; clean: amount and unit; partial: amount or name alone; unparseable: nothing.
    """
    text = stripped(F.coalesce(line, F.lit("")))
    low = F.lower(text)
    amount = amount_of(text)
    rest = stripped(F.regexp_replace(text, r"^[0-9][0-9\s./]*(?:-\s*[0-9./]+)?", ""))
    word = F.regexp_extract(rest, r"^([A-Za-z][A-Za-z.]*)\s+\S", 1)
    unit = F.nullif(unit_name(word), F.lit(""))
    known = F.when(unit.isin(*sorted(set(UNIT_ALIASES.values()))), unit)
    grams = reduce(lambda c, t: c.when(F.contains(low, F.lit(t[0])), t[1]), TRACES[1:], F.when(F.contains(low, F.lit(TRACES[0][0])), TRACES[0][1])).otherwise(TRACE_GRAMS)
    trace = reduce(lambda c, t: c.when(F.contains(low, F.lit(t[0])), t[0]), TRACES[1:], F.when(F.contains(low, F.lit(TRACES[0][0])), TRACES[0][0])).otherwise("trace")
    vague = text.rlike(VAGUE)
    name = F.when(known.isNotNull(), F.regexp_replace(rest, r"^[A-Za-z][A-Za-z.]*\s+", "")).otherwise(rest)
    name = F.when(vague, squeezed(F.regexp_replace(name, VAGUE, " "))).otherwise(name)
    kind = F.when(text == "", "unparseable").when(vague, "vague").when(amount.isNotNull() & known.isNotNull(), "clean").otherwise("partial")
    return F.struct(
        F.when(vague, grams).otherwise(amount).alias("amount"),
        F.when(vague, trace).otherwise(known).alias("unit"),
        F.regexp_replace(name, r"^[ ,;\-]+|[ ,;\-]+$", "").alias("name"),
        kind.alias("parse_class"),
    )


def in_unit(amount: Column, unit: Column, wanted: Column) -> Column:
    """Grams, milligrams and micrograms into each other; what is neither stays."""
    short = lambda u: F.when(F.upper(u).isin("G", "GRAM", "GRAMS"), 1e6).when(F.upper(u) == "MG", 1e3).when(F.upper(u).isin("UG", "MCG"), 1.0)
    return amount * F.coalesce(F.try_divide(short(unit), short(wanted)), F.lit(1.0))


def sane_nutrient(name: Column, amount: Column, unit: Column) -> Column:
    """(amount, unit): energy over 20 g is kcal, cholesterol and minerals given in grams are milligrams."""
    low, up = F.lower(name), F.upper(unit)
    energy = low.rlike("calor|energy") & (up == "G") & (amount > 20)
    fat = F.contains(low, F.lit("cholesterol")) & (up == "G")
    mineral = low.rlike("iron|sodium|calcium|potassium|magnesium|zinc") & (up == "G")
    value = F.when(~energy & ~fat & mineral & (amount > 0.05) & (amount <= 1), amount * 1000).otherwise(amount)
    kind = F.when(energy, "KCAL").when(fat | (mineral & (amount > 0.05)), "MG").otherwise(up)
    return F.struct(value.alias("amount"), kind.alias("unit"))


def evidence_split(text: Column, otherwise: Column) -> Column:
    """(measured, predicted, fraction) of "7 measured / 1 predicted", "9 measured" or "6 predicted"; a fraction given without counts."""
    low = F.lower(stripped(text))
    count = lambda what: F.coalesce(F.regexp_extract(low, rf"(?:^|/\s*)([0-9]+) {what}", 1).try_cast("int"), F.lit(0))
    m, p = count("measured"), count("predicted")
    return F.struct(m.alias("measured"), p.alias("predicted"), F.when(m + p > 0, m / (m + p)).otherwise(otherwise).alias("fraction"))


def pathway_id(raw: Column) -> Column:
    """(stable_id, name, kind): R-HSA ids, "Name [GO:0000001]", GO ids, others."""
    text = stripped(raw)
    go = F.regexp_extract(text, r"\[(GO:[0-9]+)\]\s*$", 1)
    kind = F.when(text.rlike("^R-[A-Z]{3}-[0-9]+$"), "reactome").when((go != "") | text.startswith("GO:"), "go").otherwise("other")
    name = F.when(go != "", stripped(F.regexp_replace(text, r"\[GO:[0-9]+\]\s*$", "")))
    return F.struct(F.when(go != "", go).otherwise(text).alias("stable_id"), name.alias("name"), kind.alias("kind"))


def list_literal(text: Column) -> Column:
    """The strings of a list written as JSON or with single quotes; comma-separated parts of anything else; null as no parts."""
    body = stripped(F.coalesce(text, F.lit("")))
    quotes = F.from_json(F.replace(body, F.lit("'"), F.lit('"')), "array<string>")
    bare = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"[^,\[\]]+"), F.lit(0)), lambda p: F.regexp_replace(stripped(p), "^['\"]+|['\"]+$", "")), lambda p: p != "")
    return F.coalesce(F.when(body.startswith("["), F.from_json(body, "array<string>")), F.when(body.startswith("["), quotes), bare)


def drivers(json: Column) -> Column:
    """The structs of a JSON list of driving genes."""
    return F.coalesce(F.from_json(json, "array<struct<gene_symbol:string,confidence:double,evidence:string>>"), F.array().cast("array<struct<gene_symbol:string,confidence:double,evidence:string>>"))


def lipid_like(name: Column) -> Column:
    """Names of lipid classes by prefix, suffix or part; case counts."""
    return reduce(lambda c, p: c | name.startswith(p), LIPID_PREFIXES, name.endswith(LIPID_SUFFIX) | F.contains(name, F.lit(LIPID_PART)))


def first_rule(text: Column, rules: tuple, default: str) -> Column:
    """The label of the first rule (label, parts) of which the lower-cased text holds a part."""
    low = F.lower(text)
    out = None
    for label, parts in rules:
        holds = reduce(lambda c, p: c | F.contains(low, F.lit(p)), parts[1:], F.contains(low, F.lit(parts[0])))
        out = F.when(holds, label) if out is None else out.when(holds, label)
    return out.otherwise(default)


def every_rule(text: Column, rules: tuple) -> Column:
    """Sorted labels of all rules (label, parts) of which the lower-cased text holds a part."""
    low = F.lower(text)
    return F.array_sort(F.array_compact(F.array(*[F.when(reduce(lambda c, p: c | F.contains(low, F.lit(p)), parts[1:], F.contains(low, F.lit(parts[0]))), label) for label, parts in rules])))


def display_name(name: Column, overrides: dict[str, str], longest: int = 64) -> Column:
    """A label for people: an override if there is one, else underscores to spaces, squeezed, cut, first letter upper."""
    plain = squeezed(F.replace(name, F.lit("_"), F.lit(" ")))
    plain = F.substring(F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, F.lit(2), F.length(plain))), 1, longest)
    known = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair]) if overrides else None
    return F.coalesce(F.element_at(known, name), plain) if overrides else plain
