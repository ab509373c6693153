"""Column expressions: canonical ids, names, units, bands, tiers, similarity of arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped from names, tier floors, similarity bands.
MODIFIERS = ("fresh", "dried", "raw", "cooked", "organic", "whole")
TIERS = ((0.7, "high"), (0.5, "moderate"), (0.3, "low"))
BANDS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def canonical_id(value: Column, prefix: str, longest: int | None = None, digits: int | None = None) -> Column:
    """Strip, spaces to ``_``, drop what is neither word character nor ``-``, pad plain numbers, add the prefix once."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(value.cast("string")), r"\s", "_"), r"[^A-Za-z0-9_\-]", "")
    if digits:
        clean = F.when(clean.rlike("^[0-9]+$") & (F.length(clean) < digits), F.lpad(clean, digits, "0")).otherwise(clean)
    if longest:
        clean = F.substring(clean, 1, longest)
    return F.when(clean.startswith(prefix), clean).otherwise(F.concat(F.lit(prefix), clean))


def pair_id(a: Column, b: Column, prefix: str = "INT_") -> Column:
    """Id of an unordered pair."""
    return F.concat(F.lit(prefix), F.least(a, b), F.lit("_"), F.greatest(a, b))


def name_words(name: Column) -> Column:
    """Lower case, marks to spaces, without the modifier words, squeezed."""
    words = F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9_\s]", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*MODIFIERS) & (w != "")), " ")


def affinity_nm(text: Column, most: float = 10_000.0, zero: bool = False) -> Column:
    """Numbers written with a leading comparison or thousands commas; null outside (0, most], 0 allowed with ``zero``."""
    value = F.regexp_replace(F.trim(text), r"^[<>=~]+\s*|,", "").try_cast("double")
    return F.when(((value >= 0) if zero else (value > 0)) & (value <= most), value)


def to_nm(value: Column, unit: Column) -> Column:
    """Nanomolar from nM or uM; null for other units."""
    return value * F.when(F.lower(unit) == "nm", 1.0).when(F.lower(unit) == "um", 1000.0)


def active(nm: Column, least: float = 6.0) -> Column:
    """Is the negative logarithm of the molar value at least ``least``; null where there is no positive value."""
    return F.when(nm > 0, F.round(9 - F.log10(nm), 6) >= least)


def tier(confidence: Column) -> Column:
    """high, moderate, low or withheld."""
    out = reduce(lambda chain, t: chain.when(confidence >= t[0], t[1]), TIERS[1:], F.when(confidence >= TIERS[0][0], TIERS[0][1]))
    return out.otherwise("withheld")


def similarity_band(similarity: Column) -> Column:
    """Lower end of the 0.1-wide band; the last is closed; null below the first."""
    top = F.when(similarity >= BANDS[-1], BANDS[-1])
    return reduce(lambda chain, b: chain.when(similarity >= b, b), BANDS[-2::-1], top)


def interpolated(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the knots, 0 below the first, level after the last."""
    out = F.when(x < knots[0][0], 0.0)
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x < x1, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(knots[-1][1])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def set_jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def cosine_or_rule(a: Column, b: Column) -> Column:
    """Cosine; 1 where both norms are zero, 0 where one is."""
    zero = (dot(a, a) == 0).cast("int") + (dot(b, b) == 0).cast("int")
    return F.when(zero == 2, 1.0).when(zero == 1, 0.0).otherwise(cosine(a, b))
