"""Grammars of messy metadata values, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, has_any, strip

# Years in a unit, year bounds and age bounds.
UNIT_YEARS = {
    "day": 1 / 365.25, "days": 1 / 365.25, "week": 1 / 52.1775, "weeks": 1 / 52.1775,
    "month": 1 / 12, "months": 1 / 12, "year": 1.0, "years": 1.0, "yo": 1.0, "y": 1.0,
}
YEAR_BOUNDS = (1990, 2022)
AGE_BOUNDS = (0.0, 120.0)

_NUMBER = r"(\d+(?:\.\d+)?)"
_UNIT = r"(days|day|weeks|week|months|month|years|year|yo|y)"


def unit_years(unit: Column) -> Column:
    """Years in a unit of time, null for other words."""
    bare = clean(unit)
    out = None
    for name, years in UNIT_YEARS.items():
        hit = bare == name
        out = F.when(hit, F.lit(years)) if out is None else out.when(hit, F.lit(years))
    return out


def implied_unit_years(subjects: Column) -> Column:
    """Months where the description speaks of newborn children, else years."""
    young = F.coalesce(subjects.rlike("(?i)infant|neonat|newborn"), F.lit(False))
    return F.when(young, F.lit(1 / 12)).otherwise(F.lit(1.0))


def parse_age(raw: Column, unit_hint: Column, implied: Column) -> Column:
    """``struct<years double, confidence string>`` by the first form that fits: a range
    (its middle), a bound, a number with unit, a bare number with a hinted unit, a bare
    number with the implied unit.  Anything else, or out of bounds, is null."""
    text = strip(raw)
    span = rf"(?i)^{_NUMBER}\s*-\s*{_NUMBER}\s*{_UNIT}?\b"
    bound = rf"^[<>]=?\s*{_NUMBER}"
    exact = rf"(?i)^{_NUMBER}\s*{_UNIT}\b"
    group = lambda pattern, k: F.regexp_extract(text, pattern, k)
    number = lambda c: c.try_cast("double")
    hinted = unit_years(unit_hint)
    years = (
        F.when(text.rlike(span), (number(group(span, 1)) + number(group(span, 2))) / 2 * F.coalesce(unit_years(group(span, 3)), hinted, F.lit(1.0)))
        .when(text.rlike(r"^[<>]"), number(group(bound, 1)) * F.coalesce(hinted, F.lit(1.0)))
        .when(text.rlike(exact), number(group(exact, 1)) * unit_years(group(exact, 2)))
        .when(text.rlike(r"^\d+(\.\d+)?$"), number(text) * F.coalesce(hinted, implied))
    )
    kind = (
        F.when(text.rlike(span), "range")
        .when(text.rlike(r"^[<>]"), "bound")
        .when(text.rlike(exact), "exact")
        .when(text.rlike(r"^\d+(\.\d+)?$"), F.when(hinted.isNotNull(), "exact").otherwise("inferred"))
    )
    fit = years.between(*AGE_BOUNDS)
    return F.struct(F.when(fit, years).alias("years"), F.when(fit, kind).alias("confidence"))


_DATE_FORMS = ("yyyy-MM-dd", "yyyy-MM", "yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "dd-MMM-yyyy", "MMM-yyyy")


def parse_year(value: Column, forms: Sequence[str] = _DATE_FORMS, bounds: tuple[int, int] = YEAR_BOUNDS) -> Column:
    """The year of a date; of anything else the first four digits, if within bounds."""
    text = strip(value)
    stamp = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms))
    digits = F.regexp_extract(text, r"(\d{4})", 1).try_cast("int")
    return F.coalesce(F.year(stamp), F.when(digits.between(*bounds), digits))


def host_is_human(host: Column, prefixes: Sequence[str], exact: Sequence[str], other: Sequence[str]) -> Column:
    """False if a word for something else occurs, True for a human name, else null."""
    bare = clean(host)
    human = bare.isin(list(exact))
    for p in prefixes:
        human = human | bare.startswith(p)
    return F.when(has_any(bare, other), F.lit(False)).when(human, F.lit(True))


def repair_sex(value: Column, typos: dict[str, str]) -> Column:
    """male or female, after typos; bare numbers and repeated refusals are null."""
    bare = clean(value)
    for wrong, right in typos.items():
        bare = F.when(bare == wrong, F.lit(right)).otherwise(bare)
    return F.when(bare.isin("male", "female"), bare)


def is_number(value: Column) -> Column:
    return F.coalesce(strip(value).rlike(r"^\d+(\.\d+)?$"), F.lit(False))


def repair_unit(value: Column) -> Column:
    """A unit that is a bare number has leaked from another field: null."""
    return F.when(~is_number(value), value)


def to_number(value: Column) -> Column:
    return strip(value).try_cast("double")
