"""Text rules as Column expressions: cleaning, null vocabularies, ordered rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean(c: Column) -> Column:
    return F.lower(strip(c))


def apply_null_rules(value: Column, field: Column, everywhere: Sequence[str], conditional: dict[str, Sequence[str]]) -> Column:
    """The value as it is, or null where its cleaned form is in the vocabulary
    ``everywhere``, or is a ``conditional`` token whose exempt fields don't include
    ``field``."""
    bare = clean(value)
    gone = bare.isin(list(everywhere))
    for token, exempt in conditional.items():
        gone = gone | ((bare == token) & ~F.coalesce(field.isin(list(exempt)), F.lit(False)))
    return F.when(~gone, value)


def has_any(c: Column, tokens: Sequence[str]) -> Column:
    """Whether any token occurs in the text."""
    return reduce(lambda a, b: a | b, (c.contains(t) for t in tokens), F.lit(False))


def first_rule(c: Column, rules: Sequence[tuple[Sequence[str], str]], default: str | None) -> Column:
    """The category of the first rule with a needle in the lower-case text."""
    low = F.lower(c)
    out = None
    for needles, category in rules:
        hit = has_any(low, [n.lower() for n in needles])
        out = F.when(hit, F.lit(category)) if out is None else out.when(hit, F.lit(category))
    end = F.lit(default).cast("string")
    return F.coalesce(out.otherwise(end), end) if out is not None else end


def sanitize(c: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one underscore."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def name_tokens(c: Column) -> Column:
    return F.split(F.lower(c), "[^a-z0-9]+")


def name_matches(c: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs in a name, in either case."""
    return has_any(F.lower(c), [w.lower() for w in words])


def known_or_unknown(c: Column) -> Column:
    """Blank text and the words that stand for missing become the level ``unknown``."""
    bare = strip(c.cast("string"))
    return F.when(bare.isNull() | bare.isin("", "nan", "None"), F.lit("unknown")).otherwise(bare)


def recode(c: Column, mapping: dict[str, str], keep_other: bool = True) -> Column:
    """Values by dictionary; others as they are, or null."""
    if not mapping:
        return c if keep_other else F.lit(None).cast("string")
    found = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))[c]
    return F.coalesce(found, c) if keep_other else found
