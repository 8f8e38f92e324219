"""Normalisers of names, sides and results."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")
OVER_NAMES = ("over", "o", "ov")
UNDER_NAMES = ("under", "u", "un")


@F.pandas_udf(StringType())
def _ascii(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without what ASCII lacks; Spark has no function for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def fold(s: Column) -> Column:
    return F.lower(_ascii(s))


def registry_name(s: Column) -> Column:
    """Letters and digits with single spaces; `&` is `and`; generation suffixes go."""
    x = F.regexp_replace(fold(s), "&", " and ")
    x = F.regexp_replace(x, r"[^a-z0-9]+", " ")
    x = F.regexp_replace(x, rf"\b({'|'.join(SUFFIXES)})\b", " ")
    return F.trim(F.regexp_replace(x, r" +", " "))


def quote_name(s: Column) -> Column:
    """Punctuation vanishes without a space: O'Neil is oneil here, o neil above."""
    x = F.regexp_replace(fold(s), r"[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(x, r" +", " "))


def hand(s: Column) -> Column:
    """L, R or the first letter; null for an empty text."""
    first = F.substring(F.upper(F.trim(s)), 1, 1)
    return F.nullif(first, F.lit(""))


def side(s: Column) -> Column:
    x = F.lower(F.trim(s))
    return F.when(x.isin(*OVER_NAMES), "over").when(x.isin(*UNDER_NAMES), "under")


def result_flags(result: Column) -> dict[str, Column]:
    r = F.lower(F.coalesce(result, F.lit("")))
    flag = lambda c: c.cast("int")
    return {
        "is_strikeout": flag(r.contains("strikeout")),
        "is_walk": flag(r.contains("walk") & ~r.contains("intentional")),
        "is_hit": flag(r.rlike("single|double|triple|home run") & ~r.contains("double play")),
        "is_out": flag(r.contains("out")),
    }


def resolve_column(columns: list[str], *candidates: str) -> str | None:
    """The first candidate that the table has."""
    return next((c for c in candidates if c in columns), None)
