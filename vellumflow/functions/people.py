"""Person names as column expressions: parts, sort keys, the rule by which two names are linked."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

# Suffixes that are no surnames.
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]
#: Surname similarity from which two names may be linked.
SIMILAR = 0.88


def tokens(name: Column | str) -> Column:
    """Runs of ASCII letters, lower case."""
    x = F.col(name) if isinstance(name, str) else name
    return F.transform(F.regexp_extract_all(x, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)


def parsed(tok: Column) -> Column:
    """struct<surname, given array, suffix> of a token array; a lone suffix is its own surname."""
    n = F.size(tok)
    suffix = (n > 1) & F.try_element_at(tok, F.lit(-1)).isin(SUFFIXES)
    core = F.when(suffix, F.slice(tok, 1, n - 1)).otherwise(tok)
    return F.struct(
        F.coalesce(F.try_element_at(core, F.lit(-1)), F.lit("")).alias("surname"),
        F.when(F.size(core) > 1, F.slice(core, 1, F.size(core) - 1)).otherwise(F.array().cast("array<string>")).alias("given"),
        F.when(suffix, F.try_element_at(tok, F.lit(-1))).alias("suffix"),
    )


def name_parts(name: Column | str) -> Column:
    """struct of what linking and scoring need, computed once a record.

    first_initial and middle_initial are null where absent; information = 3 x whole given names + 2 x middle names +
    one for a suffix + the number of tokens.
    """
    tok = tokens(name)
    p = parsed(tok)
    given = p["given"]
    full = F.size(F.filter(given, lambda g: F.length(g) > 1))
    middles = F.greatest(F.size(given) - 1, F.lit(0))
    first = F.try_element_at(given, F.lit(1))
    return F.struct(
        p["surname"].alias("surname"),
        first.alias("first_token"),
        F.substring(first, 1, 1).alias("first_initial"),
        F.substring(F.try_element_at(given, F.lit(2)), 1, 1).alias("middle_initial"),
        p["suffix"].alias("suffix"),
        F.size(tok).alias("n_tokens"),
        (3 * full + 2 * middles + F.when(p["suffix"].isNotNull(), 1).otherwise(0) + F.size(tok)).alias("information"),
    )


def person_sort_key(name: Column | str) -> Column:
    """struct<surname, given> to sort people by; a suffix counts among the given names."""
    tok = tokens(name)
    p = parsed(tok)
    given = F.concat_ws(" ", F.concat(p["given"], F.when(p["suffix"].isNotNull(), F.array(p["suffix"])).otherwise(F.array().cast("array<string>"))))
    return F.struct(p["surname"].alias("surname"), given.alias("given"))


@F.pandas_udf(DoubleType())
def surname_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 if equal, 0 if either is shorter than four letters, else the Ratcliff-Obershelp ratio, ``a`` first."""
    return pd.Series([1.0 if x == y else 0.0 if len(x) < 4 or len(y) < 4 else SequenceMatcher(a=x, b=y, autojunk=True).ratio() for x, y in zip(a, b)], dtype=float)


@lru_cache(100_000)
def _letters(word: str) -> Counter:
    return Counter(word)


@F.pandas_udf(BooleanType())
def surnames_similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether :func:`surname_similarity` reaches SIMILAR; most pairs are settled by the letters they have in common at all."""

    def similar(x: str, y: str) -> bool:
        if x == y:
            return True
        if min(len(x), len(y)) < 4 or 2 * (_letters(x) & _letters(y)).total() < SIMILAR * (len(x) + len(y)):
            return False
        return SequenceMatcher(a=x, b=y, autojunk=True).ratio() >= SIMILAR

    return pd.Series([similar(x, y) for x, y in zip(a, b)], dtype=bool)


def could_be_similar(a: Column, b: Column) -> Column:
    """An upper bound of the ratio reaches SIMILAR: cheap enough to keep most pairs from the similarity itself."""
    la, lb = F.length(a), F.length(b)
    return (a == b) | ((la >= 4) & (lb >= 4) & (2 * F.least(la, lb) / (la + lb) >= SIMILAR))


def first_names_agree(a: Column, b: Column) -> Column:
    """Equal initials, and equal first names where both are spelt out."""
    x, y = a["first_token"], b["first_token"]
    return (a["first_initial"] == b["first_initial"]) & ((F.length(x) <= 1) | (F.length(y) <= 1) | (x == y))


def middles_conflict(a: Column, b: Column) -> Column:
    return F.coalesce(a["middle_initial"] != b["middle_initial"], F.lit(False))


def linked(a: Column, b: Column) -> Column:
    """Whether two parsed names whose surnames are similar are linked: shared period words can never change the outcome and are
    left out."""
    enough = (a["surname"] == b["surname"]) | (a["first_token"] == b["first_token"]) | (a["middle_initial"].isNotNull() & b["middle_initial"].isNotNull())
    return first_names_agree(a, b) & ~middles_conflict(a, b) & enough


# Why two names are linked.
SAME = "same surname and matching first name"
INITIALS = "same surname and compatible initials"
NEARLY = "similar surname and compatible initials"


def link_reason(a: Column, b: Column) -> Column:
    """Why two linked names are linked."""
    return F.when(a["surname"] != b["surname"], NEARLY).when(a["first_token"].eqNullSafe(b["first_token"]), SAME).otherwise(INITIALS)


def periods_overlap(a: Column | str, b: Column | str) -> Column:
    """Two period labels share a word."""
    words = lambda x: F.split(F.lower(F.col(x) if isinstance(x, str) else x), "[^0-9a-z]+")
    return F.coalesce(F.arrays_overlap(F.filter(words(a), lambda w: w != ""), F.filter(words(b), lambda w: w != "")), F.lit(False))
