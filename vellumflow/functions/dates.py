"""Dates inside free text: what a text names, the earliest of it, and the labels a report shows. All stays in the JVM.

One scan from left to right takes at each place the longest way a date can be written there: month, day and year; month and
year; part of a year; a year alone. Every such date ends in its year, so its parts are read off from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in order, of which three letters (or 'sept') stand for the whole; and the month a part of a year counts as.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
VAGUE = {"early": 2, "mid": 6, "late": 10}
# What an undated row is called, and where it is sorted.
UNDATED = "Undated"
UNDATED_KEY = (9999, 12, 31)

_NAMED = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]}{'|t' if m == 'september' else ''})?" if m != "may" else m for m in MONTHS) + r")\.?"
_YEAR = "(?:1[89]|20)[0-9]{2}"
_S = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A date as one pattern, no letter or digit beside it; what stands before the year is optional from the left.
SCAN = rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{_NAMED}{_S}+(?:[0-9]{{1,2}}(?:st|nd|rd|th)?,?{_S}+)?{_YEAR}|(?:{'|'.join(VAGUE)})(?:{_S}|-)+{_YEAR}|{_YEAR})(?![\p{{L}}\p{{N}}_])"


_KEY = ("y", "m", "d")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _dated(found: Column, place: Column) -> Column:
    """struct<kind, place, y, m, d, label> of one match of SCAN; kinds 0 to 3 from the most specific."""
    year = F.right(found, F.lit(4))

    def parts(p: Column) -> Column:
        word, day = p["word"], p["day"]
        vague = F.coalesce(*(F.when(word == w, F.lit(m)) for w, m in VAGUE.items()))
        month = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.substring(word, 1, 3)).cast("int")
        kind = F.when(word == "", 3).when(vague.isNotNull(), 2).when(day == "", 1).otherwise(0)
        of_day = F.when(day == "", 1).otherwise(day.cast("int"))
        named = F.concat_ws(" ", F.when(kind == 2, word).when(kind < 2, F.initcap(word)), F.when(kind == 0, F.concat(of_day.cast("string"), F.lit(","))), year)
        return F.struct(kind.alias("kind"), place.alias("place"), year.cast("int").alias("y"), F.when(kind == 3, 1).when(kind == 2, vague).otherwise(month).alias("m"), of_day.alias("d"), named.alias("label"))

    return _let(F.struct(F.lower(F.regexp_extract(found, "^[A-Za-z]*", 0)).alias("word"), F.regexp_extract(found, "^[^0-9]+([0-9]{1,2})[^0-9]", 1).alias("day")), parts)


def _scanned(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(SCAN), F.lit(0)), _dated)


def extract_dates(text: Column | str) -> Column:
    """array<struct<y, m, d, label>> of the dates in a text, the most specific kind first, each kind in the text's order; days
    are not checked, parts of a year count as a month of theirs. Empty for null."""
    found = F.sort_array(_scanned(F.col(text) if isinstance(text, str) else text))
    return F.coalesce(F.transform(found, lambda x: F.struct(*(x[k].alias(k) for k in (*_KEY, "label")))), F.array().cast("array<struct<y:int,m:int,d:int,label:string>>"))


def best_date_label(values: Column | str, fallback: Column | str) -> Column:
    """struct<y, m, d, date_label, date_badge_label> of the earliest date in a list of strings and a text, read on as one.

    The badge names the two earliest different dates; equal days are in order of their labels.
    """
    v, f = (F.col(x) if isinstance(x, str) else x for x in (values, fallback))
    text = F.concat_ws(" ", F.filter(v, lambda x: x != ""), F.coalesce(f, F.lit("")))
    order = lambda x: F.struct(*(x[k].alias(k) for k in _KEY), F.lower(x["label"]).alias("folded"), x["label"].alias("label"))
    dates = F.slice(F.sort_array(F.array_distinct(F.transform(_scanned(text), order))), 1, 2)

    def shown(two: Column) -> Column:
        none = F.size(two) == 0
        keys = [F.when(none, u).otherwise(two[0][k]).alias(k) for k, u in zip(_KEY, UNDATED_KEY)]
        badge = F.array_join(F.transform(two, lambda x: x["label"]), " -> ")
        return F.struct(*keys, F.when(none, UNDATED).otherwise(two[0]["label"]).alias("date_label"), F.when(none, UNDATED).otherwise(badge).alias("date_badge_label"))

    return _let(dates, shown)


def time_period(first: Column | str, last: Column | str) -> Column:
    """'a', 'a to b', or 'Undated' for the labels of the first and last mention."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (first, last))
    return F.when(a.isNull(), UNDATED).when(a == b, a).otherwise(F.concat(a, F.lit(" to "), b))
