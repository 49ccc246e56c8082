"""Scalar column functions on text, labels, lists and sizes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it: Unicode spaces and the four separators of ASCII.
SPACE = r"(?U)[\s\x{1c}-\x{1f}]"  # the flag holds for the rest of a pattern
#: Characters a spreadsheet's XML can't hold.
ILLEGAL_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
YEAR = r"\b(1[89][0-9]{2}|20[0-9]{2})\b"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_whitespace(x: Column | str) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c(x), SPACE + "+", " "))


#: Letters whose folded form is not their lower case, by the rules of Unicode: single letters, and those that become several.
_ODD = {chr(i): chr(i).casefold() for i in range(0x20000) if chr(i).casefold() != chr(i).lower() and not 0x13A0 <= i <= 0x13FF and not 0xAB70 <= i <= 0xABBF}
_ONE, _MANY = {k: v for k, v in _ODD.items() if len(v) == 1}, {k: v for k, v in _ODD.items() if len(v) > 1}


def casefold(x: Column | str) -> Column:
    """Full Unicode case folding: lower case, but for letters that fold otherwise (Cherokee, which folds upwards, stays lower)."""
    one = lambda t: F.translate(t, "".join(_ONE), "".join(_ONE.values()))
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in _MANY.items()))
    whole = F.aggregate(pairs, one(c(x)), lambda acc, p: F.replace(acc, p["k"], p["v"]))
    # The engine's lower case knows a sigma at the end of a word, so single letters are folded once more.
    plain = F.octet_length(c(x)) == F.length(c(x))
    return F.when(plain, F.lower(c(x))).when(c(x).rlike("[" + "".join(_MANY) + "]"), one(F.lower(whole))).otherwise(one(F.lower(one(c(x)))))


def normalize_question(x: Column | str) -> Column:
    """The key a question is known by."""
    return casefold(normalize_whitespace(x))


def slugify(x: Column | str) -> Column:
    """Lower case, everything else as single hyphens; 'project' if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "project").otherwise(slug)


def truncate_text(x: Column | str, limit: int = 105) -> Column:
    """White space collapsed; a longer text cut to ``limit`` with three points."""
    clean = normalize_whitespace(x)
    return F.when(F.length(clean) > limit, F.concat(F.rtrim(F.substring(clean, 1, limit - 3)), F.lit("..."))).otherwise(clean)


def excel_safe(x: Column | str) -> Column:
    return F.regexp_replace(c(x), ILLEGAL_XML, "")


def coerce_json_list(x: Column | str) -> Column:
    """Non-empty strings of a JSON list of strings; an empty list for null, bad JSON and anything else."""
    parsed = F.from_json(c(x), "array<string>")
    return F.coalesce(F.filter(parsed, lambda e: e.isNotNull() & (e != "")), F.array().cast("array<string>"))


def display_list(x: Column | str) -> Column:
    return F.array_join(F.filter(c(x), lambda e: e.isNotNull() & (e != "")), "; ")


def sort_year(values: Column | str, text: Column | str) -> Column:
    """Least year of 1800-2099 in the values and the text; null if there is none."""
    joined = F.concat_ws(" ", F.concat_ws(" ", c(values)), c(text))
    return F.array_min(F.transform(F.regexp_extract_all(joined, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int")))


def page_label(start: Column | str, end: Column | str) -> Column:
    a, b = c(start), c(end)
    return (
        F.when(a.isNull() | (a < 1), "Pages unknown")
        .when(b > a, F.concat(F.lit("Pages "), a.cast("string"), F.lit("-"), b.cast("string")))
        .otherwise(F.concat(F.lit("Page "), a.cast("string")))
    )


def page_href(href: Column | str, start: Column | str) -> Column:
    h, a = c(href), c(start)
    return F.when(a.isNull() | (a < 1), h).otherwise(F.concat(h, F.lit("#page="), a.cast("string")))


def key_person(people: Column | str) -> Column:
    return F.coalesce(F.try_element_at(c(people), F.lit(1)), F.lit("No named person"))


def pluralize(n: Column, singular: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, singular).otherwise(singular + "s"))


def errors_label(failures: Column | str, unanalyzed: Column | str) -> Column:
    """'2 failures, 1 unanalyzed', or 'none'."""
    f, u = c(failures), c(unanalyzed)
    said = F.concat_ws(", ", F.when(f > 0, pluralize(f, "failure")), F.when(u > 0, pluralize(u, "unanalyzed")))
    return F.when(said == "", "none").otherwise(said)


def human_size(n: Column | str) -> Column:
    """Bytes in the first of B, KB, MB, GB that keeps the number under 1024, with one decimal; halves go to the even digit."""
    b = c(n).cast("double")
    shown = lambda x, unit: F.format_string(f"%.1f {unit}", F.bround(x, 1))
    return F.when(b < 1024, shown(b, "B")).when(b < 1024**2, shown(b / 1024, "KB")).when(b < 1024**3, shown(b / 1024**2, "MB")).otherwise(shown(b / 1024**3, "GB"))


def thousands(n: Column | str) -> Column:
    return F.format_number(c(n), 0)


def price(n: Column | str) -> Column:
    """Dollars with two decimals, '?' where unknown."""
    return F.when(c(n).isNull(), "?").otherwise(F.format_string("$%.2f", c(n)))


def limit(n: Column | str) -> Column:
    """A number with thousands apart, '?' for none and 0."""
    return F.when(F.coalesce(c(n), F.lit(0)) == 0, "?").otherwise(thousands(n))


def document_anchor(name: Column | str, sha: Column | str) -> Column:
    return F.concat(F.lit("document-"), slugify(name), F.lit("-"), F.substring(c(sha), 1, 8))


def person_anchor(name: Column | str) -> Column:
    return F.concat(F.lit("person-"), slugify(name))


def strip(x: Column | str) -> Column:
    """White space of any kind cut off at both ends."""
    return F.regexp_replace(c(x), rf"{SPACE}+$|^{SPACE[4:]}+", "")


def ordered_distinct(x: Column | str) -> Column:
    """First occurrences, trimmed, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.filter(c(x), lambda e: e.isNotNull()), strip), lambda e: e != ""))
