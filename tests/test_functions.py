import random

import pytest
from pyspark.sql import functions as F

from vellumflow.functions import people, text
from vellumflow.functions.dates import best_date_label, extract_dates, time_period

BEST = [
    (["October 7, 1960"], "", (1960, 10, 7), "October 7, 1960", "October 7, 1960"),
    (["Sept. 3rd, 1960"], "", (1960, 9, 3), "Sept 3, 1960", "Sept 3, 1960"),
    (["JULY 1960"], "see 1959", (1959, 1, 1), "1959", "1959 -> July 1960"),
    (["late-1961", "mid 1959"], "", (1959, 6, 1), "mid 1959", "mid 1959 -> late 1961"),
    (["March"], "1960 budget", (1960, 3, 1), "March 1960", "March 1960"),
    (["7 October 1960"], "", (1960, 10, 1), "October 1960", "October 1960"),
    (["1960-10-07"], "", (1960, 1, 1), "1960", "1960"),
    (["10/7/1960"], "", (1960, 1, 1), "1960", "1960"),
    (["the 1960s"], "", (9999, 12, 31), "Undated", "Undated"),
    (["January 99, 1960"], "", (1960, 1, 99), "January 99, 1960", "January 99, 1960"),
    ([], "no date", (9999, 12, 31), "Undated", "Undated"),
    (None, None, (9999, 12, 31), "Undated", "Undated"),
    (["1959", "1961", "1960"], "", (1959, 1, 1), "1959", "1959 -> 1960"),
    (["May 5-6, 1960"], "", (1960, 1, 1), "1960", "1960"),
    (["Oct 1960", "October 1960"], "", (1960, 10, 1), "Oct 1960", "Oct 1960 -> October 1960"),
]


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first().y


def test_date_columns(spark):
    df = spark.createDataFrame([(v, f) for v, f, *_ in BEST], "v array<string>, f string")
    got = [tuple(r.b) for r in df.select(best_date_label("v", "f").alias("b")).collect()]
    assert got == [(*k, label, badge) for _, _, k, label, badge in BEST]
    assert [tuple(x) for x in one(spark, "In late 1961, May 1960", "string", extract_dates)] == [(1960, 5, 1, "May 1960"), (1961, 10, 1, "late 1961")]
    assert one(spark, None, "string", extract_dates) == []
    odd = "Sept. 5th, 1999 sep 1987 SEPTEMBER\xa03, 1990, LATE  1960; Mays 1999, é1999 x1999 19991 1899 1799 Oct 0 2000 march 99, 1900"
    assert [x.label for x in one(spark, odd, "string", extract_dates)] == ["Sept 5, 1999", "September 3, 1990", "Oct 0, 2000", "March 99, 1900", "Sep 1987", "late 1960", "1999", "1899"]
    assert one(spark, "May 1960 " * 50_000, "string", lambda x: F.size(extract_dates(x))) == 50_000
    assert one(spark, "a", "string", lambda x: time_period(x, F.lit("b"))) == "a to b"


SCALARS = [
    ("x" * 105, "string", text.truncate_text, "x" * 105),
    ("x" * 106, "string", text.truncate_text, "x" * 102 + "..."),
    ("a" * 101 + " " + "b" * 10, "string", text.truncate_text, "a" * 101 + "..."),
    ("Winter Study (1960)", "string", text.slugify, "winter-study-1960"),
    ("---", "string", text.slugify, "project"),
    ('["a",null,"","b"]', "string", text.coerce_json_list, ["a", "b"]),
    ("not json", "string", text.coerce_json_list, []),
    ('{"a":1}', "string", text.coerce_json_list, []),
    (None, "string", text.coerce_json_list, []),
    ("\x1c a\xa0 b\t", "string", text.normalize_whitespace, "a b"),
    ("\xa0 Ann ", "string", text.strip, "Ann"),
    ("a\x00b\x0bc\td", "string", text.excel_safe, "abc\td"),
    ("Straße", "string", text.casefold, "strasse"),
    (1536, "long", text.human_size, "1.5 KB"),
    (10, "long", text.human_size, "10.0 B"),
    (["", None, "a", "b"], "array<string>", text.display_list, "a; b"),
    ([" a", "b", "a ", None, " "], "array<string>", text.ordered_distinct, ["a", "b"]),
    ([], "array<string>", text.key_person, "No named person"),
    ("Gordon N. Thayer", "string", people.person_sort_key, ("thayer", "gordon n")),
    ("Lester R. Allen, Jr.", "string", people.person_sort_key, ("allen", "lester r jr")),
    ("Plato", "string", people.person_sort_key, ("plato", "")),
    ("—", "string", people.person_sort_key, ("", "")),
    ("John V", "string", people.person_sort_key, ("john", "v")),
]


@pytest.mark.parametrize("value,kind,f,want", SCALARS)
def test_scalars(spark, value, kind, f, want):
    got = one(spark, value, kind, f)
    assert (tuple(got) if isinstance(want, tuple) else got) == want


def test_pages_and_labels(spark):
    rows = [(12, None), (12, 14), (12, 12), (12, 9), (0, 3), (None, 3)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert [r.x for r in df.select(text.page_label("a", "b").alias("x")).collect()] == ["Page 12", "Pages 12-14", "Page 12", "Page 12", "Pages unknown", "Pages unknown"]
    assert [r.x for r in df.select(text.page_href(F.lit("h"), "a").alias("x")).collect()][-3:] == ["h#page=12", "h", "h"]
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (0, 3)], "f int, u int").select(text.errors_label("f", "u").alias("x")).collect()
    assert [r.x for r in labels] == ["none", "1 failure", "2 failures, 1 unanalyzed", "3 unanalyzeds"]


def test_surname_similarity(spark):
    pairs = [("schriever", "schreiver", 0.8889), ("jacobs", "jacob", 0.9091), ("thayer", "thayre", 0.8333), ("eeeeacbbc", "eeeeabcbc", 0.8889), ("eeeeabcbc", "eeeeacbbc", 0.7778), ("abc", "abd", 0.0), ("abc", "abc", 1.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    got = df.select(people.surname_similarity("a", "b").alias("s"), people.could_be_similar(F.col("a"), F.col("b")).alias("c")).collect()
    assert [round(r.s, 4) for r in got] == [s for *_, s in pairs]
    assert all(r.c for r in got if r.s >= 0.88)
    rnd = random.Random(5)
    more = [("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))), "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))) for _ in range(400)]
    for r in spark.createDataFrame(more, "a string, b string").select(people.surname_similarity("a", "b").alias("s"), people.could_be_similar(F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c or r.s < 0.88
