import pytest

from vellumflow.operators.moments import normalise_moments, readings, resolve_entry

CASES = [
    ("2014-05-06T08:15:00Z", None, None, "2014-05-06T08:15:00.000000Z"),
    ("Wed, 25 May 2022 16:20:22 +0530", None, None, "2022-05-25T10:50:22.000000Z"),
    ("020651U AUG 22", None, None, "2022-08-02T14:51:00.000000Z"),
    ("082044Z NOV 09", None, None, "2009-11-08T20:44:00.000000Z"),
    ("1270408999800", None, None, "2010-04-04T19:23:19.800000Z"),
    ("1596636169", None, None, "2020-08-05T14:02:49.000000Z"),
    ("2018-188T23:51:15", "Asia/Tokyo", None, "2018-07-07T14:51:15.000000Z"),
    ("Tue Aug  7 12:41:03 2012", "America/New_York", None, "2012-08-07T16:41:03.000000Z"),
    ("22/06/12 08:43", "Europe/Berlin", "DMY", "2012-06-22T06:43:00.000000Z"),
    ("04/22/13 6:32 p.m.", "America/New_York", "MDY", "2013-04-22T22:32:00.000000Z"),
    ("17. März 2015, 8:05 Uhr", "Europe/Berlin", None, "2015-03-17T07:05:00.000000Z"),
    ("17 juillet 2020 à 15h49 CET", None, None, "2020-07-17T14:49:00.000000Z"),
    ("17 Mar 2021, 0859 hrs UTC+3", None, None, "2021-03-17T05:59:00.000000Z"),
    ("August 22, 2018, noon", "America/Phoenix", None, "2018-08-22T19:00:00.000000Z"),
    ("Sep. 5, 2021 12:06 am", "America/Phoenix", None, "2021-09-05T07:06:00.000000Z"),
    ("2024-01-20T23:41:22,987654321 GMT-4", None, None, "2024-01-21T03:41:22.987654Z"),
    ("2020-01-02T03:04:05." + "123456" * 40 + "Z", None, None, "2020-01-02T03:04:05.123456Z"),
    ("\xa02016-12-05 11:18:30 [America/New_York] ", None, None, "2016-12-05T16:18:30.000000Z"),
    ("2017-11-05 01:02:02", "America/New_York", None, "2017-11-05T05:02:02.000000Z"),
]


@pytest.mark.parametrize("entry,tz,order,want", CASES)
def test_forms(entry, tz, order, want):
    assert resolve_entry(entry, tz, order)[::2] == ("resolved", want)


@pytest.mark.parametrize(
    "entry,tz,order,status",
    [
        ("2019-03-10 02:30", "America/New_York", None, "nonexistent"),
        ("2012-13-26T07:29:00Z", None, None, "impossible"),
        ("2009-02-31 10:32Z", None, None, "impossible"),
        ("2018-11-24 08:43:40", None, None, "no_zone"),
        ("13/13/2020 10:00", "Europe/Paris", "DMY", "impossible"),
        ("05/11/2020 10:00", "Europe/Paris", None, "ambiguous"),
        ("13:05 pm", "Europe/Paris", None, "no_moment"),
        ("10/20/2017 13:22 p.m.", "Europe/Paris", "MDY", "impossible"),
        ("22:35 on an unknown day", None, None, "no_moment"),
        ("July 24-26, 1969", None, None, "no_moment"),
        ("x" * 100_000, None, None, "no_moment"),
        ("", None, None, "no_moment"),
        (None, None, None, "no_moment"),
    ],
)
def test_reasons(entry, tz, order, status):
    assert resolve_entry(entry, tz, order)[0] == status


def test_mixture_settles_undeclared_sources_and_keeps_ties_open(spark):
    ana = "analysis_id long, site_code string, dates array<string>, pos int"
    a = [(1, "A", ["25/01/2020 10:00"] * 40 + ["03/04/2020 10:00"], 0), (2, "B", ["03/04/2020 10:00"], 0), (3, "C", ["03/04/2020 10:00"], 0), (4, None, None, 0), (2, "B", ["03/04/2020 10:00"], 1)]
    evidence = spark.createDataFrame([(9, 1, ["04/05/2020 10:00", None], "x"), (9, 1, ["04/05/2020 10:00", None], "x"), (10, None, [], "x"), (11, 4, ["2020-01-01 10:00"], "x")], "evidence_id long, analysis_id long, dates array<string>, entry string")
    sites = spark.createDataFrame([("A", "UTC", None), ("B", "UTC", None), ("C", "UTC", "MDY")], "site_code string, tz_name string, date_order string")
    rows = normalise_moments(evidence, spark.createDataFrame(a, ana), sites).collect()
    got = {(r.record_kind, r.record_id, r.pos): (r.status, r.instant_utc) for r in rows}
    assert len(rows) == len(got)
    assert got[("analysis", 1, 40)] == ("resolved", "2020-04-03T10:00:00.000000Z")
    assert got[("evidence", 9, 0)] == ("resolved", "2020-05-04T10:00:00.000000Z")
    assert got[("evidence", 9, 1)][0] == "no_moment"
    assert got[("analysis", 2, 0)][0] == "ambiguous"
    assert got[("analysis", 3, 0)] == ("resolved", "2020-03-04T10:00:00.000000Z")
    assert got[("evidence", 11, 0)][0] == "no_zone"
    assert normalise_moments(evidence.limit(0), spark.createDataFrame([], ana), sites).collect() == []


def table(spark, entries, site="A", declared=None):
    """normalise_moments of analyses of one site, each with one entry."""
    analyses = spark.createDataFrame([(i, site, [e]) for i, e in enumerate(entries)], "analysis_id long, site_code string, dates array<string>")
    evidence = spark.createDataFrame([], "evidence_id long, analysis_id long, dates array<string>")
    sites = spark.createDataFrame([("A", "America/New_York", declared)], "site_code string, tz_name string, date_order string")
    return {r.record_id: r for r in normalise_moments(evidence, analyses, sites).collect()}


def test_the_mixture_alone_decides_an_undeclared_source(spark):
    """The same entry is read one way, the other way or not at all, by nothing but its source's other values; an impossible
    date of an undeclared source is read the way it is possible."""
    doubtful = "03/04/2020 10:00"
    assert table(spark, [doubtful, *["25/01/2020 10:00"] * 60])[0].instant_utc == "2020-04-03T14:00:00.000000Z"
    assert table(spark, [doubtful, *["01/25/2020 10:00"] * 60])[0].instant_utc == "2020-03-04T15:00:00.000000Z"
    even = table(spark, [doubtful, *["01/25/2020 10:00", "25/01/2020 10:00"] * 30])
    assert even[0].status == "ambiguous" and len(even[0].alternatives) == 2 and abs(even[0].posterior - 0.5) < 0.02
    assert even[1].status == even[2].status == "resolved" and even[1].instant_utc == even[2].instant_utc
    declared = table(spark, [doubtful, *["25/01/2020 10:00"] * 60], declared="MDY")
    assert declared[0].instant_utc == "2020-03-04T15:00:00.000000Z" and declared[1].status == "impossible"


def test_what_is_taken_for_granted_is_marked(spark):
    got = table(spark, ["2020-11-01 01:30", "2020-07-01 10:00 CST", "01.02.65 10:00", "2020-11-01 03:30"])
    assert got[0].instant_utc == "2020-11-01T05:30:00.000000Z" and got[0].alternatives == ["2020-11-01T06:30:00.000000Z hour:second"]
    assert got[1].instant_utc == "2020-07-01T16:00:00.000000Z" and got[1].alternatives == ["2020-07-01T02:00:00.000000Z zone:CST+480"]
    assert got[2].instant_utc.startswith("2065") and got[2].alternatives == ["1965-02-01T15:00:00.000000Z century:19"]
    assert got[3].alternatives == [] and got[3].posterior == 1.0 > got[0].posterior > 0.95


def test_readings():
    assert readings("x", None) == (None, []) == readings(None, None)
    assert [r[0] for r in readings("03/04/20 10:00", "UTC")[1]] == [("order:mdy", "century:20"), ("order:mdy", "century:19"), ("order:dmy", "century:20"), ("order:dmy", "century:19")]
    assert readings("5 Smarch 2020 10:00", "UTC") == (None, [])
