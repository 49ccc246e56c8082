import random

from pyspark.sql import functions as F

from vellumflow.operators.intervals import merge_intervals, page_coverage


def brute(rows):
    covered = {}
    for e, lo, hi in rows:
        if e is None or lo is None or lo < 1:
            continue
        covered.setdefault(e, set()).update(range(lo, max(lo, hi if hi is not None else lo) + 1))
    out = set()
    for e, pages in covered.items():
        runs = []
        for p in sorted(pages):
            if runs and runs[-1][1] == p - 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        out |= {("period", e, a, b) for a, b in runs}
        out |= {("gap", e, x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])}
    return out


def test_matches_brute_force_over_many_shards(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([rnd.randint(-2, 200), rnd.randint(1, 40), None]), rnd.choice([None, rnd.randint(1, 220), rnd.randint(1, 60)])) for _ in range(400)]
    rows = [(e, lo, None if hi is None or (lo is not None and hi - lo > 60 and rnd.random() < 0.7) else hi) for e, lo, hi in rows]
    df = spark.createDataFrame(rows, "e long, lo int, hi int")
    for width in (1, 7, 16, 4096):
        got = [tuple(r) for r in merge_intervals(df, "e", F.col("lo"), F.col("hi"), shard_width=width).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(rows), width


def test_senseless_end_costs_shards_once(spark):
    df = spark.createDataFrame([(1, 5, 2**31 - 1)] * 50 + [(1, 1, 2)], "e long, lo int, hi int")
    got = {tuple(r) for r in merge_intervals(df, "e", F.col("lo"), F.col("hi"), shard_width=2**20).collect()}
    assert got == {("period", 1, 1, 2), ("gap", 1, 3, 4), ("period", 1, 5, 2**31 - 1)}


def test_pages_nulls_empty_and_clashing_columns(spark):
    schema = "analysis_id long, page_number int, page_start int, page_end int, first int, _lo string"
    rows = [(1, 9, None, 11, 0, "x"), (1, 3, 2, 1, 0, "x"), (1, None, None, 5, 0, "x"), (1, 0, None, 5, 0, "x"), (None, 1, 1, 1, 0, "x"), (1, 9, None, 11, 0, "x")]
    got = {tuple(r) for r in page_coverage(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("period", 1, 2, 2), ("gap", 1, 3, 8), ("period", 1, 9, 11)}
    assert page_coverage(spark.createDataFrame([], schema)).collect() == []
