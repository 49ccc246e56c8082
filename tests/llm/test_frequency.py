import random
from collections import Counter, defaultdict

import numpy as np

from vellumflow.llm import frequency
from vellumflow.llm.frequency import SuffixArray, checked_terms, evidence_ngrams, evidence_terms, normal_form


def test_suffix_array_against_sorting():
    rnd = random.Random(7)
    for _ in range(60):
        entries = [[0, *[rnd.randint(2, 4) for _ in range(rnd.randint(1, 6))], 1] for _ in range(rnd.randint(1, 12))]
        symbols = np.array([x for e in entries for x in e])
        remaining = np.array([len(e) - i for e in entries for i in range(len(e))])
        sa = SuffixArray(symbols, remaining)
        suffix = lambda i: tuple(symbols[i : i + remaining[i]])
        assert sa.order.tolist() == sorted(range(len(symbols)), key=lambda i: (suffix(i), i))
        for i in range(1, len(symbols)):
            a, b = suffix(sa.order[i - 1]), suffix(sa.order[i])
            assert sa.common[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


SCHEMA = "evidence_id long, people array<string>, places array<string>, term string, n_records int"


def rows(n, rnd):
    words = ["ann", "Ann", "BOB", "bob  lee", " ann  lee ", "éva", "éva", "", None, "  ", "x y z x y", "x y"]
    make = lambda: rnd.choice([None, [], [rnd.choice(words) for _ in range(rnd.randint(1, 5))]])
    return [(i if rnd.random() < 0.97 else None, make(), make(), "t", 1) for i in range(n)]


def brute(data, order):
    tf, df = Counter(), defaultdict(set)
    for i, people, places, *_ in data:
        if i is None:
            continue
        for field, lst in (("people", people), ("places", places)):
            for x in lst or []:
                t = normal_form(x) if x else ""
                if not t:
                    continue
                w = t.split(" ")
                for g in [t] if order == 0 else [" ".join(w[k : k + order]) for k in range(len(w) - order + 1)]:
                    tf[field, g] += 1
                    df[field, g].add(i)
    return {k: (tf[k], len(df[k])) for k in tf}


def test_terms_and_ngrams_against_counting(spark, monkeypatch):
    monkeypatch.setattr(frequency, "CHUNK_SYMBOLS", 50)
    data = rows(300, random.Random(8))
    df = spark.createDataFrame(data + data[:40], SCHEMA)
    got = {(r.field_name, r.term): (r.occurrences, r.n_records) for r in evidence_terms(df).collect()}
    assert got == brute(data, 0)
    grams = evidence_ngrams(df).collect()
    for n in (1, 2, 3):
        assert {(r.field_name, r.ngram): (r.occurrences, r.n_records) for r in grams if r.n_words == n} == brute(data, n)


def test_marks_mentions_and_empty(spark):
    data = [(i, ["Common"] * 2 if i < 5 else ["Twice"] if i < 7 else ["Once", " once"] if i == 7 else None, None, "t", 1) for i in range(300)]
    names = spark.createDataFrame([(1, "ONCE", 4, "t"), (1, "ONCE", 4, "t"), (2, "once ", None, "t"), (3, None, 2, "t")], "name_id long, name_string string, mentions int, term string")
    got = {r.term: (r.occurrences, r.n_records, r.mark, r.recorded_mentions) for r in checked_terms(spark.createDataFrame(data, SCHEMA), names).collect()}
    assert got == {"common": (10, 5, "common", None), "twice": (2, 2, "useful", None), "once": (2, 1, "rare", 4)}
    assert evidence_terms(spark.createDataFrame([], SCHEMA)).collect() == []
    long = spark.createDataFrame([(1, ["w " * 50_000], None, "t", 1)], SCHEMA)
    assert [(r.occurrences, r.n_records, len(r.term)) for r in evidence_terms(long).collect()] == [(1, 1, 99_999)]


def test_ngrams_of_every_length(spark, monkeypatch):
    monkeypatch.setattr(frequency, "CHUNK_SYMBOLS", 50)
    rnd = random.Random(9)
    data = [(i, [" ".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(2)], ["Keeper of the Ardenmoor Papers"], "t", 1) for i in range(60)]
    grams = evidence_ngrams(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r.n_words for r in grams} == set(range(1, 10))
    assert {(r.n_words, r.field_name, r.ngram): (r.occurrences, r.n_records) for r in grams} == {(n, *k): v for n in range(1, 10) for k, v in brute(data, n).items()}
    assert [r.mark for r in grams if r.n_words == 5 and r.field_name == "places"] == ["common"]
