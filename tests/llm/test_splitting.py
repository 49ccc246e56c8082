import random

import numpy as np

from vellumflow.llm.splitting import cut_points, split_candidates


def brute(sizes, boundaries, limit, overlap):
    """The same rules by stepping one unit at a time."""
    n, pieces, start, done = len(sizes), [], 0, 0
    fits = lambda a, b: sum(sizes[a:b]) <= limit
    while done < n:
        def reach(a):
            e = a
            while e < n and fits(a, e + 1):
                e += 1
            return e

        end = reach(start)
        while end <= done and start < done:
            start += 1
            end = reach(start)
        if end >= n:
            pieces.append((start, n - 1, "end"))
            break
        if end <= start:
            pieces.append((start, start, "oversized"))
            done = start + 1
        else:
            cuts = [b for b in boundaries if done < b <= end]
            done = max(cuts) if cuts else end
            pieces.append((start, done - 1, "boundary" if cuts else "hard"))
        start = max(done - overlap, start + 1)
    return pieces


def test_cut_points_like_brute_force():
    rnd = random.Random(6)
    for _ in range(500):
        n = rnd.randint(1, 40)
        sizes = [rnd.choice([0, 1, 3, 5, 9, 14, 30]) for _ in range(n)]
        bounds = sorted(rnd.sample(range(n), rnd.randint(0, n // 3)))
        limit, overlap = rnd.choice([10, 20, 25]), rnd.randint(0, 3)
        got = cut_points(np.array(sizes), np.array(bounds, dtype=np.int64), limit, overlap)
        assert got == brute(sizes, bounds, limit, overlap)
        covered = set()
        for a, b, how in got:
            covered.update(range(a, b + 1))
            assert sum(sizes[a : b + 1]) <= limit or how == "oversized" and a == b
        assert covered == set(range(n))


C = "candidate_sha256 string, document_sha256 string, start_page int, end_page int, size_bytes long, piece_no int"
P = "document_sha256 string, page_no int, page_bytes long, heading string"
D = "sha256 string, page_count int, lo int"


def test_candidates(spark):
    pages = [("d", p, 10, "S" if p in (4, 8) else None) for p in range(1, 11)] + [("d", 3, 10, None), ("e", 1, None, None), ("e", 2, -5, None)]
    cands = [
        ("whole", "d", None, None, 100, 0),
        ("whole", "d", None, None, 100, 0),
        ("sum", "d", 2, None, 0, 0),
        ("small", "d", 1, 2, None, 0),
        ("stated", "d", 1, 2, 35, 0),
        ("even", "f", None, None, 90, 0),
        ("nothing", "g", None, None, 90, 0),
        ("unknown", "e", None, None, -1, 0),
        ("nodoc", None, 5, 4, 80, 0),
        ("fits", "d", 1, 9, 35, 0),
    ]
    docs = [("d", 12, 0), ("f", 9, 0)]
    df = split_candidates(spark.createDataFrame(cands, C), spark.createDataFrame(pages, P), spark.createDataFrame(docs, D), limit=35, overlap=1)
    got = {}
    for r in sorted(df.collect(), key=lambda r: r.piece_no):
        got.setdefault(r.candidate_sha256, []).append((r.start_page, r.end_page, r.piece_bytes, r.cut_at))
    assert got["whole"] == [(1, 3, 30, "boundary"), (3, 5, 30, "hard"), (5, 7, 30, "boundary"), (7, 9, 30, "hard"), (9, 10, 20, "end")]
    assert got["sum"][0] == (2, 3, 20, "boundary")
    assert len(got["even"]) == 4 and got["even"][0] == (1, 3, 30, "hard")
    assert got["nothing"] == [(None, None, 90, "no_units")] and got["nodoc"] == [(None, None, 80, "no_units")]
    assert set(got) == {"whole", "sum", "even", "nothing", "nodoc"}
    assert split_candidates(spark.createDataFrame([], C), spark.createDataFrame([], P), spark.createDataFrame([], D)).collect() == []
