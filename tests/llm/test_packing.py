import random
from collections import Counter, defaultdict

from vellumflow.llm.packing import pack, plan_containers


def test_plan_places_everything_and_wastes_little():
    rnd = random.Random(4)
    for capacity, n in ((1, 5), (2, 9), (10, 300), (100, 1000), (2048, 5000)):
        for _ in range(8):
            items = [min(capacity, 1 + int(rnd.expovariate(6 / capacity))) for _ in range(n)] + [rnd.randint(1, capacity) for _ in range(n // 3)]
            counts = Counter(items)
            plan = plan_containers(dict(counts), capacity)
            placed = Counter()
            for contents, count in plan:
                used = sum(s * k for s, k in contents)
                assert 0 < used <= capacity
                assert sum(k for s, k in contents if 3 * s > capacity) <= 2
                for s, k in contents:
                    placed[s] += k * count
            assert placed == counts
            bins, least = sum(c for _, c in plan), -(-sum(items) // capacity)
            halves = sum(2 * s > capacity for s in items)
            assert bins <= 1.12 * max(least, halves) + 1
    assert plan_containers({}, 10) == []


def test_pack_whole_items(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, 0, -3, 7, 7, 7, 7, rnd.randint(1, 40), rnd.randint(60, 200)]), "x") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, n int, piece_size string")
    got = pack(df, "id", "n", capacity=50, salts=3).collect()
    size = {i: max(0, n or 0) for i, n, _ in rows}
    by_id, room = defaultdict(list), Counter()
    for r in got:
        by_id[r.id].append(r)
        if r.container_id is not None:
            room[r.container_id] += r.piece_size
    assert by_id.keys() == size.keys()
    for i, pieces in by_id.items():
        pieces.sort(key=lambda r: r.piece_no)
        assert sum(r.piece_size for r in pieces) == size[i]
        assert len(pieces) == max(1, -(-size[i] // 50))
        assert [r.piece_start for r in pieces] == [50 * k for k in range(len(pieces))]
        assert (pieces[0].container_id is None) == (size[i] == 0)
    assert max(room.values()) <= 50 and set(room) == set(range(len(room)))
    assert sorted(map(tuple, got)) == sorted(map(tuple, pack(df.repartition(7), "id", "n", capacity=50, salts=3).collect()))


def test_pack_nothing(spark):
    empty = spark.createDataFrame([], "id long, n int")
    assert pack(empty, "id", "n").collect() == []
    assert [tuple(r) for r in pack(spark.createDataFrame([(1, 0)], "id long, n int"), "id", "n").collect()] == [(1, 0, 0, 0, None)]
