"""Filling fixed-capacity containers: large items matched in pairs, smaller ones best-fit into what is left."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.encoding import VOCABULARY, token_count
from vellumflow.plans.tables import cut_lineage, drop_repeats, spread

#: Tokens a container holds.
CAPACITY = 2048
#: Ways every size is split for numbering its items, so that a size a third of all items have is numbered by many tasks.
SALTS, MOST_SALTS = 64, 512


class _Bins:
    """Containers as classes: those with equal contents so far, kept by the room they have left."""

    def __init__(self) -> None:
        self.gaps: list[int] = []
        self.by_gap: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)

    def add(self, gap: int, contents: tuple[tuple[int, int], ...], count: int) -> None:
        if not self.by_gap[gap]:
            insort(self.gaps, gap)
        self.by_gap[gap].append((contents, count))

    def tightest(self, size: int) -> int | None:
        at = bisect_left(self.gaps, size)
        return self.gaps[at] if at < len(self.gaps) else None

    def take(self, gap: int) -> tuple[tuple[tuple[int, int], ...], int]:
        classes = self.by_gap[gap]
        contents, count = classes.pop()
        if not classes:
            del self.gaps[bisect_left(self.gaps, gap)]
        return contents, count


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Classes of containers, each (((size, how many), ...), number of such containers), holding ``counts`` items of each size.

    Sizes are whole numbers from 1 to ``capacity``, so this plan is made on at most ``capacity`` counts whatever the number
    of items, and each step settles all items or all containers of a kind at once.

    Items above a third of the capacity go first, at most two to a container: the largest still free takes the largest
    partner that fits beside it. Then the smaller ones, largest first, go to the container with the least room that still
    takes them; when none does, new containers are filled with that size alone and their rest is offered to what follows.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 1 <= s <= capacity for s in left):
        raise ValueError("a size outside 1..capacity")
    bins = _Bins()
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        if at < 0:
            bins.add(capacity - a, ((a, 1),), left[a])
            large.pop()
            continue
        b = large[at]
        if a == b:
            pairs, odd = divmod(left[a], 2)
            if pairs:
                bins.add(capacity - 2 * a, ((a, 2),), pairs)
            large.pop()
            left[a] = odd
            if odd:  # the last of its size: the next smaller one is its partner
                if large:
                    c = large[-1]
                    bins.add(capacity - a - c, ((a, 1), (c, 1)), 1)
                    left[c] -= 1
                    if not left[c]:
                        large.pop()
                else:
                    bins.add(capacity - a, ((a, 1),), 1)
            continue
        pairs = min(left[a], left[b])
        bins.add(capacity - a - b, ((a, 1), (b, 1)), pairs)
        for s in (a, b):
            left[s] -= pairs
            if not left[s]:
                large.remove(s)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            gap = bins.tightest(s)
            if gap is None:
                each = capacity // s
                full, rest = divmod(n, each)
                if full:
                    bins.add(capacity - each * s, ((s, each),), full)
                if rest:
                    bins.add(capacity - rest * s, ((s, rest),), 1)
                break
            contents, count = bins.take(gap)
            each = gap // s
            full = min(n // each, count)
            if full:
                bins.add(gap - each * s, (*contents, (s, each)), full)
                n -= full * each
            if full < count:  # fewer than ``each`` are left: they go to one more container
                if n:
                    bins.add(gap - n * s, (*contents, (s, n)), 1)
                bins_left = count - full - (1 if n else 0)
                n = 0
                if bins_left:
                    bins.add(gap, contents, bins_left)
    return [x for gap in bins.gaps for x in bins.by_gap[gap]]


def _slots(plan: Sequence[tuple[tuple[tuple[int, int], ...], int]]) -> pd.DataFrame:
    """Ranks of each size given to each class of containers: (size, first rank, each, first container), ranks from 0."""
    used: dict[int, int] = defaultdict(int)
    rows, container = [], 0
    for contents, count in plan:
        merged: dict[int, int] = defaultdict(int)
        for size, each in contents:
            merged[size] += each
        for size, each in merged.items():
            rows.append((size, used[size], each, container))
            used[size] += each * count
        container += count
    return pd.DataFrame(rows, columns=["size", "rank", "each", "container"]).sort_values(["size", "rank"], ignore_index=True)


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """Containers of all items: (key, piece_no, piece_start, piece_size, container_id).

    One row for each item; an item above the capacity, and only that, is cut into pieces of the capacity and a last one of
    the rest, one row each. Items of size 0 or null take no room: container_id null, piece_size 0. Containers are numbered
    from 0. ``key`` must be unique. The numbering follows the key, so the result is the same whatever the partitions are.

    Only the counts of sizes (at most ``capacity`` of them) reach the driver. Items are numbered within their size by
    salted windows and cumulated counts, then each finds its container by binary search in the plan, which is as bounded
    as the counts are.
    """
    spark = items.sparkSession
    # As many as there are partitions, so that a size a third of all items have is numbered by all of them.
    salts = salts or min(MOST_SALTS, max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    sized = items.select(F.col(key).alias("_key"), F.greatest(n, F.lit(0)).alias("_n"))
    last = F.greatest(F.ceil(F.col("_n") / capacity).cast("long"), F.lit(1)) - 1
    pieces = sized.select("_key", "_n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece_no"))
    start = F.col("piece_no") * capacity
    pieces = pieces.select("_key", "piece_no", start.alias("piece_start"), F.least(F.col("_n") - start, F.lit(capacity).cast("long")).alias("piece_size"))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("_key", "piece_no"), F.lit(salts)))

    blocks = pieces.where("piece_size > 0").groupBy("piece_size", "_salt").count().collect()  # at most capacity x salts rows
    per_size: dict[int, int] = defaultdict(int)
    offset = {}
    for r in sorted(blocks, key=lambda r: (r["piece_size"], r["_salt"])):
        offset[r["piece_size"], r["_salt"]] = per_size[r["piece_size"]]
        per_size[r["piece_size"]] += r["count"]
    slots = _slots(plan_containers(dict(per_size), capacity))
    offsets = np.zeros((capacity + 1, salts), dtype=np.int64)
    for (s, k), v in offset.items():
        offsets[s, k] = v
    shared = spark.sparkContext.broadcast((offsets, *(slots[c].to_numpy(np.int64) for c in ("size", "rank", "each", "container"))))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets, sizes, ranks, each, container = shared.value
        top = np.int64(1) << 40  # ranks of one size stay below this
        keys = sizes * top + ranks
        for pdf in batches:
            size, salt = pdf["piece_size"].to_numpy(np.int64), pdf["_salt"].to_numpy(np.int64)
            inside = size > 0
            rank = np.where(inside, offsets[size, salt] + pdf["_rank"].to_numpy(np.int64) - 1, 0)
            at = np.maximum(np.searchsorted(keys, size * top + rank, side="right") - 1, 0)
            found = pd.array(container[at] + (rank - ranks[at]) // each[at] if len(keys) else np.zeros(len(pdf), np.int64), dtype="Int64")
            found[~inside] = pd.NA
            yield pd.DataFrame({"_key": pdf["_key"], "piece_no": pdf["piece_no"], "piece_start": pdf["piece_start"], "piece_size": size, "container_id": found})

    from pyspark.sql import Window

    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("piece_size", "_salt").orderBy("_key", "piece_no")))
    schema = f"_key {dict(sized.dtypes)['_key']}, piece_no long, piece_start long, piece_size long, container_id long"
    return ranked.mapInPandas(place, schema).withColumnRenamed("_key", key)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """Containers of all texts, measured in tokens of a public vocabulary; repeats of a document count once.

    Texts are encoded once: their sizes are written to shared storage, from where both passes of :func:`pack` read.
    """
    once = drop_repeats(spread(documents.select("doc_id", "text").where("doc_id is not null")), ["doc_id"])
    return pack(cut_lineage(once.select("doc_id", token_count("text", path).alias("n_tokens"))), "doc_id", "n_tokens", capacity)
