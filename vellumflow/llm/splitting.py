"""Oversized items cut into consecutive pieces under a limit, at natural boundaries where there are any."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.plans.tables import drop_repeats

#: Bytes an upload candidate may have.
LIMIT = 50_000_000
#: Units (pages) consecutive pieces have in common.
OVERLAP = 1

PIECE = "piece_no int, first_unit long, last_unit long, piece_bytes long, cut_at string"


def cut_points(sizes: np.ndarray, boundaries: np.ndarray, limit: float, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces (first, last, cut) of units 0..n-1 with ``sizes``; ``boundaries`` are the sorted units a section begins at.

    Prefix sums give the farthest end under the limit by binary search, and a binary search of the boundaries the last one
    up to there; the piece ends before it ('boundary'). With no boundary past the overlap it ends at the limit ('hard'); a
    single unit above the limit is a piece of its own ('oversized'). The next piece begins ``overlap`` units before the cut,
    or fewer where it would otherwise not get further. The last piece is 'end'.
    """
    n, sums = len(sizes), np.concatenate(([0.0], np.cumsum(sizes, dtype=np.float64)))
    pieces, start, done = [], 0, 0  # units before ``done`` are covered
    while done < n:
        end = int(np.searchsorted(sums, sums[start] + limit, side="right")) - 1  # units start..end-1 fit
        while end <= done and start < done:  # the overlap alone leaves no room for a new unit
            start += 1
            end = int(np.searchsorted(sums, sums[start] + limit, side="right")) - 1
        if end >= n:
            pieces.append((start, n - 1, "end"))
            break
        if end <= start:
            pieces.append((start, start, "oversized"))
            done = start + 1
        else:
            at = int(np.searchsorted(boundaries, end, side="right")) - 1
            cut = int(boundaries[at]) if at >= 0 else 0
            natural = cut > done
            done = cut if natural else end
            pieces.append((start, done - 1, "boundary" if natural else "hard"))
        start = max(done - overlap, start + 1)
    return pieces


def split_oversized(items: DataFrame, units: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every item above ``limit``: (item_id, item_bytes, piece_no, first_unit, last_unit, piece_bytes, cut_at).

    ``items``: item_id, parent_id, lo, hi (bounds within the parent, inclusive, either may be null), stated (bytes, null or
    not positive where unknown), parent_units (null where unknown). ``units``: parent_id, unit_no, unit_bytes, begins (bool:
    a section begins on it). Ids must be unique, and (parent_id, unit_no) too.

    An item's size is what it states, else the bytes of its parent's units between its bounds, a missing bound being the
    parent's first or last unit. Where the stated size differs from the sum of the units, each unit takes its share of
    the stated size. Units without a row have the size of an even share of what is stated; where nothing at all is known
    about the units the item is one piece with cut_at 'no_units' and null bounds. Negative and null unit sizes count as 0.

    The unit list of a parent is gathered once, only for parents that an item above the limit or of unknown size needs,
    and is as long as one document. Equal requests (same parent, bounds and size) are cut once and shared by their items,
    so a parent that a third of all items belong to is neither joined nor cut once an item.
    """
    stated = F.when(F.col("stated") > 0, F.col("stated").cast("long"))
    asked = items.select("item_id", "parent_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), stated.alias("stated"), F.col("parent_units").cast("long").alias("parent_units"))
    asked = asked.where(F.col("item_id").isNotNull() & (F.col("stated").isNull() | (F.col("stated") > limit)))
    # Nulls compare equal only under eqNullSafe; a request is therefore known by its parts written out.
    request = F.sha2(F.to_json(F.struct("parent_id", "lo", "hi", "stated", "parent_units"), {"ignoreNullFields": "false"}), 256)
    asked = asked.withColumn("_request", request)
    requests = asked.groupBy("_request").agg(*(F.first(c).alias(c) for c in ("parent_id", "lo", "hi", "stated", "parent_units")))
    needed = requests.select("parent_id").distinct()
    lists = (
        units.join(needed, "parent_id", "left_semi")
        .groupBy("parent_id")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("unit_no").cast("long").alias("n"), F.greatest(F.coalesce(F.col("unit_bytes").cast("long"), F.lit(0)), F.lit(0)).alias("b"), F.coalesce("begins", F.lit(False)).alias("s")))).alias("_u"))
        .select("parent_id", F.col("_u.n").alias("_no"), F.col("_u.b").alias("_bytes"), F.col("_u.s").alias("_begins"))
    )
    with_units = requests.join(lists, "parent_id", "left")
    schema = f"_request string, item_bytes long, {PIECE}"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rows += _cut_request(r, limit, overlap)
            yield pd.DataFrame(rows, columns=["_request", "item_bytes", "piece_no", "first_unit", "last_unit", "piece_bytes", "cut_at"]).astype({"first_unit": "Int64", "last_unit": "Int64"})

    pieces = with_units.select("_request", "lo", "hi", "stated", "parent_units", "_no", "_bytes", "_begins").mapInPandas(cut, schema)
    return asked.select("item_id", "_request").join(pieces, "_request").drop("_request")


def _known(x: object) -> bool:
    return x is not None and x == x


def _cut_request(r, limit: int, overlap: int) -> list[tuple]:
    no = np.asarray(r[5] if r[5] is not None else [], dtype=np.int64)
    listed = np.asarray(r[6] if r[6] is not None else [], dtype=np.int64)
    begins = np.asarray(r[7] if r[7] is not None else [], dtype=bool)
    request, lo, hi, stated, parent_units = r[0], *(int(x) if _known(x) else None for x in (r[1], r[2], r[3], r[4]))
    first = lo if lo is not None else int(no[0]) if len(no) else 1
    last = hi if hi is not None else int(no[-1]) if len(no) else parent_units
    inside = (no >= first) & (no <= last) if last is not None else np.zeros(len(no), bool)
    no, listed, begins = no[inside], listed[inside], begins[inside]
    total = stated if stated is not None else int(listed.sum())
    if total <= limit:
        return []
    if last is None or last < first:
        return [(request, total, 0, None, None, total, "no_units")]
    sizes = np.full(last - first + 1, np.nan)
    sizes[no - first] = listed
    if np.isnan(sizes).all():
        sizes[:] = total / len(sizes)
    elif np.isnan(sizes).any():
        rest = max(0.0, total - float(np.nansum(sizes)))
        sizes[np.isnan(sizes)] = rest / np.isnan(sizes).sum()
    if stated is not None and sizes.sum() > 0:
        sizes *= stated / sizes.sum()
    elif sizes.sum() == 0:
        sizes[:] = total / len(sizes)
    sums = np.concatenate(([0.0], np.cumsum(sizes)))
    cuts = cut_points(sizes, np.sort(no[begins] - first), limit, overlap)
    return [(request, total, i, first + a, first + b, int(round(sums[b + 1] - sums[a])), how) for i, (a, b, how) in enumerate(cuts)]


def split_candidates(candidates: DataFrame, pages: DataFrame, documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Page ranges of the upload candidates above the limit, cut where a section begins.

    Columns: candidate_sha256, candidate_bytes, piece_no, start_page, end_page, piece_bytes, cut_at. Repeats of a candidate
    or a page count once; candidates within the limit give no row.
    """
    own = candidates.select("candidate_sha256", "document_sha256", "start_page", "end_page", "size_bytes").where("candidate_sha256 is not null")
    own = drop_repeats(own.where(f"size_bytes is null or size_bytes <= 0 or size_bytes > {int(limit)}"), ["candidate_sha256"])
    counts = documents.select("sha256", "page_count").where("page_count > 0").groupBy("sha256").agg(F.max("page_count").alias("parent_units"))
    items = own.join(counts, own.document_sha256 == counts.sha256, "left").select(
        F.col("candidate_sha256").alias("item_id"), F.col("document_sha256").alias("parent_id"), F.col("start_page").alias("lo"), F.col("end_page").alias("hi"), F.col("size_bytes").alias("stated"), "parent_units"
    )
    units = pages.where("document_sha256 is not null and page_no is not null").groupBy(F.col("document_sha256").alias("parent_id"), F.col("page_no").alias("unit_no")).agg(F.max("page_bytes").alias("unit_bytes"), F.max(F.col("heading").isNotNull()).alias("begins"))
    return split_oversized(items, units, limit, overlap).select(
        F.col("item_id").alias("candidate_sha256"), F.col("item_bytes").alias("candidate_bytes"), "piece_no", F.col("first_unit").alias("start_page"), F.col("last_unit").alias("end_page"), "piece_bytes", "cut_at"
    )


def oversized_candidates(candidates: DataFrame, pages: DataFrame, documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(candidate_sha256) of the candidates that had to be cut: those with a first piece."""
    return split_candidates(candidates, pages, documents, limit).where("piece_no = 0").select("candidate_sha256")
