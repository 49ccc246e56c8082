"""Overlapping and gapped intervals: continuous covered periods of an entity and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of one shard. A shard of an entity never holds more than this many different starts, so no task
#: of the local merge grows with the rows of an entity.
SHARD_WIDTH = 4096


def page_span(start: str = "page_start", legacy: str = "page_number", end: str = "page_end") -> tuple[Column, Column]:
    """First and last page a row covers: the start falls back to the legacy column, an end not beyond it means one page."""
    first = F.coalesce(F.col(start), F.col(legacy)).cast("long")
    return first, F.greatest(first, F.coalesce(F.col(end).cast("long"), first))


def _merge(by: list[str], lo: str, hi: str) -> list[Column]:
    """Window columns that number the runs of touching or overlapping intervals of ``by``."""
    order = Window.partitionBy(*by).orderBy(lo, hi)
    return [F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_reach")]


def merge_intervals(df: DataFrame, entity: str, lo: Column, hi: Column, shard_width: int = SHARD_WIDTH, least: int = 1) -> DataFrame:
    """Covered periods and gaps of every entity: rows (span_kind, entity, first, last), all distinct.

    Two levels, so that an entity holding a third of all rows is spread out:

    1. equal starts are reduced to their farthest end before anything is shuffled by entity; each interval is clipped to
       shards of ``shard_width`` positions (an interval over many shards gives its two ends and one run of whole shards;
       runs are merged per entity before they are spelt out, so a senseless end costs shards once, not once a row);
       each (entity, shard) is merged on its own;
    2. only the first and last piece of a shard go on to be stitched per entity: pieces touching across a boundary
       are coalesced, and gaps that cross a boundary are read off. Pieces and gaps inside a shard are already final.

    Rows without entity or without a start of at least ``least`` cover nothing; an end before the start counts as the
    start; repeated rows change nothing; an empty table gives an empty result; other columns are ignored.
    """
    rows = (
        df.select(F.col(entity).alias("_e"), lo.cast("long").alias("_lo"), hi.cast("long").alias("_hi"))
        .where(F.col("_e").isNotNull() & (F.col("_lo") >= least))
        .withColumn("_hi", F.greatest("_lo", F.coalesce("_hi", "_lo")))
        .groupBy("_e", "_lo")
        .agg(F.max("_hi").alias("_hi"))
        .select("_e", "_lo", "_hi", F.floor(F.col("_lo") / shard_width).alias("_a"), F.floor(F.col("_hi") / shard_width).alias("_b"))
    )
    piece = lambda k, a, b: F.struct(k.cast("long").alias("_k"), a.cast("long").alias("_lo"), b.cast("long").alias("_hi"))
    a, b, width = F.col("_a"), F.col("_b"), F.lit(shard_width)
    ends = F.when(a == b, F.array(piece(a, F.col("_lo"), F.col("_hi")))).otherwise(
        F.array(piece(a, F.col("_lo"), (a + 1) * width - 1), piece(b, b * width, F.col("_hi")))
    )
    clipped = rows.select("_e", F.explode(ends).alias("_p")).select("_e", "_p.*")
    runs = rows.where(b - a > 1).groupBy("_e", (a + 1).alias("_from")).agg(F.max(b - 1).alias("_to"))
    runs = runs.select("*", *_merge(["_e"], "_from", "_to"))
    # What an earlier run reaches is already spelt out there.
    runs = runs.withColumn("_from", F.greatest("_from", F.coalesce(F.col("_reach") + 1, F.col("_from")))).where("_from <= _to")
    whole = runs.select("_e", F.explode(F.sequence("_from", "_to")).alias("_k")).select("_e", "_k", (F.col("_k") * width).alias("_lo"), ((F.col("_k") + 1) * width - 1).alias("_hi"))

    local = _coalesced(clipped.unionByName(whole), ["_e", "_k"])
    shard = Window.partitionBy("_e", "_k").orderBy("_lo")
    local = local.withColumn("_next", F.lead("_lo").over(shard)).withColumn("_prev", F.lag("_lo").over(shard))
    outer = F.col("_next").isNull() | F.col("_prev").isNull()
    row = lambda kind, x, y: F.struct(F.lit(kind).alias("_kind"), x.alias("_lo"), y.alias("_hi"))
    said = local.select(
        "_e",
        F.col("_k"),
        F.explode(
            F.filter(
                F.array(
                    row("period", F.col("_lo"), F.col("_hi")),
                    F.when(F.col("_next").isNotNull(), row("gap", F.col("_hi") + 1, F.col("_next") - 1)),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("_r"),
        outer.alias("_outer"),
    ).select("_e", "_k", "_outer", "_r.*")
    edge = (F.col("_kind") == "period") & F.col("_outer")
    inner = said.where(~edge).select(F.col("_kind").alias("span_kind"), "_e", "_lo", "_hi")

    # A first and a last piece of one shard never touch, so runs found here join pieces of neighbouring shards only.
    order = Window.partitionBy("_e").orderBy("_lo")
    edges = said.where(edge).select("_e", "_k", "_lo", "_hi", F.lag("_hi").over(order).alias("_left"), F.lag("_k").over(order).alias("_left_k"))
    cross = edges.where((F.col("_left_k") != F.col("_k")) & (F.col("_lo") > F.col("_left") + 1)).select(F.lit("gap").alias("span_kind"), "_e", (F.col("_left") + 1).alias("_lo"), (F.col("_lo") - 1).alias("_hi"))
    stitched = _coalesced(edges.select("_e", "_lo", "_hi"), ["_e"]).select(F.lit("period").alias("span_kind"), "_e", "_lo", "_hi")
    return inner.unionByName(cross).unionByName(stitched).select("span_kind", F.col("_e").alias(entity), F.col("_lo").alias("first"), F.col("_hi").alias("last"))


def _coalesced(df: DataFrame, by: list[str]) -> DataFrame:
    """Touching or overlapping intervals of each ``by`` group made one."""
    order = Window.partitionBy(*by).orderBy("_lo", "_hi")
    reached = df.select(*by, "_lo", "_hi", *_merge(by, "_lo", "_hi"))
    begun = F.when(F.col("_reach").isNull() | (F.col("_lo") > F.col("_reach") + 1), 1).otherwise(0)
    numbered = reached.select(*by, "_lo", "_hi", F.sum(begun).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"))
    return numbered.groupBy(*by, "_run").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).drop("_run")


def page_coverage(evidence: DataFrame) -> DataFrame:
    """Periods and gaps of the page ranges of each analysis: (span_kind, analysis_id, first_page, last_page)."""
    first, last = page_span()
    merged = merge_intervals(evidence, "analysis_id", first, last)
    return merged.select("span_kind", F.col("analysis_id").cast("long"), F.col("first").alias("first_page"), F.col("last").alias("last_page"))
