"""Page ranges of documents: size-bounded bisection, choice of candidates, totals of images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.plans.tables import cut_lineage

LIMIT = 50_000_000


#: Units of a document that are added up in one task.
BLOCK = 4_096


def prefix_sums(pages: DataFrame) -> DataFrame:
    """(document, k, total): the k-th unit of each document and the bytes up to its end, from (document, unit_no, bytes).

    Units are added up within blocks of BLOCK unit numbers and blocks by document, so that a document of any length is
    spread over tasks. Null bytes count 0.
    """
    placed = pages.select("document", "unit_no", F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("bytes"), F.floor(F.col("unit_no") / BLOCK).alias("block"))
    inside = Window.partitionBy("document", "block").orderBy("unit_no")
    within = placed.select("document", "block", F.row_number().over(inside).alias("_k"), F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_total"))
    before = Window.partitionBy("document").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("document", "block").agg(F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_sum"))
    offsets = blocks.select("document", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_units"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_bytes"))
    return within.join(offsets, ["document", "block"]).select("document", (F.col("_k") + F.col("_units")).cast("long").alias("k"), (F.col("_total") + F.col("_bytes")).alias("total"))


def bisect_ranges(sums: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(document, chunk_id, start_page, end_page, bytes): documents halved until every part is within ``limit``.

    ``sums``: document, k, total (see :func:`prefix_sums`). A range is cut at the middle page (first + last) // 2; the two
    parts take _0 and _1 onto their id. A single page above the limit stays as it is. A range carries its bounds and the sums
    at them only; each round halves all open ranges at once by looking up the sum at their middle, so there are as many
    rounds as a document's length can be halved.
    """
    sums = cut_lineage(sums)
    state = sums.groupBy("document").agg(F.max("k").alias("end_page"), F.max("total").alias("hi")).select("document", F.lit("001").alias("chunk_id"), F.lit(1).cast("long").alias("start_page"), "end_page", F.lit(0).cast("long").alias("lo"), "hi")
    done = []
    while True:
        state = cut_lineage(state)
        over = (F.col("hi") - F.col("lo") > limit) & (F.col("start_page") < F.col("end_page"))
        done.append(state.where(~over))
        if not state.where(over).limit(1).count():
            whole = reduce(DataFrame.unionByName, done)
            return whole.select("document", "chunk_id", "start_page", "end_page", (F.col("hi") - F.col("lo")).alias("bytes"))
        cut = state.where(over).withColumn("k", F.floor((F.col("start_page") + F.col("end_page")) / 2).cast("long")).join(sums, ["document", "k"])
        half = lambda k, a, z, lo, hi: F.struct(F.lit(k).alias("id"), F.expr(a).alias("a"), F.expr(z).alias("z"), F.expr(lo).alias("lo"), F.expr(hi).alias("hi"))
        both = cut.select("document", "chunk_id", F.explode(F.array(half("_0", "start_page", "k", "lo", "total"), half("_1", "k + 1", "end_page", "total", "hi"))).alias("h"))
        state = both.select("document", F.concat("chunk_id", "h.id").alias("chunk_id"), F.col("h.a").alias("start_page"), F.col("h.z").alias("end_page"), "h.lo", "h.hi")


#: Ways to make an oversized document fit: 'auto' is 'chunk'; 'qpdf' and 'ebook' take the smallest file such a tool made.
STRATEGIES = ("none", "auto", "chunk", "qpdf", "ebook")


def choose_by_strategy(candidates: DataFrame, strategy: str, limit: int = LIMIT) -> DataFrame:
    """(document_sha256, choice, candidate_sha256, size_bytes) under one of STRATEGIES.

    An original within the limit is taken under each of them. Else 'none' takes nothing, 'chunk' and 'auto' leave the document
    to be cut, 'qpdf' and 'ebook' take the smallest file their tool made if it is within the limit, and nothing otherwise.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    fits = (F.col("size_bytes") > 0) & (F.col("size_bytes") <= limit)
    best = F.struct("size_bytes", "candidate_sha256")
    own = lambda method: F.min(F.when(fits & F.col("compression_method").eqNullSafe(F.lit(method)), best))
    made = own(strategy) if strategy in ("qpdf", "ebook") else F.min(F.when(F.lit(False), best))
    picked = candidates.groupBy("document_sha256").agg(own("original").alias("o"), made.alias("m"))
    rest = "chunk" if strategy in ("auto", "chunk") else "none"
    chosen = F.coalesce("o", "m")
    return picked.select("document_sha256", F.when(F.col("o").isNotNull(), "original").when(F.col("m").isNotNull(), strategy).otherwise(rest).alias("choice"), chosen["candidate_sha256"].alias("candidate_sha256"), chosen["size_bytes"].alias("size_bytes"))


def choose_candidate(candidates: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(document_sha256, choice, candidate_sha256, size_bytes): the original if it fits, else the smallest candidate that
    does, else 'chunk' without candidate. Rows without a positive size are no candidates."""
    fits = (F.col("size_bytes") > 0) & (F.col("size_bytes") <= limit)
    original = fits & F.col("compression_method").eqNullSafe(F.lit("original"))
    best = F.struct("size_bytes", "candidate_sha256")
    picked = candidates.groupBy("document_sha256").agg(F.min(F.when(original, best)).alias("o"), F.min(F.when(fits, best)).alias("f"))
    chosen = F.coalesce("o", "f")
    return picked.select("document_sha256", F.when(F.col("o").isNotNull(), "original").when(F.col("f").isNotNull(), "compressed").otherwise("chunk").alias("choice"), chosen["candidate_sha256"].alias("candidate_sha256"), chosen["size_bytes"].alias("size_bytes"))


def image_summary(usages: DataFrame, top: int = 10, threshold: float = 72.0) -> DataFrame:
    """Totals of a document's images and its largest ones: (document, images, image_bytes, high_images, high_bytes, max_dpi,
    top array<struct<object_id, bytes, dpi, uses>>). ``usages``: document, object_id, pos, bytes, dpi; an object's bytes are
    those of its first use; high means above ``threshold`` dpi."""
    objects = usages.groupBy("document", "object_id").agg(F.min_by("bytes", "pos").alias("bytes"), F.count(F.lit(1)).alias("uses"), F.coalesce(F.max("dpi"), F.lit(0.0)).alias("dpi"))
    high = F.col("dpi") > threshold
    largest = Window.partitionBy("document").orderBy(high.desc(), F.desc_nulls_last("bytes"), F.desc("dpi"), F.desc("object_id"))
    few = objects.withColumn("_k", F.row_number().over(largest)).where(F.col("_k") <= top).groupBy("document").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "object_id", "bytes", "dpi", "uses"))), lambda x: x.dropFields("_k")).alias("top"))
    totals = objects.groupBy("document").agg(
        F.count(F.lit(1)).alias("images"), F.sum("bytes").alias("image_bytes"), F.count_if(high).alias("high_images"), F.coalesce(F.sum(F.when(high, F.col("bytes"))), F.lit(0)).alias("high_bytes"), F.max("dpi").alias("max_dpi")
    )
    return totals.join(few, "document")
