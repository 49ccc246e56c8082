"""Connected components of links by rounds of joins: no component is ever gathered in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.plans.tables import cut_lineage


def component_roots(links: DataFrame, by: str) -> DataFrame:
    """(by, id, root) of every id that a link leads to a lesser one; ``links``: by, a, b. The root is the component's least id.

    Every link leads from the greater id to the lesser. In each round an id keeps a link to its least neighbour only, its
    other neighbours are linked to that one instead, and links are followed one step further, so that paths shrink by half;
    links never multiply. The rounds end when every id has one link and it leads to a root.
    """
    up = cut_lineage(links.where("a <> b").select(by, F.greatest("a", "b").alias("id"), F.least("a", "b").alias("root")).distinct())
    while True:
        least = up.groupBy(by, "id").agg(F.min("root").alias("least"), F.count(F.lit(1)).alias("n"))
        above = least.select(by, F.col("id").alias("root"), F.col("least").alias("beyond"))
        held = cut_lineage(up.join(least, [by, "id"]).join(above, [by, "root"], "left"))
        if not held.where("n > 1 or beyond is not null").limit(1).count():
            return held.select(by, "id", "root")
        own = held.select(by, "id", F.when(F.col("root") == F.col("least"), F.coalesce("beyond", "root")).otherwise(F.col("least")).alias("root"))
        aside = held.where("root <> least").select(by, F.col("root").alias("id"), F.col("least").alias("root"))
        up = own.unionByName(aside).distinct()
