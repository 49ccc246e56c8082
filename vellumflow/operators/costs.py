"""Price lookup, cost of token usage, backfill of missing costs, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.plans.tables import join_small

USAGE = ("prompt_tokens", "candidate_tokens", "total_cost_usd")


def priced_models(usage: DataFrame, prices: DataFrame, model: str = "model_name") -> DataFrame:
    """(model, alias, input_price, output_price) of each model: the price of its own name, else of the first alias in order
    that its name begins with. ``prices``: alias, input_price, output_price. Models without a price are left out."""
    models = usage.where(F.length(model) > 0).select(F.col(model)).distinct()
    # Every beginning of a name is looked up as it stands: an equality join, however many prices there are.
    beginnings = models.select(model, F.explode(F.transform(F.sequence(F.lit(1), F.length(model)), lambda i: F.substring(F.col(model), F.lit(1), i))).alias("alias"))
    found = beginnings.join(prices.dropDuplicates(["alias"]), "alias")
    return found.groupBy(model).agg(F.min_by(F.struct("alias", "input_price", "output_price"), F.struct(F.col("alias") != F.col(model), F.col("alias"))).alias("p")).select(model, "p.*")


def estimated(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> tuple[Column, Column, Column]:
    """Cost of input, of output, and both, at prices a million tokens."""
    i, o = tokens_in / F.lit(1_000_000.0) * price_in, tokens_out / F.lit(1_000_000.0) * price_out
    return i, o, i + o


def with_costs(usage: DataFrame, prices: DataFrame, model: str = "model_name") -> DataFrame:
    """``usage`` with input_cost_usd, output_cost_usd, estimated_cost_usd and pricing_missing; without a price the costs are 0."""
    joined = join_small(usage, priced_models(usage, prices, model), [model])
    zero = lambda x: F.coalesce(x, F.lit(0))
    i, o, both = estimated(zero(F.col("prompt_tokens")), zero(F.col("candidate_tokens")), F.coalesce("input_price", F.lit(0.0)), F.coalesce("output_price", F.lit(0.0)))
    return joined.withColumns({"input_cost_usd": i, "output_cost_usd": o, "estimated_cost_usd": both, "pricing_missing": F.col("alias").isNull()}).drop("alias", "input_price", "output_price")


def unpriced() -> Column:
    """Rows whose cost was never computed: no cost but some tokens."""
    return (F.coalesce("total_cost_usd", F.lit(0.0)) == 0) & ((F.coalesce("prompt_tokens", F.lit(0)) > 0) | (F.coalesce("candidate_tokens", F.lit(0)) > 0))


def backfill(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` with total_cost_usd computed where it is missing, and untouched elsewhere."""
    costs = with_costs(usage, prices)
    return costs.withColumn("total_cost_usd", F.when(unpriced(), F.col("estimated_cost_usd")).otherwise(F.col("total_cost_usd"))).drop("input_cost_usd", "output_cost_usd", "estimated_cost_usd", "pricing_missing")


def rollup(usage: DataFrame, by: Sequence[str], columns: Sequence[str] = USAGE) -> DataFrame:
    """Sums of usage, 0 where there is nothing; without ``by`` one row even of an empty table."""
    sums = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in columns]
    return usage.groupBy(*by).agg(*sums) if by else usage.agg(*sums)


def summed_sources(sources: Sequence[DataFrame], by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Usage of several ledgers (analyses, syntheses) added up by key."""
    first, *rest = (s.select(*by, *columns) for s in sources)
    for r in rest:
        first = first.unionByName(r)
    return rollup(first, by, columns)
