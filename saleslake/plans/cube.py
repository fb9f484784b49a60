"""Deal measures for every combination of the business dimensions, all subtotals included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.functions.parsing import is_open, is_won, same_text
from saleslake.plans.marts import Silver, _deals

DIMENSIONS = ["vertical", "horizontal", "geography", "engagement_model", "business_type", "lead_source", "ai_influenced"]
_SUMS = ["deal_count", "won_count", "ai_influenced_count", "total_deal_value", "won_value", "pipeline_value"]


def revenue_cube(silver: Silver) -> DataFrame:
    """One row per combination of values of any of the dimensions.

    ``grouping_id`` has a bit for each dimension (the first is the highest), set where the row sums over it; its value
    is NULL then, as it is for deals without one. Deals are summed once, at the finest grain. Each dimension then adds
    its own subtotals to what there is so far: a level is summed from one with a single dimension more, so a row is
    copied twice a step, not 128 times, and sums are combined before every shuffle.
    """
    stage, rows, value = F.col("deal_stage"), F.col("_rows"), F.col("_amount")
    ai = same_text(F.col("ai_influenced"), "yes")
    shares = [rows, F.when(is_won(stage), rows), F.when(ai, rows), value, F.when(is_won(stage), value), F.when(is_open(stage), value)]
    level = _deals(silver).groupBy(*DIMENSIONS).agg(*[F.sum(s).alias(n) for s, n in zip(shares, _SUMS)]).withColumn("grouping_id", F.lit(0))
    for place, name in enumerate(reversed(DIMENSIONS)):
        kind = level.schema[name].dataType
        both = F.array(
            F.struct(F.col(name).alias("v"), F.col("grouping_id").alias("g")),
            F.struct(F.lit(None).cast(kind).alias("v"), (F.col("grouping_id") + (1 << place)).alias("g")),
        )
        doubled = level.withColumn("_at", F.explode(both)).withColumns({name: F.col("_at.v"), "grouping_id": F.col("_at.g")})
        level = doubled.groupBy(*DIMENSIONS, "grouping_id").agg(*[F.sum(n).alias(n) for n in _SUMS])
    money = {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in _SUMS[3:]}
    counts = {n: F.coalesce(n, F.lit(0)) for n in _SUMS[:3]}
    return level.withColumns({**counts, **money, "grouping_id": F.col("grouping_id").cast("bigint")})
