"""Global row numbers without funnelling the rows through one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslake.session import durable

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row number in its lower 33 bits


def number_rows(df: DataFrame, order: list[Column], name: str = "rank", store: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """Add ``name`` = 1..n in the given total order.

    Rows are range-partitioned and sorted, each partition numbers its own rows, and the
    partition sizes (one row per partition) give the offsets. ``store`` keeps the sorted rows.
    """
    placed = store(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", _SLOT_BITS).alias("_part")
    slot = F.col("_place").bitwiseAND((1 << _SLOT_BITS) - 1)
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + slot + 1)
        .drop("_place", "_part", "_offset")
    )
