"""Keyed merges of a batch into a current table.

The batch is first reduced to one row per key (map-side combined, so a key repeated in
most of the batch costs nothing), then joined once with the current table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslake.functions.parsing import filled, name_key
from saleslake.operators.joins import fan_out_join, union_all
from saleslake.operators.ranking import number_rows


def last_non_null(batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key; per column the latest value that is neither NULL nor empty."""
    values = [c for c in batch.columns if c not in {*keys, seq}]
    return batch.groupBy(*keys).agg(
        F.max(seq).alias(seq),
        *[F.max_by(c, F.when(filled(F.col(c).cast("string")), F.col(seq))).alias(c) for c in values],
    )


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Insert new keys; on known keys a batch value replaces the old one unless it is NULL.

    Keys compare null-safe. Columns of either side survive. New rows have a NULL ``id``
    when the table has one; see ``assign_ids``.
    """
    latest = last_non_null(batch, keys, seq).drop(seq)
    new_names = {c: f"_new_{c}" for c in latest.columns}
    incoming = latest.withColumnsRenamed(new_names).withColumn("_new", F.lit(True))
    match = [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys]
    joined = current.withColumn("_old", F.lit(True)).join(incoming, match, "full")
    columns = list(dict.fromkeys([*current.columns, *latest.columns]))
    merged = []
    for c in columns:
        sides = [F.col(s) for s in ([f"_new_{c}"] if c in latest.columns else []) + ([c] if c in current.columns else [])]
        if c in keys:
            value = F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_new_{c}"))
        else:
            value = F.coalesce(*sides)
        merged.append(value.alias(c))
    return joined.select(*merged)


def merge_deals(current: DataFrame, batch: DataFrame, seq: str) -> DataFrame:
    """Merge on (deal_name, account_name); deals lacking either are appended as they are.

    Deals without a full key stay out of the join on both sides: they match nothing, and
    many of them may share one incomplete key.
    """
    keys = ["deal_name", "account_name"]
    keyed = F.coalesce(filled(F.col("deal_name")) & filled(F.col("account_name")), F.lit(False))
    merged = upsert(current.where(keyed), batch.where(keyed), keys, seq)
    return union_all([merged, current.where(~keyed), batch.where(~keyed).drop(seq)])


def append(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Facts are events: nothing is merged, missing columns are NULL on either side."""
    return union_all([current, batch])


def assign_ids(df: DataFrame, column: str = "id", base: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Give rows without an id the next ones beyond the largest in use (or ``base``), without gaps.

    New rows are numbered in ``order``, by default in the order of a hash of their values."""
    top = base if base is not None else df.agg(F.max(column)).first()[0] or 0
    fresh = df.where(F.col(column).isNull()).drop(column)
    numbered = number_rows(fresh, order or [F.xxhash64(*fresh.columns)], column).withColumn(column, F.col(column) + top)
    return df.where(F.col(column).isNotNull()).unionByName(numbered)


def backfill_account_id(facts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Fill missing account ids from equal names, smallest id first.

    Each distinct name is looked up once; the names are joined back by salting hot ones.
    """
    by_name = accounts.groupBy(name_key(F.col("account_name")).alias("_key")).agg(F.min("id").alias("_found"))
    needed = facts.withColumn("_key", F.when(F.col("account_id").isNull(), name_key(F.col("account_name"))))
    known = by_name.where(F.col("_key").isNotNull())
    return (
        fan_out_join(needed, known, ["_key"], "id")
        .withColumn("account_id", F.coalesce("account_id", "_found"))
        .drop("_key", "_found")
    )
