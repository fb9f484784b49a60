"""Joins that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys heavier than HOT_ROWS are spread over several tasks. At most HOT_KEYS keys are
# treated that way, the heaviest ones, so the table of them is always small; a key that
# is not among them holds less than 1/HOT_KEYS of the rows.
HOT_ROWS = 1_000_000
HOT_KEYS = 10_000
MAX_SALTS = 4_096


def lookup_join(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, spread: Column) -> DataFrame:
    """LEFT JOIN on an id that is NULL for many facts.

    Rows without an id match nothing; giving them distinct negative keys keeps them from
    landing in one task. Ids are positive or zero.
    """
    key = F.coalesce(F.col(fact_key), -1 - F.pmod(F.xxhash64(spread), F.lit(1 << 30)))
    keyed = facts.withColumn("_lookup_key", key)
    return keyed.join(dim, F.col("_lookup_key") == dim[dim_key], "left").drop("_lookup_key")


def hot_keys(facts: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The heaviest key combinations and how many tasks each should be spread over."""
    return (
        facts.groupBy(*[F.col(k).alias(f"_hot_{k}") for k in keys])
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > hot_rows)
        .orderBy(F.desc("_rows"))
        .limit(HOT_KEYS)
        .withColumn("_salts", F.least(F.ceil(F.col("_rows") / hot_rows), F.lit(MAX_SALTS)).cast("int"))
        .drop("_rows")
    )


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def fan_out_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    row_id: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    sent: bool = False,
) -> DataFrame:
    """Null-safe equi-join in which hot fact keys are salted and their dim rows replicated.

    Both sides have the ``keys``; the result keeps the facts' copy. ``row_id`` decides the
    salt, so a retried task salts its rows the same way. With ``sent``, a small dim goes to
    every task and the facts stay where they are.
    """
    if sent:
        dim_names = [f"_dim_{k}" for k in keys]
        small = F.broadcast(dim.withColumnsRenamed(dict(zip(keys, dim_names))))
        return facts.join(small, _same(keys, dim_names), how).drop(*dim_names)
    hot = F.broadcast(hot_keys(facts, keys, hot_rows))
    hot_names = [f"_hot_{k}" for k in keys]
    dim_names = [f"_dim_{k}" for k in keys]
    salted = facts.join(hot, _same(keys, hot_names), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(row_id), F.coalesce("_salts", F.lit(1))).cast("int")
    )
    replicated = (
        dim.withColumnsRenamed(dict(zip(keys, dim_names)))
        .join(hot, _same(dim_names, hot_names), "left")
        .withColumn("_dim_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop(*hot_names, "_salts")
    )
    return salted.drop(*hot_names, "_salts").join(
        replicated, _same([*keys, "_salt"], [*dim_names, "_dim_salt"]), how
    ).drop("_salt", "_dim_salt", *dim_names)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly row-wise work on an input of fewer splits than cores.

    A large input has more splits than the cluster has cores and is left where it lies.
    Meant for scans: asking a shuffled input for its splits would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
