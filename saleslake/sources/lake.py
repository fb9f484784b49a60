"""Tables of a lake: folders of Parquet that Spark partitions by ``_part``, and a table of their columns.

Merged tables are cut into a fixed number of buckets by a hash of the merge key. A batch rewrites the buckets that its
keys fall in and leaves the others' files alone: Spark's dynamic partition overwrite writes them beside the old ones and
swaps them when the job commits. Tables that only grow have one partition for each batch. Either way a batch that runs
again replaces what it wrote, and one that broke off is completed by running it again. ``commits`` holds a row for each
batch that was taken in whole.

Columns only ever join a table. They are registered before the first rows that have them are written, so files without
them read as NULL and no footers are merged.
"""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "_part"
#: Buckets of a merged table, fixed by its first write. A bucket is what one task rewrites, so a table that will hold
#: terabytes is begun with as many as it has gigabytes.
BUCKETS = 64
#: Of the tables and of the raw and audit layers: their JSON texts say every field's name in every row.
CODEC = "zstd"
_COLUMNS = "columns"
_REGISTRY = "schema string, buckets int, table string"


def _at(lake: str, table: str) -> str:
    return f"{lake}/{table}"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _dynamic(df: DataFrame, path: str, by: str) -> None:
    df.repartition(by).write.mode("overwrite").option("compression", CODEC).option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def registry(spark: SparkSession, lake: str) -> dict[str, tuple[StructType, int]]:
    """Columns and number of buckets of every table; a row for each table, read in one go."""
    if not _exists(spark, _at(lake, _COLUMNS)):
        return {}
    rows = spark.read.schema(_REGISTRY).parquet(_at(lake, _COLUMNS)).collect()
    return {r["table"]: (StructType.fromJson(json.loads(r["schema"])), r["buckets"]) for r in rows}


def registered(spark: SparkSession, lake: str, table: str) -> tuple[StructType, int] | None:
    """Columns and number of buckets of a table, or None before its first write."""
    return registry(spark, lake).get(table)


def widen(spark: SparkSession, lake: str, table: str, schema: StructType, buckets: int = BUCKETS) -> tuple[StructType, int]:
    """Register the columns that a table does not have yet."""
    known = registered(spark, lake, table)
    fields = list(known[0].fields) if known else []
    names = {f.name.lower() for f in fields}
    fresh = [f for f in schema.fields if f.name != PART and f.name.lower() not in names]
    if known and not fresh:
        return known
    whole, buckets = StructType([*fields, *fresh]), known[1] if known else buckets
    row = spark.createDataFrame([(whole.json(), buckets, table)], _REGISTRY)
    _dynamic(row, _at(lake, _COLUMNS), "table")
    return whole, buckets


def read_table(spark: SparkSession, lake: str, table: str, parts: bool = False, known: dict | None = None) -> DataFrame | None:
    """A table's rows, or None before its first write. ``parts`` keeps the partition column; ``known`` is the registry
    where the caller has it."""
    columns = (registry(spark, lake) if known is None else known).get(table)
    if not _exists(spark, _at(lake, table)):
        return None
    if columns is None:  # a table that is only ever replaced as a whole
        return spark.read.parquet(_at(lake, table))
    rows = spark.read.schema(StructType(columns[0].fields).add(PART, "string")).parquet(_at(lake, table))
    return rows if parts else rows.drop(PART)


def replace_table(df: DataFrame, lake: str, table: str) -> None:
    """Replace an unpartitioned table."""
    df.write.mode("overwrite").parquet(_at(lake, table))


def bucket(keys: list[str], buckets: int) -> Column:
    """Name of the partition that a key falls in."""
    return F.concat(F.lit("k"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string"))


def parts_of(df: DataFrame) -> list[str]:
    """Partitions that rows fall in; at most the number of buckets and one for the batch."""
    return sorted(r[PART] for r in df.select(PART).distinct().collect())


def overwrite_parts(df: DataFrame, lake: str, table: str, buckets: int = BUCKETS) -> None:
    """Replace the partitions that the rows name, and no others."""
    widen(df.sparkSession, lake, table, df.schema, buckets)
    _dynamic(df, _at(lake, table), PART)


def batch_part(batch_id: str) -> str:
    return f"b-{quote(batch_id, safe='')}"


def replace_part(df: DataFrame, lake: str, table: str, part: str) -> None:
    """Replace one partition as a whole, also by no rows."""
    widen(df.sparkSession, lake, table, df.schema)
    df.write.mode("overwrite").option("compression", CODEC).parquet(f"{_at(lake, table)}/{PART}={quote(part, safe='-')}")


def commit(spark: SparkSession, lake: str, batch_id: str, source: str) -> None:
    """Note that a batch has been taken in whole."""
    row = spark.createDataFrame([(batch_id, source)], "batch_id string, source string").withColumn("at", F.current_timestamp())
    replace_part(row, lake, "commits", batch_part(batch_id))


def committed(spark: SparkSession, lake: str, batch_id: str) -> bool:
    rows = read_table(spark, lake, "commits", parts=True)
    return rows is not None and not rows.where(F.col("batch_id") == batch_id).isEmpty()
