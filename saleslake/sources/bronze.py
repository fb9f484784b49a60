"""The append-only raw layer and the per-batch audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslake import vocab
from saleslake.functions.parsing import coerce_audit_value
from saleslake.operators.joins import union_all

TRANSCRIPT_FIELDS = ["transcript", "raw_transcript"]
MIN_TRANSCRIPT_CHARS = 50


def data_type(columns: list[str]) -> Column:
    """``raw_transcript`` for a record with a transcript of more than 50 characters."""
    texts = [F.nullif(F.col(c), F.lit("")) for c in TRANSCRIPT_FIELDS if c in columns]
    if not texts:
        return F.lit("structured_data")
    return F.when(F.length(F.coalesce(*texts)) > MIN_TRANSCRIPT_CHARS, "raw_transcript").otherwise("structured_data")


def with_data_type(df: DataFrame) -> DataFrame:
    return df.withColumn("data_type", data_type(df.columns))


def bronze_rows(df: DataFrame, source: str) -> DataFrame:
    """Raw records as JSON payloads."""
    return df.select(
        F.lit(source).alias("source"), data_type(df.columns).alias("data_type"), F.to_json(F.struct("*")).alias("raw_payload")
    )


def append_bronze(df: DataFrame, source: str, path: str) -> None:
    """Append a batch; the arrival time is stamped on write."""
    bronze_rows(df, source).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def audit_rows(mapped: dict[str, DataFrame], batch_id: str, source: str, method: str) -> DataFrame:
    """The audit trail of a batch: one JSON row per mapped record, values in read-back form.

    One row per record keeps a large batch out of a single value; the batch id groups them.
    """
    read_back = {t: df.select(*[coerce_audit_value(F.col(c).cast("string"), c).alias(c) for c in df.columns]) for t, df in mapped.items()}
    return coerced_audit_rows(read_back, batch_id, source, method)


def coerced_audit_rows(mapped: dict[str, DataFrame], batch_id: str, source: str, method: str) -> DataFrame:
    """``audit_rows`` of records that are in read-back form already."""
    rows = [
        df.select(
            F.lit(batch_id).alias("batch_id"),
            F.lit(source).alias("source"),
            F.lit(method).alias("classification_method"),
            F.lit(vocab.ENTITY_NAMES.get(table, table)).alias("entity"),
            F.to_json(F.struct(*df.columns)).alias("record"),
        )
        for table, df in mapped.items()
    ]
    return union_all(rows)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("batch_id", "entity").parquet(path)


def read_audit(spark: SparkSession, path: str, batch_id: str, table: str, columns: list[str]) -> DataFrame:
    """Records of one entity of one batch; only its partition is read."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.parquet(path).where(
        (F.col("batch_id") == batch_id) & (F.col("entity") == vocab.ENTITY_NAMES.get(table, table))
    )
    return rows.select(F.from_json("record", schema).alias("r")).select("r.*")
