"""Incremental ingest of a folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from saleslake.plans.ingest import ingest_structured
from saleslake.sources.lake import committed


def ingest_folder(
    spark: SparkSession,
    folder: str,
    schema: str,
    source: str,
    lake: str,
    checkpoint: str,
    as_of: str,
    routing: dict[str, str] | None = None,
) -> StreamingQuery:
    """Take in every CSV file not seen yet, then stop.

    Each micro-batch is one ingest batch. Its id is derived from the stream's own batch number. A batch that the lake
    has noted as taken in is not taken in again when the stream repeats it (it was lost between the lake's note and the
    stream's own); one that broke off earlier is run again and replaces what it wrote.
    ``schema`` names the columns, all text.
    """
    files = spark.readStream.schema(schema).option("header", True).option("multiLine", True).csv(folder)

    def take(batch: DataFrame, number: int) -> None:
        batch_id = f"{source.strip().lower()}-{number}"
        if committed(batch.sparkSession, lake, batch_id):
            return
        rows = batch.withColumn("seq", F.monotonically_increasing_id())
        ingest_structured(batch.sparkSession, rows, source, batch_id, lake, as_of, routing)

    return (
        files.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
