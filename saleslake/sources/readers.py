"""Reading uploaded files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", columns: list[str] | None = None) -> DataFrame:
    """Header CSV with every value as text. Naming the columns avoids a pass over the header."""
    reader = spark.read.option("header", True).option("multiLine", True).option("encoding", encoding).option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One record per file: its text and its name."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("raw_transcript"), F.regexp_extract(F.input_file_name(), r"([^/]+)\z", 1).alias("filename")
    )


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines ``{source, data: [...]}``, one row per record."""
    return spark.read.schema(schema).json(path).select("source", F.explode("data").alias("record")).select("source", "record.*")
