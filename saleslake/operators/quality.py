"""Splitting, reporting and relevance over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake import vocab
from saleslake.functions import quality as rules
from saleslake.functions.parsing import not_blank, strip
from saleslake.operators.joins import union_all


def with_errors(df: DataFrame, table: str) -> DataFrame:
    return df.withColumn("errors", rules.errors(table, df.columns))


def split(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Valid records, and rejects with their reasons and the whole record as JSON."""
    checked = with_errors(df, table)
    valid = checked.where(F.size("errors") == 0).drop("errors")
    rejects = checked.where(F.size("errors") > 0).select(
        F.lit(table).alias("table_name"),
        *(["id"] if "id" in df.columns else []),
        F.col("errors").alias("error_messages"),
        F.to_json(F.struct(*df.columns)).alias("raw_record"),
    )
    return valid, rejects


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Record counts and validation rate per table."""
    reports = []
    for name, df in tables.items():
        is_valid = F.size(rules.errors(name, df.columns)) == 0
        counted = df.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(is_valid).alias("valid_records"))
        reports.append(
            counted.select(
                F.lit(name).alias("table_name"),
                "total_records",
                "valid_records",
                (F.col("total_records") - F.col("valid_records")).alias("invalid_records"),
                F.coalesce(
                    F.round(F.col("valid_records") / F.nullif(F.col("total_records"), F.lit(0)), 3), F.lit(1.0)
                ).alias("validation_rate"),
            )
        )
    return union_all(reports)


def fill_rates(df: DataFrame) -> DataFrame:
    """Share of filled values per field; one aggregate over the table."""
    fields = df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(not_blank(F.col(c).cast("string"))).alias(c) for c in fields],
    )
    return counts.unpivot("_total", fields, "field", "filled").select(
        "field", F.round(F.col("filled") / F.nullif(F.col("_total"), F.lit(0)), 3).alias("fill_rate")
    )


def top_errors(df: DataFrame, table: str, limit: int = 10) -> DataFrame:
    """The most frequent reasons for rejection."""
    n = F.col("records")
    return (
        df.select(F.explode(rules.errors(table, df.columns)).alias("error"))
        .groupBy("error")
        .agg(F.count(F.lit(1)).alias("records"))
        .orderBy(F.desc("records"), "error")
        .limit(limit)
        .select(
            "error",
            "records",
            F.concat(
                F.col("error"), F.lit(" ("), n.cast("string"), F.lit(" record"),
                F.when(n > 1, "s").otherwise(""), F.lit(")"),
            ).alias("summary"),
        )
    )


def enum_distribution(df: DataFrame) -> DataFrame:
    """Counts of every value of the controlled fields, in one pass."""
    fields = [f for f in vocab.ENUM_FIELDS if f in df.columns]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), strip(F.col(f)).alias("value")) for f in fields])
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .where(not_blank(F.col("value")))
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("records"))
    )


def text_relevance(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: evidence count and verdict. The whole text is searched."""
    blob = F.concat(F.lit("raw_transcript "), F.col(text))
    hits = rules.relevance_hits(blob, ["raw_transcript"])
    return docs.withColumn("hits", hits).withColumn("is_relevant", F.col("hits") >= vocab.MIN_RELEVANCE_HITS)


def batch_relevance(df: DataFrame) -> DataFrame:
    """Verdict on a structured file as a whole: one row, from all rows of the file."""
    names = " ".join(df.columns).lower()
    hints = len({c.lower() for c in df.columns} & set(vocab.SALES_COLUMN_HINTS))
    blob = F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])
    open_words = [w for w in vocab.SALES_KEYWORDS if w not in names]
    sure = hints + len(vocab.SALES_KEYWORDS) - len(open_words)
    found = df.select(blob.alias("_blob"), F.lower(blob).alias("_low")).agg(
        *[F.max(F.contains("_low", F.lit(w)).cast("int")).alias(f"w_{i}") for i, w in enumerate(open_words)],
        F.max(F.when(F.col("_blob").rlike(rules.ROLE_PATTERN), 2).otherwise(0)).alias("role"),
        F.max(F.when(F.col("_blob").rlike(vocab.RELEVANCE_MONEY_PATTERN), 1).otherwise(0)).alias("money"),
    )
    hits = F.lit(sure)
    for column in found.columns:
        hits = hits + F.coalesce(F.col(f"`{column}`"), F.lit(0))
    return found.select(hits.cast("bigint").alias("hits")).withColumn(
        "is_relevant", F.col("hits") >= vocab.MIN_RELEVANCE_HITS
    )
