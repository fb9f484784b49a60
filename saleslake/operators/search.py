"""Finding raw records a question is about, and turning them into silver rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saleslake import vocab
from saleslake.functions.parsing import bind
from saleslake.operators import transcripts
from saleslake.operators.transcripts import usable_text

PER_KEYWORD, FALLBACK_ROWS, MAX_RECORDS = 3, 2, 3
TEXT_FIELDS = ["raw_transcript", "transcript", "content_text"]


def question_keywords(question: str, account: str | None = None) -> list[str]:
    """The account, then the capitalised names of a question that are no stop words."""
    names = [n for n in re.findall(vocab.QUESTION_NAME_PATTERN, question) if n not in vocab.QUESTION_STOP_WORDS]
    return list(dict.fromkeys([*([account] if account else []), *(n for n in names if len(n) >= 3)]))


def keyword_hits(bronze: DataFrame, keywords: list[str]) -> DataFrame:
    """Newest records per keyword, numbered in keyword order; one scan for all keywords."""
    found = bind(
        F.lower("raw_payload"),
        lambda text: F.array_compact(
            F.array(*[F.when(F.contains(text, F.lit(w.lower())), F.lit(i)) for i, w in enumerate(keywords)])
        ),
    )
    newest = Window.partitionBy("keyword_no").orderBy(F.desc("created_at"), F.desc("id"))
    return (
        bronze.select("*", F.explode_outer(found).alias("keyword_no"))
        .where(F.col("keyword_no").isNotNull())
        .withColumn("hit", F.row_number().over(newest))
        .where(F.col("hit") <= PER_KEYWORD)
    )


def relevant_records(bronze: DataFrame, question: str, account: str | None = None) -> DataFrame:
    """At most three records: keyword hits in keyword order, else the two newest."""
    keywords = question_keywords(question, account)
    newest = (
        bronze.orderBy(F.desc("created_at"), F.desc("id"))
        .limit(FALLBACK_ROWS)
        .withColumns({"keyword_no": F.lit(len(keywords)), "hit": F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id")))})
    )
    hits = keyword_hits(bronze, keywords).unionByName(newest) if keywords else newest
    # Fallback rows carry the last keyword number: they count only when no keyword hit.
    first_kind = F.min(F.col("keyword_no") == len(keywords)).over(Window.partitionBy(F.lit(1)))
    once = Window.partitionBy("id").orderBy("keyword_no", "hit")
    chosen = (
        hits.withColumn("only_fallback", first_kind)
        .where(F.col("only_fallback") | (F.col("keyword_no") < len(keywords)))
        .withColumn("copy", F.row_number().over(once))
        .where("copy = 1")
    )
    return chosen.orderBy("keyword_no", "hit").limit(MAX_RECORDS).select("id", "source", "data_type", "raw_payload", "created_at")


def payload_text(bronze: DataFrame) -> DataFrame:
    """The usable text of each payload: its transcript field, else the payload itself."""
    fields = [F.get_json_object("raw_payload", f"$.{f}").alias(f"_{f}") for f in TEXT_FIELDS]
    return (
        bronze.select("*", *fields)
        .withColumn("text", usable_text([*(f"_{f}" for f in TEXT_FIELDS), "raw_payload"]))
        .drop(*(f"_{f}" for f in TEXT_FIELDS))
        .where(F.col("text").isNotNull())
    )


def extract_records(bronze: DataFrame) -> DataFrame:
    """Extracted attributes of the usable records, under the source name ``<source>_enriched``."""
    texts = payload_text(bronze).withColumnRenamed("id", "doc_id")
    return transcripts.extract(texts).withColumn("source", F.concat("source", F.lit("_enriched")))
