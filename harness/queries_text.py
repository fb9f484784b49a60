"""Registered transcript and document queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harness import silver_views as views
from saleslake import vocab
from saleslake.functions import text as tx
from saleslake.operators import chunking, transcripts
from saleslake.operators.joins import spread


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.transcripts(spark, sf_dir, spread)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(views.table(spark, sf_dir, "documents").select("doc_id", "text"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meeting notes, and the document corpus under negative ids."""
    corpus = documents(spark, sf_dir).select(
        (-F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").cast("string").alias("filename"), F.lit("").alias("account_name"), "text")
    return notes(spark, sf_dir).select("doc_id", "filename", "account_name", "text").unionByName(corpus)


def _joined(values: Column) -> Column:
    return F.array_join(values, "|")


def _over_both(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in columns.items()])


def speakers(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", _joined(F.array_sort(tx.speakers(F.col("text")))).alias("speakers"))


def company_name(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", tx.company(F.col("text")).alias("company"))


def industry_tag(spark, sf_dir):
    tag = tx.industry(F.col("text")).alias("industry")
    return (
        notes(spark, sf_dir).select("doc_id", F.lit("note").alias("kind"), tag)
        .unionByName(documents(spark, sf_dir).select("doc_id", F.lit("document").alias("kind"), tag))
    )


def firmographics(spark, sf_dir):
    body = F.col("text")
    return texts(spark, sf_dir).select(
        "doc_id",
        tx.geography(body).alias("geography"),
        tx.employee_count(body).alias("employee_count"),
        tx.annual_revenue(body).alias("annual_revenue"),
    )


def money_mentions(spark, sf_dir):
    body = F.col("text")
    return _over_both(spark, sf_dir, mentions=_joined(tx.money_mentions(body)), deal_value=tx.first_amount(body))


def topics_keypoints(spark, sf_dir):
    body = F.col("text")
    return _over_both(spark, sf_dir, topics=_joined(tx.topics(body)), key_points=_joined(tx.key_points(body)))


def lexicon_sentiment(spark, sf_dir):
    lowered = F.lower("text")
    return _over_both(
        spark,
        sf_dir,
        positive=tx.count_contained(lowered, vocab.POSITIVE_WORDS).cast("bigint"),
        negative=tx.count_contained(lowered, vocab.NEGATIVE_WORDS).cast("bigint"),
        sentiment=tx.sentiment(F.col("text")),
    )


def duration_minutes(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", tx.duration_minutes(F.col("text")).alias("duration_minutes"))


def competitors(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", _joined(tx.competitors(F.col("text"))).alias("competitors"))


def deal_signals(spark, sf_dir):
    body = F.col("text")
    return texts(spark, sf_dir).select(
        "doc_id",
        (F.size(tx.money_mentions(body)) > 0).alias("budget_confirmed"),
        tx.buying_intent(body).alias("buying_intent"),
        tx.stated_stage(body).alias("stated_stage"),
        tx.deal_name(body).alias("deal_name"),
        tx.close_date(body).alias("close_date"),
    )


def named_contacts(spark, sf_dir):
    return (
        texts(spark, sf_dir)
        .select("doc_id", F.explode_outer(tx.named_contacts(F.col("text"))).alias("c"))
        .where(F.col("c").isNotNull())
        .select("doc_id", F.col("c.name").alias("contact_name"), "c.role", "c.department")
    )


def transcript_entities(spark, sf_dir):
    return transcripts.entity_listing(transcripts.extract(texts(spark, sf_dir)))


def insight_text(spark, sf_dir):
    return transcripts.insights(transcripts.extract(texts(spark, sf_dir)))


def chunk_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumns({"filename": F.col("doc_id").cast("string"), "account_name": F.lit("")})
    return chunking.chunk(docs).select("doc_id", "chunk_index", "total_chunks", "chunk_text")


def chunk_ids(spark, sf_dir):
    return chunking.chunk(texts(spark, sf_dir)).select("doc_id", "chunk_id")


TEXT_QUERIES = {
    f.__name__: f
    for f in [
        speakers, company_name, industry_tag, firmographics, money_mentions, topics_keypoints,
        lexicon_sentiment, duration_minutes, competitors, deal_signals, named_contacts,
        transcript_entities, insight_text, chunk_documents, chunk_ids,
    ]
}
