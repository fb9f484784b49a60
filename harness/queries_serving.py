"""Registered queries on the serving side: dashboards, vectors, questions, raw search."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import batches, silver_views as views
from saleslake.functions.parsing import closing_band
from saleslake.operators import chunking, search, transcripts, vectors
from saleslake.operators.joins import spread
from saleslake.plans import cube, dashboard, questions
from saleslake.plans.marts import MARTS
from saleslake.plans.refresh import mart_row_counts as count_marts

ACCOUNT = 10  # the account opened in the detail page
QUESTION = "What did Globex Industries and Acme Corp say about the Migration budget?"


# ------------------------------------------------------------------ dashboard
def accounts_overview(spark, sf_dir):
    return dashboard.accounts_overview(views.silver(spark, sf_dir)).select(
        "id", "account_name", "contact_count", "deal_count", "deal_total_value", "interaction_count"
    )


def _detail(spark, sf_dir, part: str):
    return dashboard.account_detail(views.silver(spark, sf_dir), ACCOUNT)[part]


def account_detail(spark, sf_dir):
    return _detail(spark, sf_dir, "account")


def account_detail_contacts(spark, sf_dir):
    return _detail(spark, sf_dir, "contacts")


def account_detail_deals(spark, sf_dir):
    return _detail(spark, sf_dir, "deals").select("id", "deal_name", "account_name", "deal_value", "deal_stage")


def account_detail_interactions(spark, sf_dir):
    return _detail(spark, sf_dir, "interactions")


def account_detail_insights(spark, sf_dir):
    return _detail(spark, sf_dir, "insights")


def pipeline_by_stage(spark, sf_dir):
    return dashboard.pipeline_by_stage(views.silver(spark, sf_dir))


def pipeline_total(spark, sf_dir):
    return dashboard.pipeline_total(views.silver(spark, sf_dir))


def insights_feed(spark, sf_dir):
    return dashboard.insights_feed(views.silver(spark, sf_dir))


def insights_feed_by_type(spark, sf_dir):
    return dashboard.insights_feed(views.silver(spark, sf_dir), "deal_signal")


def insight_types(spark, sf_dir):
    return dashboard.insight_types(views.silver(spark, sf_dir))


def dashboard_stats(spark, sf_dir):
    return dashboard.dashboard_stats(views.silver(spark, sf_dir))


def pipeline_share(spark, sf_dir):
    return dashboard.pipeline_share(views.silver(spark, sf_dir), views.AS_OF)


def closing_bands(spark, sf_dir):
    rows = MARTS["deals_closing_soon"](views.silver(spark, sf_dir), views.AS_OF)
    return rows.groupBy(closing_band(F.col("days_until_close")).alias("band")).agg(F.count(F.lit(1)).alias("deals"))


def schema_profile(spark, sf_dir):
    return dashboard.schema_profile(views.silver(spark, sf_dir))


def mart_row_counts(spark, sf_dir):
    return count_marts(views.silver(spark, sf_dir), views.AS_OF)


def revenue_cube(spark, sf_dir):
    return cube.revenue_cube(views.silver(spark, sf_dir))


def semantic_query(spark, sf_dir):
    request = dashboard.Request(
        metrics=["total_deal_value", "won_value", "pipeline_value", "deal_count", "won_count", "ai_influenced_count"],
        group_by=["vertical", "lead_source"],
        filters={"geography": ["Onshore", "Offshore"]},
    )
    return dashboard.semantic_query(views.fact_deals(spark, sf_dir), request)


def _request(table: str, metrics: list[str], group_by: list[str], filters: dict | None = None):
    asked = dashboard.Request(metrics, group_by, filters or {}, None, table)
    return lambda spark, sf_dir: dashboard.answer_request(views.silver(spark, sf_dir), asked)


REQUESTS = {
    "request_accounts": _request("dim_account", ["row_count", "total:annual_revenue"], ["industry", "geography"]),
    "request_contacts": _request("dim_contact", ["row_count", "distinct:account_name", "filled:role"], ["role"]),
    "request_deals": _request("fact_deals", ["total_deal_value", "won_count", "distinct:account_id"], ["industry", "account_vertical", "horizontal"]),
    "request_interactions": _request("fact_interactions", ["row_count", "distinct:account_id", "latest:interaction_date"], ["sentiment", "industry"], {"geography": ["Onshore", "Both"]}),
    "request_insights": _request("fact_insights", ["row_count", "total:confidence", "earliest:insight_date"], ["insight_type", "vertical"]),
}


def semantic_query_rows(spark, sf_dir):
    request = dashboard.Request(metrics=[], group_by=["id", "deal_name", "deal_stage"])
    return dashboard.semantic_query(views.fact_deals(spark, sf_dir), request)


def mart_then_detail(spark, sf_dir):
    silver = views.silver(spark, sf_dir)
    asked = silver["fact_interactions"].select("account_name").unionByName(silver["fact_insights"].select("account_name"))
    mart = MARTS["at_risk_accounts"](silver, views.AS_OF).select(
        "account_name", F.concat(F.lit("risk "), "risk_level").alias("answer")
    )
    detail = silver["fact_interactions"].select(
        "account_name", F.concat(F.lit("contact "), F.col("id").cast("string")).alias("answer")
    )
    return dashboard.mart_then_detail(asked, mart, detail)


def _mart_page(name: str):
    def page(spark, sf_dir):
        return dashboard.mart_view(name, MARTS[name](views.silver(spark, sf_dir), views.AS_OF))

    return page


PAGES = {f"view_{name}": _mart_page(name) for name in dashboard.VIEW_COLUMNS}


# ------------------------------------------------------------------ raw search
def bronze_keyword_search(spark, sf_dir):
    return search.relevant_records(batches.bronze(spark, sf_dir), QUESTION).select("id", "source", "data_type")


def bronze_enrich(spark, sf_dir):
    """Entities found in the records the question is about."""
    found = search.relevant_records(batches.bronze(spark, sf_dir), QUESTION)
    return transcripts.entity_listing(search.extract_records(found))


# ------------------------------------------------------------------ vectors
def _asked(spark, sf_dir):
    """Every twentieth vector is a query against all of them."""
    return batches.vectors(spark, sf_dir).where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("scope")
    )


def vector_topk(spark, sf_dir):
    return vectors.top_k(batches.vectors(spark, sf_dir), _asked(spark, sf_dir).drop("scope"))


def vector_topk_scoped(spark, sf_dir):
    scoped = batches.vectors(spark, sf_dir).withColumn("scope", F.col("label"))
    return vectors.top_k(scoped, _asked(spark, sf_dir))


def vector_centroids(spark, sf_dir):
    """The mean vector of every label as a query."""
    means = vectors.centroids(batches.vectors(spark, sf_dir), "label").select(F.col("label").cast("bigint").alias("query_id"), "embedding")
    return vectors.top_k(batches.vectors(spark, sf_dir), means)


def vector_threshold(spark, sf_dir):
    return vectors.above_floor(vector_topk(spark, sf_dir))


def vector_stats(spark, sf_dir):
    return vectors.stats(batches.vectors(spark, sf_dir), "label")


def vector_upsert(spark, sf_dir):
    """All notes are indexed; those of closed orders come again, longer than before."""
    notes = views.transcripts(spark, sf_dir, spread).select("doc_id", "filename", "account_name", "text")
    closed = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    longer = notes.join(closed, "doc_id").withColumn("text", F.concat("text", F.lit("\n"), F.repeat(F.lit("More was said. "), 20)))
    index = vectors.replace_documents(chunking.chunk(notes), chunking.chunk(longer))
    return index.select("doc_id", "chunk_id", "total_chunks", F.length("chunk_text").cast("bigint").alias("chunk_chars"))


# ------------------------------------------------------------------ questions
def question_intent(spark, sf_dir):
    narrative, metric = questions.keyword_scores(F.col("question"))
    return batches.questions(spark, sf_dir).select(
        "conv_id", "turn", narrative.cast("bigint").alias("narrative"), metric.cast("bigint").alias("metric"),
        questions.intent(F.col("question")).alias("intent"),
    )


def greeting_filter(spark, sf_dir):
    return batches.questions(spark, sf_dir).select("conv_id", "turn", questions.is_greeting(F.col("question")).alias("is_greeting"))


def recent_context(spark, sf_dir):
    return questions.recent_context(views.table(spark, sf_dir, "conversations"))


def recent_context_whole(spark, sf_dir):
    return questions.recent_context(views.table(spark, sf_dir, "conversations"), cut=None)


def answer_route(spark, sf_dir):
    tiers = {
        "gold_rows": MARTS["activity_summary"](views.silver(spark, sf_dir), views.AS_OF),
        "silver_rows": views.fact_deals(spark, sf_dir),
        "bronze_rows": views.transcripts(spark, sf_dir),
        "vector_rows": batches.vectors(spark, sf_dir).selectExpr(f"{views.customer_name('label * 3')} AS account_name"),
    }
    asked = questions.with_row_counts(batches.questions(spark, sf_dir), tiers, "conv_id")
    return questions.answer_route(asked).select("conv_id", "turn", "intent", "route")


def _logged(spark, sf_dir):
    return batches.query_log(spark, sf_dir).select(
        "event_id", "question", questions.silver_tables(F.col("sql_text")).alias("tables")
    )


def silver_tables_used(spark, sf_dir):
    return _logged(spark, sf_dir).select("event_id", "tables")


def proposal_dedupe(spark, sf_dir):
    pending = batches.pending_proposals(spark, sf_dir)
    return questions.new_proposals(_logged(spark, sf_dir), pending, "event_id").select("event_id", "question", "tables")


def fallback_candidates(spark, sf_dir):
    return questions.fallback_candidates(_logged(spark, sf_dir))


SERVING_QUERIES = {
    **{
        f.__name__: f
        for f in [
            accounts_overview, account_detail, account_detail_contacts, account_detail_deals,
            account_detail_interactions, account_detail_insights, pipeline_by_stage, pipeline_total, insights_feed,
            insights_feed_by_type, insight_types, dashboard_stats, pipeline_share, closing_bands,
            schema_profile, mart_row_counts, revenue_cube, semantic_query, semantic_query_rows, mart_then_detail,
            bronze_keyword_search, bronze_enrich, vector_topk, vector_topk_scoped, vector_centroids, vector_threshold,
            vector_stats, vector_upsert, question_intent, greeting_filter, recent_context,
            recent_context_whole, answer_route, silver_tables_used, proposal_dedupe, fallback_candidates,
        ]
    },
    **PAGES,
    **REQUESTS,
}
