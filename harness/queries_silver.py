"""Registered queries on ingest: parsing, mapping, merging, identity and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harness import batches, silver_views as views
from saleslake import vocab
from saleslake.functions import parsing as p
from saleslake.functions import quality as rules
from saleslake.operators import identity, mapping, merge
from saleslake.operators import quality as dq
from saleslake.operators.joins import spread, union_all
from saleslake.sources import bronze as bronze_io

CARRY = ["seq", "source_name"]


# ------------------------------------------------------------------ values
def deal_value_parse(spark, sf_dir):
    value = p.amount(F.col("deal_value"))
    large = p.amount(F.concat(F.lit("123456789012345678"), "deal_value"))
    return views.fact_deals(spark, sf_dir).select(
        "id", "deal_value", value.cast("double").alias("amount"), large.cast("string").alias("large_amount")
    )


def number_prefix(spark, sf_dir):
    return views.fact_deals(spark, sf_dir).select("id", p.leading_number(F.col("deal_value")).alias("amount"))


def currency_clean(spark, sf_dir):
    return batches.crm_batch(spark, sf_dir).select("seq", p.clean_currency(F.col("deal_value")).alias("deal_value"))


def canonical_coerce(spark, sf_dir):
    deals = views.fact_deals(spark, sf_dir)
    padded = F.concat(F.lit("00"), "probability")
    return deals.select(
        "id",
        p.coerce_audit_value(F.col("deal_value"), "deal_value").alias("deal_value"),
        p.coerce_audit_value(padded, "probability").alias("probability"),
        p.coerce_audit_value(F.concat("probability", F.lit(".0")), "win_rate").alias("win_rate"),
        p.coerce_audit_value(F.concat("probability", F.lit(".50")), "score").alias("score"),
        p.coerce_audit_value(F.col("close_date"), "close_date").alias("close_date"),
        p.coerce_audit_value(F.concat("probability", F.lit(".12345678901234")), "score").alias("fine"),
        p.coerce_audit_value(F.concat("probability", F.lit(".5e3")), "score").alias("power"),
        p.coerce_audit_value(F.concat(F.lit("12345678901234567890"), "deal_value"), "score").alias("large"),
    )


def normalize_existing(spark, sf_dir):
    deals = views.fact_deals(spark, sf_dir).select(
        F.lit("deal").alias("kind"), "id",
        F.when(~F.col("deal_stage").rlike("^[A-Z]"), p.init_cap(F.col("deal_stage")))
        .otherwise(F.col("deal_stage")).alias("value"),
    )
    interactions = views.fact_interactions(spark, sf_dir).select(
        F.lit("interaction").alias("kind"), "id", F.lower("sentiment").alias("value")
    )
    return deals.unionByName(interactions)


def init_cap(spark, sf_dir):
    stages = F.concat_ws(" - ", F.upper("deal_stage"), F.upper("lead_source"))
    return views.fact_deals(spark, sf_dir).select("id", p.init_cap(stages).alias("label"))


def account_search(spark, sf_dir):
    hit = p.has_text(F.coalesce("account_name", F.lit("")), "machin") | p.has_text(F.coalesce("industry", F.lit("")), "machin")
    return views.dim_account(spark, sf_dir).where(hit).select("id", "account_name", "industry")


def currency_label(spark, sf_dir):
    whole = F.floor(F.col("o_totalprice"))
    value = F.when(F.col("o_orderkey") % 3 == 0, whole * 1000).when(F.col("o_orderkey") % 3 == 1, whole % 1000).otherwise(whole * 0)
    rounded = F.when(value >= 1_000_000, value - value % 100_000).when(value >= 1000, value - value % 1000).otherwise(value)
    return views.table(spark, sf_dir, "orders").select("o_orderkey", p.currency_label(rounded).alias("label"))


# ------------------------------------------------------------------ bronze
def bronze_typed(spark, sf_dir):
    raw = views.transcripts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("raw_transcript"))
    table = views.fact_deals(spark, sf_dir).select((-F.col("id") - 1).alias("id"), "deal_name")
    return bronze_io.with_data_type(union_all([raw, table])).select("id", "data_type")


def bronze_append(spark, sf_dir):
    """Bronze rows of a CRM batch, as they are appended."""
    return bronze_io.bronze_rows(batches.crm_batch(spark, sf_dir), "salesforce")


# ------------------------------------------------------------------ mapping
def source_family(spark, sf_dir):
    return batches.crm_batch(spark, sf_dir).select("seq", mapping.source_family(F.col("source_name")).alias("family"))


def _crm(spark, sf_dir, table: str) -> DataFrame:
    return mapping.map_table(batches.crm_batch(spark, sf_dir), "crm", table, CARRY)


def map_crm_accounts(spark, sf_dir):
    return _crm(spark, sf_dir, "dim_account").drop("source_name")


def map_crm_contacts(spark, sf_dir):
    return _crm(spark, sf_dir, "dim_contact").drop("source_name")


def map_crm_deals(spark, sf_dir):
    return _crm(spark, sf_dir, "fact_deals").drop("source_name", "source_data")


def map_crm_interactions(spark, sf_dir):
    return _crm(spark, sf_dir, "fact_interactions").drop("source_name", "source_data")


def map_erp(spark, sf_dir):
    return mapping.map_table(batches.erp_batch(spark, sf_dir), "erp", "fact_transactions").drop("source_data")


def map_hrms(spark, sf_dir):
    return mapping.map_table(batches.hr_batch(spark, sf_dir), "hrms", "fact_hr_records").drop("source_data")


def map_hrms_departments(spark, sf_dir):
    return mapping.map_table(batches.hr_batch(spark, sf_dir), "hrms", "dim_department").distinct()


def unmapped_fields(spark, sf_dir):
    return mapping.unmapped_fields(batches.crm_batch(spark, sf_dir), "crm", "seq", CARRY)


def evolve_schema(spark, sf_dir):
    """The deals mapping with the routed new field filled in."""
    batch = batches.crm_batch(spark, sf_dir)
    evolution = mapping.evolve(["deal_priority", "preferred_time"], {"deal_priority": "silver.fact_deals"})
    rows = mapping.map_table(batch, "crm", "fact_deals", CARRY, evolution.added["fact_deals"])
    return rows.select("seq", "deal_name", "deal_priority")


def contact_identity(spark, sf_dir):
    batch = batches.crm_batch(spark, sf_dir).select(
        "seq", "account_name", F.when(F.col("seq") % 3 == 0, F.col("contact_name")).alias("contact_name"),
        F.when(F.col("seq") % 3 == 1, F.col("owner")).alias("person_name"),
    )
    return batch.select("seq", mapping.contact_identity(batch.columns).alias("contact_name"))


def mapping_preview(spark, sf_dir):
    return mapping.preview(batches.crm_batch(spark, sf_dir), "crm", CARRY)


def batch_accounts(spark, sf_dir):
    return mapping.batch_accounts(batches.crm_batch(spark, sf_dir))


def account_mismatch(spark, sf_dir):
    return mapping.other_accounts(batches.crm_batch(spark, sf_dir), "Customer#000000010")


def table_preview(spark, sf_dir):
    return mapping.table_preview(batches.crm_batch(spark, sf_dir), "seq")


def table_shape(spark, sf_dir):
    return mapping.table_shape(batches.crm_batch(spark, sf_dir))


# ------------------------------------------------------------------ merging
def last_non_null(spark, sf_dir):
    return merge.last_non_null(map_crm_accounts(spark, sf_dir), ["account_name"], "seq").drop("seq")


def merge_dim_account(spark, sf_dir):
    return merge.upsert(views.dim_account(spark, sf_dir), map_crm_accounts(spark, sf_dir), ["account_name"], "seq")


def merge_dim_contact(spark, sf_dir):
    current = views.dim_contact(spark, sf_dir)
    batch = map_crm_contacts(spark, sf_dir).select("seq", "contact_name", "account_name", "role", "title")
    renamed = batch.withColumn("contact_name", F.concat("contact_name", F.lit("-B")))
    return merge.upsert(current, renamed, ["contact_name", "account_name"], "seq")


def merge_fact_deals(spark, sf_dir):
    batch = map_crm_deals(spark, sf_dir).select("seq", "deal_name", "account_name", "deal_value", "deal_stage", "owner")
    current = views.fact_deals(spark, sf_dir).select("id", "deal_name", "account_name", "deal_value", "deal_stage", "vertical")
    return merge.merge_deals(current, batch, "seq")


def append_facts(spark, sf_dir):
    batch = map_crm_interactions(spark, sf_dir).select("account_name", "interaction_date", "sentiment", "interaction_type")
    return merge.append(views.fact_interactions(spark, sf_dir), batch)


def backfill_account_id(spark, sf_dir):
    facts = views.fact_deals(spark, sf_dir).select("id", "account_id", "account_name")
    return merge.backfill_account_id(facts, views.dim_account(spark, sf_dir))


# ------------------------------------------------------------------ identity
def resolve_accounts(spark, sf_dir):
    accounts = views.dim_account(spark, sf_dir)
    resolved, created = identity.resolve(batches.name_batch(spark, sf_dir), accounts)
    known = accounts.select("id", "account_name").unionByName(created)
    return resolved.join(known, F.col("account_id") == F.col("id")).select("name", "tier", "account_name")


def _matched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    names = batches.name_batch(spark, sf_dir)
    matched = identity.match_existing(identity.distinct_names(names), views.dim_account(spark, sf_dir))
    return names, matched.where("tier is not null")


def match_accounts(spark, sf_dir):
    return _matched(spark, sf_dir)[1].select("name", "account_id", "tier")


def account_source_map(spark, sf_dir):
    names, matched = _matched(spark, sf_dir)
    current = views.dim_account(spark, sf_dir).where(p.filled(F.col("account_name"))).select(
        F.col("id").alias("account_id"), F.lit("hubspot").alias("source"),
        F.col("account_name").alias("source_name"), F.concat(F.lit("h-"), F.col("id").cast("string")).alias("source_id"),
    )
    return identity.upsert_source_map(current, identity.source_map_rows(names, matched))


def seed_source_map(spark, sf_dir):
    accounts = views.dim_account(spark, sf_dir)
    current = accounts.where(F.col("vertical") == "Payments").select(
        F.col("id").alias("account_id"), F.lit("legacy").alias("source"), F.col("account_name").alias("source_name")
    )
    return identity.seed_source_map(accounts, current)


# ------------------------------------------------------------------ data quality
def dq_valid_deals(spark, sf_dir):
    return dq.split(views.fact_deals(spark, sf_dir), "fact_deals")[0].select("id", "deal_name", "account_name", "deal_value")


def dq_rejects(spark, sf_dir):
    _, rejects = dq.split(views.fact_deals(spark, sf_dir), "fact_deals")
    return rejects.select("id", "table_name", F.array_join("error_messages", "|").alias("errors"))


def dq_warnings(spark, sf_dir):
    deals = views.fact_deals(spark, sf_dir)
    return deals.select("id", F.array_join(rules.warnings("fact_deals", deals.columns), "|").alias("warnings"))


def completeness(spark, sf_dir):
    deals = views.fact_deals(spark, sf_dir)
    fields = [c for c in vocab.SILVER_COLUMNS["fact_deals"] if c in deals.columns]
    return deals.select("id", rules.completeness(["deal_name", "account_name"], fields).alias("score"))


def dq_summary(spark, sf_dir):
    return dq.summary(views.silver(spark, sf_dir))


def dq_fill_rates(spark, sf_dir):
    return dq.fill_rates(views.fact_deals(spark, sf_dir).drop("created_at", "updated_at"))


def dq_top_errors(spark, sf_dir):
    return dq.top_errors(views.fact_deals(spark, sf_dir), "fact_deals")


def dq_enum_distribution(spark, sf_dir):
    return dq.enum_distribution(views.fact_deals(spark, sf_dir))


def sales_relevance(spark, sf_dir):
    docs = spread(views.table(spark, sf_dir, "documents").select("doc_id", "text"))
    notes = views.transcripts(spark, sf_dir, spread).select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    return dq.text_relevance(docs.unionByName(notes)).select("doc_id", "hits", "is_relevant")


def batch_relevance(spark, sf_dir):
    return dq.batch_relevance(spread(batches.erp_batch(spark, sf_dir)))


SILVER_QUERIES = {
    f.__name__: f
    for f in [
        deal_value_parse, number_prefix, currency_clean, canonical_coerce, normalize_existing, init_cap,
        account_search, currency_label, bronze_typed, bronze_append, source_family, map_crm_accounts,
        map_crm_contacts, map_crm_deals, map_crm_interactions, map_erp, map_hrms, map_hrms_departments,
        unmapped_fields, evolve_schema, contact_identity, mapping_preview, batch_accounts, account_mismatch,
        table_preview, table_shape, last_non_null, merge_dim_account, merge_dim_contact, merge_fact_deals,
        append_facts, backfill_account_id, resolve_accounts, match_accounts, account_source_map,
        seed_source_map, dq_valid_deals, dq_rejects, dq_warnings, completeness, dq_summary, dq_fill_rates,
        dq_top_errors, dq_enum_distribution, sales_relevance, batch_relevance,
    ]
}
