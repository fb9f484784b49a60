"""The state of a lake after loads: batches go through bronze, mapping, validation, identity, merges and marts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harness import batches, silver_views as views
from saleslake.plans.ingest import ingest_structured, read_silver
from saleslake.session import shared_dir


def _lake(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lake-{uuid.uuid4().hex}"


def _load(spark: SparkSession, lake: str, batch: DataFrame, source: str, batch_id: str, **options) -> dict[str, DataFrame]:
    ingest_structured(spark, batch, source, batch_id, lake, views.AS_OF, force=True, **options)
    return read_silver(spark, lake)


def load_erp(spark, sf_dir):
    """Transactions after an ERP batch, each with its account."""
    batch = batches.erp_batch(spark, sf_dir).withColumn("seq", F.monotonically_increasing_id())
    silver = _load(spark, _lake(spark), batch, "sap", "erp-1")
    accounts = silver["dim_account"].select(F.col("id").alias("account_id"), F.col("account_name").alias("linked_account"))
    return silver["fact_transactions"].join(accounts, "account_id", "left").select(
        "transaction_type", "amount", "quantity", "reference_id", "status", "product_name", "account_name", "linked_account")


def load_hrms(spark, sf_dir):
    """HR records after an HR batch, each with the head of its department."""
    batch = batches.hr_batch(spark, sf_dir).withColumn("seq", F.monotonically_increasing_id())
    silver = _load(spark, _lake(spark), batch, "workday", "hr-1")
    heads = silver["dim_department"].select(F.col("name").alias("department"), "head")
    return silver["fact_hr_records"].join(heads, "department", "left").select("record_type", "employee_name", "department", "salary", "manager", "head")


def _crm(spark, sf_dir) -> DataFrame:
    """The deals of the CRM batch that have all that a merge needs."""
    return batches.crm_batch(spark, sf_dir).where("deal_name <> '' AND account_name <> '' AND deal_value RLIKE '^[0-9]+[.][0-9]+$'").select(
        "seq", "account_name", "contact_name", "contact_email", "contact_title", "deal_name", "deal_value", "deal_stage", "owner", "lead_source", "deal_priority")


def load_crm_columns(spark, sf_dir):
    """Contacts after a CRM batch, with every column that the field map names."""
    return _load(spark, _lake(spark), _crm(spark, sf_dir), "salesforce", "crm-1")["dim_contact"].select("contact_name", "account_name", "email", "title")


def evolve_second_batch(spark, sf_dir):
    """Deals after two batches: the first brings a new column, the second, without saying where it goes, more values of it."""
    lake, batch = _lake(spark), _crm(spark, sf_dir)
    _load(spark, lake, batch.where("seq % 3 <> 0"), "salesforce", "crm-1", routing={"deal_priority": "fact_deals"})
    silver = _load(spark, lake, batch.where("seq % 3 = 0").withColumn("deal_stage", F.lit("Negotiation")), "salesforce", "crm-2")
    return silver["fact_deals"].select("deal_name", "account_name", "deal_value", "deal_stage", "owner", "lead_source", "deal_priority")


LOAD_QUERIES = {f.__name__: f for f in [load_erp, load_hrms, load_crm_columns, evolve_second_batch]}
