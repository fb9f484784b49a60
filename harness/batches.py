"""Incoming batches, logs and questions derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harness.silver_views import customer_name, fact_deals, pick, table, transcripts

QUESTION_HEADS = [
    "hello ", "What did they discuss in the meeting? ", "How many open deals are at risk? ",
    "Summarize the call notes and the pipeline value. ", "Show all deals ",
]


def crm_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CRM export row per deal; every third customer under a new account name."""
    return fact_deals(spark, sf_dir).selectExpr(
        "id AS seq",
        f"{pick('id % 4', ['Salesforce', 'hubspot', ' Zoho_CRM ', 'unknown_sys'])} AS source_name",
        """CASE WHEN account_name = '' THEN '' WHEN bigint(substring(contact_name, 9, 20)) % 3 = 0
           THEN account_name || ' Holdings' ELSE account_name END AS account_name""",
        "IF(id % 4 <> 0, 'Industry ' || string(id % 9), NULL) AS industry",
        "geography",
        "IF(id % 3 <> 0, string(id * 1000), NULL) AS annual_revenue",
        "string(id % 5000) AS employee_count",
        "IF(id % 5 = 0, '', 'www.s' || string(id % 50) || '.example') AS website",
        "'Customer' AS account_type",
        "IF(id % 3 <> 0, 'Enterprise', NULL) AS segment",
        "contact_name",
        "'c' || string(id) || '@example.com' AS contact_email",
        "string(NULL) AS contact_phone",
        "'Title ' || string(id % 7) AS contact_title",
        f"{pick('id % 4', ['Primary Contact', 'Engineer', 'Buyer'])} AS contact_role",
        "IF(id % 2 = 0, deal_name, 'New deal ' || string(id % 1000)) AS deal_name",
        "IF(id % 2 = 0, '$' || deal_value || ' ', deal_value) AS deal_value",
        "deal_stage",
        "close_date",
        "probability || '%' AS probability",
        "'USD' AS currency",
        "'Product ' || string(id % 10) AS product_name",
        "'Owner ' || string(id % 12) AS owner",
        "IF(id % 6 <> 0, 'Call', NULL) AS last_interaction_type",
        "IF(id % 6 <> 0, close_date, NULL) AS last_interaction_date",
        "IF(id % 2 = 0, 'Positive', NULL) AS sentiment",
        "lead_source",
        "IF(id % 7 = 0, 'Level ' || string(id % 3), NULL) AS deal_priority",
    )


def erp_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS transaction_type",
        "string(CAST(l_extendedprice AS DECIMAL(15,2))) AS amount",
        "string(bigint(l_quantity)) AS quantity",
        "string(l_orderkey) AS invoice_number",
        "l_linestatus AS status",
        "'Part ' || string(l_partkey) AS product_name",
        "'Supplier#' || lpad(string(l_suppkey), 9, '0') AS account_name",
    )


def hr_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_name AS employee_name",
        "'Nation ' || string(s_nationkey) AS department",
        "'hire' AS record_type",
        "string(CAST(s_acctbal AS DECIMAL(15,2))) AS salary",
        "'Manager ' || string(s_nationkey % 4) AS manager",
    )


def name_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account spellings of the orders: as stored, upper case, with a suffix, and new companies."""
    name = customer_name("o_custkey")
    return table(spark, sf_dir, "orders").selectExpr(
        f"""CASE o_orderkey % 4 WHEN 0 THEN {name} WHEN 1 THEN upper({name}) WHEN 2 THEN {name} || ' Holdings'
            ELSE 'Newco ' || string(o_orderkey % 5) END AS name""",
        f"{pick('o_orderkey % 3', ['hubspot', 'salesforce'])} AS source",
        "o_orderkey AS seq",
    )


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records: every meeting note as a transcript payload."""
    return transcripts(spark, sf_dir).selectExpr(
        "doc_id AS id",
        "'notes' AS source",
        "'raw_transcript' AS data_type",
        "to_json(named_struct('raw_transcript', text)) AS raw_payload",
        "created_at",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations, opened by one of five phrases; one account per conversation."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").selectExpr(
        "conv_id",
        "turn",
        f"{customer_name('conv_id')} AS account_name",
        f"{pick('(conv_id * 3 + turn) % 5', QUESTION_HEADS)} || text AS question",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that fell back to silver, with the question that led to them."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "'Which ' || event_type || ' records moved in period ' || string(event_id % 50) || ' of the year?' AS question",
        """'SELECT count(*) FROM ' || CASE event_type WHEN 'view' THEN 'silver.fact_deals'
           WHEN 'click' THEN 'SILVER.dim_account' ELSE 'silver.fact_insights' END || ' t' ||
           CASE event_id % 5 WHEN 0 THEN ' JOIN silver.dim_contact c ON true'
           WHEN 1 THEN ' JOIN Silver.Fact_Deals d ON true' ELSE '' END AS sql_text""",
    )


def pending_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of proposals waiting for approval."""
    return table(spark, sf_dir, "region").selectExpr(
        "'Please answer: which error records moved in period ' || string(r_regionkey) || ' of the year' AS question",
        "'silver.dim_account,silver.' || IF(r_regionkey < 3, 'dim_contact', 'fact_insights') AS tables",
    )
