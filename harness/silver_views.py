"""Silver-shaped inputs derived from the driver's tables (see FIXTURES.md, section 3).

All of them read whole tables and none of them shuffles: account names are written
out of the customer key, which is how the customer table itself spells them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-03-01"
TODAY = f"DATE'{AS_OF}'"
VERTICALS = [
    "Mortgage & Lending", "Banking & Insurance", "Capital Market",
    "Higher Education", "Technology", "Payments",
]
GEOGRAPHIES = ["Onshore", "Offshore", "Both"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(expression: str, names: list[str]) -> str:
    """Name at position ``expression``; NULL beyond the list."""
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def customer_name(key: str) -> str:
    return f"'Customer#' || lpad(string({key}), 9, '0')"


def dim_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "CASE WHEN c_custkey % 97 = 0 THEN '' WHEN c_custkey % 89 = 0 THEN NULL ELSE c_name END AS account_name",
        "c_mktsegment AS industry",
        f"{pick('c_nationkey % 4', GEOGRAPHIES)} AS geography",
        f"{pick('c_custkey % 7', VERTICALS)} AS vertical",
        "string(CAST(c_acctbal AS DECIMAL(15,2))) AS annual_revenue",
        "string(c_custkey * 10) AS employee_count",
        "'www.c' || string(c_custkey) || '.example' AS website",
    )


def dim_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contact per customer and a second one for every fifth."""
    roles = pick("c_custkey % 4", ["Primary Contact", "decision_maker", "Engineer"])
    first = (
        "named_struct('id', c_custkey * 2, 'contact_name', 'Contact ' || string(c_custkey) || '-A', 'account_name', "
        "CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) ELSE ' ' || c_name || ' ' END, "
        f"'role', {roles})"
    )
    second = (
        "named_struct('id', c_custkey * 2 + 1, 'contact_name', 'Contact ' || string(c_custkey) || '-B', "
        "'account_name', c_name, 'role', 'Decision Maker')"
    )
    return table(spark, sf_dir, "customer").selectExpr(
        f"inline(CASE WHEN c_custkey % 5 = 0 THEN array({first}, {second}) ELSE array({first}) END)"
    )


def fact_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k").selectExpr(
        "k AS id",
        "CASE WHEN k % 11 <> 0 THEN o_custkey END AS account_id",
        f"CASE WHEN k % 101 = 0 THEN '' ELSE {customer_name('o_custkey')} END AS account_name",
        "CASE WHEN k % 53 = 0 THEN '' WHEN k % 59 = 0 THEN NULL ELSE 'Deal ' || string(k) END AS deal_name",
        """CASE k % 20 WHEN 0 THEN 'N/A' WHEN 1 THEN '-5' WHEN 2 THEN '1e5' WHEN 3 THEN NULL WHEN 4 THEN '1.2.3'
           ELSE string(CAST(o_totalprice AS DECIMAL(15,2))) END AS deal_value""",
        """CASE WHEN k % 37 = 0 THEN NULL WHEN k % 41 = 0 THEN '' WHEN k % 43 = 0 THEN 'Closed - No Decision'
           WHEN o_orderstatus = 'F' THEN CASE WHEN k % 3 = 0 THEN 'Closed Lost' WHEN k % 7 = 0 THEN 'closed won' ELSE 'Closed Won' END
           WHEN o_orderstatus = 'O' THEN CASE WHEN k % 2 = 0 THEN 'Negotiation' ELSE 'Proposal' END
           ELSE 'Discovery' END AS deal_stage""",
        "string(k % 101) AS probability",
        f"""CASE WHEN k % 15 = 0 THEN 'Q2 2025' WHEN k % 16 = 0 THEN NULL
            ELSE string(date_add({TODAY}, int(k % 200 - 60))) END AS close_date""",
        "'Contact ' || string(o_custkey) AS contact_name",
        f"{pick('k % 8', VERTICALS)} AS vertical",
        f"{pick('k % 4', ['AI & Data', 'Application Engineering', 'Digital Operations'])} AS horizontal",
        f"{pick('k % 5', ['T&M', 'Fixed', 'Retainers', 'Outcome-based'])} AS engagement_model",
        "'P' || string(k % 11) AS opportunity_stage",
        "CASE WHEN k % 9 = 0 THEN 'Yes' WHEN k % 3 = 0 THEN 'yes' WHEN k % 3 = 1 THEN 'no' END AS ai_influenced",
        f"{pick('k % 4', ['New Business', 'Existing Customer', 'Renewal'])} AS business_type",
        f"{pick('k % 6', ['Referral', 'Inbound', 'Conference', 'Cold Outreach', 'Account Mining'])} AS lead_source",
        "CASE WHEN k % 13 = 0 THEN '' WHEN k % 17 = 0 THEN NULL ELSE 'Rep ' || string(k % 25) END AS salesperson",
        f"{pick('k % 5', GEOGRAPHIES)} AS geography",
        f"timestamp(date_sub({TODAY}, int(k % 400))) AS created_at",
        f"CASE WHEN k % 23 <> 0 THEN timestamp(date_sub({TODAY}, int(k % 100))) END AS updated_at",
    )


def fact_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "CASE WHEN event_id % 29 <> 0 THEN user_id END AS account_id",
        f"{customer_name('user_id')} AS account_name",
        """CASE WHEN user_id % 31 = 0 THEN 'unknown'
           ELSE string(date_sub(date(ts), int(user_id % 90))) END AS interaction_date""",
        """CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'signup' THEN 'Very Positive'
           WHEN 'error' THEN 'negative' WHEN 'view' THEN 'neutral' END AS sentiment""",
    )


def fact_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id AS id",
        "CASE WHEN doc_id % 19 <> 0 THEN doc_id % 200 END AS account_id",
        f"{customer_name('doc_id % 200')} AS account_name",
        "CASE WHEN toxic = 1 THEN 'Competitive' WHEN quality = 1 THEN 'deal_signal' ELSE 'action_items' END AS insight_type",
        "CASE WHEN quality = 1 THEN '0.9' ELSE '0.5' END AS confidence",
        f"string(date_sub({TODAY}, int(doc_id % 60))) AS insight_date",
    )


def transcripts(
    spark: SparkSession, sf_dir: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """One meeting note per order; ``prepare`` sees the orders before their texts are written out."""
    lines = [
        "'Meeting with ' || CASE k % 40 WHEN 0 THEN 'Acme Corp' WHEN 10 THEN 'Globex Industries' "
        "WHEN 20 THEN 'Stark Systems' ELSE 'Initech Group' END || '.'",
        "'Participants: Ann Lee, Bob Stone'",
        "'[00:05] Ann Lee: budget of $' || string(k * 100 + 1000) || IF(k % 30 = 0, ' million', '') || ' for the migration.'",
        "'[00:' || string(k % 49 + 10) || '] Bob Stone: ' || CASE k % 50 "
        "WHEN 0 THEN 'we are ready to move forward, great and excellent and perfect.' "
        "WHEN 10 THEN 'there is a concern, a delay, a risk and an issue.' "
        "WHEN 20 THEN 'we will evaluate AWS and Snowflake.' ELSE 'the proposal needs work.' END",
        "IF(k % 20 = 0, 'Industry: Retail', 'Industry: Banking')",
        "'Expected close: 2024-06-30'",
        "IF(k % 70 = 0, 'Primary Contact: Carol King, Role: VP Data', NULL)",
        "IF(k % 25 = 0, 'Based in New York, with ' || string(k * 3 + 100) || ' employees and annual revenue of $1.5 billion', NULL)",
        "IF(k % 35 = 0, 'Deal: Migration ' || string(k), NULL)",
    ]
    orders = prepare(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    return orders.withColumnRenamed("o_orderkey", "k").selectExpr(
        "k AS doc_id",
        "'note_' || string(k) || '.txt' AS filename",
        f"{customer_name('o_custkey')} AS account_name",
        f"concat_ws('\\n', {', '.join(lines)}) AS text",
        "o_orderdate AS created_at",
    )


_TABLES = {
    "dim_account": dim_account,
    "dim_contact": dim_contact,
    "fact_deals": fact_deals,
    "fact_interactions": fact_interactions,
    "fact_insights": fact_insights,
}


class SilverTables(Mapping[str, DataFrame]):
    """The five silver tables, opened when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._open = {name: lambda build=build: build(spark, sf_dir) for name, build in _TABLES.items()}
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._open[name]()
        return self._opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._open)

    def __len__(self) -> int:
        return len(self._open)


def silver(spark: SparkSession, sf_dir: str) -> SilverTables:
    return SilverTables(spark, sf_dir)
