"""Dashboard reads over silver tables and marts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saleslake.functions.parsing import amount, filled, is_open, is_won, leading_number, same_text
from saleslake.operators.containment import counts_by_contained_name
from saleslake.operators.joins import fan_out_join, lookup_join, union_all
from saleslake.plans.marts import MARTS, Silver

RECENT = 20
FEED = 50


def accounts_overview(silver: Silver) -> DataFrame:
    """Every account with what is recorded under texts containing its name."""
    return counts_by_contained_name(
        silver["dim_account"], silver["dim_contact"], silver["fact_deals"], silver["fact_interactions"]
    )


def account_detail(silver: Silver, account_id: int) -> dict[str, DataFrame]:
    """One account with its contacts, deals and latest interactions and insights."""
    account = silver["dim_account"].where(F.col("id") == account_id)
    row = account.select("account_name").first()
    if row is None:
        raise LookupError(f"no account {account_id}")

    def of(table: str) -> DataFrame:
        if row.account_name is None:
            return silver[table].where(F.lit(False))
        return silver[table].where(F.contains(F.lower("account_name"), F.lit(row.account_name.lower())))

    newest = F.desc("id")
    return {
        "account": account,
        "contacts": of("dim_contact"),
        "deals": of("fact_deals"),
        "interactions": of("fact_interactions").orderBy(newest).limit(RECENT),
        "insights": of("fact_insights").orderBy(newest).limit(RECENT),
    }


def pipeline_by_stage(silver: Silver) -> DataFrame:
    """Deals and value per stage, blank stages as Unknown.

    Values are read the way the pipeline page reads them: by numeric prefix.
    """
    stage = F.when(filled(F.col("deal_stage")), F.col("deal_stage")).otherwise("Unknown")
    return (
        silver["fact_deals"]
        .groupBy(stage.alias("stage"))
        .agg(F.count(F.lit(1)).alias("deal_count"), _page_sum(F.col("deal_value")).alias("stage_value"))
    )


def pipeline_total(silver: Silver) -> DataFrame:
    """Value of all stages together, in one row."""
    return silver["fact_deals"].agg(F.coalesce(_page_sum(F.col("deal_value")), F.lit(0.0)).alias("total_value"))


def _page_sum(text: Column) -> Column:
    """Sum of numeric prefixes: exact in cents, and besides it the few numbers that no decimal holds."""
    number = leading_number(text)
    cents = number.try_cast("decimal(28,2)")
    beyond = F.sum(F.when(cents.isNull(), number))
    return F.sum(cents).cast("double") + F.coalesce(beyond, F.lit(0.0))


def insights_feed(silver: Silver, kind: str | None = None) -> DataFrame:
    """Latest fifty insights, optionally of one type."""
    rows = silver["fact_insights"]
    return (rows if kind is None else rows.where(F.col("insight_type") == kind)).orderBy(F.desc("id")).limit(FEED)


def insight_types(silver: Silver) -> DataFrame:
    """Types that occur among all insights."""
    return silver["fact_insights"].where(filled(F.col("insight_type"))).select("insight_type").distinct()


def dashboard_stats(silver: Silver) -> DataFrame:
    """Five table counts and the value of all deals, in one row."""
    none = F.lit(None).cast("double")
    counts = [
        silver[table].agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("what"), "n", none.alias("v"))
        for table, label in [
            ("dim_account", "accounts"), ("dim_contact", "contacts"),
            ("fact_interactions", "interactions"), ("fact_insights", "insights"),
        ]
    ]
    deals = silver["fact_deals"].agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount(F.col("deal_value"))).cast("double").alias("v")
    ).select(F.lit("deals").alias("what"), "n", "v")
    named = ["accounts", "contacts", "deals", "interactions", "insights"]
    return union_all([*counts, deals]).agg(
        *[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in named],
        F.coalesce(F.max("v"), F.lit(0.0)).alias("total_deal_value"),
    )


def pipeline_share(silver: Silver, as_of: str) -> DataFrame:
    """Share of every pipeline stage in the open pipeline, in percent."""
    value = F.col("total_value").cast("decimal(28,2)")
    stages = MARTS["pipeline_health"](silver, as_of).groupBy("stage").agg(F.sum(value).cast("double").alias("total_value"))
    # One row a stage: the total is a window over a handful of rows.
    total = F.sum(value).over(Window.partitionBy()).cast("double")
    return stages.select("stage", "total_value", F.when(total != 0, F.col("total_value") / total * 100).otherwise(0.0).alias("share"))


def _risk_rank() -> Column:
    level = F.col("risk_level")
    return F.when(level == "High", 1).when(level == "Medium", 2).when(level == "Low", 3).otherwise(4)


VIEW_COLUMNS = {
    "revenue_summary": [
        "account_name", "industry", "geography", "total_deal_value", "won_value", "pipeline_value",
        "deal_count", "won_count", "avg_deal_size",
    ],
    "top_customers": [
        "rank", "account_name", "industry", "geography", "total_deal_value", "won_value",
        "open_deals", "contacts_count", "last_interaction",
    ],
    "pipeline_health": ["stage", "deal_count", "total_value", "avg_deal_size", "accounts_in_stage"],
    "account_360": [
        "account_name", "industry", "geography", "employee_count", "annual_revenue", "website",
        "total_deal_value", "open_deal_count", "won_deal_count", "contact_count",
        "interaction_count", "insight_count", "primary_contact", "latest_deal_stage", "latest_sentiment",
    ],
    "activity_summary": [
        "account_name", "total_interactions", "positive_interactions", "negative_interactions",
        "neutral_interactions", "total_insights", "competitive_flags",
    ],
    "deals_closing_soon": [
        "deal_name", "account_name", "deal_value", "deal_stage", "close_date", "probability",
        "contact_name", "days_until_close",
    ],
    "at_risk_accounts": [
        "account_name", "industry", "geography", "open_deal_count", "open_deal_value",
        "last_interaction_date", "days_since_last_contact", "last_sentiment", "risk_level",
    ],
}


def _view_order(mart: str) -> list[Column]:
    return {
        "revenue_summary": lambda: [F.desc("total_deal_value")],
        "top_customers": lambda: [F.asc("rank")],
        "pipeline_health": lambda: [F.desc("total_value")],
        "account_360": lambda: [F.desc("total_deal_value")],
        "activity_summary": lambda: [F.desc("total_interactions")],
        "deals_closing_soon": lambda: [F.asc_nulls_last("days_until_close")],
        "at_risk_accounts": lambda: [_risk_rank(), F.desc_nulls_first("days_since_last_contact")],
    }[mart]()


def mart_view(mart: str, rows: DataFrame) -> DataFrame:
    """The columns a mart page shows, in its order."""
    return rows.select(*VIEW_COLUMNS[mart]).orderBy(*_view_order(mart))


def schema_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables, columns, types and row counts."""
    spark: SparkSession = next(iter(tables.values())).sparkSession
    columns = spark.createDataFrame(
        [(t, i, n, k) for t, df in tables.items() for i, (n, k) in enumerate(df.dtypes)],
        "table_name string, position int, column_name string, data_type string",
    )
    counts = union_all(
        [df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(t)) for t, df in tables.items()]
    )
    return columns.join(counts, "table_name")


# ------------------------------------------------------------------ requests
@dataclass
class Request:
    """What to measure, by what, over which rows."""

    metrics: list[str]
    group_by: list[str] = field(default_factory=list)
    filters: dict[str, object] = field(default_factory=dict)
    limit: int | None = 100
    table: str = "fact_deals"


#: Metrics that every table has, and those of one table; ``name:column`` takes one column.
_ANY_METRICS = {
    "row_count": lambda column: F.count(F.lit(1)),
    "filled": lambda column: F.count_if(filled(F.col(column).cast("string"))),
    "distinct": lambda column: F.count_distinct(column),
    "earliest": lambda column: F.min(column),
    "latest": lambda column: F.max(column),
    "total": lambda column: F.coalesce(F.sum(amount(F.col(column).cast("string"))).cast("double"), F.lit(0.0)),
}
#: Attributes that a fact takes from its account where it has no column of that name.
_ACCOUNT_DIMENSIONS = ["industry", "geography", "vertical", "annual_revenue", "employee_count", "website", "segment", "account_type"]


def answer_request(silver: dict[str, DataFrame], request: Request) -> DataFrame:
    """Answer a request over any silver table.

    Dimensions and filters are columns of the table or, for facts, attributes of the account (as ``account_<name>`` too).
    Facts without an account id are spread over the tasks of that join. Metrics are those of deals or ``name:column`` of ``row_count``, ``filled``, ``distinct``,
    ``earliest``, ``latest`` and ``total``; the result's columns replace the colon by an underscore."""
    rows = silver[request.table]
    asked = [*request.group_by, *request.filters]
    plain = {n.removeprefix("account_"): n for n in asked if n not in rows.columns and n.removeprefix("account_") in _ACCOUNT_DIMENSIONS}
    unknown = [n for n in asked if n not in rows.columns and n not in plain.values()]
    if unknown or (plain and "account_id" not in rows.columns):
        raise LookupError(f"{request.table} has no dimension {', '.join(unknown or plain.values())}")
    if plain:
        accounts = silver["dim_account"].select(F.col("id").alias("_account"), *[F.col(c).alias(n) for c, n in plain.items()])
        rows = lookup_join(rows, accounts, "account_id", "_account", F.xxhash64("id"))
    metrics = request.metrics
    named = {m: m.replace(":", "_") for m in metrics}
    own = [m for m in metrics if m.split(":")[0] not in _ANY_METRICS]
    if own and request.table != "fact_deals":
        raise LookupError(f"{request.table} has no metric {', '.join(own)}")
    for name, wanted in request.filters.items():
        rows = rows.where(F.col(name).isin(*(wanted if isinstance(wanted, (list, tuple)) else [wanted])))
    if not metrics:
        return semantic_query(rows, Request([], request.group_by, {}, request.limit))
    measures = [(_metric(m) if m in own else _ANY_METRICS[m.split(":")[0]](m.partition(":")[2])).alias(named[m]) for m in metrics]
    answer = rows.groupBy(*request.group_by).agg(*measures)
    return answer if request.limit is None else answer.orderBy(F.desc(named[metrics[0]]), *request.group_by).limit(request.limit)


def _metric(name: str) -> Column:
    value, stage = amount(F.col("deal_value")), F.col("deal_stage")
    return {
        "total_deal_value": lambda: F.coalesce(F.sum(value).cast("double"), F.lit(0.0)),
        "won_value": lambda: F.coalesce(F.sum(F.when(is_won(stage), value)).cast("double"), F.lit(0.0)),
        "pipeline_value": lambda: F.coalesce(F.sum(F.when(is_open(stage), value)).cast("double"), F.lit(0.0)),
        "deal_count": lambda: F.count(F.lit(1)),
        "won_count": lambda: F.count_if(is_won(stage)),
        "ai_influenced_count": lambda: F.count_if(same_text(F.col("ai_influenced"), "yes")),
    }[name]()


def semantic_query(deals: DataFrame, request: Request) -> DataFrame:
    """Answer a request over the deals; without metrics, the newest rows of the dimensions."""
    rows = deals
    for name, wanted in request.filters.items():
        allowed = wanted if isinstance(wanted, (list, tuple)) else [wanted]
        rows = rows.where(F.col(name).isin(*allowed))
    if not request.metrics:
        newest = rows.orderBy(F.desc("id")) if request.limit is not None else rows
        newest = newest.limit(request.limit) if request.limit is not None else newest
        return newest.select(*request.group_by) if request.group_by else newest
    answer = rows.groupBy(*request.group_by).agg(*[_metric(m).alias(m) for m in request.metrics])
    if request.limit is None:
        return answer
    return answer.orderBy(F.desc(request.metrics[0]), *request.group_by).limit(request.limit)


def mart_then_detail(requests: DataFrame, mart: DataFrame, detail: DataFrame) -> DataFrame:
    """Rows of the mart per requested account; detail rows where the mart has none.

    Both inputs carry ``account_name`` and ``answer``; fallback rows are flagged.
    """
    wanted = requests.select("account_name").distinct()
    from_mart = wanted.join(mart.select("account_name", "answer"), "account_name").withColumn("fallback_used", F.lit(False))
    missing = wanted.join(mart.select("account_name").distinct(), "account_name", "left_anti")
    rows = fan_out_join(detail.select("account_name", "answer"), missing, ["account_name"], "answer", how="inner")
    from_detail = rows.withColumn("fallback_used", F.lit(True))
    return from_mart.unionByName(from_detail)

