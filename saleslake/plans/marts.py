"""The fifteen gold marts.

Every builder takes the silver tables as a dict of DataFrames and the reporting day, and
returns one DataFrame. Sums run over DECIMAL(18,2) and leave as DOUBLE. Where a mart needs
account attributes, deals are aggregated per account first, so the join with the account
dimension moves sums instead of deals and a very large account costs one row per group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslake.functions.parsing import (
    amount, as_of_date, days_between, filled, has_text, is_closed, is_lost, is_open, is_won,
    iso_date, name_key, percent, same_text,
)
from saleslake.operators.joins import fan_out_join, lookup_join
from saleslake.operators.ranking import number_rows

Silver = Mapping[str, DataFrame]


# ------------------------------------------------------------------ shared measures
#: Columns of deals that marts group or filter by.
DEAL_KEYS = [
    "account_id", "account_name", "geography", "vertical", "horizontal", "engagement_model", "deal_stage",
    "opportunity_stage", "salesperson", "ai_influenced", "business_type", "lead_source",
]
#: Sums over deals from which the marts are finished: rows, rows with an id, with an amount, their amount; days to the
#: close date and the deals that have one; for the others the day of creation.
DEAL_SUMS = ["_rows", "_ids", "_parsed", "_amount", "_close_deals", "_close_days", "_undated_deals", "_undated_days"]
_EPOCH = "1970-01-01"


def deal_measures(deals: DataFrame, *extra: str) -> DataFrame:
    """Every deal as its keys and its share of the sums."""
    value, created = amount(F.col("deal_value")), F.col("created_at").cast("date")
    closing = days_between(iso_date(F.col("close_date")), created)
    undated = F.when(iso_date(F.col("close_date")).isNull(), days_between(created, as_of_date(_EPOCH)))
    sums = [
        F.lit(1).cast("bigint"), F.col("id").isNotNull().cast("bigint"), value.isNotNull().cast("bigint"), value,
        closing.isNotNull().cast("bigint"), closing, undated.isNotNull().cast("bigint"), undated,
    ]
    return deals.select(*DEAL_KEYS, *extra, *[s.alias(n) for s, n in zip(sums, DEAL_SUMS)])


def deal_state(deals: DataFrame, *extra: str) -> DataFrame:
    """The sums for every combination of keys. Marts take it in place of the deals (as ``deal_state``)."""
    return deal_measures(deals, *extra).groupBy(*DEAL_KEYS, *extra).agg(*[F.sum(c).alias(c) for c in DEAL_SUMS])


def interaction_state(interactions: DataFrame, *extra: str) -> DataFrame:
    """Interactions counted by what the marts look at."""
    return interactions.groupBy("account_id", "sentiment", "interaction_date", *extra).agg(F.count(F.lit(1)).alias("_rows"))


def _count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("_rows"))), F.lit(0))


def _value_where(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("_amount")))


def _deal_state() -> list[Column]:
    """Additive state from which every deal measure can be finished."""
    stage, ai = F.col("deal_stage"), same_text(F.col("ai_influenced"), "yes")
    return [
        F.sum("_ids").alias("deals"),
        _count_where(is_won(stage)).alias("won"),
        _count_where(is_closed(stage)).alias("closed"),
        _count_where(ai).alias("ai_deals"),
        F.sum("_parsed").alias("parsed"),
        F.sum("_amount").alias("value"),
        _value_where(is_won(stage)).alias("value_won"),
        _value_where(is_open(stage)).alias("value_open"),
        _value_where(ai).alias("value_ai"),
    ]


_STATE = ["deals", "won", "closed", "ai_deals", "parsed", "value", "value_won", "value_open", "value_ai"]


def _merge_state() -> list[Column]:
    return [F.sum(c).alias(c) for c in _STATE]


def _money(column: str | Column) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("double"), F.lit(0.0))


def _mean(total: Column, count: Column) -> Column:
    return F.coalesce(total.cast("double") / F.nullif(count, F.lit(0)), F.lit(0.0))


_MEASURES: dict[str, Callable[[], Column]] = {
    "total_deal_value": lambda: _money("value"),
    "won_value": lambda: _money("value_won"),
    "pipeline_value": lambda: _money("value_open"),
    "ai_influenced_value": lambda: _money("value_ai"),
    "deal_count": lambda: F.col("deals"),
    "won_count": lambda: F.col("won"),
    "ai_influenced_count": lambda: F.col("ai_deals"),
    "avg_deal_size": lambda: _mean(F.col("value"), F.col("parsed")),
    "win_rate": lambda: percent(F.col("won"), F.col("closed")),
}


def _pick(*names: str) -> list[Column]:
    return [_MEASURES[n]().alias(n) for n in names]


def _deals(silver: Silver) -> DataFrame:
    return silver["deal_state"] if "deal_state" in silver else deal_measures(silver["fact_deals"])


def _interactions(silver: Silver) -> DataFrame:
    if "interaction_state" in silver:
        return silver["interaction_state"]
    return silver["fact_interactions"].select("account_id", "sentiment", "interaction_date", F.lit(1).cast("bigint").alias("_rows"))


def _named_deals(silver: Silver) -> DataFrame:
    return _deals(silver).where(filled(F.col("account_name")))


def _deals_per_account(silver: Silver, *extra: str) -> DataFrame:
    """Deal state per account and attribute combination, with the account's own attributes."""
    keys = ["account_id", "account_name", "geography", "vertical", *extra]
    state = _named_deals(silver).groupBy(*keys).agg(*_deal_state())
    accounts = silver["dim_account"].select(
        F.col("id").alias("dim_id"),
        F.col("account_name").alias("dim_name"),
        F.col("industry").alias("dim_industry"),
        F.col("geography").alias("dim_geography"),
        F.col("vertical").alias("dim_vertical"),
    )
    return lookup_join(state, accounts, "account_id", "dim_id", F.col("account_name"))


def _named_accounts(silver: Silver) -> DataFrame:
    return silver["dim_account"].where(filled(F.col("account_name")))


def _with_id(df: DataFrame) -> DataFrame:
    return df.where(F.col("account_id").isNotNull())


def _is_lead_contact() -> Column:
    return has_text(F.col("role"), "primary") | has_text(F.col("role"), "decision")


# ------------------------------------------------------------------ the marts
def revenue_summary(silver: Silver, as_of: str) -> DataFrame:
    """Total revenue exposure per account and business dimension."""
    return (
        _deals_per_account(silver, "horizontal", "engagement_model")
        .groupBy(
            F.coalesce("dim_name", "account_name").alias("account_name"),
            F.col("dim_industry").alias("industry"),
            F.coalesce("dim_geography", "geography").alias("geography"),
            F.coalesce("dim_vertical", "vertical").alias("vertical"),
            "horizontal",
            "engagement_model",
        )
        .agg(*_merge_state())
        .select(
            "account_name", "industry", "geography", "vertical", "horizontal", "engagement_model",
            *_pick(
                "total_deal_value", "won_value", "pipeline_value", "ai_influenced_value",
                "deal_count", "won_count", "ai_influenced_count", "avg_deal_size",
            ),
        )
    )


def top_customers(silver: Silver, as_of: str) -> DataFrame:
    """Accounts ranked by total deal value; ties go by name."""
    by_account = (
        _deals_per_account(silver)
        .groupBy(F.coalesce("dim_name", "account_name").alias("account_name"))
        .agg(
            F.max("dim_industry").alias("industry"),
            F.max(F.coalesce("dim_geography", "geography")).alias("geography"),
            F.max(F.coalesce("dim_vertical", "vertical")).alias("vertical"),
            *_merge_state(),
        )
        .where(filled(F.col("account_name")))
        .withColumn("key", name_key(F.col("account_name")))
    )
    first_id = (
        silver["dim_account"].groupBy(name_key(F.col("account_name")).alias("key")).agg(F.min("id").alias("dim_id"))
    )
    last_contact = (
        _with_id(_interactions(silver))
        .groupBy(F.col("account_id").alias("dim_id"))
        .agg(F.max("interaction_date").alias("last_interaction"))
    )
    contacts = (
        silver["dim_contact"]
        .groupBy(name_key(F.col("account_name")).alias("key"))
        .agg(F.count(F.lit(1)).alias("contacts"))
    )
    people = first_id.join(last_contact, "dim_id", "left").select("key", "last_interaction")
    rows = (
        by_account.join(people, "key", "left")
        .join(contacts, "key", "left")
        .select(
            "account_name", "industry", "geography", "vertical",
            *_pick("total_deal_value", "won_value"),
            (F.col("deals") - F.col("won")).alias("open_deals"),
            F.coalesce("contacts", F.lit(0)).alias("contacts_count"),
            "last_interaction",
        )
    )
    return number_rows(rows, [F.desc("total_deal_value"), F.asc("account_name")])


def pipeline_health(silver: Silver, as_of: str) -> DataFrame:
    """Open deals by stage and business dimension."""
    return (
        _deals(silver)
        .where(filled(F.col("deal_stage")) & is_open(F.col("deal_stage")))
        .groupBy(F.col("deal_stage").alias("stage"), "opportunity_stage", "vertical", "horizontal")
        .agg(
            F.sum("_rows").alias("deal_count"),
            _money(F.sum("_amount")).alias("total_value"),
            _mean(F.sum("_amount"), F.sum("_parsed")).alias("avg_deal_size"),
            F.count_distinct(F.coalesce(F.col("account_id").cast("string"), "account_name")).alias("accounts_in_stage"),
        )
    )


def account_360(silver: Silver, as_of: str) -> DataFrame:
    """One wide row per account."""
    stage = F.col("deal_stage")
    deals = (
        _with_id(_deals(silver))
        .groupBy(F.col("account_id").alias("id"))
        .agg(
            F.sum("_amount").alias("value"),
            _count_where(is_open(stage)).alias("open_deal_count"),
            _count_where(is_won(stage)).alias("won_deal_count"),
            _count_where(same_text(F.col("ai_influenced"), "yes")).alias("ai_influenced_count"),
            F.max(stage).alias("latest_deal_stage"),
        )
    )
    interactions = (
        _with_id(_interactions(silver))
        .groupBy(F.col("account_id").alias("id"))
        .agg(F.sum("_rows").alias("interaction_count"), F.max("sentiment").alias("latest_sentiment"))
    )
    insights = (
        _with_id(silver["fact_insights"])
        .groupBy(F.col("account_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("insight_count"))
    )
    contacts = (
        silver["dim_contact"]
        .groupBy(name_key(F.col("account_name")).alias("key"))
        .agg(
            F.count(F.lit(1)).alias("contact_count"),
            F.max(F.when(_is_lead_contact(), F.col("contact_name"))).alias("primary_contact"),
        )
    )
    counts = [
        "open_deal_count", "won_deal_count", "ai_influenced_count", "contact_count",
        "interaction_count", "insight_count",
    ]
    return (
        _named_accounts(silver)
        .withColumn("key", name_key(F.col("account_name")))
        .join(deals, "id", "left")
        .join(interactions, "id", "left")
        .join(insights, "id", "left")
        .join(contacts, "key", "left")
        .select(
            "account_name", "industry", "geography", "vertical", "employee_count",
            "annual_revenue", "website",
            _money("value").alias("total_deal_value"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
            "primary_contact", "latest_deal_stage", "latest_sentiment",
        )
    )


def activity_summary(silver: Silver, as_of: str) -> DataFrame:
    """Interactions, sentiment and insights of every account that has any."""
    mood = F.col("sentiment")
    positive, negative = has_text(mood, "positive"), has_text(mood, "negative")
    interactions = (
        _with_id(_interactions(silver))
        .groupBy(F.col("account_id").alias("id"))
        .agg(
            F.sum("_rows").alias("total_interactions"),
            _count_where(positive).alias("positive_interactions"),
            _count_where(negative).alias("negative_interactions"),
            _count_where(has_text(mood, "neutral") | mood.isNull()).alias("neutral_interactions"),
            (F.sum(F.when(positive, F.col("_rows")).when(negative, -F.col("_rows")).otherwise(0)) / F.sum("_rows")).alias("avg_sentiment_score"),
        )
    )
    insights = (
        _with_id(silver["fact_insights"])
        .groupBy(F.col("account_id").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("total_insights"),
            F.count_if(has_text(F.col("insight_type"), "competitive")).alias("competitive_flags"),
        )
    )
    counts = [
        "total_interactions", "positive_interactions", "negative_interactions",
        "neutral_interactions", "total_insights", "competitive_flags",
    ]
    return (
        _named_accounts(silver)
        .join(interactions.join(insights, "id", "full"), "id")
        .select(
            "account_name", "vertical",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
            "avg_sentiment_score",
        )
    )


def deals_closing_soon(silver: Silver, as_of: str) -> DataFrame:
    """Open deals that carry any close date, one row per deal and lead contact."""
    deals = silver["fact_deals"].where(
        is_open(F.col("deal_stage"))
        & F.col("close_date").isNotNull()
        & filled(F.col("deal_name"))
        & filled(F.col("account_name"))
    )
    accounts = silver["dim_account"].select(
        F.col("id").alias("dim_id"),
        F.col("account_name").alias("dim_name"),
        F.col("vertical").alias("dim_vertical"),
    )
    leads = silver["dim_contact"].where(_is_lead_contact()).select(
        name_key(F.col("account_name")).alias("key"), F.col("contact_name").alias("lead_name")
    )
    # Names and contacts are looked up once per account reference, not once per deal.
    references = deals.select("account_id", "account_name").distinct()
    looked_up = (
        lookup_join(references, accounts, "account_id", "dim_id", F.col("account_name"))
        .withColumn("shown_name", F.coalesce("dim_name", "account_name"))
        .withColumn("key", name_key(F.col("shown_name")))
        .join(leads, "key", "left")
        .select("account_id", "account_name", "shown_name", "dim_vertical", "lead_name")
    )
    return fan_out_join(deals, looked_up, ["account_id", "account_name"], "id").select(
        "deal_name",
        F.col("shown_name").alias("account_name"),
        "deal_value", "deal_stage", "opportunity_stage",
        F.coalesce("dim_vertical", "vertical").alias("vertical"),
        "horizontal", "engagement_model", "ai_influenced", "salesperson", "close_date", "probability",
        F.coalesce("lead_name", "contact_name").alias("contact_name"),
        days_between(iso_date(F.col("close_date")), as_of_date(as_of)).alias("days_until_close"),
    )


def at_risk_accounts(silver: Silver, as_of: str) -> DataFrame:
    """Accounts with open deals, by how long ago they were last contacted."""
    open_deals = (
        _with_id(_deals(silver))
        .where(is_open(F.col("deal_stage")))
        .groupBy(F.col("account_id").alias("id"))
        .agg(F.sum("_rows").alias("open_deal_count"), F.sum("_amount").alias("value"))
    )
    contact = (
        _with_id(_interactions(silver))
        .groupBy(F.col("account_id").alias("id"))
        .agg(F.max("interaction_date").alias("last_interaction_date"), F.max("sentiment").alias("last_sentiment"))
    )
    days = F.col("days_since_last_contact")
    return (
        _named_accounts(silver)
        .join(open_deals, "id")
        .join(contact, "id", "left")
        .withColumn(
            "days_since_last_contact",
            days_between(as_of_date(as_of), iso_date(F.col("last_interaction_date"))),
        )
        .select(
            "account_name", "industry", "geography", "vertical", "open_deal_count",
            _money("value").alias("open_deal_value"),
            "last_interaction_date", "days_since_last_contact", "last_sentiment",
            F.when(F.col("last_interaction_date").isNull() | (days > 60), "High")
            .when(days > 30, "Medium")
            .otherwise("Low")
            .alias("risk_level"),
        )
    )


def salesperson_performance(silver: Silver, as_of: str) -> DataFrame:
    """Results per sales representative."""
    won = is_won(F.col("deal_stage"))
    days, dated = F.sum(F.when(won, F.col("_close_days"))), F.sum(F.when(won, F.col("_close_deals")))
    return (
        _deals(silver)
        .where(filled(F.col("salesperson")))
        .groupBy("salesperson", "vertical", "horizontal")
        .agg(*_deal_state(), (days / F.nullif(dated, F.lit(0))).alias("avg_close_days"))
        .select(
            "salesperson", "vertical", "horizontal",
            *_pick(
                "total_deal_value", "won_value", "pipeline_value", "deal_count", "won_count",
                "ai_influenced_count", "avg_deal_size",
            ),
            "avg_close_days",
        )
    )


def vertical_revenue(silver: Silver, as_of: str) -> DataFrame:
    """Revenue by vertical."""
    return (
        _deals_per_account(silver, "horizontal", "engagement_model")
        .groupBy(
            F.coalesce("dim_vertical", "vertical", F.lit("Unassigned")).alias("vertical"),
            "horizontal",
            F.coalesce("dim_geography", "geography").alias("geography"),
            "engagement_model",
        )
        .agg(*_merge_state())
        .select(
            "vertical", "horizontal", "geography", "engagement_model",
            *_pick(
                "total_deal_value", "won_value", "pipeline_value", "ai_influenced_value",
                "deal_count", "won_count", "avg_deal_size",
            ),
        )
    )


def ai_influence_summary(silver: Silver, as_of: str) -> DataFrame:
    """How much revenue is marked as AI-influenced."""
    return (
        _named_deals(silver)
        .withColumn("influence", F.coalesce("ai_influenced", F.lit("Unknown")))
        .groupBy("influence", "vertical", "horizontal", "business_type")
        .agg(*_deal_state())
        .select(
            F.col("influence").alias("ai_influenced"), "vertical", "horizontal", "business_type",
            *_pick(
                "total_deal_value", "won_value", "pipeline_value", "deal_count", "won_count",
                "avg_deal_size",
            ),
        )
    )


def win_loss_analysis(silver: Silver, as_of: str) -> DataFrame:
    """Win rate and sizes of closed deals."""
    stage = F.col("deal_stage")
    sums = {c: [F.sum(F.when(kind(stage), F.col(c))) for kind in (is_won, is_lost)] for c in ("_amount", "_parsed")}
    (won, lost), (won_parsed, lost_parsed) = sums["_amount"], [F.coalesce(n, F.lit(0)) for n in sums["_parsed"]]
    return (
        _deals(silver)
        .where(is_closed(stage))
        .groupBy("vertical", "horizontal", "salesperson")
        .agg(
            F.sum("_rows").alias("total_closed"),
            _count_where(is_won(stage)).alias("won_count"),
            _count_where(is_lost(stage)).alias("lost_count"),
            _money(won).alias("won_value"),
            _money(lost).alias("lost_value"),
            _mean(won, won_parsed).alias("avg_won_deal_size"),
            _mean(lost, lost_parsed).alias("avg_lost_deal_size"),
        )
        .withColumn("win_rate", percent(F.col("won_count"), F.col("total_closed")))
    )


def deal_velocity(silver: Silver, as_of: str) -> DataFrame:
    """Mean age of deals per stage: creation to close date, else to the reporting day."""
    today = days_between(as_of_date(as_of), as_of_date(_EPOCH))
    days = F.coalesce(F.sum("_close_days"), F.lit(0)) + today * F.sum("_undated_deals") - F.coalesce(F.sum("_undated_days"), F.lit(0))
    return (
        _deals(silver)
        .where(filled(F.col("deal_stage")))
        .groupBy("deal_stage", "vertical", "engagement_model")
        .agg(
            F.sum("_rows").alias("deal_count"),
            (days / F.nullif(F.sum("_close_deals") + F.sum("_undated_deals"), F.lit(0))).alias("avg_days_in_stage"),
            _mean(F.sum("_amount"), F.sum("_parsed")).alias("avg_deal_value"),
            _money(F.sum("_amount")).alias("total_value"),
        )
    )


def geography_mix(silver: Silver, as_of: str) -> DataFrame:
    """Onshore and offshore revenue."""
    return (
        _deals_per_account(silver)
        .groupBy(
            F.coalesce("dim_geography", "geography", F.lit("Unknown")).alias("geography"),
            F.coalesce("dim_vertical", "vertical").alias("vertical"),
        )
        .agg(
            *_merge_state(),
            F.count_distinct(F.coalesce(F.col("account_id").cast("string"), "account_name")).alias("account_count"),
        )
        .select(
            "geography", "vertical",
            *_pick("total_deal_value", "won_value", "pipeline_value", "deal_count", "won_count"),
            "account_count",
        )
    )


def lead_source_effectiveness(silver: Silver, as_of: str) -> DataFrame:
    """Revenue and wins per lead source."""
    return (
        _named_deals(silver)
        .withColumn("source", F.coalesce("lead_source", F.lit("Unknown")))
        .groupBy("source", "vertical")
        .agg(*_deal_state())
        .select(
            F.col("source").alias("lead_source"), "vertical",
            *_pick("total_deal_value", "won_value", "deal_count", "won_count", "win_rate", "avg_deal_size"),
        )
    )


def stale_deals(silver: Silver, as_of: str) -> DataFrame:
    """Open deals by the days since they were last touched."""
    today = as_of_date(as_of)
    idle = days_between(today, F.col("updated_at").cast("date"))
    age = days_between(today, F.col("created_at").cast("date"))
    return (
        silver["fact_deals"]
        .where(is_open(F.col("deal_stage")) & F.col("deal_name").isNotNull())
        .select(
            "deal_name", "account_name", "deal_value", "deal_stage", "opportunity_stage", "vertical",
            "salesperson", "close_date",
            F.coalesce(idle, age).alias("days_since_update"),
            F.when(idle > 60, "Critical")
            .when(F.coalesce(idle, age) > 30, "Warning")
            .when(idle > 14, "Monitor")
            .otherwise("Active")
            .alias("staleness_level"),
        )
    )


Mart = Callable[[Silver, str], DataFrame]

MARTS: dict[str, Mart] = {
    builder.__name__: builder
    for builder in [
        revenue_summary, top_customers, pipeline_health, account_360, activity_summary,
        deals_closing_soon, at_risk_accounts, salesperson_performance, vertical_revenue,
        ai_influence_summary, win_loss_analysis, deal_velocity, geography_mix,
        lead_source_effectiveness, stale_deals,
    ]
}
