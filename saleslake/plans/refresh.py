"""Building the marts of a lake."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslake.operators.joins import union_all
from saleslake.plans.marts import MARTS, Silver, deal_state, interaction_state
from saleslake.session import durable
from saleslake.sources.lake import PART, overwrite_parts, read_table, registry, replace_table

#: Additive states of facts, kept by the partitions of the fact they are summed from: table -> what marts know it as, how it is summed.
STATES = {"state/deals": ("deal_state", deal_state), "state/interactions": ("interaction_state", interaction_state)}


def follow(rows: DataFrame, lake: str, state: str) -> None:
    """Sum the partitions of a fact that a batch has rewritten, given with all their rows, and replace their states.

    Nothing is added to or taken from an older state, so a batch that runs again or broke off cannot count twice."""
    _, build = STATES[state]
    overwrite_parts(build(rows, PART), lake, state)


def with_states(spark: SparkSession, silver: Silver, lake: str) -> dict[str, DataFrame]:
    """The silver tables and, where the lake has them, the states of its facts."""
    known = registry(spark, lake)
    found = {name: read_table(spark, lake, state, known=known) for state, (name, _) in STATES.items()}
    return {**silver, **{name: rows for name, rows in found.items() if rows is not None}}


def write_marts(silver: Silver, as_of: str, lake: str) -> dict[str, int]:
    """Build every mart and replace the one before; returns the row counts.

    All are computed and kept before the first is replaced, so a failure among them leaves the old ones."""

    def build(name: str) -> DataFrame:
        return durable(MARTS[name](silver, as_of).withColumn("refreshed_at", F.current_timestamp()))

    def replace(name: str) -> int:
        replace_table(built[name], lake, f"gold/{name}")
        return built[name].count()

    # The marts are independent; a few at a time keep the cluster busy while small ones finish.
    with ThreadPoolExecutor(max_workers=4) as pool:
        built = dict(zip(MARTS, pool.map(build, MARTS)))
        return dict(zip(MARTS, pool.map(replace, MARTS)))


def refresh_all(silver: Silver, as_of: str, lake: str) -> dict[str, int]:
    """Rebuild all marts from silver tables; deals and interactions are scanned once for their states."""
    states = {"deal_state": durable(deal_state(silver["fact_deals"])), "interaction_state": durable(interaction_state(silver["fact_interactions"]))}
    return write_marts({**silver, **states}, as_of, lake)


def mart_row_counts(silver: Silver, as_of: str) -> DataFrame:
    """Rows each mart would have, without writing any."""
    return union_all(
        [
            build(silver, as_of).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("mart"), "row_count")
            for name, build in MARTS.items()
        ]
    )
