"""Matching names that contain each other, without comparing every pair.

A text contains a name exactly when one of its substrings equals the name. So the longer
side is exploded into its distinct substrings, only of lengths the other side really has,
and matched by equality. Nothing is approximate and no candidate pair is ever tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslake.functions.parsing import AMOUNT_TYPE, amount
from saleslake.operators.joins import fan_out_join, union_all


def name_lengths(df: DataFrame, name: str) -> list[int]:
    """Distinct lengths of a name column; as many values as the longest name has characters."""
    rows = df.select(F.length(name).alias("n")).where("n > 0").distinct().collect()
    return sorted(r.n for r in rows)


def substrings(text: Column, lengths: list[int]) -> Column:
    """Distinct substrings of the given lengths."""
    size = F.length(text)
    sizes = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= size)
    cut = F.transform(
        sizes, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: text.substr(i, n))
    )
    return F.array_distinct(F.flatten(cut))


def contained_in(inner: DataFrame, outer: DataFrame, inner_text: str, outer_text: str, row_id: str) -> DataFrame:
    """All (outer row, inner row) pairs where the outer text contains the inner text.

    A short inner name may sit in a large share of the outer texts; its matches are spread
    over several tasks.
    """
    lengths = name_lengths(inner, inner_text)
    if not lengths:
        lengths = [1]
    pieces = outer.withColumn("_piece", F.explode_outer(substrings(F.col(outer_text), lengths)))
    return fan_out_join(
        pieces, inner.withColumn("_piece", F.col(inner_text)), ["_piece"], row_id, how="inner"
    ).drop("_piece")


def least_containing(inner: DataFrame, outer: DataFrame, inner_text: str, outer_text: str, value: str) -> DataFrame:
    """Inner rows with the least ``value`` of the outer rows whose text contains theirs; rows without one are left out.

    The least value is taken for each substring before the join, so that a short name inside most outer texts meets
    one row instead of all of them.
    """
    lengths = name_lengths(inner, inner_text) or [1]
    pieces = outer.select(F.explode_outer(substrings(F.col(outer_text), lengths)).alias("_piece"), value)
    least = pieces.groupBy("_piece").agg(F.min(value).alias(value))
    return inner.join(least, F.col(inner_text) == F.col("_piece")).drop("_piece")


def counts_by_contained_name(
    accounts: DataFrame, contacts: DataFrame, deals: DataFrame, interactions: DataFrame
) -> DataFrame:
    """Every account with the contacts, deals and interactions whose account text contains its name.

    Rows are summed per spelling, spellings are exploded into substrings, and the sums are
    added up per substring before the accounts are joined: a substring shared by a third of
    all names ends up as one row. An empty account name is contained in every text.
    """
    zero = F.lit(0).cast("bigint")
    no_money = F.lit(None).cast(AMOUNT_TYPE)

    def counted(df: DataFrame, kind: str) -> DataFrame:
        return df.where(F.col("account_name").isNotNull()).select(
            F.lower("account_name").alias("low"),
            *[(F.lit(1).cast("bigint") if kind == k else zero).alias(k) for k in ("contact", "deal", "interaction")],
            (amount(F.col("deal_value")) if kind == "deal" else no_money).alias("value"),
        )

    sums = [
        F.sum("contact").alias("contact"), F.sum("deal").alias("deal"),
        F.sum("interaction").alias("interaction"), F.sum("value").alias("value"),
    ]
    spelled = (
        union_all([counted(contacts, "contact"), counted(deals, "deal"), counted(interactions, "interaction")])
        .groupBy("low")
        .agg(*sums)
    )
    keyed = accounts.withColumn("_piece", F.lower("account_name"))
    lengths = name_lengths(accounts, "account_name") or [1]
    # The empty text joins the pieces of every spelling, for accounts with an empty name.
    pieces = F.concat(F.array(F.lit("")), substrings(F.col("low"), lengths))
    per_piece = (
        spelled.select(F.explode_outer(pieces).alias("_piece"), "contact", "deal", "interaction", "value")
        .groupBy("_piece")
        .agg(*sums)
    )
    return (
        fan_out_join(keyed, per_piece, ["_piece"], "id")
        .select(
            *accounts.columns,
            F.coalesce("contact", zero).alias("contact_count"),
            F.coalesce("deal", zero).alias("deal_count"),
            F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("deal_total_value"),
            F.coalesce("interaction", zero).alias("interaction_count"),
        )
    )
