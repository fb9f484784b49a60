"""Resolving account names to account ids, and the map of who calls an account what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.functions.parsing import filled, name_key, strip
from saleslake.operators.containment import contained_in, least_containing
from saleslake.operators.joins import union_all
from saleslake.operators.merge import upsert
from saleslake.operators.ranking import number_rows
from saleslake.session import durable

MIN_FUZZY = 3  # shorter incoming names are never matched by containment


def distinct_names(names: DataFrame) -> DataFrame:
    """One row per distinct trimmed name with its first sequence number."""
    return (
        names.select(strip(F.col("name")).alias("name"), "seq")
        .where(filled(F.col("name")))
        .groupBy("name")
        .agg(F.min("seq").alias("seq"))
    )


def _by_name(accounts: DataFrame, key, alias: str, found: str) -> DataFrame:
    return accounts.groupBy(key.alias(alias)).agg(F.min("id").alias(found))


def _containment_matches(names: DataFrame, accounts: DataFrame) -> DataFrame:
    """(name, account id, length) for containment either way, in lower case."""
    wanted = names.where(F.length("name") >= MIN_FUZZY).withColumn("low", F.lower("name"))
    # Equal spellings are one candidate; the smallest id stands for them.
    known = accounts.groupBy(F.lower("account_name").alias("account_low")).agg(
        F.min(F.struct(F.length("account_name").alias("size"), F.col("id"))).alias("best")
    )
    inside_name = contained_in(known, wanted, "account_low", "low", "name").select("name", "best")
    inside_account = least_containing(wanted, known, "low", "account_low", "best").select("name", "best")
    return inside_name.unionByName(inside_account)


def match_existing(names: DataFrame, accounts: DataFrame) -> DataFrame:
    """(name, seq, account_id, tier, size) with tier 1 exact, 2 same key, 3 containment, else NULL.

    ``names`` holds distinct names. In tier 3 the shortest account name wins, then the
    smallest id. Accounts without a name are no candidates.
    """
    known = accounts.where(filled(F.trim("account_name"))).select("id", "account_name")
    exact = _by_name(known, F.col("account_name"), "name", "exact_id")
    same_key = _by_name(known, name_key(F.col("account_name")), "key", "key_id")
    looked_up = (
        names.join(exact, "name", "left")
        .withColumn("key", name_key(F.col("name")))
        .join(same_key, "key", "left")
        .drop("key")
    )
    # Written once: the lengths and both containment joins read it.
    open_names = durable(looked_up.where(F.coalesce("exact_id", "key_id").isNull()).select("name"))
    if open_names.isEmpty():
        return looked_up.select(
            "name",
            "seq",
            F.coalesce("exact_id", "key_id").alias("account_id"),
            F.when(F.col("exact_id").isNotNull(), 1).otherwise(2).alias("tier"),
            F.lit(None).cast("int").alias("size"),
        )
    fuzzy = _containment_matches(open_names, known).groupBy("name").agg(F.min("best").alias("best"))
    return looked_up.join(fuzzy, "name", "left").select(
        "name",
        "seq",
        F.coalesce("exact_id", "key_id", "best.id").alias("account_id"),
        F.when(F.col("exact_id").isNotNull(), 1)
        .when(F.col("key_id").isNotNull(), 2)
        .when(F.col("best.id").isNotNull(), 3)
        .alias("tier"),
        F.col("best.size").alias("size"),
    )


def _conflicts(names: DataFrame) -> DataFrame:
    """(earlier, later) pairs of names that would resolve to each other."""
    left = names.select(F.col("name").alias("inner_name"), F.col("seq").alias("inner_seq"), F.lower("name").alias("inner_low"))
    right = names.select(F.col("name").alias("outer_name"), F.col("seq").alias("outer_seq"), F.lower("name").alias("outer_low"))
    within = contained_in(left, right, "inner_low", "outer_low", "outer_name").where("inner_name != outer_name")
    inner_first = F.struct("inner_seq", "inner_name") < F.struct("outer_seq", "outer_name")
    pairs = within.select(
        F.when(inner_first, F.col("inner_name")).otherwise(F.col("outer_name")).alias("earlier"),
        F.when(inner_first, F.col("outer_name")).otherwise(F.col("inner_name")).alias("later"),
    )
    # Names shorter than three characters conflict only when their keys are equal.
    keyed_pairs = (F.length("later") >= MIN_FUZZY) | (name_key(F.col("earlier")) == name_key(F.col("later")))
    return pairs.where(keyed_pairs).distinct()


def created_names(names: DataFrame) -> DataFrame:
    """The names that become accounts, when none of them matches an existing one.

    In sequence order a name is created unless it matches an earlier created name. Names
    are decided in rounds: one whose earlier neighbours are all decided can be decided.
    """
    edges = durable(_conflicts(names))
    state = durable(names.select("name", "seq", F.lit("open").alias("state")))
    while state.where("state = 'open'").limit(1).count():
        around = (
            edges.join(state.select(F.col("name").alias("earlier"), F.col("state").alias("s")), "earlier")
            .groupBy(F.col("later").alias("name"))
            .agg(F.max(F.col("s") == "created").alias("blocked"), F.max(F.col("s") == "open").alias("waiting"))
        )
        state = durable(
            state.join(around, "name", "left").select(
                "name",
                "seq",
                F.when(F.col("state") != "open", F.col("state"))
                .when(F.col("blocked"), "absorbed")
                .when(F.coalesce("waiting", F.lit(False)), "open")
                .otherwise("created")
                .alias("state"),
            )
        )
    return state.where("state = 'created'").select("name", "seq")


def resolve(names: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve every distinct name; returns (name -> account_id with tier, new account rows).

    New accounts are numbered after the existing ones in order of first appearance. A name
    that only matched by containment, or was absorbed, is ranked again over the existing
    accounts and those created before it.
    """
    first = durable(match_existing(distinct_names(names), accounts))
    unmatched = first.where("tier is null").select("name", "seq")
    if unmatched.isEmpty():
        none = accounts.select("id", "account_name").limit(0)
        return first.select("name", "account_id", "tier"), none
    top = accounts.agg(F.max("id")).first()[0] or 0
    fresh = number_rows(created_names(unmatched), [F.asc("seq"), F.asc("name")], "n")
    new_accounts = durable(fresh.select((F.col("n") + top).alias("id"), F.col("name").alias("account_name"), F.col("seq").alias("created_seq")))

    settled = first.where("tier in (1, 2)").select("name", "account_id", "tier")
    created = new_accounts.select(F.col("account_name").alias("name"), F.col("id").alias("account_id"), F.lit(4).alias("tier"))
    floating = first.where("tier is null or tier = 3").join(created.select("name"), "name", "left_anti")
    old_choice = floating.where("tier = 3").select(
        "name", F.lit(3).alias("tier"), F.col("size"), F.col("account_id").alias("id")
    )
    wanted = floating.select("name", "seq", F.lower("name").alias("low"))
    known = new_accounts.select(F.col("id"), "created_seq", F.lower("account_name").alias("account_low"), F.length("account_name").alias("size"))
    both_ways = contained_in(known, wanted, "account_low", "low", "name").unionByName(
        contained_in(wanted, known, "low", "account_low", "id"), allowMissingColumns=True
    )
    new_choice = (
        both_ways.where((F.col("created_seq") <= F.col("seq")))
        .withColumn("tier", F.when(F.trim("low") == F.trim("account_low"), 2).otherwise(3))
        .where((F.col("tier") == 2) | (F.length("name") >= MIN_FUZZY))
        .select("name", "tier", "size", "id")
    )
    chosen = (
        old_choice.unionByName(new_choice)
        .groupBy("name")
        .agg(F.min(F.struct("tier", "size", "id")).alias("c"))
        .select("name", F.col("c.id").alias("account_id"), F.col("c.tier").alias("tier"))
    )
    return union_all([settled, created, chosen]), new_accounts.drop("created_seq")


def source_map_rows(names: DataFrame, resolved: DataFrame) -> DataFrame:
    """(account_id, source, source_name, source_id) rows seen in a batch of (name, source, seq)."""
    seen = (
        names.withColumn("name", strip(F.col("name")))
        .groupBy("name", F.coalesce("source", F.lit("unknown")).alias("source"))
        .agg(F.max("seq").alias("seq"))
    )
    return seen.join(resolved.select("name", "account_id"), "name").select(
        "account_id", "source", F.col("name").alias("source_name"), F.lit(None).cast("string").alias("source_id"), "seq"
    )


def upsert_source_map(current: DataFrame, rows: DataFrame) -> DataFrame:
    """Keyed by account, source and name; a known source id is kept when the new one is NULL."""
    return upsert(current, rows, ["account_id", "source", "source_name"], "seq")


def seed_source_map(accounts: DataFrame, current: DataFrame) -> DataFrame:
    """Map rows with source 'legacy' for all named accounts not yet in the map."""
    seeds = accounts.where(filled(F.col("account_name"))).select(
        F.col("id").alias("account_id"), F.lit("legacy").alias("source"), F.col("account_name").alias("source_name")
    )
    return seeds.join(current, ["account_id", "source", "source_name"], "left_anti")
