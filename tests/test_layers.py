"""Files, tables and marts on hand-written rows."""

from __future__ import annotations

import os
import random
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from saleslake.operators import mapping
from saleslake.plans import dashboard
from saleslake.plans.ingest import empty
from saleslake.plans.marts import MARTS, deal_state, interaction_state
from saleslake.plans.refresh import refresh_all
from saleslake.sources import bronze, lake, readers

AS_OF = "2024-03-01"


def home() -> str:
    return tempfile.mkdtemp(prefix="run-")


# ------------------------------------------------------------------ files and tables
def test_csv_keeps_texts(spark):
    path = f"{home()}/deals.csv"
    with open(path, "w", encoding="latin-1") as out:
        out.write('name,value\n"Caf\xe9, ""big""",007\n"two\nlines",$1.2B\n')
    rows = readers.read_csv(spark, path, encoding="ISO-8859-1").collect()
    assert [tuple(r) for r in rows] == [('Café, "big"', "007"), ("two\nlines", "$1.2B")]


def test_text_files_are_one_record_each(spark):
    folder = home()
    for name in ("a.txt", "b.txt"):
        with open(os.path.join(folder, name), "w") as out:
            out.write(f"first of {name}\nsecond")
    rows = {r.filename: r.raw_transcript for r in readers.read_texts(spark, folder).collect()}
    assert rows == {"a.txt": "first of a.txt\nsecond", "b.txt": "first of b.txt\nsecond"}


def test_json_batches(spark):
    path = f"{home()}/in.json"
    with open(path, "w") as out:
        out.write('{"source":"crm","data":[{"account_name":"A"},{"account_name":"B"}]}\n')
    rows = readers.read_json(spark, path, "source string, data array<struct<account_name:string>>").collect()
    assert [tuple(r) for r in rows] == [("crm", "A"), ("crm", "B")]


def test_bronze_appends_and_types_each_record(spark):
    path = f"{home()}/bronze"
    rows = spark.createDataFrame([("x" * 51, "A"), ("short", "B"), (None, "C")], "raw_transcript string, account_name string")
    bronze.append_bronze(rows, "notes", path)
    bronze.append_bronze(rows, "notes", path)
    stored = spark.read.parquet(path)
    assert stored.count() == 6
    assert stored.where("data_type = 'raw_transcript'").count() == 2


def test_audit_round_trip(spark):
    path = f"{home()}/audit"
    deals = spark.createDataFrame([("Big", "007", "2500000.0")], "deal_name string, probability string, deal_value string")
    bronze.append_audit(bronze.audit_rows({"fact_deals": deals}, "b1", "crm", "deterministic"), path)
    bronze.append_audit(bronze.audit_rows({"fact_deals": deals}, "b2", "crm", "deterministic"), path)
    back = bronze.read_audit(spark, path, "b1", "fact_deals", deals.columns).collect()
    assert [tuple(r) for r in back] == [("Big", "7", "2500000")]


def test_only_named_partitions_are_replaced(spark):
    path = home()
    assert lake.read_table(spark, path, "t") is None
    rows = spark.range(100).withColumn(lake.PART, lake.bucket(["id"], 8))
    lake.overwrite_parts(rows, path, "t", buckets=8)
    before = {r.id: r.file for r in lake.read_table(spark, path, "t").withColumn("file", F.input_file_name()).collect()}
    touched = lake.parts_of(rows.where("id = 7"))
    more = rows.where(F.col(lake.PART).isin(touched)).withColumn("note", F.lit("x"))
    lake.overwrite_parts(more, path, "t")
    after = lake.read_table(spark, path, "t", parts=True).withColumn("file", F.input_file_name()).collect()
    assert {r.id for r in after} == set(range(100)) and lake.registered(spark, path, "t")[1] == 8
    assert all((r.note == "x") == (r[lake.PART] in touched) == (before[r.id] != r.file) for r in after)


def test_a_partition_is_replaced_by_no_rows(spark):
    path = home()
    for n in (3, 0):
        lake.replace_part(spark.range(n), path, "t", lake.batch_part("a b/c=1"))
        lake.replace_part(spark.range(5), path, "t", lake.batch_part("other"))
        assert lake.read_table(spark, path, "t").count() == n + 5
    assert {r[0] for r in lake.read_table(spark, path, "t", parts=True).select(lake.PART).distinct().collect()} == {"b-other"}


def test_commits(spark):
    path = home()
    assert not lake.committed(spark, path, "b 1")
    lake.commit(spark, path, "b 1", "crm")
    assert lake.committed(spark, path, "b 1") and not lake.committed(spark, path, "b 2")


def test_stamp(spark):
    df = mapping.stamp_account(spark.createDataFrame([("B",)], "account_name string"), "A")
    assert df.first().account_name == "A"


# ------------------------------------------------------------------ marts
def silver(spark, **tables):
    kinds = {
        "dim_account": "id bigint, account_name string, industry string, geography string, vertical string",
        "dim_contact": "contact_name string, account_name string, role string",
        "fact_deals": "id bigint, account_id bigint, account_name string, deal_name string, deal_value string, deal_stage string, horizontal string, close_date string, created_at timestamp, updated_at timestamp",
        "fact_interactions": "id bigint, account_id bigint, account_name string, interaction_date string, sentiment string",
        "fact_insights": "id bigint, account_id bigint, account_name string, insight_type string",
    }
    out = {}
    for table, kind in kinds.items():
        given = spark.createDataFrame(tables.get(table, []), kind)
        out[table] = given.unionByName(empty(spark, table), allowMissingColumns=True)
    return out


def deal(i, account, value="10", stage="Proposal", horizontal=None, account_id=None, name="D", close=None):
    return (i, account_id, account, name, value, stage, horizontal, close, None, None)


def test_an_account_is_ranked_once(spark):
    tables = silver(
        spark,
        fact_deals=[deal(1, "Acme", "5", horizontal="x"), deal(2, "Acme", "7", horizontal="y"), deal(3, "Beta", "12")],
    )
    got = [(r["rank"], r.account_name, r.total_deal_value) for r in MARTS["top_customers"](tables, AS_OF).orderBy("rank").collect()]
    assert got == [(1, "Acme", 12.0), (2, "Beta", 12.0)]


def test_two_spellings_of_a_contact_account(spark):
    tables = silver(
        spark,
        dim_account=[(1, "Acme", None, None, None)],
        dim_contact=[("Ann", "Acme", "Engineer"), ("Bob", " ACME ", "Decision maker")],
    )
    rows = MARTS["account_360"](tables, AS_OF).collect()
    assert [(r.account_name, r.contact_count, r.primary_contact) for r in rows] == [("Acme", 2, "Bob")]


def test_stages_without_name(spark):
    tables = silver(
        spark, fact_deals=[deal(1, "A", "1", None), deal(2, "A", "2", ""), deal(3, "A", "4", "CLOSED WON"), deal(4, "A", "8", "Closed - x")]
    )
    row = MARTS["revenue_summary"](tables, AS_OF).first()
    assert (row.total_deal_value, row.won_value, row.pipeline_value, row.deal_count, row.won_count) == (15.0, 4.0, 2.0, 4, 1)
    assert MARTS["pipeline_health"](tables, AS_OF).count() == 0


def test_win_rate_counts_other_closed_stages(spark):
    tables = silver(spark, fact_deals=[deal(i, "A", "1", "Closed Won" if i == 0 else "Closed - x") for i in range(16)])
    row = MARTS["win_loss_analysis"](tables, AS_OF).first()
    assert (row.total_closed, row.won_count, row.lost_count, row.win_rate) == (16, 1, 0, 6.3)


def test_risk_bands(spark):
    names = ["none", "old", "mid", "new", "text"]
    dates = {"old": "2023-12-31", "mid": "2024-01-30", "new": "2024-02-20", "text": "soon"}
    tables = silver(
        spark,
        dim_account=[(i, n, None, None, None) for i, n in enumerate(names)],
        fact_deals=[deal(i, n, account_id=i) for i, n in enumerate(names)],
        fact_interactions=[(i, i, n, dates[n], None) for i, n in enumerate(names) if n in dates],
    )
    got = {r.account_name: r.risk_level for r in MARTS["at_risk_accounts"](tables, AS_OF).collect()}
    assert got == {"none": "High", "old": "High", "mid": "Medium", "new": "Low", "text": "Low"}
    page = dashboard.mart_view("at_risk_accounts", MARTS["at_risk_accounts"](tables, AS_OF)).collect()
    assert [r.risk_level for r in page] == ["High", "High", "Medium", "Low", "Low"]


def test_lead_contacts_fan_out(spark):
    tables = silver(
        spark,
        fact_deals=[deal(1, "Acme", close="2024-03-11"), deal(2, "Beta", close="x")],
        dim_contact=[("Ann", "acme", "Primary"), ("Bob", "Acme", "decision"), ("Eve", "Acme", "Engineer")],
    )
    got = {
        (r.account_name, r.contact_name, r.days_until_close) for r in MARTS["deals_closing_soon"](tables, AS_OF).collect()
    }
    assert got == {("Acme", "Ann", 10), ("Acme", "Bob", 10), ("Beta", None, None)}


def test_totals_agree_between_marts(spark):
    tables = silver(spark, fact_deals=[deal(i, f"A{i % 3}", str(i), ["Proposal", "Closed Won"][i % 2], f"h{i % 2}") for i in range(20)])
    total = lambda mart: MARTS[mart](tables, AS_OF).agg(F.sum("total_deal_value")).first()[0]
    assert total("revenue_summary") == total("vertical_revenue") == total("geography_mix") == sum(range(20))
    assert total("ai_influence_summary") == total("lead_source_effectiveness")


def test_refresh_publishes_every_mart(spark):
    path = home()
    counts = refresh_all(silver(spark, fact_deals=[deal(1, "Acme")]), AS_OF, path)
    assert set(counts) == set(MARTS) and counts["revenue_summary"] == 1
    assert "refreshed_at" in lake.read_table(spark, path, "gold/revenue_summary").columns


def test_marts_from_states_equal_those_from_rows(spark):
    rng = random.Random(4)
    some = lambda *options: rng.choice(options)
    deals = [
        (i, some(None, 1, 2), some("Acme", "Beta", "", None), f"D{i}", some("5", "7.25", "x", None), some("Proposal", "Closed Won", "closed lost", "", None),
         some("x", None), some("2024-05-01", "soon", None), some(None, datetime(2024, 1, rng.randint(1, 28))), None)
        for i in range(300)
    ]
    talks = [(i, some(None, 1, 2), "Acme", some("2024-02-01", "2024-01-09", None), some("Positive", "negative", "neutral", None)) for i in range(80)]
    tables = silver(spark, fact_deals=deals, fact_interactions=talks, dim_account=[(1, "Acme", "a", None, "v"), (2, "Beta", None, "g", None)])
    summed = {**tables, "deal_state": deal_state(tables["fact_deals"]), "interaction_state": interaction_state(tables["fact_interactions"])}
    for name, build in MARTS.items():
        a, b = ([tuple(r) for r in build(t, AS_OF).collect()] for t in (tables, summed))
        assert sorted(a, key=repr) == sorted(b, key=repr), name


def test_requests(spark):
    deals = silver(spark, fact_deals=[deal(1, "A", "5", horizontal="x"), deal(2, "A", "7", horizontal="y"), deal(3, "B", "1", horizontal="x")])["fact_deals"]
    request = dashboard.Request(metrics=["total_deal_value", "deal_count"], group_by=["account_name"], filters={"horizontal": "x"}, limit=1)
    assert [tuple(r) for r in dashboard.semantic_query(deals, request).collect()] == [("A", 5.0, 1)]


def test_unknown_account(spark):
    try:
        dashboard.account_detail(silver(spark), 99)
    except LookupError:
        return
    raise AssertionError("no error for an unknown account")
