"""From a CRM batch to marts, and the same again."""

from __future__ import annotations

import glob
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from saleslake.plans import ingest
from saleslake.plans.ingest import enrich_from_bronze, ingest_for_account, ingest_structured, ingest_transcripts, read_silver
from saleslake.plans.marts import MARTS
from saleslake.session import shared_dir
from saleslake.sources.lake import PART, committed, read_table

COLUMNS = "seq bigint, account_name string, industry string, contact_name string, contact_role string, deal_name string, deal_value string, deal_stage string, close_date string, sentiment string, last_interaction_date string, lead_priority string"
ROWS = [
    (1, "Acme", "Retail", "Ann", "Primary Contact", "Big", "$1,200", "Negotiation", "2024-05-01", "Positive", "2024-02-01", "high"),
    (2, "Acme", "", "Ann", None, "Big", "", "Closed Won", "2024-05-02", None, None, None),
    (3, "acme ", "Food", "Bob", "Engineer", "Small", "007", "Proposal", None, "NEGATIVE", "2024-02-02", None),
    (4, "Beta", None, None, None, "Broken", "abc", "Proposal", None, None, None, None),
]


@pytest.fixture(scope="module")
def lake():
    return tempfile.mkdtemp(prefix="run-")


@pytest.fixture(scope="module")
def first(spark, lake):
    batch = spark.createDataFrame(ROWS, COLUMNS)
    return ingest_structured(spark, batch, "Salesforce", "b1", lake, "2024-03-01", {"lead_priority": "fact_deals"})


def test_report(first):
    assert first.status == "success"
    assert first.rejected == 1  # the deal whose value is no number
    assert first.columns_added == {"fact_deals": {"lead_priority": "lead_priority"}}
    assert first.mart_rows["revenue_summary"] >= 1


def test_accounts_and_contacts(spark, lake, first):
    silver = read_silver(spark, lake)
    names = {r.account_name: r.industry for r in silver["dim_account"].collect()}
    assert names == {"Acme": "Retail", "acme": "Food", "Beta": None}
    people = {(r.contact_name, r.account_name): r.role for r in silver["dim_contact"].collect()}
    assert people[("Ann", "Acme")] == "Primary Contact"


def test_deals(spark, lake, first):
    deals = {r.deal_name: r for r in read_silver(spark, lake)["fact_deals"].collect()}
    assert set(deals) == {"Big", "Small"}
    assert deals["Big"].deal_value == "1200" and deals["Big"].deal_stage == "Closed Won"
    assert deals["Big"].lead_priority == "high"
    assert deals["Small"].deal_value == "7"  # audit form of 007
    assert deals["Big"].account_id is not None


def test_rejects_and_source_map(spark, lake, first):
    issues = read_table(spark, lake, "silver/data_quality_issues").collect()
    assert [i.error_messages for i in issues] == [["deal_value must be numeric, got: 'abc'"]]
    assert "Broken" in issues[0].raw_record
    sources = read_table(spark, lake, "silver/account_source_map")
    assert {(r.source, r.source_name) for r in sources.collect()} == {
        ("Salesforce", "Acme"), ("Salesforce", "acme"), ("Salesforce", "Beta")
    }


def test_same_batch_again_changes_nothing(spark, lake, first):
    before = read_silver(spark, lake)
    counts = {t: df.count() for t, df in before.items()}
    batch = spark.createDataFrame(ROWS, COLUMNS)
    ingest_structured(spark, batch, "Salesforce", "b1", lake, "2024-03-01", {"lead_priority": "fact_deals"})
    after = read_silver(spark, lake)
    assert {t: df.count() for t, df in after.items()} == counts


def test_unknown_source_stays_in_bronze(spark, lake, first):
    batch = spark.createDataFrame(ROWS, COLUMNS)
    assert ingest_structured(spark, batch, "mystery", "b9", lake, "2024-03-01").status == "unclassified"
    assert spark.read.parquet(f"{lake}/bronze").where(F.col("source") == "mystery").count() == len(ROWS)


def test_irrelevant_batch_is_skipped(spark, lake, first):
    batch = spark.createDataFrame([(1, "red", "oak")], "seq bigint, colour string, tree string")
    assert ingest_structured(spark, batch, "crm", "b8", lake, "2024-03-01").status == "skipped"


def test_transcripts(spark, lake, first):
    note = (
        "Meeting with Gamma Systems.\nParticipants: Ann Lee\n[00:05] Ann Lee: budget of $5,000 is fine.\n"
        "[00:45] Ann Lee: we are ready.\nExpected close: 2024-06-30"
    )
    docs = spark.createDataFrame([(7, note)], "doc_id bigint, text string")
    report = ingest_transcripts(spark, docs, "notes", "t1", lake, "2024-03-01")
    assert report.status == "success"
    silver = read_silver(spark, lake)
    deal = silver["fact_deals"].where("account_name = 'Gamma Systems'").first()
    assert (deal.deal_name, deal.deal_value, deal.deal_stage) == ("Gamma Systems Deal", "5000", "Negotiation")
    assert silver["fact_interactions"].where("account_name = 'Gamma Systems'").count() == 1
    assert silver["dim_contact"].where("contact_name = 'Ann Lee'").count() == 1
    chunks = read_table(spark, lake, "silver/document_chunks").collect()
    assert [(c.filename, c.chunk_index, c.total_chunks, c.chunk_text) for c in chunks] == [("7", 0, 1, note)]


def test_incremental_folder(spark):
    import os

    from saleslake.streaming.incremental import ingest_folder

    home = tempfile.mkdtemp(prefix="run-")
    os.makedirs(f"{home}/in")
    with open(f"{home}/in/a.csv", "w") as out:
        out.write("account_name,deal_name,deal_value,deal_stage\nAcme,Big,100,Proposal\nBeta,Other,50,Closed Won\n")
    schema = "account_name string, deal_name string, deal_value string, deal_stage string"

    def run():
        ingest_folder(spark, f"{home}/in", schema, "crm", f"{home}/lake", f"{home}/state", "2024-03-01").awaitTermination()
        return read_silver(spark, f"{home}/lake")["fact_deals"].count()

    assert run() == 2
    assert run() == 2  # nothing new
    with open(f"{home}/in/b.csv", "w") as out:
        out.write("account_name,deal_name,deal_value,deal_stage\nAcme,Big,,Closed Won\nAcme,Third,5,Proposal\n")
    assert run() == 3


# ------------------------------------------------------------------ what a load keeps
def lake_of(*parts):
    return tempfile.mkdtemp(prefix="run-")


def test_erp_and_hr_tables_are_loaded(spark):
    lake = lake_of()
    erp = spark.createDataFrame([(1, "Acme", "sale", "12.50", "INV-1"), (2, "Acme", "refund", "3", "INV-2")],
                                "seq bigint, account_name string, transaction_type string, amount string, invoice_number string")
    assert ingest_structured(spark, erp, "sap", "e1", lake, "2024-03-01", force=True).status == "success"
    hr = spark.createDataFrame([(1, "Ann", "Sales", "Bob", "hire", "100.123456789012345")],
                               "seq bigint, employee_name string, department string, manager string, record_type string, salary string")
    assert ingest_structured(spark, hr, "workday", "h1", lake, "2024-03-01", force=True).status == "success"
    silver = read_silver(spark, lake)
    rows = {(r.reference_id, r.amount, r.account_id is not None) for r in silver["fact_transactions"].collect()}
    assert rows == {("INV-1", "12.5", True), ("INV-2", "3", True)}
    assert [(r.name, r.head) for r in silver["dim_department"].collect()] == [("Sales", "Bob")]
    assert [(r.employee_name, r.salary) for r in silver["fact_hr_records"].collect()] == [("Ann", "100.123456789012345")]


def test_all_mapped_columns_and_evolved_ones_stay(spark):
    lake = lake_of()
    schema = "seq bigint, account_name string, segment string, contact_name string, contact_email string, deal_name string, deal_value string, owner string, lead_priority string"
    one = spark.createDataFrame([(1, "Acme", "Big", "Ann", "ann@a.example", "D1", "5", "Olga", "high")], schema)
    two = spark.createDataFrame([(1, "Acme", None, "Ann", None, "D2", "6", "Otto", "low")], schema)
    ingest_structured(spark, one, "crm", "b1", lake, "2024-03-01", {"lead_priority": "fact_deals"})
    second = ingest_structured(spark, two, "crm", "b2", lake, "2024-03-01")  # no routing: the column is known by now
    assert second.fields_ignored == [] and second.columns_added == {}
    silver = read_silver(spark, lake)
    assert {(r.deal_name, r.owner, r.lead_priority) for r in silver["fact_deals"].collect()} == {("D1", "Olga", "high"), ("D2", "Otto", "low")}
    assert [r.email for r in silver["dim_contact"].collect()] == ["ann@a.example"]
    assert [r.segment for r in silver["dim_account"].collect()] == ["Big"]


def test_event_ids_go_on_over_batches(spark):
    lake = lake_of()
    schema = "seq bigint, account_name string, deal_name string, last_interaction_date string, sentiment string"
    for k in (1, 2, 1, 3):
        rows = [(i, "Acme", "D", f"2024-0{k}-0{i}", "positive") for i in (1, 2, 3)]
        ingest_structured(spark, spark.createDataFrame(rows, schema), "crm", f"b {k}/x", lake, "2024-03-01")
    events = read_silver(spark, lake)["fact_interactions"].orderBy("id").collect()
    assert len({r.id for r in events}) == len(events) == 9
    assert [r.interaction_date for r in events if r.interaction_date.startswith("2024-03")] == ["2024-03-01", "2024-03-02", "2024-03-03"]
    assert events[-1].interaction_date == "2024-03-03"  # the last batch has the largest ids


def state_of(spark, lake):
    """All rows of silver tables and marts, without ids and times of loading."""
    skipped = {"created_at", "updated_at", "refreshed_at", "id", "account_id"}
    tables = {**read_silver(spark, lake), **{m: read_table(spark, lake, f"gold/{m}") for m in MARTS}}
    return {t: sorted((tuple(sorted((c, str(v)) for c, v in r.asDict().items() if c not in skipped)) for r in df.collect()), key=repr) for t, df in tables.items()}


def test_a_batch_that_broke_off_is_completed_by_running_it_again(spark, monkeypatch):
    from saleslake.plans import ingest

    batch = spark.createDataFrame(ROWS, COLUMNS)
    more = batch.withColumn("deal_name", F.when(F.col("seq") < 3, F.concat("deal_name", F.lit(" again")))).withColumn("sentiment", F.lit("neutral"))
    whole, broken_off = lake_of(), lake_of()
    for lake in (whole, broken_off):
        ingest_structured(spark, batch, "crm", "b1", lake, "2024-03-01")
    ingest_structured(spark, more, "crm", "b2", whole, "2024-03-01")

    def broken(*args, **kwargs):
        raise OSError("lost")

    for step in ("fan_out_join", "follow", "write_marts", "commit"):
        with monkeypatch.context() as patch:
            patch.setattr(ingest, step, broken)
            with pytest.raises(OSError, match="lost"):
                ingest_structured(spark, more, "crm", "b2", broken_off, "2024-03-01")
        assert committed(spark, broken_off, "b1") and not committed(spark, broken_off, "b2")
    ingest_structured(spark, more, "crm", "b2", broken_off, "2024-03-01")
    assert committed(spark, broken_off, "b2")
    assert state_of(spark, broken_off) == state_of(spark, whole)


def test_a_batch_rewrites_only_the_buckets_of_its_keys(spark):
    lake = lake_of()
    schema = "seq bigint, account_name string, deal_name string, deal_value string, deal_stage string"
    many = spark.createDataFrame([(i, f"Firm {i:03d} of town", f"D{i}", str(i), "Proposal") for i in range(300)], schema)
    ingest_structured(spark, many, "crm", "b1", lake, "2024-03-01")

    def files():
        names = ("silver/dim_account", "silver/fact_deals", "silver/account_source_map", "state/deals")
        return {t: {r[0]: r[1] for r in read_table(spark, lake, t, parts=True).select(PART, F.input_file_name()).distinct().collect()} for t in names}

    before = files()
    few = spark.createDataFrame([(i, f"Firm {i:03d} of town", f"D{i}", "7", "Closed Won") for i in range(3)], schema)
    ingest_structured(spark, few, "crm", "b2", lake, "2024-03-01")
    after = files()
    for table, parts in before.items():
        changed = [p for p, file in parts.items() if after[table][p] != file and p.startswith("k")]
        assert 1 <= len(changed) <= 3 < len(parts), table
    deals = read_silver(spark, lake)["fact_deals"]
    assert deals.count() == 300 and deals.where("deal_stage = 'Closed Won' AND deal_value = '7'").count() == 3


def test_marts_follow_three_batches_as_a_rebuild_would(spark):
    """Deals change value, stage, account attributes and appear without a full key; interactions are added."""
    from saleslake.plans.refresh import with_states

    lake = lake_of()
    schema = "seq bigint, account_name string, deal_name string, deal_value string, deal_stage string, close_date string, last_interaction_date string, sentiment string, lead_source string"
    rows = lambda k: [
        (i, f"Firm {i % 7}", f"D{i * k % 23}" if i % 6 else None, str(100 * k + i), ["Proposal", "Closed Won", "Closed Lost", "Negotiation"][(i + k) % 4],
         ["2024-05-01", None, "x"][i % 3], f"2024-02-{10 + i % 9}", ["positive", "negative", None][(i + k) % 3], ["Web", None][i % 2])
        for i in range(40)
    ]
    for k in (1, 2, 3):
        ingest_structured(spark, spark.createDataFrame(rows(k), schema), "crm", f"b{k}", lake, "2024-03-01")
    silver = read_silver(spark, lake)
    states = with_states(spark, silver, lake)
    assert {"deal_state", "interaction_state"} <= set(states)
    assert states["deal_state"].agg(F.sum("_rows")).first()[0] == silver["fact_deals"].count()
    for name, build in MARTS.items():
        plain = lambda df: sorted(map(repr, (tuple(r) for r in df.drop("refreshed_at").collect())))
        assert plain(read_table(spark, lake, f"gold/{name}")) == plain(build(silver, "2024-03-01")), name


def test_a_stream_does_not_take_a_batch_in_twice(spark):
    """The stream is lost after the lake has noted the batch, before the stream has."""
    import os
    import shutil

    from saleslake.streaming.incremental import ingest_folder

    home = tempfile.mkdtemp(prefix="run-")
    os.makedirs(f"{home}/in")
    with open(f"{home}/in/a.csv", "w") as out:
        out.write("account_name,deal_name,deal_value,deal_stage\nAcme,Big,100,Proposal\nBeta,Other,50,Closed Won\n")

    def run():
        ingest_folder(spark, f"{home}/in", "account_name string, deal_name string, deal_value string, deal_stage string", "crm", f"{home}/lake", f"{home}/state", "2024-03-01").awaitTermination()
        return [tuple(r) for r in read_silver(spark, f"{home}/lake")["fact_deals"].orderBy("id").collect()]

    first = run()
    assert len(first) == 2 and committed(spark, f"{home}/lake", "crm-0")
    shutil.rmtree(f"{home}/state/commits")
    assert run() == first  # also the same times of loading: nothing was written again


# ------------------------------------------------------------------ jobs over a lake
NOTE = (
    "Meeting with {0}.\nParticipants: Ann Lee, Bob Stone\n[00:05] Ann Lee: budget of $5,000 is fine.\n[00:45] Bob Stone: we are ready.\n"
    "Primary Contact: Ann Lee, Role: VP Data\nExpected close: 2024-06-30"
)


def test_a_batch_is_loaded_for_one_account(spark):
    lake = lake_of()
    schema = "seq bigint, account_name string, company string, deal_name string, deal_value string"
    batch = spark.createDataFrame([(1, "Acme", None, "D1", "5"), (2, None, "Beta", "D2", "6"), (3, " acme ", None, "D3", "7")], schema)
    report = ingest_for_account(spark, batch, "Acme", "crm", "b1", lake, "2024-03-01")
    assert (report.status, report.other_accounts) == ("success", 1)
    silver = read_silver(spark, lake)
    assert {(r.deal_name, r.account_name) for r in silver["fact_deals"].collect()} == {("D1", "Acme"), ("D2", "Acme"), ("D3", "Acme")}
    assert [r.account_name for r in silver["dim_account"].collect()] == ["Acme"]
    assert [tuple(r) for r in read_table(spark, lake, "account_mismatches").collect()] == [("Acme", "Beta")]


def test_notes_without_relevance_stay_in_bronze_until_a_question_needs_them(spark):
    """Also: of an attendee who is a labelled contact, the label stays."""
    lake = lake_of()
    docs = spark.createDataFrame([(1, "The oak is red and the elm is green, as trees are in autumn."), (2, NOTE.format("Gamma Systems"))], "doc_id bigint, text string")
    assert ingest_transcripts(spark, docs.where("doc_id = 1"), "notes", "t0", lake, "2024-03-01").status == "skipped"
    assert ingest_transcripts(spark, docs, "notes", "t1", lake, "2024-03-01").status == "success"
    silver = read_silver(spark, lake)
    assert {r.account_name for r in silver["fact_deals"].collect()} == {"Gamma Systems"}
    people = {r.contact_name: r.role for r in silver["dim_contact"].collect()}
    assert people == {"Ann Lee": "VP Data", "Bob Stone": "Participant"}
    assert read_table(spark, lake, "silver/document_chunks").count() == 1

    raw = spark.createDataFrame([(NOTE.format("Delta Corp"),), (NOTE.format("Omega Labs"),)], "raw_transcript string")
    from saleslake.sources.bronze import append_bronze

    append_bronze(raw, "mail", f"{lake}/bronze/batch_id=raw")
    assert enrich_from_bronze(spark, "What did Delta Corp say?", "q1", lake, "2024-03-01").status == "success"
    for again in (False, True):
        deals = read_silver(spark, lake)["fact_deals"].collect()
        assert {r.account_name for r in deals} == {"Gamma Systems", "Delta Corp"} and len(deals) == 2
        assert read_table(spark, lake, "gold/revenue_summary").where("account_name = 'Delta Corp'").count() == 1
        if not again:
            enrich_from_bronze(spark, "What did Delta Corp say?", "q1", lake, "2024-03-01")  # asking again changes nothing


def test_values_are_read_back_once_for_the_audit_trail_and_the_load(spark):
    """F1 to F3: the conversions ran for the audit trail, again for each side of the validation and in their filters."""
    evaluated = spark.sparkContext.accumulator(0)

    def note(text):
        evaluated.add(1)
        return text

    rows = spark.range(20).select(
        F.col("id").alias("seq"), F.lit("Acme").alias("account_name"), F.lit("10").alias("amount"),
        F.udf(note, "string")(F.concat(F.lit("Part "), F.col("id").cast("string"))).alias("product_name"))
    lake = tempfile.mkdtemp(prefix="run-")
    report = ingest_structured(spark, rows, "sap", "once", lake, "2024-03-01", force=True)
    loaded = read_silver(spark, lake)["fact_transactions"].orderBy("id").collect()
    assert report.rejected == 0 and [r.product_name for r in loaded] == [f"Part {i}" for i in range(20)]
    assert evaluated.value <= 2 * 20  # for bronze and for the load


@pytest.mark.parametrize("sent", [32 << 20, -1])
def test_a_load_leaves_no_copies_of_its_rows(spark, monkeypatch, sent):
    monkeypatch.setattr(ingest, "NAMES_SENT", sent, raising=False)
    copies = lambda: set(glob.glob(f"{shared_dir(spark)}/kept-*/*.parquet"))
    before, lake = copies(), tempfile.mkdtemp(prefix="run-")
    rows = [(i, "sale", str(i), f"S{i % 7}" if i % 5 else None) for i in range(60)]
    batch = spark.createDataFrame(rows, "seq bigint, transaction_type string, amount string, account_name string")
    ingest_structured(spark, batch, "sap", "e1", lake, "2024-03-01", force=True)
    silver = read_silver(spark, lake)
    names = {r.id: r.account_name for r in silver["dim_account"].collect()}
    found = [(r.amount, r.account_name, names.get(r.account_id)) for r in silver["fact_transactions"].orderBy("id").collect()]
    assert found == [(str(i), a, a) for i, _, _, a in rows]
    assert copies() == before
    # The tables and the raw and audit layers are packed by the tighter codec.
    files = [f for part in ("bronze", "audit", "silver/fact_transactions") for f in glob.glob(f"{lake}/{part}/*/*.parquet")]
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
