"""Value rules on hand-written rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from saleslake.functions import parsing as p
from saleslake.functions import quality as rules
from saleslake.functions import text as tx
from saleslake.operators import transcripts
from saleslake.plans import questions


def apply(spark, values, function, kind="string"):
    """function over a column of values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
    return [r.out for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_amount(spark):
    assert str(apply(spark, ["12345678901234567890.125"], p.amount)[0]) == "12345678901234567890.125000"
    got = apply(spark, ["1.2.3", ".", "5.", "12", "-5", "1e5", None, "12\n", "0.125"], p.amount)
    assert [None if g is None else float(g) for g in got] == [None, None, 5, 12, None, None, None, None, 0.125]


def test_init_cap(spark):
    assert apply(spark, ["closed-won deal", "P0 stage", ""], p.init_cap) == ["Closed-Won Deal", "P0 Stage", ""]


@pytest.mark.parametrize(
    "field, value, expected",
    [
        ("x", "007", "7"), ("x", "2500000.0", "2500000"), ("win_rate", "2.0", "2.0"), ("x", "1.50", "1.5"),
        ("x", '{"a":1}', '{"a":1}'), ("x", "{broken", "{broken"), ("x", " text ", "text"), ("sentiment", " Good", "good"),
        ("x", "--5", "--5"), ("x", "-5", "-5"), ("x", "1.2.3", "1.2.3"), ("x", "12345678.25", "12345678.25"),
        ("x", "0.12345678901234", "0.12345678901234"), ("x", "1.5e-12", "0.0000000000015"), ("x", "1.5e3", "1500"), ("x", "1.25E-30", "1.25E-30"),
        ("x", "+00.50", "0.5"), ("x", "-0.0", "0"), ("x", "-.5", "-0.5"), ("x", "12345678901234567890.5", "12345678901234567890.5"),
        ("x", "1" * 60, "1" * 60), ("x", "1" * 60 + ".0", "1" * 60),
    ],
)
def test_audit_form(spark, field, value, expected):
    assert apply(spark, [value], lambda c: p.coerce_audit_value(c, field)) == [expected]


def test_percent(spark):
    df = spark.createDataFrame([(1, 16), (1, 8), (0, 0), (3, 3)], "a bigint, b bigint")
    assert [r[0] for r in df.select(p.percent(F.col("a"), F.col("b"))).collect()] == [6.3, 12.5, 0.0, 100.0]


def test_leading_number(spark):
    assert apply(spark, ["12abc", "-5", "1e5", "N/A", None, ".5", "1.2.3"], p.leading_number) == [12, -5, 100000, 0, 0, 0.5, 1.2]


def test_bands_and_labels(spark):
    assert apply(spark, [-3, 7, 8, 30, 31, None], p.closing_band, "bigint") == ["urgent", "urgent", "soon", "soon", "later", None]
    assert apply(spark, [1_500_000.0, 20_000.0, 300.0, 12.5, 0.0, None], p.currency_label, "double") == [
        "$1.5M", "$20K", "$300", "$12.5", "$0", "$0"
    ]


def test_iso_date(spark):
    got = apply(spark, ["2024-02-30", "2024-02-29", "Q2 2025", None], p.iso_date)
    assert [g if g is None else str(g) for g in got] == [None, "2024-02-29", None, None]


def test_number_text(spark):
    values = ["$1,200", "nan", "abc", "1_000", "1__0", " 1e5 ", "-Infinity", ".5", "5.", "1e"]
    assert apply(spark, values, rules.is_number_text) == [True, True, False, True, False, True, True, True, True, False]


def test_deal_errors(spark):
    df = spark.createDataFrame(
        [(None, "", "D", "1"), (1, None, None, "x"), (1, "A", "D", None)],
        "account_id bigint, account_name string, deal_name string, deal_value string",
    )
    got = [r[0] for r in df.select(rules.errors("fact_deals", df.columns)).collect()]
    assert got == [
        ["At least one of account_id, account_name is required"],
        ["deal_name is required and cannot be empty", "deal_value must be numeric, got: 'x'"],
        [],
    ]


def test_warnings_never_reject(spark):
    df = spark.createDataFrame([("D", "A", "Shipping", "2024/01/02")], "deal_name string, account_name string, vertical string, close_date string")
    row = df.select(rules.warnings("fact_deals", df.columns).alias("w"), rules.errors("fact_deals", df.columns).alias("e")).first()
    assert row.e == [] and len(row.w) == 1 and row.w[0].startswith("vertical value 'Shipping'")


def test_completeness(spark):
    df = spark.createDataFrame([("a", None, " ")], "x string, y string, z string")
    assert df.select(rules.completeness(["x"], ["x", "y", "z"])).first()[0] == 0.5


NOTE = """Meeting with Stark Systems about pricing.
Participants: Ann Lee, Bob Stone
[00:05] Carol King: we need a budget of $1,200,000 for the migration.
[01:07] Ann Lee: Salesforce and AWS are under review. The proposal is ready
Primary Contact: Michael Johnson, Role: VP of Cloud Strategy
Contact: Michael Johnson
Key Contact: Dana Fox, Title: CTO, Department: Research
Expected close: Q2 2025
Current Deal: Cloud Move"""


def test_note_extraction(spark):
    docs = spark.createDataFrame([(1, NOTE)], "doc_id bigint, text string")
    row = transcripts.extract(docs).first()
    assert row.company == "Stark Systems"
    assert row.attendees == ["Carol King", "Ann Lee", "Bob Stone"]
    assert [(c["name"], c.role, c.department) for c in row.contacts] == [
        ("Michael Johnson", "VP of Cloud Strategy", ""), ("Dana Fox", "CTO", "Research")
    ]
    assert row.primary_contact == "Michael Johnson"
    assert row.deal_value == "1200000" and row.deal_name == "Cloud Move" and row.close_date == "Q2 2025"
    assert row.competitors == ["AWS", "Salesforce"] and row.duration_minutes == 62
    assert row.topics[:3] == ["Budget", "Pricing", "Migration"]
    assert row.buying_intent == "High" and row.stated_stage == "Proposal"
    assert row.key_points[0] == "Budget/amount mentioned: $1,200,000 "


def test_nothing_to_extract(spark):
    docs = spark.createDataFrame([(1, "")], "doc_id bigint, text string")
    row = transcripts.extract(docs).first()
    assert (row.company, row.sentiment, row.duration_minutes) == ("Unknown", "Neutral", 10)
    assert row.topics == ["General Discussion"] and row.contacts == []
    assert row.key_points == ["Meeting recorded - details require manual review"]


def test_action_items_become_an_insight(spark):
    docs = transcripts.extract(spark.createDataFrame([(1, NOTE)], "doc_id bigint, text string"))
    item = F.struct(F.lit("Send quote").alias("task"), F.lit("Ann").alias("owner"), F.lit("").alias("due_date"))
    kinds = {r.insight_type: r for r in transcripts.insights(docs.withColumn("action_items", F.array(item))).collect()}
    assert set(kinds) == {"deal_signal", "competitive", "action_items"}
    assert kinds["action_items"].content == "Follow-up actions from meeting: Send quote (Owner: Ann)."
    assert kinds["deal_signal"].confidence == "0.9"


def test_sentiment_margin(spark):
    texts = ["great good happy", "great good", "risk fail delay", "great risk"]
    assert apply(spark, texts, tx.sentiment) == ["Positive", "Neutral", "Negative", "Neutral"]


def test_question_rules(spark):
    asked = ["What did they say? Total?", "how many deals", "the meeting total revenue"]
    assert apply(spark, asked, questions.intent) == ["narrative", "metric", "metric"]
    assert apply(spark, ["Hi!", "hi there you", "history", "hello"], questions.is_greeting) == [True, True, False, True]
    sql = ["select * from Silver.Fact_Deals d join silver.dim_account a on true, silver.where"]
    assert apply(spark, sql, questions.silver_tables) == ["silver.dim_account,silver.fact_deals"]
