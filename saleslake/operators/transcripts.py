"""From transcript rows to silver entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslake import vocab
from saleslake.functions import text as tx
from saleslake.functions.parsing import strip


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add every extracted attribute to the document rows; a narrow projection."""
    body = F.col(text)
    return (
        docs.withColumns(
            {
                "company": tx.company(body),
                "industry": tx.industry(body),
                "geography": tx.geography(body),
                "employee_count": tx.employee_count(body),
                "annual_revenue": tx.annual_revenue(body),
                "attendees": tx.speakers(body),
                "contacts": tx.named_contacts(body),
                "topics": tx.topics(body),
                "key_points": tx.key_points(body),
                "sentiment": tx.sentiment(body),
                "duration_minutes": tx.duration_minutes(body),
                "competitors": tx.competitors(body),
                "buying_intent": tx.buying_intent(body),
                "budget_confirmed": F.size(tx.money_mentions(body)) > 0,
                "deal_name": tx.deal_name(body),
                "deal_value": tx.first_amount(body),
                "stated_stage": tx.stated_stage(body),
                "close_date": tx.close_date(body),
            }
        )
        .withColumn("primary_contact", tx.primary_contact(F.col("contacts"), F.col("attendees")))
    )


def _by_intent(values: dict[str, str]) -> Column:
    result = F.lit(None).cast("string")
    for intent, value in values.items():
        result = F.when(F.col("buying_intent") == intent, value).otherwise(result)
    return result


def signal_sentence() -> Column:
    """Text of the deal-signal insight."""
    budget = F.when(F.col("budget_confirmed"), "Budget has been confirmed by the prospect.").otherwise(
        "Budget not yet confirmed."
    )
    signals = F.concat(F.lit("Key signals: "), F.array_join(F.slice("key_points", 1, 3), "; "), F.lit("."))
    return F.concat_ws(
        " ",
        F.concat(F.lit("Buying intent is "), F.col("buying_intent"), F.lit(".")),
        budget,
        F.when(F.size("key_points") > 0, signals),
    )


def competitor_sentence() -> Column:
    return F.concat(
        F.lit("Competitors mentioned in conversation: "), F.array_join("competitors", ", "), F.lit(".")
    )


def action_sentence(items: Column) -> Column:
    """Text of the follow-up insight, from at most five (task, owner, due date) items."""
    lines = F.transform(
        F.slice(items, 1, 5),
        lambda i: F.concat(
            i["task"],
            F.when(i["owner"] != "", F.concat(F.lit(" (Owner: "), i["owner"], F.lit(")"))).otherwise(""),
            F.when(i["due_date"] != "", F.concat(F.lit(" [Due: "), i["due_date"], F.lit("]"))).otherwise(""),
        ),
    )
    return F.concat(F.lit("Follow-up actions from meeting: "), F.array_join(lines, "; "), F.lit("."))


def _insight_kinds(columns: list[str]) -> Column:
    """Deal signal, competitors if any, action items if the rows carry them."""
    kinds = [
        F.struct(
            F.lit("deal_signal").alias("insight_type"),
            signal_sentence().alias("content"),
            _by_intent(vocab.INTENT_CONFIDENCE).alias("confidence"),
        ),
        F.when(
            F.size("competitors") > 0,
            F.struct(
                F.lit("competitive").alias("insight_type"),
                competitor_sentence().alias("content"),
                F.lit("0.8").alias("confidence"),
            ),
        ),
    ]
    if "action_items" in columns:
        kinds.append(
            F.when(
                F.size("action_items") > 0,
                F.struct(
                    F.lit("action_items").alias("insight_type"),
                    action_sentence(F.col("action_items")).alias("content"),
                    F.lit("0.9").alias("confidence"),
                ),
            )
        )
    return F.array_compact(F.array(*kinds))


def _people() -> Column:
    """Attendees as participants, then the labelled contacts."""

    def person(name: Column, role: Column, department: Column) -> Column:
        return F.struct(name.alias("contact_name"), role.alias("role"), department.alias("department"))

    return F.concat(
        F.transform("attendees", lambda n: person(n, F.lit("Participant"), F.lit(""))),
        F.transform("contacts", lambda c: person(c["name"], c["role"], c["department"])),
    )


def _deal() -> Column:
    stage = F.when(F.col("stated_stage") != "", F.col("stated_stage")).otherwise(_by_intent(vocab.INTENT_STAGE))
    name = F.when(F.col("deal_name") != "", F.col("deal_name")).otherwise(F.concat(F.col("company"), F.lit(" Deal")))
    return F.struct(
        name.alias("deal_name"),
        "deal_value",
        stage.alias("deal_stage"),
        "close_date",
        F.col("primary_contact").alias("contact_name"),
        F.to_json(F.struct("buying_intent", "budget_confirmed")).alias("source_data"),
    )


def _interaction() -> Column:
    return F.struct(
        F.lit("meeting").alias("interaction_type"),
        F.col("close_date").alias("interaction_date"),
        F.array_join("key_points", ", ").alias("summary"),
        F.lower("sentiment").alias("sentiment"),
        F.col("duration_minutes").cast("string").alias("duration_minutes"),
        F.to_json(F.struct("attendees", "topics", "key_points", "competitors", "buying_intent")).alias("source_data"),
    )


# Outer explodes: Spark adds no filter to them, which would repeat the extraction.
def insights(extracted: DataFrame) -> DataFrame:
    """Insight rows per document; there always is a deal signal."""
    return extracted.select(
        "doc_id",
        F.col("company").alias("account_name"),
        F.explode_outer(_insight_kinds(extracted.columns)).alias("i"),
    ).select("doc_id", "account_name", "i.*", F.lit("").alias("insight_date"))


def entities(extracted: DataFrame) -> dict[str, DataFrame]:
    """The five silver record sets found in extracted transcripts.

    ``place`` orders the people of a document: of an attendee who is a labelled contact too, the label is the later one."""
    account = F.col("company").alias("account_name")
    people = extracted.select("doc_id", account, F.posexplode_outer(_people()).alias("place", "p")).where(F.col("p").isNotNull())
    return {
        "dim_account": extracted.select(
            "doc_id", account, "industry", "geography", "employee_count", "annual_revenue"
        ),
        "dim_contact": people.select("doc_id", "place", "account_name", "p.*"),
        "fact_interactions": extracted.select("doc_id", account, _interaction().alias("i")).select("doc_id", "account_name", "i.*"),
        "fact_deals": extracted.select("doc_id", account, _deal().alias("d")).select("doc_id", "account_name", "d.*"),
        "fact_insights": insights(extracted),
    }


def entity_listing(extracted: DataFrame) -> DataFrame:
    """All entity rows in one shape (which table, which account, which record), from one scan."""

    def row(table: str, record: Column) -> Column:
        return F.struct(F.lit(table).alias("entity"), record.alias("record"))

    def joined(value: Column, *names: str) -> Column:
        return F.concat_ws("/", *[value[n] for n in names])

    rows = F.concat(
        F.array(row("dim_account", F.coalesce("industry", F.lit("")))),
        F.transform(_people(), lambda p: row("dim_contact", joined(p, "contact_name", "role"))),
        F.array(row("fact_interactions", F.concat_ws("/", "close_date", F.lower("sentiment"), "duration_minutes"))),
        F.array(row("fact_deals", joined(_deal(), "deal_name", "deal_value", "deal_stage", "close_date", "contact_name"))),
        F.transform(
            _insight_kinds(extracted.columns), lambda i: row("fact_insights", joined(i, "insight_type", "confidence"))
        ),
    )
    return extracted.select(
        "doc_id", F.col("company").alias("account_name"), F.explode_outer(rows).alias("r")
    ).select("r.entity", "doc_id", "account_name", "r.record")


def usable_text(payload_columns: list[str]) -> Column:
    """First non-empty of the given text columns, NULL when shorter than 50 characters."""
    body = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in payload_columns])
    return F.when(F.length(strip(body)) >= vocab.MIN_TEXT_CHARS, body)
