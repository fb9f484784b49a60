"""One batch from raw records to marts that hold it.

bronze -> mapping -> audit trail -> validation -> identity -> merges -> states -> marts. Dimensions
are merged before facts. Merged tables are rewritten in the buckets that the batch's keys fall in,
the others grow by the batch's own partition, and the marts follow from states that are summed anew
for just these partitions. Every step replaces what the same batch wrote before, so one that broke
off is completed by running it again; the last one notes the batch as taken in.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslake import vocab
from saleslake.functions.parsing import coerce_audit_value, filled
from saleslake.operators import chunking, identity, mapping, merge, quality, search, transcripts
from saleslake.operators.joins import fan_out_join, spread, union_all
from saleslake.operators.ranking import number_rows
from saleslake.plans.marts import deal_state
from saleslake.plans.refresh import follow, with_states, write_marts
from saleslake.session import discard, durable, kept, release
from saleslake.sources import bronze
from saleslake.sources.lake import BUCKETS, CODEC, PART, batch_part, bucket, commit, overwrite_parts, parts_of, read_table, registered, registry, replace_part, widen

# Facts that are only ever added to, one partition for each batch.
EVENT_FACTS = ["fact_interactions", "fact_insights", "fact_transactions", "fact_hr_records"]
#: Bytes of account names that are sent to every task; with more, facts and names are shuffled to meet.
NAMES_SENT = 32 << 20
_KEYS = {"dim_account": ["account_name"], "dim_contact": ["contact_name", "account_name"], "dim_department": ["name"]}


@dataclass
class Report:
    """What a batch did."""

    status: str
    rejected: int = 0
    columns_added: dict[str, dict[str, str]] = field(default_factory=dict)
    fields_ignored: list[str] = field(default_factory=list)
    other_accounts: int = 0
    mart_rows: dict[str, int] = field(default_factory=dict)


def family_of(source: str) -> str | None:
    name = source.strip().lower()
    return next((f for f, aliases in vocab.SOURCE_ALIASES.items() if name in aliases), None)


def empty(spark: SparkSession, table: str) -> DataFrame:
    columns = ", ".join(f"{c} {'bigint' if c == 'account_id' else 'string'}" for c in mapping.target_columns(table))
    stamps = ", created_at timestamp, updated_at timestamp" if table == "fact_deals" else ""
    return spark.createDataFrame([], f"id bigint, {columns}{stamps}")


def read_silver(spark: SparkSession, lake: str) -> dict[str, DataFrame]:
    """Current silver tables; empty ones before the first batch."""
    tables, known = {}, registry(spark, lake)
    for table in vocab.SILVER_TABLES:
        found = read_table(spark, lake, f"silver/{table}", known=known)
        tables[table] = empty(spark, table) if found is None else merge.append(empty(spark, table), found)
    return tables


def _write_batch(df: DataFrame, path: str, batch_id: str) -> None:
    """The batch's own partition of the raw or audit layer, replaced as a whole."""
    df.write.mode("overwrite").option("compression", CODEC).parquet(f"{path}/batch_id={quote(batch_id, safe='')}")


def ingest_structured(
    spark: SparkSession,
    batch: DataFrame,
    source: str,
    batch_id: str,
    lake: str,
    as_of: str,
    routing: dict[str, str] | None = None,
    force: bool = False,
) -> Report:
    """Take in a CRM, ERP or HR batch. ``batch`` has an order column ``seq``."""
    raw = batch.drop("seq")
    stamped = bronze.bronze_rows(raw, source).withColumn("created_at", F.current_timestamp())
    _write_batch(stamped, f"{lake}/bronze", batch_id)
    if not force and not quality.batch_relevance(raw).first().is_relevant:
        return Report("skipped")
    family = family_of(source)
    if family is None:
        return Report("unclassified")

    known = {table: df.columns for table, df in read_silver(spark, lake).items()}
    fresh = [r.field for r in mapping.unmapped_fields(batch, family, "seq", known=known).select("field").collect()]
    evolution = mapping.evolve(fresh, routing or {})
    mapped = {
        table: mapping.map_table(batch, family, table, ["seq"], evolution.added.get(table), known[table])
        for table in {*vocab.FIELD_MAPS[family], *evolution.added}
    }
    report = _load(spark, mapped, source, batch_id, lake, as_of, evolution)
    report.columns_added, report.fields_ignored = evolution.added, evolution.ignored
    return report


def ingest_for_account(
    spark: SparkSession, batch: DataFrame, account: str, source: str, batch_id: str, lake: str, as_of: str, **options
) -> Report:
    """Take in a batch under one account, whatever accounts its records name.

    The other names found in it are kept as the batch's part of ``account_mismatches``, for whoever has to judge whether
    the file belongs to the account; their number is reported."""
    others = durable(mapping.other_accounts(batch, account).select(F.lit(account).alias("account_name"), F.col("account_name").alias("other_name")))
    replace_part(others, lake, "account_mismatches", batch_part(batch_id))
    report = ingest_structured(spark, mapping.stamp_account(batch, account), source, batch_id, lake, as_of, **options)
    report.other_accounts = others.count()
    return report


def ingest_transcripts(
    spark: SparkSession, docs: DataFrame, source: str, batch_id: str, lake: str, as_of: str, force: bool = False
) -> Report:
    """Take in meeting notes: rows of ``doc_id`` and ``text``, and of ``filename`` and ``account_name`` if they are known.

    Every note is a file of its own: one without relevance to sales stays in bronze (unless ``force``). The chunks of the
    others go to the table ``document_chunks`` for the vector index."""
    raw = docs.select(F.col("text").alias("raw_transcript"))
    _write_batch(
        bronze.bronze_rows(raw, source).withColumn("created_at", F.current_timestamp()), f"{lake}/bronze", batch_id
    )
    if not force:
        docs = durable(quality.text_relevance(docs).where("is_relevant").drop("hits", "is_relevant"))
        if docs.isEmpty():
            return Report("skipped")
    extracted = durable(transcripts.extract(spread(docs.select("doc_id", "text"))).drop("text"))
    given = {"filename": F.col("doc_id").cast("string"), "account_name": F.lit(None).cast("string")}
    named = docs.withColumns({c: v for c, v in given.items() if c not in docs.columns})
    pieces = chunking.chunk(named.select("filename", "account_name", "text")).withColumn("source", F.lit(source))
    return _load(spark, _in_order(transcripts.entities(extracted)), source, batch_id, lake, as_of, mapping.Evolution(), {"document_chunks": pieces})


def _in_order(entities: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Extracted records with an order column: by document, people of a document by their place in it."""
    people = entities["dim_contact"]
    seq = F.col("doc_id").cast("decimal(38,0)") * 1_000_000 + F.col("place")
    return {**{t: df.withColumnRenamed("doc_id", "seq") for t, df in entities.items()},
            "dim_contact": people.withColumn("seq", seq).drop("doc_id", "place")}


def enrich_from_bronze(
    spark: SparkSession, question: str, batch_id: str, lake: str, as_of: str, account: str | None = None
) -> Report:
    """Take the raw records that a question is about into silver, and bring the marts up to date.

    Of each source's records the entities are extracted and loaded like a batch of notes, under ``<source>_enriched``."""
    records = spark.read.parquet(f"{lake}/bronze").withColumn("id", F.xxhash64("source", "raw_payload", "created_at"))
    extracted = durable(search.extract_records(search.relevant_records(records, question, account)).drop("text"))
    report = Report("skipped")
    for row in extracted.select("source").distinct().orderBy("source").collect():  # three records at most
        found = transcripts.entities(extracted.where(F.col("source") == row.source).drop("source"))
        report = _load(spark, _in_order(found), row.source, f"{batch_id}-{row.source}", lake, as_of, mapping.Evolution())
    return report


def _load(
    spark: SparkSession,
    mapped: dict[str, DataFrame],
    source: str,
    batch_id: str,
    lake: str,
    as_of: str,
    evolution: mapping.Evolution,
    beside: dict[str, DataFrame] | None = None,
) -> Report:
    # Every value is read back once; the audit trail and the load read the results.
    coerced = {t: kept(_read_back(df)) for t, df in mapped.items()}
    audit = bronze.coerced_audit_rows({t: _audit_form(df) for t, df in coerced.items()}, batch_id, source, "deterministic")
    _write_batch(audit.drop("batch_id"), f"{lake}/audit", batch_id)

    silver = read_silver(spark, lake)
    valid, rejects, held = {}, [], {}
    for table, df in coerced.items():
        extra = [*evolution.added.get(table, {}), *silver[table].columns]
        loaded = mapping.to_silver(df, table, ["seq"], extra)
        if table == "dim_contact":
            loaded = loaded.withColumn("contact_name", mapping.contact_identity(loaded.columns))
        # Written before it is split: each side would repeat the conversions, and again in every filter pushed below them.
        held[table] = kept(loaded)
        discard(df)
        good, bad = quality.split(held[table], table)
        valid[table] = good
        rejects.append(bad)
    own = batch_part(batch_id)
    rejected = durable(union_all(rejects))
    replace_part(rejected, lake, "silver/data_quality_issues", own)

    # Dimensions first: facts resolve against the accounts this batch brings.
    for table, keys in _KEYS.items():
        if table in valid:
            # A source without one of the keys (HR knows no accounts) has it empty.
            brought = valid[table].withColumns({k: F.lit(None).cast("string") for k in keys if k not in valid[table].columns})
            merge_table(spark, lake, table, brought, keys, "seq")
    facts = {t: df for t, df in valid.items() if t.startswith("fact_")}
    names = union_all(
        [
            df.select(F.col("account_name").alias("name"), F.lit(source).alias("source"), "seq")
            for t, df in valid.items()
            if t != "dim_contact" and "account_name" in df.columns
        ]
        or [spark.createDataFrame([], "name string, source string, seq bigint")]
    )
    accounts = read_table(spark, lake, "silver/dim_account")
    accounts = empty(spark, "dim_account") if accounts is None else merge.append(empty(spark, "dim_account"), accounts)
    names = durable(_first_and_last(names))
    for table in valid.keys() - facts.keys():
        discard(held[table])
    resolved, created = identity.resolve(names, accounts)
    resolved = durable(resolved)
    merge_table(spark, lake, "dim_account", created.withColumn("seq", F.lit(0).cast("bigint")), _KEYS["dim_account"], "seq")

    seen = durable(identity.source_map_rows(names, resolved).withColumn(PART, _map_bucket()))
    source_map = read_table(spark, lake, "silver/account_source_map", parts=True)
    mapped_before = seen.drop("seq", PART).limit(0) if source_map is None else source_map.where(F.col(PART).isin(parts_of(seen))).drop(PART)
    after = identity.upsert_source_map(mapped_before, seen.drop(PART))
    overwrite_parts(after.withColumn(PART, _map_bucket()), lake, "silver/account_source_map")

    ids = resolved.select(F.col("name").alias("account_name"), F.col("account_id").alias("_found"))
    few = (resolved.agg(F.sum(F.octet_length("name") + 64)).first()[0] or 0) <= NAMES_SENT
    for table, df in facts.items():
        name = f"silver/{table}"
        linked = df
        if "account_name" in df.columns:
            linked = fan_out_join(df, ids, ["account_name"], "seq", sent=few).withColumnRenamed("_found", "account_id")
        if table in EVENT_FACTS:
            # Ids go on from the other batches', in the order of the batch: the newest rows have the largest.
            # Each copy of the rows goes as soon as the next one is written.
            linked = linked if few else kept(linked)
            events = number_rows(linked, [F.col("seq"), F.xxhash64(*df.columns)], "id", store=kept)
            # With ``few`` names these are the loaded rows' files.
            for done in (linked, held[table]):
                discard(done)
            release(spark)
            numbered = events.withColumn("id", F.col("id") + _top(spark, lake, name, own)).drop("seq")
            replace_part(numbered, lake, name, own)
            if table == "fact_interactions":
                follow(merge.append(empty(spark, table), numbered).withColumn(PART, F.lit(own)), lake, "state/interactions")
            discard(events)
        else:
            _merge_deals(spark, lake, linked, batch_id)
            discard(held[table])
    for table, df in (beside or {}).items():
        replace_part(df, lake, f"silver/{table}", own)
    counts = write_marts(with_states(spark, read_silver(spark, lake), lake), as_of, lake)
    commit(spark, lake, batch_id, source)
    return Report("success", rejected=rejected.count(), mart_rows=counts)


def _read_back(df: DataFrame) -> DataFrame:
    """Mapped records in the audit trail's form, the source record as it came."""
    return df.withColumns({c: coerce_audit_value(F.col(c).cast("string"), c) for c in df.columns if c not in ("seq", "source_data")})


def _audit_form(df: DataFrame) -> DataFrame:
    fields = df.drop("seq")
    whole = "source_data" in fields.columns
    return fields.withColumn("source_data", coerce_audit_value(F.col("source_data").cast("string"), "source_data")) if whole else fields


def _first_and_last(names: DataFrame) -> DataFrame:
    """Of every name its first and last place in the batch: all that resolving and the source map ask for."""
    ends = names.groupBy("name", "source").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    return ends.select("name", "source", F.explode(F.array("first", "last")).alias("seq"))


def _map_bucket() -> Column:
    return bucket(["account_id", "source", "source_name"], BUCKETS)


def _top(spark: SparkSession, lake: str, name: str, own: str) -> int:
    """Largest id outside the batch's own partition."""
    rows = read_table(spark, lake, name, parts=True)
    return 0 if rows is None else rows.where(F.col(PART) != own).agg(F.max("id")).first()[0] or 0


def _touched(spark: SparkSession, lake: str, table: str, parts: list[str]) -> DataFrame:
    """The rows of some partitions of a silver table."""
    rows = read_table(spark, lake, f"silver/{table}", parts=True)
    return empty(spark, table) if rows is None else merge.append(empty(spark, table), rows.where(F.col(PART).isin(parts)).drop(PART))


def merge_table(spark: SparkSession, lake: str, table: str, batch: DataFrame, keys: list[str], seq: str) -> list[str]:
    """Upsert a batch into a silver table by rewriting the buckets of its keys; returns these."""
    name = f"silver/{table}"
    known = registered(spark, lake, name)
    latest = durable(merge.last_non_null(batch, keys, seq))
    placed = latest.withColumn(PART, bucket(keys, known[1] if known else BUCKETS))
    touched = parts_of(placed)
    if not touched:
        widen(spark, lake, name, empty(spark, table).schema)
        return touched
    merged = merge.upsert(_touched(spark, lake, table, touched), placed.drop(PART), keys, seq)
    rows = durable(merge.assign_ids(merged, base=_top(spark, lake, name, "")))
    overwrite_parts(rows.withColumn(PART, bucket(keys, known[1] if known else BUCKETS)), lake, name)
    return touched


def _merge_deals(spark: SparkSession, lake: str, batch: DataFrame, batch_id: str) -> None:
    """Deals with a full key are merged in their buckets; the others are the batch's own partition."""
    name, own, keys = "silver/fact_deals", batch_part(batch_id), ["deal_name", "account_name"]
    known = registered(spark, lake, name)
    buckets = known[1] if known else BUCKETS
    batch = batch.withColumns({k: F.lit(None).cast("string") for k in keys if k not in batch.columns})
    full = filled(F.col("deal_name")) & filled(F.col("account_name"))
    part = F.when(F.coalesce(full, F.lit(False)), bucket(keys, buckets)).otherwise(own)
    placed = durable(batch.withColumn("batch_id", F.lit(batch_id)).withColumn(PART, part))
    touched = [p for p in parts_of(placed) if p != own]
    merged = merge.merge_deals(_touched(spark, lake, "fact_deals", touched), placed.drop(PART), "seq")
    now = F.current_timestamp()
    fresh = F.col("batch_id").eqNullSafe(batch_id)
    rows = durable(merge.assign_ids(merged, base=_top(spark, lake, name, own)).withColumns(
        {
            "created_at": F.coalesce("created_at", now),
            "updated_at": F.when(fresh, now).otherwise(F.coalesce("updated_at", now)),
            PART: part,
        }
    ))
    overwrite_parts(rows.where(F.col(PART) != own), lake, name, buckets)
    follow(rows.where(F.col(PART) != own), lake, "state/deals")
    loose = rows.where(F.col(PART) == own).drop(PART)
    replace_part(loose, lake, name, own)
    replace_part(deal_state(merge.append(empty(spark, "fact_deals"), loose)), lake, "state/deals", own)
