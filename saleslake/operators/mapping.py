"""Source fields to silver columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslake import vocab
from saleslake.functions.parsing import bind, canonical_text, clean_currency, column_name, strip
from saleslake.operators.joins import union_all

_SYSTEM_COLUMNS = ["id", "created_at", "updated_at", "account_id"]


def source_family(source: Column) -> Column:
    """Mapping family of a source name; NULL for an unknown source."""
    name = F.lower(strip(source))
    result = F.lit(None).cast("string")
    for family, aliases in vocab.SOURCE_ALIASES.items():
        result = F.when(name.isin(aliases), family).otherwise(result)
    return result


def mapped_fields(family: str) -> set[str]:
    """Every source field some table of the family consumes."""
    return {src for fields in vocab.FIELD_MAPS[family].values() for src in fields.values()}


def pass_through(columns: list[str], family: str, table: str, known: list[str] | None = None) -> list[str]:
    """Unmapped source fields that equal a column of the target: those it starts with, and ``known`` ones."""
    target = {*vocab.SILVER_COLUMNS.get(table, []), *(known or [])} - {*_SYSTEM_COLUMNS, "source_data", "batch_id"}
    return [c for c in columns if c in target and c not in mapped_fields(family)]


def map_table(
    df: DataFrame,
    family: str,
    table: str,
    carry: list[str] | None = None,
    extra: dict[str, str] | None = None,
    known: list[str] | None = None,
) -> DataFrame:
    """Rows of one target table: renamed fields, same-name fields, then routed ``extra`` ones.

    ``known`` are the columns the target has by now. A NULL field counts as absent. A row is kept when it has its dimension key, or any
    value beyond the context columns. Facts keep the whole source record as JSON.
    """
    carry = carry or []
    sources = {dst: src for dst, src in vocab.FIELD_MAPS[family].get(table, {}).items() if src in df.columns}
    sources.update({c: c for c in pass_through([c for c in df.columns if c not in carry], family, table, known)})
    sources.update({dst: src for dst, src in (extra or {}).items() if src in df.columns})
    kinds = dict(df.dtypes)
    values = {
        dst: F.to_json(F.col(src)) if kinds[src].startswith(("array", "struct", "map")) else F.col(src).cast("string")
        for dst, src in sources.items()
    }
    if table == "dim_contact" and "contact_name" not in values:
        values["contact_name"] = contact_identity(df.columns)
    worth = [F.col(sources.get(d, d)) for d in values if d not in vocab.CONTEXT_COLUMNS]
    key = vocab.DIMENSION_KEYS.get(table)
    if key in sources:
        worth.append(F.col(sources[key]))
    keep = reduce(lambda a, b: a | b, [c.isNotNull() for c in worth]) if worth else F.lit(False)
    record = [c for c in df.columns if c not in carry]
    if table.startswith("fact_"):
        values["source_data"] = F.to_json(F.struct(*record))
    return df.where(keep).select(*carry, *[v.alias(n) for n, v in values.items()])


def map_all(df: DataFrame, family: str, carry: list[str] | None = None) -> dict[str, DataFrame]:
    return {table: map_table(df, family, table, carry) for table in vocab.FIELD_MAPS[family]}


def preview(df: DataFrame, family: str, carry: list[str] | None = None) -> DataFrame:
    """How many records each target table would get, without writing any."""
    counts = [
        rows.agg(F.count(F.lit(1)).alias("records")).select(F.lit(table).alias("target"), "records")
        for table, rows in map_all(df, family, carry).items()
    ]
    return union_all(counts)


def unmapped_fields(
    df: DataFrame, family: str, seq: str, carry: list[str] | None = None, known: dict[str, list[str]] | None = None
) -> DataFrame:
    """Fields no table takes, with a sample of at most 100 characters from the first row having one.

    The candidates are columns, so one aggregate over the batch finds all samples.
    """
    taken = mapped_fields(family) | {seq, *(carry or [])}
    for table in vocab.SILVER_TABLES:
        taken |= set(pass_through(df.columns, family, table, (known or {}).get(table)))
    fields = [c for c in df.columns if c not in taken]
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, sample_value string, source_type string")
    firsts = df.agg(
        *[
            F.min_by(F.substring(F.col(c).cast("string"), 1, 100), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c)
            for c in fields
        ]
    )
    return (
        firsts.unpivot([], fields, "field", "sample_value")
        .where(F.col("sample_value").isNotNull())
        .withColumn("source_type", F.lit(family))
    )


@dataclass
class Evolution:
    """Outcome of routing unmapped fields: new columns per table, and what was left out."""

    added: dict[str, dict[str, str]] = field(default_factory=dict)
    ignored: list[str] = field(default_factory=list)


def evolve(fields: list[str], routing: dict[str, str]) -> Evolution:
    """Route new fields to silver tables by an explicit ``{field: table}`` table."""
    outcome = Evolution()
    for name in fields:
        table = routing.get(name, "").split(".")[-1]
        if table in vocab.SILVER_TABLES:
            outcome.added.setdefault(table, {})[column_name(name)] = name
        else:
            outcome.ignored.append(name)
    return outcome


def contact_identity(columns: list[str]) -> Column:
    """Name of a contact: the first name-like field, else the account's general contact."""
    names = [F.col(c).cast("string") for c in vocab.CONTACT_NAME_FALLBACKS if c in columns]
    names = [F.nullif(n, F.lit("")) for n in names]
    general = (
        F.concat(F.nullif(F.col("account_name"), F.lit("")), F.lit(" (General)"))
        if "account_name" in columns
        else F.lit(None).cast("string")
    )
    return F.coalesce(*names, general)


def target_columns(table: str) -> list[str]:
    """Columns a table starts with, and those that some field map fills."""
    mapped = [dst for fields in vocab.FIELD_MAPS.values() for dst in fields.get(table, {})]
    return list(dict.fromkeys([*vocab.SILVER_COLUMNS.get(table, []), *mapped, "source_data"]))


def to_silver(mapped: DataFrame, table: str, carry: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """Columns of the target only, as canonical text, empty rows dropped.

    A target has the columns it starts with, all that a field map fills, and the ``extra`` ones."""
    carry = carry or []
    wanted = [c for c in dict.fromkeys([*target_columns(table), *(extra or [])]) if c in mapped.columns and c not in carry]
    values = {c: canonical_text(F.col(c).cast("string")) for c in wanted}
    if "sentiment" in values:
        values["sentiment"] = F.lower(values["sentiment"])
    if "deal_value" in values:
        values["deal_value"] = clean_currency(values["deal_value"])
    return mapped.select(*carry, *[v.alias(n) for n, v in values.items()]).dropna("all", subset=wanted)


def account_names(columns: list[str]) -> Column:
    """The account a raw record speaks of: first non-empty of its naming fields."""
    options = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ["account_name", "company", "account"] if c in columns]
    if not options:
        return F.lit(None).cast("string")
    return bind(strip(F.coalesce(*options)), lambda name: F.when(F.length(name) > 1, name))


def batch_accounts(df: DataFrame) -> DataFrame:
    """Distinct account names of a batch."""
    name = account_names(df.columns).alias("account_name")
    return df.select(name).where(F.col("account_name").isNotNull()).distinct()


def other_accounts(df: DataFrame, account: str) -> DataFrame:
    """Names in the batch that differ from the account it is loaded for."""
    return batch_accounts(df).where(F.lower(strip(F.col("account_name"))) != account.strip().lower())


def stamp_account(df: DataFrame, account: str) -> DataFrame:
    return df.withColumn("account_name", F.lit(account))


def table_preview(df: DataFrame, order: str, rows: int = 5, columns: int = 8) -> DataFrame:
    """First rows and columns of a file, values cut to 30 characters."""
    shown = [c for c in df.columns if c not in ("account_name", "raw_transcript", order)][:columns]
    return df.orderBy(order).limit(rows).select(
        order, *[F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, 30).alias(c) for c in shown]
    )


def table_shape(df: DataFrame) -> DataFrame:
    """Row count and number of shown columns."""
    shown = [c for c in df.columns if c not in ("account_name", "raw_transcript")]
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(shown)).cast("bigint"))
