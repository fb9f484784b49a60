"""Validation of silver records as error and warning columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saleslake import vocab
from saleslake.functions.parsing import clean_currency, not_blank, strip

# Texts Python's float() accepts: digits (with single underscores between them), fraction,
# exponent, and the words for infinity and not-a-number.
_DIGITS = r"[0-9](?:_?[0-9])*"
NUMBER_PATTERN = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)\z"
)
_WORD = r"[\p{L}\p{N}_]"
ROLE_PATTERN = rf"(?i)(?<!{_WORD})(?:{vocab.ROLE_TITLES})(?!{_WORD})"

# table -> fields that must be filled, groups of which one must be, numeric fields
_REQUIRED = {"dim_account": ["account_name"], "dim_contact": ["contact_name"], "fact_deals": ["deal_name"]}
_NEEDS_ACCOUNT = ["fact_deals", "fact_interactions", "fact_insights"]
_NUMERIC = {"fact_deals": ["deal_value"]}
_ENUMS = {
    "dim_account": ["vertical", "geography"],
    "fact_deals": [
        "vertical", "horizontal", "engagement_model", "opportunity_stage", "ai_influenced", "business_type",
    ],
}
_DATES = {"fact_deals": ["close_date"], "fact_interactions": ["interaction_date"]}


def is_number_text(value: Column) -> Column:
    return clean_currency(value).rlike(NUMBER_PATTERN)


def _text(field: str, columns: list[str]) -> Column:
    return F.col(field).cast("string") if field in columns else F.lit(None).cast("string")


def errors(table: str, columns: list[str]) -> Column:
    """Array of the reasons to reject a record; empty for a valid one."""
    found = []
    if table in _NEEDS_ACCOUNT:
        either = not_blank(_text("account_id", columns)) | not_blank(_text("account_name", columns))
        found.append(F.when(~either, "At least one of account_id, account_name is required"))
    for field in _REQUIRED.get(table, []):
        found.append(F.when(~not_blank(_text(field, columns)), f"{field} is required and cannot be empty"))
    for field in _NUMERIC.get(table, []):
        value = _text(field, columns)
        message = F.concat(F.lit(f"{field} must be numeric, got: '"), value, F.lit("'"))
        found.append(F.when(not_blank(value) & ~is_number_text(value), message))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def warnings(table: str, columns: list[str]) -> Column:
    """Array of remarks that never reject a record."""
    found = []
    for field in _ENUMS.get(table, []):
        value, known = _text(field, columns), vocab.ENUM_FIELDS[field]
        message = F.concat(
            F.lit(f"{field} value '"), value,
            F.lit(f"' is not a recognized value. Expected one of: {', '.join(sorted(known))}"),
        )
        found.append(F.when(not_blank(value) & ~F.lower(strip(value)).isin(known), message))
    for field in _DATES.get(table, []):
        value = strip(_text(field, columns))
        shaped = F.lit(False)
        for pattern in vocab.DATE_SHAPES:
            shaped = shaped | value.rlike(pattern)
        message = F.concat(
            F.lit(f"{field} value '"), value, F.lit("' does not look like a date (expected YYYY-MM-DD)")
        )
        found.append(F.when((value != "") & ~shaped, message))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def completeness(required: list[str], fields: list[str]) -> Column:
    """Share of filled fields, required ones counting double."""
    weights = {f: 2 if f in required else 1 for f in fields}
    if not weights:
        return F.lit(1.0)
    score = F.lit(0)
    for field, weight in weights.items():
        score = score + F.when(not_blank(F.col(field).cast("string")), weight).otherwise(0)
    return F.round(score / F.lit(float(len(fields) + len(required))), 3)


def relevance_hits(blob: Column, column_names: list[str]) -> Column:
    """Evidence that a text belongs to the sales domain."""
    lowered = F.lower(blob)
    hints = len({c.lower() for c in column_names} & set(vocab.SALES_COLUMN_HINTS))
    hits = F.lit(hints)
    for word in vocab.SALES_KEYWORDS:
        hits = hits + F.contains(lowered, F.lit(word)).cast("int")
    role = F.when(blob.rlike(ROLE_PATTERN), 2).otherwise(0)
    money = F.when(blob.rlike(vocab.RELEVANCE_MONEY_PATTERN), 1).otherwise(0)
    return (hits + role + money).cast("bigint")
