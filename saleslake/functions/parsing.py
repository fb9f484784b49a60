"""Column helpers for text-typed business values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wide enough for 32 digits before the point; six after it are more than any currency has.
AMOUNT_TYPE = "decimal(38,6)"
# The characters Unicode counts as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def amount(value: Column) -> Column:
    """Plain digits-and-dots text as a decimal; anything else (also ``1.2.3``) is NULL."""
    return F.when(value.rlike(r"^[0-9.]+\z"), value.try_cast(AMOUNT_TYPE))


def same_text(value: Column, word: str) -> Column:
    """Case-insensitive equality, without trimming."""
    return F.lower(value) == word


def is_won(stage: Column) -> Column:
    return same_text(stage, "closed won")


def is_lost(stage: Column) -> Column:
    return same_text(stage, "closed lost")


def is_closed(stage: Column) -> Column:
    return F.lower(stage).startswith("closed")


def is_open(stage: Column) -> Column:
    """NULL for a NULL stage: such a deal is neither open nor closed."""
    return ~is_closed(stage)


def has_text(value: Column, word: str) -> Column:
    """Case-insensitive literal substring test."""
    return F.contains(F.lower(value), F.lit(word))


def filled(value: Column) -> Column:
    """Not NULL and not the empty string; blanks count as filled."""
    return value.isNotNull() & (value != "")


def _plain(value: Column) -> Column:
    """Begins with a visible ASCII character: the common case, told from one byte."""
    return F.ascii(value).between(33, 126)


def not_blank(value: Column) -> Column:
    """Not NULL and not only whitespace."""
    return bind(value, lambda v: v.isNotNull() & (_plain(v) | (F.btrim(v, F.lit(WHITESPACE)) != "")))


def strip(value: Column) -> Column:
    """Trim every kind of whitespace (``trim`` alone only removes spaces)."""
    return bind(
        value,
        lambda v: F.when(_plain(v) & _plain(F.right(v, F.lit(1))), v).otherwise(F.btrim(v, F.lit(WHITESPACE))),
    )


def name_key(value: Column) -> Column:
    """Join key under which account spellings are considered equal."""
    return F.lower(F.trim(value))


def iso_date(value: Column) -> Column:
    return F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), value.try_cast("date"))


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("bigint")


def as_of_date(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def clean_currency(value: Column) -> Column:
    return strip(F.regexp_replace(value, "[,$€£]", ""))


def canonical_text(value: Column, kind: str = "string") -> Column:
    """Value as stored in silver: JSON for nested, true/false for flags, NULL when empty."""
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(value)
    text = value.cast("string")
    if kind != "string":
        return text
    # Most values begin and end with a visible character and stay as they are.
    clean = _plain(text) & _plain(F.right(text, F.lit(1)))
    return F.when(clean, text).when(text != "", strip(text))


def coerce_audit_value(value: Column, field: str) -> Column:
    """Text of the audit trail as it reads back: JSON kept, numbers in canonical form.

    Whole floats lose their fraction unless the field is a rate or a multiplier; digit
    text loses leading zeros. Other text is stripped, and sentiment lower-cased.

    Most values read back as they are, which their first and last character or one pattern
    tells; only the others go through all of the rules.
    """
    def coerced(body: Column) -> Column:
        plain_number = F.when(body.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)\z"), body)
        # An exponent is written out where a decimal holds the same number, else the text stays.
        power = body.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+\z")
        written = F.when(power, body.try_cast("decimal(38,18)"))
        exact = F.when(written.cast("double") == body.try_cast("double"), written.cast("string"))
        digits = F.when(body.rlike(r"^-*[0-9]+\z"), body.try_cast("decimal(38,0)").cast("string"))
        plain = F.lower(body) if field == "sentiment" else body
        return F.coalesce(bind(F.coalesce(plain_number, exact), number_text), digits, plain)

    def number_text(number: Column) -> Column:
        """Digits without zeros before or after; nothing is rounded."""
        whole = F.regexp_extract(number, r"^[+-]?0*([0-9]*)", 1)
        fraction = F.regexp_extract(number, r"\.([0-9]*?)0*\z", 1)
        end = ".0" if field.endswith(("rate", "multiplier")) else ""
        body = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(fraction == "", end).otherwise(F.concat(F.lit("."), fraction)))
        negative = number.startswith("-") & ((whole != "") | (fraction != ""))
        return F.when(number.isNotNull(), F.concat(F.when(negative, "-").otherwise(""), body))

    is_json = value.rlike(r"^[\[{]") & F.try_parse_json(value).isNotNull()
    slow = F.when(is_json, value).otherwise(bind(strip(value), coerced))
    if field == "sentiment":
        return slow
    # Visible characters at both ends: nothing to strip. A letter begins no number, a bracket neither, JSON or not.
    first, end = F.ascii(value), _plain(F.right(value, F.lit(1)))
    text = (first.between(65, 91) | first.between(97, 123)) & end  # A to Z and [, a to z and {
    number = first.between(48, 57) & value.rlike(r"^(?:[1-9][0-9]{0,36}|(?:0|[1-9][0-9]*)\.[0-9]*[1-9])\z")
    return F.when(text | number, value.cast("string")).otherwise(slow)


def init_cap(value: Column) -> Column:
    """Capital after every non-alphanumeric character, rest lower case."""
    runs = F.regexp_extract_all(F.lower(value), F.lit("([a-z0-9]+|[^a-z0-9]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), run.substr(F.lit(2), F.length(run)))),
        "",
    )


def column_name(field: str) -> str:
    """Silver column name for a newly seen source field."""
    return field.lower().replace(" ", "_").replace("-", "_")


def leading_number(value: Column) -> Column:
    """Numeric prefix of a text (``12abc`` is 12, ``-5`` is -5), zero when there is none."""
    prefix = F.regexp_extract(value, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.coalesce(prefix.try_cast("double"), F.lit(0.0))


def closing_band(days: Column) -> Column:
    return F.when(days <= 7, "urgent").when(days <= 30, "soon").when(days.isNotNull(), "later")


def currency_label(value: Column) -> Column:
    """Compact label: $1.5M, $20K, $300, $0."""
    small = F.regexp_replace(F.format_string("%.3f", value.cast("double")), r"\.?0+\z", "")
    return (
        F.when(value >= 1_000_000, F.format_string("$%.1fM", value / 1_000_000.0))
        .when(value >= 1_000, F.format_string("$%.0fK", value / 1_000.0))
        .when(value > 0, F.concat(F.lit("$"), small))
        .otherwise("$0")
    )


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, halves up, in integer arithmetic; 0 for an empty whole."""
    tenths = F.call_function("div", part * 2000 + whole, F.nullif(whole * 2, F.lit(0)))
    return F.coalesce(tenths / F.lit(10.0), F.lit(0.0))
