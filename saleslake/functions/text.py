"""Rule-based extraction from meeting notes, as column expressions over a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saleslake import vocab
from saleslake.functions.parsing import bind, strip


# ------------------------------------------------------------------ small helpers
def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group; NULL when there is none."""
    return bind(F.regexp_extract(text, pattern, group), lambda m: F.when(m != "", m))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def count_contained(text: Column, words: list[str]) -> Column:
    """How many of the words occur."""
    total = F.lit(0)
    for word in words:
        total = total + F.contains(text, F.lit(word)).cast("int")
    return total


def contained(text: Column, words: list[str], label=lambda w: w) -> Column:
    """The words that occur, in list order."""
    hits = [F.when(F.contains(text, F.lit(w.lower())), F.lit(label(w))) for w in words]
    return F.array_compact(F.array(*hits))


def _or_default(values: Column, default: str) -> Column:
    """The values, or the default alone when there are none."""
    return F.filter(F.array(values, F.array(F.lit(default))), lambda v: F.size(v) > 0)[0]


# ------------------------------------------------------------------ who and where
def speakers(text: Column) -> Column:
    """Names of bracketed speaker lines, then of the participants line, without repeats."""
    listed = F.split(F.coalesce(_first(text, vocab.PARTICIPANTS_PATTERN), F.lit("")), ",")
    names = F.filter(F.transform(listed, strip), lambda n: n != "")
    return F.array_union(_all(text, vocab.SPEAKER_PATTERN, 1), names)


def company(text: Column) -> Column:
    """First hit of the ordered company patterns."""
    return F.coalesce(*[strip(_first(text, p)) for p in vocab.COMPANY_PATTERNS], F.lit("Unknown"))


def industry(text: Column) -> Column:
    """Labelled industry, else the first industry one of whose keywords occurs."""

    def by_keyword(lowered: Column) -> Column:
        found = F.lit(None).cast("string")
        for name, words in reversed(list(vocab.INDUSTRY_KEYWORDS.items())):
            found = F.when(contains_any(lowered, words), name).otherwise(found)
        return found

    label = _first(text, vocab.INDUSTRY_LABEL_PATTERN)
    return F.coalesce(bind(strip(label), lambda m: F.when(m != "", m)), bind(F.lower(text), by_keyword))


def geography(text: Column) -> Column:
    return F.regexp_replace(strip(_first(text, vocab.GEOGRAPHY_PATTERN)), r",+\z", "")


def employee_count(text: Column) -> Column:
    return F.regexp_replace(_first(text, vocab.EMPLOYEES_PATTERN), ",", "")


def annual_revenue(text: Column) -> Column:
    """Revenue in full units, as whole-number text."""
    number = F.regexp_replace(_first(text, vocab.REVENUE_PATTERN, 1), ",", "").try_cast("decimal(20,6)")
    in_billions = F.lower(_first(text, vocab.REVENUE_PATTERN, 2)).startswith("b")
    scale = F.when(in_billions, F.lit(1_000_000_000)).otherwise(F.lit(1_000_000))
    return F.floor(number * scale.cast("decimal(10,0)")).cast("decimal(38,0)").cast("string")


# ------------------------------------------------------------------ money, topics, tone
def money_mentions(text: Column) -> Column:
    return _all(text, vocab.MONEY_PATTERN)


def first_amount(text: Column) -> Column:
    """Digits of the first money mention; scale words are ignored."""
    mention = F.regexp_replace(F.regexp_extract(text, vocab.MONEY_PATTERN, 0), ",", "")
    return F.regexp_extract(mention, r"[\d.]+", 0)


def topics(text: Column) -> Column:
    found = bind(F.lower(text), lambda t: contained(t, vocab.TOPIC_WORDS, label=str.capitalize))
    return _or_default(F.slice(found, 1, 5), "General Discussion")


def action_sentences(text: Column) -> Column:
    """Sentences that mention a need, plan or decision.

    Sentences are cut first and then tested, so a text without punctuation is scanned once.
    """
    runs = _all(text, r"[^.!?\n]++[.!?]?")
    verbs = r"(?i)need|want|require|plan|decide|agree|confirm|approve|move forward|ready"
    return F.filter(runs, lambda s: F.right(s, F.lit(1)).isin(".", "!", "?") & s.rlike(verbs))


def key_points(text: Column) -> Column:
    amounts = F.transform(money_mentions(text), lambda m: F.concat(F.lit("Budget/amount mentioned: "), m))
    actions = F.transform(F.slice(action_sentences(text), 1, 5), strip)
    return _or_default(F.concat(amounts, actions), "Meeting recorded - details require manual review")


def sentiment(text: Column) -> Column:
    def by_margin(margin: Column) -> Column:
        return F.when(margin > 2, "Positive").when(margin < -2, "Negative").otherwise("Neutral")

    return bind(
        F.lower(text),
        lambda t: bind(
            count_contained(t, vocab.POSITIVE_WORDS) - count_contained(t, vocab.NEGATIVE_WORDS), by_margin
        ),
    )


def duration_minutes(text: Column) -> Column:
    """First to last bracket stamp, read as hours and minutes; at least 1, 10 without stamps."""

    def minutes_of(stamp: Column) -> Column:
        return F.split_part(stamp, F.lit(":"), F.lit(1)).cast("bigint") * 60 + F.split_part(
            stamp, F.lit(":"), F.lit(2)
        ).cast("bigint")

    def span(stamps: Column) -> Column:
        passed = minutes_of(F.element_at(stamps, -1)) - minutes_of(stamps[0])
        return F.when(F.size(stamps) > 0, F.greatest(passed, F.lit(1)))

    stamps = F.transform(_all(text, vocab.TIMESTAMP_PATTERN), lambda m: F.btrim(m, F.lit("[]")))
    return F.coalesce(bind(stamps, span), F.lit(10)).cast("bigint")


def competitors(text: Column) -> Column:
    return bind(F.lower(text), lambda t: contained(t, vocab.COMPETITORS))


# ------------------------------------------------------------------ the deal
def buying_intent(text: Column) -> Column:
    return bind(
        F.lower(text),
        lambda t: F.when(contains_any(t, vocab.HIGH_INTENT_WORDS), "High")
        .when(contains_any(t, vocab.MEDIUM_INTENT_WORDS), "Medium")
        .otherwise("Low"),
    )


def stated_stage(text: Column) -> Column:
    stage = F.lit("")
    for name, pattern in reversed(vocab.STAGE_PATTERNS.items()):
        stage = F.when(text.rlike(pattern), name).otherwise(stage)
    return stage


def deal_name(text: Column) -> Column:
    return strip(F.regexp_extract(text, vocab.DEAL_NAME_PATTERN, 1))


def close_date(text: Column) -> Column:
    return strip(F.regexp_extract(text, vocab.CLOSE_DATE_PATTERN, 1))


def named_contacts(text: Column) -> Column:
    """Labelled contacts with role and department, first mention of each name."""
    def part(match: Column, group: int) -> Column:
        return strip(F.regexp_extract(match, vocab.CONTACT_PATTERN, group))

    mentions = F.transform(
        _all(text, vocab.CONTACT_PATTERN),
        lambda m: F.struct(
            F.regexp_replace(part(m, 1), r",+\z", "").alias("name"),
            part(m, 2).alias("role"),
            part(m, 3).alias("department"),
        ),
    )
    people = F.filter(mentions, lambda m: (m["name"] != "") & (F.size(F.split(m["name"], r"\s+")) <= 4))

    def first_of_each(found: Column) -> Column:
        names = F.transform(found, lambda m: m["name"])
        return F.filter(found, lambda m, i: F.array_position(names, m["name"]) == i + 1)

    return bind(people, first_of_each)


def primary_contact(contacts: Column, attendees: Column) -> Column:
    return F.coalesce(
        F.try_element_at(F.transform(contacts, lambda c: c["name"]), F.lit(1)),
        F.try_element_at(attendees, F.lit(1)),
        F.lit(""),
    )
