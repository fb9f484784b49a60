"""DuckDB statements for the transcript and document queries."""

from __future__ import annotations

from saleslake import vocab
from saleslake.functions.parsing import WHITESPACE


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values: list[str], lower: bool = False) -> str:
    return "[" + ", ".join(q(v.lower() if lower else v) for v in values) + "]"


def strip(expr: str) -> str:
    return f"trim({expr}, '{WHITESPACE}')"


def first(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(text, {q(pattern)}, {group}), '')"


def every(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(text, {q(pattern)}, {group})"


def hits(values: list[str]) -> str:
    return f"len(list_filter({words(values)}, lambda w: contains(lower(text), w)))"


def any_of(values: list[str]) -> str:
    return f"{hits(values)} > 0"


SPEAKERS = (
    f"list_distinct(list_concat({every(vocab.SPEAKER_PATTERN, 1)}, "
    f"list_filter(list_transform(string_split(coalesce({first(vocab.PARTICIPANTS_PATTERN)}, ''), ','), "
    f"lambda n: {strip('n')}), lambda n: n <> '')))"
)
COMPANY = "coalesce(" + ", ".join(strip(first(p)) for p in vocab.COMPANY_PATTERNS) + ", 'Unknown')"
INDUSTRY = (
    f"coalesce(nullif({strip(first(vocab.INDUSTRY_LABEL_PATTERN))}, ''), CASE "
    + " ".join(f"WHEN {any_of(ws)} THEN {q(name)}" for name, ws in vocab.INDUSTRY_KEYWORDS.items())
    + " END)"
)
_REV = f"TRY_CAST(replace({first(vocab.REVENUE_PATTERN, 1)}, ',', '') AS DECIMAL(20,6))"
REVENUE = (
    f"CAST(CAST(floor({_REV} * CASE WHEN lower({first(vocab.REVENUE_PATTERN, 2)}) LIKE 'b%' "
    f"THEN 1000000000 ELSE 1000000 END) AS DECIMAL(38,0)) AS VARCHAR)"
)
MONEY = every(vocab.MONEY_PATTERN)
FIRST_AMOUNT = f"regexp_extract(replace(regexp_extract(text, {q(vocab.MONEY_PATTERN)}), ',', ''), '[\\d.]+')"
_TOPIC_HITS = f"list_filter({words(vocab.TOPIC_WORDS)}, lambda w: contains(lower(text), w))"
TOPICS = (
    f"CASE WHEN len({_TOPIC_HITS}) = 0 THEN ['General Discussion'] ELSE "
    f"list_transform({_TOPIC_HITS}[1:5], lambda w: upper(w[1:1]) || w[2:]) END"
)
_POINTS = (
    f"list_concat(list_transform({MONEY}, lambda m: 'Budget/amount mentioned: ' || m), "
    f"list_transform({every(vocab.ACTION_PATTERN)}[1:5], lambda s: {strip('s')}))"
)
POINTS = f"CASE WHEN len({_POINTS}) = 0 THEN ['Meeting recorded - details require manual review'] ELSE {_POINTS} END"
MARGIN = f"({hits(vocab.POSITIVE_WORDS)} - {hits(vocab.NEGATIVE_WORDS)})"
SENTIMENT = f"CASE WHEN {MARGIN} > 2 THEN 'Positive' WHEN {MARGIN} < -2 THEN 'Negative' ELSE 'Neutral' END"
_HH, _MM = every(vocab.TIMESTAMP_PATTERN, 1), every(vocab.TIMESTAMP_PATTERN, 2)


def _stamp(i: int) -> str:
    return f"(CAST({_HH}[{i}] AS BIGINT) * 60 + CAST({_MM}[{i}] AS BIGINT))"


DURATION = f"CASE WHEN len({_HH}) = 0 THEN 10 ELSE greatest({_stamp(-1)} - {_stamp(1)}, 1) END"
COMPETITORS = f"list_filter({words(vocab.COMPETITORS)}, lambda w: contains(lower(text), lower(w)))"
INTENT = (
    f"CASE WHEN {any_of(vocab.HIGH_INTENT_WORDS)} THEN 'High' "
    f"WHEN {any_of(vocab.MEDIUM_INTENT_WORDS)} THEN 'Medium' ELSE 'Low' END"
)
STAGE = (
    "CASE " + " ".join(f"WHEN regexp_matches(text, {q(p)}) THEN {q(n)}" for n, p in vocab.STAGE_PATTERNS.items())
    + " ELSE '' END"
)
DEAL_NAME = strip(f"regexp_extract(text, {q(vocab.DEAL_NAME_PATTERN)}, 1)")
CLOSE_DATE = strip(f"regexp_extract(text, {q(vocab.CLOSE_DATE_PATTERN)}, 1)")


def _contact(group: int) -> str:
    return every(vocab.CONTACT_PATTERN, group)


_STAGE_OR_INTENT = (
    "CASE WHEN st <> '' THEN st WHEN intent = 'High' THEN 'Negotiation' "
    "WHEN intent = 'Medium' THEN 'Proposal' ELSE 'Discovery' END"
)
_SIGNAL = (
    "'Buying intent is ' || intent || '. ' || CASE WHEN budget THEN 'Budget has been confirmed by the prospect.' "
    "ELSE 'Budget not yet confirmed.' END || ' Key signals: ' || array_to_string(points[1:3], '; ') || '.'"
)

_PEOPLE = f"""
people AS (
  SELECT doc_id, company, unnest(list_zip({_contact(1)}, {_contact(2)}, {_contact(3)})) AS p, text,
    unnest(range(len({_contact(1)}))) AS pos
  FROM (SELECT doc_id, text, {COMPANY} AS company FROM texts)
), named AS (
  SELECT doc_id, company, pos, {strip('p[1]')} AS contact_name, coalesce({strip('p[2]')}, '') AS role, coalesce({strip('p[3]')}, '') AS department
  FROM people
), first_named AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, contact_name ORDER BY pos) AS nth FROM named
  WHERE contact_name <> '' AND len(string_split_regex(contact_name, '\\s+')) <= 4
), contacts AS (SELECT * FROM first_named WHERE nth = 1)"""

TEXT_SQL = {
    "speakers": f"SELECT doc_id, array_to_string(list_sort({SPEAKERS}), '|') AS speakers FROM texts",
    "company_name": f"SELECT doc_id, {COMPANY} AS company FROM texts",
    "industry_tag": f"""
SELECT doc_id, 'note' AS kind, {INDUSTRY} AS industry FROM transcripts
UNION ALL SELECT doc_id, 'document', {INDUSTRY} FROM documents""",
    "firmographics": f"""
SELECT doc_id, regexp_replace({strip(first(vocab.GEOGRAPHY_PATTERN))}, ',+$', '') AS geography,
  replace({first(vocab.EMPLOYEES_PATTERN)}, ',', '') AS employee_count, {REVENUE} AS annual_revenue
FROM texts""",
    "money_mentions": f"""
SELECT doc_id, array_to_string({MONEY}, '|') AS mentions, {FIRST_AMOUNT} AS deal_value FROM transcripts
UNION ALL SELECT -doc_id - 1, array_to_string({MONEY}, '|'), {FIRST_AMOUNT} FROM documents""",
    "topics_keypoints": f"""
SELECT doc_id, array_to_string({TOPICS}, '|') AS topics, array_to_string({POINTS}, '|') AS key_points FROM transcripts
UNION ALL SELECT -doc_id - 1, array_to_string({TOPICS}, '|'), array_to_string({POINTS}, '|') FROM documents""",
    "lexicon_sentiment": f"""
SELECT doc_id, {hits(vocab.POSITIVE_WORDS)} AS positive, {hits(vocab.NEGATIVE_WORDS)} AS negative,
  {SENTIMENT} AS sentiment FROM transcripts
UNION ALL SELECT -doc_id - 1, {hits(vocab.POSITIVE_WORDS)}, {hits(vocab.NEGATIVE_WORDS)}, {SENTIMENT} FROM documents""",
    "duration_minutes": f"SELECT doc_id, {DURATION} AS duration_minutes FROM texts",
    "competitors": f"SELECT doc_id, array_to_string({COMPETITORS}, '|') AS competitors FROM texts",
    "deal_signals": f"""
SELECT doc_id, len({MONEY}) > 0 AS budget_confirmed, {INTENT} AS buying_intent, {STAGE} AS stated_stage,
  {DEAL_NAME} AS deal_name, {CLOSE_DATE} AS close_date FROM texts""",
    "named_contacts": f"WITH {_PEOPLE} SELECT doc_id, contact_name, role, department FROM contacts",
    "transcript_entities": f"""
WITH {_PEOPLE},
x AS (
  SELECT doc_id, {COMPANY} AS company, {INDUSTRY} AS industry, {SPEAKERS} AS speakers, {SENTIMENT} AS sentiment,
    {DURATION} AS minutes, {COMPETITORS} AS comp, {INTENT} AS intent, {STAGE} AS st, {DEAL_NAME} AS dn,
    {CLOSE_DATE} AS cd, {FIRST_AMOUNT} AS dv, {every(vocab.SPEAKER_PATTERN, 1)} AS stamped
  FROM texts
), lead AS (SELECT doc_id, arg_min(contact_name, pos) AS lead FROM contacts GROUP BY 1)
SELECT 'dim_account' AS entity, doc_id, company AS account_name, coalesce(industry, '') AS record FROM x
UNION ALL SELECT 'dim_contact', doc_id, company, unnest(speakers) || '/Participant' FROM x
UNION ALL SELECT 'dim_contact', doc_id, company, contact_name || '/' || role FROM contacts
UNION ALL SELECT 'fact_interactions', doc_id, company, cd || '/' || lower(sentiment) || '/' || minutes FROM x
UNION ALL SELECT 'fact_deals', x.doc_id, company,
  CASE WHEN dn <> '' THEN dn ELSE company || ' Deal' END || '/' || dv || '/' || {_STAGE_OR_INTENT} || '/' || cd || '/'
  || coalesce(lead, stamped[1], '') FROM x LEFT JOIN lead ON lead.doc_id = x.doc_id
UNION ALL SELECT 'fact_insights', doc_id, company,
  'deal_signal/' || CASE intent WHEN 'High' THEN '0.9' WHEN 'Medium' THEN '0.7' ELSE '0.5' END FROM x
UNION ALL SELECT 'fact_insights', doc_id, company, 'competitive/0.8' FROM x WHERE len(comp) > 0""",
    "insight_text": f"""
WITH x AS (
  SELECT doc_id, {COMPANY} AS account_name, {COMPETITORS} AS comp, {INTENT} AS intent, len({MONEY}) > 0 AS budget,
    {POINTS} AS points FROM texts
)
SELECT doc_id, account_name, 'deal_signal' AS insight_type, {_SIGNAL} AS content,
  CASE intent WHEN 'High' THEN '0.9' WHEN 'Medium' THEN '0.7' ELSE '0.5' END AS confidence, '' AS insight_date FROM x
UNION ALL SELECT doc_id, account_name, 'competitive',
  'Competitors mentioned in conversation: ' || array_to_string(comp, ', ') || '.', '0.8', ''
FROM x WHERE len(comp) > 0""",
    "chunk_documents": f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {strip('text')} AS t FROM documents
), w AS (
  SELECT doc_id, t, 0 AS start, -1 AS stop FROM docs WHERE length(t) >= 50
  UNION ALL
  SELECT doc_id, t, CASE WHEN stop < 0 THEN 0 ELSE stop - 100 END,
    CASE WHEN (CASE WHEN stop < 0 THEN 0 ELSE stop - 100 END) + 500 >= length(t) THEN length(t)
    ELSE (CASE WHEN stop < 0 THEN 0 ELSE stop - 100 END) + 500
      - instr(reverse(substring(t, (CASE WHEN stop < 0 THEN 0 ELSE stop - 100 END) + 401, 100)), ' .') END
  FROM w WHERE stop < length(t)
), c AS (
  SELECT doc_id, start, {strip('substring(t, start + 1, stop - start)')} AS chunk_text FROM w WHERE stop >= 0
), k AS (SELECT * FROM c WHERE chunk_text <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index,
  count(*) OVER (PARTITION BY doc_id) AS total_chunks, chunk_text FROM k""",
    "chunk_ids": f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, account_name, filename, {strip('text')} AS t FROM texts
), w AS (
  SELECT doc_id, account_name, filename, t, 0 AS start, -1 AS stop FROM docs WHERE length(t) >= 50
  UNION ALL
  SELECT doc_id, account_name, filename, t, CASE WHEN stop < 0 THEN 0 ELSE stop - 100 END,
    CASE WHEN (CASE WHEN stop < 0 THEN 0 ELSE stop - 100 END) + 500 >= length(t) THEN length(t)
    ELSE (CASE WHEN stop < 0 THEN 0 ELSE stop - 100 END) + 500
      - instr(reverse(substring(t, (CASE WHEN stop < 0 THEN 0 ELSE stop - 100 END) + 401, 100)), ' .') END
  FROM w WHERE stop < length(t)
)
SELECT doc_id, substring(sha256(lower({strip('filename')}) || '|' || lower({strip('account_name')})), 1, 16)
  || '_chunk_' || (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1) AS chunk_id
FROM w WHERE stop >= 0""",
}
