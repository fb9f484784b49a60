"""DuckDB statements for dashboards, vectors, questions and raw search."""

from __future__ import annotations

from harness.oracle_marts import MART_SQL
from harness.oracle_silver import strip
from harness.oracle_text import TEXT_SQL, q, words
from saleslake import vocab
from saleslake.plans.dashboard import VIEW_COLUMNS

_NUM = "CASE WHEN regexp_full_match(deal_value, '[0-9.]+') THEN TRY_CAST(deal_value AS DECIMAL(38,6)) END"
_NAME = "(SELECT lower(account_name) FROM dim_account WHERE id = 10)"
_NUM_SUM = "CAST(coalesce(sum(CASE WHEN {} THEN " + _NUM + " END), 0) AS DOUBLE)"


def _of(table: str, columns: str = "*", tail: str = "") -> str:
    return f"SELECT {columns} FROM {table} WHERE contains(lower(account_name), {_NAME}) {tail}"


def _named(table: str, extra: str = "") -> str:
    return f"SELECT lower(account_name) AS low, count(*) AS n{extra} FROM {table} WHERE account_name IS NOT NULL GROUP BY 1"


def _overview(table: str, value: str) -> str:
    return f"(SELECT a.id, sum({value}) AS v FROM dim_account a JOIN {table} x ON contains(x.low, lower(a.account_name)) GROUP BY 1)"


def _nested(name: str) -> str:
    """A mart statement as a derived table."""
    return f"({MART_SQL[name].strip()})"


def _score(values: list[str], text: str) -> str:
    return f"len(list_filter({words(values)}, lambda w: contains({text}, w)))"


_QL = strip("lower(question)")
_NARR, _METR = _score(vocab.NARRATIVE_KEYWORDS, _QL), _score(vocab.METRIC_KEYWORDS, _QL)
_INTENT = f"CASE WHEN {_NARR} > 0 AND {_NARR} >= {_METR} THEN 'narrative' ELSE 'metric' END"
_GREETING = " OR ".join(
    f"{_QL} = {q(g)} OR starts_with({_QL}, {q(g + ' ')}) OR starts_with({_QL}, {q(g + '!')})" for g in vocab.GREETINGS
)
_CENTROID = """
e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY 1, 2),
topics AS (SELECT label AS q, list(x ORDER BY i) AS v FROM c GROUP BY 1),
s AS (
  SELECT q, vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 10) AS score FROM embeddings, topics
)"""


_ASKED = """
s AS (
  SELECT a.vec_id AS q, a.label AS asked_label, e.vec_id AS vec_id, e.label AS label,
    round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), 10) AS score
  FROM embeddings e, embeddings a WHERE a.vec_id % 20 = 0
)"""


def _topk(where: str = "", scores: str = _ASKED) -> str:
    return f"""
WITH {scores}, r AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s {where}
)
SELECT CAST(q AS BIGINT) AS query_id, rank, vec_id, round(score, 4) AS score FROM r WHERE rank <= 5"""


_CONTEXT = """
WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations
)
SELECT conv_id, string_agg(upper(role) || ': ' || {}, chr(10) ORDER BY turn) AS context FROM r WHERE back <= 6 GROUP BY 1"""
_PROPOSALS = """
p AS (
  SELECT lower('Please answer: which error records moved in period ' || CAST(r_regionkey AS VARCHAR) || ' of the year') AS question,
    'silver.dim_account,silver.' || CASE WHEN r_regionkey < 3 THEN 'dim_contact' ELSE 'fact_insights' END AS tables FROM region
)"""
_HIT = """
b AS (
  SELECT doc_id AS id, lower(text) AS t, created_at FROM transcripts
), k AS (
  SELECT 0 AS no, 'globex industries' AS w UNION ALL SELECT 1, 'acme corp' UNION ALL SELECT 2, 'migration'
), h AS (
  SELECT id, no, row_number() OVER (PARTITION BY no ORDER BY created_at DESC, id DESC) AS hit FROM b JOIN k ON contains(t, w)
), f AS (SELECT id, min(no * 10 + hit) AS place FROM h WHERE hit <= 3 GROUP BY 1),
found AS (SELECT id FROM f ORDER BY place LIMIT 3)"""

SERVING_SQL = {
    "accounts_overview": f"""
WITH c AS ({_named('dim_contact')}), d AS ({_named('fact_deals', f', sum({_NUM}) AS v')}), i AS ({_named('fact_interactions')}),
cc AS {_overview('c', 'n')}, dd AS {_overview('d', 'n')}, dv AS {_overview('d', 'v')}, ii AS {_overview('i', 'n')}
SELECT a.id AS id, a.account_name AS account_name, CAST(coalesce(cc.v, 0) AS BIGINT) AS contact_count,
  CAST(coalesce(dd.v, 0) AS BIGINT) AS deal_count, coalesce(CAST(dv.v AS DOUBLE), 0.0) AS deal_total_value,
  CAST(coalesce(ii.v, 0) AS BIGINT) AS interaction_count
FROM dim_account a LEFT JOIN cc ON cc.id = a.id LEFT JOIN dd ON dd.id = a.id LEFT JOIN dv ON dv.id = a.id LEFT JOIN ii ON ii.id = a.id""",
    "account_detail": "SELECT * FROM dim_account WHERE id = 10",
    "account_detail_contacts": _of("dim_contact"),
    "account_detail_deals": _of("fact_deals", "id, deal_name, account_name, deal_value, deal_stage"),
    "account_detail_interactions": _of("fact_interactions", tail="ORDER BY id DESC LIMIT 20"),
    "account_detail_insights": _of("fact_insights", tail="ORDER BY id DESC LIMIT 20"),
    "pipeline_by_stage": """
SELECT CASE WHEN deal_stage IS NULL OR deal_stage = '' THEN 'Unknown' ELSE deal_stage END AS stage, count(*) AS deal_count,
  CAST(sum(CAST(coalesce(TRY_CAST(nullif(regexp_extract(deal_value,
    '^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE), 0) AS DECIMAL(20,2))) AS DOUBLE) AS stage_value
FROM fact_deals GROUP BY 1""",
    "pipeline_total": """
SELECT CAST(sum(CAST(coalesce(TRY_CAST(nullif(regexp_extract(deal_value,
    '^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE), 0) AS DECIMAL(28,2))) AS DOUBLE) AS total_value
FROM fact_deals""",
    "insights_feed": "SELECT * FROM fact_insights ORDER BY id DESC LIMIT 50",
    "insights_feed_by_type": "SELECT * FROM fact_insights WHERE insight_type = 'deal_signal' ORDER BY id DESC LIMIT 50",
    "insight_types": "SELECT DISTINCT insight_type FROM fact_insights WHERE insight_type <> ''",
    "dashboard_stats": f"""
SELECT (SELECT count(*) FROM dim_account) AS accounts, (SELECT count(*) FROM dim_contact) AS contacts,
  (SELECT count(*) FROM fact_deals) AS deals, (SELECT count(*) FROM fact_interactions) AS interactions,
  (SELECT count(*) FROM fact_insights) AS insights,
  (SELECT CAST(coalesce(sum({_NUM}), 0) AS DOUBLE) FROM fact_deals) AS total_deal_value""",
    "pipeline_share": f"""
WITH s AS (SELECT stage, sum(CAST(total_value AS DECIMAL(28,2))) AS v FROM {_nested('pipeline_health')} GROUP BY 1)
SELECT stage, CAST(v AS DOUBLE) AS total_value, CAST(v AS DOUBLE) / (SELECT CAST(sum(v) AS DOUBLE) FROM s) * 100 AS share FROM s""",
    "closing_bands": f"""
SELECT CASE WHEN days_until_close <= 7 THEN 'urgent' WHEN days_until_close <= 30 THEN 'soon'
  WHEN days_until_close IS NOT NULL THEN 'later' END AS band, count(*) AS deals FROM {_nested('deals_closing_soon')} GROUP BY 1""",
    "mart_row_counts": " UNION ALL ".join(
        f"SELECT {q(name)} AS mart, count(*) AS row_count FROM {_nested(name)}" for name in MART_SQL
    ),
    "revenue_cube": f"""
SELECT vertical, horizontal, geography, engagement_model, business_type, lead_source, ai_influenced,
  CAST(grouping(vertical, horizontal, geography, engagement_model, business_type, lead_source, ai_influenced) AS BIGINT) AS grouping_id,
  count(*) AS deal_count, count(CASE WHEN deal_stage ILIKE 'closed won' THEN 1 END) AS won_count,
  count(CASE WHEN ai_influenced ILIKE 'yes' THEN 1 END) AS ai_influenced_count, {_NUM_SUM.format('TRUE')} AS total_deal_value,
  {_NUM_SUM.format("deal_stage ILIKE 'closed won'")} AS won_value, {_NUM_SUM.format("deal_stage NOT ILIKE 'closed%'")} AS pipeline_value
FROM fact_deals GROUP BY CUBE (vertical, horizontal, geography, engagement_model, business_type, lead_source, ai_influenced)""",
    "semantic_query": f"""
SELECT vertical, lead_source, {_NUM_SUM.format('TRUE')} AS total_deal_value,
  {_NUM_SUM.format("deal_stage ILIKE 'closed won'")} AS won_value,
  {_NUM_SUM.format("deal_stage NOT ILIKE 'closed%'")} AS pipeline_value, count(*) AS deal_count,
  count(CASE WHEN deal_stage ILIKE 'closed won' THEN 1 END) AS won_count,
  count(CASE WHEN ai_influenced ILIKE 'yes' THEN 1 END) AS ai_influenced_count
FROM fact_deals WHERE geography IN ('Onshore', 'Offshore') GROUP BY 1, 2
ORDER BY total_deal_value DESC, vertical, lead_source LIMIT 100""",
    "request_accounts": """
SELECT industry, geography, count(*) AS row_count, CAST(coalesce(sum(CASE WHEN regexp_full_match(annual_revenue, '[0-9.]+')
  THEN TRY_CAST(annual_revenue AS DECIMAL(38,6)) END), 0) AS DOUBLE) AS total_annual_revenue FROM dim_account GROUP BY 1, 2""",
    "request_contacts": """
SELECT role, count(*) AS row_count, count(DISTINCT account_name) AS distinct_account_name,
  count(CASE WHEN role <> '' THEN 1 END) AS filled_role FROM dim_contact GROUP BY 1""",
    "request_deals": f"""
SELECT a.industry AS industry, a.vertical AS account_vertical, horizontal, {_NUM_SUM.format('TRUE')} AS total_deal_value,
  count(CASE WHEN deal_stage ILIKE 'closed won' THEN 1 END) AS won_count, count(DISTINCT account_id) AS distinct_account_id
FROM fact_deals fd LEFT JOIN dim_account a ON a.id = fd.account_id GROUP BY 1, 2, 3""",
    "request_interactions": """
SELECT sentiment, industry, count(*) AS row_count, count(DISTINCT account_id) AS distinct_account_id, max(interaction_date) AS latest_interaction_date
FROM fact_interactions f LEFT JOIN dim_account a ON a.id = f.account_id WHERE geography IN ('Onshore', 'Both') GROUP BY 1, 2""",
    "request_insights": """
SELECT insight_type, vertical, count(*) AS row_count, CAST(sum(CAST(confidence AS DECIMAL(38,6))) AS DOUBLE) AS total_confidence,
  min(insight_date) AS earliest_insight_date FROM fact_insights f LEFT JOIN dim_account a ON a.id = f.account_id GROUP BY 1, 2""",
    "semantic_query_rows": "SELECT id, deal_name, deal_stage FROM fact_deals ORDER BY id DESC LIMIT 100",
    "mart_then_detail": f"""
WITH asked AS (SELECT account_name FROM fact_interactions UNION SELECT account_name FROM fact_insights),
m AS (SELECT account_name, 'risk ' || risk_level AS answer FROM {_nested('at_risk_accounts')})
SELECT m.account_name AS account_name, answer, false AS fallback_used FROM m JOIN asked USING (account_name)
UNION ALL SELECT fi.account_name, 'contact ' || CAST(fi.id AS VARCHAR), true FROM fact_interactions fi
JOIN asked USING (account_name) WHERE fi.account_name NOT IN (SELECT account_name FROM m)""",
    "bronze_keyword_search": f"WITH {_HIT} SELECT id, 'notes' AS source, 'raw_transcript' AS data_type FROM found",
    "bronze_enrich": "WITH " + _HIT + ", listing AS (" + TEXT_SQL["transcript_entities"].strip()
    + ") SELECT * FROM listing WHERE doc_id IN (SELECT id FROM found)",
    "vector_topk": _topk(),
    "vector_topk_scoped": _topk("WHERE asked_label = label"),
    "vector_centroids": _topk(scores=_CENTROID),
    "vector_threshold": f"SELECT * FROM ({_topk().strip()}) WHERE score > 0.20",
    "vector_stats": "SELECT label AS namespace, count(*) AS vectors, max(len(embedding)) AS dimension FROM embeddings GROUP BY 1",
    "question_intent": f"SELECT conv_id, turn, {_NARR} AS narrative, {_METR} AS metric, {_INTENT} AS intent FROM questions",
    "greeting_filter": f"SELECT conv_id, turn, ({_GREETING}) AS is_greeting FROM questions",
    "recent_context": _CONTEXT.format("CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END"),
    "recent_context_whole": _CONTEXT.format("text"),
    "answer_route": f"""
WITH g AS (SELECT account_name, count(*) AS n FROM {_nested('activity_summary')} GROUP BY 1),
s AS (SELECT account_name, count(*) AS n FROM fact_deals GROUP BY 1),
b AS (SELECT account_name, count(*) AS n FROM transcripts GROUP BY 1),
v AS (SELECT 'Customer#' || lpad(CAST(label * 3 AS VARCHAR), 9, '0') AS account_name, count(*) AS n FROM embeddings GROUP BY 1),
x AS (
  SELECT conv_id, turn, question, {_INTENT} AS intent, coalesce(v.n, 0) AS vn,
    CASE WHEN g.n > 0 THEN 'gold' WHEN s.n > 0 THEN 'silver' WHEN b.n > 0 THEN 'bronze' END AS tier
  FROM questions LEFT JOIN g USING (account_name) LEFT JOIN s USING (account_name)
  LEFT JOIN b USING (account_name) LEFT JOIN v USING (account_name)
)
SELECT conv_id, turn, intent, CASE WHEN {_GREETING} THEN 'greeting'
  WHEN intent = 'narrative' AND vn > 0 THEN 'vector' WHEN tier IS NOT NULL THEN tier
  WHEN vn > 0 THEN 'vector' ELSE 'none' END AS route FROM x""",
    "silver_tables_used": "SELECT event_id, array_to_string(tables, ',') AS tables FROM logged_tables",
    "proposal_dedupe": f"""
WITH {_PROPOSALS}
SELECT event_id, question, array_to_string(tables, ',') AS tables FROM logged_tables l
WHERE NOT EXISTS (SELECT 1 FROM p WHERE contains(p.question, lower(substring(l.question, 1, 30)))
  OR p.tables = array_to_string(l.tables, ','))""",
    "fallback_candidates": """
SELECT array_to_string(tables, ',') AS tables, count(*) AS fallbacks, min(question) AS example FROM logged_tables GROUP BY 1""",
    **{f"view_{name}": f"SELECT {', '.join(columns)} FROM {_nested(name)}" for name, columns in VIEW_COLUMNS.items()},
}

_DOC_CHUNKS = """
w AS (
  SELECT doc_id, prefix, t, 0 AS start, -1 AS stop FROM docs WHERE length(t) >= 50
  UNION ALL
  SELECT doc_id, prefix, t, CASE WHEN stop < 0 THEN 0 ELSE stop - 100 END,
    CASE WHEN (CASE WHEN stop < 0 THEN 0 ELSE stop - 100 END) + 500 >= length(t) THEN length(t)
    ELSE (CASE WHEN stop < 0 THEN 0 ELSE stop - 100 END) + 500
      - instr(reverse(substring(t, (CASE WHEN stop < 0 THEN 0 ELSE stop - 100 END) + 401, 100)), ' .') END
  FROM w WHERE stop < length(t)
)"""
SERVING_SQL["vector_upsert"] = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, substring(sha256(lower(filename) || '|' || lower(account_name)), 1, 16) AS prefix,
    {strip("CASE WHEN o_orderstatus = 'F' THEN text || chr(10) || repeat('More was said. ', 20) ELSE text END")} AS t
  FROM transcripts JOIN orders ON o_orderkey = doc_id
), {_DOC_CHUNKS}
SELECT doc_id, prefix || '_chunk_' || (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1) AS chunk_id,
  count(*) OVER (PARTITION BY doc_id) AS total_chunks,
  length({strip('substring(t, start + 1, stop - start)')}) AS chunk_chars FROM w WHERE stop >= 0"""
