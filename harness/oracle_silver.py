"""DuckDB statements for ingest, mapping, merging, identity and data quality."""

from __future__ import annotations

from harness.oracle_text import hits, q, strip, words
from saleslake import vocab

_ENUM = {f: sorted(v) for f, v in vocab.ENUM_FIELDS.items()}
_CLEAN = strip("regexp_replace(deal_value, '[,$€£]', '', 'g')")
_D = "[0-9](?:_?[0-9])*"
_FLOAT = f"(?i)(?:[+-]?(?:(?:{_D}(?:\\.(?:{_D})?)?|\\.{_D})(?:e[+-]?{_D})?|inf|infinity|nan))"
_BAD_VALUE = f"({strip('deal_value')} <> '' AND NOT regexp_full_match({_CLEAN}, {q(_FLOAT)}))"
_NO_NAME = f"(deal_name IS NULL OR {strip('deal_name')} = '')"
_NO_ACCOUNT = f"(account_id IS NULL AND (account_name IS NULL OR {strip('account_name')} = ''))"
_DEAL_ERRORS = f"""list_filter([
  CASE WHEN {_NO_ACCOUNT} THEN 'At least one of account_id, account_name is required' END,
  CASE WHEN {_NO_NAME} THEN 'deal_name is required and cannot be empty' END,
  CASE WHEN {_BAD_VALUE} THEN 'deal_value must be numeric, got: ''' || deal_value || '''' END], lambda e: e IS NOT NULL)"""


def _coerce(e: str, rate: bool = False) -> str:
    """Numbers by their digits: no zeros before or after, whole ones without a fraction; other text stays."""
    x = strip(e)
    sign = f"CASE WHEN starts_with({x}, '-') THEN '-' ELSE '' END"
    whole = f"CASE WHEN ltrim(split_part(ltrim({x}, '+-'), '.', 1), '0') = '' THEN '0' ELSE ltrim(split_part(ltrim({x}, '+-'), '.', 1), '0') END"
    fraction = f"rtrim(split_part({x}, '.', 2), '0')"
    body = f"{whole} || CASE WHEN {fraction} = '' THEN '{'.0' if rate else ''}' ELSE '.' || {fraction} END"
    return (
        f"CASE WHEN regexp_full_match({x}, '[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)') THEN "
        f"CASE WHEN regexp_full_match({x}, '[+-]?[0.]+') THEN '0{'.0' if rate else ''}' ELSE {sign} || {body} END "
        f"WHEN regexp_full_match({x}, '-*[0-9]+') THEN CAST(TRY_CAST({x} AS DECIMAL(38,0)) AS VARCHAR) ELSE {x} END"
    )


def _initcap(e: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({e}), '[a-z0-9]+|[^a-z0-9]+'), "
        "lambda r: upper(r[1:1]) || r[2:]), '')"
    )


def _warn(field: str) -> str:
    known = ", ".join(q(v) for v in _ENUM[field])
    text = "' is not a recognized value. Expected one of: " + ", ".join(_ENUM[field])
    return (
        f"CASE WHEN {strip(field)} <> '' AND lower({strip(field)}) NOT IN ({known}) "
        f"THEN {q(field + ' value ' + chr(39))} || {field} || {q(text)} END"
    )


_DEAL_WARNINGS = (
    "list_filter([" + ", ".join(_warn(f) for f in [
        "vertical", "horizontal", "engagement_model", "opportunity_stage", "ai_influenced", "business_type"
    ])
    + f""", CASE WHEN {strip('close_date')} <> '' AND NOT regexp_full_match({strip('close_date')},
    '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{4}}/\\d{{2}}/\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}}|\\d{{2}}-\\d{{2}}-\\d{{4}}')
    THEN 'close_date value ''' || {strip('close_date')} || ''' does not look like a date (expected YYYY-MM-DD)' END],
    lambda e: e IS NOT NULL)"""
)

_DEAL_FIELDS = [c for c in vocab.SILVER_COLUMNS["fact_deals"] if c != "source_data"]
_SCORE = " + ".join(
    f"CASE WHEN {strip(f'CAST({c} AS VARCHAR)')} <> '' THEN {2 if c in ('deal_name', 'account_name') else 1} ELSE 0 END"
    for c in _DEAL_FIELDS
)
_ACCOUNT_COLUMNS = ["industry", "geography", "annual_revenue", "employee_count", "website", "account_type", "segment"]


def _last(column: str, keys: str = "") -> str:
    return f"arg_max({column}, seq) FILTER (WHERE {column} IS NOT NULL AND {column} <> '') AS {column}"


_LATEST = f"""
SELECT account_name, {', '.join(_last(c) for c in _ACCOUNT_COLUMNS)}
FROM crm_batch GROUP BY 1"""

_DQ = {
    "dim_account": f"account_name IS NOT NULL AND {strip('account_name')} <> ''",
    "dim_contact": f"contact_name IS NOT NULL AND {strip('contact_name')} <> ''",
    "fact_deals": f"len({_DEAL_ERRORS}) = 0",
    "fact_interactions": f"NOT {_NO_ACCOUNT}",
    "fact_insights": f"NOT {_NO_ACCOUNT}",
}
_ROLES = vocab.ROLE_TITLES
_RELEVANCE = (
    f"{hits(vocab.SALES_KEYWORDS)} "
    f"+ CASE WHEN regexp_matches(text, {q(f'(?i)(^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])(?:' + _ROLES + ')($|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])')}) THEN 2 ELSE 0 END "
    f"+ CASE WHEN regexp_matches(text, {q(vocab.RELEVANCE_MONEY_PATTERN)}) THEN 1 ELSE 0 END"
)
_MATCHED = """
n AS (
  SELECT trim(name) AS name, min(seq) AS seq FROM name_batch GROUP BY 1
), a AS (SELECT id, account_name FROM dim_account WHERE account_name IS NOT NULL AND account_name <> ''),
c AS (
  SELECT n.name, a.id, CASE WHEN a.account_name = n.name THEN 1
     WHEN lower(trim(a.account_name)) = lower(n.name) THEN 2 ELSE 3 END AS tier, length(a.account_name) AS size
  FROM n JOIN a ON a.account_name = n.name OR lower(trim(a.account_name)) = lower(n.name)
    OR (length(n.name) >= 3 AND (contains(lower(a.account_name), lower(n.name)) OR contains(lower(n.name), lower(a.account_name))))
), m AS (
  SELECT name, id AS account_id, tier FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, CASE WHEN tier = 3 THEN size END, id) AS rn FROM c) WHERE rn = 1
)"""

SILVER_SQL = {
    "deal_value_parse": """
SELECT id, deal_value, CAST(CASE WHEN regexp_full_match(deal_value, '[0-9.]+')
  THEN TRY_CAST(deal_value AS DECIMAL(38,6)) END AS DOUBLE) AS amount,
  CAST(CASE WHEN regexp_full_match('123456789012345678' || deal_value, '[0-9.]+')
  THEN TRY_CAST('123456789012345678' || deal_value AS DECIMAL(38,6)) END AS VARCHAR) AS large_amount FROM fact_deals""",
    "number_prefix": """
SELECT id, coalesce(TRY_CAST(nullif(regexp_extract(deal_value,
  '^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE), 0.0) AS amount FROM fact_deals""",
    "currency_clean": f"SELECT seq, {_CLEAN} AS deal_value FROM crm_batch",
    "canonical_coerce": f"""
SELECT id, {_coerce('deal_value')} AS deal_value, {_coerce("('00' || probability)")} AS probability,
  {_coerce("(probability || '.0')", True)} AS win_rate, {_coerce("(probability || '.50')")} AS score,
  {_coerce('close_date')} AS close_date, {_coerce("(probability || '.12345678901234')")} AS fine,
  CAST(CAST(probability AS BIGINT) * 1000 + 500 AS VARCHAR) AS power, {_coerce("('12345678901234567890' || deal_value)")} AS large FROM fact_deals""",
    "normalize_existing": f"""
SELECT 'deal' AS kind, id, CASE WHEN NOT regexp_matches(deal_stage, '^[A-Z]') THEN {_initcap('deal_stage')} ELSE deal_stage END AS value
FROM fact_deals UNION ALL SELECT 'interaction', id, lower(sentiment) FROM fact_interactions""",
    "init_cap": f"SELECT id, {_initcap('label')} AS label FROM (SELECT id, concat_ws(' - ', upper(deal_stage), upper(lead_source)) AS label FROM fact_deals)",
    "account_search": """
SELECT id, account_name, industry FROM dim_account
WHERE contains(lower(coalesce(account_name, '')), 'machin') OR contains(lower(coalesce(industry, '')), 'machin')""",
    "currency_label": """
WITH v AS (
  SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN CAST(floor(o_totalprice) AS BIGINT) * 1000
    WHEN 1 THEN CAST(floor(o_totalprice) AS BIGINT) % 1000 ELSE 0 END AS BIGINT) AS x FROM orders
), r AS (
  SELECT o_orderkey, CASE WHEN x >= 1000000 THEN x - x % 100000 WHEN x >= 1000 THEN x - x % 1000 ELSE x END AS x FROM v
)
SELECT o_orderkey, CASE WHEN x >= 1000000 THEN '$' || CAST(CAST(x / 1000000.0 AS DECIMAL(18,1)) AS VARCHAR) || 'M'
  WHEN x >= 1000 THEN '$' || CAST(x // 1000 AS VARCHAR) || 'K' WHEN x > 0 THEN '$' || CAST(x AS VARCHAR) ELSE '$0' END AS label
FROM r""",
    "bronze_typed": """
SELECT doc_id AS id, CASE WHEN length(text) > 50 THEN 'raw_transcript' ELSE 'structured_data' END AS data_type FROM transcripts
UNION ALL SELECT -id - 1, 'structured_data' FROM fact_deals""",
    "source_family": f"""
SELECT seq, CASE {' '.join(f"WHEN lower(trim(source_name)) IN ({', '.join(q(a) for a in al)}) THEN {q(f)}" for f, al in vocab.SOURCE_ALIASES.items())} END AS family
FROM crm_batch""",
    "map_crm_accounts": """
SELECT seq, account_name, industry, geography, annual_revenue, employee_count, website, account_type, segment
FROM crm_batch WHERE account_name IS NOT NULL""",
    "map_crm_contacts": """
SELECT seq, contact_name, account_name, contact_email AS email, contact_phone AS phone, contact_title AS title,
  contact_role AS role FROM crm_batch""",
    "map_crm_deals": """
SELECT seq, deal_name, deal_value, deal_stage, close_date, probability, currency, product_name, account_name,
  contact_name, owner, lead_source FROM crm_batch""",
    "map_crm_interactions": """
SELECT seq, sentiment, account_name, contact_name, last_interaction_type AS interaction_type,
  last_interaction_date AS interaction_date FROM crm_batch
WHERE sentiment IS NOT NULL OR last_interaction_type IS NOT NULL OR last_interaction_date IS NOT NULL""",
    "map_erp": """
SELECT l_returnflag AS transaction_type, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR) AS amount,
  CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, l_linestatus AS status,
  'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS account_name, 'Part ' || CAST(l_partkey AS VARCHAR) AS product_name,
  CAST(l_orderkey AS VARCHAR) AS reference_id FROM lineitem""",
    "map_hrms": """
SELECT 'hire' AS record_type, s_name AS employee_name, 'Nation ' || CAST(s_nationkey AS VARCHAR) AS department,
  CAST(CAST(s_acctbal AS DECIMAL(15,2)) AS VARCHAR) AS salary, 'Manager ' || CAST(s_nationkey % 4 AS VARCHAR) AS manager FROM supplier""",
    "map_hrms_departments": """
SELECT DISTINCT 'Nation ' || CAST(s_nationkey AS VARCHAR) AS name, 'Manager ' || CAST(s_nationkey % 4 AS VARCHAR) AS head FROM supplier""",
    "unmapped_fields": """
SELECT 'deal_priority' AS field, arg_min(deal_priority, seq) FILTER (WHERE deal_priority IS NOT NULL) AS sample_value,
  'crm' AS source_type FROM crm_batch""",
    "evolve_schema": "SELECT seq, deal_name, deal_priority FROM crm_batch",
    "contact_identity": """
SELECT seq, CASE WHEN seq % 3 = 0 THEN contact_name WHEN seq % 3 = 1 THEN owner
  WHEN account_name <> '' THEN account_name || ' (General)' END AS contact_name FROM crm_batch""",
    "mapping_preview": """
SELECT 'dim_account' AS target, count(*) AS records FROM crm_batch UNION ALL SELECT 'dim_contact', count(*) FROM crm_batch
UNION ALL SELECT 'fact_deals', count(*) FROM crm_batch
UNION ALL SELECT 'fact_interactions', count(*) FROM crm_batch
  WHERE sentiment IS NOT NULL OR last_interaction_type IS NOT NULL OR last_interaction_date IS NOT NULL""",
    "batch_accounts": "SELECT DISTINCT account_name FROM crm_batch WHERE length(trim(account_name)) > 1",
    "account_mismatch": """
SELECT DISTINCT account_name FROM crm_batch
WHERE length(trim(account_name)) > 1 AND lower(trim(account_name)) <> 'customer#000000010'""",
    "table_preview": """
SELECT seq, """ + ", ".join(
        f"substring(coalesce({c}, ''), 1, 30) AS {c}"
        for c in ["source_name", "industry", "geography", "annual_revenue", "employee_count", "website", "account_type", "segment"]
    ) + " FROM crm_batch ORDER BY seq LIMIT 5",
    "table_shape": "SELECT count(*) AS row_count, CAST(27 AS BIGINT) AS column_count FROM crm_batch",
    "last_non_null": _LATEST,
    "merge_dim_account": f"""
WITH b AS ({_LATEST}), cur AS (SELECT * FROM dim_account)
SELECT cur.id AS id, CASE WHEN cur.id IS NOT NULL THEN cur.account_name ELSE b.account_name END AS account_name,
  {', '.join(f'coalesce(b.{c}, cur.{c}) AS {c}' for c in ['industry', 'geography', 'annual_revenue', 'employee_count', 'website'])},
  cur.vertical AS vertical, b.account_type AS account_type, b.segment AS segment
FROM cur FULL JOIN b ON b.account_name IS NOT DISTINCT FROM cur.account_name""",
    "merge_dim_contact": f"""
WITH b AS (
  SELECT contact_name || '-B' AS contact_name, account_name, {_last('role')}, {_last('title')}
  FROM (SELECT seq, contact_name, account_name, contact_role AS role, contact_title AS title FROM crm_batch) GROUP BY 1, 2
)
SELECT cur.id AS id, coalesce(cur.contact_name, b.contact_name) AS contact_name,
  CASE WHEN cur.id IS NOT NULL THEN cur.account_name ELSE b.account_name END AS account_name,
  coalesce(b.role, cur.role) AS role, b.title AS title
FROM dim_contact cur FULL JOIN b ON b.contact_name IS NOT DISTINCT FROM cur.contact_name
  AND b.account_name IS NOT DISTINCT FROM cur.account_name""",
    "merge_fact_deals": f"""
WITH b AS (
  SELECT deal_name, account_name, {_last('deal_value')}, {_last('deal_stage')}, {_last('owner')}
  FROM crm_batch WHERE deal_name <> '' AND account_name <> '' GROUP BY 1, 2
)
SELECT cur.id AS id, CASE WHEN cur.id IS NOT NULL THEN cur.deal_name ELSE b.deal_name END AS deal_name,
  CASE WHEN cur.id IS NOT NULL THEN cur.account_name ELSE b.account_name END AS account_name,
  coalesce(b.deal_value, cur.deal_value) AS deal_value, coalesce(b.deal_stage, cur.deal_stage) AS deal_stage,
  cur.vertical AS vertical, b.owner AS owner
FROM fact_deals cur FULL JOIN b ON b.deal_name = cur.deal_name AND b.account_name = cur.account_name
UNION ALL
SELECT NULL, deal_name, account_name, deal_value, deal_stage, NULL, owner FROM crm_batch
WHERE NOT coalesce(deal_name <> '' AND account_name <> '', false)""",
    "append_facts": """
SELECT id, account_id, account_name, interaction_date, sentiment, CAST(NULL AS VARCHAR) AS interaction_type FROM fact_interactions
UNION ALL SELECT NULL, NULL, account_name, last_interaction_date, sentiment, last_interaction_type FROM crm_batch
WHERE sentiment IS NOT NULL OR last_interaction_type IS NOT NULL OR last_interaction_date IS NOT NULL""",
    "backfill_account_id": """
WITH k AS (SELECT lower(trim(account_name)) AS key, min(id) AS id FROM dim_account WHERE account_name IS NOT NULL GROUP BY 1)
SELECT fd.id AS id, coalesce(fd.account_id, k.id) AS account_id, fd.account_name AS account_name
FROM fact_deals fd LEFT JOIN k ON k.key = lower(trim(fd.account_name))""",
    "resolve_accounts": f"""
WITH {_MATCHED}, u AS (SELECT * FROM n WHERE name NOT IN (SELECT name FROM m)),
p AS (
  SELECT l.name AS later, e.name AS earlier FROM u l JOIN u e ON e.seq < l.seq
    AND (contains(lower(e.name), lower(l.name)) OR contains(lower(l.name), lower(e.name)))
), created AS (SELECT * FROM u WHERE name NOT IN (SELECT later FROM p))
SELECT m.name AS name, m.tier AS tier, a.account_name AS account_name FROM m JOIN a ON a.id = m.account_id
UNION ALL SELECT name, 4, name FROM created
UNION ALL SELECT later, CASE WHEN lower(earlier) = lower(later) THEN 2 ELSE 3 END, earlier
FROM p WHERE earlier IN (SELECT name FROM created)""",
    "match_accounts": f"WITH {_MATCHED} SELECT name, account_id, tier FROM m",
    "account_source_map": f"""
WITH {_MATCHED}, b AS (
  SELECT DISTINCT m.account_id, coalesce(nb.source, 'unknown') AS source, m.name AS source_name
  FROM name_batch nb JOIN m ON m.name = trim(nb.name)
), cur AS (
  SELECT id AS account_id, 'hubspot' AS source, account_name AS source_name, 'h-' || CAST(id AS VARCHAR) AS source_id FROM a
)
SELECT coalesce(cur.account_id, b.account_id) AS account_id, coalesce(cur.source, b.source) AS source,
  coalesce(cur.source_name, b.source_name) AS source_name, cur.source_id AS source_id
FROM cur FULL JOIN b ON b.account_id = cur.account_id AND b.source = cur.source AND b.source_name = cur.source_name""",
    "seed_source_map": """
SELECT id AS account_id, 'legacy' AS source, account_name AS source_name FROM dim_account
WHERE account_name IS NOT NULL AND account_name <> '' AND vertical IS DISTINCT FROM 'Payments'""",
    "dq_valid_deals": f"SELECT id, deal_name, account_name, deal_value FROM fact_deals WHERE len({_DEAL_ERRORS}) = 0",
    "dq_rejects": f"""
SELECT id, 'fact_deals' AS table_name, array_to_string({_DEAL_ERRORS}, '|') AS errors FROM fact_deals
WHERE len({_DEAL_ERRORS}) > 0""",
    "dq_warnings": f"SELECT id, array_to_string({_DEAL_WARNINGS}, '|') AS warnings FROM fact_deals",
    "completeness": f"SELECT id, round(({_SCORE}) / {float(len(_DEAL_FIELDS) + 2)}, 3) AS score FROM fact_deals",
    "dq_summary": " UNION ALL ".join(
        f"SELECT {q(t)} AS table_name, count(*) AS total_records, count(CASE WHEN {c} THEN 1 END) AS valid_records, "
        f"count(*) - count(CASE WHEN {c} THEN 1 END) AS invalid_records, "
        f"round(count(CASE WHEN {c} THEN 1 END) / count(*), 3) AS validation_rate FROM {t}"
        for t, c in _DQ.items()
    ),
    "dq_fill_rates": " UNION ALL ".join(
        f"SELECT {q(c)} AS field, round(count(CASE WHEN {strip(f'CAST({c} AS VARCHAR)')} <> '' THEN 1 END) / count(*), 3) AS fill_rate FROM fact_deals"
        for c in ["id", *_DEAL_FIELDS]
    ),
    "dq_top_errors": f"""
WITH e AS (SELECT unnest({_DEAL_ERRORS}) AS error FROM fact_deals), g AS (SELECT error, count(*) AS records FROM e GROUP BY 1)
SELECT error, records, error || ' (' || CAST(records AS VARCHAR) || ' record' || CASE WHEN records > 1 THEN 's' ELSE '' END || ')' AS summary
FROM g ORDER BY records DESC, error LIMIT 10""",
    "dq_enum_distribution": " UNION ALL ".join(
        f"SELECT {q(f)} AS field, {strip(f)} AS value, count(*) AS records FROM fact_deals WHERE {strip(f)} <> '' GROUP BY 2"
        for f in vocab.ENUM_FIELDS
    ),
    "sales_relevance": f"""
SELECT doc_id, {_RELEVANCE} AS hits, {_RELEVANCE} >= 2 AS is_relevant FROM documents
UNION ALL SELECT -doc_id - 1, {_RELEVANCE}, {_RELEVANCE} >= 2 FROM transcripts""",
    "batch_relevance": f"""
WITH b AS (
  SELECT lower(concat_ws(' ', 'transaction_type amount quantity invoice_number status product_name account_name', l_returnflag,
    CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), CAST(l_orderkey AS VARCHAR),
    l_linestatus, 'Part ' || CAST(l_partkey AS VARCHAR), 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0'))) AS t FROM lineitem
), w AS (SELECT unnest({words(vocab.SALES_KEYWORDS)}) AS word), d AS (SELECT DISTINCT word FROM w)
SELECT count(*) + 1 AS hits, count(*) + 1 >= 2 AS is_relevant FROM d WHERE EXISTS (SELECT 1 FROM b WHERE contains(t, word))""",
}
