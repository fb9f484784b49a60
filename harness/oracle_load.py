"""DuckDB statements for the state of a lake after loads."""

from __future__ import annotations

_CRM = "SELECT * FROM crm_batch WHERE deal_name <> '' AND account_name <> '' AND regexp_full_match(deal_value, '[0-9]+[.][0-9]+')"


def _plain(number: str) -> str:
    """A decimal's text without trailing zeros."""
    return f"regexp_replace(regexp_replace({number}, '0+$', ''), '[.]$', '')"


def _last(column: str, name: str) -> str:
    return f"arg_max({column}, (k, seq)) FILTER (WHERE {column} IS NOT NULL AND {column} <> '') AS {name}"


LOAD_SQL = {
    "load_erp": f"""
SELECT l_returnflag AS transaction_type, {_plain('CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR)')} AS amount,
  CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, CAST(l_orderkey AS VARCHAR) AS reference_id, l_linestatus AS status,
  'Part ' || CAST(l_partkey AS VARCHAR) AS product_name, 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS account_name,
  'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS linked_account FROM lineitem""",
    "load_hrms": f"""
SELECT 'hire' AS record_type, s_name AS employee_name, 'Nation ' || CAST(s_nationkey AS VARCHAR) AS department,
  {_plain('CAST(CAST(s_acctbal AS DECIMAL(15,2)) AS VARCHAR)')} AS salary, 'Manager ' || CAST(s_nationkey % 4 AS VARCHAR) AS manager,
  'Manager ' || CAST(s_nationkey % 4 AS VARCHAR) AS head FROM supplier""",
    "load_crm_columns": f"""
SELECT contact_name, account_name, {_last('contact_email', 'email')}, {_last('contact_title', 'title')}
FROM (SELECT 0 AS k, * FROM ({_CRM})) GROUP BY 1, 2""",
    "evolve_second_batch": f"""
WITH b AS (SELECT CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS k, * FROM ({_CRM})),
c AS (SELECT k, seq, deal_name, account_name, {_plain('deal_value')} AS deal_value,
  CASE WHEN k = 1 THEN 'Negotiation' ELSE deal_stage END AS deal_stage, owner, lead_source, deal_priority FROM b)
SELECT deal_name, account_name, {', '.join(_last(c, c) for c in ('deal_value', 'deal_stage', 'owner', 'lead_source', 'deal_priority'))}
FROM c GROUP BY 1, 2""",
}
