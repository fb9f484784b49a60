"""DuckDB text of the silver-shaped inputs; each oracle starts with the ones it names."""

from __future__ import annotations

import re

AS_OF = "DATE '2024-03-01'"

_VERTICALS = """CASE {k} WHEN 0 THEN 'Mortgage & Lending' WHEN 1 THEN 'Banking & Insurance'
  WHEN 2 THEN 'Capital Market' WHEN 3 THEN 'Higher Education' WHEN 4 THEN 'Technology'
  WHEN 5 THEN 'Payments' END"""
_GEOGRAPHY = "CASE {k} WHEN 0 THEN 'Onshore' WHEN 1 THEN 'Offshore' WHEN 2 THEN 'Both' END"

VIEWS = {
    "dim_account": f"""
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 97 = 0 THEN '' WHEN c_custkey % 89 = 0 THEN NULL ELSE c_name END AS account_name,
  c_mktsegment AS industry,
  {_GEOGRAPHY.format(k='c_nationkey % 4')} AS geography,
  {_VERTICALS.format(k='c_custkey % 7')} AS vertical,
  CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) AS annual_revenue,
  CAST(c_custkey * 10 AS VARCHAR) AS employee_count,
  'www.c' || CAST(c_custkey AS VARCHAR) || '.example' AS website
FROM customer""",
    "dim_contact": """
SELECT c_custkey * 2 AS id, 'Contact ' || CAST(c_custkey AS VARCHAR) || '-A' AS contact_name,
  CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) ELSE ' ' || c_name || ' ' END AS account_name,
  CASE c_custkey % 4 WHEN 0 THEN 'Primary Contact' WHEN 1 THEN 'decision_maker' WHEN 2 THEN 'Engineer' END AS role
FROM customer
UNION ALL
SELECT c_custkey * 2 + 1, 'Contact ' || CAST(c_custkey AS VARCHAR) || '-B', c_name, 'Decision Maker'
FROM (SELECT *, c_custkey % 5 AS fifth FROM customer) WHERE fifth = 0""",
    "fact_deals": f"""
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS account_id,
  CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS account_name,
  CASE WHEN o_orderkey % 53 = 0 THEN '' WHEN o_orderkey % 59 = 0 THEN NULL
       ELSE 'Deal ' || CAST(o_orderkey AS VARCHAR) END AS deal_name,
  CASE o_orderkey % 20 WHEN 0 THEN 'N/A' WHEN 1 THEN '-5' WHEN 2 THEN '1e5' WHEN 3 THEN NULL WHEN 4 THEN '1.2.3'
       ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) END AS deal_value,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN ''
       WHEN o_orderkey % 43 = 0 THEN 'Closed - No Decision'
       WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'Closed Lost'
       WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'closed won'
       WHEN o_orderstatus = 'F' THEN 'Closed Won'
       WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'Negotiation'
       WHEN o_orderstatus = 'O' THEN 'Proposal' ELSE 'Discovery' END AS deal_stage,
  CAST(o_orderkey % 101 AS VARCHAR) AS probability,
  CASE WHEN o_orderkey % 15 = 0 THEN 'Q2 2025' WHEN o_orderkey % 16 = 0 THEN NULL
       ELSE CAST({AS_OF} + CAST(o_orderkey % 200 - 60 AS INTEGER) AS VARCHAR) END AS close_date,
  'Contact ' || CAST(o_custkey AS VARCHAR) AS contact_name,
  {_VERTICALS.format(k='o_orderkey % 8')} AS vertical,
  CASE o_orderkey % 4 WHEN 0 THEN 'AI & Data' WHEN 1 THEN 'Application Engineering' WHEN 2 THEN 'Digital Operations' END AS horizontal,
  CASE o_orderkey % 5 WHEN 0 THEN 'T&M' WHEN 1 THEN 'Fixed' WHEN 2 THEN 'Retainers' WHEN 3 THEN 'Outcome-based' END AS engagement_model,
  'P' || CAST(o_orderkey % 11 AS VARCHAR) AS opportunity_stage,
  CASE WHEN o_orderkey % 9 = 0 THEN 'Yes' WHEN o_orderkey % 3 = 0 THEN 'yes' WHEN o_orderkey % 3 = 1 THEN 'no' END AS ai_influenced,
  CASE o_orderkey % 4 WHEN 0 THEN 'New Business' WHEN 1 THEN 'Existing Customer' WHEN 2 THEN 'Renewal' END AS business_type,
  CASE o_orderkey % 6 WHEN 0 THEN 'Referral' WHEN 1 THEN 'Inbound' WHEN 2 THEN 'Conference'
       WHEN 3 THEN 'Cold Outreach' WHEN 4 THEN 'Account Mining' END AS lead_source,
  CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN NULL
       ELSE 'Rep ' || CAST(o_orderkey % 25 AS VARCHAR) END AS salesperson,
  {_GEOGRAPHY.format(k='o_orderkey % 5')} AS geography,
  CAST({AS_OF} - CAST(o_orderkey % 400 AS INTEGER) AS TIMESTAMP) AS created_at,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST({AS_OF} - CAST(o_orderkey % 100 AS INTEGER) AS TIMESTAMP) END AS updated_at
FROM orders""",
    "fact_interactions": """
SELECT event_id AS id, CASE WHEN event_id % 29 = 0 THEN NULL ELSE user_id END AS account_id,
  'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS account_name,
  CASE WHEN user_id % 31 = 0 THEN 'unknown'
       ELSE CAST(CAST(ts AS DATE) - CAST(user_id % 90 AS INTEGER) AS VARCHAR) END AS interaction_date,
  CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'signup' THEN 'Very Positive'
       WHEN 'error' THEN 'negative' WHEN 'view' THEN 'neutral' END AS sentiment
FROM events""",
    "fact_insights": f"""
SELECT doc_id AS id, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE doc_id % 200 END AS account_id,
  'Customer#' || lpad(CAST(doc_id % 200 AS VARCHAR), 9, '0') AS account_name,
  CASE WHEN toxic = 1 THEN 'Competitive' WHEN quality = 1 THEN 'deal_signal' ELSE 'action_items' END AS insight_type,
  CASE WHEN quality = 1 THEN '0.9' ELSE '0.5' END AS confidence,
  CAST({AS_OF} - CAST(doc_id % 60 AS INTEGER) AS VARCHAR) AS insight_date
FROM labels""",
    "transcripts": """
SELECT o_orderkey AS doc_id, 'note_' || CAST(o_orderkey AS VARCHAR) || '.txt' AS filename,
  'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS account_name,
  'Meeting with ' || CASE o_orderkey % 40 WHEN 0 THEN 'Acme Corp' WHEN 10 THEN 'Globex Industries'
     WHEN 20 THEN 'Stark Systems' ELSE 'Initech Group' END || '.' || chr(10)
  || 'Participants: Ann Lee, Bob Stone' || chr(10)
  || '[00:05] Ann Lee: budget of $' || CAST(o_orderkey * 100 + 1000 AS VARCHAR)
  || CASE WHEN o_orderkey % 30 = 0 THEN ' million' ELSE '' END || ' for the migration.' || chr(10)
  || '[00:' || lpad(CAST(10 + o_orderkey % 49 AS VARCHAR), 2, '0') || '] Bob Stone: '
  || CASE o_orderkey % 50 WHEN 0 THEN 'we are ready to move forward, great and excellent and perfect.'
     WHEN 10 THEN 'there is a concern, a delay, a risk and an issue.'
     WHEN 20 THEN 'we will evaluate AWS and Snowflake.' ELSE 'the proposal needs work.' END || chr(10)
  || CASE WHEN o_orderkey % 20 = 0 THEN 'Industry: Retail' ELSE 'Industry: Banking' END || chr(10)
  || 'Expected close: 2024-06-30'
  || CASE WHEN o_orderkey % 70 = 0 THEN chr(10) || 'Primary Contact: Carol King, Role: VP Data' ELSE '' END
  || CASE WHEN o_orderkey % 25 = 0 THEN chr(10) || 'Based in New York, with ' || CAST(o_orderkey * 3 + 100 AS VARCHAR)
     || ' employees and annual revenue of $1.5 billion' ELSE '' END
  || CASE WHEN o_orderkey % 35 = 0 THEN chr(10) || 'Deal: Migration ' || CAST(o_orderkey AS VARCHAR) ELSE '' END AS text,
  o_orderdate AS created_at
FROM orders""",
    "texts": """
SELECT doc_id, filename, account_name, text FROM transcripts
UNION ALL SELECT -doc_id - 1, CAST(doc_id AS VARCHAR), '', text FROM documents""",
    "crm_batch": """
SELECT id AS seq,
  CASE id % 4 WHEN 0 THEN 'Salesforce' WHEN 1 THEN 'hubspot' WHEN 2 THEN ' Zoho_CRM ' ELSE 'unknown_sys' END AS source_name,
  CASE WHEN account_name = '' THEN ''
       WHEN CAST(substring(contact_name, 9, 20) AS BIGINT) % 3 = 0 THEN account_name || ' Holdings' ELSE account_name END AS account_name,
  CASE WHEN id % 4 <> 0 THEN 'Industry ' || CAST(id % 9 AS VARCHAR) END AS industry, geography,
  CASE WHEN id % 3 <> 0 THEN CAST(id * 1000 AS VARCHAR) END AS annual_revenue,
  CAST(id % 5000 AS VARCHAR) AS employee_count,
  CASE WHEN id % 5 = 0 THEN '' ELSE 'www.s' || CAST(id % 50 AS VARCHAR) || '.example' END AS website,
  'Customer' AS account_type, CASE WHEN id % 3 <> 0 THEN 'Enterprise' END AS segment, contact_name,
  'c' || CAST(id AS VARCHAR) || '@example.com' AS contact_email, CAST(NULL AS VARCHAR) AS contact_phone,
  'Title ' || CAST(id % 7 AS VARCHAR) AS contact_title,
  CASE id % 4 WHEN 0 THEN 'Primary Contact' WHEN 1 THEN 'Engineer' WHEN 2 THEN 'Buyer' END AS contact_role,
  CASE WHEN id % 2 = 0 THEN deal_name ELSE 'New deal ' || CAST(id % 1000 AS VARCHAR) END AS deal_name,
  CASE WHEN id % 2 = 0 THEN '$' || deal_value || ' ' ELSE deal_value END AS deal_value,
  deal_stage, close_date, probability || '%' AS probability, 'USD' AS currency,
  'Product ' || CAST(id % 10 AS VARCHAR) AS product_name, 'Owner ' || CAST(id % 12 AS VARCHAR) AS owner,
  CASE WHEN id % 6 <> 0 THEN 'Call' END AS last_interaction_type,
  CASE WHEN id % 6 <> 0 THEN close_date END AS last_interaction_date,
  CASE WHEN id % 2 = 0 THEN 'Positive' END AS sentiment, lead_source,
  CASE WHEN id % 7 = 0 THEN 'Level ' || CAST(id % 3 AS VARCHAR) END AS deal_priority
FROM fact_deals""",
    "name_batch": """
SELECT CASE o_orderkey % 4 WHEN 0 THEN n WHEN 1 THEN upper(n) WHEN 2 THEN n || ' Holdings'
       ELSE 'Newco ' || CAST(o_orderkey % 5 AS VARCHAR) END AS name,
  CASE o_orderkey % 3 WHEN 0 THEN 'hubspot' WHEN 1 THEN 'salesforce' END AS source, o_orderkey AS seq
FROM (SELECT o_orderkey, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS n FROM orders)""",
    "questions": """
SELECT conv_id, turn, 'Customer#' || lpad(CAST(conv_id AS VARCHAR), 9, '0') AS account_name,
  CASE (conv_id * 3 + turn) % 5 WHEN 0 THEN 'hello ' WHEN 1 THEN 'What did they discuss in the meeting? '
    WHEN 2 THEN 'How many open deals are at risk? ' WHEN 3 THEN 'Summarize the call notes and the pipeline value. '
    ELSE 'Show all deals ' END || text AS question
FROM conversations WHERE role = 'user'""",
    "query_log": """
SELECT event_id,
  'Which ' || event_type || ' records moved in period ' || CAST(event_id % 50 AS VARCHAR) || ' of the year?' AS question,
  'SELECT count(*) FROM ' || CASE event_type WHEN 'view' THEN 'silver.fact_deals' WHEN 'click' THEN 'SILVER.dim_account'
    ELSE 'silver.fact_insights' END || ' t' || CASE event_id % 5 WHEN 0 THEN ' JOIN silver.dim_contact c ON true'
    WHEN 1 THEN ' JOIN Silver.Fact_Deals d ON true' ELSE '' END AS sql_text
FROM events""",
    "logged_tables": """
SELECT event_id, question, list_transform(list_sort(list_distinct(list_filter(list_transform(
    regexp_extract_all(sql_text, '(?i)silver\\.(\\w+)', 1), lambda n: lower(n)),
    lambda n: n NOT IN ('where', 'from', 'join', 'on', 'and', 'or')))), lambda n: 'silver.' || n) AS tables
FROM query_log""",
}


def _mentioned(body: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", body) is not None


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it mentions; a body may bring its own CTEs."""
    body = body.strip()
    needed: set[str] = set()
    grown = True
    while grown:
        text = body + " ".join(VIEWS[n] for n in needed)
        found = {n for n in VIEWS if _mentioned(text, n)}
        grown, needed = found != needed, found
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in VIEWS if n in needed)
    if not ctes:
        return body
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(opening):
            return f"{opening}{ctes},\n{body[len(opening):]}"
    return f"WITH {ctes}\n{body}"
