"""Vocabularies, word lists, patterns and field maps the results depend on."""

from __future__ import annotations

# ---------------------------------------------------------------- business dimensions
VERTICALS = [
    "mortgage & lending", "banking & insurance", "capital market",
    "higher education", "technology", "payments",
]
HORIZONTALS = ["ai & data", "application engineering", "digital operations"]
ENGAGEMENT_MODELS = [
    "t&m", "time and material", "fixed", "retainers", "outcome-based", "transactional",
]
OPPORTUNITY_STAGES = [f"p{i}" for i in range(11)]
AI_INFLUENCED = ["yes", "no"]
BUSINESS_TYPES = ["new business", "existing customer", "renewal"]
GEOGRAPHIES = ["onshore", "offshore", "both"]

ENUM_FIELDS = {
    "vertical": VERTICALS,
    "horizontal": HORIZONTALS,
    "engagement_model": ENGAGEMENT_MODELS,
    "opportunity_stage": OPPORTUNITY_STAGES,
    "ai_influenced": AI_INFLUENCED,
    "business_type": BUSINESS_TYPES,
    "geography": GEOGRAPHIES,
}

# ---------------------------------------------------------------- source families
SOURCE_ALIASES = {
    "crm": [
        "salesforce_crm", "salesforce", "hubspot", "hubspot_crm", "pipedrive", "zoho_crm",
        "dynamics_crm", "crm", "crm_export", "user_upload",
    ],
    "erp": [
        "sap_erp", "sap", "oracle_erp", "oracle", "netsuite", "quickbooks", "xero", "erp",
    ],
    "hrms": ["workday", "workday_hrms", "bamboohr", "adp", "gusto", "hrms"],
}

# ---------------------------------------------------------------- field maps
# Family -> target table -> {target column: source field}.
FIELD_MAPS = {
    "crm": {
        "dim_account": {
            "account_name": "account_name",
            "industry": "industry",
            "geography": "geography",
            "vertical": "vertical",
            "annual_revenue": "annual_revenue",
            "employee_count": "employee_count",
            "website": "website",
            "account_type": "account_type",
            "segment": "segment",
        },
        "dim_contact": {
            "contact_name": "contact_name",
            "email": "contact_email",
            "phone": "contact_phone",
            "title": "contact_title",
            "role": "contact_role",
            "account_name": "account_name",
        },
        "fact_deals": {
            "deal_name": "deal_name",
            "deal_value": "deal_value",
            "deal_stage": "deal_stage",
            "close_date": "close_date",
            "probability": "probability",
            "currency": "currency",
            "pipeline": "pipeline",
            "product_name": "product_name",
            "account_name": "account_name",
            "contact_name": "contact_name",
            "owner": "owner",
            "vertical": "vertical",
            "horizontal": "horizontal",
            "engagement_model": "engagement_model",
            "opportunity_stage": "opportunity_stage",
            "ai_influenced": "ai_influenced",
            "business_type": "business_type",
            "lead_source": "lead_source",
            "salesperson": "salesperson",
        },
        "fact_interactions": {
            "interaction_type": "last_interaction_type",
            "interaction_date": "last_interaction_date",
            "summary": "last_interaction_summary",
            "sentiment": "sentiment",
            "account_name": "account_name",
            "contact_name": "contact_name",
        },
    },
    "erp": {
        "dim_account": {
            "account_name": "account_name",
        },
        "fact_transactions": {
            "transaction_type": "transaction_type",
            "transaction_date": "transaction_date",
            "amount": "amount",
            "quantity": "quantity",
            "currency": "currency",
            "status": "status",
            "reference_id": "invoice_number",
            "account_name": "account_name",
            "product_name": "product_name",
        },
    },
    "hrms": {
        "dim_contact": {
            "contact_name": "employee_name",
            "email": "employee_email",
            "phone": "employee_phone",
            "title": "title",
            "department": "department",
        },
        "dim_department": {
            "name": "department",
            "head": "manager",
            "location": "location",
        },
        "fact_hr_records": {
            "record_type": "record_type",
            "record_date": "hire_date",
            "employee_name": "employee_name",
            "department": "department",
            "position": "title",
            "salary": "salary",
            "status": "status",
            "manager": "manager",
        },
    },
}

# Columns that identify a row's context but do not make it worth keeping on their own.
CONTEXT_COLUMNS = ["account_name", "contact_name", "source", "source_data"]
DIMENSION_KEYS = {"dim_account": "account_name", "dim_contact": "contact_name"}
CONTACT_NAME_FALLBACKS = ["contact_name", "name", "person_name", "employee_name", "contact"]

# ---------------------------------------------------------------- silver tables
SILVER_COLUMNS = {
    "dim_account": [
        "account_name", "industry", "geography", "vertical", "annual_revenue",
        "employee_count", "website", "source_data",
    ],
    "dim_contact": ["contact_name", "account_name", "role", "source_data"],
    "fact_interactions": [
        "account_id", "account_name", "interaction_date", "sentiment", "source_data",
    ],
    "fact_deals": [
        "account_id", "deal_name", "account_name", "deal_value", "deal_stage", "probability",
        "close_date", "contact_name", "vertical", "horizontal", "engagement_model",
        "opportunity_stage", "ai_influenced", "business_type", "lead_source", "salesperson",
        "geography", "source_data",
    ],
    "fact_insights": [
        "account_id", "account_name", "insight_type", "content", "confidence",
        "insight_date", "source_data",
    ],
}
ENTITY_NAMES = {
    "dim_account": "accounts",
    "dim_contact": "contacts",
    "fact_deals": "deals",
    "fact_interactions": "interactions",
    "fact_insights": "insights",
}

# Tables that a load may fill: those above, and those only the field maps name.
SILVER_TABLES = list(SILVER_COLUMNS) + ["dim_department", "fact_transactions", "fact_hr_records"]

# ---------------------------------------------------------------- relevance of a file
SALES_KEYWORDS = [
    "account", "client", "deal", "meeting", "revenue", "opportunity",
    "contact", "pipeline", "proposal", "negotiation", "contract",
    "prospect", "customer", "sales", "crm", "lead", "close", "quote",
    "pricing", "budget", "forecast", "renewal", "churn", "upsell",
    "onboarding", "demo", "sow", "rfp", "rfi",
]
SALES_COLUMN_HINTS = [
    "account_name", "deal_name", "deal_value", "deal_stage", "close_date",
    "contact_name", "contact_email", "opportunity", "revenue", "pipeline",
    "lead_source", "account", "client", "company", "stage",
]
# Fixed value: titles that count as a role, as whole words in any case.
ROLE_TITLES = (
    "CEO|CFO|CTO|COO|CIO|CMO|VP|Director|Manager|Head of|"
    "President|Partner|Account Executive|Sales Rep|BDR|SDR|"
    "Account Manager|Sales Manager|Regional Director"
)
RELEVANCE_MONEY_PATTERN = (
    r"(?i)\$\s?[\d,.]+|\d+(?:,\d{3})+(?:\.\d+)?\s*(?:USD|dollars?|M|K|B)\b"
)
MIN_RELEVANCE_HITS = 2

DATE_SHAPES = [
    r"^\d{4}-\d{2}-\d{2}\z", r"^\d{4}/\d{2}/\d{2}\z",
    r"^\d{2}/\d{2}/\d{4}\z", r"^\d{2}-\d{2}-\d{4}\z",
]

# ---------------------------------------------------------------- transcript extraction
SPEAKER_PATTERN = r"\[\d{1,2}:\d{2}(?::\d{2})?\]\s*([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)\s*:"
PARTICIPANTS_PATTERN = r"[Pp]articipants?\s*:\s*([^\n]+)"
COMPANY_PATTERNS = [
    r"(?:from|at|with)\s+([A-Z][A-Za-z\s]+(?:Industries|Corp|Inc|Ltd|Tech|Solutions|Systems|Group|Company))",
    r"(?:about|regarding|for|on|re:|info\s+(?:about|on|for))\s+([A-Z][A-Za-z]+(?:\s[A-Z][A-Za-z]+){0,3})\b",
    r"(?:from|at|with)\s+([A-Z][a-z]+(?:\s[A-Z][a-z]+){0,3})\b",
    r"([A-Z][A-Za-z]+\s+(?:Industries|Corp|Inc|Ltd|Tech|Solutions|Systems|Group))",
    r"(?:client|customer|company|account|organization)\s*(?:is|:|-|–)?\s*([A-Z][A-Za-z]+(?:\s[A-Z][A-Za-z]+){0,3})\b",
    r"\b([A-Z][A-Za-z]+(?:\s[A-Z][A-Za-z]+){0,2})\s+(?:is a|is an|are a|are an)\s+(?:technology|tech|software|finance|healthcare|consulting|manufacturing)",
]
INDUSTRY_LABEL_PATTERN = r"[Ii]ndustry\s*[:\-]\s*([^\n]+)"
INDUSTRY_KEYWORDS = {
    "Information Technology & Hardware": ["computer hardware", "hardware and electronics", "pc manufacturer", "laptop", "semiconductor"],
    "Information Technology": ["information technology", "technology", "tech", "software", "saas", "cloud computing", "ai ", "artificial intelligence", "it services"],
    "Healthcare": ["healthcare", "health care", "medical", "pharma", "pharmaceutical", "biotech"],
    "Finance": ["finance", "financial", "banking", "insurance", "fintech"],
    "Manufacturing": ["manufacturing", "industrial", "factory", "production"],
    "Retail": ["retail", "e-commerce", "ecommerce", "shopping"],
    "Energy": ["energy", "oil", "gas", "petroleum", "renewable"],
    "Automotive": ["automotive", "automobile", "vehicle", "car"],
    "Consulting": ["consulting", "advisory", "professional services"],
    "Telecommunications": ["telecom", "telecommunications", "wireless", "mobile network"],
    "Education": ["education", "edtech", "university", "academic"],
}
GEOGRAPHY_PATTERN = r"(?i)(?:headquartered|hq|based|located)\s+in\s+([A-Z][A-Za-z\s,]+?)(?:\.|,|\n|with)"
EMPLOYEES_PATTERN = r"(?i)(\d[\d,]+)\s*\+?\s*(?:employees|staff|workforce|people)"
REVENUE_PATTERN = r"(?i)(?:annual revenue|revenue)[^\$\d]*\$?\s*([\d,.]+)\s*(billion|million|B|M)\b"
MONEY_PATTERN = r"(?i)\$[\d,.]+\s*(?:million|billion|M|B|K)?|\d+(?:\.\d+)?\s*(?:million|billion)\s*(?:dollars?)?"
TOPIC_WORDS = [
    "budget", "timeline", "deadline", "pricing", "security", "compliance",
    "integration", "migration", "support", "license", "contract", "demo",
    "proposal", "requirements", "features", "performance", "scalability",
    "deployment", "training", "onboarding", "implementation",
]
ACTION_PATTERN = (
    r"(?i)[^.!?\n]*(?:need|want|require|plan|decide|agree|confirm|approve|move forward|ready)"
    r"[^.!?\n]*[.!?]"
)
POSITIVE_WORDS = [
    "great", "excellent", "happy", "pleased", "good", "excited", "love", "wonderful",
    "forward", "agree", "ready", "perfect", "thanks", "appreciate", "fantastic",
]
NEGATIVE_WORDS = [
    "concern", "issue", "problem", "worry", "delay", "expensive", "difficult",
    "frustrated", "disappointed", "unfortunately", "risk", "fail",
]
TIMESTAMP_PATTERN = r"\[(\d{1,2}):(\d{2})(?::(\d{2}))?\]"
COMPETITORS = [
    "AWS", "Azure", "Google Cloud", "GCP", "Salesforce", "Oracle",
    "SAP", "Microsoft", "IBM", "Workday", "ServiceNow", "Snowflake",
    "Databricks", "HubSpot", "Zendesk", "Slack", "Zoom",
]
HIGH_INTENT_WORDS = ["ready", "move forward", "approve", "sign"]
MEDIUM_INTENT_WORDS = ["interested", "evaluate", "consider"]
DEAL_NAME_PATTERN = r"(?i)(?:current deal|deal name|deal|project)\s*[:\-]\s*([^\n]+)"
STAGE_PATTERNS = {
    "Negotiation": r"(?i)\bnegotiat",
    "Proposal": r"(?i)\bproposal|\bproposed",
    "Discovery": r"(?i)\bdiscovery|\bqualif",
    "Closed Won": r"(?i)\bclosed?\s+won",
    "Closed Lost": r"(?i)\bclosed?\s+lost",
}
CLOSE_DATE_PATTERN = (
    r"(?i)(?:close|closing|expected)\s*(?:date)?\s*[:\-]?\s*"
    r"([Q][1-4]\s*\d{4}|\d{4}-\d{2}-\d{2}|[A-Z][a-z]+\s+\d{4})"
)
# The name runs to the next comma or line end; role and department are optional labels after it.
CONTACT_PATTERN = (
    r"(?i)(?:primary contact|key contact|account manager|sales rep|contact)\s*[:\-]\s*"
    r"([A-Z][A-Za-z ]+)"
    r"(?:[,\n]\s*(?:role|title|position)\s*[:\-]\s*([^\n,]+))?"
    r"(?:[,\n]\s*(?:department|dept|region|division)\s*[:\-]\s*([^\n,]+))?"
)
INTENT_STAGE = {"High": "Negotiation", "Medium": "Proposal", "Low": "Discovery"}
INTENT_CONFIDENCE = {"High": "0.9", "Medium": "0.7", "Low": "0.5"}

# ---------------------------------------------------------------- chunks and vectors
CHUNK_SIZE = 500
CHUNK_OVERLAP = 100
MIN_TEXT_CHARS = 50
TOP_K = 5
SCORE_FLOOR = 0.20

# ---------------------------------------------------------------- questions
GREETINGS = [
    "hi", "hello", "hey", "hola", "namaste", "good morning",
    "good afternoon", "good evening", "greetings", "yo", "sup",
    "howdy", "hi there", "hey there", "what's up", "how are you",
]
NARRATIVE_KEYWORDS = [
    "what did", "what was said", "what was discussed", "what was mentioned",
    "what were they", "what happened", "what came up",
    "summarize", "summary of", "describe", "tell me about", "explain",
    "key points", "action items", "next steps", "follow up",
    "meeting", "transcript", "call", "conversation", "discussion",
    "attendees", "who attended", "who was in",
    "how did", "how was the", "how did they", "tone", "reaction",
    "excited", "hesitant", "concerned", "positive about", "negative about",
    "mentioned", "talked about", "said about", "raised", "brought up",
    "according to", "notes", "quote",
    "competitor", "competitive", "intel", "mentioned aws", "mentioned azure",
    "mentioned salesforce", "mentioned oracle",
]
METRIC_KEYWORDS = [
    "how many", "how much", "total", "count", "sum", "average", "avg",
    "revenue", "pipeline value", "deal value", "number of",
    "list all", "show all", "show me all",
    "which accounts", "which deals", "which stage",
    "top ", "rank", "highest", "lowest",
    "closing soon", "close date", "probability",
    "open deals", "won deals", "lost deals",
    "at risk", "no contact",
    "vertical", "horizontal", "salesperson", "engagement model",
    "ai influenced", "ai-influenced", "ai influence",
    "onshore", "offshore", "opportunity stage",
    "new business", "existing customer", "renewal",
    "p0", "p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9", "p10",
    "mortgage", "banking", "capital market", "higher education", "payments",
    "win rate", "conversion", "performance",
    "win loss", "win/loss", "loss rate", "lost deals",
    "velocity", "cycle time", "days in stage", "speed",
    "geography mix", "onshore vs", "offshore vs",
    "lead source", "referral", "inbound", "cold outreach",
    "stale", "stuck", "no update", "inactive deal",
]
QUESTION_STOP_WORDS = [
    "What", "When", "Where", "Who", "How", "Which",
    "Show", "Tell", "Give", "List", "Find", "Get",
    "The", "And", "For", "Are", "Can", "Does", "Did",
    "Have", "Has", "Will", "Any", "All", "Our", "Their",
    "About", "From", "With", "This", "That", "Some",
]
QUESTION_NAME_PATTERN = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
HISTORY_TURNS = 6
HISTORY_CHARS = 500
SILVER_TABLE_PATTERN = r"(?i)silver\.(\w+)"
SQL_WORDS = ["where", "from", "join", "on", "and", "or"]
