"""Fixed values that must equal the reference's for equal results.

Word lists, phrase maps and thresholds, stated as plain text in their natural
order. Callers may pass their own tables; these are the defaults.
"""

# ---------------------------------------------------------------------------
# Claim extraction and direction detection.
# ---------------------------------------------------------------------------
INCREASE_WORDS = [
    "increased", "increase", "grew", "growth", "up", "rose", "higher", "surged",
    "jumped", "improved", "expanded", "gained",
]
DECREASE_WORDS = [
    "decreased", "decrease", "declined", "decline", "down", "fell", "lower",
    "dropped", "reduced", "contracted", "shrunk",
]
DIRECTION_WORDS = INCREASE_WORDS + DECREASE_WORDS
MULTIPLIER_WORDS = [
    "doubled", "tripled", "halved", "quadrupled",
    "nearly doubled", "nearly tripled",
    "more than doubled", "more than tripled",
]
DIRECTION_VERBS_WITH_NUMBER = [
    "grew", "increased", "declined", "decreased", "fell", "rose", "dropped", "reduced",
]
SENTENCE_MIN_CHARS = 15
SENTENCE_MAX_CHARS = 250
MAX_CLAIMS_PER_DOCUMENT = 8

# ---------------------------------------------------------------------------
# Change parsing (pct, direction, tolerance, mode), checked in
# this order after a percent sign, which always wins with tolerance 5.
# ---------------------------------------------------------------------------
PERCENT_TOLERANCE = 5.0
MULTIPLIER_RULES = [
    # (pattern words, pct, direction, tolerance, mode)
    ("more than doubled", 100.0, "increase", 0.0, "more_than_doubled"),
    ("more than tripled", 200.0, "increase", 0.0, "more_than_tripled"),
    ("nearly doubled", 100.0, "increase", 30.0, None),
    ("nearly tripled", 200.0, "increase", 30.0, None),
    ("doubled", 100.0, "increase", 20.0, None),
    ("tripled", 200.0, "increase", 25.0, None),
    ("halved", 50.0, "decrease", 10.0, None),
]

# ---------------------------------------------------------------------------
# Column matching.
# ---------------------------------------------------------------------------
MATCH_CONFIDENCE_THRESHOLD = 0.80
FUZZY_CUTOFF = 60

BUSINESS_TERMS = {
    "net promoter score": ["nps_score", "nps"],
    "nps":                ["nps_score", "nps"],
    "headcount":          ["headcount", "head_count", "employees", "staff"],
    "employees":          ["employees", "headcount", "head_count", "staff"],
    "staff":              ["staff", "headcount", "employees"],
    "workforce":          ["headcount", "employees", "workforce"],
    "paying customers":   ["customers", "paying_customers", "customer"],
    "customer base":      ["customers", "customer_base", "customer"],
    "customers":          ["customers", "customer"],
    "clients":            ["customers", "clients", "client"],
    "accounts":           ["customers", "accounts"],
    "churn rate":         ["churn_rate_pct", "churn_rate", "churn"],
    "churn":              ["churn_rate_pct", "churn_rate", "churn"],
    "attrition":          ["churn_rate_pct", "attrition", "churn"],
    "total revenue":      ["revenue_usd_thousands", "total_revenue", "revenue", "sales"],
    "net revenue":        ["net_revenue", "revenue_usd_thousands", "revenue"],
    "revenue":            ["revenue_usd_thousands", "revenue", "sales"],
    "sales":              ["sales", "revenue_usd_thousands", "revenue"],
    "gross profit":       ["gross_profit", "gross_margin", "profit"],
    "net income":         ["net_income", "net_profit", "profit"],
    "profit margin":      ["profit_margin", "gross_margin", "margin"],
    "profit":             ["profit", "net_income", "earnings"],
    "earnings":           ["earnings", "net_income", "profit"],
    "annual recurring revenue":  ["arr", "annual_recurring_revenue"],
    "monthly recurring revenue": ["mrr", "monthly_recurring_revenue"],
    "arr":                ["arr", "annual_recurring_revenue"],
    "mrr":                ["mrr", "monthly_recurring_revenue"],
    "operating costs":    ["operating_cost", "opex", "cost", "expenses"],
    "cost of goods sold": ["cogs_usd_m", "cogs", "cost_of_goods"],
    "cost of goods":      ["cogs_usd_m", "cogs", "cost_of_goods", "cost"],
    "cogs":               ["cogs_usd_m", "cogs"],
    "expenses":           ["expenses", "opex", "cost"],
    "cost":               ["cost", "costs", "expenses"],
    "research & development":  ["rnd_spend_usd_m", "rnd", "r_and_d", "research"],
    "research and development": ["rnd_spend_usd_m", "rnd", "r_and_d", "research"],
    "r and d":            ["rnd_spend_usd_m", "rnd"],
    "r&d":                ["rnd_spend_usd_m", "rnd"],
    "customer lifetime value": ["ltv_usd", "ltv", "lifetime_value"],
    "lifetime value":     ["ltv_usd", "ltv", "lifetime_value"],
    "ltv":                ["ltv_usd", "ltv", "lifetime_value"],
    "customer acquisition cost": ["cac_usd", "cac", "customer_acquisition_cost"],
    "cac":                ["cac_usd", "cac", "customer_acquisition_cost"],
    "seats":              ["seats", "licenses", "users"],
    "growth rate":        ["growth_rate", "growth"],
    "retention":          ["retention_rate", "retention"],
    "conversion":         ["conversion_rate", "conversion"],
}

DOMAIN_ALIASES = {
    "revenue":   ["revenue", "sales", "income", "turnover"],
    "profit":    ["profit", "net income", "earnings"],
    "cost":      ["cost", "expense", "expenditure"],
    "arr":       ["arr", "annual recurring revenue"],
    "mrr":       ["mrr", "monthly recurring revenue"],
    "seats":     ["seats", "licenses", "users"],
    "customers": ["customers", "clients", "accounts"],
    "churn":     ["churn", "attrition"],
    "nps":       ["nps", "net promoter score", "promoter"],
    "headcount": ["headcount", "employees", "staff", "workforce"],
    "growth":    ["growth", "growth rate"],
    "cogs":      ["cogs", "cost of goods sold", "cost of goods"],
    "rnd":       ["r&d", "research and development", "research & development", "r and d"],
    "ltv":       ["ltv", "lifetime value", "customer lifetime value"],
    "cac":       ["cac", "customer acquisition cost"],
}

# ---------------------------------------------------------------------------
# Time windows and date-column detection.
# ---------------------------------------------------------------------------
DATE_NAME_WORDS = ["date", "period", "quarter", "month", "year", "time"]

# ---------------------------------------------------------------------------
# Question routing (checked both, then csv, then pdf; default pdf).
# ---------------------------------------------------------------------------
PDF_KEYWORDS = [
    "document", "pdf", "report", "page", "section", "mentioned", "states",
    "says", "according to", "summarize", "summary", "takeaways", "risks",
    "highlights", "narrative", "financial highlights", "main points",
]
CSV_KEYWORDS = [
    "csv", "data", "dataset", "spreadsheet", "table", "columns", "rows",
    "missing", "null", "total", "sum", "average", "mean", "maximum",
    "minimum", "max", "min", "highest", "lowest", "count", "group",
    "by region", "by category", "revenue by", "sales by", "profit by",
    "arr", "mrr", "seats", "customers",
]
BOTH_KEYWORDS = [
    "match", "matches", "verify", "compare", "comparison",
    "contradict", "contradicted", "supported", "claim", "claims",
    "consistent", "consistency", "does the report match", "does the pdf match",
    "document vs data", "pdf vs csv", "against the csv", "against the data",
    "validate", "validation",
]

# ---------------------------------------------------------------------------
# Table-question intents, tested in this order as substrings.
# ---------------------------------------------------------------------------
INTENT_WORDS = [
    ("summary", ["summary", "summarize", "overview"]),
    ("missing", ["missing", "null"]),
    ("columns", ["columns"]),
    ("numeric", ["numeric"]),
    ("categorical", ["categorical", "category"]),
    ("total", ["total", "sum"]),
    ("average", ["average", "mean"]),
    ("max", ["highest", "maximum", "max"]),
    ("min", ["lowest", "minimum", "min"]),
    ("grouped", ["by"]),
]
GROUPED_TOP_N = 10

# ---------------------------------------------------------------------------
# Model-response cleaning and citations.
# ---------------------------------------------------------------------------
ROUTE_INTENTS = ["pdf", "csv", "both"]
DEFAULT_ROUTE_CONFIDENCE = 0.8
FALLBACK_ROUTE_CONFIDENCE = 0.5
CITATION_PATTERN = r"(?i)\(page\s+\d+\)"
