"""Verdict and scoring rules. Scores and verdicts depend on these numbers and words."""

# Confidence bands.
CONFIDENCE_HIGH = 0.8
CONFIDENCE_MEDIUM = 0.6
CONFIDENCE_LOW = 0.4
CONFIDENCE_MINIMUM = 0.2

# Spam terms.
SPAM_TERMS = [
    "casino", "poker", "betting", "adult", "xxx", "porn", "pharmacy", "pills", "viagra", "loan",
    "payday",
]

# Signals of a self-serve tool and of a service agency.
TOOL_SIGNALS = [
    r"free\s*trial",
    r"\$\d+\s*(?:/|per)\s*(?:month|mo\b|user|seat)",
    r"pricing\s*plan",
    r"sign\s*up\s*(?:for\s*)?free",
    r"start\s*(?:for\s*)?free",
    r"per\s*(?:user|seat|month)\b",
    r"(?:a/b|split)\s*testing\s*(?:tool|software|platform|solution)",
    r"heatmap\s*(?:tool|software|platform)",
    r"session\s*recording\s*(?:tool|software)",
    r"crm\s*(?:software|platform|tool|system)",
    r"no-?code\s*(?:tool|platform|builder)",
    r"run\s*(?:a/b|split)\s*tests\s*(?:yourself|on your)",
    r"self-?serve",
    r"(?:14|30)-day\s*free",
]
AGENCY_SIGNALS = [
    r"our\s+(?:team|clients|experts|consultants|specialists)",
    r"we\s+(?:help|partner\s+with|specialize\s+in|work\s+with)",
    r"case\s+stud(?:y|ies)",
    r"managed\s+(?:service|program|cro|experimentation)",
    r"(?:cro|conversion)\s+(?:consulting|consultancy|agency|audit\s+service)",
    r"client\s+(?:result|success|portfolio)",
    r"experimentation\s+program",
    r"\bagency\b|\bconsultancy\b|\bconsulting\s+firm\b",
    r"full.?service\s+(?:agency|cro|marketing)",
]

# Where tool-against-agency matters.
SERVICE_INTENTS = ["agency_search", "local_business_search"]
SERVICE_INDUSTRIES = ["cro_agency", "digital_marketing", "hr_tech", "edtech"]

# Words of a phrase that never occur on a target site.
OPERATOR_WORDS = [
    "competitor", "competitors", "alternative", "alternatives",
    "find", "best", "top", "similar", "like", "vs", "versus",
    "leading", "popular", "agency", "agencies",
]

# Phrases that move the relevance of service searches.
AGENCY_PHRASES = [
    "our team", "our clients", "our experts", "case study", "case studies",
    "we help", "we partner", "managed service", "full-service", "consulting",
    "consultancy", "bespoke", "tailored", "dedicated team", "client results",
]
TOOL_PHRASES = [
    "free trial", "pricing", "sign up free", "per user", "per month",
    "dashboard", "self-serve", "no-code", "14-day", "30-day free",
]

# Words without weight in a service phrase.
SERVICE_STOP_WORDS = [
    "software", "platform", "tool", "service", "services", "solution", "solutions",
    "management", "analytics", "system", "app", "application", "product", "products",
    "and", "the", "for", "with", "your", "our", "their", "web", "data", "digital",
    "business", "company", "enterprise", "team", "teams",
    "testing", "test", "tests",
]
MIN_MATCH_SCORE = 0.1
