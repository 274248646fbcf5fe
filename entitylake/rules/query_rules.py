"""Search-phrase rules. Patterns are matched in this order, first hit wins."""

# Bare domain, with or without scheme and path.
BARE_DOMAIN = r"^(?:https?://)?(?:www\.)?([\w-]+\.[\w.-]+)(?:/.*)?$"

# Intent rules and the label when none fits.
INTENT_RULES = [
    (r"competitor|alternative|vs\s|versus|similar to", "competitor_analysis"),
    (r"agency|agencies|firm|firms", "agency_search"),
    (r"local|near me|\bin\s+[a-z]+|delhi|mumbai|new york|london|bangalore", "local_business_search"),
    (r"\bproduct\b|\btool\b|\bsoftware\b|\bplatform\b|\bsaas\b", "product_discovery"),
    (r"\bbrand\b|\bstore\b|\bshop\b|\becommerce\b", "brand_discovery"),
    (r"\btechnology\b|using\s+\w+|powered by|built with", "technology_search"),
    (r"best|top|leading|popular", "market_discovery"),
]
DEFAULT_INTENT = "general_search"

# Industry of a search phrase.
QUERY_INDUSTRY_RULES = [
    (r"\bcro\b|conversion rate optimization|a/b test|experimentation|conversion optimiz", "cro_agency"),
    (r"shopify\s+(?:alternative|competitor|vs|platform)|(?:best|top)\s+ecommerce\s+platform"
     r"|bigcommerce|woocommerce|magento|opencart|prestashop", "ecommerce_platform"),
    (r"shopify\s+store|(?:best|top|popular)\s+(?:online\s+)?(?:store|brand|shop|business)"
     r"|d2c|dtc|direct.to.consumer|ecommerce\s+brand", "ecommerce"),
    (r"ecommerce|e-commerce|online store", "ecommerce_platform"),
    (r"\bai\b(?!\w)|artificial intelligence|machine learning|\bml\b(?!\w)|\bllm\b(?!\w)|generative", "ai"),
    (r"\bseo\b|digital marketing|\bppc\b|\bsem\b|paid ads|growth hacking", "digital_marketing"),
    (r"\bsports\b|jersey|clothing|apparel|fashion|garment|uniform|shoe|shoes|sneaker|sneakers"
     r"|footwear|boots|activewear|sportswear|jordan|nike|adidas", "apparel"),
    (r"\btoy\b|\bgame\b(?! agency)|\bkids\b|\bchildren\b|\bentertainment\b", "toys"),
    (r"\bsoftware\b(?! agency)|\bsaas\b|development agency|dev agency", "software"),
    (r"food|restaurant|hospitality|catering|\bfnb\b", "food"),
    (r"finance|fintech|banking|insurance|trading", "finance"),
    (r"healthcare|health tech|medtech|pharma|telemedicine|clinic", "healthcare"),
    (r"real estate|proptech|property|realty|mortgage", "real_estate"),
    (r"travel|hospitality|hotel|booking|flight|tourism", "travel"),
    (r"edtech|education|learning|e-learning|online course|tutoring", "edtech"),
    (r"\bvideo\b|streaming|youtube|vimeo|twitch|podcast|media|entertainment|broadcast", "media"),
    (r"social media|social network|facebook|instagram|tiktok|snapchat", "social_media"),
    (r"cloud|hosting|infrastructure|vpc|devops|kubernetes|docker", "cloud"),
    (r"cybersecurity|security|firewall|antivirus|endpoint|soc\b|siem", "cybersecurity"),
    (r"recruiting|talent|staffing|hiring|hr tech|workforce", "hr_tech"),
]

# Industry of a long company description.
DESCRIPTION_INDUSTRY_RULES = [
    (r"\ba/b test|\bsplit test|conversion.*rate.*optim|\bcro\b|experimentation.*platform"
     r"|website.*optim.*agency", "cro_agency"),
    (r"video.*shar|streaming.*video|video.*platform|video.*host", "media"),
    (r"social.*network|social.*media.*platform", "social_media"),
    (r"e-?commerce|online.*retail|online.*shop|marketplace", "ecommerce"),
    (r"fintech|financial.*tech|payment.*platform|digital.*bank", "finance"),
    (r"artificial.*intelligence|machine.*learning|large.*language", "ai"),
    (r"cloud.*computing|cloud.*service|infrastructure.*as", "cloud"),
    (r"cybersecurity|information.*security|endpoint.*protect", "cybersecurity"),
    (r"footwear|athletic.*shoe|sportswear|apparel|clothing.*brand", "apparel"),
    (r"food.*delivery|restaurant.*tech|meal.*kit", "food"),
    (r"real.*estate|property.*tech|proptech", "real_estate"),
    (r"online.*travel|hotel.*booking|flight.*search", "travel"),
    (r"software.*company|saas|cloud.*application", "software"),
    (r"online.*education|e-?learning|edtech|learning.*platform", "edtech"),
    (r"digital.*market|seo|paid.*ads|paid.*search", "digital_marketing"),
    (r"note.?taking|wiki|knowledge\s*base|personal\s*knowledge|docs.*tool", "notes_app"),
    (r"project\s*management|task\s*management|work\s*management", "project_management"),
    (r"team\s*collaboration|workplace\s*communication|messaging.*platform|team\s*messaging",
     "collaboration"),
    (r"all.in.one\s*workspace|productivity\s*tool|productivity\s*app|workspace\s*app", "productivity"),
    (r"design.*tool|design.*software|prototyping.*tool|ui.*design", "design_tool"),
    (r"developer\s*tool|devops|code.*editor|ide\b|version\s*control", "devtools"),
]

# Industry of a page's meta description and title.
META_INDUSTRY_RULES = [
    (r"\ba/b\s*test|\bsplit\s*test|conversion\s*rate\s*optim|\bcro\b|experimentation.*agency",
     "cro_agency"),
    (r"digital\s*market|seo\b|\bppc\b|\bsem\b|paid\s*ads|growth\s*hack", "digital_marketing"),
    (r"video\s*shar|streaming\s*video|video\s*platform|video\s*host", "media"),
    (r"social\s*network|social\s*media\s*platform", "social_media"),
    (r"e-?commerce|online\s*retail|online\s*store|marketplace", "ecommerce_platform"),
    (r"fintech|financial\s*tech|payment\s*platform|digital\s*bank", "finance"),
    (r"artificial\s*intelligence|machine\s*learning|large\s*language\s*model", "ai"),
    (r"cloud\s*computing|cloud\s*service|infrastructure\s*as\s*a\s*service", "cloud"),
    (r"cybersecurity|information\s*security|endpoint\s*protect", "cybersecurity"),
    (r"footwear|athletic\s*shoe|sportswear|apparel|clothing\s*brand", "apparel"),
    (r"food\s*delivery|restaurant|meal\s*kit|catering", "food"),
    (r"real\s*estate|proptech|property\s*tech", "real_estate"),
    (r"travel|hotel|flight\s*search|booking\s*platform", "travel"),
    (r"online\s*education|e-?learning|edtech|learning\s*platform", "edtech"),
    (r"recruiting|talent\s*acquisition|staffing|hr\s*tech|workforce", "hr_tech"),
    (r"saas|software\s*as\s*a\s*service", "software"),
    (r"note.?taking|wiki|knowledge\s*base|personal\s*knowledge|docs.*tool", "notes_app"),
    (r"project\s*management|task\s*management|work\s*management\s*tool", "project_management"),
    (r"team\s*collaboration|workplace\s*communication|messaging.*platform|team\s*messaging",
     "collaboration"),
    (r"all.in.one\s*workspace|productivity\s*(?:tool|app|suite)|workspace\s*app", "productivity"),
    (r"design.*tool|design.*software|prototyping.*tool|ui.*design\s*tool", "design_tool"),
    (r"developer\s*tool|devops\s*platform|code\s*editor|version\s*control", "devtools"),
]

# Location phrases, then known cities.
QUERY_LOCATION_PATTERNS = [r"\bin\s+([\w\s]+?)(?:\s*,|\s*$)", r"\bnear\s+([\w\s]+?)(?:\s*,|\s*$)"]
CITIES = [
    "Delhi", "Mumbai", "Bangalore", "Chennai", "Hyderabad", "Pune", "London", "New York",
    "Los Angeles", "Chicago", "San Francisco", "Toronto", "Sydney", "Singapore",
]

# Person words of the entity type.
PERSON_WORDS = r"\bperson\b|\bfounder\b|\bceo\b|\bcto\b|\bpeople\b"

# Words that carry no topic.
KEYWORD_STOP_WORDS = [
    "find", "best", "top", "good", "great", "list", "of", "the", "a", "an",
    "and", "or", "for", "with", "using", "competitor", "competitors", "alternative",
    "alternatives", "similar", "like", "versus", "vs", "leading", "popular",
    "how", "what", "where", "who", "show", "me", "give", "store", "stores",
    "brand", "brands", "company", "companies", "agency", "agencies",
]

# Target company of a phrase. "documented" looks for "of X" first and keeps the
# dot; "literal" takes the word before "competitor" first; "enhancer" is the third published order.
TARGET_COMPANY_PATTERNS = {
    "literal": [
        r"([a-zA-Z0-9_-]+)\s+(?:competitor|alternative|vs\b)",
        r"(?:competitor|alternative)\s+(?:of|to)\s+([a-zA-Z0-9_-]+)",
        r"(?:find\s+competitors?\s+of|analyze)\s+([a-zA-Z0-9._-]+)",
    ],
    "enhancer": [
        r"([a-zA-Z0-9_-]+)\s+(?:competitor|alternative|vs\b)",
        r"(?:competitor|alternative)\s+(?:of|to)\s+([a-zA-Z0-9_-]+)",
        r"(?:find|best|top|leading)\s+([a-zA-Z0-9_-]+)\s+(?:competitor|alternative)",
    ],
    "documented": [
        r"(?:competitors?\s+of\s+|alternatives?\s+to\s+|vs\.?\s+|like\s+)([a-zA-Z0-9_.-]+)",
        r"([a-zA-Z0-9_-]+)\s+(?:competitors?|alternatives?)",
    ],
}

# Top-level domains cut from a domain to get a company name.
NAME_TLDS = r"\.(com|io|co|net|org|tv|ai|app).*$"

# Web-search intents that use discovered domains.
WEB_INTENTS = ["competitor_analysis", "market_discovery", "brand_discovery", "general_search"]
