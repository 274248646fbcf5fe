"""Domain lists. Exact-match lists; the four block lists differ on purpose."""

# Domains a verdict rejects.
VERDICT_BLOCKLIST = [
    "google.com", "facebook.com", "youtube.com", "twitter.com", "linkedin.com",
    "instagram.com", "reddit.com", "wikipedia.org", "amazon.com", "bing.com",
    "yahoo.com", "pinterest.com", "tiktok.com", "snapchat.com",
    "clutch.co", "g2.com", "capterra.com", "goodfirms.co", "trustpilot.com",
    "crunchbase.com", "producthunt.com", "growjo.com", "cbinsights.com",
]

# Domains never taken as a candidate of a batch run.
CANDIDATE_BLOCKLIST = [
    "google.com", "google.co.uk", "google.in", "google.co",
    "facebook.com", "youtube.com", "twitter.com", "x.com",
    "linkedin.com", "instagram.com", "reddit.com", "wikipedia.org",
    "amazon.com", "bing.com", "yahoo.com", "tiktok.com",
    "pinterest.com", "whatsapp.com", "snapchat.com",
    "duckduckgo.com", "baidu.com", "yandex.com", "apple.com",
    "microsoft.com", "github.com", "stackoverflow.com", "medium.com",
    "clutch.co", "g2.com", "capterra.com", "goodfirms.co",
    "trustpilot.com", "crunchbase.com", "producthunt.com",
    "growjo.com", "cbinsights.com", "topdevelopers.co",
]

# Domains never taken as a candidate of a profile-driven search.
SEARCH_BLOCKLIST = [
    "google.com", "google.co.uk", "google.in", "facebook.com", "youtube.com",
    "twitter.com", "x.com", "linkedin.com", "instagram.com", "reddit.com",
    "wikipedia.org", "amazon.com", "bing.com", "yahoo.com", "tiktok.com",
    "pinterest.com", "duckduckgo.com", "apple.com", "microsoft.com",
    "github.com", "stackoverflow.com", "medium.com",
    "clutch.co", "g2.com", "capterra.com", "goodfirms.co",
    "trustpilot.com", "crunchbase.com", "producthunt.com",
    "growjo.com", "cbinsights.com", "topdevelopers.co",
]

# Hosts of result pages that are not companies.
RESULT_BLOCKLIST = [
    "google.com", "bing.com", "yahoo.com", "duckduckgo.com",
    "facebook.com", "twitter.com", "x.com", "linkedin.com",
    "youtube.com", "reddit.com", "wikipedia.org", "amazon.com",
    "medium.com", "quora.com", "forbes.com", "techcrunch.com",
    "g2.com", "capterra.com", "trustpilot.com", "glassdoor.com",
    "crunchbase.com", "producthunt.com", "github.com",
]

# Companies whose site is not under .com, for page titles.
KNOWN_TITLE_DOMAINS = {
    "twitch": "twitch.tv", "telegram": "telegram.org", "signal": "signal.org",
    "whatsapp": "whatsapp.com", "github": "github.com", "gitlab": "gitlab.com",
    "bitbucket": "bitbucket.org", "mastodon": "mastodon.social",
    "khanacademy": "khanacademy.org", "wikipedia": "wikipedia.org", "mozilla": "mozilla.org",
    "creativecommons": "creativecommons.org",
}

# Company -> site, the long and the short map.
KNOWN_COMPANY_DOMAINS = {
    "notion": "notion.so", "linear": "linear.app", "figma": "figma.com", "slack": "slack.com",
    "zoom": "zoom.us", "miro": "miro.com", "airtable": "airtable.com", "clickup": "clickup.com",
    "discord": "discord.com", "dropbox": "dropbox.com", "asana": "asana.com",
    "monday": "monday.com", "jira": "atlassian.com", "trello": "trello.com",
    "vercel": "vercel.com", "netlify": "netlify.com", "supabase": "supabase.com",
    "webflow": "webflow.com", "framer": "framer.com", "loom": "loom.com", "retool": "retool.com",
    "amplitude": "amplitude.com", "mixpanel": "mixpanel.com", "segment": "segment.com",
    "intercom": "intercom.com", "zendesk": "zendesk.com",
}

# Brand word -> site.
KNOWN_BRANDS = {
    "nike": "nike.com", "adidas": "adidas.com", "jordan": "nike.com", "puma": "puma.com",
    "apple": "apple.com", "samsung": "samsung.com", "google": "google.com",
    "amazon": "amazon.com", "tesla": "tesla.com", "microsoft": "microsoft.com",
    "shopify": "shopify.com", "stripe": "stripe.com", "notion": "notion.so",
    "figma": "figma.com", "slack": "slack.com", "zoom": "zoom.us",
    "hubspot": "hubspot.com", "salesforce": "salesforce.com", "zendesk": "zendesk.com",
    "lego": "lego.com", "netflix": "netflix.com", "spotify": "spotify.com",
    "airbnb": "airbnb.com", "uber": "uber.com", "lyft": "lyft.com",
    "doordash": "doordash.com", "instacart": "instacart.com",
}

# Directory pages, read for their links only.
DIRECTORY_PAGES = {
    "cro_agency": [
        "https://clutch.co/agencies/conversion-rate-optimization",
        "https://goodfirms.co/cro-companies",
        "https://www.topdevelopers.co/blog/top-conversion-rate-optimization-companies",
    ],
    "digital_marketing": [
        "https://clutch.co/agencies/digital-marketing",
        "https://goodfirms.co/digital-marketing-companies",
    ],
}

# Industry keys and the other names they go by. The seed companies of each
# industry are an input table (industry, pos, domain), not part of the package.
INDUSTRY_KEYS = [
    "cro_agency", "ecommerce_platform", "ecommerce", "ai", "digital_marketing", "software",
    "productivity", "project_management", "notes_app", "collaboration", "design_tool", "devtools",
    "apparel", "food", "finance", "cloud", "cybersecurity", "hr_tech", "edtech", "media", "travel",
]
INDUSTRY_ALIASES = {
    "ab_testing": "cro_agency", "conversion_optimization": "cro_agency",
    "conversion_rate_optimization": "cro_agency", "experimentation": "cro_agency",
    "cro": "cro_agency", "marketing_agency": "digital_marketing", "seo": "digital_marketing",
    "saas": "software", "b2b_saas": "software", "enterprise_software": "software",
    "project_management": "project_management", "task_management": "project_management",
    "note_taking": "notes_app", "knowledge_management": "notes_app",
    "team_communication": "collaboration", "messaging": "collaboration",
    "ui_design": "design_tool", "ux_design": "design_tool", "developer_tools": "devtools",
    "infrastructure": "cloud", "hr": "hr_tech", "human_resources": "hr_tech",
    "recruiting": "hr_tech", "talent_management": "hr_tech", "ecommerce": "ecommerce",
    "online_retail": "ecommerce",
}
