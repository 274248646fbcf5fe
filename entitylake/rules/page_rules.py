"""Page fingerprints. Results depend on these exact strings and their order."""

# Technology -> signature substrings, in report order.
TECHNOLOGY_SIGNATURES = {
    "Shopify": ["cdn.shopify.com", "shopifycdn.com", "myshopify.com"],
    "WooCommerce": ["woocommerce", "wc-api"],
    "Magento": ["mage/cookies", "magento", "mageworx"],
    "BigCommerce": ["bigcommerce.com", "cdn11.bigcommerce"],
    "WordPress": ["wp-content", "wp-includes", "wordpress.org"],
    "Webflow": ["webflow.com", "assets.website-files.com"],
    "Squarespace": ["squarespace.com", "static1.squarespace"],
    "Wix": ["wixstatic.com", "wix.com"],
    "Optimizely": ["optimizely.com", "cdn.optimizely.com"],
    "VWO": ["vwo.com", "visualwebsiteoptimizer"],
    "Hotjar": ["hotjar.com", "static.hotjar.com"],
    "Google Analytics": ["google-analytics.com", "gtag/js", "ga.js"],
    "Google Tag Manager": ["googletagmanager.com", "gtm.js"],
    "Mixpanel": ["mixpanel.com", "cdn.mxpnl.com"],
    "Amplitude": ["amplitude.com", "cdn.amplitude.com"],
    "HubSpot": ["hubspot.com", "hs-scripts.com"],
    "Salesforce": ["salesforce.com", "force.com"],
    "Klaviyo": ["klaviyo.com", "klaviyoV2"],
    "Mailchimp": ["mailchimp.com", "chimpstatic.com"],
    "Intercom": ["intercom.io", "widget.intercom.io"],
    "Segment": ["cdn.segment.com", "analytics.js"],
    "React": ["react.development.js", "react.production.min.js", "__react"],
    "Next.js": ["_next/static", "__NEXT_DATA__"],
    "Vue.js": ["vue.min.js", "__vue__"],
    "Angular": ["angular.min.js", "ng-version"],
    "Nuxt.js": ["_nuxt/", "__nuxt"],
    "Gatsby": ["gatsby-chunk", "/static/gatsby"],
    "Cloudflare": ["cloudflare.com", "__cf_bm", "cf-ray"],
    "AWS CloudFront": ["cloudfront.net"],
    "Fastly": ["fastly.net"],
    "Stripe": ["js.stripe.com", "stripe.com/v3"],
    "PayPal": ["paypal.com/sdk", "paypalobjects.com"],
}

# Social platform -> link pattern.
SOCIAL_PATTERNS = {
    "linkedin": r"linkedin\.com/(company|in)/",
    "twitter": r"twitter\.com/|x\.com/",
    "facebook": r"facebook\.com/",
    "instagram": r"instagram\.com/",
    "youtube": r"youtube\.com/(channel|c|user)/",
    "github": r"github\.com/",
}

# Structured-data node types taken as an organisation.
ORGANISATION_TYPES = r"Organization|Corporation|LocalBusiness|Company"

# Contact formats. The groups of the phone format do not capture, because extraction reads whole matches.
EMAIL_LOCAL = r"[a-zA-Z0-9._%+\-]"
EMAIL_HOST = r"[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"(?:\+?1?\s?)?(?:\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4})"
EMAIL_DENY = ["example.com", "test.com"]

# Parts of class names that mark the card of a person, and that mark the role in it.
CARD_CLASSES = [
    "team-member", "team_member", "teamMember", "team-card", "team_card", "teamCard", "person-card", "person_card", "personCard",
    "people-item", "people_item", "member-card", "member_item", "staff-card", "staff_item", "executive", "leadership", "our-team",
    "bio-card", "bio_card",
]
ROLE_CLASSES = ["role", "position", "job-title", "jobtitle", "designation"]

# Roles that mark a person in page markup.
MARKUP_ROLES = (
    "CEO|CTO|CFO|COO|CMO|CPO|CRO|Founder|Co-Founder|President|Chairman|Director|VP|Vice President"
    "|Managing Director|Chief Executive|Chief Technology|Chief Operating|Chief Financial"
    "|Chief Marketing|Chief Product|Chief Revenue|Chief Commercial|Chief People|Head of"
)

# Words never part of a personal name, for markup and for running text.
NOT_A_NAME_MARKUP = [
    "Rate", "Optimization", "Development", "Marketing", "Analytics", "Management", "Strategy",
    "Integration", "Technology", "Services", "Solutions", "Platform", "Software", "Commerce",
    "Intelligence", "Automation", "Operations", "Infrastructure", "Architecture", "Engineering",
    "Administration", "Testing", "Consulting", "Research", "Production", "Distribution",
    "Manufacturing", "Acquisition", "Implementation", "Transformation",
]
NOT_A_NAME_TEXT = [
    "Rate", "Optimization", "Development", "Marketing", "Analytics", "Management", "Strategy",
    "Integration", "Technology", "Services", "Solutions", "Platform", "Software", "Commerce",
    "Intelligence", "Automation", "Operations", "Engineering", "Administration", "Testing",
    "Consulting", "Research",
]

# Executive titles searched in text, in match order, and their short labels.
EXECUTIVE_TITLES = [
    "CEO", "Chief Executive Officer", "CTO", "Chief Technology Officer",
    "CFO", "Chief Financial Officer", "CMO", "Chief Marketing Officer",
    "COO", "Chief Operating Officer", "CRO", "Chief Revenue Officer",
    "CPO", "Chief Product Officer", "Founder", "Co-Founder", "Co-founder",
    "President", "Chairman", "Managing Director", "MD", "VP", "Vice President",
]
SHORT_TITLES = {
    "Chief Executive Officer": "CEO",
    "Chief Technology Officer": "CTO",
    "Chief Financial Officer": "CFO",
    "Chief Marketing Officer": "CMO",
    "Chief Operating Officer": "COO",
    "Chief Revenue Officer": "CRO",
    "Chief Product Officer": "CPO",
    "Managing Director": "MD",
    "Vice President": "VP",
}

# Openings that mark a slogan instead of a company name.
TAGLINE_STARTERS = (
    "from|helping|building|making|the place|grow|unlock|discover|transform|turning|powering"
    "|your|we |how |why |what "
)

# Service phrases, in report order.
SERVICE_TERMS = [
    "A/B Testing", "CRO", "Conversion Rate Optimization", "UX Design", "UX Research",
    "SEO", "SEM", "PPC", "Social Media", "Email Marketing", "Content Marketing",
    "Performance Marketing", "Growth Marketing", "Affiliate Marketing",
    "Web Development", "Mobile Development", "App Development", "API Development",
    "Cloud Services", "DevOps", "Cybersecurity", "Data Engineering",
    "Data Analytics", "Business Intelligence", "Machine Learning", "AI",
    "Automation", "Integration", "Data Science", "Computer Vision",
    "E-commerce", "Shopify", "WooCommerce", "Magento", "Marketplace",
    "Consulting", "Strategy", "Branding", "Design", "Logistics",
    "Manufacturing", "Distribution", "Wholesale", "Retail",
    "Streaming", "Video", "Podcast", "Media", "Publishing",
    "Insurance", "Lending", "Payments", "Banking", "Investing",
    "Recruitment", "HR", "Payroll", "Training", "Certification",
    "Healthcare", "Telemedicine", "Pharmacy", "Fitness", "Wellness",
    "Real Estate", "Property Management", "Mortgage",
    "Travel", "Hotels", "Flights", "Tours",
]

# Product category, first match wins, else the default.
PRODUCT_CATEGORIES = [
    (["cro", "conversion"], "CRO Tool"),
    (["analytics"], "Analytics"),
    (["email"], "Email Marketing"),
    (["social"], "Social Media"),
    (["ecommerce", "shopify"], "Ecommerce"),
]
DEFAULT_PRODUCT_CATEGORY = "Software"

# Location, rating and price formats.
LOCATION_PATTERNS = [
    r"(?:located|based|headquartered)\s+(?:in|at)\s+([A-Z][a-z]+(?:\s*,\s*[A-Z][a-z]+)?)",
    r"([A-Z][a-z]+(?:,\s*[A-Z]{2})?)\s+(?:office|headquarters|HQ)",
]
RATING_PATTERN = r"(\d+(?:\.\d+)?)\s*(?:/\s*5|stars?|rating)"
PRICE_PATTERNS = [
    r"\$(\d+(?:\.\d+)?)\s*(?:/\s*(?:month|mo|year|yr))?",
    r"(free|freemium|open source)",
    r"starting\s+(?:at|from)\s+\$(\d+)",
]

# Engagement signals on a company page.
ENGAGEMENT_PATTERNS = {
    "has_case_studies": r"case stud(?:y|ies)|client success|success stor(?:y|ies)",
    "has_team_page": r"our team|meet the team|our experts|our consultants|our specialists",
    "has_portfolio": r"our work|past projects|client work|portfolio",
    "has_testimonials": r"testimonial|what (?:our )?clients say|trusted by|clients include",
}

# Business-model signals, the short set and the profile set.
MATCHER_TOOL_SIGNALS = [
    r"free\s*trial", r"\$\d+\s*/\s*mo", r"pricing\s*plan", r"per\s*(?:user|seat|month)\b",
]
MATCHER_AGENCY = r"our\s+team|case\s+stud"
PROFILE_TOOL_SIGNALS = [
    r"free\s*trial", r"sign\s*up.*free", r"\$\d+\s*/\s*mo", r"pricing\s*plan",
    r"per\s*(?:user|seat|month)\b",
]
PROFILE_AGENCY_SIGNALS = [r"our\s+(?:team|clients|experts)", r"we\s+(?:help|work\s+with|partner)"]
PLATFORM_SIGNAL = r"marketplace|buy\s+and\s+sell"
BRAND_SIGNAL = r"shop\s*now|add\s*to\s*cart"

# Subpage choice, exact slugs, then looser words and the words that rule a path out.
ABOUT_SLUGS = [
    "/about-us", "/about_us", "/our-team", "/team/", "/who-we-are", "/leadership", "/management",
    "/people", "/company/about", "/about/",
]
ABOUT_WORDS = ["about", "team", "people"]
ABOUT_EXCLUDED = ["blog", "career", "job"]
SERVICE_SLUGS = [
    "/services", "/our-services", "/what-we-do", "/what-we-offer", "/solutions", "/capabilities",
    "/expertise", "/offerings", "/our-work", "/work", "/how-we-help",
]
SERVICE_WORDS = ["service", "solution", "capabilities", "what-we", "expertise"]
SERVICE_EXCLUDED = ["blog", "news", "case-stud", "career"]
