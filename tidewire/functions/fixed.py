"""Word lists, tables, patterns and limits that results depend on."""

from __future__ import annotations

# Title tokens for ranking.
TITLE_STOP = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "is", "of", "on", "or", "the", "to", "with", "after", "before", "new", "says", "say", "said"]

# Headline tokens for retrieval.
HEADLINE_STOP = [
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "by", "for", "from", "has", "have", "in", "into", "is", "it", "its", "of",
    "on", "or", "that", "the", "this", "to", "was", "were", "will", "with", "after", "before", "over", "under", "near", "about", "following",
]
HEADLINE_CANON = {
    "died": "death", "dies": "death", "dead": "death", "fatal": "death", "killed": "death", "kills": "death",
    "crashes": "crash", "crashed": "crash", "collision": "crash", "collisions": "crash", "wreck": "crash", "wrecks": "crash",
    "women": "woman", "men": "man",
    "charged": "charge", "charges": "charge", "charging": "charge", "arrested": "arrest", "arrests": "arrest",
    "approves": "approve", "approved": "approve", "approval": "approve", "votes": "vote", "voted": "vote", "voting": "vote",
    "resigned": "resign", "resigns": "resign", "resigning": "resign", "left": "leave", "leaves": "leave", "leaving": "leave",
    "rule": "regulation", "rules": "regulation", "law": "regulation", "laws": "regulation", "ordinance": "regulation", "ordinances": "regulation",
    "fishes": "fishing", "fished": "fishing",
    "move": "revise", "moves": "revise", "moved": "revise", "rewrite": "revise", "rewrites": "revise", "rewriting": "revise",
    "review": "revise", "reviews": "revise", "reviewed": "revise", "reviewing": "revise", "change": "revise", "changes": "revise",
    "changed": "revise", "changing": "revise", "revises": "revise", "revised": "revise", "revising": "revise",
    "commissioner": "commission", "commissioners": "commission",
}
CONTEXT_TOKENS = [
    "city", "county", "commission", "council", "board", "local", "state", "federal", "government", "official", "officials", "agency", "department",
    "revise", "propose", "approve", "vote", "says", "must",
    "according", "resident", "residents", "people", "news", "story", "report", "reported", "reporting", "said", "saying",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "today", "yesterday", "morning", "afternoon", "evening",
    "area", "community", "communities", "office", "authorities", "home", "homes", "nearby", "including", "also", "new",
    "update", "updates", "latest", "still", "first", "another", "several",
]
CONTENT_CHARS = 12_000

# Timeline title tokens and suffixes.
TIMELINE_STOP = [
    "a", "an", "and", "are", "as", "at", "be", "become", "before", "by", "could", "for", "from", "in", "including", "into", "is",
    "local", "man", "more", "new", "news", "of", "on", "out", "over", "said", "says", "that", "the", "than", "this", "to", "was", "were", "with", "woman",
]

# Archive signature tokens and shared legal words.
ARCHIVE_STOP = [
    "the", "a", "an", "in", "of", "for", "to", "and", "or", "on", "at", "is", "was", "are", "were", "that", "this", "with", "from", "have",
    "been", "after", "over", "into", "says", "said", "will", "than", "more", "also", "when", "s", "us", "u", "news", "report", "reports", "new",
    "latest", "update", "updates",
]
LEGAL_FRAME = [
    "supreme", "court", "federal", "appeals", "appeal", "judges", "declines", "declined", "hear", "hearing", "rules", "ruled",
    "ruling", "rulings", "allows", "allowed", "leaving", "lower", "intact", "challenge", "challenging", "lawsuit", "case",
]

# Source title tokens.
SOURCE_TITLE_NOISE = [
    "the", "and", "for", "with", "from", "after", "before", "into", "over", "this", "that", "today", "friday", "saturday", "sunday", "monday",
    "tuesday", "wednesday", "thursday", "news", "report", "reports", "update", "updates", "live", "com",
]

# Focus tokens.
FOCUS_STOP = [
    "about", "after", "before", "from", "into", "with", "without", "that", "this", "their", "there", "would", "could", "should", "news",
    "report", "reports", "says", "said", "update", "latest", "today",
]

# Resolver tokens.
RESOLVER_STOP = ["the", "and", "for", "with", "from", "after", "before", "into", "county", "news", "update", "says", "said"]

# States and signals of national relevance.
STATES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho",
    "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota",
    "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york",
    "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota",
    "tennessee", "texas", "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming", "district of columbia",
    "washington dc", "washington d.c.",
]
FEDERAL_SIGNALS = [
    "white house", "congress", "senate", "house of representatives", "supreme court", "justice department", "department of justice",
    "pentagon", "department of defense", "state department", "treasury", "federal reserve", "cdc", "fda", "epa", "fbi", "nasa", "noaa",
    "federal government", "u.s. government", "us government", "united states", "u.s.", " us ",
]
GLOBAL_SIGNALS = [
    "war", "invasion", "ceasefire", "missile", "nuclear", "hostage", "earthquake", "tsunami", "hurricane", "mass casualty", "pandemic",
    "global markets", "oil prices", "trade war", "sanctions",
]
FOREIGN_SIGNALS = [
    "ukraine", "russia", "china", "taiwan", "israel", "gaza", "iran", "european union", "united kingdom", "france", "germany", "india",
    "japan", "south korea", "north korea", "mexico", "canada", "brazil", "australia", "africa", "middle east", "europe", "asia",
]
SCOPE_SCORE = {"us_national": 100, "us_multistate": 95, "us_state_regional": 82, "global_major": 88, "international": 72, "unknown": 60}

# Importance rules (code, points, phrases).
IMPORTANCE = [
    ("federal_action", 32, ["white house", "congress", "senate", "house of representatives", "supreme court", "executive order", "federal reserve", "justice department", "department of justice", "pentagon", "state department", "federal law", "national security", "impeachment", "government shutdown"]),
    ("election", 25, ["election", "primary", "ballot", "presidential", "senate race", "house race", "governor", "electoral", "campaign"]),
    ("macroeconomy", 28, ["inflation", "interest rate", "federal reserve", "jobs report", "unemployment", "recession", "tariff", "trade war", "oil prices", "stock market", "dow jones", "s&p 500", "nasdaq", "gdp"]),
    ("war_diplomacy", 30, ["war", "invasion", "airstrike", "missile", "ceasefire", "hostage", "sanctions", "nuclear", "peace talks", "treaty", "military action"]),
    ("major_disaster", 30, ["hurricane", "tornado", "earthquake", "tsunami", "wildfire", "flash flood", "evacuation order", "state of emergency", "pandemic"]),
    ("business_tech", 18, ["merger", "acquisition", "bankruptcy", "recall", "data breach", "cyberattack", "antitrust", "layoffs", "artificial intelligence", "semiconductor", "fda approval"]),
    ("court_action", 15, ["indicted", "convicted", "sentenced", "supreme court", "appeals court", "lawsuit", "verdict", "pleaded guilty", "pleads guilty"]),
    ("public_safety", 10, ["shooting", "stabbing", "fire", "crash", "collision", "explosion", "missing person", "amber alert", "hazmat", "armed suspect", "lockdown"]),
    ("cultural_sports", 12, ["super bowl", "world series", "nba finals", "stanley cup", "national championship", "academy awards", "oscars", "grammys"]),
]
FATALITY_PATTERNS = [
    r"\b(\d{1,5})\s+(?:people\s+)?(?:killed|dead|deaths|fatalities)\b",
    r"\bdeath toll(?:\s+(?:at|of|reaches|rose to))?\s+(\d{1,5})\b",
]
DEATH_PATTERN = r"\b(?:killed|dead|dies|died|death|fatality)\b"
FATALITY_POINTS = [(50, "mass_casualty", 45), (10, "multi_fatality", 30), (2, "multiple_deaths", 18)]
LEVELS = [(80, "breaking"), (55, "high"), (25, "normal")]

# Event types by pattern, in order.
EVENT_PATTERNS = [
    ("election", r"\b(?:election|primary|runoff|ballot|polls?)\b"),
    ("legislation", r"\b(?:bill|legislation|law|act)\b.{0,80}\b(?:passes|passed|signed|approved|vetoed|blocked)\b|\b(?:passes|passed|signed|approved|vetoed|blocked)\b.{0,80}\b(?:bill|legislation|law|act)\b"),
    ("court ruling", r"\b(?:supreme court|appeals court|judge|court)\b.{0,80}\b(?:rules|ruled|blocks|blocked|upholds|strikes down|orders)\b"),
    ("war or military action", r"\b(?:war|invasion|airstrike|air strike|missile strike|military strike|ceasefire)\b"),
    ("cybersecurity incident", r"\b(?:cyberattack|cyber attack|data breach|ransomware|hack(?:ed|ing)?)\b"),
    ("business transaction", r"\b(?:merger|acquisition|acquires|acquired|buyout|bankruptcy)\b"),
    ("labor action", r"\b(?:strike|walkout|union vote|collective bargaining)\b"),
    ("shooting", r"\b(?:shooting|shot|gunfire)\b"),
    ("traffic crash", r"\b(?:crash|collision|wreck)\b"),
    ("fire", r"\b(?:fire|blaze|wildfire|arson)\b"),
    ("natural disaster", r"\b(?:hurricane|tornado|earthquake|tsunami|flood|wildfire)\b"),
    ("arrest", r"\b(?:arrested|arrest|charged|indicted)\b"),
    ("death", r"\b(?:killed|dead|dies|died|death)\b"),
]
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
SPARSE_EVENTS = ["traffic-crash", "fire", "missing-person"]

# Refusal patterns and word minima of publication quality.
REFUSAL = (
    r"\bi appreciate you sharing this task\b|\bi (?:don.t|do not) have access to (?:the )?(?:actual )?(?:content|source|article)\b|"
    r"\bi (?:can.t|cannot) (?:responsibly )?rewrite\b|\bcould you (?:please )?(?:share|provide) (?:the )?(?:source|full text|article|material)\b|"
    r"\byou.ve only provided the headlines\b|\bas an ai(?: language model)?\b|\bi would need you to provide (?:the )?(?:full text|source|article)\b"
)
#: Each phrase of REFUSAL holds one of these.
REFUSAL_NEEDS = ["i appreciate you sharing this task", "have access to ", "rewrite", "could you ", "only provided the headlines", "as an ai", "i would need you to provide "]
HERO_WORDS, CARD_WORDS, CARD_MOST_WORDS, SOURCE_WORDS, FULL_SOURCE_WORDS, BRIEF_WORDS = 120, 60, 140, 80, 140, 40
# Noise of summaries, words of absence, greetings.
SUMMARY_NOISE = [
    r"(?i)read more.*$", r"(?i)click here.*$", r"(?i)continue reading.*$", r"(?i)\[\+\d+ chars\].*$", r"(?i)^by [A-Z][a-z]+ [A-Z][a-z]+", r"(?i)related articles?:.*$", r"(?i)also read:.*$",
    r"(?i)share this:.*$", r"(?i)follow us.*$", r"&amp;|&lt;|&gt;|&quot;|&#\d+;",
]
#: All noise but bylines holds one of these, in any case.
SUMMARY_NEEDS = ["read more", "click here", "continue reading", " chars]", "related article", "also read:", "share this:", "follow us", "&"]
ABSENCE = [
    "no information was", "no details were", "no details have", "details were not", "details have not", "details are not", "has not been confirmed", "have not been confirmed",
    "was not disclosed", "were not disclosed", "it remains unclear", "it is unclear", "remains unknown", "officials have not", "has not responded", "did not respond",
    "not immediately available", "not yet available", "could not be reached", "could not be confirmed", "no official statement", "no statement has", "reporting is ongoing", "investigation is ongoing",
]
GREETINGS = ["good morning.", "good afternoon.", "good evening.", "good morning,", "good afternoon,", "good evening,"]

# Blocks and sentences of a page that are no article text, and the most words that are kept.
LD_JSON = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
ARTICLE, PARAGRAPH = r"(?is)<article[^>]*>(.*?)</article>", r"(?is)<p[^>]*>(.*?)</p>"
PAGE_JUNK = ["subscribe", "sign up", "cookie", "advertisement", "all rights reserved", "privacy policy", "newsletter", "download our app", "manage preferences"]
ARTICLE_MOST_WORDS = 2500
MEASURES = r"\b(?:amendment|proposition|measure|resolution|ordinance|referendum|initiative|house bill|senate bill|bill)\s+(?:no\.?\s*)?[a-z0-9-]+\b"

# URL keys, feed paths and source types.
CACHE_TRACKING = ["gclid", "fbclid", "mc_cid", "mc_eid", "ocid", "cmpid", "ref", "ref_src"]
IDENTITY_TRACKING = ["oc", "output", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term", "fbclid", "gclid", "mc_cid", "mc_eid"]
RANKING_TRACKING = ["oc", "gclid", "fbclid"]
FEED_SEGMENTS = ["feed", "feeds", "rss"]
FEED_FILE = r"\.(?:rss|xml|atom)/?$"
DISCOVERY_DOMAINS = ["nytimes.com", "washingtonpost.com", "wsj.com", "bloomberg.com", "businessinsider.com", "theinformation.com", "ft.com"]
AGGREGATOR = "news.google.com"

# Cache limits by bucket, newest kept.
CACHE_LIMITS = {"source_text": 500, "source_resolutions": 700, "classifications": 2500, "categories": 140, "guardian_text": 400, "semantic_gate": 600, "pre_generation_materiality": 900, "material_updates": 300}

# Ranking windows, category relevance and transient phrases.
CATEGORIES = ["world", "us", "business", "tech", "sports", "entertainment", "politics"]
CATEGORY_RELEVANCE = {"us": 100, "politics": 100, "business": 92, "tech": 90, "world": 82, "sports": 78, "entertainment": 76}
OTHER_RELEVANCE = 80
DECK, FRESH_HOURS, EXTENDED_HOURS, TRANSIENT_HOURS, SPORTS_HOURS, EXTENDED_URGENCY = 12, 48.0, 60.0, 24.0, 24.0, 8
TRANSIENT = [
    "flood advisory", "flood warning", "weather advisory", "tornado warning", "severe thunderstorm warning", "closed in both directions", "road closed",
    "road closure", "lane closure", "bridge closure", "boil water notice",
]

# Lifecycle phrases.
RESOLUTION = [
    "all clear", "fully contained", "100% contained", "road reopened", "lanes reopened", "bridge reopened", "evacuation lifted", "evacuations lifted",
    "warning lifted", "alert canceled", "alert cancelled", "found safe", "located safe", "missing person found", "search ended", "case closed",
]

# Image checks.
PLACEHOLDERS = [
    "1x1", "pixel", "spacer", "tracking", "transparent", "placeholder", "default-image", "default_image", "news-slate", "site-logo", "station-logo",
    "publisher-logo", "masthead-logo", "brand-logo", "brandmark", "favicon", "apple-touch-icon", "logo-square", "logo-horizontal", "social-logo",
    "generic-share", "og-image.png", "top_image", "brand-icons", "avatar-default", "noimage", "no-image", "missing-image",
]
LOGO_WORDS = ["logo", "icon", "brand", "masthead", "publisher", "station"]
BRAND_PATH = r"/(?:logo|logos|brand|branding|assets/logo)(?:[._/-]|$)"
IMAGE_STOP = [
    "the", "a", "an", "in", "on", "at", "to", "for", "of", "and", "or", "is", "are", "was", "were", "with", "its", "by", "as", "from", "that", "this",
    "after", "over", "into", "about", "amid", "during", "says", "say", "new", "latest", "update",
]

# Event families of timeline titles, in order.
FAMILIES = [
    ("road_rage", r"\broad rage\b|\b(?:pit|police) maneuver\b|\b(?:run|running|chased|forced) .{0,45} off (?:the )?road\b"),
    ("wildfire_arson", r"\bwildfire\b|\bbrush fire\b.{0,45}\b(?:arson|set|setting|charged)\b|\b(?:arson|set|setting)\b.{0,45}\b(?:wildfire|brush fire)\b"),
    ("execution", r"\b(?:execution|executions|executes|executed|death row)\b|\bputs? .{0,30} to death\b"),
    ("hazing", r"\bhazing\b"),
    ("government_finance", r"\b(?:property tax|tax reform|millage|budget|job cuts?|police positions?)\b"),
    ("dui", r"\b(?:dui|driving under the influence)\b"),
    ("traffic_crash", r"\b(?:crash|collision|wreck|semi truck|vehicle)\b"),
    ("shooting", r"\b(?:shooting|shot|gunfire)\b"),
    ("death", r"\b(?:killed|dead|dies|died|death|murder)\b"),
    ("fire", r"\b(?:fire|blaze)\b"),
]

# Tokens of update composition.
UPDATE_STOP = [
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "by", "for", "from", "has", "have", "in", "into", "is", "it", "its", "of",
    "on", "or", "that", "the", "this", "to", "was", "were", "will", "with", "after", "before", "about", "over", "under", "near", "said", "says",
    "news", "update", "officials",
]
UPDATE_CANON = {
    "directed": "directive", "directs": "directive", "direction": "directive", "directions": "directive", "aligned": "align", "aligning": "align",
    "alignment": "align", "recovered": "recover", "recovery": "recover", "recovering": "recover", "found": "find", "finding": "find",
    "receives": "receive", "received": "receive", "receiving": "receive",
}

# Terms of hard rejections and tokens of backfill.
HARD_REJECTIONS = [
    "duplicate", "same event", "same story", "off-category", "off category", "wrong category", "category misfit", "listicle", "promotional", "promotion",
    "advertorial", "opinion-only", "opinion only", "stale", "discovery-only", "discovery only", "too thin", "unsafe", "non-news",
]
BACKFILL_STOP = ["the", "and", "for", "with", "from", "after", "before", "into", "over", "this", "that", "news", "says", "said", "new", "latest", "update"]

# Front-page patterns.
TIER = {
    "sports": r"\b(?:grand prix|formula 1|formula one|premier league|nba|nfl|mlb|nhl|ncaa|football game|basketball game|tennis match|world cup qualifier|playoff game|golf tournament|world series game|championship bout|boxing match|soccer match|motorsport race)\b",
    "entertainment": r"\b(?:box office|opening weekend|film festival|movie premiere|album release|grammy awards|reality television|celebrity wedding)\b",
    "government": r"\b(?:president|white house|congress|senate|house|supreme court|federal court|federal reserve|fed|pentagon|justice department|state department|treasury|administration|trump|u\.s\.|us)\b.{0,90}\b(?:overturns?|strikes down|blocks?|orders?|allows?|upholds?|permits?|authorizes?|reinstates?|invalidates?|signs?|passes?|approves?|vetoes?|halts?|suspends?|announces?|launches?|replaces?|fires?|resigns?|cuts?|raises?|sanctions?|deploys?|attacks?|releases?|declares?|shuts? down|agrees?|votes?)\b",
    "government_reverse": r"\b(?:overturns?|strikes down|blocks?|signs?|passes?|allows?|upholds?|permits?|authorizes?|reinstates?|invalidates?|approves?|vetoes?|halts?|orders?|cuts?|raises?|announces?|replaces?|launches?)\b.{0,75}\b(?:supreme court|congress|senate|white house|president|federal reserve|trump|federal government)\b",
    "war": r"\b(?:strikes?|airstrikes?|invades?|invaded|launches? missiles?|missile strikes?|deploys? troops?|ceasefire|peace deal|peace agreement|signs? treaty|sanctions?|attacks? (?:nato|us|u\.s\.|military|ukraine|russia|iran|israel)|nuclear deal|nuclear strike|war begins|war ends|military offensive|drone strikes?|drones? (?:hit|strike|attack)|launches? \d+ drones?|drone attacks?|major offensive|bombards?|shells? (?:capital|city))\b",
    "economy": r"\b(?:federal reserve|fed|interest rates?|inflation|jobs report|unemployment|recession|tariffs?|national economy|stock market|banking crisis|markets? crash|government shutdown)\b",
    "security": r"\b(?:terrorist attack|terror attack|national security|critical infrastructure|cyberattack|data breach|nationwide outage|mass shooting|federal emergency|major hurricane|earthquake|tsunami)\b",
    "analysis": r"\b(?:declines? to rule out|refuses? to rule out|won't rule out|will not rule out|would not rule out|has not ruled out|not ruling out|could|might|may|opinion|analysis|commentary|expert says|experts say|warns?|predicts?|enabling|what to know|how (?:to|the)|future of|raises questions|explainer)\b",
    "foreign_crisis": r"\b(?:president|prime minister|parliament|government|military junta|opposition leader)\b.{0,80}\b(?:impeached|ousted|overthrown|arrested|collapses?|resigns?|coup|dissolved)\b",
    "election": r"\b(?:senate race|presidential election|electoral votes?|congressional election|national election|wins? (?:the )?presidency|enters? (?:the )?senate race)\b",
    "us_forces": r"\b(?:nato|u\.s\.|us military|united states|american forces)\b",
    "wide": r"\b(?:nationwide|national|mass|major|multiple states)\b",
    "politics": r"\b(?:election|vote|appoint|senator|cabinet|congress|senate|governor)\b",
    "one_firm": r"\b(?:chip sales?|nvidia|tesla|apple|google|microsoft|company|startup|export license|single firm)\b",
    "broad": r"\b(?:nationwide|industrywide|across the (?:industry|sector)|all (?:banks|exchanges|platforms|companies|financial institutions)|new federal law|economy.wide)\b",
}
#: Court rulings; what rules out something isn't one.
TIER_COURT = r"\b(?:supreme court|federal court|appeals court)\b.{0,90}\b(?:rules?|ruled)\b(?!\s+out\b)|\b(?:rules?|ruled)\b(?!\s+out\b).{0,75}\b(?:supreme court|federal court|appeals court)\b"
BLOCKED_CATEGORIES = ["sports", "entertainment"]

# Places a headline names and the words that ground them, and section misfits.
PLACES = {
    "krakow": ["krakow", "poland"], "poland": ["poland", "krakow"], "israel": ["israel"], "gaza": ["gaza"], "louisiana": ["louisiana"], "wisconsin": ["wisconsin"],
    "moscow": ["moscow", "russia"], "russia": ["russia", "moscow"], "ukraine": ["ukraine"], "paraguay": ["paraguay"], "iran": ["iran"], "china": ["china"],
    "texas": ["texas"], "florida": ["florida"], "japan": ["japan"], "india": ["india"], "taiwan": ["taiwan"], "korea": ["korea"], "germany": ["germany"],
    "france": ["france"], "brazil": ["brazil"], "canada": ["canada"], "mexico": ["mexico"], "london": ["london", "england", "britain", "uk"],
    "manchester": ["manchester", "england", "britain", "uk"], "britain": ["britain", "uk", "british"], "afghanistan": ["afghanistan"], "syria": ["syria"],
}
DOMESTIC_PLACES = ["louisiana", "wisconsin", "texas", "florida"]
GROUNDING_CHARS = 1800
US_ACTION = r"\b(?:u\.s\.|united states|american|pentagon|white house|state department|us military|us president|washington dc|u\.s\. citizens?|u\.s\. troops?)\b"
POLITICS_EVENT = r"\b(?:senate race|presidential (?:race|campaign)|runs? for (?:senate|governor|congress|president)|enters? (?:the )?(?:senate|presidential) race|attorney general .*?election|campaigns? for (?:senate|office)|wins? (?:the )?(?:senate|gubernatorial) primary)\b"
SPORTS_EVENT = r"\b(?:grand prix|formula 1|formula one|ncaa|nba finals|nfl|mlb|nhl|premier league|college football|football game|soccer match|tennis match|boxing match|world cup qualifier)\b"

# Follow-up milestones by token.
MILESTONES = {
    "arrest": ["arrest", "arrested", "charge", "charged", "charges"], "identified": ["identified", "named", "identity"], "death": ["dies", "died", "dead", "killed", "death"],
    "sentencing": ["sentenced", "sentence", "sentencing"], "court_action": ["trial", "hearing", "lawsuit", "sues", "sued", "indicted"],
    "investigation": ["investigation", "reopen", "reopens", "reopened"], "recovery": ["recovered", "found", "located", "rescued", "reunited"],
    "release": ["released", "discharged", "returns", "returned"], "resolution": ["contained", "resolved", "cleared", "reopened"],
}

# Publisher names after a headline.
PUBLISHER_ENDINGS = ["news", "network", "post", "press", "record", "sentinel", "times", "tribune", "journal", "herald", "observer", "courier", "living"]
PUBLISHERS = [
    "ap", "associated press", "reuters", "npr", "bbc", "cnn", "cbs news", "abc news", "nbc news", "fox news", "axios", "politico", "the hill",
    "the guardian", "new york times", "washington post", "wall street journal", "yahoo", "aol", "msn", "espn", "variety", "rolling stone",
]

# The section words of image matching and the generic words of source focus.
CATEGORY_WORDS = {
    "world": ["world", "war", "military", "foreign", "international", "gaza", "ukraine", "russia", "china", "iran", "israel", "europe"],
    "us": ["america", "american", "u.s", "us", "state", "federal", "nation", "court", "police", "weather", "storm"],
    "politics": ["trump", "congress", "senate", "house", "white", "president", "election", "campaign", "federal", "administration"],
    "business": ["business", "market", "stock", "company", "economy", "bank", "fed", "jobs", "trade", "tariff", "earnings"],
    "tech": ["technology", "tech", "science", "ai", "software", "chip", "space", "nasa", "apple", "google", "microsoft", "meta"],
    "sports": ["sports", "game", "team", "league", "nba", "nfl", "mlb", "nhl", "soccer", "football", "baseball", "basketball", "tennis"],
    "entertainment": ["movie", "film", "music", "tv", "television", "actor", "actress", "singer", "celebrity", "hollywood", "netflix"],
}
FOCUS_GENERIC = ["after", "before", "following", "from", "into", "with", "without", "state", "location", "news", "says", "said", "report", "reports", "update", "latest"]

# Production routes, repairable quality reasons, corroboration and pair identity tokens, fresh words.
ROUTES = {"publish_new": "generate_new", "update_existing": "update_existing", "replace_canonical": "replace_canonical", "ignore": "skip"}
REPAIRABLE = [
    "weak_or_missing_headline", "lead_too_thin", "headline_money_claim_missing_from_lead", "headline_percentage_claim_missing_from_lead", "headline_jurisdiction_missing_from_lead",
    "headline_named_measure_missing_from_lead", "headline_entity_missing_from_lead", "person_first_reference_not_full_name", "original_event_context_missing",
    "new_development_missing", "insufficient_article_structure", "card_requires_two_paragraph_summary", "card_body_over_140_words",
]
CORROBORATION_STOP = ["this", "that", "from", "with", "over", "after", "before", "says", "said", "news", "report", "update", "today", "enters", "could", "would"]
COURT_FRAME = [
    "supreme", "court", "federal", "judges", "declines", "declined", "hear", "hearing", "appeals", "appeal", "ruling", "rulings",
    "allows", "allowed", "leaving", "lower", "intact", "challenge", "challenging", "case", "lawsuit",
]
PAIR_STOP = ["a", "an", "and", "at", "by", "for", "from", "in", "into", "is", "of", "on", "the", "to", "with"]
FRESH_WORDS = [
    "confirms", "confirmed", "announces", "announced", "charges", "charged", "arrested", "arrest", "resigns", "resigned", "fired", "breaks", "exclusive",
    "new details", "emerges", "emerged", "discovered", "uncovers", "uncovered", "identified", "named", "ruled", "plot", "conspiracy", "indicted", "sentenced",
    "found guilty", "linked", "motive", "cause of death",
]

# Path words of sources whose address stays while their story changes.
ROLLING_PATHS = ["weather", "forecast", "radar", "traffic", "live", "livestream", "updates", "update", "blog", "alerts", "alert"]

#: National agencies and the patterns that name them; acronyms count in capitals only.
AGENCIES = [
    ("U.S. Department of Justice", r"(?i)\b(?:u\.?s\.?\s+)?department of justice\b|\bjustice department\b"),
    ("FBI", r"\bfederal bureau of investigation\b|\bFBI\b"),
    ("U.S. Department of Defense", r"(?i)\bdepartment of defense\b|\bPentagon\b"),
    ("U.S. Department of State", r"(?i)\bdepartment of state\b|\bState Department\b"),
    ("U.S. Department of the Treasury", r"(?i)\bdepartment of the treasury\b|\bTreasury Department\b"),
    ("Federal Reserve", r"\bfederal reserve\b|\bFed\b"),
    ("CDC", r"\bcenters for disease control(?: and prevention)?\b|\bCDC\b"),
    ("FDA", r"\bfood and drug administration\b|\bFDA\b"),
    ("EPA", r"\benvironmental protection agency\b|\bEPA\b"),
    ("NASA", r"\bnational aeronautics and space administration\b|\bNASA\b"),
    ("NOAA", r"\bnational oceanic and atmospheric administration\b|\bNOAA\b"),
    ("U.S. Supreme Court", r"(?i)\bsupreme court\b"),
    ("White House", r"(?i)\bwhite house\b"),
    ("U.S. Senate", r"\bu\.?s\.? senate\b|\bSenate\b"),
    ("U.S. House of Representatives", r"(?i)\bu\.?s\.? house(?: of representatives)?\b|\bHouse of Representatives\b"),
]
PROPER_NAME = r"\b[A-Z][A-Za-z0-9&.'’/-]+(?:\s+(?:of|the|and|for|[A-Z][A-Za-z0-9&.'’/-]+)){1,5}\b"

# Fixed values of unified incident evidence: stop words, generic words, families and concepts by pattern, names.
EVIDENCE_STOP = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "local", "man", "new", "news", "of", "on", "or",
    "said", "says", "the", "this", "to", "was", "were", "with", "woman", "state", "county", "after", "near", "used", "police", "accused",
]
EVIDENCE_GENERIC = [
    "arrest", "arrested", "charge", "charged", "crash", "family", "incident", "road", "vehicle", "vehicles", "fire", "death", "killed", "dead",
    "shooting", "shot", "officials", "investigation", "report", "reported", "murder", "suicide", "domestic", "related", "victim", "suspect",
    "identified", "identify", "identifies", "dies", "died", "fatal", "collision", "wreck", "driver", "rider", "person", "people",
]
EVIDENCE_FAMILIES = [
    ("road_rage", r"\broad rage\b|\b(?:pit|police) maneuver\b|\brun(?:ning)? .{0,45} off (?:the )?road\b|\bchased? off (?:the )?road\b"),
    ("wildfire_arson", r"\bwildfire\b|\bbrush fire\b.{0,45}\b(?:arson|set|setting|charged)\b|\b(?:arson|set|setting)\b.{0,45}\b(?:wildfire|brush fire)\b"),
    ("animal_cruelty", r"\banimal cruelty\b|\b(?:dog|cat|animal|pet)\b.{0,55}\b(?:kicked|kicking|abused|abusing|beaten|beating|cruelty)\b|\b(?:kicked|kicking|abused|abusing|beaten|beating|cruelty)\b.{0,55}\b(?:dog|cat|animal|pet)\b"),
    ("animal_rescue", r"\b(?:cat|cats|dog|dogs|animal|animals|hamster|pets?)\b.{0,45}\b(?:rescue|rescued|saved)\b|\b(?:rescue|rescued|saved)\b.{0,45}\b(?:cat|cats|dog|dogs|animal|animals|hamster|pets?)\b"),
    (
        "missing_person",
        r"\b(?:missing|reported missing|went missing|last seen)\b.{0,90}\b(?:person|child|boy|girl|teen|teenager|man|woman|student)\b"
        r"|\b(?:help|search|seek|seeking|find|finding|locate|locating)\b.{0,75}\b(?:missing|last seen|autistic|teen|boy|girl|child)\b"
        r"|\b(?:person|child|boy|girl|teen|teenager|man|woman|student)\b.{0,75}\b(?:missing|last seen|reported missing|went missing)\b"
        r"|\b(?:search(?:ing)? for|locat(?:e|ing))\b.{0,120}\b(?:disappeared|disappearance|has not been heard from|family has not heard)\b",
    ),
    ("traffic_crash", r"\b(?:crash|collision|wreck|vehicle overturned|hit and run)\b"),
    ("murder_suicide", r"\bmurder[- ]suicide\b|\bdomestic[- ]related\b.{0,45}\b(?:two|2) dead\b"),
    ("shooting", r"\b(?:shooting|shot|gunfire)\b"),
    ("government_finance", r"\b(?:property tax|tax reform|millage|budget|job cuts?)\b"),
    ("dui", r"\b(?:dui|driving under the influence)\b"),
    ("fire", r"\b(?:fire|blaze)\b"),
    ("death", r"\b(?:killed|dead|dies|died|death|murder)\b"),
]
CONCEPTS = [
    ("pit_maneuver", r"\b(?:pit|police) maneuver\b"),
    ("forced_off_road", r"\b(?:run|running|ran|chased|forced|sent|sends|crash(?:ed|es)?)\b.{0,60}\b(?:off (?:the )?road|into (?:a )?(?:barbed wire )?fence)\b|\bvehicle.{0,50}\bfence\b|\bsuv.{0,50}\bfence\b"),
    ("family_victim", r"\bfamily(?:'s)?\b"),
    ("fence_collision", r"\bbarbed wire fence\b|\binto (?:a )?fence\b|\bsuv.{0,35}\bfence\b"),
    ("i95", r"\bi\s*95\b|\binterstate 95\b"),
    ("fourth_arrest", r"\b(?:4th|fourth) arrest\b|\b4 (?:people )?arrested\b"),
    ("missing_person_signal", r"\b(?:missing|reported missing|went missing|last seen|disappeared|disappearance)\b|\b(?:help|search|seek|seeking|find|finding|locate|locating|searching for)\b.{0,75}\b(?:person|child|boy|girl|teen|teenager|man|woman|student|autistic|disappeared)\b"),
    ("last_seen", r"\blast seen\b"),
    ("public_search", r"\b(?:help|search|seek|seeking|find|finding|locate|locating|looking)\b"),
    ("autistic_subject", r"\bautistic\b|\bautism\b"),
    ("minor_subject", r"\b(?:child|boy|girl|teen|teenager|juvenile|minor)\b|\b\d{1,2}\s+year\s+old\b"),
    ("animal_cruelty", r"\banimal cruelty\b"),
    ("small_dog", r"\bsmall dog\b|\blittle dog\b"),
    ("social_media_video", r"\bsocial media (?:video|clip|post)\b|\bviral video\b"),
    ("kicking_dog", r"\b(?:kick|kicked|kicking)\b.{0,28}\b(?:dog|pet)\b|\b(?:dog|pet)\b.{0,28}\b(?:kick|kicked|kicking)\b"),
    ("pool_scene", r"\b(?:pool|swimming pool)\b"),
]
AGE_BY_YEARS, AGE_BY_NAME = r"\b(\d{1,2})\s+year\s+old\b", r"\b[A-Z][A-Za-z'.-]+(?:\s+[A-Z][A-Za-z'.-]+){1,2},\s*(\d{1,2})(?:,|\s)"
BONDS = [r"(?i)\$\s*([0-9][0-9,]{2,})\s+(?:bond|bail)", r"(?i)\b(?:bond|bail)(?:\s+(?:was|is|set|amount|at))*\s*\$\s*([0-9][0-9,]{2,})"]
_PERSON = r"[A-Z][a-z]+(?:\s+(?:[A-Z]\.?|[A-Z][a-z]+)){1,2}"
PEOPLE = [
    rf"\b({_PERSON})(?:,?\s+(?:age\s+)?\d{{1,3}}\b|\s+(?:was\s+)?(?:arrested|charged|identified|killed)\b)",
    rf"\b\d{{1,3}}[- ]year[- ]old\s+({_PERSON})\b",
    rf"\b({_PERSON}),\s+(?:an?\s+|the\s+)?\d{{1,3}}[- ]year[- ]old\b",
    rf"\b(?:find|finding|locate|locating|search(?:ing)? for|looking for)\s+({_PERSON})\b",
    rf"\b({_PERSON})\b[^.!?]{{0,65}}\b(?:reported missing|went missing|is missing|was missing|last seen|found safe|located safe)\b",
]
NOT_PEOPLE = ["united states", "white house", "supreme court", "federal reserve", "new york", "los angeles", "washington dc", "washington d c", "justice department", "state department", "department of justice"]
NOT_PEOPLE_WORDS = ["county", "sheriff", "police", "office", "facility", "living"]
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]
CRUELTY_CORE = ["animal_cruelty", "small_dog", "social_media_video", "kicking_dog", "pool_scene"]
GENERAL_FAMILIES = ["traffic_crash", "shooting", "murder_suicide", "animal_rescue", "animal_cruelty", "dui", "wildfire_arson", "missing_person"]

# Fixed values of incident signatures: contexts, names, assets, animals.
DEATH_CONTEXT = r"(?i)\b(?:dies?|died|dead|death|deceased|killed|murdered|suicide|fatal(?:ity)?|passes? away|passed away|mourns?|mourning|memorial|tribute|funeral|celebration of life|loss of|remember(?:ed|ing)?|honor(?:s|ed|ing)? (?:the )?life)\b"
FULL_NAME = r"\b([A-Z][A-Za-z'’-]{1,30}(?:\s+[A-Z][A-Za-z'’-]{1,30}){1,2})\b"
STOP_NAMES = ["United States", "White House", "Supreme Court", "Federal Reserve", "New York", "Los Angeles", "Washington DC", "Washington D.C.", "Department Justice", "State Department", "Justice Department"]
NAME_ROLES = ["firefighter", "paramedic", "officer", "deputy", "chief", "captain", "detective", "teacher", "coach", "doctor", "dr", "senator", "mayor"]
NAME_REJECTS = [
    "county", "city", "department", "office", "commission", "board", "district", "rescue", "police", "sheriff", "school", "university",
    "hospital", "association", "foundation", "authority", "council", "administration", "government", "news", "daily", "times", "post",
    "network", "fire", "paramedic", "firefighter", "dies", "died", "death", "mourns", "mourn", "following", "personal", "tragedy", "officials",
    "service", "resident", "who", "began", "his", "her", "career", "here", "after", "daily", "times", "post", "press", "media",
]
#: Around a name, which is written as ¤: points for its being the one who died, or a source.
NAME_POINTS = [
    (5.0, [r"(?i)(?:firefighter|paramedic|officer|deputy|teacher|coach|doctor|chief|captain)[/\s]+¤"]),
    (5.0, [r"(?i)¤[^.!?]{0,45}\b(?:dies?|died|death|dead|killed|suicide|passed away|mourned|remembered)\b", r"(?i)\b(?:death|loss|mourning|mourns?|memorial|tribute)\b[^.!?]{0,55}¤"]),
    (-7.0, [r"(?i)¤\s+(?:said|says|told|wrote|added|called|announced|explained)\b"]),
    (-6.0, [r"(?i)(?:spokes(?:man|woman|person)|administrator|commissioner|chairman|mayor|chief|sheriff|detective|attorney)\s+¤"]),
]
MISSING_CONTEXT = r"(?i)\b(?:missing|reported missing|went missing|last seen|disappeared|disappearance|search(?:es|ed|ing)? for|seek(?:s|ing)?|locat(?:e|ing)|looking for|help find)\b"
_SUBJECT = r"[A-Z][A-Za-z'’\-]*(?:\s+[A-Z][A-Za-z'’\-]*){1,3}"
MISSING_SUBJECTS = [
    rf"\b(?:find|finding|locate|locating|search(?:es|ed|ing)? for|looking for|seek(?:s|ing)?|help find)\s+(?:an?\s+|the\s+)?({_SUBJECT})\b",
    rf"\b({_SUBJECT})\b[^.!?]{{0,80}}\b(?:reported missing|went missing|is missing|was missing|last seen|disappeared)\b",
    rf"\b({_SUBJECT})(?:,?\s+who\s+)?(?:\s+was)?\s+(?:visiting|visited|went to|had gone to|left for|headed to|traveled to|travelled to|drove to|walked to)\b",
]
MISSING_NOT_WORDS = ["county", "sheriff", "police", "office", "department", "beach", "island", "park", "city", "school", "hospital", "highway", "road", "street"]
MISSING_NOT_NAMES = ["good samaritan"]
OPERATION = r"\bOperation\s+[\"'“‘]?([A-Z][A-Za-z0-9'’-]+(?:\s+(?:the|of|and|for|[A-Z][A-Za-z0-9'’-]+)){1,5})[\"'”’]?"
OPERATION_CONTEXT = r"(?i)\b(?:sheriff|police|deput(?:y|ies)|narcotics?|drug|cocaine|fentanyl|methamphetamine|traffick(?:ing)?|arrest(?:ed|s)?|indict(?:ed|ment)?|dea|fbi|homeland security)\b"
OPERATION_TAIL = ["and", "of", "for", "the", "resulted", "resulting", "led", "targeted", "focused", "began", "started"]
NO_OPERATIONS = ["underway", "in-progress", "ongoing-investigation"]
NONOPERATIONAL = r"(?i)\b(?:not\s+(?:fully\s+)?(?:operational|working|functioning)|out\s+of\s+service|inoperable|malfunction(?:ing|s|ed)?|still\s+flashing|flashing\s+(?:for|since|after))\b"
NAMED_ROAD = r"\b([A-Z][A-Za-z0-9'’.-]*(?:\s+[A-Z][A-Za-z0-9'’.-]*){0,6}\s+(?:Road|Rd\.?|Street|St\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Drive|Dr\.?|Highway|Hwy\.?|Parkway|Pkwy\.?|Lane|Ln\.?|Trail|Causeway|Bridge))\b"
ASSETS = [
    ("traffic-signal", r"(?i)\b(?:traffic\s+(?:signal|light)|stoplight)\b"),
    ("rail-crossing", r"(?i)\b(?:rail(?:road)?\s+crossing)\b"),
    ("bridge", r"(?i)\b(?:drawbridge|bridge)\b"),
    ("fire-station", r"(?i)\bfire\s+station\b"),
    ("school", r"(?i)\bschool\b"),
    ("facility", r"(?i)\bfacility\b"),
]
ANIMAL_COUNT = r"(?i)\b(\d{1,3})\s+(?:cats?|dogs?|animals?|pets?)\b"
ANIMAL, ANIMALS, HOARDING = r"(?i)\b(?:cats?|dogs?|animals?|pets?)\b", r"(?i)\b(?:cats|dogs|animals|pets)\b", r"(?i)hoard"
ANIMAL_ACTION, POSTAL_ROLE = r"(?i)rescu|removed|reunit|shelter|humane society|filth|feces|faeces|cages", r"(?i)\b(?:mail carrier|postal worker)\b"
SIGNATURE_STOP = [
    "the", "and", "for", "with", "after", "from", "that", "this", "into", "over", "says", "said", "new", "county", "state", "man", "woman",
    "home", "story", "news", "local", "report", "reported", "officials", "following", "police", "what", "how", "why", "their", "they", "was",
    "were", "has", "have", "had", "near", "more", "than", "some",
]
SIGNATURE_PUBLISHERS = ["ap", "associated", "press", "reuters", "npr", "bbc", "cnn", "cbs", "abc", "nbc", "fox", "axios", "politico", "hill", "guardian", "yahoo", "aol", "msn", "times", "post", "journal", "herald", "network", "com"]
SIGNATURE_CANON = {
    "rescued": "rescue", "rescuing": "rescue", "removed": "rescue", "removing": "rescue", "remove": "rescue", "found": "rescue", "animals": "animal", "pets": "animal",
    "cats": "cat", "dogs": "dog", "hoarded": "hoard", "hoarding": "hoard", "owners": "owner", "reunited": "reunite", "reuniting": "reunite", "recovering": "recover",
    "arrested": "arrest", "charged": "arrest", "charges": "arrest", "houses": "house", "carrier": "postalworker", "postal": "postalworker", "worker": "postalworker",
}
DISTINCTIVE_MARKERS = ["postal_worker", "owner_reunion", "animal_cruelty", "filthy_home", "sheriff"]

# Fixed values of relationships: stop words, casualty words, facts that many incidents share, milestones by phrase.
RELATION_STOP = ["the", "and", "for", "with", "from", "after", "before", "into", "county", "news", "update", "says", "said", "earlier", "reported"]
CASUALTIES = ["injured", "killed", "dead", "fatalities", "victims", "hurt"]
COMMON_FACTS = ["arrest made", "fire reported", "road closed", "no injuries reported", "missing person", "investigation ongoing"]
ADVISORY_MILESTONES = {
    "arrest": r"\barrest(?:ed|s|ing)?\b|\bcharg(?:e|ed|es|ing)\b|\btaken into custody\b",
    "identified": r"\bidentified\b|\bidentity (?:was )?released\b|\bnamed as\b",
    "death": r"\b(?:dies|died|dead|deadly|killed|death|fatal|fatality|fatalities)\b|\b(?:suspected|apparent) suicide\b|\bdied by suicide\b",
    "sentencing": r"\b(?:sentenced|sentencing)\b",
    "court_action": r"\b(?:trial|hearing|lawsuit|sues|sued|indicted|indictment|arraigned|convicted)\b|\bpleads? guilty\b|\bfound guilty\b",
    "investigation": r"\binvestigation\b|\breopen(?:s|ed|ing)? (?:the )?investigation\b",
    "recovery": r"\b(?:safely located|located safe|found safe|found alive|recovered|rescued|reunited)\b|\bmissing .{0,40}\b(?:located|found)\b",
    "release": r"\breleased (?:from|on)\b|\bdischarged\b|\breturns? home\b|\breturned home\b",
    "resolution": r"\b(?:contained|resolved|cleared)\b|\b(?:road|bridge|causeway|lane|lanes|highway|intersection) (?:reopens?|reopened)\b|\b(?:all )?lanes? (?:reopen|reopened)\b|\bevacuation (?:order )?lifted\b",
    "approval": r"\b(?:approves?|approved|adopts?|adopted)\b|\bpass(?:es|ed)? (?:the )?(?:measure|ordinance|budget|plan|proposal|resolution|bill)\b",
    "rejection": r"\b(?:rejects?|rejected|denies|denied|vetoes|vetoed)\b",
    "opening": r"\b(?:opens?|opened|launches?|launched|groundbreaking)\b|\bbreaks? ground\b|\bground (?:is )?broken\b",
    "closure": r"\b(?:closes?|closed) (?:the )?(?:store|school|road|bridge|facility|business|office|route|service|program|park|beach|airport|plant|location)\b|\b(?:cancels?|canceled|cancelled) (?:the )?(?:route|service|event|program|project|flight|flights)\b|\bends? (?:the )?(?:route|service|program|operations|operation|season|project)\b|\bshuts? down\b",
    "election_result": r"\belected\b|\bwins? (?:the )?(?:election|race|seat|primary)\b|\bwon (?:the )?(?:election|race|seat|primary)\b|\bdeclared (?:the )?winner\b",
    "funding": r"\b(?:awarded|receives?|received|secures?|secured) (?:a |an |the )?(?:\$[\d.,]+ )?(?:grant|funding)\b|\bgrant (?:awarded|approved|funded)\b|\bfunding (?:approved|awarded|secured)\b",
}

# Fixed values of identity authority: outcomes, tiers, kinds of key with what they prove.
VERIFIED, POSSIBLE, NEW = "same_event_verified", "possible_relationship", "new_story"
EXACT_TIER, HARD_TIER, CANDIDATE_TIER, CONFLICT_TIER, THIN_TIER = "exact_identity", "hard_composite_identity", "candidate_only", "conflict", "insufficient_evidence"
EXACT_KEYS = [("source:", "exact_source_url"), ("custom-event:", "exact_custom_event_key"), ("weather:", "exact_weather_event_key")]

# Fixed values of exclusions and of stale heroes.
SOCIAL_MARKERS = ["facebook.com", "instagram.com", "x.com", "twitter.com", "tiktok.com", "reddit.com", "youtube.com", "youtu.be", "threads.net", "nextdoor.com"]
LOW_VALUE_TITLE = r"^expert (?:breaks down|explains)\b|^what to know\b|^watch(?: below|:)|^video:\s*|^photos?:\s*|^opinion:\s*|^analysis:\s*|^live updates?\b|^a happy ending\b"
RETROSPECTIVE_STOP = ["the", "and", "for", "with", "from", "after", "before", "into", "news", "update", "says", "said", "earlier", "reported"]
FOLLOWING = ["follow_up", "follow-up", "related"]
UNRESOLVED = ["legacy_unresolved", "recent_unresolved", "quarantined_live_mismatch"]
FRESH_PHRASES = [
    "today", "this morning", "this afternoon", "this evening", "hours ago", "minutes ago", "just announced", "just released", "breaking",
    "moments ago", "earlier today", "announced today", "arrested today", "ruled today", "confirmed today",
]
STALE_PHRASES = ["yesterday", "two days ago", "three days ago", "earlier this week", "last week", "days ago", "happened on", "occurred on", "took place on"]
RECOVERY_HOURS, LEAD_RECOVERY_HOURS, RECOVERY_TRIES, EXPANSIONS = 48, 72, 10, 3

# Publishers by name with their domains; words that content lookup leaves out.
TRUSTED_PUBLISHERS = {
    "Reuters": ["reuters.com"], "AP": ["apnews.com"], "BBC": ["bbc.com", "bbc.co.uk", "bbci.co.uk"], "NPR": ["npr.org"], "The Guardian": ["theguardian.com"],
    "CNN": ["cnn.com"], "NBC News": ["nbcnews.com"], "CBS News": ["cbsnews.com"], "ABC News": ["abcnews.go.com"], "Fox News": ["foxnews.com"], "USA Today": ["usatoday.com"],
    "Politico": ["politico.com"], "Axios": ["axios.com"], "The Hill": ["thehill.com"], "The Verge": ["theverge.com"], "Ars Technica": ["arstechnica.com"], "TechCrunch": ["techcrunch.com"],
    "Variety": ["variety.com"], "Rolling Stone": ["rollingstone.com"], "ESPN": ["espn.com"], "CBS Sports": ["cbssports.com"],
}
CONTENT_STOP = ["that", "this", "with", "from", "have", "been", "said", "will", "more", "also", "when", "were", "they", "their", "about", "says", "just", "after"]
EXACT_SOURCE, EXACT_TITLE = "Exact source article identity: true", "Exact normalized title match: true"
