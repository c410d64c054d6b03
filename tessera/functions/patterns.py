"""Word lists, patterns and numbers that results depend on. Patterns are Java regular expressions."""

import re

# Metadata patterns, matched as written unless (?i) is given.
DATES = [
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b",
    r"\bFY\d{2,4}\b",
    r"\bQ[1-4]-?\d{4}\b",
]
DOC_REFS = [
    r"(?i)\b(?:Table|Figure|Chart|Exhibit)\s+\d+(?:\.\d+)?\b",
    r"(?i)\b(?:Section|Chapter)\s+\d+(?:\.\d+)*\b",
    r"(?i)\b(?:see|refer to|as shown in)\s+(?:Table|Figure|Section)\s+\d+",
]
CHANGE_NOTE = r"(?i)\b(?:deprecated|migrated|renamed|changed|updated|modified|replaced|removed)\b"
UNITS = [
    r"\b(?:USD|EUR|GBP|CNY|JPY)\b",
    r"(?i)\b(?:%|percent|percentage)\b",
    r"(?i)\b(?:MM|million|billion|thousand|K|M|B)\b",
]
PERIODS = [r"\bFY\d{2,4}\b", r"\bQ[1-4]-?\d{4}\b", r"\b\d{4}\b"]

# Entity patterns (group 1 is the entity) and words that are never entities.
ENTITIES = [
    r"(?i)\b([A-Z][a-zA-Z]*(?:[A-Z][a-zA-Z]*)*)\s+(?:v\d+\.\d+|\d+\.\d+|version\s+\d+)\b",
    r"(?i)\b([A-Z][a-zA-Z]*(?:[A-Z][a-zA-Z]*)*)\s+(?:solution|platform|product|service|system|suite)\b",
    r"(?i)\b(?:introducing|announcing|launching|releasing)\s+(?:the\s+)?(?:new\s+)?([A-Z][a-zA-Z]*(?:[A-Z][a-zA-Z]*)*)\b",
    r"(?i)\b([A-Z][a-zA-Z]*(?:[A-Z][a-zA-Z]*)*)\s+(?:offers|provides|enables|supports|includes|delivers)\b",
    r"(?i)\b([A-Z][a-zA-Z]*[A-Z][a-zA-Z]*)\b",
    r"(?i)\b(?:our|the)\s+(?:new\s+)?([A-Z][a-zA-Z]*(?:[A-Z][a-zA-Z]*)*)\b",
]
#: The same for Java's matcher: where case is ignored a name is any run of letters, and what follows a run is no letter, so
#: no shorter part of it can match and none is tried.
FAST_ENTITIES = [
    p.replace("[A-Z][a-zA-Z]*(?:[A-Z][a-zA-Z]*)*", "[a-zA-Z]++").replace("[A-Z][a-zA-Z]*[A-Z][a-zA-Z]*", "[a-zA-Z]{2,}+") for p in ENTITIES
]
NOT_ENTITIES = [
    "the", "our", "this", "that", "new", "old", "first", "last", "are", "and", "for", "all",
    "system", "product", "solution", "platform", "service", "customer", "customers", "enterprise",
    "business", "data", "user", "users", "team", "company", "market", "markets", "time", "now",
    "version", "latest", "recent", "enhanced", "improved", "advanced", "comprehensive", "better",
]


def needed(pattern: str) -> list[str]:
    """Literals one of which every match of a pattern for lower-cased text holds, told by how it begins: a list of words
    ``(a|b|c)`` or of phrases ``(a\\s+(…)|b\\s+(…))``; none if it begins otherwise."""
    words = re.match(r"\\b\((?:\?:)?([^()\[\]]*)\)(?![?*{])", pattern)
    phrases = re.fullmatch(r"\\b\(\?:((?:[a-z?]+\\s\+\(\?:[^()]*\)\|?)+)\)\\b", pattern)
    parts = words[1].split("|") if words else re.findall(r"([a-z?]+)\\s\+\(", phrases[1]) if phrases else []
    found = [re.match(r"(?:[a-z& -](?![?*{]))*", w)[0] for w in parts]
    return found if all(found) else []


# Policy tags, on lower-cased text.
POLICY_TAGS = {
    "decision": [
        r"\b(?:decided|decision|determined|concluded|resolved|chose|selected)\b",
        r"\b(?:board\s+(?:decided|approved)|management\s+(?:decided|approved))\b",
        r"\b(?:we\s+(?:decided|chose|determined|resolved))\b",
    ],
    "update": [
        r"\b(?:updated|upgraded|improved|enhanced|modified|changed|revised)\b",
        r"\b(?:new\s+(?:version|release|update|feature))\b",
        r"\b(?:latest\s+(?:version|release|update))\b",
    ],
    "feature": [
        r"\b(?:feature|functionality|capability|enhancement|improvement)\b",
        r"\b(?:introduced|launched|released|announced|unveiled)\b",
        r"\b(?:new\s+(?:feature|product|service|offering))\b",
    ],
    "initiative": [
        r"\b(?:initiative|strategy|strategic|roadmap|plan|goal|objective)\b",
        r"\b(?:investing\s+in|focusing\s+on|prioritizing|emphasizing)\b",
        r"\b(?:direction|vision|mission|commitment|approach)\b",
    ],
    "factor": [
        r"\b(?:factors?\s+(?:affecting|influencing|impacting))\b",
        r"\b(?:due\s+to|because\s+of|as\s+a\s+result\s+of|driven\s+by)\b",
        r"\b(?:impact|effect|influence|outcome|consequence)\b",
    ],
    "periodic_review": [r"\b(?:quarterly|annual|monthly)\s+(?:results|report|review)\b"],
    "risk_factor": [r"\b(?:risk|challenge|issue|problem|concern)\b"],
    "growth_opportunity": [r"\b(?:opportunity|growth|expansion|market)\b"],
    "customer_insight": [r"\b(?:customer|client|user)\s+(?:feedback|satisfaction|experience)\b"],
}

# Key-value lines, chunk cleaning in order, and noise.
KEY_VALUE = [r"^[^:]+:\s*[^:]+$", r"^[^-]+-\s*[^-]+$", r"^[^=]+=\s*[^=]+$"]
CLEANING = [
    (r"GLYPH<[^>]*>[^<]*</GLYPH>", ""),
    (r"GLYPH&lt;[^&]*&gt;[^&]*", ""),
    (r"/[^/]*GLYPH[^/]*/", ""),
    (r"&lt;[^&]*&gt;", ""),
    (r"<[^>]*>", ""),
    (r"\s+", " "),
    (r"(?i)Home\s*>\s*Products\s*>\s*", ""),
    (r"(?i)Skip to main content", ""),
    (r"(?i)Toggle navigation", ""),
    (r"(?i)Search\s*Search\s*", ""),
    (r"(?i)Copyright\s*©\s*\d{4}", ""),
]
#: What every match of a cleaning pattern other than white space holds.
RISKY = r"[<&]|GLYPH|(?i:home|skip|toggle|search|copyright)"
NOISE = [r"^[•\-\*\s]+$", r"^\d+\.$", r"^[:\s]*$", r"(?i)^(Home|Menu|Search|Login|Logout)$"]

# Tables of contents.
TOC_LABELS = [
    "table of contents", "contents", "index", "toc", "document index", "section index", "content overview", "navigation", "outline", "structure",
    "índice", "indice", "table des matières", "inhaltsverzeichnis", "目次", "目录", "оглавление",
]
TOC_CONTENT = [
    r"\b(?:section|item|chapter|part)\s+[\d\.]+",
    r"\b(?:page|p\.|pg\.)\s*\d+",
    r"\b(?:introduction|summary|conclusion|references|appendix)\b",
    r"\b(?:financial|business|risk|management|disclosure)\b",
    r"\b(?:see|refer to|continued on)\b",
]
TOC_HEADERS = ["page", "section", "item", "chapter"]
#: (pattern, whether group 1 is the section's number)
TOC_LINES = [
    (r"(?i)^((?:Item|Section|Chapter|Part)\s+[\d\.A-Z]+\.?)\s*[|\-]?\s*(.+?)\s*[|\-]?\s*(\d+)\s*$", True),
    (r"^([^|\d]+?)\s*[|\-]?\s*(\d+)\s*$", False),
    (r"^([\d\.]+)\s+(.+?)\s+(\d+)\s*$", True),
    (r"^(.+?)\s*[\.…]+\s*(\d+)\s*$", False),
]

# Universal signals, on lower-cased text (group 1 counts; 0 for numbers).
FINANCIAL_TERMS = [
    "revenue", "income", "sales", "earnings", "profit", "loss", "margin", "gross", "net", "operating", "ebitda", "cash flow", "dividend",
    "cost", "expense", "expenditure", "investment", "budget", "spend", "capex", "opex", "overhead", "liability", "debt",
    "growth", "decline", "increase", "decrease", "performance", "efficiency", "productivity", "roi", "return", "yield", "conversion", "retention",
    "market share", "competition", "competitive", "advantage", "strategy", "opportunity", "risk", "threat", "demand", "supply",
]
UNIVERSAL = {
    "performance": [
        r"\b(improved?|increased?|grew|growth|rose|rising|up|higher)\b",
        r"\b(declined?|decreased?|dropped?|fell|falling|down|lower)\b",
        r"\b(stable|maintained?|steady|consistent|flat)\b",
        r"\b(volatile|fluctuat\w+|variable|inconsistent)\b",
    ],
    "organizations": [
        r"\b(marketing|sales|finance|hr|human resources|it|technology|operations|legal|compliance)\b",
        r"\b(research|development|r&d|engineering|design|manufacturing|production)\b",
        r"\b(division|unit|department|team|group|subsidiary|affiliate)\b",
        r"\b(business unit|product line|service line|vertical)\b",
        r"\b(customer|client|vendor|supplier|partner|investor|shareholder|stakeholder)\b",
        r"\b(management|executive|board|director|ceo|cfo|cto|cmo)\b",
    ],
    "geographic": [
        r"\b(north america|south america|europe|asia|africa|oceania|middle east)\b",
        r"\b(americas|emea|apac|asia pacific|latin america)\b",
        r"\b(united states|usa|canada|mexico|brazil|uk|germany|france|china|japan|india|australia)\b",
        r"\b(singapore|hong kong|south korea|taiwan|thailand|vietnam|indonesia)\b",
        r"\b(new york|london|tokyo|singapore|hong kong|shanghai|mumbai|berlin|paris|toronto)\b",
    ],
    "time_periods": [
        r"\b(q[1-4]|quarter|fiscal year|fy|fiscal)\s*\d{2,4}\b",
        r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{4}\b",
        r"\b\d{4}\s*(q[1-4]|quarter)\b",
        r"\b(monthly|quarterly|annually|yearly|biannual|semi-annual)\b",
        r"\b(year over year|yoy|year-to-date|ytd|month over month|mom)\b",
    ],
    "doc_refs": [
        r"\b(table|figure|chart|graph|exhibit|appendix|attachment)\s+[a-z0-9\-\.]+\b",
        r"\b(section|chapter|part|page|paragraph)\s+[a-z0-9\-\.]+\b",
        r"\b(reference|ref|see|refer to|as shown in)\s+[a-z0-9\-\.]+\b",
    ],
}
NUMBERS = {
    "percentages": r"\d+(?:\.\d+)?%",
    "monetary_values": r"[\$€£¥₹]\s*\d+(?:,\d{3})*(?:\.\d{2})?(?:\s*(?:million|billion|trillion|k|m|b))?",
    "quantities": r"\d+(?:,\d{3})*(?:\s*(?:units|pieces|items|customers|employees|users|subscribers))?",
}
#: Characters one of which every match holds.
NUMBER_SIGNS = {"percentages": ["%"], "monetary_values": list("$€£¥₹"), "quantities": list("0123456789")}
TICKET = r"\b([A-Z]+-\d+)\b"
VERSIONS = [r"(?i)\bv?(\d+\.\d+(?:\.\d+)?)\b", r"(?i)\b(?:release|version|build)\s+([a-zA-Z0-9\.-]+)\b", r"\b(\d{2,4}\.\d{1,2}(?:\.\d+)?)\b"]

# Query intents in the order that settles ties, on lower-cased queries.
INTENTS = {
    "financial": [r"\b(revenue|profit|earnings|cost|financial|fiscal|quarter|eps|ebitda)\b", r"\b(margin|growth|decline|performance|budget|expense)\b"],
    "technical": [r"\b(feature|update|release|version|improvement|bug|fix|software)\b", r"\b(technical|development|engineering|product|functionality)\b"],
    "process": [r"\b(decision|strategy|initiative|roadmap|plan|goal|process)\b", r"\b(management|leadership|direction|vision|objective)\b"],
    "temporal": [r"\b(latest|recent|new|current|this|last|next|future|upcoming)\b", r"\b(year|quarter|month|period|time|timeline)\b"],
    "comparative": [r"\b(compare|versus|vs|difference|better|worse|more|less)\b", r"\b(change|improvement|decline|increase|decrease)\b"],
}
PRESERVERS = [
    "what", "how", "why", "when", "where", "which", "show", "tell", "explain", "describe", "list", "find",
    "major", "key", "important", "significant", "critical", "latest", "recent", "new", "current", "upcoming",
    "decision", "strategy", "initiative", "update", "change",
]
NOISE_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
#: Terms that a variant leads with, and how many others follow.
FOCUS = {
    "financial": (["revenue", "profit", "earnings", "cost", "financial", "eps", "ebitda", "margin"], 2),
    "technical": (["feature", "update", "release", "version", "improvement", "product", "development"], 2),
    "process": (["decision", "strategy", "initiative", "roadmap", "plan", "goal", "management"], 2),
    "temporal": (["latest", "recent", "new", "current", "upcoming", "future"], 3),
}

# Content types; the first of the short lists with a word in the query decides.
CONTENT_TYPES = {
    "financial": ["revenue", "profit", "earnings", "financial", "quarter", "fiscal"],
    "product": ["product", "feature", "release", "launch", "software"],
    "strategy": ["strategy", "initiative", "vision", "mission", "goal"],
    "technical": ["technical", "system", "technology", "api", "development"],
}
QUERY_KEYWORDS = {
    "financial": ["revenue", "profit", "earnings", "financial", "cost", "income", "cash", "investment", "fiscal", "quarter", "eps", "ebitda"],
    "product": ["product", "feature", "release", "launch", "version", "update", "software", "platform", "service", "solution", "tool", "application"],
    "strategy": ["strategy", "initiative", "vision", "mission", "goal", "roadmap", "direction", "focus", "priority", "objective", "plan", "decision"],
    "technical": ["technical", "system", "technology", "integration", "api", "development", "engineering", "implementation", "architecture", "infrastructure"],
}
CONTENT_KEYWORDS = QUERY_KEYWORDS | {
    "financial": ["revenue", "financial", "earnings", "profit", "cost", "fiscal", "quarter", "million", "ebitda", "margin", "income", "cash", "investment"],
}

# Two-hop retrieval.
QUICK_EXPLAIN = ["why", "how", "cause", "reason"]
QUICK_LOOKUP = ["what is", "define", "definition"]
FALLBACK = [
    ("explain", "causal_expansion", ["why", "how", "cause"]),
    ("relationship", "comparative_expansion", ["compare", "vs", "versus", "between"]),
    ("numeric_evidence", "table_focused_expansion", ["table", "data", "number", "revenue", "profit"]),
]
CAUSAL = ["because", "due to", "as a result", "caused by"]
METRIC_TEMPLATES = ["{} business performance", "{} quarterly trends"]
ENTITY_TEMPLATES = ["{} financial results", "{} business impact"]
TOPIC_VARIATIONS = [
    (["drop", "decline", "fall", "decrease"], ["business challenges and factors", "market conditions and trends", "operating costs and expenses"]),
    (["revenue", "sales", "income"], ["net sales by region", "revenue breakdown analysis", "sales performance by product"]),
    (["growth", "strategy", "performance"], ["business strategy and initiatives", "market expansion and growth", "competitive position and outlook"]),
]
DEFAULT_VARIATIONS = ["business results and analysis", "financial performance overview", "quarterly business summary"]
SIGNAL_BOOSTS = {"metric_terms": 2.0, "doc_refs": 1.5, "entities": 1.2, "mentioned_dates": 1.0}
NUMERIC_BOOSTS = {"metric_terms": 2.5, "doc_refs": 2.0, "mentioned_dates": 1.8, "entities": 1.2}
#: (pattern, groups that are joined by a space; empty: the whole match)
QUERY_PERIODS = [(r"(?i)\b(FY\d{2,4})\b", [1]), (r"(?i)\b(Q[1-4])\s*-?\s*(\d{4})\b", [1, 2]), (r"(?i)\b(Q[1-4])\b", [1]), (r"\b(\d{4})\b", [1]), (r"(?i)\b(quarter|quarterly|annual|yearly|monthly)\b", [1])]
QUERY_UNITS = [(r"(?i)\b(\$|USD|EUR|GBP|CNY|JPY)\b", [1]), (r"(?i)\b(%|percent|percentage)\b", [1]), (r"(?i)\b(million|billion|thousand|MM|M|B|K)\b", [1]), (r"(?i)\b(ratio|margin|rate|growth|decline)\b", [1])]
QUERY_VALUES = [(r"\b\d+\.\d+\b", []), (r"\b\d+%\b", []), (r"\$\d+", [])]
QUERY_TABLES = [(r"(?i)\b(table|figure|chart|exhibit)\s*(\d+(?:\.\d+)?)\b", [1, 2]), (r"(?i)\b(show me|see|refer to|according to)\s+(table|figure)\b", [1, 2])]

# Query variants by financial words.
FINANCIAL_ABBREVIATIONS = [
    "eps", "roi", "roe", "roa", "p/e", "pe", "ebitda", "ebit", "fcf", "capex", "opex", "cogs", "sga", "r&d", "rd", "ltv", "cac", "arpu", "mrr", "arr", "nps", "ctr",
]
FINANCIAL_STOPWORDS = [
    "tell", "me", "show", "what", "is", "the", "are", "how", "much", "give", "provide", "find", "get", "about", "for", "in", "on", "of", "to", "from", "with", "by",
    "at", "this", "that", "these", "those", "can", "you", "please", "would", "could", "should",
]
TEMPORAL_NOISE = ["year", "quarter", "month", "period", "time", "current", "latest", "recent", "last", "next", "today", "now", "2024", "2023", "2022"]

# Prompts by intent, (role, documents), and the text around context and question.
PROMPT_ROLES = {
    "financial": ("financial analyst", "financial documents and reports"),
    "technical": ("technical analyst", "product documentation and technical updates"),
    "process": ("business analyst", "strategic documents and process information"),
}
PROMPT_DEFAULT = ("business analyst", "business documents")
PROMPT = "Analyse %s with the context given, found by %s.\n\n%s\n\nQuestion: %s\n\nAnswer this %s query from the context alone, and say what it lacks."

# Interface words, short key-values, artefacts of HTML in order, and where a page lists its contents.
UI_WORDS = [
    "home", "menu", "search", "login", "logout", "sign in", "sign up", "click here", "read more", "show more", "expand", "collapse",
    "loading", "error", "success", "warning", "info",
]
SHORT_KEY_VALUE = [r"^[^:]+:\s*.+$", r"^[^=]+=.+$", r"^[^-]+\s*-\s*.+$"]
HTML_ARTEFACTS = [
    (r"&[a-zA-Z0-9#]+;", " "),
    (r"GLYPH[^G]*GLYPH", ""),
    (r"GLYPH.*?(?=\s|$)", ""),
    (r"\s+", " "),
    (r"(?i)Skip to (?:main )?content", ""),
    (r"(?i)Toggle navigation", ""),
    (r"(?i)Search\s*Search", ""),
    (r"(?i)Home\s*>\s*[^>]*>\s*", ""),
    (r"(?i)Copyright\s*©\s*\d{4}", ""),
    (r"(?i)All rights reserved", ""),
    (r"(?i)Privacy Policy", ""),
    (r"(?i)Terms of Service", ""),
]
#: (tag or none, class or none) in the order in which they are tried; the sixth is a list inside a nav.
CONTENTS_PLACES = [("nav", "table-of-contents"), ("nav", "toc"), (None, "table-of-contents"), (None, "document-index"), (None, "toc"), ("nav ul", None), (None, "contents")]
CONTENTS_CLASSES = ["toc", "contents", "index"]
