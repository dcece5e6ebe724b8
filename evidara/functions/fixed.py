"""Word lists, patterns and constants that results depend on, stated as they are."""

# Prefixes of public rulings, longest first.
RULING_PREFIXES = ["SMSFR", "SMSFD", "GSTR", "GSTD", "PSLA", "LCR", "PCG", "SGR", "FTD", "SGD", "TR", "TD", "IT", "CR", "PR", "MT", "PS", "TA", "ER", "ST"]
_RULING = "|".join(RULING_PREFIXES)

# Identifier patterns in the order in which they are tried, with the group that holds the value.
IDENTIFIER_PATTERNS = [
    (rf"(?i)\b(?:{_RULING})\s+\d{{2,4}}/\d+[A-Z0-9]*\b", 0),
    (r"(?i)\[\d{4}\]\s+(?:HCA|FCAFC|FCA)\s+\d+", 0),
    (r"(?i)\bC\d{4}C\d+#\d+[A-Z]?(?:-\d+[A-Z]?)?\b", 0),
    (r"(?i)\b(?:s|section)\s+(\d+[A-Z]?(?:[-.]\d+[A-Z]?)*(?:\(\d+[A-Z]?\))*)", 1),
    (r"(?i)\b(?:Income Tax Assessment Act|Income Tax Assessment Regulations|Taxation Administration Act)\s+\d{4}\b", 0),
    (r"\[(\d{1,3})\]", 1),
]

# Words that carry no lexical weight in a query.
GENERIC_TERMS = [
    "what", "which", "when", "how", "does", "did", "is", "are", "the", "this", "that", "about", "under", "into", "from", "with", "for", "provide", "provides",
    "apply", "applies", "guidance", "rule", "establish", "conclude", "issue", "address", "information", "required", "requirements", "determine", "commissioner",
    "high", "court", "ato", "treated", "purposes",
]

# Stop words of the evidence check and of query rewriting.
STOP_WORDS = [
    "what", "which", "when", "where", "how", "does", "is", "are", "the", "a", "an", "under", "into", "from", "with", "for", "and", "or", "in", "of", "to", "as",
    "can", "you", "tell", "explain", "describe", "provide", "please", "according",
]

# Injection patterns.
INJECTION_PATTERNS = [
    r"(?i)ignore\s+(all\s+)?(previous|prior)\s+instructions",
    r"(?i)(system\s+(prompt\s+)?|developer\s+mode\s+)(override|bypass)",
    r"(?i)(print|reveal|expose|dump)\s+(api_key|secret|credential|token|password)",
    r"(?i)(exfiltrate|send\s+data\s+to|curl|wget)\s+https?://",
    r"(?i)you\s+are\s+now\s+an\s+unrestricted",
    r"(?i)disregard\s+(all\s+)?(legal|tax|system)\s+(rules|law|instructions)",
]

# Evasion patterns and malformed punctuation.
EVASION_PATTERNS = [
    r"(?i)\b(hide\s+(cash|income)|off\s+the\s+books|launder|evade\s+tax|tax\s+evasion)\b",
    r"(?i)\b(disregard\s+all\s+ato|unreported\s+cash\s+economy)\b",
]
MALFORMED_PATTERN = r"(\?{2,}|:{2,}|;{2,}|\${2,}|@{2,})"

# Domains outside the corpus, in the order in which they are tried.
OUTSIDE_DOMAINS = [
    ("foreign_jurisdiction", r"(?i)\b(uk|hmrc|hm\s+revenue|manchester|new\s+zealand|auckland|irs|internal\s+revenue|vat\s+refund|401k|401\(k\)|tfsa|singapore|canada|ireland|w-8ben|1031\s+exchange)\b"),
    ("fair_work_employment", r"(?i)\b(fair\s+work|fwc\b|modern\s+award|minimum\s+wage|annual\s+leave\s+entitlement|unfair\s+dismissal|enterprise\s+agreement|national\s+employment\s+standards|nes\b|long\s+service\s+leave)\b"),
    ("asic_corporate", r"(?i)\b(asic\s+(form|fee|annual|registration)|form\s+201\b|company\s+incorporation\s+fee|director\s+id\b|afsl\b|australian\s+financial\s+services\s+licen[sc]e)\b"),
    ("apra_prudential", r"(?i)\b(apra\b|prudential\s+standard|cps\s+\d+|aps\s+\d+|capital\s+adequacy\s+ratio|bank\s+liquidity\s+coverage)\b"),
    ("accc_competition", r"(?i)\b(accc\b|australian\s+consumer\s+law|acl\b|misleading\s+or\s+deceptive|merger\s+clearance|cartel\s+conduct)\b"),
    ("privacy_cyber", r"(?i)\b(privacy\s+act\s+1988|oaic\b|australian\s+privacy\s+principles|app\s+guidelines|notifiable\s+data\s+breaches|essential\s+eight)\b"),
    ("immigration_family", r"(?i)\b(visa\s+subclass|tss\s+482|family\s+court|family\s+law\s+act|property\s+settlement\s+divorce)\b"),
]
IN_SCOPE_PATTERN = (
    r"(?i)\b(itaa|taxation\s+administration\s+act|taa\s+1953|fbt|fbtaa|cgt|capital\s+gains\s+tax|goods\s+and\s+services\s+tax|gst\b|franking|superannuation\s+guarantee|sgaa|"
    r"division\s+\d+|section\s+\d+-\d+|s\s+\d+-\d+|tr\s+\d+|td\s+\d+|lcr\s+\d+|pcg\s+\d+|gstr\s+\d+|gstd\s+\d+|psla\s+\d+|ato\s+id|assessable\s+income|deductib|depreciat|"
    r"cost\s+base|small\s+business\s+cgt|franked\s+dividend|commissioner\s+of\s+taxation|fct\s+v|re\s+dixon|part\s+iva|fringe\s+benefits)\b"
)
FOREIGN_QUERY = r"(?i)\b(uk|hmrc|hm\s+revenue|manchester|new\s+zealand|auckland|irs|internal\s+revenue|vat\s+refund|401k|401\(k\)|tfsa|singapore|canada|ireland)\b"
SPECULATIVE_QUERY = r"(?i)\b(asteroid|moon\s+mining|mars\b|lunar\b|204[5-9]|205[0-9]|quantum\s+computing\s+lease)\b"

# Lifecycle evidence.
WITHDRAWN_REFERENCE = r"(?i)\b(?:TR|TD|LCR|GSTR|CR|PR|MT)\s+\d{2,4}/\d+W\b"
DRAFT_REFERENCE = r"(?i)\b(?:TR|TD|LCR|GSTR|CR|PR|MT)\s+\d{2,4}/D\d+\b"
DRAFT_PHRASE = "draft taxation ruling"
ACT_TITLE = r"(?i)\bAct\s+(?:19|20)\d{2}\b"
REGULATION_TITLE = r"(?i)\bRegulations?\s+(?:19|20)\d{2}\b"

# Rank and effect of each class of authority.
WITHDRAWN_RANK, DRAFT_RANK, LAW_RANK, GUIDANCE_RANK = 90, 80, 10, 40

# Authority weights of the heuristic reranker and its composite.
AUTHORITY_WEIGHTS = {
    "legislation": 1.0, "statutory_rule": 0.95, "court_decision": 0.90, "public_ruling": 0.85,
    "practical_compliance_guideline": 0.75, "ato_determination": 0.80, "interpretative_decision": 0.70, "guidance": 0.60,
}
OTHER_AUTHORITY = 0.70
LEGAL_MARKERS = r"(?i)\b(section|subsection|paragraph|deduct|assess|income|tax|capital|rate)\b"
COMPOSITE = (0.45, 0.30, 0.15, 0.10)

# Weights of identifier types and of channels in rank fusion.
IDENTIFIER_WEIGHTS = {"citation": 4, "section": 3, "document_title": 2}
CHANNEL_WEIGHTS = {"exact": 2.0, "lexical": 1.0, "dense": 1.0}
FUSION_OFFSET = 60
EXACT_LIMIT, LEXICAL_LIMIT, DENSE_LIMIT, FUSED_LIMIT = 120, 200, 100, 20

# Context budget.
TOKEN_BUDGET, MAX_EVIDENCE = 12_000, 10
CHILD_LIMIT, CANDIDATE_LIMIT = 20, 80
NEAR_DUPLICATE = 0.95

# Chunk sizes in tokens.
PARENT_TARGET, PARENT_MAX, CHILD_TARGET, CHILD_MAX, OVERLAP = 2000, 2500, 600, 900, 60

# Recall cut-offs.
RECALL_CUTOFFS = [1, 5, 10, 20, 60, 100]

# Names of classifications that pass unredacted.
PUBLIC_CLASSIFICATIONS = ["PUBLIC_OFFICIAL", "PUBLIC_SECONDARY"]
KEPT_METADATA = [
    "candidate_count_in", "candidate_count_out", "pre_rerank_ranks", "post_rerank_ranks", "scores", "input_tokens", "output_tokens",
    "evidence_support", "answer_completeness", "relevance", "unsupported_claim_risk", "overall_score",
]

# Prefixes of the references that each ruling class has.
CLASS_REFERENCES = {
    "practical_compliance_guideline": ["pcg "],
    "taxation_determination": ["td "],
    "public_ruling": ["tr ", "cr ", "pr ", "gstr ", "mt "],
    "law_companion_ruling": ["lcr "],
}

# Text that marks a passage as boilerplate.
BLOCKED_TEXT = [
    "browse all legislation", "public rulings practical compliance guidelines",
    "this cover sheet is provided for information only", "does not form part of",
    "on this page", "skip to", "last updated", "subscribe to", "copyright",
    "privacy", "accessibility", "print this page", "ato law navigation",
    "pdf version is the authorised", "pdf version is the authorized",
    "authorised consolidated version", "authorized consolidated version",
    "ato references", "issn:", "finalisation of this draft", "adobe reader",
    "pdf viewer may not be able", "publications distribution service", "1300 720 092",
    "if you rely on this ruling", "a public ruling is an expression of the commissioner",
    "this publication provides you with the following level of protection",
    "we acknowledge the traditional owners", "page not found | australian taxation office",
    "omit ‘", "omit '", "correctly rely on it", "part ivaaa", "relying on this ruling",
    "relying on this determination", "legally binding", "good faith, the commissioner will",
    "good faith, we will apply", "is a public ruling for the purposes of",
    "is a 'public ruling' for the purposes of",
]

# Headings that carry no evidence.
BLOCKED_LABELS = [
    "on this page", "contact details", "federal court", "request for valuation",
    "notice of withdrawal", "contents", "how to obtain this publication",
    "in footnote", "omit ‘", "omit '", "adobe reader",
    "page not found", "what this ruling is about",
    "by phone", "privacy notice", "school education", "interpretation now",
    "things to know", "you need to know", "what you need to answer this question",
    "completing this section", "key benchmark range", "about the tax help program",
    "review permissions in access manager",
]
GENERIC_HEADINGS = ["introduction", "about this guide", "summary", "addendum", "preamble", "ruling", "overview", "guidance notes", "things to know", "you need to know", "what's new"]
OPENINGS_WITHOUT_SUBSTANCE = ["this document", "this page", "the following table", "in footnote", "omit ", "insert ", "after paragraph"]

# Titles of legislation in scope.
TAX_ACTS = [
    "income tax assessment act 1997", "income tax assessment act 1936",
    "taxation administration act 1953", "fringe benefits tax assessment act 1986",
    "a new tax system (goods and services tax) act 1999",
    "superannuation industry (supervision) act 1993",
    "income tax (transitional provisions) act 1997",
]
TAX_REGULATIONS = ["income tax assessment", "taxation administration", "fringe benefits tax", "a new tax system (goods and services tax)", "superannuation industry (supervision)"]

# What stands before a ruling's reference in a heading.
HEADING_PREFIXES = ["taxation ruling", "taxation determination", "miscellaneous taxation ruling", "class ruling", "product ruling"]

# Other labels and patterns of headings that carry no evidence.
STATISTICS_LABELS = [" statistics", "episode ", "key messages"]
QUESTION_HEADING = r"(?i)^question\s+\d+$"
FORM_LINE = r"(?i)^(?:[A-Z]?\d+[A-Z]?\s+(?:subtotal|total|item|label)|step\s+\d+|table\s+\d+)"
PERCENT_MATRIX = r"(?:\d+(?:\.\d+)?%\s*){4,}"
DOT_LEADERS = r"\.{4,}"
DEFINITION_WITHOUT_TERM = r"(?i)\bdefinition:\s*(?:[^A-Za-z\s]|$)"
LONG_IDENTIFIER = r"\b[0-9a-f]{8}(?:[-_ ][0-9a-f]{4}){3}"

# Names of issue dates.
ISSUE_DATES = ["issue_date", "issued", "published", "decision_date"]

# Passages.
PASSAGE_LEAST, PASSAGE_MOST = 120, 650
METHOD_STATEMENT = "method statement"
METHOD_STEP = r"(?i)\bStep\s+(\d+)\."

# Fields that every gold case has.
GOLD_FIELDS = [
    "id", "question", "category", "expected_jurisdictions", "as_of_date",
    "expected_documents", "expected_versions", "expected_locators",
    "acceptable_alternatives", "must_abstain", "grading_notes", "expected_passages", "review_status",
]

# Stop words of English full-text search.
SEARCH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her",
    "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
]

# The English stemmer's beginnings whose first region starts after them, words with stems of their own, and words left alone once plurals are off.
STEM_PREFIXES = ["gener", "commun", "arsen"]
STEM_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STEM_KEPT_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]

# The English stemmer's suffixes by step, with what takes their place.
STEM_SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEM_THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEM_FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]

# What court pages are read by.
SKIPPED_TAGS = {"script", "style", "nav", "footer"}
TRACKED_TAGS = {"title", "p", "li", "h1", "h2", "h3", "td"}
NUMBERED_PARAGRAPH = r"(?s)^\s*\[?(\d{1,4})\]?\s+(.+)$"
WRITTEN_DAY = r"\b(\d{1,2}\s+[A-Z][a-z]+\s+\d{4})\b"
BEFORE_DECISION_DAY = r"(?i:date of judge?ment|delivered)\W*(?:on\W*)?"
JUDGE_TITLE = r"\b(?:CJ|J|JJ)\b"
BETWEEN_PARTIES = r"(?i)\bv\b"

# Citations in file names, addresses and ids.
CITATION_IN_FILE = r"^([A-Za-z]+)(\d{4})-(\d+)"
CITATION_IN_ID = r"(?i)(?:docid=|/)(?:[A-Z]+/)?([A-Za-z]+)(\d{3,})(?:/|&|$)"
DEFINITION_ID = r"^(.+?)-def-(.+)$"

# Tokens and paragraph breaks of chunks.
CHUNK_TOKEN = r"\w+(?:['’\-]\w+)*|[^\w\s]"
BLANK_LINE = r"\n\s*\n"

# Citations, sentences, lists and years of passages.
COURT_CITATION = r"(?i)\[\d{4}\]\s+[A-Z]{2,}\s+\d+"
SENTENCE_END = r"[.!?]$"
SENTENCE_START = r"^[A-Z0-9(\-•]"
NUMBERED_LIST = r"(?s)^\s*1\s+[A-Za-z].*\b2\s+[A-Za-z]"
YEARLY_PERIOD = r"^\d{4}[-–]\d{2}$"
YEAR = r"\b((?:19|20)\d{2})\b"
YEAR_OF_REFERENCE = r"\b((?:19|20)\d{2}|\d{2})/"
YEAR_OF_PERIOD = r"\b((?:19|20)\d{2})(?:[–-]\d{2})?\b"
