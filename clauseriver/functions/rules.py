"""Rule lexicons. All values here are fixed: results depend on them to the letter.

Patterns are case-insensitive and free of look-around, so that they mean the same to every engine;
order is precedence. clauseriver.functions.text turns them into columns.
"""

# The pillars, in the order that every "first pillar" rule follows.
PILLARS = ["ai_training", "data_selling", "transparency", "data_retention", "content_ownership", "dark_patterns"]

# Penalties (full, low) by profile, pillars without an entry, floor, and rating bands.
PROFILES = {
    "prod": {
        "penalty": {
            "ai_training": (15, 8), "data_selling": (15, 8), "transparency": (0, 0), "data_retention": (15, 8),
            "content_ownership": (15, 8), "dark_patterns": (20, 10),
        },
        "other": (30, 15), "default_confidence": "MEDIUM", "floor": 5, "safe": 80, "okay": 50,
    },
    "battery": {
        "penalty": {
            "ai_training": (30, 15), "data_selling": (30, 15), "transparency": (20, 5), "data_retention": (30, 15),
            "content_ownership": (30, 15), "dark_patterns": (40, 20),
        },
        "other": (30, 15), "default_confidence": "HIGH", "floor": 0, "safe": 90, "okay": 50,
    },
}

# What a citation says when there is none.
NOT_FOUND = "[NOT_FOUND]"
NOT_ADDRESSED = "Not addressed in document."
NULL_CITATIONS = [
    "[not_found]", "not addressed in document.", "not addressed", "not mentioned", "not explicitly mentioned",
    "not specified", "not stated", "n/a", "",
]
NULL_CITATION = r"^this practice is not (?:explicitly )?(?:mentioned|addressed|stated)"

# Hard violations (pattern, whether a negated sentence is exempt).
HARD_VIOLATIONS = {
    "ai_training": [
        (r"\btrain(?:ing|s)?\s+(?:our\s+)?(?:ai|ml|machine[\s-]learning|language[\s-])?\s*models?\b", True),
        (r"\bfine[\s-]tun", True),
        (r"\bmachine[\s-]learning\b.{0,120}\btrain", True),
        (r"\btrain.{0,120}\bmachine[\s-]learning\b", True),
        (r"\bgenerative\s+ai\b", True),
        (r"\blarge\s+language\s+model\b", True),
        (r"(?:content|data|input)s?\b.{0,100}\btrain(?:ing|s)?\b.{0,80}\bmodel\b", True),
        (r"\bai\s+model\b.{0,100}\btrain", True),
    ],
    "data_selling": [
        (r"\bsell(?:ing|s)?\s+(?:your\s+|user\s+|personal\s+)?(?:data|information|details)\b", True),
        (r"\bsold\b.{0,60}\b(?:data|information|personal)\b", True),
        (r"\bthird[\s-]part(?:y|ies)\b.{0,80}\b(?:advertis(?:ing|ers?)|marketing(?:[\s-]partner)?|commercial)\b", True),
        (r"\b(?:share|disclose|provide)\b.{0,100}\bpersonal\b.{0,100}\b(?:advertis|marketing[\s-]partner|third[\s-]party)\b", True),
        (r"\bdata\s+broker\b", False),
        (r"\bmonetiz(?:e|es|ing|ation)\b.{0,80}\b(?:data|information|content)\b", True),
    ],
    "data_retention": [
        (r"\b(?:retain|keep|store|held|maintain)\b.{0,100}\b(?:data|information|personal)\b.{0,80}\b(?:[2-9]|[1-9]\d+)\s*years?\b", False),
        (r"\b(?:[2-9]|[1-9]\d+)\s*(?:months?|years?)\b.{0,120}\b(?:after|following)\b.{0,80}\b(?:delet|terminat|clos|cancell)", False),
        (r"\bretain(?:ing|s)?\b.{0,80}\bup\s+to\b.{0,80}\b\d+\s*(?:months?|years?)", False),
    ],
    "content_ownership": [
        (r"\bsub[\s-]?licens(?:e|able|ing|ed|es)?\b", False),
        (r"\bperpetual\b.{0,80}\birrevocable\b.{0,80}\blicen", False),
        (r"\birrevocable\b.{0,80}\bperpetual\b.{0,80}\blicen", False),
        (r"\broyalty[\s-]free\b.{0,120}\b(?:sublicens|creat(?:e|ing)\s+derivative|distribut\w+\s+commerc)", False),
        (r"\blicen(?:se|ce)\b.{0,120}\bfor\s+any\s+purpose\b", False),
        (r"\bfor\s+any\s+purpose\b.{0,120}\blicen(?:se|ce)\b", False),
    ],
    "dark_patterns": [
        (r"\bclass\s+action\b", False),
        (r"\bclass\s+(?:representative|member)\b.{0,150}\b(?:waiv|not\s+bring|cannot\s+bring|may\s+not\s+bring)", False),
        (r"\b(?:mandatory|binding|compulsory)\b.{0,30}\barbitrat", False),
        (r"\bagree(?:s|d|ing)?\s+to\s+(?:binding\s+)?arbitrat", False),
        (r"\bstatute\s+of\s+limitation", False),
        (r"\bliabilit\w*\b.{0,80}\b(?:shall\s+not\s+exceed|is\s+limited\s+to|will\s+not\s+exceed|capped?\s+at)\b.{0,120}(?:\$\s*\d+|\d+\s*(?:dollars?|usd))\b", False),
        (r"\bindividual\s+basis\b.{0,200}\b(?:class|collective|representative)\b", False),
    ],
}
STRONG_NEGATION = (
    r"\b(?:do(?:es)?|did|will|shall|have|has|had|can|could|may|might|should|would|must|are|is|was|were|am)\s+not\b"
    r"|\b(?:don't|doesn't|didn't|won't|shan't|haven't|hasn't|hadn't|can't|couldn't|shouldn't|wouldn't|mustn't|aren't|isn't|wasn't|weren't)\b"
    r"|\bnever\b|\bnot\s+(?:sell|share|train|use|disclose|transfer|collect|store)\b"
)

# Keywords for citations of clean pillars, 3 points (high) and 1 point (low) each.
BACKFILL = {
    "ai_training": {
        "high": ["train.{0,20}(?:model|ai|data)", "machine learning", "artificial intelligence", "fine.?tun",
                 "large language model", "generative ai", "neural network", "training data"],
        "low": [],
    },
    "data_selling": {
        "high": ["sell.{0,20}(?:data|information|personal)", "third.?part.{0,20}(?:advertis|commercial|marketing)",
                 "data broker", "marketing partner", "advertis.{0,20}partner", "share.{0,30}personal.{0,30}third"],
        "low": [],
    },
    "transparency": {
        "high": ["privacy policy", "simple and clear", "easy to understand", "plain.{0,10}language",
                 "worked hard to make", "transparent"],
        "low": ["clear", "inform"],
    },
    "data_retention": {
        "high": ["retain.{0,20}(?:data|information|personal)", "(?:data|information).{0,20}retain", "retention period",
                 "(?:days|months|years).{0,30}(?:after|follow).{0,30}(?:delet|terminat|clos)",
                 "how long.{0,30}(?:keep|store|retain|held)",
                 "(?:keep|store|held).{0,20}(?:data|information).{0,30}(?:days|months|years)",
                 "after.{0,30}account.{0,30}(?:delet|clos).{0,30}(?:days|months|years)"],
        "low": [],
    },
    "content_ownership": {
        "high": ["sublicens", "royalty.free.{0,20}licen", "worldwide.{0,20}licen", "licen.{0,30}content",
                 "intellectual property.{0,20}content", "rights.{0,20}(?:your )?content"],
        "low": ["license", "licence"],
    },
    "dark_patterns": {
        "high": ["arbitrat", "class action", "waiv.{0,20}right", "liabilit.{0,20}(?:cap|limit|shall not exceed)",
                 "statute of limitation", "(?:individual|binding).{0,20}arbitrat", "dispute.{0,20}(?:resolut|individual)"],
        "low": ["claim", "court"],
    },
}

# Phrases that confirm a pillar alone (HIGH), or two at a time (STANDARD).
HIGH_PHRASES = {
    "ai_training": ["train our models", "training data for ai", "fine-tune our", "generative ai trained", "llm trained on",
                    "used to train ai", "machine learning and ai models", "machine learning or ai",
                    "training our machine learning"],
    "data_selling": ["sell your personal data", "sell user data", "selling data", "data broker", "sell or share your",
                     "advertising partners for their", "commercial purposes"],
    "content_ownership": ["for any purpose", "sublicensable", "sub-licensable", "sub licensable", "royalty-free",
                          "irrevocable", "perpetual", "derivative works"],
    "dark_patterns": ["class action waiver", "waive your right to participate", "binding individual arbitration",
                      "forced arbitration", "not exceed $100", "shortened statute", "class action",
                      "mandatory arbitration", "compulsory arbitration", "statute of limitations", "individual basis"],
    "data_retention": ["retain indefinitely", "retain forever", "stored permanently"],
}
STANDARD_PHRASES = {
    "ai_training": ["machine learning", "artificial intelligence", "ai model", "train", "fine-tune"],
    "data_selling": ["trusted partners", "business partner", "advertiser", "third party", "share your information",
                     "disclose your", "advertising partner", "marketing partner", "data broker"],
    "transparency": ["at our sole discretion", "from time to time", "at any time without notice", "we may change",
                     "reserves the right to modify"],
    "data_retention": ["retain", "retention", "deletion", "delete your", "after account", "years after", "post-deletion"],
    "content_ownership": ["intellectual property", "royalty-free", "worldwide license", "sublicense", "perpetual",
                          "irrevocable", "derivative"],
    "dark_patterns": ["class action", "arbitration", "liability", "limitation of liability", "statute of limitations",
                      "waive", "individual basis"],
}

# Signs that a citation talks about the policy instead of quoting it.
PARAPHRASE_STRICT = [
    r"^the policy\b", r"^the terms of service\b", r"^the terms\b", r"^the document\b", r"^the agreement\b",
    r"^the platform\b", r"^the service\b", r"^the tos\b", r"^this policy\b", r"^this document\b", r"^this agreement\b",
    r"^there is no\b", r"^there are no\b", r"^no mention\b", r"^no explicit\b", r"^no specific\b",
    r"\bprovided terms of service\b", r"\bin the provided\b", r"\bmention of .{0,40} in the\b",
    r"\bin the terms of service\b", r"\bin the document\b",
    r"\b(?:policy|document|text|terms?) (?:does|do) not (?:contain|include|mention|address|discuss|state|specify|cover)\b",
    r"\bis silent on\b", r"\bthe absence of\b",
    r"\b(?:missing|lacks|lacking) (?:any |explicit |specific )?(?:language|clause|provision|mention|statement)\b",
    r"\bno (?:explicit )?(?:language|clause|mention|statement|provision|reference)\s+(?:regarding|about|on|for)\b",
]
PARAPHRASE_LEADING = [
    r"\bdoes not contain\b", r"\bdoes not include\b", r"\bdoes not mention\b", r"\bdoes not address\b",
    r"\bdoes not discuss\b", r"\bdoes not state\b", r"\bdoes not specify\b",
    r"\bdoes not explicitly (?:state|mention|address|include)\b", r"\bis not addressed\b", r"\bnot addressed\b",
    r"\bnot (?:explicitly )?mentioned\b", r"\bnot (?:explicitly )?stated\b", r"\bnot (?:explicitly )?specified\b",
]
WRAPPER_PREFIX = (
    r"^(?:the (?:terms?(?: of service)?|policy|document|agreement|x user agreement|platform)\s+(?:also\s+)?"
    r"(?:states?|says?|notes?|requires?|provides?|includes?|limits?|caps?|restricts?|grants?|gives?)\s+(?:that\s+)?[\"'“‘]?"
    r"|this (?:policy|license|agreement|means?)\s+(?:states?|says?|provides?|requires?|means?)\s+(?:that\s+)?[\"'“‘]?)"
)
WRAPPER_SUFFIX = (
    r"[,;]\s+(?:indicating|suggesting|implying|potentially|which means|and may be|and could be|making it|this means|and is)[^.]*\.?\s*$"
)

# Explicit denials by pillar.
DENIALS = {
    "data_selling": [
        r"we do not sell\b",
        r"we never sell\b",
        r"we do not share.*(?:personal|user)\s*(?:data|information)",
        r"we never share.*(?:personal|user)\s*(?:data|information)",
        r"(?:personal|user)\s*(?:data|information).*(?:is not|are not|will not be)\s*sold",
        r"does not sell\b",
        r"will not sell\b",
        r"not.*sell or share.*(?:personal|user)",
        r"we don't sell\b",
        r"we don't share.*(?:personal|user)\s*(?:data|information)",
        r"no personal (?:data|information) (?:is|are) (?:shared|sold)",
    ],
    "ai_training": [
        r"do not use.*(?:data|content|information).*(?:to train|for training|for ai|for machine learning)",
        r"never use.*(?:data|content).*(?:to train|for training)",
        r"(?:data|content|information).*(?:is not|will not be|are not)\s*used.*(?:to train|for training|for ai)",
        r"will not.*(?:train|use.*for ai|use.*for machine learning)",
        r"(?:do not|does not|will not).*train.*(?:ai|artificial intelligence|machine learning|model)",
        r"not.*used to train",
        r"we don't use.*(?:data|content).*(?:to train|for training)",
        r"we do not train (?:ai|ml|our models)",
    ],
    "data_retention": [
        r"data (?:is|are) deleted within (\d+) days",
        r"deleted within \d+ (?:days?|weeks?|months?) of account (?:deletion|closure|termination)",
        r"we do not retain (?:personal|user)?\s*(?:data|information) after",
        r"we never retain.*(?:indefinitely|permanently)",
        r"no personal (?:data|information) is retained after",
        r"retain.*only.*(?:necessary|required) (?:to|for)",
        r"limits?\s+(?:data\s+)?retention\s+to\s+(?:the\s+)?(?:duration|time|period)\s+necessary",
        r"(?:retain|keep|store).*(?:only\s+)?(?:as\s+long\s+as|for\s+as\s+long\s+as|for\s+the\s+time)\s+necessary",
        r"(?:data|information)\s+(?:is|are|will be)\s+retained\s+(?:only\s+)?(?:for|as long as)\s+(?:as long as\s+)?necessary",
        r"we (?:do not|don't) (?:keep|store|retain).*(?:longer than|beyond what is) necessary",
        r"(?:minimum|shortest) (?:retention|storage) period",
    ],
    "content_ownership": [
        r"you retain (?:full )?ownership",
        r"you own (?:all )?(?:your )?content",
        r"we (?:do not|don't) claim (?:any )?(?:intellectual property|ownership|rights) (?:over|to)",
        r"we claim no (?:intellectual property|ownership|rights)",
        r"(?:your content|user content).*remains? (?:your|yours)",
        r"license.*only.*(?:to display|to operate|to provide).*(?:service|you)",
    ],
    "dark_patterns": [
        r"we (?:will )?never waive your right to (?:participate in )?class action",
        r"(?:you may|users may) (?:participate|join) (?:in )?class action",
        r"no (?:mandatory |binding |forced )?arbitration",
        r"our liability is limited only by applicable law",
        r"we (?:do not|don't) (?:impose|require) (?:forced |binding |mandatory )?arbitration",
        r"(?:no|without) (?:liability|damages) caps? (?:below|under) (?:applicable|statutory)",
    ],
    "transparency": [
        r"written in plain (?:english|language)",
        r"(?:easy|clear) to (?:read|understand)",
        r"we (?:aim|strive) to be (?:transparent|clear|honest)",
        r"this policy is (?:clear|transparent|written in plain)",
    ],
}
CONDITIONAL = (
    r"\b(?:except(?:\s+when)?|unless|however|provided\s+that|other\s+than|notwithstanding|subject\s+to|only\s+when"
    r"|but\s+(?:not|we|may)|in\s+certain\s+cases|under\s+some\s+circumstances)\b"
)

# Clauses that are a violation wherever they stand.
CLAUSES = {
    "ai_training": [
        r"\b(?:use|using|uses)\s+(?:your|user|customer)\s+(?:content|data|information|posts?|uploads?)\s+[^.]{0,80}?(?:to\s+train|for\s+training|to\s+improve|to\s+develop)\s+[^.]{0,40}?(?:ai|a\.i\.|artificial intelligence|machine learning|ml model|model|algorithm|generative)",
        r"\b(?:your|user|customer)\s+(?:content|data|submissions?)\s+(?:may|will|can|shall)\s+be\s+used\s+[^.]{0,40}?(?:to\s+train|for\s+training|for\s+ai|for\s+model)",
        r"\bwe\s+train\s+(?:our\s+)?(?:ai\s+|ml\s+)?models?\s+(?:on|using|with)\s+(?:your|user|customer)\s+(?:content|data|information)",
    ],
    "data_selling": [
        r"\b(?:sell|sells|selling|sold)\s+(?:your|user|customer|consumer)?\s*(?:personal\s+)?(?:data|information|content)\s+(?:to|for)",
        r"\bshare\s+(?:your|user|personal|customer)\s+(?:data|information|identifiers?)\s+with\s+[^.]{0,60}?(?:advertis|marketing\s+partners?|third[- ]part|measurement\s+partners?|data\s+brokers?)",
        r"\bdisclose\s+(?:personal|user)\s+information\s+[^.]{0,40}?(?:for\s+(?:monetary|valuable)\s+consideration|in\s+exchange\s+for)",
    ],
    "content_ownership": [
        r"\bnon[- ]exclusive[^.]{0,80}?(?:worldwide|sub[- ]?licens|royalty[- ]free|transferable|perpetual)",
        r"\bperpetual[^.]{0,30}?(?:licen[sc]e|right)\s+to\s+(?:your|user)\s+content",
        r"\b(?:right|licen[sc]e)\s+to\s+(?:modify|adapt|translate|publicly\s+display|publicly\s+perform|distribute|reproduce)[^.]{0,80}?(?:your|user)\s+content[^.]{0,60}?(?:for\s+any\s+purpose|commercial)",
    ],
    "dark_patterns": [
        r"\bclass\s+action\s+waiver\b",
        r"\bwaive[rs]?[^.]{0,30}?(?:right\s+to\s+)?class\s+action",
        r"\bindividually\s+and\s+not\s+as\s+part\s+of\s+(?:a|any)\s+class",
        r"\b(?:mandatory|binding|compulsory|required)\s+arbitration\b",
        r"\barbitration\s+(?:is\s+)?(?:mandatory|binding|required|compulsory)",
        r"(?:\$\d{1,3}(?:,\d{3})*|\$\s*\d{1,5})\s+(?:total\s+)?(?:liability\s+cap|limit(?:ation)?\s+of\s+liability|maximum\s+liability)",
        r"(?:liability\s+(?:is\s+)?(?:limited|capped)\s+(?:to|at))\s+\$\d{1,5}",
        r"\b(?:must\s+(?:bring|file|assert)|claims?\s+must\s+be\s+(?:brought|filed))\s+[^.]{0,40}?within\s+(?:30|60|90|120|180|six|6)\s+(?:days?|months?)",
    ],
    "data_retention": [
        r"\bretain(?:ed|s)?\s+(?:your\s+|user\s+)?(?:data|information|content)\s+(?:indefinitely|permanently|forever|in perpetuity)",
        r"\b(?:keep|store)\s+[^.]{0,40}?(?:indefinitely|permanently|forever)",
        r"\b(?:do\s+not|don't|does\s+not)\s+(?:have\s+)?(?:a\s+)?(?:data\s+)?(?:deletion|retention)\s+(?:timeline|schedule|period|policy)",
    ],
    "transparency": [
        r"\bwe\s+do\s+not\s+(?:share|sell|disclose)[^.]{0,80}?(?:except|unless|however|provided that)\s+[^.]{0,100}?(?:share|sell|disclose|provide|transfer)",
    ],
}

# Evidence patterns of the scan without a model, and signs of a protective policy.
EVIDENCE = {
    "ai_training": [
        r"\b(train(?:ing)?|fine[-\s]?tune|machine learning|artificial intelligence|AI models?)\b.{0,120}\b(user|your|customer)\b.{0,120}\b(data|content|interactions|prompts|uploads)\b",
        r"\b(user|your|customer)\b.{0,120}\b(data|content|interactions|prompts|uploads)\b.{0,120}\b(train(?:ing)?|improve)\b.{0,80}\b(machine learning|AI|models?)\b",
    ],
    "data_selling": [
        r"\b(sell|selling|share|sharing|disclose|disclosing)\b.{0,140}\b(data|information|content)\b.{0,140}\b(advertis|partner|third[-\s]?part|affiliate|commercial)\b",
        r"\b(advertising partners?|analytics partners?|third[-\s]?party)\b",
        r"\b(use|using)\b.{0,80}\bdata\b.{0,80}\b(personalization|advertising|measurement|commercial)\b",
    ],
    "transparency": [
        r"\b(including but not limited to|from time to time|at our sole discretion|for any purpose)\b",
        r"\bwe may collect other information\b",
    ],
    "data_retention": [
        r"\bretain(?:ed|ing)?\b.{0,120}\b(indefinite|indefinitely|forever|perpetual)\b",
        r"\bretain(?:ed|ing)?\b.{0,120}\b\d+\s*(year|years)\b",
        r"\bafter (?:account )?deletion\b.{0,120}\b(month|months|year|years)\b",
    ],
    "content_ownership": [
        r"\blicense\b.{0,180}\b(worldwide|perpetual|irrevocable|sublicensable|transferable|royalty[-\s‐-―]?free)\b",
        r"\b(worldwide|perpetual|irrevocable|sublicensable|transferable|royalty[-\s‐-―]?free)\b.{0,180}\blicense\b",
        r"\b(create|prepare|preparation of|modify)\b.{0,80}\bderivative works\b",
        r"\bfor any purpose\b",
    ],
    "dark_patterns": [
        r"\b(class action waiver|waive.*class action)\b",
        r"\b(binding individual arbitration|forced arbitration)\b",
        r"\bliability\b.{0,30}\$\s?\d{1,4}\b",
        r"\bstatute of limitations\b.{0,60}\b(1|one)\s*year\b",
    ],
}
POSITIVE_SIGNALS = [
    r"we (don't|do not|never) (sell|share|track|collect|disclose)\b",
    r"never sell.{0,50}(data|information|personal)",
    r"do not (track|sell|share) your",
    r"not (sell|share|disclose).{0,50}(third part|advertis)",
    r"privacy (is|by design|first|focused)",
    r"we (collect|use) (minimal|as little|only what)",
    r"we don't collect personal",
]

# Categories of service by url and by text (two hits needed), pillars that don't apply, labels.
CATEGORIES = {
    "search_engine": {
        "url": r"\b(?:duckduckgo|startpage|brave\.com/search|searx|qwant|ecosia|kagi)\b",
        "text": [r"\bsearch\s+engine\b", r"\bqueries?\s+(?:are\s+)?(?:not\s+)?(?:logged|stored|tracked)"],
        "label": "search engines", "not_applicable": ["content_ownership"],
    },
    "messaging_e2e": {
        "url": r"\b(?:signal|protonmail|tutanota|threema|wire\.com|wickr|session\.org|silence)\b",
        "text": [r"\bend[- ]to[- ]end\s+encrypt", r"\bzero[- ]knowledge\b", r"\bcannot\s+(?:read|access|decrypt)\s+your\s+messages"],
        "label": "end-to-end messaging services", "not_applicable": ["content_ownership", "ai_training", "data_selling"],
    },
    "financial": {
        "url": r"\b(?:paypal|stripe|chase|wells ?fargo|coinbase|kraken|robinhood|fidelity|schwab|vanguard|bank|trading|invest|crypto|gambling|casino|betting|forex|brokerage)\b",
        "text": [r"\baccount\s+(?:holder|balance)", r"\bfdic[- ]insured", r"\bkyc\s+(?:process|verification)", r"\banti[- ]money[- ]laundering"],
        "label": "financial services", "not_applicable": ["content_ownership", "ai_training"],
    },
    "ecommerce": {
        "url": r"\b(?:amazon|ebay|etsy|shopify|walmart|alibaba|aliexpress|target|bestbuy)\b",
        "text": [r"\border\s+history", r"\bshipping\s+address", r"\bpayment\s+method", r"\breturns?\s+policy"],
        "label": "ecommerce", "not_applicable": [],
    },
    "social_platform": {
        "url": r"\b(?:facebook|meta|instagram|twitter|x\.com|tiktok|snapchat|snap\.com|reddit|linkedin|youtube|pinterest|threads)\b",
        "text": [r"\bpost[s]?\s+content", r"\bshar(?:e|ing)\s+(?:posts?|content|photos?|videos?)", r"\bfollow(?:er|ing)s?\b", r"\bnews\s+feed"],
        "label": "social platforms", "not_applicable": [],
    },
    "media_streaming": {
        "url": r"\b(?:netflix|hulu|disney|spotify|apple ?music|primevideo|hbomax|paramount|peacock|max\.com)\b",
        "text": [r"\bstream(?:ing)?\s+(?:service|content|library)", r"\bsubscription\s+plan", r"\bcontent\s+catalog"],
        "label": "streaming services", "not_applicable": [],
    },
    "enterprise_saas": {
        "url": r"\b(?:slack|salesforce|workday|okta|servicenow|atlassian|oracle\.com/cloud|aws\.amazon|gcp\.google)\b",
        "text": [r"\benterprise\s+customer", r"\bdata\s+processing\s+agreement", r"\bsub[- ]processor", r"\bcorporate\s+account", r"\bbusiness\s+associate"],
        "label": "enterprise SaaS", "not_applicable": ["dark_patterns"],
    },
    "developer_tools": {
        "url": r"\b(?:github|gitlab|bitbucket|npmjs|pypi|huggingface|vercel|netlify|cloudflare)\b",
        "text": [r"\brepositor(?:y|ies)", r"\bapi\s+(?:key|token)", r"\bcommit\s+history", r"\bpull\s+request"],
        "label": "developer tools", "not_applicable": [],
    },
}
GENERAL_LABEL = "this service"
NO_REAL_CITATION = r"^(?:\[not_found\]|not addressed|not mentioned|n/a|\s*)$"

# Headings near which a citation is prominent.
HEADINGS = [
    r"\barbitration\b", r"\bclass\s+action\b", r"\bliability\b", r"\blimitation\s+of\s+liability\b", r"\blicense\s+grant\b",
    r"\buser\s+content\b", r"\bcontent\s+license\b", r"\bintellectual\s+property\b", r"\badvertising\b", r"\bretention\b",
    r"\bdata\s+retention\b", r"\bdeletion\b", r"\bartificial\s+intelligence\b", r"\bmachine\s+learning\b", r"\bai\s+training\b",
    r"\btraining\s+(?:of\s+)?(?:our\s+)?(?:ai|models)\b", r"\bgoverning\s+law\b", r"\bdispute\s+resolution\b",
    r"\bwarrant(?:y|ies)\b", r"\bthird[-\s]party\b", r"\badvertising\s+partners?\b",
]
#: These two are case-sensitive.
NUMBERED_HEADING = r"(?:^|\n)\s*(?:section\s+)?(?:§\s*)?\d+(?:\.\d+){0,3}\.?\s+[A-Z]"
BULLET = r"(?:^|\n)\s*(?:[\-•*]|\d+[.)]|[A-Z]\.)\s"

# Cookie banners, links and pages.
COOKIE_INDICATORS = [
    r"targeting\s+cookies", r"strictly\s+necessary\s+cookies", r"functional\s+cookies", r"performance\s+cookies",
    r"accept\s+all\s+cookies", r"reject\s+all\s+cookies", r"cookie\s+preferences", r"universal\s+advertising\s+identifier",
    r"consent\s+management\s+platform", r"\bonetrust\b", r"\bcookiebot\b", r"vendors?\s+may\s+rely\s+on\s+your\s+consent",
]
BLOCKED_HOSTS = [
    "paypal", "stripe", "bank", "trading", "invest", "crypto", "gambling", "casino", "betting", "forex", "brokerage",
]
LEGAL_URLS = [
    r"/terms[-_]?(of[-_]?(service|use))?", r"/privacy[-_]?(policy)?", r"/tos\b", r"/eula\b", r"/legal\b",
    r"/user[-_]?agreement", r"/cookie[-_]?(policy)?", r"/data[-_]?(protection|processing)", r"/acceptable[-_]?use",
]
LEGAL_KEYWORDS = [
    "terms of service", "terms and conditions", "privacy policy", "user agreement", "end user license", "eula",
    "cookie policy", "data processing", "acceptable use", "legal notice", "by using this service",
    "by accepting these terms",
]
PAGE_SIGNALS = {"url": 40, "title": 25, "h1": 20, "h2": 15, "modal": 30, "cookie-banner": 20, "meta": 10}
COOKIE_BANNER = (
    r"<[^>]+(?:id=[\"'](?:onetrust-banner-sdk|cookiebanner|cookie-banner|cookie-consent|CybotCookiebotDialog)"
    r"|class=[\"'][^\"']*(?:cookie-consent|cookie-notice|cc-window)|aria-label=[\"'][^\"']*cookie)"
)
LINK_KEYWORDS = [
    "privacy", "privacy-policy", "privacy_policy", "privacy-notice", "terms", "terms-of-service", "terms-of-use", "tos",
    "eula", "cookie", "cookies", "cookie-policy", "dmca", "copyright", "acceptable-use", "aup", "data-processing", "dpa",
    "data-protection", "legal", "license", "licenses", "community-guidelines", "content-policy",
]
LINK_BLOCKLIST = [
    "login", "signin", "sign-in", "signup", "register", "pricing", "blog", "support", "help", "careers", "jobs", "contact",
    "about", "download", "app-store", "google-play",
]
SITE_CATEGORIES = {
    "social_media": r"twitter|instagram|facebook|tiktok|linkedin|snapchat|x\.com",
    "streaming": r"spotify|netflix|youtube|apple\.com/music|primevideo|hulu",
    "cloud_storage": r"drive\.google|dropbox|onedrive|icloud|box\.com",
    "ecommerce": r"amazon|ebay|etsy|shopify|walmart",
    "gaming": r"steam|epicgames|xbox|playstation|ea\.com",
    "productivity": r"google\.com|microsoft|notion|slack|zoom",
}

# Words that make a citation too weak to stand, by override rule.
COMMERCIAL_WORDS = [
    "advertis", "broker", "marketing partner", "targeted", "personaliz", "personalis", "commercial partner",
    "third-party partner", "business partner",
]
SHARING_WORDS = ["third party", "third-party", "share your"]
BAN_WORDS = ["prohibited", "not permitted", "you may not", "you must not", "do not", "forbidden", "automated means", "engage in any of"]
BAN_WORDS_LATER = ["as training data", "licensed products"]
SCOPING_WORDS = ["opt-out", "solely applies", "limited to", "only applies", "applies solely", "does not apply to"]
FEEDBACK_WORDS = ["feedback", "ideas", "suggestions", "comments", "input"]
BUSINESS_WORDS = ["bing places", "business listing", "business information", "business profile", "business data"]
INCOMING_WORDS = [
    "you send", "send us", "send to us", "communicate to us", "you submit", "submit to us", "provided to us", "sent to us",
    "communication you", "you communicate",
]
PUBLISHED_WORDS = ["post", "photo", "video", "image", "file", "upload", "creat"]
PUBLISHED_WORDS_LATER = ["stream", "broadcast"]
HOSTING_WORDS = ["store", "sync", "backup", "icloud", "host", "access your", "areas of the service", "areas of our service"]
NOT_HOSTING_WORDS = ["sublicens", "commercial", "advertis", "publish"]
OPEN_LICENSE_WORDS = ["creative commons", "cc by", "cc-by", "open license", "freely licensed"]
PUBLIC_CONTENT_WORDS = [
    "server copies of public content", "cached copies", "search engine cache", "publicly available", "archived copies",
    "public posts", "account or access is blocked or otherwise terminated", "licences granted by you for public content",
    "license for public content", "public content continue", "contributions remain", "delinquent", "delinquent restricted",
    "may delete accounts", "inactive account",
]
SCOPED_ARBITRATION = [
    "for violations of this section", "related to undisclosed paid", "solely for disputes arising from",
    "only in connection with", "limited to claims arising from", "solely in connection with",
]
SCOPED_ARBITRATION_LATER = ["undisclosed paid contributions", "related to your contributions"]
CAP_WORDS = ["liability", "damages", "limit", "cap", "exceed", "total amount paid"]

# Words that don't help to find a citation.
STOPWORDS = [
    "that", "with", "this", "from", "your", "their", "have", "will", "been", "they", "were", "when", "also", "than", "then",
    "into", "more", "about", "which", "such", "other", "these", "those", "shall", "under", "upon", "including", "without",
    "within", "whether", "however", "each", "only",
]

# What a scan without a model says of itself: risks found ({} stands for their names), protections, neither; and why.
FALLBACK_TLDR = [
    "AI analysis was partially unavailable. Regex patterns detected potential risks in: {}. Manual review recommended.",
    "No high-risk clauses detected. This policy contains explicit privacy protections (\"we don't sell/track you\"). AI deep-analysis was unavailable — full confidence requires a manual re-scan.",
    "AI analysis was unavailable. No explicit violation patterns were found in the text. This is an automated fallback — re-scan for a full AI verdict.",
]
FALLBACK_DEDUCTION = "AI analysis unavailable — fallback scan found no violations but full audit could not be completed"
