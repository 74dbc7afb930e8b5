"""Word lists and patterns.

Fixed values: results depend on these exact terms, so they are stated as they are.
"""

# Style and corpus statistics, and identity statistics.
STYLE_STOP_WORDS = """
the a an and or but if then else when while for to of in on at by with from
is are was were be been being i me my mine you your yours we our ours they their theirs
it its this that these those as so not no yes do does did doing done have has had having
can could would should will just like really very im ive id dont cant wont isnt arent wasnt werent
""".split()

# Per-contact topics.
TOPIC_STOP_WORDS = """
the a an and or but if then so to of in on for with at by from as is are was were be been being
i me my mine you your yours he him his she her hers they them their theirs we us our ours
this that these those it its im ive id dont cant wont ok yeah yep no yes lol lmao omg
""".split()

# Free questions: the style list and the usual question words.
QUESTION_STOP_WORDS = STYLE_STOP_WORDS + """
what which who whom why how about tell show give find any anything
""".split()

# Knowledge words of the activity view.
KNOWLEDGE_STOP_WORDS = """
the and that this with have your from just like they what when were will would about there their
them then than into because could should really also more very you for not are was but can its our
out all any how
""".split()

CONTRACTIONS = """
i'm i've i'd can't won't don't isn't aren't wasn't weren't it's that's there's you're we're they're
""".split()
SLANG = "lol lmao tbh imo imho idk ngl ya yep nah gonna wanna".split()
CHAT_SLANG = SLANG + "bruh fam bestie sis bro".split()
HUMOUR = "lol lmao haha hehe rofl /s".split()
SERIOUS = "study data evidence source according research statistic analysis".split()
CONJUNCTIONS = "and but because however although".split()

# Message classes in the order in which a tie is decided.
CLASS_WORDS = {
    "casual": "lol haha omg wtf nice cool yeah dude hey hi".split(),
    "planning": "meet when where time schedule plan tomorrow tonight lunch dinner".split(),
    "emotional": "feel stressed happy sad sorry worried love miss upset tired".split(),
    "professional": "work job meeting client project deadline email business career".split(),
}
CLASS_TONE = {
    "casual": "relaxed, conversational banter",
    "planning": "making arrangements, scheduling",
    "emotional": "sharing feelings, providing support",
    "professional": "work-related matters, formal",
    "other": "mixed-purpose messages",
}

# Sentiment of a comparison (substring) and of a change over time (whole word).
COMPARE_POSITIVE = "love great awesome good best excellent amazing".split()
COMPARE_NEGATIVE = "hate terrible awful bad worst horrible sucks".split()
TREND_POSITIVE = "love great awesome good best".split()
TREND_NEGATIVE = "hate terrible awful bad worst sucks".split()

TOPIC_SYNONYMS = {
    "startup": "startup company project app business venture".split(),
    "job": "job work position role employment career".split(),
    "breakup": "breakup split separated divorce ended".split(),
    "move": "move moving apartment house relocate relocation".split(),
    "promotion": "promotion promoted raise advance advancement".split(),
    "dating": "dating relationship boyfriend girlfriend partner".split(),
    "health": "health sick hospital doctor medical".split(),
    "family": "family mom dad sister brother parents".split(),
    "travel": "travel trip vacation visit visiting".split(),
    "money": "money finance budget savings debt loan".split(),
}
DISCLOSURE_DENIALS = [
    "haven't told", "didn't tell", "not sure if i mentioned", "keep this between us",
]

PHRASE_ABBREVIATIONS = {
    "to be honest": "tbh",
    "in my opinion": "imo",
    "by the way": "btw",
    "for what it's worth": "fwiw",
    "as far as i know": "afaik",
    "not gonna lie": "ngl",
    "not going to lie": "ngl",
}

# Contradicting statements per topic.
STANCE_TOPICS = {
    "teamwork": ["team", "teams", "collaboration", "coworker", "manager", "office"],
    "politics": ["politics", "political", "election", "policy", "government"],
    "work": ["job", "career", "work", "company", "boss"],
    "social_media": ["instagram", "twitter", "facebook", "reddit", "social media"],
    "health": ["health", "exercise", "diet", "sleep", "mental health", "therapy"],
}
STANCE_POSITIVE = "love like enjoy great good support best".split()
STANCE_NEGATIVE = "hate dislike awful terrible bad worst hell".split()

# Automated texts, matched on the lower-cased message with ASCII word bounds.
SPAM_PATTERNS = [
    r"\bcode:\s*\d+", r"\botp\b", r"\bverification\s*code\b", r"\byour\s*code\s*is\b",
    r"\bsecurity\s*code\b", r"\bverify\s*your\b", r"\border\s*#\b", r"\byour\s*order\b",
    r"\bshipped\b", r"\bdelivered\b", r"\btracking\s*#\b", r"\bpackage\s*arriving\b",
    r"\bappointment\s*reminder\b", r"\bbalance\s*is\b", r"\btransaction\s*alert\b",
    r"\bfraud\s*alert\b",
]
BUSINESS_WORDS = [
    "pharmacy|medical|clinic|hospital|health|wellness",
    "bank|pnc|chase|wells|credit|union|loan",
    "amazon|walmart|target|costco|best buy",
    "uber|lyft|taxi|transit|delivery",
    "postal|usps|fedex|ups|dhl",
    "google|apple|microsoft|facebook|instagram",
    "netflix|spotify|hulu|amazon prime",
    "restaurant|food|delivery|doordash|grubhub",
    "case manager|social security|unemployment|benefits",
    "utility|con edison|national grid|verizon|att",
]
COMPANY_WORDS = "llc|inc|corp|company|service|center|office"

# Platforms recognised in a channel name. A bare "x" or "fb" must end a word.
CHANNEL_PLATFORMS = {
    "twitter": r"twitter|x\b",
    "instagram": "instagram|insta",
    "facebook": r"facebook|fb\b",
    "tiktok": r"tiktok|tik\s*tok",
    "linkedin": "linkedin",
    "spotify": "spotify|music",
}

ENTITY_TYPES = """
person place event work health relationship hobby opinion possession education travel pet project
""".split()

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
