"""What a question asks for, as columns over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.functions.text import bounded, col, let, strip

# The wording that marks each kind of question, tried in this order.
PHRASE_PATTERNS = [
    r"how (often|frequently|many times) (do|did) (i|you) (say|use|mention)",
    r"count.*(times|instances|occurrences)",
    r"(do|did) (i|you) (ever|often) (say|use|mention)",
    r"frequency of.*phrase",
    r"how many times",
]
TIME_PATTERNS = [
    r"(\d+)\s+(year|month|week)s?\s+ago", r"back in \d{4}", r"in (early|mid|late)?\s*\d{4}",
    r"what (was|were) (i|you) like", r"how (did|have) (i|you) (change|evolve)",
]
COMPARE_PATTERNS = [r"\bvs\b", r"\bversus\b", "prefer.*or", "difference between"]
CHANGE_PATTERNS = [
    "how (have|has|did).*(change|evolve|shift)", "(used to|formerly).*(think|believe|say)",
    "still (think|believe|say)",
]
# Wording of questions about words, and of requests for a summary.
LEXICAL_PATTERN = r"\b(common|commonly|frequent|most used|use most|words?|phrases?|sayings?|terms?)\b"
SUMMARY_VERBS = r"\b(summarize|summary|tell me about|what about|how's|how is|describe)\b"
SUMMARY_NOUNS = r"\b(conversation|chat|text|messages|relationship|talk|talking)\b"
SUMMARY_ASKS = r"\b(what did we talk|what do we talk)\b"
END = r"(?:\?|\z)"


def _any(q: Column, patterns: list[str]) -> Column:
    return q.rlike(bounded("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


def intent(question: Column | str) -> Column:
    """phrase_frequency, time_period, comparison, evolution or general; the first that fits."""
    q = F.lower(strip(question))
    return let(q, lambda x: (
        F.when(_any(x, PHRASE_PATTERNS), "phrase_frequency")
        .when(_any(x, TIME_PATTERNS), "time_period")
        .when(_any(x, COMPARE_PATTERNS), "comparison")
        .when(_any(x, CHANGE_PATTERNS), "evolution").otherwise("general")))


def intent_confidence(kind: Column | str) -> Column:
    k = col(kind)
    return (F.when(k == "phrase_frequency", 0.9).when(k == "time_period", 0.85)
            .when(k == "general", 1.0).otherwise(0.8))


def _group(q: Column, pattern: str, n: int = 1) -> Column:
    """A matched group, trimmed; null where the pattern does not occur or the group is empty."""
    return F.nullif(strip(F.regexp_extract(q, bounded(pattern), n)), F.lit(""))


def asked_phrase(question: Column | str) -> Column:
    """Quoted text, else what follows say/use/mention, word or phrase."""
    q = strip(question)
    return F.coalesce(
        _group(q, r"""["']([^"']+)["']"""),
        *[_group(q, rf"""(?i){lead}\s+["']?([^"'?]+)["']?""")
          for lead in ("(?:say|use|mention)", "word", "phrase")],
        F.lit(""))


def timeframe(question: Column | str, now: Column) -> Column:
    """Struct of type, value, start and end. "N years ago" means from then until now."""
    q = col(question)
    relative = r"(?i)(\d+)\s+(year|month|week)s?\s+ago"
    amount = F.regexp_extract(q, relative, 1).try_cast("int")
    unit = F.lower(F.regexp_extract(q, relative, 2))
    months = F.when(unit == "year", amount * 12).when(unit == "month", amount)
    time_of_day = now - F.date_trunc("day", now)
    start = F.when(
        unit == "week", now - F.make_dt_interval(F.coalesce(amount, F.lit(0)) * 7)
    ).otherwise(F.add_months(now, F.coalesce(months, F.lit(0))  * -1).cast("timestamp") + time_of_day)
    year = F.regexp_extract(q, bounded(r"\b(20\d{2})\b"), 1).try_cast("int")

    def at(y: Column, last: bool) -> Column:
        parts = (12, 31, 23, 59, 59) if last else (1, 1, 0, 0, 0)
        return F.make_timestamp(y, *[F.lit(p) for p in parts])

    def frame(kind: str, value: Column, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias("value"), a.alias("start"),
                        b.alias("end"))

    none = F.lit(None).cast("timestamp")
    return (
        F.when(unit != "", frame("relative", F.concat(
            amount.cast("string"), F.lit(" "), unit, F.lit("s ago")), start, now))
        .when(year.isNotNull(), frame("absolute", year.cast("string"), at(year, False), at(year, True)))
        .when(q.rlike("(?i)pandemic|covid"), frame(
            "descriptive", F.lit("pandemic"), at(F.lit(2020), False), at(F.lit(2021), True)))
        .otherwise(frame("descriptive", F.lit("recent"), none, none)))


def compared_topics(question: Column | str) -> Column:
    """The two sides of a comparison; empty where there are none."""
    q = col(question)
    sides = [rf"(?i)(.+?)\s+(?:vs|versus|or)\s+(.+?){END}", rf"(?i)between\s+(.+?)\s+and\s+(.+?){END}"]
    pairs = [F.when(q.rlike(p), F.array(*[strip(F.regexp_extract(q, p, i)) for i in (1, 2)]))
             for p in sides]
    return F.coalesce(*pairs, F.array().cast("array<string>"))


def changed_topic(question: Column | str) -> Column:
    return F.coalesce(_group(col(question), rf"(?i)(?:on|about|regarding)\s+(.+?){END}"), F.lit(""))


# --- People and topics -----------------------------------------------------------------------------

# Wording of questions whether something was told.
DISCLOSURE = [
    (rf"does (\w+) know (?:about )?(.+?){END}", 1, 2),
    (rf"did i tell (\w+) about (.+?){END}", 1, 2),
    (rf"have i mentioned (.+?) to (\w+){END}", 2, 1),
]


def disclosure_parts(question: Column | str) -> Column:
    """Struct of name and topic for "does X know about Y" and its kin; null otherwise."""
    q = F.lower(col(question))
    return F.coalesce(*[
        F.when(q.rlike(p), F.struct(F.regexp_extract(q, p, name).alias("name"),
                                    strip(F.regexp_extract(q, p, topic)).alias("topic")))
        for p, name, topic in DISCLOSURE])


def topic_asked(question: Column | str) -> Column:
    """Topic of "what did I tell X about Y" and the like; null otherwise."""
    q = F.lower(col(question))
    return F.coalesce(*[_group(q, p) for p in (
        rf"what did i (?:tell|say to|talk to) .+? about (.+?){END}",
        rf"what did we talk about (.+?){END}", r"about (.+?) with ")])


def asks_summary(question: Column | str) -> Column:
    q = F.lower(col(question))
    return (q.rlike(bounded(SUMMARY_VERBS)) & q.rlike(bounded(SUMMARY_NOUNS))) | q.rlike(
        bounded(SUMMARY_ASKS))


def asks_lexical(question: Column | str) -> Column:
    return F.lower(col(question)).rlike(bounded(LEXICAL_PATTERN))


# Fixed value: how a topic ends.
TAIL = r"\s+(.+?)\s*\??\s*\z"


def name_after_with(question: Column | str) -> Column:
    return _group(col(question), rf"(?i)\bwith{TAIL}")


def lookup_name(question: Column | str) -> Column:
    """The person looked up: after "with", in quotes, or at the end after for/containing."""
    q = col(question)
    return F.coalesce(name_after_with(q), _group(q, '"([^"]{2,80})"'),
                      _group(q, rf"(?i)\b(?:with|containing|for){TAIL}"))


def about_topic(question: Column | str) -> Column:
    return _group(col(question), rf"(?i)\babout{TAIL}")


def quoted_phrase(question: Column | str) -> Column:
    return _group(col(question), '"([^"]{2,120})"')


def years_ago(question: Column | str) -> Column:
    return F.regexp_extract(
        F.lower(col(question)), bounded(r"\b(\d{1,2})\s+years?\s+ago\b"), 1).try_cast("int")


def citations(answer: Column | str) -> Column:
    """Numbers cited in square brackets, in order."""
    groups = F.regexp_extract_all(col(answer), F.lit(r"\[(\d+(?:,\d+)*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    return F.filter(F.transform(numbers, lambda n: n.try_cast("long")), lambda n: n >= 1)
