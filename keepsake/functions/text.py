"""Text expressions.

Lengths and slices count code points. Word bounds are ASCII, as in the exports' own tooling; Java's
``\\b`` follows Unicode, so the bounds are spelled out with look-arounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space a trim removes.
SPACES = (
    " \t\n\r\x0b\f\u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = r"[\s\x{00A0}\x{FEFF}\p{Z}]+"
WORD = r"[a-z0-9']+"
EMOJI = (
    r"[\x{231A}\x{231B}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{25AA}\x{25AB}\x{25B6}\x{25C0}"
    r"\x{25FB}-\x{25FE}\x{2600}-\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}"
    r"\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{00A9}\x{00AE}\x{203C}\x{2049}"
    r"\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{1F000}-\x{1FAFF}]"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once per row for an expression that mentions it many times."""
    return F.transform(F.array(value), use)[0]


def bounded(pattern: str) -> str:
    """Replace ``\\b`` by ASCII look-arounds that hold on either side of a word edge."""
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return pattern.replace(r"\b", edge)


def any_word(words: Iterable[str], ignore_case: bool = True) -> str:
    """Pattern for one of the words with an edge on both sides."""
    words = list(words)
    body, flag = "|".join(re.escape(w) for w in words), "(?i)" if ignore_case else ""
    if all(re.fullmatch(r"[A-Za-z0-9_](.*[A-Za-z0-9_])?", w) for w in words):
        # Beside a word character an edge is the absence of another; places without a first letter are passed over at once.
        first = "".join(sorted({w[0] for w in words}))
        return f"{flag}(?=[{first}])(?<![A-Za-z0-9_])(?:{body})(?![A-Za-z0-9_])"
    return flag + bounded(rf"\b(?:{body})\b")


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def squeeze(c: Column | str) -> Column:
    """Collapse every run of white space to one blank."""
    return F.regexp_replace(col(c), SPACE_RUN, " ")


def one_line(c: Column | str) -> Column:
    return F.btrim(squeeze(c), F.lit(" "))


def clip(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def pieces_of(low: Column, lengths: Column) -> Column:
    """The distinct substrings of a text that have one of the given lengths."""
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, n)))))


def first_text(*candidates: Column | str) -> Column:
    """The first candidate that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in candidates])


def first_raw(*candidates: Column | str) -> Column:
    """The first candidate that is not blank, as written."""
    return F.coalesce(*[F.when(strip(c) != "", col(c)) for c in candidates])


def community(c: Column | str) -> Column:
    """Community name without its ``r/`` prefix."""
    return F.nullif(F.regexp_replace(strip(c), "(?i)^r/", ""), F.lit(""))


def number(c: Column | str) -> Column:
    n = F.expr("cast(null as double)") if c is None else strip(c).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), F.lit(0))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(F.lower(col(c)), F.lit(WORD)).cast("long")


def sentences(c: Column | str) -> Column:
    """Split after ``. ! ?`` and white space; blank pieces drop out."""
    parts = F.split(col(c), r"(?<=[.!?])" + SPACE_RUN)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words: the list zipped with its own tails. Lists under n words give none.

    ``words`` should be a column already computed; the list is read n times per row.
    """
    length = F.greatest(F.size(words) - (n - 1), F.lit(0))
    runs = F.slice(words, F.lit(1), length)
    for i in range(2, n + 1):
        tail = F.slice(words, F.lit(i), length)
        runs = F.zip_with(runs, tail, lambda a, b: F.concat_ws(" ", a, b))
    return runs


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def count_matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern)).cast("long")


def has_any(low: Column, terms: Sequence[str]) -> Column:
    """True when the lower-cased text contains one of the terms."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t))
    return out


def hits(low: Column, terms: Sequence[str]) -> Column:
    """How many of the terms the lower-cased text contains."""
    out = F.lit(0)
    for t in terms:
        out = out + F.contains(low, F.lit(t)).cast("int")
    return out


def hits_of(low: Column, terms: Column) -> Column:
    """The same for a term list held in a column."""
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def snippet(c: Column | str, at: Column, before: int, after: int) -> Column:
    """Text around the 0-based position, on one line."""
    start = F.greatest(F.lit(0), at - before)
    return one_line(F.substring(col(c), start + 1, at + after - start))


def token_estimate(c: Column | str) -> Column:
    return F.ceil(F.length(col(c)) / 4).cast("long")


def length_score(n: Column) -> Column:
    """Short, medium, long and very long texts."""
    return F.when(n < 20, 0.5).when(n < 150, 2.0).when(n < 400, 1.5).otherwise(0.8)


def recency_score(ts: Column, now_ms: int, weight: float = 1.0) -> Column:
    """Share of the time since 1970, up to the weight; 0 without a date."""
    part = F.unix_millis(ts) / F.lit(float(now_ms)) * weight
    return F.coalesce(F.least(F.lit(weight), part), F.lit(0.0))


# --- HTML ---------------------------------------------------------------------------------------

def unescape_html(c: Column | str) -> Column:
    """Six entities, in this order, so ``&amp;lt;`` turns into ``<``."""
    out = col(c)
    for entity, char in (
        ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"),
        ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def strip_html(c: Column | str) -> Column:
    breaks = F.regexp_replace(col(c), r"(?i)<br\s*/?>", "\n")
    return unescape_html(strip(squeeze(F.regexp_replace(breaks, "<[^>]+>", " "))))


def hosts(c: Column | str) -> Column:
    """Hosts of the links in a text, without ``www.``."""
    urls = F.regexp_extract_all(col(c), F.lit(r"(?i)https?://[^\s)]+"), F.lit(0))
    return F.filter(F.transform(urls, host), lambda h: h.isNotNull())


def host(c: Column | str) -> Column:
    """Host of one link in lower case, without port, user and leading ``www.``."""
    raw = F.lower(F.regexp_extract(
        col(c), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)(?::\d*)?(?:[/?#]|$)", 1))
    return F.nullif(F.regexp_replace(raw, r"^www\.", ""), F.lit(""))


# --- Names and keys ------------------------------------------------------------------------------

def person_words(c: Column | str) -> Column:
    """Lower case, ASCII letters, digits and single blanks."""
    return F.btrim(F.regexp_replace(
        F.regexp_replace(F.lower(col(c)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def person_letters(c: Column | str) -> Column:
    """Lower-case ASCII letters only."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z]", "")


def person_any_script(c: Column | str) -> Column:
    """Lower case, letters and digits of any script, single blanks."""
    kept = F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}\s]", "")
    return F.btrim(F.regexp_replace(kept, r"\s+", " "))


def person_slug(c: Column | str) -> Column:
    """Lower case with underscores."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9_]", "_"), "_+", "_")
    return F.regexp_replace(slug, "^_|_$", "")


def contact_key(participants: Column | str) -> Column:
    """Sorted lower-case names joined by ``_``; ``unknown`` when none is left."""
    names = F.filter(
        F.transform(col(participants), lambda p: F.lower(strip(F.coalesce(p, F.lit(""))))),
        lambda p: p != "")
    joined = F.array_join(F.array_sort(names), "_")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("unknown"))


def dedupe_text(c: Column | str, n: int | None = None) -> Column:
    """Lower-cased one-line text, optionally clipped, as a comparison key."""
    key = one_line(F.lower(col(c)))
    return key if n is None else clip(key, n)


# --- Phrases -------------------------------------------------------------------------------------

def phrase_variants(c: Column | str) -> Column:
    """Lower case, without punctuation, with single blanks, plus abbreviations both ways."""
    from keepsake.functions.lexicons import PHRASE_ABBREVIATIONS as short_forms

    low = strip(F.lower(col(c)))
    pairs = F.create_map(*[F.lit(x) for kv in short_forms.items() for x in kv])
    longs = F.array(*[F.lit(k) for k in short_forms])
    spelled = F.filter(longs, lambda k: F.element_at(pairs, k) == low)
    plain = F.array(low, F.regexp_replace(low, r"[^A-Za-z0-9_\s']", ""), squeeze(low))
    abbreviation = F.filter(
        F.array(F.try_element_at(pairs, low)), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(plain, abbreviation, spelled))


def phrase_pattern(phrase: str) -> str | None:
    """Pattern for the words of a phrase with any non-word characters between them."""
    words = re.findall(WORD, phrase.lower())
    if not words:
        return None
    return "(?i)" + bounded(r"\b" + r"[^A-Za-z0-9_]+".join(map(re.escape, words)) + r"\b")
