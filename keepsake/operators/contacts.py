"""People: name matching, per-contact style, topics, and which threads are real conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.lexicons import (
    BUSINESS_WORDS, CHAT_SLANG, COMPANY_WORDS, SPAM_PATTERNS, STYLE_STOP_WORDS, TOPIC_STOP_WORDS,
)
from keepsake.functions.text import (
    EMOJI, any_word, bounded, clamp01, clip, count_matches, ngrams, one_line, person_words, strip,
    tokens,
)
from keepsake.functions.times import iso, iso_seconds
from keepsake.operators.ranking import bounded_lists, broadcast_if_small, first_last_longest, keep_first, top_k
from keepsake.operators.term_index import stored

PERSON = ["owner_id", "contact"]
# Names with the asked-for names they fit: two hundred thousand are some tens of megabytes.
MAX_NAMES = 200_000


# --- Automated and business senders ---------------------------------------------------------------

def is_spam(text: Column, sender: Column, phone: Column, thread_size: Column) -> Column:
    """Blank sender, short code, one of the known patterns, or only a few digits."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), "[^0-9]", "")
    # Each pattern begins with an edge and a letter; places without such a letter are passed over at once.
    rests = [p.removeprefix(r"\b") for p in SPAM_PATTERNS]
    first = "".join(sorted({r[0] for r in rests}))
    patterns = bounded(rf"(?=[{first}])(?<![A-Za-z0-9_])(?:{'|'.join(rests)})")
    return (
        (strip(F.coalesce(sender, F.lit(""))) == "")
        | digits.rlike(r"^\+?1?(\d{5,6})$")
        | ((thread_size == 1) & (sender == "Unknown"))
        | F.lower(text).rlike(patterns)
        | ((F.length(text) < 20) & strip(text).rlike(r"^\d+$"))
    )


def is_business(name: Column, deny: Sequence[str] = ()) -> Column:
    """On the caller's list, a business word, all capitals over three characters, or a legal form."""
    words = bounded("|".join(rf"(?:\b(?:{w})\b)" for w in BUSINESS_WORDS))
    company = "(?i)" + bounded(rf"\b(?:{COMPANY_WORDS})\b")
    listed = name.isin(*deny) if deny else F.lit(False)
    return F.coalesce(
        (name != "") & (listed | F.lower(name).rlike(words)
                        | ((name == F.upper(name)) & (F.length(name) > 3)) | name.rlike(company)),
        F.lit(False))


def conversation_threads(messages: DataFrame, keys: Sequence[str], total: int = 3,
                         per_side: int = 2) -> DataFrame:
    """Messages of threads with enough on both sides. The count is aggregated, then semi-joined."""
    good = messages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_user_message").alias("mine"),
        F.count_if(~F.col("is_user_message")).alias("theirs"),
    ).filter((F.col("n") >= total) & (F.col("mine") >= per_side) & (F.col("theirs") >= per_side))
    return messages.join(good.select(*keys), list(keys), "left_semi")


def significant_contacts(messages: DataFrame, total: int = 10, mine: int = 5) -> DataFrame:
    return messages.groupBy(*PERSON).agg(
        F.count(F.lit(1)).alias("messages"), F.count_if("is_user_message").alias("user_messages"),
    ).filter((F.col("messages") >= total) & (F.col("user_messages") >= mine))


# --- Name matching --------------------------------------------------------------------------------

def names_match(a: Column, b: Column) -> Column:
    """Equal, or one contained in the other. A blank name matches nothing."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def match_names(events: DataFrame, targets: DataFrame, normalize=person_words) -> DataFrame:
    """Which participant names fit which asked-for name: ``(owner_id, name, target)``."""
    return _matched_names(events, targets, normalize).drop("target_plain")


def _matched_names(events: DataFrame, targets: DataFrame, normalize) -> DataFrame:
    """The same with the asked-for name as it is compared.

    Names are reduced to distinct ones first. The asked-for names of an owner travel as one array
    (a request lists a few), so no pair is formed that does not match.
    """
    names = (
        events.select("owner_id", F.explode("participants").alias("name"))
        .filter(F.col("name").isNotNull()).distinct()
    )
    asked = bounded_lists(targets.select("owner_id", "target").distinct().withColumn(
        "plain", normalize(F.col("target"))), ["owner_id"], ["target", "plain"], "targets")
    fits = F.filter("targets", lambda x: names_match(F.col("plain"), x["plain"]))
    return (
        names.withColumn("plain", normalize(F.col("name"))).join(asked, "owner_id")
        .select("owner_id", "name", F.explode(fits).alias("t"))
        .select("owner_id", "name", "t.target", F.col("t.plain").alias("target_plain"))
    )


def events_with(events: DataFrame, targets: DataFrame, normalize=person_words) -> DataFrame:
    """Events in which a participant matches an asked-for name, once per (event, target).

    Where several participants match, the row of the first name stays; each row can tell this by itself, so events
    need no identity and no shuffle of their own.
    """
    # Stored, so that counting does not read the events again. Few names are hot ones: then no event is shuffled by its name.
    matched = broadcast_if_small(stored(_matched_names(events, targets, normalize), "names"), MAX_NAMES)
    hits = events.withColumn("name", F.explode(F.array_distinct("participants"))).join(
        matched, ["owner_id", "name"])
    fitting = F.filter("participants", lambda p: names_match(normalize(p), F.col("target_plain")))
    return hits.filter(F.col("name") == F.array_min(fitting)).drop("name", "target_plain")


def recent_with(events: DataFrame, targets: DataFrame, n: int = 50) -> DataFrame:
    """The latest messages with each asked-for person."""
    return top_k(events_with(events, targets), ["owner_id", "target"],
                 [F.desc_nulls_last("created_at"), F.desc("seq")], n)


# --- Profiles -------------------------------------------------------------------------------------

def shared_phrases(messages: DataFrame, k: int = 20, min_user: int = 2) -> DataFrame:
    """Word pairs both sides use, the owner at least twice; in order of the owner's first use."""
    worded = messages.select(*PERSON, "is_user_message", "seq", tokens("text").alias("w"))
    pairs = worded.select(
        *PERSON, "is_user_message", "seq",
        F.posexplode(ngrams(F.col("w"), 2)).alias("position", "phrase"))
    kept = pairs.filter(~F.substring_index("phrase", " ", 1).isin(*STYLE_STOP_WORDS))
    first = F.col("seq").cast("decimal(20,0)") * F.lit(1 << 20) + F.col("position")
    mine = F.col("is_user_message")
    counted = kept.groupBy(*PERSON, "phrase").agg(
        F.count_if(mine).alias("user_count"), F.count_if(~mine).alias("contact_count"),
        F.min(F.when(mine, first)).alias("first_use"))
    shared = counted.filter((F.col("user_count") >= min_user) & (F.col("contact_count") >= 1))
    return top_k(shared, PERSON, [F.asc("first_use"), F.asc("phrase")], k).drop("first_use")


def sample_messages(messages: DataFrame, k: int = 10) -> DataFrame:
    """The first messages of 11 to 199 characters of each side."""
    n = F.length("text")
    fitting = messages.filter((n > 10) & (n < 200)).select(*PERSON, "is_user_message", "seq", "text")
    return top_k(fitting, [*PERSON, "is_user_message"], [F.asc("seq")], k)


def contact_profiles(messages: DataFrame) -> DataFrame:
    """Counts, lengths, rates, closeness and relation per contact, in one grouped pass."""
    mine, theirs = F.col("is_user_message"), ~F.col("is_user_message")
    slang = any_word(CHAT_SLANG)
    rows = messages.select(
        *PERSON, "is_user_message", "seq", "sender_name", iso("created_at").alias("at"),
        F.length("text").alias("length"), count_matches("text", EMOJI).alias("emoji"),
        count_matches("text", slang).alias("slang"), count_matches("text", r"\?").alias("asks"),
        count_matches("text", "!").alias("shouts"))

    def rate(value: str, side: Column, n: str) -> Column:
        return F.sum(F.when(side, F.col(value)).otherwise(0)).alias(f"_{value}_{n}")

    sums = [rate(v, s, n) for n, s in (("user", mine), ("contact", theirs))
            for v in ("length", "emoji", "slang", "asks", "shouts")]
    g = rows.groupBy(*PERSON).agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(mine).alias("user_messages"),
        F.count_if(theirs).alias("contact_messages"),
        F.min("at").alias("first_date"), F.max("at").alias("last_date"),
        F.min_by("sender_name", F.when(theirs, F.col("seq"))).alias("contact_name"), *sums)
    g = g.filter((F.col("messages") >= 3) & (F.col("user_messages") >= 2)
                 & (F.col("contact_messages") >= 2))

    def per(value: str, side: str) -> Column:
        return F.col(f"_{value}_{side}") / F.col(f"{side}_messages")

    intimacy = clamp01((per("emoji", "user") * 2 + per("slang", "user") * 2
                        + per("shouts", "user")) / 5)
    relation = (
        F.when((F.col("intimacy") > 0.6) & (F.col("user_slang_rate") > 0.3), "close_friend")
        .when((F.col("intimacy") > 0.4) | (F.col("user_slang_rate") > 0.2), "friend")
        .when((F.col("user_avg_length") > 100) & (F.col("user_question_rate") > 0.5), "professional")
        .when(F.col("intimacy") > 0.3, "acquaintance").otherwise("unknown"))
    return g.select(
        *PERSON, F.coalesce("contact_name", F.lit("Unknown")).alias("contact_name"),
        "messages", "user_messages", "contact_messages", "first_date", "last_date",
        intimacy.alias("intimacy"),
        per("length", "user").alias("user_avg_length"), per("emoji", "user").alias("user_emoji_rate"),
        per("slang", "user").alias("user_slang_rate"), per("asks", "user").alias("user_question_rate"),
        per("shouts", "user").alias("user_exclamation_rate"),
        per("length", "contact").alias("contact_avg_length"),
        per("emoji", "contact").alias("contact_emoji_rate"),
        per("slang", "contact").alias("contact_slang_rate"),
    ).withColumn("relation", relation)


# --- Topics of a contact ---------------------------------------------------------------------------

def contact_topics(messages: DataFrame, k: int = 25, min_length: int = 4) -> DataFrame:
    """Most used words with a contact, and when each was last used."""
    words = messages.select(*PERSON, "created_at", F.explode(tokens("text")).alias("topic"))
    kept = words.filter((F.length("topic") >= min_length) & ~F.col("topic").isin(*TOPIC_STOP_WORDS))
    counted = kept.groupBy(*PERSON, "topic").agg(
        F.count(F.lit(1)).alias("count"), F.max("created_at").alias("last_mentioned"))
    return top_k(counted, PERSON, [F.desc("count"), F.asc("topic")], k)


def topic_quotes(topics: DataFrame, messages: DataFrame, n: int = 2) -> DataFrame:
    """The latest messages containing each topic. A contact's topics (25 at most) join as a list."""
    lists = topics.groupBy(*PERSON).agg(F.collect_list("topic").alias("topics"))
    lined = messages.select(*PERSON, "created_at", "seq", "is_user_message",
                            one_line(F.coalesce("text", F.lit(""))).alias("said"))
    hit = (
        lined.filter(F.col("said") != "").join(lists, PERSON)
        .withColumn("low", F.lower("said"))
        .select(*PERSON, "created_at", "seq", "is_user_message", clip("said", 160).alias("said"),
                F.explode(F.filter("topics", lambda x: F.contains(F.col("low"), x))).alias("topic"))
    )
    best = top_k(hit, [*PERSON, "topic"], [F.desc_nulls_last("created_at"), F.desc("seq")], n)
    who = F.when(F.col("is_user_message"), "Me").otherwise("Them")
    return best.withColumn("quote", F.concat(
        F.lit("["), iso_seconds("created_at"), F.lit("] "), who, F.lit(": "), "said"))


# --- Months and last messages ----------------------------------------------------------------------

def month_evidence(messages: DataFrame, first: int = 5, last: int = 5, longest: int = 10
                   ) -> DataFrame:
    """First, last and longest messages of each contact's months, without repeats."""
    rows = messages.withColumn("month", F.coalesce(F.date_format("created_at", "yyyy-MM"),
                                                   F.lit("unknown")))
    picked = first_last_longest(
        rows, [*PERSON, "month"], ["created_at", "seq"], F.length("text"), first, last, longest)
    return keep_first(
        picked.withColumn("_key", F.concat_ws("::", iso("created_at"), clip("text", 80))),
        [*PERSON, "month", "_key"], [F.asc("picked")]).drop("_key")


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last messages with each contact, by time, undated first."""
    return top_k(messages, PERSON, [F.desc_nulls_last("created_at"), F.desc("seq")], n)


def conversation_texts(messages: DataFrame, n: int = 30, min_messages: int = 5,
                       min_chars: int = 100) -> DataFrame:
    """The last messages with a contact as one text, for contacts with enough of them."""
    enough = messages.groupBy(*PERSON).agg(
        F.count(F.lit(1)).alias("messages")).filter(F.col("messages") >= min_messages)
    line = F.concat(F.lit("["), F.coalesce(iso("created_at"), F.lit("unknown")), F.lit("] "),
                    F.when(F.col("is_user_message"), "Me").otherwise(F.col("contact")),
                    F.lit(": "), "text")
    tail = last_messages(messages, n).withColumn("line", line)
    joined = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "line"))),
        lambda s: s["line"]), "\n")
    return (
        tail.groupBy(*PERSON).agg(joined.alias("conversation"), F.max("created_at").alias("last_at"))
        .join(enough, PERSON, "left_semi").filter(F.length("conversation") >= min_chars)
    )
