"""Routing of questions, and the answers that counting can give."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.functions import questions as ask
from keepsake.functions.lexicons import (
    COMPARE_NEGATIVE, COMPARE_POSITIVE, TREND_NEGATIVE, TREND_POSITIVE,
)
from keepsake.functions.text import (
    any_word, bounded, hits, person_slug, phrase_variants, pieces_of, snippet, strip, tokens,
)
from keepsake.functions.times import in_timeframe, in_window, quarter_key
from keepsake.operators import term_scan
from keepsake.operators.ranking import (
    MAX_OWNERS, bounded_lists, broadcast_if_small, keep_first, top_counts, top_k,
)
from keepsake.operators.retrieval import ASK, blank_terms, matched, matching, with_terms
from keepsake.operators.term_index import TermIndex

OWNER = ["owner_id"]
# Lists of 500 periods: 200 of them stay within some megabytes.
MAX_LISTS = 200
# Phrases that every text of their owner is tested with.
MAX_PHRASES = 1000
# A word of a plain text, and what lies between.
_RUN, _NOT_RUN = re.compile("[a-z0-9_]+"), re.compile("[^A-Za-z0-9_]+")


def routed(questions: DataFrame, now: Column) -> DataFrame:
    """Questions with their intent and everything the routes need."""
    return (
        questions.withColumn("intent", ask.intent("question"))
        .withColumn("confidence", ask.intent_confidence("intent"))
        .withColumn("phrase", ask.asked_phrase("question"))
        .withColumn("timeframe", ask.timeframe("question", now))
        .withColumn("topics", ask.compared_topics("question"))
        .withColumn("change_topic", ask.changed_topic("question"))
    )


def window_bounds(tables: Sequence[DataFrame], days: int) -> DataFrame:
    """Lower bound per owner: newest date over the tables minus a number of days, one at least."""
    dates = None
    for t in tables:
        part = t.select("owner_id", "created_at")
        dates = part if dates is None else dates.unionByName(part)
    return dates.groupBy("owner_id").agg(
        (F.max("created_at") - F.make_dt_interval(F.lit(max(1, days)))).alias("lower_bound"))


def in_recent_window(rows: DataFrame, bounds: DataFrame, upper: Column | None = None) -> DataFrame:
    """Rows since their owner's lower bound; undated rows pass."""
    return (
        rows.join(broadcast_if_small(bounds, MAX_OWNERS), OWNER, "left")
        .filter(in_window("created_at", F.col("lower_bound"), upper)).drop("lower_bound")
    )


def contact_pieces(contacts: DataFrame) -> DataFrame:
    """The pieces of text that name a contact, each with its best contact."""
    name = F.col("contact")
    parts = F.filter(F.split(name, r"[_\s]+"), lambda p: F.length(p) >= 3)

    def keyed(priority: int, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(
            F.lit(priority).alias("priority"), F.lower(v).alias("piece")))

    keys = contacts.select("owner_id", "contact", "seq", F.explode(F.concat(
        keyed(0, F.array(name, person_slug(name))), keyed(1, parts))).alias("k")).select(
        "owner_id", "contact", "seq", "k.priority", "k.piece").filter("piece <> ''")
    # The best contact of a question is the best of one of its pieces: a part that many names share keeps one of them.
    return keep_first(keys, ["owner_id", "piece"], [F.asc("priority"), F.asc("seq")])


def named_contacts(questions: DataFrame, contacts: DataFrame) -> DataFrame:
    """The contact a question names: the full name or its slug, else a part of three or more letters.

    "Contains" is turned round: the substrings of a question that are as long as some name of its owner are listed
    and equi-joined with the names, so no question meets a name it does not contain, and a question lists a few dozen
    pieces a character however long it is.
    """
    keys = contact_pieces(contacts)
    # Distinct lengths of names: a few dozen numbers an owner.
    lengths = keys.groupBy("owner_id").agg(F.collect_set(F.length("piece")).alias("lengths"))
    pieces = questions.join(lengths, "owner_id").select(
        *ASK, F.explode(pieces_of(F.lower("question"), F.col("lengths"))).alias("piece"))
    hit = pieces.join(keys, ["owner_id", "piece"]).select(*ASK, "contact", "seq", "priority")
    return keep_first(hit, ASK, [F.asc("priority"), F.asc("seq")]).select(*ASK, "contact", "priority")


# --- Phrase counts -----------------------------------------------------------------------------------

def phrase_matches(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Texts containing a phrase or one of its variants. ``asked`` has a ``phrase``.

    Few phrases are sent to the texts: each text is tested with those of its owner where it is read, and is neither stored,
    shuffled nor repeated. Beyond ``MAX_PHRASES`` an index finds them.
    """
    requests = phrase_terms(asked)
    few = requests.limit(MAX_PHRASES + 1).collect()
    if len(few) > MAX_PHRASES:
        texts = rows.withColumn("low", F.lower("text"))
        return matching(texts, requests).drop("low", "hits")
    numbers = rows.sparkSession.createDataFrame([(n, r.question_id) for n, r in enumerate(few)], T.StructType([
        T.StructField("_number", T.IntegerType()), requests.schema["question_id"]]))
    return (
        rows.withColumn("_number", F.explode(_phrases_held(few)("owner_id", F.lower("text"))))
        .join(F.broadcast(numbers), "_number").select(*rows.columns, "question_id")
    )


def _phrases_held(few: Sequence[Row]) -> Callable[..., Column]:
    """(owner, text): numbers of the owner's requests with a term in the text; a term of white space only counts for none."""
    asked: dict[str, list[tuple[int, list[str]]]] = {}
    for n, r in enumerate(few):
        if r.owner_id is not None:
            asked.setdefault(r.owner_id, []).append((n, [t for t in r.terms if t.strip(" \t\n\x0b\f\r")]))

    # Searching strings is what Python does some twenty times faster than the contains of a column.
    @F.pandas_udf("array<int>")
    def held(owners: pd.Series, lows: pd.Series) -> pd.Series:
        return pd.Series([[] if low is None else [n for n, terms in asked.get(owner, ()) if any(t in low for t in terms)]
                          for owner, low in zip(owners, lows)], dtype=object)

    return held


def phrase_terms(asked: DataFrame) -> DataFrame:
    """Requests for a phrase or one of its variants."""
    return with_terms(asked.filter(strip("phrase") != ""), F.filter(phrase_variants("phrase"), lambda v: v != ""))


def phrase_frequency(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Matches, all items, share in percent, first and last date per asked phrase."""
    found = phrase_matches(rows, asked).groupBy(*ASK).agg(
        F.count(F.lit(1)).alias("matches"), F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"))
    total = rows.groupBy("owner_id").agg(F.count(F.lit(1)).alias("total_items"))
    out = (
        asked.filter(strip("phrase") != "").select(*ASK, "phrase").join(found, ASK, "left")
        .join(total, OWNER, "left").na.fill(0, ["matches", "total_items"])
    )
    share = F.col("matches") / F.greatest(F.lit(1), F.col("total_items")) * 100
    return out.withColumn("share_percent", F.round(share, 1))


def _plain_words(text: Column | str) -> Column:
    """Runs of ASCII letters, digits and underscores in lower case, with a blank before and after each.

    Only ASCII letters are folded, as by the patterns; a text without a run is one blank, which every text contains.
    """
    runs = F.regexp_replace(text, "[^A-Za-z0-9_]+", " ")
    return F.lower(F.concat(F.lit(" "), F.btrim(runs, F.lit(" ")), F.when(
        F.btrim(runs, F.lit(" ")) != "", " ").otherwise("")))


def lexical_hits(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Texts with whole-word occurrences of a quoted phrase: how many, and where the first is.

    A text is tested with the pattern only if its words, with a blank between each, contain those of the phrase.
    """
    words = tokens("phrase")
    plain = F.array_join("words", " ")
    liars = plain.isin("not gonna lie", "not going to lie")
    forms = F.concat(F.array(F.col("words")), F.when(liars, F.array(
        F.array(F.lit("ngl")), F.split(F.lit("not gon na lie"), " "))).otherwise(
        F.array().cast("array<array<string>>")))
    edge_a, edge_b = bounded(r"\b"), bounded(r"\b")
    patterns = F.transform(F.col("forms"), lambda w: F.struct(w.alias("words"), F.concat(
        F.lit("(?i)" + edge_a), F.array_join(w, "[^A-Za-z0-9_]+"), F.lit(edge_b)).alias("pattern"),
        _plain_words(F.array_join(w, " ")).alias("plain")))
    forms = asked.withColumn("words", words).filter(F.size("words") > 0).withColumn("forms", forms).withColumn(
        "forms", patterns)
    found = _forms_found(rows, forms.select(*ASK, "forms"))
    if found is None:
        # Every occurrence of a form holds its longest word.
        longest = F.transform("forms", lambda f: F.array_max(F.transform(f["words"], lambda w: F.struct(
            F.length(w).alias("n"), w.alias("w"))))["w"])
        texts = rows.withColumn("low", F.lower("text")).withColumn("plain", _plain_words("text"))
        found = TermIndex(texts, OWNER).holding(forms, longest, "forms").filter(
            F.exists("forms", lambda f: F.contains("plain", f["plain"]))).select(*rows.columns, "question_id", "forms")
    found = found.withColumn("occurrences", F.aggregate("forms", F.lit(0).cast("long"), lambda a, f: a + F.regexp_count(
        "text", f["pattern"]))).filter(F.col("occurrences") > 0)
    first = F.filter(F.transform("forms", lambda f: F.regexp_instr("text", f["pattern"])), lambda at: at > 0)
    return found.withColumn("snippet", snippet("text", F.get(first, 0) - 1, 90, 220)).drop("forms")


def _forms_found(rows: DataFrame, forms: DataFrame) -> DataFrame | None:
    """Texts with the requests of their owner of which a form's words follow each other in them; none if the requests are many.

    A text is tested where it is read, and is neither stored nor shuffled: only forms whose first word it has are looked for.
    """
    few = forms.limit(term_scan.MAX_REQUESTS + 1).collect()
    if len(few) > term_scan.MAX_REQUESTS:
        return None
    # By owner and first word: number and words of each form. A form without a word is in every text.
    asked: dict[str, dict[str, list[tuple[int, str]]]] = {}
    for n, r in enumerate(few):
        if r.owner_id is not None and r.question_id is not None:
            for f in r.forms:
                asked.setdefault(r.owner_id, {}).setdefault(next(iter(f["plain"].split()), ""), []).append((n, f["plain"]))

    @F.pandas_udf("array<int>")
    def held(owners: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for owner, text in zip(owners, texts):
            first = asked.get(owner)
            if first is None or text is None:
                out.append([])
                continue
            words = _RUN.findall(text.lower() if text.isascii() else _NOT_RUN.sub(" ", text).lower())
            plain = f" {' '.join(words)} "
            out.append(sorted({n for w in first.keys() & {"", *words} for n, form in first[w] if w == "" or form in plain}))
        return pd.Series(out, dtype=object)

    numbers = rows.sparkSession.createDataFrame([(n, r.question_id, r.forms) for n, r in enumerate(few)], T.StructType([
        T.StructField("_number", T.IntegerType()), forms.schema["question_id"], forms.schema["forms"]]))
    return (
        rows.withColumn("_number", F.explode(held("owner_id", "text")))
        .join(F.broadcast(numbers), "_number").select(*rows.columns, "question_id", "forms")
    )


def lexical_counts(hit: DataFrame) -> DataFrame:
    return hit.groupBy(*ASK).agg(F.sum("occurrences").alias("total_matches"),
                                 F.count(F.lit(1)).alias("matched_items"))


def lexical_examples(hit: DataFrame, k: int = 6) -> DataFrame:
    return top_k(hit, ASK, [F.desc(F.coalesce("score", F.lit(0.0))), F.asc("place"), F.asc("seq")], k)


# --- Time, comparison, change ---------------------------------------------------------------------------

def time_period_rows(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Texts inside the asked period. Periods of an owner's questions are few, so they come as a list."""
    flat = asked.select(*ASK, "timeframe.start", "timeframe.end")
    periods = broadcast_if_small(bounded_lists(
        flat, OWNER, ["question_id", "start", "end"], "periods"), MAX_LISTS)
    fits = F.filter("periods", lambda p: in_timeframe("created_at", p["start"], p["end"]))
    return (
        rows.join(periods, OWNER).withColumn("_p", F.explode(fits))
        .select(*rows.columns, "_p.question_id")
    )


def time_period_summary(rows: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """Items in the period and the most active communities."""
    inside = time_period_rows(
        rows.select("owner_id", "created_at", F.coalesce("subreddit", F.lit("unknown"))
                    .alias("community")), asked)
    counted = inside.groupBy(*ASK).agg(F.count(F.lit(1)).alias("items"))
    best = top_counts(inside, ASK, "community", k)
    listed = best.groupBy(*ASK).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "community"))),
        lambda s: F.concat(F.lit("r/"), s["community"])), ", ").alias("communities"))
    return counted.join(listed, ASK)


def compare_sentiment(low: Column) -> Column:
    """Positive minus negative words contained."""
    return hits(low, COMPARE_POSITIVE) - hits(low, COMPARE_NEGATIVE)


def trend_sentiment(low: Column) -> Column:
    """One up for any positive word, one down for any negative word."""
    return (low.rlike(any_word(TREND_POSITIVE)).cast("int")
            - low.rlike(any_word(TREND_NEGATIVE)).cast("int"))


def comparison(comments: DataFrame, asked: DataFrame, k: int = 8) -> DataFrame:
    """Items and sentiment of each side. ``asked`` has two ``topics``."""
    sides = asked.filter(F.size("topics") >= 2).select(
        *ASK, F.posexplode(F.slice("topics", 1, 2)).alias("side", "topic"))
    # A side is a request of its own.
    keyed = sides.withColumn("question_id", F.struct("question_id", "side"))
    low = F.lower(F.coalesce("body", F.lit("")))
    index = TermIndex(comments.select("owner_id", "seq", low.alias("low")), OWNER)
    hit = matched(index, with_terms(keyed, blank_terms("topic")), ["seq"])
    best = index.fetch(top_k(hit, ASK, [F.desc("hits"), F.asc("seq")], k), "low")
    scored = best.groupBy(*ASK).agg(
        F.count(F.lit(1)).alias("items"), F.sum(compare_sentiment(F.col("low"))).alias("score"))
    out = keyed.join(scored, ASK, "left").na.fill(0, ["items", "score"])
    label = (F.when(F.col("score") > 0, "positive").when(F.col("score") < 0, "negative")
             .otherwise("neutral"))
    return out.select("owner_id", "question_id.question_id", "question_id.side", "topic", "items",
                      label.alias("sentiment"))


def evolution_rows(comments: DataFrame, asked: DataFrame) -> DataFrame:
    """Dated comments about a topic with their quarter and sentiment."""
    low = F.lower(F.coalesce("body", F.lit("")))
    # A text's sentiment does not depend on the topic: it is taken once, and its number goes with each topic.
    texts = comments.filter(F.col("created_at").isNotNull()).select(
        "owner_id", "seq", "id", quarter_key("created_at").alias("quarter"), low.alias("low")).withColumn(
        "sentiment", trend_sentiment(F.col("low")))
    return matched(TermIndex(texts, OWNER), with_terms(asked.filter(strip("topic") != ""), blank_terms("topic")),
                   ["seq", "id", "quarter", "sentiment"]).drop("_row")


def evolution(rows: DataFrame, last: int = 8) -> DataFrame:
    """Mean sentiment of the last quarters."""
    quarters = rows.groupBy(*ASK, "quarter").agg(
        F.count(F.lit(1)).alias("items"), F.avg("sentiment").alias("sentiment"))
    return top_k(quarters, ASK, [F.desc("quarter")], last)


def evolution_examples(rows: DataFrame, last: int = 8, n: int = 2) -> DataFrame:
    """The first examples of each of the last quarters, best matches first."""
    kept = rows.join(evolution(rows, last).select(*ASK, "quarter"), [*ASK, "quarter"], "left_semi")
    return top_k(kept, [*ASK, "quarter"], [F.desc("hits"), F.asc("seq")], n)


def citation_stats(cited: DataFrame) -> DataFrame:
    """Well-liked citations and distinct communities of each answer."""
    return cited.groupBy(*ASK).agg(
        F.count_if(F.coalesce("score", F.lit(0.0)) > 5).alias("high"),
        F.countDistinct(F.coalesce("subreddit", F.lit("unknown"))).alias("communities"))


def citations_per_year(cited: DataFrame) -> DataFrame:
    """Citations by year; undated ones under 0."""
    year = F.coalesce(F.year("created_at"), F.lit(0)).cast("long")
    return cited.groupBy(*ASK, year.alias("year")).agg(F.count(F.lit(1)).alias("citations"))
