"""Ranked retrieval for a batch of requests.

A request holds an owner, a topic and its terms. Every route scores a text as *base + bonus*: the base
does not depend on the request and a text without any of the terms has no bonus. So the best k texts
of a request lie among (a) the texts that contain a term and (b) the k best texts by base alone:
whatever is outside both has k texts above it. Only these candidates are formed: (a) comes from an index
over words, so requests and texts are never paired off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.lexicons import QUESTION_STOP_WORDS, TOPIC_STOP_WORDS
from keepsake.functions.text import (
    clip, dedupe_text, hits_of, length_score, person_letters, recency_score, snippet, squeeze, strip,
    token_estimate, tokens, word_count,
)
from keepsake.functions.times import day_key
from keepsake.operators.clusters import message_class, with_classes
from keepsake.operators.contacts import events_with, match_names
from keepsake.operators.corpus import titled
from keepsake.operators.ranking import dedupe_ranked, keep_first, top_k, within_budget
from keepsake.operators.term_index import TermIndex, stored, with_blanks

OWNER = ["owner_id"]
ASK = ["owner_id", "question_id"]
# Names with a person asked for that travel to every task.
MAX_FITTING = 100_000


# --- Requests --------------------------------------------------------------------------------------

def word_terms(topic: Column | str, min_length: int = 3, stop_words: Sequence[str] = (),
               distinct: bool = False) -> Column:
    """ASCII words of a topic."""
    kept = F.filter(tokens(topic), lambda w: (F.length(w) >= min_length)
                    & (~w.isin(*stop_words) if stop_words else F.lit(True)))
    return F.array_distinct(kept) if distinct else kept


def blank_terms(topic: Column | str, min_length: int = 3) -> Column:
    """Pieces of a topic between white space."""
    c = F.col(topic) if isinstance(topic, str) else topic
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) >= min_length)


def with_terms(requests: DataFrame, terms: Column, *keep: str) -> DataFrame:
    return requests.select(*ASK, *keep, terms.alias("terms"))


def matching(texts: DataFrame, requests: DataFrame, group: Sequence[str] = OWNER) -> DataFrame:
    """Texts that contain at least one term of a request, with the number of terms; those of white space only do not count.

    ``texts`` carries the lower-cased text as ``low``.
    """
    return matches(TermIndex(texts, group), requests).drop("_row")


def matches(index: TermIndex, requests: DataFrame) -> DataFrame:
    """The same for texts that are indexed already, with their numbers."""
    asked = requests.withColumn("phrases", with_blanks(F.col("terms")))
    found = index.found(asked, F.col("terms"), "phrases")
    hits = F.col("sure") + F.when(F.size("phrases") > 0, hits_of(F.col("low"), F.col("phrases"))).otherwise(0)
    return found.withColumn("hits", hits.cast("int")).filter(F.col("hits") > 0).drop("phrases", "sure")


def candidates(index: TermIndex, requests: DataFrame, columns: Sequence[str], order: Sequence[Column], k: int,
               key: str | None = None, within: Sequence[str] = (), reach: DataFrame | None = None,
               keep: Sequence[str] = ()) -> DataFrame:
    """Matching texts, and the k best of the group by ``order`` for requests they do not match, as numbers with ``columns``.

    Where repeats drop out before the limit, ``key`` names the column that makes a repeat: then the best text of
    each of the k best keys is kept. ``within`` splits the group where a bonus depends on it. ``reach`` holds the numbers
    of the texts that a ``target`` reaches, for requests that name one. ``keep`` are columns of the requests.
    """
    hit = matched(index, requests, columns, reach, keep)
    return hit.unionByName(idle(index, requests, columns, order, k, key, within, reach=reach, keep=keep))


def matched(index: TermIndex, requests: DataFrame, columns: Sequence[str], reach: DataFrame | None = None,
            keep: Sequence[str] = ()) -> DataFrame:
    """Numbers of matching texts with some of their columns."""
    if reach is None:
        few = index.scanned(requests, F.col("terms"), columns, keep)
        if few is not None:
            return few.filter(F.col("sure") > 0).select(*ASK, *keep, "_row", F.col("sure").cast("int").alias("hits"), *columns)
        hit = index.counted(requests, *keep)
    else:
        hit = index.counted(requests, *dict.fromkeys(["target", *keep])).join(reach.select("_row", "target"), ["_row", "target"])
    return hit.join(index.rows.select("_row", *columns), "_row").select(*ASK, *keep, "_row", "hits", *columns)


def idle(index: TermIndex, requests: DataFrame, columns: Sequence[str], order: Sequence[Column], k: int,
         key: str | None = None, within: Sequence[str] = (), some: Column | None = None,
         reach: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The k best of the group by ``order`` (among ``some``) for requests they do not match."""
    group = [*OWNER] if reach is None else [*OWNER, "target"]
    pool, heads = index.slim(*columns), [*group, *within]
    if reach is not None:
        pool = pool.join(reach.select("_row", "target"), "_row")
    if some is not None:
        pool = pool.filter(some)
    if key is not None:
        pool = keep_first(pool, [*heads, key], order)
    head = index.fetch(top_k(pool, heads, order, k, rank="_base_rank").drop("_base_rank").withColumn(
        "_at", F.col("_row")), "low").withColumnRenamed("_at", "_row")
    return (
        head.join(requests.select(*group, "question_id", "terms", *[c for c in keep if c not in group]), group)
        .withColumn("hits", hits_of(F.col("low"), F.filter("terms", lambda t: t.rlike(r"\S")))).filter(F.col("hits") == 0)
        .select(*ASK, *keep, "_row", "hits", *columns)
    )


def rising(column: str) -> Column:
    """A whole number as it is ordered: null first."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63)))


def latest(column: str) -> Column:
    """A time as a number that is smaller the later it is; null last."""
    return F.coalesce(-F.unix_micros(column), F.lit((1 << 63) - 1))


def best_candidates(index: TermIndex, requests: DataFrame, columns: Sequence[str], ties: Sequence[Column], k: int, weight: float,
                    key: str | None = None, every: bool = True, hits_first: bool = False) -> DataFrame | None:
    """Candidates by hits times ``weight`` plus ``base``, then ``ties``: with ``every`` also texts without a hit.

    Each task passes on the k best of each request only; none if the requests are too many for that.
    """
    names = [f"_tie{i}" for i in range(len(ties))]

    def score(hits, _, text, __):
        order = (-(hits * weight + text["base"]), *[text[n] for n in names])
        return (hits == 0, *order) if hits_first else order

    few = index.best(requests, F.col("terms"), k, score, columns, dict(zip(names, ties)), key=key, idle=every)
    if few is not None:
        few = few if every else few.filter(F.col("sure") > 0)
        return few.select(*ASK, "_row", F.col("sure").alias("hits"), *columns)
    return None


def score_column(weight: float, base: str = "base") -> Column:
    return F.col("hits") * F.lit(float(weight)) + F.col(base)


# --- Forum search ----------------------------------------------------------------------------------

KINDS = ("comment", "post", "saved", "upvoted")


def forum_rows(comments: DataFrame, posts: DataFrame, saved: DataFrame | None = None,
               upvoted: DataFrame | None = None) -> DataFrame:
    """Forum tables as one, in search order."""
    def part(df, place, text, score):
        return df.select("owner_id", F.lit(place).alias("place"), "seq", "id", "subreddit",
                         "created_at", text.alias("text"), score.alias("score"))

    none = F.lit(None).cast("double")
    rows = part(comments, 0, F.coalesce("body", F.lit("")), F.col("score")).unionByName(
        part(posts, 1, titled(), F.col("score")))
    for df, place in ((saved, 2), (upvoted, 3)):
        if df is not None:
            rows = rows.unionByName(part(df, place, titled("title", "permalink"), none))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("place") + 1)
    return rows.withColumn("kind", kind)


def search(rows: DataFrame, requests: DataFrame, limit: int = 25) -> DataFrame:
    """Texts containing the whole request, by table and then file order; 1 to 100 results."""
    k = max(1, min(100, limit))
    asked = requests.select(*ASK, F.array(strip(F.lower("topic"))).alias("terms"))
    hit = matching(rows.withColumn("low", F.lower("text")), asked.filter("terms[0] <> ''"))
    best = top_k(hit, ASK, [F.asc("place"), F.asc("seq")], k)
    first = asked.select(*ASK, F.col("terms")[0].alias("needle"))
    return best.join(first, ASK).withColumn(
        "snippet", snippet("text", F.instr("low", F.col("needle")) - 1, 80, 160)
    ).drop("low", "hits", "needle")


def general(rows: DataFrame, requests: DataFrame, k: int = 6) -> DataFrame:
    """Best forum texts: the whole question counts 6, each of its words 3, the votes a little."""
    return general_of(TermIndex(rows, OWNER, "text"), requests, k)


def general_of(index: TermIndex, requests: DataFrame, k: int = 6) -> DataFrame:
    """The same for forum texts that are numbered already."""
    votes = F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))) * 0.01
    scored = _question_best(index, requests, 6, 3, k, ["place", "seq"], votes)
    if scored is None:
        scored = _question_hits(index, requests, 6, 3).select(*ASK, "_row", "place", "seq", "points", votes.alias("_votes"))
    scored = scored.withColumn("score", F.col("points") + F.col("_votes")).drop("_votes")
    best = top_k(scored, ASK, [F.desc("score"), F.asc("place"), F.asc("seq")], k)
    return _with_hit_snippet(index.fetch(best, *[
        c for c in index.columns if c not in ("owner_id", "place", "seq", "score")]), requests)


def message_hits(events: DataFrame, requests: DataFrame, k: int | None = None) -> DataFrame:
    """Every message that contains the question (8) or its words (4 each), in file order; or the k best of a request."""
    texts = (
        events.filter(F.col("source") == "sms")
        .select("owner_id", "seq", "created_at", "participants", "is_user_message",
                strip(F.coalesce("text", F.lit(""))).alias("text"))
        .filter(F.col("text") != "")
    )
    index = TermIndex(texts, OWNER, "text")
    if k is None:
        found = _question_hits(index, requests, 8, 4).drop("_row")
    else:
        few = _question_best(index, requests, 8, 4, k, ["seq"], F.lit(0.0))
        if few is None:
            few = _question_hits(index, requests, 8, 4).select(*ASK, "_row", "seq", "points")
        best = top_k(few.select(*ASK, "_row", "seq", "points"), ASK, [F.desc("points"), F.asc("seq")], k)
        found = index.fetch(best, *[c for c in index.columns if c not in ("owner_id", "seq")])
    out = _with_hit_snippet(found, requests)
    who = F.when(F.col("is_user_message"), "Me").otherwise("Them")
    return out.withColumn("snippet", F.concat(
        F.lit("[SMS "), who, F.lit(" to "), F.array_join("participants", ", "), F.lit("] "),
        "snippet")).withColumnRenamed("points", "score")


def _asked_words(requests: DataFrame) -> DataFrame:
    phrase = strip(F.lower("topic"))
    asked = requests.select(*ASK, phrase.alias("phrase"), word_terms(
        "topic", 3, QUESTION_STOP_WORDS, distinct=True).alias("terms"))
    return asked.filter(F.length("phrase") >= 2)


def _question_best(index: TermIndex, requests: DataFrame, whole: int, each: int, k: int, places: Sequence[str], votes: Column
                   ) -> DataFrame | None:
    """The k best of each task by points plus ``votes``, then ``places``; none if the requests are many."""
    def score(hits, said, text, _):
        return (-(whole * said + each * hits + text["_votes"]), *[text[f"_{p}"] for p in places])

    rows = index.rows.withColumn("_votes", votes)
    ties = {f"_{p}": rising(p) for p in places}
    few = index.over(rows).best(_asked_words(requests), F.col("terms"), k, score, [*places, "_votes"], ties, also=F.array("phrase"))
    if few is None:
        return None
    points = F.col("said").cast("int") * whole + F.col("sure") * each
    return few.select(*ASK, "_row", *places, points.cast("int").alias("points"), "_votes")


def _question_hits(index: TermIndex, requests: DataFrame, whole: int, each: int) -> DataFrame:
    few = index.scanned(_asked_words(requests), F.col("terms"), index.columns, ["phrase"], F.array("phrase"))
    if few is not None:
        points = F.col("said").cast("int") * whole + F.col("sure") * each
        return few.select(*index.columns, "_row", "question_id", points.cast("int").alias("points"))
    found = index.found(_asked_words(requests), F.col("terms"), "phrase", also=F.array("phrase"))
    points = F.contains("low", F.col("phrase")).cast("int") * whole + F.col("sure") * each
    return found.withColumn("points", points.cast("int")).filter(F.col("points") > 0).drop("phrase", "sure")


def _with_hit_snippet(best: DataFrame, requests: DataFrame) -> DataFrame:
    """Snippet at the whole question, else at its first word."""
    joined = best.join(_asked_words(requests), ASK)
    whole = F.instr("low", F.col("phrase"))
    word = F.instr("low", F.coalesce(F.try_element_at("terms", F.lit(1)), F.lit("")))
    at = F.greatest(F.lit(0), F.when(whole > 0, whole).otherwise(word) - 1)
    return joined.withColumn("snippet", snippet("text", at, 80, 160)).drop("low", "phrase", "terms")


def relevant_comments(comments: DataFrame, requests: DataFrame, k: int | None = None) -> DataFrame:
    """Comments by the number of topic words they contain; all of them without k."""
    texts = comments.select("owner_id", "id", "seq", "subreddit", "created_at", "score",
                            F.coalesce("body", F.lit("")).alias("text"))
    asked = with_terms(requests, blank_terms("topic"))
    index = TermIndex(texts, OWNER, "text")
    rest = [c for c in texts.columns if c not in ("owner_id", "seq")]
    if k is None:
        return matched(index, asked, ["seq", *rest]).drop("_row")
    return index.fetch(top_k(matched(index, asked, ["seq"]), ASK, [F.desc("hits"), F.asc("seq")], k), *rest)


# --- Examples of the owner's writing -----------------------------------------------------------------

def _forum_texts(comments: DataFrame, posts: DataFrame) -> DataFrame:
    rows = forum_rows(comments, posts).withColumn("text", strip("text"))
    return rows.withColumn("votes", F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))))


def write_examples(comments: DataFrame, posts: DataFrame, requests: DataFrame, k: int = 15
                   ) -> DataFrame:
    """Relevant, short and any examples, in this order, without repeats."""
    pool = _forum_texts(comments, posts).filter(F.length("text") >= 10)
    clipped = F.when(F.length("text") > 500, F.concat(clip("text", 500), F.lit("...")))
    pool = (
        pool.select("owner_id", "place", "seq", "votes",
                    F.coalesce(clipped, F.col("text")).alias("example"))
        .withColumn("low", F.lower("example")).withColumn("words", word_count("example"))
    )
    by_words = (F.when(F.col("words") < 50, 10.0).when(F.col("words") < 100, 5.0)
                .otherwise(F.least(F.lit(3.0), F.lit(300.0) / F.col("words"))))
    pool = pool.withColumn("base", by_words + F.col("votes") * 0.02)
    asked = with_terms(requests, word_terms("topic"))
    ties = [F.asc("place"), F.asc("seq")]
    order = [F.desc(F.col("hits") > 0), F.desc("score"), *ties]
    base_order = [F.desc("base"), *ties]

    index = TermIndex(pool.withColumn("brief", F.col("words") < 80), OWNER)
    columns = ["place", "seq", "base", "brief"]
    # The best of either length hold the best of all, so matches are ranked in one pass.
    hit = matched(index, asked, columns).withColumn("score", score_column(12))
    head = stored(top_k(hit, [*ASK, "brief"], order, 8).drop("rank"), "head")
    every = head.unionByName(idle(index, asked, columns, base_order, 4).withColumn("score", score_column(12)))
    brief = F.col("brief")
    short = head.filter(brief).unionByName(
        idle(index, asked, columns, base_order, 6, some=brief).withColumn("score", score_column(12)))
    relevant = top_k(head, ASK, order, 8)
    typical = top_k(short, ASK, order, 6).withColumn("rank", F.col("rank") + 8)
    longer = top_k(every, ASK, order, 4).withColumn("rank", F.col("rank") + 14)
    picked = relevant.unionByName(typical).unionByName(longer).withColumnRenamed("rank", "place_no")
    shown = index.fetch(picked.select(*ASK, "_row", "hits", "place_no"), "example")
    return dedupe_ranked(shown, ASK, dedupe_text("example"), [F.asc("place_no")], k).select(
        *ASK, "rank", "example", "hits")


def cross_platform_examples(events: DataFrame, requests: DataFrame, limit: int = 10,
                            sources: Sequence[str] | None = None) -> DataFrame:
    """Best events of any source; the limit applies before repeats drop out."""
    rows = events if sources is None else events.filter(F.col("source").isin(*sources))
    texts = (
        rows.select("owner_id", "source", "channel", "created_at", "seq",
                    strip(F.coalesce("text", F.lit(""))).alias("text"))
        .filter(F.length("text") >= 20)
        .withColumn("base", F.when(F.col("source") == "reddit", 0.0).otherwise(1.0)
                    + F.least(F.lit(6.0), F.length("text") / 180))
    )
    asked = with_terms(requests, word_terms("topic"))
    index = TermIndex(texts, OWNER, "text")
    scored = best_candidates(index, asked, ["base", "seq"], [rising("seq")], limit, 8)
    if scored is None:
        scored = candidates(index, asked, ["base", "seq"], [F.desc("base"), F.asc("seq")], limit)
    scored = scored.withColumn("score", score_column(8))
    best = index.fetch(top_k(scored, ASK, [F.desc("score"), F.asc("seq")], limit, rank="cut").select(
        *ASK, "_row", "score", "cut"), "source", "channel", "created_at", "text")
    label = F.concat(F.lit("["), "source", F.coalesce(F.concat(F.lit("/"), "channel"), F.lit("")),
                     F.lit("] "), F.coalesce(day_key("created_at"), F.lit("no-date")), F.lit("\n"),
                     clip("text", 500))
    lines = best.withColumn("line", label)
    return dedupe_ranked(lines, ASK, dedupe_text("line"), [F.asc("cut")], limit).select(
        *ASK, "rank", "line", "score")


def _outbound(events: DataFrame, min_length: int, *extra: str) -> DataFrame:
    return (
        events.filter((F.col("source") == "sms") & F.col("is_user_message"))
        .select("owner_id", "seq", "created_at", *extra,
                strip(F.coalesce("text", F.lit(""))).alias("text"))
        .filter(F.length("text") >= min_length)
    )


def message_examples(events: DataFrame, requests: DataFrame, limit: int = 10) -> DataFrame:
    """The owner's own messages; three times the limit is taken before repeats drop out."""
    texts = _outbound(events, 8).withColumn("base", F.least(F.lit(6.0), F.length("text") / 120))
    ties = [F.desc_nulls_last("created_at"), F.asc("seq")]
    cut = max(limit * 3, 24)
    asked = with_terms(requests, word_terms("topic"))
    index = TermIndex(texts, OWNER, "text")
    scored = candidates(index, asked, ["base", "created_at", "seq"], [F.desc("base"), *ties], cut).withColumn(
        "score", score_column(10))
    best = index.fetch(top_k(scored, ASK, [F.desc("score"), *ties], cut, rank="cut").select(
        *ASK, "_row", "score", "cut"), "text").withColumn("example", clip("text", 500))
    return dedupe_ranked(best, ASK, dedupe_text("example"), [F.asc("cut")], limit).select(
        *ASK, "rank", "example", "score")


def _outbound_scored(index: TermIndex, asked: DataFrame, most: int, reach: DataFrame | None = None) -> DataFrame:
    ties = [F.desc_nulls_last("created_at"), F.asc("seq")]
    columns = ["base", "created_at", "seq", "_key"]
    scored = None if reach is not None else best_candidates(
        index, asked, columns, [latest("created_at"), rising("seq")], most, 8, "_key", hits_first=True)
    if scored is None:
        scored = candidates(index, asked, columns, [F.desc("base"), *ties], most, "_key", reach=reach)
    scored = scored.withColumn("score", score_column(8))
    order = [F.desc(F.col("hits") > 0), F.desc("score"), *ties]
    return top_k(keep_first(scored, [*ASK, "_key"], order), ASK, order, most).drop("_key", "base")


def outbound_messages(events: DataFrame, requests: DataFrame, now_ms: int, most: int = 200
                      ) -> DataFrame:
    """The owner's messages for a topic, to the person named in the request where there is one.

    ``requests`` may have a ``target`` column; null means everybody.
    """
    example = clip("text", 600)
    texts = (
        _outbound(events, 5, "participants")
        .withColumn("base", length_score(F.length("text")) + recency_score(F.col("created_at"), now_ms, 0.5))
        .withColumn("_key", F.md5(dedupe_text(example)))
    )

    def shown(index: TermIndex, best: DataFrame) -> DataFrame:
        return index.fetch(best, "text").withColumn("example", example).drop("text")

    if "target" not in requests.columns:
        index = TermIndex(texts.drop("participants"), OWNER, "text")
        return shown(index, _outbound_scored(index, with_terms(requests, word_terms("topic")), most))
    index = TermIndex(texts, OWNER, "text")
    asked = with_terms(requests, word_terms("topic"), "target")
    everybody = _outbound_scored(index, asked.filter("target IS NULL"), most)
    named = asked.filter("target IS NOT NULL")
    # A text may be with several of the people asked for: it is indexed once, and its number goes with each.
    reach = events_with(index.slim("participants"), named.select("owner_id", "target").distinct())
    return shown(index, everybody.unionByName(_outbound_scored(index, named, most, reach)))


def outbound_stats(events: DataFrame, requests: DataFrame, ranked: DataFrame) -> DataFrame:
    """Candidates, topic matches and results of each request."""
    texts = _outbound(events, 5)
    asked = with_terms(requests, word_terms("topic"))
    pool = texts.groupBy("owner_id").agg(F.count(F.lit(1)).alias("candidates"))
    matches = TermIndex(texts.select("owner_id", "text"), OWNER, "text").counted(asked).groupBy(*ASK).agg(
        F.count(F.lit(1)).alias("topic_matches"))
    kept = ranked.groupBy(*ASK).agg(F.count(F.lit(1)).alias("after_dedupe"))
    out = requests.select(*ASK).join(pool, OWNER, "left").join(matches, ASK, "left").join(
        kept, ASK, "left")
    return out.na.fill(0, ["candidates", "topic_matches", "after_dedupe"])


def forum_snippets(comments: DataFrame, posts: DataFrame, requests: DataFrame, most: int = 100
                   ) -> DataFrame:
    """Relevant forum texts; twice the limit is taken before repeats drop out."""
    rows = _forum_texts(comments, posts)
    n, post = F.length("text"), F.col("place") == 1
    rows = rows.filter(n >= F.when(post, 30).otherwise(15)).withColumn(
        "base", F.least(F.lit(2.0), n / F.when(post, 500).otherwise(300)) + F.col("votes") * 0.01)
    index = TermIndex(rows.select("owner_id", "place", "seq", "text", "base"), OWNER, "text")
    asked, columns = with_terms(requests, blank_terms("topic")), ["place", "seq", "base"]
    hit = best_candidates(index, asked, columns, [rising("place"), rising("seq")], most * 2, 5, every=False)
    if hit is None:
        hit = matched(index, asked, columns)
    hit = hit.withColumn("score", score_column(5))
    best = index.fetch(top_k(hit, ASK, [F.desc("score"), F.asc("place"), F.asc("seq")], most * 2, rank="cut").select(
        *ASK, "_row", "score", "cut"), "text").withColumn("example", clip("text", 700))
    return dedupe_ranked(best, ASK, dedupe_text("example"), [F.asc("cut")], most).select(
        *ASK, "rank", "example", "score")


def clone_context(comments: DataFrame, posts: DataFrame, requests: DataFrame,
                  locked_at: Column | None = None, k: int = 10) -> DataFrame:
    """Forum texts close to a message, optionally only up to a date; undated texts stay."""
    rows = _forum_texts(comments, posts).filter(F.length("text") >= 40)
    if locked_at is not None:
        rows = rows.filter(F.col("created_at").isNull() | (F.col("created_at") <= locked_at))
    texts = rows.select("owner_id", "place", "seq", "subreddit", "created_at", "votes", "text",
                        F.lower("text").alias("low")).withColumn(
        "base", F.least(F.lit(8.0), F.length("text") / 140) + F.col("votes") * 0.02)
    ties = [F.asc("place"), F.asc("seq")]
    asked = with_terms(requests, word_terms("topic", distinct=True))
    index = TermIndex(texts, OWNER)
    scored = candidates(index, asked, ["base", "place", "seq"], [F.desc("base"), *ties], k).withColumn(
        "relevance", score_column(8))
    return index.fetch(top_k(scored, ASK, [F.desc("relevance"), *ties], k).drop("base"), "subreddit", "created_at", "votes",
                       "text").withColumn("example", clip("text", 900)).drop("text")


def messages_about(events: DataFrame, requests: DataFrame, k: int = 25) -> DataFrame:
    """Messages with a person, those about the topic first. Requests name a ``target``."""
    group = ["owner_id", "target"]
    asked = with_terms(requests, word_terms("topic", 3, TOPIC_STOP_WORDS), "target").filter(
        F.size("terms") > 0)
    sms = events.filter(F.col("source") == "sms").select(
        "owner_id", "seq", "created_at", "participants", "is_user_message",
        F.coalesce("text", F.lit("")).alias("text"))
    index = TermIndex(sms.withColumn("low", F.lower("text")).withColumn(
        "base", F.least(F.lit(0.5), F.length("text") / 6000)), OWNER)
    reach = events_with(index.slim("participants"), asked.select(*group).distinct())
    ties = [F.asc_nulls_first("created_at"), F.asc("seq")]
    scored = candidates(index, asked, ["base", "created_at", "seq"], [F.desc("base"), *ties], k, reach=reach,
                        keep=["target"]).withColumn("score", score_column(1))
    return index.fetch(top_k(scored.filter(F.col("score") > 0), ASK, [F.desc("score"), *ties], k).drop("base"),
                       "participants", "is_user_message", "text")


# --- Class-routed retrieval --------------------------------------------------------------------------

def routed_messages(events: DataFrame, requests: DataFrame, now_ms: int, most: int = 50,
                    min_score: float = 0.5) -> DataFrame:
    """Messages with a person ranked by class, topic, length and recency.

    The class bonus takes one of three values per message class, so the base order is kept per class.
    """
    group = ["owner_id", "target"]
    asked = with_terms(requests, blank_terms("topic"), "target", "preferred").join(
        requests.select(*ASK, message_class("topic").alias("topic_class")), ASK).withColumn(
        "wanted", F.coalesce("preferred", "topic_class")).drop("preferred", "topic_class")
    base = length_score(F.length("text")) + recency_score(F.col("created_at"), now_ms)
    classed = (
        with_classes(events).filter(F.length("text") >= 5)
        .select("owner_id", "seq", "created_at", "participants", "text", "cluster", "_row").withColumn("base", base)
        .withColumn("_key", F.md5(clip(squeeze(F.lower(clip("text", 600))), 100)))
    )
    index = TermIndex(classed, OWNER, "text")
    pairs = _routed_best(index, asked, most)
    ties = [F.asc("seq")]
    if pairs is None:
        # A message may be with several of the people asked for: it is indexed once, and its number goes with each.
        reach = events_with(index.slim("participants"), asked.select(*group).distinct(), person_letters)
        pairs = candidates(index, asked, ["base", "seq", "cluster", "_key"], [F.desc("base"), *ties], most, "_key", ["cluster"],
                           reach, ["wanted"])
    by_class = (F.when(F.col("cluster") == F.col("wanted"), 4.0)
                .when(F.col("cluster") == "other", 1.0).otherwise(0.0))
    scored = pairs.withColumn(
        "score", by_class + F.least(F.lit(3), F.col("hits")) + F.col("base")).filter(
        F.col("score") >= min_score)
    order = [F.desc("score"), *ties]
    best = top_k(keep_first(scored, [*ASK, "_key"], order), ASK, order, most)
    return index.fetch(best, "text").withColumn("example", clip("text", 600)).select(
        *ASK, "rank", "seq", "cluster", "wanted", "score", "example")


def _routed_best(index: TermIndex, asked: DataFrame, most: int) -> DataFrame | None:
    """The best messages of each task for requests to a person; none if the requests or the names they fit are many."""
    names = match_names(index.slim("participants"), asked.select(*OWNER, "target").distinct(), person_letters).limit(
        MAX_FITTING + 1).collect()
    if len(names) > MAX_FITTING:
        return None
    reached: dict[tuple, set] = {}
    for r in names:
        reached.setdefault((r["owner_id"], r["name"]), set()).add(r["target"])

    def fits(text):
        targets = set().union(*[reached.get((text["owner_id"], p), ()) for p in text["participants"] or ()])
        return lambda request: request["target"] in targets

    def score(hits, _, text, request):
        bonus = 4.0 if text["cluster"] == request["wanted"] else 1.0 if text["cluster"] == "other" else 0.0
        return -(bonus + min(3, hits) + text["base"]), text["_seq"]

    few = index.best(asked, F.col("terms"), most, score, ["base", "seq", "cluster", "_key"], {
        "_seq": rising("seq"), "participants": F.col("participants")}, ["target", "wanted"], key="_key", idle=True, fits=fits)
    return None if few is None else few.select(*ASK, "wanted", "_row", F.col("sure").alias("hits"), "base", "seq", "cluster", "_key")


def routed_stats(events: DataFrame, requests: DataFrame, ranked: DataFrame) -> DataFrame:
    """Candidates, class matches, results, and confidence as a raw and a clamped ratio.

    Class matches are counted before repeats drop out, results after, so the ratio may pass 1.
    """
    group = ["owner_id", "target"]
    classed = with_classes(events).select(
        "owner_id", "participants", F.when(F.length("text") >= 5, F.col("cluster")).alias("cluster"))
    # Messages with the same people are counted before they meet the people asked for.
    counted = classed.groupBy("owner_id", "participants", "cluster").agg(F.count(F.lit(1)).alias("n"))
    sized = events_with(counted, requests.select(*group).distinct(), person_letters)
    total = sized.groupBy(*group).agg(F.sum("n").alias("total_candidates"))
    classes = sized.filter("cluster IS NOT NULL").groupBy(*group, "cluster").agg(F.sum("n").alias("cluster_matches"))
    wanted = F.coalesce("preferred", message_class("topic"))
    asked = requests.select(*ASK, "target", wanted.alias("cluster"))
    kept = ranked.groupBy(*ASK).agg(F.count(F.lit(1)).alias("final_count"))
    out = (
        asked.join(total, group, "left").join(classes, [*group, "cluster"], "left")
        .join(kept, ASK, "left")
        .na.fill(0, ["total_candidates", "cluster_matches", "final_count"])
    )
    ratio = F.col("cluster_matches") / F.greatest(F.lit(1), F.col("final_count"))
    return out.withColumn("confidence_raw", ratio).withColumn(
        "confidence", F.least(F.lit(1.0), ratio))


# --- Budget ------------------------------------------------------------------------------------------

# Weight of messages, forum texts and mail per writing mode.
MODE_WEIGHTS = {
    "personal_text": (3, 1, 2), "close_friend": (3, 1, 2), "public_post": (1, 3, 2),
    "professional": (2, 1, 3), "unfiltered_me": (2, 2, 1), "default": (2, 2, 2),
}
BUDGET_SOURCES = ("sms", "reddit", "gmail")


def budget_of(mode: Column, source: Column, max_tokens: int = 25_000) -> Column:
    """Token share of a source in a mode."""
    out = F.lit(None).cast("long")
    for name, weights in MODE_WEIGHTS.items():
        for s, w in zip(BUDGET_SOURCES, weights):
            share = max_tokens * w // sum(weights)
            known = mode == name if name != "default" else ~mode.isin(
                *[m for m in MODE_WEIGHTS if m != "default"])
            out = F.when(known & (source == s), F.lit(share)).otherwise(out)
    return out.cast("long")


def budgeted(examples: DataFrame, max_tokens: int = 25_000) -> DataFrame:
    """Examples in rank order within the token share of their source.

    ``examples``: owner, question, mode, source, rank, example.
    """
    keys = [*ASK, "source"]
    share = budget_of(F.col("mode"), F.col("source"), max_tokens)
    return within_budget(examples, keys, token_estimate("example"), share, [F.asc("rank")],
                         max_tokens)


def write_context(comments: DataFrame, posts: DataFrame, events: DataFrame, requests: DataFrame,
                  now_ms: int, max_tokens: int = 25_000) -> DataFrame:
    """Budgeted examples of every unlocked source. ``requests`` has mode and ``locked`` sources."""
    parts = {
        "sms": outbound_messages(events, requests, now_ms, 300).select(*ASK, "rank", "example"),
        "reddit": forum_snippets(comments, posts, requests, 150).select(*ASK, "rank", "example"),
        "gmail": cross_platform_examples(events, requests, 50, ["gmail"]).select(
            *ASK, "rank", F.col("line").alias("example")),
    }
    rows = None
    for source, df in parts.items():
        part = df.withColumn("source", F.lit(source))
        rows = part if rows is None else rows.unionByName(part)
    meta = requests.select(*ASK, "mode", "locked")
    return budgeted(
        rows.join(meta, ASK).filter(~F.array_contains("locked", F.col("source"))), max_tokens
    ).drop("locked")
