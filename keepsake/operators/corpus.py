"""Word, phrase and link statistics over all texts of an owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.lexicons import KNOWLEDGE_STOP_WORDS, STYLE_STOP_WORDS
from keepsake.functions.text import clip, hosts, strip, tokens
from keepsake.functions.times import hour_of_day
from keepsake.operators.ranking import top_counts


def titled(title: str = "title", body: str = "body") -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))


def all_texts(comments: DataFrame, posts: DataFrame, saved: DataFrame, upvoted: DataFrame,
              events: DataFrame) -> DataFrame:
    """Every text of an owner, whichever table it stands in."""
    def part(df, kind, text):
        return df.select("owner_id", F.lit(kind).alias("kind"), text.alias("text"))

    return (
        part(comments, "comment", F.coalesce("body", F.lit("")))
        .unionByName(part(posts, "post", strip(titled())))
        .unionByName(part(saved, "saved", strip(titled("title", "permalink"))))
        .unionByName(part(upvoted, "upvoted", strip(titled("title", "permalink"))))
        .unionByName(part(events, "timeline", F.coalesce("text", F.lit(""))))
    )


def dated_texts(comments: DataFrame, posts: DataFrame, events: DataFrame,
                tz: str | None = None, most: int | None = None) -> DataFrame:
    """Texts that have a date, with their hour and the place of their table; cut if ``most`` is given."""
    def part(df, place, source, text):
        text = strip(text)
        return df.select("owner_id", source.alias("source"), "created_at", "seq", F.lit(place).alias("place"),
                         text.alias("text"))

    forum = F.lit("reddit")
    rows = (
        part(comments, 0, forum, F.coalesce("body", F.lit("")))
        .unionByName(part(posts, 1, forum, titled()))
        .unionByName(part(events, 2, F.col("source"), F.coalesce("text", F.lit(""))))
    )
    return (
        rows.filter(F.col("created_at").isNotNull() & (F.col("text") != ""))
        .withColumn("text", F.col("text") if most is None else clip("text", most))
        .withColumn("hour", hour_of_day("created_at", tz))
    )


def top_words(texts: DataFrame, k: int = 40, min_length: int = 3,
              stop_words=STYLE_STOP_WORDS) -> DataFrame:
    words = texts.select("owner_id", F.explode(tokens("text")).alias("word"))
    kept = words.filter((F.length("word") >= min_length) & ~F.col("word").isin(*stop_words))
    return top_counts(kept, ["owner_id"], "word", k)


def top_bigrams(texts: DataFrame, k: int = 25, min_length: int = 3) -> DataFrame:
    """Word pairs of two long-enough words that are not both stop words."""
    pairs = (
        texts.select("owner_id", tokens("text").alias("w"))
        .select("owner_id", F.explode(F.arrays_zip(
            F.col("w").alias("a"),
            F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("p"))
        .select("owner_id", "p.a", "p.b").filter(F.col("b").isNotNull())
    )
    stop = [F.col(c).isin(*STYLE_STOP_WORDS) for c in ("a", "b")]
    kept = pairs.filter(
        (F.length("a") >= min_length) & (F.length("b") >= min_length) & ~(stop[0] & stop[1]))
    return top_counts(kept.select("owner_id", F.concat_ws(" ", "a", "b").alias("phrase")),
                      ["owner_id"], "phrase", k)


def top_domains(texts: DataFrame, k: int = 15) -> DataFrame:
    found = texts.select("owner_id", F.explode(hosts("text")).alias("domain"))
    return top_counts(found, ["owner_id"], "domain", k)


def distinct_domains(texts: DataFrame) -> DataFrame:
    found = texts.select("owner_id", F.explode(hosts("text")).alias("domain"))
    return found.groupBy("owner_id").agg(F.countDistinct("domain").alias("domains"))


TIMELINE_TOTALS = {
    "youtube_events": "youtube", "gmail_events": "gmail", "google_voice_events": "google_voice",
    "chrome_events": "chrome", "discover_events": "discover", "instagram_events": "instagram",
    "llm_chat_events": "llm_chat", "sms_events": "sms",
}


def identity_totals(comments: DataFrame, posts: DataFrame, saved: DataFrame, upvoted: DataFrame,
                    events: DataFrame) -> DataFrame:
    """Thirteen counts per owner in one pass over (owner, label)."""
    labels = events.select("owner_id", F.col("source").alias("label"),
                           F.lit(True).alias("event"))
    for df, name in ((comments, "comments"), (posts, "posts"), (saved, "saved"),
                     (upvoted, "upvoted")):
        labels = labels.unionByName(df.select(
            "owner_id", F.lit(name).alias("label"), F.lit(False).alias("event")))
    forum = [F.count_if(~F.col("event") & (F.col("label") == n)).alias(f"reddit_{n}")
             for n in ("comments", "posts", "saved", "upvoted")]
    sources = [F.count_if(F.col("event") & (F.col("label") == s)).alias(n)
               for n, s in TIMELINE_TOTALS.items()]
    return labels.groupBy("owner_id").agg(
        *forum, F.count_if("event").alias("timeline_events"), *sources)


def _listed(ranked: DataFrame, item: Column, n: int, name: str) -> DataFrame:
    """The first n ranked items of an owner as one text."""
    few = ranked.filter(F.col("rank") <= n)
    return few.groupBy("owner_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))),
        lambda s: s["item"]), ", ").alias(name))


def identity_summary(texts: DataFrame, communities: DataFrame, sources: DataFrame,
                     words: DataFrame) -> DataFrame:
    """Four sentences from the item count and the ranked lists."""
    total = texts.groupBy("owner_id").agg(F.count(F.lit(1)).alias("items"))
    joined = total
    for part in (
        _listed(communities, F.concat(F.lit("r/"), "subreddit"), 5, "c"),
        _listed(sources, F.concat("source", F.lit(" ("), F.col("count").cast("string"),
                                  F.lit(")")), 5, "s"),
        _listed(words, F.col("word"), 12, "w"),
    ):
        joined = joined.join(part, "owner_id", "left")

    def sentence(c, lead, missing):
        return F.coalesce(F.concat(F.lit(lead), F.col(c), F.lit(".")), F.lit(missing))

    summary = F.concat_ws(
        " ",
        F.concat(F.lit("Analyzed "), F.format_number("items", 0),
                 F.lit(" text items from all connected data sources.")),
        sentence("c", "Most upvoted activity clusters around: ",
                 "No upvote subreddit signals found yet."),
        sentence("s", "Strongest non-Reddit data signals: ",
                 "No additional portal signals found yet."),
        sentence("w", "Recurring language markers include: ",
                 "No recurring language markers found yet."))
    return joined.select("owner_id", summary.alias("summary"))


def knowledge_words(texts: DataFrame, k: int = 12) -> DataFrame:
    """Most frequent words in three equal bands."""
    ranked = top_words(texts, k, stop_words=KNOWLEDGE_STOP_WORDS)
    third = k // 3
    band = (F.when(F.col("rank") <= third, "expert")
            .when(F.col("rank") <= 2 * third, "learning").otherwise("curious"))
    return ranked.withColumn("band", band)
