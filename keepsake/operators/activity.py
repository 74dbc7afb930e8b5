"""Counts by source, channel, person, day and month."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions.text import clip, host, one_line, person_words
from keepsake.functions.times import day_key, month_key
from keepsake.operators.ranking import top_counts, top_k


def most_texted(events: DataFrame, k: int = 15, me: str = "me") -> DataFrame:
    """Messages per participant other than the owner, most frequent first.

    The owner's own name is in nearly every row; it drops out before the count.
    """
    people = (
        events.filter(F.col("source") == "sms")
        .select("owner_id", F.explode("participants").alias("contact"))
        .filter(F.col("contact").isNotNull() & (person_words("contact") != me))
    )
    return top_counts(people, ["owner_id"], "contact", k, "messages")


def distinct_participants(events: DataFrame) -> DataFrame:
    return (
        events.select("owner_id", F.explode("participants").alias("name"))
        .filter(F.col("name").isNotNull() & (F.col("name") != "")).distinct()
    )


def per_source(events: DataFrame) -> DataFrame:
    return events.groupBy("owner_id", "source").agg(F.count(F.lit(1)).alias("events"))


def top_values(rows: DataFrame, item: str, k: int = 12) -> DataFrame:
    """Most frequent values of one column, without nulls."""
    return top_counts(rows.filter(F.col(item).isNotNull()), ["owner_id"], item, k)


def browsing_domains(events: DataFrame, k: int = 30) -> DataFrame:
    visits = (
        events.filter(F.col("source") == "chrome").select("owner_id", host("url").alias("domain"))
    )
    return top_counts(visits.filter(F.col("domain").isNotNull()), ["owner_id"], "domain", k,
                      "visits")


def per_day(*tables: DataFrame) -> DataFrame:
    """Dated rows per day over several tables."""
    return (
        _stack(tables, "created_at").filter(F.col("created_at").isNotNull())
        .groupBy("owner_id", day_key("created_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _stack(tables, *cols: str) -> DataFrame:
    """Union of the named columns only."""
    out = None
    for t in tables:
        part = t.select("owner_id", *cols)
        out = part if out is None else out.unionByName(part)
    return out


def month_sources(forum_tables, events: DataFrame) -> DataFrame:
    """Dated rows per month and source; forum tables count as one source."""
    forum = _stack(forum_tables, "created_at").withColumn("source", F.lit("reddit"))
    rows = forum.unionByName(events.select("owner_id", "created_at", "source"))
    return (
        rows.filter(F.col("created_at").isNotNull())
        .groupBy("owner_id", month_key("created_at").alias("month"), "source")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def monthly(month_source: DataFrame) -> DataFrame:
    """Months with their total and the split by source as a map."""
    return month_source.groupBy("owner_id", "month").agg(
        F.sum("count").alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "count"))))
        .alias("by_source"))


def active_communities(comments: DataFrame, posts: DataFrame, k: int = 10) -> DataFrame:
    return top_values(_stack((comments, posts), "subreddit"), "subreddit", k)


def date_ranges(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and first and last date per dataset, one pass over slim columns."""
    rows = None
    for name, df in tables.items():
        part = df.select("owner_id", F.lit(name).alias("dataset"), "created_at")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("owner_id", "dataset").agg(
        F.count(F.lit(1)).alias("count"), F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"))


def samples_per_source(events: DataFrame, n: int = 3) -> DataFrame:
    """The first rows of each source in file order, on one line."""
    slim = events.select("owner_id", "source", "created_at", "channel", "seq",
                         clip(one_line(F.coalesce("text", F.lit(""))), 240).alias("sample"))
    return top_k(slim, ["owner_id", "source"], [F.asc("seq")], n)


# How many recent rows of a source the context shows, and how much of each text.
RECENT = {
    "sms": (200, 150), "youtube": (100, 120), "chrome": (10, 220),
    "gmail": (5, 220), "google_voice": (5, 220),
}


def recent_per_source(events: DataFrame, limits: Mapping[str, tuple[int, int]] = RECENT
                      ) -> DataFrame:
    """The latest rows of each source, each source with its own limit and text width."""
    table = F.create_map(*[
        x for source, (n, width) in limits.items()
        for x in (F.lit(source), F.struct(F.lit(n).alias("rows"), F.lit(width).alias("width")))])
    known = events.filter(F.col("source").isin(*limits))
    shown = known.select(
        "owner_id", "source", "created_at", "channel", "seq", "participants", "is_user_message",
        F.substring(one_line(F.coalesce("text", F.lit(""))), F.lit(1),
                    table[F.col("source")]["width"]).alias("line"))
    most = max(n for n, _ in limits.values())
    ranked = top_k(shown, ["owner_id", "source"], [F.desc_nulls_last("created_at"), F.desc("seq")],
                   most)
    return ranked.filter(F.col("rank") <= table[F.col("source")]["rows"])
