"""Forum export: comments, posts, votes, saved items, subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.text import community, number, strip
from keepsake.functions.times import forum_date
from keepsake.sources.files import pick, read_export_csv

DATES = ("created_at", "created", "timestamp", "date")
COMMUNITY = ("subreddit", "community")
LINKS = ("permalink", "link", "url")
SAVED_COLUMNS = ["owner_id", "id", "subreddit", "permalink", "title", "created_at", "seq"]


def _id(df: DataFrame, prefix: str) -> Column:
    """The row's own id, else one made of prefix, file and row."""
    file = F.col("file_name") if "file_name" in df.columns else F.lit("")
    return F.coalesce(
        pick(df, "id", "comment_id", "post_id", "thing_id", "full_id"),
        F.concat_ws("-", F.lit(prefix), file, F.col("seq").cast("string")))


def _link(df: DataFrame) -> Column:
    return F.nullif(strip(pick(df, *LINKS)), F.lit(""))


def comments(df: DataFrame) -> DataFrame:
    return df.select(
        "owner_id", _id(df, "comment").alias("id"), community(pick(df, *COMMUNITY)).alias("subreddit"),
        _link(df).alias("permalink"),
        F.coalesce(pick(df, "body", "comment", "text"), F.lit("")).alias("body"),
        forum_date(pick(df, *DATES)).alias("created_at"),
        number(pick(df, "score", "ups", "upvotes")).alias("score"), "seq")


def posts(df: DataFrame) -> DataFrame:
    return df.select(
        "owner_id", _id(df, "post").alias("id"), community(pick(df, *COMMUNITY)).alias("subreddit"),
        _link(df).alias("permalink"),
        F.coalesce(pick(df, "title", "subject"), F.lit("")).alias("title"),
        pick(df, "body", "selftext", "text").alias("body"),
        forum_date(pick(df, *DATES)).alias("created_at"),
        number(pick(df, "score", "ups", "upvotes")).alias("score"), "seq")


def _items(df: DataFrame, prefix: str, split: bool) -> DataFrame:
    """Voted or saved items. The split files know a few more column names than the legacy one."""
    where = (*COMMUNITY, "subreddit_name") if split else COMMUNITY
    title = ("title", "subject", "link_title") if split else ("title", "subject")
    dates = (*DATES, "vote_date") if split and prefix == "upvoted" else DATES
    return df.select(
        "owner_id", _id(df, prefix).alias("id"), community(pick(df, *where)).alias("subreddit"),
        _link(df).alias("permalink"), pick(df, *title).alias("title"),
        forum_date(pick(df, *dates)).alias("created_at"), "seq")


def is_upvote(direction: Column) -> Column:
    """One as a number, or one of the words for it."""
    n = strip(direction).try_cast("double")
    words = F.lower(strip(F.coalesce(direction, F.lit(""))))
    return F.coalesce(n == 1, words.isin("up", "upvote", "upvoted"))


def upvoted(votes: list[DataFrame], legacy: DataFrame | None = None) -> DataFrame | None:
    parts = [_items(df.filter(is_upvote(pick(
        df, "direction", "vote", "vote_direction", "voteDirection"))), "upvoted", True)
        for df in votes]
    return _union(parts + ([_items(legacy, "upvoted", False)] if legacy is not None else []))


def saved(split: list[DataFrame], legacy: DataFrame | None = None) -> DataFrame | None:
    parts = [_items(df, "saved", True) for df in split]
    return _union(parts + ([_items(legacy, "saved", False)] if legacy is not None else []))


def subscriptions(tables: list[DataFrame]) -> DataFrame | None:
    """Names as they come, repeats included."""
    return _union([df.select("owner_id", community(pick(
        df, "name", "subreddit", "community", "subreddit_name")).alias("name")).filter(
        "name IS NOT NULL") for df in tables])


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def read_forum_export(spark: SparkSession, folder: str, owner_id: str) -> dict[str, DataFrame | None]:
    """The five tables of one export folder; files that are not there count as empty."""
    def csv(name: str) -> DataFrame | None:
        df = read_export_csv(spark, f"{folder}/{name}.csv")
        return None if df is None else df.withColumn("owner_id", F.lit(owner_id))

    def present(*names: str) -> list[DataFrame]:
        return [df for df in map(csv, names) if df is not None]

    c, p = csv("comments"), csv("posts")
    return {
        "comments": None if c is None else comments(c), "posts": None if p is None else posts(p),
        "upvoted": upvoted(present("comment_votes", "post_votes"), csv("upvoted")),
        "saved": saved(present("saved_comments", "saved_posts"), csv("saved")),
        "subreddits": subscriptions(present("subreddits", "subscribed_subreddits")),
    }
