"""Any CSV of messages, by a mapping of its columns; and a guess of the mapping."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.text import first_text
from keepsake.functions.times import plain_date

# Header words that hint at each role.
HINTS = {
    "text": "text message body content caption post comment title msg".split(),
    "date": "created_at createdat timestamp time date sent_at sentat datetime".split(),
    "author": "author user from sender username handle name".split(),
    "recipient": "to recipient target receiver thread contact".split(),
    "channel": "platform source channel app subreddit service".split(),
    "id": "id message_id msg_id post_id comment_id uuid guid".split(),
}


def preview(df: DataFrame, n: int = 5) -> tuple[list[str], DataFrame]:
    """Headers and the first rows as text."""
    return df.columns, df.limit(n).select([
        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def events(df: DataFrame, mapping: Mapping[str, str], owner_id: Column) -> DataFrame:
    """Event rows; rows without text drop out, the whole row stays as metadata."""
    def role(name: str) -> Column:
        c = mapping.get(name)
        return first_text(F.col(f"`{c}`")) if c else F.lit(None).cast("string")

    people = F.filter(F.array(role("author"), role("recipient")), lambda p: p.isNotNull())
    cells = [c for c in df.columns if c not in ("owner_id", "seq", "file_name")]
    return df.select(
        owner_id.alias("owner_id"), F.lit("social_csv").alias("source"),
        F.lit("message").alias("kind"), role("text").alias("text"),
        plain_date(role("date")).alias("created_at"),
        F.when(F.size(people) > 0, people).alias("participants"),
        role("channel").alias("channel"), role("id").alias("external_id"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in cells]),
                          F.array(*[F.col(f"`{c}`").cast("string") for c in cells])).alias("metadata"),
        F.col("seq") if "seq" in df.columns else F.monotonically_increasing_id().alias("seq"),
    ).filter("text IS NOT NULL")


def column_stats(df: DataFrame) -> DataFrame:
    """Per column: filled cells, mean length, share of numbers, dates and links; one pass."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(c).alias("header"),
                 F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias("value"))
        for i, c in enumerate(df.columns)]))
    v = F.col("value")
    return (
        df.select(cells.alias("c")).select("c.*").filter(v != "")
        .groupBy("place", "header").agg(
            F.count(F.lit(1)).alias("filled"), F.avg(F.length(v)).alias("mean_length"),
            F.avg(F.regexp_replace(v, r"\s+", "").rlike("^[0-9]+$").cast("double"))
            .alias("numeric_share"),
            F.avg(plain_date(v).isNotNull().cast("double")).alias("date_share"),
            F.max(v.rlike(r"(?i)^(https?://|www\.)")).alias("has_link"))
    )


def infer_mapping(df: DataFrame) -> dict[str, str]:
    """Roles by header hints, else by what the columns hold. One row per column reaches the driver."""
    def norm(s: str) -> str:
        return re.sub("[^a-z0-9]+", "", s.lower().strip())

    def hinted(role: str) -> str:
        best, top = "", 0
        for h in df.columns:
            n = norm(h)
            points = sum(6 * (n == norm(k)) + 4 * (norm(k) in n) + (n in norm(k)) for k in HINTS[role])
            if points > top:
                best, top = h, points
        return best

    stats = {r["header"]: r for r in column_stats(df).collect()}

    def best(score) -> str:
        ranked = [(h, score(h)) for h in df.columns if h in stats]
        return max(ranked, key=lambda x: x[1])[0] if ranked else ""

    def text_score(h: str) -> float:
        s = stats[h]
        return s["mean_length"] - (25 * (s["numeric_share"] >= 0.7) + 25 * (s["date_share"] >= 0.7)
                                   + 10 * bool(s["has_link"]))

    def date_score(h: str) -> float:
        named = re.search("date|time|timestamp|created|sent", norm(h)) is not None
        return stats[h]["date_share"] + 0.25 * named

    def id_score(h: str) -> float:
        named = re.search("(^|_)(id|uuid|guid)($|_)", norm(h)) is not None
        return float(stats[h]["numeric_share"] >= 0.7) + 0.5 * named

    date = hinted("date") or best(date_score)
    found = {
        "text": hinted("text") or best(text_score),
        "date": date if date in stats and stats[date]["date_share"] >= 0.6 else "",
        "author": hinted("author"), "recipient": hinted("recipient"), "channel": hinted("channel"),
        "id": hinted("id") or best(id_score),
    }
    return {k: v for k, v in found.items() if v}
