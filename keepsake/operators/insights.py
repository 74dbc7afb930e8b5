"""Activity scores of an owner. The scores are proxies from counts, as their names say; no diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions.lexicons import (
    CHANNEL_PLATFORMS, STANCE_NEGATIVE, STANCE_POSITIVE, STANCE_TOPICS,
)
from keepsake.functions.text import bounded, clamp01, has_any, hosts, strip, word_count
from keepsake.operators.corpus import titled
from keepsake.operators.ranking import top_k
from keepsake.operators.term_index import stored

OWNER = ["owner_id"]
PLATFORMS = ["reddit", "twitter", "instagram", "facebook", "youtube", "tiktok", "linkedin", "spotify"]


def on_platform(channel: Column | str, platform: str) -> Column:
    """Whether a channel name belongs to a platform. One name may fit several."""
    c = F.col(channel) if isinstance(channel, str) else channel
    return F.lower(F.coalesce(c, F.lit(""))).rlike(bounded(CHANNEL_PLATFORMS[platform]))


def partials(comments: DataFrame, posts: DataFrame, saved: DataFrame, upvoted: DataFrame, events: DataFrame,
             topics=None, positive=STANCE_POSITIVE, negative=STANCE_NEGATIVE) -> DataFrame:
    """All that the scores need of an owner's rows, by month, table, source and channel, in one pass over each table.

    A row counts once, and once more for each domain its text links to. Groups hold sums and first places only, so
    map tasks reduce whatever they read; the result is stored, and every score is made from it.
    """
    topics = topics or STANCE_TOPICS

    def part(df: DataFrame, place: int, name: str, text: Column, source=None, channel=None) -> DataFrame:
        none = F.lit(None).cast("string")
        return df.select("owner_id", F.lit(name).alias("part"), F.lit(place).alias("place"), "seq", "created_at", text.alias("text"),
                         (none if source is None else F.col(source)).alias("source"),
                         (none if channel is None else F.col(channel)).alias("channel"))

    rows = (
        part(comments, 0, "comment", F.coalesce("body", F.lit("")))
        .unionByName(part(posts, 1, "post", titled()))
        .unionByName(part(events, 2, "event", F.coalesce("text", F.lit("")), "source", "channel"))
        .unionByName(part(saved, 3, "saved", titled("title", "permalink")))
        .unionByName(part(upvoted, 4, "upvoted", titled("title", "permalink")))
    )
    low, at = F.lower("text"), F.struct("place", "seq", "created_at")
    dated = (F.col("place") < 3) & F.col("created_at").isNotNull() & (strip("text") != "")
    about = {name: dated & has_any(low, words) for name, words in topics.items()}
    slim = rows.select(
        "owner_id", "part", "source", "channel", F.date_format("created_at", "yyyy-MM").alias("month"),
        at.alias("at"), dated.alias("dated"), (dated & F.hour("created_at").between(0, 5)).alias("late"),
        ((F.col("place") == 0) & (word_count("text") >= 80)).alias("long"),
        (dated & has_any(low, positive)).alias("pro"), (dated & has_any(low, negative)).alias("con"),
        *[test.alias(f"is_{name}") for name, test in about.items()],
        F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(hosts("text")))).alias("domain"))
    itself = F.col("domain").isNull()
    keys = [F.when(itself, F.col(c)).alias(c) for c in ("month", "part", "source", "channel")]
    sides = [
        agg for name in topics for agg in (
            F.count_if(itself & F.col(f"is_{name}")).alias(f"n_{name}"),
            F.min(F.when(itself & F.col(f"is_{name}") & F.col("pro"), F.col("at"))).alias(f"pro_{name}"),
            F.min(F.when(itself & F.col(f"is_{name}") & F.col("con"), F.col("at"))).alias(f"con_{name}"))]
    return stored(slim.groupBy("owner_id", "domain", *keys).agg(
        F.count_if(itself).alias("n"), *[F.count_if(itself & F.col(c)).alias(c) for c in ("dated", "late", "long")], *sides), "partials")


def platform_counts(parts: DataFrame) -> DataFrame:
    """Rows per platform and owner: thirteen counts and the texts written on the forum."""
    event, n = F.col("part") == "event", F.col("n")

    def summed(test: Column, name: str) -> Column:
        return F.sum(F.when(test, n).otherwise(0)).alias(name)

    return parts.groupBy("owner_id").agg(
        *[summed(event & on_platform("channel", p), p) for p in CHANNEL_PLATFORMS],
        *[summed(event & (F.col("source") == s), s) for s in ("youtube", "gmail", "google_voice", "chrome", "discover")],
        summed(event, "total_timeline"), summed(F.col("part").isin("comment", "post", "saved", "upvoted"), "reddit"),
        summed(F.col("part").isin("comment", "post"), "written"))


def month_totals(parts: DataFrame) -> DataFrame:
    """Dated rows of all tables by month."""
    return parts.filter("month IS NOT NULL").groupBy("owner_id", "month").agg(F.sum("n").alias("total"))


def entropy(counts: list[Column]) -> Column:
    """Shannon entropy of the shares, in bits."""
    total = sum(counts[1:], counts[0])

    def part(c: Column) -> Column:
        p = c / total
        return F.when(c > 0, -p * F.log2(p)).otherwise(0.0)

    return F.when(total > 0, sum([part(c) for c in counts[1:]], part(counts[0]))).otherwise(0.0)


def coverage(counts: list[Column]) -> Column:
    """Share of the platforms with rows."""
    present = [(c > 0).cast("int") for c in counts]
    return sum(present[1:], present[0]) / F.lit(float(len(counts)))


def growth(months: DataFrame) -> DataFrame:
    """Mean of the later half of the months minus the mean of the earlier half, and its scaled form.

    ``months``: owner_id, month, total. An owner has twelve rows a year.
    """
    w = Window.partitionBy("owner_id")
    n = F.count(F.lit(1)).over(w)
    half = F.greatest(F.lit(1), F.floor(n / 2))
    placed = months.select("owner_id", "total", n.alias("n"), F.row_number().over(
        w.orderBy("month")).alias("at"), half.alias("half"))
    early = F.avg(F.when(F.col("at") <= F.col("half"), F.col("total")))
    late = F.avg(F.when(F.col("at") > F.col("half"), F.col("total")))
    out = placed.groupBy("owner_id").agg(
        F.max("n").alias("months"),
        (F.coalesce(late, F.lit(0.0)) - F.coalesce(early, F.lit(0.0))).alias("growth"))
    return out.withColumn("growth_norm", clamp01((F.col("growth") + 50) / 120))


def contradictions(texts: DataFrame, topics=None, positive=STANCE_POSITIVE, negative=STANCE_NEGATIVE,
                   min_days: float = 7, k: int = 8) -> DataFrame:
    """Topics with a first approving and a first rejecting text at least a week apart.

    "First" is corpus order. The first text of each side is an aggregate; no text meets another.
    """
    topics = topics or STANCE_TOPICS
    low = F.lower("text")
    tagged = texts.select(
        "owner_id", "created_at", F.col("corpus_seq").alias("at"),
        has_any(low, positive).alias("pro"), has_any(low, negative).alias("con"),
        F.filter(F.array(*[F.when(has_any(low, keys), F.lit(name)) for name, keys in topics.items()]),
                 lambda x: x.isNotNull()).alias("topics"),
    ).withColumn("topic", F.explode("topics"))
    # Corpus order is (table, number): compared as one pair.
    pro = F.min(F.when(F.col("pro"), F.struct("at", "created_at")))
    con = F.min(F.when(F.col("con"), F.struct("at", "created_at")))
    sided = tagged.groupBy("owner_id", "topic").agg(
        F.count(F.lit(1)).alias("texts"), pro.alias("p"), con.alias("c"))
    gap = F.abs(F.unix_millis("p.created_at") - F.unix_millis("c.created_at")) / 86_400_000
    out = sided.filter("texts >= 2 AND p IS NOT NULL AND c IS NOT NULL").withColumn("gap_days", gap)
    return top_k(
        out.filter(F.col("gap_days") >= min_days).select(
            "owner_id", "topic", "gap_days", F.col("p.at").alias("positive_at"),
            F.col("c.at").alias("negative_at")),
        OWNER, [F.desc("gap_days"), F.asc("topic")], k)


def corpus_flags(texts: DataFrame) -> DataFrame:
    """Texts and late-night texts per owner."""
    return texts.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("corpus"),
        F.count_if(F.col("hour").between(0, 5)).alias("late_night"))


def long_texts(comments: DataFrame, words: int = 80) -> DataFrame:
    return comments.groupBy("owner_id").agg(
        F.count_if(word_count(F.coalesce("body", F.lit(""))) >= words).alias("long_form"))


def _conflicts(parts: DataFrame, min_days: float = 7, k: int = 8) -> list[Column]:
    """Per owner, from all of its parts: how many topics have a first approving and a first rejecting text so far apart."""
    names = [c.removeprefix("n_") for c in parts.columns if c.startswith("n_")]
    def apart(name: str) -> Column:
        p, c = F.min(f"pro_{name}"), F.min(f"con_{name}")
        gap = F.abs(F.unix_millis(p["created_at"]) - F.unix_millis(c["created_at"])) / 86_400_000
        return F.when((F.sum(f"n_{name}") >= 2) & (gap >= min_days), 1).otherwise(0)
    return [F.least(F.lit(k), sum([apart(n) for n in names[1:]], apart(names[0]))).alias("conflicts")]


def scores(parts: DataFrame) -> DataFrame:
    """Eighteen activity scores in 0..1, one row per owner, from the partial sums."""
    own = parts.groupBy("owner_id").agg(
        F.sum("dated").alias("corpus"), F.sum("late").alias("late_night"), F.sum("long").alias("long_form"),
        F.countDistinct("domain").alias("domains"), *_conflicts(parts))
    rows = platform_counts(parts).join(own, OWNER).join(growth(month_totals(parts)), OWNER, "left")
    rows = rows.na.fill(0)
    c = F.col
    one = F.lit(1)
    public = c("linkedin") + c("twitter") + c("instagram") + c("facebook")
    private = c("reddit") + c("youtube") + c("gmail") + c("google_voice")
    passive = c("youtube") + c("chrome") + c("discover")
    active = c("written") + c("twitter") + c("instagram") + c("facebook") + c("linkedin")
    both, acts = F.greatest(one, public + private), F.greatest(one, passive + active)
    eight = [c(p) for p in PLATFORMS]
    cover = coverage(eight)
    conflict = clamp01(c("conflicts") / 6)
    made = clamp01(active / acts)
    grow = c("growth_norm")
    parts = {
        "public_private": private / both,
        "consumption_creation": made,
        "stated_revealed": clamp01(F.lit(0.45) + cover * 0.4 - conflict * 0.2),
        "authenticity": private / both,
        "knowledge_map": clamp01((c("long_form") / 800 + c("youtube") / 2500) / 2),
        "social_identity": clamp01(cover),
        "temporal_patterns": clamp01(c("months") / 36),
        "contradiction_detector": conflict,
        "life_phase": clamp01((c("months") / 48 + grow) / 2),
        "influence_sources": clamp01(c("domains") / 80),
        "energy_investment": made,
        "hidden_interests": clamp01(passive / acts),
        "performativity": public / both,
        "identity_fragmentation": clamp01(entropy(eight) / 3),
        "value_alignment": clamp01(F.lit(0.9) - conflict * 0.5),
        "loneliness": clamp01(c("late_night") / F.greatest(one, c("corpus")) * 2),
        "growth": grow,
        "future": clamp01((grow + cover) / 2),
    }
    return rows.select("owner_id", *[v.cast("double").alias(k) for k, v in parts.items()])


# How personal each platform counts.
AUTHENTICITY = {
    "reddit": 0.85, "twitter": 0.55, "instagram": 0.42, "facebook": 0.58, "youtube": 0.7,
    "linkedin": 0.3, "spotify": 0.74,
}


def authenticity_ranking(platforms: DataFrame) -> DataFrame:
    """Platforms in use by how personal they count."""
    rows = platforms.select("owner_id", F.explode(F.array(*[
        F.struct(F.lit(p).alias("platform"), F.col(p).alias("rows"), F.lit(s).alias("score"))
        for p, s in AUTHENTICITY.items()])).alias("p")).select("owner_id", "p.*")
    return top_k(rows.filter(F.col("rows") > 0), OWNER, [F.desc("score"), F.asc("platform")],
                 len(AUTHENTICITY))


def _round(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def constellation(platforms: DataFrame) -> DataFrame:
    """Four sides of an owner with a display size of 44 to 100."""
    c = F.col
    sides = {
        "Professional": c("linkedin") + c("twitter") * 0.4,
        "Anonymous": c("reddit") + c("youtube") * 0.2,
        "Social": c("instagram") + c("facebook") + c("tiktok") * 0.5,
        "Creative": c("spotify") + c("youtube") * 0.3 + c("instagram") * 0.2,
    }
    most = F.greatest(F.lit(1.0), *[v.cast("double") for v in sides.values()])
    return platforms.select("owner_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("side"), v.cast("double").alias("value"),
                 (_round(v / most * 56) + 44).alias("size"))
        for k, v in sides.items()])).alias("s")).select("owner_id", "s.*")


def effort_shares(platforms: DataFrame) -> DataFrame:
    """Creating, consuming and reacting, in percent of the largest of them."""
    c = F.col
    kinds = {"create": c("written"), "consume": c("youtube"),
             "react": c("instagram") + c("facebook") + c("tiktok")}
    most = F.greatest(F.lit(1), *kinds.values())
    return platforms.select("owner_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("effort"), v.alias("rows"), _round(v / most * 100).alias("percent"))
        for k, v in kinds.items()])).alias("e")).select("owner_id", "e.*")


# Share of the contradiction score by axis and platform.
MATRIX = {
    "Values": (0.85, 0.6, 0.55), "Tone": (0.7, 0.9, 0.8), "Claims": (0.75, 0.5, 0.45),
    "Lifestyle": (0.4, 0.5, 0.95),
}


def contradiction_matrix(score_rows: DataFrame) -> DataFrame:
    base = clamp01(F.col("contradiction_detector"))
    return score_rows.select("owner_id", F.explode(F.array(*[
        F.struct(F.lit(axis).alias("axis"), *[
            clamp01(base * w).alias(p) for p, w in zip(("reddit", "linkedin", "instagram"), ws)])
        for axis, ws in MATRIX.items()])).alias("m")).select("owner_id", "m.*")
