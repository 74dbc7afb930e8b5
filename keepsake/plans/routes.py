"""A batch of questions answered from the tables: one plan per kind of question, one result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.operators import questions as q
from keepsake.operators import retrieval as r
from keepsake.operators.ranking import top_k
from keepsake.operators.term_index import TermIndex, stored

RESULT = ["owner_id", "question_id", "route", "rank", "kind", "id", "subreddit", "created_at",
          "snippet", "score"]


def answers(questions: DataFrame, comments: DataFrame, posts: DataFrame, events: DataFrame,
            now: Column) -> DataFrame:
    """Evidence rows for every question, by the route its wording asks for.

    Questions whose route finds nothing to work with (no phrase, no two topics, no topic) fall back to
    general retrieval, as do general ones. No step counts or collects questions on the driver.
    """
    asked = q.routed(questions, now)
    rows = r.forum_rows(comments, posts)
    route = (
        F.when((F.col("intent") == "phrase_frequency") & (F.col("phrase") != ""), "phrase_frequency")
        .when(F.col("intent") == "time_period", "time_period")
        .when((F.col("intent") == "comparison") & (F.size("topics") >= 2), "comparison")
        .when((F.col("intent") == "evolution") & (F.col("change_topic") != ""), "evolution")
        .otherwise("general"))
    # Routed once: every branch reads the result.
    asked = stored(asked.withColumn("route", route), "routed")

    def of(name: str) -> DataFrame:
        return asked.filter(F.col("route") == name)

    def shaped(df: DataFrame, name: str, k: int, order: list[Column]) -> DataFrame:
        ranked = df if "rank" in df.columns else top_k(df, r.ASK, order, k)
        text = F.col("snippet") if "snippet" in df.columns else F.substring("text", 1, 260)
        return ranked.select(
            "owner_id", "question_id", F.lit(name).alias("route"), F.col("rank").cast("long"),
            F.col("kind"), F.col("id").cast("string").alias("id"), "subreddit", "created_at",
            text.alias("snippet"), F.col("score").cast("double").alias("score"))

    in_order = [F.asc("place"), F.asc("seq")]
    # Ranked as numbers; the texts of the few that stay are fetched. Forum texts are numbered once for all routes.
    shown = ["kind", "id", "subreddit", "created_at", "text"]
    whole = TermIndex(rows, r.OWNER, "text")
    said = r.matches(whole, q.phrase_terms(of("phrase_frequency"))).select(*r.ASK, "_row", "place", "seq", "score")
    phrase = shaped(whole.fetch(top_k(said, r.ASK, in_order, 10), *shown), "phrase_frequency", 10, in_order)
    dated = q.time_period_rows(whole.slim("place", "seq", "score", "created_at"), of("time_period")).drop("created_at")
    period = shaped(whole.fetch(top_k(dated, r.ASK, in_order, 10), *shown), "time_period", 10, in_order)
    # A side is a request of its own.
    sides = of("comparison").select("owner_id", "question_id", F.posexplode(
        F.slice("topics", 1, 2)).alias("side", "topic")).withColumn("question_id", F.struct("question_id", "side"))
    best = [F.desc("hits"), *in_order]
    comments_only = whole.over(whole.rows.filter("place = 0"))
    slim = ["place", "seq", "score", "created_at"]
    compared = r.matched(comments_only, r.with_terms(sides, r.blank_terms("topic")), slim).withColumn(
        "question_id", F.col("question_id.question_id"))
    changed = r.matched(comments_only, r.with_terms(of("evolution"), r.blank_terms("change_topic")), slim).filter(
        "created_at IS NOT NULL")
    comparison, evolution = (
        shaped(comments_only.fetch(top_k(found, r.ASK, best, 10).drop("created_at"), *shown), name, 10, best)
        for found, name in ((compared, "comparison"), (changed, "evolution")))
    general = of("general").select("owner_id", "question_id", F.col("question").alias("topic"))
    found = shaped(r.general_of(whole, general), "general", 6, [])
    texts = r.message_hits(events, general, 25)
    told = shaped(
        texts.withColumn("kind", F.lit("message")).withColumn("id", F.col("seq")).withColumn(
            "subreddit", F.lit(None).cast("string")), "messages", 25, [])
    out = phrase
    for part in (period, comparison, evolution, found, told):
        out = out.unionByName(part)
    return out
