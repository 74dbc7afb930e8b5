"""Evidence of disclosure on hand-written conversations."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keepsake.functions import questions as ask
from keepsake.operators import disclosure

EVENT = ("owner_id string, seq bigint, source string, participants array<string>, text string, "
         "created_at timestamp, is_user_message boolean")
SUMMARY = ("owner_id string, chunk_id string, contact_key string, start_ms bigint, knowledge_deltas "
           "array<struct<topic:string,status:string,date:string,evidence:string>>")


def run(spark, contact, topic, messages, deltas=()):
    rows = [("a", i, "sms", [contact], text, datetime.fromisoformat(day), mine)
            for i, (text, mine, day) in enumerate(messages)]
    events = spark.createDataFrame(rows, EVENT)
    cases = spark.createDataFrame([("a", contact, topic)], "owner_id string, contact string, topic string")
    stored = spark.createDataFrame([("a", "c", contact, 0, list(deltas))] if deltas else [], SUMMARY)
    out = disclosure.disclosure(events, cases, stored)
    notes = disclosure.notes(out, disclosure.statements(events, cases, stored))
    return out.first(), [r["note"] for r in notes.orderBy("order").collect()]


DAY = "2025-01-15T10:00:00"


def test_never_mentioned(spark):
    r, notes = run(spark, "Mom", "divorce", [("Hey Mom, how are you?", True, DAY),
                                             ("I'm good, thanks!", False, DAY)])
    assert (r.status, r.mentions, r.direction) == ("none", 0, "incoming")
    assert "No evidence found" in r.answer and notes == ["No matching messages found"]


def test_indirect(spark):
    r, _ = run(spark, "Mom", "startup", [("I've been working on something new", True, DAY)])
    assert r.status == "none"


def test_hint_becomes_a_note(spark):
    _, notes = run(spark, "Mom", "startup", [("I've been busy", True, DAY)],
                   [("startup", "hinted", "2025-01-15", "working on something")])
    assert any("Indirect mention" in n for n in notes)


def test_acknowledged_only(spark):
    r, notes = run(spark, "Mom", "startup", [("How's your startup going?", False, DAY)])
    assert r.acknowledged and r.status == "none" and "Contact acknowledged the topic" in notes


def test_conflict_over_time(spark):
    r, _ = run(spark, "Mom", "job", [
        ("I got a job at Stripe!", True, "2025-02-01"),
        ("I haven't told anyone about the job yet", True, "2025-03-01")])
    assert r.status == "conflicting" and r.denials == 1


def test_repeated(spark):
    r, _ = run(spark, "Mom", "job", [
        ("I got a new job", True, "2025-01-15"), ("The job is going well", True, "2025-02-15"),
        ("My job is stressful", True, "2025-03-15")])
    assert (r.status, r.mentions, r.spread) == ("confirmed", 3, True)
    assert r.confidence == pytest.approx(0.65)


def test_strengthened(spark):
    r, _ = run(spark, "Mom", "startup", [
        ("I started a startup", True, "2025-01-15"),
        ("How's your startup going?", False, "2025-01-20")])
    assert r.acknowledged and "later referenced" in r.answer and r.status == "weak"


def test_disclosed_delta_is_evidence(spark):
    r, _ = run(spark, "Mom", "startup", [("Random message", True, DAY)],
               [("startup", "disclosed", "2025-01-15", "I launched my startup!")])
    assert r.mentions == 1 and r.last_mentioned == "2025-01-15"


def test_contradicted_delta(spark):
    r, _ = run(spark, "Mom", "job", [], [
        ("job", "disclosed", "2025-01-15", "I got the job"),
        ("job", "contradicted", "2025-02-15", "I didn't get it")])
    assert r.denials == 1 and r.status == "conflicting"


@pytest.mark.parametrize("topic,expected", [
    ("startup", {"startup", "company", "project"}), ("job", {"job", "work", "career"})])
def test_topic_terms(spark, topic, expected):
    terms = spark.range(1).select(disclosure.topic_terms(F.lit(topic)).alias("t")).first().t
    assert expected <= set(terms)


def test_unknown_topic_stands_for_itself(spark):
    assert spark.range(1).select(disclosure.topic_terms(F.lit("golf")).alias("t")).first().t == ["golf"]


@pytest.mark.parametrize("text,mine,found", [
    ("How is your startup going?", False, 1), ("I started a startup", True, 0),
    ("How are you?", False, 0)])
def test_acknowledgment(spark, text, mine, found):
    events = spark.createDataFrame(
        [("a", 1, "sms", ["Mom"], text, datetime(2025, 1, 20), mine)], EVENT)
    cases = spark.createDataFrame([("a", "Mom", "startup")], "owner_id string, contact string, topic string")
    assert disclosure.acknowledgments(disclosure.statements(events, cases)).count() == found


@pytest.mark.parametrize("question,name,topic", [
    ("Does Mom know about my startup?", "mom", "my startup"),
    ("Did I tell Mom about the job?", "mom", "the job"),
    ("Have I mentioned the move to Mom?", "mom", "the move"), ("What is the weather?", None, None)])
def test_disclosure_questions(spark, question, name, topic):
    p = spark.range(1).select(ask.disclosure_parts(F.lit(question)).alias("p")).first().p
    assert (p and p["name"], p and p["topic"]) == (name, topic)


@pytest.mark.parametrize("question,kind", [
    ('how many times did I say "to be honest"', "phrase_frequency"),
    ("what was I like 2 years ago", "time_period"), ("tea vs coffee?", "comparison"),
    ("has my view shifted on tea?", "general"), ("how has my view shifted on tea?", "evolution"),
    ("how did I change", "time_period"), ("tell me something", "general")])
def test_intents(spark, question, kind):
    assert spark.range(1).select(ask.intent(F.lit(question)).alias("k")).first().k == kind


def test_recorded_statements_count_once(spark):
    long = "I told you all about the new job, from the first day to the last one of it " * 3
    r, notes = run(spark, "Mom", "job", [(long, True, DAY), (long, True, DAY), ("nice job", False, DAY)], [
        ("job", "disclosed", "2025-01-16", long), ("job", "disclosed", "2025-03-16", "about the job"),
        ("job", "disclosed", "2025-03-17", "about the job"), ("job", "disclosed", "2025-03-18", ""), ("job", "contradicted", "2025-01-16", None)])
    assert (r.mentions, r.denials, r.acks, r.status, r.spread) == (3, 1, 1, "conflicting", True)
    assert r.last_mentioned == "2025-03-16" and "1 contradiction(s) found" in notes


def test_scans_of_each_table(spark, tmp_path):
    events = spark.createDataFrame([("a", 1, "sms", ["Mom"], "job", datetime(2025, 1, 1), True)], EVENT)
    cases = spark.createDataFrame([("a", "Mom", "job")], "owner_id string, contact string, topic string")
    for name, df in (("events", events), ("cases", cases), ("summaries", spark.createDataFrame([], SUMMARY))):
        df.write.parquet(str(tmp_path / name))
    e, c, s = (spark.read.parquet(str(tmp_path / n)) for n in ("events", "cases", "summaries"))
    plan = disclosure.disclosure(e, c, s)._jdf.queryExecution().executedPlan().toString()
    assert all(plan.count(f"{tmp_path / n}") <= 3 for n in ("events", "cases", "summaries"))
