"""Few requests are looked for where texts are read, with the same results as by the index."""

import random

import pytest
from pyspark.sql import functions as F

from keepsake.operators import questions, retrieval, term_scan
from keepsake.operators.term_index import TermIndex

BITS = ["don't", "lol", "meet", "a", "b", "ab", "abc", "A", "ÄB", "_", " ", "\x1c", "work", " ", " ", "  ", "\n", "7:30", "İ", "naïve", "k" * 70]


def rows(spark, n=150, seed=5):
    rng = random.Random(seed)
    made = [(rng.choice(["o", "o", "p", None]), i % 60, rng.choice([0, 1]), i, "general", f"2024-01-{i % 28 + 1:02d}" if i % 5 else None,
             rng.choice([None, -1.0, 0.0, 250.0]), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) if i % 9 else None,
             "sms", ["Me", rng.choice(["Ana", "Bo", "Ana Bo", None])], True) for i in range(n)]
    return spark.createDataFrame(made, """owner_id string, seq long, place int, id long, subreddit string, created_at string, score double,
        text string, source string, participants array<string>, is_user_message boolean""").withColumn(
        "created_at", F.col("created_at").cast("timestamp")).withColumn("body", F.col("text")).withColumn("title", F.lit("t")).withColumn(
        "channel", F.lit("c")).withColumn("permalink", F.lit(None).cast("string")).withColumn("kind", F.lit("message"))


def asked(spark, target=False):
    topics = ["abc meet ab", "lol a b abc", "work work naïve", "the", "", " \n", "äb don't meet", "abc", "abc", "k" * 68, "b 7:30", None]
    made = [(["o", "p", "o", None][i % 4], min(i, 8), t, "casual" if i % 3 else None, ["Ana", "Bo", "xx"][i % 3]) for i, t in enumerate(topics)]
    out = spark.createDataFrame(made + made[:1], "owner_id string, question_id int, topic string, preferred string, target string")
    return out if target else out.drop("target")


def by_index(monkeypatch):
    monkeypatch.setattr(term_scan, "MAX_REQUESTS", -1)


def found(df):
    return sorted(map(str, df.collect()))


JOBS = {
    "general": lambda f, a: retrieval.general(f, a, 4),
    "message_hits": lambda f, a: retrieval.message_hits(f, a),
    "message_hits_best": lambda f, a: retrieval.message_hits(f, a, 3),
    "matching": lambda f, a: retrieval.matching(f.withColumn("low", F.lower("text")), a.withColumn("terms", F.array("topic"))),
    "outbound": lambda f, a: retrieval.outbound_messages(f, a, 1_717_200_000_000, 5),
    "snippets": lambda f, a: retrieval.forum_snippets(f, f, a, 4),
    "cross": lambda f, a: retrieval.cross_platform_examples(f, a, 6),
    "relevant": lambda f, a: retrieval.relevant_comments(f, a),
    "lexical": lambda f, a: questions.lexical_hits(f, a.withColumnRenamed("topic", "phrase")),
}


@pytest.mark.parametrize("name", list(JOBS))
def test_same_as_by_the_index(spark, monkeypatch, name):
    # A row number is its own, so equal places cannot be told apart.
    texts, requests = rows(spark).withColumn("seq", F.col("id")), asked(spark)
    few = found(JOBS[name](texts, requests))
    by_index(monkeypatch)
    assert few == found(JOBS[name](texts, requests)) and few


def test_routed_same_as_by_the_index(spark, monkeypatch):
    texts, requests = rows(spark).withColumn("seq", F.col("id")), asked(spark, target=True)

    def job():
        best = retrieval.routed_messages(texts, requests, 1_717_200_000_000, 4)
        return found(best), found(retrieval.routed_stats(texts, requests, best))
    few = job()
    by_index(monkeypatch)
    monkeypatch.setattr(retrieval, "MAX_FITTING", -1)
    assert few == job() and all(few)


def test_texts_are_neither_cut_into_words_nor_shuffled(spark):
    texts, requests = rows(spark), asked(spark)
    index = TermIndex(texts, ["owner_id"], "text")
    assert "low" in index.columns and "low" not in spark.read.parquet(index.rows.inputFiles()[0]).columns
    hits = retrieval.matched(index, retrieval.with_terms(requests, retrieval.blank_terms("topic")), ["seq"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    plan = questions.lexical_hits(texts, requests.withColumnRenamed("topic", "phrase"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_a_task_passes_on_the_best_of_a_request(spark):
    texts = spark.range(5000, numPartitions=2).selectExpr("'o' AS owner_id", "id AS seq", "0.5 AS base", "concat('word', id % 3) AS low")
    texts = texts.withColumn("base", F.col("base").cast("double"))
    requests = spark.createDataFrame([("o", 1, ["word1"]), ("o", 2, ["none"])], "owner_id string, question_id int, terms array<string>")
    index = TermIndex(texts, ["owner_id"])
    got = retrieval.best_candidates(index, requests, ["base", "seq"], [retrieval.rising("seq")], 3, 8.0).collect()
    assert len(got) <= 2 * 2 * 3 and {(r.seq, r.hits) for r in got if r.question_id == 1} >= {(1, 1), (4, 1), (7, 1)}
    assert {(r.seq, r.hits) for r in got if r.question_id == 2} >= {(0, 0), (1, 0), (2, 0)}


def test_repeats_leave_room_for_others():
    top = term_scan._Top(2)
    for i in range(100):
        for order, key in (((i,), i // 50), ((200 - i,), "late"), ((300 + i,), -i)):
            if top.limit is None or order < top.limit:
                top.add(order, key, i)
    assert top.limit is not None and sorted(top.rows()) == [0, 50]
