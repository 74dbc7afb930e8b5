"""Stored tables: pruning by key bucket, the change log, state as of a time."""

from datetime import datetime

from pyspark.sql import functions as F

from keepsake.plans import tables

EVENT = "owner_id string, source string, kind string, text string, created_at timestamp, external_id string, seq bigint"


def events(spark, numbers):
    return spark.createDataFrame([(f"o{i % 3}", "sms", "message", f"text {i}", datetime(2024, 1, 1 + i % 28), None, i) for i in numbers], EVENT)


def test_a_small_batch_reads_few_buckets(spark, tmp_path):
    path = str(tmp_path / "timeline")
    tables.import_events(spark, path, events(spark, range(2000)))
    batch = events(spark, [3, 3, 7, 2000, 2001, 2002])
    plan = tables.stored_keys(spark, path, batch)
    text = plan._jdf.queryExecution().executedPlan().toString()
    read = {r[0] for r in plan.select(F.regexp_extract(F.input_file_name(), "key_bucket=(\\d+)", 1)).distinct().collect()}
    held = {str(r[0]) for r in tables.with_key(batch).select(tables.key_bucket()).distinct().collect()}
    assert "PartitionFilters: [key_bucket" in text and read <= held and len(held) <= 5
    tables.import_events(spark, path, batch)
    tables.import_events(spark, path, batch)
    got = tables.read_timeline(spark, path)
    assert sorted(r.seq for r in got.collect()) == list(range(2003)) and "key_bucket" not in got.columns


def test_a_session_with_many_corrections(spark, tmp_path):
    path = str(tmp_path / "changes")
    sessions = spark.createDataFrame([("a", i, f"topic {i}", 1.5) for i in range(3)], "owner_id string, session_id bigint, topic string, score double")
    many = spark.range(10_000).selectExpr("'a' AS owner_id", "cast(1 AS bigint) AS session_id", "id AS seq", "concat('fix ', id) AS feedback")
    update = lambda rows: tables.updates_as_changes(spark.createDataFrame(rows, "owner_id string, session_id bigint, topic string, score double"), ["topic", "score"])
    assert tables.read_changes(spark, path).count() == 0
    tables.compact_changes(spark, path)
    tables.log_changes(tables.corrections_as_changes(many), path, 1)
    tables.log_changes(update([("a", 0, "new", None), ("a", 2, "two", 2.0)]), path, 2)
    tables.compact_changes(spark, path)
    tables.compact_changes(spark, path)
    tables.log_changes(update([("a", 0, None, 9.0), ("b", 0, "nobody's", None)]), path, 3)
    tables.log_changes(update([("a", 0, None, 9.0), ("b", 0, "nobody's", None)]), path, 3)  # written again after a failure
    want = {0: ("new", 9.0), 1: ("topic 1", 1.5), 2: ("two", 2.0)}
    for _ in range(2):
        changes = tables.read_changes(spark, path)
        got = tables.update_sessions(sessions, changes, ["topic", "score"]).collect()
        assert {r.session_id: (r.topic, r.score) for r in got} == want
        fixes = tables.corrections_of(changes).filter("session_id = 1").collect()
        assert sorted((r.place, r.feedback) for r in fixes) == [(i + 1, f"fix {i}") for i in range(10_000)]
        tables.compact_changes(spark, path)
    # A compaction that was cut off before its row was written does not count.
    (tmp_path / "changes" / "base" / "upto=99").mkdir()
    assert tables.read_changes(spark, path).count() == 10_000 + 5


def test_state_as_of(spark, tmp_path):
    path, day = str(tmp_path / "state"), lambda n: F.lit(f"2024-01-{n:02}").cast("timestamp")
    rows = spark.createDataFrame([("a", "k", "one"), ("b", "k", None)], "owner_id string, contact_key string, v string")
    asked = spark.createDataFrame([("a", "k", i) for i in (1, 2, 3, 5, 9)] + [("a", "k", 9), ("c", "k", 9)], "owner_id string, contact_key string, n int")
    asked = asked.withColumn("at", F.to_timestamp(F.concat(F.lit("2024-01-0"), "n")))
    assert tables.state_as_of(tables.read_state(spark, path), asked, ["x"]).filter("x IS NOT NULL").count() == 0
    tables.set_state(rows, path, "x", "v", day(2))
    tables.set_state(rows.withColumn("v", F.lit("two")), path, "x", "v", day(5))
    tables.set_state(rows.withColumn("v", F.lit("tie")), path, "x", "v", day(5))
    tables.set_state(rows.limit(1), path, "y", "v", day(3))
    got = tables.state_as_of(tables.read_state(spark, path), asked, ["x", "y"]).collect()
    assert sorted((r.owner_id, r.n, r.x, r.y) for r in got if r.owner_id == "a") == [
        ("a", 1, None, None), ("a", 2, "one", None), ("a", 3, "one", "one"), ("a", 5, "two", "one"), ("a", 9, "two", "one"), ("a", 9, "two", "one")]
    assert [(r.x, r.y) for r in got if r.owner_id == "c"] == [(None, None)]


def test_levels_of_chunks(spark):
    from keepsake.operators import sessions
    hour = 3_600_000
    chunks = spark.createDataFrame([("a", "k", "short", 0, hour // 2), ("a", "m", "long", 0, 90 * 24 * hour), ("a", "m", "mid", hour, 5 * hour)],
                                   "owner_id string, contact_key string, chunk_id string, start_ms bigint, end_ms bigint")
    messages = spark.createDataFrame([("a", k, t) for k in "kmn" for t in (0, hour // 2, hour // 2 + 1, 2 * hour)],
                                     "owner_id string, contact_key string, ts_ms bigint")
    got = sorted((r.contact_key, r.chunk_id, r.ts_ms) for r in sessions.messages_in_chunks(chunks, messages).collect())
    assert got == sorted([("k", "short", 0), ("k", "short", hour // 2), ("m", "mid", 2 * hour)]
                         + [("m", "long", t) for t in (0, hour // 2, hour // 2 + 1, 2 * hour)])
