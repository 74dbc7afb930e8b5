"""Gaps, merging and cutting of conversations; the same result however hot a slot is."""

from datetime import datetime, timedelta, timezone

import pytest

from keepsake.operators import sessions

SCHEMA = ("owner_id string, seq bigint, source string, participants array<string>, text string, "
          "created_at timestamp, is_user_message boolean")
START = datetime(2024, 3, 1, tzinfo=timezone.utc)
HOUR = timedelta(hours=1)
MS = timedelta(milliseconds=1)


def events(spark, times, contact="Ana"):
    return spark.createDataFrame(
        [("a", i, "sms", ["Me", contact], f"m{i}", t, i % 2 == 0) for i, t in enumerate(times)], SCHEMA)


@pytest.mark.parametrize("gap,conversations,pauses", [
    (2 * HOUR, 1, 0), (2 * HOUR + MS, 1, 1), (6 * HOUR, 1, 1), (6 * HOUR + MS, 2, 0)])
def test_gap_edges(spark, gap, conversations, pauses):
    table = sessions.slots(sessions.prepare(events(spark, [START, START + gap])))
    rows = sessions.conversations(table).collect()
    assert len(rows) == conversations and sum(r.gap_count for r in rows) == pauses


def test_undated_and_other_sources_stay_out(spark):
    assert sessions.prepare(events(spark, [None, START])).count() == 1


@pytest.mark.parametrize("n,sizes", [
    (29, [29]), (30, [30]), (150, [150]), (151, [150, 1]), (301, [150, 150, 1])])
@pytest.mark.parametrize("hot", [1, 10**6])
def test_chunk_sizes(spark, n, sizes, hot):
    rows = sessions.chunks(events(spark, [START + i * MS for i in range(n)]), hot_slot=hot
                           ).orderBy("start_ms").collect()
    assert [r.message_count for r in rows] == sizes
    assert rows[0].chunk_id.endswith("_merged") == (n < 30)
    assert {r.gap_count for r in rows} == {1}


def test_small_conversations_add_up(spark):
    times = [START + d * 24 * HOUR + m * timedelta(minutes=1) for d in range(7) for m in range(10)]
    rows = sessions.chunks(events(spark, times)).orderBy("start_ms").collect()
    assert [(r.message_count, r.gap_count) for r in rows] == [(30, 3), (30, 3), (10, 1)]


def test_equal_times_number_by_seq(spark):
    for hot in (1, 3, 10**6):
        m = sessions.chunk_messages(events(spark, [START] * 20), hot_slot=hot)
        assert [r.position for r in m.orderBy("seq").collect()] == list(range(20))


def test_partitions_and_order_do_not_matter(spark):
    times = [START + timedelta(minutes=37 * i * i % 5000) for i in range(300)]
    plain = sessions.chunks(events(spark, times), min_messages=5, max_messages=8).collect()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            mixed = events(spark, times).orderBy("text").repartition(7)
            again = sessions.chunks(mixed, min_messages=5, max_messages=8).collect()
            assert sorted(map(tuple, again)) == sorted(map(tuple, plain))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(r.message_count for r in plain) == 300
