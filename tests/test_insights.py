"""Scores come from one pass over each table."""

from datetime import datetime

from pyspark.sql import functions as F

from keepsake.operators import insights

FORUM = "owner_id string, seq bigint, created_at timestamp, title string, body string, permalink string"
EVENT = "owner_id string, seq bigint, created_at timestamp, text string, source string, channel string"


def tables(spark):
    day = datetime(2024, 1, 5, 3)
    forum = spark.createDataFrame([("a", 1, day, "t", "I love my job https://www.x.org/a https://x.org", "/p"),
                                   ("a", 2, None, None, None, None), ("b", 1, day, None, "word " * 80, None)], FORUM)
    events = spark.createDataFrame([("a", 1, datetime(2024, 3, 5), "I hate my job", "sms", "Twitter"),
                                    ("a", 2, datetime(2024, 3, 6), None, "chrome", None),
                                    (None, 3, None, " ", "sms", "insta")], EVENT)
    return forum, forum.filter("seq = 1"), forum.limit(0), forum, events


def test_partial_sums(spark):
    parts = insights.partials(*tables(spark))
    own = {r.owner_id: r for r in insights.platform_counts(parts).collect()}
    a = own["a"]
    assert (a.reddit, a.written, a.total_timeline, a.twitter, a.chrome) == (5, 3, 2, 1, 1)
    assert own[None].instagram == 1 and own["b"].total_timeline == 0
    months = {(r.owner_id, r.month): r.total for r in insights.month_totals(parts).collect()}
    assert months == {("a", "2024-01"): 3, ("b", "2024-01"): 3, ("a", "2024-03"): 2}
    score = {r.owner_id: r for r in insights.scores(parts).collect()}
    # One topic with both sides, 60 days apart; one host, whatever its spelling.
    assert abs(score["a"].contradiction_detector - 1 / 6) < 1e-9 and score["a"].influence_sources == 1 / 80
    assert score["b"].loneliness == 1.0


def test_one_scan_of_each_table(spark, tmp_path, monkeypatch):
    paths = []
    for i, df in enumerate(tables(spark)):
        df.write.parquet(str(tmp_path / str(i)))
        paths.append(spark.read.parquet(str(tmp_path / str(i))))
    plans = []
    monkeypatch.setattr(insights, "stored", lambda df, name: plans.append(df) or df)
    insights.partials(*paths)
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert [text.count(f"{tmp_path / str(i)}") for i in range(5)] == [1] * 5
