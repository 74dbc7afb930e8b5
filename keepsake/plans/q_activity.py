"""Counts over the timeline."""

from pyspark.sql import functions as F

from keepsake.functions import times
from keepsake.operators import activity
from keepsake.plans.registry import query


@query("agg_08_most_texted", """
    SELECT owner_id, contact, count(*) AS messages,
           row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, contact) AS rank
    FROM v_evt GROUP BY owner_id, contact
    QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, contact) <= 15""")
def _(t):
    return activity.most_texted(t.dense())


@query("agg_01_events_per_source", """
    SELECT owner_id, source, count(*) AS events FROM v_timeline GROUP BY ALL""")
def _(t):
    return activity.per_source(t.timeline())


def top_sql(item, view, k, where="true"):
    order = f"PARTITION BY owner_id ORDER BY count(*) DESC, {item}"
    return f"""
    SELECT owner_id, {item}, count(*) AS count, row_number() OVER ({order}) AS rank
    FROM {view} WHERE {item} IS NOT NULL AND {where} GROUP BY owner_id, {item}
    QUALIFY row_number() OVER ({order}) <= {k}"""


@query("agg_01_events_per_channel", """
    SELECT owner_id, channel, count(*) AS events FROM v_evt GROUP BY ALL""")
def _(t):
    return t.dense().groupBy("owner_id", "channel").agg(F.count(F.lit(1)).alias("events"))


@query("agg_04_top_upvoted_communities", top_sql("subreddit", "v_upvoted", 12))
def _(t):
    return activity.top_values(t.upvoted(), "subreddit", 12)


@query("agg_04_top_sources", top_sql("source", "v_timeline", 12))
def _(t):
    return activity.top_values(t.timeline(), "source", 12)


@query("agg_04_top_channels", top_sql("channel", "v_timeline", 12))
def _(t):
    return activity.top_values(t.timeline(), "channel", 12)


@query("agg_09_browsing_domains", """
    WITH hosts AS (
        SELECT owner_id, regexp_replace(lower(regexp_extract(
            url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\\s]+)', 1)), '^www\\.', '') AS domain
        FROM v_page JOIN events ON page_id = event_id)
    SELECT owner_id, domain, count(*) AS visits,
           row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, domain) AS rank
    FROM hosts WHERE domain <> '' GROUP BY owner_id, domain
    QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, domain) <= 30""")
def _(t):
    return activity.browsing_domains(t.timeline())


@query("agg_10_activity_per_day", """
    SELECT owner_id, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS count
    FROM (SELECT owner_id, created_at FROM v_comment UNION ALL
          SELECT owner_id, created_at FROM v_post) GROUP BY ALL""")
def _(t):
    return activity.per_day(t.comments(), t.posts())


MONTH_SOURCE = """
    SELECT owner_id, strftime(created_at, '%Y-%m') AS month, source, count(*) AS count
    FROM (SELECT owner_id, created_at, 'reddit' AS source FROM v_comment
          UNION ALL SELECT owner_id, created_at, 'reddit' FROM v_post
          UNION ALL SELECT owner_id, created_at, 'reddit' FROM v_saved
          UNION ALL SELECT owner_id, created_at, 'reddit' FROM v_upvoted
          UNION ALL SELECT owner_id, created_at, source FROM v_evt
          UNION ALL SELECT owner_id, created_at, source FROM v_timeline)
    WHERE created_at IS NOT NULL GROUP BY ALL"""


def month_sources(t):
    forum = (t.comments(), t.posts(), t.saved(), t.upvoted())
    events = t.dense().select("owner_id", "created_at", "source").unionByName(
        t.timeline().select("owner_id", "created_at", "source"))
    return activity.month_sources(forum, events)


@query("agg_11_activity_per_month_and_source", MONTH_SOURCE)
def _(t):
    return month_sources(t)


@query("agg_11_activity_per_month", f"""
    SELECT owner_id, month, CAST(sum(count) AS BIGINT) AS total,
           string_agg(source || '=' || count, ',' ORDER BY source) AS split
    FROM ({MONTH_SOURCE}) GROUP BY owner_id, month""")
def _(t):
    pairs = F.transform(F.map_entries("by_source"),
                        lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return activity.monthly(month_sources(t)).select(
        "owner_id", "month", "total", F.array_join(pairs, ",").alias("split"))


@query("agg_12_active_communities", top_sql(
    "subreddit", "(SELECT owner_id, subreddit FROM v_comment UNION ALL "
    "SELECT owner_id, subreddit FROM v_post)", 10))
def _(t):
    return activity.active_communities(t.comments(), t.posts())


@query("agg_13_date_ranges", """
    SELECT owner_id, dataset, count(*) AS count,
           strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_at,
           strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_at
    FROM (SELECT owner_id, 'comments' AS dataset, created_at FROM v_comment
          UNION ALL SELECT owner_id, 'posts', created_at FROM v_post
          UNION ALL SELECT owner_id, 'saved', created_at FROM v_saved
          UNION ALL SELECT owner_id, 'upvoted', created_at FROM v_upvoted
          UNION ALL SELECT owner_id, 'events', created_at FROM v_evt) GROUP BY ALL""")
def _(t):
    ranges = activity.date_ranges({
        "comments": t.comments(), "posts": t.posts(), "saved": t.saved(),
        "upvoted": t.upvoted(), "events": t.dense()})
    for c in ("first_at", "last_at"):
        ranges = ranges.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return ranges


@query("set_04_distinct_participants", """
    SELECT DISTINCT owner_id, name FROM (
        SELECT owner_id, contact AS name FROM v_evt UNION ALL SELECT owner_id, 'Me' FROM v_evt)""")
def _(t):
    return activity.distinct_participants(t.dense())


@query("win_06_samples_per_source", r"""
    SELECT owner_id, source, channel, seq, strftime(created_at, '%Y-%m-%d') AS day,
           substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 240) AS sample,
           row_number() OVER (PARTITION BY owner_id, source ORDER BY seq) AS rank
    FROM v_timeline QUALIFY row_number() OVER (PARTITION BY owner_id, source ORDER BY seq) <= 3""")
def _(t):
    return activity.samples_per_source(t.timeline()).select(
        "owner_id", "source", "channel", "seq", times.day_key("created_at").alias("day"),
        "sample", "rank")


@query("win_06_recent_per_source", r"""
    SELECT owner_id, source, seq, channel,
           substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1,
                  CASE source WHEN 'sms' THEN 150 ELSE 220 END) AS line,
           row_number() OVER (PARTITION BY owner_id, source
                              ORDER BY created_at DESC NULLS LAST, seq DESC) AS rank
    FROM v_timeline WHERE source IN ('sms', 'chrome')
    QUALIFY row_number() OVER (PARTITION BY owner_id, source
                               ORDER BY created_at DESC NULLS LAST, seq DESC)
            <= CASE source WHEN 'sms' THEN 200 ELSE 10 END""")
def _(t):
    return activity.recent_per_source(t.timeline()).select(
        "owner_id", "source", "seq", "channel", "line", "rank")


@query("top_18_timeline_order", """
    SELECT owner_id, source, seq, row_number() OVER (
        PARTITION BY owner_id ORDER BY coalesce(epoch_us(created_at) // 1000, 0) DESC, seq) AS rank
    FROM v_timeline QUALIFY row_number() OVER (
        PARTITION BY owner_id ORDER BY coalesce(epoch_us(created_at) // 1000, 0) DESC, seq) <= 100""")
def _(t):
    from keepsake.operators.ranking import top_k
    from keepsake.plans.tables import newest_first
    rows = t.timeline().select("owner_id", "source", "seq", "created_at")
    return top_k(rows, ["owner_id"], newest_first(), 100).drop("created_at")
