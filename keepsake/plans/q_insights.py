"""Platforms, growth, contradictions and activity scores."""

from pyspark.sql import functions as F

from keepsake.functions.lexicons import STANCE_NEGATIVE, STANCE_POSITIVE, STANCE_TOPICS
from keepsake.operators import corpus, insights
from keepsake.plans.q_corpus import DATED, LINKS, TRIM, dated
from keepsake.plans.registry import query

# Channel and source names for the dense events, so that every platform occurs.
CHANNELS = ["Twitter feed", "x", "instagram dm", "insta", "FB", "facebook page", "tik tok", "LinkedIn",
            "spotify", "youtube_music", "dropbox", "max", "mail"]
SOURCES = ["sms", "youtube", "gmail", "google_voice", "chrome", "discover", "instagram"]


def chosen(values):
    return f"([{', '.join(repr(v) for v in values)}])[event_id % {len(values)} + 1]"


# The events span one month; orders, as events of a shop, give the owners rows in many.
EVENTS = f"""ev AS (SELECT owner_id, event_id, event_id AS seq, created_at, {chosen(CHANNELS)} AS channel, {chosen(SOURCES)} AS source, text FROM v_evt
    UNION ALL SELECT 'o' || (o_custkey % 3), 1000000000 + o_orderkey, 1000000000 + o_orderkey, o_orderdate, 'shop', 'shop', NULL FROM orders)"""
LIKE = {
    "twitter": r"twitter|x\b", "instagram": "instagram|insta", "facebook": r"facebook|fb\b",
    "tiktok": r"tiktok|tik\s*tok", "linkedin": "linkedin", "spotify": "spotify|music",
}
PLATFORMS = f"""{EVENTS}, counts AS (SELECT owner_id,
        {", ".join(f"count(*) FILTER (regexp_matches(lower(channel), '{p}')) AS {n}" for n, p in LIKE.items())},
        {", ".join(f"count(*) FILTER (source = '{s}') AS {s}" for s in SOURCES[1:6])},
        count(*) AS total_timeline FROM ev GROUP BY 1),
    forum AS (SELECT owner_id, count(*) AS reddit FROM (
        SELECT owner_id FROM v_comment UNION ALL SELECT owner_id FROM v_post UNION ALL
        SELECT owner_id FROM v_saved UNION ALL SELECT owner_id FROM v_upvoted) GROUP BY 1),
    wrote AS (SELECT owner_id, count(*) AS written FROM (
        SELECT owner_id FROM v_comment UNION ALL SELECT owner_id FROM v_post) GROUP BY 1),
    pf AS (SELECT * FROM counts JOIN forum USING (owner_id) JOIN wrote USING (owner_id))"""


def event_rows(t):
    def at(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]),
                            (F.col("event_id") % len(values) + 1).cast("int"))
    cols = ["owner_id", "event_id", "seq", "created_at", "channel", "source", "text"]
    number = F.col("o_orderkey") + 1_000_000_000
    orders = t.raw("orders").select(
        t.owner("o_custkey"), number.alias("event_id"), number.alias("seq"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.lit("shop").alias("channel"), F.lit("shop").alias("source"), F.lit(None).cast("string").alias("text"))
    return t.dense().withColumn("channel", at(CHANNELS)).withColumn("source", at(SOURCES)).select(cols).unionByName(
        orders.select(cols))


def parts(t):
    return insights.partials(t.comments(), t.posts(), t.saved(), t.upvoted(), event_rows(t))


def platforms(t):
    return insights.platform_counts(parts(t))


@query("agg_35_platform_counts", f"WITH {PLATFORMS} SELECT * FROM pf")
def _(t):
    return platforms(t)


@query("fn_28_channel_platforms", f"WITH {EVENTS} SELECT event_id, "
       + ", ".join(f"regexp_matches(lower(channel), '{p}') AS {n}" for n, p in LIKE.items()) + " FROM ev")
def _(t):
    return event_rows(t).select("event_id", *[
        insights.on_platform("channel", p).alias(p) for p in LIKE])


EIGHT = insights.PLATFORMS
TOTAL = "(" + " + ".join(EIGHT) + ")"
ENTROPY = " + ".join(
    f"CASE WHEN {p} > 0 THEN -({p} / {TOTAL}) * log2({p} / {TOTAL}) ELSE 0 END" for p in EIGHT)
COVER = "(" + " + ".join(f"({p} > 0)::INT" for p in EIGHT) + ") / 8.0::DOUBLE"


@query("agg_36_platform_entropy", f"""WITH {PLATFORMS}
    SELECT owner_id, round({ENTROPY}, 6) AS entropy, {COVER} AS coverage FROM pf""")
def _(t):
    cols = [F.col(p) for p in EIGHT]
    return platforms(t).select("owner_id", F.round(insights.entropy(cols), 6).alias("entropy"),
                               insights.coverage(cols).alias("coverage"))


MONTHS = """mon AS (SELECT owner_id, strftime(created_at, '%Y-%m') AS month, count(*) AS total FROM (
    SELECT owner_id, created_at FROM ev UNION ALL SELECT owner_id, created_at FROM v_comment UNION ALL
    SELECT owner_id, created_at FROM v_post UNION ALL SELECT owner_id, created_at FROM v_saved UNION ALL
    SELECT owner_id, created_at FROM v_upvoted) GROUP BY ALL)"""
GROWTH = f"""{MONTHS}, placed AS (SELECT *, count(*) OVER (PARTITION BY owner_id) AS n,
        row_number() OVER (PARTITION BY owner_id ORDER BY month) AS at_no FROM mon),
    gr AS (SELECT owner_id, max(n) AS months, coalesce(avg(total) FILTER (at_no > greatest(1, n // 2)), 0)
        - coalesce(avg(total) FILTER (at_no <= greatest(1, n // 2)), 0) AS growth FROM placed GROUP BY 1),
    gn AS (SELECT *, greatest(0, least(1, (growth + 50) / 120)) AS growth_norm FROM gr)"""


@query("agg_37_growth", f"""WITH {EVENTS}, {GROWTH}
    SELECT owner_id, months, round(growth, 6) AS growth, round(growth_norm, 6) AS growth_norm FROM gn""")
def _(t):
    return insights.growth(insights.month_totals(parts(t))).select(
        "owner_id", "months", F.round("growth", 6).alias("growth"),
        F.round("growth_norm", 6).alias("growth_norm"))


# The invented text has none of the opinion words; syllables that do occur stand in for them.
TOPICS = {"a": ["tion", "que"], "b": ["ung", "ción"], "c": ["the", "and"]}
PRO, CON = ["er", "mente"], ["heed", "eaux", "ich"]


def either(words):
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


def stance_sql(topics, pro, con, days, texts):
    tagged = " UNION ALL ".join(
        f"SELECT *, '{n}' AS topic FROM dt WHERE {either(k)}" for n, k in topics.items())
    return f"""dt AS (SELECT *, place * 10000000000 + seq AS at_no
        FROM {texts}), tg AS ({tagged}),
    sided AS (SELECT owner_id, topic, count(*) AS texts, min(at_no) FILTER ({either(pro)}) AS positive_at,
            min(at_no) FILTER ({either(con)}) AS negative_at,
            arg_min(created_at, at_no) FILTER ({either(pro)}) AS p, arg_min(created_at, at_no) FILTER ({either(con)}) AS c
        FROM tg GROUP BY ALL),
    con AS (SELECT owner_id, topic, positive_at, negative_at,
            abs(epoch_us(p) // 1000 - epoch_us(c) // 1000) / 86400000.0::DOUBLE AS gap_days FROM sided
        WHERE texts >= 2 AND abs(epoch_us(p) // 1000 - epoch_us(c) // 1000) / 86400000.0::DOUBLE >= {days})"""


def placed(t):
    """Texts in corpus order: comments, posts, messages, each table by its own numbers."""
    rows = corpus.dated_texts(t.comments(), t.posts(), t.messages(), most=1800)
    return rows.withColumn("corpus_seq", F.col("place") * F.lit(10_000_000_000) + F.col("seq"))


STORED = "substr(trim({}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1, 1800)"
PLACED = f"""(SELECT * FROM (SELECT owner_id, 'reddit' AS source, created_at, seq, 0 AS place, {STORED.format("body")} AS text FROM v_comment
    UNION ALL SELECT owner_id, 'reddit', created_at, seq, 1, {STORED.format("title || chr(10) || body")} FROM v_post
    UNION ALL SELECT owner_id, source, created_at, seq, 2, {STORED.format("text")} FROM v_msg) WHERE text <> '')"""


@query("jn_08_contradictions", f"""WITH {stance_sql(TOPICS, PRO, CON, 0.001, PLACED)}
    SELECT owner_id, topic, positive_at, negative_at, round(gap_days, 6) AS gap_days,
        row_number() OVER (PARTITION BY owner_id ORDER BY gap_days DESC, topic) AS rank FROM con
    QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY gap_days DESC, topic) <= 8""")
def _(t):
    return insights.contradictions(placed(t), TOPICS, PRO, CON, 0.001).withColumn(
        "gap_days", F.round("gap_days", 6))


@query("flt_19_late_and_long", f"""
    SELECT owner_id, (SELECT count(*) FROM v_comment c WHERE c.owner_id = d.owner_id
            AND len(regexp_extract_all(lower(body), '[a-z0-9'']+')) >= 80) AS long_form,
        count(*) AS corpus, count(*) FILTER (hour(created_at) BETWEEN 0 AND 5) AS late_night
    FROM {DATED} d GROUP BY owner_id""")
def _(t):
    return insights.corpus_flags(dated(t)).join(insights.long_texts(t.comments()), "owner_id")


# Texts with a date, whole, in corpus order; and the domains that any text links to.
TEXTS = f"""txt AS (SELECT * FROM (SELECT owner_id, created_at, seq, 0 AS place, body AS text FROM v_comment
    UNION ALL SELECT owner_id, created_at, seq, 1, title || chr(10) || body FROM v_post
    UNION ALL SELECT owner_id, created_at, seq, 2, text FROM ev) WHERE created_at IS NOT NULL AND trim(text, {TRIM}) <> ''),
    said AS (SELECT owner_id, body AS text FROM v_comment UNION ALL SELECT owner_id, title || chr(10) || body FROM v_post
    UNION ALL SELECT owner_id, title || chr(10) || permalink FROM v_saved UNION ALL SELECT owner_id, permalink FROM v_upvoted
    UNION ALL SELECT owner_id, text FROM ev)"""
LINKED = LINKS.replace("SELECT owner_id, text FROM v_corpus UNION ALL SELECT owner_id, url FROM v_page", "SELECT * FROM said")
SCORES = f"""{PLATFORMS}, {GROWTH}, {TEXTS}, {stance_sql(STANCE_TOPICS, STANCE_POSITIVE, STANCE_NEGATIVE, 7, "txt")},
    nc AS (SELECT owner_id, count(*) AS conflicts FROM con GROUP BY 1),
    fl AS (SELECT owner_id, count(*) AS corpus, count(*) FILTER (hour(created_at) BETWEEN 0 AND 5) AS late_night
           FROM txt GROUP BY 1),
    lf AS (SELECT owner_id, count(*) FILTER (len(regexp_extract_all(lower(body), '[a-z0-9'']+')) >= 80) AS long_form
           FROM v_comment GROUP BY 1),
    dm AS (SELECT owner_id, count(DISTINCT domain) AS domains FROM {LINKED} GROUP BY 1),
    k AS (SELECT *, linkedin + twitter + instagram + facebook AS pub, reddit + youtube + gmail + google_voice AS priv,
            youtube + chrome + discover AS passive, written + twitter + instagram + facebook + linkedin AS active,
            {COVER} AS cover, least(1, coalesce(conflicts, 0) / 6) AS conflict FROM pf
          JOIN gn USING (owner_id) JOIN fl USING (owner_id) JOIN lf USING (owner_id) LEFT JOIN dm USING (owner_id)
          LEFT JOIN nc USING (owner_id)),
    sc AS (SELECT owner_id, priv / greatest(1, pub + priv) AS public_private,
        active / greatest(1, active + passive) AS consumption_creation,
        greatest(0, least(1, 0.45 + 0.4 * cover - 0.2 * conflict)) AS stated_revealed,
        priv / greatest(1, pub + priv) AS authenticity,
        least(1, (long_form / 800 + youtube / 2500) / 2) AS knowledge_map, cover AS social_identity,
        least(1, months / 36) AS temporal_patterns, conflict AS contradiction_detector,
        least(1, (months / 48 + growth_norm) / 2) AS life_phase, least(1, coalesce(domains, 0) / 80) AS influence_sources,
        active / greatest(1, active + passive) AS energy_investment,
        passive / greatest(1, active + passive) AS hidden_interests, pub / greatest(1, pub + priv) AS performativity,
        least(1, ({ENTROPY}) / 3) AS identity_fragmentation, greatest(0, 0.9 - 0.5 * conflict) AS value_alignment,
        least(1, 2 * late_night / greatest(1, corpus)) AS loneliness, growth_norm AS growth,
        (growth_norm + cover) / 2 AS future FROM k)"""
NAMES = [
    "public_private", "consumption_creation", "stated_revealed", "authenticity", "knowledge_map",
    "social_identity", "temporal_patterns", "contradiction_detector", "life_phase",
    "influence_sources", "energy_investment", "hidden_interests", "performativity",
    "identity_fragmentation", "value_alignment", "loneliness", "growth", "future"]


def score_rows(t):
    return insights.scores(parts(t))


@query("agg_38_activity_scores", f"""WITH {SCORES}
    SELECT owner_id, {", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in NAMES)} FROM sc""")
def _(t):
    return score_rows(t).select("owner_id", *[F.round(n, 6).alias(n) for n in NAMES])


@query("agg_40_contradiction_matrix", f"""WITH {SCORES}
    SELECT owner_id, axis, round(a * contradiction_detector::DOUBLE, 6) AS reddit,
        round(b * contradiction_detector::DOUBLE, 6) AS linkedin, round(c * contradiction_detector::DOUBLE, 6) AS instagram
    FROM sc, (VALUES {", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in insights.MATRIX.items())}) m(axis, a, b, c)""")
def _(t):
    out = insights.contradiction_matrix(score_rows(t))
    for c in ("reddit", "linkedin", "instagram"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("agg_40_authenticity_ranking", f"""WITH {PLATFORMS}, r AS (
        {" UNION ALL ".join(f"SELECT owner_id, '{p}' AS platform, {p} AS rows, {s}::DOUBLE AS score FROM pf" for p, s in insights.AUTHENTICITY.items())})
    SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY score DESC, platform) AS rank FROM r WHERE rows > 0""")
def _(t):
    return insights.authenticity_ranking(platforms(t))


@query("agg_40_constellation", f"""WITH {PLATFORMS}, v AS (SELECT owner_id,
        (linkedin + 0.4 * twitter)::DOUBLE AS a, (reddit + 0.2 * youtube)::DOUBLE AS b,
        (instagram + facebook + 0.5 * tiktok)::DOUBLE AS c, (spotify + 0.3 * youtube + 0.2 * instagram)::DOUBLE AS d FROM pf),
    w AS (SELECT owner_id, greatest(1, a, b, c, d) AS m, unnest(['Professional', 'Anonymous', 'Social', 'Creative']) AS side,
        unnest([a, b, c, d]) AS value FROM v)
    SELECT owner_id, side, round(value, 6) AS value, CAST(44 + floor(56 * value / m + 0.5) AS BIGINT) AS size FROM w""")
def _(t):
    return insights.constellation(platforms(t)).withColumn("value", F.round("value", 6))


@query("agg_40_effort_shares", f"""WITH {PLATFORMS}, w AS (SELECT owner_id,
        unnest(['create', 'consume', 'react']) AS effort, unnest([written, youtube, instagram + facebook + tiktok]) AS rows,
        greatest(1, written, youtube, instagram + facebook + tiktok) AS m FROM pf)
    SELECT owner_id, effort, rows, CAST(floor(100 * rows / m + 0.5) AS BIGINT) AS percent FROM w""")
def _(t):
    return insights.effort_shares(platforms(t))
