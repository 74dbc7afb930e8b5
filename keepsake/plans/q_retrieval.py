"""Ranked retrieval for batches of requests made from the benchmark texts."""

from pyspark.sql import functions as F

from keepsake.functions.lexicons import QUESTION_STOP_WORDS, TOPIC_STOP_WORDS
from keepsake.operators import retrieval
from keepsake.operators.clusters import with_classes
from keepsake.plans.q_contacts import class_sql
from keepsake.plans.q_corpus import TRIM, quoted
from keepsake.plans.registry import query

NOW = 1_717_200_000_000
# Each benchmark text, whole, is a request of its owner.
ASKED = f"""asked AS (
        SELECT item_id AS question_id, 'o' || (item_id % 3) AS owner_id, text AS topic, trim(lower(text), {TRIM}) AS phrase,
               regexp_extract_all(lower(text), '[a-z0-9'']+') AS w,
               [x for x in regexp_split_to_array(lower(text), '\\s+') if length(x) >= 3] AS pieces,
               CASE WHEN item_id % 2 = 0 THEN 'src' || (item_id % 20) END AS target,
               (['casual', NULL, 'professional', NULL])[item_id % 4 + 1] AS preferred,
               (['personal_text', 'public_post', 'professional', 'unfiltered_me', 'other'])[item_id % 5 + 1] AS mode
        FROM benchmark)"""


def asked(t):
    n = F.col("item_id")
    modes = F.array(*[F.lit(m) for m in (
        "personal_text", "public_post", "professional", "unfiltered_me", "other")])
    return t.raw("benchmark").select(
        n.alias("question_id"), t.owner("item_id"),
        F.col("text").alias("topic"),
        F.when(n % 2 == 0, F.concat(F.lit("src"), (n % 20).cast("string"))).alias("target"),
        F.when(n % 4 == 0, "casual").when(n % 4 == 2, "professional").alias("preferred"),
        F.element_at(modes, (n % 5 + 1).cast("int")).alias("mode"),
        F.when(n % 7 == 0, F.array(F.lit("sms"))).otherwise(
            F.array().cast("array<string>")).alias("locked"))


def terms(stop=(), distinct=False):
    kept = "[x for x in w if length(x) >= 3" + (
        f" AND x NOT IN ({quoted(stop)})" if stop else "") + "]"
    return f"list_distinct({kept})" if distinct else kept


FORUM = """forum AS (
        SELECT owner_id, 0 AS place, seq, id, subreddit, created_at, body AS text, score, 'comment' AS kind FROM v_comment
        UNION ALL SELECT owner_id, 1, seq, id, subreddit, created_at, title || chr(10) || body, score, 'post' FROM v_post
        UNION ALL SELECT owner_id, 2, seq, id, subreddit, created_at, title || chr(10) || permalink, NULL, 'saved' FROM v_saved
        UNION ALL SELECT owner_id, 3, seq, id, subreddit, created_at, chr(10) || permalink, NULL, 'upvoted' FROM v_upvoted)"""


def hits(low, words):
    return f"len([x for x in {words} if contains({low}, x)])"


def snip(at, before=80, after=160):
    start = f"greatest(0, {at} - {before})"
    return (f"trim(regexp_replace(substr(text, {start} + 1, {at} + {after} - {start}), "
            rf"'\s+', ' ', 'g'))")


ASK = "owner_id, question_id"


def first(k, order, keys="a.owner_id, a.question_id"):
    return f"row_number() OVER (PARTITION BY {keys} ORDER BY {order})"


@query("top_01_search", f"""WITH {ASKED}, {FORUM}
    SELECT a.owner_id, question_id, kind, id, {snip("(instr(lower(text), phrase) - 1)")} AS snippet,
        {first(25, 'place, seq')} AS rank
    FROM asked a JOIN forum f ON f.owner_id = a.owner_id AND contains(lower(text), phrase)
    QUALIFY {first(25, 'place, seq')} <= 25""")
def _(t):
    rows = retrieval.forum_rows(t.comments(), t.posts(), t.saved(), t.upvoted())
    return retrieval.search(rows, asked(t)).select(
        "owner_id", "question_id", "kind", "id", "snippet", "rank")


POINTS = f"""(CASE WHEN contains(lower(text), phrase) THEN {{}} ELSE 0 END
    + {{}} * {hits('lower(text)', 'terms')})"""
AT = """greatest(0, CASE WHEN contains(lower(text), phrase) THEN instr(lower(text), phrase)
    ELSE instr(lower(text), coalesce(terms[1], '')) END - 1)"""
# list_distinct keeps no order, and the snippet needs the first word.
WORDED = f"""worded AS (SELECT * EXCLUDE (w), [w[i] for i in range(1, len(w) + 1)
        if length(w[i]) >= 3 AND w[i] NOT IN ({quoted(QUESTION_STOP_WORDS)})
           AND list_position(w, w[i]) = i] AS terms FROM asked WHERE length(phrase) >= 2)"""


@query("top_02_general_retrieval", f"""WITH {ASKED}, {FORUM}, {WORDED}, s AS (
        SELECT a.owner_id, question_id, kind, id, place, seq, {snip(AT)} AS snippet,
            {POINTS.format(6, 3)} AS points, greatest(0, coalesce(score, 0)) * 0.01 AS votes
        FROM worded a JOIN forum f ON f.owner_id = a.owner_id WHERE place < 2)
    SELECT owner_id, question_id, kind, id, snippet, round(points + votes, 6) AS score,
        {first(6, 'points + votes DESC, place, seq', ASK)} AS rank FROM s WHERE points > 0
    QUALIFY {first(6, 'points + votes DESC, place, seq', ASK)} <= 6""")
def _(t):
    rows = retrieval.forum_rows(t.comments(), t.posts())
    return retrieval.general(rows, asked(t)).select(
        "owner_id", "question_id", "kind", "id", "snippet", F.round("score", 6).alias("score"), "rank")


@query("top_03_message_hits", f"""WITH {ASKED}, {WORDED}, m AS (
        SELECT * REPLACE (trim(text, {TRIM}) AS text) FROM v_msg)
    SELECT a.owner_id, question_id, event_id, CAST({POINTS.format(8, 4)} AS BIGINT) AS score,
        '[SMS ' || CASE WHEN is_user_message THEN 'Me' ELSE 'Them' END || ' to Me, ' || contact || '] '
        || {snip(AT)} AS snippet
    FROM worded a JOIN m ON m.owner_id = a.owner_id WHERE {POINTS.format(8, 4)} > 0""")
def _(t):
    return retrieval.message_hits(t.messages(), asked(t)).select(
        "owner_id", "question_id", F.col("seq").alias("event_id"),
        F.col("score").cast("long").alias("score"), "snippet")


@query("top_05_relevant_comments", f"""WITH {ASKED}
    SELECT a.owner_id, question_id, id, CAST({hits('lower(body)', 'pieces')} AS BIGINT) AS hits
    FROM asked a JOIN v_comment c ON c.owner_id = a.owner_id WHERE {hits('lower(body)', 'pieces')} > 0""")
def _(t):
    return retrieval.relevant_comments(t.comments(), asked(t)).select(
        "owner_id", "question_id", "id", F.col("hits").cast("long").alias("hits"))


KEY = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"


@query("top_06_write_examples", rf"""WITH {ASKED}, q AS (SELECT *, {terms()} AS terms FROM asked), {FORUM},
    p AS (SELECT owner_id, place, seq, score, trim(text, {TRIM}) AS text FROM forum
          WHERE place < 2 AND length(trim(text, {TRIM})) >= 10),
    c AS (SELECT *, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS example FROM p),
    n AS (SELECT *, len(regexp_extract_all(lower(example), '[a-z0-9'']+')) AS words FROM c),
    s AS (SELECT a.owner_id, question_id, example, words, place, seq, {hits('lower(example)', 'terms')} AS hits,
            12 * {hits('lower(example)', 'terms')} + (CASE WHEN words < 50 THEN 10.0 WHEN words < 100 THEN 5.0
            ELSE least(3.0, 300.0 / words) END + greatest(0, coalesce(score, 0)) * 0.02)::DOUBLE AS score
          FROM q a JOIN n ON n.owner_id = a.owner_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY {ASK} ORDER BY hits > 0 DESC, score DESC, place, seq) AS every,
            row_number() OVER (PARTITION BY {ASK}, words < 80 ORDER BY hits > 0 DESC, score DESC, place, seq) AS short
          FROM s),
    u AS (SELECT *, every AS place_no FROM r WHERE every <= 8 AND hits > 0
          UNION ALL SELECT *, 8 + short FROM r WHERE words < 80 AND short <= 6
          UNION ALL SELECT *, 14 + every FROM r WHERE every <= 4),
    d AS (SELECT * FROM u QUALIFY row_number() OVER (
            PARTITION BY {ASK}, {KEY.format('example')} ORDER BY place_no) = 1)
    SELECT {ASK}, example, CAST(hits AS BIGINT) AS hits, {first(15, 'place_no', ASK)} AS rank FROM d
    QUALIFY {first(15, 'place_no', ASK)} <= 15""")
def _(t):
    return retrieval.write_examples(t.comments(), t.posts(), asked(t)).withColumn(
        "hits", F.col("hits").cast("long"))


CROSS = rf"""x AS (
        SELECT owner_id, source, channel, created_at, seq, trim(text, {TRIM}) AS text FROM {{}}
        WHERE length(trim(text, {TRIM})) >= 20),
    xs AS (SELECT a.owner_id, question_id, seq,
             '[' || source || coalesce('/' || channel, '') || '] ' || coalesce(strftime(created_at, '%Y-%m-%d'), 'no-date')
             || chr(10) || substr(text, 1, 500) AS line,
             8 * {hits('lower(text)', 'terms')} + (CASE WHEN source = 'reddit' THEN 0.0 ELSE 1.0 END
             + least(6.0::DOUBLE, length(text)::DOUBLE / 180)) AS score
           FROM q a JOIN x ON x.owner_id = a.owner_id),
    xc AS (SELECT *, {first(0, 'score DESC, seq', ASK)} AS cut FROM xs
           QUALIFY {first(0, 'score DESC, seq', ASK)} <= {{}}),
    xd AS (SELECT * FROM xc QUALIFY row_number() OVER (
             PARTITION BY {ASK}, {KEY.format('line')} ORDER BY cut) = 1)"""


@query("top_07_cross_platform_examples", f"""WITH {ASKED}, q AS (SELECT *, {terms()} AS terms FROM asked),
    {CROSS.format('v_timeline', 10)}
    SELECT {ASK}, line, round(score, 6) AS score, {first(0, 'cut', ASK)} AS rank FROM xd""")
def _(t):
    return retrieval.cross_platform_examples(t.timeline(), asked(t)).withColumn(
        "score", F.round("score", 6))


@query("top_08_message_examples", rf"""WITH {ASKED}, q AS (SELECT *, {terms()} AS terms FROM asked),
    m AS (SELECT owner_id, created_at, seq, trim(text, {TRIM}) AS text FROM v_msg
          WHERE is_user_message AND length(trim(text, {TRIM})) >= 8),
    s AS (SELECT a.owner_id, question_id, created_at, seq, substr(text, 1, 500) AS example,
            10 * {hits('lower(text)', 'terms')} + least(6.0::DOUBLE, length(text)::DOUBLE / 120) AS score
          FROM q a JOIN m ON m.owner_id = a.owner_id),
    c AS (SELECT *, {first(0, 'score DESC, created_at DESC, seq', ASK)} AS cut FROM s
          QUALIFY {first(0, 'score DESC, created_at DESC, seq', ASK)} <= 30),
    d AS (SELECT * FROM c QUALIFY row_number() OVER (
            PARTITION BY {ASK}, {KEY.format('example')} ORDER BY cut) = 1)
    SELECT {ASK}, example, round(score, 6) AS score, {first(0, 'cut', ASK)} AS rank FROM d
    QUALIFY {first(0, 'cut', ASK)} <= 10""")
def _(t):
    return retrieval.message_examples(t.messages(), asked(t)).withColumn("score", F.round("score", 6))


LENGTH = ("CASE WHEN length(text) < 20 THEN 0.5 WHEN length(text) < 150 THEN 2.0 "
          "WHEN length(text) < 400 THEN 1.5 ELSE 0.8 END::DOUBLE")
OUTBOUND = rf"""m AS (
        SELECT owner_id, created_at, seq, channel, trim(text, {TRIM}) AS text FROM v_msg
        WHERE is_user_message AND length(trim(text, {TRIM})) >= 5),
    s AS (SELECT a.owner_id, question_id, created_at, seq, substr(text, 1, 600) AS example,
            {hits('lower(text)', 'terms')} AS hits, 8 * {hits('lower(text)', 'terms')}
            + ({LENGTH} + least(0.5, (epoch_us(created_at) // 1000)::DOUBLE / {NOW}.0::DOUBLE * 0.5)) AS score
          FROM q a JOIN m ON m.owner_id = a.owner_id {{}}),
    d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY {ASK}, {KEY.format('example')}
            ORDER BY hits > 0 DESC, score DESC, created_at DESC, seq) = 1),
    r AS (SELECT *, {first(0, 'hits > 0 DESC, score DESC, created_at DESC, seq', ASK)} AS rank FROM d
          QUALIFY {first(0, 'hits > 0 DESC, score DESC, created_at DESC, seq', ASK)} <= {{}})"""
Q = f"q AS (SELECT *, {terms()} AS terms FROM asked)"


@query("top_09_outbound_messages", f"""WITH {ASKED}, {Q},
    {OUTBOUND.format('', 200)}
    SELECT {ASK}, rank, seq, example, CAST(hits AS BIGINT) AS hits, round(score, 6) AS score FROM r""")
def _(t):
    return retrieval.outbound_messages(t.messages(), asked(t).drop("target"), NOW).select(
        "owner_id", "question_id", "rank", "seq", "example", F.col("hits").cast("long").alias("hits"),
        F.round("score", 6).alias("score"))


def named(t):
    """Messages whose other participant is the channel."""
    return t.messages().withColumn("participants", F.array(F.lit("Me"), "channel"))


@query("top_09_outbound_to_person", f"""WITH {ASKED}, {Q}, {OUTBOUND.format(
        "AND (target IS NULL OR contains(channel, target) OR contains(target, channel))", 200)}
    SELECT {ASK}, rank, seq, CAST(hits AS BIGINT) AS hits FROM r""")
def _(t):
    return retrieval.outbound_messages(named(t), asked(t), NOW).select(
        "owner_id", "question_id", "rank", "seq", F.col("hits").cast("long").alias("hits"))


@query("top_09_outbound_stats", f"""WITH {ASKED}, {Q},
    {OUTBOUND.format('', 200)}
    SELECT a.owner_id, a.question_id, coalesce(n, 0) AS candidates, coalesce(h, 0) AS topic_matches,
        coalesce(k, 0) AS after_dedupe
    FROM asked a LEFT JOIN (SELECT owner_id, count(*) AS n FROM m GROUP BY ALL) USING (owner_id)
    LEFT JOIN (SELECT {ASK}, count(*) AS h FROM s WHERE hits > 0 GROUP BY ALL) USING ({ASK})
    LEFT JOIN (SELECT {ASK}, count(*) AS k FROM r GROUP BY ALL) USING ({ASK})""")
def _(t):
    ask = asked(t).drop("target")
    ranked = retrieval.outbound_messages(t.messages(), ask, NOW)
    return retrieval.outbound_stats(t.messages(), ask, ranked)


SNIPPETS = rf"""f1 AS (SELECT owner_id, place, seq, score, trim(text, {TRIM}) AS text FROM forum WHERE place < 2),
    fs AS (SELECT a.owner_id, question_id, place, seq, substr(text, 1, 700) AS example,
            5 * {hits('lower(text)', 'pieces')} + (least(2.0::DOUBLE, length(text)::DOUBLE / CASE place WHEN 1 THEN 500 ELSE 300 END)
            + greatest(0, coalesce(score, 0)) * 0.01::DOUBLE) AS score
          FROM q a JOIN f1 ON f1.owner_id = a.owner_id
          WHERE length(text) >= CASE place WHEN 1 THEN 30 ELSE 15 END AND {hits('lower(text)', 'pieces')} > 0),
    fc AS (SELECT *, {first(0, 'score DESC, place, seq', ASK)} AS cut FROM fs
          QUALIFY {first(0, 'score DESC, place, seq', ASK)} <= 2 * {{0}}),
    fd AS (SELECT * FROM fc QUALIFY row_number() OVER (
            PARTITION BY {ASK}, {KEY.format('example')} ORDER BY cut) = 1),
    fr AS (SELECT *, {first(0, 'cut', ASK)} AS rank FROM fd QUALIFY {first(0, 'cut', ASK)} <= {{0}})"""


@query("top_10_forum_snippets", f"""WITH {ASKED}, {Q}, {FORUM}, {SNIPPETS.format(100)}
    SELECT {ASK}, rank, example, round(score, 6) AS score FROM fr""")
def _(t):
    return retrieval.forum_snippets(t.comments(), t.posts(), asked(t)).withColumn(
        "score", F.round("score", 6))


def clone_sql(where="true"):
    return rf"""WITH {ASKED}, q AS (SELECT *, {terms(distinct=True)} AS terms FROM asked), {FORUM},
    p AS (SELECT owner_id, place, seq, subreddit, score, trim(text, {TRIM}) AS text FROM forum
          WHERE place < 2 AND length(trim(text, {TRIM})) >= 40 AND {where}),
    s AS (SELECT a.owner_id, question_id, place, seq, subreddit, substr(text, 1, 900) AS example,
            8 * {hits('lower(text)', 'terms')} + (least(8.0::DOUBLE, length(text)::DOUBLE / 140)
            + greatest(0, coalesce(score, 0)) * 0.02::DOUBLE) AS relevance
          FROM q a JOIN p ON p.owner_id = a.owner_id)
    SELECT {ASK}, subreddit, example, round(relevance, 6) AS relevance,
        {first(0, 'relevance DESC, place, seq', ASK)} AS rank FROM s
    QUALIFY {first(0, 'relevance DESC, place, seq', ASK)} <= 10"""


def clone(t, locked_at=None):
    return retrieval.clone_context(t.comments(), t.posts(), asked(t), locked_at).select(
        "owner_id", "question_id", "subreddit", "example", F.round("relevance", 6).alias("relevance"),
        "rank")


@query("top_11_clone_context", clone_sql())
def _(t):
    return clone(t)


@query("flt_06_era_locked_context", clone_sql(
    "(created_at IS NULL OR created_at <= TIMESTAMP '2024-01-01 20:00:00')"))
def _(t):
    return clone(t, F.lit("2024-01-01 20:00:00").cast("timestamp"))


@query("top_12_messages_about", f"""WITH {ASKED}, q AS (SELECT *, {terms(TOPIC_STOP_WORDS)} AS terms FROM asked),
    s AS (SELECT a.owner_id, question_id, created_at, seq,
            {hits('lower(text)', 'terms')} + least(0.5::DOUBLE, length(text)::DOUBLE / 6000) AS score
          FROM q a JOIN v_msg m ON m.owner_id = a.owner_id
               AND (contains(m.channel, target) OR contains(target, m.channel))
          WHERE len(terms) > 0)
    SELECT {ASK}, seq, round(score, 6) AS score, {first(0, 'score DESC, created_at, seq', ASK)} AS rank FROM s
    QUALIFY {first(0, 'score DESC, created_at, seq', ASK)} <= 25""")
def _(t):
    return retrieval.messages_about(named(t), asked(t).filter("target IS NOT NULL")).select(
        "owner_id", "question_id", "seq", F.round("score", 6).alias("score"), "rank")


# Letters only: the channel "src7" and the target "src12" are both "src", so every channel fits.
ROUTED = rf"""q AS (SELECT *, coalesce(preferred, {class_sql('lower(topic)')}) AS wanted FROM asked
          WHERE target IS NOT NULL),
    m AS (SELECT owner_id, created_at, seq, trim(text, {TRIM}) AS text,
                 {class_sql(f'lower(trim(text, {TRIM}))')} AS cluster FROM v_msg),
    s AS (SELECT a.owner_id, question_id, seq, cluster, wanted, substr(text, 1, 600) AS example,
            CASE WHEN cluster = wanted THEN 4.0 WHEN cluster = 'other' THEN 1.0 ELSE 0.0 END::DOUBLE
            + least(3, {hits('lower(text)', 'pieces')})
            + ({LENGTH} + least(1.0::DOUBLE, (epoch_us(created_at) // 1000)::DOUBLE / {NOW}.0::DOUBLE)) AS score
          FROM q a JOIN m ON m.owner_id = a.owner_id WHERE length(text) >= 5),
    d AS (SELECT * FROM s WHERE score >= 0.5 QUALIFY row_number() OVER (
            PARTITION BY {ASK}, substr(regexp_replace(lower(example), '\s+', ' ', 'g'), 1, 100)
            ORDER BY score DESC, seq) = 1),
    r AS (SELECT *, {first(0, 'score DESC, seq', ASK)} AS rank FROM d
          QUALIFY {first(0, 'score DESC, seq', ASK)} <= 50)"""


def routed(t):
    return asked(t).filter("target IS NOT NULL")


@query("top_13_routed_messages", f"""WITH {ASKED}, {ROUTED}
    SELECT {ASK}, rank, seq, cluster, wanted, round(score, 6) AS score FROM r""")
def _(t):
    return retrieval.routed_messages(named(t), routed(t), NOW).select(
        "owner_id", "question_id", "rank", "seq", "cluster", "wanted",
        F.round("score", 6).alias("score"))


ROUTED_STATS = f"""st AS (SELECT q.owner_id, q.question_id, q.target, wanted AS cluster,
        (SELECT count(*) FROM m WHERE m.owner_id = q.owner_id) AS total_candidates,
        (SELECT count(*) FROM s WHERE s.owner_id = q.owner_id AND s.question_id = q.question_id
            AND s.cluster = q.wanted) AS cluster_matches,
        (SELECT count(*) FROM r WHERE r.owner_id = q.owner_id AND r.question_id = q.question_id) AS final_count
    FROM q)"""


@query("top_13_routed_stats", f"""WITH {ASKED}, {ROUTED}, {ROUTED_STATS}
    SELECT *, round(cluster_matches / greatest(1, final_count), 6) AS confidence_raw,
        round(least(1.0::DOUBLE, cluster_matches / greatest(1, final_count)), 6) AS confidence FROM st""")
def _(t):
    told = with_classes(named(t))
    ranked = retrieval.routed_messages(told, routed(t), NOW)
    out = retrieval.routed_stats(told, routed(t), ranked)
    for c in ("confidence_raw", "confidence"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("win_05_first_of_each_text", f"""
    SELECT id, owner_id FROM v_comment QUALIFY row_number() OVER (
        PARTITION BY owner_id, {KEY.format('body')} ORDER BY score DESC, seq) = 1""")
def _(t):
    from keepsake.functions.text import dedupe_text
    from keepsake.operators.ranking import keep_first
    return keep_first(
        t.comments().withColumn("key", F.md5(dedupe_text("body"))), ["owner_id", "key"],
        [F.desc("score"), F.asc("seq")]).select("id", "owner_id")


WEIGHTS = " ".join(
    f"WHEN '{m}' THEN CASE source " + " ".join(
        f"WHEN '{s}' THEN {25000 * w // sum(ws)}" for s, w in zip(retrieval.BUDGET_SOURCES, ws)) + " END"
    for m, ws in retrieval.MODE_WEIGHTS.items() if m != "default")
SHARE = f"CASE mode {WEIGHTS} ELSE 8333 END"
CONTEXT = f"""{ASKED}, {Q}, {FORUM}, {OUTBOUND.format('', 300)}, {SNIPPETS.format(150)},
    mail AS (SELECT owner_id, 'gmail' AS source, 'chat' AS channel, CAST(NULL AS TIMESTAMP) AS created_at, seq, text FROM v_chat),
    {CROSS.format('mail', 50)},
    allx AS (SELECT {ASK}, 'sms' AS source, rank, example FROM r
        UNION ALL SELECT {ASK}, 'reddit', rank, example FROM fr
        UNION ALL SELECT {ASK}, 'gmail', {first(0, 'cut', ASK)}, line FROM xd),
    priced AS (SELECT x.*, mode, CAST(ceil(length(example) / 4.0) AS BIGINT) AS cost FROM allx x JOIN asked USING ({ASK})
        WHERE NOT (source = 'sms' AND question_id % 7 = 0)),
    summed AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY {ASK}, source ORDER BY rank) AS BIGINT) AS running_cost FROM priced)"""


def context(t, max_tokens=25_000):
    mail = t.chats().withColumn("source", F.lit("gmail")).withColumn("channel", F.lit("chat"))
    cols = ["owner_id", "source", "channel", "created_at", "seq", "text", "is_user_message"]
    events = t.messages().select(cols).unionByName(
        mail.select(cols).withColumn("is_user_message", F.lit(False)))
    return retrieval.write_context(
        t.comments(), t.posts(), events.withColumn("participants", F.array(F.lit("Me"))),
        asked(t).drop("target"), NOW, max_tokens)


@query("ctx_07_write_context", f"""WITH {CONTEXT}
    SELECT {ASK}, mode, source, rank, example, cost, running_cost FROM summed WHERE running_cost <= {SHARE}""")
def _(t):
    return context(t)


@query("win_09_token_budget", f"""WITH {CONTEXT}
    SELECT {ASK}, source, count(*) AS kept, CAST(sum(cost) AS BIGINT) AS tokens FROM summed
    WHERE running_cost <= {SHARE} GROUP BY ALL""")
def _(t):
    return context(t).groupBy("owner_id", "question_id", "source").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("cost").alias("tokens"))
