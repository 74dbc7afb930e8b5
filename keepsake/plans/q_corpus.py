"""Corpus-wide word, phrase and link statistics."""

from pyspark.sql import functions as F

from keepsake.functions.lexicons import KNOWLEDGE_STOP_WORDS, STYLE_STOP_WORDS
from keepsake.operators import activity, corpus
from keepsake.plans.registry import query


def quoted(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP = quoted(STYLE_STOP_WORDS)
TRIM = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def texts(t):
    events = t.chats().select("owner_id", "text").unionByName(t.dense().select("owner_id", "text"))
    return corpus.all_texts(t.comments(), t.posts(), t.saved(), t.upvoted(), events)


@query("set_01_all_texts", f"""
    SELECT owner_id, kind, count(*) AS texts, CAST(sum(length(trim(text, {TRIM}))) AS BIGINT) AS chars
    FROM v_corpus GROUP BY ALL""")
def _(t):
    from keepsake.functions.text import strip
    return texts(t).groupBy("owner_id", "kind").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.length(strip("text"))).alias("chars"))


def ranked(item, source, k):
    order = f"PARTITION BY owner_id ORDER BY count(*) DESC, {item}"
    return f"""
    SELECT owner_id, {item}, count(*) AS count, row_number() OVER ({order}) AS rank
    FROM {source} GROUP BY owner_id, {item} QUALIFY row_number() OVER ({order}) <= {k}"""


WORDS = f"""(SELECT * FROM (
    SELECT owner_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM v_corpus)
    WHERE length(word) >= 3 AND word NOT IN ({STOP}))"""


@query("agg_02_top_words", ranked("word", WORDS, 40))
def _(t):
    return corpus.top_words(texts(t))


@query("agg_03_top_bigrams", "WITH " + f"""toks AS (
        SELECT owner_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM v_corpus),
    pairs AS (SELECT owner_id, w[i] AS a, w[i + 1] AS b FROM toks, generate_series(1, len(w) - 1) g(i)),
    kept AS (SELECT owner_id, a || ' ' || b AS phrase FROM pairs
             WHERE length(a) >= 3 AND length(b) >= 3 AND NOT (a IN ({STOP}) AND b IN ({STOP})))
    """ + ranked("phrase", "kept", 25))
def _(t):
    return corpus.top_bigrams(texts(t))


LINKS = r"""(SELECT owner_id, regexp_replace(lower(regexp_extract(
        u, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)', 1)), '^www\.', '') AS domain
    FROM (SELECT owner_id, unnest(regexp_extract_all(text, '(?i)https?://[^\s)]+')) AS u
          FROM (SELECT owner_id, text FROM v_corpus UNION ALL SELECT owner_id, url FROM v_page)))"""


def linked(t):
    return texts(t).select("owner_id", "text").unionByName(
        t.pages().select("owner_id", F.col("url").alias("text")))


@query("agg_05_top_domains", ranked("domain", LINKS, 15))
def _(t):
    return corpus.top_domains(linked(t))


@query("agg_39_distinct_domains", f"""
    SELECT owner_id, count(DISTINCT domain) AS domains FROM {LINKS} GROUP BY owner_id""")
def _(t):
    return corpus.distinct_domains(linked(t))


@query("agg_06_identity_totals", "WITH rows AS (" + """
        SELECT owner_id, 'comments' AS label FROM v_comment UNION ALL
        SELECT owner_id, 'posts' FROM v_post UNION ALL
        SELECT owner_id, 'saved' FROM v_saved UNION ALL
        SELECT owner_id, 'upvoted' FROM v_upvoted UNION ALL
        SELECT owner_id, 'e:' || source FROM v_timeline)
    SELECT owner_id,
        count(*) FILTER (label = 'comments') AS reddit_comments,
        count(*) FILTER (label = 'posts') AS reddit_posts,
        count(*) FILTER (label = 'saved') AS reddit_saved,
        count(*) FILTER (label = 'upvoted') AS reddit_upvoted,
        count(*) FILTER (label LIKE 'e:%') AS timeline_events,
        """ + ", ".join(f"count(*) FILTER (label = 'e:{s}') AS {n}"
                       for n, s in corpus.TIMELINE_TOTALS.items()) + """
    FROM rows GROUP BY owner_id""")
def _(t):
    return corpus.identity_totals(t.comments(), t.posts(), t.saved(), t.upvoted(), t.timeline())


@query("agg_07_identity_summary", f"""WITH
    n AS (SELECT owner_id, count(*) AS n FROM v_corpus GROUP BY 1),
    c AS (SELECT owner_id, string_agg('r/' || subreddit, ', ' ORDER BY rank) AS c FROM
          ({ranked('subreddit', 'v_upvoted', 5)}) GROUP BY 1),
    s AS (SELECT owner_id, string_agg(source || ' (' || count || ')', ', ' ORDER BY rank) AS s FROM
          ({ranked('source', 'v_timeline', 5)}) GROUP BY 1),
    w AS (SELECT owner_id, string_agg(word, ', ' ORDER BY rank) AS w FROM
          ({ranked('word', WORDS, 12)}) GROUP BY 1)
    SELECT owner_id, 'Analyzed ' || format('{{:,}}', n) ||
        ' text items from all connected data sources. Most upvoted activity clusters around: ' || c ||
        '. Strongest non-Reddit data signals: ' || s || '. Recurring language markers include: ' || w ||
        '.' AS summary
    FROM n JOIN c USING (owner_id) JOIN s USING (owner_id) JOIN w USING (owner_id)""")
def _(t):
    items = texts(t)
    return corpus.identity_summary(
        items, activity.top_values(t.upvoted(), "subreddit", 12),
        activity.top_values(t.timeline(), "source", 12), corpus.top_words(items))


DATED = f"""(SELECT owner_id, source, created_at, seq, substr(text, 1, 1800) AS text FROM (
    SELECT owner_id, 'reddit' AS source, created_at, seq, trim(body, {TRIM}) AS text FROM v_comment
    UNION ALL SELECT owner_id, 'reddit', created_at, seq, trim(title || chr(10) || body, {TRIM}) FROM v_post
    UNION ALL SELECT owner_id, source, created_at, seq, trim(text, {TRIM}) FROM v_timeline)
    WHERE created_at IS NOT NULL AND text <> '')"""


def dated(t):
    return corpus.dated_texts(t.comments(), t.posts(), t.timeline(), most=1800)


@query("set_02_dated_texts", f"""
    SELECT owner_id, source, CAST(hour(created_at) AS BIGINT) AS hour, count(*) AS texts,
           CAST(sum(length(text)) AS BIGINT) AS chars FROM {DATED} GROUP BY ALL""")
def _(t):
    return dated(t).groupBy("owner_id", "source", F.col("hour").cast("long").alias("hour")).agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("chars"))


@query("agg_41_knowledge_words", f"""
    SELECT *, CASE WHEN rank <= 4 THEN 'expert' WHEN rank <= 8 THEN 'learning' ELSE 'curious' END AS band
    FROM ({ranked('word', f'''(SELECT * FROM (
        SELECT owner_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM {DATED})
        WHERE length(word) >= 3 AND word NOT IN ({quoted(KNOWLEDGE_STOP_WORDS)}))''', 12)})""")
def _(t):
    return corpus.knowledge_words(dated(t))
