"""Training set, batches, and text functions over whole tables."""

from pyspark.sql import functions as F

from keepsake.functions import text as tx
from keepsake.functions import times
from keepsake.operators import training, voice
from keepsake.plans.q_contacts import ISO
from keepsake.plans.q_corpus import TRIM
from keepsake.plans.q_questions import sentiment
from keepsake.plans.registry import query

SLICED = rf"""raw AS (
        SELECT owner_id, seq, 'reddit_comments' AS slice, trim(body, {TRIM}) AS text, score FROM v_comment
        UNION ALL SELECT owner_id, seq, 'reddit_posts', trim(title || chr(10) || body, {TRIM}), score FROM v_post
        UNION ALL SELECT owner_id, seq, 'sms_messages', trim(text, {TRIM}), 0 FROM v_msg WHERE is_user_message
        UNION ALL SELECT owner_id, seq, 'llm_chat_messages', trim(text, {TRIM}), 0 FROM v_chat WHERE is_user_message),
    quality AS (SELECT *, len(regexp_split_to_array(text, '\s+')) AS words FROM raw WHERE length(text) >= 50),
    slices AS (SELECT owner_id, seq, slice, text, score::DOUBLE AS score FROM quality WHERE words >= 5
        AND NOT (len(regexp_extract_all(text, 'https?://')) > 3 AND length(text) < 200)
        AND NOT (len(regexp_extract_all(text, '[\x{{1F300}}-\x{{1F9FF}}]')) > words / 3))"""
SCORE = """(CASE WHEN length(text) BETWEEN 50 AND 500 THEN 10 WHEN length(text) >= 30 THEN 5 ELSE 0 END
    + least(score / 10, 20) + CASE WHEN regexp_matches(text, '[.?!]') THEN 5 ELSE 0 END)::DOUBLE"""


def slices(t):
    cols = ["owner_id", "seq", "source", "kind", "text", "is_user_message"]
    return training.outbound_slices(
        t.comments(), t.posts(), t.messages().select(cols).unionByName(t.chats().select(cols)))


@query("set_03_outbound_slices", f"WITH {SLICED} SELECT owner_id, slice, seq FROM slices")
def _(t):
    return slices(t).select("owner_id", "slice", "seq")


@query("flt_12_slice_sizes", f"""WITH {SLICED}
    SELECT owner_id, slice, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars FROM slices GROUP BY ALL""")
def _(t):
    return slices(t).groupBy("owner_id", "slice").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("chars"))


@query("agg_42_training_sources", f"""WITH {SLICED}
    SELECT owner_id, (SELECT count(*) FROM v_comment c WHERE c.owner_id = s.owner_id) AS reddit_comments,
        (SELECT count(*) FROM v_post c WHERE c.owner_id = s.owner_id) AS reddit_posts,
        count(*) FILTER (slice = 'sms_messages') AS sms_messages, 0 AS instagram_messages, 0 AS instagram_comments,
        count(*) FILTER (slice = 'llm_chat_messages') AS llm_chat_messages FROM slices s GROUP BY owner_id""")
def _(t):
    return training.source_counts(t.comments(), t.posts(), slices(t))


RANKED = f"""scored AS (SELECT *, {SCORE} AS quality FROM slices),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY quality DESC, score DESC, slice, seq) AS rank
        FROM scored QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY quality DESC, score DESC, slice, seq) <= {{}})"""


@query("win_14_training_set", f"""WITH {SLICED}, {RANKED.format(300)}
    SELECT owner_id, rank, slice, seq, round(quality, 6) AS quality FROM ranked""")
def _(t):
    return training.training_set(slices(t), 300).select(
        "owner_id", "rank", "slice", "seq", F.round("quality", 6).alias("quality"))


@query("win_10_packed_batches", "WITH RECURSIVE" + f""" {SLICED}, {RANKED.format(5000)},
    sized AS (SELECT owner_id, slice, seq, length(trim(substr(text, 1, 900), {TRIM})) * 0 + length(substr(text, 1, 900)) AS chars,
        rank FROM ranked),
    walk AS (SELECT owner_id, slice, seq, rank, 0 AS batch, 1 AS items, chars AS held FROM sized WHERE rank = 1
        UNION ALL SELECT s.owner_id, s.slice, s.seq, s.rank,
            CASE WHEN w.items >= 30 OR w.held + s.chars + 7 > 16000 THEN w.batch + 1 ELSE w.batch END,
            CASE WHEN w.items >= 30 OR w.held + s.chars + 7 > 16000 THEN 1 ELSE w.items + 1 END,
            CASE WHEN w.items >= 30 OR w.held + s.chars + 7 > 16000 THEN s.chars ELSE w.held + s.chars + 7 END
        FROM walk w JOIN sized s ON s.owner_id = w.owner_id AND s.rank = w.rank + 1)
    SELECT owner_id, rank, slice, seq, CAST(batch AS BIGINT) AS batch FROM walk""")
def _(t):
    return training.pack(training.training_set(slices(t), 5000), item_chars=900).select(
        "owner_id", "rank", "slice", "seq", "batch")


@query("flt_10_quality_texts", r"""
    SELECT doc_id, length(text) >= 50 AND len(regexp_split_to_array(text, '\s+')) >= 5
        AND NOT (len(regexp_extract_all(text, 'https?://')) > 3 AND length(text) < 200)
        AND NOT (len(regexp_extract_all(text, '[\x{1F300}-\x{1F9FF}]')) > len(regexp_split_to_array(text, '\s+')) / 3)
        AS quality FROM documents""")
def _(t):
    return t.raw("documents").select("doc_id", training.is_quality("text").alias("quality"))


@query("fn_25_content_score", f"""
    SELECT id, round({SCORE}, 6) AS points FROM (SELECT id, body AS text, score FROM v_comment)""")
def _(t):
    return t.comments().select("id", F.round(training.content_score("body", "score"), 6).alias("points"))


@query("flt_11_style_corpus", f"""
    SELECT id, len(regexp_extract_all(lower(body), '[a-z0-9'']+')) AS words FROM v_comment
    WHERE len(regexp_extract_all(lower(body), '[a-z0-9'']+')) >= 5
      AND lower(trim(body, {TRIM})) NOT IN ('[deleted]', '[removed]')""")
def _(t):
    return voice.style_corpus(t.comments()).select("id", "words")


@query("flt_01_nonblank_clipped", f"""
    SELECT owner_id, source, seq, length(substr(text, 1, 6000)) AS kept, md5(substr(text, 1, 6000)) AS digest
    FROM v_timeline WHERE trim(text, {TRIM}) <> ''""")
def _(t):
    from keepsake.sources.events import cut_texts, nonblank
    return cut_texts(nonblank(t.timeline()), 6000).select(
        "owner_id", "source", "seq", F.length("text").cast("long").alias("kept"),
        F.md5("text").alias("digest"))


@query("flt_05_calendar_year", """
    SELECT owner_id, id FROM v_comment c WHERE year(created_at) = (
        SELECT max(year(created_at)) FROM v_comment x WHERE x.owner_id = c.owner_id)""")
def _(t):
    return voice.rows_of_year(t.comments(), t.comments(), 0).select("owner_id", "id")


@query("flt_13_boilerplate", r"""
    SELECT page_id, NOT (regexp_matches(html, '\{\s*[^}]*:\s*[^;]*;') OR regexp_matches(html, '(?i)Copyright.*Google.*Reserved')) AS kept
    FROM pages""")
def _(t):
    from keepsake.sources.takeout import is_boilerplate
    return t.pages().select("page_id", (~is_boilerplate(F.col("html"))).alias("kept"))


@query("flt_15_source_locks", """
    SELECT owner_id, seq FROM v_timeline WHERE source NOT IN ('sms', 'gmail')""")
def _(t):
    from keepsake.sources.events import without_sources
    return without_sources(t.timeline(), ["sms", "gmail"]).select("owner_id", "seq")


# --- Text functions ------------------------------------------------------------------------------------

@query("fn_05_unescaped_html", """
    SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'),
        '&gt;', '>'), '&quot;', '"'), '&#39;', '''')) AS digest FROM pages""")
def _(t):
    return t.pages().select("page_id", F.md5(tx.unescape_html("html")).alias("digest"))


@query("fn_06_stripped_html", r"""
    SELECT page_id, replace(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(
        regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')),
        '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS plain FROM pages""")
def _(t):
    return t.pages().select("page_id", tx.strip_html("html").alias("plain"))


@query("fn_07_host_of_url", r"""
    SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url,
        '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)', 1)), '^www\.', ''), '') AS host FROM pages""")
def _(t):
    return t.pages().select("page_id", tx.host("url").alias("host"))


@query("fn_08_tokens", """
    SELECT doc_id, len(w) AS words, w[1] AS first_word, w[len(w)] AS last_word FROM (
        SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents)""")
def _(t):
    w = F.col("w")
    return t.raw("documents").select("doc_id", tx.tokens("text").alias("w")).select(
        "doc_id", F.size(w).cast("long").alias("words"), F.try_element_at(w, F.lit(1)).alias("first_word"),
        F.try_element_at(w, F.lit(-1)).alias("last_word"))


SENTENCES = (f"[trim(s, {TRIM}) for s in string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), "
             f"chr(1)) if trim(s, {TRIM}) <> '']")


@query("fn_09_sentences", f"""
    SELECT doc_id, len(s) AS sentences, s[1] AS first_sentence FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)""")
def _(t):
    s = F.col("s")
    return t.raw("documents").select("doc_id", tx.sentences("text").alias("s")).select(
        "doc_id", F.size(s).cast("long").alias("sentences"), F.get(s, 0).alias("first_sentence"))


@query("fn_10_ngrams", """
    SELECT doc_id, greatest(len(w) - 1, 0) AS pairs, greatest(len(w) - 2, 0) AS triples,
        CASE WHEN len(w) >= 3 THEN w[len(w) - 2] || ' ' || w[len(w) - 1] || ' ' || w[len(w)] END AS last_triple
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents)""")
def _(t):
    rows = t.raw("documents").select("doc_id", tx.tokens("text").alias("w"))
    grams = rows.select("doc_id", tx.ngrams(F.col("w"), 2).alias("p"), tx.ngrams(F.col("w"), 3).alias("q"))
    return grams.select(
        "doc_id", F.size("p").cast("long").alias("pairs"), F.size("q").cast("long").alias("triples"),
        F.try_element_at("q", F.lit(-1)).alias("last_triple"))


@query("fn_15_person_names", r"""WITH n AS (
        SELECT doc_id, split_part(text, ' ', 1) || '-' || split_part(text, ' ', 2) || ' ' || doc_id AS name FROM documents)
    SELECT doc_id, regexp_replace(lower(name), '[^a-z]', '', 'g') AS letters,
        trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS words,
        trim(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS any_script,
        regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'),
            '^_|_$', '', 'g') AS slug FROM n""")
def _(t):
    name = F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit("-"),
                    F.split_part("text", F.lit(" "), F.lit(2)), F.lit(" "), F.col("doc_id").cast("string"))
    return t.raw("documents").select("doc_id", name.alias("name")).select(
        "doc_id", tx.person_letters("name").alias("letters"), tx.person_words("name").alias("words"),
        tx.person_any_script("name").alias("any_script"), tx.person_slug("name").alias("slug"))


@query("fn_16_contact_key", """
    SELECT event_id, array_to_string(list_sort([x for x in ['me', 'user ' || user_id, lower(event_type)] if x <> '']), '_') AS contact_key
    FROM events""")
def _(t):
    names = F.array(F.lit(" Me "), F.concat(F.lit("User "), F.col("user_id").cast("string")),
                    F.lit("  "), F.lit(None).cast("string"), F.col("event_type"))
    return t.raw("events").select("event_id", tx.contact_key(names).alias("contact_key"))


@query("fn_17_time_keys", r"""
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month,
        year(ts) || '-Q' || quarter(ts) AS quarter, CAST(hour(ts) AS BIGINT) AS hour,
        strftime(ts, '%Y-%m-%d_%H') AS conversation FROM events""")
def _(t):
    return t.raw("events").select(
        "event_id", times.day_key("ts").alias("day"), times.month_key("ts").alias("month"),
        times.quarter_key("ts").alias("quarter"), times.hour_of_day("ts").cast("long").alias("hour"),
        times.conversation_key(F.unix_millis("ts")).alias("conversation"))


@query("fn_18_dedupe_keys", rf"""
    SELECT seq, md5(source || '|' || kind || '||' || {ISO} || '|'
            || substr(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 1, 180)) AS event_key,
        md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS whole,
        md5(substr(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 1, 100)) AS start FROM v_msg""")
def _(t):
    from keepsake.plans.tables import timeline_key
    m = t.messages().withColumn("external_id", F.lit(None).cast("string"))
    return m.select("seq", timeline_key().alias("event_key"), F.md5(tx.dedupe_text("text")).alias("whole"),
                    F.md5(tx.dedupe_text("text", 100)).alias("start"))


@query("fn_20_tone_hits", r"""
    SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(?:ha|the|and)\b')) AS listed,
        len(regexp_extract_all(text, '\*[^*]+\*|\b[A-Z]{3,}\b')) AS passion,
        regexp_matches(text, '^[A-Z]') AS capital_start FROM documents""")
def _(t):
    return t.raw("documents").select(
        "doc_id", tx.count_matches("text", tx.any_word(["ha", "the", "and"])).alias("listed"),
        tx.count_matches("text", voice.PASSION).alias("passion"),
        F.col("text").rlike("^[A-Z]").alias("capital_start"))


@query("fn_21_punctuation_counts", """SELECT doc_id, """ + ", ".join(
    f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in voice.MARKS.items()) + " FROM documents")
def _(t):
    return t.raw("documents").select(
        "doc_id", *[tx.count_matches("text", p).alias(n) for n, p in voice.MARKS.items()])


@query("fn_22_emoji_counts", r"""
    SELECT doc_id, len(regexp_extract_all(text || ' ' || chr(128512 + CAST(doc_id % 60 AS INT)) || '©' || chr(9728) || '#',
        '[\x{00A9}\x{00AE}\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}]')) AS emoji FROM documents""")
def _(t):
    face = F.decode(F.unhex(F.concat(F.lit("F09F98"), F.hex((F.col("doc_id") % 60 + 128)))), "UTF-8")
    shown = F.concat("text", F.lit(" "), face, F.lit("©☀#"))
    return t.raw("documents").select("doc_id", tx.count_matches(shown, tx.EMOJI).alias("emoji"))


@query("fn_24_sentiment", f"""
    SELECT doc_id, CAST({sentiment('lower(text)', ['tion', 'er', 'the'], ['que', 'ung'])} AS BIGINT) AS contained,
        CAST(regexp_matches(lower(text), '\\b(?:the|que)\\b')::INT - regexp_matches(lower(text), '\\b(?:is|der)\\b')::INT AS BIGINT) AS bounded
    FROM documents""")
def _(t):
    low = F.lower("text")
    return t.raw("documents").select(
        "doc_id", (tx.hits(low, ["tion", "er", "the"]) - tx.hits(low, ["que", "ung"])).cast("long")
        .alias("contained"),
        (low.rlike(tx.any_word(["the", "que"])).cast("int")
         - low.rlike(tx.any_word(["is", "der"])).cast("int")).cast("long").alias("bounded"))


@query("fn_26_length_and_recency", """
    SELECT seq, CASE WHEN length(text) < 20 THEN 0.5 WHEN length(text) < 150 THEN 2.0 WHEN length(text) < 400 THEN 1.5
        ELSE 0.8 END::DOUBLE AS length_points, round(least(0.5::DOUBLE,
        (epoch_us(created_at) // 1000)::DOUBLE / 1717200000000.0::DOUBLE * 0.5), 9) AS recency FROM v_msg""")
def _(t):
    return t.messages().select(
        "seq", tx.length_score(F.length("text")).alias("length_points"),
        F.round(tx.recency_score(F.col("created_at"), 1_717_200_000_000, 0.5), 9).alias("recency"))


@query("fn_27_token_estimate", """
    SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents""")
def _(t):
    return t.raw("documents").select("doc_id", tx.token_estimate("text").alias("tokens"))


STAMPS = "event_id, ts, epoch_us(ts) AS us"


@query("fn_03_export_dates", r"""WITH e AS (SELECT event_id, ts, epoch_us(ts) AS us FROM events)
    SELECT event_id, strftime(make_timestamp(us // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%S') AS from_seconds,
        strftime(make_timestamp(us // 1000 * 1000), '%Y-%m-%dT%H:%M:%S') AS from_millis,
        strftime(make_timestamp(us // 1000 * 1000), '%Y-%m-%dT%H:%M:%S') AS from_micros,
        strftime(ts, '%Y-%m-%dT%H:%M:%S') AS from_text,
        strftime(ts, '%Y-%m-%dT00:00:00') AS from_day, NULL AS from_garbage FROM e""")
def _(t):
    us = F.unix_micros("ts")
    e = t.raw("events").withColumn("us", us).select(
        "event_id", F.floor(F.col("us") / 1_000_000).cast("string").alias("s"),
        F.floor(F.col("us") / 1000).cast("string").alias("ms"), F.col("us").cast("string").alias("us"),
        F.date_format("ts", "MMM d, yyyy, h:mm:ss a").alias("text"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("garbage"))

    def show(c):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")

    return e.select(
        "event_id", show(times.forum_date("s")).alias("from_seconds"),
        show(times.chat_date("ms")).alias("from_millis"), show(times.takeout_date("us")).alias("from_micros"),
        show(times.takeout_date("text")).alias("from_text"), show(times.plain_date("day")).alias("from_day"),
        show(times.forum_date("garbage")).alias("from_garbage"))


@query("fn_01_first_nonblank", f"""
    SELECT page_id, coalesce(nullif(trim(a, {TRIM}), ''), nullif(trim(b, {TRIM}), '')) AS first_text FROM (
        SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '  ' WHEN page_id % 3 = 1 THEN NULL ELSE ' ' || url END AS a,
               chr(10) || regexp_extract(html, '<title>([^<]*)</title>', 1) AS b FROM pages)""")
def _(t):
    n = F.col("page_id")
    a = F.when(n % 3 == 0, "  ").when(n % 3 == 2, F.concat(F.lit(" "), "url"))
    b = F.concat(F.lit("\n"), F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return t.pages().select("page_id", tx.first_text(a, b).alias("first_text"))


@query("fn_02_community_names", r"""
    SELECT doc_id, nullif(regexp_replace(trim(CASE WHEN doc_id % 3 = 0 THEN 'r/' WHEN doc_id % 3 = 1 THEN ' R/' ELSE '' END || source),
        '(?i)^r/', ''), '') AS community FROM documents""")
def _(t):
    lead = F.when(F.col("doc_id") % 3 == 0, "r/").when(F.col("doc_id") % 3 == 1, " R/").otherwise("")
    return t.raw("documents").select("doc_id", tx.community(F.concat(lead, "source")).alias("community"))


@query("fn_04_optional_numbers", """
    SELECT event_id, try_cast(CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN ' ' ELSE value::VARCHAR END AS DOUBLE) AS number
    FROM events""")
def _(t):
    n = F.col("event_id") % 4
    raw = F.when(n == 0, F.col("event_type")).when(n == 1, " ").otherwise(F.col("value").cast("string"))
    return t.raw("events").select("event_id", tx.number(raw).alias("number"))


@query("fn_11_clamped", """
    SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value - 20) / 30)) AS share FROM events""")
def _(t):
    return t.raw("events").select("event_id", tx.clamp01((F.col("value") - 20) / 30).alias("share"))


@query("fn_12_snippets", r"""WITH d AS (SELECT doc_id, text, instr(lower(text), 'the') - 1 AS pos FROM documents)
    SELECT doc_id, trim(regexp_replace(substr(text, greatest(0, pos - 80) + 1, pos + 160 - greatest(0, pos - 80)), '\s+', ' ', 'g')) AS snippet
    FROM d WHERE pos >= 0""")
def _(t):
    pos = F.instr(F.lower("text"), F.lit("the")) - 1
    rows = t.raw("documents").withColumn("pos", pos).filter("pos >= 0")
    return rows.select("doc_id", tx.snippet("text", F.col("pos"), 80, 160).alias("snippet"))


@query("fn_14_flexible_phrases", r"""
    SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(?:of\W+the)\b')) AS matches FROM documents""")
def _(t):
    return t.raw("documents").select(
        "doc_id", tx.count_matches("text", tx.phrase_pattern("Of THE")).alias("matches"))
