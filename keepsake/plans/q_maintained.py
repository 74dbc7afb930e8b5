"""Tables that are kept up to date: timeline, sessions of writing, chunk memory."""

from pyspark.sql import functions as F

from keepsake.operators import context
from keepsake.plans import tables
from keepsake.plans.q_contacts import ISO
from keepsake.plans.q_retrieval import ASKED, asked
from keepsake.plans.registry import query

# Stored: half of the events. Incoming: all of them, a third twice, so it overlaps and repeats.
KEYED = rf"""k AS (SELECT seq, owner_id, source, kind, created_at, source || '|' || kind || '||' || {ISO} || '|'
        || substr(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 1, 180) AS key FROM v_evt),
    old AS (SELECT * FROM k WHERE seq % 2 = 0),
    inc AS (SELECT * FROM k UNION ALL SELECT * REPLACE (seq + 1000000000000 AS seq) FROM k WHERE seq % 3 = 0),
    added AS (SELECT * FROM inc i WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.owner_id = i.owner_id AND o.key = i.key)
        QUALIFY row_number() OVER (PARTITION BY owner_id, key ORDER BY seq) = 1),
    merged AS (SELECT *, false AS imported FROM old UNION ALL SELECT *, true FROM added)"""

REPEATED = 1_000_000_000_000


def sides(t):
    e = t.dense().withColumn("external_id", F.lit(None).cast("string"))
    again = e.filter(F.col("seq") % 3 == 0).withColumn("seq", F.col("seq") + REPEATED)
    return e.filter(F.col("seq") % 2 == 0), e.unionByName(again)


@query("inc_01_upsert_timeline", f"WITH {KEYED} SELECT owner_id, seq, imported FROM merged")
def _(t):
    return tables.upsert_timeline(*sides(t)).select("owner_id", "seq", "imported")


@query("inc_01_import_report", f"""WITH {KEYED}
    SELECT owner_id, count(*) FILTER (imported) AS imported, count(*) AS total_after_import FROM merged GROUP BY 1""")
def _(t):
    return tables.import_report(tables.upsert_timeline(*sides(t)))


@query("jn_07_new_events", f"WITH {KEYED} SELECT owner_id, seq FROM added")
def _(t):
    return tables.new_events(*sides(t)).select("owner_id", "seq")


def stored_at(t, name):
    """A fresh folder for a table this query writes and reads back."""
    import uuid

    from keepsake.session import shared_dir
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("snk_01_stored_timeline", f"WITH {KEYED} SELECT owner_id, source, seq FROM merged")
def _(t):
    path = stored_at(t, "timeline")
    old, incoming = sides(t)
    tables.write_timeline(old, path)
    tables.import_events(t.spark, path, incoming)
    return tables.read_timeline(t.spark, path).select("owner_id", "source", "seq")


@query("inc_01_first_import", f"WITH {KEYED} SELECT owner_id, source, seq FROM merged")
def _(t):
    """Two imports into a store that does not exist yet."""
    path = stored_at(t, "first")
    for rows in sides(t):
        tables.import_events(t.spark, path, rows)
    return tables.read_timeline(t.spark, path).select("owner_id", "source", "seq")


@query("snk_02_stored_forum", """
    SELECT 'comments' AS name, count(*) AS rows, CAST(sum(id) AS BIGINT) AS ids FROM v_comment
    UNION ALL SELECT 'posts', count(*), CAST(sum(id) AS BIGINT) FROM v_post
    UNION ALL SELECT 'saved', count(*), CAST(sum(id) AS BIGINT) FROM v_saved
    UNION ALL SELECT 'upvoted', count(*), CAST(sum(id) AS BIGINT) FROM v_upvoted
    UNION ALL SELECT 'subreddits', count(*), NULL FROM (SELECT DISTINCT owner_id, subreddit FROM v_comment)""")
def _(t):
    path = stored_at(t, "forum")
    names = t.comments().select("owner_id", F.col("subreddit").alias("name")).distinct()
    tables.write_forum({"comments": t.comments(), "posts": t.posts(), "saved": t.saved(),
                        "upvoted": t.upvoted(), "subreddits": names}, path)
    out = None
    for name, df in tables.read_forum(t.spark, path).items():
        ids = F.sum("id") if "id" in df.columns else F.lit(None).cast("long")
        row = df.agg(F.count(F.lit(1)).alias("rows"), ids.alias("ids")).select(
            F.lit(name).alias("name"), "rows", "ids")
        out = row if out is None else out.unionByName(row)
    return out


@query("snk_03_stored_profiles", """
    SELECT owner_id, count(*) AS events FROM v_evt GROUP BY 1""")
def _(t):
    path = stored_at(t, "profiles")
    totals = t.dense().groupBy("owner_id").agg(F.count(F.lit(1)).alias("events"))
    tables.write_profile(totals, path, "identity")
    return tables.read_profile(t.spark, path, "identity")


@query("snk_03_cleared", """
    SELECT owner_id, 0 AS before, count(*) AS after FROM v_evt WHERE is_user_message GROUP BY 1
    UNION ALL SELECT owner_id, count(*), 0 FROM v_evt GROUP BY 1""")
def _(t):
    """A table that is emptied keeps its schema, and takes new rows."""
    path = stored_at(t, "cleared")
    rows = t.dense().select("owner_id", "seq", "is_user_message")
    rows.write.parquet(path)
    n = F.count(F.lit(1))
    before = rows.groupBy("owner_id").agg(n.alias("before"), F.lit(0).cast("long").alias("after"))
    tables.clear(t.spark, path, rows.schema)
    kept = t.spark.read.parquet(path)
    kept.unionByName(rows.filter("is_user_message")).write.mode("append").parquet(path)
    after = t.spark.read.parquet(path).groupBy("owner_id").agg(F.lit(0).cast("long").alias("before"), n.alias("after"))
    return before.unionByName(after)


@query("snk_04_latest_contact_profiles", """
    SELECT owner_id, contact, CASE WHEN count(*) FILTER (is_user_message) > 0 THEN count(*) FILTER (is_user_message)
        ELSE count(*) END AS messages FROM v_evt GROUP BY ALL""")
def _(t):
    path = stored_at(t, "contacts")
    keys = ["owner_id", "contact"]
    n = F.count(F.lit(1)).alias("messages")
    tables.write_contact_profiles(t.dense().groupBy(*keys).agg(n), path, 1)
    tables.write_contact_profiles(
        t.dense().filter("is_user_message").groupBy(*keys).agg(n), path, 2)
    return tables.read_contact_profiles(t.spark, path).drop("version")


# Writing sessions: each chat is one, its first turn the topic, its channel number the contact.
SESSIONS = """ws AS (SELECT conv_id AS session_id, owner_id, arg_min(text, turn) AS topic,
        CASE WHEN conv_id % 3 > 0 THEN 'c' || (conv_id % 4) END AS contact, count(*) AS turns FROM v_chat GROUP BY ALL),
    fixes AS (SELECT conv_id AS session_id, owner_id, turn, text AS feedback FROM v_chat WHERE role <> 'user')"""


def writing(t):
    return t.chats().groupBy(F.col("conv_id").alias("session_id"), "owner_id").agg(
        F.min_by("text", "turn").alias("topic"), F.count(F.lit(1)).alias("turns")).withColumn(
        "contact", F.when(F.col("session_id") % 3 > 0, F.concat(
            F.lit("c"), (F.col("session_id") % 4).cast("string")))).withColumn(
        "timestamp", F.timestamp_seconds(F.col("session_id") * 3600)).withColumn(
        "data_note", F.when(F.col("session_id") % 5 == 0, F.lit("few messages")))


def fixes(t):
    return t.chats().filter("role <> 'user'").select(
        F.col("conv_id").alias("session_id"), "owner_id", F.col("turn").alias("seq"),
        F.col("text").alias("feedback"))


@query("inc_07_recent_sessions", f"""WITH {SESSIONS}
    SELECT owner_id, session_id, row_number() OVER (PARTITION BY owner_id ORDER BY session_id DESC) AS rank FROM ws
    QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY session_id DESC) <= 100""")
def _(t):
    return tables.keep_recent_sessions(writing(t), 100).select("owner_id", "session_id", "rank")


@query("jn_14_sessions_of_contact", f"""WITH {SESSIONS}
    SELECT owner_id, contact, session_id, row_number() OVER (PARTITION BY owner_id, contact ORDER BY session_id DESC) AS rank
    FROM ws WHERE contact IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY owner_id, contact ORDER BY session_id DESC) <= 5""")
def _(t):
    return tables.recent_of_contact(writing(t), 5).select("owner_id", "contact", "session_id", "rank")


CORRECTED = f"""{SESSIONS}, cs AS (SELECT ws.*, coalesce(n, 0) AS n, f AS feedback FROM ws LEFT JOIN (
        SELECT owner_id, session_id, count(*) AS n, string_agg(feedback, '; ' ORDER BY turn % 2, turn) AS f FROM fixes GROUP BY ALL)
        USING (owner_id, session_id))"""


def changed(t, compact=False):
    """Corrections in two writes, an update in each, and a compaction between them."""
    path, late = stored_at(t, "changes"), F.col("seq") % 2 == 1
    notes = writing(t).select("owner_id", "session_id", F.concat(F.lit("note "), "session_id").alias("data_note"),
                              F.when(F.col("session_id") % 2 == 0, "somebody").alias("contact"))
    first = tables.updates_as_changes(notes.withColumn("data_note", F.lit("old")), ["data_note", "contact"])
    second = tables.updates_as_changes(notes.filter("session_id % 3 = 0").withColumn("contact", F.lit(None)), ["data_note", "contact"])
    tables.log_changes(tables.corrections_as_changes(fixes(t).filter(~late)).unionByName(first), path, 1)
    if compact:
        tables.compact_changes(t.spark, path)
    tables.log_changes(tables.corrections_as_changes(fixes(t).filter(late)).unionByName(second), path, 2)
    if compact:
        tables.compact_changes(t.spark, path)
    return tables.read_changes(t.spark, path)


# Even turns were written first.
@query("inc_08_corrections", f"""WITH {SESSIONS}
    SELECT owner_id, session_id, row_number() OVER (PARTITION BY owner_id, session_id ORDER BY turn % 2, turn) AS place,
        md5(feedback) AS digest FROM fixes""")
def _(t):
    return tables.corrections_of(changed(t)).select("owner_id", "session_id", "place", F.md5("feedback").alias("digest"))


@query("inc_08_updated_sessions", f"""WITH {SESSIONS}
    SELECT owner_id, session_id, CASE WHEN session_id % 3 = 0 THEN 'note ' || session_id ELSE 'old' END AS data_note,
        CASE WHEN session_id % 2 = 0 THEN 'somebody' ELSE contact END AS contact,
        (SELECT count(*) FROM fixes f WHERE f.owner_id = ws.owner_id AND f.session_id = ws.session_id) AS corrections FROM ws""")
def _(t):
    changes = changed(t, compact=True)
    n = tables.corrections_of(changes).groupBy("owner_id", "session_id").agg(F.count(F.lit(1)).alias("corrections"))
    rows = tables.update_sessions(writing(t), changes, ["data_note", "contact"])
    return rows.join(n, ["owner_id", "session_id"], "left").select(
        "owner_id", "session_id", "data_note", "contact", F.coalesce("corrections", F.lit(0)).alias("corrections"))


@query("ctx_04_session_lines", f"""WITH {CORRECTED}
    SELECT owner_id, session_id, '[' || strftime(make_timestamp(session_id * 3600000000), '%Y-%m-%dT%H:%M:%S.000Z') || ']'
        || coalesce(' (to ' || contact || ')', '') || chr(10) || 'User asked: "' || substr(topic, 1, 100)
        || CASE WHEN length(topic) > 100 THEN '...' ELSE '' END || '"'
        || coalesce(chr(10) || 'User corrections: ' || feedback, '')
        || CASE WHEN session_id % 5 = 0 THEN chr(10) || 'Note: few messages' ELSE '' END AS line
    FROM cs QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY session_id DESC) <= 5""")
def _(t):
    return context.session_lines(writing(t), tables.corrections_of(changed(t)), 5).select(
        "owner_id", "session_id", "line")


# Chunk memory: each chat is a summarized chunk, the words of its first turn its topics.
MEMORY = """mem AS (SELECT owner_id, 'k' || (conv_id % 6) AS contact_key, conv_id AS chunk_id, conv_id * 86400000 AS start_ms,
        conv_id * 86400000 + count(*) * 3600000 AS end_ms, count(*) AS message_count, arg_min(text, turn) AS summary,
        list_distinct(regexp_extract_all(lower(arg_min(text, turn)), '[a-z0-9'']+')) AS topics FROM v_chat GROUP BY owner_id, conv_id)"""


def memory(t):
    from keepsake.functions.text import tokens
    day = F.col("conv_id") * 86_400_000
    return t.chats().groupBy("owner_id", "conv_id").agg(
        F.min_by("text", "turn").alias("summary"), F.count(F.lit(1)).alias("message_count")).select(
        "owner_id", F.concat(F.lit("k"), (F.col("conv_id") % 6).cast("string")).alias("contact_key"),
        F.col("conv_id").alias("chunk_id"), day.alias("start_ms"),
        (day + F.col("message_count") * 3_600_000).alias("end_ms"), "message_count", "summary",
        F.array_distinct(tokens("summary")).alias("topics"),
        F.array().cast("array<string>").alias("notable_events"))


@query("inc_09_memory_rows", """
    SELECT conv_id AS chunk_id, owner_id, count(*) AS message_count, 'tone ' || (conv_id % 3) AS tone FROM v_chat GROUP BY ALL""")
def _(t):
    chunks = memory(t).select("owner_id", "chunk_id", "contact_key", "start_ms", "end_ms", "message_count")
    made = memory(t).select(
        "owner_id", "chunk_id", "summary", "topics", "notable_events",
        F.concat(F.lit("tone "), (F.col("chunk_id") % 3).cast("string")).alias("tone"))
    out = tables.memory_rows(chunks, made, "local", F.lit("2024-01-01").cast("timestamp"))
    return out.select("chunk_id", "owner_id", "message_count", "tone")


# Every word of every benchmark text is asked for.
TOPICAL = f"""{ASKED}, {MEMORY}, who AS (SELECT question_id * 1000 + i AS question_id, owner_id, w[i] AS topic,
        'k' || (question_id % 6) AS contact_key FROM asked, generate_series(1, len(w)) g(i))"""


def asking(t):
    from keepsake.functions.text import tokens
    return asked(t).select("owner_id", "question_id", F.posexplode(tokens("topic")).alias("i", "topic")).select(
        "owner_id", (F.col("question_id") * 1000 + F.col("i") + 1).alias("question_id"), "topic",
        F.concat(F.lit("k"), (F.col("question_id") % 6).cast("string")).alias("contact_key"))


@query("top_15_chunks_by_topic", f"""WITH {TOPICAL}, m AS (SELECT w.owner_id, question_id, chunk_id, start_ms,
        CASE WHEN len([x for x in topics if contains(x, topic) OR contains(topic, x)]) > 0 THEN 0
             WHEN contains(lower(summary), topic) THEN 1 END AS grp
        FROM who w JOIN mem USING (owner_id, contact_key))
    SELECT owner_id, question_id, chunk_id, row_number() OVER (PARTITION BY owner_id, question_id ORDER BY grp, start_ms, chunk_id) AS rank
    FROM m WHERE grp IS NOT NULL""")
def _(t):
    return context.chunks_by_topic(memory(t), asking(t)).select(
        "owner_id", "question_id", "chunk_id", "rank")


# The summary of a contact was set twice, what is known of it once, a day later.
SET_AT = ("2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00")


def state(t):
    path = stored_at(t, "state")
    contacts = memory(t).groupBy("owner_id", "contact_key").agg(F.sum("message_count").alias("n"))
    at = [F.lit(x).cast("timestamp") for x in SET_AT]
    tables.set_state(contacts.withColumn("v", F.concat(F.lit("meta "), "contact_key")), path, "meta_summary", "v", at[0])
    tables.set_state(contacts.withColumn("v", F.concat(F.lit("known of "), F.col("n").cast("string"))), path, "knowledge_state", "v", at[1])
    tables.set_state(contacts.filter("n % 2 = 0").withColumn("v", F.concat(F.lit("newer "), "contact_key")), path, "meta_summary", "v", at[2])
    return tables.read_state(t.spark, path)


@query("inc_09_state_as_of", f"""WITH {MEMORY}, c AS (SELECT owner_id, contact_key, sum(message_count) AS n FROM mem GROUP BY ALL),
    days AS (SELECT unnest([0, 1, 2, 3]) AS day)
    SELECT owner_id, contact_key, day, CASE WHEN day = 0 THEN NULL WHEN day = 3 AND n % 2 = 0 THEN 'newer ' || contact_key
            ELSE 'meta ' || contact_key END AS meta_summary, CASE WHEN day >= 2 THEN 'known of ' || n END AS knowledge_state FROM c, days""")
def _(t):
    asked = memory(t).select("owner_id", "contact_key").distinct().withColumn(
        "day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn(
        "at", F.timestamp_seconds(F.unix_timestamp(F.lit("2023-12-31 12:00:00")) + F.col("day") * 86_400))
    return tables.state_as_of(state(t), asked, ["meta_summary", "knowledge_state"]).drop("at")


@query("top_16_first_chunks", f"""WITH {MEMORY}, c AS (SELECT owner_id, contact_key, sum(message_count) AS n FROM mem GROUP BY ALL)
    SELECT owner_id, contact_key, chunk_id, CASE WHEN n % 2 = 0 THEN 'newer ' ELSE 'meta ' END || contact_key AS meta_summary,
        'known of ' || n AS knowledge_state, row_number() OVER (PARTITION BY owner_id, contact_key ORDER BY start_ms, chunk_id) AS rank FROM mem JOIN c USING (owner_id, contact_key)
    QUALIFY row_number() OVER (PARTITION BY owner_id, contact_key ORDER BY start_ms, chunk_id) <= 10""")
def _(t):
    asked = memory(t).select("owner_id", "contact_key").distinct().withColumn("at", F.lit("2024-02-01").cast("timestamp"))
    known = tables.state_as_of(state(t), asked, ["meta_summary", "knowledge_state"]).drop("at")
    return context.first_chunks(memory(t), known).select(
        "owner_id", "contact_key", "chunk_id", "meta_summary", "knowledge_state", "rank")


@query("ctx_05_memory_text", f"""WITH {MEMORY}, r AS (
        SELECT *, row_number() OVER (PARTITION BY owner_id, contact_key ORDER BY start_ms, chunk_id) AS rank FROM mem),
    l AS (SELECT *, chr(10) || '[' || strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d') || ' to '
        || strftime(make_timestamp(end_ms * 1000), '%Y-%m-%d') || '] (' || message_count || ' messages)' || chr(10)
        || 'Summary: ' || summary || CASE WHEN len(w) > 0 THEN chr(10) || 'Topics: ' || array_to_string(w, ', ') ELSE '' END AS line
        FROM (SELECT *, regexp_extract_all(lower(summary), '[a-z0-9'']+') AS w FROM r) WHERE rank <= 10)
    SELECT owner_id, contact_key, 'OVERALL SUMMARY: meta ' || contact_key || chr(10) || chr(10) || 'CONVERSATION CHUNKS:'
        || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS memory_text FROM l GROUP BY owner_id, contact_key""")
def _(t):
    meta = memory(t).select("owner_id", "contact_key").distinct().withColumn(
        "meta_summary", F.concat(F.lit("meta "), "contact_key"))
    from keepsake.functions.text import tokens
    every = memory(t).withColumn("topics", tokens("summary"))  # in order and with repeats, as SQL lists them
    return context.memory_text(context.first_chunks(every, meta))


@query("ctx_02_timeline_context", r"""WITH lines AS (
        SELECT owner_id, 'source' AS section, '- ' || source || ': ' || format('{:,}', count(*)) AS line,
            row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, source) AS rank, 12 AS most FROM v_timeline GROUP BY owner_id, source
        UNION ALL SELECT owner_id, 'contact', '- ' || contact || ': ' || format('{:,}', count(*)) || ' messages',
            row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, contact), 20 FROM v_msg GROUP BY owner_id, contact
        UNION ALL SELECT owner_id, 'recent_' || source, '- [' || strftime(created_at, '%Y-%m-%d') || ']' || CASE source
                WHEN 'sms' THEN CASE WHEN is_user_message THEN ' [Me]' ELSE '' END || ' with: Me, ' || contact || ' | '
                    || substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 150)
                ELSE ' (' || channel || ') ' || substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 220) END,
            row_number() OVER (PARTITION BY owner_id, source ORDER BY created_at DESC, seq DESC),
            CASE source WHEN 'sms' THEN 200 ELSE 10 END FROM v_timeline WHERE source <> 'llm_chat'
        UNION ALL SELECT owner_id, 'domain', '- ' || domain || ': ' || format('{:,}', count(*)) || ' visits',
            row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, domain), 30
        FROM (SELECT owner_id, regexp_replace(lower(regexp_extract(text, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)', 1)),
                  '^www\.', '') AS domain FROM v_timeline WHERE source = 'chrome') WHERE domain <> '' GROUP BY owner_id, domain)
    SELECT owner_id, section, rank, line FROM lines WHERE rank <= most""")
def _(t):
    return context.timeline_context(t.timeline())
