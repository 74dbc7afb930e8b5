"""Conversations by silence and chunks of messages."""

from pyspark.sql import functions as F

from keepsake.operators import sessions
from keepsake.plans.registry import query

GAP = 6 * sessions.HOUR
P = "PARTITION BY owner_id, contact_key ORDER BY ts_ms, seq"
STEPS = f"""gaps AS (SELECT *, ts_ms - lag(ts_ms) OVER ({P}) AS gap FROM v_evt),
    tagged AS (SELECT *, CAST(sum((gap IS NULL OR gap > {GAP})::INT) OVER ({P}) AS BIGINT) AS conversation
               FROM gaps),
    conv AS (SELECT owner_id, contact_key, conversation, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms,
                    count(*) AS message_count,
                    count(*) FILTER (gap <= {GAP} AND gap * 3 > {GAP}) AS gap_count
             FROM tagged GROUP BY ALL)"""
WALK = f"""WITH RECURSIVE {STEPS}, walk AS (
        SELECT owner_id, contact_key, conversation, 0 AS merged_group, message_count AS held
        FROM conv WHERE conversation = 1
        UNION ALL
        SELECT c.owner_id, c.contact_key, c.conversation,
               CASE WHEN w.held >= 5 THEN w.merged_group + 1 ELSE w.merged_group END,
               CASE WHEN w.held >= 5 THEN c.message_count ELSE w.held + c.message_count END
        FROM walk w JOIN conv c ON c.owner_id = w.owner_id AND c.contact_key = w.contact_key
             AND c.conversation = w.conversation + 1)"""
PIECES = f"""{WALK}, placed AS (
        SELECT t.*, merged_group, row_number() OVER (
            PARTITION BY owner_id, contact_key, merged_group ORDER BY ts_ms, seq) - 1 AS position
        FROM tagged t JOIN walk USING (owner_id, contact_key, conversation)),
    totals AS (SELECT owner_id, contact_key, merged_group, sum(message_count) AS group_messages,
                      CAST(sum(gap_count + 1) AS BIGINT) AS gap_count
               FROM conv JOIN walk USING (owner_id, contact_key, conversation) GROUP BY ALL),
    chunk AS (SELECT owner_id, contact_key, merged_group, position // 8 AS piece, min(ts_ms) AS start_ms,
                     max(ts_ms) AS end_ms, count(*) AS message_count FROM placed GROUP BY ALL),
    chunks AS (SELECT owner_id, contact_key, start_ms, end_ms, message_count, gap_count, merged_group, piece,
        contact_key || '_' || start_ms || CASE WHEN group_messages < 5 THEN '_merged' ELSE '' END AS chunk_id,
        CASE WHEN group_messages < 5 THEN 'merged'
             ELSE strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d_%H') END AS conversation_key
        FROM chunk JOIN totals USING (owner_id, contact_key, merged_group))"""
KEY = sessions.KEY


def table(t):
    return sessions.slots(sessions.prepare(t.dense()))


@query("win_01_gap_sessions", f"""WITH {STEPS}
    SELECT owner_id, contact_key, conversation, event_id FROM tagged""")
def _(t):
    messages = sessions.prepare(t.dense())
    return sessions.with_conversation(messages, sessions.slots(messages)).select(
        *KEY, "conversation", "event_id")


@query("win_02_conversations_with_pauses", f"WITH {STEPS} SELECT * FROM conv")
def _(t):
    return sessions.conversations(table(t))


@query("win_03_merged_conversations", f"""{WALK}
    SELECT owner_id, contact_key, conversation, CAST(merged_group AS BIGINT) AS merged_group FROM walk""")
def _(t):
    return sessions.merge_small(sessions.conversations(table(t)), 5).select(
        *KEY, "conversation", "merged_group")


def chunks(t, **kw):
    return sessions.chunks(t.dense(), min_messages=5, max_messages=8, **kw)


CHUNK_COLUMNS = ["owner_id", "chunk_id", "contact_key", "conversation_key", "start_ms", "end_ms",
                 "message_count", "gap_count"]


@query("win_04_chunks", f"{PIECES} SELECT {', '.join(CHUNK_COLUMNS)} FROM chunks")
def _(t):
    return chunks(t).select(CHUNK_COLUMNS)


@query("win_04_chunks_hot_slots", f"{PIECES} SELECT {', '.join(CHUNK_COLUMNS)} FROM chunks")
def _(t):
    """The same with every slot of two messages and more taken apart as a hot one."""
    return chunks(t, hot_slot=1).select(CHUNK_COLUMNS)


@query("ctx_01_chunk_texts", rf"""{PIECES}, lines AS (
        SELECT owner_id, contact_key, merged_group, position // 8 AS piece, string_agg(
            '[' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '] ' ||
            CASE WHEN is_user_message THEN 'Me' ELSE 'Them' END || ': ' || text, chr(10) ORDER BY position) AS body
        FROM placed GROUP BY ALL)
    SELECT owner_id, chunk_id, contact_key, 'CONTACT: ' || contact_key
        || chr(10) || 'TIME RANGE: ' || strftime(make_timestamp(start_ms * 1000), '%Y-%m-%dT%H:%M:%S')
        || ' to ' || strftime(make_timestamp(end_ms * 1000), '%Y-%m-%dT%H:%M:%S')
        || chr(10) || 'DURATION: ~' || CAST(floor((end_ms - start_ms) / 3600000.0 + 0.5) AS BIGINT) || ' hours'
        || chr(10) || 'MESSAGE COUNT: ' || message_count
        || chr(10) || 'GAPS: ' || gap_count || ' significant pauses within conversation'
        || chr(10) || chr(10) || 'MESSAGES:' || chr(10) || body AS chunk_text
    FROM chunks JOIN lines USING (owner_id, contact_key, merged_group, piece)""")
def _(t):
    return sessions.chunk_texts(t.dense(), min_messages=5, max_messages=8)


@query("agg_44_contacts_of_chunks", f"{PIECES} SELECT DISTINCT owner_id, contact_key FROM chunks")
def _(t):
    return sessions.contacts_of(chunks(t))


@query("jn_04_messages_in_chunks", f"""{PIECES}
    SELECT c.owner_id, c.chunk_id, e.event_id FROM chunks c JOIN v_evt e
    ON e.owner_id = c.owner_id AND e.contact_key = c.contact_key
       AND e.ts_ms BETWEEN c.start_ms AND c.end_ms""")
def _(t):
    return sessions.messages_in_chunks(chunks(t), sessions.prepare(t.dense())).select(
        "owner_id", "chunk_id", "event_id")


@query("win_08_chunk_samples", f"""{PIECES}, inside AS (
        SELECT c.owner_id, c.chunk_id, e.event_id, e.created_at, e.text, e.seq FROM chunks c JOIN v_evt e
        ON e.owner_id = c.owner_id AND e.contact_key = c.contact_key
           AND e.ts_ms BETWEEN c.start_ms AND c.end_ms),
    ranks AS (SELECT *,
        row_number() OVER (PARTITION BY owner_id, chunk_id ORDER BY created_at, seq) AS up,
        row_number() OVER (PARTITION BY owner_id, chunk_id ORDER BY created_at DESC, seq DESC) AS down,
        row_number() OVER (PARTITION BY owner_id, chunk_id ORDER BY length(text) DESC, created_at, seq) AS size
        FROM inside),
    picked AS (
        SELECT *, up AS picked FROM ranks WHERE up <= 3 UNION ALL
        SELECT *, 7 - down FROM ranks WHERE down <= 3 UNION ALL
        SELECT *, 6 + size FROM ranks WHERE size <= 2),
    once AS (SELECT * FROM picked QUALIFY row_number() OVER (
        PARTITION BY owner_id, chunk_id, created_at, text ORDER BY picked) = 1)
    SELECT owner_id, chunk_id, event_id,
           row_number() OVER (PARTITION BY owner_id, chunk_id ORDER BY picked) AS rank FROM once
    QUALIFY row_number() OVER (PARTITION BY owner_id, chunk_id ORDER BY picked) <= 6""")
def _(t):
    inside = sessions.messages_in_chunks(chunks(t), sessions.prepare(t.dense()))
    slim = inside.select("owner_id", "chunk_id", "event_id", "created_at", "seq", "text")
    return sessions.chunk_samples(slim).select("owner_id", "chunk_id", "event_id", "rank")


STORED = f"""stored AS (
        SELECT owner_id, chunk_id, message_count + CASE WHEN start_ms % 5 = 0 THEN 1 ELSE 0 END AS message_count,
               to_timestamp(1706745600) - to_days(CAST(start_ms % 11 AS INT)) AS processed_at
        FROM chunks WHERE start_ms % 4 <> 0)"""


def stored(t):
    c, ms = chunks(t), F.col("start_ms")
    back = F.make_dt_interval((ms % 11).cast("int"))
    return c.filter(ms % 4 != 0).select(
        "owner_id", "chunk_id",
        (F.col("message_count") + (ms % 5 == 0).cast("long")).alias("message_count"),
        (F.timestamp_seconds(F.lit(1706745600)) - back).alias("processed_at"))


@query("inc_03_stale_chunks", f"""{PIECES}, {STORED}
    SELECT c.owner_id, c.chunk_id, CASE WHEN s.chunk_id IS NULL THEN 'absent'
        WHEN s.message_count <> c.message_count THEN 'changed' ELSE 'old' END AS reason
    FROM chunks c LEFT JOIN stored s ON s.owner_id = c.owner_id AND s.chunk_id = c.chunk_id
    WHERE s.chunk_id IS NULL OR s.message_count <> c.message_count
       OR s.processed_at < to_timestamp(1706745600) - INTERVAL 7 DAY""")
def _(t):
    from keepsake.plans import tables
    return tables.stale_chunks(chunks(t), stored(t), 1706745600_000).select(
        "owner_id", "chunk_id", "reason")


@query("inc_02_upsert_chunks", f"""{PIECES}, {STORED}
    SELECT owner_id, chunk_id, message_count, 'new' AS origin FROM chunks WHERE start_ms % 3 = 0
    UNION ALL
    SELECT owner_id, chunk_id, message_count, 'stored' FROM stored s WHERE NOT EXISTS (
        SELECT 1 FROM chunks c WHERE c.owner_id = s.owner_id AND c.chunk_id = s.chunk_id
        AND c.start_ms % 3 = 0)""")
def _(t):
    from keepsake.plans import tables
    old = stored(t).select("owner_id", "chunk_id", "message_count", F.lit("stored").alias("origin"))
    new = chunks(t).filter(F.col("start_ms") % 3 == 0).select(
        "owner_id", "chunk_id", "message_count", F.lit("new").alias("origin"))
    return tables.upsert_by_key(old, new, ["owner_id", "chunk_id"])
