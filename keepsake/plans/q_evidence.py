"""Evidence of disclosure."""

from pyspark.sql import functions as F

from keepsake.functions.lexicons import DISCLOSURE_DENIALS, TOPIC_SYNONYMS
from keepsake.operators import disclosure
from keepsake.operators.term_index import stored
from keepsake.plans.q_contacts import ISO
from keepsake.plans.registry import query

# Cases: each language stands for a person, and the channel number picks a topic.
TOPICS = ["the", "and", "er", "job", "que"]


def case_sql():
    return f"""cases AS (SELECT DISTINCT owner_id, lang AS contact,
        ([{", ".join(f"'{x}'" for x in TOPICS)}])[event_id % {len(TOPICS)} + 1] AS topic FROM v_msg)"""


SYN = " ".join(
    f"WHEN topic IN ('{n}', {', '.join(repr(w) for w in ws)}) THEN [{', '.join(repr(w) for w in [*ws, n])}]"
    for n, ws in TOPIC_SYNONYMS.items())
DENY = " OR ".join("contains(low, '" + d.replace("'", "''") + "')" for d in [*DISCLOSURE_DENIALS])
# Every seventh text of the owner is kept as a recorded statement of the case's contact.
BASE = rf"""{case_sql()}, terms AS (SELECT *, CASE {SYN} ELSE [lower(topic)] END AS terms FROM cases),
    hit AS (SELECT t.owner_id, t.contact, topic, seq, text, is_user_message, lower(text) AS low, created_at,
              {ISO} AS stamp FROM v_msg m JOIN terms t ON t.owner_id = m.owner_id AND t.contact = m.lang
            WHERE len([x for x in terms if contains(lower(text), x)]) > 0),
    delta AS (SELECT t.owner_id, t.contact, t.topic, seq, d.status, d.at_date, d.evidence FROM (
            SELECT owner_id, lang AS contact, seq, split_part(text, ' ', 2) AS dtopic,
                ([ 'disclosed', 'hinted', 'contradicted', 'updated'])[seq % 4 + 1] AS status,
                strftime(created_at, '%Y-%m-%d') AS at_date,
                CASE WHEN seq % 3 = 0 THEN text ELSE 'heard: ' || text END AS evidence FROM v_msg) d
        JOIN terms t ON t.owner_id = d.owner_id AND t.contact = d.contact
        WHERE len([x for x in terms if contains(lower(dtopic), x)]) > 0),
    said AS (SELECT owner_id, contact, topic, stamp, text FROM hit WHERE is_user_message),
    ev AS (SELECT * FROM said UNION ALL
        SELECT owner_id, contact, topic, at_date, evidence FROM (SELECT * FROM delta d WHERE status = 'disclosed'
            AND NOT EXISTS (SELECT 1 FROM said s WHERE s.owner_id = d.owner_id AND s.contact = d.contact
                            AND s.topic = d.topic AND s.text = d.evidence)
            QUALIFY row_number() OVER (PARTITION BY owner_id, contact, topic, evidence ORDER BY seq) = 1)),
    denial AS (SELECT owner_id, contact, topic, stamp, text FROM hit WHERE is_user_message AND ({DENY})
        UNION ALL SELECT owner_id, contact, topic, at_date, evidence FROM delta WHERE status = 'contradicted'),
    ack AS (SELECT owner_id, contact, topic, stamp, text FROM hit WHERE NOT is_user_message)"""


def people(t):
    return t.messages().withColumn("participants", F.array(F.lit("Me"), "lang"))


def cases(t):
    topics = F.array(*[F.lit(x) for x in TOPICS])
    return t.messages().select(
        "owner_id", F.col("lang").alias("contact"),
        F.element_at(topics, (F.col("event_id") % len(TOPICS) + 1).cast("int")).alias("topic")
    ).distinct()


def summaries(t):
    status = F.element_at(F.array(*[F.lit(s) for s in (
        "disclosed", "hinted", "contradicted", "updated")]), (F.col("seq") % 4 + 1).cast("int"))
    delta = F.struct(
        F.split_part("text", F.lit(" "), F.lit(2)).alias("topic"), status.alias("status"),
        F.date_format("created_at", "yyyy-MM-dd").alias("date"),
        F.when(F.col("seq") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("heard: "), "text"))
        .alias("evidence"))
    return t.messages().select(
        "owner_id", F.col("lang").alias("contact_key"), F.col("seq").alias("start_ms"),
        F.col("seq").cast("string").alias("chunk_id"), F.array(delta).alias("knowledge_deltas"))


@query("fn_19_topic_terms", f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN
        ([{", ".join(repr(x) for x in ["Job", "venture", "golf", "mom", "TRIP", "debt", "moving"])}])[doc_id % 7 + 1]
        ELSE split_part(text, ' ', 1) END AS topic FROM documents)
    SELECT doc_id, CASE {SYN.replace('topic IN', 'lower(topic) IN').replace('[', "array_to_string([").replace(']', "], '|')")}
        ELSE lower(topic) END AS terms FROM d""")
def _(t):
    stock = F.array(*[F.lit(x) for x in ["Job", "venture", "golf", "mom", "TRIP", "debt", "moving"]])
    n = F.col("doc_id")
    topic = F.when(n % 2 == 0, F.element_at(stock, (n % 7 + 1).cast("int"))).otherwise(
        F.split_part("text", F.lit(" "), F.lit(1)))
    return t.raw("documents").select("doc_id", F.array_join(
        disclosure.topic_terms(topic), "|").alias("terms"))


@query("jn_09_disclosing_statements", f"""WITH {BASE}
    SELECT owner_id, contact, topic, stamp, md5(text) AS text_md5 FROM ev""")
def _(t):
    rows = disclosure.evidence(stored(disclosure.statements(people(t), cases(t), summaries(t)), "statements"))
    return rows.select(*disclosure.CASE, F.col("at").alias("stamp"), F.md5("text").alias("text_md5"))


@query("jn_10_acknowledgments", f"""WITH {BASE}
    SELECT owner_id, contact, topic, stamp, md5(text) AS text_md5 FROM ack""")
def _(t):
    rows = disclosure.acknowledgments(disclosure.statements(people(t), cases(t)))
    return rows.select(*disclosure.CASE, F.col("at").alias("stamp"), F.md5("text").alias("text_md5"))


ROLLUP = f"""WITH {BASE}, n AS (
        SELECT c.*, (SELECT count(*) FROM ev x WHERE x.owner_id = c.owner_id AND x.contact = c.contact AND x.topic = c.topic) AS mentions,
        (SELECT count(*) FROM denial x WHERE x.owner_id = c.owner_id AND x.contact = c.contact AND x.topic = c.topic) AS denials,
        (SELECT count(*) FROM ack x WHERE x.owner_id = c.owner_id AND x.contact = c.contact AND x.topic = c.topic) AS acks,
        (SELECT count(*) FROM delta x WHERE x.owner_id = c.owner_id AND x.contact = c.contact AND x.topic = c.topic AND status = 'hinted') AS hints,
        (SELECT max(stamp) FROM ev x WHERE x.owner_id = c.owner_id AND x.contact = c.contact AND x.topic = c.topic) AS last,
        (SELECT max(length(text)) FROM ev x WHERE x.owner_id = c.owner_id AND x.contact = c.contact AND x.topic = c.topic) AS longest,
        (SELECT date_diff('second', min(CAST(stamp AS TIMESTAMP)), max(CAST(stamp AS TIMESTAMP))) FROM ev x
         WHERE x.owner_id = c.owner_id AND x.contact = c.contact AND x.topic = c.topic) AS span FROM cases c),
    s AS (SELECT *, CASE WHEN mentions = 0 THEN 'none' WHEN denials > 0 THEN 'conflicting'
            WHEN mentions = 1 AND longest < 50 THEN 'weak' ELSE 'confirmed' END AS status,
            mentions > 1 AND span > 604800 AS spread FROM n)"""


@query("agg_34_disclosure", f"""{ROLLUP}
    SELECT owner_id, contact, topic, status, mentions, denials, acks, hints, acks > 0 AS acknowledged, spread,
        round(greatest(0, least(1, 0.3 + CASE WHEN mentions >= 3 THEN 0.25 WHEN mentions = 2 THEN 0.15
            WHEN mentions = 1 THEN 0.05 ELSE 0 END + CASE WHEN acks > 0 THEN 0.2 ELSE 0 END
            + CASE WHEN spread THEN 0.1 ELSE 0 END - 0.15 * denials))::DOUBLE, 6) AS confidence,
        CASE WHEN mentions > 0 THEN 'outgoing' ELSE 'incoming' END AS direction, coalesce(last, '') AS last_mentioned,
        CASE status WHEN 'none' THEN 'No evidence found that you told ' || contact || ' about ' || topic || '.'
            WHEN 'conflicting' THEN 'You mentioned ' || topic || ' to ' || contact || ', but there are conflicting statements.'
            WHEN 'weak' THEN 'There is weak evidence you mentioned ' || topic || ' to ' || contact || '.'
            ELSE 'There is clear evidence you told ' || contact || ' about ' || topic || '.' END
        || CASE WHEN acks > 0 THEN ' ' || contact || ' later referenced it, suggesting they were aware.' ELSE '' END AS answer
    FROM s""")
def _(t):
    return disclosure.disclosure(people(t), cases(t), summaries(t)).withColumn(
        "confidence", F.round("confidence", 6))


@query("fn_38_disclosure_notes", f"""{ROLLUP}, made AS (
        SELECT owner_id, contact, topic, 1 AS "order", CASE status WHEN 'none' THEN 'No matching messages found'
            WHEN 'conflicting' THEN denials || ' contradiction(s) found' WHEN 'weak' THEN 'Only one brief mention found'
            ELSE CASE WHEN mentions > 1 THEN mentions || ' mention(s) found' END END AS note FROM s
        UNION ALL SELECT owner_id, contact, topic, 2, 'Contact acknowledged the topic' FROM s WHERE acks > 0
        UNION ALL SELECT owner_id, contact, topic, 3, 'Mentions spread across multiple weeks' FROM s WHERE spread
        UNION ALL SELECT owner_id, contact, topic, 0, 'Indirect mention on ' || at_date || ': "' || evidence || '"'
            FROM delta WHERE status = 'hinted')
    SELECT * FROM made WHERE note IS NOT NULL""")
def _(t):
    rows = stored(disclosure.statements(people(t), cases(t), summaries(t)), "statements")
    return disclosure.notes(disclosure.rollup(rows, cases(t)), rows).withColumn("order", F.col("order").cast("long"))


@query("ctx_06_evidence_lines", f"""WITH {BASE}
    SELECT owner_id, contact, topic, 'evidence' AS kind, md5('[' || stamp || '] ' || text) AS line FROM ev
    UNION ALL SELECT owner_id, contact, topic, 'contradiction', md5('[' || stamp || '] ' || text) FROM denial
    UNION ALL SELECT owner_id, contact, topic, 'acknowledgment', md5('[' || stamp || '] ' || text) FROM ack""")
def _(t):
    return disclosure.evidence_lines(people(t), cases(t), summaries(t)).select(
        *disclosure.CASE, "kind", F.md5("line").alias("line"))


@query("flt_18_mentions_any_term", """
    SELECT event_id, contains(lower(text), 'tion') OR contains(lower(text), 'über') OR contains(lower(text), 'que') AS mentions
    FROM v_msg""")
def _(t):
    from keepsake.functions.text import has_any
    return t.messages().select("event_id", has_any(
        F.lower("text"), ["tion", "über", "que"]).alias("mentions"))
