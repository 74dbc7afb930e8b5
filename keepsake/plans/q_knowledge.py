"""Entities made from the texts: three neighbouring words, at a place that moves over the texts, name one."""

from pyspark.sql import functions as F

from keepsake.functions.text import tokens
from keepsake.operators import knowledge
from keepsake.plans.q_retrieval import ASKED, asked
from keepsake.plans.registry import query

KINDS = ["person", "place", "event", "work", "pet"]
NOW = "2024-01-20 00:00:00"
# Odd texts arrive, even ones are stored. Both sets cover the whole table.
MENTIONS = rf"""mention AS (
        SELECT event_id AS seq, owner_id, ([{", ".join(repr(k) for k in KINDS)}])[length(w[1]) % 5 + 1] AS type,
            upper(w[1]) AS canonical_name, [w[2], w[3] || ' '] AS aliases, lang, channel,
            source, strftime(created_at, '%Y-%m-%d') AS date, text AS context, contact AS contact_name,
            created_at
        FROM (SELECT * REPLACE (w[1 + 7 * event_id % (len(w) - 2):3 + 7 * event_id % (len(w) - 2)] AS w)
              FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM v_msg) WHERE len(w) >= 3)),
    old AS (SELECT * FROM mention WHERE seq % 2 = 0), incoming AS (SELECT * FROM mention WHERE seq % 2 = 1),
    stored AS (SELECT owner_id, 'ent_' || md5(owner_id || '|' || lower(canonical_name)) AS entity_id,
            arg_min(type, seq) AS type, arg_min(canonical_name, seq) AS canonical_name, count(*) AS mention_count,
            CASE WHEN count(*) = 1 THEN 0.5 ELSE least(0.95, 0.5 + 0.1 * count(*)) END AS confidence,
            max(created_at) AS last_mentioned FROM old GROUP BY 1, 2),
    stored_alias AS (SELECT DISTINCT owner_id, 'ent_' || md5(owner_id || '|' || lower(canonical_name)) AS entity_id,
            unnest(aliases) AS alias FROM old),
    idx AS (SELECT owner_id, alias, entity_id FROM (
            SELECT owner_id, entity_id, lower(canonical_name) AS alias, 0 AS kind FROM stored UNION ALL
            SELECT owner_id, entity_id, lower(trim(alias)), 1 FROM stored_alias WHERE length(trim(alias)) >= 2)
        QUALIFY row_number() OVER (PARTITION BY owner_id, alias ORDER BY kind, entity_id DESC) = 1)"""


def mentions(t):
    w = F.col("w")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    rows = t.messages().withColumn("w", tokens("text")).filter(F.size("w") >= 3).withColumn(
        "w", F.slice("w", (F.col("seq") * 7 % (F.size("w") - 2) + 1).cast("int"), 3))
    return rows.select(
        "seq", "owner_id", F.element_at(kinds, F.length(w[0]) % 5 + 1).alias("type"),
        F.upper(w[0]).alias("canonical_name"),
        F.array_distinct(F.array(w[1], F.concat(w[2], F.lit(" ")))).alias("aliases"),
        F.create_map(F.lit("relationship"), F.col("lang"), F.lit("role"), F.col("channel"))
        .alias("attributes"), F.lit(None).cast("string").alias("status"),
        "source", F.date_format("created_at", "yyyy-MM-dd").alias("date"),
        F.col("text").alias("context"), F.col("contact").alias("contact_name"),
        "created_at")


def stored(t):
    old = mentions(t).filter(F.col("seq") % 2 == 0).withColumn(
        "entity_id", knowledge.new_id(F.col("owner_id"), F.col("canonical_name")))
    n = F.count(F.lit(1))
    entities = old.groupBy("owner_id", "entity_id").agg(
        F.min_by("type", "seq").alias("type"), F.min_by("canonical_name", "seq").alias("canonical_name"),
        n.alias("mention_count"), F.when(n == 1, 0.5).otherwise(
            F.least(F.lit(0.95), F.lit(0.5) + n * 0.1)).alias("confidence"),
        F.max("created_at").alias("last_mentioned")).withColumn(
        "status", F.lit("active")).withColumn("first_mentioned", F.col("last_mentioned")).withColumn(
        "last_updated", F.col("last_mentioned"))
    none = old.limit(0)
    aliases = knowledge.merge_aliases(
        none.select("owner_id", "entity_id", F.lit("").alias("alias")), old)
    return entities, aliases, old


def resolved(t):
    entities, aliases, _ = stored(t)
    incoming = mentions(t).filter(F.col("seq") % 2 == 1)
    return knowledge.resolve(incoming, knowledge.alias_index(entities, aliases))


@query("jn_03_alias_lookup", f"""WITH {MENTIONS}, probe AS (
        SELECT owner_id, seq, 0 AS position, lower(canonical_name) AS alias FROM incoming UNION ALL
        SELECT owner_id, seq, i, lower(trim(aliases[i])) FROM incoming, generate_series(1, len(aliases)) g(i)
        WHERE length(trim(aliases[i])) >= 2)
    SELECT owner_id, seq, entity_id FROM probe JOIN idx USING (owner_id, alias)
    QUALIFY row_number() OVER (PARTITION BY owner_id, seq ORDER BY position) = 1""")
def _(t):
    return resolved(t).filter("NOT is_new").select("owner_id", "seq", "entity_id")


# New names that the first mentions join by aliases are one, over any number of steps.
RESOLVED = f"""{MENTIONS}, probe AS (
        SELECT owner_id, seq, 0 AS position, lower(canonical_name) AS alias FROM incoming UNION ALL
        SELECT owner_id, seq, i, lower(trim(aliases[i])) FROM incoming, generate_series(1, len(aliases)) g(i)
        WHERE length(trim(aliases[i])) >= 2),
    known AS (SELECT owner_id, seq, entity_id FROM probe JOIN idx USING (owner_id, alias)
        QUALIFY row_number() OVER (PARTITION BY owner_id, seq ORDER BY position) = 1),
    fresh AS (SELECT * FROM incoming i WHERE NOT EXISTS (
        SELECT 1 FROM known k WHERE k.owner_id = i.owner_id AND k.seq = i.seq)),
    heads AS (SELECT owner_id, lower(canonical_name) AS name, min(seq) AS first_seq FROM fresh GROUP BY ALL),
    link AS (SELECT h.owner_id, h.name, g.name AS other FROM heads h
        JOIN probe p ON p.owner_id = h.owner_id AND p.seq = h.first_seq AND p.position > 0
        JOIN heads g ON g.owner_id = h.owner_id AND g.name = p.alias AND g.name <> h.name
        QUALIFY row_number() OVER (PARTITION BY h.owner_id, h.name ORDER BY position) = 1),
    edge AS (SELECT owner_id, name, other FROM link UNION SELECT owner_id, other, name FROM link),
    reached AS (SELECT owner_id, name, name AS other FROM heads UNION
        SELECT r.owner_id, r.name, e.other FROM reached r JOIN edge e ON e.owner_id = r.owner_id AND e.name = r.other),
    target AS (SELECT r.owner_id, r.name, r.other AS head FROM reached r
        JOIN heads g ON g.owner_id = r.owner_id AND g.name = r.other
        QUALIFY row_number() OVER (PARTITION BY r.owner_id, r.name ORDER BY first_seq, other) = 1),
    resolved AS (SELECT i.*, coalesce(k.entity_id, 'ent_' || md5(i.owner_id || '|'
            || coalesce(head, lower(canonical_name)))) AS entity_id
        FROM incoming i LEFT JOIN known k ON k.owner_id = i.owner_id AND k.seq = i.seq
        LEFT JOIN target t ON t.owner_id = i.owner_id AND t.name = lower(canonical_name))"""


@query("agg_33_entity_merge", f"""WITH RECURSIVE {RESOLVED}, heard AS (
        SELECT owner_id, entity_id, count(*) AS heard, arg_min(type, seq) AS type, arg_min(canonical_name, seq) AS name
        FROM resolved GROUP BY ALL)
    SELECT owner_id, entity_id, coalesce(s.type, h.type) AS type, coalesce(canonical_name, name) AS canonical_name,
        coalesce(mention_count, 0) + coalesce(heard, 0) AS mention_count,
        round(CASE WHEN heard IS NULL THEN confidence WHEN mention_count IS NULL AND heard = 1 THEN 0.5
            ELSE least(0.95, 0.5 + 0.1 * (coalesce(mention_count, 0) + heard)) END::DOUBLE, 6) AS confidence
    FROM stored s FULL JOIN heard h USING (owner_id, entity_id)""")
def _(t):
    return merged(t).select("owner_id", "entity_id", "type", "canonical_name", "mention_count",
                            F.round("confidence", 6).alias("confidence"))


def merged(t):
    return knowledge.merge_entities(stored(t)[0], resolved(t), F.lit(NOW).cast("timestamp"))


@query("set_05_merged_aliases", f"""WITH RECURSIVE {RESOLVED}
    SELECT owner_id, entity_id, alias FROM stored_alias UNION
    SELECT owner_id, entity_id, unnest(aliases) FROM resolved""")
def _(t):
    return knowledge.merge_aliases(stored(t)[1], resolved(t))


def old_attributes(t):
    return stored(t)[2].select("owner_id", "entity_id", F.explode("attributes").alias("key", "value"),
                               "seq").groupBy("owner_id", "entity_id", "key").agg(
        F.max_by("value", "seq").alias("value"))


@query("agg_33_merged_attributes", f"""WITH RECURSIVE {RESOLVED}, rows AS (
        SELECT owner_id, 'ent_' || md5(owner_id || '|' || lower(canonical_name)) AS entity_id, seq - 1000000000 AS seq, lang, channel FROM old
        UNION ALL SELECT owner_id, entity_id, seq, lang, channel FROM resolved)
    SELECT owner_id, entity_id, 'relationship' AS key, arg_max(lang, seq) AS value FROM rows GROUP BY ALL
    UNION ALL SELECT owner_id, entity_id, 'role', arg_max(channel, seq) FROM rows GROUP BY ALL""")
def _(t):
    return knowledge.merge_attributes(old_attributes(t), resolved(t))


@query("agg_33_merged_sources", f"""WITH RECURSIVE {RESOLVED}, rows AS (
        SELECT owner_id, 'ent_' || md5(owner_id || '|' || lower(canonical_name)) AS entity_id, -1 AS seq, source, date, context, contact_name FROM old
        UNION ALL SELECT owner_id, entity_id, seq, source, date, context, contact_name FROM resolved)
    SELECT owner_id, entity_id, source, date, context, contact_name FROM rows
    QUALIFY row_number() OVER (PARTITION BY owner_id, entity_id, source, date, context ORDER BY seq, contact_name) = 1""")
def _(t):
    return knowledge.merge_sources(stored(t)[2], resolved(t))


@query("agg_32_entities_by_type", f"""WITH {MENTIONS}
    SELECT owner_id, type, count(*) AS entities FROM stored GROUP BY ALL""")
def _(t):
    return knowledge.count_by_type(stored(t)[0])


@query("jn_12_entities_of_contact", f"""WITH RECURSIVE {RESOLVED}
    SELECT DISTINCT owner_id, entity_id, contact_name AS contact FROM resolved""")
def _(t):
    return knowledge.of_contact(resolved(t))


@query("jn_13_entity_links", f"""WITH RECURSIVE {RESOLVED}, pairs AS (
        SELECT owner_id, entity_id AS a, 'ent_' || md5(owner_id || '|' || lower(aliases[1])) AS b FROM resolved)
    SELECT owner_id, a AS src_id, b AS dst_id FROM pairs UNION SELECT owner_id, b, a FROM pairs""")
def _(t):
    pairs = resolved(t).select(
        "owner_id", F.col("entity_id").alias("src_id"),
        knowledge.new_id(F.col("owner_id"), F.col("aliases")[0]).alias("dst_id"))
    return knowledge.link_entities(pairs.limit(0), pairs)


@query("inc_06_delete_entities", f"""WITH {MENTIONS}
    SELECT owner_id, entity_id, 'entity' AS part FROM stored WHERE type <> 'pet' UNION ALL
    SELECT a.owner_id, a.entity_id, 'alias' FROM stored_alias a JOIN stored s USING (owner_id, entity_id)
    WHERE s.type <> 'pet'""")
def _(t):
    entities, aliases, _ = stored(t)
    left = knowledge.delete_entities(
        {"entity": entities, "alias": aliases}, entities.filter("type = 'pet'"))
    cols = ["owner_id", "entity_id"]
    return left["entity"].select(*cols, F.lit("entity").alias("part")).unionByName(
        left["alias"].select(*cols, F.lit("alias").alias("part")))


@query("flt_16_active_entities", f"""WITH {MENTIONS}
    SELECT owner_id, entity_id FROM stored WHERE confidence >= 0.5""")
def _(t):
    return stored(t)[0].filter((F.col("status") == "active") & (F.col("confidence") >= 0.5)).select(
        "owner_id", "entity_id")


RELEVANT = f"""b AS (SELECT *, CASE WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_mentioned) < 30 * 86400000000 THEN 2 ELSE 0 END
            + confidence::DOUBLE * 2 + least(mention_count, 5) AS base FROM stored WHERE confidence >= 0.5),
    who AS (SELECT question_id, owner_id, lower(topic) AS topic, 'user_' || (question_id % 150) AS contact FROM asked),
    src AS (SELECT DISTINCT owner_id, 'ent_' || md5(owner_id || '|' || lower(canonical_name)) AS entity_id, contact_name FROM old),
    s AS (SELECT q.owner_id, question_id, b.entity_id, b.type, canonical_name, base
            + CASE WHEN contains(topic, lower(canonical_name)) THEN 10 ELSE 0 END
            + CASE WHEN EXISTS (SELECT 1 FROM stored_alias a WHERE a.owner_id = b.owner_id AND a.entity_id = b.entity_id
                   AND contains(topic, lower(alias))) THEN 5 ELSE 0 END
            + CASE WHEN EXISTS (SELECT 1 FROM src WHERE src.owner_id = b.owner_id AND src.entity_id = b.entity_id
                   AND contact_name = q.contact) THEN 3 ELSE 0 END AS score
          FROM who q JOIN b ON b.owner_id = q.owner_id),
    best AS (SELECT *, row_number() OVER (PARTITION BY owner_id, question_id ORDER BY round(score, 6) DESC, entity_id) AS rank FROM s
        QUALIFY row_number() OVER (PARTITION BY owner_id, question_id ORDER BY round(score, 6) DESC, entity_id) <= 15)"""


def best(t):
    entities, aliases, old = stored(t)
    who = asked(t).select("owner_id", "question_id", "topic", F.concat(
        F.lit("user_"), (F.col("question_id") % 150).cast("string")).alias("contact"))
    return knowledge.relevant(entities, aliases, old, who, F.lit(NOW).cast("timestamp"))


@query("top_14_relevant_entities", f"""WITH {MENTIONS}, {ASKED}, {RELEVANT}
    SELECT owner_id, question_id, entity_id, rank, round(score, 6) AS score FROM best""")
def _(t):
    return best(t).select("owner_id", "question_id", "entity_id", "rank",
                          F.round("score", 6).alias("score"))


@query("ctx_03_entity_facts", f"""WITH {MENTIONS}, {ASKED}, {RELEVANT},
    attr AS (SELECT owner_id, 'ent_' || md5(owner_id || '|' || lower(canonical_name)) AS entity_id,
        arg_max(lang, seq) AS relationship, arg_max(channel, seq) AS role FROM old GROUP BY ALL),
    shown AS (SELECT b.*, CASE type WHEN 'person' THEN canonical_name || ' (' || relationship || ')'
            WHEN 'work' THEN canonical_name || ' as ' || role ELSE canonical_name END AS item,
        CASE type WHEN 'person' THEN 'People' WHEN 'place' THEN 'Places' WHEN 'event' THEN 'Events'
            WHEN 'work' THEN 'Work' ELSE 'Pets' END AS heading FROM best b JOIN attr USING (owner_id, entity_id))
    SELECT owner_id, question_id, '- ' || heading || ': ' || string_agg(item, ', ' ORDER BY rank) AS line
    FROM shown GROUP BY owner_id, question_id, heading""")
def _(t):
    return knowledge.facts(best(t), old_attributes(t)).drop("line_no")
