"""People, their style, topics and message classes."""

from pyspark.sql import functions as F

from keepsake.functions.lexicons import (
    BUSINESS_WORDS, CHAT_SLANG, CLASS_TONE, CLASS_WORDS, COMPANY_WORDS, SPAM_PATTERNS,
    TOPIC_STOP_WORDS,
)
from keepsake.operators import clusters, contacts
from keepsake.plans import tables
from keepsake.plans.q_corpus import STOP, TRIM, quoted
from keepsake.plans.registry import query

# The language of the messages stands for the person, so that a person has enough of them.
PEOPLE = """(SELECT owner_id, lang AS contact, text, is_user_message, created_at, seq,
    CASE WHEN is_user_message THEN 'Me' ELSE upper(lang) END AS sender_name FROM v_msg)"""
ISO = "strftime(created_at, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(created_at) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z'"
EMOJI_SQL = r"[\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}©®™]"
PERSON = "owner_id, contact"


def people(t):
    return t.messages().withColumn("contact", F.col("lang")).withColumn(
        "sender_name", F.when(F.col("is_user_message"), "Me").otherwise(F.upper("lang")))


def mean(what, side):
    return f"avg({what}) FILTER ({side})"


MINE, THEIRS = "is_user_message", "NOT is_user_message"
PROFILE = rf"""WITH c AS (SELECT *, len(regexp_extract_all(text, '{EMOJI_SQL}')) AS emoji,
        len(regexp_extract_all(text, '(?i)\b(?:{"|".join(CHAT_SLANG)})\b')) AS slang,
        len(regexp_extract_all(text, '\?')) AS asks, len(regexp_extract_all(text, '!')) AS shouts,
        {ISO} AS stamp FROM {PEOPLE}),
    g AS (SELECT {PERSON}, count(*) AS messages, count(*) FILTER ({MINE}) AS user_messages,
        count(*) FILTER ({THEIRS}) AS contact_messages, min(stamp) AS first_date, max(stamp) AS last_date,
        coalesce(arg_min(sender_name, seq) FILTER ({THEIRS}), 'Unknown') AS contact_name,
        {mean('length(text)', MINE)} AS user_avg_length, {mean('emoji', MINE)} AS user_emoji_rate,
        {mean('slang', MINE)} AS user_slang_rate, {mean('asks', MINE)} AS user_question_rate,
        {mean('shouts', MINE)} AS user_exclamation_rate, {mean('length(text)', THEIRS)} AS contact_avg_length,
        {mean('emoji', THEIRS)} AS contact_emoji_rate, {mean('slang', THEIRS)} AS contact_slang_rate
        FROM c GROUP BY {PERSON}),
    i AS (SELECT *, greatest(0, least(1, (2 * user_emoji_rate + 2 * user_slang_rate
            + user_exclamation_rate) / 5)) AS intimacy FROM g
          WHERE messages >= 3 AND user_messages >= 2 AND contact_messages >= 2)
    SELECT {PERSON}, contact_name, messages, user_messages, contact_messages, first_date, last_date,
        round(intimacy, 6) AS intimacy, round(user_avg_length, 6) AS user_avg_length,
        round(user_emoji_rate, 6) AS user_emoji_rate, round(user_slang_rate, 6) AS user_slang_rate,
        round(user_question_rate, 6) AS user_question_rate,
        round(user_exclamation_rate, 6) AS user_exclamation_rate,
        round(contact_avg_length, 6) AS contact_avg_length,
        round(contact_emoji_rate, 6) AS contact_emoji_rate, round(contact_slang_rate, 6) AS contact_slang_rate,
        CASE WHEN intimacy > 0.6 AND user_slang_rate > 0.3 THEN 'close_friend'
             WHEN intimacy > 0.4 OR user_slang_rate > 0.2 THEN 'friend'
             WHEN user_avg_length > 100 AND user_question_rate > 0.5 THEN 'professional'
             WHEN intimacy > 0.3 THEN 'acquaintance' ELSE 'unknown' END AS relation FROM i"""


@query("agg_23_contact_profiles", PROFILE)
def _(t):
    out = contacts.contact_profiles(people(t))
    for name, kind in out.dtypes:
        if kind == "double":
            out = out.withColumn(name, F.round(name, 6))
    return out


@query("agg_23_sample_messages", f"""
    SELECT {PERSON}, is_user_message, seq, text,
        row_number() OVER (PARTITION BY {PERSON}, is_user_message ORDER BY seq) AS rank
    FROM {PEOPLE} WHERE length(text) > 10 AND length(text) < 200
    QUALIFY row_number() OVER (PARTITION BY {PERSON}, is_user_message ORDER BY seq) <= 10""")
def _(t):
    return contacts.sample_messages(people(t))


@query("jn_02_shared_phrases", f"""WITH w AS (
        SELECT {PERSON}, is_user_message, seq, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM {PEOPLE}),
    z AS (SELECT {PERSON}, is_user_message, seq, unnest(w) AS a, unnest(w[2:]) AS b,
                 unnest(range(len(w))) AS i FROM w),
    p AS (SELECT {PERSON}, is_user_message, seq, i, a || ' ' || b AS phrase
          FROM z WHERE b IS NOT NULL AND a NOT IN ({STOP})),
    c AS (SELECT {PERSON}, phrase, count(*) FILTER ({MINE}) AS user_count,
                 count(*) FILTER ({THEIRS}) AS contact_count,
                 min(seq * 1048576 + i) FILTER ({MINE}) AS first_use FROM p GROUP BY {PERSON}, phrase)
    SELECT {PERSON}, phrase, user_count, contact_count,
        row_number() OVER (PARTITION BY {PERSON} ORDER BY first_use, phrase) AS rank FROM c
    WHERE user_count >= 2 AND contact_count >= 1
    QUALIFY row_number() OVER (PARTITION BY {PERSON} ORDER BY first_use, phrase) <= 20""")
def _(t):
    return contacts.shared_phrases(people(t))


@query("flt_09_conversation_threads", f"""
    SELECT event_id FROM v_msg JOIN (
        SELECT owner_id, contact FROM v_msg GROUP BY ALL HAVING count(*) >= 3
        AND count(*) FILTER ({MINE}) >= 2 AND count(*) FILTER ({THEIRS}) >= 2) USING (owner_id, contact)""")
def _(t):
    return contacts.conversation_threads(t.messages(), contacts.PERSON).select("event_id")


@query("flt_17_significant_contacts", f"""
    SELECT {PERSON}, count(*) AS messages, count(*) FILTER ({MINE}) AS user_messages FROM v_evt
    GROUP BY {PERSON} HAVING count(*) >= 10 AND count(*) FILTER ({MINE}) >= 5""")
def _(t):
    return contacts.significant_contacts(t.dense())


# Event numbers pick a stock text, sender and phone, so every rule meets the whole table.
NOTES = [
    "code: 4521", "Your OTP", "see you soon", "verification code 9", "your order came", "12345",
    "it was shipped", "good night", "tracking # 3", "fraud alert now", "balance is low", "hello",
    "order #", "precoded", "package  arriving", "unshipped goods",
]
SENDERS = ["Ana", "", "Unknown", " ", "Lin"]
PHONES = ["+1 555 010 0199", "12345", "+123456", "1-54321", None]


def pick(values, n):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]),
                        (F.col("event_id") % n + 1).cast("int"))


def picked(values):
    return "([" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"])[event_id % {len(values)} + 1]"


@query("flt_07_spam_messages", rf"""WITH m AS (
        SELECT event_id, {picked(NOTES)} || ' ' || event_type AS text, {picked(SENDERS)} AS sender,
               {picked(PHONES)} AS phone, event_id % 3 + 1 AS thread_size FROM events)
    SELECT event_id, (trim(sender) = '' OR coalesce(regexp_matches(regexp_replace(phone, '[^0-9]', '', 'g'),
        '^\+?1?(\d{{5,6}})$'), false) OR (thread_size = 1 AND sender = 'Unknown')
        OR regexp_matches(lower(text), '{"|".join(SPAM_PATTERNS)}')
        OR (length(text) < 20 AND regexp_matches(trim(text), '^\d+$'))) AS spam FROM m""")
def _(t):
    m = t.raw("events").select(
        "event_id", F.concat_ws(" ", pick(NOTES, len(NOTES)), "event_type").alias("text"),
        pick(SENDERS, 5).alias("sender"), pick(PHONES, 5).alias("phone"),
        (F.col("event_id") % 3 + 1).alias("thread_size"))
    return m.select("event_id", contacts.is_spam(
        F.col("text"), F.col("sender"), F.col("phone"), F.col("thread_size")).alias("spam"))


NAMES = ["Chase Bank", "Ana", "ACME", "Beta llc", "Wellness Point", "Bob", "UPS", "Banksia", "ONE",
         "Listed Friend", "Service desk", ""]


@query("flt_08_business_contacts", rf"""WITH m AS (
        SELECT event_id, {picked(NAMES)} || CASE WHEN event_id % 5 = 0 THEN ' ' || event_type ELSE '' END AS name
        FROM events)
    SELECT event_id, name <> '' AND (name = 'Listed Friend'
        OR regexp_matches(lower(name), '\b(?:{"|".join(BUSINESS_WORDS)})\b')
        OR (name = upper(name) AND length(name) > 3)
        OR regexp_matches(name, '(?i)\b(?:{COMPANY_WORDS})\b')) AS business FROM m""")
def _(t):
    name = F.concat(pick(NAMES, len(NAMES)), F.when(
        F.col("event_id") % 5 == 0, F.concat(F.lit(" "), "event_type")).otherwise(""))
    return t.raw("events").select(
        "event_id", contacts.is_business(name, ["Listed Friend"]).alias("business"))


TARGETS = "(SELECT DISTINCT owner_id, 'User ' || (CAST(regexp_extract(contact, '\\d+') AS INT) % 20) AS target FROM v_evt)"
NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
MATCHED = rf"""m AS (
        SELECT n.owner_id, name, target FROM (
            SELECT DISTINCT owner_id, contact AS name FROM v_evt UNION SELECT owner_id, 'Me' FROM v_evt) n
        JOIN {TARGETS} t ON n.owner_id = t.owner_id AND {NORM.format('name')} <> '' AND (
            contains({NORM.format('name')}, {NORM.format('target')})
            OR contains({NORM.format('target')}, {NORM.format('name')})))"""


def targets(t):
    n = F.regexp_extract("contact", r"\d+", 0).cast("int") % 20
    return t.dense().select(
        "owner_id", F.concat(F.lit("User "), n.cast("string")).alias("target")).distinct()


@query("jn_01_participant_names", f"WITH {MATCHED} SELECT * FROM m")
def _(t):
    return contacts.match_names(t.dense(), targets(t))


@query("top_17_recent_with_contact", f"""WITH {MATCHED}
    SELECT e.owner_id, target, e.event_id, row_number() OVER (
        PARTITION BY e.owner_id, target ORDER BY created_at DESC, seq DESC) AS rank
    FROM v_evt e JOIN m ON m.owner_id = e.owner_id AND m.name = e.contact
    QUALIFY row_number() OVER (PARTITION BY e.owner_id, target ORDER BY created_at DESC, seq DESC) <= 50""")
def _(t):
    return contacts.recent_with(t.dense(), targets(t)).select(
        "owner_id", "target", "event_id", "rank")


TOPICS = f"""topics AS (
        SELECT {PERSON}, topic, count(*) AS count, max(created_at) AS last_mentioned,
            row_number() OVER (PARTITION BY {PERSON} ORDER BY count(*) DESC, topic) AS rank
        FROM (SELECT {PERSON}, created_at, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS topic
              FROM {PEOPLE})
        WHERE length(topic) >= 4 AND topic NOT IN ({quoted(TOPIC_STOP_WORDS)})
        GROUP BY {PERSON}, topic
        QUALIFY row_number() OVER (PARTITION BY {PERSON} ORDER BY count(*) DESC, topic) <= 25)"""


@query("agg_26_contact_topics", f"""WITH {TOPICS}
    SELECT {PERSON}, topic, count, rank, strftime(last_mentioned, '%Y-%m-%d %H:%M:%S') AS last_mentioned
    FROM topics""")
def _(t):
    return contacts.contact_topics(people(t)).withColumn(
        "last_mentioned", F.date_format("last_mentioned", "yyyy-MM-dd HH:mm:ss"))


@query("jn_06_topic_quotes", rf"""WITH {TOPICS}, said AS (
        SELECT {PERSON}, created_at, seq, is_user_message, trim(regexp_replace(text, '\s+', ' ', 'g')) AS said
        FROM {PEOPLE})
    SELECT owner_id, contact, topic, row_number() OVER (
            PARTITION BY owner_id, contact, topic ORDER BY created_at DESC, seq DESC) AS rank,
        '[' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '] '
        || CASE WHEN is_user_message THEN 'Me' ELSE 'Them' END || ': ' || substr(said, 1, 160) AS quote
    FROM said JOIN topics USING (owner_id, contact) WHERE contains(lower(said), topic)
    QUALIFY row_number() OVER (PARTITION BY owner_id, contact, topic ORDER BY created_at DESC, seq DESC) <= 2""")
def _(t):
    return contacts.topic_quotes(contacts.contact_topics(people(t)), people(t)).select(
        "owner_id", "contact", "topic", "rank", "quote")


@query("win_07_month_evidence", f"""WITH r AS (
        SELECT *, strftime(created_at, '%Y-%m') AS month, row_number() OVER up AS up, row_number() OVER down AS down,
            row_number() OVER size AS size FROM v_evt WINDOW
            up AS (PARTITION BY {PERSON}, strftime(created_at, '%Y-%m') ORDER BY created_at, seq),
            down AS (PARTITION BY {PERSON}, strftime(created_at, '%Y-%m') ORDER BY created_at DESC, seq DESC),
            size AS (PARTITION BY {PERSON}, strftime(created_at, '%Y-%m') ORDER BY length(text) DESC, created_at, seq)),
    picked AS (SELECT *, up AS picked FROM r WHERE up <= 5 UNION ALL SELECT *, 11 - down FROM r WHERE down <= 5
               UNION ALL SELECT *, 10 + size FROM r WHERE size <= 10)
    SELECT {PERSON}, month, event_id, picked FROM picked
    QUALIFY row_number() OVER (PARTITION BY {PERSON}, month, {ISO}, text ORDER BY picked) = 1""")
def _(t):
    return contacts.month_evidence(t.dense()).select(
        "owner_id", "contact", "month", "event_id", F.col("picked").cast("long").alias("picked"))


CACHE = f"""prints AS (SELECT {PERSON}, count(*) || ':' || min({ISO}) || ':' || max({ISO}) AS fingerprint
                       FROM v_evt GROUP BY {PERSON}),
    months AS (SELECT {PERSON}, strftime(created_at, '%Y-%m') AS month, count(*) AS message_count
               FROM v_evt GROUP BY ALL),
    cache AS (SELECT owner_id, contact, month,
                     CASE WHEN length(contact) = 6 THEN 'changed' ELSE fingerprint END AS fingerprint
              FROM months JOIN prints USING (owner_id, contact) WHERE message_count % 2 = 0),
    missing AS (SELECT m.* FROM months m WHERE NOT EXISTS (
        SELECT 1 FROM cache c JOIN prints p USING (owner_id, contact, fingerprint)
        WHERE c.owner_id = m.owner_id AND c.contact = m.contact AND c.month = m.month))"""


def cache(t):
    months = tables.month_counts(t.dense()).filter(F.col("message_count") % 2 == 0)
    return months.join(tables.fingerprints(t.dense()), contacts.PERSON).withColumn(
        "fingerprint", F.when(F.length("contact") == 6, "changed").otherwise(F.col("fingerprint")))


@query("inc_04_missing_months", f"WITH {CACHE} SELECT * FROM missing")
def _(t):
    return tables.missing_months(t.dense(), cache(t))


@query("inc_05_month_priority", f"""WITH {CACHE}, b AS (
        SELECT {PERSON}, min(month) AS lo, max(month) AS hi FROM months GROUP BY {PERSON})
    SELECT {PERSON}, month, message_count, row_number() OVER (PARTITION BY {PERSON} ORDER BY
        CASE WHEN month = lo THEN 0 WHEN month = hi THEN 1 ELSE 2 END, message_count DESC, month) AS rank
    FROM missing JOIN b USING (owner_id, contact)
    QUALIFY row_number() OVER (PARTITION BY {PERSON} ORDER BY
        CASE WHEN month = lo THEN 0 WHEN month = hi THEN 1 ELSE 2 END, message_count DESC, month) <= 6""")
def _(t):
    months = tables.month_counts(t.dense())
    return tables.month_priority(months, tables.missing_months(t.dense(), cache(t)))


@query("ctx_08_month_coverage", f"""WITH {CACHE}
    SELECT {PERSON}, 'Coverage: ' || (count(*) - count(x.month)) || '/' || count(*) || ' months summarized' AS line
    FROM months m LEFT JOIN missing x USING (owner_id, contact, month) GROUP BY {PERSON}""")
def _(t):
    from keepsake.operators import context
    months = tables.month_counts(t.dense())
    return context.month_coverage(months, tables.missing_months(t.dense(), cache(t)))


@query("win_11_last_messages", f"""
    SELECT {PERSON}, event_id, row_number() OVER (
        PARTITION BY {PERSON} ORDER BY created_at DESC, seq DESC) AS rank FROM v_evt
    QUALIFY row_number() OVER (PARTITION BY {PERSON} ORDER BY created_at DESC, seq DESC) <= 50""")
def _(t):
    return contacts.last_messages(t.dense(), 50).select("owner_id", "contact", "event_id", "rank")


@query("ctx_09_conversation_texts", f"""WITH r AS (
        SELECT *, row_number() OVER (PARTITION BY {PERSON} ORDER BY created_at DESC, seq DESC) AS rank,
            count(*) OVER (PARTITION BY {PERSON}) AS n FROM v_evt)
    SELECT {PERSON}, string_agg('[' || {ISO} || '] ' || CASE WHEN is_user_message THEN 'Me' ELSE contact END
        || ': ' || text, chr(10) ORDER BY rank DESC) AS conversation
    FROM r WHERE rank <= 30 AND n >= 5 GROUP BY {PERSON} HAVING length(conversation) >= 100""")
def _(t):
    return contacts.conversation_texts(t.dense()).select("owner_id", "contact", "conversation")


def class_sql(low):
    def total(words):
        return " + ".join(f"contains({low}, '{w}')::INT" for w in words)
    clock = rf"2 * regexp_matches({low}, '\d{{1,2}}:\d{{2}}')::INT"
    day = rf"2 * regexp_matches({low}, '\b(?:mon|tue|wed|thu|fri|sat|sun)\b')::INT"
    s = {k: total(v) for k, v in CLASS_WORDS.items()}
    s["planning"] += f" + {clock} + {day}"
    best = f"greatest({', '.join(s.values())})"
    cases = " ".join(f"WHEN {v} = {best} THEN '{k}'" for k, v in s.items())
    return f"CASE WHEN {best} = 0 THEN 'other' {cases} END"


CLASSED = f"""(SELECT owner_id, unnest(['Me', contact]) AS contact, text, {class_sql('lower(text)')} AS cluster
    FROM (SELECT owner_id, channel AS contact, trim(text, {TRIM}) AS text FROM v_msg) WHERE length(text) >= 3)"""


@query("fn_23_message_class", f"""
    SELECT event_id, {class_sql('lower(text)')} AS cluster FROM v_msg""")
def _(t):
    return t.messages().select("event_id", clusters.message_class("text").alias("cluster"))


def classed(t):
    m = t.messages()
    return m.withColumn("participants", F.array(F.lit("Me"), "channel"))


GROUP = "owner_id, contact, cluster"
PHRASES = rf"""phrases AS (
        SELECT {GROUP}, phrase, count(*) AS count,
            row_number() OVER (PARTITION BY {GROUP} ORDER BY count(*) DESC, phrase) AS rank
        FROM (SELECT {GROUP}, w[i] || ' ' || w[i + 1] AS phrase FROM (
                SELECT {GROUP}, [x for x in regexp_split_to_array(lower(text), '\s+') if length(x) > 2] AS w
                FROM {CLASSED}), generate_series(1, len(w) - 1) g(i))
        GROUP BY {GROUP}, phrase HAVING count(*) >= 2
        QUALIFY row_number() OVER (PARTITION BY {GROUP} ORDER BY count(*) DESC, phrase) <= 8)"""


MEMORY = f"""{PHRASES},
    sizes AS (SELECT {GROUP}, count(*) AS message_count, avg(length(text)) AS a FROM {CLASSED} GROUP BY ALL),
    listed AS (SELECT {GROUP}, string_agg(phrase, '|' ORDER BY rank) AS top_phrases,
               string_agg(phrase, '", "' ORDER BY rank) FILTER (rank <= 3) AS few FROM phrases GROUP BY ALL),
    memo AS (SELECT {GROUP}, message_count, round(a, 6) AS avg_length, coalesce(top_phrases, '') AS top_phrases,
        message_count || ' ' || CASE WHEN a < 30 THEN 'short' WHEN a < 80 THEN 'medium' ELSE 'detailed' END
        || ' messages. ' || CASE cluster {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASS_TONE.items())} END
        || '.' || coalesce(' Common: "' || few || '".', '') AS summary
    FROM sizes LEFT JOIN listed USING ({GROUP}))"""


@query("agg_25_cluster_memory", f"WITH {MEMORY} SELECT * FROM memo")
def _(t):
    return clusters.cluster_memory(classed(t)).withColumn(
        "avg_length", F.round("avg_length", 6)).withColumn(
        "top_phrases", F.array_join("top_phrases", "|"))
