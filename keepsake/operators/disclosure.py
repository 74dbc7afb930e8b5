"""Evidence that the owner told a contact about a topic.

Knowledge is not stored, it is rebuilt from messages and from what summaries recorded. Evidence stays
as rows; the roll-up holds counts and bounds only, so a heavily mentioned topic costs no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.lexicons import DISCLOSURE_DENIALS, TOPIC_SYNONYMS
from keepsake.functions.text import clamp01, has_any, hits_of
from keepsake.functions.times import iso
from keepsake.operators.contacts import events_with
from keepsake.operators.ranking import bounded_lists, broadcast_if_small
from keepsake.operators.term_index import stored

# Lists of 500 topics: 200 of them stay within some megabytes.
MAX_LISTS = 200
CASE = ["owner_id", "contact", "topic"]
WEEK_MS = 7 * 24 * 3_600_000


def topic_terms(topic: Column | str) -> Column:
    """A topic's synonym group and its name; an unknown topic stands for itself."""
    c = F.lower(F.col(topic) if isinstance(topic, str) else topic)
    out = F.array(c)
    for name, words in reversed(list(TOPIC_SYNONYMS.items())):
        group = F.array(*[F.lit(w) for w in [*words, name]])
        out = F.when(c.isin(name, *words), group).otherwise(out)
    return out


def _lower(c):
    return F.lower(c)


def case_messages(events: DataFrame, cases: DataFrame) -> DataFrame:
    """Messages with a case's contact that mention its topic. ``cases``: owner, contact, topic."""
    targets = cases.select("owner_id", F.col("contact").alias("target")).distinct()
    sms = events.filter(F.col("source") == "sms").select(
        "owner_id", "seq", "participants", "created_at", "is_user_message",
        F.coalesce("text", F.lit("")).alias("text"))
    with_contact = events_with(sms, targets, _lower).withColumnRenamed("target", "contact")
    listed = bounded_lists(
        cases.select(*CASE).distinct().withColumn("terms", topic_terms("topic")),
        ["owner_id", "contact"], ["topic", "terms"], "topics")
    listed = broadcast_if_small(stored(listed, "topics"), MAX_LISTS)
    low = F.col("low")
    named = F.filter("topics", lambda x: hits_of(low, x["terms"]) > 0)
    return (
        with_contact.drop("participants").withColumn("low", F.lower("text"))
        .join(listed, ["owner_id", "contact"])
        .withColumn("_t", F.explode(named)).withColumn("topic", F.col("_t.topic")).drop("_t", "topics")
        .withColumn("at", iso("created_at"))
    )


def case_deltas(summaries: DataFrame, cases: DataFrame) -> DataFrame:
    """Recorded statements whose topic contains one of the case's terms."""
    deltas = summaries.select(
        "owner_id", F.col("contact_key").alias("contact"), "start_ms", "chunk_id",
        F.posexplode("knowledge_deltas").alias("position", "d"))
    asked = cases.select(*CASE, topic_terms("topic").alias("terms"))
    return (
        deltas.join(asked, ["owner_id", "contact"])
        .filter(hits_of(F.lower("d.topic"), F.col("terms")) > 0)
        .select(*CASE, "start_ms", "chunk_id", "position", F.lower("d.status").alias("status"),
                F.col("d.date").alias("at"), F.col("d.evidence").alias("text"))
    )


def statements(events: DataFrame, cases: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Everything that bears on a case, one row for each kind it counts as, in one pass over messages and summaries.

    ``said``: the owner's messages; ``denial``: those that deny having told, and recorded contradictions; ``ack``: the
    contact's own; ``told``: recorded disclosures; ``hint``: recorded hints. Recorded rows carry their place.
    """
    cases = stored(cases.select(*CASE).distinct(), "cases")
    mine, text = F.col("is_user_message"), F.coalesce("text", F.lit(""))
    messages = case_messages(events, cases).select(*CASE, "at", "text", _kinds(
        said=mine, denial=mine & has_any(F.col("low"), DISCLOSURE_DENIALS), ack=~mine))
    if summaries is None:
        return messages
    status = F.col("status")
    recorded = case_deltas(summaries, cases).select(*CASE, "at", F.struct(
        "start_ms", "chunk_id", "position").alias("place"), "text", _kinds(
            told=(status == "disclosed") & (text != ""), denial=status == "contradicted", hint=status == "hinted"))
    recorded = recorded.withColumn("text", F.when(F.col("kind") == "denial", F.coalesce(
        "text", F.lit("contradicting statement"))).otherwise(F.col("text")))
    return messages.unionByName(recorded, allowMissingColumns=True)


def _kinds(**tests: Column) -> Column:
    """The kinds whose test holds, exploded."""
    named = F.array(*[F.when(test, F.lit(kind)) for kind, test in tests.items()])
    return F.explode(F.filter(named, lambda k: k.isNotNull())).alias("kind")


def _by_text(rows: DataFrame) -> DataFrame:
    """Numbers of each text of a case (other kinds: of none), of recorded disclosures the first one."""
    kind, ms = F.col("kind"), F.unix_millis(F.col("at").try_cast("timestamp"))
    first = F.struct(F.col("place"), F.col("at"), ms.alias("ms"), F.length("text").alias("length"), F.col("text"))
    said = kind == "said"
    return rows.groupBy(*CASE, F.when(kind.isin("said", "told"), F.md5("text")).alias("_key")).agg(
        F.count_if(said).alias("said"), F.max(F.when(said, F.col("at"))).alias("last"),
        F.min(F.when(said, ms)).alias("from_ms"), F.max(F.when(said, ms)).alias("to_ms"),
        F.max(F.when(said, F.length("text"))).alias("longest"),
        F.min(F.when(kind == "told", first)).alias("told"),
        *[F.count_if(kind == k).alias(n) for k, n in (("denial", "denials"), ("ack", "acks"), ("hint", "hints"))])


def evidence(rows: DataFrame) -> DataFrame:
    """Disclosing statements: the owner's messages, and recorded ones with a new text, once each."""
    said = rows.filter("kind = 'said'").select(*CASE, "at", "text")
    if "place" not in rows.columns:
        return said
    new = _by_text(rows.filter("kind IN ('said', 'told')")).filter("said = 0").select(*CASE, "told.at", "told.text")
    return said.unionByName(new)


def contradictions(rows: DataFrame) -> DataFrame:
    """Statements that deny having told, in messages or as recorded."""
    return rows.filter("kind = 'denial'").select(*CASE, "at", "text")


def acknowledgments(rows: DataFrame) -> DataFrame:
    """The contact's own messages about the topic, at any time."""
    return rows.filter("kind = 'ack'").select(*CASE, "at", "text")


def hints(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'hint'").select(*CASE, "at", F.concat(
        F.lit("Indirect mention on "), "at", F.lit(': "'),
        F.coalesce("text", F.lit("undefined")), F.lit('"')).alias("note"))


def confidence(mentions: Column, denials: Column, acknowledged: Column, spread: Column) -> Column:
    base = (F.when(mentions >= 3, 0.25).when(mentions >= 2, 0.15).when(mentions == 1, 0.05)
            .otherwise(0.0))
    return clamp01(F.lit(0.3) + base + F.when(acknowledged, 0.2).otherwise(0.0)
                   + F.when(spread, 0.1).otherwise(0.0) - denials * 0.15)


def disclosure(events: DataFrame, cases: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One row per case: status, answer, counts, spread, confidence."""
    return rollup(statements(events, cases, summaries), cases)


def rollup(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """The same from the statements: first per text of a case, then per case, each statement reduced to numbers."""
    if "place" not in rows.columns:
        rows = rows.withColumn("place", F.lit(None).cast("struct<start_ms:bigint>"))
    new = (F.col("said") == 0) & F.col("told").isNotNull()

    def either(of_said: str, of_told: str) -> Column:
        return F.coalesce(F.col(of_said), F.when(new, F.col(of_told)))

    grouped = _by_text(rows).groupBy(*CASE).agg(
        F.sum(F.col("said") + new.cast("int")).alias("mentions"),
        *[F.sum(n).alias(n) for n in ("denials", "acks", "hints")],
        F.max(either("last", "told.at")).alias("last_mentioned"),
        (F.max(either("to_ms", "told.ms")) - F.min(either("from_ms", "told.ms"))).alias("span_ms"),
        F.max(either("longest", "told.length")).alias("longest"))
    out = cases.select(*CASE).distinct().join(grouped, CASE, "left")
    out = out.na.fill(0, ["mentions", "denials", "acks", "span_ms", "longest", "hints"])
    status = (
        F.when(F.col("mentions") == 0, "none").when(F.col("denials") > 0, "conflicting")
        .when((F.col("mentions") == 1) & (F.col("longest") < 50), "weak").otherwise("confirmed"))
    who, what = F.col("contact"), F.col("topic")
    answer = (
        F.when(F.col("status") == "none", F.concat(
            F.lit("No evidence found that you told "), who, F.lit(" about "), what, F.lit(".")))
        .when(F.col("status") == "conflicting", F.concat(
            F.lit("You mentioned "), what, F.lit(" to "), who,
            F.lit(", but there are conflicting statements.")))
        .when(F.col("status") == "weak", F.concat(
            F.lit("There is weak evidence you mentioned "), what, F.lit(" to "), who, F.lit(".")))
        .otherwise(F.concat(
            F.lit("There is clear evidence you told "), who, F.lit(" about "), what, F.lit("."))))
    referenced = F.concat(F.lit(" "), who,
                          F.lit(" later referenced it, suggesting they were aware."))
    return (
        out.withColumn("status", status).withColumn("acknowledged", F.col("acks") > 0)
        .withColumn("spread", (F.col("mentions") > 1) & (F.col("span_ms") > WEEK_MS))
        .withColumn("confidence", confidence(
            F.col("mentions"), F.col("denials"), F.col("acknowledged"), F.col("spread")))
        .withColumn("direction", F.when(F.col("mentions") > 0, "outgoing").otherwise("incoming"))
        .withColumn("last_mentioned", F.coalesce("last_mentioned", F.lit("")))
        .withColumn("answer", F.concat(answer, F.when(F.col("acknowledged"), referenced).otherwise("")))
        .select(*CASE, "status", "answer", "mentions", "denials", "acks", "hints", "acknowledged",
                "spread", "confidence", "direction", "last_mentioned")
    )


def notes(cases: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Remarks on each disclosed case, one row each, in reading order; hints come from the statements."""
    def when(test: Column, order: int, text: Column) -> Column:
        return F.when(test, F.struct(F.lit(order).alias("order"), text.alias("note")))

    m, d = F.col("mentions"), F.col("denials")
    made = F.array(
        when(F.col("status") == "none", 1, F.lit("No matching messages found")),
        when(F.col("status") == "conflicting", 1, F.concat(
            d.cast("string"), F.lit(" contradiction(s) found"))),
        when(F.col("status") == "weak", 1, F.lit("Only one brief mention found")),
        when((F.col("status") == "confirmed") & (m > 1), 1, F.concat(
            m.cast("string"), F.lit(" mention(s) found"))),
        when(F.col("acknowledged"), 2, F.lit("Contact acknowledged the topic")),
        when(F.col("spread"), 3, F.lit("Mentions spread across multiple weeks")))
    out = cases.select(*CASE, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("n")).select(
        *CASE, "n.order", "n.note")
    return out if rows is None else out.unionByName(hints(rows).select(*CASE, F.lit(0).alias("order"), "note"))


def evidence_lines(events: DataFrame, cases: DataFrame, summaries: DataFrame | None = None
                   ) -> DataFrame:
    """``[time] text`` of every statement behind a case, by kind."""
    rows, out = stored(statements(events, cases, summaries), "statements"), None
    for kind, df in (("evidence", evidence(rows)), ("contradiction", contradictions(rows)),
                     ("acknowledgment", acknowledgments(rows))):
        part = df.select(*CASE, F.lit(kind).alias("kind"), "at", F.concat(
            F.lit("["), F.coalesce("at", F.lit("unknown")), F.lit("] "), "text").alias("line"))
        out = part if out is None else out.unionByName(part)
    return out
