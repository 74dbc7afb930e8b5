"""Reading stored answers of a language model: summaries, entities, topics. No model is called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.functions.lexicons import ENTITY_TYPES
from keepsake.functions.text import clamp01, col, let, strip

# Fixed value: the states of the answer format.
DELTA_STATUS = "disclosed|hinted|updated|contradicted"


def _section(text: Column, name: str, until: str | None) -> Column:
    stop = rf"(?={until}|\z)" if until else r"\z"
    return F.nullif(strip(F.regexp_extract(text, rf"(?s){name}:\s*(.+?){stop}", 1)), F.lit(""))


def _list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: (x != "") & (x != "none"))


def summary(response: Column | str) -> Column:
    """Struct of summary, topics, notable events, tone and the raw list of statements."""
    t = col(response)
    return F.struct(
        F.coalesce(_section(t, "SUMMARY", "TOPICS:"), F.lit("Unable to summarize")).alias("summary"),
        _list(F.coalesce(_section(t, "TOPICS", "NOTABLE_EVENTS:"), F.lit(""))).alias("topics"),
        _list(F.coalesce(_section(t, "NOTABLE_EVENTS", "TONE:"), F.lit("none"))).alias("notable_events"),
        F.lower(F.coalesce(_section(t, "TONE", "KNOWLEDGE_DELTAS:"), F.lit("unknown"))).alias("tone"),
        F.coalesce(_section(t, "KNOWLEDGE_DELTAS", None), F.lit("none")).alias("statements"))


def deltas(statements: Column | str) -> Column:
    """Recorded statements with topic, status, date and evidence; incomplete ones drop out."""
    s = col(statements)
    blocks = F.filter(F.split(s, r"(?=- TOPIC:)"), lambda b: strip(b) != "")

    def read(b: Column) -> Column:
        topic = F.regexp_extract(b, r"(?s)TOPIC:\s*(.+?)(?=- STATUS:|\z)", 1)
        evidence = F.regexp_extract(b, r"(?s)EVIDENCE:\s*(.+?)(?=- TOPIC:|\z)", 1)
        return F.struct(
            F.nullif(strip(topic), F.lit("")).alias("topic"),
            F.nullif(F.lower(F.regexp_extract(b, rf"(?i)STATUS:\s*({DELTA_STATUS})", 1)), F.lit(""))
            .alias("status"),
            F.nullif(F.regexp_extract(b, r"DATE:\s*(\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("date"),
            F.nullif(strip(evidence), F.lit("")).alias("evidence"))

    found = F.filter(F.transform(blocks, read), lambda d: d["topic"].isNotNull()
                     & d["status"].isNotNull() & d["date"].isNotNull())
    return F.when(F.lower(s) != "none", found).otherwise(F.slice(found, 1, 0))


def summary_confidence(messages: Column, text: Column, topics: Column) -> Column:
    """From message count, summary length, number of topics, hedging; errors give 0.1."""
    n, low = F.length(text), F.lower(text)
    score = (
        F.lit(0.5)
        + F.when(messages >= 50, 0.15).when(messages >= 20, 0.1).when(messages < 10, -0.1).otherwise(0.0)
        + F.when(n.between(50, 500), 0.1).otherwise(0.0)
        + F.when(F.size(topics).between(2, 7), 0.1).otherwise(0.0)
        - F.when(F.contains(low, F.lit("uncertain")) | F.contains(low, F.lit("unclear")), 0.15)
        .otherwise(0.0))
    failed = F.contains(text, F.lit("Error")) | F.contains(text, F.lit("Unable to"))
    return clamp01(F.when(failed, 0.1).otherwise(score))


# Fixed value: a line of the answer format that names an entity.
ENTITY = (
    r"(?s)ENTITY_START\s*TYPE:\s*(.+?)\s*NAME:\s*(.+?)\s*ALIASES:\s*(.+?)\s*ATTRIBUTES:\s*(.+?)"
    r"\s*CONFIDENCE:\s*(.+?)\s*RELATED_TO:\s*(.+?)\s*ENTITY_END"
)


def entities(response: Column | str) -> Column:
    """Entities named in an answer, of the known types."""
    t = col(response)
    found = F.arrays_zip(*[
        F.regexp_extract_all(t, F.lit(ENTITY), F.lit(i)).alias(n) for i, n in enumerate(
            ("type", "name", "aliases", "attributes", "confidence", "related"), 1)])

    def names(c: Column) -> Column:
        return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")

    def pairs(c: Column) -> Column:
        cut = F.transform(F.split(c, ","), lambda p: F.transform(F.split(p, ":"), strip))
        kept = F.filter(cut, lambda p: (F.size(p) > 1) & (p[0] != "") & (F.get(p, F.lit(1)) != ""))
        return F.map_from_entries(F.transform(kept, lambda p: F.struct(p[0].alias("k"), p[1].alias("v"))))

    def read(e: Column) -> Column:
        attributes, related = strip(e["attributes"]), strip(e["related"])
        number = F.regexp_extract(e["confidence"], r"^\s*(\d*\.?\d+)", 1).try_cast("double")
        return F.struct(
            strip(e["type"]).alias("type"), strip(e["name"]).alias("canonical_name"),
            names(e["aliases"]).alias("aliases"),
            F.when(attributes != "none", pairs(attributes)).alias("attributes"),
            F.coalesce(F.nullif(number, F.lit(0.0)), F.lit(0.5)).alias("confidence"),
            F.when(related != "none", names(related)).alias("related_to"))

    known = F.filter(F.transform(found, read), lambda e: e["type"].isin(*ENTITY_TYPES))
    return F.when(~F.contains(t, F.lit("NO_ENTITIES")), known).otherwise(F.slice(known, 1, 0))


def topic_quotes(response: Column | str, most: int = 5) -> Column:
    """Up to five topics with their last mention and a quote."""
    t = col(response)
    pattern = r"(?s)TOPIC:\s*(.+?)\nLAST_MENTIONED:\s*(.+?)\nQUOTE:\s*(.+?)(?=TOPIC:|\z)"
    found = F.arrays_zip(*[
        F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(i)), strip).alias(n)
        for i, n in enumerate(("topic", "last_mentioned", "quote"), 1)])
    return F.slice(found, F.lit(1), F.when(F.contains(t, F.lit("NO_TOPICS")), 0).otherwise(most))


def first_json_object(text: Column | str) -> Column:
    """The first balanced ``{...}`` of a text; null where none closes."""
    t = col(text)
    tail = F.substring(t, F.instr(t, F.lit("{")), F.length(t))

    def close(chars: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

        def step(s: Column, ch: Column) -> Column:
            depth = s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
            closes = (s["end"] == 0) & (ch == "}") & (depth == 0)
            return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"),
                            F.when(closes, s["at"] + 1).otherwise(s["end"]).alias("end"))

        return F.aggregate(chars, start, step, lambda s: s["end"])

    end = let(F.split(tail, ""), close)
    found = let(end, lambda n: F.when(n > 0, F.substring(tail, F.lit(1), n)))
    return F.when(F.contains(t, F.lit("{")), found)
