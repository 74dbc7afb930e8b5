"""Assistant chat exports: the owner's turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.times import chat_date
from keepsake.sources.files import counts_here, elements_before, parsed

MIN_LENGTH = 5


def _text(content: Column) -> Column:
    """A string, or the joined string parts, or the text field."""
    own = F.when(F.schema_of_variant(content) == "STRING", content.try_cast("string"))
    parts = F.try_variant_get(content, "$.parts", "array<variant>")
    strings = F.filter(F.transform(parts, lambda p: F.when(
        F.schema_of_variant(p) == "STRING", p.try_cast("string"))), lambda s: s != "")
    return F.coalesce(own, F.array_join(strings, "\n"),
                      F.try_variant_get(content, "$.text", "string"), F.lit(""))


def _string(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def _date(v: Column, *keys: str) -> Column:
    return F.coalesce(*[chat_date(_string(v, k)) for k in keys])


def _user_turns(rows: DataFrame, m: Column, at: Column, channel: Column, person: str,
                external: Column, title: Column, extra: list[str]) -> DataFrame:
    """Turns of the owner with enough text, as events."""
    content = F.try_variant_get(m, "$.content", "variant")
    return rows.withColumn("text", F.when(content.isNotNull(), _text(content))).filter(
        F.length("text") >= MIN_LENGTH).select(
        "owner_id", *extra, F.lit("llm_chat").alias("source"), F.lit("message").alias("kind"),
        "text", at.alias("created_at"),
        F.array(F.lit(person)).alias("participants"), channel.alias("channel"),
        external.alias("external_id"), F.lit(True).alias("is_user_message"),
        F.create_map(F.lit("title"), title).alias("metadata"), "seq")


def mapping_turns(docs: DataFrame, *extra: str) -> DataFrame:
    """The ``mapping`` form. An array at the root holds one conversation per element."""
    doc = F.col("doc")
    convs = F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), F.array(doc))
    nodes = docs.filter(counts_here(None)).select("owner_id", *extra, "base", "array", F.posexplode(convs).alias("conv_no", "conv")).select(
        "owner_id", *extra, (F.col("conv_no") + elements_before(None)).alias("conv_no"), F.posexplode(F.map_values(F.try_variant_get(
            "conv", "$.mapping", "map<string,variant>"))).alias("node_no", "node"))
    m = F.col("m")
    rows = nodes.withColumn("m", F.try_variant_get("node", "$.message", "variant")).withColumn(
        "seq", F.col("conv_no") * F.lit(1_000_000) + F.col("node_no").cast("long")).filter(
        F.try_variant_get(m, "$.author.role", "string") == "user")
    return _user_turns(rows, m, _date(m, "create_time"), F.lit("chatgpt"), "ChatGPT",
                       _string(m, "id"), _string(m, "title"), list(extra))


def message_turns(docs: DataFrame, *extra: str) -> DataFrame:
    """The message-list form: conversations with messages, or one flat list.

    A turn without a date takes its conversation's.
    """
    doc = F.col("doc")
    flat = F.try_variant_get(doc, "$", "array<variant>")
    convs = F.coalesce(F.try_variant_get(doc, "$.conversations", "array<variant>"), F.array(doc))
    several = F.try_variant_get(doc, "$.conversations", "variant").isNotNull()
    mine = F.when(several, counts_here("conversations")).otherwise(counts_here("messages"))
    listed = docs.filter(flat.isNull() & mine).select("owner_id", *extra, "base", "array", F.posexplode(convs).alias(
        "conv_no", "conv")).select(
        "owner_id", *extra, "base", "array", (F.col("conv_no") + elements_before("conversations")).alias("conv_no"), F.col("conv"),
        F.posexplode(F.try_variant_get("conv", "$.messages", "array<variant>")).alias("turn_no", "m")).withColumn(
        "turn_no", F.col("turn_no") + elements_before("messages"))
    single = docs.filter(flat.isNotNull()).select(
        "owner_id", *extra, "base", "array", F.lit(0).cast("long").alias("conv_no"), F.lit(None).cast("variant").alias("conv"),
        F.posexplode(flat).alias("turn_no", "m")).withColumn("turn_no", F.col("turn_no") + elements_before(None))
    m = F.col("m")
    rows = listed.unionByName(single).withColumn(
        "seq", F.col("conv_no") * F.lit(1_000_000) + F.col("turn_no").cast("long")).filter(
        _string(m, "role") == "user")
    at = F.coalesce(_date(m, "timestamp", "created_at"), _date(F.col("conv"), "created_at"))
    title = F.coalesce(_string(F.col("conv"), "name"), F.lit("Claude Chat"))
    return _user_turns(rows, m, at, F.lit("claude"), "Claude", F.lit(None).cast("string"), title,
                       list(extra))


def plain_turns(docs: DataFrame, *extra: str) -> DataFrame:
    """Any document with ``messages`` at its root."""
    m = F.col("m")
    listed = F.coalesce(F.try_variant_get("doc", "$", "array<variant>"),
                        F.try_variant_get("doc", "$.messages", "array<variant>"))
    rows = docs.filter(counts_here("messages") | counts_here(None)).select(
        "owner_id", *extra, "base", "array", F.posexplode(listed).alias("turn_no", "m")).withColumn(
        "seq", F.col("turn_no") + F.when(F.col("array").isNull(), F.col("base")).otherwise(elements_before("messages"))).filter(_string(m, "role") == "user")
    return _user_turns(rows, m, _date(m, "timestamp", "created_at", "date"),
                       F.coalesce(_string(m, "model"), F.lit("unknown")), "LLM",
                       F.lit(None).cast("string"), F.lit(None).cast("string"), list(extra))


def any_turns(raw: DataFrame) -> DataFrame:
    """The first form that yields turns wins, per file."""
    docs = parsed(raw).filter("doc IS NOT NULL")
    has_list = (F.try_variant_get("doc", "$", "array<variant>").isNotNull()
                | F.try_variant_get("doc", "$.conversations", "variant").isNotNull())
    forms = [mapping_turns(docs, "path"), message_turns(docs.filter(has_list), "path"),
             plain_turns(docs, "path")]
    rows = None
    for i, df in enumerate(forms):
        part = df.withColumn("form", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("owner_id", "path").agg(F.min("form").alias("form"))
    return rows.join(best, ["owner_id", "path", "form"], "left_semi").drop("form")
