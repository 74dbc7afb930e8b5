"""Conversations by silence, and chunks of bounded size made of them.

All decisions are taken on *slots*: a contact's messages counted per third of the gap. Two messages
in one slot lie closer than a third of the gap, so a slot never contains a break or a pause, and a
contact has a few thousand slots a year however many messages it holds. Only slots pass through
windows; messages meet them again in an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions.text import clip, contact_key, one_line
from keepsake.functions.times import conversation_key, iso_seconds
from keepsake.operators.ranking import first_last_longest, keep_first, top_k
from keepsake.operators.term_index import stored

HOUR = 3_600_000
KEY = ["owner_id", "contact_key"]
# A slot with more messages than this is numbered in two steps.
HOT_SLOT = 1_000_000


def prepare(events: DataFrame) -> DataFrame:
    """Dated text messages with their contact key and time in milliseconds."""
    return (
        events.filter((F.col("source") == "sms") & F.col("created_at").isNotNull())
        .withColumn("contact_key", contact_key("participants"))
        .withColumn("ts_ms", F.unix_millis("created_at"))
    )


def slots(messages: DataFrame, gap_ms: int = 6 * HOUR) -> DataFrame:
    """Messages per slot with conversation number and pauses; counted before any shuffle."""
    size = max(1, gap_ms // 3)
    counted = (
        messages.withColumn("slot", F.floor(F.col("ts_ms") / size).cast("long"))
        .groupBy(*KEY, "slot")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"),
             F.max("ts_ms").alias("last_ms"))
    )
    w = Window.partitionBy(*KEY).orderBy("slot")
    silence = F.col("first_ms") - F.lag("last_ms").over(w)
    return (
        counted.withColumn("silence", silence)
        .withColumn("opens", F.coalesce(F.col("silence") > gap_ms, F.lit(True)).cast("long"))
        # "Over a third" is a fraction for gaps that three does not divide.
        .withColumn("pause", F.coalesce(
            (F.col("silence") <= gap_ms) & (F.col("silence") * 3 > gap_ms), F.lit(False)
        ).cast("long"))
        .withColumn("conversation", F.sum("opens").over(w))
        .drop("silence", "opens")
    )


def conversations(slot_table: DataFrame) -> DataFrame:
    """One row per conversation: bounds, message count, pauses."""
    return slot_table.groupBy(*KEY, "conversation").agg(
        F.min("first_ms").alias("start_ms"), F.max("last_ms").alias("end_ms"),
        F.sum("n").alias("message_count"), F.sum("pause").alias("gap_count"))


def with_conversation(messages: DataFrame, slot_table: DataFrame, gap_ms: int = 6 * HOUR
                      ) -> DataFrame:
    """Messages with the number of their conversation."""
    size = max(1, gap_ms // 3)
    tagged = messages.withColumn("slot", F.floor(F.col("ts_ms") / size).cast("long"))
    return tagged.join(slot_table.select(*KEY, "slot", "conversation"), [*KEY, "slot"])


def merge_small(convs: DataFrame, min_messages: int = 30) -> DataFrame:
    """Add conversations up, in order, until a group has enough messages.

    The walk is sequential, so it runs over sorted conversation rows (two numbers each), streaming
    through a partition with the running state carried from batch to batch.
    """
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group, held = None, 0, 0
        for batch in batches:
            groups = []
            for owner, contact, n in zip(
                    batch["owner_id"], batch["contact_key"], batch["message_count"]):
                if (owner, contact) != key:
                    key, group, held = (owner, contact), 0, 0
                groups.append(group)
                held += n
                if held >= min_messages:
                    group, held = group + 1, 0
            yield batch.assign(merged_group=groups)

    schema = (
        "owner_id string, contact_key string, conversation bigint, start_ms bigint, "
        "end_ms bigint, message_count bigint, gap_count bigint, merged_group bigint"
    )
    return (
        convs.select(*KEY, "conversation", "start_ms", "end_ms", "message_count", "gap_count")
        .repartition(*KEY).sortWithinPartitions(*KEY, "conversation")
        .mapInPandas(walk, schema)
    )


def merged_groups(merged: DataFrame) -> DataFrame:
    """Totals of each merged group; every member conversation adds one gap."""
    return merged.groupBy(*KEY, "merged_group").agg(
        F.sum("message_count").alias("group_messages"),
        F.sum(F.col("gap_count") + 1).alias("gap_count"),
        F.max("end_ms").alias("group_end_ms"))


def numbered(messages: DataFrame, slot_table: DataFrame, merged: DataFrame,
             gap_ms: int = 6 * HOUR, hot_slot: int = HOT_SLOT) -> DataFrame:
    """Messages with their 0-based position in the merged group.

    Position = messages in earlier slots of the group + position inside the slot. A hot slot is cut
    further by millisecond and by ``seq`` range, so no window sees more than ``hot_slot`` messages
    of it or one row per millisecond.
    """
    size = max(1, gap_ms // 3)
    earlier = Window.partitionBy(*KEY, "merged_group").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = (
        slot_table.join(merged.select(*KEY, "conversation", "merged_group"),
                        [*KEY, "conversation"])
        .withColumn("before_slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .select(*KEY, "slot", "merged_group", "before_slot", (F.col("n") > hot_slot).alias("hot"))
    )
    tagged = (
        messages.withColumn("slot", F.floor(F.col("ts_ms") / size).cast("long"))
        .join(placed, [*KEY, "slot"])
        .withColumn("cut_ms", F.when(F.col("hot"), F.col("ts_ms")).otherwise(0))
        .withColumn("cut_seq", F.when(F.col("hot"), F.floor(F.col("seq") / hot_slot)).otherwise(0))
    )
    cut = [*KEY, "slot", "cut_ms", "cut_seq"]
    in_slot = Window.partitionBy(*KEY, "slot").orderBy("cut_ms", "cut_seq").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        tagged.filter("hot").groupBy(*cut).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before_cut", F.coalesce(F.sum("n").over(in_slot), F.lit(0))).drop("n")
    )
    inside = Window.partitionBy(*cut).orderBy("ts_ms", "seq")
    return (
        tagged.withColumn("in_cut", F.row_number().over(inside) - 1)
        .join(offsets, cut, "left")
        .withColumn("position", F.col("before_slot") + F.coalesce("before_cut", F.lit(0))
                    + F.col("in_cut"))
        .drop("hot", "cut_ms", "cut_seq", "in_cut", "before_cut", "before_slot", "slot")
    )


def chunk_messages(events: DataFrame, gap_ms: int = 6 * HOUR, min_messages: int = 30,
                   max_messages: int = 150, hot_slot: int = HOT_SLOT) -> DataFrame:
    """Messages with their merged group and piece number."""
    messages = prepare(events)
    table = slots(messages, gap_ms)
    merged = merge_small(conversations(table), min_messages)
    return numbered(messages, table, merged, gap_ms, hot_slot).withColumn(
        "piece", F.floor(F.col("position") / max_messages).cast("long"))


def chunks(events: DataFrame, gap_ms: int = 6 * HOUR, min_messages: int = 30,
           max_messages: int = 150, hot_slot: int = HOT_SLOT) -> DataFrame:
    """The chunk table: merged conversations cut every ``max_messages`` messages."""
    # Read three times, and the walk's result twice: contact keys are made once, and the walk runs once.
    messages = stored(prepare(events).select(*KEY, "ts_ms", "seq"), "messages")
    table = slots(messages, gap_ms)
    merged = stored(merge_small(conversations(table), min_messages), "merged")
    pieces = (
        numbered(messages, table, merged, gap_ms, hot_slot)
        .groupBy(*KEY, "merged_group", F.floor(F.col("position") / max_messages).alias("piece"))
        .agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"),
             F.count(F.lit(1)).alias("message_count"))
    )
    small = F.col("group_messages") < min_messages
    return (
        pieces.join(merged_groups(merged), [*KEY, "merged_group"])
        .withColumn("chunk_id", F.concat(
            "contact_key", F.lit("_"), F.col("start_ms").cast("string"),
            F.when(small, "_merged").otherwise("")))
        .withColumn("conversation_key",
                    F.when(small, "merged").otherwise(conversation_key("start_ms")))
        .select("owner_id", "chunk_id", "contact_key", "conversation_key", "start_ms", "end_ms",
                "message_count", "gap_count", "merged_group", "piece")
    )


def chunk_lines(messages: DataFrame, width: int = 500) -> DataFrame:
    """Each message as ``[time] Me/Them: text``."""
    who = F.when(F.col("is_user_message"), "Me").otherwise("Them")
    line = F.concat(F.lit("["), iso_seconds("created_at"), F.lit("] "), who, F.lit(": "),
                    clip(one_line(F.coalesce("text", F.lit(""))), width))
    return messages.withColumn("line", line)


def chunk_texts(events: DataFrame, gap_ms: int = 6 * HOUR, min_messages: int = 30,
                max_messages: int = 150) -> DataFrame:
    """Chunks as text: a header and the message lines. A chunk holds ``max_messages`` at most."""
    lines = chunk_lines(chunk_messages(events, gap_ms, min_messages, max_messages))
    bodies = lines.groupBy(*KEY, "merged_group", "piece").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "line"))), lambda s: s["line"]),
        "\n").alias("body"))
    table = chunks(events, gap_ms, min_messages, max_messages)
    seconds = [F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss")
               for c in ("start_ms", "end_ms")]
    hours = F.floor((F.col("end_ms") - F.col("start_ms")) / HOUR + 0.5).cast("long")
    text = F.concat(
        F.lit("CONTACT: "), "contact_key",
        F.lit("\nTIME RANGE: "), seconds[0], F.lit(" to "), seconds[1],
        F.lit("\nDURATION: ~"), hours.cast("string"),
        F.lit(" hours\nMESSAGE COUNT: "), F.col("message_count").cast("string"),
        F.lit("\nGAPS: "), F.col("gap_count").cast("string"),
        F.lit(" significant pauses within conversation\n\nMESSAGES:\n"), "body")
    return table.join(bodies, [*KEY, "merged_group", "piece"]).select(
        "owner_id", "chunk_id", "contact_key", text.alias("chunk_text"))


# Bucket width and the longest chunk listed with it: short chunks use fine buckets.
LEVELS = ((60_000, HOUR), (HOUR, 48 * HOUR), (24 * HOUR, None))


def messages_in_chunks(chunk_table: DataFrame, messages: DataFrame) -> DataFrame:
    """Stored chunks with the messages between their bounds.

    A chunk is listed under every time bucket it touches and meets the messages of that bucket.
    Dense chunks are short, so they use minutes: a busy day does not compare all its messages with
    all its chunks.
    """
    # Read twice, and made of many steps.
    chunk_table = stored(chunk_table.select(*KEY, "chunk_id", "start_ms", "end_ms"), "chunks")
    span = F.col("end_ms") - F.col("start_ms")
    level, width = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (w, longest) in reversed(list(enumerate(LEVELS))):
        fits = F.lit(True) if longest is None else span <= longest
        level = F.when(fits, F.lit(i)).otherwise(level)
        width = F.when(fits, F.lit(w)).otherwise(width)
    buckets = F.sequence(F.floor(F.col("start_ms") / width), F.floor(F.col("end_ms") / width))
    spans = chunk_table.select(
        *KEY, "chunk_id", "start_ms", "end_ms", level.alias("level"),
        F.explode(buckets).alias("bucket"))
    # Where a message is looked for depends on the chunks its contact has: one short row a contact.
    levels = spans.groupBy(*KEY).agg(F.collect_set("level").alias("_levels"))
    widths = F.array(*[F.lit(w).cast("long") for w, _ in LEVELS])
    points = F.transform("_levels", lambda i: F.struct(
        i.alias("level"), F.floor(F.col("ts_ms") / F.get(widths, i)).alias("bucket")))
    placed = messages.join(levels, KEY).withColumn("_p", F.explode(points)).select(
        *messages.columns, "_p.level", "_p.bucket")
    return (
        placed.join(spans, [*KEY, "level", "bucket"])
        .filter(F.col("ts_ms").between(F.col("start_ms"), F.col("end_ms")))
        .drop("level", "bucket")
    )


def contacts_of(chunk_table: DataFrame) -> DataFrame:
    """Every contact of the chunk table; order on output where a reader needs it."""
    return chunk_table.select(*KEY).distinct()


def chunk_samples(inside: DataFrame, first: int = 3, last: int = 3, longest: int = 2,
                  most: int = 6) -> DataFrame:
    """First, last and longest messages of each chunk without repeats."""
    group = ["owner_id", "chunk_id"]
    picked = first_last_longest(
        inside, group, ["created_at", "seq"], F.length("text"), first, last, longest)
    once = keep_first(picked, [*group, "created_at", "text"], [F.asc("picked")])
    return top_k(once, group, [F.asc("picked")], most)
