"""Stored tables: saving, loading, and merging new rows into what is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.functions.text import clip, one_line
from keepsake.functions.times import iso
from keepsake.operators.ranking import keep_first, rank_all, top_k
from keepsake.schema import TIMELINE
from keepsake.sources.files import exists


def newest_first() -> list[Column]:
    """Stored order: date descending, undated rows as 1970; equal dates by ``seq``."""
    return [F.desc(F.coalesce(F.unix_millis("created_at"), F.lit(0))), F.asc("seq")]


def newest_first_undated_last() -> list[Column]:
    """Importer order: date descending, undated rows last."""
    return [F.desc_nulls_last("created_at"), F.asc("seq")]


def timeline_key(chars: int = 180) -> Column:
    """Identity of an event: source, kind, id, date and the first ``chars`` characters of its text (a rule of the archive format).

    A 128-bit digest, since it decides which rows are dropped: 64 bits would collide at 10^10 rows.
    """
    text = clip(one_line(F.lower(F.coalesce("text", F.lit("")))), chars)
    return F.md5(F.concat_ws(
        "|", "source", "kind", F.coalesce("external_id", F.lit("")),
        F.coalesce(iso("created_at"), F.lit("")), text))


def with_key(events: DataFrame) -> DataFrame:
    return events if "event_key" in events.columns else events.withColumn(
        "event_key", timeline_key())


def new_events(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows that are neither stored nor repeated; the first by ``seq`` stays.

    Of the stored table only owner and key are read.
    """
    fresh = with_key(incoming).join(
        with_key(existing).select("owner_id", "event_key"), ["owner_id", "event_key"], "left_anti")
    return keep_first(fresh, ["owner_id", "event_key"], [F.asc("seq")])


def upsert_timeline(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The merged table. Stored rows win. Column ``imported`` marks the rows just added."""
    added = new_events(existing, incoming).withColumn("imported", F.lit(True))
    kept = with_key(existing).withColumn("imported", F.lit(False))
    return kept.unionByName(added, allowMissingColumns=True)


def import_report(merged: DataFrame) -> DataFrame:
    return merged.groupBy("owner_id").agg(
        F.count_if("imported").alias("imported"), F.count(F.lit(1)).alias("total_after_import"))


# --- Saving ---------------------------------------------------------------------------------------

#: Parts of a source by event key. A small batch touches few of them, and a merge reads no others.
KEY_BUCKETS = 64


def key_bucket() -> Column:
    return (F.conv(F.substring("event_key", 1, 4), 16, 10).cast("int") % KEY_BUCKETS).cast("int")


def write_timeline(events: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by source and key bucket, each event with its key, so a later merge reads two columns of few buckets."""
    rows = with_key(events).drop("imported").withColumn("key_bucket", key_bucket())
    # One file for each bucket of a write; AQE parts a hot one.
    rows.hint("rebalance", F.col("source"), F.col("key_bucket")).write.mode(mode).partitionBy("source", "key_bucket").parquet(path)


def _stored_timeline(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([
            *TIMELINE.fields, T.StructField("event_key", T.StringType()), T.StructField("key_bucket", T.IntegerType())]))
    return spark.read.parquet(path)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """The stored events; none before the first import."""
    return _stored_timeline(spark, path).drop("key_bucket")


def stored_keys(spark: SparkSession, path: str, incoming: DataFrame) -> DataFrame:
    """Owner and key of the stored events in the buckets that hold a key of the batch.

    A bucket has all events of its keys, so no other can hold one of them. At most KEY_BUCKETS numbers come to the
    driver, as a filter on partitions; sources are not filtered, as a key already says its source.
    """
    held = sorted(r[0] for r in with_key(incoming).select(key_bucket().alias("b")).distinct().collect())
    rows = _stored_timeline(spark, path)
    if "key_bucket" in rows.columns and len(held) < KEY_BUCKETS:
        rows = rows.filter(F.col("key_bucket").isin(held))
    return rows.select("owner_id", "event_key")


def import_events(spark: SparkSession, path: str, incoming: DataFrame) -> None:
    """Append only what is new: the stored files are never rewritten, and only the batch's buckets are read."""
    keyed = with_key(incoming)
    write_timeline(new_events(stored_keys(spark, path, keyed), keyed), path)


FORUM_TABLES = ("comments", "posts", "saved", "upvoted", "subreddits")


def write_forum(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    for name in FORUM_TABLES:
        tables[name].write.mode(mode).parquet(f"{folder}/{name}")


def read_forum(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in FORUM_TABLES}


def clear(spark: SparkSession, path: str, schema) -> None:
    """Empty a stored table and keep its schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def write_profile(profile: DataFrame, folder: str, name: str) -> None:
    profile.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_profile(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def latest_per_key(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last write wins."""
    return keep_first(rows, keys, [F.desc(version)])


def write_contact_profiles(profiles: DataFrame, path: str, version: int) -> None:
    """Append one generation of profiles; readers take the newest of a name."""
    profiles.withColumn("version", F.lit(version)).write.mode("append").parquet(path)


def read_contact_profiles(spark: SparkSession, path: str) -> DataFrame:
    return latest_per_key(spark.read.parquet(path), ["owner_id", "contact"], "version")


# --- Derived tables kept up to date ---------------------------------------------------------------

def upsert_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace stored rows of the same key."""
    keys = list(keys)
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def stale_chunks(chunks: DataFrame, stored: DataFrame, now_ms: int, max_age_days: int = 7,
                 per_owner: int | None = None) -> DataFrame:
    """Chunks to summarize: absent, with another message count, or summarized too long ago.

    ``per_owner`` bounds the work of one run (the interactive path took three at a time).
    """
    s = stored.select("owner_id", "chunk_id", F.col("message_count").alias("_n"), "processed_at")
    limit = F.timestamp_millis(F.lit(now_ms)) - F.make_dt_interval(F.lit(max_age_days))
    reason = (
        F.when(F.col("_n").isNull(), "absent")
        .when(F.col("_n") != F.col("message_count"), "changed")
        .when(F.col("processed_at") < limit, "old"))
    out = (
        chunks.join(s, ["owner_id", "chunk_id"], "left").withColumn("reason", reason)
        .filter(F.col("reason").isNotNull()).drop("_n", "processed_at")
    )
    if per_owner is None:
        return out
    return top_k(out, ["owner_id"], [F.asc("contact_key"), F.asc("start_ms"), F.asc("chunk_id")],
                 per_owner)


def stored_months(cache: DataFrame, messages: DataFrame, contact: str = "contact") -> DataFrame:
    """Cached months that are still valid: the contact's fingerprint has not changed."""
    keys = ["owner_id", contact]
    return cache.join(fingerprints(messages, contact), [*keys, "fingerprint"], "left_semi")


def fingerprints(messages: DataFrame, contact: str = "contact") -> DataFrame:
    """``count:first:last`` per contact, dates as text."""
    first, last = F.min("created_at"), F.max("created_at")
    return messages.groupBy("owner_id", contact).agg(F.concat_ws(
        ":", F.count(F.lit(1)).cast("string"), F.coalesce(iso(first), F.lit("")),
        F.coalesce(iso(last), F.lit(""))).alias("fingerprint"))


def month_counts(messages: DataFrame, contact: str = "contact") -> DataFrame:
    month = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("unknown"))
    return messages.groupBy("owner_id", contact, month.alias("month")).agg(
        F.count(F.lit(1)).alias("message_count"))


def missing_months(messages: DataFrame, cache: DataFrame, contact: str = "contact") -> DataFrame:
    """Months without a valid cached summary."""
    keys = ["owner_id", contact]
    return month_counts(messages, contact).join(
        stored_months(cache, messages, contact).select(*keys, "month"), [*keys, "month"], "left_anti")


def month_priority(months: DataFrame, missing: DataFrame, n: int = 6, contact: str = "contact"
                   ) -> DataFrame:
    """Missing months in build order: the contact's earliest, its latest, then the largest."""
    keys = ["owner_id", contact]
    bounds = months.groupBy(*keys).agg(F.min("month").alias("_first"), F.max("month").alias("_last"))
    place = (F.when(F.col("month") == F.col("_first"), 0)
             .when(F.col("month") == F.col("_last"), 1).otherwise(2))
    ranked = (
        months.join(missing.select(*keys, "month"), [*keys, "month"], "left_semi")
        .join(bounds, keys).withColumn("_place", place)
    )
    return top_k(ranked, keys, [F.asc("_place"), F.desc("message_count"), F.asc("month")], n
                 ).drop("_place", "_first", "_last")


# --- Writing sessions and chunk memory -----------------------------------------------------------

def keep_recent_sessions(sessions: DataFrame, n: int = 100) -> DataFrame:
    """The newest sessions of each owner."""
    return top_k(sessions, ["owner_id"], [F.desc("timestamp"), F.desc("session_id")], n)


def recent_of_contact(sessions: DataFrame, n: int = 5) -> DataFrame:
    return top_k(sessions.filter("contact IS NOT NULL"), ["owner_id", "contact"],
                 [F.desc("timestamp"), F.desc("session_id")], n)


SESSION = ["owner_id", "session_id"]
#: A change of a session: a new value of a field, or a correction. ``version`` orders writes, ``seq`` what one write holds.
CHANGE = "owner_id string, session_id bigint, field string, value string, seq bigint, version bigint"
CORRECTION = "correction"


def corrections_as_changes(corrections: DataFrame) -> DataFrame:
    return corrections.select(*SESSION, F.lit(CORRECTION).alias("field"), F.col("feedback").alias("value"), "seq")


def updates_as_changes(updates: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One change for each given value; a null changes nothing. Values are stored as text."""
    given = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = updates.select(*SESSION, F.explode(given).alias("g")).select(*SESSION, "g.field", "g.value")
    return rows.filter("value IS NOT NULL").withColumn("seq", F.lit(0).cast("long"))


def log_changes(changes: DataFrame, path: str, version: int) -> None:
    """Append changes; sessions are not rewritten. A version that is written again replaces itself."""
    changes.select(*SESSION, "field", "value", "seq").write.mode("overwrite").parquet(f"{path}/log/version={version}")


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """All changes that count: those of the last finished compaction, and the log behind it."""
    log = spark.read.schema(CHANGE).parquet(f"{path}/log") if exists(spark, f"{path}/log") else spark.createDataFrame([], CHANGE)
    done = _compacted(spark, path)
    if done is None:
        return log
    return spark.read.schema(CHANGE).parquet(f"{path}/base/upto={done}").unionByName(log.filter(F.col("version") > done))


def _compacted(spark: SparkSession, path: str) -> int | None:
    """The version up to which changes are compacted; a compaction counts from when its row is written."""
    if not exists(spark, f"{path}/compacted"):
        return None
    return spark.read.schema("upto bigint").parquet(f"{path}/compacted").agg(F.max("upto")).first()[0]


def compact_changes(spark: SparkSession, path: str) -> None:
    """Fold the log into a new base: of a field its last value stays, and all corrections. Readers see the old or the new base."""
    changes = read_changes(spark, path)
    upto = changes.agg(F.max("version")).first()[0]
    if upto is None or upto == _compacted(spark, path):
        return
    last = _last_values(changes).select(*SESSION, "field", "last.value", "last.seq", "last.version")
    kept = last.unionByName(changes.filter(F.col("field") == CORRECTION).select(last.columns))
    kept.write.mode("overwrite").parquet(f"{path}/base/upto={upto}")
    spark.createDataFrame([(upto,)], "upto bigint").coalesce(1).write.mode("append").parquet(f"{path}/compacted")


def _last_values(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("field") != CORRECTION).groupBy(*SESSION, "field").agg(
        F.max(F.struct("version", "seq", "value")).alias("last"))


def update_sessions(sessions: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sessions as the changes leave them: the last given value of a column replaces the stored one."""
    last = _last_values(changes)
    values = last.groupBy(*SESSION).agg(*[
        F.max(F.when(F.col("field") == c, F.col("last.value"))).alias(f"_{c}") for c in columns])
    joined = sessions.join(values, SESSION, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(F.col(f"_{c}").cast(sessions.schema[c].dataType), F.col(c))).drop(f"_{c}")
    return joined


def corrections_of(changes: DataFrame) -> DataFrame:
    """Corrections of each session as rows with their place, however many a session has."""
    rows = changes.filter(F.col("field") == CORRECTION).select(*SESSION, "version", "seq", F.col("value").alias("feedback"))
    return rank_all(rows, SESSION, [F.asc("version"), F.asc("seq"), F.asc("feedback")], "place").drop("version")


# --- State of a contact --------------------------------------------------------------------------

STATE = "owner_id string, contact_key string, field string, value string, set_at timestamp"


def set_state(rows: DataFrame, path: str, field: str, value: str, set_at: Column) -> None:
    """Store a value of a contact (its overall summary, what is known of it) as of a time. Older values stay readable."""
    rows.select("owner_id", "contact_key", F.lit(field).alias("field"), F.col(value).cast("string").alias("value"),
                set_at.cast("timestamp").alias("set_at")).write.mode("append").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).parquet(path) if exists(spark, path) else spark.createDataFrame([], STATE)


def state_as_of(state: DataFrame, asked: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The rows of ``asked`` (owner_id, contact_key, at) with the value that each field had then, null before the first.

    Of two values set at one time the greater counts. Only values that were set by then meet a request, and they are reduced
    to one by an aggregate before the request's columns come back.
    """
    keys = ["owner_id", "contact_key", "at"]
    found = asked.select(*keys).distinct().join(state, keys[:2]).filter(F.col("set_at") <= F.col("at")).groupBy(*keys).agg(*[
        F.max(F.when(F.col("field") == f, F.struct("set_at", "value")))["value"].alias(f) for f in fields])
    return asked.join(found, keys, "left")


def memory_rows(chunks: DataFrame, summaries: DataFrame, model: str, now: Column) -> DataFrame:
    """Chunks with their summary, ready to be stored."""
    return chunks.join(summaries, ["owner_id", "chunk_id"]).withColumn(
        "model_used", F.lit(model)).withColumn("processed_at", now)
