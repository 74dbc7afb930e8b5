"""Live conversations: sessions of a contact's messages by silence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keepsake.functions.text import contact_key

GAP = "6 hours"


def live_sessions(messages: DataFrame, gap: str = GAP, delay: str = "1 hour") -> DataFrame:
    """Closed conversations. A silence of exactly the gap still belongs to the conversation.

    The window's own end lies a gap after the last message, so the last time is carried along. State
    holds one open session per contact, not its messages; messages later than ``delay`` drop out.
    """
    keyed = messages.filter((F.col("source") == "sms") & F.col("created_at").isNotNull()).select(
        "owner_id", contact_key("participants").alias("contact_key"), "created_at")
    return (
        keyed.withWatermark("created_at", delay)
        .groupBy("owner_id", "contact_key", F.session_window("created_at", gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("message_count"), F.min("created_at").alias("first_at"),
             F.max("created_at").alias("last_at"))
        .select("owner_id", "contact_key", F.unix_millis("first_at").alias("start_ms"),
                F.unix_millis("last_at").alias("end_ms"), "message_count")
    )


def write_sessions(sessions: DataFrame, path: str, checkpoint: str, available_now: bool = False
                   ) -> StreamingQuery:
    writer = (
        sessions.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now
            else writer.trigger(processingTime="1 minute")).start()
