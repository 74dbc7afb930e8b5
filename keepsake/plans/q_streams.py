"""Streams run to the end of the given tables."""

from pyspark.sql import functions as F

from keepsake.plans import tables
from keepsake.plans.q_maintained import KEYED, REPEATED, sides, stored_at
from keepsake.plans.q_sessions import GAP, STEPS
from keepsake.plans.registry import query
from keepsake.streaming import session_stream, timeline_stream


@query("str_01_continuous_import", f"WITH {KEYED} SELECT owner_id, seq FROM merged")
def _(t):
    path = stored_at(t, "stream")
    old, incoming = sides(t)
    tables.write_timeline(old, f"{path}/timeline")
    # Two drops; the second repeats the first under later numbers.
    for half in (F.col("seq") < REPEATED, F.col("seq") >= REPEATED):
        incoming.filter(half).write.mode("append").parquet(f"{path}/landing")
    rows = timeline_stream.landed(t.spark, f"{path}/landing", incoming.schema, files_per_batch=4)
    timeline_stream.import_continuously(
        rows, f"{path}/timeline", f"{path}/checkpoint", available_now=True).awaitTermination()
    return tables.read_timeline(t.spark, f"{path}/timeline").select("owner_id", "seq")


@query("str_02_live_sessions", f"""WITH {STEPS}
    SELECT owner_id, contact_key, start_ms, end_ms, message_count FROM conv
    WHERE end_ms + {GAP} <= (SELECT max(ts_ms) FROM v_evt) - 3600000""")
def _(t):
    path = stored_at(t, "sessions")
    schema = t.spark.read.parquet(f"{t.folder}/events.parquet").schema
    events = (
        t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
        .withColumn("created_at", F.col("ts").cast("timestamp")).withColumn("source", F.lit("sms"))
        .withColumn("owner_id", t.owner("user_id")).withColumn("participants", F.array(
            F.lit("Me"), F.concat(F.lit("user_"), F.col("user_id").cast("string"))))
    )
    session_stream.write_sessions(session_stream.live_sessions(events), f"{path}/out",
                                  f"{path}/checkpoint", available_now=True).awaitTermination()
    return t.spark.read.parquet(f"{path}/out")
