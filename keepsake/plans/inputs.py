"""Views over the driver's tables, and the same views as SQL text for the comparison.

Text comes from one table and time and person from another, so the views join them on their common
number. Three owners share every view.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.session import configure

VIEW_SQL = {
    "v_msg": """
        SELECT e.event_id, e.event_id AS seq, 'o' || (e.event_id % 3) AS owner_id,
               'sms' AS source, 'message' AS kind, d.text, e.ts AS created_at,
               'user_' || e.user_id AS contact, e.event_id % 2 = 0 AS is_user_message,
               d.source AS channel, d.lang
        FROM events e JOIN documents d ON e.event_id = d.doc_id""",
    "v_comment": """
        SELECT d.doc_id AS id, d.doc_id AS seq, 'o' || (d.doc_id % 3) AS owner_id,
               d.source AS subreddit, d.text AS body, e.ts AS created_at,
               CAST(floor(e.value) AS DOUBLE) AS score
        FROM events e JOIN documents d ON e.event_id = d.doc_id""",
    "v_post": """
        SELECT p.page_id AS id, p.page_id AS seq, 'o' || (p.page_id % 3) AS owner_id,
               e.event_type AS subreddit, p.url AS permalink,
               regexp_extract(p.html, '<title>([^<]*)</title>', 1) AS title,
               p.html AS body, e.ts AS created_at, CAST(floor(e.value) AS DOUBLE) AS score
        FROM events e JOIN pages p ON e.event_id = p.page_id""",
    "v_saved": """
        SELECT b.item_id AS id, b.item_id AS seq, 'o' || (b.item_id % 3) AS owner_id,
               e.event_type AS subreddit, '/saved/' || b.item_id AS permalink, b.text AS title,
               e.ts AS created_at
        FROM events e JOIN benchmark b ON e.event_id = b.item_id""",
    "v_upvoted": """
        SELECT l.doc_id AS id, l.doc_id AS seq, 'o' || (l.doc_id % 3) AS owner_id,
               e.event_type AS subreddit, '/voted/' || l.doc_id AS permalink,
               CAST(NULL AS VARCHAR) AS title, e.ts AS created_at
        FROM events e JOIN labels l ON e.event_id = l.doc_id""",
    "v_evt": """
        SELECT e.event_id, e.event_id AS seq, 'o' || (e.user_id % 3) AS owner_id,
               'sms' AS source, e.event_type AS channel, 'message' AS kind, e.props AS text,
               e.ts AS created_at, epoch_us(e.ts) // 1000 AS ts_ms, 'user_' || e.user_id AS contact,
               'me_user_' || e.user_id AS contact_key, e.event_id % 2 = 0 AS is_user_message
        FROM events e""",
    "v_chat": """
        SELECT conv_id || ':' || turn AS external_id, 'o' || (conv_id % 3) AS owner_id,
               'llm_chat' AS source, 'message' AS kind, text, role,
               role = 'user' AS is_user_message, conv_id, turn, conv_id * 1000 + turn AS seq
        FROM conversations""",
    "v_page": "SELECT page_id, 'o' || (page_id % 3) AS owner_id, url, html FROM pages",
    "v_corpus": """
        SELECT owner_id, 'comment' AS kind, body AS text FROM v_comment
        UNION ALL SELECT owner_id, 'post', title || chr(10) || body FROM v_post
        UNION ALL SELECT owner_id, 'saved', title || chr(10) || permalink FROM v_saved
        UNION ALL SELECT owner_id, 'upvoted', permalink FROM v_upvoted
        UNION ALL SELECT owner_id, 'timeline', text FROM v_chat
        UNION ALL SELECT owner_id, 'timeline', text FROM v_evt""",
    "v_timeline": """
        SELECT owner_id, source, kind, text, created_at, channel, is_user_message, contact, seq
        FROM v_msg
        UNION ALL
        SELECT owner_id, source, kind, text, NULL, 'chat', is_user_message, NULL, 1000000000 + seq
        FROM v_chat
        UNION ALL
        SELECT owner_id, 'chrome', 'message', url, e.ts, 'chrome_history', NULL, NULL,
               2000000000 + page_id
        FROM v_page JOIN events e ON e.event_id = page_id""",
}
_USES = {
    "v_corpus": ["v_comment", "v_post", "v_saved", "v_upvoted", "v_chat", "v_evt"],
    "v_timeline": ["v_msg", "v_chat", "v_page"],
}


def sql(body: str) -> str:
    """Put the views a query names in front of it."""
    named = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", body)]
    needed = list(dict.fromkeys(u for v in named for u in [*_USES.get(v, []), v]))
    views = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in needed)
    body = body.strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {views}, {body[len('WITH'):]}"
    return f"WITH {views} {body}"


# Tables whose rows take much work each.
TEXT_TABLES = ("documents", "pages", "conversations")


class Tables:
    """The driver's tables and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        for f in df.schema.fields:
            if f.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
        return self._spread(df) if name in TEXT_TABLES else df

    def _spread(self, df: DataFrame) -> DataFrame:
        """Text that comes in fewer splits than there are cores is dealt out before the work on it.

        A table of many files has more splits than cores and stays as it is.
        """
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @staticmethod
    def owner(number: str) -> Column:
        return F.concat(F.lit("o"), (F.col(number) % 3).cast("string")).alias("owner_id")

    def _dated(self, name: str, number: str) -> DataFrame:
        return self.raw(name).join(self.raw("events"), F.col(number) == F.col("event_id"))

    def messages(self) -> DataFrame:
        contact = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
        docs = self.raw("documents").withColumnRenamed("source", "doc_source")
        return docs.join(self.raw("events"), F.col("doc_id") == F.col("event_id")).select(
            "event_id", F.col("event_id").alias("seq"), self.owner("event_id"),
            F.lit("sms").alias("source"), F.lit("message").alias("kind"), "text",
            F.col("ts").alias("created_at"), contact.alias("contact"),
            F.array(F.lit("Me"), contact).alias("participants"),
            (F.col("event_id") % 2 == 0).alias("is_user_message"),
            F.col("doc_source").alias("channel"), "lang")

    def comments(self) -> DataFrame:
        return self._dated("documents", "doc_id").select(
            F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), self.owner("doc_id"),
            F.col("source").alias("subreddit"), F.col("text").alias("body"),
            F.lit(None).cast("string").alias("permalink"), F.lit(None).cast("string").alias("title"),
            F.col("ts").alias("created_at"), F.floor("value").cast("double").alias("score"))

    def posts(self) -> DataFrame:
        return self._dated("pages", "page_id").select(
            F.col("page_id").alias("id"), F.col("page_id").alias("seq"), self.owner("page_id"),
            F.col("event_type").alias("subreddit"), F.col("url").alias("permalink"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
            F.col("html").alias("body"), F.col("ts").alias("created_at"),
            F.floor("value").cast("double").alias("score"))

    def saved(self) -> DataFrame:
        return self._dated("benchmark", "item_id").select(
            F.col("item_id").alias("id"), F.col("item_id").alias("seq"), self.owner("item_id"),
            F.col("event_type").alias("subreddit"),
            F.concat(F.lit("/saved/"), F.col("item_id").cast("string")).alias("permalink"),
            F.col("text").alias("title"), F.col("ts").alias("created_at"))

    def upvoted(self) -> DataFrame:
        return self._dated("labels", "doc_id").select(
            F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), self.owner("doc_id"),
            F.col("event_type").alias("subreddit"),
            F.concat(F.lit("/voted/"), F.col("doc_id").cast("string")).alias("permalink"),
            F.lit(None).cast("string").alias("title"), F.col("ts").alias("created_at"))

    def dense(self) -> DataFrame:
        contact = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
        return self.raw("events").select(
            "event_id", F.col("event_id").alias("seq"), self.owner("user_id"),
            F.lit("sms").alias("source"), F.col("event_type").alias("channel"),
            F.lit("message").alias("kind"), F.col("props").alias("text"),
            F.col("ts").alias("created_at"), contact.alias("contact"),
            F.array(F.lit("Me"), contact).alias("participants"),
            (F.col("event_id") % 2 == 0).alias("is_user_message"))

    def chats(self) -> DataFrame:
        return self.raw("conversations").select(
            F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
            .alias("external_id"), self.owner("conv_id"), F.lit("llm_chat").alias("source"),
            F.lit("message").alias("kind"), "text", "role",
            (F.col("role") == "user").alias("is_user_message"), "conv_id", "turn",
            (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
            F.lit(None).cast("timestamp").alias("created_at"))

    def pages(self) -> DataFrame:
        return self.raw("pages").select("page_id", self.owner("page_id"), "url", "html")

    def timeline(self) -> DataFrame:
        """Messages, chat turns and page visits as one event table."""
        none = F.lit(None)
        cols = ["owner_id", "source", "kind", "text", "created_at", "channel", "is_user_message",
                "contact", "participants", "url", "seq"]
        msg = self.messages().withColumn("url", none.cast("string"))
        chat = (
            self.chats().withColumn("channel", F.lit("chat"))
            .withColumn("contact", none.cast("string"))
            .withColumn("participants", none.cast("array<string>"))
            .withColumn("url", none.cast("string"))
            .withColumn("seq", F.col("seq") + 1_000_000_000)
        )
        visit = self._dated("pages", "page_id").select(
            self.owner("page_id"), F.lit("chrome").alias("source"), F.lit("message").alias("kind"),
            F.col("url").alias("text"), F.col("ts").alias("created_at"),
            F.lit("chrome_history").alias("channel"), none.cast("boolean").alias("is_user_message"),
            none.cast("string").alias("contact"), none.cast("array<string>").alias("participants"),
            "url", (F.col("page_id") + 2_000_000_000).alias("seq"))
        return msg.select(cols).unionByName(chat.select(cols)).unionByName(visit.select(cols))
