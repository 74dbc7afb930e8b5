"""Direct messages and comments of a photo network's export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.text import strip
from keepsake.sources.files import counts_here, elements_before, parsed


def _ms(c: Column) -> Column:
    return F.when(c != 0, F.timestamp_millis(c.cast("long")))


def messages(raw: DataFrame, owner_name: str | None = None) -> DataFrame:
    """Events of ``message_*.json`` files. The conversation is named by the folder.

    Everybody but the network's own senders counts as the owner unless ``owner_name`` is given.
    """
    doc = F.col("doc")
    names = F.filter(F.try_variant_get(doc, "$.participants", "array<struct<name:string>>")["name"],
                     lambda n: n.isNotNull())
    folder = F.replace(F.element_at(F.split("path", "/"), -2), F.lit("_"), F.lit(" "))
    rows = (
        parsed(raw).filter(F.lower(F.element_at(F.split("path", "/"), -1)).rlike(r"^message_.*\.json$")
                           & counts_here("messages"))
        .select("owner_id", F.coalesce(names, F.array().cast("array<string>")).alias("people"),
                folder.alias("folder"), elements_before("messages").alias("base"), F.posexplode(
                    F.try_variant_get(doc, "$.messages", "array<variant>")).alias("seq", "m"))
        .select("owner_id", "people", "folder", (F.col("seq") + F.col("base")).alias("seq"),
                F.try_variant_get("m", "$.sender_name", "string").alias("sender"),
                F.try_variant_get("m", "$.timestamp_ms", "double").alias("ms"),
                F.coalesce(F.try_variant_get("m", "$.content", "string"), F.lit("")).alias("text"))
        .filter(strip("text") != "")
    )
    low = F.lower("sender")
    if owner_name is not None:
        mine = low == owner_name.lower()
    else:
        mine = (F.size("people") > 0) & ~F.contains(low, F.lit("meta ai")) & ~F.contains(
            low, F.lit("instagram"))
    return rows.select(
        "owner_id", F.lit("instagram").alias("source"), F.lit("message").alias("kind"),
        "text", _ms(F.col("ms")).alias("created_at"),
        F.when(F.size("people") > 0, F.col("people")).alias("participants"),
        F.lit("dm").alias("channel"), F.coalesce((F.col("sender") != "") & mine, F.lit(False))
        .alias("is_user_message"), F.col("folder").alias("contact_name"),
        F.col("sender").alias("sender_name"), "seq")


ENTRY = "struct<value:string,timestamp:double,href:string>"


def _numbered(first: Column):
    return lambda c, i: F.struct((first + i).alias("seq"), c.alias("c"))


def comments(raw: DataFrame) -> DataFrame:
    """The owner's comments, from any of three lists and two spellings of the keys."""
    doc = F.col("doc")
    keys = ("comments_media_comments", "comments", "media_comments")
    none = F.array().cast("array<struct<seq:bigint,c:variant>>")
    lists, earlier = [], F.lit(0).cast("long")
    for k in keys:
        found = F.try_variant_get(doc, f"$.{k}", "array<variant>")
        before = earlier + elements_before(k)
        numbered = F.transform(found, _numbered(before))
        lists.append(F.coalesce(F.when(counts_here(k), numbered), none))
        # Lists follow each other; of a cut document the whole lists count.
        earlier = earlier + F.coalesce(F.col("counts")[k], F.size(found).cast("long"), F.lit(0))
    rows = parsed(raw).filter(F.lower(F.element_at(F.split("path", "/"), -1)).rlike(
        r"comment.*\.json$")).select("owner_id", F.explode(F.flatten(F.array(*lists))).alias("e")).select("owner_id", "e.seq", "e.c")

    def entry(name: str) -> Column:
        return F.coalesce(*[F.try_variant_get("c", f"$.string_map_data.{k}", ENTRY)
                            for k in (name.title(), name)])

    said, title = F.col("said"), F.col("title")
    shaped = rows.select("owner_id", F.col("seq").cast("long").alias("seq"),
                         entry("comment").alias("said"), entry("title").alias("title"))
    return shaped.filter(strip(F.coalesce(said["value"], F.lit(""))) != "").select(
        "owner_id", F.lit("instagram").alias("source"), F.lit("comment").alias("kind"),
        said["value"].alias("text"), _ms(said["timestamp"] * 1000).alias("created_at"),
        F.lit("comment").alias("channel"), F.lit(True).alias("is_user_message"),
        said["href"].alias("url"),
        F.create_map(F.lit("postTitle"), title["value"]).alias("metadata"), "seq")
