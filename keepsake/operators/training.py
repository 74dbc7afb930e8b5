"""The owner's own writing as a training set: slices, quality, score, order, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions.text import clip, count_matches, let, strip
from keepsake.operators.corpus import titled
from keepsake.operators.ranking import rank_all, top_k
from keepsake.operators.term_index import stored

OWNER = ["owner_id"]
#: Rows that are looked at together when batches are closed.
SLOT = 4096


def is_quality(text: Column | str, min_length: int = 50) -> Column:
    """Long enough, five words, not mostly links, not mostly emoji."""
    c = F.col(text) if isinstance(text, str) else text
    words = F.size(F.split(c, r"\s+"))
    links = count_matches(c, "https?://")
    emoji = count_matches(c, r"[\x{1F300}-\x{1F9FF}]")
    return (
        (F.length(c) >= min_length) & (words >= 5) & ~((links > 3) & (F.length(c) < 200))
        & ~(emoji > words / 3)
    )


def content_score(text: Column | str, votes: Column | str) -> Column:
    """Length band, votes up to 20 points, a sentence mark."""
    c = F.col(text) if isinstance(text, str) else text
    v = F.col(votes) if isinstance(votes, str) else votes
    n = F.length(c)
    return (
        F.when((n >= 50) & (n <= 500), 10.0).when(n >= 30, 5.0).otherwise(0.0)
        + F.least(v / 10, F.lit(20.0)) + F.when(c.rlike("[.?!]"), 5.0).otherwise(0.0)
    )


def outbound_slices(comments: DataFrame, posts: DataFrame, events: DataFrame,
                    min_length: int = 50) -> DataFrame:
    """Everything the owner wrote, by slice, of training quality."""
    def part(df: DataFrame, slice_: Column, text: Column, score: Column) -> DataFrame:
        return df.select("owner_id", "seq", slice_.alias("slice"), strip(text).alias("text"),
                         F.coalesce(score, F.lit(0.0)).alias("score"))

    mine = F.coalesce("is_user_message", F.lit(False))
    source, kind = F.col("source"), F.col("kind")
    label = (
        F.when((source == "sms") & mine, "sms_messages")
        .when((source == "instagram") & (kind == "message") & mine, "instagram_messages")
        .when((source == "instagram") & (kind == "comment"), "instagram_comments")
        .when((source == "llm_chat") & mine, "llm_chat_messages")
        .when((source == "gmail") & mine, "gmail_sent"))
    told = events.withColumn("_slice", label).filter("_slice IS NOT NULL")
    rows = (
        part(comments, F.lit("reddit_comments"), F.coalesce("body", F.lit("")), F.col("score"))
        .unionByName(part(posts, F.lit("reddit_posts"), titled(), F.col("score")))
        .unionByName(part(told, F.col("_slice"), F.coalesce("text", F.lit("")), F.lit(0.0)))
    )
    return rows.filter((F.col("text") != "") & is_quality("text", min_length))


SLICES = ("sms_messages", "instagram_messages", "instagram_comments", "llm_chat_messages")


def source_counts(comments: DataFrame, posts: DataFrame, slices: DataFrame) -> DataFrame:
    """Forum rows as they are, and quality rows of the other slices."""
    labels = (
        comments.select("owner_id", F.lit("all_comments").alias("slice"))
        .unionByName(posts.select("owner_id", F.lit("all_posts").alias("slice")))
        .unionByName(slices.select("owner_id", "slice"))
    )
    return labels.groupBy("owner_id").agg(
        F.count_if(F.col("slice") == "all_comments").alias("reddit_comments"),
        F.count_if(F.col("slice") == "all_posts").alias("reddit_posts"),
        *[F.count_if(F.col("slice") == s).alias(s) for s in SLICES])


def training_set(slices: DataFrame, most: int | None = None) -> DataFrame:
    """The best items of each owner, in order; all of them unless ``most`` is given.

    With ``most``, numbers of items are ranked: only the texts of the best are joined, none is shuffled to be ranked.
    """
    scored = slices.withColumn("quality", content_score("text", "score"))
    order = [F.desc("quality"), F.desc("score"), F.asc("slice"), F.asc("seq")]
    if most is None:
        return rank_all(scored, OWNER, order)
    rows = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    best = top_k(rows.select("_row", "owner_id", "quality", "score", "slice", "seq"), OWNER, order, most)
    return stored(stored(best.select("_row", "rank"), "ranks").join(rows, "_row").select(*scored.columns, "rank"), "best")


def pack(ranked: DataFrame, max_items: int = 30, max_chars: int = 16_000, item_chars: int | None = None,
         separator: int = 7, slot: int = SLOT) -> DataFrame:
    """Batch numbers for ranked texts: close a batch when items or characters would pass the cap.

    Where a batch that opens at a row ends, only the next ``max_items`` rows decide. So rows are dealt by their
    place into slots, which the first rows of the next slot overlap; inside a slot pointers to the next opening row are
    doubled until they leave it, and a slot becomes a map from the few rows at which it can be entered to those of the next one.
    Maps of neighbouring slots are doubled too, which gives every slot its entry and the batches before it. No task
    holds more than a slot, whoever owns the rows. Blank texts are left out; null is an owner like others.
    """
    if slot < max_items:
        raise ValueError("a batch has to end in the next slot at the latest")
    text = strip("text")
    sized = ranked.withColumn("text", text if item_chars is None else clip(text, item_chars)).filter("text <> ''")
    lengths = sized.select("owner_id", "rank", F.length("text").cast("long").alias("chars"))
    slots = stored(_slots(rank_all(lengths, OWNER, [F.asc("rank")], "_at"), max_items, max_chars, separator, slot), "slots")
    opened = slots.join(_entries(slots), _same("_owner", "_number")).select(
        "owner_id", "_slot", "rows", "next", "_batch", "_entry")
    # The rows of the slot that open a batch: from the entry on, each row points at the next.
    walk = F.aggregate(F.sequence(F.lit(1), F.size("next")), F.array("_entry"), lambda seen, _: F.when(
        F.element_at(seen, -1) < F.size("next"), F.concat(seen, F.array(F.get("next", F.element_at(seen, -1))))).otherwise(seen))
    batches = opened.withColumn("opens", walk).select(
        "owner_id", "rows", F.posexplode(F.slice("opens", 1, F.size("opens") - 1)).alias("_nth", "_from"),
        "opens", "_batch").select("owner_id", (F.col("_batch") + F.col("_nth")).alias("batch"), F.explode(F.slice(
            "rows", F.col("_from") + 1, F.get("opens", F.col("_nth") + 1) - F.col("_from"))).alias("_rank"))
    batches = batches.withColumnRenamed("owner_id", "_owner")
    here = F.col("owner_id").eqNullSafe(F.col("_owner")) & (F.col("rank") == F.col("_rank"))
    return sized.join(batches, here).drop("_owner", "_rank")


def _same(owner: str, slot: str) -> Column:
    return F.col("owner_id").eqNullSafe(F.col(owner)) & (F.col("_slot") == F.col(slot))


def _slots(placed: DataFrame, max_items: int, max_chars: int, separator: int, slot: int) -> DataFrame:
    """One row a slot: ranks of its rows (and of those that overlap), for each own row the place of the row that opens the
    next batch, and for the first rows where a walk from there leaves the slot, and after how many batches."""
    at = F.col("_at") - 1
    own = F.floor(at / slot)
    both = F.when((at % slot < max_items) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    window = Window.partitionBy("owner_id", "_slot").orderBy("_at")
    rows = placed.select("owner_id", "rank", "_at", "chars", F.explode(both).alias("_slot")).withColumn(
        "_sum", F.sum(F.col("chars") + separator).over(window))
    held = rows.groupBy("owner_id", "_slot").agg(F.array_sort(F.collect_list(F.struct("_at", "_sum", "chars", "rank"))).alias("_rows"))
    inside = F.least(F.size("_rows"), F.lit(slot))
    held = held.select("owner_id", "_slot", F.transform("_rows", lambda r: r["rank"]).alias("rows"), inside.alias("_own"),
                       F.transform("_rows", lambda r: r["_sum"]).alias("_sums"), F.slice("_rows", 1, inside).alias("_rows"))

    def following(r: Column, i: Column) -> Column:
        limit = r["_sum"] - r["chars"] + max_chars
        fits = F.size(F.filter(F.slice("_sums", i + 1, max_items), lambda x: x <= limit))
        return i + F.greatest(F.lit(1), fits)

    held = held.withColumn("next", F.transform("_rows", following))
    jumps = F.transform("next", lambda n: F.struct(n.alias("to"), F.lit(1).cast("long").alias("n")))

    def twice(jump: Column) -> Column:
        def on(j: Column) -> Column:
            then = F.get(jump, j["to"])
            return F.when(j["to"] >= F.col("_own"), j).otherwise(
                F.struct(then["to"].alias("to"), (j["n"] + then["n"]).alias("n")))
        return F.transform(jump, on)

    for _ in range((slot - 1).bit_length()):
        jumps = let(jumps, twice)
    leave = F.transform(jumps, lambda j: F.struct((j["to"] - F.col("_own")).alias("to"), j["n"].alias("n")))
    return held.withColumn("leave", F.slice(leave, 1, max_items)).select("owner_id", "_slot", "rows", "next", "leave")


def _entries(slots: DataFrame) -> DataFrame:
    """(_owner, _number, _entry, _batch): where the batches of an owner enter each of its slots, and how many lie before."""
    maps = slots.select(F.col("owner_id").alias("_owner"), F.col("_slot").alias("_number"), "leave")
    known = maps.filter("_number = 0").select("_owner", "_number", F.lit(0).alias("_entry"), F.lit(0).cast("long").alias("_batch"))
    last, step = maps.agg(F.max("_number")).first()[0] or 0, 1
    while step <= last:
        # ``maps`` leads over ``step`` slots; entries are known of as many.
        exits = F.get("leave", F.col("_entry"))
        on = maps.withColumnsRenamed({"_owner": "owner_id", "_number": "_slot"})
        further = known.join(on, _same("_owner", "_number")).select(
            "_owner", (F.col("_number") + step).alias("_number"), exits["to"].alias("_entry"),
            (F.col("_batch") + exits["n"]).alias("_batch")).filter(F.col("_entry").isNotNull())
        known = stored(known.unionByName(further), "entries")
        then = maps.select(F.col("_owner").alias("owner_id"), (F.col("_number") - step).alias("_slot"), F.col("leave").alias("_then"))
        joined = F.transform("leave", lambda a: F.struct(
            F.get("_then", a["to"])["to"].alias("to"), (a["n"] + F.get("_then", a["to"])["n"]).alias("n")))
        maps = stored(maps.join(then, _same("_owner", "_number")).select("_owner", "_number", joined.alias("leave")), "maps")
        step *= 2
    return known
