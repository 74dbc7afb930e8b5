"""Entities: resolution, merge, links, relevance.

An entity's list-valued parts live in tables of their own (aliases, attributes, sources, links), so an
entity mentioned in a third of all messages is a third of the rows of a table, never one row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.text import pieces_of, strip
from keepsake.operators.ranking import keep_first, top_k
from keepsake.operators.roots import roots
from keepsake.operators.term_index import stored

ENTITY = ["owner_id", "entity_id"]


def name_key(c: Column | str) -> Column:
    return F.lower(strip(c))


def new_id(owner: Column, name: Column) -> Column:
    """Same owner and name, same id: a repeated run creates no second entity."""
    return F.concat(F.lit("ent_"), F.md5(F.concat_ws("|", owner, name_key(name))))


def alias_index(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(owner_id, alias, entity_id)``; a name goes before an alias, a newer entity before an older.

    Aliases under two characters are not looked up.
    """
    names = entities.select(
        *ENTITY, name_key("canonical_name").alias("alias"), F.lit(0).alias("kind"))
    extra = aliases.select(*ENTITY, name_key("alias").alias("alias"), F.lit(1).alias("kind"))
    rows = names.unionByName(extra.filter(F.length("alias") >= 2)).filter("alias <> ''")
    return keep_first(rows, ["owner_id", "alias"], [F.asc("kind"), F.desc("entity_id")])


def resolve(incoming: DataFrame, index: DataFrame) -> DataFrame:
    """Incoming mentions with the entity they belong to.

    By name, else by the first alias that is known. Unknown mentions of one name become one entity; names whose first
    mention gives another new name as an alias become one with it, over any number of links and in any order of
    rows: their id is that of the name that was mentioned first. Numbers only order the mentions: equal ones, as of two
    imports, are told apart by what they name. The mentions are written once; all steps read them from there.
    """
    none = F.array().cast("array<string>")
    mentions = stored(incoming.withColumn("_said", F.md5(F.concat_ws(
        "\u0001", "canonical_name", F.coalesce("aliases", none)))).withColumn("_own", name_key("canonical_name")), "mentions")
    mention = ["owner_id", "seq", "_said"]
    probe = mentions.select(*mention, F.posexplode(F.concat(
        F.array("_own"), F.transform(F.coalesce("aliases", none), name_key))).alias("position", "alias"))
    probe = probe.filter((F.col("position") == 0) | (F.length("alias") >= 2)).filter("alias <> ''")
    known = stored(probe.join(index.drop("kind"), ["owner_id", "alias"]).groupBy(*mention).agg(
        F.min(F.struct("position", "entity_id"))["entity_id"].alias("stored_id")), "known")
    # The first mention of each new name, and what it is called besides.
    first = F.struct("seq", "_said", F.transform(F.coalesce("aliases", none), name_key).alias("aliases"))
    heads = stored(mentions.join(known, mention, "left_anti").groupBy("owner_id", F.col("_own").alias("name")).agg(
        F.min(first).alias("first")).select("owner_id", "name", F.struct("first.seq", "first._said").alias("place"),
                                            F.col("first.aliases").alias("aliases")), "heads")
    others = heads.select("owner_id", F.col("name").alias("other"))
    links = heads.select("owner_id", "name", F.posexplode("aliases").alias("position", "other")).filter(
        (F.length("other") >= 2) & (F.col("other") != F.col("name"))).join(others, ["owner_id", "other"])
    links = links.groupBy("owner_id", "name").agg(F.min(F.struct("position", "other"))["other"].alias("other"))
    root = roots(heads.select("owner_id", "name", "place"), links).withColumnRenamed("name", "_own")
    keyed = mentions.join(known, mention, "left").join(root, ["owner_id", "_own"], "left")
    made = new_id(F.col("owner_id"), F.coalesce("root", "_own"))
    return keyed.withColumn("entity_id", F.coalesce("stored_id", made)).withColumn(
        "is_new", F.col("stored_id").isNull()).drop("stored_id", "_own", "root", "_said")


def merge_entities(stored: DataFrame, resolved: DataFrame, now: Column) -> DataFrame:
    """Entity rows after the mentions: counts, confidence, times; stored name and type stay."""
    n = F.count(F.lit(1))
    heard = resolved.groupBy(*ENTITY).agg(
        n.alias("heard"), F.min_by("canonical_name", "seq").alias("new_name"),
        F.min_by("type", "seq").alias("new_type"),
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("new_status"))
    old = stored.select(*ENTITY, "type", "canonical_name", "mention_count", "confidence", "status",
                        "first_mentioned", "last_updated", "last_mentioned")
    joined = old.join(heard, ENTITY, "full_outer")
    mentions = F.coalesce("mention_count", F.lit(0)) + F.coalesce("heard", F.lit(0))
    touched = F.col("heard").isNotNull()
    raised = F.least(F.lit(0.95), F.lit(0.5) + mentions * 0.1)
    confidence = (
        F.when(~touched, F.col("confidence"))
        .when(F.col("mention_count").isNull() & (F.col("heard") == 1), F.lit(0.5)).otherwise(raised))
    # A new entity is active; a later mention of the same batch may say otherwise.
    return joined.select(
        *ENTITY, F.coalesce("type", "new_type").alias("type"),
        F.coalesce("canonical_name", "new_name").alias("canonical_name"),
        mentions.alias("mention_count"), confidence.alias("confidence"),
        F.coalesce("new_status", "status", F.lit("active")).alias("status"),
        F.coalesce("first_mentioned", now).alias("first_mentioned"),
        F.when(touched, now).otherwise(F.col("last_updated")).alias("last_updated"),
        F.when(touched, now).otherwise(F.col("last_mentioned")).alias("last_mentioned"))


def merge_aliases(stored: DataFrame, resolved: DataFrame) -> DataFrame:
    new = resolved.select(*ENTITY, F.explode("aliases").alias("alias"))
    return stored.select(*ENTITY, "alias").unionByName(new).filter("alias IS NOT NULL").distinct()


def merge_attributes(stored: DataFrame, resolved: DataFrame) -> DataFrame:
    """The latest value of each attribute."""
    new = resolved.select(*ENTITY, "seq", F.explode("attributes").alias("key", "value"))
    rows = stored.select(*ENTITY, F.lit(-1).cast("long").alias("seq"), "key", "value").unionByName(new)
    return rows.groupBy(*ENTITY, "key").agg(F.max_by("value", "seq").alias("value"))


def merge_sources(stored: DataFrame, resolved: DataFrame) -> DataFrame:
    """Sources without repeats of (source, date, context); the earliest record stays."""
    cols = ["source", "date", "context", "contact_name"]
    new = resolved.select(*ENTITY, "seq", *cols)
    rows = stored.select(*ENTITY, F.lit(-1).cast("long").alias("seq"), *cols).unionByName(new)
    keyed = rows.withColumn("_key", F.md5(F.concat_ws("|", "source", "date", "context")))
    return keep_first(keyed, [*ENTITY, "_key"], [F.asc("seq"), F.asc("contact_name")]).drop(
        "_key", "seq")


def link_entities(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both directions of every pair, once."""
    forth = pairs.select("owner_id", "src_id", "dst_id")
    back = pairs.select("owner_id", F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    return edges.select("owner_id", "src_id", "dst_id").unionByName(forth).unionByName(back).distinct()


def count_by_type(entities: DataFrame) -> DataFrame:
    return entities.groupBy("owner_id", "type").agg(F.count(F.lit(1)).alias("entities"))


def of_contact(sources: DataFrame) -> DataFrame:
    """Which entities were mentioned with which contact."""
    return sources.filter("contact_name IS NOT NULL").select(
        *ENTITY, F.col("contact_name").alias("contact")).distinct()


def delete_entities(tables: Mapping[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """All entity tables without the given ids."""
    ids = doomed.select(*ENTITY).distinct()
    return {name: df.join(ids, ENTITY, "left_anti") for name, df in tables.items()}


# --- Relevance ---------------------------------------------------------------------------------------

def relevant(entities: DataFrame, aliases: DataFrame, sources: DataFrame, asked: DataFrame,
             now: Column, k: int = 15) -> DataFrame:
    """The entities that matter to a request: named, aliased, known from the contact, recent, certain.

    Names and aliases meet the topic as its word runs in an equi-join when they are whole runs, which
    a substring of a topic need not be; so the topic's substrings of the lengths that names have are listed instead. Entities that
    are not named at all rank by what does not depend on the topic, and the best k of these suffice.
    ``asked``: owner_id, question_id, topic, contact (null for none).
    """
    ask = ["owner_id", "question_id"]
    active = entities.filter((F.col("status") == "active") & (F.col("confidence") >= 0.5))
    days = (F.unix_millis(now) - F.unix_millis("last_mentioned")) / 86_400_000
    based = active.select(
        *ENTITY, "type", "canonical_name", "last_mentioned",
        (F.when(days < 30, 2.0).otherwise(0.0) + F.col("confidence") * 2
         + F.least("mention_count", F.lit(5))).alias("base"))
    names = based.select(*ENTITY, F.lower("canonical_name").alias("piece"), F.lit(10).alias("points"))
    other = aliases.join(based.select(*ENTITY), ENTITY, "left_semi").select(
        *ENTITY, F.lower("alias").alias("piece"), F.lit(5).alias("points"))
    names = names.unionByName(other).filter("piece <> ''")
    named = _substrings(asked, names).join(names, ["owner_id", "piece"])
    from_contact = (
        asked.filter("contact IS NOT NULL").join(of_contact(sources), ["owner_id", "contact"])
        .select(*ask, "entity_id", F.lit(3).alias("points"))
    )
    # One point class counts once however many aliases fit.
    points = (
        named.select(*ask, "entity_id", "points").unionByName(from_contact).distinct()
        .groupBy(*ask, "entity_id").agg(F.sum("points").alias("points"))
    )
    hit = points.join(based, ENTITY)
    head = top_k(based, ["owner_id"], [F.desc("base"), F.asc("entity_id")], k, rank="_r").drop("_r")
    idle = (
        head.join(asked.select(*ask), "owner_id")
        .join(points.select(*ask, "entity_id"), [*ask, "entity_id"], "left_anti")
        .withColumn("points", F.lit(0).cast("long"))
    )
    scored = hit.unionByName(idle.select(hit.columns)).withColumn(
        "score", F.col("points") + F.col("base"))
    return top_k(scored.filter("score > 0"), ask, [F.desc("score"), F.asc("entity_id")], k).drop(
        "points", "base")


def _substrings(asked: DataFrame, names: DataFrame) -> DataFrame:
    """The substrings of each topic that are as long as some name (``piece``) of its owner."""
    lengths = names.groupBy("owner_id").agg(F.collect_set(F.length("piece")).alias("lengths"))
    return asked.join(lengths, "owner_id").select(
        "owner_id", "question_id", F.explode(pieces_of(F.lower("topic"), F.col("lengths"))).alias("piece")).distinct()


# Heading of a type and the attribute shown with it.
FACTS = {
    "person": ("People", ", ", "relationship", " (", ")"),
    "place": ("Places", ", ", "context", " - ", ""),
    "event": ("Events", ", ", "date", " (", ")"),
    "work": ("Work", ", ", "role", " as ", ""),
    "health": ("Health", ", ", None, "", ""),
    "hobby": ("Interests", ", ", None, "", ""),
    "relationship": ("Relationships", ", ", "partner", " with ", ""),
    "pet": ("Pets", ", ", "animalType", " (", ")"),
}


def facts(ranked: DataFrame, attributes: DataFrame) -> DataFrame:
    """Lines of known facts, one per type, from a request's ranked entities (15 at most)."""
    keys = ["owner_id", "question_id"]
    # Only what belongs to a ranked entity is gathered.
    wanted = attributes.join(ranked.select(*ENTITY).distinct(), ENTITY, "left_semi")
    attrs = wanted.groupBy(*ENTITY).agg(F.map_from_entries(
        F.collect_list(F.struct("key", "value"))).alias("attributes"))
    rows = ranked.join(attrs, ENTITY, "left")
    item, heading, order = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0)
    for i, (kind, (title, _, attr, before, after)) in enumerate(FACTS.items()):
        name = F.col("canonical_name")
        if kind == "relationship":
            name = F.coalesce(F.col("attributes")["status"], F.lit("undefined"))
        text = name if attr is None else F.concat(name, F.coalesce(F.concat(
            F.lit(before), F.nullif(F.col("attributes")[attr], F.lit("")), F.lit(after)), F.lit("")))
        is_kind = F.col("type") == kind
        item = F.when(is_kind, text).otherwise(item)
        heading = F.when(is_kind, title).otherwise(heading)
        order = F.when(is_kind, i).otherwise(order)
    shown = rows.withColumn("item", item).withColumn("heading", heading).withColumn(
        "line_no", order).filter("heading IS NOT NULL")
    listed = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"]), ", ")
    return shown.groupBy(*keys, "line_no", "heading").agg(listed.alias("items")).select(
        *keys, "line_no", F.concat(F.lit("- "), "heading", F.lit(": "), "items").alias("line"))
