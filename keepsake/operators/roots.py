"""Roots of names that link to each other, by pointer jumping in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.operators.term_index import stored


def roots(names: DataFrame, links: DataFrame) -> DataFrame:
    """(owner_id, name, root): names joined by links, in either direction and over any number, share a root.

    ``names``: owner_id, name (unique), place (an orderable value); ``links``: owner_id, name, other. The root is
    the name of the smallest (place, name) of its group. In a round every name takes the smallest root that a
    neighbour points to, and then the root of that root, so the rounds grow with the logarithm of the longest chain.
    Each round is a table in the shared folder. Names without links are their own roots and take no part.
    """
    both = links.select("owner_id", "name", "other").unionByName(
        links.select("owner_id", F.col("other").alias("name"), F.col("name").alias("other"))).filter("name <> other")
    both = stored(both.distinct(), "links")
    own = names.join(both.select("owner_id", "name").distinct(), ["owner_id", "name"], "left_semi")
    # A pointer is the (place, name) of a root, so that the smaller of two can be told.
    state = stored(own.select("owner_id", "name", F.struct("place", "name").alias("at")), "roots")
    while True:
        near = both.join(state.select("owner_id", F.col("name").alias("other"), "at"), ["owner_id", "other"])
        least = near.groupBy("owner_id", "name").agg(F.min("at").alias("near"))
        moved = state.join(least, ["owner_id", "name"]).select(
            "owner_id", "name", F.col("at").alias("was"), F.least("at", "near").alias("at"))
        # What a name points to points on.
        hop = moved.select("owner_id", F.col("name").alias("_to"), F.col("at").alias("then"))
        jumped = moved.withColumn("_to", F.col("at.name")).join(hop, ["owner_id", "_to"]).select(
            "owner_id", "name", "was", F.least("at", "then").alias("at"))
        state = stored(jumped, "roots")
        if not state.filter("was <> at").limit(1).count():
            break
        state = state.drop("was")
    linked = state.select("owner_id", "name", F.col("at.name").alias("root"))
    return names.select("owner_id", "name").join(linked, ["owner_id", "name"], "left").select(
        "owner_id", "name", F.coalesce("root", "name").alias("root"))
