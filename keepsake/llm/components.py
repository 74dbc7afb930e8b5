"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in links (a, b) the smallest id that it reaches.

    Large and small stars in turn: every id's larger neighbours, then its smaller ones, are linked to the smallest
    instead, until nothing changes. Links never grow in number; rounds grow with the logarithm of the longest path. Each round is a
    table in the shared folder. An id with very many links meets them in an aggregate and a join that splits.
    """
    links = written(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # v is larger than u: link it to the smallest of u's neighbourhood.
        large = links.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(
            F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.filter(F.col("u") != F.col("v")), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        ).select("x.u", "x.v").filter(F.col("u") != F.col("v")).distinct()
        small = written(small, "links")
        # Stars: every id has one link, and none leads on.
        ends = small.select(F.explode(F.array(
            F.struct(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")),
            F.struct(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")).select("e.*")
        again = ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter(
            (F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).limit(1).count()
        links = small
        if not again:
            break
    tops = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops)
