"""Ranked subsets, duplicates and budgets that stay even when one group holds a third of the rows.

A window over a hot group would put the whole group into one task. Every operator here either cuts
the group down before the window sees it, or works on a per-group summary.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.session import shared_dir

SALTS = 64
# One short row per owner: a million of them are some tens of megabytes.
MAX_OWNERS = 1_000_000


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """The first k rows of each group, with their rank.

    Round one ranks within (group, salt), round two ranks the at most ``salts * k`` survivors of a
    group. Spark adds a local limit before each shuffle, so a hot group never travels whole.
    ``order`` has to end in a unique key.
    """
    if not keys:
        best = df.orderBy(*order).limit(k)
        return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if _hashable(df, c)]), F.lit(salts))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_local", F.row_number().over(local)).filter(F.col("_local") <= k)
        .drop("_salt", "_local")
        .withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)
        .withColumn(rank, F.col(rank).cast("long"))
    )


def rank_all(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Every row with its rank in its group.

    Rows are range partitioned by group and order, so a hot group spreads over many tasks; a rank is the place in the
    partition plus the group's rows in earlier ones. The sorted rows are written to the shared folder, since ranges
    are sampled and both readers have to see the same ones. ``order`` has to end in a unique key.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ranked-{uuid.uuid4().hex}"
    by = [*[F.asc(c) for c in keys], *order]
    # The upper bits of a number are the partition's, the lower 33 the place in it.
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    spans = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = spans.select(F.col("_part").alias("_of"), *[F.col(c).alias(f"_key_{c}") for c in keys],
                        (F.coalesce(earlier, F.lit(0)) - F.col("_first") + 1).alias("_base"))
    same = F.col("_part") == F.col("_of")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return rows.join(base, same).select(*df.columns, (F.col("_base") + F.col("_at")).cast("long").alias(rank))


def bounded_lists(df: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str, size: int = 500) -> DataFrame:
    """Rows of each group as lists of about ``size`` entries, several rows where one is not enough.

    A hash deals the rows of a group to as many lists as its count asks for, so no task sees a whole group.
    """
    lists = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("_lists"))
    return (
        df.join(lists, list(keys)).withColumn("_list", F.pmod(F.xxhash64(*fields), F.col("_lists"))).groupBy(*keys, "_list")
        .agg(F.collect_list(F.struct(*fields)).alias(name)).drop("_list")
    )


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a table for broadcast if counting finds it small, so the other side need not shuffle.

    A larger table joins by shuffle, where AQE splits hot keys. Rows have to be of bounded width.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def _hashable(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in (
        "string", "long", "integer", "double", "timestamp", "boolean", "date")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order.

    The limit of one is applied before the shuffle: a task sends at most one copy of a key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_copy", F.row_number().over(w)).filter(F.col("_copy") == 1).drop("_copy")
    )


def top_counts(
    df: DataFrame, group: Sequence[str], item: str, k: int, count: str = "count"
) -> DataFrame:
    """The k most frequent items of each group; equal counts by item."""
    counted = df.groupBy(*group, item).agg(F.count(F.lit(1)).alias(count))
    return top_k(counted, group, [F.desc(count), F.asc(item)], k)


def dedupe_ranked(
    df: DataFrame, keys: Sequence[str], text_key: Column, order: Sequence[Column],
    k: int, rank: str = "rank",
) -> DataFrame:
    """Drop later copies of a text within a group, then keep the first k."""
    tagged = df.withColumn("_text_key", F.md5(text_key))
    return top_k(keep_first(tagged, [*keys, "_text_key"], order).drop("_text_key"),
                 keys, order, k, rank)


def within_budget(
    df: DataFrame, keys: Sequence[str], cost: Column, budget: Column | int,
    order: Sequence[Column], max_budget: int,
) -> DataFrame:
    """Rows in order while their running cost stays within the budget.

    Every row costs at least one, so no more than ``max_budget`` rows of a group can stay; the rest
    is cut before the running sum. A row over the budget ends the group: costs are positive, so the
    sum stays over from there on.
    """
    priced = df.withColumn("cost", F.greatest(F.lit(1), cost).cast("long"))
    head = top_k(priced, keys, order, max_budget, rank="_position")
    run = Window.partitionBy(*keys).orderBy("_position").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return (
        head.withColumn("running_cost", F.sum("cost").over(run))
        .filter(F.col("running_cost") <= limit).drop("_position")
    )


def first_last_longest(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], length: Column,
    first: int, last: int, longest: int,
) -> DataFrame:
    """First, last and longest rows of each group; column ``picked`` gives the selection order.

    The three ranks are taken side by side, so the rows are computed once, and a group is salted as in ``top_k``: a salt
    passes on no row that none of its ranks wants.
    """
    up = [F.asc(c) for c in order]
    down = [F.desc(c) for c in order]
    picks = [("_head", up, first), ("_tail", down, last), ("_size", [F.desc("_length"), *up], longest)]

    def ranked(rows: DataFrame, *salt: str) -> DataFrame:
        for name, by, _ in picks:
            rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys, *salt).orderBy(*by)))
        wanted = F.lit(False)
        for name, _, n in picks:
            wanted = wanted | (F.col(name) <= n)
        return rows.filter(wanted)

    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if _hashable(df, c)]), F.lit(SALTS))
    sized = df.withColumn("_length", length).withColumn("_salt", salt)
    few = ranked(ranked(sized, "_salt").drop("_head", "_tail", "_size", "_salt"))
    places = F.array(
        F.when(F.col("_head") <= first, F.col("_head")),
        F.when(F.col("_tail") <= last, F.lit(first + last + 1) - F.col("_tail")),
        F.when(F.col("_size") <= longest, F.lit(first + last) + F.col("_size")))
    return few.withColumn("picked", F.explode(F.array_compact(places.cast("array<bigint>")))).select(*df.columns, "picked")
