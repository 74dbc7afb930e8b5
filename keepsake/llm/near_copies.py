"""Near-duplicate documents by min-max hashing.

Each permutation of the shingles gives two samples, its smallest and its largest value, so a signature of 2p values takes p
hash evaluations a shingle. Bands of the signature put documents that may be alike into buckets; links are confirmed
on the full shingle sets. Texts with equal sets form a class first, so copies cost nothing further. Then each member of a bucket is
compared with its smallest one, which settles most buckets. In the others no pairs are listed: some members, the centres, are
compared with those of other components, links join components, and centres retire from the bucket once compared with all. Pairs that cannot link, by how many shingles
each part of the hash can have in common, are not compared. A bucket is done when all members but those of one component have
been centres, which is as complete as comparing all pairs and costs a group of near copies one comparison a member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import passed, text_bytes, written
from keepsake.llm.components import components
from keepsake.llm.shingles import mixed, sets_of

#: Bands, and permutations of a band: with 6 values a band, a pair of similarity 0.8 shares none of 40 bands with
#: probability (1 - 0.8 ** 6) ** 40 = 5e-6.
BANDS, PERMUTATIONS = 40, 3
#: Centres of a bucket in the first round; eight times as many in each later one.
CENTRES = 64
#: Parts of the shingle hash by which common shingles are bounded.
PARTS = 64


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(values: np.ndarray, count: np.ndarray, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each set (none empty) under each permutation."""
    begin = np.cumsum(count) - count
    low = np.empty((len(count), permutations), np.uint64)
    high = np.empty_like(low)
    times, plus = _odd(5, permutations), _odd(6, permutations)
    turned = np.empty_like(values)
    for p in range(permutations):
        np.multiply(values, times[p], out=turned)
        turned += plus[p]
        low[:, p] = np.minimum.reduceat(turned, begin)
        high[:, p] = np.maximum.reduceat(turned, begin)
    return low, high


def bands(values: np.ndarray, count: np.ndarray, number: int, permutations: int) -> np.ndarray:
    """One 64-bit key for each set and band, of the band's smallest and largest values."""
    low, high = signatures(values, count, number * permutations)
    key = np.tile(np.arange(1, number + 1, dtype=np.uint64), (len(count), 1))
    for p in range(permutations):
        for side in (low, high):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + side[:, p::permutations])
    return key


def sketches(docs: DataFrame, k: int, number: int = BANDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a 128-bit hash of the set), keys (null for an empty set)."""
    def sketch(t: pa.Table) -> pa.Table:
        data, starts = text_bytes(t.column("text"))
        n, a, b, keys = (np.zeros(len(t), np.int64), np.zeros(len(t), np.uint64), np.zeros(len(t), np.uint64),
                         np.zeros((len(t), number), np.uint64))
        for i, j, values, count in sets_of(data, starts, k):
            n[i:j] = count
            full = np.flatnonzero(count)
            if not len(full):
                continue
            begin = (np.cumsum(count) - count)[full]
            a[i + full] = np.add.reduceat(mixed(values), begin)
            b[i + full] = np.add.reduceat(mixed(values ^ np.uint64(0x5851F42D4C957F2D)), begin)
            keys[i + full] = bands(values, count[full], number, permutations)
        return pa.table({
            "doc_id": t.column("doc_id"), "n_shingles": pa.array(n), "set_a": pa.array(a.view(np.int64)),
            "set_b": pa.array(b.view(np.int64)), "keys": pa.ListArray.from_arrays(
                pa.array(np.arange(len(t) + 1, dtype=np.int32) * number), pa.array(keys.view(np.int64).ravel()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = passed(rows, sketch, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>")
    return made.withColumn("keys", F.when(F.col("n_shingles") > 0, F.col("keys")))


def set_table(docs: DataFrame, k: int) -> DataFrame:
    """(id, hashes): the sorted shingles of each text, eight bytes each."""
    def shingled(t: pa.Table) -> pa.Table:
        made = []
        for i, j, values, count in sets_of(*text_bytes(t.column("text")), k):
            ends = np.append(0, np.cumsum(count))
            made += [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        return pa.table({"id": t.column("id"), "hashes": pa.array(made, pa.binary())})

    return passed(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), shingled, "id long, hashes binary")


def _hashes(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for c in column.chunks for x in c]


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets reach the similarity: 100 * common >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("right"))

    def compare(t: pa.Table) -> pa.Table:
        alike = []
        for x, y in zip(_hashes(t.column("left")), _hashes(t.column("right"))):
            common = len(np.intersect1d(x, y, assume_unique=True))
            alike.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
        return t.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return passed(pairs.select("a", "b").join(left, "a").join(right, "b"), compare, "a long, b long")


def shared_shingles(sets: DataFrame) -> DataFrame:
    """(rep, shared): in how many shingles, by PARTS parts of their hash, a document is not alone among these.

    Ids with several rows are left out.
    """
    once = sets.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows = 1").select("id")
    sets = sets.join(once, "id", "left_semi")

    def spread(t: pa.Table) -> pa.Table:
        lists = _hashes(t.column("hashes"))
        ids = t.column("id").combine_chunks().take(pa.array(np.repeat(np.arange(len(t)), [len(x) for x in lists])))
        return pa.table({"rep": ids, "shingle": pa.array(np.concatenate([*lists, np.zeros(0, np.uint64)]).view(np.int64))})

    def count_parts(t: pa.Table) -> pa.Table:
        every = [np.bincount((x & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS) for x in _hashes(t.column("hashes"))]
        return pa.table({"rep": t.column("id"), "every": pa.ListArray.from_arrays(
            pa.array(np.arange(len(t) + 1, dtype=np.int32) * PARTS),
            pa.array(np.concatenate([*every, np.zeros(0, np.int64)]).astype(np.int32)))})

    alone = passed(sets, spread, "rep long, shingle long").groupBy("shingle").agg(
        F.count(F.lit(1)).alias("times"), F.min("rep").alias("rep")).filter("times = 1")
    part = F.col("shingle").bitwiseAND(F.lit(PARTS - 1)).cast("int").alias("part")
    alone = alone.groupBy("rep", part).agg(F.count(F.lit(1)).cast("int").alias("n")).groupBy("rep").agg(
        F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("alone"))
    return passed(sets, count_parts, "rep long, every array<int>").join(alone, "rep", "left").select("rep", F.transform(
        "every", lambda x, i: x - F.coalesce(F.try_element_at("alone", i), F.lit(0))).alias("shared"))


def may_link(n: Column, shared: Column, other_n: Column, other_shared: Column, percent: int) -> Column:
    """Whether two sets can reach the similarity: in no part have they more in common than the smaller number there."""
    parts = F.aggregate(F.zip_with(shared, other_shared, lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
    most = F.least(n, other_n, F.coalesce(parts, n))
    return 100 * most >= percent * (n + other_n - most)


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups (id, component) after more links. What is known is contracted first: only links between groups are followed."""
    def of(side: str) -> DataFrame:
        return groups.select(F.col("id").alias(side), F.col("component").alias(f"{side}_group"))

    a, b = F.coalesce("a_group", "a"), F.coalesce("b_group", "b")
    between = written(links.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(a != b).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "between")
    if not between.limit(1).count():
        return groups
    tops = written(components(between), "tops")
    moved = groups.join(tops.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select(
        "id", F.coalesce("top", "component").alias("component"))
    return written(moved.unionByName(tops.join(groups, "id", "left_anti")), "groups")


def near_copies(docs: DataFrame, k: int = 5, percent: int = 80, number: int = BANDS,
                permutations: int = PERMUTATIONS, centres: int = CENTRES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id is that id): one row per row of ``docs``.

    Sets are distinct k-word shingles (words: ``[^\\x20\\x09-\\x0D]+``, A-Z lowered; fewer words: all as one). A null
    or empty text has an empty set and is linked with nothing. Rows of one id count as one document, linked
    by any of its texts. Rows without id are linked with nothing, have no component, and are kept.
    """
    sketched = written(sketches(docs, k, number, permutations), "sketches")
    named = sketched.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    same_set = ["set_a", "set_b", "n_shingles"]
    # Written, so that the join below has exchanges on both sides and a large class of copies is split.
    classes = written(named.groupBy(*same_set).agg(F.min("doc_id").alias("rep")), "classes")
    member = written(named.join(classes, same_set).select(
        "doc_id", "rep", F.col("n_shingles").alias("n"), F.when(F.col("doc_id") == F.col("rep"), F.col("keys")).alias("keys")),
        "members")
    placed = member.filter(F.col("keys").isNotNull()).select(F.explode("keys").alias("key"), "rep", "n")
    # Of each key that several documents have: the smallest id, and how large its sets are.
    shared_keys = written(placed.groupBy("key").agg(
        F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.min(F.struct("rep", "n"))["n"].alias("n_least"),
        F.max(F.struct((-F.col("rep")).alias("rep"), "n"))["n"].alias("n_most")).filter(F.col("lo") < F.col("hi")).drop("hi"), "keys")
    buckets = written(placed.join(shared_keys, "key").distinct(), "buckets")
    # An id with texts of several classes links each of them to the one of the smallest id.
    several = member.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).filter(F.col("b") < F.col("last"))
    same_id = member.join(several.select("doc_id", "b"), "doc_id").filter(F.col("rep") != F.col("b")).select(
        F.col("rep").alias("a"), "b").distinct()
    wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(set_table(docs.join(wanted, docs["doc_id"].cast("long") == wanted["doc_id"], "left_semi"), k), "sets")

    # First each document with the smallest id of every of its buckets, if their sizes allow a link.
    fits = 100 * F.least("n", "n_most") >= percent * F.greatest("n", "n_least")
    tried = written(buckets.filter((F.col("rep") != F.col("lo")) & fits).select(
        F.col("lo").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = written(confirmed(tried, sets, percent).unionByName(same_id).distinct(), "links")
    groups = written(components(links), "groups")
    buckets = buckets.select("key", "rep", "n")
    shared: DataFrame | None = None
    while True:
        now = buckets.join(groups.withColumnRenamed("id", "rep"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep"))
        parts = now.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
        # Of each bucket that still holds several components: the largest of them.
        largest = parts.groupBy("key").agg(F.max(F.struct("members", "component")).alias("most"), F.count(F.lit(1)).alias("n_parts"))
        open_keys = largest.filter(F.col("n_parts") > 1).select("key", F.col("most.component").alias("largest"))
        still = written(now.join(open_keys, "key"), "open-buckets")
        if not still.limit(1).count():
            break
        if shared is None:
            # Partners stand in these buckets; shingles that no other document here has are common to no pair.
            rest = sets.join(still.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
            shared = written(shared_shingles(rest), "shared-shingles")
        known = still.join(shared, "rep", "left")
        part = F.pmod(F.xxhash64("rep"), F.lit(centres))
        chosen = written(known.filter(F.col("component") != F.col("largest")).groupBy("key", part.alias("part")).agg(
            F.min(F.struct("rep", "n", "shared", "component")).alias("c")).select(
            "key", F.col("c.rep").alias("c"), F.col("c.n").alias("c_n"), F.col("c.shared").alias("c_shared"),
            F.col("c.component").alias("c_component")), "centres")
        met = known.join(chosen, "key").filter(
            (F.col("component") != F.col("c_component"))
            & may_link(F.col("n"), F.col("shared"), F.col("c_n"), F.col("c_shared"), percent))
        new = written(met.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct().join(
            tried, ["a", "b"], "left_anti"), "pairs")
        if new.limit(1).count():
            tried = tried.unionByName(new)
            groups = joined(groups, confirmed(new, sets, percent))
        # Centres have met everybody in their bucket.
        buckets = written(still.select("key", "rep", "n").join(
            chosen.select("key", F.col("c").alias("rep")), ["key", "rep"], "left_anti"), "buckets")
        centres *= 8
    # Component of each id; an id with several classes has one, as the id links them.
    of_id = member.join(groups.withColumnRenamed("id", "rep"), "rep", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = sketched.select("doc_id", "n_shingles").join(of_id, "doc_id", "left").withColumn(
        "component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id",
                      (F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))
