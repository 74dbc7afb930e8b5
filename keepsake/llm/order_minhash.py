"""Order MinHash: fingerprints whose likeness follows the edit distance of texts.

The k-mers of a text (k words in a row) are numbered by occurrence, so repeats are elements of their own. Each order
begins at its own place of the circle of hash values: the two k-mers that come first from there on are its minimal ones,
are put back into text order, and are hashed as a tuple. In a long text the orders look at different k-mers; in a short one
they share them, so that every tuple has two and tells their order. Two texts agree in an order if the same k-mers
were selected and stand in the same order in the text. Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import written

#: Words of a k-mer; log2 of the number of orders, whose places part the circle of hash values into bins.
K, BIN_BITS = 2, 6
# Words without white space between them: single characters of these scripts, else at most 16 characters.
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
WORD = rf"[{_ALONE}]|[^\x20\x09-\x0D{_ALONE}]{{1,16}}"
_PLACE = 30
_LOW = (1 << _PLACE) - 1
#: Bits of a tuple's hash in a fingerprint; with the bin's they fit a 32-bit number.
HASH_BITS = 25


def _packed(hashed: Column, place: Column) -> Column:
    """The hash's upper 34 bits and a place in the text, as one number that sorts by the hash."""
    return hashed.bitwiseAND(F.lit(~_LOW)).bitwiseOR(place)


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = K, bits: int = BIN_BITS) -> DataFrame:
    """Adds ``name``: an ascending array of integers, one an order: its number (upper bits) and the hash of its tuple.

    A null text or one without words gets an empty array; with fewer than ``k`` words all are one k-mer, which
    is the whole tuple where a text has no second.
    """
    w, h, s, b, t, e = (f"_{x}_{name}" for x in "whsbte")
    kept = df.columns
    none = F.array().cast("array<bigint>")
    df = df.withColumn(w, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)))
    size = F.size(w)

    def kmer(i: Column) -> Column:
        return F.xxhash64(*[F.get(F.col(w), i + j) for j in range(k)])

    df = df.withColumn(h, F.when(size > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(size - k, F.lit(0))), kmer)).otherwise(none))
    df = df.withColumn(s, F.sort_array(F.transform(h, lambda x, i: _packed(x, i.cast("long")))))

    def item(array: str, i: Column) -> Column:
        return F.get(F.col(array), i)

    # Runs of equal k-mers, by where they begin.
    df = df.withColumn(b, F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i >= 0) & ((i == 0) | (
        F.shiftright(item(s, i).bitwiseXOR(item(s, i - 1)), _PLACE) != 0))))

    def numbered(i: Column, occurrence: Column) -> Column:
        x = F.coalesce(item(s, i), F.lit(0))
        return _packed(F.xxhash64(F.shiftright(x, _PLACE), occurrence), x.bitwiseAND(F.lit(_LOW)))

    once = F.transform(s, lambda x, i: numbered(i, F.lit(0)))
    runs = F.flatten(F.transform(b, lambda at, r: F.transform(
        F.sequence(at, F.coalesce(item(b, r + 1), F.size(s)) - 1), lambda i: numbered(i, i - at))))
    df = df.withColumn(t, F.sort_array(F.when(F.size(s) == 0, none).when(F.size(b) == F.size(s), once).otherwise(runs)))

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, 64 - bits)

    # Where the k-mers of each filled bin begin, and from there where each order's first k-mer stands.
    df = df.withColumn(e, F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i >= 0) & (
        (i == 0) | (bin_of(item(t, i)) != bin_of(item(t, i - 1))))))
    low = -(1 << (bits - 1))
    numbers = F.sequence(F.lit(low), F.lit(-low - 1))
    from_there = F.transform(numbers, lambda g: F.coalesce(F.get(F.filter(
        F.col(e), lambda i: bin_of(item(t, i)) >= g), F.lit(0)), F.lit(0)))
    places = F.when(F.size(t) == 0, F.array().cast("array<int>")).when(F.size(e) == 1 << bits, F.col(e)).otherwise(from_there)

    def tuple_of(i: Column, order: Column) -> Column:
        first, second = item(t, i), item(t, F.pmod(i + 1, F.size(t)))
        a, c = F.shiftright(first, _PLACE), F.shiftright(second, _PLACE)
        after = first.bitwiseAND(F.lit(_LOW)) < second.bitwiseAND(F.lit(_LOW))
        hashed = F.when(F.size(t) == 1, F.xxhash64(a)).when(after, F.xxhash64(a, c)).otherwise(F.xxhash64(c, a))
        return F.shiftleft(order, HASH_BITS).bitwiseOR(hashed.bitwiseAND(F.lit((1 << HASH_BITS) - 1))).cast("int")

    return df.withColumn(name, F.transform(places, tuple_of)).select(*[F.col(f"`{c}`") for c in kept], name)


def likeness(a: Column, b: Column) -> Column:
    """Share of the orders in which two fingerprints agree; 1 for two empty ones."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits for each order."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


KEY = ["i", "u", "t"]


def keyed(docs: DataFrame) -> DataFrame:
    """text (null: empty) under a key without nulls: i and u tell the id and whether it is null, t the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("i"), doc_id.isNull().alias("u"), F.xxhash64(text).alias("t"),
                       text.alias("text"))


def ring(keys: DataFrame) -> DataFrame:
    """Keys and n with who follows (next_i, next_u, next_t): ids descend, then t; null ids last; the first follows the last.

    Keys are slim. They are dealt to ranges, which a written table fixes; inside a range the next row follows, after
    its end the head of the next range (one row a range).
    """
    down = [F.asc("u"), F.desc("i"), F.desc("t")]
    parts = written(keys.repartitionByRange(*down).select(*KEY, "n", F.spark_partition_id().alias("part")), "ring")
    me = F.struct((~F.col("u")).alias("known"), "i", "t")
    heads = parts.groupBy("part").agg(F.max(me).alias("head"))
    every = Window.orderBy("part")
    after = heads.select("part", F.coalesce(
        F.lead("head").over(every), F.first("head").over(every.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    following = F.lead(me).over(Window.partitionBy("part").orderBy(*down))
    return parts.withColumn("_n", following).join(F.broadcast(after), "part").withColumn(
        "_n", F.coalesce("_n", "after")).select(
        *KEY, "n", F.col("_n.i").alias("next_i"), (~F.col("_n.known")).alias("next_u"), F.col("_n.t").alias("next_t"))


def compare_edits(docs: DataFrame, k: int = K, bits: int = BIN_BITS) -> DataFrame:
    """Fingerprints of each text and of its edited text, where its last third is the next document's beginning.

    doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next. Null texts count as empty. Rows
    of one id follow each other by a hash of their text; rows repeated in full are one document in the order,
    and each is returned. Texts move once by their own key (both joins read that exchange), and the borrowed
    beginnings once; fingerprints are a written table, so each is made once.
    """
    base = keyed(docs)
    links = ring(base.select(*KEY, F.length("text").alias("n")).distinct())
    prints = written(with_fingerprint(base, "text", "fp", k, bits).groupBy(*KEY).agg(F.first("fp").alias("fp")), "prints")
    named = lambda df, p: df.withColumnsRenamed({c: p + c for c in df.columns})

    def follows(p: str) -> Column:
        return ((F.col("next_i") == F.col(f"{p}i")) & (F.col("next_u") == F.col(f"{p}u")) & (F.col("next_t") == F.col(f"{p}t")))

    third = F.floor(F.col("n") / 3).cast("int")
    borrowed = links.join(named(prints, "p_"), follows("p_")).join(named(base, "o_"), follows("o_")).select(
        *KEY, F.substring("o_text", F.lit(1), third).alias("head"), F.col("p_fp").alias("next_fp"))
    borrowed = borrowed.groupBy(*KEY).agg(F.first("head").alias("head"), F.first("next_fp").alias("next_fp"))
    rows = base.join(borrowed, KEY).join(prints, KEY)
    n = F.length("text")
    rows = rows.select(F.when(~F.col("u"), F.col("i")).alias("doc_id"), n.alias("n_chars"), "fp", "next_fp", F.concat(
        F.substring("text", F.lit(1), (n - F.floor(n / 3)).cast("int")), "head").alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fp", k, bits)
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited", as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
