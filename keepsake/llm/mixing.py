"""A mixture of sources with given weights, every source cut at its exact budget of words.

Documents get hash-random keys. Inside a source they stand in the order of these keys: a key's leading bits name a
range, ranges are summed, the sums of earlier ranges are added to the running sum inside a range, and the budget cuts
where the sum reaches it. A source below its budget is repeated whole before its last, partial round. Since ranges
come from the keys and not from a sample, a task that runs again finds the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import passing, prefix, written
from keepsake.operators.ranking import rank_all

WEIGHTS = (5, 2, 1)
#: Words of the mixture as a share of all words, and how often a document may be taken.
SHARE, MOST = Fraction(3, 2), 2
#: Leading hexadecimal digits of a key that name its range: at most 4096 ranges a source.
DIGITS = 3
MADE = ["source", "size", "source_size", "target", "taken"]


def n_words(text: Column) -> Column:
    r"""How many ``[^\x20\x09-\x0D]+`` the text has; null: 0. Needs no array of them."""
    marks = F.regexp_replace(text, "[^\\x20\\x09-\\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def weighted(sizes: DataFrame, group: str, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Adds weight: the groups in order take the weights in turn."""
    ranked = rank_all(sizes, [], [F.asc(group)], rank="_place")
    turn = F.array(*[F.lit(int(w)) for w in weights])
    return ranked.withColumn("weight", F.get(turn, F.pmod(F.col("_place") - 1, F.lit(len(weights))).cast("int")).cast("long")).drop("_place")


def targets(sizes: DataFrame, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """Adds target to rows of (size, weight): ``share`` of all sizes by weight, none above ``most`` times its size.

    What a full row cannot take goes to the others by weight, until none is above. Each round reads sums only; a
    round without a newly full row is the last.
    """
    sizes = written(sizes, "sizes")
    total, held, weight, full = 0, 0, 0, -1
    ahead = None
    while True:
        # Full rows are those that the level of the round before fills.
        is_full = F.lit(False) if ahead is None else ahead > most * F.col("size")
        got = sizes.agg(F.sum("size"), F.sum(F.when(is_full, F.col("size"))), F.sum(F.when(~is_full, F.col("weight"))),
                        F.count(F.when(is_full, 1))).first()
        total, held, weight = (int(x or 0) for x in got[:3])
        if got[3] == full or not weight:
            break
        full = got[3]
        left = share.numerator * total - share.denominator * most * held
        ahead = F.col("weight") * F.lit(left) / F.lit(share.denominator * weight)
    level = F.col("weight") * F.lit(0.0) if ahead is None else ahead
    top = (most * F.col("size")).cast("double")
    return sizes.withColumn("target", F.when(F.lit(weight == 0), top).otherwise(F.least(top, level)))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, seed: str = "mix",
        keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (whose names clash are replaced), then source, size, source_size, target and taken.

    ``taken`` counts the words that the mixture takes from a document, repeats included: those of its whole rounds,
    and what the last round takes of it. A source's taken words are its target, rounded down. A null text has size 0 and
    gives nothing; a null source is a source of its own, the last; a null doc_id is keyed as the empty text. Rows of
    one id are separate documents, ordered by size and a hash of their text. An empty table gives no rows. Without
    ``keep_text`` the text is read once, for its size, and travels nowhere.
    """
    p, names = prefix(docs), passing(docs, MADE if keep_text else [*MADE, "text"])
    group, key, span, run, before = (f"{p}{x}" for x in ("group", "key", "span", "run", "before"))
    # Null sorts last, other sources by code point.
    grouped = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    rows = written(docs.select(
        *[F.col(f"`{n}`") for n in names], F.col("source"), n_words(F.col("text")).alias("size"), grouped.alias(group),
        random_key(F.col("doc_id"), seed).alias(key), F.xxhash64("text").alias(f"{p}tie")), "sized")
    rows = rows.withColumn(span, F.substring(key, 1, DIGITS))
    spans = written(rows.groupBy(group, span).agg(F.sum("size").alias(f"{p}n")), "spans")
    sizes = spans.groupBy(group).agg(F.sum(f"{p}n").alias("size"))
    sources = targets(weighted(sizes, group, weights), share, most).select(
        group, F.col("size").alias("source_size"), "target")
    # At most 4096 rows a source.
    earlier = F.sum(f"{p}n").over(Window.partitionBy(group).orderBy(span).rowsBetween(Window.unboundedPreceding, -1))
    base = spans.select(group, span, F.coalesce(earlier, F.lit(0)).alias(before)).join(sources, group)
    inside = F.sum("size").over(Window.partitionBy(group, span).orderBy(key, "size", f"{p}tie").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn(run, inside).join(base, [group, span])
    budget = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.expr(f"cast(floor(target) as bigint) div source_size")).otherwise(0)
    rest = budget - rounds * F.col("source_size") - (F.col(before) + F.col(run) - F.col("size"))
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select(*[F.col(f"`{n}`") for n in names], "source", "size", "source_size", "target",
                         taken.cast("long").alias("taken"))


def rounds(mixed: DataFrame, text: str = "text") -> DataFrame:
    """One row for each time a document is taken: its columns, round (from 0), words, and the text of so many words.

    A text that is taken in part ends after its last taken word. ``mixed`` is what ``mix`` returns with the text.
    """
    size, taken = F.col("size"), F.col("taken")
    last = (F.ceil(taken / size) - 1).cast("int")
    out = mixed.filter(taken > 0).withColumn("round", F.explode(F.sequence(F.lit(0), last)))
    out = out.withColumn("words", F.least(size, taken - F.col("round") * size))
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), 0), 1,
                                F.col("words").cast("int")), "")
    return out.withColumn(text, F.when(F.col("words") < size, part).otherwise(F.col(text)))


SQL = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS random_key
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM sized GROUP BY source),
-- In the order in which a rising level fills them: the level if all before are full.
levels AS (
    SELECT *, 3 * sum(source_size) OVER ()
                - 4 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
                                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS amount,
           2 * sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS among
    FROM sources),
level AS (
    SELECT arg_min(amount, source_size / weight) AS amount, arg_min(among, source_size / weight) AS among
    FROM levels WHERE weight * amount <= 2 * source_size * among),
targets AS (
    SELECT s.source, s.source_size,
           least(2.0::DOUBLE * s.source_size, (s.weight * l.amount)::DOUBLE / l.among::DOUBLE) AS target
    FROM sources s, level l),
placed AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY random_key, d.size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - earlier)) END::BIGINT AS taken
FROM placed
"""
