"""Lines that spread over many sites, found by HyperLogLog sketches, and their removal.

A sketch of sites per line hash merges in any order, so it is built on the map side and a line that every document
carries costs one small sketch a task. Lines whose estimate lies near the threshold get an exact distinct count; then
lines at or above it are boilerplate and go from every document. A class of exact copies counts as one site. Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import passing, prefix, written

#: Sites from which on a line is boilerplate; log2 of a sketch's registers (error about 1.6 %).
SITES, LG = 5, 12
#: Estimates within this share of the threshold are counted exactly: ten standard errors.
NEAR = 0.16
# White space of a line does not count, nor do lines without a letter or digit.
_BLANK = r"[\x20\x09-\x0D]+"


def normalized(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), _BLANK, " "))


def _hashed(line: Column) -> Column:
    """Two 64-bit hashes; null for a line without a letter or digit, which is never boilerplate."""
    text = normalized(line)
    return F.when(F.regexp_like(line, F.lit(r"[\p{L}\p{N}]")), F.struct(
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit(9), text).alias("b")))


def line_table(docs: DataFrame) -> DataFrame:
    """One slim row for each line with a letter or digit: doc_id, t and u (two hashes of the text), i, a, b, site.

    Written once, so that texts are split and hashed once; all passes read it. A null source is a site of its own.
    """
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), _hashed(x).alias("h")))
    kept = F.filter(lines, lambda x: x["h"].isNotNull())
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(9), "text").alias("u"),
                       F.coalesce(F.col("source"), F.lit("")).alias("site"), F.explode(kept).alias("x"))
    return written(rows.select("doc_id", "t", "u", "x.i", "x.h.a", "x.h.b", "site"), "lines")


def _sites(lines: DataFrame) -> DataFrame:
    """(a, b, site), each line once for each distinct text: copies of a whole text are one site, the smallest of theirs."""
    return lines.groupBy("t", "u", "a", "b").agg(F.min("site").alias("site")).select("a", "b", "site")


def boilerplate(lines: DataFrame, sites: int = SITES, near: float = NEAR) -> DataFrame:
    """Hashes (a, b) of the lines of ``line_table`` that distinct texts of at least ``sites`` different sources carry.

    The first pass only tells lines of one site, by far the most, from the others: smallest and largest site differ.
    Only the others get sketches, and only those near the threshold an exact count.
    """
    spread = lines.groupBy("a", "b").agg(F.min("site").alias("lo"), F.max("site").alias("hi"))
    shared = written(spread.filter(F.col("lo") < F.col("hi")).select("a", "b"), "shared-lines")
    pairs = written(_sites(lines.join(shared, ["a", "b"], "left_semi")), "line-sites")
    estimates = written(pairs.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG))).alias("n")),
                        "line-spread")
    low, high = sites * (1 - near), sites * (1 + near)
    # A sketch of few sites is exact up to rounding, so the band is at least one wide on both sides.
    low, high = min(low, sites - 1), max(high, sites + 1)
    unsure = estimates.filter((F.col("n") >= low) & (F.col("n") <= high)).select("a", "b")
    counted = pairs.join(unsure, ["a", "b"], "left_semi").groupBy("a", "b", "site").agg(F.lit(1).alias("one")).groupBy(
        "a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= sites).select("a", "b")
    return written(estimates.filter(F.col("n") > high).select("a", "b").unionByName(counted), "boilerplate")


def without_boilerplate(docs: DataFrame, sites: int = SITES, near: float = NEAR) -> DataFrame:
    """All columns of ``docs`` with boilerplate lines taken from ``text``; then n_lines and n_removed.

    Lines are equal if they differ only in white space and case; every occurrence goes, from every document. Rows with the
    same whole text count as one site together, so copies do not make their own lines boilerplate. A null text stays null;
    rows are told apart by doc_id and a hash of the text, so repeated rows and ids stay. Extra columns pass.
    """
    kept, p = passing(docs, ["n_lines", "n_removed"]), prefix(docs)
    key, more, of, other, second, lost = (p + n for n in ("key", "more", "of", "other", "second", "lost"))
    lines = line_table(docs)
    bad = boilerplate(lines, sites, near)
    # At most the lines of one document come together.
    gone = lines.join(bad, ["a", "b"], "left_semi").groupBy("doc_id", "t", "u").agg(F.collect_set("i").alias(lost)).select(
        F.col("doc_id").alias(of), F.col("t").alias(other), F.col("u").alias(second), lost)
    keyed = docs.select(*[F.col(f"`{c}`") for c in kept], F.xxhash64("text").alias(key), F.xxhash64(F.lit(9), "text").alias(more))
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(key) == F.col(other)) & (F.col(more) == F.col(second)), "left")
    stay = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(lost), i))
    text = F.when(F.col(lost).isNotNull(), F.array_join(stay, "\n")).otherwise(F.col("text"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in kept],
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col(lost)), F.lit(0)).cast("long").alias("n_removed"))


#: The same as SQL, over whole tables and with exact counts.
SQL = rf"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
keyed AS (
  SELECT *, CASE WHEN regexp_matches(line, '[\p{{L}}\p{{N}}]')
    THEN trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') END AS norm FROM lines),
classes AS (SELECT text, min(coalesce(source, '')) AS site FROM documents GROUP BY text),
bad AS (
  SELECT norm FROM keyed JOIN documents USING (doc_id) JOIN classes USING (text)
  WHERE norm IS NOT NULL GROUP BY norm HAVING count(DISTINCT classes.site) >= {SITES}),
flagged AS (SELECT k.*, b.norm IS NOT NULL AS gone FROM keyed k LEFT JOIN bad b ON k.norm = b.norm)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS n_chars_left,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM flagged GROUP BY doc_id
"""
