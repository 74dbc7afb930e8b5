"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much text go.

Column expressions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.text import let
from keepsake.llm.common import passing, prefix

WORD = r"[^\x20\x09-\x0D]"
SYMBOL, SIGN, BAR = r"[#*$%&|<>]", r"[#*$%&<>]", r"\|"
WINDOW = 5
# Phrases of page furniture, in lower case.
BOILERPLATE = [
    "lorem ipsum", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "use cookies", "uses cookies", "enable javascript", "click here", "read more", "sign in", "sign up", "log in",
    "login", "subscribe now", "subscribe to", "share this", "skip to content",
]
# Fixed value: signs that end a sentence or a clause, of all scripts.
SENTENCE_ENDS = "[.!?:;…。！？：；．｡︒﹒﹔﹕﹖﹗՞։؟؛۔܀܁।॥၊။።፣፤፥፦፧៖។៕᠃᠉‼‽⁇⁈⁉⸮෴༎།]"
#: Shares, in hundredths: signs in a line, text a document may lose, repeated words.
LINE_SYMBOLS, LOST, REPEATED = 10, 30, 20
#: Bars of a navigation line, capitals of a shouted one, fewest words of a document.
BARS, CAPITALS, FEWEST = 3, 3, 10
_LOW = (1 << 30) - 1


def has_word(line: Column) -> Column:
    return F.regexp_like(line, F.lit(WORD))


def failed_rule(line: Column) -> Column:
    """Name of the first rule that a line breaks: symbols, navigation, shouting, no_sentence, boilerplate; else null.

    A line without a word breaks none.
    """
    signs = F.regexp_count(line, F.lit(SIGN))
    bars = F.regexp_count(line, F.lit(BAR))
    return (
        F.when(~has_word(line), F.lit(None).cast("string"))
        .when(100 * signs > LINE_SYMBOLS * F.length(line), "symbols")
        .when(bars >= BARS, "navigation")
        .when(~F.regexp_like(line, F.lit(r"\p{Ll}"))
              & F.regexp_like(line, F.lit(r"(\p{Lu}.*){%d}" % CAPITALS)), "shouting")
        .when(~F.regexp_like(line, F.lit(SENTENCE_ENDS)), "no_sentence")
        .when(let(F.lower(line), lambda low: reduce(or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE])), "boilerplate")
    )


def _length(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0).cast("long"), lambda n, x: n + F.length(x))


def clean(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (clashing names are replaced), then the counts, cleaned_text and the verdict.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: of the whole text. n_lines, n_bad_lines, lost_chars:
    lines with a word, those that break a rule, and their characters. A null or empty text has no words and fails.
    Windows of words are compared by a 64-bit hash. Rows are judged one by one, so repeated rows do no harm.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines",
            "lost_chars", "base_failed", "kept", "cleaned_text"]
    kept, p = [f"`{c}`" for c in passing(docs, made)], prefix(docs)
    words_, text_, lines_, hashes_, sorted_, alike_, places_, judged_, full_, bad_, chars_ = (p + n for n in (
        "words", "text", "lines", "hashes", "sorted", "alike", "places", "judged", "full", "bad", "chars"))
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD + "+"), F.lit(0))
    rows = docs.select(*kept, text.alias(text_), words.alias(words_), F.split(text, "\n").alias(lines_))

    # Equal windows: neighbours in the sorted array of (34 bits of the hash, place), then compared by the whole hash.
    def window_hash(i: Column) -> Column:
        return F.xxhash64(*[F.get(F.col(words_), i + k) for k in range(WINDOW)])

    size = F.size(words_)
    hashes = F.when(size >= WINDOW, F.transform(F.sequence(F.lit(0), size - WINDOW), window_hash)).otherwise(
        F.array().cast("array<bigint>"))
    rows = rows.withColumn(hashes_, hashes)
    rows = rows.withColumn(sorted_, F.sort_array(F.transform(
        hashes_, lambda h, i: h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long")))))

    def near(a: Column, b: Column) -> Column:
        return F.coalesce(F.shiftright(a.bitwiseXOR(b), 30) == 0, F.lit(False))

    alike = F.filter(sorted_, lambda x, i: near(x, F.get(F.col(sorted_), i - 1)) | near(x, F.get(F.col(sorted_), i + 1)))
    rows = rows.withColumn(alike_, F.sort_array(F.transform(alike, lambda x: F.struct(
        F.get(F.col(hashes_), x.bitwiseAND(F.lit(_LOW)).cast("int")).alias("h"),
        x.bitwiseAND(F.lit(_LOW)).cast("int").alias("p")))))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a["h"] == b["h"], F.lit(False))

    repeated = F.filter(alike_, lambda x, i: same(x, F.get(F.col(alike_), i - 1)) | same(x, F.get(F.col(alike_), i + 1)))
    rows = rows.withColumn(places_, F.sort_array(F.transform(repeated, lambda x: x["p"])))
    covered = F.aggregate(
        F.transform(places_, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(places_), i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda n, x: n + x)
    # The rules are the costly part: each line is judged once.
    rows = rows.withColumn(judged_, F.transform(lines_, lambda x: F.struct(
        x.alias("line"), has_word(x).alias("full"), failed_rule(x).isNotNull().alias("bad"))))

    def judged(test: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(judged_, test), lambda j: j["line"])

    rows = rows.select("*", judged(lambda j: j["full"]).alias(full_), judged(lambda j: j["bad"]).alias(bad_))
    n_words, whole = F.size(words_).cast("long"), F.col(text_)
    rows = rows.select(
        *kept, n_words.alias("n_words"), _length(F.col(words_)).alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size(full_) - F.size(F.array_distinct(full_))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"), F.size(full_).cast("long").alias("n_lines"),
        F.size(bad_).cast("long").alias("n_bad_lines"), _length(F.col(bad_)).alias("lost_chars"),
        _length(F.col(full_)).alias(chars_),
        F.array_join(judged(lambda j: ~j["bad"]), "\n").alias("cleaned_text"))
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= LOST * F.col(chars_))).drop(chars_)


BAD = rf"""(100 * (length(x) - length(translate(x, '#*$%&<>', ''))) > {LINE_SYMBOLS} * length(x)
      OR length(x) - length(translate(x, '|', '')) >= {BARS}
      OR (NOT regexp_matches(x, '\p{{Ll}}') AND regexp_matches(x, '(\p{{Lu}}.*){{{CAPITALS}}}'))
      OR NOT regexp_matches(x, '{SENTENCE_ENDS}')
      OR {" OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)})"""
#: The same as SQL; a document is told by its id.
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: length(translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0) AS l
  FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d),
twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 4)) AS n FROM win),
cover AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i FROM twice WHERE n > 1), range(0, 5) AS r(k) GROUP BY doc_id),
judged AS (
  SELECT doc_id, count(*) AS n_lines, sum(length(x)) AS chars,
    count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(length(x)) FILTER (bad), 0) AS lost_chars
  FROM (SELECT doc_id, x, {BAD} AS bad
    FROM (SELECT doc_id, unnest(l) AS x FROM d)) GROUP BY doc_id),
counted AS (
  SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words,
    length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_bad_lines, 0) AS n_bad_lines, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars,
    coalesce(chars, 0) AS chars
  FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN judged USING (doc_id)),
verdict AS (
  SELECT *, n_words < {FEWEST} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bad_lines, lost_chars,
  base_failed, NOT base_failed AND 100 * lost_chars <= {LOST} * chars AS kept,
  sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x:
    length(translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')) = 0 OR NOT {BAD}), chr(10))) AS cleaned_sha256
FROM verdict
"""
