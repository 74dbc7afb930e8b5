"""An inverted index over the distinct words of texts, for terms that a text has to contain.

A term without white space lies inside one word of a text (words end at white space), so it is looked for in the
vocabulary and not in the texts. Vocabulary words are filed under their runs of up to three characters; a term is looked up
under the rarest of its own. Whoever has that run is compared with the term; the words that hold it lead back to their texts by
an equi-join. A term of two pieces with one blank between can only stand where a word that ends with the first is followed,
after one blank, by a word that begins with the second: neighbours of a text are joined with such words. Of other terms with white
space the longest piece is looked up. What comes back is verified on the text.
The work grows with the texts, the terms and the matches; texts and requests are never paired off. A match is a row's
number and a count: whatever ranks matches carries numbers, and fetches the texts of the few that stay.
Few requests need no index: each text is tested with those of its group where it is read (``term_scan.py``).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.text import let
from keepsake.operators import term_scan
from keepsake.operators.ranking import broadcast_if_small
from keepsake.session import shared_dir

GRAM = 3
BLANK = r"\s+"
# Terms that are looked up by neighbouring words.
TWO = r"\A\S+ \S+\z"
# Vocabulary words that hold an asked part: a million of them are some tens of megabytes.
MAX_LINKS = 1_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def runs(word: Column, least: Column | int, most: Column | int) -> Column:
    """The distinct runs of ``least`` to ``most`` characters of a word, in time linear in its length."""
    def run(chars: Column, i: Column, n: Column) -> Column:
        rest = [F.when(n > j, F.coalesce(F.get(chars, i + j), F.lit(""))).otherwise("") for j in range(1, GRAM)]
        return F.concat(F.get(chars, i), *rest)

    def every(chars: Column) -> Column:
        low, high = (F.lit(x) if isinstance(x, int) else x for x in (least, most))
        return F.array_distinct(F.flatten(F.transform(F.sequence(low, high), lambda n: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), lambda i: run(chars, i, n)))))

    return let(F.filter(F.split(word, ""), lambda c: c != ""), every)


class TermIndex:
    """Texts of groups, stored once with a number each, and the words they hold.

    ``texts`` carries the lower-cased text as ``low`` (null: never found) and the columns of ``group``. Instead of ``low``
    the column may be named that is ``low`` in lower case: then one text is stored, not two. Stored texts that have a ``_row``
    already are taken as they are.
    """

    def __init__(self, texts: DataFrame, group: Sequence[str], low: str | None = None):
        rows = texts if "_row" in texts.columns else stored(texts.withColumn("_row", F.monotonically_increasing_id()), "texts")
        self._over(rows if low is None else rows.withColumn("low", F.lower(low)), list(group))

    def _over(self, rows: DataFrame, group: list[str]) -> None:
        self.rows, self.group, self.columns = rows, group, [c for c in rows.columns if c != "_row"]
        # One row for each distinct word of a text.
        self.words = self.rows.select(*self.group, "_row", F.explode(F.array_distinct(F.split("low", BLANK))).alias("_word"))
        self._vocabulary: DataFrame | None = None

    def over(self, rows: DataFrame) -> TermIndex:
        """Some of the same numbered texts, or with more columns."""
        out = TermIndex.__new__(TermIndex)
        out._over(rows, self.group)
        return out

    @property
    def texts(self) -> DataFrame:
        return self.rows.drop("_row")

    @property
    def vocabulary(self) -> DataFrame:
        """Distinct words of all texts; their number grows far slower than that of the texts."""
        if self._vocabulary is None:
            self._vocabulary = stored(self.words.select("_word").filter("_word <> ''").distinct(), "vocabulary")
        return self._vocabulary

    def words_with(self, parts: DataFrame) -> DataFrame:
        """(part, word): all vocabulary words that contain a part. ``parts`` are distinct, without white space."""
        size = F.least(F.length("_part"), F.lit(GRAM))
        asked = stored(parts.select("_part", F.explode(runs(F.col("_part"), size, size)).alias("_run")), "runs")
        # Parts under three characters are rare: runs of their length are filed only if there are any.
        lengths = [r[0] for r in asked.select(F.length("_run").alias("n")).distinct().collect()]
        if not lengths:
            return parts.select("_part", F.lit("").alias("_word")).limit(0)
        own = runs(F.col("_word"), min(lengths), max(lengths))
        filed = stored(self.vocabulary.filter(F.length("_word") >= min(lengths)).select("_word", F.explode(own).alias("_run")).join(
            asked.select("_run").distinct(), "_run", "left_semi"), "filed")
        often = filed.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
        rarest = asked.join(often, "_run").groupBy("_part").agg(F.min(F.struct("_n", "_run")).alias("_best"))
        return rarest.select("_part", F.col("_best._run").alias("_run")).join(filed, "_run").filter(
            F.contains("_word", F.col("_part"))).select("_part", "_word")

    def holding(self, asked: DataFrame, terms: Column, *keep: str, also: Column | None = None) -> DataFrame:
        """Texts, each with the requests of its group of which it may hold a term: all that do, and few others.

        ``asked`` has a row for each (group, question_id); its columns ``keep`` come along, and ``sure``, the number of
        terms without white space that the text does hold, repeats in the request counted. Terms with white space are
        for the caller to verify, as are those of ``also``, which are not counted. A term without a character other than
        white space finds nothing.
        """
        return self.found(asked, terms, *keep, also=also).drop("_row")

    def found(self, asked: DataFrame, terms: Column, *keep: str, also: Column | None = None) -> DataFrame:
        """The same with the number of the text."""
        few = self.scanned(asked, terms, self.columns, keep, also, once=not keep)
        if few is not None:
            return few.select(*self.columns, "_row", "question_id", "sure", *keep)
        found = self.rows.join(self.pairs(asked, terms, also).drop(*self.group), "_row").select(
            *self.columns, "_row", "question_id", "sure")
        return found if not keep else found.join(
            asked.select(*self.group, "question_id", *keep), [*self.group, "question_id"]).select(
            *self.columns, "_row", "question_id", "sure", *keep)

    def counted(self, requests: DataFrame, *keep: str) -> DataFrame:
        """Numbers of the texts that hold one of a request's ``terms``, with how many (``hits``) and the columns ``keep``.

        For terms without white space, which need no look at the text.
        """
        few = self.scanned(requests, F.col("terms"), [], keep)
        if few is not None:
            return few.filter(F.col("sure") > 0).select(
                *self.group, "question_id", *[c for c in keep if c not in self.group], "_row", F.col("sure").cast("int").alias("hits"))
        pairs = self.pairs(requests, F.col("terms")).filter(F.col("sure") > 0)
        return pairs.join(requests.select(*self.group, "question_id", *keep), [*self.group, "question_id"]).select(
            *self.group, "question_id", *keep, "_row", F.col("sure").cast("int").alias("hits"))

    def scanned(self, asked: DataFrame, terms: Column, columns: Sequence[str], keep: Sequence[str] = (), also: Column | None = None,
                once: bool = False) -> DataFrame | None:
        """(group, number of a text, ``columns``, question_id, ``keep``, ``sure``, ``said``) of the texts that hold a term; none if
        the requests are many. ``said``: whether a term is held that does not count, one with white space or one of ``also``."""
        few = term_scan.collected(asked, self.group, terms, also, keep, once=once)
        if few is None:
            return None
        shown = [*self.group, "_row", *[c for c in columns if c not in self.group]]
        hits = self.rows.withColumn("_m", F.explode(term_scan.matched(few)(*self.group, "low"))).select(
            *shown, F.shiftright("_m", term_scan.SHIFT).cast("int").alias("_number"),
            F.col("_m").bitwiseAND(F.lit(term_scan.SAID - 1)).alias("sure"),
            (F.col("_m").bitwiseAND(F.lit(term_scan.SAID)) > 0).alias("said"))
        return self._numbered(hits, few, asked, keep)

    def best(self, asked: DataFrame, terms: Column, k: int, score: term_scan.Score, columns: Sequence[str],
             ties: dict[str, Column], keep: Sequence[str] = (), also: Column | None = None, key: str | None = None, idle: bool = False,
             fits=None) -> DataFrame | None:
        """The same for the k best texts of each task, among them the k best of each request. ``ties`` are columns that ``score``
        sees beside those shown; see ``term_scan.best`` for the others."""
        few = term_scan.collected(asked, self.group, terms, also, keep, k)
        if few is None:
            return None
        shown = list(dict.fromkeys([*self.group, "_row", *columns]))
        texts = self.rows.select(*shown, "low", *[c.alias(n) for n, c in ties.items()])
        found = term_scan.best(texts, self.group, few, k, score, shown, key, idle, fits).withColumnRenamed("hits", "sure")
        return self._numbered(found, few, asked, keep)

    def _numbered(self, rows: DataFrame, few: term_scan.Requests, asked: DataFrame, keep: Sequence[str]) -> DataFrame:
        keep = [c for c in keep if c not in self.group]
        return term_scan.numbered(rows, few, asked.schema["question_id"].dataType, [asked.schema[c] for c in keep])

    def slim(self, *columns: str) -> DataFrame:
        """Number and group of every text with some columns."""
        return self.rows.select("_row", *self.group, *[c for c in columns if c not in self.group])

    def fetch(self, best: DataFrame, *columns: str) -> DataFrame:
        """Columns of the texts of a few numbered rows; these are stored, so that their size decides how they are joined."""
        return stored(best, "best").join(self.rows.select("_row", *columns), "_row").drop("_row")

    def pairs(self, asked: DataFrame, terms: Column, also: Column | None = None) -> DataFrame:
        """(group, number of a text, question_id, ``sure``) as ``holding`` says.

        The parts that a text holds are made distinct before requests are joined, so a row per word, text and request
        is neither shuffled nor kept. All of a text's parts are in one partition: a text is what one record holds.
        """
        listed = F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(1).alias("n")))
        if also is not None:
            listed = F.concat(listed, F.transform(also, lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"))))
        pieces = F.filter(F.split("t.term", BLANK), lambda p: p != "")
        longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
        counted = F.when(F.col("t.term") == longest, F.col("t.n")).otherwise(0)
        sides = F.when(F.col("t.term").rlike(TWO), F.split("t.term", " "))
        wanted = asked.select(*self.group, "question_id", F.explode(listed).alias("t")).select(
            *self.group, "question_id", longest.alias("_part"), counted.alias("_n"),
            F.get(sides, 0).alias("_first"), F.get(sides, 1).alias("_second")).filter(F.col("_part").isNotNull())
        wanted = stored(wanted.groupBy(*self.group, "question_id", "_part", "_first", "_second").agg(F.sum("_n").alias("_n")), "wanted")
        near = wanted.filter("_first IS NOT NULL").select(*self.group, "question_id", "_first", "_second")
        if not near.limit(1).count():
            return self._held(wanted)
        return self._held(wanted.filter("_first IS NULL")).unionByName(self._neighbours(near)).groupBy(
            *self.group, "_row", "question_id").agg(F.sum("sure").alias("sure"))

    def _held(self, wanted: DataFrame) -> DataFrame:
        """``pairs`` by one part of each term."""
        links = stored(wanted.select(*self.group, "_part").distinct().join(
            self.words_with(wanted.select("_part").distinct()), "_part"), "links")
        held = self.words.join(broadcast_if_small(links, MAX_LINKS), [*self.group, "_word"]).select(
            *self.group, "_row", "_part").repartition("_row").distinct()
        return held.join(wanted, [*self.group, "_part"]).groupBy(*self.group, "_row", "question_id").agg(
            F.sum("_n").alias("sure"))

    def _neighbours(self, near: DataFrame) -> DataFrame:
        """``pairs`` for terms of two pieces, by the words of a text that one blank parts."""
        def edges(column: str, edge) -> DataFrame:
            """(piece, word): vocabulary words with an asked piece at their edge."""
            asked = near.select(column).distinct()
            # Distinct lengths of pieces: a few dozen numbers.
            lengths = F.lit(sorted(r[0] for r in asked.select(F.length(column)).distinct().collect()))
            cuts = F.transform(F.filter(lengths, lambda n: n <= F.length("_word")), lambda n: edge(F.col("_word"), n))
            return self.vocabulary.select("_word", F.explode(cuts).alias(column)).join(asked, column)

        pairs = near.select(*self.group, "_first", "_second").distinct()
        opens = stored(pairs.select(*self.group, "_first").distinct().join(edges("_first", F.right), "_first").withColumnRenamed(
            "_word", "_left"), "opens")
        closes = stored(pairs.join(edges("_second", F.left), "_second").withColumnRenamed("_word", "_right"), "closes")
        # White space other than one blank becomes an empty word, which is no neighbour.
        plain = F.split(F.regexp_replace("low", r"\s{2,}|[\s&&[^ ]]", "  "), " ")
        words = self.rows.select(*self.group, "_row", plain.alias("_left")).select(*self.group, "_row", F.inline(F.arrays_zip(
            "_left", F.slice("_left", 2, F.size("_left")).alias("_right")))).filter("_left <> '' AND _right <> ''")
        found = words.join(broadcast_if_small(opens, MAX_LINKS), [*self.group, "_left"]).join(
            broadcast_if_small(closes, MAX_LINKS), [*self.group, "_first", "_right"]).select(
            *self.group, "_row", "_first", "_second").distinct()
        return found.join(near, [*self.group, "_first", "_second"]).select(
            *self.group, "_row", "question_id", F.lit(0).cast("long").alias("sure"))


def with_blanks(terms: Column) -> Column:
    """The terms that an index does not count: those with white space and something else."""
    return F.filter(terms, lambda t: t.rlike(BLANK) & t.rlike(r"\S"))
