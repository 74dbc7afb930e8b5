"""Terms of few requests, looked for while the texts are read.

Where requests are few, a text is tested with all those of its group in the task that reads it: its distinct words lead to
the asked parts that they contain, by a table that a task fills as it meets words, and a request counts the parts it asked for.
Texts are then neither cut into rows of words nor shuffled, and a task passes on the best of each request only. Requests are
collected and travel with the plan; beyond the bounds below an index finds their texts (``term_index.py``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"\s+"
# What separates words: the white space of the patterns, which is narrower than Python's.
SEPARATORS = re.compile("[ \t\n\x0b\f\r]+")
# What only Python's split cuts at.
WIDE = re.compile(r"[^\S \t\n\x0b\f\r]")
# Requests that travel to every task, their parts, and rows that a task holds as the best of all requests.
MAX_REQUESTS, MAX_PARTS, MAX_BEST = 2_000, 100_000, 400_000
# Words whose parts a task remembers, and the longest of them.
MAX_WORDS, LONGEST = 200_000, 64
# Characters by which parts are filed.
GRAM = 3
#: A number, a match count and a flag in one long.
SHIFT, SAID = 32, 1 << 31
# Up to so many parts are searched for one by one.
DIRECT = 24

Score = Callable[[int, bool, dict[str, Any], Any], tuple]


def listed(terms: Column, also: Column | None = None) -> Column:
    """The part that stands for each term, how often a hit counts, and the whole term where it has to be verified.

    A term without white space is its own part; of others, and of those of ``also``, which count nothing, the longest piece is.
    """
    each = F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(1).alias("n")))
    if also is not None:
        each = F.concat(each, F.transform(also, lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"))))

    def part(t: Column) -> Column:
        pieces = F.filter(F.split(t["term"], BLANK), lambda p: p != "")
        longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
        sure = (t["term"] == longest) & (t["n"] == 1)
        return F.struct(longest.alias("part"), sure.alias("sure"), F.when(~sure, t["term"]).alias("whole"))

    return F.filter(F.transform(each, part), lambda t: t["part"].isNotNull())


class Requests:
    """Few requests, by group: what a task needs to test a text with them."""

    def __init__(self, rows: Sequence[Row], group: Sequence[str], keep: Sequence[str], once: bool = False):
        self.groups: dict[tuple, _Group] = {}
        self.rows: list[tuple] = []
        firsts: dict[tuple, int] = {}
        for r in rows:
            key = tuple(r[g] for g in group)
            if any(k is None for k in key):
                continue
            first = firsts.setdefault((key, r["question_id"]), len(self.rows))
            number = first if once else len(self.rows)
            if number == len(self.rows):
                self.rows.append((number, r["question_id"], *[r[c] for c in keep if c not in group]))
            self.groups.setdefault(key, _Group()).add(number, first, r)

    def at(self, key: tuple) -> _Group | None:
        return self.groups.get(key)


def collected(requests: DataFrame, group: Sequence[str], terms: Column, also: Column | None = None, keep: Sequence[str] = (),
              most: int = 1, once: bool = False) -> Requests | None:
    """The requests, unless they or their parts are too many, or ``most`` rows of each are. A request that is there twice finds
    its texts twice, unless ``once``."""
    few = requests.select(*group, "question_id", *[c for c in keep if c not in group], listed(terms, also).alias("_parts"))
    size = few.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_parts")).alias("parts")).first()
    if size["n"] > MAX_REQUESTS or (size["parts"] or 0) > MAX_PARTS or size["n"] * most > MAX_BEST:
        return None
    return Requests(few.collect(), group, keep, once)


class _Group:
    """Requests of one group. A part is a bit, what a text holds is one number."""

    def __init__(self):
        self.bits: dict[str, int] = {}
        self.counts: dict[int, dict[int, int]] = {}
        self.asked: dict[int, tuple[int, dict[str, int], Row]] = {}
        self.ready: list[tuple] | None = None

    def add(self, number: int, first: int, r: Row) -> None:
        """Rows with the same question_id, of which ``first`` is the first, count their parts together; whole terms are a row's own."""
        counts = self.counts.setdefault(first, {})
        wholes = self.asked.setdefault(number, (first, {}, r))[1]
        for p in r["_parts"]:
            bit = self.bits.setdefault(p["part"], 1 << len(self.bits))
            if p["sure"]:
                counts[bit] = counts.get(bit, 0) + 1
            else:
                wholes[p["whole"]] = bit

    def _prepare(self) -> None:
        # Planes of parts that count at least once, twice and so on: their common bits with a text add up to its hits.
        self.ready = []
        for number, (first, wholes, row) in self.asked.items():
            counts = self.counts[first]
            planes = [sum(b for b, n in counts.items() if n > i) for i in range(max(counts.values(), default=0))]
            every = (planes[0] if planes else 0) | _union(wholes.values())
            self.ready.append((number, every, planes, list(wholes.items()), row))
        # Parts by their first characters: a word is looked up once at each of its places.
        self.size = min([GRAM, *map(len, self.bits)])
        self.opening: dict[str, list[tuple[str, int]]] = {}
        for part, bit in self.bits.items():
            self.opening.setdefault(part[:self.size], []).append((part, bit))
        # Python's own split cuts at more characters; that may only be where no part holds one.
        self.split = str.split if all(len(p.split()) == 1 for p in self.bits) else SEPARATORS.split
        self.known: dict[str, int] = {}

    def _held_by(self, word: str) -> int:
        opening, size, out = self.opening, self.size, 0
        for i in range(len(word) - size + 1):
            for part, bit in opening.get(word[i:i + size], ()):
                if word.startswith(part, i):
                    out |= bit
        if len(word) <= LONGEST:
            if len(self.known) >= MAX_WORDS:
                self.known.clear()
            self.known[word] = out
        return out

    def tested(self, low: str | None, idle: bool = False) -> Iterator[tuple[int, int, bool, Row]]:
        """(number, hits, whether a whole term is held, request) of each request that the text matches, or of all."""
        if self.ready is None:
            self._prepare()
        if low is None:
            return
        known, held = self.known, 0
        if len(self.bits) <= DIRECT:
            for part, bit in self.bits.items():
                if part in low:
                    held |= bit
        else:
            for word in set(self.split(low)):
                bits = known.get(word)
                held |= self._held_by(word) if bits is None else bits
        for number, every, planes, wholes, row in self.ready:
            if not held & every:
                if idle:
                    yield number, 0, False, row
                continue
            hits = sum((held & plane).bit_count() for plane in planes)
            said = any(held & bit and whole in low for whole, bit in wholes)
            if hits or said or idle:
                yield number, hits, said, row


def _union(bits) -> int:
    out = 0
    for b in bits:
        out |= b
    return out


def numbered(rows: DataFrame, requests: Requests, question: T.DataType, keep: Sequence[T.StructField] = ()) -> DataFrame:
    """Rows with a ``_number`` get the requests of that number: their question_id and the columns kept."""
    schema = T.StructType([T.StructField("_number", T.IntegerType()), T.StructField("question_id", question), *[
        T.StructField(f.name, f.dataType) for f in keep]])
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(requests.rows, schema)), "_number").drop("_number")


def matched(requests: Requests) -> Callable[..., Column]:
    """(group, text): the requests that a text matches, as a number, the hits and a flag in one long."""

    @F.pandas_udf("array<bigint>")
    def found(*columns: pd.Series) -> pd.Series:
        *keys, lows = columns
        out = []
        for *key, low in zip(*keys, lows):
            group = requests.at(tuple(key))
            out.append([] if group is None else [
                number << SHIFT | hits | (SAID if said else 0) for number, hits, said, _ in group.tested(low)])
        return pd.Series(out, dtype=object)

    return found


def best(texts: DataFrame, group: Sequence[str], requests: Requests, k: int, score: Score, columns: Sequence[str], key: str | None = None,
         idle: bool = False, fits: Callable[[dict[str, Any]], Callable[[Row], bool]] | None = None) -> DataFrame:
    """(_number, hits, said, columns): of each task the k best texts of a request, among them the best of all.

    ``score`` gives the order, smallest first, from hits, flag, text and request; it may not differ from that by which the
    rows are ranked afterwards. ``key`` names what makes a repeat: of each key only the best counts. With ``idle`` texts without a
    hit are ranked too. ``fits`` says which requests a text is for.
    """
    fields = [texts.schema[c] for c in columns]
    schema = T.StructType([T.StructField("_number", T.IntegerType()), T.StructField("hits", T.IntegerType()),
                           T.StructField("said", T.BooleanType()), *fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, _Top] = {}
        types: dict[str, pa.DataType] = {}
        for batch in batches:
            types = types or {f.name: f.type for f in batch.schema}
            for text in batch.to_pylist():
                asked = requests.at(tuple(text[g] for g in group))
                if asked is None:
                    continue
                wanted = None if fits is None else fits(text)
                repeat = text["_row"] if key is None else text[key]
                row = tuple(text[c] for c in columns)
                for number, hits, said, request in asked.tested(text["low"], idle):
                    if wanted is None or wanted(request):
                        if (top := tops.get(number)) is None:
                            top = tops[number] = _Top(k)
                        order = score(hits, said, text, request)
                        if top.limit is None or order < top.limit:
                            top.add(order, repeat, (hits, said, row))
        for number, top in tops.items():
            found = top.rows()
            yield pa.RecordBatch.from_arrays([
                pa.array([number] * len(found), pa.int32()), pa.array([f[0] for f in found], pa.int32()),
                pa.array([f[1] for f in found], pa.bool_()),
                *[pa.array([f[2][i] for f in found], types[c]) for i, c in enumerate(columns)]], ["_number", "hits", "said", *columns])

    return texts.mapInArrow(search, schema)


class _Top:
    """The k smallest of what was added, one for each key."""

    def __init__(self, k: int):
        self.k, self.most, self.kept = k, 2 * k + 16, {}
        self.limit: tuple | None = None

    def add(self, order: tuple, key: Any, value: Any) -> None:
        """For an order below the limit: whatever is kept is not above it."""
        old = self.kept.get(key)
        if old is None or order < old[0]:
            self.kept[key] = (order, value)
            if len(self.kept) > self.most:
                self._cut()

    def _cut(self) -> None:
        self.kept = dict(sorted(self.kept.items(), key=lambda e: e[1][0])[:self.k])
        self.limit = max(order for order, _ in self.kept.values())

    def rows(self) -> list:
        if len(self.kept) > self.k:
            self._cut()
        return [value for _, value in self.kept.values()]
