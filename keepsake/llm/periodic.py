"""Runs of words that repeat with a period, found by block convolution.

A run of period q, at least 2q long, holds whole blocks of a grid whose width L fits q (2L - 1 <= q <= 4L - 2), and each
of them stands there again q words later. So at every dyadic width, the squared differences between a block and all
places of the window that follows it are summed by convolution; a sum of zero is an occurrence, and its distance seeds
an extension to both sides. The convolution is an exact number-theoretic transform modulo 2**16 + 1: a sum that is
zero is zero modulo the prime, so no occurrence is missed, and what is zero only modulo the prime fails in the extension,
which compares the words.

All texts of a block of rows are one sequence with a mark, equal to nothing, after each: their blocks are transformed
together. Work and memory grow with the words times the logarithm of the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.chunks import gather
from keepsake.llm.common import blocks, passed, passing, text_bytes
from keepsake.llm.shingles import _BLANK

#: Shortest run, and how often it has to hold its period.
SHORTEST, TIMES = 12, 2
PRIME = (1 << 16) + 1
#: Longest block that is transformed whole, words in one transform of blocks, and bytes of texts taken together.
WIDEST, TOGETHER, BLOCK = 1 << 14, 1 << 18, 2 << 20
_HASH = (1 << 31) - 1

#: What a text's words are read as: given the batch and the number of words of each row, for some rows the word
#: numbers in the order in which they are read.
Reading = Callable[[pa.Table, np.ndarray], dict[int, np.ndarray]]


def folded(v: np.ndarray) -> np.ndarray:
    """A smaller number that is the same modulo PRIME."""
    return (v & 0xFFFF) - (v >> 16)


def _roots(n: int, inverse: bool = False) -> np.ndarray:
    """The first n / 2 powers of a root of unity of order n (3 generates all numbers modulo PRIME)."""
    step = pow(3, (PRIME - 1) // n * (n - 1 if inverse else 1), PRIME)
    out = np.ones(1, np.int64)
    while len(out) < n // 2:
        out = np.concatenate([out, out * pow(step, len(out), PRIME) % PRIME])
    return out


def transform(x: np.ndarray) -> np.ndarray:
    """Transform of each column, places in bit-reversed order. Sums at most double in a step, which 64 bits hold."""
    n, width = x.shape
    half = n // 2
    while half:
        v = x.reshape(n // (2 * half), 2, half, width)
        low, high = v[:, 0], v[:, 1]
        out = np.empty_like(v)
        np.add(low, high, out=out[:, 0])
        out[:, 1] = folded((low - high) * _roots(2 * half)[:, None])
        x, half = out.reshape(n, width), half // 2
    return x


def back(x: np.ndarray) -> np.ndarray:
    """What was transformed, times its number of places."""
    n, width = x.shape
    half = 1
    while half < n:
        v = x.reshape(n // (2 * half), 2, half, width)
        high = folded(v[:, 1] * _roots(2 * half, inverse=True)[:, None])
        out = np.empty_like(v)
        np.add(v[:, 0], high, out=out[:, 0])
        np.subtract(v[:, 0], high, out=out[:, 1])
        x, half = out.reshape(n, width), half * 2
    return x


def occurrences(value: np.ndarray, square: np.ndarray, at: np.ndarray, width: int, low: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of all zero sums: blocks of ``width`` at ``at``, distances from ``low`` on, ``number`` of them.

    ``square`` has the sums of the first i squares. At most 3 * width distances.
    """
    n, last = 4 * width, len(value) - 1
    block = np.zeros((n, len(at)), np.int64)
    block[:width] = value[at + np.arange(width - 1, -1, -1)[:, None]]
    window = value[np.minimum(at + low + np.arange(n)[:, None], last)]
    product = folded(folded(transform(block))) * folded(folded(transform(window)))
    both = back(folded(folded(product)))[width - 1:width - 1 + number]
    begin = np.minimum(at + low + np.arange(number)[:, None], last + 1)
    squares = square[np.minimum(begin + width, last + 1)] - square[begin] + (square[at + width] - square[at])
    rest = folded(folded(folded(squares)) * n - 2 * folded(folded(both)))
    rest = folded(folded(rest))
    distance, which = np.nonzero((rest == 0) | (rest == PRIME) | (rest == -PRIME))
    return which, low + distance


class WordSequence:
    """Words of several texts in a row, with what extensions need."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        """``words``: numbers, equal for equal words; ``starts``: where each text begins, and the end."""
        count = np.diff(starts)
        texts = len(count)
        self.x = np.empty(len(words) + texts, np.int64)
        place = np.arange(len(words)) + np.repeat(np.arange(texts), count)
        marks = starts[1:] + np.arange(texts)
        self.x[place] = words
        self.x[marks] = (int(words.max()) + 1 if len(words) else 0) + np.arange(texts)
        self.begin = marks - count
        self.end = marks
        self.text = np.repeat(np.arange(texts), count + 1)
        self.power = np.ones(1, np.uint64)
        prime = np.uint64(_HASH)
        while len(self.power) <= len(self.x):
            step = np.uint64(pow(1_000_003, len(self.power), _HASH))
            self.power = np.concatenate([self.power, self.power * step % prime])
        mixed = (self.x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(34)) + np.uint64(1)
        self.hash = np.zeros(len(self.x) + 1, np.uint64)
        np.cumsum(mixed * self.power[:len(self.x)] % prime, out=self.hash[1:])
        self.hash %= prime

    def same(self, i: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
        """Are the k words at i and those d later alike, by their hashes."""
        prime = np.uint64(_HASH)
        left = (self.hash[i + k] + prime - self.hash[i]) % prime * self.power[d] % prime
        return left == (self.hash[i + d + k] + prime - self.hash[i + d]) % prime

    def reach(self, i: np.ndarray, d: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
        """How many words from i on (sign 1) or before i (sign -1) equal those d later, at most ``most``."""
        k, step, active = np.zeros(len(i), np.int64), 1, np.arange(len(i))

        def grow(some: np.ndarray, by: int) -> np.ndarray:
            some = some[k[some] + by <= most[some]]
            at = i[some] + k[some] if sign > 0 else i[some] - k[some] - by
            some = some[self.same(at, d[some], by)]
            k[some] += by
            return some

        while len(active):
            active = grow(active, step)
            step *= 2
        every = np.arange(len(i))
        while step > 1:
            step //= 2
            grow(every, step)
        return k

    def stretch(self, seed: int, d: int) -> tuple[int, int]:
        """The stretch around ``seed`` in which words d apart are alike, word by word."""
        t = self.text[seed]
        low, high = self.begin[t], self.end[t] - d
        differ = np.flatnonzero(self.x[low:high] != self.x[low + d:high + d]) + low
        at = int(np.searchsorted(differ, seed))
        if at < len(differ) and differ[at] == seed:
            return seed, seed
        return (int(differ[at - 1]) + 1 if at else int(low)), (int(differ[at]) if at < len(differ) else int(high)) + d


def runs_of(words: np.ndarray, starts: np.ndarray, shortest: int = SHORTEST, widest: int = WIDEST) -> np.ndarray:
    """All runs of the texts: rows (text, start, length, period), sorted; start counts the words of the text."""
    none = np.zeros((0, 4), np.int64)
    if not len(words):
        return none
    s = WordSequence(words, starts)
    value = s.x % PRIME
    square = np.append(0, np.cumsum(value * value))
    covered_to, covered_by = np.zeros(len(s.x), np.int64), np.ones(len(s.x), np.int64)
    longest = int((s.end - s.begin).max())
    found: list[np.ndarray] = []
    length = 2
    while True:
        low, high = (1, 6) if length == 2 else (2 * length - 1, 4 * length - 2)
        if max(TIMES * low, shortest) > longest:
            break
        at = np.arange(0, len(s.x), length)
        # Whole blocks, with room in their text for the period to come twice.
        text = s.text[at]
        at = at[(at + length + low <= s.end[text]) & (s.end[text] - s.begin[text] >= max(TIMES * low, shortest))]
        width = min(length, widest)
        rows = max(1, TOGETHER // (4 * width))
        new: list[np.ndarray] = []
        for i in range(0, len(at), rows):
            some = at[i:i + rows]
            for first in range(low, high + 1, 3 * width):
                number = min(3 * width, high + 1 - first)
                which, d = occurrences(value, square, some, width, first, number)
                b = some[which]
                to = b + d + width
                # Whatever lies in a run whose period divides the distance is that run again.
                fresh = (to <= s.end[s.text[b]]) & ~((to <= covered_to[b]) & (d % covered_by[b] == 0))
                if fresh.any():
                    new.append(_extended(s, b[fresh], d[fresh], width == length and length, shortest))
        if new:
            got = np.unique(np.concatenate(new), axis=0)
            found.append(got)
            for start, end, q in got[np.lexsort((-got[:, 2], got[:, 1]))].tolist():
                covered_to[start:end], covered_by[start:end] = end, q
        length *= 2
    every = np.concatenate(found) if found else none[:, :3]
    if not len(every):
        return none
    # One stretch can hold multiples of its smallest period too.
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    every = every[np.append(True, (every[1:, :2] != every[:-1, :2]).any(1))]
    text = s.text[every[:, 0]]
    out = np.column_stack([text, every[:, 0] - s.begin[text], every[:, 1] - every[:, 0], every[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _extended(s: WordSequence, b: np.ndarray, d: np.ndarray, grid: int, shortest: int) -> np.ndarray:
    """Stretches (start, end, distance) around blocks that stand again d later, if they are long enough."""
    order = np.lexsort((b, d))
    b, d = b[order], d[order]
    # Blocks that touch (``grid`` apart; 0: none do) and have one distance are in one stretch.
    first = np.append(True, (d[1:] != d[:-1]) | (b[1:] != b[:-1] + grid))
    b, d = b[first], d[first]
    text = s.text[b]
    right = s.reach(b, d, s.end[text] - b - d, 1)
    left = s.reach(b, d, b - s.begin[text], -1)
    start, end = b - left, b + right + d
    long = (right > 0) & (end - start >= np.maximum(TIMES * d, shortest))
    out = np.column_stack([start, end, d])[long]
    if not len(out):
        return out
    out, first = np.unique(out, axis=0, return_index=True)
    for row, seed in zip(out, b[long][first].tolist()):
        x, y, q = row.tolist()
        # Hashes decided so far; the words have the last say.
        t = s.text[seed]
        if not (np.array_equal(s.x[x:y - q], s.x[x + q:y]) and (x == s.begin[t] or s.x[x - 1] != s.x[x - 1 + q])
                and (y == s.end[t] or s.x[y] != s.x[y - q])):
            row[:2] = s.stretch(seed, q)
    return out[out[:, 1] - out[:, 0] >= np.maximum(TIMES * out[:, 2], shortest)]


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: a number (equal for equal words), where it begins, its bytes; and where each text's words begin."""
    word = ~_BLANK[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = starts[:-1][starts[:-1] < len(data)]
    begins[edges] = word[edges]
    begin = np.flatnonzero(begins)
    ends = word.copy()
    ends[:-1] &= ~word[1:] | begins[1:]
    offsets = np.append(0, np.cumsum(np.flatnonzero(ends) + 1 - begin))
    column = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])])
    number = column.dictionary_encode().indices.to_numpy().astype(np.int64)
    return number, begin, np.diff(offsets), np.searchsorted(begin, starts)


def _joined(data: np.ndarray, begin: np.ndarray, length: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> list[str]:
    """The kept words of each text, one space between them."""
    out = []
    padded = np.append(data, 32).astype(np.uint8)
    for a, z in zip(starts[:-1].tolist(), starts[1:].tolist()):
        parts, i = [], a
        ends = np.cumsum(length[a:z])
        while i < z:  # so that a long text takes no index for each of its bytes at once
            j = a + max(int(np.searchsorted(ends, (ends[i - a - 1] if i > a else 0) + BLOCK, "right")), i - a + 1)
            k = i + np.flatnonzero(keep[i:j])
            if len(k):
                text = gather(padded, begin[k], length[k] + 1)
                text[np.cumsum(length[k] + 1) - 1] = 32
                parts.append(text.tobytes())
            i = j
        out.append(b"".join(parts)[:-1].decode())
    return out


def find_runs(docs: DataFrame, reading: Reading | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    r"""All columns of ``docs`` (whose names clash are replaced), then n_words, runs and collapsed.

    Words are ``[^\x20\x09-\x0D]+`` of ``text``. A run is a stretch of at least 12 words, and twice its smallest period,
    that no neighbouring word extends; runs (array of start, length, period) come by start, then period. ``collapsed`` is
    the text's words with one space between them, without those that some run holds after its first period. A null or
    empty text has no word, no run and an empty ``collapsed``; repeated rows give equal results; no rows give none.
    ``reading`` may have words read in another order (its columns come from ``also``, and are not returned).
    """
    names = passing(docs, ["n_words", "runs", "collapsed", *(also or {})])
    fields = [docs.schema[n] for n in names]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def detect(t: pa.Table) -> pa.Table:
        data, places = text_bytes(t.column("text"))
        number, runs, texts = [], [], []
        for at, end in blocks(places, BLOCK):
            part = data[places[at]:places[end]]
            ids, begin, length, starts = words_of(part, places[at:end + 1] - places[at])
            if reading is not None and (read := reading(t.slice(at, end - at), np.diff(starts))):
                order = np.concatenate([starts[i] + read.get(i, np.arange(starts[i + 1] - starts[i])) for i in range(end - at)])
                ids, begin, length = ids[order], begin[order], length[order]
            got = runs_of(ids, starts)
            keep = np.ones(len(ids), bool)
            for text, start, size, period in got.tolist():
                keep[starts[text] + start + period:starts[text] + start + size] = False
            edge = np.searchsorted(got[:, 0], np.arange(end - at + 1))
            rows = [{"start": r[1], "length": r[2], "period": r[3]} for r in got.tolist()]
            runs += [rows[a:b] for a, b in zip(edge[:-1], edge[1:])]
            number += np.diff(starts).tolist()
            texts += _joined(part, begin, length, starts, keep)
        out = t.select(names)
        return out.append_column("n_words", pa.array(number, pa.int64())).append_column(
            "runs", pa.array(runs, kind)).append_column("collapsed", pa.array(texts, pa.large_string()).cast(pa.string()))

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    rows = docs.select(*[F.col(f"`{n}`") for n in names], *[c.alias(n) for n, c in (also or {}).items()])
    return passed(rows, detect, f"{schema}n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def repeating(batch: pa.Table, count: np.ndarray, number: str) -> dict[int, np.ndarray]:
    """A reading that makes periodic texts: by the number h of a row, where h % 10 is 0.

    From word a = (h // 10) % n on, word i is read as word a + (i - a) % p, where p = 1 + (n - a) // (3 + (h // 10) % 8).
    """
    out = {}
    for row, (h, n) in enumerate(zip(batch.column(number).to_pylist(), count.tolist())):
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            i = np.arange(n)
            out[row] = np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))
    return out


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and SHA-256 of all runs and of collapsed."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    start, length, period = -best["start"], best["length"], -best["period"]
    shown = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    shown = F.when(F.size("runs") > 0, F.concat(shown, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"),
        F.sha2(shown, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
