"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (pairs of character classes, repeated words), a gated
attention layer weighs the passages, and the weighted passage representation is scored. Labels are of documents only;
the attention finds the passages that decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import blocks, passed, passing, text_bytes

#: Bytes of a passage, about.
PASSAGE = 512
#: Labelled documents that are learned from (first by a hash of their id), and characters of the longest of them.
SAMPLE, SAMPLE_CHARS = 2500, 200_000
#: From this score on a document counts as good.
GOOD = 0.3
BLOCK = 1 << 20
_KINDS = 16
#: Classes of bytes: blank, line end, vowel, consonant, capital, digit, signs of several kinds, outside ASCII.
_KIND = np.full(256, 14, np.int64)
for _i, _of in enumerate((" \t", "\n\r", "aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789",
                          ".", ",;:", "!?", "|", "#*$%&<>", "'\"()-", "@/\\_=+~^`[]{}")):
    _KIND[np.frombuffer(_of.encode(), np.uint8)] = _i
_KIND[0x80:0xC0], _KIND[0xC0:] = 13, 15
WIDTH = _KINDS * _KINDS + 2


def passages(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and how many passages each text has (an empty text: one of zeros)."""
    size = np.diff(starts)
    number = np.maximum(1, -(-size // PASSAGE))
    out = np.zeros((int(number.sum()), WIDTH), np.float32)
    at = np.append(0, np.cumsum(number))
    for a, b in blocks(starts, BLOCK):
        part, places = data[starts[a]:starts[b]], starts[a:b + 1] - starts[a]
        if not len(part):
            continue
        # A long text is taken in slices; what is counted in them adds up.
        counts = np.zeros((at[b] - at[a], _KINDS * _KINDS), np.int64)
        words, again = np.zeros(at[b] - at[a], np.int64), np.zeros(at[b] - at[a], np.int64)
        seen = np.zeros(0, np.uint64)
        for low, high in _slices(part, BLOCK):
            seen = _count(part, low, high, places, number[a:b], counts, words, again, seen)
        rows = out[at[a]:at[b]]
        rows[:, :-2] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
        rows[:, -2] = again / np.maximum(words, 1)
        rows[:, -1] = np.log1p(words) / 8
    return out, number


def _slices(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Slices of about ``size`` bytes that end before a blank, so that no word is parted; one slice if not twice as long."""
    low = 0
    while low < len(data):
        high = len(data) if len(data) - low <= 2 * size else low + size
        while high < len(data) and _KIND[data[high]] > 1:
            blank = np.flatnonzero(_KIND[data[high:high + size]] <= 1)
            high = high + int(blank[0]) if len(blank) else min(high + size, len(data))
        yield low, high
        low = high


def _count(data: np.ndarray, low: int, high: int, starts: np.ndarray, number: np.ndarray, counts: np.ndarray,
           words: np.ndarray, again: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Add the bytes from ``low`` to ``high`` to the counts of passages; ``seen`` are the words (with their text) before, sorted."""
    size, first = np.diff(starts), np.cumsum(number) - number
    place = np.arange(low, high)
    text = np.searchsorted(starts, place, "right") - 1
    within = place - starts[text]
    row = first[text] + within * number[text] // size[text]
    kind = _KIND[data[low:high]]
    before = np.empty_like(kind)
    before[1:], before[0] = kind[:-1], _KIND[data[low - 1]] if low else 0
    pair = kind + _KINDS * before * (within > 0)  # the first byte of a text has none before it
    counts += np.bincount(row * (_KINDS * _KINDS) + pair, minlength=counts.size).reshape(counts.shape)
    # Words whose letters came before in the same text: the share of each passage.
    blank = kind <= 1
    begin = np.flatnonzero(~blank & ((before <= 1) | (within == 0)))
    if not len(begin):
        return seen
    spot = np.arange(len(kind))
    spot[begin[0]:] -= np.repeat(begin, np.diff(np.append(begin, len(kind))))
    mixed = _WORDS[(spot & 31) * 256 + data[low:high]] * ~blank
    word = np.add.reduceat(mixed, begin) + first[text[begin]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    distinct, at = np.unique(word, return_index=True)
    repeated = np.ones(len(word), bool)
    repeated[at[~np.isin(distinct, seen, assume_unique=True)]] = False
    passage = row[begin]
    words += np.bincount(passage, minlength=len(words))
    again += np.bincount(passage[repeated], minlength=len(again))
    return np.union1d(seen, distinct) if high < len(data) else seen


_WORDS = np.random.default_rng(1).integers(1, 2**63, 32 * 256, dtype=np.uint64)


class Attention:
    """Encoder, gate and classifier. ``run`` scores bags; ``fit`` learns from labels of bags."""

    HIDDEN, GATE = 24, 12

    def __init__(self, prior: float = 0.5):
        rng = np.random.default_rng(3)
        h, g = self.HIDDEN, self.GATE
        draw = lambda *s: rng.normal(0, s[0] ** -0.5, s)
        self.w = {"e": draw(WIDTH, h), "eb": np.zeros(h), "v": draw(h, g), "u": draw(h, g), "a": draw(g, 1)[:, 0],
                  "c": np.zeros(h), "cb": np.zeros(1)}
        self.w["cb"][0] = np.log(prior / (1 - prior))
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, number: np.ndarray) -> dict:
        w, begin = self.w, np.cumsum(number) - number
        h = np.tanh((x - self.mean) / self.scale @ w["e"] + w["eb"])
        t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-np.clip(h @ w["u"], -30, 30)))
        e = (t * s) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), number))
        attention = e / np.repeat(np.add.reduceat(e, begin), number)
        z = np.add.reduceat(h * attention[:, None], begin)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["cb"], -30, 30)))
        return {"h": h, "t": t, "s": s, "attention": attention, "z": z, "p": p, "begin": begin}

    def run(self, x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag, attention of each passage."""
        if not len(number):
            return np.zeros(0), np.zeros(0)
        f = self.forward(x.astype(float), number)
        return f["p"], f["attention"]

    def slopes(self, x: np.ndarray, number: np.ndarray, y: np.ndarray) -> dict:
        w, f = self.w, self.forward(x, number)
        scaled = (x - self.mean) / self.scale
        d = (f["p"] - y) / len(y)
        dz = np.repeat(d[:, None] * w["c"], number, 0)
        dot = (dz * f["h"]).sum(1)
        mean = np.repeat(np.add.reduceat(dot * f["attention"], f["begin"]), number)
        de = f["attention"] * (dot - mean)
        dt = de[:, None] * w["a"] * f["s"] * (1 - f["t"] ** 2)
        ds = de[:, None] * w["a"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (dz * f["attention"][:, None] + dt @ w["v"].T + ds @ w["u"].T) * (1 - f["h"] ** 2)
        return {"e": scaled.T @ dh, "eb": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ ds,
                "a": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ d, "cb": d.sum(keepdims=True)}

    def fit(self, bags: list[tuple[int, np.ndarray]], rounds: int = 40, batch: int = 128) -> Attention:
        every = np.concatenate([b[1] for b in bags])
        self.mean, self.scale = every.mean(0), every.std(0) + 0.02
        rng = np.random.default_rng(4)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for r in range(rounds):
            for some in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // batch)):
                x = np.concatenate([bags[i][1] for i in some]).astype(float)
                number = np.array([len(bags[i][1]) for i in some])
                got, step = self.slopes(x, number, np.array([bags[i][0] for i in some], float)), step + 1
                for k in self.w:
                    g = got[k] + 1e-4 * self.w[k]
                    m[k], v2[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v2[k] + 0.01 * g * g
                    rate = 0.01 * 0.5 * (1 + np.cos(np.pi * r / rounds))
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)
        return self


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE) -> Attention:
    """Fit on at most ``sample`` labelled documents among the allowed ones.

    A document labelled twice counts as good if half its labels are 1. Without rows of both kinds every score is the
    share of good ones (0.5 without labels). Only passage features of the sample come to the driver.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & allowed).groupBy(
        F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_good"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).filter(
        F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).select("_id", "_good", "text")

    def bags(t: pa.Table) -> pa.Table:
        x, number = passages(*text_bytes(t.column("text")))
        ends = np.append(0, np.cumsum(number))
        return pa.table({"_id": t.column("_id"), "_good": t.column("_good"), "x": pa.array(
            [x[a:b].astype(np.float16).tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())})

    rows = sorted(passed(texts, bags, "_id long, _good int, x binary").collect())
    got = [(r[1], np.frombuffer(r[2], np.float16).astype(np.float32).reshape(-1, WIDTH)) for r in rows]
    share = (sum(g for g, _ in got) + 0.5) / (len(got) + 1)
    model = Attention(min(max(share, 0.01), 0.99))
    return model.fit(got) if len({g for g, _ in got}) == 2 else model


def score(docs: DataFrame, model: Attention, good: float = GOOD) -> DataFrame:
    """All columns of ``docs`` (whose names clash are replaced), then score, predicted, and the passage that weighs most.

    Null texts count as empty: one passage without features. Only ``text`` is read by the model.
    """
    names = passing(docs, ["score", "predicted", "top_passage"])
    fields = [docs.schema[n] for n in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def rate(t: pa.Table) -> pa.Table:
        x, number = passages(*text_bytes(t.column("text")))
        p, attention = model.run(x, number)
        begin = np.cumsum(number) - number
        top = np.array([int(attention[a:a + n].argmax()) for a, n in zip(begin, number)], np.int32)
        return t.append_column("score", pa.array(p)).append_column(
            "predicted", pa.array((p >= good).astype(np.int32))).append_column("top_passage", pa.array(top))

    return passed(docs.select(*[F.col(f"`{n}`") for n in names]), rate,
                  f"{schema}, score double, predicted int, top_passage int")
