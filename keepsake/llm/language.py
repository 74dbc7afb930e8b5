"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier on hashed byte trigrams predicts each bit. Decoding weighs the
bits by their logistic loss and takes the nearest codeword. A small lead over the second is flagged as ambiguous.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import blocks, passed, passing, prefix, text_bytes
from keepsake.operators.ranking import top_k

BINS = 2048
#: Most labelled rows of a language that are learned from: those first by a hash of their id.
PER_LANGUAGE = 400
#: Most languages of an exhaustive code; above that codewords are random.
EXHAUSTIVE = 5
#: A smaller lead of the best score over the second is ambiguous.
LEAD = 0.2
UNKNOWN = "und"
BLOCK, SLICE = 1 << 20, 4 << 20
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
# Digits and signs say nothing about a language.
_LOWER[[b for b in range(33, 128) if not chr(b).isalpha()]] = 32


def _bins(data: np.ndarray) -> np.ndarray:
    code = _LOWER[data]
    return ((code[:-2] * 0x9E3779B1 + code[1:-1] * 0x85EBCA77 + code[2:] * 0xC2B2AE3D) >> 13) & (BINS - 1)


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Square roots of the shares of trigrams of each text. Long texts are counted in slices, nothing is cut off."""
    out = np.zeros((len(starts) - 1, BINS), np.float32)
    for a, b in blocks(starts, BLOCK):
        first, last = int(starts[a]), int(starts[b])
        counts = np.zeros((b - a) * BINS, np.int64)
        for at in range(first, last, SLICE):
            bins = _bins(data[at:min(at + SLICE + 2, last)])
            row = 0
            if b - a > 1:
                place = np.arange(at, at + len(bins))
                row = np.searchsorted(starts[a:b + 1], place, "right") - 1
                whole = place + 2 < starts[a + 1 + row]  # the other trigrams end in the next text
                row, bins = row[whole], bins[whole]
            counts += np.bincount(row * BINS + bins, minlength=len(counts))
        counts = counts.reshape(b - a, BINS)
        out[a:b] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    return out


def codewords(languages: int) -> np.ndarray:
    """+1 or -1 for each language and bit: all splits of few languages, else the best of some random codes."""
    if languages <= EXHAUSTIVE:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=max(languages - 1, 0)) if -1 in rest]
        return np.array(splits, np.int64).reshape(len(splits), languages).T
    rng, bits = np.random.default_rng(8), int(np.ceil(10 * np.log2(languages)))
    def apart(code):
        agree = code @ code.T - 2 * bits * np.eye(languages, dtype=np.int64)
        return -agree.max()
    return max((rng.choice([-1, 1], (languages, bits)) for _ in range(50)), key=apart)


class LanguageModel:
    """Names of the languages, their codewords, and a column of weights (the last one added) for each bit."""

    def __init__(self, names: list[str], code: np.ndarray, weights: np.ndarray):
        self.names, self.code, self.weights = names, code, weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Share of each language: nearness of its codeword under the logistic loss of every bit."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :]).sum(2)
        near = np.exp(loss.min(1, keepdims=True) - loss)
        return near / near.sum(1, keepdims=True)


def fit(sample: list[tuple[str, bytes]]) -> LanguageModel:
    """From (language, features as float32 bytes) of the sampled rows; the order of the rows does not matter."""
    sample = sorted(sample)
    names = sorted({s[0] for s in sample})
    code = codewords(len(names))
    weights = np.zeros((BINS + 1, code.shape[1]))
    if not code.size:
        return LanguageModel(names, code, weights)
    x = np.column_stack([np.array([np.frombuffer(s[1], np.float32) for s in sample], float), np.ones(len(sample))])
    which = np.array([names.index(s[0]) for s in sample])
    y = code[which].astype(float)
    weight = (len(sample) / len(names) / np.bincount(which))[which][:, None]  # each language counts alike
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, 251):
        pull = weight * y / (1 + np.exp(np.clip(y * (x @ weights), -30, 30)))
        slope = -(x.T @ pull) / len(x) + 1e-5 * weights
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        weights -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LanguageModel(names, code, weights)


def learn(docs: DataFrame, allowed: Column, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``per_language`` rows of each ``lang`` among the allowed ones.

    Rows without id, text or lang teach nothing. Only features of the sample come to the driver.
    """
    docs = docs.select("doc_id", "text", "lang")
    rows = docs.filter(allowed & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
                       & (F.length("text") > 0)).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    rows = rows.withColumn("_order", F.xxhash64("_id"))
    chosen = top_k(rows, ["_lang"], [F.col("_order"), F.col("_id")], per_language).select("_id", "_lang").distinct()
    texts = docs.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))

    def vectors(t: pa.Table) -> pa.Table:
        x = features(*text_bytes(t.column("text")))
        return pa.table({"lang": t.column("lang"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    return fit([tuple(r) for r in passed(texts.select("lang", "text"), vectors, "lang string, x binary").collect()])


def identify(docs: DataFrame, model: LanguageModel, lead: float = LEAD) -> DataFrame:
    """All columns of ``docs`` (whose names clash are replaced), then lang_pred, score and ambiguous.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if no language was learned.
    """
    names = passing(docs, ["lang_pred", "score", "ambiguous"])
    fields, flag = [docs.schema[n] for n in names], f"{prefix(docs)}lettered"
    # In Spark, for the whole text; only rows with a letter reach the classifiers.
    lettered = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def predict(t: pa.Table) -> pa.Table:
        known = t.column(flag).to_numpy() & bool(model.names)
        pred, score, lead_of = np.full(len(t), UNKNOWN, object), np.zeros(len(t)), np.ones(len(t))
        if known.any():
            data, starts = text_bytes(t.column("text"))
            found = model.scores(features(data, starts))
            best = found.argmax(1)
            top = found[np.arange(len(best)), best]
            second = np.sort(found, 1)[:, -2] if found.shape[1] > 1 else np.zeros(len(best))
            pred[known] = np.array(model.names, object)[best[known]]
            score[known], lead_of[known] = top[known], (top - second)[known]
        t = t.select(names)
        return t.append_column("lang_pred", pa.array(pred, pa.string())).append_column(
            "score", pa.array(score)).append_column("ambiguous", pa.array(lead_of < lead))

    return passed(docs.select(*[F.col(f"`{n}`") for n in names], lettered.alias(flag)), predict,
                  f"{schema}, lang_pred string, score double, ambiguous boolean")
