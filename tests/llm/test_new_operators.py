"""Runs, alignment and mixtures against plain Python."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keepsake.llm import alignment, chunks, mixing, periodic, queries
from tests.llm.conftest import CLASHING, COLUMNS, ODD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = r"[^\x20\x09-\x0D]+"


def plain_runs(x, shortest=12):
    """(start, length, period) of all runs, period by period."""
    out, n = {}, len(x)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("widest", [1 << 14, 4, 2])
def test_runs_of_random_texts(widest):
    rng = np.random.default_rng(7)
    for _ in range(60):
        texts = []
        for _ in range(int(rng.integers(1, 7))):
            n, kinds, p = int(rng.integers(0, 150)), int(rng.integers(1, 5)), int(rng.integers(1, 150))
            x = rng.integers(0, kinds, n).tolist()
            texts.append([x, (x[:p] * n)[:n], fibonacci(n), [*(x[:p] * n)[:n // 2], 9, *(x[:p] * n)[:n // 2]]][int(rng.integers(0, 4))])
        words = np.array([w for x in texts for w in x], np.int64)
        got = periodic.runs_of(words, np.append(0, np.cumsum([len(x) for x in texts])), widest=widest)
        assert got.tolist() == [[t, *r] for t, x in enumerate(texts) for r in plain_runs(x)]


def test_transform_is_a_convolution():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, periodic.PRIME, (2, 64, 5))
    got = periodic.back(periodic.folded(periodic.folded(
        periodic.folded(periodic.folded(periodic.transform(a))) * periodic.folded(periodic.folded(periodic.transform(b))))))
    want = [[sum(int(a[i, c]) * int(b[(k - i) % 64, c]) for i in range(64)) * 64 % periodic.PRIME for c in range(5)] for k in range(64)]
    assert (got % periodic.PRIME).tolist() == want


def test_numbers_alike_modulo_the_prime_are_not_words_alike():
    # Words 0 and PRIME have one value in the transform, and hashes that agree are checked word by word.
    x = np.array([0, 1, 2, periodic.PRIME, 1, 2] * 6)
    assert periodic.runs_of(x, np.array([0, len(x)])).tolist() == [[0, 0, 36, 6]]
    class Blind(periodic.WordSequence):
        def same(self, i, d, k):
            return np.ones(len(i), bool)
    got = periodic._extended(Blind(x, np.array([0, len(x)])), np.array([4, 7]), np.array([6, 3]), 0, 12)
    assert got.tolist() == [[0, 36, 6]]


def test_very_long_text_keeps_memory_in_step():
    x = np.tile(np.arange(70_000), 5)  # blocks wider than one transform
    assert periodic.runs_of(x, np.array([0, len(x)])).tolist() == [[0, 0, 350_000, 70_000]]


def run_digest(doc_id, text):
    words = re.findall(WORD, text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words) if n < 3000 else None
    if runs is None:  # one word over and over, then another word
        runs = [(0, 30000, 1)]
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(kept))


def test_runs_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = [run_digest(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len((r.text or "").split()) < 3000]
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(want) > 150 and [got[w[0]] for w in want] == want and sum(w[1] > 0 for w in want) > 5


def test_runs_of_odd_rows(spark, odd_wide, none):
    wide = odd_wide.select("*", F.lit(1).alias("runs"), F.lit("x").alias("Collapsed"))
    found = periodic.find_runs(wide)
    assert found.columns == [c for c in wide.columns if c.lower() not in ("runs", "collapsed", "n_words")] + ["n_words", "runs", "collapsed"]
    rows = found.select("doc_id", "text", "n_words", "runs", "collapsed", "score").collect()
    assert len(rows) == len(ODD) and {r.score for r in rows} == {CLASHING.index("score")}
    for r in rows:
        words = re.findall(WORD, r.text or "")
        assert r.n_words == len(words)
        if r.doc_id == 9:
            assert [tuple(x) for x in r.runs] == [(0, 30000, 1)] and r.collapsed == "word " + "x" * 5000
        elif r.doc_id == -10:
            assert [tuple(x) for x in r.runs] == [(0, 12, 3)] and r.collapsed == "same line here. other words."
        else:
            assert r.runs == [] and r.collapsed == " ".join(words)
    assert periodic.find_runs(none).count() == 0


def plain_alignment(texts):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=B)
    bytes_a, bytes_b = alignment.level_bytes(A), alignment.piece_bytes(B)
    rows, links = [], Counter()
    for x in texts:
        a = t.encode(" " + x, add_special_tokens=False).ids if x else []
        b = m.encode(x) if x else []
        whole = (" " + x).encode() if x else b"?"
        if b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            rows.append(None)
            continue
        ends_a, ends_b = (np.cumsum([len(y[i]) for i in z]).tolist() for y, z in ((bytes_a, a), (bytes_b, b)))
        groups, own, i, j = [], [], 0, 0
        for c in sorted({*ends_a} & {*ends_b}):
            i2, j2 = ends_a.index(c, i) + 1, ends_b.index(c, j) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            own.append((a[i2 - 1], b[j2 - 1]))
            i, j = i2, j2
        rows.append((len(a), len(b), groups, own))
        links.update(own)
    best = {}
    for (_, b), n in links.items():
        best[b] = max(best.get(b, 0), n)
    return links, [(0,) * 6 + ("",) if r is None else (
        r[0], r[1], len(r[2]), len(r[3]), sum(links[k] == best[k[1]] for k in r[3]), sum(links[k] for k in r[3]),
        hashlib.sha256(";".join(r[2]).encode()).hexdigest()) for r in rows]


STRANGE = ["<s> </s> <unk> <0x41>", "a▁b", "▁", " ", "  ", "\n", "\n\n x", "x \n ", " lead", "tab\tsep\r\nend\r", "  two  gaps  ", "é é \U0001f600 日本",
           "\x00 \x01", "ab" * 400, "a<|endoftext|>b <|endoftext|>", "don't  'll", "1234567 8,9.0", "{\r\n}\r\n ;\r x;\r"]


@pytest.mark.parametrize("block", [9, 2 << 20])
def test_alignment_of_texts(monkeypatch, block):
    monkeypatch.setattr(chunks, "BLOCK", block)
    from keepsake.llm.common import text_bytes
    import pyarrow as pa
    texts = [t for _, t, *_ in ODD] + STRANGE + STRANGE
    if block < 100:
        texts = [t and t[:3000] for t in texts]
    _, want = plain_alignment(texts)
    aligner = alignment.Aligner(A, B)
    for _ in range(2):
        got = list(aligner.aligned(*text_bytes(pa.array([" " + t if t else "" for t in texts]))))
        assert [tuple(map(int, g[1:4])) + (g[4],) for g in got] == [w[:3] + w[6:] for w in want]
        assert [int(np.sum(g[6])) for g in got] == [w[3] for w in want]


def test_alignment_tables_are_bounded():
    aligner = alignment.Aligner(A, B)
    aligner.most = 5
    from keepsake.llm.common import text_bytes
    import pyarrow as pa
    for i in range(6):
        list(aligner.aligned(*text_bytes(pa.array([" " + " ".join(f"w{i}x{j}" + "y" * 70 for j in range(9))]))))
        assert aligner.rows < 30


def test_alignment_of_rows(spark, odd_wide, none):
    more = spark.createDataFrame([(100 + i, t, "en", "z", 1) for i, t in enumerate(STRANGE)] + [(7, "tie", None, None, 0)] * 3, COLUMNS)
    wide = odd_wide.unionByName(more.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]))
    wide = wide.select("*", F.lit(5).alias("N_A"), F.lit(b"k").alias("key_"))
    rows = [(r.doc_id, r.text) for r in wide.collect()]
    links, measures = plain_alignment([t for _, t in rows])
    made = alignment.align(wide, A, B)
    assert made.measures.columns == [c for c in wide.columns if c not in ("text", "N_A")] + alignment.MADE
    got = Counter(map(tuple, made.measures.select("doc_id", *alignment.MADE).collect()))
    assert got == Counter((i, *m) for (i, _), m in zip(rows, measures))
    assert {(r.a, r.b): r.links for r in made.pairs.collect()} == links
    most = {b: max(n for (_, y), n in links.items() if y == b) for _, b in links}
    assert all(r.best == (r.links == most[r.b]) for r in made.pairs.collect())
    assert alignment.align(none, A, B).measures.count() == 0


def test_alignment_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    _, want = plain_alignment([r.text for r in docs])
    got = Counter(map(tuple, queries.op12_alignment(spark, "/root/testdata/sf0.001").collect()))
    assert got == Counter((r.doc_id, *w) for r, w in zip(docs, want))


def plain_targets(sizes, weights, share, most):
    """The excess of full sources goes to the others, round by round."""
    target, open_ = {s: Fraction(0) for s in sizes}, set(sizes)
    left = share * sum(sizes.values())
    while open_ and left > 0:
        total, rest = sum(weights[s] for s in open_), Fraction(0)
        for s in list(open_):
            target[s] += left * weights[s] / total
            if target[s] > most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = Fraction(most * sizes[s])
                open_.discard(s)
        left = rest
    return target


def sources_of(rows):
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(re.findall(WORD, text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    return {s: sizes[s] for s in order}, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}


def test_mixture_of_odd_rows(odd_wide, none):
    wide = odd_wide.select("*", F.lit(1).alias("Size"), F.lit(2).alias("target"))
    mixed = mixing.mix(wide).cache()
    assert mixed.columns == [c for c in wide.columns if c.lower() not in mixing.MADE] + mixing.MADE
    rows = mixed.collect()
    sizes, weights = sources_of(ODD)
    target = plain_targets(sizes, weights, mixing.SHARE, mixing.MOST)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((d, t) for d, t, *_ in ODD)
    taken = Counter()
    for r in rows:
        assert r.size == len(re.findall(WORD, r.text or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(target[r.source])) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(target[s]) for s in sizes)
    again = mixing.mix(wide.repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in rows) == Counter((r.doc_id, r.size, r.taken) for r in again)
    rounds = mixing.rounds(mixed).collect()
    words = Counter()
    for r in rounds:
        assert len(re.findall(WORD, r.text)) == r.words > 0
        words[r.source] += r.words
    assert words == +taken
    assert mixing.mix(none).count() == 0


def test_mixture_where_the_order_is_by_key(spark):
    rows = [(i, "w " * (i % 7), "en", f"s{i % 2}", 0) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, COLUMNS), weights=(9, 1), share=Fraction(1), most=3)
    for source in ("s0", "s1"):
        some = sorted((hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest(), r) for r in got.filter(F.col("source") == source).collect())
        budget, size = int(some[0][1].target), sum(r.size for _, r in some)
        whole, rest = divmod(budget, size)
        for _, r in some:
            part = max(0, min(r.size, rest))
            assert r.taken == whole * r.size + part
            rest -= r.size
    assert {r.target for r in got.collect()} == {1077.3, 119.7}  # of 57 * (0 + ... + 6) words


@pytest.mark.parametrize("sizes", [[1, 100, 100], [0, 0, 0], [5, 1, 1, 1, 1, 200], [1, 2, 4, 8, 16, 32, 64, 128, 256]])
def test_targets(spark, sizes):
    weights = {i: mixing.WEIGHTS[i % 3] for i in range(len(sizes))}
    df = spark.createDataFrame([(i, s, weights[i]) for i, s in enumerate(sizes)], "id int, size long, weight long")
    want = plain_targets(dict(enumerate(sizes)), weights, mixing.SHARE, mixing.MOST)
    assert {r.id: r.target for r in mixing.targets(df).collect()} == pytest.approx({i: float(t) for i, t in want.items()})


def test_words_are_counted_like_matches(spark):
    texts = ["", " ", "a", " a b ", "a\x0bb\x0cc\r\nd\te", "é x 　y", "x" * 99, None, "x\x00y z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(mixing.n_words(F.col("text"))).collect()] == [len(re.findall(WORD, t or "")) for t in texts]
