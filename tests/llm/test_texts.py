"""Operators on single texts against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keepsake.llm import chunks, cleaning, merge_replay, order_minhash, packing, token_files
from keepsake.llm.common import new_path, text_bytes
from tests.llm.conftest import ODD

TEXTS = [t or "" for _, t, *_ in ODD] + ["don't 'S it'll 'tis", "a <|endoftext|> b", "x<|startoftext|><|endoftext|>y  <|endoftext|>  z <|ENDOFTEXT|>", " lead\n\n two  gaps ", "ÀÉ Straße naïve", "a\r\nb\x1cc"]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_give_the_ids_of_whole_texts(name):
    encoder = chunks.library_encoder(public_tokenizers.path(name))
    for _ in range(2):  # the second time from what is kept
        ids, count = encoder(*text_bytes(pa.array(TEXTS)))
        got = [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
        assert got == library(name)(TEXTS)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_as_text(name):
    encoder = chunks.library_encoder(public_tokenizers.path(name), added=False)
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    ids, count = encoder(*text_bytes(pa.array(TEXTS)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [
        e.ids for e in t.encode_batch(TEXTS, add_special_tokens=False)]


@pytest.mark.parametrize("size", [7, 50, 1000])
def test_long_texts_in_parts(monkeypatch, size):
    monkeypatch.setattr(chunks, "BLOCK", size)
    test_chunks_give_the_ids_of_whole_texts("byte_bpe_50k.json")


def test_kept_chunks_are_bounded():
    encoder = chunks.ChunkEncoder(lambda cs: chunks.flat([[len(c)] for c in cs]), most=3)
    for i in range(9):
        ids, count = encoder(*text_bytes(pa.array([f"a{i} bb{i} ccc{i}"])))
        assert ids.tolist() == [2, 4, 5] and count.tolist() == [3] and len(encoder.keys) <= 6


def reference_encoding():
    ranks = merge_replay.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_replay_is_the_merge_order():
    encoding, ranks = reference_encoding()
    words = [w.encode() for t in TEXTS for w in re.findall(r" ?\w+|\W", t)] + [b"", b"aaaaaaa", b"abababab", bytes(range(256))]
    assert merge_replay.replay(words, ranks) == [encoding._core_bpe.encode_single_piece(w) if w else [] for w in words]


def test_a_pair_that_goes_first_is_not_passed_over():
    # "aba" ranks below "ab", so it goes first as soon as it can.
    ranks = {bytes([b]): b for b in range(256)} | {b"aba": 300, b"ab": 301, b"abab": 302, b"ba": 900}
    words = [b"abab", b"ababab", b"aabab"]
    encoding = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
    assert merge_replay.replay(words, ranks) == [encoding._core_bpe.encode_single_piece(w) for w in words]


def test_merge_replay_round_trip(odd_wide, none):
    encoding, ranks = reference_encoding()
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = merge_replay.encode(odd_wide, path, public_tokenizers.PATTERN)
    got = merge_replay.digests(tokens, path).collect()
    want = []
    for i, t, *_ in ODD:
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    data = merge_replay.decode(tokens, path).select("data").collect()
    assert Counter(bytes(r.data) for r in data) == Counter((t or "").encode() for _, t, *_ in ODD)
    assert merge_replay.encode(none, path, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark, odd_wide, none):
    path = new_path(spark, "tokens")
    name = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(odd_wide, path, name, 2)
    got = token_files.checksums(token_files.read_tokens(spark, path)).orderBy("start").collect()
    rows = sorted(((i, t or "") for i, t, *_ in ODD), key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for (i, _), ids in zip(rows, library("word_bpe_49k.json")([t for _, t in rows])):
        ids = ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    part = token_files.read_tokens(spark, path, first=5, last=7, ids=False)
    assert "ids" not in part.columns and sorted(r.doc_id for r in part.collect()) == [5, 6, 6, 7]
    empty = new_path(spark, "tokens")
    token_files.write_tokens(none, empty, name, 2)
    assert token_files.checksums(token_files.read_tokens(spark, empty)).count() == 0


def test_token_files_are_encoded_as_said(spark, odd):
    import glob

    import pyarrow.parquet as pq
    path = new_path(spark, "tokens")
    token_files.write_tokens(odd.repartition(1), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    group = pq.ParquetFile(glob.glob(f"{path}/part-*.parquet")[0]).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert all(c.has_offset_index for c in columns.values())
    assert columns["doc_id"].has_column_index


def test_pieces_and_packing(odd_wide, none):
    name = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.packed(odd_wide, name, 0).collect()
    want = []
    for (i, t, *_), ids in zip(ODD, library("byte_bpe_50k.json")([t or "" for _, t, *_ in ODD])):
        ids, at, piece = np.array(ids + [0], "<u4"), 0, 0
        while at < len(ids):
            n = (len(ids) - at) % 2048 or 2048
            want.append((i, piece, at, n, zlib.crc32(ids[at:at + n].tobytes())))
            at, piece = at + n, piece + 1
    assert Counter(tuple(r)[:5] for r in rows) == Counter(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.packed(none, name, 0).count() == 0


@pytest.mark.parametrize("histogram", [{}, {2048: 7}, {1: 5}, {1500: 3, 548: 2, 100: 40}, {1025: 10}, {n: n % 7 for n in range(1, 900) if n % 7}])
def test_plan_covers_the_histogram(histogram):
    plan, back = packing.solve(histogram), Counter()
    for used, times in plan.configurations:
        assert sum(n * k for n, k in used) <= 2048 and times > 0
        for n, k in used:
            back[n] += k * times
    assert back == Counter(histogram)
    # No worse than one sequence in a hundred above what any packing needs.
    least = max(-(-sum(n * k for n, k in histogram.items()) // 2048), sum(k for n, k in histogram.items() if n > 1024))
    assert least * 0.999 <= plan.bound <= plan.sequences() <= least * 1.01 + 1


def test_linear_program_covers_and_bounds():
    """Thirds and halves: the bound is the optimum, which the total length does not show."""
    have = np.zeros(100, np.int64)
    have[[33, 50]] = 3000, 1000  # 34 twice beside nothing else, or 51 with 34
    taken, bound = packing.linear_program(have, 100)
    assert 1900 <= bound <= 2000 and bound > (34 * 3000 + 51 * 1000) / 100 + 100
    for length in (34, 51):
        assert sum(dict(c).get(length, 0) * x for c, x in taken.items()) >= 0.7 * have[length - 1]
    assert packing.solve({34: 3000, 51: 1000}, 100).sequences() == 2000


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))


def test_cleaning(spark, odd_wide, none):
    got = cleaning.clean(odd_wide)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((r.doc_id, *[r[n] for n in names]) for r in got.collect()) == Counter(
        (i, *plain_counts(t)) for i, t, *_ in ODD)
    assert {"key", "part"} <= set(got.columns) and got.columns.count("kept") == 1
    assert cleaning.clean(none).count() == 0
    lines = ["This is a sentence that stands.", "Home | News | Sport | More", "BUY NOW!! CHEAP!!", "word*** other### third$$$",
             "no sentence in here", "Click here to go on.", ""]
    one = spark.createDataFrame([("\n".join(lines),)], "text string")
    row = cleaning.clean(one).first()
    assert row.cleaned_text == lines[0] + "\n" and row.n_bad_lines == 5 and not row.kept
    rules = one.select(F.transform(F.split("text", "\n"), cleaning.failed_rule).alias("r")).first().r
    assert rules == [None, "navigation", "shouting", "symbols", "no_sentence", "boilerplate", None]
    scripts = ["这是一个完整的句子。", "これは文です。", "यह एक वाक्य है।", "هل هذه جملة؟", "Ist das ein Satz?", "ይህ ዓረፍተ ነገር ነው።"]
    rules = spark.createDataFrame([(x,) for x in scripts], "x string").select(cleaning.failed_rule(F.col("x")).alias("r")).collect()
    assert [r.r for r in rules] == [None] * len(scripts)


def test_order_minhash(spark, odd_wide, none):
    rows = order_minhash.compare_edits(odd_wide).collect()
    assert len(rows) == len(ODD)
    # Repeated rows are one document in the order.
    order = sorted({(i is not None, i or 0, t or "") for i, t, *_ in ODD}, reverse=True)
    after = {order[n][:2]: order[(n + 1) % len(order)][2] for n in range(len(order))}
    for r in rows:
        key = (r.doc_id is not None, r.doc_id or 0)
        text = next(o[2] for o in order if o[:2] == key)
        n = len(text)
        assert r.n_chars == n and r.edited == text[:n - n // 3] + after[key][:n // 3]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.edited == text:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    same = {r.fingerprint for r in rows if r.doc_id in (1, 6)}
    assert len(same) == 1
    assert order_minhash.compare_edits(none).count() == 0


def test_order_minhash_follows_order_and_repeats(spark):
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words), " ".join(words[300:] + words[:300]), " ".join(words[:580] + ["x"] * 20), " ".join(["a b c"] * 200),
             " ".join(["a b c"] * 100)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    fp = order_minhash.with_fingerprint(df, "text", "fp")
    near = {(r.a, r.b): r.n for r in fp.alias("x").crossJoin(fp.alias("y")).select(
        F.col("x.i").alias("a"), F.col("y.i").alias("b"), order_minhash.likeness(F.col("x.fp"), F.col("y.fp")).alias("n")).collect()}
    assert near[0, 0] == 1 and near[0, 2] > 0.8 and near[0, 3] == 0
    assert near[0, 1] < 0.75  # the same k-mers nearly, in another order
    assert near[3, 4] < 1  # the same k-mers, but fewer occurrences


@pytest.mark.parametrize("n", [6, 20, 40, 80, 160])
def test_order_counts_in_short_texts(spark, n):
    words = [f"w{i}" for i in range(n)]
    texts = [" ".join(words), " ".join(words[n // 2:] + words[:n // 2]), " ".join(words[:-1] + ["x"])]
    fp = order_minhash.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "fp")
    a, b, c = (r.fp for r in fp.orderBy("i").collect())
    swapped, edited = (len(set(a) & set(x)) / 64 for x in (b, c))
    assert len(a) == len(b) == 64 and swapped < 0.75 and (n < 40 or edited > swapped)


def plain_fingerprint(spark, text, k=order_minhash.K):
    """Minimal k-mers of every order, by trying them all, from the hashes that Spark gives."""
    words = re.findall(r"[\u4e00-\u9fff\u3040-\u30ff]|[^\x20\x09-\x0d\u4e00-\u9fff\u3040-\u30ff]{1,16}", text)
    grams = [words[i:i + k] for i in range(max(len(words) - k, 0) + 1)] if words else []
    if not grams:
        return []
    row = lambda g: F.xxhash64(*[F.lit(w) for w in g + [None] * (k - len(g))])
    hashed = list(spark.range(1).select(*[row(g) for g in grams]).first())
    seen, items = Counter(), []
    for at, h in sorted(enumerate(hashed), key=lambda x: (x[1] >> 30, x[0])):
        items.append((h >> 30, seen[h >> 30], at))
        seen[h >> 30] += 1
    numbered = list(spark.range(1).select(*[F.xxhash64(F.lit(h).cast("long"), F.lit(n)) for h, n, _ in items]).first())
    circle = sorted(((v >> 30) << 30 | at) for v, (_, _, at) in zip(numbered, items))
    out = []
    for order in range(64):
        start = (order - 32) << 58
        i = next((i for i, x in enumerate(circle) if x >= start), 0)
        pair = [circle[i], circle[(i + 1) % len(circle)]] if len(circle) > 1 else [circle[i]]
        pair.sort(key=lambda x: x & ((1 << 30) - 1))
        out.append((order, [x >> 30 for x in pair]))
    values = list(spark.range(1).select(*[F.xxhash64(*[F.lit(x).cast("long") for x in p]) for _, p in out]).first())
    return [(o << 25) | (v & ((1 << 25) - 1)) for (o, _), v in zip(out, values)]


def test_fingerprints_against_all_kmers(spark):
    texts = ["", "one", "one two", "a b a b a b a b", "日本語 テスト x", " ".join(f"w{i % 37}" for i in range(90))]
    fp = order_minhash.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "fp")
    for r in fp.collect():
        assert [v & 0xFFFFFFFF for v in r.fp] == plain_fingerprint(spark, r.text), r.text
