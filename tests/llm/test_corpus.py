"""Operators on whole tables against brute force, held-out labels or SQL, and the pipeline."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keepsake.llm import components, language, line_spread, near_copies, quality, queries, revisits
from keepsake.llm.common import remainder, table, text_bytes
from tests.llm.conftest import ODD

FOLDER = "/root/testdata/sf0.001"


def found(rows):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)


def all_pairs(docs, k):
    """Shingle sets compared with each other, and what is reached from each."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, top = [], {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append((i, {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}))
        top[i] = i

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if i is not None and j is not None and x and y:
                common = len(x & y)
                if 100 * common >= 80 * (len(x) + len(y) - common):
                    a, b = sorted((root(i), root(j)))
                    top[b] = a
    return Counter((i, len(x), None if i is None else root(i), i is None or root(i) == i) for i, x in sets)


@pytest.mark.parametrize("k", [4, 5])
def test_near_copies_of_odd_rows(odd_wide, none, k):
    assert found(near_copies.near_copies(odd_wide, k).collect()) == all_pairs([r[:2] for r in ODD], k)
    assert near_copies.near_copies(none, k).count() == 0


def test_near_copies_of_a_table(spark):
    docs = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    assert found(queries.op2_near_copies(spark, FOLDER).collect()) == all_pairs(docs, 4)


def test_near_copies_in_large_groups(spark):
    """A group whose members mostly link through one of them, another that shares a passage but no link."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, docs = [word() for _ in range(120)], []
    for i in range(60):  # about 0.86 alike to the base, about 0.75 to each other
        w = list(base)
        for at in rng.sample(range(4, 116), 2):
            w[at] = word()
        docs.append((1000 + i, " ".join(w)))
    docs.append((5000, " ".join(base)))
    passage = [word() for _ in range(60)]
    docs += [(2000 + i, " ".join([word() for _ in range(60)] + passage)) for i in range(60)]
    docs += [(3000 + i, " ".join(base[::-1])) for i in range(40)]  # exact copies
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert found(near_copies.near_copies(df, 4).collect()) == all_pairs(docs, 4)


def test_an_id_links_all_its_texts(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(20)) for x in "abcd")
    rows = [(1, a), (2, b), (5, a), (5, b), (3, c), (7, c), (7, d), (8, d), (7, d), (9, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_copies.near_copies(df).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter(
        [(i, 1 if i in (1, 2, 5, 9) else 3) for i, _ in rows])
    assert {r.doc_id for r in got if r.kept} == {1, 3}


def test_min_max_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    common, own = rng.integers(0, 2**63, 600, dtype=np.uint64), rng.integers(0, 2**63, (2, 200), dtype=np.uint64)
    values = np.concatenate([common, own[0], common, own[1]])
    low, high = near_copies.signatures(values, np.array([800, 800]), 400)
    assert abs(np.mean([low[0] == low[1], high[0] == high[1]]) - 0.6) < 0.06


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [
        (rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    top = {i: i for p in links for i in p}
    for _ in top:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    alone = {i for i in top if all(i not in p or p[0] == p[1] for p in links)}
    assert {r.id: r.component for r in got} == {i: t for i, t in top.items() if i not in alone} and len(got) == len({r.id for r in got})
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_on_held_out_rows(spark):
    rows = queries.op8_language(spark, FOLDER).join(table(spark, FOLDER, "documents"), "doc_id").filter("held_out").collect()
    assert len(rows) > 30 and np.mean([r.lang_pred == r.lang for r in rows]) >= 0.98


def test_language_of_odd_rows(odd_wide, none):
    everything = remainder(F.col("doc_id"), 4) >= 0
    model = language.learn(odd_wide, everything)
    assert model.names == ["en", "fr"] or model.names == ["de", "en", "fr"]
    got = language.identify(odd_wide, model)
    for r in got.collect():
        lettered = bool(r.text) and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1 and (lettered or r.score == 0)
    assert "part" in got.columns and got.columns.count("score") == 1 and got.count() == len(ODD)
    assert language.identify(none, model).count() == 0
    unlearned = language.learn(none, everything)
    assert {r.lang_pred for r in language.identify(odd_wide, unlearned).collect()} == {"und"}
    assert {r.lang_pred for r in language.identify(odd_wide, language.learn(odd_wide, F.col("lang") == "en")).collect()} == {"en", "und"}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert code.shape[0] == n and least >= (2 ** (n - 2) if n <= 5 else 8)


def test_long_texts_count_in_slices(monkeypatch):
    data, starts = text_bytes(pa.array(["ein langer Text " * 50, "", None, "kurz"]))
    whole = language.features(data, starts)
    monkeypatch.setattr(language, "SLICE", 7)
    assert np.allclose(whole, language.features(data, starts))


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op1_quality(spark, folder).join(table(spark, folder, "labels"), "doc_id").filter("held_out").collect()
    right = [np.mean([r.predicted == r.quality for r in rows if r.quality == q]) for q in (0, 1)]
    assert min(right) >= 0.8, right


def test_quality_of_odd_rows(spark, odd_wide, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (7, 0), (None, 1), (5, None), (9, 0), (77, 1)], "doc_id long, quality int")
    every = F.lit(True)
    model = quality.learn(odd_wide, labels, every)
    got = quality.score(odd_wide, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.score(none, model).count() == 0
    prior = quality.learn(odd_wide, labels.limit(0), every)
    assert {round(r.score, 6) for r in quality.score(odd_wide, prior).collect()} == {0.5}


def test_attention_follows_the_slope():
    """Backward pass against differences."""
    rng = np.random.default_rng(0)
    model, number = quality.Attention(), np.array([3, 1, 2])
    x, y = rng.normal(size=(6, quality.WIDTH)), np.array([1.0, 0.0, 1.0])
    model.w["c"] = rng.normal(size=model.HIDDEN)

    def loss():
        p = model.forward(x, number)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    slopes = model.slopes(x, number, y)
    for name, at in (("e", (5, 3)), ("eb", (2,)), ("v", (4, 1)), ("u", (3, 2)), ("a", (1,)), ("c", (6,)), ("cb", (0,))):
        w = model.w[name]
        w[at] += 1e-5
        more = loss()
        w[at] -= 2e-5
        less = loss()
        w[at] += 1e-5
        assert abs((more - less) / 2e-5 - slopes[name][at]) < 1e-6


def test_features_do_not_depend_on_the_neighbours():
    texts = ["ab", "", "x", "Ein Satz.", "été", "word " * 300, "", "\n", "日本", "The end"]
    together, (passages, number) = language.features(*text_bytes(pa.array(texts))), quality.passages(*text_bytes(pa.array(texts)))
    ends = np.append(0, np.cumsum(number))
    for i, t in enumerate(texts):
        assert (together[i] == language.features(*text_bytes(pa.array([t])))[0]).all(), t
        alone, n = quality.passages(*text_bytes(pa.array([t])))
        assert n[0] == number[i] and (passages[ends[i]:ends[i + 1]] == alone).all(), t


def test_line_spread(spark, none):
    common, near = "All pages of all sites carry this line.", "Four sites carry this line."
    docs = [(i, f"Own text {i}, long enough to stay where it is.\n{common}\n" + (near if i < 4 else f"Own end {i}."), "en", f"s{i % 6}", 0)
            for i in range(12)]
    copies = [(100 + i, "A copy that many sites hold.\nWith nothing else.", "en", f"s{i}", 0) for i in range(8)]
    odd = [(None, common, "en", None, 0), (200, None, "en", "s1", 0), (201, "", "en", "s2", 0), (202, "\n \n--\n", "en", "s3", 0),
           (12, docs[0][1], "en", "s0", 0), (12, docs[0][1], "en", "s0", 0), (12, f"{common.upper()}\nAnother text that stands under the same number.", "en", "s1", 0)]
    df = spark.createDataFrame(docs + copies + odd, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumn("n_lines", F.lit("clash")).withColumn("key", F.lit(1))
    got = line_spread.without_boilerplate(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "n_lines", "n_removed"]
    rows = Counter((r.doc_id, r.text, r.n_removed) for r in got.collect())
    gone = lambda t: "\n".join(x for x in t.split("\n") if x.lower() != common.lower())
    want = Counter((i, gone(t), 1) for i, t, *_ in docs + odd[4:]) + Counter((i, t, 0) for i, t, *_ in copies + odd[1:4])
    # A page that is all boilerplate loses all of it; copies of a whole text are one site.
    assert rows == want + Counter([(None, "", 1)])
    heavy = spark.createDataFrame([(300, f"{common}\n" * 20 + "own", "en", "s9", 0)], df.select("doc_id", "text", "lang", "source", "n_chars").schema)
    more = line_spread.without_boilerplate(df.select(*heavy.columns).unionByName(heavy))
    assert more.filter("doc_id = 300").first().text == "own"
    assert line_spread.without_boilerplate(none).count() == 0


def test_lines_near_the_threshold_count_exactly(spark):
    rows = [(n * 1000 + s, f"line {n} for the sites\nown text {s} of {n}", "en", f"site{s}", 0) for n in range(90, 112) for s in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert line_spread.boilerplate(line_spread.line_table(df), sites=100).count() == 12


def record(i, url, s, kind, **headers):
    return (i, url, s, kind, [(k.replace("_", "-"), v) for k, v in headers.items()], f"digest {i}")


def test_revisits(spark):
    records = [
        record(1, "http://Example.com:80/a?b=2&a=1&utm_source=x#top", 100, "response", ETag='"1"', Server="s", Content_Length="9"),
        record(2, "http://example.com/a?a=1&b=2", 200, "response", ETag='"2"', Cache_Control="old", Set_Cookie="c"),
        record(3, "HTTP://example.com/a?b=2&a=1", 150, "revisit", ETag='W/"1"', Content_Length="0", Cache_Control="new"),
        record(4, "http://example.com/a?b=2&a=1", 90000, "revisit", etag='"2"', expires="e"),
        record(5, "http://example.com/a?b=2&a=1", 90001, "revisit", etag='"1"'),
        record(6, "http://example.com/a?b=2&a=1", 100, "revisit", etag='"1"'),
        record(7, "http://example.com/other", 100, "revisit", etag='"1"'),
        record(8, "http://example.com/a?b=2&a=1", 300, "revisit", last_modified="d"),
        record(9, None, 100, "revisit"), record(10, "not a url", 100, "response"), record(11, " not a url", 101, "revisit"),
        record(12, "http://example.com/a?a=1&b=2", None, "revisit", etag='"1"'),
        record(3, "HTTP://example.com/a?b=2&a=1", 150, "revisit", ETag='W/"1"', Content_Length="0", Cache_Control="new"),
        record(13, "http://example.com/a?a=1&b=2", 200, "request"),
        (14, "http://example.com/a?a=1&b=2", 201, "revisit", None, None),
    ]
    schema = "record_id long, url string, s long, kind string, headers array<struct<name:string,value:string>>, payload_digest string"
    df = spark.createDataFrame(records, schema).withColumn("at", F.timestamp_seconds("s")).withColumn("slot", F.lit(3))
    got = {r.record_id: r for r in revisits.resolve(df).collect()}
    assert {i: (r.response_id, r.outcome) for i, r in got.items()} == {
        3: (1, "resolved"), 4: (2, "resolved"), 5: (2, "changed"), 6: (None, "no_response"), 7: (None, "no_response"),
        8: (2, "unproved"), 9: (None, "no_response"), 11: (10, "resolved"), 12: (None, "no_response"), 14: (2, "unproved")}
    assert [tuple(h) for h in got[3].headers] == [
        ("cache-control", "new"), ("content-length", "9"), ("etag", 'W/"1"'), ("server", "s")]
    assert [tuple(h) for h in got[4].headers] == [("cache-control", "old"), ("etag", '"2"'), ("expires", "e"), ("set-cookie", "c")]
    assert got[4].payload_digest == "digest 2" and got[5].headers is None
    assert revisits.resolve(df.limit(0)).count() == 0


def test_revisits_without_id_or_with_one_id(spark):
    rows = [record(1, "http://e.org/", 100, "response", etag='"1"'), record(1, "http://e.org/", 200, "revisit", etag='"1"'),
            record(None, "http://e.org/", 300, "revisit", etag='"1"'), record(None, "http://e.org/", 300, "revisit", etag='"1"'),
            record(None, "http://e.org/", 301, "revisit", etag='"2"'), record(None, "http://f.org/", 1, "response", etag='"3"'),
            record(7, "http://f.org/", 2, "revisit", etag='"3"'), record(7, "http://f.org/", 0, "revisit", etag='"3"')]
    schema = "record_id long, url string, s long, kind string, headers array<struct<name:string,value:string>>, payload_digest string"
    df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("s"))
    got = Counter((r.record_id, r.outcome, r.response_id) for r in revisits.resolve(df).collect())
    # Two rows of id 7 are one, the smaller: it came before the response. A response without id proves as any other.
    assert got == Counter([(1, "resolved", 1), (None, "resolved", 1), (None, "changed", 1), (7, "no_response", None)])
    later = revisits.resolve(df.filter("s <> 0")).filter("record_id = 7").first()
    assert (later.outcome, later.response_id, later.payload_digest) == ("resolved", None, "digest None")


def test_revisits_do_not_depend_on_slots(spark):
    records = revisits.records_of_pages(table(spark, FOLDER, "pages")).withColumn("url", F.lit("http://one.example/"))
    want = None
    for slot in (60, 3600, 10**7):
        got = sorted((r.record_id, r.response_id, r.outcome) for r in revisits.resolve(records, slot).collect())
        assert want is None or got == want
        want = got


def test_pipeline_stages(spark, odd_wide, tmp_path):
    """Each stage on odd rows: its columns, and that it keeps what it should."""
    docs = odd_wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert out.filter("doc_id = 1").count() == (1 if docs.filter("doc_id = 1").count() else 0) or name == "quality_classifier"
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "quality_classifier", "line_dedup", "minhash_near_dedup", "best_fit_packing"]


def test_repeated_rows_of_a_kept_document_stay_once(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "b", 9), (1, text, "en", "a", 9), (2, text, "en", "a", 9), (None, text, "en", "a", 9),
            (None, text, "en", "a", 9), (3, None, "en", "a", 0), (3, None, "en", "a", 0), (4, "", "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.minhash_near_dedup(spark, df, FOLDER).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, text), (None, text), (3, None), (4, "")])


def test_pipeline_against_plain_python(spark):
    """Stages over the table, each against what its operator's brute force says of its own input."""
    docs = table(spark, FOLDER, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER).cache()
        before, after = {r.doc_id: r for r in docs.collect()}, out.collect()
        ids = {r.doc_id for r in after}
        if name == "language_id":
            assert {i for i, r in before.items() if r.text and any(c.isalpha() for c in r.text)} - ids == set()
        if name == "quality_classifier":
            wrong = [i for i in before if i in labels and (i in ids) != (labels[i] == 1)]
            assert len(wrong) <= 0.05 * len(before)
        if name == "line_dedup":
            assert ids == set(before)
            for r in after:
                assert r.n_chars == len(r.text) and set(r.text.split("\n")) <= set(before[r.doc_id].text.split("\n"))
        if name == "minhash_near_dedup":
            want = all_pairs([(i, r.text) for i, r in before.items()], 5)
            assert ids == {i for i, _, _, kept in want if kept}
        if name == "best_fit_packing":
            assert ids == set(before)
            sizes = Counter()
            for r in after:
                sizes[r.sequence_id] += r.length
            assert max(sizes.values()) <= 2048 and len(sizes) <= sum(sizes.values()) / 2048 * 1.02 + 1
        docs = out


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    import verify
    con = verify.connect(FOLDER)
    assert verify.compare(spark, con, FOLDER, name, queries.queries()[name], queries.oracle_sql()[name])[0] is None
    assert isinstance(con, duckdb.DuckDBPyConnection)
