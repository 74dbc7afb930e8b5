"""Texts that hold a term, by the index and by trying all."""

import random

from pyspark.sql import functions as F

from keepsake.operators import retrieval
from keepsake.operators.term_index import TermIndex, runs


def test_index_finds_what_contains_finds(spark):
    rng = random.Random(5)
    letters = "abcdé日 \n😀'"
    texts = [("o%d" % (i % 2), i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))) for i in range(80)] + [("o0", 80, None), ("o1", 81, "ab" * 200)]
    asked = []
    for q in range(60):
        terms = [rng.choice([rng.choice(texts[:80])[2][a:a + rng.randint(1, 6)] for a in (0, 3, 8)] + ["zz", "", " ", "ab"]) for _ in range(rng.randint(0, 4))]
        asked.append(("o%d" % (q % 3), q, terms))
    df = spark.createDataFrame(texts, "owner_id string, id int, low string").repartition(3)
    requests = spark.createDataFrame(asked, "owner_id string, question_id int, terms array<string>")
    got = {(r.id, r.question_id): r.hits for r in retrieval.matching(df, requests).collect()}
    # A term of white space only is no term.
    want = {(i, q): n for o, i, low in texts for p, q, terms in asked if o == p and low is not None
            and (n := sum(t in low for t in terms if t.strip()))}
    assert got == want


def test_runs_of_words(spark):
    words = ["", "a", "ab", "abc", "abcd", "aaaa", "é日x", "x" * 5000]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", runs(F.col("w"), 1, 3).alias("r")).collect()
    for r in rows:
        assert sorted(r.r) == sorted({r.w[i:i + n] for n in (1, 2, 3) for i in range(len(r.w) - n + 1)} or {None}, key=str)


def test_texts_and_requests_are_not_paired(spark):
    """Requests from all texts: what is joined grows with the matches."""
    texts = spark.range(3000).selectExpr("'o' AS owner_id", "id AS seq", "concat('common w', id, ' x', id % 100) AS low")
    requests = texts.selectExpr("owner_id", "seq AS question_id", "array(concat('w', seq, ' x')) AS terms")
    index = TermIndex(texts, ["owner_id"])
    found = index.holding(requests, F.col("terms"), "terms")
    assert retrieval.matches(index, requests).count() == 3000
    # Words that hold "w1" and the like: some thousand, not nine million.
    assert found.count() < 15_000
