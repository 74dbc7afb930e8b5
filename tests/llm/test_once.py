"""Costly steps are taken once: rules for a line, merges for a word."""

import base64

from keepsake.llm import cleaning, merge_replay


def test_lines_are_judged_once(spark):
    text = "A good line, as it stands.\nShare this and read more.\n\nno end\nA good line, as it stands."
    out = cleaning.clean(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lorem ipsum") == 1
    row = out.filter("doc_id = 1").first()
    assert (row.n_lines, row.n_bad_lines, row.n_dup_lines, row.lost_chars) == (4, 2, 1, 31)
    assert row.cleaned_text == "A good line, as it stands.\n\nA good line, as it stands."


def test_known_words_are_not_replayed(tmp_path, monkeypatch):
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    replayed, replay = [], merge_replay.replay
    monkeypatch.setattr(merge_replay, "replay", lambda words, *a: replayed.extend(words) or replay(words, *a))
    long = "c" * 100
    encoder = merge_replay.replay_encoder(str(path), r"\w+|\W")
    for text, ids in (("abc", [257]), ("abc,ab", [257, 44, 256]), ("ab," + long, [256, 44] + [99] * 100), (long, [99] * 100)):
        got, count = encoder.encode([text.encode()])
        assert got.tolist() == ids and count.tolist() == [len(ids)]
    # Long words are not kept.
    assert replayed == [b"abc", b",", b"ab", long.encode(), long.encode()]


def test_words_of_one_length_are_replayed_together(monkeypatch):
    import random

    rng = random.Random(3)
    ranks = {bytes([b]): b for b in range(256)}
    # Ranks at random: merged tokens may rank below their parts.
    made = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(200)})
    ranks |= {t: 256 + i for i, t in enumerate(rng.sample(made, len(made)))}
    words = [bytes(rng.choice(b"abcd\xc3") for _ in range(rng.randint(0, 100))) for _ in range(400)] + [b"", b"a", b"a" * 64, b"a" * 65]
    want = merge_replay._by_index(words, ranks, None, None)
    indexed, by_index = [], merge_replay._by_index
    monkeypatch.setattr(merge_replay, "_by_index", lambda some, *a: indexed.extend(some) or by_index(some, *a))
    assert merge_replay.replay(words, ranks) == want
    assert sorted(indexed) == sorted(w for w in words if len(w) > merge_replay.SHORT)
