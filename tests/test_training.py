"""The training set without a cap, and its batches, where one owner holds most rows."""

import random

import pytest

from keepsake.operators import training


def written_by(n):
    rows = [("hot" if i % 10 else f"o{i % 3}", i, f"slice {i % 2}", f"Text number {i} of many." + " word" * (i * 7 % 90), float(i % 37))
            for i in range(n)]
    return rows + [(None, n, "slice 0", "Text of nobody, with some words in it.", 1.0)]


def ordered(rows):
    def quality(text, score):
        return (10 if 50 <= len(text) <= 500 else 5 if len(text) >= 30 else 0) + min(score / 10, 20) + 5
    by_owner = {}
    for r in sorted(rows, key=lambda r: (-quality(r[3], r[4]), -r[4], r[2], r[1])):
        by_owner.setdefault(r[0], []).append(r)
    return by_owner


def test_training_set_keeps_all_rows(spark):
    rows = written_by(7000)
    df = spark.createDataFrame(rows, "owner_id string, seq bigint, slice string, text string, score double").repartition(5)
    got = training.training_set(df).collect()
    want = {(owner, i + 1, r[1]) for owner, held in ordered(rows).items() for i, r in enumerate(held)}
    assert len(ordered(rows)["hot"]) > 5000
    assert len(got) == len(rows) and {(r.owner_id, r["rank"], r.seq) for r in got} == want


def walked(lengths, max_items, max_chars, separator):
    out, items, chars, batch = [], 0, 0, 0
    for n in lengths:
        if items and (items >= max_items or chars + n + separator > max_chars):
            batch, items, chars = batch + 1, 0, 0
        chars += n + (separator if items else 0)
        items += 1
        out.append(batch)
    return out


@pytest.mark.parametrize("slot, max_items, max_chars", [(8, 5, 60), (8, 8, 40), (16, 3, 1000), (64, 30, 200), (4096, 30, 160)])
def test_batches_are_those_of_a_walk(spark, slot, max_items, max_chars):
    rng = random.Random(slot + max_items)
    owners = {"hot": 700, "o1": 1, "o2": 37, None: 90}
    rows, want = [], {}
    for owner, n in owners.items():
        lengths = [rng.choice([1, 5, 20, rng.randint(1, 90)]) for _ in range(n)]
        # Ranks with gaps, and blank texts between, which no batch counts.
        rows += [(owner, 3 * i + 1, "x" * k) for i, k in enumerate(lengths)] + [(owner, 3 * i + 2, " ") for i in range(0, n, 7)]
        want |= {(owner, 3 * i + 1): b for i, b in enumerate(walked(lengths, max_items, max_chars, 7))}
    df = spark.createDataFrame(rows, "owner_id string, rank bigint, text string").repartition(4)
    got = training.pack(df, max_items, max_chars, slot=slot).collect()
    assert len(got) == len(want) and {(r.owner_id, r["rank"]): r.batch for r in got} == want


def test_no_batches_of_no_texts(spark):
    df = spark.createDataFrame([("a", 1, " ")], "owner_id string, rank bigint, text string")
    assert training.pack(df).columns == ["owner_id", "rank", "text", "batch"] and training.pack(df).count() == 0


def test_no_task_holds_more_than_a_slot(spark):
    rows = spark.range(20_000).selectExpr("'hot' AS owner_id", "id + 1 AS rank", "repeat('x', cast(id % 50 + 1 AS int)) AS text")
    lengths = [i % 50 + 1 for i in range(20_000)]
    got = training.pack(rows, 30, 300, slot=512)
    assert {r["rank"]: r.batch for r in got.collect()} == dict(enumerate(walked(lengths, 30, 300, 7), 1))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan
