"""New names that lead to each other, in any order of rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from keepsake.operators import knowledge
from keepsake.operators.roots import roots

MENTION = "owner_id string, seq bigint, canonical_name string, aliases array<string>"
INDEX = "owner_id string, alias string, entity_id string, kind int"


def ids(spark, rows, known=()):
    index = spark.createDataFrame(list(known), INDEX)
    out = knowledge.resolve(spark.createDataFrame(rows, MENTION), index).collect()
    return {(r.owner_id, r.canonical_name): r.entity_id for r in out}, out


@pytest.mark.parametrize("order", list(itertools.permutations(range(4)))[::5])
def test_a_chain_is_one_entity_in_any_order(spark, order):
    chain = [("Ann", ["Bea"]), ("Bea", ["Cy"]), ("Cy", [" DEE "]), ("Dee", None)]
    rows = [("o", i, *chain[k]) for i, k in enumerate(order)] + [("p", i, *chain[k]) for i, k in enumerate(order[:2])]
    rows += [("o", 9, "Eve", ["x"]), ("o", 10, "Fay", [])]
    got, out = ids(spark, rows)
    assert len({got["o", n] for n in ("Ann", "Bea", "Cy", "Dee")}) == 1 and len({got["o", n] for n in ("Ann", "Eve", "Fay")}) == 3
    assert all(r.is_new for r in out) and len(out) == len(rows)
    first = chain[order[0]][0]
    want = spark.range(1).select(knowledge.new_id(F.lit("o"), F.lit(first))).first()[0]
    assert got["o", "Ann"] == want


def test_circles_and_known_names(spark):
    rows = [("o", 1, "A1", ["B1"]), ("o", 2, "B1", ["A1"]), ("o", 3, "Known", ["A1"]), ("o", 4, "C1", ["Known"]), ("o", 5, "C1", ["zz"]),
            ("o", 6, "", []), ("o", 6, "", []), (None, 1, "A1", [])]
    got, out = ids(spark, rows, [("o", "known", "ent_k", 0)])
    assert got["o", "A1"] == got["o", "B1"] and got["o", "Known"] == "ent_k"
    # C1 is known at its fourth row by an alias, and a new name at its fifth.
    assert {r.entity_id == "ent_k" for r in out if r.canonical_name == "C1"} == {True, False}
    assert len(out) == 8


def test_roots_of_random_graphs(spark):
    rng = random.Random(4)
    for n, m in ((1, 0), (40, 25), (60, 59)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m < n - 1 else [(i, i + 1) for i in range(m)]
        place = list(range(n))
        rng.shuffle(place)
        top = list(range(n))
        for _ in range(n):
            for a, b in links:
                least = min(top[a], top[b], key=lambda v: place[v])
                top[a] = top[b] = least
        names = spark.createDataFrame([("o", f"n{i}", place[i]) for i in range(n)], "owner_id string, name string, place int")
        edges = spark.createDataFrame([("o", f"n{a}", f"n{b}") for a, b in links], "owner_id string, name string, other string")
        got = {r.name: r.root for r in roots(names, edges).collect()}
        assert got == {f"n{i}": f"n{top[i]}" for i in range(n)}


def test_mentions_are_read_from_one_table(spark, tmp_path):
    spark.createDataFrame([("o", 1, "Ann", ["Bea"])], MENTION).write.parquet(str(tmp_path / "in"))
    plan = knowledge.resolve(spark.read.parquet(str(tmp_path / "in")), spark.createDataFrame([], INDEX))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") <= 12 and str(tmp_path / "in") not in text
