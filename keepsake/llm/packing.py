"""Packing of documents into sequences of fixed length, by a linear program over the histogram of lengths.

A configuration says how many pieces of each length share a sequence. The program "fewest configurations that cover
the histogram" has one row a length, however many documents there are; multiplicative weights price the lengths that
lag behind, a knapsack table over the capacity finds the best configurations at these prices, and their fractional
multiplicities add up over the tables. They are rounded down, and the few pieces that are left are packed by the same
tables in whole sequences. The prices also prove how few sequences any packing needs. Documents never leave
Spark: a piece finds its sequence from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.chunks import library_encoder
from keepsake.llm.common import arrow_pass, text_bytes, worker_state, written

CAPACITY = 2048
#: Knapsack tables of the linear program, configurations taken from one, and how fast prices follow what lags behind.
TABLES, COLUMNS, RATE = 150, 48, 4.0
#: Tables for what is left, after which configurations are used up whole.
GENTLE = 400
#: Rows of one length that are ranked together.
RANKED = 1_000_000

Configuration = tuple[tuple[int, int], ...]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of each document: doc_id, piece, start, length, ids_crc32.

    The text (null: empty) is encoded, then ``end_id`` follows. Only documents longer than ``capacity`` are cut: all
    pieces are full but the first, which takes the rest. Repeated rows give repeated pieces; extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))

    def cut(batches):
        encoder = worker_state(("library", tokenizer), lambda: library_encoder(tokenizer))
        for b in batches:
            ids, count = encoder(*text_bytes(b.column("text")))
            ids = np.insert(ids.astype("<u4"), np.cumsum(count), end_id)
            count = count + 1
            # Pieces of each document; the first one's length decides all starts.
            number = -(-count // capacity)
            row = np.repeat(np.arange(len(count)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            first = count - (number - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            raw = memoryview(ids.tobytes())
            at = 4 * ((np.cumsum(count) - count)[row] + start)
            sums = [zlib.crc32(raw[a:a + 4 * n]) for a, n in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                 pa.array(length), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_pass(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity with any number of each length (value[l - 1]; -inf: none), and the last length."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    smallest = int(np.flatnonzero(np.isfinite(value))[0]) + 1
    back = np.zeros(capacity + 1)  # best, turned around, so that both operands are contiguous
    for c in range(smallest, capacity + 1):
        got = value[:c] + back[capacity - c + 1:]
        i = int(got.argmax())
        if got[i] > 0:
            best[c], last[c] = got[i], i + 1
        back[capacity - c] = best[c]
    return best, last


@dataclass
class Plan:
    """Configurations [(length, copies), ...] with the number of sequences that use each; together exactly the histogram.

    No plan needs fewer sequences than ``bound``, which the prices of the linear program prove.
    """

    configurations: list[tuple[Configuration, int]]
    bound: int

    def sequences(self) -> int:
        return sum(times for _, times in self.configurations)


def _prices(ratio: np.ndarray, have: np.ndarray, size: np.ndarray, rate: float) -> np.ndarray:
    """Multiplicative weights: lengths whose covered share lags behind the mean gain, those ahead of it lose.

    They begin as what fills a sequence: the length, and a little more for long pieces, which are hard to place later.
    """
    mean = float((ratio * have * size).sum() / (have * size).sum())
    return size * (1 + 0.05 * size) * np.exp(np.clip(rate * (mean - ratio), -30, 30))


def _configurations(value: np.ndarray, best: np.ndarray, last: np.ndarray, capacity: int, most: int) -> Iterator[tuple[Configuration, float]]:
    """The best configurations at some prices, each with a different length in it, and what they are worth."""
    lengths = np.flatnonzero(np.isfinite(value)) + 1
    worth = value[lengths - 1] + best[capacity - lengths]
    seen = set()
    for i in np.argsort(-worth, kind="stable")[:most].tolist():
        used, room = Counter([int(lengths[i])]), capacity - int(lengths[i])
        while room and (length := int(last[room])):
            used[length] += 1
            room -= length
        made = tuple(sorted(used.items(), reverse=True))
        if made not in seen:
            seen.add(made)
            yield made, float(worth[i])


def linear_program(have: np.ndarray, capacity: int, tables: int = TABLES) -> tuple[dict[Configuration, float], int]:
    """Fractional multiplicities of configurations that about cover ``have`` (pieces of each length), and a lower bound.

    Each table prices the lengths, a knapsack over the capacity finds the best configurations at these prices, and
    these take an equal share of the sequences that the total length asks for. The bound is the dual one: at any prices,
    the value of all pieces divided by that of the best configuration; the best of all tables counts.
    """
    size = np.arange(1, capacity + 1) / capacity
    some = have > 0
    whole = np.maximum(have, 1).astype(float)
    area = float((have * size).sum())
    taken: dict[Configuration, float] = {}
    covered, bound = np.zeros(capacity), max(area, float(have[capacity // 2:].sum()))
    for _ in range(tables):
        price = _prices(covered / whole, have, size, RATE)
        value = np.where(some, price, -np.inf)
        best, last = _knapsack(value, capacity)
        bound = max(bound, float((have * price).sum() / best[capacity]))
        found = [c for c, worth in _configurations(value, best, last, capacity, COLUMNS) if worth >= 0.98 * best[capacity]]
        for c in found:
            step = area / tables / len(found)
            taken[c] = taken.get(c, 0.0) + step
            for length, copies in c:
                covered[length - 1] += copies * step
    return taken, int(np.ceil(bound - 1e-6))


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Round the linear program down to whole sequences, and pack what is left.

    The work depends on the number of different lengths, at most ``capacity``, not on the number of pieces.
    """
    left = np.zeros(capacity, np.int64)
    for length, n in histogram.items():
        left[length - 1] = n
    plan: list[tuple[Configuration, int]] = []
    full = int(left[-1])
    if full:
        plan.append((((capacity, 1),), full))
        left[-1] = 0
    if not left.any():
        return Plan(plan, full)
    taken, bound = linear_program(left, capacity)
    for configuration, share in sorted(taken.items(), key=lambda x: (-x[1], x[0])):
        times = min(int(share), *(int(left[n - 1]) // k for n, k in configuration))
        if times > 0:
            for n, k in configuration:
                left[n - 1] -= k * times
            plan.append((configuration, times))
    return Plan(plan + _residue(left, capacity), bound + full)


def _residue(left: np.ndarray, capacity: int) -> list[tuple[Configuration, int]]:
    """Whole configurations for few pieces of each length: half of what fits at a time, so that prices can follow."""
    plan: list[tuple[Configuration, int]] = []
    whole = np.maximum(left, 1).astype(float)
    size = np.arange(1, capacity + 1) / capacity
    table = 0
    while left.any():
        gentle = table < GENTLE
        price = _prices(1 - left / whole, left, size, 0.5 if gentle else 0.0)
        value = np.where(left > 0, price, -np.inf)
        best, last = _knapsack(value, capacity)
        lengths = np.flatnonzero(left > 0) + 1
        worth = value[lengths - 1] + best[capacity - lengths]
        for rank, seed in enumerate(lengths[np.argsort(-worth, kind="stable")][:COLUMNS].tolist()):
            if not left[seed - 1]:
                continue
            used, room = {seed: 1}, capacity - seed
            short = False
            while room and (length := int(last[room])):
                if used.get(length, 0) < left[length - 1]:
                    used[length] = used.get(length, 0) + 1
                    room -= length
                else:
                    short = True
                    break
            if short:
                if rank:
                    continue
                # Pieces ran out: fill up with the longest that fit and are left.
                for length in lengths[::-1].tolist():
                    while length <= room and used.get(length, 0) < left[length - 1]:
                        used[length] = used.get(length, 0) + 1
                        room -= length
            times = min(int(left[n - 1]) // k for n, k in used.items())
            times = max(1, times // 2 if gentle else times)
            for n, k in used.items():
                left[n - 1] -= k * times
            plan.append((tuple(sorted(used.items(), reverse=True)), times))
        table += 1
    return plan


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces: sequences are filled from 0 without gaps, up to ``capacity``.

    ``cut`` is read several times: it should be a written table. The histogram, at most ``capacity`` rows, goes to
    the driver. Pieces of a frequent length are ranked in salted parts.
    """
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    plan = solve(histogram, capacity).configurations
    by_length = np.zeros(capacity + 2, np.int64)
    for length, n in histogram.items():
        by_length[length + 1] = n
    base = np.cumsum(by_length)  # pieces of shorter lengths
    taken, sequence = base.copy(), 0
    slots = []
    for used, times in plan:
        offset = 0
        for length, copies in used:
            slots.append((taken[length], copies, sequence, offset, length))
            taken[length] += copies * times
            offset += copies * length
        sequence += times
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)

    salts = max(16, -(-max(histogram.values(), default=0) // RANKED))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("length", "_salt", F.coalesce(earlier, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("_place", place).join(before, ["length", "_salt"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_place") - 1).alias("_rank"))

    def assign(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            slot = base[length] + b.column("_rank").to_numpy()
            row = table[np.searchsorted(table[:, 0], slot, "right") - 1] if len(table) else np.zeros((0, 5), np.int64)
            nth = slot - row[:, 0]
            sequence_id = row[:, 2] + nth // row[:, 1]
            offset = row[:, 3] + nth % row[:, 1] * length
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence_id), pa.array(offset)], names=[
                "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                     "sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return pack(written(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
