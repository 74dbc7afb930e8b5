"""Two tokenizers side by side: which of their tokens end together, in every text and over the whole corpus.

Rows are shuffled by their full text, so that every distinct text is encoded and aligned once and carries its number of
rows. Inside a task the work is shared once more: texts are cut into chunks at places where both tokenizers always have
a border, and a chunk met before is not aligned again. Linked tokens end at the same byte, so one's bytes end the
other's: the two vocabularies alone say which pairs can occur, a few hundred thousand, however large the corpus. Pair
counts are sums over that fixed list, which bounds what tasks send and what goes back to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.chunks import ChunkEncoder, Encoded, flat, gather, library_encoder, spans
from keepsake.llm.common import arrow_pass, passing, prefix, text_bytes, worker_state, written

MADE = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
#: Ids of the second tokenizer are below 2 ** SHIFT.
SHIFT = 24


def level_bytes(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level file stands for."""
    import json

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def piece_bytes(path: str) -> list[bytes]:
    """The bytes that each id of a piece model stands for."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def piece_encoder(path: str) -> Callable[[list[bytes]], Encoded]:
    """Encodes chunks as a piece model does inside a text: the space that it puts before a text is there already."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    space = model.piece_to_id("▁")
    if any("▁" in p.lstrip("▁") or "\n" in p for p in map(model.id_to_piece, range(model.get_piece_size()))):
        raise ValueError(f"pieces of {path} reach over white space")

    def encode(chunks: list[bytes]) -> Encoded:
        # The model adds a space in front: it takes the place of the chunk's own, or is taken off again.
        own = [c.startswith(b" ") for c in chunks]
        ids = model.encode([c.decode()[o:] for c, o in zip(chunks, own)], num_threads=1)
        return flat([(x or [space]) if o else x[1:] for x, o in zip(ids, own)])

    return encode


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted numbers (id of a << SHIFT | id of b) of all pairs of which one's bytes end the other's."""
    by_bytes: list[dict[bytes, list[int]]] = [{}, {}]
    for tokens, ids in zip((a, b), by_bytes):
        for i, t in enumerate(tokens):
            if t:
                ids.setdefault(t, []).append(i)
    in_a, in_b = by_bytes
    pairs = [i << SHIFT | j for i, t in enumerate(a) for k in range(len(t)) for j in in_b.get(t[k:], ())]
    pairs += [i << SHIFT | j for j, t in enumerate(b) for k in range(1, len(t)) for i in in_a.get(t[k:], ())]
    return np.unique(np.array(pairs, np.int64))


class Aligner(ChunkEncoder):
    """Tables of chunks: how many tokens and groups, the groups as text, and the linked pairs by number.

    A chunk's "id", which the parent keeps and looks up, is its row in these tables.
    """

    def __init__(self, path_a: str, path_b: str):
        self.encode_a, self.encode_b = library_encoder(path_a, added=False).encode, piece_encoder(path_b)
        self.bytes_a, self.bytes_b = level_bytes(path_a), piece_bytes(path_b)
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.pairs = possible_pairs(self.bytes_a, self.bytes_b)
        super().__init__(self._rows)

    def forget(self) -> None:
        super().forget()
        self.rows = 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def _rows(self, chunks: list[bytes]) -> Encoded:
        """Align chunks and add them to the tables."""
        (a, of_a), (b, of_b) = self.encode_a(chunks), self.encode_b(chunks)
        a, b = a.astype(np.int64), b.astype(np.int64)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        good = np.ones(len(chunks), bool)
        ends, raw = [], b"".join(chunks)
        for ids, count, sizes, tokens in ((a, of_a, self.size_a, self.bytes_a), (b, of_b, self.size_b, self.bytes_b)):
            chunk = np.repeat(np.arange(len(chunks)), count)
            good &= np.bincount(chunk, sizes[ids], len(chunks)).astype(np.int64) == size
            if b"".join(map(tokens.__getitem__, ids.tolist())) != raw:  # else all are equal
                stop = np.cumsum(count)
                good &= np.fromiter((b"".join(tokens[i] for i in ids[s - n:s].tolist()) == c
                                     for c, s, n in zip(chunks, stop, count)), bool, len(chunks))
            within = np.cumsum(sizes[ids])
            within -= np.repeat(within[np.cumsum(count) - 1] - np.bincount(chunk, sizes[ids], len(chunks)).astype(np.int64), count)
            ends.append(chunk << 40 | within)
        # Where both end; chunks whose bytes differ count for nothing.
        _, last_a, last_b = np.intersect1d(*ends, assume_unique=True, return_indices=True)
        chunk = ends[0][last_a] >> 40
        keep = good[chunk]
        chunk, last_a, last_b = chunk[keep], last_a[keep], last_b[keep]
        groups = np.bincount(chunk, minlength=len(chunks))
        link = np.searchsorted(self.pairs, a[last_a] << SHIFT | b[last_b])
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        # A chunk's first group begins where its tokens do, others after the group before.
        new = np.ones(len(chunk), bool)
        new[1:] = chunk[1:] != chunk[:-1]
        first_a = np.where(new, (np.cumsum(of_a) - of_a)[chunk], np.append(0, last_a[:-1] + 1))
        first_b = np.where(new, (np.cumsum(of_b) - of_b)[chunk], np.append(0, last_b[:-1] + 1))
        shown = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])};" for i, j, k, m in zip(
            first_a.tolist(), (last_a + 1).tolist(), first_b.tolist(), (last_b + 1).tolist())]
        length = np.bincount(chunk, np.fromiter(map(len, shown), np.int64, len(shown)), len(chunks)).astype(np.int64)
        self.parts.append((of_a, of_b, groups, good, length, link, np.frombuffer("".join(shown).encode(), np.uint8)))
        row = self.rows + np.arange(len(chunks))
        self.rows += len(chunks)
        return row.astype(np.uint32), np.ones(len(chunks), np.int64)

    def _tables(self) -> tuple[np.ndarray, ...]:
        if len(self.parts) > 1:
            self.parts = [tuple(map(np.concatenate, zip(*self.parts)))]
        return self.parts[0]

    def aligned(self, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple]:
        """Of each text: is it aligned, numbers of tokens, groups, SHA-256 of the groups, pairs and how often each occurs."""
        open_text = None  # a long text comes in several runs
        for first, last, places in spans(data, starts):
            held = self.rows
            row, count = self._block(data[places[0]:places[-1]], places - places[0])
            if not len(row):
                yield from ((False, 0, 0, 0, "", [], []) for _ in range(last - first))
                continue
            of_a, of_b, groups, good, length, link, shown = self._tables()
            row = row.astype(np.int64)
            text = np.repeat(np.arange(last - first), count)
            begin_link, begin_shown = np.cumsum(groups) - groups, np.cumsum(length) - length
            links = gather(link, begin_link[row], groups[row])
            written_out = memoryview(gather(shown, begin_shown[row], length[row])).cast("B")
            sums = [np.bincount(text, x[row], last - first).astype(np.int64) for x in (~good, of_a, of_b, groups, length)]
            key, times = np.unique(np.repeat(text, groups[row]) << 32 | links, return_counts=True)
            edges = np.searchsorted(key, np.arange(last - first + 1) << 32)
            stops = np.append(0, np.cumsum(sums[4]))
            for i in range(last - first):
                found = key[edges[i]:edges[i + 1]] & 0xFFFFFFFF, times[edges[i]:edges[i + 1]]
                if first + i != (open_text and open_text[0]):
                    open_text = [first + i, np.zeros(4, np.int64), hashlib.sha256(), b"", []]
                open_text[1] += [s[i] for s in sums[:4]]
                open_text[2].update(open_text[3] + written_out[stops[i]:max(stops[i], stops[i + 1] - 1)])
                open_text[3] = b";" if stops[i + 1] > stops[i] else open_text[3]
                open_text[4].append(found)
                if places[-1] < starts[last] and i == last - first - 1:
                    break  # its next part follows
                _, (bad, n_a, n_b, n_groups), digest, _, parts = open_text
                ids, number = parts[0]
                if len(parts) > 1:
                    ids, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    number = np.bincount(which, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield (True, n_a, n_b, n_groups, digest.hexdigest(), ids, number) if not bad and n_groups else (
                    False, 0, 0, 0, "", [], [])
            if self.rows - held > self.most:  # chunks that are never kept fill the tables too
                self.forget()


@dataclass
class Alignment:
    """``texts``: one row a distinct text. ``pairs``: a, b, links (their number over all rows), best (the most of their b).

    ``measures`` has one row for each row of the documents.
    """

    texts: DataFrame
    pairs: DataFrame
    measures: DataFrame


def align(docs: DataFrame, path_a: str, path_b: str) -> Alignment:
    """Align a byte-level file (a, which reads space + text) with a piece model (b, which adds the space itself).

    Measures are the columns of ``docs`` but the text (names that clash are replaced), then n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256. A null or empty text, and one whose tokens do not give back its bytes on either
    side (it holds U+2581, say), has zeros and an empty groups_sha256, and counts for no pair. Repeated rows each
    get the measures of their text and count as often as they stand there. No rows give no rows.
    """
    p, names = prefix(docs), passing(docs, MADE + ["text"])
    key = f"{p}key"
    digest = F.unhex(F.sha2("text", 256))
    some = F.coalesce(F.length("text") > 0, F.lit(False))
    distinct = docs.filter(some).select("text").groupBy("text").agg(F.count(F.lit(1)).alias("times"))

    def worker() -> Aligner:
        return worker_state(("align", path_a, path_b), lambda: Aligner(path_a, path_b))

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker()
        for batch in batches:
            got = list(aligner.aligned(*text_bytes(batch.column("text"))))
            ok, n_a, n_b, n_groups, sha, ids, times = zip(*got) if got else [()] * 7
            offsets = pa.array(np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.zeros(0)]).astype(np.int32)))
                     for x in (ids, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("times"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)),
                 pa.array(sha, pa.string()), *lists],
                names=["key", "times", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "number"])

    texts = written(arrow_pass(
        distinct.select(digest.alias("key"), F.concat(F.lit(" "), "text").alias("text"), "times"), by_text,
        "key binary, times long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<int>, number array<int>"), "aligned")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            pairs, number = (batch.column(c).flatten().to_numpy() for c in ("pairs", "number"))
            times = np.repeat(batch.column("times").to_numpy(), batch.column("pairs").value_lengths().to_numpy())
            if len(pairs):
                more = np.zeros(max(len(total), int(pairs.max()) + 1), np.int64)
                more[:len(total)] = total
                np.add.at(more, pairs, times * number)
                total = more
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 100_000):
            some = seen[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "links"])

    counts = arrow_pass(texts.select("times", "pairs", "number"), counted, "pair long, links long").groupBy("pair").agg(
        F.sum("links").alias("links"))
    # At most one row for each possible pair of the two vocabularies.
    pairs = possible_pairs(level_bytes(path_a), piece_bytes(path_b))
    total = np.zeros(len(pairs), np.int64)
    for pair, links in counts.toLocalIterator():
        total[pair] = links
    b_id = pairs & (1 << SHIFT) - 1
    most = np.zeros(int(b_id.max()) + 1, np.int64)
    np.maximum.at(most, b_id, total)
    best = total == most[b_id]
    held = np.flatnonzero(total)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, number = (batch.column(c).flatten().to_numpy() for c in ("pairs", "number"))
            size = batch.column("pairs").value_lengths().to_numpy()
            edge = np.append(0, np.cumsum(size))
            sums = [np.diff(np.append(0, np.cumsum(x))[edge]) for x in (number.astype(np.int64), number * best[ids], number * total[ids])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "n_a", "n_b", "n_groups")), *map(pa.array, sums), batch.column("groups_sha256")],
                names=[key, *MADE])

    schema = f"{key} binary, " + ", ".join(f"{m} {'string' if m == 'groups_sha256' else 'long'}" for m in MADE)
    measures = arrow_pass(
        texts.select("key", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "number"), measured, schema)
    kept = [F.col(f"`{n}`") for n in names]
    with_text = docs.filter(some).select(*kept, digest.alias(key)).join(measures, key).select(*kept, *MADE)
    without = docs.filter(~some).select(*kept, *[F.lit(0).cast("long").alias(m) for m in MADE[:-1]], F.lit("").alias(MADE[-1]))
    table = pa.table({"a": pairs[held] >> SHIFT, "b": b_id[held], "links": total[held], "best": best[held]})
    return Alignment(texts, docs.sparkSession.createDataFrame(table), with_text.unionByName(without))
