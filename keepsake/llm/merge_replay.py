"""Byte-level BPE by replaying merges over a corpus of words.

The distinct words of a block of texts are laid out in arrays of tokens, with the rank of the pair at every place. Merges are
replayed in the order of ranks: the place of lowest rank is merged, and only the pairs with the two neighbours change. Words of one
length are replayed together, one merge of each in a step. For long words an inverted index leads from the rank of a pair to the
places where the pair stands. Words never depend on each other, so blocks may be replayed anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.chunks import LONGEST, ChunkEncoder, Encoded, gather
from keepsake.llm.common import passed, text_bytes, worker_state

#: Ids that are turned into bytes together.
DECODED = 1 << 20
#: Words whose ids are kept by an encoder; it starts anew beyond that.
KNOWN = 100_000
#: Words of up to so many bytes are replayed by length, this many together.
SHORT, TOGETHER = 64, 1 << 16
#: Rank of a pair that is no token.
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class PairRanks:
    """Ranks of the pairs of tokens that make a token, sorted by pair."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks]
        found.sort()
        self.keys = np.array([-1, *[k for k, _ in found]], np.int64)
        self.ranks = np.array([NONE, *[r for _, r in found]], np.int32)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # Pairs of bytes, with which every word begins.
        left, right = np.repeat(self.single, 256), np.tile(self.single, 256)
        self.bytes = self(left, right)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key, "right") - 1
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def replay(words: Sequence[bytes], ranks: dict[bytes, int], text: dict[int, bytes] | None = None,
           pairs: dict[tuple[int, int], int | None] | None = None, table: PairRanks | None = None) -> list[list[int]]:
    """Ids of each word: as long as a pair of neighbours is a token, the one of lowest rank merges, leftmost first.

    ``text`` (bytes of each rank), ``pairs`` (ranks looked up before) and ``table`` may be handed on from call to call.
    """
    table = PairRanks(ranks) if table is None else table
    out: list[list[int]] = [[] for _ in words]
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word) if len(word) <= SHORT else -1, []).append(i)
    for length, of in by_length.items():
        for at in range(0, len(of) if length else 0, TOGETHER):
            part = of[at:at + TOGETHER]
            some = [words[i] for i in part]
            for i, ids in zip(part, _by_index(some, ranks, text, pairs) if length < 0 else _together(some, length, table)):
                out[i] = ids
    return out


def _together(words: Sequence[bytes], length: int, table: PairRanks) -> list[list[int]]:
    """``replay`` of words of one length: all that still change have as many tokens, since each merges once a step."""
    data = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)
    token, rank = table.single[data], table.bytes[data[:, :-1].astype(np.int64) << 8 | data[:, 1:]]
    out: list[list[int]] = [[]] * len(words)
    place = np.arange(len(words))
    while len(place):
        if token.shape[1] == 1:
            lowest, best = np.full(len(place), NONE), np.zeros(len(place), np.int64)
        else:
            best = rank.argmin(1)
            lowest = rank[np.arange(len(place)), best]
        ended = lowest == NONE
        if ended.any():
            for i, ids in zip(place[ended].tolist(), token[ended].tolist()):
                out[i] = ids
            token, rank, place, best, lowest = (x[~ended] for x in (token, rank, place, best, lowest))
            if not len(place):
                break
        row, n = np.arange(len(place)), token.shape[1] - 1
        token = np.where(np.arange(n) > best[:, None], token[:, 1:], token[:, :-1])
        token[row, best] = lowest
        rank = np.where(np.arange(n - 1) >= best[:, None], rank[:, 1:], rank[:, :-1])
        for rows, first in ((np.flatnonzero(best > 0), best - 1), (np.flatnonzero(best < n - 1), best)):
            i = first[rows]
            rank[rows, i] = table(token[rows, i], token[rows, i + 1])
    return out


def _by_index(words: Sequence[bytes], ranks: dict[bytes, int], text: dict[int, bytes] | None,
              pairs: dict[tuple[int, int], int | None] | None) -> list[list[int]]:
    """``replay`` of long words, all places of a rank after each other."""
    text = {rank: token for token, rank in ranks.items()} if text is None else text
    pairs = {} if pairs is None else pairs
    single = [ranks[bytes([b])] for b in range(256)]
    token: list[int] = []
    after: list[int] = []
    begins: list[int] = []
    for word in words:
        begins.append(len(token))
        token += [single[b] for b in word]
        after += range(len(token) - len(word) + 1, len(token) + 1)
        if word:
            after[-1] = -1
    before = [-1] * len(token)
    for i, j in enumerate(after):
        if j >= 0:
            before[j] = i

    seen, unknown = pairs.get, -1
    index: dict[int, list[int]] = {}
    filed = index.get
    for i, j in enumerate(after):
        if j < 0:
            continue
        key = (token[i], token[j])
        if (r := seen(key, unknown)) == unknown:
            r = pairs[key] = ranks.get(text[key[0]] + text[key[1]])
        if r is not None:
            if (at := filed(r)) is None:
                index[r] = [i]
            else:
                at.append(i)
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        places = sorted(index.pop(rank))
        for n, i in enumerate(places):
            j = after[i]
            # Merged meanwhile, or the pair has changed; a pair that stands anywhere was looked up when it arose.
            if token[i] < 0 or j < 0 or seen((token[i], token[j])) != rank:
                continue
            token[i], token[j] = rank, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
            lower = False
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right < 0:
                    continue
                key = (token[left], token[right])
                if (r := seen(key, unknown)) == unknown:
                    r = pairs[key] = ranks.get(text[key[0]] + text[key[1]])
                if r is not None:
                    if (at := filed(r)) is None:
                        heapq.heappush(heap, r)
                        index[r] = [left]
                    else:
                        at.append(left)
                    lower = lower or r < rank
            if lower:
                # A pair arose that goes first; the other places wait.
                index[rank] = places[n + 1:]
                heapq.heappush(heap, rank)
                break
    out = []
    for i, word in zip(begins, words):
        ids, at = [], i if word else -1
        while at >= 0:
            ids.append(token[at])
            at = after[at]
        out.append(ids)
    return out


def replay_encoder(path: str, pattern: str) -> ChunkEncoder:
    """Encoder of texts by the ranks in a file; every match of ``pattern`` is a word of its own."""
    import regex

    ranks = read_ranks(path)
    text = {rank: token for token, rank in ranks.items()}
    pairs: dict[tuple[int, int], int | None] = {}
    table = PairRanks(ranks)
    known: dict[str, list[int]] = {}
    matches = regex.compile(pattern).findall

    def encode(chunks: list[bytes]) -> Encoded:
        if len(pairs) > 500_000:
            pairs.clear()
        if len(known) > KNOWN:
            known.clear()
        parts = [matches(c.decode()) for c in chunks]
        # New chunks are mostly known words with other signs around them.
        new = [w for w in dict.fromkeys(w for p in parts for w in p) if w not in known]
        known.update(zip(new, replay([w.encode() for w in new], ranks, text, pairs, table)))
        of_chunk = [[i for w in p for i in known[w]] for p in parts]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        count = np.fromiter(map(len, of_chunk), np.int64, len(of_chunk))
        return np.fromiter((i for c in of_chunk for i in c), np.uint32, int(count.sum())), count

    return ChunkEncoder(encode)


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every text; null texts count as empty. Extra columns are ignored."""
    def run(t: pa.Table) -> pa.Table:
        encoder = worker_state(("replay", ranks, pattern), lambda: replay_encoder(ranks, pattern))
        ids, count = encoder(*text_bytes(t.column("text")))
        offsets = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
        return pa.table({"doc_id": t.column("doc_id"),
                         "ids": pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))})

    return passed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>")


def decoder(ranks: str) -> Callable[[np.ndarray], bytes]:
    """Bytes that ids stand for."""
    tokens = sorted((rank, token) for token, rank in read_ranks(ranks).items())
    size = np.zeros(tokens[-1][0] + 1, np.int64)
    size[[r for r, _ in tokens]] = [len(t) for _, t in tokens]
    begin, data = np.cumsum(size) - size, np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
    return lambda ids: gather(data, begin[ids], size[ids]).tobytes()


def _lists(t: pa.Table) -> list[np.ndarray]:
    lists = t.column("ids").combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def decode(tokens: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids and the bytes they stand for."""
    def run(t: pa.Table) -> pa.Table:
        turn = worker_state(("decode", ranks), lambda: decoder(ranks))
        data = [b"".join(turn(ids[i:i + DECODED]) for i in range(0, len(ids), DECODED)) for ids in _lists(t)]
        return t.append_column("data", pa.array(data, pa.binary()))

    return passed(tokens.select("doc_id", "ids"), run, "doc_id long, ids array<int>, data binary")


def digests(tokens: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian, 32 bits) and of the bytes they stand for."""
    def run(t: pa.Table) -> pa.Table:
        turn = worker_state(("decode", ranks), lambda: decoder(ranks))
        count, of_ids, of_data = [], [], []
        for ids in _lists(t):
            count.append(len(ids))
            of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            data = hashlib.sha256()
            for i in range(0, len(ids), DECODED):
                data.update(turn(ids[i:i + DECODED]))
            of_data.append(data.hexdigest())
        return pa.table({"doc_id": t.column("doc_id"), "n_tokens": pa.array(count, pa.int64()),
                         "ids_sha256": of_ids, "decoded_sha256": of_data})

    return passed(tokens.select("doc_id", "ids"), run,
                  "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
