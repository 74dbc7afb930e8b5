"""Encoding of large text blocks with a tokenizer that splits at white space.

Texts repeat their words. A block of texts is cut, with array operations only, into chunks (white space and the
word after it), each distinct chunk that this worker has not met is encoded once, and ids are gathered for all.
A cut stands between a character that no reading of white space includes and a space or line feed, where the
supported tokenizers never join characters; so the ids are those of the whole text.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np

#: Longer chunks are encoded each time, without being kept.
LONGEST = 64
#: Bytes that are hashed together; a longer text is taken in parts that end where chunks do.
BLOCK = 2 << 20
#: Chunks in one call of a tokenizer.
TOGETHER = 1000
# Fixed value: how byte-level files without a splitter of their own split text.
LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
Encoded = tuple[np.ndarray, np.ndarray]
_PLACES = np.random.default_rng(20).integers(1, 2**63, (LONGEST, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cut(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks begin in the bytes of several texts; every non-empty text begins one."""
    if not len(data):
        return np.zeros(0, np.int64)
    gap = (data == 32) | (data == 10)
    before = data[:-1]
    word = before > 32
    # The last two bytes of white space outside ASCII; other characters that end alike only miss a cut.
    high = np.flatnonzero(gap[1:] & (before >= 0x80))
    if len(high):
        last, first = before[high], data[np.maximum(high - 1, 0)]
        blank = (((last == 0x85) | (last == 0xA0)) & (first == 0xC2)) | ((last == 0x80) & (first == 0x9A)) | (
            (last <= 0xAF) & ((first == 0x80) | (first == 0x81)))
        word[high[blank]] = False
    begins = np.zeros(len(data), bool)
    begins[1:] = gap[1:] & word
    begins[starts[:-1][starts[:-1] < starts[1:]]] = True
    return np.flatnonzero(begins)


def hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each chunk: the sum of a random number for each (place, byte)."""
    place = np.arange(len(data), dtype=np.int64) - np.repeat(begin, length)
    np.bitwise_and(place, LONGEST - 1, out=place)
    place <<= 8
    place += data
    return np.add.reduceat(_PLACES.ravel()[place], begin)


def gather(store: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """store[begin:begin + count] of every entry, one after the other."""
    total = int(count.sum())
    offset = np.repeat(begin - (np.cumsum(count) - count), count)
    return store[offset + np.arange(total)]


def spans(data: np.ndarray, starts: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of about ``size`` bytes: the texts first..last - 1 that they hold, and where these begin and end in ``data``.

    A longer text comes as several runs of its own, parted where a chunk begins (a chunk is never parted).
    """
    at, size = 0, size or BLOCK
    while at < len(starts) - 1:
        end = int(np.searchsorted(starts, starts[at] + size, "right")) - 1
        if end > at:
            yield at, end, starts[at:end + 1]
            at = end
            continue
        low, high = int(starts[at]), int(starts[at + 1])
        while low < high:
            reach, stop = size, high
            while low + reach < high:
                inside = cut(data[low:low + reach], np.array([0, reach]))
                if len(inside) > 1:
                    stop = low + int(inside[-1])
                    break
                reach *= 2
            yield at, at + 1, np.array([low, stop])
            low = stop
        at += 1


def flat(sequences: Sequence[Sequence[int]]) -> Encoded:
    count = np.fromiter(map(len, sequences), np.int64, len(sequences))
    return np.fromiter(itertools.chain.from_iterable(sequences), np.uint32, int(count.sum())), count


class ChunkEncoder:
    """Ids of texts; ``encode`` gives all ids of a list of chunks (bytes), and how many each has.

    At most ``most`` chunks are kept; then it starts anew.
    """

    def __init__(self, encode: Callable[[list[bytes]], Encoded], most: int = 400_000):
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.int64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0

    def _append(self, encoded: Encoded) -> tuple[np.ndarray, np.ndarray]:
        ids, count = encoded
        if self.used + len(ids) > len(self.store):
            grown = np.zeros(max(2 * len(self.store), self.used + len(ids)), np.uint32)
            grown[:self.used] = self.store[:self.used]
            self.store = grown
        self.store[self.used:self.used + len(ids)] = ids
        begin = self.used + np.cumsum(count) - count
        self.used += len(ids)
        return begin, count

    def _block(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = cut(data, starts)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(starts) - 1, np.int64)
        length = np.diff(np.append(begin, len(data)))
        if len(self.keys) > self.most:
            self.forget()
        key, raw = hashes(data, begin, length), data.tobytes()
        long = np.flatnonzero(length > LONGEST)
        key[long] = key[0] if length[0] <= LONGEST else 0
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        if len(self.keys):
            fresh = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != distinct)
        else:
            fresh = np.arange(len(distinct))
        if len(fresh):
            new = [raw[begin[i]:begin[i] + length[i]] for i in first[fresh]]
            b, c = self._append(self.encode(new))
            entries = len(self.begin) + np.arange(len(fresh))
            self.begin, self.count = np.append(self.begin, b), np.append(self.count, c)
            self.keys = np.insert(self.keys, at[fresh], distinct[fresh])
            self.entry = np.insert(self.entry, at[fresh], entries)
            at = np.searchsorted(self.keys, distinct)
        entry = self.entry[at]
        b, c = self.begin[entry][which], self.count[entry][which]
        if len(long):
            held = self.used
            b[long], c[long] = self._append(self.encode([raw[begin[i]:begin[i] + length[i]] for i in long]))
            self.used = held
        ids = gather(self.store, b, c)
        ends = np.append(0, np.cumsum(c))
        return ids, np.diff(ends[np.searchsorted(begin, starts)])

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has."""
        parts, counts = [np.zeros(0, np.uint32)], np.zeros(len(starts) - 1, np.int64)
        for first, last, places in spans(data, starts):
            ids, count = self._block(data[places[0]:places[-1]], places - places[0])
            parts.append(ids)
            counts[first:last] += count
        return np.concatenate(parts), counts


def library_encoder(path: str, added: bool = True) -> ChunkEncoder:
    """A byte-level BPE file of the tokenizers library, without the special tokens that it puts around texts.

    Where a text holds the string of an added token, such as <|endoftext|>, the library makes one id of it; with
    ``added=False`` the string is ordinary text. Such a string lies inside one chunk: it has no white space, and files
    whose added tokens take white space along are refused.

    Plain chunks (a space or line feed, then ASCII or Latin-1 letters, digits, signs) are encoded many in a call. Their
    merges run on the vocabulary of the same file in the tiktoken library, which gives the same ids, since a file's
    merges come in the order of the ids they make (else everything goes through the tokenizers library). As neither
    lower-casing nor composing changes how many bytes plain chunks have, the bytes that tokens stand for tell where
    a chunk's ids end. All other chunks go through the tokenizers library, one entry of a call each.
    """
    import json
    import os

    import regex
    import tiktoken

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added

    def apart(chunks: list[bytes]) -> Encoded:
        made = tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return flat([e.ids for e in made])

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if any(t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in spec["added_tokens"]):
        raise ValueError(f"added tokens of {path} reach over white space")
    strings = [regex.escape(t["content"].encode()) for t in spec["added_tokens"] if added or not t["special"]]
    marked = regex.compile(b"|".join(strings) or rb"(?!)").search
    model, vocabulary = spec["model"], spec["model"]["vocab"]
    suffix = model.get("end_of_word_suffix") or ""
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    splitter = next((p["pattern"]["Regex"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
                     if p["type"] == "Split"), None)
    if (merged != sorted(merged) or bool(suffix) != bool(splitter) or bool(suffix) != bool(spec["normalizer"])
            or model.get("ignore_merges") or '"ByteLevel"' not in json.dumps(spec["pre_tokenizer"])):
        return ChunkEncoder(apart)

    # How byte-level files write bytes: printable ones as themselves, others from U+0100 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
    ranks, stands_for = {}, np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        bare = token.removesuffix(suffix) if suffix else token
        if all(c in byte for c in bare):
            stands_for[i] = len(bare)
            # A space stands for the end of a word where a file marks it.
            ranks[bytes(byte[c] for c in bare) + b" " * (bare != token)] = i
    merges = tiktoken.Encoding("file", pat_str="[^ ]+ " if suffix else LEVEL_PATTERN, mergeable_ranks=ranks,
                               special_tokens={})
    words = regex.compile(splitter or "").findall
    fullmatch = regex.compile(rb"[ \n](?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch

    def together(chunks: list[bytes]) -> Encoded:
        text = b"".join(chunks).decode()
        ids = np.array(merges.encode_ordinary(" ".join(words(text.lower())) + " " if suffix else text), np.int64)
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) - bool(suffix))
        reached = np.cumsum(stands_for[ids])
        stops = np.searchsorted(reached, ends) + 1
        if not len(ids) or stops[-1] != len(ids) or (reached[stops - 1] != ends).any():
            return apart(chunks)
        return ids, np.diff(stops, prepend=0)

    def encode(chunks: list[bytes]) -> Encoded:
        fits = np.fromiter((fullmatch(c) is not None and marked(c) is None for c in chunks), bool, len(chunks))
        many = [c for c, f in zip(chunks, fits) if f]
        parts = [together(many[i:i + TOGETHER]) for i in range(0, len(many), TOGETHER)]
        parts.append(apart([c for c, f in zip(chunks, fits) if not f]))
        ids, counts = (np.concatenate(x) for x in zip(*parts))
        place = np.empty(len(chunks), np.int64)  # where each chunk stands among the encoded
        place[np.append(np.flatnonzero(fits), np.flatnonzero(~fits))] = np.arange(len(chunks))
        begin = np.cumsum(counts) - counts
        return gather(ids, begin[place], counts[place]), counts[place]

    return ChunkEncoder(encode)
