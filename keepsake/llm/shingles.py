"""Word shingles of whole texts, with array operations over a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from keepsake.llm.common import blocks

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 64
_BYTES = np.random.default_rng(2).integers(1, 2**63, (_LONG, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z lowered), and how many words each text has."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    low = _LOWER[data]
    word = ~_BLANK[low]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = starts[:-1][starts[:-1] < len(data)]
    begins[edges] = word[edges]
    begin = np.flatnonzero(begins)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    span = np.diff(np.append(begin, len(data)))
    place = np.arange(len(data), dtype=np.int64)
    place[begin[0]:] -= np.repeat(begin, span)
    value = _BYTES.ravel()[((place & (_LONG - 1)) << 8) + low]
    # Beyond the table's places, a round of it changes the value, so no two places of a long word are alike.
    far = np.flatnonzero(place >= _LONG)
    if len(far):
        value[far] = mixed(value[far] + (place[far] // _LONG).astype(np.uint64) * _STEP)
    value *= word
    return mixed(np.add.reduceat(value, begin)), np.diff(np.searchsorted(begin, starts))


def sliced_word_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Word hashes of one text, a slice at a time; slices end before a blank, so no word is parted."""
    parts, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end, step = min(at + size, len(data)), size
        while end < len(data):
            blank = np.flatnonzero(_BLANK[data[end - step:end]])
            if len(blank) and end - step + blank[-1] > at:
                end = end - step + int(blank[-1])
                break
            end, step = min(end + step, len(data)), min(step, len(data) - end)
        part = data[at:end]
        parts.append(word_hashes(part, np.array([0, len(part)]))[0])
        at = end
    return np.concatenate(parts)


def long_shingle_set(data: np.ndarray, k: int, size: int) -> np.ndarray:
    """The shingles of one long text, sorted."""
    words = sliced_word_hashes(data, size)
    number = max(len(words) - k + 1, min(len(words), 1))
    width = min(len(words), k)
    value = np.full(number, width, np.uint64)
    for j in range(width):
        value = mixed(value * _STEP + words[j:j + number])
    return np.unique(value)


def sets_of(data: np.ndarray, starts: np.ndarray, k: int, size: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``shingle_sets`` of about ``size`` bytes of texts together: first and last text, shingles, how many each text has."""
    for i, j in blocks(starts, size):
        part = data[starts[i]:starts[j]]
        if len(part) > 2 * size and j == i + 1:
            values = long_shingle_set(part, k, size)
            yield i, j, values, np.array([len(values)])
        else:
            yield i, j, *shingle_sets(part, starts[i:j + 1] - starts[i], k)


def shingle_sets(data: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted, and how many each has; fewer words are one shingle."""
    words, count = word_hashes(data, starts)
    first = np.cumsum(count) - count
    number = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.repeat(first - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
    size = np.repeat(np.minimum(count, k), number)
    value = size.astype(np.uint64)
    for j in range(k):
        at = np.minimum(begin + j, max(len(words) - 1, 0))
        value = np.where(j < size, mixed(value * _STEP + words[at]) if len(words) else value, value)
    row = np.repeat(np.arange(len(count)), number)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.bincount(row[new], minlength=len(count))
