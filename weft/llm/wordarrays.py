"""Words of many texts at once, as 64-bit hashes in arrays: no Python object a word.

A batch's texts lie one after the other in one buffer, each closed by a line feed, so one
comparison of neighbouring bytes finds the ends of all words.  A word's hash folds its
bytes eight at a time: equal words have equal hashes, and words of up to eight bytes differ
before the last mixing.  Work goes in blocks of whole texts that fit a processor's cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Kinds of bytes where words are runs outside [\x20\x09-\x0D]: 0 for those six, 1 for others.
RUNS = np.ones(256, np.uint8)
RUNS[[9, 10, 11, 12, 13, 32]] = 0
#: Kinds of bytes where words are runs of letters, digits and bytes beyond ASCII (1), and any other character stands alone (2).
MARKS = RUNS * 2
MARKS[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1
MARKS[:32] = 0
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
MIX = np.uint64(0xD6E8FEB86659FD93)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(32))


def closed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, each closed by a line feed, and where each begins (with the end as last)."""
    whole = pc.binary_join_element_wise(texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    start = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2] or b"", np.uint8), start


def word_hashes(raw: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every word of ``raw``, A-Z lower-cased; the last byte of ``raw`` is white."""
    kind = kinds[raw]
    if kinds.max() == 1:
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        if kind[0]:
            edge = np.concatenate([[0], edge])
        first, end = edge[0::2], edge[1::2]
    else:
        change, alone = kind[1:] != kind[:-1], kind == 2
        first = np.flatnonzero((kind > 0) & (np.concatenate([[True], change]) | alone))
        end = np.flatnonzero((kind > 0) & (np.concatenate([change, [True]]) | alone)) + 1
    low = np.concatenate([LOWER[raw], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw),), "<u8", low, strides=(1,))
    size = end - first
    h = mixed((eight[first] & LOW_BYTES[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * STEP))
    at, done = np.flatnonzero(size > 8), 8
    while len(at):
        more = eight[first[at] + done] & LOW_BYTES[np.minimum(size[at] - done, 8)]
        h[at] = mixed((h[at] * STEP) ^ more)
        done += 8
        at = at[size[at] > done]
    return first, h


def blocks(texts: pa.Array, kinds: np.ndarray = RUNS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, where each text's words begin with the end as last, word hashes) of blocks of whole texts."""
    if not len(texts):
        return
    raw, start = closed(texts)
    k = 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(start, start[k] + BLOCK_BYTES, "right")) - 1)
        first, h = word_hashes(raw[start[k] : start[stop]], kinds)
        yield k, np.searchsorted(first, start[k : stop + 1] - start[k]), h
        k = stop


def ngram_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, where each text's set begins with the end as last, sets) of blocks: sorted distinct hashes of the word n-grams.

    A text with fewer words than ``size`` has the sequence of all its words as its one n-gram.
    """
    for k, at, h in blocks(texts):
        n = np.diff(at)
        acc = np.full(max(0, len(h) - size + 1), size, np.uint64)
        for j in range(size):
            acc = (acc ^ h[j : j + len(acc)]) * STEP
            acc ^= acc >> np.uint64(31)
        windows = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        start = np.concatenate([[0], np.cumsum(windows)])
        whole = np.repeat(n >= size, windows)
        g = np.empty(start[-1], np.uint64)
        place = np.repeat(at[:-1], windows) + np.arange(start[-1]) - np.repeat(start[:-1], windows)
        g[whole] = acc[place[whole]]
        for i in np.flatnonzero((n > 0) & (n < size)).tolist():
            v = n[i]
            for w in h[at[i] : at[i + 1]]:
                v = (int(v) ^ int(w)) * int(STEP) & 0xFFFFFFFFFFFFFFFF
                v ^= v >> 31
            g[start[i]] = v
        for i, j in zip(start[:-1].tolist(), start[1:].tolist()):
            if j - i > 1:
                g[i:j].sort()
        new = np.ones(len(g), np.bool_)
        new[1:] = g[1:] != g[:-1]
        new[start[:-1][windows > 0]] = True
        yield k, np.concatenate([[0], np.cumsum(new)])[start], g[new]
