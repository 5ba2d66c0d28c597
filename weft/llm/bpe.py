"""Byte-level BPE: encode texts by a rank file, decode ids to bytes.

Two forms of one method, the fold of ranked merges over the bytes of distinct words:

* :func:`encode` / :func:`decode_bytes`, the main path: Spark deals out the documents,
  every task folds each distinct word of its rows once and looks repeats up.
* :func:`encode_words_native`: the same fold as Spark higher-order functions over byte
  arrays with a literal rank map, cut in hash buckets so that a lookup doesn't scan it.
  Its ids can't come back to the documents cheaply (figures in the README).

Null and empty texts give no ids.  Very long texts and very long words take
O(n log n) steps.  Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, buckets, literal, texts_of

#: Distinct words that a task remembers before it starts over; bounds its memory.
CACHE_WORDS = 300_000
#: Words beyond this many bytes are folded with a heap.
LONG_WORD = 96
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: one base64 piece and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def white_space_as_unicode(pattern: str) -> str:
    r"""``pattern`` with \s and \S as the White_Space property, which leaves out U+001C to U+001F."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def fold_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    pairs = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
    while pairs and (least := min(pairs)) != NEVER:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NEVER)
    return [ranks[p] for p in parts]


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges, the next one from a heap of (rank, place); stale entries are skipped."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1") * n
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the word itself if it has a rank, else what the lowest-rank merges leave."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return fold_short(word, ranks) if len(word) <= LONG_WORD else fold_long(word, ranks)


class Folded(dict):
    """Word to its ids as little-endian unsigned 32-bit integers, folded when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        ids = np.array(fold(word.encode(), self.ranks), dtype="<u4").tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, ids): ``ids`` holds the token ids as little-endian unsigned 32-bit integers.

    ``ranks`` is broadcast; a vocabulary has a fixed size (50,256 entries here).
    """
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)
    shape = white_space_as_unicode(pattern)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids_of = regex.compile(shape).findall, Folded(shipped.value)
        for b in batches:
            ids = [b"".join(map(ids_of.__getitem__, words(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return texts_of(docs).mapInArrow(task, "doc_id long, ids binary")


def decode_bytes(ids: bytes, pieces: list[bytes]) -> bytes:
    """The bytes of packed ids: the pieces one after the other."""
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` (with a binary column ``ids``) and the column ``decoded``, the bytes of its ids."""
    shipped = encoded.sparkSession.sparkContext.broadcast(pieces_of(ranks))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shipped.value
        for b in batches:
            out = [decode_bytes(x, pieces) for x in b.column(b.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(task, ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes) + ", decoded binary")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in the same task."""
    ranks_sent = docs.sparkSession.sparkContext.broadcast(ranks)
    shape = white_space_as_unicode(pattern)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids_of, pieces = regex.compile(shape).findall, Folded(ranks_sent.value), pieces_of(ranks_sent.value)
        sha = hashlib.sha256
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for t in b.column(1):
                ids = b"".join(map(ids_of.__getitem__, words(t.as_py())))
                n.append(len(ids) // 4)
                of_ids.append(sha(ids).hexdigest())
                of_bytes.append(sha(decode_bytes(ids, pieces)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_words_native(words: DataFrame, ranks: dict[bytes, int], most_bytes: int = 64) -> DataFrame:
    """(word, ids array<int>) for each distinct value of the string column ``word``, without Python.

    The bytes of a word become an array of hex pieces.  A fold over as many steps as
    the longest word has bytes merges, in each step, the first pair of lowest rank; the
    rank map is a literal array of hash buckets.  Words beyond ``most_bytes`` bytes are refused.
    """
    pieces = sorted(ranks, key=ranks.__getitem__)
    n = 1 << max(4, (len(pieces) // 4).bit_length())
    place_of, rank_at = buckets([piece.hex().upper() for piece in pieces], n), literal([ranks[piece] for piece in pieces], "array<int>")
    none = F.lit(1 << 30)
    known = lambda x: F.get(rank_at, F.element_at(F.get(place_of, bucket(x, n)), x))

    def rank(x):
        return F.coalesce(known(x), none)

    def step(parts, _):
        pairs = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.struct(rank(F.concat(p, F.get(parts, i + 1))).alias("r"), i.alias("i")))
        best = F.array_min(pairs)
        at = best["i"]
        merged = F.concat(F.slice(parts, 1, at), F.array(F.concat(F.get(parts, at), F.get(parts, at + 1))), F.slice(parts, at + 3, F.size(parts)))
        return F.when(best.isNull() | (best["r"] >= none), parts).otherwise(merged)

    hexed = F.hex(F.encode("word", "UTF-8"))
    size = F.octet_length("word")
    start = F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(hexed, i * 2 + 1, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    whole = known(hexed)
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), start, step, lambda parts: F.transform(parts, rank))
    checked = words.select(F.assert_true(F.octet_length("word") <= most_bytes), "word").select("word").where("word is not null").distinct()
    return checked.select("word", F.when(whole.isNotNull(), F.array(whole)).otherwise(folded).alias("ids"))
