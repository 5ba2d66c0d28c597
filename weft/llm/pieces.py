"""SentencePiece BPE: encode texts by a model file, decode ids to texts.

Where no piece of the model crosses a whitespace marker (a marker only ever stands in the
run that begins a piece), marked words are segmented apart from each other.  Every task
keeps a table of the distinct marked words of its rows, segments each word when it is first
met, and joins the ids back by the positions of the words in each text.  Models with pieces
that cross markers take whole texts as one word.

Supported are BPE models with the identity normaliser that keep extra spaces, with or
without dummy prefix and byte fallback; others are refused.

Null and empty texts give no ids.  Very long texts and words take O(n log n) steps.  Rows
with null or repeated ids give a row each, an empty table gives none, and other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from .common import texts_of

MARK = "▁"
#: Distinct marked words that a task's table holds before it becomes the older one of two; bounds its memory.
TABLE_WORDS = 200_000
#: Words beyond this many characters are segmented with a heap.
LONG_WORD = 64
#: Words of a task's texts that are looked up together, and distinct words that are merged together.
WORDS_AT_ONCE, ROWS_AT_ONCE = 200_000, 20_000
NEVER, NO_MERGE = 1 << 60, np.iinfo(np.int32).max
BPE = 2


@dataclass(frozen=True)
class Vocabulary:
    """What encoding and decoding need of a model; its size is that of the vocabulary, whatever the input."""

    order: dict[str, int]  # piece that merges may make -> place in the order of merges; equal scores share a place
    ids: dict[str, int]  # piece -> id
    byte_ids: tuple[int, ...] | None  # ids of the 256 bytes, if the model falls back to bytes
    unknown: int
    prefixed: bool
    separable: bool  # no piece crosses a whitespace marker
    surfaces: tuple[bytes, ...]  # id -> the bytes it stands for
    controls: frozenset[int]
    bare: frozenset[int]  # ids whose first marker is never taken for the dummy prefix: bytes and the unknown one


def read_model(path: str) -> Vocabulary:
    """The vocabulary of a .model file."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm, kind = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    if proto.trainer_spec.model_type != BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with the identity normaliser, which keep extra spaces, are supported")
    if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
        raise ValueError("models with user-defined or unused pieces are not supported")
    normal = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
    places = {s: k for k, s in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
    byte_of = {k: int(p.piece[3:5], 16) for k, p in enumerate(proto.pieces) if p.type == kind.BYTE}
    unknown = next(k for k, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN)
    controls = frozenset(k for k, p in enumerate(proto.pieces) if p.type == kind.CONTROL)

    def surface(k: int, piece: str) -> bytes:
        if k in byte_of:
            return bytes([byte_of[k]])
        return b"" if k in controls else proto.trainer_spec.unk_surface.encode() if k == unknown else piece.replace(MARK, " ").encode()

    return Vocabulary(
        order={p: places[proto.pieces[k].score] for p, k in normal.items()},
        ids=normal,
        byte_ids=tuple(sorted(byte_of, key=byte_of.__getitem__)) if len(byte_of) == 256 and proto.trainer_spec.byte_fallback else None,
        unknown=unknown,
        prefixed=norm.add_dummy_prefix,
        separable=not any(MARK in p.lstrip(MARK) for p in normal),
        surfaces=tuple(surface(k, p.piece) for k, p in enumerate(proto.pieces)),
        controls=controls,
        bare=frozenset(byte_of) | {unknown},
    )


def merged_short(word: str, order: dict[str, int]) -> list[str]:
    """The pieces of a word: the adjacent pair that comes first in the order of merges, the left one of equals, is joined until none is left."""
    parts = list(word)
    place = order.get
    pairs = [place(a + b, NEVER) for a, b in zip(parts, parts[1:])]
    while pairs and (first := min(pairs)) != NEVER:
        i = pairs.index(first)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = place(parts[i - 1] + parts[i], NEVER)
        if i < len(pairs):
            pairs[i] = place(parts[i] + parts[i + 1], NEVER)
    return parts


def merged_long(word: str, order: dict[str, int]) -> list[str]:
    """The same merges, the next one from a heap of (place, start, end); entries whose parts have changed are skipped."""
    n = len(word)
    stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1") * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and stop[i] < n and (place := order.get(word[i : stop[stop[i]]])) is not None:
            heapq.heappush(heap, (place, i, stop[stop[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or stop[i] >= n or stop[stop[i]] != end:
            continue
        alive[stop[i]] = 0
        stop[i] = end
        if end < n:
            before[end] = i
        offer(i)
        offer(before[i])
    return [word[i : stop[i]] for i in range(n) if alive[i]]


def segmented(word: str, v: Vocabulary) -> list[int]:
    """Ids of one marked word; characters without a piece become their bytes, or the unknown id (one for a run of them)."""
    parts = (merged_short if len(word) <= LONG_WORD else merged_long)(word, v.order)
    return spelt([v.ids[p] if p in v.ids else -1 - ord(p) for p in parts], v)


def spelt(ids: list[int], v: Vocabulary) -> list[int]:
    """``ids`` with the bytes, or the unknown id, in place of -1 - c for a character c without a piece."""
    out: list[int] = []
    for k in ids:
        if k >= 0:
            out.append(k)
        elif v.byte_ids:
            out.extend(v.byte_ids[b] for b in chr(-1 - k).encode())
        elif not out or out[-1] != v.unknown:
            out.append(v.unknown)
    return out


class Merges:
    """The merges of a vocabulary as sorted arrays, for many words at once."""

    def __init__(self, v: Vocabulary):
        self.v = v
        n = len(v.surfaces)
        pairs = {v.ids[p[:i]] * n + v.ids[p[i:]]: k for p, k in v.ids.items() for i in range(1, len(p)) if p[:i] in v.ids and p[i:] in v.ids}
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.place = np.full(n, NO_MERGE, np.int32)
        for p, k in v.ids.items():
            self.place[k] = v.order[p]
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, k in v.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = k

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of ids makes, -1 where none; negative ids make none."""
        wanted = a.astype(np.int64) * len(self.place) + b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (a >= 0) & (b >= 0), self.made[at], -1)

    def of_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of every word, all words a merge at a time; longest words by themselves."""
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_width.setdefault(-(-len(w) // 8) * 8, []).append(k)
        for width, rows in by_width.items():
            if width > LONG_WORD or not len(self.keys):
                for k in rows:
                    out[k] = np.array(segmented(words[k], self.v), "<u4").tobytes()
                continue
            for s in range(0, len(rows), ROWS_AT_ONCE):
                some = rows[s : s + ROWS_AT_ONCE]
                for k, ids in zip(some, self.of_width([words[k] for k in some], width)):
                    out[k] = ids
        return out

    def of_width(self, words: list[str], width: int) -> list[bytes]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)
        columns = np.arange(width)
        ids = self.of_char[chars]
        ids = np.where(ids >= 0, ids, -1 - chars.astype(np.int32))  # characters without a piece stand below zero
        ids[columns >= size[:, None]] = -1
        strange = ((ids < 0) & (columns < size[:, None])).any(1)
        made = self.pair(ids[:, :-1], ids[:, 1:])
        places = np.where(made >= 0, self.place[made], NO_MERGE)
        live, mine, ranks = np.arange(len(words)), ids.copy(), places
        while len(live):
            at = ranks.argmin(1)
            r = np.arange(len(live))
            going = ranks[r, at] < NO_MERGE
            if not going.all():
                ids[live[~going]] = mine[~going]
                live, mine, ranks, at = live[going], mine[going], ranks[going], at[going]
                r = r[: len(live)]
                if not len(live):
                    break
            joined = self.pair(mine[r, at], mine[r, at + 1])
            after = columns + (columns > at[:, None])
            mine = np.take_along_axis(np.pad(mine, ((0, 0), (0, 1)), constant_values=-1), after, 1)
            mine[r, at] = joined
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=NO_MERGE), after[:, :-1], 1)
            size[live] -= 1
            for left in (at - 1, at):
                sound = (left >= 0) & (left < width - 1)
                k = left[sound]
                pair = self.pair(mine[r[sound], k], mine[r[sound], k + 1])
                ranks[r[sound], k] = np.where(pair >= 0, self.place[pair], NO_MERGE)
        ends = np.cumsum(size) * 4
        packed = ids[columns < size[:, None]].astype("<u4").tobytes()
        out = [packed[e - 4 * n : e] for e, n in zip(ends.tolist(), size.tolist())]
        for k in np.flatnonzero(strange).tolist():
            out[k] = np.array(spelt(np.frombuffer(out[k], "<i4").tolist(), self.v), "<u4").tobytes()
        return out


def words_of(v: Vocabulary) -> Callable[[str], list[str]]:
    """A function from a text to its marked words, in order; together they are the marked text."""
    split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
    start = MARK if v.prefixed else ""
    if not v.separable:
        return lambda text: [start + text.replace(" ", MARK)] if text else []
    return lambda text: split(start + text.replace(" ", MARK)) if text else []


class WordTable:
    """The distinct marked words that a task has met, each with its packed ids.

    A full table becomes the older one, from which words that are met again come back, so frequent words stay.
    """

    def __init__(self, v: Vocabulary):
        self.words, self.merges, self.young, self.older = words_of(v), Merges(v), {}, {}

    def segment(self, words: set[str]) -> None:
        """Puts ``words`` into the table."""
        new = [w for w in words if w not in self.young]
        fresh = [w for w in new if w not in self.older]
        if len(self.young) + len(new) > TABLE_WORDS:
            known = {w: self.young[w] for w in words if w in self.young} | {w: self.older[w] for w in new if w in self.older}
            self.older, self.young = self.young, known
        else:
            self.young |= {w: self.older[w] for w in new if w in self.older}
        self.young |= zip(fresh, self.merges.of_words(fresh))

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of every text, in order: some texts at a time are cut, their distinct words segmented, and the ids joined by position."""
        waiting: list[list[str]] = []
        n = 0
        for text in texts:
            waiting.append(self.words(text))
            n += len(waiting[-1])
            if n >= WORDS_AT_ONCE:
                yield from self.joined(waiting)
                waiting, n = [], 0
        yield from self.joined(waiting)

    def joined(self, texts: list[list[str]]) -> Iterator[bytes]:
        self.segment(set().union(*texts))
        return (b"".join(map(self.young.__getitem__, words)) for words in texts)


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(doc_id, ids): ``ids`` holds the piece ids as little-endian unsigned 32-bit integers.  The vocabulary is broadcast."""
    shipped = docs.sparkSession.sparkContext.broadcast(v)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(shipped.value)
        for b in batches:
            ids = list(words.ids(t.as_py() for t in b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return texts_of(docs).mapInArrow(task, "doc_id long, ids binary")


def one_mark_a_byte(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("one_mark_a_byte", one_mark_a_byte)


def decoded(ids: list[int], v: Vocabulary) -> str:
    """The text of ids: pieces with spaces for markers, runs of bytes as UTF-8 with U+FFFD for each byte out of place, without the dummy prefix.

    Control ids stand for nothing and end a run of bytes.
    """
    if v.controls.isdisjoint(ids):
        text = b"".join(map(v.surfaces.__getitem__, ids)).decode("utf-8", "one_mark_a_byte")
    else:
        runs = (b"".join(map(v.surfaces.__getitem__, run)) for control, run in groupby(ids, v.controls.__contains__) if not control)
        text = "".join(run.decode("utf-8", "one_mark_a_byte") for run in runs)
    if v.prefixed and text.startswith(" ") and next(k for k in ids if k not in v.controls) not in v.bare:
        return text[1:]
    return text


def decode(encoded: DataFrame, v: Vocabulary) -> DataFrame:
    """``encoded`` (with a binary column ``ids``) and the string column ``decoded``."""
    shipped = encoded.sparkSession.sparkContext.broadcast(v)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else decoded(np.frombuffer(x, "<u4").tolist(), shipped.value) for x in b.column(b.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(task, ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes) + ", decoded string")


def digests(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in the same task."""
    shipped = docs.sparkSession.sparkContext.broadcast(v)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped.value
        words, decimal, sha = WordTable(v), [str(k) for k in range(len(v.surfaces))], hashlib.sha256
        for b in batches:
            n, of_ids, of_texts = [], [], []
            for packed in words.ids(t.as_py() for t in b.column(1)):
                ids = np.frombuffer(packed, "<u4").tolist()
                n.append(len(ids))
                of_ids.append(sha(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_texts.append(sha(decoded(ids, v).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
