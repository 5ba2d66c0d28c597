"""Language-model scoring by cross-entropy difference.

A target model and a background model of the same order and smoothing share one
vocabulary: every distinct word of the corpus.  Both are bigram models with a Dirichlet
prior on the unigram distribution, which is add-one smoothed over the distinct words and
an unseen one (``words`` at least).  A word is a run of letters, digits and characters
beyond ASCII, with A-Z lower-cased; any other character but white space stands alone.  A document's score is the mean over its tokens of
(target loss - background loss); low scores look like the target.

Every distinct word and bigram of every document is counted by itself, without a limit:
an n-gram is known by a 63-bit hash and a bit for its order, so two of n would be taken
for one about n * n / 2**64 times (0.05 times for a billion bigrams).  Nothing of the corpus is
sent to the driver or to every executor:

1. Documents are dealt by a hash of id and text to blocks, and so are the hashes of those of
   the target, which a join of narrow rows finds.  A block's task counts its distinct n-grams
   and cuts them, sorted, into slices of the key range: one row a block and slice, packed.
   A very frequent n-gram is one entry a block.
2. A slice's task adds the blocks' counts up and answers every block with the totals of
   the n-grams that it asked for, in the same order, so without the keys.
3. A block's task meets its documents with its totals and scores them.

Blocks and slices have a fixed size, so their numbers follow the input; rows between them
are their product, all other things grow in proportion.

Edge cases: null and empty texts have no tokens and score 0 with n_tokens 0.  Without a
target document every score is 0 up to smoothing.  Very long texts are taken whole.  A
model is counted when documents are scored, once if these are the documents it was fitted on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of
from .wordarrays import MARKS, STEP, blocks, mixed

#: Characters in a slice's share of the texts.
SLICE_CHARS = 16_000_000


@dataclass(frozen=True)
class Settings:
    """``words``: the least size of the vocabulary in smoothing; a block has 2**(slots + 3) characters, about 2**slots tokens, which changes no result."""

    words: int = 65_536
    slots: int = 20
    prior: float = 50.0


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers as their width in bytes and their bytes, lowest ones first, which compress well."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros(((len(raw) - 1) // raw[0], 8), np.uint8)
    out[:, : raw[0]] = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1).T
    return out.view("<u8").ravel()


def slice_start(k: int, slices: int) -> np.uint64:
    """The least key of a slice."""
    return np.uint64(-(-(k << 32) // slices) << 32)


@dataclass
class Tokens:
    """The tokens of a block's texts in one row: document of each, keys of the words (even) and of the bigrams (odd) that end at ``at``."""

    n: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    at: np.ndarray
    bigram: np.ndarray

    @classmethod
    def of(cls, texts: pa.ChunkedArray) -> Tokens:
        n, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for c in texts.chunks:
            for _, at, h in blocks(c, MARKS):
                n.append(np.diff(at))
                hashes.append(h)
        n, h = np.concatenate(n), np.concatenate(hashes)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        one = np.uint64(1)
        pair = h[at - 1] * STEP + h[at]
        return cls(n, doc, h & ~one, at, mixed(pair) | one)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): ``key`` is a hash of both, by which a row is known and dealt out."""
    return texts_of(docs).withColumn("key", F.xxhash64("doc_id", "text"))


def dealt(rows: DataFrame, settings: Settings, chars: int) -> DataFrame:
    """``rows`` with the block of each key, the same in each run."""
    blocks = -(-chars // (8 << settings.slots)) or 1
    return rows.withColumn("block", F.pmod("key", F.lit(blocks)))


def asking(rows: DataFrame, marks: DataFrame, slices: int, count: bool, ask: bool) -> DataFrame:
    """A row a block and slice: its distinct keys, their counts in all and in target rows if ``count``, and whether it wants totals.

    ``marks``: the keys of target rows, dealt like ``rows``, so that no text moves to find them.
    """

    def task(t: pa.Table, m: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({c: pa.array([], k) for c, k in (("slice", pa.int64()), ("block", pa.int64()), ("ask", pa.bool_()), ("keys", pa.binary()), ("n0", pa.binary()), ("n1", pa.binary()))})
        tokens = Tokens.of(t.column("text"))
        keys, n0 = np.unique(np.concatenate([tokens.word, tokens.bigram]), return_counts=True)
        n1 = np.zeros(len(keys), np.int64)
        target = np.isin(t.column("key").to_numpy(), m.column("mark").to_numpy())[tokens.doc]
        some, n = np.unique(np.concatenate([tokens.word[target], tokens.bigram[target[tokens.at]]]), return_counts=True)
        n1[np.searchsorted(keys, some)] = n
        if not count:
            n0, n1 = n0 * 0, n1 * 0
        starts = [slice_start(k, slices) for k in range(slices)]
        cut = np.append(np.searchsorted(keys, np.array(starts, np.uint64)), len(keys))
        out: list[list] = [[], [], []]
        for start, a, b in zip(starts, cut[:-1], cut[1:]):
            out[0].append(packed(np.diff(keys[a:b], prepend=start)))
            out[1].append(packed(n0[a:b]))
            out[2].append(packed(n1[a:b]))
        block = t.column("block")[0].as_py()
        return pa.table({"slice": pa.array(range(slices), pa.int64()), "block": pa.array([block] * slices, pa.int64()), "ask": [ask] * slices, "keys": pa.array(out[0], pa.binary()), "n0": pa.array(out[1], pa.binary()), "n1": pa.array(out[2], pa.binary())})

    return rows.groupBy("block").cogroup(marks.groupBy("mark_block")).applyInArrow(task, "slice long, block long, ask boolean, keys binary, n0 binary, n1 binary")


def answered(asked: DataFrame, slices: int) -> DataFrame:
    """For every row that asks the totals of its keys, and the slice's number of words and of tokens of both models."""

    def task(t: pa.Table) -> pa.Table:
        start = slice_start(t.column("slice")[0].as_py(), slices)
        parts = [np.cumsum(unpacked(k.as_py()), dtype=np.uint64) + start for k in t.column("keys")]
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        n = [np.bincount(at, np.concatenate([unpacked(x.as_py()) for x in t.column(c)]), len(keys)).astype(np.int64) for c in ("n0", "n1")]  # exact below 2**53
        words = (keys & np.uint64(1)) == 0
        size = [int((words & (n[0] > 0)).sum()), int(n[0][words].sum()), int(n[1][words].sum())]
        ends = np.cumsum([len(p) for p in parts])
        spans = [(int(e) - len(p), int(e)) for p, e, ask in zip(parts, ends, t.column("ask").to_pylist()) if ask]
        own = t.filter(t.column("ask"))
        totals = [pa.array([packed(x[at[a:b]]) for a, b in spans], pa.binary()) for x in n]
        return pa.table({"block": own.column("block"), "slice": own.column("slice"), "n0": totals[0], "n1": totals[1]} | {c: pa.array([v] * len(spans), pa.int64()) for c, v in zip(("words", "all0", "all1"), size)})

    return asked.groupBy("slice").applyInArrow(task, "block long, slice long, n0 binary, n1 binary, words long, all0 long, all1 long")


@dataclass
class Models:
    """Background and target model over one vocabulary: the documents that they are counted from, and the ids of the target's."""

    settings: Settings
    docs: DataFrame
    ids: DataFrame

    def score(self, text: str) -> tuple[int, float, float]:
        """(tokens, mean target loss, mean background loss); the first token counts by its unigram."""
        r = scored(self.docs.sparkSession.createDataFrame([(0, text)], "doc_id long, text string"), self).first()
        return r["n_tokens"], r["target_loss"], r["background_loss"]


def fit(docs: DataFrame, targets: DataFrame, settings: Settings = Settings()) -> Models:
    """``targets``: ids (column doc_id) of the documents that stand for the target; all documents are the background."""
    return Models(settings, docs, targets.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct())


def scored(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every document; score is their difference."""
    s, chars = models.settings, lambda d: d.agg(F.sum(F.length("text"))).first()[0] or 0
    n = chars(texts_of(models.docs))
    slices = -(-n // SLICE_CHARS) or 1
    rows = dealt(keyed(models.docs), s, n)
    marks = rows.select("doc_id", "key", "block").join(models.ids, "doc_id").select(F.col("key").alias("mark"), F.col("block").alias("mark_block")).distinct()
    if docs is models.docs:
        asked = asking(rows, marks, slices, True, True)
    else:
        counted = asking(rows, marks, slices, True, False)
        rows = dealt(keyed(docs), s, chars(texts_of(docs)))
        asked = counted.unionByName(asking(rows, marks.limit(0), slices, False, True))

    def task(d: pa.Table, t: pa.Table) -> pa.Table:
        t = t.sort_by("slice")
        tokens = Tokens.of(d.column("text"))
        keys = np.unique(np.concatenate([tokens.word, tokens.bigram]))
        word, bigram = np.searchsorted(keys, tokens.word), np.searchsorted(keys, tokens.bigram)
        size = max(s.words, sum(t.column("words").to_pylist()) + 1)
        loss = []
        for k in "01":
            n = np.concatenate([np.zeros(0, np.uint64), *(unpacked(x.as_py()) for x in t.column(f"n{k}"))]).astype(np.float64)
            if len(n) != len(keys):
                raise ValueError("a block's totals don't fit its n-grams")
            p = (n[word] + 1) / (sum(t.column(f"all{k}").to_pylist()) + size)
            before, at = n[word[tokens.at - 1]], tokens.at
            p[at] = (n[bigram] + s.prior * p[at]) / (before + s.prior)
            loss.append(np.bincount(tokens.doc, -np.log(p), len(tokens.n)) / np.maximum(tokens.n, 1))
        return pa.table({"doc_id": d.column("doc_id"), "n_tokens": tokens.n, "target_loss": loss[1], "background_loss": loss[0], "score": loss[1] - loss[0]})

    return rows.groupBy("block").cogroup(answered(asked, slices).groupBy("block")).applyInArrow(task, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
