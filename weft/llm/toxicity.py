"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting takes a bounded sample of labelled rows (``examples`` of each class, those with
the smallest hash of their id), picks the terms that tell the classes apart, and lays the
examples out as an inverted index whose postings are cut in blocks of examples, with the
largest weight of every term in every block.  A query adds those block maxima up to
bounds, visits blocks from the highest bound down, and stops once no bound beats its
k-th neighbour, so neighbours are exact.  Votes of the k nearest, weighted by cosine and
by how many labelled rows each example stands for, give a raw score; a monotone map
fitted on the examples' own leave-one-out scores calibrates it.  The neighbours and the
terms shared with the nearest one are kept as evidence.

Terms are lower-cased words and the first 3 to 6 characters of words, so compounds and
inflected forms of a labelled word are found as well.  The vector space is that of the terms
whose rates differ between the classes: over all words nearest neighbours share a language
and a topic rather than a verdict (figures in the README).  Within that space cosines
are exact.

The index is bounded by its parameters (examples, terms) and is broadcast; documents are
scored where they lie, without a shuffle, over their whole texts.

Edge cases: null and empty texts, and texts without any chosen term, match nothing and
get the share of toxic rows among labelled ones that match nothing either; without
labels every score is 0.  Equal cosines go to the smaller example id.  Very long texts are
taken whole.  Rows that repeat an id are scored one by one; a labelled id with several
texts gives an example for each.  An empty table gives an empty result.  Other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, small_enough, stored, texts_of, training_labels

WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6)
CACHE_WORDS = 300_000
#: Examples in a block.
BLOCK = 512


def terms_of(word: str) -> list[str]:
    """The word itself and, marked by a tilde, its beginnings."""
    return [word, *(f"{word[:k]}~" for k in PREFIXES if len(word) >= k)]


def word_counts(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


@dataclass(frozen=True)
class Settings:
    examples: int = 6000
    terms: int = 8192
    neighbours: int = 15
    least_g2: float = 12.0
    least_lift: float = 3.0
    least_rows: int = 3


class Terms(dict):
    """Word to the numbers of its chosen terms, looked up once a word."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(n for t in terms_of(word) if (n := self.number.get(t)) is not None)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found


def vector(text: str, terms: Terms, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and unit-length TF-IDF weights of the chosen terms of a text."""
    tf: dict[int, int] = {}
    for word, n in word_counts(text).items():
        for t in terms[word]:
            tf[t] = tf.get(t, 0) + n
    if not tf:
        return np.zeros(0, np.int32), np.zeros(0)
    at = np.fromiter(sorted(tf), np.int32, len(tf))
    w = (1 + np.log(np.fromiter((tf[t] for t in at.tolist()), np.float64, len(at)))) * idf[at]
    return at, w / np.sqrt((w * w).sum())


@dataclass
class Index:
    """Postings ordered by term and block; ``top[t, b]`` is the largest weight of term t in block b, ``at[t, b]`` where its run begins.

    ``rows`` counts the labelled rows that an example stands for.
    """

    ids: np.ndarray
    y: np.ndarray
    rows: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    top: np.ndarray
    at: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, y: np.ndarray, rows: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> Index:
        term = np.concatenate([t for t, _ in vectors]).astype(np.int64)
        weight = np.concatenate([w for _, w in vectors])
        place = np.repeat(np.arange(len(vectors), dtype=np.int64), [len(t) for t, _ in vectors])
        order = np.lexsort((place, term))
        term, weight, place = term[order], weight[order], place[order]
        n_blocks = -(-len(vectors) // BLOCK)
        cell = term * n_blocks + place // BLOCK
        top = np.zeros(n_terms * n_blocks)
        np.maximum.at(top, cell, weight)
        at = np.searchsorted(cell, np.arange(n_terms * n_blocks + 1))
        at = np.stack([at[:-1].reshape(n_terms, n_blocks), at[1:].reshape(n_terms, n_blocks)])
        return cls(ids, y, rows, place.astype(np.int32), weight, top.reshape(n_terms, n_blocks), at.astype(np.int32))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples that share a term; ``without``: a place to leave out."""
        bound = weights @ self.top[terms]
        found, near, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(near) >= k and bound[b] < least - 1e-12:
                break
            first, size = self.at[0, terms, b], self.at[1, terms, b] - self.at[0, terms, b]
            run = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            dot = np.bincount(self.place[run] - b * BLOCK, np.repeat(weights, size) * self.weight[run], BLOCK)
            if 0 <= without - b * BLOCK < BLOCK:
                dot[without - b * BLOCK] = 0
            hit = np.flatnonzero(dot > max(0.0, least - 1e-12))
            found, near = np.r_[found, hit + b * BLOCK], np.r_[near, dot[hit]]
            if len(near) >= k:
                best = np.lexsort((self.ids[found], -near.round(12)))[:k]
                found, near = found[best], near[best]
                least = near[-1]
        best = np.lexsort((self.ids[found], -near.round(12)))[:k]
        return found[best], near[best]

    def vote(self, found: np.ndarray, near: np.ndarray, prior: float) -> float:
        w = near**2 * self.rows[found]
        return float((w @ self.y[found] + 0.05 * prior) / (w.sum() + 0.05))


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: scores and their calibrated values, for interpolation."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order]):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([p / c for p, _, c in blocks]), np.array([q / c for _, q, c in blocks])


@dataclass
class Model:
    settings: Settings
    number: dict[str, int]
    idf: np.ndarray
    index: Index | None
    prior: float
    unmatched: float
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def score(self, found: np.ndarray, near: np.ndarray) -> float:
        if not len(found):
            return self.unmatched
        raw = self.index.vote(found, near, self.prior)
        return float(np.interp(raw, *self.knots)) if self.knots else raw


def sampled(labelled: DataFrame, y: int, settings: Settings) -> DataFrame:
    """At most ``examples`` ids of a class, those with the smallest hash of the id."""
    return labelled.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.examples)


def chosen_terms(sample: DataFrame, n: dict[int, int], settings: Settings) -> list[tuple[str, int]]:
    """Terms whose document rates differ between the classes, surely (likelihood ratio G2) and much (``least_lift``), with their document counts.

    ``terms`` at most, those with the largest G2.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y].update({t for w in set(WORD.findall(text.lower())) for t in terms_of(w)})
        both = list(seen[0].keys() | seen[1].keys())
        for k in range(0, len(both), 100_000):
            part = both[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[0][t] for t in part], pa.int64()), pa.array([seen[1][t] for t in part], pa.int64())], ["term", "n0", "n1"])

    counts = sample.select("text", "y").mapInArrow(task, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counts.where(F.col("n0") + F.col("n1") >= settings.least_rows)
    both, all_rows = F.col("n0") + F.col("n1"), n[0] + n[1]
    part = lambda c, size: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * all_rows / (both * size))).otherwise(0.0)
    lift = F.abs(F.log((F.col("n1") + 0.5) / (n[1] + 1.0)) - F.log((F.col("n0") + 0.5) / (n[0] + 1.0)))
    telling = counts.withColumn("g2", 2 * (part("n0", n[0]) + part("n1", n[1]))).where((F.col("g2") >= settings.least_g2) & (lift >= math.log(settings.least_lift)))
    best = telling.orderBy(F.desc("g2"), "term").limit(settings.terms)
    return [(r["term"], r["n0"] + r["n1"]) for r in best.collect()]


def fit(docs: DataFrame, labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """``labelled``: (doc_id, y).  Reads the texts of the sampled examples only."""
    spark = docs.sparkSession
    total = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    rows = sum(total.values())
    prior = total.get(1, 0) / rows if rows else 0.0
    if len(total) < 2:
        return Model(settings, {}, np.zeros(0), None, prior, prior)
    ids = sampled(labelled, 0, settings).unionByName(sampled(labelled, 1, settings))
    sample = stored(texts_of(docs).join(F.broadcast(ids), "doc_id"), "toxicity-examples")  # two classes of bounded size
    n = {0: 0, 1: 0} | {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not min(n.values()):
        return Model(settings, {}, np.zeros(0), None, prior, prior)
    terms = chosen_terms(sample, n, settings)
    number = {t: k for k, (t, _) in enumerate(terms)}
    idf = np.log((1 + n[0] + n[1]) / (1 + np.array([c for _, c in terms], float))) + 1
    sent = spark.sparkContext.broadcast((number, idf))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(sent.value[0])
        for b in batches:
            found = [vector(t.as_py(), terms, sent.value[1]) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([t.tolist() for t, _ in found], pa.list_(pa.int32())), pa.array([w.tolist() for _, w in found], pa.list_(pa.float64()))], ["doc_id", "y", "t", "w"])

    got = sample.select("doc_id", "text", "y").mapInArrow(task, "doc_id long, y int, t array<int>, w array<double>").collect()  # the examples, a bounded number
    got.sort(key=lambda r: (r["t"][:1] or [1 << 30], r["doc_id"], r["t"], r["w"]))  # alike examples share blocks, which sharpens the bounds
    y = np.array([r["y"] for r in got])
    stands = np.where(y == 1, total[1] / n[1], total[0] / n[0])
    vectors = [(np.array(r["t"], np.int32), np.array(r["w"], np.float64)) for r in got]
    empty = np.array([not len(t) for t, _ in vectors])
    unmatched = float((stands[empty] @ y[empty] + prior) / (stands[empty].sum() + 1))
    index = Index.build(np.array([r["doc_id"] for r in got], np.int64), y, stands, vectors, len(terms))
    model = Model(settings, number, idf, index, prior, unmatched)
    raw, own = left_out(spark, model, vectors)
    if len(set(y[own])) == 2:
        model.knots = pool_adjacent(np.r_[0.0, raw, 1.0], np.r_[0.0, y[own], 1.0], np.r_[1.0, stands[own], 1.0])
    return model


def left_out(spark: SparkSession, model: Model, vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Votes for each example from the others, scored in tasks, and the examples' places; without those that match nothing."""
    sent, settings = spark.sparkContext.broadcast(model), model.settings

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            out: list[tuple[int, float]] = []
            for k, t, w in zip(*(c.to_pylist() for c in b.columns)):
                found, near = m.index.nearest(np.array(t, np.int32), np.array(w), settings.neighbours, without=k)
                if len(found):
                    out.append((k, m.index.vote(found, near, m.prior)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([v for _, v in out], pa.float64())], ["k", "raw"])

    rows = [(k, t.tolist(), w.tolist()) for k, (t, w) in enumerate(vectors) if len(t)]
    if not rows:
        return np.zeros(0), np.zeros(0, np.int64)
    examples = spark.createDataFrame(rows, "k long, t array<int>, w array<double>").repartition(8)
    got = sorted(tuple(r) for r in examples.mapInArrow(task, "k long, raw double").collect())  # the examples, a bounded number
    return np.array([v for _, v in got]), np.array([k for k, _ in got], np.int64)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, version, score, evidence_ids, evidence_terms) of every document; ``version``: the hash of its text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, version long, score double, evidence_ids array<long>, evidence_terms array<string>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        terms, names = Terms(m.number), list(m.number)
        for b in batches:
            score, near_ids, shared = [], [], []
            for t in b.column(1):
                at, w = vector(t.as_py(), terms, m.idf)
                found, near = m.index.nearest(at, w, m.settings.neighbours) if m.index and len(at) else (at, w)
                score.append(m.score(found, near))
                near_ids.append(m.index.ids[found[:3]].tolist() if len(found) else [])
                best = np.argsort(-w, kind="stable")[:3] if len(found) else []
                shared.append([names[at[i]] for i in best])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score, pa.float64()), pa.array(near_ids, pa.list_(pa.int64())), pa.array(shared, pa.list_(pa.string()))], ["doc_id", "version", "score", "evidence_ids", "evidence_terms"])

    return texts_of(docs).withColumn("version", version_of(F.col("text"))).mapInArrow(task, schema)


def version_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, least: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows predicted 1; each row goes by its own text, whatever rows share its id or have none."""
    judged = scored(docs, fit(docs, training_labels(labels, label, folds, held_out), settings))
    gone = stored(judged.where(F.col("score") >= least).select(F.col("doc_id").alias("gone id"), F.col("version").alias("gone version")).distinct(), "toxicity-gone")
    same = F.col("doc_id").eqNullSafe(F.col("gone id")) & (version_of(docs["text"]) == F.col("gone version"))
    return docs.join(F.broadcast(gone) if small_enough(gone, 1_000_000) else gone, same, "left_anti")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, least: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document."""
    model = fit(docs, training_labels(labels, label, folds, held_out), settings)
    out = scored(docs, model)
    return out.select("doc_id", (fold_of("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "evidence_ids", "evidence_terms")
