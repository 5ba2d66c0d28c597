"""Hard negatives: for an anchor and each of its positives, the best rows of other labels whose score lies in a window.

Rows become vectors of integers, ``floor(256 * x)``; a score is their inner product, in whole
numbers.  Rows are range-partitioned by label and first coordinates into shards; each
shard is packed into an R-tree by sort-tile-recursive: rows are sorted by label, cut into slabs,
each slab by the next coordinate, and so on, until a tile fills one leaf.  Runs of leaves form
the nodes above.  A node's minimum bounding box bounds the product with an anchor from both
sides, coordinate by coordinate.  A best-first queue opens the node with the largest upper
bound; nodes outside every window, or strictly below the last of a full list, are dropped
(equal bounds are opened, as ties go to the smaller id).

A shard's tree stays in its place: it is read once, and the anchors, some hundredth of the
rows, stream past it in Arrow batches.  For positives an anchor visits only the shards that hold
its label.  Lists of the shards are merged by rank.  Anchors times shards is the work by its
nature; nothing is sampled.

Defined cases: null ids, labels or vectors, and null, non-finite or, times 256, infinite
components take no part.  Rows that repeat an id count once, the least by label and vector.
Vectors of different lengths are different spaces; empty ones score 0.  With fewer
rows than asked for, all are returned; an anchor without positives gives none, nor does an empty
table.  Scores that doubles can't hold are taken in Python's whole numbers, of up to 38
digits (larger ones count as the largest); beyond a long they are reported as the nearest long.  Other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_by_size, small_batches, stored

SHARD_ROWS = 8_192
#: Rows in a leaf; children of a node.
LEAF, FAN = 64, 8
#: Anchors whose bounds are computed at once.
ABREAST = 256
#: (shard, label) pairs that may be broadcast: 12 bytes each.
BROADCAST_PAIRS = 500_000
#: Products below are whole in doubles, and so are a hundred times as much.
EXACT = 1 << 46
#: Scores travel with 38 digits and are handed out as longs.
DIGITS, LONG = 10**38 - 1, (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """(id, label, dim, v) of the rows that take part, one an id; ``v`` as doubles times 256, not yet floored."""
    scaled = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * 256.0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), scaled.alias("v")).where("id is not null and label is not null and v is not null")
    sound = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    one = sound.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", F.size("row.v").alias("dim"), "row.v")
    return one


def tiled(x: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order of the rows such that every run of LEAF rows is one tile."""
    spread = np.argsort(-x.var(0), kind="stable").tolist() if len(x) else []
    out: list[np.ndarray] = []

    def cut(rows: np.ndarray, depth: int) -> None:
        pages = -(-len(rows) // LEAF)
        if pages <= 1 or depth > len(spread):
            out.append(rows)
            return
        key = labels[rows] if depth == 0 else x[rows, spread[depth - 1]]
        rows = rows[np.lexsort((ids[rows], key))]
        slabs = min(pages, len(np.unique(key))) if depth == 0 else max(2, round(pages ** (1 / (len(spread) - depth + 1))))
        step = -(-pages // max(slabs, 1)) * LEAF
        for s in range(0, len(rows), step):
            cut(rows[s : s + step], depth + 1)

    cut(np.arange(len(x)), 0)
    return np.concatenate(out) if out else np.arange(0)


class Tree:
    """A packed R-tree in flat arrays: ``levels[0]`` leaves of LEAF rows, above them nodes of FAN children, at last one root; nodes are numbered from the leaves up."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        starts = np.arange(0, len(x), LEAF)
        lo, hi = np.minimum.reduceat(x, starts, 0), np.maximum.reduceat(x, starts, 0)
        first, last = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
        boxes = [(lo, hi, first, last)]
        while len(boxes[-1][0]) > 1:
            lo, hi, first, last = boxes[-1]
            starts = np.arange(0, len(lo), FAN)
            boxes.append((np.minimum.reduceat(lo, starts, 0), np.maximum.reduceat(hi, starts, 0), np.minimum.reduceat(first, starts), np.maximum.reduceat(last, starts)))
        self.starts = np.cumsum([0, *(len(b[0]) for b in boxes)]).tolist()
        self.lo, self.hi = (np.concatenate([b[k] for b in boxes]) for k in (0, 1))
        self.first, self.last = (np.concatenate([b[k] for b in boxes]).tolist() for k in (2, 3))
        self.most = float(np.abs(x).max(initial=0))
        self.children: list[range] = [range(0)] * (self.starts[1])
        for level in range(1, len(boxes)):
            below, above = self.starts[level - 1], self.starts[level]
            for j in range(len(boxes[level][0])):
                self.children.append(range(below + j * FAN, min(below + (j + 1) * FAN, above)))
        self.root = self.starts[-1] - 1
        self.whole: Tree | None = None

    def in_whole_numbers(self) -> Tree:
        """The same tree with Python's whole numbers, for products beyond 53 bits."""
        if self.whole is None:
            self.whole = object.__new__(Tree)
            self.whole.__dict__ = dict(self.__dict__)
            for name in ("x", "lo", "hi"):
                setattr(self.whole, name, whole_numbers(getattr(self, name)))
        return self.whole

    def scores(self, leaf: int, q: np.ndarray) -> np.ndarray:
        s = self.x[leaf * LEAF : (leaf + 1) * LEAF] @ q
        return s.astype(np.int64) if s.dtype == np.float64 else s


def whole_numbers(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(c) for c in x.ravel().tolist()]
    return out


class Best:
    """The first ``k`` of (score, id) pairs handed over, larger scores and then smaller ids first."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.pairs: list[tuple[int, int]] = []

    def least(self) -> int | None:
        """Scores strictly below can't enter."""
        return -self.pairs[-1][0] if len(self.pairs) == self.k else None

    def may_hold(self, lower: float, upper: float) -> bool:
        least = self.least()
        return (self.low is None or (100 * upper >= self.low and 100 * lower <= self.high)) and (least is None or upper >= least)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.low is not None:
            keep = (100 * scores >= self.low) & (100 * scores <= self.high)
            scores, ids = scores[keep], ids[keep]
        if (least := self.least()) is not None:
            keep = scores >= least
            scores, ids = scores[keep], ids[keep]
        if len(scores):
            self.pairs = heapq.nsmallest(self.k, self.pairs + list(zip((-scores).tolist(), ids.tolist())))


def best_first(tree: Tree, q: np.ndarray, lower: list, upper: list, fits: Callable[[int], bool], rows_that_fit: Callable[[int], np.ndarray], lists: list[Best]) -> None:
    """Fills ``lists`` from the tree: the node of the largest upper bound is opened first."""
    queue = [(-upper[tree.root], tree.root)]
    n_leaves = tree.starts[1]
    while queue:
        bound, node = heapq.heappop(queue)
        open_lists = [b for b in lists if b.may_hold(lower[node], -bound)]
        if not open_lists:
            continue
        if node < n_leaves:
            keep = rows_that_fit(node)
            if len(keep):
                scores, ids = tree.scores(node, q)[keep], tree.ids[node * LEAF : (node + 1) * LEAF][keep]
                for b in open_lists:
                    b.take(scores, ids)
            continue
        for child in tree.children[node]:
            if fits(child) and any(b.may_hold(lower[child], upper[child]) for b in open_lists):
                heapq.heappush(queue, (-upper[child], child))


def searched(tree: Tree, q: np.ndarray, ids: list[int], labels: list[int], positives: list[list[tuple[int, int]] | None], k: int, window: tuple[int, int]) -> Iterator[tuple[int, int | None, int | None, list[tuple[int, int]]]]:
    """(anchor, positive, its score, best pairs): without ``positives`` the rows of the anchor's label, with them those of other labels in each window."""
    if tree.most * float(np.abs(q).max(initial=0)) * max(q.shape[1], 1) >= EXACT:
        tree, q = tree.in_whole_numbers(), whole_numbers(q)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    upper, lower = up @ tree.hi.T + down @ tree.lo.T, up @ tree.lo.T + down @ tree.hi.T
    for k_row, (me, label, known) in enumerate(zip(ids, labels, positives)):
        if known is None:
            lists = [Best(k)]
            fits = lambda node: tree.first[node] <= label <= tree.last[node]
            rows = lambda leaf: np.flatnonzero((tree.labels[leaf * LEAF : (leaf + 1) * LEAF] == label) & (tree.ids[leaf * LEAF : (leaf + 1) * LEAF] != me))
        else:
            lists = [Best(k, window[0] * score, window[1] * score) for _, score in known]
            fits = lambda node: not tree.first[node] == label == tree.last[node]
            rows = lambda leaf: np.flatnonzero(tree.labels[leaf * LEAF : (leaf + 1) * LEAF] != label)
        best_first(tree, q[k_row], lower[k_row].tolist(), upper[k_row].tolist(), fits, rows, lists)
        for b, (positive, score) in zip(lists, known or [(None, None)]):
            yield me, positive, None if score is None else Decimal(score), b.pairs


TREE = "ids binary, labels binary, vectors binary"


def shards_of(points: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a shard and space: its rows in the order of its tree's leaves, as flat arrays, and the labels it holds."""
    n = points.count()
    keys = ["dim", "label", F.get("v", F.lit(0)), F.get("v", F.lit(1)), "id"]
    placed = stored(points.repartitionByRange(max(1, -(-n // shard_rows)), *keys).withColumn("shard", F.spark_partition_id()), "negatives-rows")

    def build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        x = np.floor(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(t.num_rows, dim)
        ids, labels = t.column("id").to_numpy(), t.column("label").to_numpy()
        order = tiled(x, labels, ids)
        row = {"dim": dim, "shard": key[1].as_py(), "held": np.unique(labels).tolist(), "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "vectors": x[order].tobytes()}
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({k: pa.array([v], kind) for (k, v), kind in zip(row.items(), kinds)})

    return placed.groupBy("dim", "shard").applyInArrow(build, f"dim int, shard int, held array<bigint>, {TREE}")


SCORE = "decimal(38,0)"
FOUND = f"anchor_id long, positive_id long, positive_score {SCORE}, id long, score {SCORE}"


def streamed(shards: DataFrame, asked: DataFrame, k: int, window: tuple[int, int]) -> DataFrame:
    """FOUND rows: ``asked`` (dim, shard, anchor_id, label, v, positives) streams past the tree of its shard."""
    none = F.lit(None)
    trees = shards.select("dim", "shard", F.lit(0).alias("kind"), "ids", "labels", "vectors", *(none.cast(t).alias(c) for c, t in asked.select("anchor_id", "label", "v", "positives").dtypes))
    anchors = asked.select("dim", "shard", F.lit(1).alias("kind"), *(none.cast("binary").alias(c) for c in ("ids", "labels", "vectors")), "anchor_id", "label", "v", "positives")
    small_batches(shards.sparkSession)
    wide = max(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = trees.unionByName(anchors).repartition(wide, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")

    score = pa.decimal128(38)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for b in batches:
            out: list[tuple] = []
            dims, places, kinds = (b.column(c).to_pylist() for c in range(3))
            s = 0
            while s < len(kinds):
                if kinds[s] == 0:
                    at = (dims[s], places[s])
                    ids, labels = (np.frombuffer(b.column(c)[s].as_py(), np.int64) for c in (3, 4))
                    tree = Tree(ids, labels, np.frombuffer(b.column(5)[s].as_py(), np.float64).reshape(len(ids), dims[s]))
                    s += 1
                    continue
                e = s
                while e < len(kinds) and kinds[e] == 1 and (dims[e], places[e]) == (dims[s], places[s]) and e - s < ABREAST:
                    e += 1
                if at == (dims[s], places[s]):
                    part = b.slice(s, e - s)
                    q = np.floor(part.column(8).flatten().to_numpy(zero_copy_only=False)).reshape(e - s, dims[s])
                    known = [None if p is None else [(x["id"], int(x["score"])) for x in p] for p in part.column(9).to_pylist()]
                    for me, positive, of_positive, pairs in searched(tree, q, part.column(6).to_pylist(), part.column(7).to_pylist(), known, k, window):
                        out += [(me, positive, of_positive, i, Decimal(max(-DIGITS, min(DIGITS, -negated)))) for negated, i in pairs]
                s = e
            columns = list(zip(*out)) or [()] * 5
            kinds = [score if c in (2, 4) else pa.int64() for c in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["anchor_id", "positive_id", "positive_score", "id", "score"])

    return dealt.mapInArrow(task, FOUND)


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def as_long(score: str) -> Column:
    return F.greatest(F.least(F.col(score), F.lit(LONG).cast(SCORE)), F.lit(-LONG - 1).cast(SCORE)).cast("long")


def mined(points: DataFrame, is_anchor: Callable[[Column], Column], n_positives: int = 5, n_negatives: int = 10, window: tuple[int, int] = (30, 90), shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``usable`` rows; ``window`` is in hundredths of the positive's score."""
    points = stored(points, "negatives-points")
    shards = stored(shards_of(points, shard_rows), "negatives-trees")
    places = stored(shards.select("dim", "shard", F.explode("held").alias("label")), "negatives-places")
    anchors = points.where(is_anchor(F.col("id"))).withColumnRenamed("id", "anchor_id")
    kind = f"array<struct<id:bigint,score:{SCORE}>>"
    same = joined_by_size(anchors, places, ["dim", "label"], "inner", BROADCAST_PAIRS).withColumn("positives", F.lit(None).cast(kind))
    positives = ranked(streamed(shards, same, n_positives, window), ["anchor_id"], n_positives)
    positives = stored(positives.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives")), "negatives-positives")
    every = shards.groupBy("dim").agg(F.collect_set("shard").alias("shards"))
    asked = anchors.join(positives, "anchor_id").join(F.broadcast(every), "dim").withColumn("shard", F.explode("shards"))
    found = streamed(shards, asked, n_negatives, window)
    best = ranked(found, ["anchor_id", "positive_id"], n_negatives)
    return best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), as_long("positive_score").alias("positive_score"), as_long("score").alias("negative_score"))
