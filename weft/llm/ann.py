"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by a hash of their id.  Each shard's graph is built in one
task and stored as flat arrays (neighbour numbers with a fixed number of places a vector,
upper levels as node lists with their own arrays) in one row of a stored table, so a shard
has a bounded size and is built once.  Query vectors are cut into blocks; every (shard,
block) is one group that searches the shard's graph, and the shards' lists are merged per
query.  Every vector is in the index; nothing is sampled.

Nearness is the inner product.  The graph sees scaled vectors with one more coordinate that
gives all of them the same length, which makes the inner product a distance; scores are
taken on the original vectors in double precision.

Equal vectors are one node with a list of ids, so thousands of copies neither disconnect
the graph nor fill a result.

Edge cases: vectors that are null, empty, zero, or hold a null or a non-finite component
take no part, as queries or as candidates; so do null ids.  Rows that repeat an id count
once (the least vector).  Vectors of different lengths are different spaces.  Ties go to
the smaller id.  With fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARD_ROWS = 8_192
LEAST_SHARDS = 8
BLOCK_QUERIES = 2_048
M = 16
EF_BUILD = 96
EF_SEARCH = 512
#: Nodes inserted at once, at most; queries that walk the graph at once; nodes that each of them opens in a step.
BATCH, ABREAST, OPENED = 256, 128, 6


def same_length(x: np.ndarray) -> np.ndarray:
    """float32 rows, scaled to a largest norm of one, with one more coordinate that makes all norms equal."""
    x = x / max(np.abs(x).max(initial=0.0), np.finfo(np.float64).tiny)
    square = (x**2).sum(1)
    most = square.max(initial=0.0) or 1.0
    return np.concatenate([x, np.sqrt(np.maximum(most - square, 0))[:, None]], 1).astype(np.float32) / np.float32(most**0.5)


def levels_of(n: int) -> np.ndarray:
    """Level of each node: exponential, from a fixed generator, so a retry builds the same graph."""
    u = np.random.default_rng(7).random(n)
    return np.minimum(-np.log(1 - u) / math.log(M), 12).astype(np.int32)


class Graph:
    """``links[l]``: node i's neighbours on level l lie in row ``row[l][i]``; n, the number of nodes, marks an unused place.

    Whole batches of queries walk the graph side by side, and whole batches of nodes are
    inserted: each is linked to what the graph finds for it and to its nearest in the batch.
    """

    def __init__(self, x: np.ndarray, levels: np.ndarray):
        self.x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        self.levels, self.n = levels, len(x)
        self.row, self.links, self.entry = [], [], 0
        for level in range(int(levels.max(initial=0)) + 1):
            own = np.flatnonzero(levels >= level)
            row = np.full(self.n + 1, len(own), np.int32)
            row[own] = np.arange(len(own))
            self.row.append(row)
            self.links.append(np.full((len(own) + 1, M if level else 2 * M), self.n, np.int32))

    def search(self, q: np.ndarray, starts: np.ndarray, ef: int, level: int, opened: int = OPENED) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of the ``ef`` best found for each row of ``q`` from its row of ``starts``, best first."""
        found = [self._walk(q[a : a + ABREAST], starts[a : a + ABREAST], ef, level, min(opened, ef)) for a in range(0, len(q), ABREAST)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _walk(self, q: np.ndarray, starts: np.ndarray, ef: int, level: int, opened: int) -> tuple[np.ndarray, np.ndarray]:
        links, row, none = self.links[level], self.row[level], np.float32(-np.inf)
        ids = np.full((len(q), max(ef, starts.shape[1])), self.n, np.int32)
        sims, unopened = np.full(ids.shape, none), np.zeros(ids.shape, np.bool_)
        seen = np.zeros((len(q), self.n + 1), np.bool_)
        seen[:, self.n] = True
        ids[:, : starts.shape[1]] = starts
        sims[:, : starts.shape[1]] = np.where(starts < self.n, (self.x[starts] * q[:, None]).sum(2), none)
        unopened[:] = sims > none
        np.put_along_axis(seen, starts.astype(np.int64), True, 1)
        width, todo = ids.shape[1], np.arange(len(q))
        while len(todo):
            best = np.where(unopened[todo], sims[todo], none)
            pick = np.argpartition(-best, opened - 1, 1)[:, :opened] if opened < width else np.tile(np.arange(width), (len(todo), 1))
            value = np.take_along_axis(best, pick, 1)
            live = value.max(1) > none
            todo, pick, value = todo[live], pick[live], value[live]
            if not len(todo):
                break
            at = todo[:, None]
            nodes = np.where(value > none, ids[at, pick], self.n)
            unopened[at, pick] = False
            near = np.sort(links[row[nodes]].reshape(len(todo), -1), 1)
            new = ~seen[at, near]
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[at, near] = True
            r, c = np.nonzero(new)
            v = np.full(near.shape, none)
            v[r, c] = np.einsum("ij,ij->i", self.x[near[r, c]], q[todo[r]])
            every, all_ids, all_open = np.concatenate([sims[todo], v], 1), np.concatenate([ids[todo], near], 1), np.concatenate([unopened[todo], new], 1)
            keep = np.argpartition(-every, width - 1, 1)[:, :width]
            sims[todo], ids[todo], unopened[todo] = (np.take_along_axis(z, keep, 1) for z in (every, all_ids, all_open))
        order = np.argsort(-sims, 1, kind="stable")[:, :ef]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(sims > none, ids, self.n), sims

    def diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """``most`` of each row's candidates, which come best first: those nearer to the node than to one already taken, then the best of the rest."""
        out = np.full((len(ids), most), self.n, np.int32)
        for a in range(0, len(ids), BATCH):
            i, s = ids[a : a + BATCH], sims[a : a + BATCH]
            v = self.x[i]
            among = v @ v.transpose(0, 2, 1)
            there, closest = s > -np.inf, np.full(s.shape, np.float32(-np.inf))
            taken, count = np.zeros(s.shape, np.bool_), np.zeros(len(s), np.int32)
            for c in range(s.shape[1]):
                ok = there[:, c] & (s[:, c] > closest[:, c]) & (count < most)
                taken[:, c] = ok
                count += ok
                closest[ok] = np.maximum(closest[ok], among[ok, c])
            rest = there & ~taken
            taken |= rest & (np.cumsum(rest, 1) <= (most - taken.sum(1))[:, None])
            first = np.argsort(~taken, 1, kind="stable")[:, :most]
            out[a : a + BATCH, : first.shape[1]] = np.where(np.take_along_axis(taken, first, 1), np.take_along_axis(i, first, 1), self.n)
        return out

    def connect(self, nodes: np.ndarray, near: np.ndarray, level: int) -> None:
        """Links ``nodes`` to their rows of ``near`` and back; a full list is cut to three quarters of its places."""
        links, row = self.links[level], self.row[level]
        places = links.shape[1]
        links[row[nodes], : near.shape[1]] = near
        src, dst = np.repeat(nodes, near.shape[1]), near.ravel()
        src, dst = src[dst < self.n], dst[dst < self.n]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        own, first, count = np.unique(dst, return_index=True, return_counts=True)
        if not len(own):
            return
        of = np.repeat(np.arange(len(own)), count)
        held = np.full((len(own), places + int(count.max())), self.n, np.int32)
        held[:, :places] = links[row[own]]
        known = (held[of, :places] == src[:, None]).any(1)
        held[of, places + np.arange(len(dst)) - first[of]] = np.where(known, self.n, src)
        full = (held < self.n).sum(1) > places
        links[row[own[~full]]] = np.sort(held[~full], 1)[:, :places]
        for a in range(0, int(full.sum()), BATCH):
            j, h = own[full][a : a + BATCH], held[full][a : a + BATCH]
            sims = np.where(h < self.n, (self.x[h] @ self.x[j][:, :, None])[:, :, 0], np.float32(-np.inf))
            best = np.argsort(-sims, 1, kind="stable")
            kept = self.diverse(np.take_along_axis(h, best, 1), np.take_along_axis(sims, best, 1), places * 3 // 4)
            links[row[j]] = self.n
            links[row[j], : kept.shape[1]] = kept

    def nearest(self, q: np.ndarray, ef: int) -> np.ndarray:
        """The nodes of the ``ef`` best found for each row of ``q``; n fills what is missing."""
        at = np.full((len(q), 1), self.entry)
        for k in range(int(self.levels[self.entry]), 0, -1):
            at, _ = self.search(q, at, 4, k, 2)
        return self.search(q, at, ef, 0)[0]

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        g = cls(same_length(x), levels_of(len(x)))
        nodes = np.argsort(-g.levels, kind="stable")  # high levels first: upper levels are whole before the bulk comes
        g.entry, done, top = int(nodes[0]), 1, int(g.levels.max(initial=0))
        while done < g.n:
            level = int(g.levels[nodes[done]])
            batch = nodes[done : done + max(1, min(BATCH, done // 2))]
            batch = batch[g.levels[batch] == level]
            q, at = g.x[batch], np.full((len(batch), 1), g.entry)
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            best = np.argsort(-own, 1, kind="stable")[:, :M]
            mine, mine_sims = np.where(np.take_along_axis(own, best, 1) > -np.inf, batch[best], g.n), np.take_along_axis(own, best, 1)
            for k in range(top, level, -1):
                at, _ = g.search(q, at, 1, k, 1)
            for k in range(level, -1, -1):
                at, sims = g.search(q, at, EF_BUILD, k)
                every, every_sims = np.concatenate([at, mine], 1), np.concatenate([sims, mine_sims], 1)
                order = np.argsort(-every_sims, 1, kind="stable")
                g.connect(batch, g.diverse(np.take_along_axis(every, order, 1), np.take_along_axis(every_sims, order, 1), M), k)
            done += len(batch)
        return g

    def flat(self) -> dict[str, bytes | list[bytes] | int]:
        return {"entry": self.entry, "levels": self.levels.tobytes(), "links": [a.tobytes() for a in self.links]}

    @classmethod
    def from_flat(cls, x: np.ndarray, entry: int, levels: bytes, links: list[bytes]) -> Graph:
        g = cls(same_length(x), np.frombuffer(levels, np.int32))
        g.entry = entry
        g.links = [np.frombuffer(b, np.int32).reshape(a.shape) for b, a in zip(links, g.links)]
        return g


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, v) of the vectors that take part, one row an id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    sound = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    return sound.groupBy("id").agg(F.min("v").alias("v")).select("id", F.size("v").alias("dim"), "v")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


INDEX = "dim int, shard int, vectors binary, start binary, ids binary, entry int, levels binary, links array<binary>"


def index_of(points: DataFrame, n_shards: int) -> DataFrame:
    """One row a shard: distinct vectors, the ids of each, and the graph as flat arrays."""

    def build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        x, ids = matrix(t.column("v"), dim), t.column("id").to_numpy()
        distinct, node = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, node.ravel()))
        start = np.r_[0, np.cumsum(np.bincount(node.ravel(), minlength=len(distinct)))].astype(np.int64)
        g = Graph.build(distinct).flat()
        row = {"dim": dim, "shard": key[1].as_py(), "vectors": distinct.tobytes(), "start": start.tobytes(), "ids": ids[order].astype(np.int64).tobytes(), **g}
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.binary())]
        return pa.table({k: pa.array([v], kind) for (k, v), kind in zip(row.items(), kinds)})

    return points.withColumn("shard", shard_of(n_shards)).groupBy("dim", "shard").applyInArrow(build, INDEX)


def shard_of(n_shards: int):
    return F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int")


def search(index: DataFrame, queries: DataFrame, n_shards: int, k: int, n_blocks: int, ef: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): ``queries`` holds id, dim and v; a query's own id is no candidate."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    left = index.select("*", blocks)
    right = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n_blocks)).cast("int"))
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))

    def one(key: tuple[pa.Scalar, ...], shard: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if shard.num_rows and asked.num_rows:
            dim = key[0].as_py()
            at = {c: shard.column(c)[0].as_py() for c in shard.column_names}
            x = np.frombuffer(at["vectors"], np.float64).reshape(-1, dim)
            start, ids = np.frombuffer(at["start"], np.int64), np.frombuffer(at["ids"], np.int64)
            g = Graph.from_flat(x, at["entry"], at["levels"], at["links"])
            q = matrix(asked.column("v"), dim)
            walking = np.concatenate([q / np.abs(q).max(1, keepdims=True), np.zeros((len(q), 1))], 1).astype(np.float32)
            for v, mine, nodes in zip(q, asked.column("id").to_pylist(), g.nearest(walking, ef)):
                nodes = nodes[nodes < g.n]
                found = [(-s, i) for s, node in zip((x[nodes] @ v).tolist(), nodes.tolist()) for i in ids[start[node] : min(start[node + 1], start[node] + k + 1)].tolist() if i != mine]
                for s, i in heapq.nsmallest(k, found):
                    out["query_id"].append(mine)
                    out["vec_id"].append(i)
                    out["score"].append(-s)
        return pa.table({c: pa.array(v, pa.float64() if c == "score" else pa.int64()) for c, v in out.items()})

    keys = ("dim", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(one, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors of every vector whose id meets ``is_query`` (a function of the id column)."""
    points = stored(usable(vectors, id_col, vector_col), "ann-points")
    n = points.count()
    n_shards = max(LEAST_SHARDS, -(-n // SHARD_ROWS))
    queries = points.where(is_query(F.col("id")))
    n_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    return search(stored(index_of(points, n_shards), "ann-index"), queries, n_shards, k, n_blocks)
