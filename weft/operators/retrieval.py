"""Fuzzy, vector and full-text retrieval, set at a time.

Inverted-list joins (trigrams, words) are equi-joins on the token, so they scale with the
postings that meet; exact nearest neighbours run as matrix products of bounded blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..functions import text, vector
from ..functions.phonetic import double_metaphone_keys, jaro_winkler_similarity, metaphone_key, phonetic_score
from .relational import top_per_key


#: Query terms up to which they are sent to every executor.
MOST_TERMS = 1_000_000
#: Pairs of a query and a word up to which a document meets all of them in its task; documents and cells of scores looked at together.
MOST_PAIRS, TASK_DOCS, TASK_CELLS = 200_000, 1_000, 1_000_000
WORD = re.compile("[a-z0-9]+")


def trigram_join(left: DataFrame, right: DataFrame, column: str, least: float) -> DataFrame:
    """(a, b, similarity) of distinct values of ``column`` on both sides with trigram similarity >= ``least``.

    Postings meet on trigrams; set sizes travel with them, so the similarity follows from
    the count of shared trigrams, and sizes too far apart never meet.
    """

    def postings(df: DataFrame, s: str) -> DataFrame:
        sets = df.select(F.col(column).alias(s)).where(F.col(s).isNotNull()).distinct().withColumn("t", text.trigrams(F.col(s)))
        return sets.select(s, F.size("t").alias(f"n_{s}"), F.explode("t").alias("t"))

    met = postings(left, "a").join(postings(right, "b"), "t").where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
    shared = met.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    return shared.withColumn("similarity", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).where(F.col("similarity") >= least).select("a", "b", "similarity")


def contained_names(names: DataFrame, column: str = "name") -> DataFrame:
    """(name) of the distinct values that lie within a longer one.

    A name is looked for only where its rarest run of three characters stands (the whole name, if shorter), so common runs
    are not joined on.
    """
    distinct = names.select(F.col(column).alias("name")).where("name <> ''").distinct()
    runs = lambda k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - (k - 1), F.lit(1))), lambda i: F.substring("name", i, F.lit(k))))
    postings = distinct.select("name", F.explode(F.concat(*(F.when(F.length("name") >= k, runs(k)).otherwise(F.array().cast("array<string>")) for k in (1, 2, 3)))).alias("run"))
    own = postings.where(F.length("run") == F.least(F.length("name"), F.lit(3))).join(postings.groupBy("run").agg(F.count("*").alias("n")), "run")
    rarest = top_per_key(own, ["name"], 1, F.asc("n"), F.asc("run")).select(F.col("name").alias("short"), "run")
    met = rarest.join(postings, "run").where((F.col("short") != F.col("name")) & F.contains("name", F.col("short")))
    return met.select(F.col("short").alias("name")).distinct()


def with_phonetic_key(df: DataFrame, column: str, out: str = "phonetic") -> DataFrame:
    """Adds the metaphone key, computed once a distinct value."""
    keys = df.select(column).distinct().withColumn(out, metaphone_key(F.col(column)))
    return df.join(keys, column, "left")


def phonetic_join(left: DataFrame, right: DataFrame, column: str, codes: int = 4) -> DataFrame:
    """(a, b, score) of distinct values whose metaphone keys begin with the same ``codes`` codes; the beginning is what counts as sounding alike."""
    of = lambda df, s: with_phonetic_key(df.select(F.col(column).alias(s)).distinct(), s, f"key_{s}").where(f"key_{s} <> ''").withColumn("k", F.substring(f"key_{s}", 1, codes))
    return of(left, "a").join(of(right, "b"), "k").select("a", "b", phonetic_score(F.col("key_b"), F.col("key_a")).alias("score"))


def candidate_scores(mentions: DataFrame, names: DataFrame, column: str = "name", t: Thresholds = DEFAULTS) -> DataFrame:
    """(mention, name, trigram, jaro_winkler, match_score) for distinct strings of both sides.

    Recall: trigram similarity of at least ``trigram_match``.  The match score is the best
    signal; weaker matches than ``keep_match`` go.
    """
    pairs = trigram_join(mentions.select(F.col("mention").alias(column)), names, column, t.trigram_match)
    scored = pairs.select(F.col("a").alias("mention"), F.col("b").alias(column), F.col("similarity").alias("trigram"), jaro_winkler_similarity("a", "b").alias("jaro_winkler"))
    return scored.withColumn("match_score", F.greatest("trigram", "jaro_winkler")).where(F.col("match_score") >= t.keep_match)


def phonetic_codes(strings: DataFrame, column: str) -> DataFrame:
    """(s, key, codes): the metaphone key of each distinct string, and the codes by which it may be recalled: that key, its first word's key, and both Double Metaphone keys."""
    s = strings.select(F.col(column).alias("s")).where(F.col("s").isNotNull()).distinct()
    keyed = s.select("s", metaphone_key("s").alias("key"), metaphone_key(F.split("s", " ")[0]).alias("first"), double_metaphone_keys("s").alias("dm"))
    tagged = lambda tag, c: F.when(c != "", F.concat(F.lit(tag), c))
    return keyed.select("s", "key", F.array_distinct(F.array_compact(F.array(tagged("k", F.col("key")), tagged("f", F.col("first")), tagged("d", F.col("dm.primary")), tagged("d", F.col("dm.alternate"))))).alias("codes"))


def signal_candidates(mentions: DataFrame, names: DataFrame, vectors: DataFrame | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """(mention, name, trigram, jaro_winkler, phonetic, vector, match_score) of every pair that a signal recalls.

    Recall: trigram similarity, an equal phonetic code, or a row of ``vectors`` (mention, name,
    distance).  The match score is the best of trigram, Jaro-Winkler and vector signal; weaker
    matches than ``keep_match`` go.  Each recall is an equi-join; strings are scored once a pair.
    """
    near = trigram_join(mentions.select(F.col("mention").alias("name")), names, "name", t.trigram_match).select(F.col("a").alias("mention"), F.col("b").alias("name"))
    a, b = phonetic_codes(mentions, "mention"), phonetic_codes(names, "name")
    exploded = lambda df, c: df.select(F.col("s").alias(c), F.explode("codes").alias("code"))
    sounding = exploded(a, "mention").join(exploded(b, "name"), "code").select("mention", "name")
    pairs = near.unionByName(sounding)
    if vectors is not None:
        pairs = pairs.unionByName(vectors.select("mention", "name"))
    keys = lambda df, c, k: df.select(F.col("s").alias(c), F.col("key").alias(k))
    both = pairs.distinct().join(keys(a, "mention", "key_a"), "mention").join(keys(b, "name", "key_b"), "name")
    if vectors is not None:
        both = both.join(vectors.select("mention", "name", (1 - F.col("distance")).alias("vector")), ["mention", "name"], "left")
    else:
        both = both.withColumn("vector", F.lit(None).cast("double"))
    scored = both.select("mention", "name", text.trigram_similarity(F.col("mention"), F.col("name")).alias("trigram"), jaro_winkler_similarity("mention", "name").alias("jaro_winkler"), phonetic_score(F.col("key_b"), F.col("key_a")).alias("phonetic"), "vector")
    return scored.withColumn("match_score", F.greatest("trigram", "jaro_winkler", "vector")).where(F.col("match_score") >= t.keep_match)


def escalated(found: DataFrame, wanted: DataFrame, key: str, next_stage) -> DataFrame:
    """``found`` and, for keys of ``wanted`` without a result, what ``next_stage(missing keys)`` finds."""
    missing = wanted.join(found.select(key).distinct(), key, "left_anti")
    return found.unionByName(next_stage(missing))


class Words:
    """The words of a bounded set of queries, which go with every task: their numbers, and the queries of each.

    Pairs that are given twice count twice.
    """

    def __init__(self, pairs: list[tuple]):
        self.queries = list(dict.fromkeys(q for q, _ in pairs))
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for _, w in pairs))}
        place = {q: i for i, q in enumerate(self.queries)}
        word, query = (np.array(x, dtype="i8") for x in ([self.number[w] for _, w in pairs], [place[q] for q, _ in pairs]))
        order = np.argsort(word, kind="stable")
        self.of = query[order]
        self.begin = np.searchsorted(word[order], np.arange(len(self.number) + 1))

    @staticmethod
    def of_queries(queries: DataFrame, docs: DataFrame, *keys: str) -> Words | None:
        """``queries``: keys, text; None where pairs are too many, or where ``doc_id`` is no whole number, missing or not unique, so that documents are put together by a shuffle."""
        if docs.schema["doc_id"].dataType.typeName() not in ("integer", "long") or queries.schema[keys[0]].dataType.typeName() not in ("integer", "long"):
            return None
        pairs = queries.select(*keys, F.explode(F.array_distinct(text.words(F.col("text")))).alias("word"))
        if pairs.count() > MOST_PAIRS or not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
            return None
        return Words([(tuple(r[c] for c in keys), r["word"]) for r in pairs.collect()])

    def met(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of some documents at once: ids, numbers of words, and of each word that a query has its document's place, its number and how often it stands there."""
        for batch in batches:
            for start in range(0, batch.num_rows, TASK_DOCS):
                part = batch.slice(start, TASK_DOCS)
                length, at, words = [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    found = WORD.findall(t)
                    length.append(len(found))
                    known = [n for n in map(self.number.get, found) if n is not None]
                    words += known
                    at.append(len(known))
                pairs, tf = np.unique(np.repeat(np.arange(len(at)), at) * max(1, len(self.number)) + np.array(words, dtype="i8"), return_counts=True)
                row, word = np.divmod(pairs, max(1, len(self.number)))
                yield part.column(0).to_numpy(), np.array(length, dtype="i8"), row, word, tf

    def best(self, docs: DataFrame, k: int, digits: int, weight: Callable, scale: np.ndarray | None = None) -> DataFrame:
        """(query, doc_id, score, rank): the ``k`` documents of greatest rounded score of each query, ties to the smaller id.

        ``query`` is a place in ``queries``; a score is the sum of ``weight(word, tf, length)`` over shared words, over the query's
        ``scale``.  A task hands on no more than its ``k`` best of each query.
        """
        n, grain = len(self.queries), 10.0**digits

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
            floor = np.full(n, -np.inf)  # a query's kth score so far
            for ids, length, row, word, tf in self.met(batches):
                w = weight(word, tf, length[row])
                step = max(1, TASK_CELLS // n)
                for start in range(0, len(ids), step):
                    lo, hi = np.searchsorted(row, [start, start + step])
                    each = self.begin[word[lo:hi] + 1] - self.begin[word[lo:hi]]
                    first = np.repeat(self.begin[word[lo:hi]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                    cells = np.repeat(row[lo:hi] - start, each) * n + self.of[first]
                    size = min(step, len(ids) - start) * n
                    sums = np.bincount(cells, np.repeat(w[lo:hi], each), size)
                    some = np.flatnonzero(sums > 0)
                    query = some % n
                    score = np.floor((sums[some] / (1.0 if scale is None else scale[query])) * grain + 0.5) / grain
                    near = score >= floor[query]
                    query, doc, score = query[near], ids[start + some[near] // n], score[near]
                    query, doc, score = (np.concatenate(x) for x in zip(held, (query, doc, score)))
                    order = np.lexsort((doc, -score, query))
                    query, doc, score = query[order], doc[order], score[order]
                    place = np.arange(len(query)) - np.searchsorted(query, query)
                    last = place == k - 1
                    floor[query[last]] = score[last]
                    held = tuple(x[place < k] for x in (query, doc, score))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["query", "doc_id", "score"])

        if not n:
            return docs.sparkSession.createDataFrame([], "query long, doc_id long, score double, rank int")
        found = lowered(docs).mapInArrow(task, "query long, doc_id long, score double")
        return top_per_key(found, ["query"], k, F.desc("score"), F.asc("doc_id"))

    def counts(self, docs: DataFrame) -> tuple[int, int, np.ndarray]:
        """(documents, their words, documents of each word)."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, df = 0, 0, np.zeros(len(self.number), "i8")
            for ids, length, _, word, _ in self.met(batches):
                n, total = n + len(ids), total + int(length.sum())
                df += np.bincount(word, minlength=len(df))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], np.arange(len(df))])), pa.array(np.concatenate([[n, total], df]))], ["word", "n"])

        got = {r["word"]: r["n"] for r in lowered(docs).mapInArrow(task, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
        return got.get(-2, 0), got.get(-1, 0), np.array([got.get(i, 0) for i in range(len(self.number))], dtype=float)

    def named(self, found: DataFrame, *keys: str) -> DataFrame:
        """``found`` with its queries' keys in place of their places."""
        names = found.sparkSession.createDataFrame([(i, *q) for i, q in enumerate(self.queries)], ", ".join(["query long", *(f"{c} long" for c in keys)]))
        return found.join(F.broadcast(names), "query").drop("query")


def lowered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, t: Thresholds = DEFAULTS) -> DataFrame:
    """(query_id, doc_id, score, rank): Okapi BM25.

    ``queries``: query_id, text; ``docs``: doc_id, text.  Queries of a bounded number of words go with every task, where a
    document meets all of them; documents are read twice, for their counts and their scores, and never shuffled.  Beyond
    that bound postings are shuffled.
    """
    words = Words.of_queries(queries, docs, "query_id")
    if words is None:
        return bm25_postings(queries, docs, k, t)
    n, total, df = words.counts(docs)
    idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), total / max(1, n)
    weight = lambda word, tf, length: idf[word] * tf * (t.bm25_k1 + 1) / (tf + t.bm25_k1 * (1 - t.bm25_b + t.bm25_b * length / mean))
    return words.named(words.best(docs, k, 6, weight), "query_id").select("query_id", "doc_id", "score", "rank")


def word_overlap(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, overlap, rank): the greatest shares of a query's words in a document; the same two ways as ``bm25``."""
    own = F.array_distinct(text.words(F.col("text")))
    queries = queries.select("query_id", "text", F.size(own).cast("long").alias("n"))
    words = Words.of_queries(queries, docs, "query_id", "n")
    if words is not None:
        scale = np.array([float(q[1]) for q in words.queries])
        found = words.named(words.best(docs, k, 9, lambda word, tf, length: np.ones(len(word)), scale), "query_id", "n")
        return top_per_key(found.select("query_id", "doc_id", F.col("score").alias("overlap")), ["query_id"], k, F.desc("overlap"), F.asc("doc_id"))
    asked, post = queries.select("query_id", "n", F.explode(own).alias("w")), docs.select("doc_id", F.explode(own).alias("w"))
    shared = asked.join(post, "w").groupBy("query_id", "n", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return top_per_key(shared.select("query_id", "doc_id", F.round(F.col("k") / F.col("n"), 9).alias("overlap")), ["query_id"], k, F.desc("overlap"), F.asc("doc_id"))


def bm25_postings(queries: DataFrame, docs: DataFrame, k: int, t: Thresholds = DEFAULTS) -> DataFrame:
    """``bm25`` over word postings, for any number of queries.

    Only words that occur in a query are posted, so the document side shrinks before it is shuffled.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))
    wanted = terms.select("term").distinct()
    few = wanted.count() <= MOST_TERMS
    split = docs.select("doc_id", text.words(F.col("text")).alias("w"))
    total = split.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avg_len"))
    tokens = split.select("doc_id", F.size("w").cast("double").alias("len"), F.explode("w").alias("term"))
    tf = tokens.join(F.broadcast(wanted) if few else wanted, "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = tf.join(F.broadcast(df) if few else df, "term").crossJoin(F.broadcast(total))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (t.bm25_k1 + 1) / (F.col("tf") + t.bm25_k1 * (1 - t.bm25_b + t.bm25_b * F.col("len") / F.col("avg_len")))
    scored = rows.select("doc_id", "term", part.alias("part")).join(terms, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_per_key(scored, ["query_id"], k, F.desc("score"), F.asc("doc_id"))


def blocks(df: DataFrame, id_col: str, vector_col: str, n_blocks: int, side: str, group_col: str | None = None) -> DataFrame:
    """(block, rows): vectors, with a group, packed into one row a block, in order of their ids; as many partitions as blocks."""
    group = F.col(group_col).cast("long") if group_col else F.lit(0).cast("long")
    row = F.struct(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), group.alias("g"))
    rows = df.where(F.size(vector_col) > 0).select(F.pmod(F.xxhash64(id_col), F.lit(n_blocks)).alias(f"block_{side}"), row.alias("r"))
    return rows.repartition(n_blocks, f"block_{side}").groupBy(f"block_{side}").agg(F.sort_array(F.collect_list("r")).alias(f"rows_{side}"))


#: Queries and points of a block, and of the tile of scores that is looked at together.
QUERY_ROWS, POINT_ROWS = 8_192, 32_768
TILE_QUERIES, TILE_POINTS = 1_024, 2_048


def exact_knn(queries: DataFrame, points: DataFrame, id_col: str, vector_col: str, k: int, metric: str = "cosine", block_rows: int | None = None, group_col: str | None = None, digits: int = 9) -> DataFrame:
    """(query_id, group, id, score, rank): the ``k`` nearest points of every query, itself left out; with ``group_col`` the ``k`` nearest of each group.

    Both sides are packed into blocks of bounded size, and a pair of blocks is a task: matrix products by tiles, of which
    only scores that reach a query's kth so far are looked at.  Blocks meet as they lie, so no pair of them is shuffled.
    ``metric``: cosine (greater is nearer) or l2 (smaller is nearer, returned as negative).  Scores equal when rounded to
    ``digits`` go by the smaller id.  All pairs are scored, so work is the product of both sides.
    """
    n_q, n_p = (max(1, -(-df.count() // rows)) for df, rows in ((queries, block_rows or QUERY_ROWS), (points, block_rows or POINT_ROWS)))
    q, p = blocks(queries, id_col, vector_col, n_q, "q"), blocks(points, id_col, vector_col, n_p, "p", group_col)
    pairs = q.crossJoin(p)  # of blocks: a stated query set against all rows, in blocks of bounded size

    def task(batches):
        for b in batches:
            for i in range(b.num_rows):
                (qi, qv, _), (pi, pv, pg) = (unpack(b.column(b.schema.get_field_index(c))[i]) for c in ("rows_q", "rows_p"))
                if metric == "cosine":
                    qv, pv = unit(qv), unit(pv)
                for g in np.unique(pg):
                    own = np.flatnonzero(pg == g)
                    rows, at, score = nearest(qi, qv, pi[own], pv[own], k, metric, digits)
                    yield pa.RecordBatch.from_arrays([pa.array(qi[rows]), pa.array(np.full(len(rows), g, "i8")), pa.array(pi[own][at]), pa.array(score)], ["query_id", "group", "id", "score"])

    found = pairs.mapInArrow(task, "query_id long, group long, id long, score double")
    return top_per_key(found.withColumn("score", F.round("score", digits)), ["query_id", "group"], k, F.desc("score"), F.asc("id"))


def nearest(qi: np.ndarray, qv: np.ndarray, pi: np.ndarray, pv: np.ndarray, k: int, metric: str, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the point, score): the ``k`` best of each query; equal rounded scores by place, which is by id."""
    grain, slack = 10.0**digits, 10.0**-digits + (1e-6 if metric == "l2" else 1e-12)
    out: list[tuple] = []
    squares = (pv**2).sum(1)
    for begin in range(0, len(qi), TILE_QUERIES):
        q, ids = qv[begin : begin + TILE_QUERIES], qi[begin : begin + TILE_QUERIES]
        own = (q**2).sum(1)
        floor = np.full(len(q), -np.inf)  # a score that k points reach
        held = (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
        for start in range(0, len(pi), TILE_POINTS):
            p = pv[start : start + TILE_POINTS]
            s = q @ p.T
            if metric == "l2":
                s *= 2
                s -= own[:, None]
                s -= squares[None, start : start + TILE_POINTS]  # minus the squared distance
            s[ids[:, None] == pi[None, start : start + TILE_POINTS]] = -np.inf
            if s.shape[1] > k and not start:
                floor = reached(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k], metric, slack)
            rows, at = np.divmod(np.flatnonzero(s >= floor[:, None]), s.shape[1])
            score = s[rows, at]
            fine = np.isfinite(score)
            rows, at, score = rows[fine], at[fine] + start, score[fine]
            if metric == "l2":
                score = -np.sqrt(((q[rows] - pv[at]) ** 2).sum(1))
            rows, at, score = (np.concatenate(x) for x in zip(held, (rows, at, score)))
            order = np.lexsort((at, -np.floor(score * grain + 0.5), rows))
            rows, at, score = rows[order], at[order], score[order]
            first = np.searchsorted(rows, rows)
            kept = np.arange(len(rows)) - first < k
            held = rows[kept], at[kept], score[kept]
            last = np.flatnonzero(np.arange(len(rows)) - first == k - 1)
            kth = -(score[last] ** 2) if metric == "l2" else score[last]
            floor[rows[last]] = reached(kth, metric, slack)
        out.append((held[0] + begin, held[1], held[2]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))


def reached(kth: np.ndarray, metric: str, slack: float) -> np.ndarray:
    """What a score must reach so that rounding may place it with the kth; l2 in negative squares."""
    return kth - slack if metric != "l2" else -((np.sqrt(np.maximum(-kth, 0)) + slack) ** 2) - 1e-9 * np.maximum(1, -kth)


def unpack(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = rows.values
    ids = got.field("id").to_numpy()
    return ids, got.field("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1), got.field("g").to_numpy()


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def anchor_affinity(points: DataFrame, anchors: DataFrame, least: float) -> DataFrame:
    """(id, domain, affinity): the best domain of each vector by cosine with the domains' anchors, null below ``least``.

    ``points``: id, v; ``anchors``: domain, a (a few rows, broadcast).
    """
    scored = points.crossJoin(F.broadcast(anchors)).select("id", "domain", F.round(vector.cosine(F.col("v"), F.col("a")), 9).alias("affinity"))
    best = scored.groupBy("id").agg(F.max(F.struct("affinity", F.col("domain"))).alias("b")).select("id", "b.domain", "b.affinity")
    return best.select("id", F.when(F.col("affinity") >= least, F.col("domain")).alias("domain"), "affinity")


def quota_pool(candidates: DataFrame, quotas: dict[int, int], hint_boost: float = 0.15) -> DataFrame:
    """(entity, id, score, from_hint): the best of each search term by the term's quota, merged by id.

    ``candidates``: entity, term_pos, id, score.  Terms behind the first are hints; ids that
    a hint surfaced gain ``hint_boost``.
    """
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col("term_pos"))
    w = Window.partitionBy("entity", "term_pos").orderBy(F.desc("score"), F.asc("id"))
    kept = candidates.withColumn("r", F.row_number().over(w)).where(F.col("r") <= quota)
    pool = kept.groupBy("entity", "id").agg(F.max("score").alias("best"), F.bool_or(F.col("term_pos") > 0).alias("from_hint"))
    return pool.select("entity", "id", (F.col("best") + F.when(F.col("from_hint"), hint_boost).otherwise(0.0)).alias("score"), "from_hint")


def category_gate(df: DataFrame, category: Column, allowed: list[str]) -> DataFrame:
    """Rows of the allowed categories after normalising; an empty list gates nothing."""
    return df.where(text.category_key(category).isin(allowed)) if allowed else df
