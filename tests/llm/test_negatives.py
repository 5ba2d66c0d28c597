"""Hard negatives against all pairs in Python's whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import negatives


def plain(rows, anchors, n_positives=5, n_negatives=10, low=30, high=90):
    """``rows`` maps an id to (label, vector)."""
    out = []
    whole = {i: (label, [math.floor(256.0 * x) for x in v]) for i, (label, v) in rows.items()}
    for a in sorted(whole):
        if a % anchors:
            continue
        scores = [(-sum(x * y for x, y in zip(whole[a][1], v)), i, label) for i, (label, v) in whole.items() if i != a and len(v) == len(whole[a][1])]
        for p, positive, _ in sorted(s for s in scores if s[2] == whole[a][0])[:n_positives]:
            fits = sorted(s for s in scores if s[2] != whole[a][0] and low * -p <= 100 * -s[0] <= high * -p)[:n_negatives]
            out += [(a, positive, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(fits)]
    return sorted(out)


def got(df, anchors, **kw):
    mined = negatives.mined(negatives.usable(df, "vec_id", F.col("label"), "embedding"), lambda i: i % anchors == 0, **kw)
    return sorted(tuple(r) for r in mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("n", "dim", "shard_rows"), [(900, 8, 8192), (700, 3, 150)])
def test_mining_equals_all_pairs(spark, n, dim, shard_rows):
    rng = np.random.default_rng(n)
    label = rng.integers(0, 4, n)
    x = rng.normal(size=(n, dim)) * 0.2 + np.eye(4, dim)[label] * 0.6
    x[100:160] = x[100]  # copies, with several labels, tie
    x[200:230] = 0.0
    rows = {i: (int(label[i]), x[i].astype(np.float32).astype(float).tolist()) for i in range(n)}
    given = [(i, label, v, "clash") for i, (label, v) in rows.items()] + [(0, *rows[0], "again"), (None, 1, rows[1][1], ""), (5000, None, rows[1][1], ""), (5010, 1, None, ""), (5020, 1, [None] * dim, ""), (5030, 1, [float("nan")] * dim, ""), (5040, 2, [float("inf")] * dim, "")]
    df = spark.createDataFrame(given, "vec_id long, label int, embedding array<float>, rank string")
    assert got(df, 10, shard_rows=shard_rows) == plain(rows, 10)


def test_other_lengths_few_rows_and_huge_components(spark):
    rows = {0: (1, [3e9, -1.5]), 1: (1, [3e9, 1.0]), 2: (2, [1.5e9, 0.25]), 3: (2, [1.4e9, 9.0]), 4: (1, [1.0]), 5: (2, [1.0]), 10: (1, [2.0]), 20: (3, []), 21: (3, []), 22: (4, [])}
    df = spark.createDataFrame([(i, *r) for i, r in rows.items()], "vec_id long, label int, embedding array<double>")
    expected = [(*r[:4], min(r[4], 2**63 - 1), min(r[5], 2**63 - 1)) for r in plain(rows, 10)]
    assert len(expected) == 3 and expected[0][4] == 2**63 - 1 and got(df, 10) == expected
    assert got(df.limit(0), 10) == []


def test_boxes_bound_scores_and_nodes_are_dropped():
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(size=(4000, 4)) * 0.05 + np.repeat(np.eye(4), 1000, 0)))
    labels, ids = np.repeat(np.arange(4), 1000), np.arange(4000)
    order = negatives.tiled(x, labels, ids)
    assert sorted(order.tolist()) == ids.tolist()
    tree = negatives.Tree(ids[order], labels[order], x[order])
    opened = []
    scores = tree.scores
    tree.scores = lambda leaf, q: opened.append(leaf) or scores(leaf, q)
    q = x[:1]
    (_, _, _, pairs), = negatives.searched(tree, q, [0], [0], [None], 5, (30, 90))
    product = (x @ q[0]).astype(int)
    assert pairs == sorted((-int(product[i]), int(i)) for i in range(1, 1000))[:5]
    assert len(opened) < tree.starts[1] / 4  # of 63 leaves
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    upper = (up @ tree.hi.T + down @ tree.lo.T)[0]
    assert all(scores(leaf, q[0]).max() <= upper[leaf] for leaf in range(tree.starts[1]))
