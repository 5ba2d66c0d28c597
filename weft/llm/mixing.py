"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate: its target share of the output divided by its
share of the input.  A document's number of copies is a Poisson draw with that mean,
taken by inverting the distribution function at a uniform number that a seeded hash of
the document's id gives.  So the draw needs no state, repeats exactly on retries and after
lost executors, and hits the target weights in expectation.  Copies are exploded and the
whole output is put in a random order that the hash gives as well: a range partitioning
on the order key and a sort within partitions.

Sources are counted with map-side combining; the table of rates has a row a source and
is broadcast only if it is small.  A hot source needs nothing special: no step gathers a
source's rows.

Edge cases: a null source is a source of its own; sources without a target weight get
``other`` (0: they leave the mix).  Documents with zero copies leave.  A document with a
null id draws from the hash of the empty text.  Rows that repeat an id draw the same
number and keep their own copies.  With no target weights every rate is ``total`` copies
a document.  Columns named like ours are kept under their own names, ours win for
``copy`` and ``order_key``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_enough

#: Sources up to which the rates are sent to every executor; beyond, documents are shuffled to them.
BROADCAST_SOURCES = 20_000
#: Rate up to which a source's distribution function is kept as an array; beyond, each document sums it up around the rate.
ARRAY_RATE = 1_000.0
#: Copies exploded at once.
RUN = 1 << 16


def uniform(key: Column, seed: str) -> Column:
    """In [0, 1): the first 52 bits of the SHA-256 of the seed and the key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit(""))), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, targets: dict[str, float] | DataFrame | None, total: float = 1.0, other: float = 0.0) -> DataFrame:
    """(source, n, rate): mean copies of a document of each source.

    ``targets``: relative weights by source, a dictionary or a table (source, weight).  The output has about ``total`` times as many
    documents as those sources have.  Weights of sources without documents are left out of the sum.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if targets is None or targets == {}:
        return counts.withColumn("rate", F.lit(float(total)))
    if isinstance(targets, DataFrame):
        weights = targets.select(F.col("source").alias("weight source"), "weight")
    else:
        weights = F.broadcast(docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "`weight source` string, weight double"))
    weighed = counts.join(weights, counts["source"].eqNullSafe(F.col("weight source")), "left").select("source", "n", F.coalesce("weight", F.lit(float(other))).alias("weight"))
    sums = weighed.agg(F.sum("weight").alias("w"), F.sum(F.when(F.col("weight") > 0, F.col("n"))).alias("rows"))  # one row
    return weighed.crossJoin(F.broadcast(sums)).select("source", "n", F.when(F.col("w") > 0, F.col("weight") / F.col("w") * F.col("rows") * F.lit(float(total)) / F.col("n")).otherwise(0.0).alias("rate"))


def distribution(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable up to where the tail is below 2**-52."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")

    def step(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.when(k > 0, F.log(rate / k)).otherwise(F.lit(0.0))
        below = state["below"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), below.alias("below"), F.concat(state["all"], F.array(below)).alias("all"))

    start = F.struct((-rate).alias("log_p"), F.lit(0.0).alias("below"), F.array().cast("array<double>").alias("all"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), last), start, step, lambda s: s["all"])).otherwise(F.array(F.lit(1.0)))


def copies(u: Column, below: Column) -> Column:
    """The least k with u < P(X <= k)."""
    return F.size(F.filter(below, lambda p: p <= u))


def inverted(u: Column, rate: Column) -> Column:
    """As ``copies`` for a rate above ARRAY_RATE: sums P(X = k) from 12 standard deviations below the rate, without an array of sums.

    A document's work grows with the square root of its rate, its copies with the rate itself.
    """
    wide = F.ceil(12 * F.sqrt(rate) + 20)
    first, last = F.floor(rate - wide), F.ceil(rate + wide)
    # ln P(X = first) by Stirling's series, whose error is below 1e-15 here
    log_p = first * F.log1p((rate - first) / first) - (rate - first) - 0.5 * F.log(2 * math.pi * first) - 1 / (12 * first) + 1 / (360 * first * first * first.cast("double"))

    def step(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.when(k > first, F.log(rate / k)).otherwise(F.lit(0.0))
        below = state["below"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), below.alias("below"), (state["n"] + (below <= u).cast("long")).alias("n"))

    start = F.struct(log_p.alias("log_p"), F.lit(0.0).alias("below"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.sequence(first, last), start, step, lambda s: first + s["n"])


def replicated(docs: DataFrame, targets: dict[str, float] | DataFrame | None, total: float = 1.0, other: float = 0.0, seed: str = "mix") -> DataFrame:
    """Each document as often as it is drawn, with ``copy`` (from 0) and ``order_key``; rows in no order yet."""
    mean = rates(docs, targets, total, other)
    mean = mean.select(F.col("source").alias("rate source"), F.col("rate").alias("source rate"), F.when(F.col("rate") <= ARRAY_RATE, distribution(F.col("rate"))).alias("rate below"))
    kept = docs.drop("copy", "order_key")
    side = F.broadcast(mean) if small_enough(docs.select("source").distinct(), BROADCAST_SOURCES) else mean
    drawn = kept.join(side, kept["source"].eqNullSafe(side["rate source"]), "left")
    u = uniform(F.col("doc_id").cast("string"), seed)
    n = F.when(F.col("source rate") <= ARRAY_RATE, copies(u, F.col("rate below")).cast("long")).otherwise(inverted(u, F.col("source rate")))
    drawn = drawn.withColumn("n copies", n).where("`n copies` > 0")
    runs = drawn.withColumn("first copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n copies") - 1, F.lit(RUN).cast("long"))))
    last = F.least(F.col("first copy") + RUN, F.col("n copies")) - 1
    rows = runs.withColumn("copy", F.explode(F.sequence(F.col("first copy").cast("int"), last.cast("int"))))
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))
    key = F.conv(F.substring(F.sha2(name, 256), 1, 15), 16, 10).cast("long")
    return rows.withColumn("order_key", key).drop("rate source", "source rate", "rate below", "n copies", "first copy")


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` in the random order of ``order_key`` over all partitions.

    The key is uniform on [0, 2**60), so a row's range is plain arithmetic and the rows need
    not be sampled for it; their number is the session's number of shuffle partitions.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.shiftright(F.shiftright("order_key", 28) * F.lit(n).cast("long"), 32)
    return rows.repartitionById(n, place.cast("int")).sortWithinPartitions("order_key")


def mixed(docs: DataFrame, targets: dict[str, float] | DataFrame | None, total: float = 1.0, other: float = 0.0, seed: str = "mix") -> DataFrame:
    return shuffled(replicated(docs, targets, total, other, seed))


def tempered(docs: DataFrame, power: float = 0.5) -> DataFrame:
    """Target weights (source, weight) that flatten the mix: each source by its count to ``power``."""
    return docs.groupBy("source").agg(F.pow(F.count(F.lit(1)), F.lit(power)).alias("weight"))
