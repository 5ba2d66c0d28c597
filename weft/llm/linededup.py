"""Line de-duplication across documents, with DataFrame functions only.

Text is cut into lines; a line counts by its key (white space stripped at both ends, A-Z
lower-cased) and only if the key is long enough.  A key found in at least ``least_docs``
documents keeps its lines in the largest doc_id that holds it and loses them everywhere
else.

How it runs
1. Every line becomes a narrow row (two 64-bit hashes of the key, doc_id, position),
   written once to the shared folder; the text itself is not shuffled for this.
2. Lines are dealt out by range of their hashes and sorted within each partition by hash,
   document (largest first) and position.  One streaming pass tells a key's first document,
   which keeps its lines, from the later ones: those from the third on lose theirs, those of
   the second do if a third follows.
3. A key with more than ``HOT_LINES`` lines would make one task long.  There are at most as
   many such keys as lines over HOT_LINES; they are found by a count with map-side combining
   and left out of step 2: their largest and smallest documents, and whether a third lies
   between, are grouped maxima, and their lines are judged where they lie.
4. Positions are packed per document into a sparse keep bitmap: 64 positions a word, and
   only words with a dropped line are stored, the others being all ones.

The result of :func:`keep_bitmaps` is one row per document with lines to drop, without
text; documents without a row keep all.  :func:`apply_bitmaps` rebuilds texts from it.

Edge cases: a null or empty text is one empty line, which is never dropped.  A document
may hold a key several times: either all its lines with that key stay or none.  Rows that
repeat a doc_id, with the same text or others, are one document when counted and lose
the same keys.  Rows with a null doc_id are not counted and keep all lines.  Very long
texts are cut whole.  An empty table gives an empty result.  Other columns pass through
unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discarded, joined_by_size, stored

WHITE = " \t\n\x0b\x0c\r"
#: Lines of one key up to which they are sorted together.
HOT_LINES = 4_000
#: Hot keys up to which they are sent to every executor.
BROADCAST_KEYS = 500_000
#: Entries (of 12 bytes, rows counting as two) up to which all bitmaps are sent to every executor; beyond, texts are shuffled to them.
BROADCAST_ENTRIES = 1_000_000
#: A row's identity: its id and its text, so that rows which repeat an id keep their own positions.
ROW = ["doc_id", "version"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def version_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("version")


def key_of(line: Column) -> Column:
    """The line's key.  lower() changes A-Z alone where all characters are ASCII; translate() does elsewhere."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.char_length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def line_keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, doc_id, version, pos) of every line whose key has at least ``least_chars`` code points."""
    lines = docs.where("doc_id is not null").select("doc_id", version_of(docs["text"]), F.posexplode(lines_of(docs["text"])).alias("pos", "line"))
    keys = lines.where(F.char_length("line") >= least_chars).select(*ROW, "pos", key_of(F.col("line")).alias("key"))
    keys = keys.where(F.char_length("key") >= least_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), *ROW, "pos")


def dropped_lines(keys: DataFrame, least_docs: int) -> DataFrame:
    """(doc_id, version, pos) of the lines that go; ``keys`` is a stored table."""
    if least_docs < 2:
        raise ValueError("a line is common from two documents on")
    hot = stored(keys.groupBy("h1", "h2").count().where(F.col("count") > HOT_LINES).select("h1", "h2"), "line-hot")
    by = ["h1", "h2"]
    rest = joined_by_size(keys, hot, by, "left_anti", BROADCAST_KEYS).repartitionByRange(*by)
    order = Window.partitionBy(*by).orderBy(F.desc("doc_id"))
    streamed = rest.sortWithinPartitions(*by, F.desc("doc_id"), "pos").withColumn("place", F.dense_rank().over(order))
    streamed = streamed.withColumn("places", F.max("place").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    gone = streamed.where((F.col("place") > 1) & (F.col("places") >= least_docs)).select(*ROW, "pos")
    if hot.isEmpty():
        return gone
    lines = joined_by_size(keys, hot, by, "inner", BROADCAST_KEYS)
    each = lines.select(*by, "doc_id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
    heads = stored(each.where(F.col("docs") >= least_docs).select(*by, "keeper"), "line-heads")
    return gone.unionByName(joined_by_size(keys, heads, by, "inner", BROADCAST_KEYS).where("doc_id <> keeper").select(*ROW, "pos"))


def bitmaps_of(dropped: DataFrame) -> DataFrame:
    """(doc_id, version, keeps): ``keeps`` lists (word, bits), one entry for each 64 lines with a dropped one; a set bit keeps its line."""
    words = dropped.groupBy(*ROW, F.shiftright("pos", 6).alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos & 63)"))).alias("bits"))
    return words.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keeps"))


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """One row (doc_id, version, keeps) for each document that loses lines; other documents keep all."""
    keys = stored(line_keys(docs, least_chars), "line-keys")
    bitmaps = stored(bitmaps_of(dropped_lines(keys, least_docs)), "line-bitmaps")
    discarded(keys)
    return bitmaps


def kept_lines(text: Column, keeps: Column) -> Column:
    """The lines that stay, as an array.  ``keeps`` is laid out as one word per 64 lines first."""

    def fill(words: Column, entry: Column) -> Column:
        return F.concat(words, F.array_repeat(F.lit(-1).cast("long"), entry["word"] - F.size(words)), F.array(entry["bits"]))

    def kept(words: Column) -> Column:
        bits = lambda i: F.coalesce(F.get(words, F.shiftright(i, 6)), F.lit(-1).cast("long"))
        return F.filter(lines_of(text), lambda line, i: F.getbit(bits(i), i.bitwiseAND(F.lit(63))) == 1)

    words = F.aggregate(keeps, F.array().cast("array<long>"), fill)
    return F.get(F.transform(F.array(words), kept), F.lit(0))  # as the array's one element, so that words are laid out once a text


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the columns ``version`` and ``keeps``; texts move only if the bitmaps are too large to send around."""
    entries = bitmaps.agg(F.sum(F.size("keeps") + 2)).first()[0] or 0
    return docs.withColumn("version", version_of(docs["text"])).join(F.broadcast(bitmaps) if entries <= BROADCAST_ENTRIES else bitmaps, ROW, "left")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the lines named in ``bitmaps`` taken out of ``text``; other columns unchanged.

    Texts without a dropped line are passed on as they are (a null text as an empty one).
    """
    names = docs.columns
    both = with_bitmaps(docs.select("doc_id", "text", *(docs[c].alias(f"other {k}") for k, c in enumerate(names) if c not in ("doc_id", "text"))), bitmaps)
    text = F.when(F.col("keeps").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept_lines(F.col("text"), F.col("keeps")), "\n"))
    return both.withColumn("text", text).select(*(c if c in ("doc_id", "text") else F.col(f"`other {k}`").alias(c) for k, c in enumerate(names)))


def digests(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    docs = docs.select("doc_id", "text")
    both = with_bitmaps(docs, keep_bitmaps(docs, least_chars, least_docs))
    text, keeps = F.coalesce("text", F.lit("")), F.col("keeps")
    kept = F.when(keeps.isNull(), text).otherwise(F.array_join(kept_lines(text, keeps), "\n"))
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_dropped = F.coalesce(F.aggregate(keeps, F.lit(0).cast("long"), lambda n, w: n + F.lit(64) - F.bit_count(w["bits"])), F.lit(0).cast("long"))
    return both.select("doc_id", n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))
