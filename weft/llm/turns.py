"""Repair of the structure of conversations by cheapest edits, ties going to the ASCII-least.

The roles of a repaired conversation read ``(s?(ua)+)?``: perhaps a system row, then user and
assistant in turn.  Edits walk over the rows in order: Keep (0), Rerole to user or assistant
(2), Delete (3, the only way for blank rows and duplicates) and Insert an empty user or
assistant row (2); a truncated row that stays adds 1.  Of the cheapest sequences the one whose
initials are least in ASCII is taken.

The dynamic program keeps square-root checkpoints.  Rows are placed in order by one range
partitioning and cut into blocks of about the square root of the longest conversation.  A block
turns the costs at its end into the costs at its start (a small min-plus matrix); a chain over the
blocks of a conversation, from the last, gives the cost vector at every block's end, the
checkpoint.  Blocks then recompute their vectors from it and walk forward, once for each state
they might be entered in; a second chain, from the first block, picks the walks.  So one
conversation may hold a third of all rows: its blocks are spread over the tasks, and only
chains of one small row a block lie in one place.  Equal rows are counted before they are
placed, and the first of equal texts is found by an aggregate, so a text that repeats without
end is no hot key either.

Defined cases: a null role or text reads as one space, a null turn comes first and counts for
no gap, a null conv_id is a conversation of its own.  Rows of one turn go by role, then by the
SHA-256 of their text.  Repeated rows are duplicates.  A conversation without rows has cost 0,
no edits and no gaps.  An empty table gives none.  Gaps beyond the range of a long are null.
Texts travel once and are never compared whole; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import stored

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = STATES = range(4)
#: State -> the state after an inserted or re-roled row; its role is the only one that the state allows besides system.
FORCED = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
FORCED_ROLE = ("user", "user", "assistant", "user")
FINAL = (START, AFTER_ASSISTANT)
INSERT, REROLE, DELETE = 2, 2, 3
NEVER = 1 << 60
#: Symbols of a row: the initial's place in INITIALS, plus CUT if truncated; GONE if it must be deleted.
INITIALS, CUT, GONE = "sua?", 4, 8
#: A block has at least so many rows; beyond, the square root of the longest conversation.
LEAST_BLOCK = 1024
ROW_KEY = ("conv", "timed", "turn", "role", "sha")
SPACE = " \t\n\x0b\x0c\r"


def kept_state(symbol: int, state: int) -> int | None:
    """The state after a row that stays as it is, or None where its role doesn't fit."""
    initial = INITIALS[symbol % CUT]
    if initial == "s":
        return AFTER_SYSTEM if state == START else None
    if initial == "u":
        return AFTER_USER if state != AFTER_USER else None
    return AFTER_ASSISTANT if initial == "a" and state == AFTER_USER else None


KEPT = [[kept_state(symbol, state) for state in STATES] for symbol in range(GONE)]


def with_inserts(v: list[int]) -> list[int]:
    """Costs where rows may be inserted before going on; two at most can pay."""
    once = [min(v[q], INSERT + v[FORCED[q]]) for q in STATES]
    return [min(v[q], INSERT + once[FORCED[q]]) for q in STATES]


END = with_inserts([0 if q in FINAL else NEVER for q in STATES])


def before(symbol: int, copies: int, v: list[int]) -> list[int]:
    """The cost vector before ``copies`` equal rows, from the one after them; all copies but the first are duplicates."""
    if symbol == GONE:
        return [min(x + DELETE * copies, NEVER) for x in v]
    if copies > 1:
        v = [min(x + DELETE * (copies - 1), NEVER) for x in v]
    cut = 1 if symbol >= CUT else 0
    out = []
    for q, kept in enumerate(KEPT[symbol]):
        least = min(DELETE + v[q], REROLE + cut + v[FORCED[q]])
        out.append(min(least, NEVER) if kept is None else min(least, cut + v[kept], NEVER))
    return with_inserts(out)


def matrix(symbols: list[int], copies: list[int]) -> list[int]:
    """Cost from each state at a block's start to each at its end, row by row."""
    columns = []
    for to in STATES:
        v = with_inserts([0 if q == to else NEVER for q in STATES])
        for s, n in zip(reversed(symbols), reversed(copies)):
            v = before(s, n, v)
        columns.append(v)
    return [columns[to][q] for q in STATES for to in STATES]


def walk(symbols: list[int], copies: list[int], end: list[int], last: bool) -> tuple[list[str], list[int]]:
    """(edits, state at the end) of a block for each state it may be entered in: the block's vectors are recomputed from ``end``."""
    vectors = [end]
    for s, n in zip(reversed(symbols), reversed(copies)):
        vectors.append(before(s, n, vectors[-1]))
    vectors.reverse()
    audits, exits = [], []
    for q in STATES:
        out: list[str] = []
        for i, (s, n) in enumerate(zip(symbols, copies)):
            here, after = vectors[i], vectors[i + 1]
            if s == GONE:
                out.append("D" * n)
                continue
            rest, cut = DELETE * (n - 1), 1 if s >= CUT else 0
            while True:
                if DELETE + rest + after[q] == here[q]:
                    out.append("D")
                elif INSERT + here[FORCED[q]] == here[q]:
                    out.append("I")
                    q = FORCED[q]
                    continue
                elif KEPT[s][q] is not None and cut + rest + after[KEPT[s][q]] == here[q]:
                    out.append("K")
                    q = KEPT[s][q]
                else:
                    out.append("R")
                    q = FORCED[q]
                break
            out.append("D" * (n - 1))
        while last and q not in FINAL:
            out.append("I")
            q = FORCED[q]
        audits.append("".join(out))
        exits.append(q)
    return audits, exits


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32 of ``conv_id:turn`` modulo 20; nulls read as one space."""
    blank = F.lit(" ")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("harm", F.crc32(key) % 20).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("harm") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("again")).drop("again")


def named(conv_id: str) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the key that orders them: conversation, timed or not, turn, role, SHA-256 of the text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(named("conv_id").alias("conv"), F.col("turn").isNotNull().alias("timed"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))


def counted(rows: DataFrame) -> DataFrame:
    """Distinct rows of ``keyed`` with their number, without texts: blank, cut (last character no end of a sentence) and whether the role and text are seen here first."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    marked = rows.select(*ROW_KEY, (F.length(bare) == 0).alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    distinct = marked.groupBy(*ROW_KEY).agg(F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    distinct = stored(distinct, "turn-rows")
    first = distinct.groupBy("conv", "role", "sha").agg(F.min(F.struct("timed", "turn")).alias("at")).select("conv", "at.timed", "at.turn", "role", "sha", F.lit(True).alias("is_first"))
    return distinct.join(first, list(ROW_KEY), "left").withColumn("is_first", F.coalesce("is_first", F.lit(False)))


def symbol() -> Column:
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.when(F.col("blank") | ~F.col("is_first"), GONE).otherwise(place + F.when(F.col("cut"), CUT).otherwise(0)).cast("int")


def blocks_of(rows: DataFrame, least_block: int = LEAST_BLOCK) -> DataFrame:
    """One row a block of a conversation: (conv, part, block), its symbols, numbers of copies and initials in order, and the key of its first row."""
    longest = rows.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    size = max(least_block, int(longest**0.5) + 1)
    spark = rows.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select(*ROW_KEY, "copies", symbol().alias("symbol"), F.substring("role", 1, 1).alias("initial"))
    placed = placed.repartitionByRange(wide, *ROW_KEY).sortWithinPartitions(*ROW_KEY)
    placed = placed.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    grouped = placed.groupBy("conv", "part", F.floor(F.col("seq") / size).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "symbol", "copies", "initial"))).alias("rows"), F.min(F.struct("seq", *ROW_KEY[1:])).alias("head")
    )
    return grouped.select("conv", "part", "block", "rows.symbol", "rows.copies", "rows.initial", *(f"head.{c}" for c in ROW_KEY[1:]))


LEGAL = {"su", "ua", "au"}


def illegal_pairs(initials: Iterable[str]) -> int:
    seen = list(initials)
    return sum(a + b not in LEGAL for a, b in zip(seen, seen[1:]))


def by_rows(task, df: DataFrame, schema: str) -> DataFrame:
    """``task`` turns each row (a dict) into an output row (a dict), in Arrow batches."""

    def batches(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            if b.num_rows:
                yield pa.RecordBatch.from_pylist([task(r) for r in b.to_pylist()], shape)

    shape = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(batches, schema)


BLOCK = ("conv", "part", "block")


def chained(blocks: DataFrame) -> DataFrame:
    """One row a conversation: its cost, its illegal pairs, and the checkpoint at the end of each of its blocks."""

    def sums(r: dict) -> dict:
        inner = illegal_pairs(r["initial"]) + sum(r["copies"]) - len(r["copies"])
        return {c: r[c] for c in BLOCK} | {"costs": matrix(r["symbol"], r["copies"]), "illegal": inner, "first": r["initial"][0], "last": r["initial"][-1]}

    def back(r: dict) -> dict:
        v, ends, chain = END, [], r["chain"]
        for k, b in enumerate(reversed(chain)):
            ends.append({"part": b["part"], "block": b["block"], "end": v, "is_last": k == 0})
            m = b["costs"]
            v = [min(min(m[4 * q + to] + v[to] for to in STATES), NEVER) for q in STATES]
        between = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(chain, chain[1:]))
        return {"conv": r["conv"], "cost": v[START], "illegal": sum(b["illegal"] for b in chain) + between, "ends": ends}

    each = by_rows(sums, blocks.select(*BLOCK, "symbol", "copies", "initial"), "conv string, part int, block long, costs array<long>, illegal long, first string, last string")
    chains = each.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "block", "costs", "illegal", "first", "last"))).alias("chain"))
    return by_rows(back, chains, "conv string, cost long, illegal long, ends array<struct<part:int,block:long,end:array<long>,is_last:boolean>>")


def edits(blocks: DataFrame, chains: DataFrame) -> DataFrame:
    """One row a block: the state it is entered in, its edits' initials, and the key of its first row."""

    def both_ways(r: dict) -> dict:
        audits, exits = walk(r["symbol"], r["copies"], r["end"], r["is_last"])
        return {c: r[c] for c in (*BLOCK, *ROW_KEY[1:])} | {"audits": audits, "exits": exits}

    def forward(r: dict) -> dict:
        q, out = START, []
        for b in r["chain"]:
            out.append({"part": b["part"], "block": b["block"], "entry": q})
            q = b["exits"][q]
        return {"conv": r["conv"], "entries": out}

    ends = chains.select("conv", F.inline("ends"))
    head = "timed boolean, turn long, role string, sha binary"
    walks = stored(by_rows(both_ways, blocks.join(ends, list(BLOCK)), f"conv string, part int, block long, {head}, audits array<string>, exits array<int>"), "turn-walks")
    chain = walks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "block", "exits"))).alias("chain"))
    entries = by_rows(forward, chain, "conv string, entries array<struct<part:int,block:long,entry:int>>").select("conv", F.inline("entries"))
    return walks.join(entries, list(BLOCK)).select(*BLOCK, *ROW_KEY[1:], "entry", F.get("audits", F.col("entry")).alias("audit"))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the digest of each conversation's repaired rows.

    A digest takes its bytes one after the other, so the rows of a conversation pass
    through one task, in order and one batch at a time; nothing of them is kept.
    """
    none = F.lit(None)
    marks = edits.select(*ROW_KEY, F.lit(False).alias("is_row"), none.cast("string").alias("text"), "entry", "audit")
    texts = rows.select(*ROW_KEY, F.lit(True).alias("is_row"), "text", none.cast("int").alias("entry"), none.cast("string").alias("audit"))
    order = (*ROW_KEY, "is_row")
    ordered = marks.unionByName(texts).repartition("conv").sortWithinPartitions(*order).select("conv", "is_row", "role", "text", "entry", "audit")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, audit, at, sha, some = None, START, "", 0, hashlib.sha256(), False

        def put(role: str, text: str) -> None:
            nonlocal some
            sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
            some = True

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                put(FORCED_ROLE[state], "")
                state, at = FORCED[state], at + 1

        for b in batches:
            done: list[tuple[str, str]] = []
            for c, is_row, role, text, entry, edits in zip(*(b.column(k).to_pylist() for k in range(6))):
                if not is_row:
                    inserts()
                    if c != conv:
                        if conv is not None:
                            done.append((conv, sha.hexdigest()))
                        conv, sha, some = c, hashlib.sha256(), False
                    state, audit, at = entry, edits, 0
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    put(role, text)
                    state = KEPT[INITIALS.index(role[0])][state]
                elif edit == "R":
                    put(FORCED_ROLE[state], text)
                    state = FORCED[state]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.string()), pa.array([h for _, h in done], pa.string())], ["conv", "repaired_sha256"])
        if conv is not None:
            inserts()
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([sha.hexdigest()])], ["conv", "repaired_sha256"])

    return ordered.mapInArrow(task, "conv string, repaired_sha256 string")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated) of counted rows; a row counts for its first fault."""
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sound = ~F.col("blank")
    by_turn = rows.groupBy("conv", "timed", "turn").agg(
        count(F.when(F.col("blank"), F.col("copies"))).alias("blank"),
        count(F.when(sound, F.col("copies") - F.col("is_first").cast("long"))).alias("duplicate"),
        count(F.when(sound & F.col("is_first") & F.col("cut"), 1)).alias("truncated"),
    )
    at = F.when(F.col("timed"), F.col("turn"))
    span = F.try_subtract(F.try_add(F.try_subtract(F.max(at), F.min(at)), F.lit(1)), F.count(at))
    return by_turn.groupBy("conv").agg(F.when(F.count(at) == 0, F.lit(0)).otherwise(span).cast("long").alias("gaps"), *(count(c).alias(c) for c in ("blank", "duplicate", "truncated")))


def audited(conversations: DataFrame, rows: DataFrame, least_block: int = LEAST_BLOCK) -> DataFrame:
    """One row a conv_id of ``conversations``: faults of ``rows`` (those to repair), cost, edits and the digest of the repaired rows."""
    texts = keyed(rows)
    known = stored(counted(texts), "turn-known")
    blocks = stored(blocks_of(known, least_block), "turn-blocks")
    chains = stored(chained(blocks), "turn-chains")
    made = stored(edits(blocks, chains), "turn-edits")
    audit = made.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "block", "audit"))), lambda b: b["audit"]), "").alias("audit"))
    ids = conversations.select("conv_id").distinct().withColumn("conv", named("conv_id"))
    found = ids.join(faults(known), "conv", "left").join(chains.drop("ends"), "conv", "left").join(audit, "conv", "left").join(repaired(texts, made), "conv", "left")
    zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    has_rows = F.col("cost").isNotNull()
    return found.select(
        "conv_id",
        *(F.when(has_rows, F.col(c)).otherwise(F.lit(n)).cast("long").alias(c) for c, n in zeros.items()),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def repair_damaged(conversations: DataFrame, least_block: int = LEAST_BLOCK) -> DataFrame:
    """``audited`` of the rows as ``damaged`` leaves them."""
    return audited(conversations, damaged(conversations), least_block)
