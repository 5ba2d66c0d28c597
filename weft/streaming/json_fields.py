"""Strings and objects out of JSON that arrives in pieces.

A piece may end anywhere: inside a name, an escape, the digits of a ``\\u`` sequence, between
two halves of a surrogate pair or, for binary pieces, inside a character.  All that a
tokenizer must remember lies in Spark's keyed state: the nesting, the name being read, the
open escape.  Every character is looked at once.  The text of an open value is appended to a list
state piece by piece, so it is neither rescanned nor rewritten as it grows.

Pieces are numbered from 0 in each session.  A piece that comes before its turn waits in a map
state; one that was taken before is passed over, so a replayed or repeated piece changes nothing.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Numbers of pieces that wait in one entry of the state: it is read and written once a batch, not once a piece.
WAITING_PIECES = 64
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PLAIN = re.compile(r'[^"\\]*')
MARK = re.compile(r'["{}\[\]:,]')
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def keyed_state(spark: SparkSession) -> None:
    """Streams with several state variables a key need the RocksDB store."""
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FieldTokenizer:
    """Reads JSON a piece at a time; ``feed`` gives ("text", part) for parts of wanted strings and ("end", name, depth) where one closes.

    ``nesting`` has a letter a container: a in an array; in an object n where a name may come,
    c before the colon, v where a value may come.  ``names`` has the last name of each object.
    """

    FIELDS = ("nesting", "names", "quoted", "name", "escape", "high")

    def __init__(self, wanted: set[str]):
        self.wanted = wanted
        self.nesting, self.names = "", []
        self.quoted = ""  # "" outside of strings; n in a name, w in a wanted string, o in another
        self.name, self.escape, self.high = "", "", 0

    def dump(self) -> str:
        return json.dumps([getattr(self, f) for f in self.FIELDS])

    def load(self, state: str) -> None:
        for f, v in zip(self.FIELDS, json.loads(state)):
            setattr(self, f, v)

    def put(self, text: str) -> Iterator[tuple]:
        if self.high:  # a first half without its second one
            text, self.high = "�" + text, 0
        if text and self.quoted == "n":
            self.name += text
        elif text and self.quoted == "w":
            yield ("text", text)

    def escaped(self, c: str) -> Iterator[tuple]:
        self.escape += c
        if self.escape == "\\u" or self.escape[1] == "u" and len(self.escape) < 6:
            return
        if self.escape[1] != "u":
            yield from self.put(ESCAPES.get(c, c))
        else:
            try:
                unit = int(self.escape[2:], 16)
            except ValueError:
                unit = 0xFFFD
            if self.high and 0xDC00 <= unit < 0xE000:
                whole, self.high = 0x10000 + ((self.high - 0xD800) << 10) + unit - 0xDC00, 0
                yield from self.put(chr(whole))
            elif 0xD800 <= unit < 0xDC00:
                yield from self.put("")
                self.high = unit
            else:
                yield from self.put(chr(unit) if not 0xDC00 <= unit < 0xE000 else "�")
        self.escape = ""

    def closed(self) -> Iterator[tuple]:
        yield from self.put("")
        if self.quoted == "n":
            self.names[-1], self.name = self.name, ""
            self.nesting = self.nesting[:-1] + "c"
        elif self.quoted == "w":
            yield ("end", self.names[-1], len(self.nesting))
        self.quoted = ""

    def feed(self, piece: str) -> Iterator[tuple]:
        i, n = 0, len(piece)
        while i < n:
            if self.escape:
                yield from self.escaped(piece[i])
                i += 1
            elif self.quoted:
                end = PLAIN.match(piece, i).end()
                if end > i:
                    yield from self.put(piece[i:end])
                if end < n:
                    if piece[end] == "\\":
                        self.escape = "\\"
                    else:
                        yield from self.closed()
                i = end + 1
            else:
                mark = MARK.search(piece, i)
                if not mark:
                    return
                i = mark.end()
                self.structure(mark.group())

    def structure(self, c: str) -> None:
        inside = self.nesting[-1:]
        if c == '"':
            self.quoted = "n" if inside == "n" else "w" if inside == "v" and self.names[-1] in self.wanted else "o"
        elif c in "{[":
            self.nesting += "n" if c == "{" else "a"
            if c == "{":
                self.names.append("")
        elif c in "}]":
            if inside and inside != "a":
                self.names.pop()
            self.nesting = self.nesting[:-1]
        elif c == ":" and inside == "c":
            self.nesting = self.nesting[:-1] + "v"
        elif c == "," and inside == "v":
            self.nesting = self.nesting[:-1] + "n"


class ObjectTokenizer:
    """Cuts objects out of a JSON array, or out of any text around them; ``feed`` gives ("text", part) inside of one and ("end", "", 1) where it closes."""

    STOP = re.compile(r'["{}]')

    def __init__(self):
        self.depth, self.quoted, self.escaped = 0, False, False

    def dump(self) -> str:
        return json.dumps([self.depth, self.quoted, self.escaped])

    def load(self, state: str) -> None:
        self.depth, self.quoted, self.escaped = json.loads(state)

    def feed(self, piece: str) -> Iterator[tuple]:
        i, begin, n = 0, 0 if self.depth else -1, len(piece)
        while i < n:
            if self.escaped:
                self.escaped = False
                i += 1
                continue
            if self.quoted:
                i = PLAIN.match(piece, i).end()
                if i < n:
                    self.escaped, self.quoted = piece[i] == "\\", piece[i] == "\\"
                i += 1
                continue
            mark = self.STOP.search(piece, i)
            if not mark:
                break
            i, c = mark.end(), mark.group()
            if c == '"':
                self.quoted = True
            elif c == "{":
                begin = mark.start() if not self.depth else begin
                self.depth += 1
            elif self.depth:
                self.depth -= 1
                if not self.depth:
                    yield ("text", piece[begin:i])
                    yield ("end", "", 1)
                    begin = -1
        if begin >= 0:
            yield ("text", piece[begin:])


class PieceProcessor(StatefulProcessor):
    """Feeds the pieces of a session, in their order, to a tokenizer whose state is Spark's."""

    def __init__(self, make):
        self.make = make

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next long, found long, tokens string, bytes binary")
        self.waiting = handle.getMapState("waiting", "block long", "pieces array<struct<seq:bigint,piece:binary>>")
        self.open = handle.getListState("open", "part string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tokens, decoder = self.make(), codecs.getincrementaldecoder("utf-8")("replace")
        following, found, new = 0, 0, True
        if self.place.exists():
            following, found, saved, bytes_left = self.place.get()
            tokens.load(saved)
            decoder.setstate((bytes(bytes_left), 0))
            new = False
        held: dict[int, dict[int, bytes]] = {}  # block -> pieces, of this batch or taken out of the state

        def fetched(block: int) -> dict[int, bytes]:
            """The block with what waits of it in the state; pieces that came later stand."""
            if block not in seen:
                seen.add(block)
                if self.waiting.containsKey((block,)):
                    (listed,) = self.waiting.getValue((block,))
                    stored.add(block)
                    held[block] = {int(p[0]): bytes(p[1]) for p in listed} | held.get(block, {})
            return held.setdefault(block, {})

        seen: set[int] = set()
        stored: set[int] = set()
        for frame in rows:
            for seq, piece in zip(frame["seq"].tolist(), frame["piece"].tolist()):
                if seq >= following and piece is not None:
                    held.setdefault(seq // WAITING_PIECES, {})[seq] = piece.encode() if isinstance(piece, str) else bytes(piece)
        out, parts = [], []
        fresh = {block: set(pieces) for block, pieces in held.items()}
        while (piece := fetched(following // WAITING_PIECES).pop(following, None)) is not None:
            following += 1
            for event in tokens.feed(decoder.decode(bytes(piece))):
                if event[0] == "text":
                    parts.append(event[1])
                    continue
                before = [] if new or not self.open.exists() else [p for (p,) in self.open.get()]
                self.open.clear()
                out.append((key[0], found, event[1], event[2], "".join(before + parts)))
                found, parts, new = found + 1, [], True
        for block, pieces in held.items():
            left = fetched(block) if fresh.get(block) else pieces
            if left and (fresh.get(block) or block in stored):
                self.waiting.updateValue((block,), (sorted(left.items()),))
            elif not left and block in stored:
                self.waiting.removeKey((block,))
        if parts:
            self.open.appendValue(("".join(parts),))
        self.place.update((following, found, tokens.dump(), decoder.getstate()[0]))
        yield pd.DataFrame(out, columns=["session", "ordinal", "name", "depth", "value"])

    def close(self) -> None:
        pass


FOUND = "session long, ordinal long, name string, depth int, value string"


def json_strings_stream(pieces: DataFrame, names: list[str]) -> DataFrame:
    """(session, ordinal, name, depth, value): every string under one of ``names``, at any depth, as soon as its quote closes.

    ``pieces``: session, seq, piece (text or bytes).  Ordinal 0 is the first one of a session.
    Halves of surrogate pairs that stand alone, and bytes that are no UTF-8, read as U+FFFD.
    """
    keyed_state(pieces.sparkSession)
    wanted = set(names)
    return pieces.select("session", "seq", "piece").groupBy("session").transformWithStateInPandas(PieceProcessor(lambda: FieldTokenizer(wanted)), FOUND, "append", "none")


def json_objects_stream(pieces: DataFrame) -> DataFrame:
    """(session, ordinal, object): each object of a streamed JSON array as soon as it closes; ``pieces`` as above."""
    keyed_state(pieces.sparkSession)
    found = pieces.select("session", "seq", "piece").groupBy("session").transformWithStateInPandas(PieceProcessor(ObjectTokenizer), FOUND, "append", "none")
    return found.selectExpr("session", "ordinal", "value AS object")
