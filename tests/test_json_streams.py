"""JSON that arrives in pieces: every cut of a text, out of order and repeated pieces, bytes."""

import json
import random

import pytest

from weft.streaming import json_fields as jf

TEXTS = [
    {"cleaned": 'He said "hi"\n\\ \t é 漢 😀 😀', "other": {"cleaned": "inner", "n": 1}, "list": ["cleaned", {"cleaned": ""}], "key:": 'cleaned":"no'},
    {"a": [1, 2.5, None, True, {"cleaned": 'q"}]{['}], "cleaned": ["cleaned"], "z": {"cleaned": 5}},
    [{"cleaned": "one"}, {"x": "cleaned", "cleaned": "two"}],
]


def strings(value, name, depth=0):
    """Strings under ``name`` in the order of the text."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k == name and isinstance(v, str):
                yield depth + 1, v
            else:
                yield from strings(v, name, depth + 1)
    elif isinstance(value, list):
        for v in value:
            yield from strings(v, name, depth + 1)


def fed(tokens, make, pieces):
    out, parts = [], []
    for piece in pieces:
        fresh = make()
        fresh.load(tokens.dump())  # the whole state goes through its saved form at each cut
        tokens = fresh
        for event in tokens.feed(piece):
            if event[0] == "text":
                parts.append(event[1])
            else:
                out.append((event[2], "".join(parts)))
                parts = []
    return out


@pytest.mark.parametrize("ascii_only", [True, False])
def test_every_cut_gives_the_same_strings(ascii_only):
    make = lambda: jf.FieldTokenizer({"cleaned"})
    for value in TEXTS:
        text = json.dumps(value, ensure_ascii=ascii_only) if ascii_only else json.dumps(json.loads(json.dumps(value)), ensure_ascii=False)
        expected = [(d, v) for d, v in strings(json.loads(text), "cleaned")]
        for cut in range(len(text) + 1):
            assert fed(make(), make, [text[:cut], text[cut:]]) == expected
        assert fed(make(), make, list(text)) == expected


def test_odd_escapes():
    make = lambda: jf.FieldTokenizer({"k"})
    assert fed(make(), make, list(r'{"k":"\ud83dx\ude00é\/\uZZZZ","k":"named"}')) == [(1, "�x�é/�"), (1, "named")]
    assert fed(make(), make, ['{"k":"never closed']) == []


def test_every_cut_gives_the_same_objects():
    text = 'noise [ {"a": "}{\\"", "b": {"c": [1, {}]}}, {}, {"d": "\\\\"} ] {"open": '
    expected = [(1, '{"a": "}{\\"", "b": {"c": [1, {}]}}'), (1, "{}"), (1, '{"d": "\\\\"}')]
    for cut in range(len(text) + 1):
        assert fed(jf.ObjectTokenizer(), jf.ObjectTokenizer, [text[:cut], text[cut:]]) == expected
    assert fed(jf.ObjectTokenizer(), jf.ObjectTokenizer, list(text)) == expected


def run(spark, frames, path, stream, name):
    """Each frame is a batch of its own; the query is started anew for each, so all state goes through the checkpoint."""
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(f"{path}/in/{k}")
        s = stream(spark.readStream.schema(frame.schema).parquet(f"{path}/in/*"))
        q = s.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return spark.read.schema(s.schema).parquet(f"{path}/out").collect()


def test_streams_of_bytes_and_of_late_and_repeated_pieces(spark, tmp_path):
    rng = random.Random(1)
    sessions = {k: json.dumps(json.loads(json.dumps(TEXTS[k % 3])), ensure_ascii=False).encode() for k in range(6)}
    rows = []
    for k, data in sessions.items():
        cuts = sorted(rng.sample(range(1, len(data)), min(25, len(data) - 1)))
        rows += [(k, seq, data[a:b]) for seq, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)]))]
    rng.shuffle(rows)
    batches = [rows[:60], rows[60:100] + rows[:10], rows[100:] + rows[95:105]]
    frames = [spark.createDataFrame(b, "session long, seq long, piece binary") for b in batches]
    got = run(spark, frames, tmp_path / "s", lambda s: jf.json_strings_stream(s, ["cleaned"]), "strings")
    expected = sorted((k, n, "cleaned", d, v) for k, data in sessions.items() for n, (d, v) in enumerate(strings(json.loads(data), "cleaned")))
    assert sorted(tuple(r) for r in got) == expected


def test_stream_of_objects(spark, tmp_path):
    text = json.dumps([{"n": i, "t": "}" * i} for i in range(20)])
    rows = [(1, i, text[7 * i : 7 * i + 7]) for i in range(-(-len(text) // 7))]
    frames = [spark.createDataFrame(b, "session long, seq long, piece string") for b in (rows[:15], rows[15:])]
    got = run(spark, frames, tmp_path / "o", jf.json_objects_stream, "objects")
    assert [json.loads(r["object"]) for r in sorted(got, key=lambda r: r["ordinal"])] == json.loads(text)


def test_waiting_pieces_cost_one_entry_of_the_state_for_many():
    """Each piece used to be written to the state, looked up, read and removed by itself, even those that came in their turn."""
    from weft.streaming import json_fields
    import pandas as pd

    class State:
        def __init__(self, calls):
            self.held, self.calls = None, calls

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

        def appendValue(self, value):
            self.held = [*(self.held or []), value]

    class Map(dict):
        def __init__(self, calls):
            super().__init__()
            self.calls = calls

        def called(self):
            self.calls.append(1)

        def containsKey(self, key):
            self.called()
            return key in self

        def getValue(self, key):
            self.called()
            return self[key]

        def updateValue(self, key, value):
            self.called()
            self[key] = value

        def removeKey(self, key):
            self.called()
            del self[key]

    calls = []
    p = json_fields.PieceProcessor(lambda: json_fields.FieldTokenizer({"text"}))
    p.place, p.waiting, p.open = State([]), Map(calls), State([])
    raw = ('{"text": "' + "ab" * 300 + '", "text": "c"}').encode()
    pieces = [(i, raw[i * 3 : i * 3 + 3]) for i in range(-(-len(raw) // 3))]
    found = []
    for some in (pieces[1::2], pieces[1:5], pieces[::4], pieces[:1], pieces):
        for f in p.handleInputRows((1,), iter([pd.DataFrame(some, columns=["seq", "piece"])]), None):
            found += f["value"].tolist()
    assert found == ["ab" * 300, "c"] and not p.waiting and len(calls) < 60
