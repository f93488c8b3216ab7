"""Event state in batch and as a stream, and deltas of bodies that are cut anywhere."""

import random
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.operators import state
from lexispark.streaming import fold, once, sse

ENTRIES = [("e1", "old", "pending", None), ("e2", "abc", "edited", None), ("e3", "", "pending", "was wrong"), ("e4", "", "pending", None), ("e5", "kept", "pending", None)]
EVENTS = [
    ("e1", "progress"), ("e1", "delta", "x"), ("none", "done", "?"), ("e1", "delta", "y"), ("e3", "strange", "?"), ("e1", "error", "boom"), ("e1", "delta", "z"), ("e1", "done", "Z"),
    ("e2", "progress"), ("e2", "error", "boom"), ("e3", "delta", "q"), ("e3", "done", "A"), ("e3", "delta", "B"), ("e4", "edit", "mine"), ("e3", "edit", "own"), ("e1", "revert"), ("e1", "delta", "!"),
]


def plain(entries, events):
    """The rule, an event at a time."""
    now = {e[0]: [*e[1:], False] for e in entries}
    for entry, kind, *text in events:
        if (s := now.get(entry)) is None:
            continue
        if kind == "progress":
            s[1] = "translating"
        elif kind == "delta":
            s[0], s[1] = s[0] + text[0], "translating"
        elif kind == "done":
            s[0], s[1], s[3] = text[0], "translated", True
        elif kind == "edit":
            s[0], s[1] = text[0], "edited"
        elif kind == "error":
            s[1], s[2] = "error", text[0]
        elif kind == "revert":
            s[:3] = ["", "pending", None]
    return now


def cancelled(entries, events):
    return {k: tuple(s[:3]) if s[3] else ("", "pending", None) for k, s in plain(entries, events).items()}


def rows_of(events):
    return [(i, e[0], e[1], "translating", e[2] if len(e) > 2 else None, e[2] if len(e) > 2 else None) for i, e in enumerate(events)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(rows_of(EVENTS), "seq long, entryId string, type string, status string, text string, message string").withColumn("ts", F.timestamp_seconds("seq"))


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "id string, target string, status string, error string")


def as_dict(df, key="id"):
    return {r[key]: (r["target"], r["status"], r["error"]) for r in df.collect()}


def test_batch(entries, log):
    assert as_dict(state.apply_to(entries, log)) == {k: tuple(s[:3]) for k, s in plain(ENTRIES, EVENTS).items()}
    for at in (0, 8, 12, len(EVENTS)):
        assert as_dict(state.cancel(entries, log, at)) == cancelled(ENTRIES, EVENTS[:at])


class Kept:
    """A value or map of state without a store."""

    def __init__(self):
        self.values = {}

    exists = lambda self: bool(self.values)
    get = lambda self: self.values[None]
    containsKey = lambda self, k: k in self.values
    getValue = lambda self, k: self.values[k]
    iterator = lambda self: iter(list(self.values.items()))

    def update(self, v):
        self.values[None] = v

    def updateValue(self, k, v):
        self.values[k] = v


class Handle:
    def getMapState(self, *_):
        return Kept()

    getValueState = getMapState


def run(processor, key, batches):
    for batch in batches:
        yield pd.concat(processor.handleInputRows(key, iter([batch]), None))


@pytest.mark.parametrize("size", [1, 4, 99])
def test_cancel_at_every_event(size):
    """The processor equals the rule whatever the cut and the batches are."""
    for at in range(len(EVENTS) + 1):
        events = [*EVENTS[:at], (None, "cancel"), *EVENTS[at:]]
        frame = pd.DataFrame(rows_of(events), columns=["seq", "entryId", "type", "status", "text", "message"]).assign(ts=lambda x: x["seq"])
        frame = frame[frame["type"] != "strange"]
        processor = fold.RunFold(known_only=True)
        processor.init(Handle())
        processor.handleInitialState(("",), pd.DataFrame(ENTRIES, columns=["id", "target", "status", "error"]), None)
        for _ in run(processor, ("", 0), [frame[i : i + size] for i in range(0, len(frame), size)]):
            pass
        assert {k[0]: v[:3] for k, v in processor.entries.iterator()} == cancelled(ENTRIES, EVENTS[:at])


@pytest.mark.parametrize("stop", [False, True])
def test_stream_with_initial_state(spark, entries, log, tmp_path, stop):
    """Several batches, prior targets, unknown ids; with a cancel in the second batch."""
    marker = log.where("seq = 8").withColumns({"entryId": F.lit(None).cast("string"), "type": F.lit("cancel")})
    source = log.where("seq < 8").union(marker).union(log.where("seq >= 8")) if stop else log
    for i, part in enumerate(("seq < 3", "seq >= 3 AND seq <= 8", "seq > 8")):
        rows = source.where(part).orderBy("seq", F.col("type") != "cancel") if stop else source.where(part)
        rows.withColumn("ts", F.when(F.col("type") == "cancel", F.col("ts") - F.expr("INTERVAL 1 MILLISECOND")).otherwise(F.col("ts"))).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    read = spark.readStream.schema(source.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get(once.PROVIDER, None)
    got = as_dict(once.drained(fold.fold_stream(read, entries, buckets=2), ["run", "entryId"]), "entryId")
    want = cancelled(ENTRIES, EVENTS[:8]) if stop else {k: tuple(s[:3]) for k, s in plain(ENTRIES, EVENTS).items()}
    assert got == {k: v for k, v in want.items() if stop or k != "e5"}
    assert spark.conf.get(once.PROVIDER, None) == before


def test_stream_of_unknown_entries(spark, log, tmp_path):
    """Without entries each id begins empty."""
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    assert as_dict(once.drained(fold.fold_stream(read, buckets=3), ["run", "entryId"]), "entryId") == as_dict(state.fold(log), "entryId")


BODY = 'data: {"choices":[{"delta":{"content":"é🙂"}}]}\r\n: note\n\ndata: {bad\ndata:{"choices":[{"delta":{"content":"no space"}}]}\ndata: {"choices":[{"delta":{"content":""}}]}\ndata: {"choices":[]}\ndata:  {"choices":[{"delta":{"content":"b"}},{"delta":{"content":"second"}}]} \r\r\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"unfinished"}}]}'.encode()


def test_deltas_of_any_cut(spark):
    """Lines of a body, whatever the chunks: equal to the whole's."""
    draw, whole = random.Random(3), BODY.split(b"\n")[:-1]
    for trial in range(300):
        cuts = sorted(draw.sample(range(len(BODY) + 1), draw.choice([0, 1, 5, 60])))
        chunks = [BODY[a:b] for a, b in zip([0, *cuts], [*cuts, len(BODY)])]
        processor = sse.Lines()
        processor.init(Handle())
        size = draw.choice([1, 3, 99])
        frames = [pd.DataFrame({"seq": range(i, i + len(chunks[i : i + size])), "chunk": chunks[i : i + size]}).sample(frac=1, random_state=trial) for i in range(0, len(chunks), size)]
        out = pd.concat(run(processor, ("b",), frames))
        assert out["line"].tolist() == [x.decode() for x in whole] and out["pos"].tolist() == list(range(len(whole)))
    cut = spark.createDataFrame([("b", i, bytearray(BODY[i : i + 1])) for i in range(len(BODY))], "body string, seq long, chunk binary")
    assert sorted((r["pos"], r["text"]) for r in sse.deltas(cut).collect()) == [(0, "é🙂"), (7, "b")]


def test_chunks_are_packed():
    """A row for each body of a batch, null ones too; chunks whose packs interleave are put in order."""
    names, seqs = ["a", None, "a", "b", None, "a"], [5, 1, 3, None, 0, 4]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array(seqs, pa.int64()), pa.array([b"x", b"cd", b"", None, b"ab", b"yz"])], ["body", "seq", "chunk"])
    packs = {r["body"]: r for half in (batch, batch.slice(0, 0)) for b in sse._packed(iter([half])) for r in b.to_pylist()}
    assert len(packs) == 3 and {k: sse._in_order([r["seqs"]], [r["sizes"]], [r["data"]]) for k, r in packs.items()} == {"a": b"yzx", None: b"abcd", "b": b""}
    halves = [r for b in sse._packed(iter([batch.slice(0, 3), batch.slice(3)])) for r in b.to_pylist() if r["body"] == "a"]
    assert len(halves) == 2 and sse._in_order(*[[r[c] for r in halves] for c in ("seqs", "sizes", "data")]) == b"yzx"


def test_packed_stream_over_batches(spark, tmp_path):
    """Bodies that share buckets, one of them null, in two batches that cut lines and characters."""
    bodies = ["a", "b", "c", None]
    rows = [(body, i, bytearray(BODY[i : i + 2])) for body in bodies for i in range(0, len(BODY), 2)]
    for at, half in enumerate(([r for r in rows if r[1] < 47], [r for r in rows if r[1] >= 47])):
        spark.createDataFrame(half, "body string, seq long, chunk binary").repartition(3, "seq").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if at == 0:
            time.sleep(1.1)
    stream = spark.readStream.schema("body string, seq long, chunk binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = once.drained(sse.delta_stream(stream, buckets=2)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((body, pos, text)) for body in bodies for pos, text in ((0, "é🙂"), (7, "b")))
