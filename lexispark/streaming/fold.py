"""Streaming fold of progress events into entry state, equal to operators.state for one log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import TYPES

STATE = "target string, status string, error string, completed boolean"
OUT = "run string, entryId string, target string, status string, error string"
#: What a new entry has, if entries needn't be known.
NEW = ("", "pending", None, False)


def _after(now: tuple, e: object) -> tuple:
    """An entry's (target, status, error, completed) after event e."""
    target, status, error, completed = now
    if e.type == "progress":
        return target, e.status, error, completed
    if e.type == "delta":
        return target + (e.text or ""), "translating", error, completed
    if e.type in ("done", "edit"):
        return e.text or "", "translated" if e.type == "done" else "edited", error, completed or e.type == "done"
    if e.type == "error":
        return target, "error", e.message, completed
    return "", "pending", None, completed


class RunFold(StatefulProcessor):
    """The entries of one bucket of a run by id, and whether the run was cancelled. Events of a batch are taken by
    (ts, seq); across batches order is the source's duty."""

    def __init__(self, known_only: bool):
        self.known_only = known_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "id string", STATE)
        self.cancelled = handle.getValueState("cancelled", "cancelled boolean")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        for e in initialState.itertuples():
            self.entries.updateValue((e.id,), (e.target or "", e.status, None if pd.isna(e.error) else e.error, False))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        changed: dict[str, tuple] = {}
        stopped = self.cancelled.exists()
        batch = pd.concat(rows).sort_values(["ts", "seq"])
        for e in batch.astype(object).where(batch.notna(), None).itertuples():
            if stopped:
                break  # late events
            if e.type == "cancel":
                stopped = True
                self.cancelled.update((True,))
                every = {k[0]: tuple(v) for k, v in self.entries.iterator()} | changed
                changed |= {k: NEW for k, v in every.items() if not v[3]}
            elif e.entryId in changed:
                changed[e.entryId] = _after(changed[e.entryId], e)
            elif self.entries.containsKey((e.entryId,)):
                changed[e.entryId] = _after(tuple(self.entries.getValue((e.entryId,))), e)
            elif not self.known_only:
                changed[e.entryId] = _after(NEW, e)
        for entry, now in changed.items():
            self.entries.updateValue((entry,), now)
        yield pd.DataFrame([(key[0], entry, *now[:3]) for entry, now in changed.items()], columns=["run", "entryId", "target", "status", "error"])

    def close(self) -> None:
        pass


def _keys(df: DataFrame, entry: str, buckets: int) -> tuple[Column, Column]:
    run = F.coalesce(F.col("run").cast("string"), F.lit("")) if "run" in df.columns else F.lit("")
    return run.alias("run"), F.pmod(F.xxhash64(entry), F.lit(buckets)).cast("int").alias("bucket")


def fold_stream(events: DataFrame, entries: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """(run, entryId, target, status, error) of the entries that a batch changes; write it in update mode.

    State is kept by run (the column run, or one for all) and bucket of entry ids, so a run of any size is dealt over
    tasks. With entries (a table: id, target, status, error and maybe run) deltas go on from their targets, and events of
    other ids drop out. An event of type cancel, which has a run and no entryId, goes to all buckets of its run: entries
    without a done are pending again, and whatever comes later is ignored. The session must have the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    run, bucket = _keys(events, "entryId", buckets)
    columns = ["entryId", "ts", "seq", "type", "status", "text", "message"]
    own = events.where(F.col("type").isin(*TYPES)).select(run, bucket, *columns)
    stops = events.where("type = 'cancel'").select(run, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), *columns)
    initial = None
    if entries is not None:
        initial = entries.select(*_keys(entries, "id", buckets), "id", "target", "status", "error").groupBy("run", "bucket")
    keyed = own.union(stops).groupBy("run", "bucket")
    return keyed.transformWithStateInPandas(statefulProcessor=RunFold(entries is not None), outputStructType=OUT, outputMode="Update", timeMode="None", initialState=initial)
