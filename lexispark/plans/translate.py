"""Running jobs through a translator in tasks, with retries, as a table of events.

A translator is a function of (prompt, source) that yields parts of the output; the default works offline. It has to
bound its own waiting for a part; between parts the time of an attempt and a request to cancel are looked at.
Tasks may run twice, so stage the events before they are used twice, and switch speculation off for paid services.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import state
from ..schema import TRANSLATING
from ..sources.streams import batched
from ..staging import staged
from . import planner

ATTEMPTS, FIRST_WAIT_S, TIMEOUT_S = 3, 0.5, 60.0
EVENTS = "job_pos long, seq long, attempt int, type string, entryId string, text string, message string"


def offline(prompt: str, source: str) -> Iterator[str]:
    yield "【译文】"
    yield source


class FileFlag:
    """True once a file exists in a folder that all executors share; looked up twice a second at most."""

    def __init__(self, path: str) -> None:
        self.path, self.seen, self.next_s = path, False, 0.0

    def __call__(self) -> bool:
        if not self.seen and time.monotonic() >= self.next_s:
            system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
            self.seen, self.next_s = system.get_file_info(path).type != fs.FileType.NotFound, time.monotonic() + 0.5
        return self.seen


def run_jobs(jobs: DataFrame, translator: Callable[[str, str], Iterable[str]] = offline, *, concurrency: int = 6, first_wait_s: float = FIRST_WAIT_S, timeout_s: float = TIMEOUT_S, cancelled: Callable[[], bool] = lambda: False) -> DataFrame:
    """Events of jobs (kind, base, first_pos, members, prompt): progress, deltas (not of series), then done or error
    for each member. Deltas of failed attempts stay; a done replaces them. Once cancelled (say, by a FileFlag), jobs
    that have not begun have no events, and those that run have neither done nor error."""

    def run(job: tuple) -> list[tuple]:
        if cancelled():
            return []
        pos, kind, base, members, prompt = job
        ids = [m["id"] for m in members]
        rows: list[tuple] = [(pos, 0, 1, "progress", i, None, None) for i in ids]
        fault = None
        for attempt in range(1, ATTEMPTS + 1):
            wait_until = time.monotonic() + first_wait_s * 2 ** (attempt - 2) * (attempt > 1)
            while (left := wait_until - time.monotonic()) > 0 and not cancelled():
                time.sleep(min(left, 0.2))
            if cancelled():
                return rows
            try:
                text, until = "", time.monotonic() + timeout_s
                for part in translator(prompt, base):
                    if cancelled():
                        return rows
                    if time.monotonic() > until:
                        raise TimeoutError(f"no answer within {timeout_s:g} s")
                    text += part
                    if kind != "series":
                        rows += [(pos, len(rows) + k, attempt, "delta", i, part, None) for k, i in enumerate(ids)]
                rows += [(pos, len(rows), attempt, "done", m["id"], _composed(text, m["suffix"]) if kind == "series" else text, None) for m in members]
                return rows
            except Exception as e:  # noqa: BLE001  a translator may fail in any way
                fault = str(e)
        return rows + [(pos, len(rows), ATTEMPTS, "error", i, None, fault) for i in ids]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, min(concurrency, 100))) as pool:
            runs = (rows for batch in batches for rows in pool.map(run, batch.itertuples(index=False, name=None)))
            yield from batched((row for rows in runs for row in rows), [c.split()[0] for c in EVENTS.split(", ")], 5)

    return jobs.select("first_pos", "kind", "base", "members", "prompt").mapInPandas(each, EVENTS)


def memory_events(resolved: DataFrame) -> DataFrame:
    """Events of entries that memory decides: progress, then done."""
    two = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.lit("progress").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(F.lit(1).cast("long").alias("seq"), F.lit("done").alias("type"), F.col("target").alias("text"))))
    return resolved.select(F.col("pos").alias("job_pos"), F.col("id").alias("entryId"), two.alias("e")).select("job_pos", "e.seq", F.lit(1).alias("attempt"), "e.type", "entryId", "e.text", F.lit(None).cast("string").alias("message"))


def translate_table(entries: DataFrame, terms: DataFrame, translator: Callable[[str, str], Iterable[str]] = offline, hint: Column | None = None, **options: object) -> tuple[DataFrame, DataFrame]:
    """(entries, events): plans, asks the translator for each job, and folds all events into the entries. Events are
    staged, so each job is asked once (again only where a task is lost); options are those of run_jobs."""
    resolved, jobs, known = planner.planned(entries)
    asked = planner.requests(jobs, terms, known, hint)
    events = staged(memory_events(resolved).unionByName(run_jobs(asked, translator, **options)))
    ordered = events.withColumns({"ts": F.timestamp_seconds("job_pos"), "status": F.lit(TRANSLATING)})
    return state.apply_to(entries, ordered), events


def _composed(base: str, suffix: str | None) -> str:
    base, suffix = base.strip(), (suffix or "").strip()
    return base if not suffix else base + suffix if not suffix[0].isalnum() and suffix[0].isascii() else f"{base} {suffix}"
