"""Folding of progress events into entry state, in batch; lexispark.streaming has the streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

#: Types of events that change an entry; all others are passed over.
TYPES = ("progress", "delta", "done", "error", "edit", "revert")


def changes(events: DataFrame) -> DataFrame:
    """What events do to each entry, in the order of (ts, seq): entryId, replaced (whether target was set anew), text
    (that comes in its place or after it), status, told (whether error was set anew), error and completed.

    progress sets the status; delta appends text and sets translating; done and edit replace the target; error sets the
    status and the message; revert empties target and message and sets pending. Only error and revert touch the message,
    so it stays until then. Aggregates that combine before the shuffle find the last events; only deltas that
    count, and the last replacement, are gathered.
    """
    own = events.where(F.col("type").isin(*TYPES)).withColumn("at", F.struct("ts", "seq"))
    kind = F.col("type")
    resets, tells = kind.isin("done", "edit", "revert"), kind.isin("error", "revert")
    marks = own.groupBy("entryId").agg(
        F.max(F.when(resets, F.col("at"))).alias("since"), F.max_by(F.struct("type", "status"), "at").alias("last"), F.bool_or(kind == "done").alias("completed"),
        F.max_by(F.when(tells, F.struct(F.when(kind == "error", F.col("message")).alias("message"))), F.when(tells, F.col("at"))).alias("said"), F.bool_or(tells).alias("told"),
    )
    parts = own.where(resets | (kind == "delta")).join(marks.select(F.col("entryId").alias("of"), "since"), F.col("entryId").eqNullSafe(F.col("of")))
    parts = parts.where(F.col("since").isNull() | (F.col("at") >= F.col("since")))
    text = F.array_sort(F.collect_list(F.struct("at", F.when(kind == "revert", "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))))
    texts = parts.groupBy(F.col("entryId").alias("of")).agg(F.array_join(F.transform(text, lambda x: x["text"]), "").alias("text"))
    last = F.col("last.type")
    status = F.when(last == "progress", F.col("last.status")).when(last == "delta", "translating").when(last == "done", "translated").when(last == "edit", "edited").when(last == "revert", "pending").otherwise("error")
    joined = marks.join(texts, F.col("entryId").eqNullSafe(F.col("of")), "left")
    return joined.select("entryId", F.col("since").isNotNull().alias("replaced"), F.coalesce("text", F.lit("")).alias("text"), status.alias("status"), "told", F.col("said.message").alias("error"), "completed")


def fold(events: DataFrame) -> DataFrame:
    """entryId, target, status and error after all events, of entries that had no target and no error."""
    return changes(events).select("entryId", F.col("text").alias("target"), "status", "error")


def apply_to(entries: DataFrame, events: DataFrame) -> DataFrame:
    """entries after the events; their own targets are what deltas go on from. Events of unknown entries don't matter."""
    return _onto(entries, changes(events)).drop("__completed")


def _onto(entries: DataFrame, changed: DataFrame) -> DataFrame:
    c = changed.select(F.struct("*").alias("__c"))
    seen = F.col("__c").isNotNull()
    joined = entries.join(c, F.col("id") == F.col("__c.entryId"), "left")
    own = F.coalesce("target", F.lit(""))
    target = F.when(~seen, F.col("target")).when(F.col("__c.replaced"), F.col("__c.text")).otherwise(F.concat(own, "__c.text"))
    error = F.when(seen & F.col("__c.told"), F.col("__c.error")).otherwise(F.col("error"))
    return joined.withColumns({"target": target, "status": F.when(seen, F.col("__c.status")).otherwise(F.col("status")), "error": error, "__completed": F.coalesce("__c.completed", F.lit(False))}).drop("__c")


def cancel(entries: DataFrame, events: DataFrame, at_seq: int) -> DataFrame:
    """entries of a run that was cancelled at at_seq: events from there on are ignored, and entries without a done before
    it are pending again, with neither target nor error."""
    now = _onto(entries, changes(events.where(F.col("seq") < at_seq)))
    kept = F.col("__completed")
    return now.withColumns({"target": F.when(kept, F.col("target")).otherwise(""), "status": F.when(kept, F.col("status")).otherwise("pending"), "error": F.when(kept, F.col("error"))}).drop("__completed")


def finished(entries: DataFrame, events: DataFrame) -> DataFrame:
    """The all_done event of a run over entries: total counts all that were pending, those that memory decided too, and
    failed the members of jobs that ended in an error. A task that Spark gives up fails the whole run instead."""
    total = entries.agg(F.count_if(~is_blank("source") & is_blank("target")).alias("total"))
    failed = events.agg(F.count_distinct(F.when(F.col("type") == "error", F.col("entryId"))).alias("failed"))
    return total.crossJoin(failed).select(F.lit("all_done").alias("type"), "total", "failed")  # one row each


def progress(entries: DataFrame) -> DataFrame:
    done = F.col("status").isin("translated", "edited")
    return entries.agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(~done).alias("pending"))
