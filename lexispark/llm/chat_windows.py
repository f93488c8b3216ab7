"""Chat formatting into budgeted windows, in DataFrame functions only.

A turn is `<s>` role newline text `</s>`. In roles and texts every `<`, `[` and backslash is followed by a
backslash of ours, so that no control string (`<s>`, `</s>`, `[INST]`, `<|...|>`) of a text survives, and taking
those backslashes out restores the text. A newline in a role is `[n`.

Prefix sums of the turns' tokens, taken in two levels (blocks of turn numbers, then within a block, so that a
very long conversation is spread over tasks), deal turns into spans: the turns within one multiple of the body
budget form a span, and a turn that crosses a multiple is a span of its own. A window is the conversation's
system turn, as many whole turns before the span as fit `history` tokens, and the span. The system turn counts
in its first window only; repeated turns carry no loss, so each assistant text is a target once.

Null texts and roles count as empty. Turns are in the order of turn (nulls first), role and a hash of the text, so
repeated turns stay. A null conv_id is a conversation like others. A turn larger than the room for a span makes a window
that exceeds the budget; no text is cut. An empty table has no windows; other columns than conv_id, turn, role and text
are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BUDGET, HISTORY, BLOCK = 1024, 256, 256
OPEN, CLOSE = "<s>", "</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def turn_tokens(text: Column) -> Column:
    """Words and single other characters, and three for the marks."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("long") + 3


def _prefixed(turns: DataFrame) -> DataFrame:
    """turns with the tokens before them (at), and the conversation's first turn."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))
    blocked = turns.withColumn("block", block)
    own = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocked.groupBy("conv_id", "block")
        .agg(F.sum("n").alias("n_block"), F.min(F.struct("turn", "role", "text_hash", "n")).alias("first"))
        .withColumn("before", F.coalesce(F.sum("n_block").over(own), F.lit(0)))
        .withColumn("first", F.first("first").over(Window.partitionBy("conv_id").orderBy("block")))
        .select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "before", F.when(F.col("first.role") == "system", F.col("first.n")).otherwise(0).alias("system_n"))
    )
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    joined = blocked.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return joined.withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0))).drop("c", "b", "before", "block")


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows: conv_id, window (in order), formatted, n_repeated (leading turns that an earlier window has),
    n_tokens and loss (character ranges of assistant texts, from start to before end)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("[n")), F.lit("\n"))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "conv_id", "turn", "role", F.xxhash64("text").alias("text_hash"), turn_tokens(F.col("text")).alias("n"),
        F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("f"), F.length(head).alias("text_at"),
    )
    placed = staged(_prefixed(turns), "chat-turns")
    is_system = (F.col("at") == 0) & (F.col("role") == "system")
    system = placed.where(is_system).select(F.col("conv_id").alias("sc"), F.col("f").alias("system_f"), F.col("n").alias("system_tokens"))
    body = placed.where(~is_system).withColumn("at", F.col("at") - F.col("system_n"))
    room = F.greatest(F.lit(budget) - F.col("system_n") - history, F.lit(budget // 4))
    first_bin, last_bin = F.floor(F.col("at") / room), F.floor((F.col("at") + F.col("n") - 1) / room)
    spans = body.withColumn("span", first_bin * 2 + (first_bin != last_bin).cast("long"))
    starts = spans.groupBy("conv_id", "span").agg(F.min("at").alias("start")).where("start > 0")
    wanted = starts.select(F.col("conv_id").alias("c"), F.col("span").alias("to"), "start", F.explode(F.array(F.floor(F.col("start") / history), F.floor(F.col("start") / history) - 1)).alias("bin"))
    near = F.col("conv_id").eqNullSafe(F.col("c")) & (F.floor(F.col("at") / history) == F.col("bin")) & (F.col("at") + F.col("n") <= F.col("start")) & (F.col("at") >= F.col("start") - history)
    columns = ["conv_id", "span", "at", "n", "repeated", "role", "f", "text_at"]
    repeats = spans.drop("span").join(wanted, near).select("conv_id", F.col("to").alias("span"), "at", "n", F.lit(True).alias("repeated"), "role", "f", "text_at")
    parts = spans.withColumn("repeated", F.lit(False)).select(*columns).union(repeats)
    part = F.struct("at", "repeated", (F.col("role") == "assistant").alias("target"), "f", "text_at", "n")
    windows = parts.groupBy("conv_id", "span").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    windows = windows.withColumn("window", F.row_number().over(Window.partitionBy("conv_id").orderBy("span")) - 1)
    whole = windows.join(system, F.col("conv_id").eqNullSafe(F.col("sc")) & F.col("span").isNotNull(), "left")
    alone = system.join(windows.select(F.col("conv_id").alias("wc")).distinct(), F.col("sc").eqNullSafe(F.col("wc")), "left_anti")
    alone = alone.select(F.col("sc").alias("conv_id"), F.lit(0).alias("window"), F.lit(None).cast(windows.schema["parts"].dataType).alias("parts"), "system_f", "system_tokens")
    every = whole.select("conv_id", "window", "parts", "system_f", "system_tokens").union(alone)
    lead = F.coalesce("system_f", F.lit(""))
    own = F.coalesce("parts", F.array().cast(windows.schema["parts"].dataType))

    def mark(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["f"])
        span = F.array(F.struct((acc["at"] + p["text_at"]).cast("long").alias("start"), (end - len(CLOSE)).cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(p["target"] & ~p["repeated"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return every.select(
        "conv_id", "window",
        F.concat(lead, F.array_join(F.transform(own, lambda p: p["f"]), "")).alias("formatted"),
        (F.size(F.filter(own, lambda p: p["repeated"])) + ((F.col("window") > 0) & F.col("system_f").isNotNull()).cast("int")).alias("n_repeated"),
        (F.coalesce("system_tokens", F.lit(0)) + F.aggregate(own, F.lit(0).cast("long"), lambda a, p: a + p["n"])).alias("n_tokens"),
        F.aggregate(own, F.struct(F.length(lead).cast("long").alias("at"), empty.alias("loss")), mark)["loss"].alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """windows with what their formatted texts say: turns (role, text) without the repeated ones, and loss_text."""
    pieces = F.split("formatted", CLOSE)

    def turn(x: Column) -> Column:
        at = F.instr(x, "\n")
        role = unescaped(F.replace(F.substr(x, F.lit(len(OPEN) + 1), at - len(OPEN) - 1), F.lit("[n"), F.lit("\n")))
        return F.struct(role.alias("role"), unescaped(F.substr(x, at + 1)).alias("text"))

    kept = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0)))
    texts = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return windows.withColumns({"turns": F.transform(kept, turn), "loss_text": F.array_join(texts, "")})


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: counts and digests of turns and of the text under the loss."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = read_windows(windows).select("conv_id", "window", F.size("turns").alias("n"), said.alias("said"), "loss_text", F.length("formatted").alias("chars"))
    whole = per.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "said", "loss_text"))).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return whole.select("conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length(joined("loss_text")).cast("long").alias("loss_chars"), F.sha2(joined("loss_text"), 256).alias("loss_sha256"), "formatted_chars")
