"""Any sequence of glossary edits against a plain list."""

import random

import pytest

from lexispark.operators import edits


def plain(terms, log, seed):
    rows = [list(t) for t in sorted(terms)]
    for seq, kind, source, new_source, new_target in sorted(log):
        wanted = new_source if kind == "add" else source
        at = next((i for i, r in enumerate(rows) if r[1] == wanted), None)
        if kind == "reset":
            rows = [list(t) for t in sorted(seed)]
        elif kind == "delete":
            if at is not None and rows[at][3] != "official":
                rows = [r for r in rows if r[1] != source]
        elif not new_source.strip() or not new_target.strip():
            continue
        elif at is not None:
            rows[at][1:] = [new_source, new_target, "user"]
        elif kind == "add":
            rows.append([None, new_source, new_target, "user"])
    return [tuple(r[1:]) for r in rows]


def drawn(draw, n, names, first=0):
    out = []
    for seq in range(first, first + n):
        kind = draw.choices(["add", "update", "delete", "reset"], [6, 3 if len(names) < 12 else 1, 3, 0.15])[0]
        out.append((seq, kind, None if kind in ("add", "reset") else draw.choice(names), draw.choice([*names, " "]) if kind in ("add", "update") else None, f"t{seq}" if draw.random() < 0.95 else " "))
    return out


@pytest.mark.parametrize("size", [6, 40])
def test_any_sequence(spark, tmp_path, size):
    draw = random.Random(size)
    names = [f"w{i}" for i in range(size)]
    seed = [(i, names[i % size], f"s{i}", "official") for i in range(5)]
    terms = [(i, draw.choice(names), f"b{i}", draw.choice(["official", "user", None])) for i in range(size)]
    for n in (0, 12, 60):
        log = drawn(draw, n, names)
        got = edits.fold(spark.createDataFrame(terms, edits.TERMS), spark.createDataFrame(log, edits.EDIT), spark.createDataFrame(seed, edits.TERMS))
        assert [tuple(r)[1:] for r in got.orderBy("pos").collect()] == plain(terms, log, seed)


def test_log_is_kept_and_compacted(spark, tmp_path):
    """Terms are the same before and after a compaction, and when the folder is opened again."""
    draw, names = random.Random(3), [f"w{i}" for i in range(9)]
    seed = [(i, names[i], f"s{i}", "official") for i in range(5)]
    log, done = edits.GlossaryLog(spark, str(tmp_path / "g"), spark.createDataFrame(seed, edits.TERMS)), []
    for part in range(3):
        new = drawn(draw, 15, names, 15 * part)
        done += new
        log.append(spark.createDataFrame(new, edits.EDIT))
        now = lambda: [tuple(r)[1:] for r in log.terms().orderBy("pos").collect()]
        assert now() == plain(seed, done, seed)
        if part == 1:
            log.compact()
            assert now() == plain(seed, done, seed) and log._bases() == [29]
            log = edits.GlossaryLog(spark, str(tmp_path / "g"), spark.createDataFrame(seed, edits.TERMS))
    log.compact()
    log.compact()
    assert [tuple(r)[1:] for r in log.terms().orderBy("pos").collect()] == plain(seed, done, seed)
