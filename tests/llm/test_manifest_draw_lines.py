"""Merkle manifest, importance resampling and line dedup against plain versions; nulls, repeats, ties, empty tables, clashes."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import importance_resampling, line_runs, merkle_manifest
from lexispark.llm.common import new_path
from lexispark.llm.ranking import ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "The Same Line Of Some Length"
ROWS = [
    (None, LINE, "en", "s", 1), (None, LINE, "en", "s", 1), (3, None, None, "s", None), (4, "", "de", None, 0), (4, "", "de", None, 0), (4, "other", "de", None, 5),
    (7, f"{LINE}\n x \n\t{LINE.upper()} \nend of the text", "en", "s", 2), (9, f"a\n\n{LINE}", "é", "s", 9223372036854775807), (9, f"b\n{LINE.lower()}", "é", "s", 3), (10, f"{LINE}\n{LINE}\n", "en", "s", 4),
    *[(20 + i, f"text {i} \x1c É" + " word" * i + "\n" + "é" * 19 + "\n" + "é" * 20, ["en", "fr", ""][i % 3], "s", i) for i in range(40)], (100, "w " * 30000 + "\n" + "y" * 5000, "en", "s", 1),
]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def same(df, want):
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


# ---- manifest ------------------------------------------------------------------------------------------------


def plain_leaf(row, more=0):
    ident, text, lang, source, n = row
    fields = [ident, source, lang, None if n is None else n + more, text]
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    return levels


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    trees = {k: plain_levels([plain_leaf(r) for r in own]) for k, own in by.items()}
    above = plain_levels([trees[k][-1][0] for k in order])
    for k, own in by.items():
        for i, r in enumerate(own):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, path = plain_leaf(r, 1 if hit else 0), []
            for levels, at in ((trees[k], i), (above, order.index(k))):
                for level in levels[:-1]:
                    mine = level[at // 2 * 2 : at // 2 * 2 + 2]
                    path += [x for j, x in enumerate(mine) if j != at % 2]
                    mine[at % 2] = node
                    node, at = sha("".join(mine)), at // 2
            yield r[0], plain_leaf(r), trees[k][-1][0], above[-1][0], sha("".join(path)), node, node == above[-1][0]


@pytest.mark.parametrize("span", [1, 2, 8])
def test_manifest(spark, docs, monkeypatch, span):
    monkeypatch.setattr(merkle_manifest, "SPAN", span)
    rows = ROWS if span < 8 else ROWS + [(1000 + i, f"t{i}", "en", "s", i) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit(1), "tree": F.lit("x"), "n": F.lit(2), "rank": F.lit(3)})
    if span < 8:  # workers read the module anew, so smaller blocks only hold where the tree is hashed by hand
        levels = plain_levels([sha(str(i)) for i in range(11)])
        for at in range(11):
            path, node = [], levels[0][at].encode()
            for level in range(0, len(levels) - 1, span):
                block = at >> level >> span
                own = [x.encode() for x in levels[level][block << span : (block + 1) << span]]
                path += merkle_manifest.siblings(merkle_manifest.climbed(own, len(levels[level])), (at >> level) - (block << span))
            assert merkle_manifest.folded(node, path).decode() == levels[-1][0]
    else:
        same(merkle_manifest.tampered_report(df), plain_manifest(rows))


def test_manifest_one_row_and_empty(spark):
    one = spark.createDataFrame(ROWS[:1], SCHEMA)
    same(merkle_manifest.tampered_report(one), plain_manifest(ROWS[:1]))
    empty = merkle_manifest.tampered_report(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_missing_child():
    with pytest.raises(ValueError, match="children"):
        merkle_manifest._vertex((("en", 0), [(0, 3, b"a", ()), (2, 3, b"c", ())]))


def test_manifest_by_other_columns(spark, docs):
    """Any fields, order and tree; each changed row, and no other, fails."""
    found = merkle_manifest.manifest(docs, ("n_chars", "text"), "n_chars", "source", {"text": F.when(F.col("n_chars") == 5, F.lit("forged")).otherwise(F.col("text"))})
    assert [r.n_chars for r in found.where("NOT verified").collect()] == [5, 5]
    assert found.count() == len(ROWS)


# ---- ranks ---------------------------------------------------------------------------------------------------


def test_ranked(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else f"g{i % 3}", i % 5 if i < 30 else 7) for i in range(100)], "tree string, v int")
    out = ranked(rows, [F.asc("v")], "tree").collect()
    for tree, n in ((None, 34), ("g1", 33), ("g2", 33)):
        own = sorted((r.rank, r.v, r.n) for r in out if r.tree == tree)
        assert [r[0] for r in own] == list(range(n)) and [r[1] for r in own] == sorted(r[1] for r in own) and {r[2] for r in own} == {n}
    assert ranked(rows.where("false"), [F.asc("v")]).collect() == []


# ---- resampling ----------------------------------------------------------------------------------------------


def plain_features(text, width):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in range(1, width + 1) for i in range(len(words) - k + 1)]


def plain_resampling(rows, target, width=1, percent=10):
    s, t = Counter(), Counter()
    for r in rows:
        s.update(plain_features(r[1], width)[1])
    for x in target:
        t.update(plain_features(x, width)[1])
    out = []
    for i, r in enumerate(rows):
        n, found = plain_features(r[1], width)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in found)
        h = int(sha(f"2024:{'null' if r[0] is None else r[0]}")[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((o for o in out if o[1] >= 20), key=lambda o: (-o[4], math.inf if rows[o[0]][0] is None else rows[o[0]][0]))
    for place, o in enumerate(enough[: math.floor(percent * len(enough) / 100)]):
        o[5] = place + 1
    return [(rows[o[0]][0], *o[2:]) for o in out]


@pytest.mark.parametrize("width,percent", [(1, 10), (3, 50)])
def test_resampling(spark, docs, width, percent):
    target = ["Word text É", None, "word word word 7", ""]
    df = docs.withColumns({"score": F.lit("own"), "rank": F.lit(1), "row": F.lit(2)})
    want = plain_resampling(ROWS, target, width, percent)
    same(importance_resampling.importance_report(df, spark.createDataFrame([(x,) for x in target], "text string"), width, percent), want)
    drawn = importance_resampling.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), width, percent)
    assert drawn.columns == df.columns
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r[0] for r in want if r[4])


def test_resampling_ties_and_empty(spark):
    """Rows of one id and text have one score: as many as fit are drawn."""
    rows = [(1, "w " * 20)] * 30 + [(2, "w " * 19)]
    df, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("w",)], "text string")
    found = importance_resampling.importance_report(df, target).collect()
    assert sorted(r.rank for r in found if r.rank) == [1, 2, 3] and len(found) == 31
    assert importance_resampling.resample(df, target).count() == 3
    none = df.where("false")
    assert importance_resampling.importance_report(none, none.select("text")).collect() == []
    assert importance_resampling.resample(none, target).collect() == []
    assert importance_resampling.gains(np.zeros(10000, np.int64), np.zeros(10000, np.int64)).tolist() == [0] * 10000


# ---- line dedup ----------------------------------------------------------------------------------------------


def plain_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))


def plain_lines(rows, least_docs=3):
    holders = {}
    for i, r in enumerate(rows):
        for key in {plain_key(x) for x in (r[1] or "").split("\n")}:
            holders.setdefault(key, []).append(i)
    least = -math.inf
    for r in rows:
        mine, kept = (r[1] or "").split("\n"), []
        for line in mine:
            own = holders[key := plain_key(line)]
            ids = [least if rows[i][0] is None else rows[i][0] for i in own]
            if len(key) < 20 or len(own) < least_docs or max(ids) == (least if r[0] is None else r[0]):
                kept.append(line)
        yield r[0], len(mine), len(mine) - len(kept), "\n".join(kept)


@pytest.mark.parametrize("batches,least_docs", [(1, 3), (6, 3), (3, 2)])
def test_line_dedup(spark, docs, batches, least_docs):
    want = list(plain_lines(ROWS, least_docs))
    df = docs.withColumns({"key": F.lit(1), "docs": F.lit(2), "row": F.lit(3), "keys": F.lit(4), "at": F.lit(5), "bucket": F.lit(6)})
    same(line_runs.dedup_report(df, least_docs=least_docs, batches=batches), [(a, b, c, sha(d)) for a, b, c, d in want])
    if batches == 6:
        out = line_runs.dedup_lines(df)
        assert out.columns == df.columns
        same(out.select("doc_id", "text"), [(w[0], w[3] if w[2] else r[1]) for w, r in zip(want, ROWS, strict=True)])


def test_line_dedup_text_ids_and_empty(spark, docs):
    """Ids that aren't numbers are ordered as texts."""
    rows = [(None if r[0] is None else f"{r[0]:04}", *r[1:]) for r in ROWS]
    found = line_runs.dedup_report(docs.withColumn("doc_id", F.format_string("%04d", "doc_id")).withColumn("doc_id", F.when(F.col("doc_id") != "null", F.col("doc_id"))))
    want = {(w[0], *w[1:3], sha(w[3])) for w in plain_lines(ROWS)}
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found.collect()} == {(None if a is None else f"{a:04}", *b) for a, *b in want} and len(rows) == found.count()
    assert line_runs.dedup_report(docs.where("false")).collect() == []
    assert line_runs.dedup_lines(docs.where("false")).collect() == []


def test_line_runs_levels(spark):
    """Runs merge as levels fill up, are found again, and what a cut-off merge left is passed over or covered."""
    folder = new_path(spark, "test-runs")
    runs = line_runs.LineRuns(spark, folder, "long")
    total = {}
    for batch in range(7):
        rows = [(100 - 10 * batch - i, bytes([k])) for k in range(8) for i in range(3) if k % (batch + 1) == 0 and i <= k % 3]
        runs.add(spark.createDataFrame(rows, "doc_id long, key binary"), batch)
        for ident, key in rows:
            total.setdefault(key, []).append(ident)
    assert [(r[0] > 0, r[1], r[2]) for r in runs.runs()] == [(True, 0, 3), (True, 4, 5), (False, 6, 6)]
    runs.close()
    again = line_runs.LineRuns(spark, folder, "long")
    assert again.runs() == runs.runs()
    stray = f"{folder}/level9-0-6-4"
    spark.range(1).write.parquet(stray)
    again.fs.delete(again._path("level9-0-6-4/_SUCCESS"), False)  # a merge that was cut off
    assert again.runs() == runs.runs()
    whole = {r.key: (r.docs, r.top) for r in again.whole().collect()}
    assert set(whole) == {bytes(k) for k in total} and len(again.runs()) == 1
    for key, ids in total.items():
        docs, top = whole[key]
        assert min(docs, 3) == min(len(ids), 3) and docs <= len(ids) and top == max(ids)
    again.close()


def test_line_runs_are_merged_as_they_lie(spark):
    """Neither the merge of runs nor the anti-join of a batch shuffles a run."""
    folder = new_path(spark, "test-plan")
    runs = line_runs.LineRuns(spark, folder, "long", fan=99)
    for batch in range(2):
        runs.add(spark.createDataFrame([(1, b"a"), (2, b"b")], "doc_id long, key binary"), batch)
    a, b = (runs.read(r) for r in runs.runs())
    plan = a.hint("merge").join(b, "key", "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()
