"""Operators over all documents, and the pipeline, against plain versions."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from brute import SPACED, Katz, components, contamination, low
from pyspark.sql import functions as F

import corpus_pipeline
from lexispark.llm import chat_windows, jaccard_join, katz_model, positional_index, queries
from lexispark.llm.common import read, staged
from lexispark.llm.components import components as linked_nodes


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(3))


def texts(spark, data):
    return {r["doc_id"]: r["text"] for r in read(spark, data, "documents").collect()}


@pytest.mark.parametrize(("bucket_bytes", "many"), [(1 << 20, 3), (4000, 48)])
def test_katz(spark, data, monkeypatch, bucket_bytes, many):
    monkeypatch.setattr(katz_model, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(katz_model, "MANY", many)
    fitted = katz_model.fit(read(spark, data, "documents"), chunk_tokens=9000)
    got = {r["doc_id"]: r for r in katz_model.scores_of(fitted).collect()}
    model = Katz(texts(spark, data), katz_model.discounts)
    for k, w in model.docs.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (model.held[k], len(w), sum(model.words[x] > 0 for x in w), model.n)
        assert r["score"] == pytest.approx(model.score(k), abs=1e-6) and r["base_score"] == pytest.approx(model.base(k), abs=1e-6)
    other = {1: "new words " + " ".join(x or "" for x in model.docs[0][:300]), 2: None, 3: "zzz yyy the the of xxx", 4: " ".join(x or "" for k in list(model.docs)[-5:] for x in model.docs[k])}
    by_table = {r["doc_id"]: r for r in katz_model.score(fitted, documents(spark, list(other.items())), chunk_tokens=500).collect()}
    for k, t in other.items():
        w = [*SPACED.findall(low(t)), None]
        assert (by_table[k]["n_tokens"], by_table[k]["n_known"]) == (len(w), sum(model.words[x] > 0 for x in w))
        assert by_table[k]["score"] == pytest.approx(sum(math.log10(model.p(h, x)) for h, x in zip([0, *w], w)), abs=1e-6)
    again = {r["doc_id"]: r["score"] for r in katz_model.score(fitted, read(spark, data, "documents")).collect()}
    assert again == pytest.approx({k: r["score"] for k, r in got.items()}, abs=1e-6)
    for h in list(model.back)[:50]:
        assert sum(model.p(h, w) for w in model.words) + model.back[h][0] * model.unknown * (model.contexts[h] > 0) == pytest.approx(1)


def test_katz_odd(spark):
    odd = documents(spark, [(1, None), (2, ""), (None, "a b"), (1, "a b"), (3, "A  b\tc")])
    scored = lambda docs: katz_model.scores_of(katz_model.fit(docs))
    got = scored(odd).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 3, 3, 4]
    assert scored(odd.limit(0)).count() == 0 and katz_model.score(katz_model.fit(odd), odd.limit(0)).count() == 0
    only = scored(documents(spark, [(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2])).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 for r in only)


def test_decontamination(spark, data):
    docs, items = read(spark, data, "documents"), read(spark, data, "benchmark")
    want = contamination(texts(spark, data).items(), [(r["item_id"], r["text"]) for r in items.collect()])
    for r in positional_index.contamination_report(docs, items).collect():
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want[r["doc_id"]]


def test_decontamination_in_small_blocks(spark, data):
    """Items that are longer than a block, and as many blocks as it takes: the same hits from one scan of the index."""
    docs, items = read(spark, data, "documents"), read(spark, data, "benchmark")
    long = " ".join(f"w{i}" for i in range(5000))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, "x " * 100_000 + long), (-2, long[: len(long) // 2])], "doc_id long, text string"))
    items = items.unionByName(spark.createDataFrame([(-5, long), (None, "w7 w8 w9")], "item_id long, text string"))
    want = contamination([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    files = positional_index.compile_queries(items, 10, 25)
    assert spark.read.parquet(*files).count() > 100
    index = positional_index.build_index(docs)
    found = positional_index.contamination(index, items, block_words=25)
    assert str(found._jdf.queryExecution().executedPlan()).count("Scan parquet") == 1
    for r in found.collect():
        assert (r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), len(r["item_ids"])) == want[r["doc_id"]][:3]


def test_decontamination_odd(spark):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    docs = [(1, "x " + " ".join(words) + " y"), (2, "seven, EIGHT! nine"), (3, None), (4, ""), (5, "Short item."), (1, "short"), (None, "Short-item")]
    items = [(7, " ".join(words)), (8, "short item"), (9, None), (9, "..."), (None, "seven eight"), (8, "short item")]
    df, it = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    index = positional_index.build_index(df, segment_words=12)
    for block in (4, 1000):
        got = positional_index.contamination(index, it, block_words=block).collect()
        found = sorted((r["doc_id"] or 0, r["n_words"], sorted(r["item_ids"]), sum(s["end"] - s["first"] for s in r["spans"]) > 0) for r in got)
        assert found == [(0, 2, ["8"], True), (1, 1, [], False), (1, 14, ["7"], True), (2, 3, [], True), (3, 0, [], False), (4, 0, [], False), (5, 2, ["8"], True)]
    assert sorted(r["doc_id"] or 0 for r in positional_index.without_contaminated(df.where("doc_id IS NULL OR doc_id > 1"), it).collect()) == [3, 4]
    same = spark.createDataFrame([(5, "Short item.", 1, "k"), (5, "clean", 2, None), (None, "short item", 3, "k")], "doc_id long, text string, row int, __key string")
    left = positional_index.without_contaminated(same, it)
    assert left.columns == same.columns and [r["text"] for r in left.collect()] == ["clean"]
    near = positional_index.find(index, spark.createDataFrame([(1, "two five seven")], "item_id long, text string"), slop=3).collect()
    assert [(r["doc_id"], r["first"], r["last"]) for r in near] == [(1, 2, 7)]
    assert positional_index.contamination_report(df, it.limit(0)).where("contaminated").count() == 0 and positional_index.contamination_report(df.limit(0), it).count() == 0


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 120)]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for e in edges for x in e if root(x) != x}
    got = linked_nodes(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def test_jaccard(spark, data, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    draw, rows = random.Random(3), []
    words = [f"w{i}" for i in range(60)]
    for size in [3, 5, 6, 7, 8, 9, 12, 20, 30, 40, 70, 130] * 4:
        base = draw.choices(words, k=size)
        for _ in range(12):
            w = list(base)
            for _ in range(draw.randint(0, max(1, size // 12))):
                k = draw.randrange(len(w))
                w[k : k + 1] = draw.choice([[draw.choice(words)], [w[k], draw.choice(words)], []] if len(w) > 1 else [[draw.choice(words)]])
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \n", "one", "ONE", "one"])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked(documents(spark, rows)).collect()}
    assert got == components(rows)
    kept = jaccard_join.one_of_each(documents(spark, [*rows[:30], (0, rows[0][1]), (None, "x y"), (None, None)])).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({v[1] for v in components(rows[:30]).values()}) and len(kept) == len({v[1] for v in components(rows[:30]).values()}) + 2


def test_jaccard_documents(spark, data):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked(read(spark, data, "documents")).collect()}
    assert got == components(texts(spark, data).items())
    assert jaccard_join.linked(read(spark, data, "documents").limit(0)).count() == 0


def test_jaccard_codes():
    codes = jaccard_join.codes_of(np.array([1, 2, 3, 100_000, 100_000_000]))
    assert list(codes[:3]) == [0, 8, 12] and len(set(codes)) == 5
    assert all(jaccard_join.shards_of(codes) * jaccard_join.SHARD >= [1, 2, 3, 100_000, 100_000_000])


@pytest.mark.parametrize("tile", [7, 2048])
def test_jaccard_hot(spark, monkeypatch, tile):
    """One passage in all documents; copies that are near but mostly not linked; shards, tiles, small chunks and k up to 4."""
    for name, value in (("FREQUENT", 2), ("FACTOR", 4), ("SHARD", 3), ("TILE", tile), ("GROUP", 4), ("CHUNK", 900)):
        monkeypatch.setattr(jaccard_join, name, value)
    draw, rows, tiles = random.Random(5), [], []
    passage = [f"p{i}" for i in range(60)]
    for i in range(90):
        w = passage[: draw.randint(50, 60)] + [f"x{i}-{k}" for k in range(draw.randint(0, 14))]
        rows.append((i, " ".join(w[draw.randint(0, 6) :])))
    for i in range(160):  # edits at a few places, so that their shingles are shared too
        w = [f"q{k}" for k in range(80)]
        for _ in range(draw.randint(1, 3)):
            w[5 * draw.randrange(16)] = f"e{draw.randrange(3)}"
        rows.append((100 + i, " ".join(w)))
    cross = jaccard_join._crossing
    monkeypatch.setattr(jaccard_join, "_crossing", lambda *a: tiles.append(cross(*a)) or tiles[0])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked(documents(spark, rows)).collect()}
    assert got == components(rows) and tiles


def test_jaccard_keys():
    """Sets that are similar share a key, whatever the frequencies of their tokens."""
    draw = np.random.default_rng(2)
    for _ in range(1500):
        n = int(draw.integers(2, 400))
        code = np.sort(draw.choice([0, 8, 40, 50, 60, 100, 150, 200], 600, p=draw.dirichlet(np.ones(8))))
        value = draw.permutation(600).astype(np.uint64)
        order = np.lexsort((value, code))
        code, value = code[order], value[order]
        a = np.sort(draw.choice(600, n, False))
        b = np.sort(np.unique(np.append(draw.permutation(a)[: n - int(draw.integers(0, n // 5 + 1))], draw.choice(600, int(draw.integers(0, n // 5 + 1))))))
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common) or not len(np.intersect1d(a[code[a] > 0], b[code[b] > 0])):
            continue
        if len(np.intersect1d(a[code[a] == 0], b[code[b] == 0])):
            continue  # what both have is not alone
        keys = [set(jaccard_join.keys_of(value[x][code[x] > 0], code[x][code[x] > 0].astype(np.uint16), len(x), 80)[0].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_one_of_each_odd(spark):
    w = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(3, w, 1, "a"), (5, w, 2, "b"), (5, other, 3, "c"), (5, other, 4, "d"), (7, w + " more", 5, "e"), (None, w, 6, "f"), (8, None, 7, None), (8, "", 8, "g")], "doc_id long, text string, node int, row string")
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    rows = sorted(((r["doc_id"] or 0), r["text"]) for r in kept.collect() if r["doc_id"] != 8)
    assert rows == [(0, w), (3, w), (5, other)] and sum(r["doc_id"] == 8 for r in kept.collect()) == 1
    assert jaccard_join.one_of_each(df.limit(0)).count() == 0
    long = " ".join(f"z{i}" for i in range(120_000))
    assert {r["component_id"] for r in jaccard_join.linked(documents(spark, [(1, long), (2, long + " end"), (9, w)])).collect()} == {1, 9}


def spoken(rows):
    turns, sha = collections.defaultdict(list), lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, t in turns.items():
        t.sort(key=lambda x: x[:3])
        loss = "".join(x for _, _, r, x in t if r == "assistant")
        out[conv] = (len(t), sha("".join(f"{r}\n{x}\n" for _, _, r, x in t)), len(loss), sha(loss))
    return out


def test_chat(spark, data):
    rows = [tuple(r) for r in read(spark, data, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.op9_chat_windows(spark, data).collect()}
    assert got == spoken(rows)


def test_chat_odd(spark):
    draw, rows = random.Random(5), [(9, 5, "system", "only"), (10, None, "assistant", "x"), (10, 2, "system", "y")]
    for conv in (None, 0, 2):
        rows.append((conv, 0, "system", draw.choice(["sys <s> x", None])))
        rows += [(conv, i, draw.choice(["user", "assistant", "to\nol", "<s>", None]), draw.choice(["", "<", "[\\", "</s>x\n", "é🙂 " * draw.randint(1, 60), None, "a b c " * draw.randint(0, 300)])) for i in range(1, 600 if conv == 2 else 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = staged(chat_windows.format_windows(df, budget=512, history=64), "t")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_windows.digests(windows).collect()}
    assert got == spoken(rows)
    assert windows.where("n_repeated > 0").count() > 20 and not windows.where(r"formatted RLIKE '\\[/?INST'").count()
    assert windows.where("n_tokens > 512 AND size(split(formatted, '</s>')) - 1 - n_repeated > 1").count() == 0
    assert chat_windows.format_windows(df.limit(0)).count() == 0


def test_chat_repeated_rows_and_names(spark):
    """Turns that tie stay all; columns of the results' names don't matter."""
    rows = [(1, 0, "user", "a", 9), (1, 0, "user", "a", 9), (1, 0, "assistant", "b", 9), (1, 1, "assistant", "c", 9), (1, 1, "assistant", "b", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window long").withColumn("formatted", F.lit("x"))
    found = chat_windows.read_windows(chat_windows.format_windows(df)).first()
    assert sorted((t["role"], t["text"]) for t in found["turns"]) == sorted((r[2], r[3]) for r in rows) and sorted(found["loss_text"]) == ["b", "b", "c"]


def test_pipeline_of_odd_rows(spark, data):
    """Nulls, repeated rows and ids, and own columns through all stages; an empty table stays empty."""
    good = " ".join(f"word{i} is here" for i in range(60))
    rows = [(1, good, "en", "s", 5, "k"), (1, good, "en", "s", 5, "k"), (1, good.replace("word", "other"), None, None, None, "k"), (None, good.replace("word", "third"), "en", "s", 5, None), (2, None, "en", "s", 0, "k"), (3, "", "en", "s", 0, "k"), (4, " ".join(f"wide{i} is here" for i in range(20_000)), "en", "s", 5, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, data), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"], name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert sorted((r["doc_id"] or 0, r["row"] or "") for r in last) == [(0, ""), (1, "k"), (1, "k"), (4, "k")] and all(r["round_trip"] for r in last)
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = staged(stage(spark, empty, data), "t")
        assert empty.count() == 0


def test_pipeline(spark, data):
    docs, columns = read(spark, data, "documents"), read(spark, data, "documents").columns
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(staged(stage(spark, tables[-1], data), "t"))
        assert name == corpus_pipeline.STAGES[-1][0] or tables[-1].columns == columns
    quality, unique, clean, masked, ids = ({r["doc_id"]: r for r in t.collect()} for t in tables[1:])
    assert set(unique) == {v[1] for v in components([(k, r["text"]) for k, r in quality.items()]).values()}
    dirty = contamination([(k, r["text"]) for k, r in unique.items()], [tuple(r) for r in read(spark, data, "benchmark").select("item_id", "text").collect()])
    assert set(clean) == {k for k in unique if not dirty[k][-1]} and set(masked) == set(clean) == set(ids)
    assert all(r["round_trip"] for r in ids.values()) and all(r["n_chars"] == len(r["text"]) for r in masked.values())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, data).collect()} == set(ids)
