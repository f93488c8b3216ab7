"""Text joins and series aliases against plain versions, with hot words, suffixes and runs."""

import random
import re

from pyspark.sql import functions as F

from lexispark.functions.text import word_bounded
from lexispark.operators import containment, glossary, memory, series
from lexispark.schema import TERM


def test_contained(spark):
    draw = random.Random(1)
    hay = ["".join(draw.choice("abcé🙂") for _ in range(draw.randint(0, 9))) for _ in range(200)] + ["x" * 3000, "", None]
    needles = ["".join(draw.choice("abcé🙂") for _ in range(draw.randint(1, 5))) for _ in range(80)] + ["x" * 2999, "zz", "", "🙂"]
    got = containment.contained(spark.createDataFrame([(h,) for h in hay + hay], "hay string"), spark.createDataFrame([(n,) for n in needles], "needle string"))
    assert sorted(map(tuple, got.collect())) == sorted({(h, n) for h in hay if h for n in needles if n and n in h})
    assert containment.contained(spark.createDataFrame([("a",)], "hay string"), spark.createDataFrame([], "needle string")).collect() == []


def plain_matches(texts, terms):
    for key, text in texts:
        found = []
        for pos, source, target, _, _, enabled, ambiguous, whole, cased, _ in terms:
            if not enabled or ambiguous or not source or text is None:
                continue
            needle, hay = (source, text) if cased else (source.lower(), text.lower())
            if re.search(rf"\b{re.escape(needle)}\b", hay) if whole else needle in hay:
                found.append((-len(source.encode()), pos, source, target))
        yield from ((key, pos, s, t, rank + 1) for rank, (_, pos, s, t) in enumerate(sorted(found)))


def test_matches_of_all_kinds(spark):
    """Words, several words, parts of words and symbols, all of them frequent; cases, null keys and texts, repeated terms."""
    draw = random.Random(5)
    words = ["the", "of", "The", "ring", "Ring", "rings", "a", "élan", "x1", "中文", "of_the"]
    gaps = [" ", " ", " ", "-", ", ", "  ", "'", "★ "]
    texts = [(None, "the ring of the Ring"), (0, None), (1, ""), (2, "★★"), (3, "the " * 4000 + "last ring")]
    texts += [(10 + i, "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randint(1, 12)))) for i in range(150)]
    sources = ["the", "of the", "The Ring", "ring of", "rin", "ING", "in", "g o", "a", "★", "★ ", ", ", "-the", "the-", "'", "élan x1", "中文", "中", "of the ring of the", "nowhere", "the nowhere", "", "of", "of_", "e r"]
    terms = [(i, s, f"t{i}", "c", "k", i % 13 != 5, i % 17 == 3, i % 2 == 0, (i // 2) % 3 == 0, 0) for i, s in enumerate(sources * 4)]
    got = glossary.matches(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, TERM), "id").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_matches(texts, terms)))


def test_no_anchor_is_hotter_than_it_must(spark, tmp_path):
    """A term of frequent words and a rare one hangs on the rare one; one with a word that no text has on none."""
    texts = spark.createDataFrame([(i, "the ring of fire" + (" unlike" if i == 7 else "")) for i in range(100)], "id long, text string")
    terms = spark.createDataFrame([(0, "the unlike ring", True), (1, "of absent", True), (2, "nlik", False), (3, "of the", True)], "pos long, source string, whole_word boolean")
    usable = terms.select("*", F.lit(False).alias("case_sensitive"), F.col("source").alias("needle"), F.lit(True).alias("worded"), F.split("source", " ").alias("pieces"))
    found = glossary.anchor_tokens(texts, usable, F.split("text", " "), str(tmp_path)).collect()
    assert sorted((r["pos"], r["token"], r["sure"]) for r in found) == [(0, "unlike", False), (2, "unlike", True), (3, "of", False)]


def test_references(spark):
    draw = random.Random(2)
    keys = sorted({" ".join(draw.choice(["iron", "ring", "of", "old", "irons"]) for _ in range(draw.randint(1, 5))) for _ in range(60)})
    known = [(k, k.upper() + "!" * (len(k) % 3), "t") for k in keys if draw.random() < 0.5] + [("ron r", "x", "t")]
    got = memory.references(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(known, "key string, source string, target string"), top=3)
    want = []
    for k in keys:
        held = sorted(((-len(s.encode()), r, s, t) for r, s, t in known if r in k and r != k))[:3]
        want += [(k, i + 1, r, s, t) for i, (_, r, s, t) in enumerate(held)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def plain_overlaps(cjk, latin):
    out = {}
    for base, own in cjk.items():
        best = min(((-len(own & other), -len(other), name) for name, other in latin.items() if len(own & other) >= 2), default=None)
        if best:
            out[base] = best[2]
    return out


def test_aliases_with_hot_suffixes(spark):
    """"1", "2" and "3" are in every base; the rest is drawn from few or many others."""
    draw = random.Random(4)
    pools = [[], ["4", "5"], [str(i) for i in range(4, 16)], [f"{i}b" for i in range(400)]]
    bases = {}
    for i in range(120):
        pool = draw.choice(pools)
        bases[f"base{i}" if i % 2 else f"物{chr(0x4E00 + i)}"] = {"1", "2", "3", *draw.sample(pool, min(len(pool), draw.randint(0, 6)))}
    bases |= {"lone": {"77"}, "独一": {"77"}, "无有": {"88", "1"}}
    rows = [(i, base, suffix, base) for i, (base, suffix) in enumerate((b, s) for b, own in bases.items() for s in own)]
    found = spark.createDataFrame(rows, "pos long, base string, suffix string, base_key string")
    known = series.profiles(found)
    none = found.select("base_key").limit(0)
    got = {r["base_key"]: r["canonical"] for r in series.aliases_by_suffix(found, known, none).collect()}
    latin = {b: s for b, s in bases.items() if b.isascii()}
    assert got == plain_overlaps({b: s for b, s in bases.items() if not b.isascii()}, latin) and len(got) > 50


def test_hot_sets_bound_the_join(spark):
    """With hot suffixes alone, rows of one set are one row however many bases there are."""
    latin = spark.range(5000).selectExpr("array('1', '2', '3') AS suffixes", "concat('b', id) AS canonical", "3 AS m")
    cjk = spark.createDataFrame([(["1", "2", "3"],), (["1", "2"],), (["3"],)], "suffixes array<string>")
    assert sorted((tuple(r["suffixes"]), r["canonical"]) for r in series.best_overlaps(cjk, latin).collect()) == [(("1", "2"), "b0"), (("1", "2", "3"), "b0")]


def test_borders_by_spaces(spark):
    """Between two spaces or not, the answer is that of the pattern."""
    needles = ["red fox", "fox", "-fox", "fox-", "e\u0301", "\u0301", " ", "\\E", "物", "x"]
    texts = ["a red fox ran", "red fox", "a -fox b", "a fox- b", "a e\u0301 b", "a \u0301 b", "the foxes", "foxes fox, x", "a \\E b", "a 物 b", "a  b", " - x - ", "redfox fox"]
    pairs = spark.createDataFrame([(t, n) for t in texts for n in needles], "t string, n string")
    pattern = F.concat(F.lit(r"(?U)\b\Q"), F.replace("n", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    got = pairs.select("t", "n", word_bounded(F.col("t"), F.col("n")).alias("got"), F.regexp_like("t", pattern).alias("want")).collect()
    assert [r for r in got if r["got"] != r["want"]] == [] and sum(r["got"] for r in got) > 8
