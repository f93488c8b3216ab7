"""contentList files read by ranges and written by streams, and orders for readers."""

import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import views
from lexispark.sources import contentlist

HEAD = '<?xml version="1.0" encoding="utf-8"?>\n'
LISTS = {
    "plain": HEAD + '<contentList>\n  <content contentuid="a" version="1">Hello</content>\n  <content contentuid="b" version="2">W <LSTag Tag="Fire">x</LSTag> {1} &amp; é🙂<br/></content>\n</contentList>\n',
    "closed": HEAD + '<contentList><content contentuid="a"/><content contentuid="b">1</content><content contentuid="c" version="3"/></contentList>',
    "only closed": '<contentList><content contentuid="a"/><content contentuid="c" version="3"/></contentList>',
    "empty": HEAD + "<contentList></contentList>",
    "faults": '<contentList><content contentuid="a">1</content><content contentuid="b">\x0c</content><content contentuid="c">3</content><content contentuid="d"><i></content><content contentuid="e">5</content></contentList>',
    "spaced": '<contentList date="x">\n<content contentuid="a">1</content ><content contentuid="b">2</content\n>\n<content contentuid="c">3</content></contentList>',
    "comments": '<contentList><!-- <content contentuid="z">old</content> --><content contentuid="a">1<!-- </content> --></content><content contentuid="b"><![CDATA[</content>]]></content><content contentuid="c">a --> b</content></contentList>',
    "small comments": '<contentList><!-- one --><content contentuid="a">1<!-- two --></content><!-- three --><content contentuid="b"><![CDATA[x<y]]></content></contentList>',
    "nested": '<contentList><content contentuid="a">x<content>y</content>z</content><content contentuid="b">2</content></contentList>',
    "type": '<!DOCTYPE contentList [<!ENTITY e "text">]><contentList><content contentuid="a">&e;</content></contentList>',
    "cut": '<contentList><content contentuid="a">1</content><content contentuid="b">2',
    "cut at an end": '<contentList><content contentuid="a">1</content><content contentuid="b">2</content>',
    "begun": '<contentList><content contentuid="h1" version="1">a</content><content',
    "stored": '<contentList><content contentuid="a">_x000C_ _x005F_x000C_</content></contentList>',
    "a+b %41": "<contentList><content contentuid=\"a\">1",
    "many": "<contentList>" + "".join(f'<content contentuid="u{i}">{"x" * (i % 97)}</content>\n' for i in range(3000)) + "</contentList>",
}


@pytest.mark.parametrize("split", ["128m", "700"])
def test_split_equals_whole(spark, tmp_path, split):
    """Every list, cut into few or many ranges."""
    for name, raw in LISTS.items():
        (tmp_path / f"{name}.xml").write_text(raw)
    (tmp_path / "wide.xml").write_bytes(LISTS["plain"].replace('"utf-8"', '"utf-16"').encode("utf-16"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if split == "700" else "4m")
    try:
        got = {}
        for r in contentlist.parse_split(spark, str(tmp_path)).collect():
            got.setdefault(r["source_file"].rpartition("/")[2], []).append((r["ordinal"], r["contentuid"], r["version"], r["source"], bool(r["warning"])))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for file in tmp_path.glob("*.xml"):
        rows = [(r[3], r[4], r[5], bool(r[7])) for r in contentlist.parse_content_list("f", file.read_bytes())]
        ordered = [r[1:] for r in sorted(got.pop(file.name, []))]
        assert [r for r in ordered if not r[3]] == [r for r in rows if not r[3]], file.name
        assert sum(r[3] for r in ordered) == sum(r[3] for r in rows), file.name
    assert got == {}


def test_streamed_lists_are_the_same(spark, tmp_path):
    """Bytes of the streamed files are those of the files as values; unsafe names and empty targets as ever."""
    draw = random.Random(9)
    rows = [(i, f"d/f{i % 3}.xml", f"t{i} < é 🙂 & \x0c", draw.choice(["", "译 <br/> <p>"]), f"u{i}", "1") for i in range(500)]
    entries = spark.createDataFrame(rows, "pos long, source_file string, source string, target string, contentuid string, version string")
    done = contentlist.write_xml(entries, str(tmp_path / "out")).collect()
    want = {r["source_file"]: r["content"].encode() for r in contentlist.written_xml(entries).collect()}
    assert {n: (tmp_path / "out" / n).read_bytes() for n in want} == want
    assert sorted((r["pieces"], r["bytes"]) for r in done) == sorted((sum(x[1] == n for x in rows), len(c)) for n, c in want.items())
    assert len(list((tmp_path / "out/d").iterdir())) == 3
    with pytest.raises(Exception, match="unsafe path"):
        contentlist.write_xml(entries.withColumn("source_file", F.lit("../x.xml")), str(tmp_path / "out"))
    assert contentlist.write_xml(entries.where("false"), str(tmp_path / "none")).collect() == []


def test_orders_for_readers(spark):
    """Folders before files at every level, names by collation; places without one task for all rows."""
    names = ["b.xml", "B.xml", "a/z.xml", "a/é.xml", "a/f.xml", "a/E/x.xml", "Z/q.xml", "_k.xml", "a/e/y.xml"]
    files = spark.createDataFrame([(n, lang) for n, lang in zip(names, ["English", None, "french", "English", None, "Français", "english", "zzz", "de"])], "name string, language string")
    tree = views.numbered(views.tree(files), views.tree_order()).orderBy("place").collect()
    assert [r["path"] for r in tree] == ["a", "a/e", "a/e/y.xml", "a/E", "a/E/x.xml", "a/é.xml", "a/f.xml", "a/z.xml", "Z", "Z/q.xml", "_k.xml", "b.xml", "B.xml"]
    assert [r["path"] for r in views.in_tree_order(views.tree(files)).collect()] == [r["path"] for r in tree]
    by = views.numbered(files, views.language_order(files)).orderBy("place")
    assert [r["language"] for r in by.collect()] == ["de", "english", "English", "English", "Français", "french", "zzz", None, None] and [r["place"] for r in by.collect()] == list(range(1, 10))
    assert [r["name"] for r in views.by_language(files).collect()] == [r["name"] for r in by.collect()]


def test_small_files_share_tasks(spark, tmp_path):
    """More than 32 small files make a task; the session keeps its own settings."""
    cores, own = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.openCostInBytes")
    for i in range(64 * cores):
        (tmp_path / f"f{i}.txt").write_bytes(b"x" * (i + 1))
    files = contentlist.read_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() <= cores + 1
    assert sorted((r["name"], r["length"], len(r["content"])) for r in files.collect()) == sorted((f"f{i}.txt", i + 1, i + 1) for i in range(64 * cores))
    assert spark.conf.get("spark.sql.files.openCostInBytes") == own and files.sparkSession is spark
