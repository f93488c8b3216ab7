"""Golden cases of text rules, matching, cleaning, planning, folding and files."""

import zipfile

import pytest
from pyspark.sql import functions as F

from lexispark.functions import files, markup, text
from lexispark.operators import glossary, state, views
from lexispark.plans import planner, translate
from lexispark.sources import archive, contentlist, json_io, tree

TERM = "pos long, source string, target string, enabled boolean, ambiguous boolean, whole_word boolean, case_sensitive boolean"


def values(spark, rows, *columns):
    df = spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], ", ".join(f"c{i} string" for i in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*columns).collect()]


def test_keys(spark):
    assert values(spark, ["  Hello   World! ", "hello !", "...", "A\u3000b"], text.consistency_key("c0")) == ["hello world", "hello ", "", "a b"]


def test_series(spark):
    v = text.series_variant("c0")
    rows = ["Silver's Hair 9b", "银色发型9b", "Silver's Hair Blonde", "small ring 11", "Customer#000000001", "Box #3", "7", "ab"]
    assert values(spark, rows, v["base"], v["suffix"]) == [("Silver's Hair", "9b"), ("银色发型", "9b"), (None, None), ("small ring", "11"), (None, None), ("Box", "#3"), (None, None), (None, None)]
    assert values(spark, [("银发 9b", "9b"), ("银发9", "9"), ("9", "9"), ("x", "9")], text.strip_target_suffix("c0", "c1")) == ["银发", "银发", None, None]
    assert values(spark, [("银发", "6"), ("盒", "#3"), ("a", "")], text.compose_variant("c0", "c1")) == ["银发 6", "盒#3", "a"]


def test_small_text_functions(spark):
    assert values(spark, ["http://x//"], text.endpoint("c0")) == ["http://x/v1/chat/completions"]
    assert values(spark, ['a<b>&"'], text.escape_attribute("c0")) == ["a&lt;b&gt;&amp;&quot;"]
    assert values(spark, ["  ", " x "], text.style_hint("c0")) == [None, "x"]


def test_cleaning(spark):
    rows = [("Fireball", "火球术"), ("[1] from [2]", "x"), ("--OBEY--", "x"), ("of", "x"), ("'of'", "x"), ("中文", "x"), ("'Danthelon's Dancing Axe'", '"丹瑟隆的飞斧"'), ("'Brake' Lever", '"制动"拉杆')]
    got = glossary.clean(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, source string, target string")).orderBy("pos").collect()
    assert [r["reason"] for r in got] == [None, "placeholder", "dashes", "stop word", None, None, None, None]
    assert [(r["source"], r["target"]) for r in got[4:]] == [("of", "x"), ("中文", "x"), ("Danthelon's Dancing Axe", "丹瑟隆的飞斧"), ("'Brake' Lever", '"制动"拉杆')]


def test_matching(spark):
    terms = [(0, "Lich", "a", True, False, True, False), (1, "ich", "b", True, False, False, False), (2, "lich", "c", True, False, True, True), (3, "Divine Smite", "d", True, False, True, False), (4, "Test", "e", True, True, True, False), (5, "Off", "f", False, False, True, False), (6, "C++", "g", True, False, False, False), (7, "a\\E.b", "h", True, False, True, False)]
    texts = [(0, "a-Lich came"), (1, "中Lich文"), (2, "divine smite, Lich"), (3, "Test Off"), (4, "c++ x"), (5, None), (6, "a\\E.b")]
    got = glossary.matches(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, TERM), "id").collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["id"], []).append(r["target"])
    assert found == {0: ["a", "b"], 1: ["b"], 2: ["d", "a", "b"], 4: ["g"], 6: ["h"]}


def test_edits(spark):
    terms = spark.createDataFrame([(0, "a", "1", "user"), (1, "b", "2", "official"), (2, "a", "3", "user")], "pos long, source string, target string, source_kind string")
    new = spark.createDataFrame([(0, "a", "9"), (1, "z", "8"), (2, " ", "7")], "pos long, source string, target string")
    assert sorted(map(tuple, glossary.upsert(terms.select("pos", "source", "target"), new).collect())) == [(0, "a", "9"), (1, "b", "2"), (2, "a", "3"), (4, "z", "8")]
    assert [r["pos"] for r in glossary.delete(terms, terms.where("source = 'a' OR source = 'b'")).collect()] == [1]
    assert [r["target"] for r in glossary.rename(terms, "b", "c", "5").orderBy("pos").collect()] == ["1", "5", "3"]
    with pytest.raises(KeyError):
        glossary.rename(terms, "none", "c", "5")


def entries(spark, rows):
    return spark.createDataFrame([(i, f"f#{i}", "f", s, t, f"h{i}", "1", "pending", None) for i, (s, t) in enumerate(rows)], "pos long, id string, source_file string, source string, target string, contentuid string, version string, status string, error string")


def test_plan(spark):
    e = entries(spark, [("Red Hair", "红发"), ("red hair 2", ""), ("Blue Hair 1", ""), ("Blue Hair 2", ""), ("Stone", ""), ("stone!", ""), ("RED HAIR", ""), (" ", ""), ("Lone 7", "")])
    resolved, jobs = planner.plan(e)
    assert sorted((r["id"], r["target"]) for r in resolved.collect()) == [("f#1", "红发 2"), ("f#6", "红发")]
    got = sorted((r["kind"], r["base"], [m["id"] for m in r["members"]]) for r in jobs.collect())
    assert got == [("exact_group", "Stone", ["f#4", "f#5"]), ("series", "Blue Hair", ["f#2", "f#3"]), ("single", "Lone 7", ["f#8"])]
    out = {r["id"]: r["target"] for r in planner.fan_out(jobs, F.concat(F.lit("T"), "base")).collect()}
    assert out["f#3"] == "TBlue Hair 2" and out["f#5"] == "TStone"


def test_run_jobs_retries(spark):
    _, jobs = planner.plan(entries(spark, [("Stone", ""), ("Bad", "")]))

    def flaky(prompt, source):
        yield "part"
        if source == "Bad":
            raise ValueError("boom")

    events = translate.run_jobs(jobs.withColumn("prompt", F.lit("p")), flaky, first_wait_s=0.0)
    rows = sorted(events.collect(), key=lambda r: (r["job_pos"], r["seq"]))
    assert [r["type"] for r in rows if r["entryId"] == "f#0"] == ["progress", "delta", "done"]
    assert [r["type"] for r in rows if r["entryId"] == "f#1"] == ["progress", "delta", "delta", "delta", "error"] and rows[-1]["message"] == "boom"


EVENTS = [("e1", "progress"), ("e1", "delta", "x"), ("e1", "delta", "y"), ("e1", "done", "Z"), ("e2", "delta", "p"), ("e2", "error", "boom"), ("e3", "done", "A"), ("e3", "delta", "B"), ("e4", "progress")]
FOLDED = {"e1": ("Z", "translated"), "e2": ("p", "error"), "e3": ("AB", "translating"), "e4": ("", "translating")}


def event_rows(spark):
    rows = [(i, e[0], e[1], "translating", e[2] if len(e) > 2 else None, e[2] if len(e) > 2 else None) for i, e in enumerate(EVENTS)]
    return spark.createDataFrame(rows, "seq long, entryId string, type string, status string, text string, message string").withColumn("ts", F.timestamp_seconds("seq"))


def test_fold(spark):
    got = {r["entryId"]: (r["target"], r["status"]) for r in state.fold(event_rows(spark)).collect()}
    assert got == FOLDED


def test_paths(spark):
    rows = ["Mods/X/Localization/English/a.xml", "meta/a.xml", "Localization/a.xml", "..\\evil.txt", "/evil.txt", "C:/x"]
    c = F.col("c0")
    got = values(spark, rows, files.file_kind(c), files.target_path(c), files.is_safe(c), files.language(c))
    assert got[0] == ("localization-xml", "Mods/X/Localization/Chinese/a.xml", True, "English")
    assert [g[0] for g in got[1:3]] == ["other", "localization-xml"] and got[2][1] == "Localization/a.xml"
    assert [g[2] for g in got[3:]] == [False, False, False]
    assert values(spark, ["d/My.PAK"], files.output_name(c), files.is_archive(c)) == [("My_zh.pak", True)]


def test_content_list_control_characters(spark):
    odd = ["a\x0cb", "nul \x00 us \x1f", "_x000C_", "_x0001\x02_x", "__x_\x01x", "c\r\nd", "\ufffe\uffff<b>_xy</b>", "plain"]
    rows = [(10 * i, "m.n/x.xml", f"h{i}\x01", "1", t, "") for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "pos long, source_file string, contentuid string, version string, source string, target string")
    for span, files in ((None, ["m.n/x.xml"]), (20, [f"m.n/x.part{i}.xml" for i in range(4)])):
        written = contentlist.written_xml(docs, span)
        assert sorted(r["source_file"] for r in written.collect()) == files
        parsed = contentlist.parse(written.select(F.col("source_file").alias("name"), F.lit("localization-xml").alias("kind"), F.col("content").cast("binary").alias("content")))
        got = contentlist.entries(parsed, strict=True).select("contentuid", contentlist.whole_name(F.col("source_file")), "source").collect()
        assert sorted(map(tuple, got)) == sorted((r[2], r[1], r[4]) for r in rows)


def test_content_list_faults(spark):
    raw = b'<contentList><content contentuid="a">1</content><content contentuid="b">\x0c</content><content contentuid="c">3</content><content contentuid="d"><i></content><content contentuid="e">5</content></contentList>'
    rows = contentlist.parse_content_list("f", raw)
    assert [(r[3], r[5]) for r in rows if not r[7]] == [("a", "1"), ("c", "3"), ("e", "5")] and sum(bool(r[7]) for r in rows) == 2
    parsed = spark.createDataFrame(rows, contentlist.PARSED)
    assert contentlist.entries(parsed).count() == 3
    with pytest.raises(Exception, match="not well-formed"):
        contentlist.entries(parsed, strict=True).collect()


def test_content_list_round_trip(spark, tmp_path):
    raw = '<?xml version="1.0" encoding="utf-8"?>\n<contentList><content contentuid="h1" version="2">Cast <LSTag Tag="Fire">Fireball</LSTag> for {1} damage &amp; more<br/></content><content contentuid="h2" version="1"/></contentList>'
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("Localization/English/t.xml", raw)
        z.writestr("../bad.txt", "x")
    members = archive.read_archives(spark, str(tmp_path / "m.zip"))
    assert [r["name"] for r in members.collect()] == ["Localization/English/t.xml"]
    got = contentlist.entries(contentlist.parse(members)).orderBy("pos")
    assert [(r["contentuid"], r["version"], r["source"]) for r in got.collect()] == [("h1", "2", 'Cast <LSTag Tag="Fire">Fireball</LSTag> for {1} damage & more<br/>'), ("h2", "1", "")]
    told = got.withColumn("target", F.when(F.col("source") != "", F.concat(F.lit("【译文】"), "source")).otherwise(""))
    written = contentlist.written_xml(told)
    again = contentlist.entries(contentlist.parse(written.select(F.col("source_file").alias("name"), F.lit("localization-xml").alias("kind"), F.col("content").cast("binary").alias("content"))))
    assert [r["source"] for r in again.orderBy("pos").collect()] == ['【译文】Cast <LSTag Tag="Fire">Fireball</LSTag> for {1} damage & more<br/>', ""]
    zipped = archive.write_archives(written.select(F.lit("a.zip").alias("archive"), F.col("source_file").alias("name"), F.col("content").cast("binary").alias("content")), str(tmp_path / "out")).collect()
    assert [(r["members"], r["bytes"]) for r in zipped] == [(1, (tmp_path / "out/a.zip").stat().st_size)]


def test_faulty_xml_keeps_what_came_before():
    rows = contentlist.parse_content_list("f", b'<contentList><content contentuid="h1" version="1">a</content><content')
    assert rows[0][3:6] == ("h1", "1", "a") and rows[1][-1]


def test_fragments(spark):
    got = values(spark, ['施放 <LSTag Tag="Fire">x</LSTag> & <p> <I> <!-- c --> <br/> </font> a < b'], markup.escape_fragment(F.col("c0")))[0]
    assert '<LSTag Tag="Fire">x</LSTag> &amp; &lt;p&gt; &lt;I&gt;' in got and "<br/> </font> a &lt; b" in got and "&lt;!-- c --&gt;" in got


def test_lsx():
    raw = b'\xef\xbb\xbf<a><attribute id="Description" type="LSString" value="A"/><attribute id="Description" type="LSWString" value="B"/><attribute id="Name" type="LSString" value="C"/><attribute id="Title" type="FixedString" value="D"/><attribute id="Tooltip" type="LSString" value=""/></a>'
    rows = contentlist.parse_lsx("f", raw)
    assert [(r[3], r[5]) for r in rows] == [("Description#0", "A"), ("Description#1", "B")]
    patched = contentlist.patch_lsx(raw, {rows[1][6]: '"x" & y'})
    assert patched.startswith(b"\xef\xbb\xbf") and contentlist.parse_lsx("f", patched)[1][5] == '"x" & y' and contentlist.parse_lsx("f", b"\xff")[0][-1]


def test_json(spark):
    body = '{"terms":[{"source":"a","target":"b","wholeWord":false},{"source":"c","target":"d","case_sensitive":true,"count":3}]}'
    terms = json_io.glossary_terms(spark.createDataFrame([(body,)], "value string")).collect()
    assert [(t["source"], t["whole_word"], t["case_sensitive"], t["enabled"], t["count"]) for t in terms] == [("a", False, False, True, 0), ("c", True, True, True, 3)]
    stream = 'data: {"choices":[{"delta":{"content":"He"}}]}\r\n: x\ndata: {bad\ndata:{"choices":[]}\ndata: {"choices":[{"delta":{"content":"y"}}]}\ndata: [DONE]\n'
    assert "".join(r["text"] for r in json_io.sse_deltas(spark.createDataFrame([(stream,)], "value string")).orderBy("pos").collect()) == "Hey"


def test_views(spark):
    e = entries(spark, [("a", "x"), ("b", " "), ("", "")])
    assert [r["source"] for r in views.only_pending(e).collect()] == [""]
    assert views.retranslate_all(e).where("target = 'x'").count() == 1
    assert views.retranslate_all(e.where("pos = 0")).where("target = ''").count() == 1
    named = spark.createDataFrame([("a/b/c.xml",), ("a/d.xml",)], "name string")
    assert sorted((r["path"], r["is_leaf"]) for r in views.tree(named).collect()) == [("a", False), ("a/b", False), ("a/b/c.xml", True), ("a/d.xml", True)]
    assert [r["name"] for r in views.toggle(named, named.limit(1), False).collect()] == ["a/d.xml"]


def test_inline_tags_stay_as_they_stand():
    body = 'a<b></b>c<br/><b>&lt;b&gt;</b><i x="/"></i><u>/></u><b><!-- - /></b><font\n/>'.replace("<!-- - /></b>", "<!--/>--></b>")
    for encoding in ("utf-8", "utf-16"):
        rows = contentlist.parse_content_list("f", f'<?xml version="1.0" encoding="{encoding}"?><contentList><content contentuid="a">{body}</content></contentList>'.encode(encoding))
        assert [r[5] for r in rows] == ['a<b></b>c<br/><b><b></b><i x="/"></i><u>/></u><b></b><font/>'], encoding


def test_lsx_quotes_and_signs(spark):
    raw = b"""<a><attribute id='Title' type='LSString' value='x > "y"'/><attribute value="1 > 0&#10;z" type="LSString"\n id="Title"></attribute><!-- <attribute id="Title" type="LSString" value="no"/> --></a>"""
    rows = contentlist.parse_lsx("f.lsx", raw)
    assert [(r[3], r[5]) for r in rows] == [("Title#0", 'x > "y"'), ("Title#1", "1 > 0\nz")]
    files = spark.createDataFrame([("f.lsx", bytearray(raw)), ("g.lsx", bytearray(raw))], "name string, content binary")
    told = spark.createDataFrame([("f.lsx", "Title#0", "it's"), ("f.lsx", "Title#1", "")], "source_file string, contentuid string, target string")
    out = {r["name"]: bytes(r["content"]) for r in contentlist.written_lsx(files, told).collect()}
    assert out["g.lsx"] == raw and out["f.lsx"] == raw.replace(b"x > \"y\"", b"it&apos;s")
    assert contentlist.parse_lsx("f", b'<a><attribute id="Title" type="LSString" value="k"/><b')[0][5] == "k" and contentlist.parse_lsx("f", b"<a><b")[0][-1]


def test_broken_and_unsafe_archives(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        for name in ("b/z.PAK", "a/y.pak", "../x"):
            z.writestr(name, name)
    members = archive.read_archives(spark, str(tmp_path / "*.zip"))
    assert sorted((r["name"], r["readable"]) for r in members.collect()) == [("", False), ("a/y.pak", True), ("b/z.PAK", True)]
    assert [r["name"] for r in archive.inner_packages(members).collect()] == ["a/y.pak"]
    with pytest.raises(Exception, match="unsafe path"):
        archive.read_archives(spark, str(tmp_path / "good.zip"), strict=True).collect()


def test_files_are_written(spark, tmp_path):
    xml = '<contentList><content contentuid="h1" version="1">Stone</content></contentList>'
    lsx = '<a><attribute id="Title" type="LSString" value="Stone"/></a>'
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("Localization/English/t.xml", xml)
        z.writestr("meta.lsx", lsx)
        z.writestr("s.lua", "x")
    members = archive.read_archives(spark, str(tmp_path / "m.zip"))
    assert sorted(r["name"] for r in tree.extract(members, str(tmp_path / "all")).collect()) == ["Localization/English/t.xml", "meta.lsx", "s.lua"]
    assert (tmp_path / "all/s.lua").read_text() == "x"
    found = contentlist.entries(contentlist.parse(contentlist.in_order(contentlist.read_files(spark, str(tmp_path / "all")))))
    assert [(r["pos"], r["id"]) for r in found.orderBy("pos").collect()] == [(0, "Localization/English/t.xml#h1"), (1 << 32, "meta.lsx#Title#0")]
    done, events = translate.translate_table(found, json_io.seed(spark))
    assert {r["type"] for r in events.collect()} == {"progress", "delta", "done"}
    tree.write_tree(tree.written(members, done, retarget=True), str(tmp_path / "out"))
    assert "【译文】Stone</content>" in (tmp_path / "out/Localization/Chinese/t.xml").read_text()
    assert 'value="【译文】Stone"' in (tmp_path / "out/meta.lsx").read_text() and not (tmp_path / "out/s.lua").exists()
    with pytest.raises(Exception, match="no copy can be read"):
        tree.extract(members.withColumn("readable", F.lit(False)), str(tmp_path / "none"))


def test_cancel_and_timeout(spark, tmp_path):
    jobs = planner.plan(entries(spark, [("Stone", ""), ("Wood", "")]))[1].withColumn("prompt", F.lit("p"))
    (tmp_path / "stop").touch()
    assert translate.run_jobs(jobs, cancelled=translate.FileFlag(str(tmp_path / "stop"))).count() == 0
    assert translate.run_jobs(jobs, cancelled=translate.FileFlag(str(tmp_path / "go"))).where("type = 'done'").count() == 2

    def slow(prompt, source):
        import time

        time.sleep(0.05)
        yield "x"

    got = translate.run_jobs(jobs, slow, first_wait_s=0.0, timeout_s=0.01).where("type IN ('done', 'error')").collect()
    assert [r["type"] for r in got] == ["error", "error"] and "no answer" in got[0]["message"]


def test_strict_edits(spark):
    terms = spark.createDataFrame([(0, "a", "1", "user"), (1, "b", "2", "official")], "pos long, source string, target string, source_kind string")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "source string")
    assert glossary.delete(terms, names("a"), strict=True).count() == 1
    for source, fault in (("b", "official term: b"), ("z", "no such term: z")):
        with pytest.raises(Exception, match=fault):
            glossary.delete(terms, names(source), strict=True).collect()
    with pytest.raises(Exception, match="blank term"):
        glossary.upsert(terms.select("pos", "source", "target"), spark.createDataFrame([(0, " ", "x")], "pos long, source string, target string"), strict=True).collect()


def test_saved_glossary(spark, tmp_path):
    folder = str(tmp_path / "g")
    first = json_io.load_glossary(spark, folder)
    assert first.count() == len(json_io.SEED) and json_io.load_glossary(spark, folder).count() == len(json_io.SEED)
    json_io.save_glossary(first.where("pos < 2"), folder)
    assert json_io.load_glossary(spark, folder).count() == 2
    (tmp_path / "g" / "x.json").write_text("{broken\n")
    assert json_io.load_glossary(spark, folder).count() == len(json_io.SEED)
    assert json_io.reset_glossary(spark, folder).count() == json_io.load_glossary(spark, folder).count() == len(json_io.SEED)
