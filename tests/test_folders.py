"""Folders listed and read by tasks, and file trees written whole."""

import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from lexispark import queries
from lexispark.sources import archive, contentlist, tree


def test_every_file_is_read(spark, tmp_path):
    """Empty and hidden files, and those of folders of any depth, are rows too."""
    want = {"a.txt": b"x", "empty.txt": b"", "_own/.hidden/b c%20.lsx": b"yy", "_own/_c": b"", "src/.txt": b"z", "d=1/e.lua": b"w"}
    for name, content in want.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "lost").symlink_to(tmp_path / "nowhere")
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        rows = contentlist.read_files(spark, folder).collect()
        assert {r["name"]: bytes(r["content"]) for r in rows} == want and len(rows) == len(want)
        assert all(r["length"] == len(r["content"]) for r in rows)
    with pytest.raises(FileNotFoundError):
        contentlist.read_files(spark, str(tmp_path / "nowhere"))


def test_failed_writes_leave_nothing(spark, tmp_path):
    """What a failed task had begun is no file of the folder."""
    (tmp_path / "out/d/a.txt").mkdir(parents=True)  # stands where the file would
    files = spark.createDataFrame([("d/a.txt", bytearray(b"1"))], "name string, content binary")
    with pytest.raises(Exception, match="a.txt"):
        tree.write_tree(files, str(tmp_path / "out"))
    assert contentlist.read_files(spark, str(tmp_path / "out")).collect() == []
    assert [p.name for p in (tmp_path / "out").rglob("*")] == ["d", "a.txt"]


def test_lost_writers_leave_nothing(spark, tmp_path, monkeypatch):
    """What a task had begun that never came back goes when the job has ended."""
    def lost(df, *_):
        jobs = [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
        (tmp_path / "out/d").mkdir()
        (jobs[0] / "task.part").write_text(str(tmp_path / "out/d/task.part"))
        (jobs[0] / "other.part").write_text(str(tmp_path / "out/d/other.part"))  # had nothing begun
        (tmp_path / "out/d/task.part").write_bytes(b"half")
        return stage(df)

    stage = tree.staged
    monkeypatch.setattr(tree, "staged", lost)
    tree.write_tree(spark.createDataFrame([("d/a.txt", bytearray(b"1"))], "name string, content binary"), str(tmp_path / "out"))
    assert [(r["name"], bytes(r["content"])) for r in contentlist.read_files(spark, str(tmp_path / "out")).collect()] == [("d/a.txt", b"1")]


@pytest.mark.parametrize("texts", [["one", "", None, "四"], []])
def test_extracted_files_of_odd_documents(spark, tmp_path, texts):
    """Documents without text are files too, and without documents there are none; as in SQL."""
    rows = [(3 + 7 * i, text, "en", f"src{i % 2}", 0) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = queries.extracted_files(spark, str(tmp_path)).select("name", "kind", "size", "digest").collect()
    assert sorted(map(tuple, found)) == sorted(duck.sql(queries.ORACLE_SQL["extracted_files"]).select("name", "kind", "size", "digest").fetchall())


def test_members_are_read_once_and_not_joined(spark, tmp_path, monkeypatch):
    """Contents go from the archives to the files by one exchange: none is broadcast or goes through the driver."""
    for i in range(3):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as z:
            for name in ("a.txt", f"d/{i}.txt"):
                z.writestr(name, f"{name} of {i}")
    plans, stage = [], tree.staged
    monkeypatch.setattr(tree, "staged", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stage(df))
    members = archive.read_archives(spark, str(tmp_path)).withColumn("pos", F.lit(0))
    written = tree.extract(members, str(tmp_path / "out"))
    assert "Join" not in plans[0] and plans[0].count("content binary") + plans[0].count("MapInPandas") == 2
    assert sorted((r["name"], r["size"]) for r in written.collect()) == [("a.txt", 10), ("d/0.txt", 12), ("d/1.txt", 12), ("d/2.txt", 12)]
    assert (tmp_path / "out/a.txt").read_text() == "a.txt of 2"  # the last archive's


def test_the_last_readable_copy_is_extracted(spark, tmp_path):
    rows = [("a", p, r, bytearray(b"%d" % p) if r else None) for p, r in ((0, True), (2, True), (10, False), (3, True), (11, None))] + [("b", 5, True, bytearray())]
    members = spark.createDataFrame(rows, "name string, pos long, readable boolean, content binary")
    tree.extract(members, str(tmp_path / "out"))
    assert (tmp_path / "out/a").read_bytes() == b"3" and (tmp_path / "out/b").read_bytes() == b""


def test_the_driver_lists_no_files(spark, tmp_path):
    """What Spark scans are lists that tasks have made, of archives as of files."""
    (tmp_path / "_SUCCESS").touch()
    (tmp_path / "none.zip").touch()
    with zipfile.ZipFile(tmp_path / "a b%20.zip", "w") as z:
        z.writestr("x.txt", "x")
    rows = archive.read_archives(spark, str(tmp_path))
    assert sorted((r["archive"], r["name"], r["readable"]) for r in rows.collect()) == [(f"file:{tmp_path}/a b%20.zip", "x.txt", True), (f"file:{tmp_path}/none.zip", "", False)]
    assert archive.read_archives(spark, f"file://{tmp_path}/").count() == 2
    files = contentlist.read_files(spark, str(tmp_path))
    assert all(f.endswith(".parquet") for df in (rows, files) for f in df.inputFiles()) and files.count() == 3


def test_archives_are_extracted_without_an_exchange_of_contents(spark, tmp_path, monkeypatch):
    """Of copies the last archive's last that can be read; contents are in no plan."""
    for i in range(3):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as z:
            for name in ("a.txt", f"d\\{i}.txt", "e", "../out"):
                z.writestr(name, f"{name} of {i}" if name != "e" else "")
    raw = bytearray((tmp_path / "2.zip").read_bytes())
    raw[raw.index(b"a.txt of 2")] ^= 255
    (tmp_path / "2.zip").write_bytes(raw)
    plans, stage = [], tree.staged
    monkeypatch.setattr(tree, "staged", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stage(df))
    written = tree.extract_archives(spark, str(tmp_path), str(tmp_path / "out"))
    assert "content" not in plans[0] and "Join" not in plans[0]
    want = {"a.txt": "a.txt of 1", "d/0.txt": "d\\0.txt of 0", "d/1.txt": "d\\1.txt of 1", "d/2.txt": "d\\2.txt of 2", "e": ""}
    assert {r["name"]: r["size"] for r in written.collect()} == {n: len(x) for n, x in want.items()}
    assert {n: (tmp_path / "out" / n).read_text() for n in want} == want and len(list((tmp_path / "out").iterdir())) == 3
    with pytest.raises(Exception, match="unsafe path"):
        tree.extract_archives(spark, str(tmp_path), str(tmp_path / "out"), strict=True)
    (tmp_path / "3.zip").write_bytes(b"no zip")
    with pytest.raises(Exception, match="no copy can be read"):
        tree.extract_archives(spark, str(tmp_path), str(tmp_path / "none"))


def test_extracted_files_exchange_no_contents(spark, data, monkeypatch):
    used, own = [], tree.extract_archives
    monkeypatch.setattr(tree, "extract_archives", lambda *a: used.append(a) or own(*a))
    assert queries.extracted_files(spark, data).count() == 200 and len(used) == 1
