"""Archives larger than a batch, read by ranges and written by streams."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lexispark.sources import archive


@pytest.fixture()
def members(spark):
    draw = random.Random(6)
    rows = [(f"{a}.zip", f"d{i % 5}/m{i:03}.txt", bytearray(draw.randbytes(2000) if i % 3 else b"ab" * (i * 40))) for a in "xy" for i in range(60)]
    return spark.createDataFrame(rows + [("x.zip", "../out", bytearray(b"1")), ("x.zip", "none", None), ("z.zip", "empty", bytearray())], "archive string, name string, content binary")


def test_round_trip(spark, members, tmp_path, monkeypatch):
    """Any zip reader opens what is written; reading by many small ranges gives the same; nothing else is left."""
    monkeypatch.setattr(archive, "RANGE_BYTES", 4096)
    done = archive.write_archives(members, str(tmp_path / "out")).collect()
    assert sorted((r["path"][-5:], r["members"]) for r in done) == [("x.zip", 60), ("y.zip", 60), ("z.zip", 1)]
    want = {(r["archive"], r["name"]): bytes(r["content"]) for r in members.where("name <> '../out' AND content IS NOT NULL").collect()}
    for name in "xyz":
        with zipfile.ZipFile(tmp_path / f"out/{name}.zip") as z:
            assert z.testzip() is None and z.namelist() == sorted(z.namelist())
            assert {n: z.read(n) for n in z.namelist()} == {n: c for (a, n), c in want.items() if a == f"{name}.zip"}
    rows = archive.read_archives(spark, str(tmp_path / "out"))
    assert {(r["archive"][-5:], r["name"]): bytes(r["content"]) for r in rows.collect()} == want
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["x.zip", "y.zip", "z.zip"]
    found = archive.directory(spark.read.format("binaryFile").load(str(tmp_path / "out")).select("path"))
    spread = archive.contents(found).withColumn("task", F.spark_partition_id()).where("archive LIKE '%x.zip'")
    assert spread.select("task").distinct().count() > 1  # one archive, several tasks


def test_damaged_members(spark, tmp_path):
    """Each damage is a row of its own, and the others are read."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in "abcde":
            z.writestr(name, name * 500)
        z.writestr("f", b"f" * 500, zipfile.ZIP_BZIP2)
    data = bytearray(out.getvalue())
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        at = {m.filename: m.header_offset for m in z.infolist()}
    data[at["b"]] ^= 255  # its signature
    data[at["d"] + 33] ^= 255  # its bytes
    (tmp_path / "m.zip").write_bytes(data)
    (tmp_path / "half.zip").write_bytes(data[: len(data) // 2])
    rows = {r["name"]: r for r in archive.read_archives(spark, str(tmp_path)).collect()}
    assert {n for n, r in rows.items() if r["readable"]} == {"a", "c", "e"} and rows["c"]["content"] == b"c" * 500
    assert all(rows[n]["error"].startswith("member") for n in "bdf") and rows[""]["error"].startswith("archive")


def test_failed_task_leaves_nothing(spark, members, tmp_path, monkeypatch):
    broken = members.withColumn("content", F.when(F.col("name") == "d2/m042.txt", F.raise_error(F.lit("boom")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="boom"):
        archive.write_archives(broken, str(tmp_path / "out")).collect()
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []
    zip_ = archive._Zip(str(tmp_path / "own/a.zip"), "1.part")
    zip_.add("n", 0, 0, archive.PLAIN, b"")
    zip_.drop()
    assert list((tmp_path / "own").iterdir()) == []


def test_large_numbers():
    """Sizes, places and counts beyond 32 and 16 bits go to the 64-bit fields."""
    big = 5 << 30
    assert archive._extra_64(1, big, big + 1) == ([1, 0xFFFFFFFF, 0xFFFFFFFF], b"\x01\x00\x10\x00" + big.to_bytes(8, "little") + (big + 1).to_bytes(8, "little"))
    head = b"PK\x05\x06"
    assert archive._end(3, 10, 20).startswith(head) and len(archive._end(3, 10, 20)) == 22
    assert len(archive._end(70_000, 10, 20)) == len(archive._end(3, big, 20)) == 56 + 20 + 22
    name = b"n"
    data = archive._central_header(name, 0, big, 7, archive.DEFLATED, big)
    with_end = data + archive._end(1, 0, len(data))
    info = zipfile.ZipFile(io.BytesIO(with_end)).infolist()[0]
    assert (info.file_size, info.compress_size, info.header_offset) == (big, 7, big)
