"""Small files, jobs and archives share frames: none has one of its own."""

import zipfile

import pandas as pd

from lexispark.plans import translate
from lexispark.sources import archive, contentlist
from lexispark.sources.streams import BATCH_BYTES, batched


class Table:
    """Takes the function of mapInPandas, to call it here."""

    def __init__(self, *columns):
        self.columns = list(columns)

    def select(self, *_):
        return self

    def mapInPandas(self, each, schema):  # noqa: N802
        self.each = each
        return self


def _frames(each, frame):
    return list(each(iter([frame])))


def test_small_files_share_a_frame(spark):
    lsx = b'<save><attribute id="Title" type="LSString" value="x"/></save>'
    files = pd.DataFrame({"name": [f"f{i}" for i in range(600)], "kind": ["metadata-lsx"] * 599 + ["other"], "pos": range(600), "content": [lsx] * 600})
    frames = _frames(contentlist.parse(Table("pos")).each, files)
    assert len(frames) == 1
    assert list(frames[0]["file_no"]) == list(range(599)) and set(frames[0]["contentuid"]) == {"Title#0"}


def test_jobs_share_a_frame():
    jobs = pd.DataFrame({"first_pos": range(100), "kind": "single", "base": "b", "members": [[{"id": str(i), "suffix": None}] for i in range(100)], "prompt": "p"})
    frames = _frames(translate.run_jobs(Table()).each, jobs)
    assert len(frames) == 1 and len(frames[0]) == 400  # progress, two deltas and done of each


def test_archives_share_a_frame(tmp_path):
    for i in range(20):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as z:
            z.writestr("x.txt", "x")
    frames = _frames(archive.directory(Table()).each, pd.DataFrame({"path": [str(tmp_path / f"{i}.zip") for i in range(20)]}))
    assert len(frames) == 1 and len(frames[0]) == 20


def test_frames_are_bounded_by_bytes_too():
    assert [len(f) for f in batched(((b"x" * BATCH_BYTES,) for _ in range(4)), ["content"], 0)] == [2, 2]
    assert list(batched(iter([]), ["content"], 0)) == []


def test_entries_are_keyed_and_remembered_once(spark, data, monkeypatch):
    from lexispark import queries
    from lexispark.operators import memory, series

    built, keyed, stage = [], [], series.staged
    build = memory.build
    monkeypatch.setattr(memory, "build", lambda entries: built.append(1) or build(entries))
    monkeypatch.setattr(series, "staged", lambda df, *under: keyed.append("key" in df.columns and "base" in df.columns) or stage(df, *under))
    queries.translated_table(spark, data)
    queries.prompt(spark, data)
    assert len(built) == 2 and sum(keyed) == 2


def test_no_string_of_a_term_is_gathered(spark, data, monkeypatch):
    from lexispark import queries
    from lexispark.operators import glossary

    gathered, stage = [], glossary.staged
    monkeypatch.setattr(glossary, "staged", lambda df, *under: gathered.extend(t for n, t in df.dtypes if n == "c") or stage(df, *under))
    few = queries.glossary_match_substring(spark, data).collect()
    assert gathered == ["array<bigint>"]
    monkeypatch.setattr(glossary, "FEW_TERMS", 0)
    assert sorted(queries.glossary_match_substring(spark, data).collect()) == sorted(few)


def test_a_list_is_read_and_written_by_small_batches(spark, data, monkeypatch):
    from lexispark import queries
    from lexispark.sources import streams

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, during = spark.conf.get(name), []
    for module in (streams, contentlist):
        stage = module.staged
        monkeypatch.setattr(module, "staged", lambda df, *under, stage=stage: during.append(int(spark.conf.get(name))) or stage(df, *under))
    queries.contentlist_split(spark, data)
    assert during == [BATCH_BYTES, BATCH_BYTES] and spark.conf.get(name) == before
