"""contentList XML and LSX files: entries from whole-file texts, and files from entries.

One row of a scan is one file. XML is parsed by expat in tasks, a file at a time; the rest is DataFrame functions.

Characters that XML can't hold are written as _x000C_ and read back; an underscore before x is written as _x005F_.
"""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.files import file_kind, safe_or_error
from ..functions.markup import escape_fragment
from ..functions.text import escape_attribute
from ..staging import staged
from . import folders
from .streams import batched, small_batches, write_streams

#: Translatable attributes of LSX files, and their types.
LSX_FIELDS = frozenset(["Description", "DisplayName", "Title", "Tooltip", "TooltipDescription"])
LSX_TYPES = frozenset(["LSString", "LSWString"])
PARSED = "source_file string, file_no long, ordinal long, contentuid string, version string, source string, place long, warning string"


#: Characters that XML 1.0 can't hold, and how they are written.
BARRED = [chr(i) for i in range(32) if i not in (9, 10, 13)] + ["\ufffe", "\uffff"]
STORED = re.compile("_x(00[01][0-9A-F]|FFF[EF]|005F)_")
PART_NAME = r"\.part-?\d+(?=\.[^./]*\z)"


def _storable(x: Column) -> Column:
    """x without characters that XML can't hold; parse_content_list undoes it."""
    marked = F.regexp_replace(x, "_(?=x)", "_x005F_")
    pairs = F.array(*[F.struct(F.lit(c).alias("raw"), F.lit(f"_x{ord(c):04X}_").alias("named")) for c in BARRED])
    barred = F.aggregate(pairs, marked, lambda out, c: F.replace(out, c["raw"], c["named"]))
    return F.when(x.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"), barred).otherwise(marked)


def _restored(x: str) -> str:
    return STORED.sub(lambda m: chr(int(m[1], 16)), x)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """name (below the folder), length, content and kind of every file; folders that can't be read are skipped. Tasks
    list the folder and read its files. A store that only Spark's readers open is listed by the driver, and without
    files of no bytes, which they leave out."""
    known = folders.kind_of(folder) != FileType.Unknown
    files = folders.with_content(folders.files_below(spark, folder), folder) if known else _scanned(spark, folder)
    return files.withColumn("kind", file_kind(F.col("name")))


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    """(name, length, content) by Spark's reader. A small file counts as OPEN_BYTES of a task's bytes, where Spark's own
    setting puts 32 files in a task."""
    reader = spark.newSession()  # a scan is planned by the settings of the session that it was made in
    reader.conf.set("spark.sql.files.openCostInBytes", str(folders.OPEN_BYTES))
    view = f"files_{uuid.uuid4().hex}"
    reader.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(folder).createGlobalTempView(view)
    found = spark.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{view}")
    reader.catalog.dropGlobalTempView(view)
    name = F.regexp_replace("path", "^[a-zA-Z]+:/*", "/")
    root = F.lit(re.sub("^[a-zA-Z]+:/*", "/", folder.rstrip("/")) + "/")
    return found.select(F.replace(name, root, F.lit("")).alias("name"), "length", "content")


def in_order(files: DataFrame) -> DataFrame:
    """files with pos, the place of their names in byte order. Names are sorted in ranges: only the ranges' sizes meet
    in one task, and contents move only where there are too many names to broadcast."""
    names = staged(files.select("name").distinct().repartitionByRange("name").withColumn("part", F.spark_partition_id()))
    before = names.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    return files.drop("pos").join(names.join(before, "part").select("name", (F.col("before") + place).alias("pos")), "name")


def _parsed_run(content: bytes, rows: list[list]) -> tuple[str, int] | None:
    """Adds the entries before the first fault to rows; the fault and its place."""
    state = {"open": None, "depth": 0, "just_opened": False}
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(tag: str, attributes: dict) -> None:
        if state["open"] is None:
            if tag == "content":
                state["open"], state["depth"] = [attributes.get("contentuid", ""), attributes.get("version", "1"), ""], 0
        else:
            state["depth"] += 1
            state["open"][2] += f"<{tag}{''.join(f' {k}="{escape(v, {chr(34): '&quot;'})}"' for k, v in attributes.items())}>"
            state["just_opened"] = True

    def end(tag: str) -> None:
        if state["open"] is not None:
            if state["depth"]:
                state["depth"] -= 1
                ended = parser.CurrentByteIndex  # just after an empty tag, or before an end tag
                if state["just_opened"] and content[max(0, ended - 4) : ended].replace(b"\0", b"").endswith(b"/>"):
                    state["open"][2] = state["open"][2][:-1] + "/>"
                else:
                    state["open"][2] += f"</{tag}>"
                state["just_opened"] = False
            else:
                rows.append(state["open"])
                state["open"] = None

    def text(data: str) -> None:
        if state["open"] is not None:
            state["open"][2] += data
            state["just_opened"] = False

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    try:
        parser.Parse(content, True)
    except expat.ExpatError as fault:
        return str(fault), parser.ErrorByteIndex
    return None


def parse_content_list(name: str, content: bytes) -> list[tuple]:
    """Entries of one file; inner tags stay in the text, with escaped text around them. A fault gives a warning, and
    reading goes on with the next entry after it."""
    rows: list[list] = []
    warnings: list[str] = []
    head, at = b"<contentList>", 0
    fault = _parsed_run(content, rows)
    while fault:
        warnings.append(fault[0])
        found = re.compile(rb"<content\s").search(content, max(at, at + fault[1] - (len(head) if at else 0)))
        if not found:
            break
        at = found.start()
        fault = _parsed_run(head + content[at:], rows)
        if fault and not fault[1]:
            break
    out = [(name, None, i, _restored(uid), _restored(version), _restored(text.strip()), None, None) for i, (uid, version, text) in enumerate(rows)]
    return out + [(name, None, len(out) + i, None, None, None, None, x) for i, x in enumerate(warnings)]


MARK = b"\xef\xbb\xbf"
ATTRIBUTE = re.compile(rb"""<attribute(?:\s+[^\s=<>"']+\s*=\s*(?:"[^"]*"|'[^']*'))*""")
PART = re.compile(rb"""([^\s=<>"']+)\s*=\s*("[^"]*"|'[^']*')""")
REFERENCE = re.compile(r"&[#\w]+;")


def _lsx_tags(content: bytes) -> tuple[list[dict[str, tuple[int, int]]], str | None]:
    """Where the values of each attribute element stand, by name, and the fault that ended the file early."""
    places: list[int] = []
    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler = lambda tag, _: places.append(parser.CurrentByteIndex) if tag == "attribute" else None
    fault = None
    try:
        parser.Parse(content, True)
    except expat.ExpatError as e:
        fault = str(e)
    spans = ({m[1].decode(): (m.start(2) + 1, m.end(2) - 1) for m in PART.finditer(content, at, ATTRIBUTE.match(content, at).end())} for at in places)
    return list(spans), fault


def parse_lsx(name: str, content: bytes) -> list[tuple]:
    """Translatable attributes of one file, numbered per field, with the place of each in the file. A fault, or bytes
    that aren't UTF-8, give a warning after what came before."""
    content = content.removeprefix(MARK)
    tags, fault = _lsx_tags(content)
    out, numbers = [], {}
    for place, tag in enumerate(tags):
        a = {k: REFERENCE.sub(lambda m: html.unescape(m[0]), content[i:j].decode()) for k, (i, j) in tag.items()}
        if a.get("id") in LSX_FIELDS and a.get("type") in LSX_TYPES and a.get("value"):
            n = numbers[a["id"]] = numbers.get(a["id"], -1) + 1
            out.append((name, None, len(out), f"{a['id']}#{n}", "1", a["value"], place, None))
    return out + [(name, None, len(out), None, None, None, None, fault)] * bool(fault)


def parse(files: DataFrame) -> DataFrame:
    """Parsed rows of files (name, kind, content) of text kinds; other kinds have none. A column pos of files, as of
    in_order, is their file_no. Small files share a frame."""

    def rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for name, kind, pos, content in zip(batch["name"], batch["kind"], batch["pos"], batch["content"]):
            found = parse_content_list(name, bytes(content)) if kind == "localization-xml" else parse_lsx(name, bytes(content)) if kind == "metadata-lsx" else []
            yield from ((name, None if pd.isna(pos) else int(pos), *row[2:]) for row in found)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from batched((row for batch in batches for row in rows(batch)), [c.split()[0] for c in PARSED.split(", ")], 5)

    pos = F.col("pos") if "pos" in files.columns else F.lit(None)
    return files.select("name", "kind", pos.cast("long").alias("pos"), "content").mapInPandas(each, PARSED)


def entries(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """Entries of parsed rows; pos orders them by file, then as they stand in it. If strict, a warning is an error.
    Files without a number (see in_order) are ordered by a hash of their names, which two may share."""
    fails = F.raise_error(F.concat_ws(": ", "source_file", "warning")).cast("boolean")
    rows = parsed.where(F.when(F.col("warning").isNull(), True).otherwise(fails if strict else F.lit(False)))
    pos = (F.coalesce("file_no", F.xxhash64("source_file").bitwiseAND((1 << 31) - 1)) * (1 << 32)) + F.col("ordinal")
    return rows.select(pos.alias("pos"), F.concat("source_file", F.lit("#"), "contentuid").alias("id"), "source_file", "source", F.lit("").alias("target"), "contentuid", "version", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"))


#: What cuts a file into records, what an entry starts with, and what may hide either: such files are parsed whole.
CLOSING, ENTRY = "</content>", re.compile(r"<content[\s/>]")
HIDING = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>", re.S)
SUSPECT = re.compile(r"<!--|-->|<!\[CDATA\[|\]\]>|<!DOCTYPE|\x00|\ufffd")
OTHER_CODE = re.compile(r"<\?xml[^>]*encoding\s*=\s*[\"'](?!utf-?8[\"'])", re.I)
RECORDS = f"{PARSED}, block long, suspect boolean"


def _record(name: str, text: str, first: bool, last: bool) -> tuple[list[tuple], bool]:
    """Parsed rows of one record, and whether its file must be parsed whole after all."""
    suspect = bool(SUSPECT.search(HIDING.sub("", text)) or first and OTHER_CODE.search(text) or last and "</contentList" not in text)
    found = ENTRY.search(text)
    if suspect or not found:
        return [], suspect
    body = text[found.start() :] if first else text
    rows = parse_content_list(name, b"<contentList>" + (body + ("" if last else CLOSING + "</contentList>")).encode())
    return rows, any(r[7] for r in rows) and len(ENTRY.findall(body)) > 1  # an entry in an entry, or one that lacks its end


def parse_split(spark: SparkSession, path: str) -> DataFrame:
    """The rows of parse() for the contentList files at path, each file cut at its closing tags and read by as many tasks
    as it has ranges. Rows stand in the file's order: ranges are numbered by their first byte, and only their sizes are
    added up. Files whose records can't be told apart so (comments or CDATA across tags, entries in entries, document
    types, codes other than UTF-8, no end) are parsed whole."""
    text = spark.read.option("lineSep", CLOSING).option("recursiveFileLookup", "true").text(path)
    place = F.col("_metadata.file_block_start"), F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")
    lines = text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), place[0].alias("block"), place[1].alias("ends"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = None, 0

        def parsed(record: tuple, last: bool) -> list[tuple]:
            nonlocal at
            value, name, block, _ = record
            rows, suspect = _record(name, bytes(value).decode("utf-8", "replace"), block == 0 and at == 0, last)
            out = [(*r[:2], at + i, *r[3:], block, suspect) for i, r in enumerate(rows)] or [(name, None, at, None, None, None, None, None, block, suspect)]
            at += len(out)
            return out

        def rows() -> Iterator[tuple]:
            nonlocal held, at
            for batch in batches:
                for record in batch.itertuples(index=False, name=None):
                    if held:
                        ended = held[1:3] != record[1:3]
                        yield from parsed(held, ended and held[3])
                        at = 0 if ended else at
                    held = record
            if held:
                yield from parsed(held, held[3])

        yield from batched(rows(), [c.split()[0] for c in RECORDS.split(", ")], 5)

    with small_batches(spark):
        found = staged(lines.mapInPandas(each, RECORDS))
    blocks = found.groupBy("source_file", "block").agg(F.max("ordinal").alias("most"), F.bool_or("suspect").alias("suspect"))
    file = Window.partitionBy("source_file")
    before = F.sum(F.col("most") + 1).over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("source_file").alias("of"), F.col("block").alias("its"), F.coalesce(before, F.lit(0)).alias("before"), F.max("suspect").over(file).alias("whole"))
    rows = found.join(blocks, (F.col("source_file") == F.col("of")) & (F.col("block") == F.col("its")))
    names = [c.split()[0] for c in PARSED.split(", ")]
    split = rows.where("NOT whole AND (contentuid IS NOT NULL OR warning IS NOT NULL)").withColumn("ordinal", F.col("before") + F.col("ordinal")).select(names)
    odd = blocks.where("whole").select(F.col("of").alias("path")).distinct()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("_metadata.file_path").alias("path"), "content").join(odd, "path", "left_semi")
    every = split.union(parse(files.select(F.col("path").alias("name"), F.lit("localization-xml").alias("kind"), "content")))
    return every.withColumn("source_file", F.url_decode(F.replace("source_file", F.lit("+"), F.lit("%2B"))))


def written_xml(entries: DataFrame, span: int | None = None) -> DataFrame:
    """(source_file, content): a contentList file of each file's entries, in order; untranslated ones keep their source.
    With span, a file for each range of so many pos: x.part0.xml, x.part1.xml; whole_name gives x.xml."""
    if span:
        part = F.concat(F.lit(".part"), F.floor(F.col("pos") / span).cast("string"))
        name = F.regexp_extract("source_file", r"(?s)^(.*?)(\.[^./]*)?\z", 1)
        entries = entries.withColumn("source_file", F.concat(name, part, F.substr("source_file", F.length(name) + 1)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", _line().alias("line")))), lambda x: x["line"])
    return entries.groupBy("source_file").agg(F.concat(F.lit(HEAD), F.array_join(lines, "\n"), F.lit(TAIL)).alias("content"))


HEAD, TAIL = '<?xml version="1.0" encoding="utf-8"?>\n<contentList>\n', "\n</contentList>\n"


def _line() -> Column:
    """An entry's line in its file."""
    text = F.replace(escape_fragment(_storable(F.coalesce(F.nullif("target", F.lit("")), F.col("source")))), F.lit("\r"), F.lit("&#13;"))
    return F.concat(F.lit('  <content contentuid="'), escape_attribute(_storable(F.col("contentuid"))), F.lit('" version="'), escape_attribute(_storable(F.col("version"))), F.lit('">'), text, F.lit("</content>"))


def write_xml(entries: DataFrame, folder: str) -> DataFrame:
    """The files of written_xml below folder, which all executors reach; (path, pieces, bytes) of what was written. Lines
    are made in parallel and sorted by file and pos; the task with a file's lines streams them out, so no file is ever
    one value, and one may be larger than any value can be."""
    lines = entries.select(safe_or_error(F.col("source_file")).alias("name"), "pos", _line().alias("piece"))
    return write_streams(lines, ["pos"], folder, HEAD, "\n", TAIL)


def whole_name(name: Column) -> Column:
    """The name that a file of written_xml is a part of."""
    return F.regexp_replace(name, PART_NAME, "")


def patch_lsx(content: bytes, values: dict[int, str]) -> bytes:
    """One file with new values at the places of its attributes; a byte order mark and all else stay as they are."""
    mark = MARK if content.startswith(MARK) else b""
    content, out, at = content.removeprefix(MARK), [], 0
    for place, tag in enumerate(_lsx_tags(content)[0]):
        if place in values and "value" in tag:
            i, j = tag["value"]
            out += [content[at:i], escape(values[place], {'"': "&quot;", "'": "&apos;"} if content[i - 1 : i] == b"'" else {'"': "&quot;"}).encode()]
            at = j
    return mark + b"".join(out) + content[at:]


def written_lsx(files: DataFrame, translated: DataFrame) -> DataFrame:
    """(name, content): files (name, content) with the non-empty targets (source_file, contentuid, target) put in place."""
    changes = translated.where("target <> ''").groupBy(F.col("source_file").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("contentuid", "target"))).alias("values"))

    def patched(name: str, content: bytes, values: object) -> bytes:
        targets = dict(values) if values is not None else {}
        return patch_lsx(content, {r[6]: targets[r[3]] for r in parse_lsx(name, content) if r[3] in targets}) if targets else content

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "content": [patched(n, bytes(c), x) for n, c, x in zip(batch["name"], batch["content"], batch["values"])]})

    return files.select("name", "content").join(changes, "name", "left").mapInPandas(each, "name string, content binary")
