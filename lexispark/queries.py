"""Queries of the localization operators on the driver's tables, and the same in DuckDB's SQL.

The tables hold no game strings, so entries come from part (numbered names; every fifth as a CJK name), terms from
frequent words, events from events, files from documents. Targets are expressions that both engines have.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import files as FF
from .functions import markup, text
from .operators import glossary, memory, series, state, views
from .plans import planner, translate
from .sources import archive, contentlist, json_io, tree
from .staging import shared_dir, staged
from .streaming import fold, once, sse


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- inputs, as SQL that both engines take -------------------------------------------------------------------

CJK_NAME = "concat('物', translate(p_name, 'abcdefghijklmnopqrstuvwxyz ', '甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄宇'))"
ENTRIES = {
    "pos": "p_partkey",
    "id": "concat('part.xml#', p_partkey)",
    "source_file": "'part.xml'",
    "source": f"CASE WHEN p_partkey % 5 = 0 THEN concat({CJK_NAME}, p_size) ELSE concat(p_name, ' ', p_size) END",
    "target": "CASE WHEN p_partkey % 5 <> 0 AND p_size % 10 = 0 AND (p_name LIKE 'red %' OR p_name LIKE 'old %') THEN concat(upper(p_name), ' ', p_size) ELSE '' END",
    "contentuid": "CASE WHEN p_size % 7 = 0 AND p_name < 'm' THEN concat('u', p_name) ELSE concat('v', p_partkey) END",
}
LANGUAGE = "CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'Chinese' ELSE 'ChineseSimplified' END"
PATH = f"""CASE WHEN doc_id % 4 = 0 THEN concat('Mods/', source, '/Localization/', {LANGUAGE}, '/a', doc_id % 97, '.xml')
 WHEN doc_id % 4 = 1 THEN concat('Mods/', source, '/localization/', {LANGUAGE}, '/b', doc_id % 89, '.loca')
 WHEN doc_id % 4 = 2 THEN concat('Public/', source, '/m', doc_id % 83, '.lsx') ELSE concat('Localization/c', doc_id % 71, '.XML') END"""
FLAGS = "rn % 11 <> 0 AS enabled, rn % 13 = 0 AS ambiguous, {whole} AS whole_word, rn % 7 = 0 AS case_sensitive"
PAGE_SIZE = 20
#: Single words and pairs of words.
TERM_PATTERNS = ['[a-z]{3,12}', '[a-z]{3,12} [a-z]{3,12}']
#: Range of doc_id in one contentList file: 1,024 entries of each of 16 files.
FILE_SPAN = 16 << 10
#: Parts in one LSX file, documents in one zip archive: ranges of their numbers.
LSX_SPAN, ZIP_SPAN = 512, 1024
LSX_LINE = """CASE p_partkey % 3 WHEN 0 THEN concat(translate('<attribute id=~Title~ type=~LSString~ value=~', '~', chr(39)), p_name, ' > &amp; ', p_size, chr(39), '/>')
 WHEN 1 THEN concat('<attribute type="LSWString" handle="x>y" value="', p_name, ' > &amp; ', p_size, '" id="Tooltip" />') ELSE concat('<attribute id="Name" type="LSString" value="', p_name, '"/>') END"""
ODD_NAME = "concat(CASE pos % 5 WHEN 0 THEN '../' WHEN 1 THEN '/' WHEN 2 THEN 'C:/' WHEN 3 THEN 'a/./' ELSE '' END, name, CASE WHEN pos % 2 = 0 THEN '.PAK' ELSE '' END)"
ODD_UID = "CASE p_partkey % 3 WHEN 0 THEN concat('Title#', p_size) WHEN 1 THEN concat('Title#x', p_size) ELSE p_name END"
ODD_VERSION = "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '7' WHEN 2 THEN 'x' ELSE CAST(p_size AS STRING) END"
NOISE = [
    ("Emberwind", "余烬之风"), ("[1] of [22]", "x"), ("Marsh's Edge", "沼泽之缘"), ("[IE_OpenDoor] Knock", "x"), ("[MAGE][THIEF]", "x"), ("--HUSH--", "x"),
    ("of", "x"), ("OF", "x"), ("the", "x"), ("from", "x"), ("Over there", "那边"), ("'of'", "x"), ("''", "x"), ("山川", "shan"), (" Warden ", "守望者"),
    ("'Orrin's Long Spear'", '"奥林的长矛"'), ("'Left' Valve", '"左"阀'), ("", "x"), ("blank", "  "), ("「Wraith」", "『幽魂』"), ("...", "x"), ("Jack-in-the-Green", "x"),
]


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(*[f"{x} AS {c}" for c, x in ENTRIES.items()], "'1' AS version", "'pending' AS status", "CAST(NULL AS STRING) AS error")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").selectExpr("doc_id", f"{PATH} AS name")
    named = rows.groupBy("name").agg(F.min("doc_id").alias("pos"), F.count("*").alias("n_entries"))
    return named.withColumns({"language": FF.language(F.col("name")), "checked": F.col("pos") % 3 == 0})


def _terms(numbered: DataFrame, whole: str) -> DataFrame:
    return numbered.selectExpr("rn AS pos", "CASE WHEN rn % 4 = 0 THEN upper(word) ELSE word END AS source", "concat('T', rn) AS target", *FLAGS.format(whole=whole).split(", "))


def document_terms(spark: SparkSession, sf_dir: str, whole: str = "rn % 5 <> 0") -> DataFrame:
    """All words of the benchmark's items, and all pairs of them beside each other, numbered by their first place."""
    items = read(spark, sf_dir, "benchmark")
    found = [items.select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("place", "word")).select("word", F.expr(f"(item_id * 16777216 + place) * 2 + {i}").alias("rn")) for i, pattern in enumerate(TERM_PATTERNS)]
    return _terms(reduce(DataFrame.union, found).groupBy("word").agg(F.min("rn").alias("rn")), whole)


def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of parts' names, numbered by the first part and place."""
    found = read(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "word"))
    return _terms(found.groupBy("word").agg(F.min(F.expr("p_partkey * 5 + place")).alias("rn")), "rn % 3 <> 0")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(read(spark, sf_dir, "events"))


def _events(table: DataFrame) -> DataFrame:
    return table.selectExpr(
        "ts", "event_id AS seq", "CAST(user_id AS STRING) AS entryId",
        "CASE event_type WHEN 'signup' THEN 'progress' WHEN 'view' THEN 'delta' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'edit' END AS type",
        "CASE WHEN event_type = 'signup' THEN 'translating' END AS status", "concat(event_type, event_id, ';') AS text", "concat('m', event_id) AS message",
    )


# ---- queries ---------------------------------------------------------------------------------------------------


def glossary_match(spark, d):
    return glossary.matches(read(spark, d, "documents"), document_terms(spark, d), "doc_id")


def glossary_match_substring(spark, d):
    return glossary.matches(read(spark, d, "documents"), document_terms(spark, d, "rn < 0"), "doc_id").groupBy("source", "target").agg(F.count("*").alias("n_texts"), F.sum("rank").alias("ranks"))


def _noise(spark):
    return spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(NOISE)], "pos long, source string, target string")


def glossary_clean(spark, d):
    return glossary.clean(_noise(spark).unionByName(part_terms(spark, d).select(F.col("pos") + 100, "source", "target").toDF("pos", "source", "target")))


def glossary_clean_stats(spark, d):
    return glossary.clean_stats(glossary_clean(spark, d))


def consistency_key(spark, d):
    return read(spark, d, "documents").select("doc_id", text.consistency_key("text").alias("key"))


def exact_groups(spark, d):
    keyed = read(spark, d, "documents").select("doc_id", "text", text.consistency_key("text").alias("key"))
    groups = keyed.groupBy(F.md5("key").alias("hash")).agg(F.min("doc_id").alias("first_pos"), F.count("*").alias("n"))
    return groups.join(keyed, F.col("doc_id") == F.col("first_pos")).select("key", "first_pos", "n", F.col("text").alias("source"))


def series_split(spark, d):
    return entries(spark, d).withColumn("v", text.series_variant("source")).select("id", F.col("v.base").alias("base"), F.col("v.suffix").alias("suffix"))


def series_profiles(spark, d):
    return series.profiles(series.variants(entries(spark, d)))


def series_alias(spark, d):
    return series.aliases(entries(spark, d))


def memory_build(spark, d):
    return memory.build(entries(spark, d))


def memory_refs_top12(spark, d):
    return memory.references(entries(spark, d).select(text.consistency_key("source").alias("key")), memory.build(entries(spark, d)))


def _jobs(spark, d):
    ids = F.array_join(F.transform("members", lambda m: F.concat(m["id"], F.lit(":"), F.coalesce(m["suffix"], F.lit("")))), ",")
    return planner.plan(entries(spark, d))[1].select("kind", "base", "first_pos", F.size("members").cast("long").alias("n_members"), ids.alias("members"))


def plan_resolved(spark, d):
    return planner.plan(entries(spark, d))[0]


def fanout(spark, d):
    return planner.fan_out(planner.plan(entries(spark, d))[1], F.concat(F.lit("【译文】"), F.col("base")))


def prompt(spark, d):
    _, jobs, known = planner.planned(entries(spark, d))
    return planner.requests(jobs, part_terms(spark, d), known, F.lit("  short names ")).select("kind", "first_pos", "prompt")


def event_fold(spark, d):
    return state.fold(events(spark, d))


def progress(spark, d):
    return state.progress(event_fold(spark, d))


def pending_filter(spark, d):
    return planner.pending(entries(spark, d)).select("id", "source")


def search(spark, d):
    return views.search(read(spark, d, "documents"), " TION ", "text", "lang", "source").select("doc_id", "lang")


def classify_files(spark, d):
    name = F.col("name")
    return views.classified(files(spark, d)).select("name", "kind", "language", FF.short_source(name).alias("short"), FF.target_path(name).alias("target"), FF.write_priority(F.col("language")).cast("long").alias("priority"), FF.is_safe(name).alias("safe"))


def write_plan(spark, d):
    return views.write_plan(files(spark, d)).withColumn("priority", F.col("priority").cast("long"))


def folder_rollup(spark, d):
    return views.folder_rollup(files(spark, d))


def latest_readable(spark, d):
    labels = read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    copies = read(spark, d, "documents").join(labels, "doc_id", "left").select(F.concat("source", F.lit("/"), "lang").alias("name"), F.col("doc_id").alias("pos"), (F.coalesce("quality", F.lit(0)) == 1).alias("readable"))
    return views.latest_readable(copies)


def inline_tags(spark, d):
    found = read(spark, d, "pages").select(F.explode(markup.tags(F.col("html"))).alias("tag"))
    return found.groupBy(markup.tag_name(F.col("tag")).alias("name"), markup.is_inline_tag(F.col("tag")).alias("inline")).agg(F.count("*").alias("n"))


def glossary_page(spark, d):
    return glossary.page(document_terms(spark, d), PAGE_SIZE, 2).select("pos", "source", "target")


def _edits(spark, d):
    return part_terms(spark, d).where("pos % 4 = 1").select("pos", F.when(F.col("pos") % 8 == 1, F.col("source")).otherwise(F.concat("source", F.lit("s"))).alias("source"), F.concat("target", F.lit("!")).alias("target"))


def glossary_upsert(spark, d):
    return glossary.upsert(part_terms(spark, d).select("pos", "source", "target"), _edits(spark, d))


def glossary_delete(spark, d):
    terms = part_terms(spark, d).withColumn("source_kind", F.when(F.col("pos") % 5 == 0, "official").otherwise("user"))
    return glossary.delete(terms, terms.where("pos % 3 = 0").select("source")).select("pos", "source", "target")


def _document_entries(spark, d):
    """Documents between inline tags as entries of 16 files a source."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.concat("source", F.lit("-"), F.col("doc_id") % 16, F.lit("/Localization/x.xml")).alias("source_file"), F.concat(F.lit("h"), "doc_id").alias("contentuid"), F.lit("1").alias("version"), F.concat(F.lit('Cast <LSTag Tag="'), F.col("doc_id"), F.lit('">'), text.ws_trim("text"), F.lit("</LSTag><br/><b></b> 1 < 2 & 3")).alias("source"), F.lit("").alias("target"))


def contentlist_roundtrip(spark, d):
    """Documents between inline tags as entries, written as contentList files and parsed again."""
    docs = _document_entries(spark, d)
    written = contentlist.written_xml(docs, span=FILE_SPAN).select(F.col("source_file").alias("name"), FF.file_kind(F.col("source_file")).alias("kind"), F.col("content").cast("binary").alias("content"))
    return contentlist.entries(contentlist.parse(written), strict=True).select("contentuid", contentlist.whole_name(F.col("source_file")).alias("source_file"), F.length("source").alias("n_chars"), F.md5(F.col("source").cast("binary")).alias("digest"))


def contentlist_split(spark, d):
    """The same entries in whole files that tasks stream out, read again by several tasks a file."""
    docs = _document_entries(spark, d)
    folder = f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}"
    contentlist.write_xml(docs, folder)
    rows = contentlist.entries(contentlist.parse_split(spark, folder), strict=True)
    order = F.row_number().over(Window.partitionBy("source_file").orderBy("pos")).cast("long")
    return rows.select("contentuid", F.regexp_extract("source_file", r"([^/]+/[^/]+/[^/]+)\z", 1).alias("source_file"), order.alias("place"), F.md5(F.col("source").cast("binary")).alias("digest"))


SSE = r"""concat('data: {"choices":[{"delta":{"content":"', event_type, event_id, '"}}]}\r\n: note\ndata: {bad\ndata: {"choices":[{"delta":{"content":"!"}}]}\ndata: [DONE]\n')"""


def sse_deltas(spark, d):
    return json_io.sse_deltas(read(spark, d, "events").selectExpr("event_id", f"{SSE} AS value"), keep=["event_id"])


def sse_stream(spark, d):
    """The same in one body a user, in chunks of 7 bytes, which cut lines and characters; put together by a stream."""
    table = spark.readStream.schema(read(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/[e]vents.parquet")
    bodies = table.selectExpr("CAST(user_id AS STRING) AS body", "event_id", f"CAST(replace({SSE}, '!', '→…') AS BINARY) AS data")
    cuts = bodies.select("body", "event_id", "data", F.explode(F.expr("sequence(0, octet_length(data) div 7)")).alias("i"))
    chunks = cuts.selectExpr("body", "event_id * 1024 + i AS seq", "substring(data, CAST(i AS INT) * 7 + 1, 7) AS chunk")
    return once.drained(sse.delta_stream(chunks)).select(F.col("body").cast("long").alias("user_id"), "pos", "text")


def fragment_escape(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(markup.escape_fragment(F.col("html")).cast("binary")).alias("digest"))


def retranslate_all(spark, d):
    """Once with pending entries, which changes nothing, and once without."""
    some = entries(spark, d)
    return views.retranslate_all(some).union(views.retranslate_all(some.where("target <> ''"))).select("id", "target", "status", "error")


def _numbered_entries(spark, d):
    return entries(spark, d).withColumn("id", F.col("pos").cast("string"))


def _middle(spark, d):
    return read(spark, d, "events").agg(F.max("event_id")).first()[0] // 2


def cancelled(spark, d):
    """Entries by number if the run of the users' events was cancelled halfway."""
    return state.cancel(_numbered_entries(spark, d), events(spark, d), _middle(spark, d)).select("id", "target", "status", "error")


def event_stream(spark, d):
    """The same run as a stream that starts from the entries: those that its events and the cancel changed."""
    table = spark.readStream.schema(read(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/[e]vents.parquet")
    stop = "event_id = {}".format(_middle(spark, d))
    log = _events(table).withColumns({"type": F.when(F.expr(stop.replace("event_id", "seq")), "cancel").otherwise(F.col("type")), "ts": F.timestamp_seconds("seq")})
    return once.drained(fold.fold_stream(log, _numbered_entries(spark, d)), ["run", "entryId"]).drop("run")


def reverted(spark, d):
    return state.fold(events(spark, d).withColumn("type", F.when((F.col("type") == "edit") & (F.col("seq") % 2 == 0), "revert").otherwise(F.col("type"))))


def applied_events(spark, d):
    """Entries by number, with the state of the events of the users of these numbers."""
    return state.apply_to(_numbered_entries(spark, d), events(spark, d)).select("id", "target", "status", "error")


def tree_nodes(spark, d):
    return views.in_tree_order(views.tree(files(spark, d)))


def language_places(spark, d):
    """Each file's place by language and name, as readers sort them."""
    return views.numbered(files(spark, d).select("name", "language"), views.language_order(files(spark, d))).select("name", "place")


def tree_places(spark, d):
    """Each node's place in the unfolded tree."""
    return views.numbered(views.tree(files(spark, d)), views.tree_order()).select("path", "is_leaf", "place")


def selection(spark, d):
    """Checked files with the English ones added, and with them taken away."""
    shown, checked = files(spark, d).where("language = 'English'"), files(spark, d).where("checked")
    return views.toggle(checked, shown, True).withColumn("on", F.lit(True)).union(views.toggle(checked, shown, False).select("name", F.lit(False)))


def selected_entries(spark, d):
    return views.selected(read(spark, d, "documents").selectExpr("doc_id", f"{PATH} AS source_file"), files(spark, d).where("checked"))


def entry_views(spark, d):
    found = {"work": views.work_items(entries(spark, d)).select("id"), "open": views.only_pending(entries(spark, d)).select("id"), "terms": glossary.search(part_terms(spark, d), " RE ").select(F.col("pos").cast("string")), "files": views.localization_only(views.classified(files(spark, d))).select("name")}
    return reduce(DataFrame.union, [rows.select(F.lit(name).alias("view"), F.col(rows.columns[0]).alias("id")) for name, rows in found.items()])


def glossary_rename(spark, d):
    terms = part_terms(spark, d).select("pos", "source", "target")
    return glossary.rename(terms, terms.orderBy("pos").first()["source"], "crimson", "R!")


def glossary_remaining(spark, d):
    return glossary.remaining(part_terms(spark, d), PAGE_SIZE, 1)


def path_rules(spark, d):
    name = F.col("name")
    return files(spark, d).selectExpr(f"{ODD_NAME} AS name").select("name", FF.is_safe(name).alias("safe"), FF.is_archive(name).alias("archive"), FF.output_name(name).alias("output"))


def small_rules(spark, d):
    rows = read(spark, d, "part").selectExpr("p_partkey", "p_size", f"{ODD_UID} AS uid", f"{ODD_VERSION} AS version").withColumn("place", text.lsx_place("uid"))
    return rows.select("p_partkey", F.col("place.field").alias("field"), F.col("place.n").alias("n"), text.version_number("version").alias("version"), text.percent(F.col("p_size") - 5, F.lit(40)).alias("percent"))


def file_order(spark, d):
    return contentlist.in_order(files(spark, d).select("name"))


def lsx_patch(spark, d):
    """Parts as LSX files; their titles translated in place, and the files parsed again."""
    rows = read(spark, d, "part").selectExpr("p_partkey", f"concat('m', p_partkey div {LSX_SPAN}, '.lsx') AS name", f"{LSX_LINE} AS line")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"])
    content = F.concat(F.lit("<save>\n"), F.array_join(lines, "\n"), F.lit("\n</save>\n"))
    made = rows.groupBy("name").agg(content.cast("binary").alias("content")).withColumn("kind", FF.file_kind(F.col("name")))
    found = contentlist.entries(contentlist.parse(made), strict=True)
    told = found.withColumn("target", F.when(F.col("contentuid").startswith("Title"), F.upper("source")).otherwise(""))
    written = tree.written(made, told).withColumn("kind", FF.file_kind(F.col("name")))
    return contentlist.entries(contentlist.parse(written), strict=True).select("source_file", "contentuid", "source")


def zip_members(spark, d):
    """Documents as members of zip archives, packed and opened again."""
    docs = read(spark, d, "documents").select(F.concat(F.lit("a"), F.floor(F.col("doc_id") / ZIP_SPAN)).alias("archive"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    folder = f"{shared_dir(spark)}/zips-{uuid.uuid4().hex}"
    archive.write_archives(docs, folder)
    return archive.read_archives(spark, folder).select(F.regexp_extract("archive", r"([^/]+)\z", 1).alias("archive"), "name", "size", F.md5("content").alias("digest"))


def _members(spark, d):
    """Documents as members of archives; every other name has backslashes, some are packages."""
    name = F.concat("source", F.when(F.col("doc_id") % 2 == 0, F.lit("/")).otherwise(F.lit("\\")), "doc_id", F.when(F.col("doc_id") % 10 == 3, ".PAK").otherwise(".txt"))
    return read(spark, d, "documents").select(F.concat(F.lit("a"), F.floor(F.col("doc_id") / 64), F.lit(".zip")).alias("archive"), name.alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def inner_packages(spark, d):
    return archive.inner_packages(_members(spark, d).withColumn("name", FF.normalized_path(F.col("name"))))


def extracted_files(spark, d):
    """The archives written, read, extracted below a folder, and what that folder holds then."""
    top = f"{shared_dir(spark)}/extract-{uuid.uuid4().hex}"
    archive.write_archives(_members(spark, d), f"{top}/zips")
    tree.extract_archives(spark, f"{top}/zips", f"{top}/files")
    return contentlist.read_files(spark, f"{top}/files").select("name", "kind", F.col("length").alias("size"), F.md5("content").alias("digest"))


LSX_FILE = """concat('<save><attribute id="Title" type="LSString" value="', p_name, '"/></save>')"""


def lsx_bytes(spark, d):
    """A file a part: with a byte order mark, without, and with a byte that is no UTF-8."""
    content = f"CASE p_partkey % 3 WHEN 0 THEN concat(unhex('EFBBBF'), CAST({LSX_FILE} AS BINARY)) WHEN 1 THEN CAST({LSX_FILE} AS BINARY) ELSE concat(unhex('FF'), CAST({LSX_FILE} AS BINARY)) END"
    made = read(spark, d, "part").selectExpr("concat('m', p_partkey, '.lsx') AS name", "'metadata-lsx' AS kind", f"{content} AS content")
    return contentlist.parse(made).select("source_file", "contentuid", "source", F.col("warning").isNotNull().alias("warned"))


def file_faults(spark, d):
    """A contentList file a document; every seventh ends within a tag, which costs no more than that."""
    tail = "CASE WHEN doc_id % 7 = 0 THEN '<content' ELSE '</contentList>' END"
    made = read(spark, d, "documents").selectExpr("concat('f', doc_id, '.xml') AS name", "'localization-xml' AS kind", f"CAST(concat('<contentList><content contentuid=\"', doc_id, '\">', lang, '</content>', {tail}) AS BINARY) AS content")
    parsed = staged(contentlist.parse(made))  # read twice
    faults = parsed.groupBy("source_file").agg(F.count("warning").alias("n_faults"))
    return contentlist.entries(parsed).join(faults, "source_file").select("id", "source", "version", "n_faults")


def saved_glossary(spark, d):
    """Terms saved and loaded again."""
    folder = f"{shared_dir(spark)}/glossary-{uuid.uuid4().hex}"
    terms = part_terms(spark, d).withColumns({"category": F.lit("x"), "source_kind": F.lit("user"), "count": F.col("pos") % 7})
    json_io.save_glossary(terms, folder)
    return json_io.load_glossary(spark, folder).select(*json_io.TERM_COLUMNS)


def request_rules(spark, d):
    base = F.concat(F.lit("http://h/"), "p_name", F.repeat(F.lit("/"), F.col("p_size") % 3))
    return read(spark, d, "part").select("p_partkey", text.clamp_concurrency(F.col("p_size") * 3 - 10).cast("long").alias("concurrency"), text.endpoint(base).alias("endpoint"))


def translatable_files(spark, d):
    return views.localization_only(views.classified(files(spark, d))).groupBy("kind").agg(F.count("*").alias("n"))


def translated_table(spark, d):
    return translate.translate_table(entries(spark, d), part_terms(spark, d))[0].select("id", "target", "status", "error")


def _fails_on_r(prompt: str, source: str) -> Iterator[str]:
    if source.startswith("r"):
        raise ValueError(source)
    yield source


def run_totals(spark, d):
    """Totals of a run whose translator fails on some sources."""
    events = translate.translate_table(entries(spark, d), part_terms(spark, d), _fails_on_r, first_wait_s=0.0)[1]
    return state.finished(entries(spark, d), events)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__.lstrip("_"): f
    for f in (
        glossary_match, glossary_match_substring, glossary_clean, glossary_clean_stats, consistency_key, exact_groups, series_split, series_profiles, series_alias, memory_build, memory_refs_top12,
        plan_resolved, fanout, prompt, event_fold, progress, pending_filter, search, classify_files, write_plan, folder_rollup, latest_readable, inline_tags, glossary_page, glossary_upsert, glossary_delete, contentlist_roundtrip,
        sse_deltas, sse_stream, event_stream, fragment_escape, retranslate_all, cancelled, reverted, applied_events, tree_nodes, selection, selected_entries, entry_views, glossary_rename, glossary_remaining,
        path_rules, small_rules, file_order, lsx_patch, zip_members, contentlist_split, language_places, tree_places, inner_packages, extracted_files, lsx_bytes, file_faults, saved_glossary, request_rules, translatable_files, translated_table, run_totals,
    )
} | {"plan_jobs": _jobs}

# ---- the same in DuckDB ----------------------------------------------------------------------------------------

WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
PUNCT = r"[!-/:-@\[-`{-~]"
CJK = "[㐀-䶿一-鿿豈-﫿]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _key(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({_trim(x)}, '{WS}+', ' ', 'g'), '^{PUNCT}+|{PUNCT}+$', '', 'g'))"


def _valid(base: str, suffix: str) -> str:
    return rf"(strlen({base}) >= 3 AND regexp_matches({base}, '\p{{L}}') AND regexp_matches({suffix}, '^#*[()\[\]{{}}]*[A-Za-z0-9_-]{{1,8}}[()\[\]{{}}]*$') AND regexp_matches({suffix}, '[0-9]'))"


E_CTE = f"entries AS (SELECT {', '.join(f'{x} AS {c}' for c, x in ENTRIES.items())} FROM part)"
SPLIT_CTE = rf"""cut AS (SELECT *, regexp_extract(t, '(?s)^(.*){WS}(\S+)$', 1) AS a0, regexp_extract(t, '(?s)^(.*){WS}(\S+)$', 2) AS a2,
 regexp_extract(t, '(?s)^(.*?)([A-Za-z0-9]+)$', 1) AS b0, regexp_extract(t, '(?s)^(.*?)([A-Za-z0-9]+)$', 2) AS b2 FROM (SELECT *, {_trim("source")} AS t FROM entries)),
cut2 AS (SELECT *, {_trim("a0")} AS a1, {_trim("b0")} AS b1 FROM cut),
split AS (SELECT * EXCLUDE (t, a0, a1, a2, b0, b1, b2), CASE WHEN {_valid("a1", "a2")} THEN a1 WHEN regexp_matches(b1, '{CJK}') AND {_valid("b1", "b2")} THEN b1 END AS base,
 CASE WHEN {_valid("a1", "a2")} THEN a2 WHEN regexp_matches(b1, '{CJK}') AND {_valid("b1", "b2")} THEN b2 END AS suffix FROM cut2)"""
VARIANTS_CTE = f"variants AS (SELECT * FROM (SELECT *, {_key('base')} AS base_key FROM split WHERE base IS NOT NULL) WHERE base_key <> '')"
PROFILES_CTE = f"profiles AS (SELECT base_key, arg_min(base, (pos, base)) AS base_source, count(DISTINCT lower({_trim('suffix')})) AS n_suffixes, bool_or(regexp_matches(base, '[A-Za-z]')) AS has_latin, bool_or(regexp_matches(base, '{CJK}')) AS has_cjk FROM variants GROUP BY base_key)"
ALIAS_CTE = f"""shared AS (SELECT DISTINCT contentuid, v.base_key, p.* EXCLUDE (base_key) FROM variants v JOIN profiles p ON p.base_key = v.base_key WHERE {_trim("contentuid")} <> ''),
chosen AS (SELECT contentuid, base_key AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY contentuid ORDER BY n_suffixes DESC, strlen(base_source) DESC, base_key DESC) AS r FROM shared WHERE has_latin) WHERE r = 1),
by_content AS (SELECT base_key, arg_min(canonical, contentuid) AS canonical FROM shared JOIN chosen USING (contentuid) WHERE has_cjk AND base_key <> canonical GROUP BY base_key),
suf AS (SELECT DISTINCT base_key, lower({_trim("suffix")}) AS s FROM variants),
overlap_rows AS (SELECT c.base_key, l.base_key AS canonical, count(*) AS n, any_value(pl.n_suffixes) AS m FROM suf c JOIN profiles pc ON pc.base_key = c.base_key AND pc.has_cjk AND NOT pc.has_latin JOIN suf l ON l.s = c.s JOIN profiles pl ON pl.base_key = l.base_key AND pl.has_latin
 WHERE c.base_key NOT IN (SELECT base_key FROM by_content) GROUP BY 1, 2 HAVING count(*) >= 2),
by_suffix AS (SELECT base_key, canonical FROM (SELECT *, row_number() OVER (PARTITION BY base_key ORDER BY n DESC, m DESC, canonical) AS r FROM overlap_rows) WHERE r = 1),
alias AS (SELECT base_key, canonical, 'contentuid' AS rule FROM by_content UNION ALL SELECT base_key, canonical, 'suffix' FROM by_suffix)"""
_LEFT = f"regexp_replace(substring({_trim('target')}, 1, length({_trim('target')}) - length({_trim('suffix')})), '({WS}|[-_#：:])+$', '')"
MEMORY_CTE = f"""told AS (SELECT pos, 0 AS ord, {_trim("source")} AS source, {_trim("target")} AS target FROM split WHERE {_trim("source")} <> '' AND {_trim("target")} <> ''
 UNION ALL SELECT pos, 1, base, {_LEFT} FROM split WHERE {_trim("source")} <> '' AND {_trim("target")} <> '' AND base IS NOT NULL AND ends_with({_trim("target")}, {_trim("suffix")})),
memory AS (SELECT key, source, target FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos, ord) AS r FROM (SELECT *, {_key("source")} AS key FROM told WHERE source <> '' AND target <> '') WHERE strlen(key) >= 3) WHERE r = 1)"""
COMPOSE = lambda base, s: f"CASE WHEN {s} = '' THEN {base} WHEN regexp_matches({s}, '^{PUNCT}') THEN {base} || {s} ELSE {base} || ' ' || {s} END"
BASE_CTES = ",\n".join((E_CTE, SPLIT_CTE, VARIANTS_CTE, PROFILES_CTE, ALIAS_CTE, MEMORY_CTE))
PLAN_CTE = f"""open AS (SELECT * FROM split WHERE {_trim("source")} <> '' AND {_trim("target")} = ''),
named AS (SELECT o.*, coalesce(a.canonical, o.raw_key) AS k FROM (SELECT *, {_key("base")} AS raw_key FROM open WHERE base IS NOT NULL) o LEFT JOIN alias a ON a.base_key = o.raw_key WHERE o.raw_key <> ''),
joined AS (SELECT n.*, coalesce(p.base_source, n.base) AS named_base, m.target AS known FROM named n LEFT JOIN profiles p ON p.base_key = n.k LEFT JOIN memory m ON m.key = n.k),
grouped AS (SELECT k, arg_min(named_base, pos) AS base, min(pos) AS first_pos, count(*) AS n_members, string_agg(id || ':' || suffix, ',' ORDER BY pos) AS members FROM joined WHERE known IS NULL GROUP BY k HAVING count(*) >= 2),
used AS (SELECT id FROM joined WHERE known IS NOT NULL OR k IN (SELECT k FROM grouped)),
rest AS (SELECT o.*, o.k2 AS key, m.target AS known FROM (SELECT *, {_key("source")} AS k2 FROM open) o LEFT JOIN memory m ON m.key = o.k2 WHERE o.id NOT IN (SELECT id FROM used)),
alike AS (SELECT key, arg_min(source, pos) AS base, min(pos) AS first_pos, count(*) AS n_members, string_agg(id || ':', ',' ORDER BY pos) AS members FROM rest WHERE known IS NULL GROUP BY key),
jobs AS (SELECT 'series' AS kind, base, first_pos, n_members, members FROM grouped UNION ALL SELECT CASE WHEN n_members > 1 THEN 'exact_group' ELSE 'single' END, base, first_pos, n_members, members FROM alike)"""
TERM_COLUMNS = "rn AS pos, CASE WHEN rn % 4 = 0 THEN upper(word) ELSE word END AS source, concat('T', rn) AS target, "
PART_TERMS_CTE = f"terms AS (SELECT {TERM_COLUMNS}{FLAGS.format(whole='rn % 3 <> 0')} FROM (SELECT word, min(p_partkey * 5 + place) AS rn FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS place FROM part) GROUP BY word))"


def _document_terms(whole: str) -> str:
    found = " UNION ALL ".join(f"SELECT unnest(w) AS word, (item_id * 16777216 + generate_subscripts(w, 1) - 1) * 2 + {i} AS rn FROM (SELECT item_id, regexp_extract_all(lower(text), '{pattern}') AS w FROM benchmark)" for i, pattern in enumerate(TERM_PATTERNS))
    return f"terms AS (SELECT {TERM_COLUMNS}{FLAGS.format(whole=whole)} FROM (SELECT word, min(rn) AS rn FROM ({found}) GROUP BY word))"


def _matches(texts: str, key: str, column: str) -> str:
    """The terms are single words or two with a space between, so a whole-word term is one of the text's words, or two of
    them with just a space between."""
    word = r"[\p{L}\p{M}\p{N}\p{Pc}]+"
    tokens = lambda x: rf"regexp_extract_all({x}, '{word}|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+')"
    units = lambda x: f"list_concat({x}, list_filter(list_transform(range(1, greatest(len({x}) - 1, 1)), lambda i: CASE WHEN {x}[i + 1] = ' ' THEN {x}[i] || ' ' || {x}[i + 2] END), lambda u: u IS NOT NULL))"
    return f"""SELECT {key}, pos AS term_pos, source, target, row_number() OVER (PARTITION BY {key} ORDER BY strlen(source) DESC, pos) AS rank FROM (
 WITH x AS (SELECT {key}, {column} AS raw, lower({column}) AS low, {tokens(column)} AS raw_tokens, {tokens(f"lower({column})")} AS low_tokens FROM {texts}),
 u AS (SELECT DISTINCT * FROM (SELECT {key}, true AS cased, unnest({units("raw_tokens")}) AS unit FROM x UNION ALL SELECT {key}, false, unnest({units("low_tokens")}) FROM x)),
 t AS (SELECT *, CASE WHEN case_sensitive THEN source ELSE lower(source) END AS needle FROM terms WHERE enabled AND NOT ambiguous AND source <> '')
 SELECT u.{key}, t.pos, t.source, t.target FROM u JOIN t ON t.needle = u.unit AND t.case_sensitive = u.cased AND t.whole_word
 UNION ALL SELECT x.{key}, t.pos, t.source, t.target FROM x JOIN t ON NOT t.whole_word AND contains(CASE WHEN t.case_sensitive THEN x.raw ELSE x.low END, t.needle))"""


_NOISE_ROWS = ", ".join("({}, '{}', '{}')".format(i, s.replace("'", "''"), t.replace("'", "''")) for i, (s, t) in enumerate(NOISE))
_WORDS = f"list_filter(regexp_split_to_array(s, '{WS}+'), lambda w: w <> '' AND replace(w, '-', '') <> '')"
_QUOTED = lambda x: "(" + " OR ".join("(starts_with({0}, '{1}') AND ends_with({0}, '{2}'))".format(x, a.replace("'", "''"), b.replace("'", "''")) for a, b in glossary.QUOTES) + ")"
_INNER = lambda x: _trim(f"substring({x}, 2, greatest(length({x}) - 2, 0))")
_UNQUOTE = lambda x: f"CASE WHEN {_QUOTED(x)} AND length({x}) >= 2 AND {_INNER(x)} <> '' THEN {_INNER(x)} ELSE {x} END"
CLEAN = rf"""WITH {PART_TERMS_CTE}, noise AS (SELECT * FROM (VALUES {_NOISE_ROWS}) AS v(pos, source, target) UNION ALL SELECT pos + 100, source, target FROM terms),
t AS (SELECT pos, {_trim("source")} AS s, {_trim("target")} AS g FROM noise)
SELECT CAST(pos AS BIGINT) AS pos, {_UNQUOTE("s")} AS source, {_UNQUOTE("g")} AS target, CASE WHEN s = '' OR g = '' THEN 'empty' WHEN regexp_matches(s, '\[\p{{Nd}}+\]') THEN 'placeholder' WHEN contains(s, '[IE_') OR regexp_matches(s, '^\[[A-Z_]{{2,}}\]') THEN 'marker'
 WHEN length(s) - length(replace(s, '-', '')) >= 2 AND len({_WORDS}) <= 2 THEN 'dashes' WHEN regexp_matches(s, '^[^\p{{L}}\p{{M}}\p{{Nd}}]+$') THEN 'symbols' WHEN strlen(s) <= 4 AND lower(s) IN ({", ".join(f"'{w}'" for w in glossary.STOP_WORDS)}) THEN 'stop word' END AS reason FROM t"""
FILES_CTE = f"files AS (SELECT name, min(doc_id) AS pos, count(*) AS n_entries FROM (SELECT doc_id, {PATH} AS name FROM documents) GROUP BY name)"
FILES2_CTE = f"""{FILES_CTE}, parts AS (SELECT *, string_split(name, '/') AS p FROM files), places AS (SELECT *, coalesce(list_position(list_transform(p, lambda s: lower(s)), 'localization'), 0) AS a FROM parts),
facts AS (SELECT *, CASE WHEN a > 0 AND len(p) > a + 1 THEN p[a + 1] END AS language, CASE WHEN a > 0 AND len(p) - a >= 2 THEN array_to_string(list_concat(p[:a], ['Chinese'], p[a + 2:]), '/') ELSE name END AS target FROM places)"""
PRIORITY = "CAST(CASE WHEN language = 'English' THEN 3 WHEN language IN ('Chinese', 'ChineseSimplified') THEN 2 ELSE 1 END AS BIGINT)"
EVENTS_CTE = """e AS (SELECT CAST(user_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'signup' THEN 'progress' WHEN 'view' THEN 'delta' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'edit' END AS type,
 concat(event_type, event_id, ';') AS text, concat('m', event_id) AS message FROM events),
marks AS (SELECT id, coalesce(max(n) FILTER (type IN ('done', 'edit')), 0) AS f, arg_max(type, n) AS last, arg_max(type, n) FILTER (type IN ('error', 'revert')) AS tells, arg_max(message, n) FILTER (type IN ('error', 'revert')) AS message,
 bool_or(type = 'done') AS completed FROM e GROUP BY id),
folded AS (SELECT m.id AS "entryId", coalesce((SELECT string_agg(e.text, '' ORDER BY e.n) FROM e WHERE e.id = m.id AND (e.n = m.f OR (e.n > m.f AND e.type = 'delta'))), '') AS target,
 CASE last WHEN 'progress' THEN 'translating' WHEN 'delta' THEN 'translating' WHEN 'done' THEN 'translated' WHEN 'edit' THEN 'edited' ELSE 'error' END AS status, CASE WHEN tells = 'error' THEN message END AS error, completed, f > 0 AS replaced, tells IS NOT NULL AS told FROM marks m),
onto AS (SELECT CAST(x.pos AS VARCHAR) AS id, CASE WHEN f.status IS NULL THEN x.target WHEN replaced THEN f.target ELSE x.target || f.target END AS target, coalesce(f.status, 'pending') AS status, f.error, coalesce(completed, false) AS completed, f.status IS NOT NULL AS seen
 FROM entries x LEFT JOIN folded f ON f."entryId" = CAST(x.pos AS VARCHAR))"""
EDITS_CTE = "edits AS (SELECT pos, CASE WHEN pos % 8 = 1 THEN source ELSE source || 's' END AS source, target || '!' AS target FROM terms WHERE pos % 4 = 1)"
_REFS = "SELECT key, ref_key, ref_source, ref_target, row_number() OVER (PARTITION BY key ORDER BY strlen(ref_source) DESC, ref_key) AS rank FROM (SELECT k.key, m.key AS ref_key, m.source AS ref_source, m.target AS ref_target FROM (SELECT DISTINCT key FROM {keys}) k, memory m WHERE contains(k.key, m.key) AND k.key <> m.key) QUALIFY rank <= 12"
_ASK = "Translate into Simplified Chinese and answer with the translation only"

_CUT = EVENTS_CTE.replace("FROM events)", "FROM events WHERE event_id < (SELECT max(event_id) // 2 FROM events))")
_REVERT = EVENTS_CTE.replace("ELSE 'edit' END AS type", "ELSE CASE WHEN event_id % 2 = 0 THEN 'revert' ELSE 'edit' END END AS type").replace("('done', 'edit')", "('done', 'edit', 'revert')").replace("string_agg(e.text,", "string_agg(CASE WHEN e.type = 'revert' THEN '' ELSE e.text END,").replace("ELSE 'error' END AS status", "WHEN 'revert' THEN 'pending' ELSE 'error' END AS status")
_TAG_NAME = r"regexp_extract(s, '(?s)^<\s*/?\s*([^\s/>!?<][^\s/>]*)', 1)"
_ESCAPED = "replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(39), '&apos;'), '\"', '&quot;')"
_TAGGED = f"concat('Cast <LSTag Tag=\"', doc_id, '\">', {_trim('text')}, '</LSTag><br/><b></b> 1 < 2 & 3')"

ORACLE_SQL: dict[str, str] = {
    "glossary_match": f"WITH {_document_terms('rn % 5 <> 0')} {_matches('documents', 'doc_id', 'text')}",
    "glossary_match_substring": f"WITH {_document_terms('rn < 0')}, m AS ({_matches('documents', 'doc_id', 'text')}) SELECT source, target, count(*) AS n_texts, CAST(sum(rank) AS BIGINT) AS ranks FROM m GROUP BY 1, 2",
    "glossary_clean": CLEAN,
    "glossary_clean_stats": f"SELECT count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS removed FROM ({CLEAN})",
    "consistency_key": f"SELECT doc_id, {_key('text')} AS key FROM documents",
    "exact_groups": f"SELECT key, min(doc_id) AS first_pos, count(*) AS n, arg_min(text, doc_id) AS source FROM (SELECT doc_id, text, {_key('text')} AS key FROM documents) GROUP BY key",
    "series_split": f"WITH {E_CTE}, {SPLIT_CTE} SELECT id, base, suffix FROM split",
    "series_profiles": f"WITH {E_CTE}, {SPLIT_CTE}, {VARIANTS_CTE}, {PROFILES_CTE} SELECT * FROM profiles",
    "series_alias": f"WITH {BASE_CTES} SELECT * FROM alias",
    "memory_build": f"WITH {BASE_CTES} SELECT * FROM memory",
    "memory_refs_top12": f"WITH {BASE_CTES}, keyed AS (SELECT {_key('source')} AS key FROM entries) SELECT key, rank, ref_key, ref_source, ref_target FROM ({_REFS.format(keys='keyed')})",
    "plan_jobs": f"WITH {BASE_CTES}, {PLAN_CTE} SELECT * FROM jobs",
    "plan_resolved": f"WITH {BASE_CTES}, {PLAN_CTE} SELECT id, pos, {COMPOSE('known', 'suffix')} AS target, 'series' AS rule FROM joined WHERE known IS NOT NULL UNION ALL SELECT id, pos, known, 'exact' FROM rest WHERE known IS NOT NULL",
    "fanout": f"WITH {BASE_CTES}, {PLAN_CTE} SELECT j.id, j.pos, {COMPOSE("('【译文】' || g.base)", 'j.suffix')} AS target FROM joined j JOIN grouped g ON g.k = j.k WHERE j.known IS NULL UNION ALL SELECT r.id, r.pos, '【译文】' || a.base FROM rest r JOIN alike a ON a.key = r.key WHERE r.known IS NULL",
    "prompt": f"""WITH {BASE_CTES}, {PLAN_CTE}, {PART_TERMS_CTE}, bases AS (SELECT DISTINCT base FROM jobs), m AS ({_matches('bases', 'base', 'base')}), mm AS (SELECT base, string_agg(source || ' = ' || target, chr(10) ORDER BY rank) AS lines FROM m GROUP BY base),
 keyed AS (SELECT *, {_key('base')} AS key FROM jobs), rr AS (SELECT key, string_agg(ref_source || ' = ' || ref_target, chr(10) ORDER BY rank) AS lines FROM ({_REFS.format(keys='keyed')}) GROUP BY key)
 SELECT kind, first_pos, '{_ASK}.' || chr(10) || chr(10) || '[Context] Use it for meaning and tone; terms and tags go first:' || chr(10) || 'short names' || coalesce(chr(10) || chr(10) || '[Terms] Use exactly these translations:' || chr(10) || mm.lines, '')
 || coalesce(chr(10) || chr(10) || '[Decided] Names already translated in this mod:' || chr(10) || rr.lines, '') || chr(10) || chr(10) || 'Text:' || chr(10) || k.base AS prompt FROM keyed k LEFT JOIN mm ON mm.base = k.base LEFT JOIN rr ON rr.key = k.key""",
    "event_fold": f"""WITH {E_CTE}, {EVENTS_CTE} SELECT "entryId", target, status, error FROM folded""",
    "progress": f"WITH {E_CTE}, {EVENTS_CTE} SELECT count(*) AS total, count(*) FILTER (status IN ('translated', 'edited')) AS done, count(*) FILTER (status NOT IN ('translated', 'edited')) AS pending FROM folded",
    "pending_filter": f"WITH {E_CTE} SELECT id, source FROM entries WHERE {_trim('source')} <> '' AND {_trim('target')} = ''",
    "search": "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'tion') OR contains(lower(lang), 'tion') OR contains(lower(source), 'tion')",
    "classify_files": f"WITH {FILES2_CTE} SELECT name, CASE WHEN lower(name) LIKE '%.xml' AND contains(lower(name), 'localization') THEN 'localization-xml' WHEN lower(name) LIKE '%.loca' THEN 'localization-loca' WHEN lower(name) LIKE '%.lsx' THEN 'metadata-lsx' WHEN lower(name) LIKE '%.lua' THEN 'script-lua' WHEN lower(name) LIKE '%.txt' THEN 'data-txt' ELSE 'other' END AS kind, language, CASE WHEN len(p) > 2 THEN array_to_string(p[-2:], '/') ELSE name END AS short, target, {PRIORITY} AS priority, NOT regexp_matches(name, '^/|^[A-Za-z]:|(^|/)\\.\\.(/|$)') AS safe FROM facts",
    "write_plan": f"WITH {FILES2_CTE} SELECT target AS target_path, name, priority FROM (SELECT *, {PRIORITY} AS priority, row_number() OVER (PARTITION BY target ORDER BY {PRIORITY} DESC, pos) AS r FROM facts WHERE n_entries > 0) WHERE r = 1",
    "folder_rollup": f"WITH {FILES_CTE}, f AS (SELECT pos, string_split(name, '/') AS p FROM files), x AS (SELECT pos, unnest(list_transform(range(1, len(p)), lambda i: array_to_string(p[:i], '/'))) AS path FROM f) SELECT path, count(*) AS total, count(*) FILTER (pos % 3 = 0) AS n_checked, CASE WHEN count(*) FILTER (pos % 3 = 0) = 0 THEN 'unchecked' WHEN count(*) FILTER (pos % 3 = 0) = count(*) THEN 'checked' ELSE 'indeterminate' END AS state, len(string_split(path, '/')) AS depth FROM x GROUP BY path",
    "latest_readable": "SELECT d.source || '/' || d.lang AS name, max(doc_id) FILTER (coalesce(l.q, 0) = 1) AS pos, count(*) FILTER (coalesce(l.q, 0) <> 1) AS unreadable, count(*) AS copies FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l USING (doc_id) GROUP BY 1",
    "inline_tags": r"SELECT name, name IN ('LSTag', 'font', 'i', 'b', 'u', 'br') AS inline, count(*) AS n FROM (SELECT regexp_extract(tag, '(?s)^<\s*/?\s*([^\s/>!?<][^\s/>]*)', 1) AS name FROM (SELECT unnest(regexp_extract_all(html, '<[^>]*>')) AS tag FROM pages)) GROUP BY 1, 2",
    "glossary_page": f"WITH {_document_terms('rn % 5 <> 0')} SELECT pos, source, target FROM terms ORDER BY pos LIMIT {2 * PAGE_SIZE}",
    "glossary_upsert": f"WITH {PART_TERMS_CTE}, {EDITS_CTE} SELECT t.pos, t.source, coalesce(e.target, t.target) AS target FROM terms t LEFT JOIN edits e ON e.source = t.source UNION ALL SELECT (SELECT max(pos) FROM terms) + 1 + pos, source, target FROM edits WHERE source NOT IN (SELECT source FROM terms)",
    "glossary_delete": f"WITH {PART_TERMS_CTE} SELECT pos, source, target FROM terms WHERE NOT (pos % 3 = 0 AND pos % 5 <> 0)",
    "contentlist_roundtrip": f"SELECT concat('h', doc_id) AS contentuid, concat(source, '-', doc_id % 16, '/Localization/x.xml') AS source_file, length({_TAGGED}) AS n_chars, md5({_TAGGED}) AS digest FROM documents",
    "sse_stream": "WITH b AS (SELECT user_id, concat(event_type, event_id) AS text, 5 * (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS pos FROM events) SELECT user_id, pos, text FROM b UNION ALL SELECT user_id, pos + 3, '→…' FROM b",
    "sse_deltas": "SELECT event_id, CAST(0 AS BIGINT) AS pos, concat(event_type, event_id) AS text FROM events UNION ALL SELECT event_id, 3, '!' FROM events",
    "fragment_escape": f"SELECT page_id, md5(array_to_string(list_transform(regexp_extract_all(html, '(?s)<[^>]*>|[^<]+|<'), lambda s: CASE WHEN starts_with(s, '<') AND ends_with(s, '>') AND {_TAG_NAME} IN ('LSTag', 'font', 'i', 'b', 'u', 'br') THEN s ELSE {_ESCAPED} END), '')) AS digest FROM pages",
    "retranslate_all": f"WITH {E_CTE} SELECT id, target, 'pending' AS status, CAST(NULL AS VARCHAR) AS error FROM entries UNION ALL SELECT id, '', 'pending', NULL FROM entries WHERE target <> ''",
    "cancelled": f"""WITH {E_CTE}, {_CUT} SELECT id, CASE WHEN completed THEN target ELSE '' END AS target, CASE WHEN completed THEN status ELSE 'pending' END AS status, CASE WHEN completed THEN error END AS error FROM onto""",
    "event_stream": f"""WITH {E_CTE}, {_CUT.replace("ORDER BY ts, event_id", "ORDER BY event_id")} SELECT id AS "entryId", CASE WHEN completed THEN target ELSE '' END AS target, CASE WHEN completed THEN status ELSE 'pending' END AS status, CASE WHEN completed THEN error END AS error FROM onto""",
    "reverted": f"""WITH {E_CTE}, {_REVERT} SELECT "entryId", target, status, error FROM folded""",
    "applied_events": f"WITH {E_CTE}, {EVENTS_CTE} SELECT id, target, status, error FROM onto",
    "contentlist_split": f"SELECT concat('h', doc_id) AS contentuid, concat(source, '-', doc_id % 16, '/Localization/x.xml') AS source_file, row_number() OVER (PARTITION BY source, doc_id % 16 ORDER BY doc_id) AS place, md5({_TAGGED}) AS digest FROM documents",
    "language_places": f"WITH {FILES2_CTE} SELECT name, row_number() OVER (ORDER BY coalesce(language, 'zzz') COLLATE en, name COLLATE en, name) AS place FROM facts",
    "tree_places": f"WITH {FILES_CTE}, n AS (SELECT name AS path, true AS is_leaf, string_split(name, '/') AS p FROM files UNION ALL SELECT DISTINCT array_to_string(p[:i], '/'), false, p[:i] FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(name, '/') AS p FROM files))) SELECT path, is_leaf, row_number() OVER (ORDER BY list_transform(p, lambda x, i: CASE WHEN is_leaf AND i = len(p) THEN '1' ELSE '0' END || icu_sort_key(x, 'en') || chr(1) || x)) AS place FROM n",
    "tree_nodes": f"WITH {FILES_CTE}, n AS (SELECT name AS path, true AS is_leaf FROM files UNION ALL SELECT DISTINCT array_to_string(p[:i], '/'), false FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(name, '/') AS p FROM files))) SELECT path, is_leaf, string_split(path, '/')[-1] AS name, CAST(len(string_split(path, '/')) AS BIGINT) AS depth FROM n",
    "selection": f"WITH {FILES2_CTE} SELECT name, true AS \"on\" FROM facts WHERE pos % 3 = 0 OR language = 'English' UNION ALL SELECT name, false FROM facts WHERE pos % 3 = 0 AND language IS DISTINCT FROM 'English'",
    "selected_entries": f"WITH {FILES_CTE} SELECT doc_id, {PATH} AS source_file FROM documents WHERE {PATH} IN (SELECT name FROM files WHERE pos % 3 = 0)",
    "entry_views": f"WITH {E_CTE}, {PART_TERMS_CTE}, {FILES_CTE} SELECT 'work' AS view, id FROM entries WHERE {_trim('source')} <> '' UNION ALL SELECT 'open', id FROM entries WHERE target = '' UNION ALL SELECT 'terms', CAST(pos AS VARCHAR) FROM terms WHERE contains(lower(source), 're') OR contains(lower(target), 're') UNION ALL SELECT 'files', name FROM files WHERE (lower(name) LIKE '%.xml' AND contains(lower(name), 'localization')) OR lower(name) LIKE '%.loca'",
    "glossary_rename": f"WITH {PART_TERMS_CTE} SELECT pos, CASE WHEN pos = first THEN 'crimson' ELSE source END AS source, CASE WHEN pos = first THEN 'R!' ELSE target END AS target FROM (SELECT *, min(pos) OVER () AS first FROM terms)",
    "glossary_remaining": f"WITH {PART_TERMS_CTE} SELECT greatest(count(*) - {PAGE_SIZE}, 0) AS remaining FROM terms",
    "path_rules": rf"WITH {FILES_CTE} SELECT name, NOT regexp_matches(name, '^/|^[A-Za-z]:|(^|/)\.\.(/|$)') AS safe, regexp_matches(name, '(?i)\.(pak|zip)$') AS archive, concat(regexp_replace(regexp_extract(name, '([^/]*)$', 1), '(?i)\.(pak|zip)$', ''), '_zh.pak') AS output FROM (SELECT {ODD_NAME} AS name FROM files)",
    "small_rules": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Title' END AS field, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) END AS n, CAST(CASE p_partkey % 4 WHEN 1 THEN 7 WHEN 3 THEN p_size ELSE 1 END AS INTEGER) AS version, greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), CAST(p_size - 5 AS DOUBLE) * 100 / 40)) AS percent FROM part",
    "file_order": f"WITH {FILES_CTE} SELECT name, row_number() OVER (ORDER BY name) - 1 AS pos FROM files",
    "lsx_patch": f"SELECT concat('m', p_partkey // {LSX_SPAN}, '.lsx') AS source_file, concat(field, '#', row_number() OVER (PARTITION BY p_partkey // {LSX_SPAN}, field ORDER BY p_partkey) - 1) AS contentuid, CASE field WHEN 'Title' THEN upper(value) ELSE value END AS source FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Title' ELSE 'Tooltip' END AS field, concat(p_name, ' > & ', p_size) AS value FROM part WHERE p_partkey % 3 <> 2)",
    "inner_packages": "SELECT concat('a', doc_id // 64, '.zip') AS archive, min(concat(source, '/', doc_id, '.PAK')) AS name FROM documents WHERE doc_id % 10 = 3 GROUP BY 1",
    "extracted_files": "SELECT concat(source, '/', doc_id, CASE WHEN doc_id % 10 = 3 THEN '.PAK' ELSE '.txt' END) AS name, CASE WHEN doc_id % 10 = 3 THEN 'other' ELSE 'data-txt' END AS kind, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents",
    "lsx_bytes": "SELECT concat('m', p_partkey, '.lsx') AS source_file, CASE WHEN p_partkey % 3 < 2 THEN 'Title#0' END AS contentuid, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS source, p_partkey % 3 = 2 AS warned FROM part",
    "file_faults": "SELECT concat('f', doc_id, '.xml#', doc_id) AS id, lang AS source, '1' AS version, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS n_faults FROM documents",
    "saved_glossary": f"WITH {PART_TERMS_CTE} SELECT pos, source, target, 'name_or_title' AS category, 'user' AS source_kind, enabled, ambiguous, whole_word, case_sensitive, pos % 7 AS count FROM terms",
    "request_rules": "SELECT p_partkey, CAST(least(greatest(p_size * 3 - 10, 1), 100) AS BIGINT) AS concurrency, concat('http://h/', p_name, '/v1/chat/completions') AS endpoint FROM part",
    "translatable_files": f"WITH {FILES_CTE} SELECT CASE WHEN lower(name) LIKE '%.xml' THEN 'localization-xml' ELSE 'localization-loca' END AS kind, count(*) AS n FROM files WHERE lower(name) LIKE '%.xml' AND contains(lower(name), 'localization') OR lower(name) LIKE '%.loca' GROUP BY 1",
    "zip_members": f"SELECT concat('a', doc_id // {ZIP_SPAN}) AS archive, concat(source, '/', doc_id, '.txt') AS name, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents",
    "run_totals": f"WITH {BASE_CTES}, {PLAN_CTE} SELECT 'all_done' AS type, (SELECT count(*) FROM open) AS total, CAST((SELECT coalesce(sum(n_members), 0) FROM jobs WHERE base LIKE 'r%') AS BIGINT) AS failed",
}
_OUTPUTS = ORACLE_SQL["fanout"].replace(f"{PLAN_CTE} SELECT j.id", f"{PLAN_CTE}, outputs AS (SELECT j.id")
ORACLE_SQL["translated_table"] = f"""{_OUTPUTS} UNION ALL SELECT id, pos, {COMPOSE('known', 'suffix')} FROM joined WHERE known IS NOT NULL UNION ALL SELECT id, pos, known FROM rest WHERE known IS NOT NULL)
 SELECT x.id, coalesce(o.target, x.target) AS target, CASE WHEN o.id IS NULL THEN 'pending' ELSE 'translated' END AS status, CAST(NULL AS VARCHAR) AS error FROM entries x LEFT JOIN outputs o USING (id)"""
