"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_transducer, chat_windows, html_layout, importance_resampling, jaccard_join, katz_model, line_runs, merkle_manifest, positional_index, quality_rules, secret_scan, token_frames, unigram_counts
from .common import read


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz backoff scores of every document by a model of those that are not held out."""
    return katz_model.scores_of(katz_model.fit(read(spark, sf_dir, "documents")))


def op2_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written in seekable frames, and read back from the files."""
    docs = read(spark, sf_dir, "documents")
    manifest = token_frames.write_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_frames.read_documents(manifest, docs.schema["doc_id"].dataType.simpleString(), digest=True)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a 10-word window of a benchmark item covers, found in a positional index."""
    return positional_index.contamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of unigram pieces of every document, without the pieces."""
    return unigram_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, laid out."""
    return html_layout.render_pages(read(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard_join.linked(read(spark, sf_dir, "documents"), width=5, percent=80)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and what they decode to, as digests."""
    return bpe_transducer.token_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: candidates that a random forest of labelled findings keeps."""
    return secret_scan.secret_report(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT CAST(-1 AS BIGINT) AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (CAST(0 AS BIGINT), 'user'), (CAST(1 AS BIGINT), 'assistant') AS t(turn, role)")
    return chat_windows.digests(chat_windows.format_windows(rows.unionByName(odd)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and whether the base rules and the certified cutoffs keep it."""
    return quality_rules.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents by language, checked after some were tampered with."""
    return merkle_manifest.tampered_report(read(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every document towards the benchmark's words, and the tenth of them that is drawn."""
    return importance_resampling.importance_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that three or more documents hold, but for the largest doc_id of each."""
    return line_runs.dedup_report(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz_scores": op1_katz_scores,
    "op2_token_frames": op2_token_frames,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_html_text": op5_html_text,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_secret_scan": op8_secret_scan,
    "op9_chat_windows": op9_chat_windows,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_line_dedup": op13_line_dedup,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: crc32 of bytes x (a list of numbers), by its polynomial.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {x}),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, _: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)))"""


def _crc(text: str) -> str:
    """crc32 of a text's UTF-8 bytes in DuckDB."""
    return _CRC.format(x=f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)")


def _field(x: str) -> str:
    return f"coalesce(strlen({x}) || ':' || {x}, '-')"


#: Levels are numbered from the leaves up; a tree is done when one node is left; heap places give each leaf's siblings.
_MERKLE = f"""WITH RECURSIVE d AS (SELECT *, {_crc("doc_id::VARCHAR")} % 7 = 0 AS hit FROM documents),
 l AS (SELECT doc_id, lang, sha256({" || ".join(_field(f"{c}::VARCHAR") for c in merkle_manifest.FIELDS)}) AS leaf,
   sha256({" || ".join(_field("(n_chars + CASE WHEN hit THEN 1 ELSE 0 END)::VARCHAR" if c == "n_chars" else f"{c}::VARCHAR") for c in merkle_manifest.FIELDS)}) AS now FROM d),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM l),
 low AS (SELECT 0 AS level, lang, place, n, leaf AS node FROM r
  UNION ALL SELECT level + 1, lang, place // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY level, lang, place // 2, n),
 roots AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
 high AS (SELECT 0 AS level, place, n, subroot AS node FROM roots
  UNION ALL SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM high WHERE n > 1 GROUP BY level, place // 2, n),
 up AS (SELECT doc_id, place AS leaf_place, lang, 0 AS level, place, n, now AS node, '' AS proof FROM r
  UNION ALL SELECT u.doc_id, u.leaf_place, u.lang, u.level + 1, u.place // 2, (u.n + 1) // 2,
   sha256(CASE WHEN s.node IS NULL THEN u.node WHEN u.place % 2 = 1 THEN s.node || u.node ELSE u.node || s.node END), u.proof || coalesce(s.node, '')
  FROM up u LEFT JOIN low s ON s.level = u.level AND s.lang IS NOT DISTINCT FROM u.lang AND s.place = xor(u.place, 1::BIGINT) WHERE u.n > 1),
 above AS (SELECT u.doc_id, u.leaf_place, u.lang, 0 AS level, t.place, t.n, u.node, u.proof FROM up u JOIN roots t ON t.lang IS NOT DISTINCT FROM u.lang WHERE u.n = 1
  UNION ALL SELECT u.doc_id, u.leaf_place, u.lang, u.level + 1, u.place // 2, (u.n + 1) // 2,
   sha256(CASE WHEN s.node IS NULL THEN u.node WHEN u.place % 2 = 1 THEN s.node || u.node ELSE u.node || s.node END), u.proof || coalesce(s.node, '')
  FROM above u LEFT JOIN high s ON s.level = u.level AND s.place = xor(u.place, 1::BIGINT) WHERE u.n > 1)
SELECT r.doc_id, r.leaf, t.subroot, h.node AS root, sha256(a.proof) AS proof_sha256, a.node AS folded_root, a.node = h.node AS verified
FROM r JOIN above a ON a.lang IS NOT DISTINCT FROM r.lang AND a.leaf_place = r.place AND a.n = 1 JOIN roots t ON t.lang IS NOT DISTINCT FROM r.lang
JOIN high h ON h.n = 1"""

_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_RESAMPLING = f"""WITH words AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents), target AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
 bucket AS (SELECT word, {_crc("word")} % 10000 AS b FROM (SELECT word FROM words UNION SELECT word FROM target)),
 s AS (SELECT b, count(*) AS s FROM words JOIN bucket USING (word) GROUP BY b), t AS (SELECT b, count(*) AS t FROM target JOIN bucket USING (word) GROUP BY b),
 gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT b FROM bucket) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
 weights AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM words JOIN bucket USING (word) JOIN gain USING (b) GROUP BY doc_id),
 scores AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN weights USING (doc_id)),
 places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scores LEFT JOIN places USING (doc_id)"""

_LINES = f"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
 keys AS (SELECT doc_id, line, place, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS key FROM lines),
 often AS (SELECT key, max(doc_id) AS top FROM keys WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
 flags AS (SELECT doc_id, line, place, top IS NOT NULL AND doc_id <> top AS gone FROM keys LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM flags GROUP BY doc_id"""

ORACLE_SQL: dict[str, str] = {"op11_merkle_manifest": _MERKLE, "op12_importance_resampling": _RESAMPLING, "op13_line_dedup": _LINES}
