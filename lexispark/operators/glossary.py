"""Glossaries: cleaning, edits, and matching against texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_bounded, ws_trim
from ..staging import scratch, staged
from .containment import contained
from .views import numbered

#: Terms that are small enough for Spark to bring them to the texts.
FEW_TERMS = 1 << 15

#: Words too common to be terms of their own, if they have up to four bytes.
STOP_WORDS = [
    "of", "and", "the", "or", "for", "to", "in", "on", "at", "by", "is", "it", "as", "be",
    "do", "no", "if", "an", "my", "we", "he", "up", "so", "tag", "end", "yes", "die", "one",
    "two", "from", "upon", "with", "that", "this", "then", "than", "but", "not", "all", "any",
    "can", "may", "has", "had", "was", "are", "were", "let", "set", "get", "put", "out", "off",
    "own", "new", "old", "big", "low",
]
QUOTES = [("'", "'"), ('"', '"'), ("“", "”"), ("‘", "’"), ("「", "」"), ("『", "』")]


def drop_reason(source: Column, target: Column) -> Column:
    """Why a term is noise: the first rule that it meets, or null. Sources and targets are trimmed."""
    parts = F.filter(F.split(source, r"(?U)\s+"), lambda w: (w != "") & (F.replace(w, F.lit("-"), F.lit("")) != ""))
    dashes = F.length(source) - F.length(F.replace(source, F.lit("-"), F.lit("")))
    return (
        F.when((source == "") | (target == ""), "empty")
        .when(source.rlike(r"(?U)\[\d+\]"), "placeholder")
        .when(source.contains("[IE_") | source.rlike(r"^\[[A-Z_]{2,}\]"), "marker")
        .when((dashes >= 2) & (F.size(parts) <= 2), "dashes")
        .when(source.rlike(r"(?U)^[\W_]+\z"), "symbols")
        .when((F.octet_length(source) <= 4) & F.lower(source).isin(STOP_WORDS), "stop word")
    )


def unquoted(x: Column) -> Column:
    """Without one pair of quotes around all of it, unless nothing would be left."""
    inner = ws_trim(F.substring(x, F.lit(2), F.length(x) - 2))
    wrapped = F.lit(False)
    for left, right in QUOTES:
        wrapped = wrapped | (x.startswith(left) & x.endswith(right))
    return F.when(wrapped & (F.length(x) >= 2) & (inner != ""), inner).otherwise(x)


def clean(terms: DataFrame) -> DataFrame:
    """terms with reason (null: kept), and trimmed, unquoted source and target. Noise is judged before quotes go."""
    trimmed = terms.withColumns({"source": ws_trim("source"), "target": ws_trim("target")})
    judged = trimmed.withColumn("reason", drop_reason(F.col("source"), F.col("target")))
    return judged.withColumns({"source": unquoted(F.col("source")), "target": unquoted(F.col("target"))})


def clean_stats(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("removed"))


def anchor_tokens(texts: DataFrame, usable: DataFrame, token: str, under: str) -> DataFrame:
    """(token, pos, sure) for each usable term that some text may hold: the tokens that its texts have one of.

    A term is made of pieces, words or else the whole of it, and each piece lies within one token of a text. A count
    table over all texts has the distinct tokens; a piece that must be a whole token is looked up there, another is
    searched in them. The term's anchor is the piece whose tokens the fewest texts have; a term with a piece that no
    text has is left out. sure: the term is one piece, and the token alone shows that it matches.
    """
    counted = staged(texts.select(F.explode(token).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("low", F.lower("token")), under)
    pieces = usable.select("pos", "worded", "whole_word", F.size("pieces").alias("many"), F.posexplode("pieces").alias("no", "piece"))
    pieces = pieces.withColumn("exact", F.col("worded") & (F.col("whole_word") | ((F.col("no") > 0) & (F.col("no") < F.col("many") - 1))))
    within = contained(counted.select(F.col("low").alias("hay")), pieces.where("NOT exact").select(F.col("piece").alias("needle")), under)
    held = pieces.where("NOT exact").join(within, F.col("piece") == F.col("needle")).select("pos", "no", "many", F.col("hay").alias("low"))
    found = pieces.where("exact").select("pos", "no", "many", F.col("piece").alias("low")).union(held).join(counted, "low")
    found = staged(found.select("pos", "no", "many", "token", "n"), under)
    weights = found.groupBy("pos", "no", "many").agg(F.sum("n").alias("n"))
    rarest = weights.groupBy("pos", "many").agg(F.min_by("no", F.struct("n", "no")).alias("no"), F.count(F.lit(1)).alias("held")).where("held = many").select("pos", "no")
    inside = F.when(F.col("case_sensitive"), F.col("token")).otherwise(F.lower("token"))
    fits = F.when(F.col("whole_word"), inside == F.col("needle")).otherwise(inside.contains(F.col("needle")))
    alone = (F.size("pieces") == 1) & (F.col("pieces")[0] == F.lower("source")) & (F.col("worded") | ~F.col("whole_word"))
    chosen = found.join(rarest, ["pos", "no"]).select("token", "pos").join(usable, "pos")
    return chosen.withColumn("sure", alone).where(~F.col("sure") | fits).select("token", "pos", "sure")


def matches(texts: DataFrame, terms: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term_pos, source, target, rank) of usable terms in each text, longest source first, then glossary order.
    key is a text's own; a null one is a key, too.

    Texts are split into distinct words (and what lies between, if a term has no word) and joined with the terms by the
    tokens of anchor_tokens(), so a term costs as many rows as texts have its rarest piece, whatever else it holds. Terms
    are numbered in the order of ranks, and a text's candidates are gathered as these numbers: no string of a term goes
    through a shuffle with them. Terms of several words, and other ones that a token can't prove, are then tested on the
    candidates' texts. Only keys, tokens and numbers are shuffled, and texts that have such candidates.
    """
    spark = texts.sparkSession
    with scratch(spark) as under:
        low = F.lower("source")
        found_words = F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0))
        usable = terms.where("enabled AND NOT ambiguous AND source <> ''").select("pos", "source", "target", "whole_word", "case_sensitive", F.when(F.col("case_sensitive"), F.col("source")).otherwise(low).alias("needle"), (F.size(found_words) > 0).alias("worded"), F.when(F.size(found_words) > 0, found_words).otherwise(F.array(low)).alias("pieces"))
        usable = staged(numbered(usable, [-F.octet_length("source"), F.col("pos"), F.col("source"), F.col("target")]), under)
        pattern = r"(?U)\w+" if usable.where("NOT worded").isEmpty() else r"(?U)\w+|\W+"
        rows = texts.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
        tokens = F.array_distinct(F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))
        code = F.col("place") * 2 + F.when(F.col("sure"), 0).otherwise(1)  # even: nothing is left to be tested
        anchored = staged(anchor_tokens(rows, usable, tokens, under).join(usable.select("pos", "place"), "pos").select("token", code.alias("code")), under)
        seen = rows.select("__key", F.explode(tokens).alias("token")).join(anchored, "token").groupBy("__key").agg(F.collect_set("code").alias("c"))
        if anchored.where("code % 2 = 1").isEmpty():
            held = seen
        else:
            seen = staged(seen, under)  # read twice, and the texts of candidates only are shuffled
            odd, unsure = lambda c: c % 2 == 1, F.exists("c", lambda c: c % 2 == 1)
            tested = seen.where(unsure)
            needles = usable.select((F.col("place") * 2 + 1).alias("code"), "needle", "whole_word", "case_sensitive")
            passed = _tested(rows, tested.select(F.col("__key").alias("__of"), F.filter("c", odd).alias("c")), needles)
            proved = tested.select("__key", F.explode(F.filter("c", lambda c: ~odd(c))).alias("code"))
            held = seen.where(~unsure).union(proved.union(passed).groupBy("__key").agg(F.collect_set("code").alias("c")))
        ranked = held.select("__key", F.posexplode(F.array_sort("c")).alias("rank", "code")).withColumn("place", F.shiftright("code", 1))
        told = usable.select("place", "pos", "source", "target")
        return staged(ranked.join(told, "place").select(F.col("__key").alias(key), F.col("pos").alias("term_pos"), "source", "target", (F.col("rank") + 1).cast("long").alias("rank")))


def _tested(rows: DataFrame, candidates: DataFrame, needles: DataFrame) -> DataFrame:
    """(__key, code): the candidates (__of, c) that their texts hold. The few terms of a usual glossary come to the texts;
    the needles of more go through a shuffle to their texts' candidates, as texts once for each of them would be larger."""

    def holds(of: Column, needle: Column, whole_word: Column, case_sensitive: Column) -> Column:
        inside = F.when(case_sensitive, F.col("__text")).otherwise(of)
        return F.when(whole_word, word_bounded(inside, needle)).otherwise(inside.contains(needle))

    same = F.col("__key").eqNullSafe(F.col("__of"))
    if needles.count() <= FEW_TERMS:
        hay = rows.join(candidates, same).select("__key", "__text", F.lower("__text").alias("__low"), "c")  # in lower case once a text, not once a candidate
        each = hay.select("__key", "__text", "__low", F.explode("c").alias("code")).join(needles, "code")
        return each.where(holds(F.col("__low"), F.col("needle"), F.col("whole_word"), F.col("case_sensitive"))).select("__key", "code")
    gathered = candidates.select("__of", F.explode("c").alias("code")).join(needles, "code").groupBy("__of").agg(F.collect_list(F.struct("code", "needle", "whole_word", "case_sensitive")).alias("c"))
    hay = rows.join(gathered, same).select("__key", "__text", F.lower("__text").alias("__low"), "c")
    held = F.filter("c", lambda t: holds(F.col("__low"), t["needle"], t["whole_word"], t["case_sensitive"]))
    return hay.select("__key", F.explode(F.transform(held, lambda t: t["code"])).alias("code"))


def page(terms: DataFrame, size: int, shown: int = 1) -> DataFrame:
    """The first pages of size terms."""
    return terms.orderBy("pos").limit(size * shown)


def remaining(terms: DataFrame, size: int, shown: int = 1) -> DataFrame:
    """How many terms the shown pages leave."""
    return terms.agg(F.greatest(F.count("*") - size * shown, F.lit(0).cast("long")).alias("remaining"))


def search(terms: DataFrame, query: str) -> DataFrame:
    q = query.strip().lower()
    return terms.where(F.lower("source").contains(q) | F.lower("target").contains(q)) if q else terms


def _holds(condition: Column, fault: str, of: Column, strict: bool) -> Column:
    """The condition as a filter; if strict, an error where it doesn't hold."""
    return F.when(condition, True).otherwise(F.raise_error(F.concat(F.lit(f"{fault}: "), of)).cast("boolean") if strict else F.lit(False))


def upsert(terms: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """new terms replace the first term of their source in its place, or come last. One new term a source. Blank ones
    are left out, or an error if strict."""
    fresh = new.select(F.col("source"), F.col("target").alias("new_target"), F.col("pos").alias("new_pos")).where(_holds((ws_trim("source") != "") & (ws_trim("new_target") != ""), "blank term", F.concat("source", F.lit(" = "), "new_target"), strict))
    first = terms.groupBy("source").agg(F.min("pos").alias("first"))
    joined = terms.join(first, "source").join(fresh, "source", "left")
    kept = joined.withColumn("target", F.when((F.col("pos") == F.col("first")) & F.col("new_target").isNotNull(), F.col("new_target")).otherwise(F.col("target"))).select("pos", "source", "target")
    last = F.coalesce(F.lit(terms.agg(F.max("pos")).first()[0]), F.lit(-1)).cast("long")
    added = fresh.join(first, "source", "left_anti").select((last + 1 + F.col("new_pos")).alias("pos"), "source", F.col("new_target").alias("target"))
    return kept.union(added)


def rename(terms: DataFrame, old_source: str, source: str, target: str) -> DataFrame:
    """The first term of old_source changed; an error if there is none."""
    first = terms.where(F.col("source") == old_source).agg(F.min("pos")).first()[0]
    if first is None:
        raise KeyError(old_source)
    if not source.strip() or not target.strip():
        raise ValueError("source and target must not be blank")
    hit = F.col("pos") == first
    return terms.withColumns({"source": F.when(hit, F.lit(source)).otherwise(F.col("source")), "target": F.when(hit, F.lit(target)).otherwise(F.col("target"))})


def delete(terms: DataFrame, sources: DataFrame, strict: bool = False) -> DataFrame:
    """terms without those of sources; official terms stay. If strict, a source that no term has, or an official term
    has, is an error."""
    if strict:
        known = terms.groupBy("source").agg(F.bool_or(F.coalesce("source_kind", F.lit("")) == "official").alias("official"))
        asked = sources.select("source").distinct().join(known, "source", "left")
        asked = asked.where(_holds(F.col("official").isNotNull(), "no such term", F.col("source"), True))
        sources = asked.where(_holds(~F.col("official"), "official term", F.col("source"), True))
    gone = sources.select(F.col("source").alias("__gone")).distinct()
    return terms.join(gone, (F.col("source") == F.col("__gone")) & (F.coalesce("source_kind", F.lit("")) != "official"), "left_anti")
