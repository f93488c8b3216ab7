"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

`measure` takes the figures of each text in its own row, without a shuffle. `fit_thresholds` tests, on labelled
good documents held out for it, the hypothesis "this cutoff rejects more than `risk` of the stratum's good
documents" by the exact binomial tail. Cutoffs of one rule are tested in fixed sequence, loosest first, up to
the first that is not certified; the confidence is split over rules and strata (Bonferroni), and the risk over
rules, so all rules together keep to it. Of the certified cutoffs, the one with the best gain in rejected bad
documents, less `weight` times the rejected good ones, is taken; a stratum with too few labels gets none.

Null texts count as empty: no words, base_failed, not kept. A null stratum is a stratum as any. Where no cutoff is
certified, so in strata with few labels or none and in all of them without labels, only the base rules apply: nothing
was tested there, so nothing could be guaranteed. Documents repeated under one id are judged row by row; of several
labels of one id the least quality counts. Texts are measured whole, of any length, in their own rows. An empty table
gives an empty result; own columns keep their names and values in keep_good().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SPACE = r"[\x20\x09-\x0D]"
#: Cutoffs of each rule, loosest first: a document is rejected if its figure exceeds the cutoff.
CUTOFFS = {
    "symbols_per_word": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "bangs_per_word": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeat_share": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
}
#: The most strata whose thresholds are broadcast.
FEW_STRATA = 10_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the struct column quality_measures. Each step's arrays are columns of their own, so that no
    array is made again for each of its elements."""
    at = [c for c in docs.columns]
    q = F.col
    t = F.coalesce(F.col(text), F.lit(""))
    words = docs.withColumn("__words", F.filter(F.split(t, SPACE + "+"), lambda w: w != ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = words.select(
        *at,
        F.size("__words").cast("long").alias("__n"),
        F.length(F.array_join("__words", "")).cast("long").alias("__chars"),
        F.slice(F.transform("__words", lambda w, i: F.xxhash64(w, F.get(q("__words"), i + 1), F.get(q("__words"), i + 2))), F.lit(1), F.greatest(F.size("__words") - 2, F.lit(0))).alias("__windows"),
        lines.alias("__lines"),
    )
    placed = hashed.select(
        *at, "__n", "__chars", "__lines",
        F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.lit(None)).alias("__sorted"),
    )
    same = lambda e, j: F.coalesce(F.get(q("__sorted"), j)["h"] == e["h"], F.lit(False))
    starts = F.transform(F.filter(q("__sorted"), lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))
    count = lambda chars: F.regexp_count(t, F.lit(chars)).cast("long")
    return placed.select(
        *at,
        F.struct(
            q("__n").alias("n_words"),
            q("__chars").alias("word_chars"),
            count(r"[#*$%&|<>]").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(F.size(F.array_distinct(F.flatten(starts))), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size("__lines").cast("long").alias("n_lines"),
            count("!").alias("n_bangs"),
        ).alias("quality_measures"),
    )


def _figures() -> dict[str, Column]:
    m = lambda name: F.col(f"quality_measures.{name}").cast("double")
    per = lambda a, b: m(a) / F.greatest(m(b), F.lit(1.0))
    return {"symbols_per_word": per("n_symbols", "n_words"), "bangs_per_word": per("n_bangs", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words")}


def base_failed() -> Column:
    n, repeated = F.col("quality_measures.n_words"), F.col("quality_measures.n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(Binomial(n, p) <= k), summed exactly term by term in logarithms; 1 where k is at least the mean."""
    log_odds = F.log(p) - F.log(1 - p)

    def term(acc: Column, i: Column) -> Column:
        new = acc["t"] + F.log(n - i + 1) - F.log(i) + log_odds
        return F.struct(new.alias("t"), (F.greatest(acc["s"], new) + F.log1p(F.exp(-F.abs(acc["s"] - new)))).alias("s"))

    first = n * F.log(1 - p)
    logs = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), F.struct(first.alias("t"), first.alias("s")), term)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(logs["s"]))


def fit_thresholds(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, confidence: float = 0.95, weight: float = 10.0) -> DataFrame:
    """Certified cutoffs as staged rows: stratum and one column for each rule, null where no cutoff is certified; strata
    without labels have no row. The confidence is split over all strata that are tested."""
    labelled = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    rows = measured.where(~base_failed()).select("doc_id", F.col(stratum).cast("string").alias("stratum"), *[x.alias(k) for k, x in _figures().items()]).join(labelled, "doc_id")
    tests = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), (F.col(rule) > c).alias("hit")) for rule, cutoffs in CUTOFFS.items() for i, c in enumerate(cutoffs)])
    good = F.col("__quality") >= 1
    hit = lambda is_good: F.sum(F.when(F.col("test.hit") & (good if is_good else ~good), 1).otherwise(0)).cast("double")
    by = ["rule", "step", "cutoff"]
    counts = (
        rows.select("stratum", "__quality", F.explode(tests).alias("test"))
        .groupBy("stratum", *[F.col(f"test.{c}").alias(c) for c in by])
        .agg(F.sum(good.cast("int")).cast("double").alias("n_good"), F.sum((~good).cast("int")).cast("double").alias("n_bad"), hit(True).alias("hit_good"), hit(False).alias("hit_bad"))
    )
    counts = staged(counts, "quality-counts")  # as many rows for a stratum as there are cutoffs
    each_risk, split = risk / len(CUTOFFS), (1 - confidence) / len(CUTOFFS)
    alpha = split / max(1, counts.select("stratum").distinct().count())
    tested = counts.withColumn("p_value", binomial_tail(F.col("hit_good"), F.col("n_good"), F.lit(each_risk)))
    upto = Window.partitionBy("stratum", "rule").orderBy("step")
    certified = F.min((F.col("p_value") <= alpha).cast("int")).over(upto) == 1
    gain = F.col("hit_bad") / F.greatest(F.col("n_bad"), F.lit(1.0)) - weight * F.col("hit_good") / F.greatest(F.col("n_good"), F.lit(1.0))
    ranked = tested.withColumn("ok", certified).withColumn("gain", F.when(F.col("ok") & (gain > 0), gain))
    best = lambda rule: F.max(F.when((F.col("rule") == rule) & F.col("gain").isNotNull(), F.struct("gain", -F.col("step"), "cutoff")))["cutoff"].alias(rule)
    return staged(ranked.groupBy("stratum").agg(*[best(rule) for rule in CUTOFFS]), "quality-thresholds")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """docs' columns with quality_measures, base_failed and kept (false where a certified cutoff of the row's stratum is
    exceeded or the base rules fail). docs are staged once, with what measure() gave them. The thresholds are broadcast
    if they are few; languages are, but a stratum may be anything."""
    measured = staged(docs, "quality-measures")
    thresholds = fit_thresholds(measured, labels, stratum, **options)
    own = thresholds.select(F.struct(*CUTOFFS).alias("__own"), F.col("stratum").alias("__stratum"))
    few = thresholds.count() <= FEW_STRATA
    rows = measured.join(F.broadcast(own) if few else own, F.col(stratum).cast("string").eqNullSafe(F.col("__stratum")), "left")
    rejected = F.lit(False)
    for rule in CUTOFFS:
        rejected = rejected | F.coalesce(_figures()[rule] > F.col(f"__own.{rule}"), F.lit(False))
    return rows.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~rejected}).drop("__own", "__stratum")


def quality_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    measured = measure(docs.select("doc_id", "lang", "text")).drop("text")
    q = F.col("quality_measures")
    return judge(measured, labels, **options).select("doc_id", *[q[c].alias(c) for c in MEASURES[:5]], "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """The documents that are kept, with their own columns, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.col(stratum).cast("string").alias("lang"), "text")
    return judge(measure(rows).drop("text"), labels, **options).where("kept").select("row.*")
