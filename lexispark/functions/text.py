"""Text functions as Column builders, so that Catalyst sees all of them. Lengths are in bytes where it says so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that count as CJK.
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}]"
STYLE_HINT_CHARS = 1200


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ws_trim(x: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+\z", "")


def is_blank(x: Column | str) -> Column:
    return ws_trim(x) == ""


def consistency_key(x: Column | str) -> Column:
    """Words joined by one space, without ASCII punctuation at both ends, in lower case; not trimmed again."""
    joined = F.regexp_replace(ws_trim(x), r"(?U)\s+", " ")
    return F.lower(F.regexp_replace(joined, r"^\p{Punct}+|\p{Punct}+\z", ""))


def contains_latin(x: Column | str) -> Column:
    return col(x).rlike("[A-Za-z]")


def contains_cjk(x: Column | str) -> Column:
    return col(x).rlike(CJK)


def is_series_base(x: Column | str) -> Column:
    return (F.octet_length(col(x)) >= 3) & col(x).rlike(r"\p{IsAlphabetic}")


def is_variant_suffix(x: Column | str) -> Column:
    """#s and brackets aside: 1 to 8 letters, digits, - or _, one of them a digit."""
    s = ws_trim(x)
    return s.rlike(r"^#*[()\[\]{}]*[A-Za-z0-9_-]{1,8}[()\[\]{}]*\z") & s.rlike("[0-9]")


def series_variant(x: Column | str) -> Column:
    """(base, suffix) of a numbered name: at the last white space, or, after CJK text, before the last run of
    letters and digits; null if neither fits."""
    t = ws_trim(x)
    spaced, compact = r"(?Us)^(.*)\s(\S+)\z", r"(?s)^(.*?)([A-Za-z0-9]+)\z"
    cut = lambda pattern: (ws_trim(F.regexp_extract(t, pattern, 1)), F.regexp_extract(t, pattern, 2))
    (base_a, suffix_a), (base_b, suffix_b) = cut(spaced), cut(compact)
    both = lambda base, suffix: F.struct(base.alias("base"), suffix.alias("suffix"))
    return F.when(is_series_base(base_a) & is_variant_suffix(suffix_a), both(base_a, suffix_a)).when(contains_cjk(base_b) & is_series_base(base_b) & is_variant_suffix(suffix_b), both(base_b, suffix_b))


def strip_target_suffix(target: Column | str, suffix: Column | str) -> Column:
    """The target before the suffix and separators; null if it doesn't end so or nothing is left."""
    t, s = ws_trim(target), ws_trim(suffix)
    left = F.substring(t, F.lit(1), F.length(t) - F.length(s))
    return F.when(t.endswith(s), F.nullif(F.regexp_replace(left, r"(?U)[\s\-_#：:]+\z", ""), F.lit("")))


def compose_variant(base_target: Column | str, suffix: Column | str) -> Column:
    base, s = ws_trim(base_target), ws_trim(suffix)
    return F.when(s == "", base).when(s.rlike(r"^\p{Punct}"), F.concat(base, s)).otherwise(F.concat(base, F.lit(" "), s))


def style_hint(x: Column | str) -> Column:
    return F.substring(F.nullif(ws_trim(x), F.lit("")), 1, STYLE_HINT_CHARS)


def escape_attribute(x: Column | str) -> Column:
    out = col(x)
    for raw, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(named))
    return out


def word_bounded(text: Column, needle: Column) -> Column:
    """Whether needle stands in text with Unicode word borders at both ends. Plain searches go first: a needle that begins
    and ends with characters of words has both borders between two spaces, so only the others' patterns are compiled."""
    literal = F.concat(F.lit(r"(?U)\b\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    spaced = F.regexp_like(needle, F.lit(r"(?Us)\A\w(.*\w)?\z")) & text.contains(F.concat(F.lit(" "), needle, F.lit(" ")))
    return (needle != "") & text.contains(needle) & (spaced | F.regexp_like(text, literal))


def anchors(x: Column, sizes: Sequence[int] = (1, 2, 3)) -> Column:
    """Distinct runs of so many characters, from every place; one pass over the text for each length."""
    runs = [F.regexp_extract_all(x, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]
    return F.array_distinct(F.concat(*runs))


def clamp_concurrency(x: Column | str) -> Column:
    return F.least(F.greatest(col(x), F.lit(1)), F.lit(100))


def endpoint(x: Column | str) -> Column:
    return F.concat(F.regexp_replace(col(x), r"/+\z", ""), F.lit("/v1/chat/completions"))


def lsx_place(contentuid: Column | str) -> Column:
    """(field, n) of `field#n`; null if it is something else."""
    x = col(contentuid)
    n = F.regexp_extract(x, r"\A[^#]*#(\d+)\z", 1).try_cast("long")
    return F.when(n.isNotNull(), F.struct(F.regexp_extract(x, r"\A([^#]*)#", 1).alias("field"), n.alias("n")))


def version_number(version: Column | str) -> Column:
    """A version as a number; 1 if it is none."""
    return F.coalesce(col(version).try_cast("int"), F.lit(1))


def percent(done: Column | str, total: Column | str) -> Column:
    """0 to 100; 0 of nothing."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(100.0 * col(done), col(total)))), F.lit(0.0))
