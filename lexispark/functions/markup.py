"""Inline tags in texts, and what is escaped when they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that stay markup; case matters.
INLINE_TAGS = ["LSTag", "font", "i", "b", "u", "br"]


def tag_name(tag: Column) -> Column:
    """The name of `<...>`; empty for comments, declarations and instructions."""
    return F.regexp_extract(tag, r"(?s)^<\s*/?\s*([^\s/>!?<][^\s/>]*)", 1)


def is_inline_tag(tag: Column) -> Column:
    return tag_name(tag).isin(INLINE_TAGS)


def tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"<[^>]*>"), F.lit(0))


def escape_text(x: Column) -> Column:
    out = x
    for raw, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(named))
    return out


def escape_fragment(text: Column) -> Column:
    """text as XML: inline tags as they are, all else escaped."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<[^>]*>|[^<]+|<"), F.lit(0))
    return F.array_join(F.transform(found, lambda s: F.when(s.startswith("<") & s.endswith(">") & is_inline_tag(s), s).otherwise(escape_text(s))), "")
