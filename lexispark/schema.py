"""Schemas of the records that operators exchange. Row order is significant in this domain, so records carry pos."""

from __future__ import annotations

ENTRY = "pos long, id string, source_file string, source string, target string, contentuid string, version string, status string, error string"
TERM = "pos long, source string, target string, category string, source_kind string, enabled boolean, ambiguous boolean, whole_word boolean, case_sensitive boolean, count long"
FILE = "pos long, name string, size long, kind string, language string"
EVENT = "ts timestamp, seq long, type string, entryId string, status string, text string, message string, total long, failed long"

#: States of an entry.
PENDING, TRANSLATING, TRANSLATED, EDITED, ERROR = "pending", "translating", "translated", "edited", "error"
