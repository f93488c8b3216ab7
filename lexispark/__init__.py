"""Localization-text analytics on Spark: extraction, glossaries, consistency, planning, event folding, publishing."""
