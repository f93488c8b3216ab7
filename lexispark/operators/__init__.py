"""Operators over entries, terms, files and events."""
