"""Operators for text corpora: formatting, privacy, quality, language, mixing, search, near-duplicates, tokens."""
