"""Operators for text corpora; nothing outside this package imports it."""
