"""Operators for large text corpora: cleaning, de-duplication, mixing, scoring and search."""
