"""Operators that clean, scan, format and encode text corpora."""
