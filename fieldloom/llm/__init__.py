"""Operators for preparing large text corpora: duplicates, language, quality, safety, packing."""
