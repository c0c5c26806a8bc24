"""Operators for preparing text corpora for language models. Nothing outside this package imports it."""
