"""Operators for building training data from a text corpus.  Nothing outside this subpackage imports it."""
