"""Operators for preparing large text corpora and embeddings; nothing else in the library imports this subpackage."""
