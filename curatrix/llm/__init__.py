"""Operators for building training corpora from text at scale."""
