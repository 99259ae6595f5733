"""Operators for training-data corpora: documents, pages and vectors at scale."""
