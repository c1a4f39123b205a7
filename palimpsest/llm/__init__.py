"""Operators that prepare text corpora, conversations and embeddings for model training."""
