"""Readers and writers for documents, parsed sections and embeddings."""
