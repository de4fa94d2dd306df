"""Buckets: versioned tables of documents."""
