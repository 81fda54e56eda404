"""Corpus-preparation operators for large text collections (nothing else in fathom imports this)."""
