"""Readers of documents, price pages, quote feeds and drawings."""
