"""Operators over mappings, triples and edge tables."""
