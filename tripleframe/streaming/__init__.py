"""Continuous triple generation."""
from tripleframe.streaming.triples import complete_edges, missing_edges, stream_triples

__all__ = ["complete_edges", "missing_edges", "stream_triples"]
