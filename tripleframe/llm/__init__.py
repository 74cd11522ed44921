"""Preparing the text of a graph for training: filters, duplicates, languages, packing, search.

The operators work on the library's own records. *Literals* are rows of a subject ``s`` and a literal text ``o``, as in
its triples; ``s`` may be an IRI or, as everywhere in this library before terms are rendered, the raw key it is made
from, so anything Spark can sort. Columns besides the named ones are ignored, whatever they are called, and results
hold only what the docstring lists. A NULL text is an empty one unless a docstring says otherwise.

Nothing outside this package imports it.
"""
