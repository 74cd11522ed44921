"""Column expressions used throughout the library."""
from tripleframe.functions.terms import (
    XSD_TYPES, encode, iri, lexical, local_name, namespace, nt_escape, nt_unescape, object_to_nt, value,
)

__all__ = ["XSD_TYPES", "encode", "iri", "lexical", "local_name", "namespace", "nt_escape",
           "nt_unescape", "object_to_nt", "value"]
