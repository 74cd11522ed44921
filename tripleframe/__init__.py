"""Tables to a knowledge graph, and analysis of that graph, with Spark DataFrames."""
from tripleframe.functions.terms import Range, iri, lexical, local_name, namespace, value
from tripleframe.model import TRIPLE_SCHEMA, ClassMap, EdgeMap, Mapping, Tbox
from tripleframe.operators.triplify import (
    MappedTriples, class_triples, const_edge, direct_map, edge_triples, literal_triples, mapping_stats, materialize,
)
from tripleframe.plans.graph import Graph
from tripleframe.plans.patterns import Literal

__all__ = ["TRIPLE_SCHEMA", "ClassMap", "EdgeMap", "Graph", "Literal", "MappedTriples", "Mapping", "Range", "Tbox", "class_triples",
           "const_edge", "direct_map", "edge_triples", "iri", "lexical", "literal_triples", "local_name",
           "mapping_stats", "materialize", "namespace", "value"]
