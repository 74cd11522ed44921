"""Reading and writing tables, ontologies and triples."""
