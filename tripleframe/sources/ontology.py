"""Ontologies in RDF/XML, one file or a corpus, by Spark's XML source."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.model import Tbox
from tripleframe.plans.support import union_all

_REF = "array<struct<`_rdf:resource`:string>>"
_TXT = "array<struct<_VALUE:string,`_xml:lang`:string>>"
_ENTITY = f"""`_rdf:about` string, `rdfs:label` {_TXT}, `rdfs:comment` {_TXT}, `rdfs:domain` {_REF},
    `rdfs:range` {_REF}, `rdfs:subClassOf` {_REF}, `rdfs:subPropertyOf` {_REF}, `owl:inverseOf` {_REF},
    `owl:equivalentClass` {_REF}, `owl:disjointWith` {_REF}"""

# XML element of each kind of entity.
ELEMENTS = {"class": "owl:Class", "object": "owl:ObjectProperty", "data": "owl:DatatypeProperty"}


@dataclass
class OntologyFrames:
    """Everything read: one row per entity and file, and one per (entity, axiom, target)."""
    entities: DataFrame    # kind, iri, label, comment, file
    axioms: DataFrame      # kind, iri, axiom, target, file

    def tbox(self) -> Tbox:
        e, a = self.entities, self.axioms

        def pairs(axiom: str, kind: str | None = None) -> DataFrame:
            rows = a.where(F.col("axiom") == axiom)
            return (rows if kind is None else rows.where(F.col("kind") == kind)).select("iri", "target").distinct()

        props = e.where("kind <> 'class'").groupBy("iri").agg(F.min("kind"), F.min("label"))
        return Tbox.of(
            e.sparkSession, classes=e.where("kind = 'class'").groupBy("iri").agg(F.min("label")), properties=props,
            sub_class=pairs("subClassOf"), sub_prop=pairs("subPropertyOf"), domain=pairs("domain"),
            range=pairs("range"), inverse=pairs("inverseOf"), equivalent=pairs("equivalentClass"),
            disjoint=pairs("disjointWith"))


def read_ontology(spark: SparkSession, path: str) -> OntologyFrames:
    """Read typed elements of one RDF/XML file or of all files under a glob, with the file as provenance.

    The usual prefixes (``owl``, ``rdf``, ``rdfs``) are expected. Anonymous elements, such as nested
    restrictions, have no name and are left out.
    """
    parts = []
    for kind, tag in ELEMENTS.items():
        rows = (spark.read.format("xml").option("rowTag", tag).schema(_ENTITY).load(path)
                .select(F.lit(kind).alias("kind"), "*", F.input_file_name().alias("file"))
                .where("`_rdf:about` is not null").withColumnRenamed("_rdf:about", "iri"))
        parts.append(rows)
    rows = union_all(parts)
    first = lambda c: F.array_min(F.transform(F.col(f"`{c}`"), lambda x: x["_VALUE"]))
    entities = rows.select("kind", "iri", first("rdfs:label").alias("label"), first("rdfs:comment").alias("comment"),
                           F.element_at(F.split("file", "/"), -1).alias("file"))
    names = ["rdfs:domain", "rdfs:range", "rdfs:subClassOf", "rdfs:subPropertyOf", "owl:inverseOf",
             "owl:equivalentClass", "owl:disjointWith"]
    def targets(name):
        axiom = F.lit(name.split(":")[1]).alias("axiom")
        return F.coalesce(F.transform(F.col(f"`{name}`"), lambda x: F.struct(axiom, x["_rdf:resource"].alias("target"))),
                          F.array())

    cells = F.flatten(F.array(*[targets(n) for n in names]))
    axioms = rows.select("kind", "iri", F.element_at(F.split("file", "/"), -1).alias("file"), F.inline(cells)).where(
        "target is not null").select("kind", "iri", "axiom", "target", "file")
    return OntologyFrames(entities, axioms)
