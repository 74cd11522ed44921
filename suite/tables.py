"""The mapping over the benchmark tables that all cases share."""
from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe import ClassMap, EdgeMap, Mapping, Tbox

NS = "http://example.org/kg#"
MONEY = "decimal(18,2)"


@lru_cache(maxsize=512)
def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # One DataFrame object per table, so that maps over the same table are recognised as such.
    return spark.read.parquet(f"{sf}/{name}.parquet")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return _read(spark, sf.rstrip("/"), name)


# class: table, key, path, properties
CLASSES = {
    "Region": ("region", ["r_regionkey"], {"regionName": ("r_name", "string")}),
    "Nation": ("nation", ["n_nationkey"], {"nationName": ("n_name", "string")}),
    "Customer": ("customer", ["c_custkey"], {"customerName": ("c_name", "string"),
                                             "segment": ("c_mktsegment", "string"),
                                             "balance": ("c_acctbal", MONEY)}),
    "Supplier": ("supplier", ["s_suppkey"], {"supplierName": ("s_name", "string"),
                                             "supplierBalance": ("s_acctbal", MONEY)}),
    "Part": ("part", ["p_partkey"], {"partName": ("p_name", "string"), "brand": ("p_brand", "string"),
                                     "partType": ("p_type", "string"), "size": ("p_size", "integer"),
                                     "price": ("p_retailprice", MONEY)}),
    "Order": ("orders", ["o_orderkey"], {"status": ("o_orderstatus", "string"),
                                         "total": ("o_totalprice", MONEY),
                                         "orderDate": ("o_orderdate", "date"),
                                         "priority": ("o_orderpriority", "string")}),
    "UrgentOrder": ("orders", ["o_orderkey"], {}),
    "Event": ("events", ["event_id"], {"eventType": ("event_type", "string"), "value": ("value", MONEY),
                                       "at": ("ts", "dateTime")}),
    "Document": ("documents", ["doc_id"], {"lang": ("lang", "string"), "source": ("source", "string"),
                                           "nChars": ("n_chars", "integer")}),
    "Assessment": ("labels", ["doc_id"], {"quality": ("quality", "integer"), "toxic": ("toxic", "integer")}),
    "Turn": ("conversations", ["conv_id", "turn"], {"role": ("role", "string")}),
    "Page": ("pages", ["page_id"], {"url": ("url", "string")}),
}

# edge: domain, range, mode, linking table, domain columns, range columns
EDGES = {
    "inRegion": ("Nation", "Region", "domain_fk", None, ["n_regionkey"], []),
    "customerNation": ("Customer", "Nation", "domain_fk", None, ["c_nationkey"], []),
    "supplierNation": ("Supplier", "Nation", "domain_fk", None, ["s_nationkey"], []),
    "placedBy": ("Order", "Customer", "domain_fk", None, ["o_custkey"], []),
    "hasAssessment": ("Document", "Assessment", "range_fk", None, ["doc_id"], []),
    "containsPart": ("Order", "Part", "junction", "lineitem", ["l_orderkey"], ["l_partkey"]),
    "suppliedBy": ("Part", "Supplier", "junction", "lineitem", ["l_partkey"], ["l_suppkey"]),
    "performedBy": ("Event", "Customer", "domain_fk", None, ["user_id"], []),
    # the inverse of placedBy; used only where asked for
    "places": ("Customer", "Order", "range_fk", None, ["o_custkey"], []),
}
DEFAULT_EDGES = [e for e in EDGES if e != "places"]

SUB_CLASS = [("Customer", "Party"), ("Supplier", "Party"), ("Party", "Agent"), ("Nation", "Place"),
             ("Region", "Place"), ("UrgentOrder", "Order")]
SUB_PROP = [("customerNation", "locatedIn"), ("supplierNation", "locatedIn"), ("inRegion", "locatedIn"),
            ("locatedIn", "relatedTo")]
DOMAIN = [("placedBy", "Order"), ("containsPart", "Order"), ("performedBy", "Event")]
RANGE = [("placedBy", "Customer"), ("containsPart", "Part"), ("customerNation", "Nation"),
         ("total", "xsd:decimal")]
INVERSE = [("places", "placedBy")]


def class_map(spark: SparkSession, sf: str, name: str, df: DataFrame | None = None, **over) -> ClassMap:
    source, pk, props = CLASSES[name]
    if df is None:
        df = table(spark, sf, source)
        if name == "UrgentOrder":
            df = df.where(F.col("o_orderpriority") == "1-URGENT")
    args = dict(path="order" if name == "UrgentOrder" else name.lower(), props=props, unique=True)
    return ClassMap(name, df, pk, **{**args, **over})


def mapping(spark: SparkSession, sf: str, classes: list[str] | None = None,
            edges: list[str] | None = None) -> Mapping:
    names = classes if classes is not None else list(CLASSES)
    cms = [class_map(spark, sf, n) for n in names]
    ems = []
    for e in edges if edges is not None else [x for x in DEFAULT_EDGES
                                              if EDGES[x][0] in names and EDGES[x][1] in names]:
        domain, rng, mode, link, d_cols, r_cols = EDGES[e]
        ems.append(EdgeMap(e, domain, rng, mode, d_cols, r_cols,
                           table(spark, sf, link) if link else None))
    return Mapping(NS, cms, ems, strict=True)


def tbox(spark: SparkSession, **over) -> Tbox:
    classes = [(c, None) for c in [*CLASSES, "Party", "Agent", "Place"]]
    props = [(p, "data", None) for _, _, ps in CLASSES.values() for p in ps]
    props += [(e, "object", None) for e in [*EDGES, "locatedIn", "relatedTo"]]
    args = dict(classes=classes, properties=props, sub_class=SUB_CLASS, sub_prop=SUB_PROP, domain=DOMAIN,
                range=RANGE, inverse=INVERSE)
    return Tbox.of(spark, NS, **{**args, **over})
