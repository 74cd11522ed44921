"""Streaming."""
from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import NULL, TYPE, case, i, money, n, t
from suite.scans import fresh
from suite.tables import class_map, mapping, table
from tripleframe.model import ClassMap
from tripleframe.streaming import stream_triples

_EVENTS = f"""
    select {t(i('event', 'event_id'), TYPE, n('Event'))} from events
    union all select {t(i('event', 'event_id'), n('eventType'), 'event_type', 'string')} from events where event_type is not null
    union all select {t(i('event', 'event_id'), n('value'), money('value'), 'decimal')} from events where value is not null
    union all select {t(i('event', 'event_id'), n('at'), "replace(cast(ts as varchar), ' ', 'T')", 'dateTime')} from events where ts is not null"""


def _run(spark, sf, distinct, edges=()):
    from tripleframe.sources.triples import load_triples
    m = mapping(spark, sf, ["Event", "Customer"])
    schema = table(spark, sf, "events").schema
    live = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out, ckpt = fresh(spark, "stream"), fresh(spark, "stream-state")
    cm = class_map(spark, sf, "Event")
    stream_triples(live, m, ClassMap("Event", live, cm.pk, cm.path, cm.props, unique=True), out, ckpt, distinct,
                   edges=edges).awaitTermination()
    return load_triples(spark, out)


@case("ST1_stream_triples", _EVENTS)
def st1(spark, sf):
    """The events file as a stream; whatever is there is turned into triples once."""
    return _run(spark, sf, None)


@case("ST1_stream_triples_dedup", _EVENTS)
def st1b(spark, sf):
    """The same with triples that were there before dropped, however late they come."""
    return _run(spark, sf, True)


@case("ST1_stream_edges", _EVENTS + f"""
    union all select {t(i('event', 'event_id'), n('performedBy'), i('customer', 'user_id'))} from events where user_id in (select c_custkey from customer)""")
def st1c(spark, sf):
    """Edges of the stream look their customers up in the static table."""
    return _run(spark, sf, None, ("performedBy",))
