"""Triples of an append-only source, as it grows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tripleframe.model import TRIPLE_COLS, ClassMap, Mapping
from tripleframe.operators import triplify
from tripleframe.plans.support import union_all
from tripleframe.sources.triples import load_triples


def triple_stream(df: DataFrame, m: Mapping, cm: ClassMap, distinct: bool | None = None, edges: tuple[str, ...] = ()) -> DataFrame:
    """Class and literal triples of a streaming table, and those of its foreign-key ``edges``.

    With a key declared unique this is a stateless projection, however old a row is. ``distinct`` (by default, when it is not
    declared) drops triples that were there before, by state that holds every triple's hash and is never forgotten: no
    watermark, so a late row is not lost, but the state grows with the graph. Edges look their parents up in the
    static tables of ``m``, as they are when a batch runs; :func:`complete_edges` adds those whose parent came later.
    """
    live = ClassMap(cm.name, df, cm.pk, cm.path, cm.props, cm.sep, True, cm.consts)
    structs = [c for _, c in triplify._class_outputs(m, live, triplify.Widening.none())]
    frames = [triplify._class_frame(m, live, structs)]
    if edges:
        own = [e for e in m.edges if e.name in edges]
        moving = Mapping(m.ns, [live, *[c for c in m.classes if c.name != cm.name]], own, strict=True)
        for link in moving.links:
            if link.owner is not live:
                raise ValueError(f"edge {link.edge.name} is not a foreign key in the table of {cm.name}")
            frames.append(triplify.edge_triples(moving, link.edge))
    out = union_all(frames)
    return out.dropDuplicates(TRIPLE_COLS) if (not cm.unique if distinct is None else distinct) else out


def stream_triples(df: DataFrame, m: Mapping, cm: ClassMap, path: str, checkpoint: str, distinct: bool | None = None,
                   edges: tuple[str, ...] = (), once: bool = True) -> StreamingQuery:
    """Write the triples of a stream to a parquet store; ``once`` takes what is there and stops.

    The checkpoint folder and the sink's commit log make every input file count exactly once.
    """
    out = triple_stream(df, m, cm, distinct, edges)
    writer = (out.writeStream.format("parquet").outputMode("append").partitionBy("p")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def missing_edges(m: Mapping, path: str, edges: tuple[str, ...]) -> DataFrame:
    """Triples of ``edges`` of the static mapping that a streamed store does not hold, such as those whose parent came late."""
    spark = m.classes[0].df.sparkSession
    wanted = union_all([triplify.edge_triples(m, e) for e in m.edges if e.name in edges])
    have = load_triples(spark, path).where("o_kind = 'iri'").select("s", "p", "o")
    return wanted.join(have, ["s", "p", "o"], "left_anti").select(*TRIPLE_COLS)


def complete_edges(m: Mapping, path: str, extra: str, edges: tuple[str, ...]) -> None:
    """Write what :func:`missing_edges` finds to ``extra``, a store of its own beside the one a stream writes to."""
    missing_edges(m, path, edges).write.mode("overwrite").partitionBy("p").parquet(extra)
