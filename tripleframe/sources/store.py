"""A store of triples in versions: a refresh writes only what differs, and readers never see half of it.

::

    path/data/write=<id>/p=<predicate>/bucket=<b>/*.parquet    what one refresh wrote
    path/manifest/write=<id>/*.parquet                         where every bucket of that version is, with its digest
    path/pointer/*.parquet                                     a row per version; the last one is current

A predicate's triples are dealt to buckets by a hash of the subject. A bucket's digest is its number of triples and two sums over hashes of them, so it does not
depend on their order, and digests of parts can be added up. A refresh takes the digests of the new triples in one aggregation, compares them with the
manifest, and writes only buckets that differ; then the manifest; then, in a file of its own, the pointer. A writer that dies before that leaves the
old version as it was, and files that no manifest names, which :meth:`TripleStore.vacuum` removes.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.functions import terms
from tripleframe.model import RDF_TYPE, TRIPLE_COLS, TRIPLE_SCHEMA

CELLS = 4096  # buckets are made of these; no predicate has more
BUCKET_TRIPLES = 4_000_000

_MANIFEST = "p string, bucket int, buckets int, n bigint, low bigint, high bigint, write string"
_POINTER = "version bigint, write string"


def cell(s: Column | str) -> Column:
    """Number from 0 to ``CELLS`` - 1 that a subject's triples are dealt to."""
    return F.pmod(F.xxhash64(s), F.lit(CELLS)).cast("int")


def _sums() -> list[Column]:
    # Halves of 32 bits, so that the sums stay within 64 for two thousand million triples.
    h = F.xxhash64("s", F.coalesce("o", F.lit("")), F.coalesce("o_kind", F.lit("")), F.coalesce("o_type", F.lit("")))
    return [F.count(F.lit(1)).alias("n"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high")]


def digests(triples: DataFrame) -> DataFrame:
    """``p``, ``cell``, ``n``, ``low`` and ``high`` of a set of triples: one aggregation, combined in every task first."""
    return triples.groupBy("p", cell("s").alias("cell")).agg(*_sums())


def _buckets(cells: DataFrame, known: DataFrame, bucket_triples: int) -> DataFrame:
    """Cells put together to buckets; a predicate keeps its number of buckets until it is more than twice too small."""
    total = cells.groupBy("p").agg(F.sum("n").alias("all"))
    had = known.groupBy("p").agg(F.max("buckets").alias("had"))
    fit = F.least(F.lit(CELLS), F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("all") / bucket_triples)))).cast("int"))
    wanted = F.when(F.col("had").isNotNull() & (F.col("had") * 2 >= fit), F.col("had")).otherwise(fit).cast("int")
    sized = total.join(had, "p", "left").select("p", wanted.alias("buckets"))
    return cells.join(sized, "p").groupBy("p", bucket_of(F.col("cell"), F.col("buckets")).alias("bucket"), "buckets").agg(
        *[F.sum(c).alias(c) for c in ("n", "low", "high")])


def bucket_of(in_cell: Column, buckets: Column) -> Column:
    """Bucket of a cell where a predicate has that many buckets, a power of two."""
    return F.floor(in_cell * buckets / CELLS).cast("int")


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: the version that is current now, and how many buckets it wrote, left as they were and dropped."""
    version: int
    written: int
    kept: int
    dropped: int

    @property
    def changed(self) -> bool:
        return bool(self.written or self.dropped)


class TripleStore:
    """Triples under ``path``. One writer at a time; readers need not care.

    The manifest comes to the driver: a row for some millions of triples (``bucket_triples``), never the triples.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_triples: int = BUCKET_TRIPLES):
        self.spark, self.path, self.bucket_triples = spark, path.rstrip("/"), bucket_triples

    # ------------------------------------------------------------ what there is

    def _fs(self, sub: str = ""):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sub}" if sub else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _there(self, sub: str) -> bool:
        fs, p = self._fs(sub)
        return bool(fs.exists(p))

    def _pointers(self) -> list:
        if not self._there("pointer"):
            return []
        return self.spark.read.schema(_POINTER).parquet(f"{self.path}/pointer").distinct().orderBy("version").collect()

    def versions(self) -> list[int]:
        """Versions that can be read, rising."""
        return [r.version for r in self._pointers()]

    def _write_of(self, version: int | None) -> str | None:
        found = self._pointers()
        if version is None:
            return found[-1].write if found else None
        for r in found:
            if r.version == version:
                return r.write
        raise ValueError(f"no version {version}")

    def manifest(self, version: int | None = None) -> DataFrame:
        """Buckets of a version (``p``, ``bucket``, ``buckets``, ``n``, ``low``, ``high``, ``write``: which refresh wrote it)."""
        write = self._write_of(version)
        if write is None:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/write={write}")

    # ------------------------------------------------------------ reading

    def load(self, version: int | None = None, values: bool = False) -> DataFrame:
        """The triples of a version, by default the current one. Only its folders are read, and of them those of the predicates asked for.

        ``values`` adds the numbers ``o_num`` and the points in time ``o_at`` of literals, by which a graph of the frame skips what is not in a range.
        """
        rows = self.manifest(version).collect()
        if not rows:
            empty = self.spark.createDataFrame([], TRIPLE_SCHEMA)
            return empty.withColumns({"o_num": F.lit(None).cast("double"), "o_at": F.lit(None).cast("timestamp_ntz")}) if values else empty
        frames = [*(f"{f.name} {f.dataType.simpleString()}" for f in TRIPLE_SCHEMA if f.name != "p"), "o_num double", "o_at timestamp_ntz"]
        out = None
        for write in sorted({r.write for r in rows}):
            data = self.spark.read.schema(", ".join([*frames, "p string", "bucket int"])).parquet(f"{self.path}/data/write={write}")
            mine = [r for r in rows if r.write == write]
            data = data.where(_one_of(mine, self._written(write))).select(*TRIPLE_COLS, *(("o_num", "o_at") if values else ()))
            out = data if out is None else out.unionByName(data)
        return out

    def _written(self, write: str) -> dict[str, int]:
        """How many buckets a refresh wrote, by predicate, according to its own manifest."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/write={write}").where(F.col("write") == write).groupBy("p").count().collect()
        return {r.p: r["count"] for r in rows}

    # ------------------------------------------------------------ writing

    def refresh(self, triples: DataFrame) -> Refreshed:
        """Make ``triples`` (a set) the current version; nothing is written if they are what is stored.

        Two passes: digests, and the triples of buckets that differ. ``triples`` should give the same in both, as anything read from files does.
        """
        before = self._pointers()
        old = self.manifest().collect()
        known = self.spark.createDataFrame([tuple(r) for r in old], _MANIFEST)
        new = _buckets(digests(triples), known, self.bucket_triples).collect()
        had = {(r.p, r.bucket, r.buckets): r for r in old}
        same = {(r.p, r.bucket, r.buckets) for r in new
                if (o := had.get((r.p, r.bucket, r.buckets))) is not None and (o.n, o.low, o.high) == (r.n, r.low, r.high)}
        differ = [r for r in new if (r.p, r.bucket, r.buckets) not in same]
        dropped = len(had.keys() - {(r.p, r.bucket, r.buckets) for r in new})
        version = before[-1].version if before else 0
        if not differ and not dropped and before:
            return Refreshed(version, 0, len(same), 0)
        write = uuid.uuid4().hex
        if differ:
            self._write_data(triples, differ, write)
        rows = [(*(r[c] for c in ("p", "bucket", "buckets", "n", "low", "high")), write) for r in differ]
        rows += [tuple(had[k]) for k in same]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/write={write}")
        now = self._pointers()
        if [r.version for r in now] != [r.version for r in before]:
            raise RuntimeError("another writer has made a version meanwhile; refresh again")
        self.spark.createDataFrame([(version + 1, write)], _POINTER).coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")
        return Refreshed(version + 1, len(differ), len(same), dropped)

    def _write_data(self, triples: DataFrame, differ: list, write: str) -> None:
        buckets = {r.p: r.buckets for r in differ}
        rows = triples.select(*TRIPLE_COLS).where(F.col("p").isin(sorted(buckets)))
        many = reduce(lambda out, p: out.when(F.col("p") == p, buckets[p]), [p for p in buckets if buckets[p] > 1], F.when(F.lit(False), 1)).otherwise(1)
        rows = rows.withColumn("bucket", bucket_of(cell("s"), many)).where(_one_of(differ, buckets))
        # Literals with a value are in its order, so that a range of values is in few row groups; others in that of their subjects.
        rows = rows.withColumns({"o_num": F.when(F.col("o_type").isin(*terms.NUMBERS), terms.number(F.col("o"))), "o_at": F.when(F.col("o_type").isin(*terms.TIMES), terms.instant(F.col("o")))})
        keys = [F.col("p"), F.col("bucket"), F.when(F.col("p") == RDF_TYPE, F.col("o")), F.col("o_num"), F.col("o_at"), F.col("s")]
        rows.hint("rebalance", "p", "bucket").sortWithinPartitions(*keys).write.partitionBy("p", "bucket").parquet(f"{self.path}/data/write={write}")

    def clear(self) -> Refreshed:
        """Make the empty graph the current version."""
        return self.refresh(self.spark.createDataFrame([], TRIPLE_SCHEMA))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Forget all versions but the last ``keep`` and delete what no other version needs; returns the folders deleted."""
        if keep < 1:
            raise ValueError("at least one version is kept")
        found = self._pointers()
        stay = found[-keep:]
        needed: set[str] = {r.write for r in stay}
        for r in stay:
            needed |= {x.write for x in self.manifest(r.version).select("write").distinct().collect()}
        if len(stay) < len(found):
            fs, p = self._fs("pointer")
            files = {f.getPath().toString() for f in fs.listStatus(p)}
            # The rows that stay are written anew before the old files go; a repeated row says the same.
            self.spark.createDataFrame([tuple(r) for r in stay], _POINTER).coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")
            for f in files:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f), False)
        gone = []
        for sub in ("data", "manifest"):
            fs, p = self._fs(sub)
            if fs.exists(p):
                for f in fs.listStatus(p):
                    name = f.getPath().getName()
                    if name.startswith("write=") and name[6:] not in needed:
                        fs.delete(f.getPath(), True)
                        gone.append(f"{sub}/{name}")
        return sorted(gone)


def _one_of(rows: list, whole: dict[str, int]) -> Column:
    """Condition on ``p`` and ``bucket`` for the buckets of ``rows``; ``whole`` says how many each predicate has, so that whole predicates need no list."""
    by: dict[str, list[int]] = {}
    for r in rows:
        by.setdefault(r.p, []).append(r.bucket)
    full = sorted(p for p, b in by.items() if len(b) == whole.get(p))
    out = F.col("p").isin(full) if full else F.lit(False)
    for p in sorted(set(by) - set(full)):
        out = out | (F.col("p") == p) & F.col("bucket").isin(sorted(by[p]))
    return out


def reconcile_store(expected: DataFrame, store: TripleStore, version: int | None = None) -> DataFrame:
    """``p``, ``expected``, ``stored`` and ``state`` for every predicate of a graph or of a store.

    ``state`` is ``match`` if the digests of the expected triples equal those of the stored ones, which are taken from the files, not from the manifest; else ``missing``
    or ``extra`` where one side has none, and ``mismatch``. Equal counts of different triples are a mismatch.
    """
    side = lambda rows, name: rows.groupBy("p").agg(*[F.sum(c).alias(c + name) for c in ("n", "low", "high")])
    both = side(digests(expected), "_e").join(side(digests(store.load(version)), "_s"), "p", "full")
    state = (F.when(F.col("n_s").isNull(), "missing").when(F.col("n_e").isNull(), "extra")
             .when((F.col("n_e") == F.col("n_s")) & (F.col("low_e") == F.col("low_s")) & (F.col("high_e") == F.col("high_s")), "match").otherwise("mismatch"))
    return both.select("p", F.coalesce("n_e", F.lit(0)).cast("bigint").alias("expected"), F.coalesce("n_s", F.lit(0)).cast("bigint").alias("stored"), state.alias("state"))
