"""The query surface: match graph patterns over stored triples or directly over the mapped tables.

Both kinds of graph give the same bindings for the same patterns; results are DataFrames with one
column per variable, and everything after that (filters, grouping, ordering) is plain DataFrame code.
"""
from __future__ import annotations

from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.functions import terms
from tripleframe.functions.terms import Range
from tripleframe.model import RDF_TYPE, TRIPLE_COLS, Mapping, Tbox
from tripleframe.operators.triplify import MappedTriples
from tripleframe.plans.patterns import (
    Literal, Pattern, hidden, in_join_order, is_var, longest_chain, normalise,
)
from tripleframe.plans.support import deal


# What a store may keep beside its triples: the number or the point in time that a literal stands for.
VALUE_COLS = ("o_num", "o_at")


class Graph(ABC):
    @staticmethod
    def materialized(triples: DataFrame | MappedTriples, ns: str = "") -> "StoredGraph":
        """A graph of stored triples, or of those of a mapping, of which a pattern then makes the ones it asks for."""
        return StoredGraph(triples, ns)

    @staticmethod
    def virtual(mapping: Mapping, tbox: Tbox | None = None, inverse: bool = False) -> "Graph":
        from tripleframe.plans.virtual import VirtualGraph
        return VirtualGraph(mapping, tbox, inverse)

    @abstractmethod
    def iri(self, name: str) -> str: ...

    @abstractmethod
    def _bind(self, patterns: list[Pattern], typed: dict[str, str], extras: bool, ranges: dict[str, Range] | None = None) -> DataFrame:
        """Bindings: a column per visible variable, with ``<var>__kind``/``<var>__type`` if asked."""

    @abstractmethod
    def _aggregate(self, patterns: list[Pattern], by: list[str], aggs: dict[str, tuple[str, str | None]], typed: dict[str, str],
                   ranges: dict[str, Range]) -> DataFrame | None:
        """The columns ``by`` with partial aggregates ``__n``, ``__sum_v``, ``__min_v``, ``__max_v``, ``__distinct_v``; None to aggregate bindings instead."""

    # ------------------------------------------------------------ matching

    def match(self, *patterns, typed: dict[str, str] | None = None, with_types: bool = False,
              max_hops: int | None = None, ranges: dict[str, Range] | None = None) -> DataFrame:
        """Bindings of a set of patterns.

        ``typed`` asks for typed values instead of text for some variables, e.g. ``{"total": "decimal"}``.
        ``with_types`` adds ``<var>__type``, the literal type of each variable (NULL for an IRI).
        ``ranges`` keeps bindings whose value of a variable, the object of some pattern, lies in a :class:`Range`. Its bounds reach the scan, of raw columns or of the
        values that a store keeps beside its triples, which a filter on the result cannot always.
        """
        ps = self._checked(patterns, max_hops)
        self._objects(ps, ranges)
        names = [v for p in ps for v in p.variables() if not hidden(v)]
        names = list(dict.fromkeys(v[1:] for v in names))
        if len({v.lower() for v in names}) < len(names):
            raise ValueError("variables that differ only in case would become one column")
        out = self._bind(ps, dict(typed or {}), with_types, ranges)
        keep = [c for n in names for c in ([n, f"{n}__type"] if with_types else [n])]
        return out.select(*keep)

    @staticmethod
    def _objects(patterns: list[Pattern], ranges: dict[str, Range] | None) -> None:
        lost = [v for v in ranges or {} if not any(p.o == "?" + v for p in patterns)]
        if lost:
            raise ValueError(f"a range needs an object of a pattern, which is not {', '.join(lost)}")

    def _checked(self, patterns, max_hops: int | None) -> list[Pattern]:
        ps = normalise(patterns, self.iri)
        if not ps:
            raise ValueError("at least one pattern is needed")
        # The same for either kind of graph: a step counts if its object goes on as a node, whatever a schema may know.
        hops = longest_chain(ps, lambda p: sum(p.o in q.ends() for q in ps) > 1)
        if max_hops is not None and hops > max_hops:
            raise ValueError(f"{hops} hops exceed the limit of {max_hops}")
        return ps

    def count_by(self, by: list[str], *patterns, typed: dict[str, str] | None = None,
                 max_hops: int | None = None) -> DataFrame:
        """Number of bindings per value of some variables: ``match(...).groupBy(by).count()`` as ``n``.

        Bindings are never written out. A variable is counted away as soon as no later pattern needs it, so
        a chain of many-to-many edges stays as large as its tables instead of multiplying, and a key that
        holds a third of all rows is one row by the time it is joined.
        """
        return self.aggregate(by, {"n": ("count", None)}, *patterns, typed=typed, max_hops=max_hops)

    def aggregate(self, by: list[str], aggs: dict[str, tuple[str, str | None]], *patterns, typed: dict[str, str] | None = None,
                  max_hops: int | None = None, ranges: dict[str, Range] | None = None) -> DataFrame:
        """``match(...).groupBy(by).agg(...)`` without the bindings: ``aggs`` maps a column to ``(function, variable)``.

        Functions are ``count`` (of bindings; the variable may be None), ``count_distinct``, ``sum``, ``avg``, ``min`` and ``max``; the last four are of typed
        values where ``typed`` names the variable. Partial sums, extremes and counts per key go through the joins, so a chain of many-to-many edges
        stays as large as its tables. On mapped tables all of it runs on raw keys; IRIs are made of the results.
        """
        ps = self._checked(patterns, max_hops)
        known, typed = {v for p in ps for v in p.variables()}, dict(typed or {})
        lost = [v for v in [*by, *(v for _, v in aggs.values() if v)] if "?" + v not in known]
        if lost:
            raise ValueError(f"no pattern binds {', '.join(lost)}")
        odd = [how for how, v in aggs.values() if how not in ("count", "count_distinct", "sum", "avg", "min", "max") or v is None and how != "count"]
        if odd or set(aggs) & set(by):
            raise ValueError(f"no such aggregate: {', '.join(odd) or 'names of groups and aggregates must differ'}")
        bare = [v for how, v in aggs.values() if how in ("sum", "avg") and v not in typed]
        if bare:
            raise ValueError(f"sums need a type of {', '.join(bare)}")
        self._objects(ps, ranges)
        out = self._aggregate(ps, list(by), aggs, typed, ranges or {})
        if out is None:
            return self._bind(ps, typed, False, ranges).groupBy(*by).agg(*_plain_aggregates(aggs))
        if "__n" not in out.columns:
            return out
        cols = []
        for name, (how, v) in aggs.items():
            value = {"count": F.col("__n"), "count_distinct": F.col(f"__distinct_{v}"), "avg": F.try_divide(F.col(f"__sum_{v}").cast(_result_type("sum", typed[v])) if how == "avg" else F.lit(None), F.col(f"__known_{v}"))}.get(how, F.col(f"__{how}_{v}"))
            cols.append((value if how in ("min", "max") else value.cast(_result_type(how, typed.get(v)))).alias(name))
        return out.select(*by, *cols)

    def ask(self, *patterns) -> DataFrame:
        """One row, one boolean: whether there is any binding."""
        hit = self._bind(normalise(patterns, self.iri), {}, False).limit(1)
        return hit.agg((F.count(F.lit(1)) > 0).alias("answer"))

    def construct(self, template: list[tuple], *patterns) -> DataFrame:
        """New triples, one per template row and binding, as a set."""
        ps = normalise(patterns, self.iri)
        rows = self._bind(ps, {}, True)
        have = set(rows.columns)

        def cell(t):
            if isinstance(t, Literal):
                return F.lit(t.text), F.lit("lit"), F.lit(t.xsd)
            if not is_var(t):
                return F.lit(self.iri(t)), F.lit("iri"), F.lit(None).cast("string")
            if t[1:] not in have:
                raise ValueError(f"{t} is not bound by the patterns")
            return F.col(t[1:]), F.col(f"{t[1:]}__kind"), F.col(f"{t[1:]}__type")

        made = []
        for s, p, o in template:
            (s_, s_kind, _), (p_, p_kind, _), (o_, kind, xsd) = cell(s), cell(p), cell(o)
            # A literal can be neither subject nor predicate; such a row gives no triple.
            ok = (s_kind == "iri") & (p_kind == "iri")
            made.append(F.when(ok, F.struct(s_.alias("s"), p_.alias("p"), o_.alias("o"),
                                            kind.alias("o_kind"), xsd.alias("o_type"))))
        out = rows.select(F.explode(F.array(*made)).alias("t")).where("t is not null").select("t.*")
        size = self._source_rows()
        return (out if size is None else deal(out, size * len(template), "s", "p", "o")).dropDuplicates(TRIPLE_COLS)

    def _source_rows(self) -> int | None:
        """Rows of the tables behind the graph, by which texts are dealt to tasks; None if they are not known without making them."""
        return None

    def describe(self, iri: str) -> DataFrame:
        """All triples with the resource as subject."""
        out = self._bind([Pattern(self.iri(iri), "?p", "?o")], {}, True)
        return out.select(F.lit(self.iri(iri)).alias("s"), "p", "o", F.col("o__kind").alias("o_kind"),
                          F.col("o__type").alias("o_type"))

    def census(self) -> DataFrame:
        """Number of instances of every class."""
        return self.match(("?x", "a", "?cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))

    def triples(self) -> DataFrame:
        out = self._bind([Pattern("?s", "?p", "?o")], {}, True)
        return out.select("s", "p", "o", F.col("o__kind").alias("o_kind"), F.col("o__type").alias("o_type"))

    def triple_count(self) -> DataFrame:
        return self.match(("?s", "?p", "?o")).agg(F.count(F.lit(1)).alias("n"))

    # ------------------------------------------------------------ combining with earlier bindings

    def _on(self, df: DataFrame, patterns) -> tuple[DataFrame, list[str]]:
        other = self.match(*patterns)
        shared = [c for c in other.columns if c in df.columns]
        if not shared:
            raise ValueError("patterns share no variable with the rows they are combined with")
        return other, shared

    def optional(self, df: DataFrame, *patterns) -> DataFrame:
        other, shared = self._on(df, patterns)
        return df.join(other, shared, "left")

    def minus(self, df: DataFrame, *patterns) -> DataFrame:
        other, shared = self._on(df, patterns)
        return df.join(other, shared, "left_anti")

    def exists(self, df: DataFrame, *patterns) -> DataFrame:
        other, shared = self._on(df, patterns)
        return df.join(other, shared, "left_semi")


def _plain_aggregates(aggs: dict[str, tuple[str, str | None]]) -> list:
    return [(F.count(F.lit(1)) if how == "count" else getattr(F, how)(v)).alias(name) for name, (how, v) in aggs.items()]


def _result_type(how: str, xsd: str | None) -> str:
    """Type that Spark gives a sum or an average of values of a literal type."""
    if how in ("count", "count_distinct"):
        return "bigint"
    kind = terms.value_type(xsd)
    if kind.startswith("decimal"):
        p, s = (int(x) for x in kind[8:-1].split(","))
        return f"decimal({min(38, p + 10)},{s})" if how == "sum" else f"decimal({min(38, p + 4)},{min(38, s + 4)})"
    return "double" if how == "avg" or kind in ("double", "float") else "bigint"


def _kinded(df: DataFrame, v: str) -> bool:
    return f"{v}__kind" in df.columns


def _columns(df: DataFrame, v: str) -> list[str]:
    return [v, f"{v}__kind", f"{v}__type"] if _kinded(df, v) else [v]


def _counted(df: DataFrame, have: set[str], live: set[str], n: str | None) -> DataFrame:
    """Rows grouped by the live variables, with how many bindings each stands for in ``__n``."""
    cols = [c for v in sorted(live) for c in _columns(df, v)]
    count = F.lit(1).cast("bigint") if n is None else F.col(n)
    if live == have:
        return df.select(*cols, count.alias("__n"))
    return df.groupBy(*cols).agg(F.sum(count).alias("__n"))


def _only_iris(df: DataFrame, v: str) -> DataFrame:
    return df.where(F.col(f"{v}__kind") == "iri").drop(f"{v}__kind", f"{v}__type")


class StoredGraph(Graph):
    """Patterns over a triples frame. With triples stored by predicate, a pattern reads one folder."""

    def __init__(self, triples: DataFrame | MappedTriples, ns: str = ""):
        self.source, self.ns = triples, ns

    def _some(self, preds: list[str] | None = None) -> DataFrame:
        """Triples of some predicates, or all."""
        if isinstance(self.source, MappedTriples):
            return self.source.only(preds)
        rows = self.source.select(*TRIPLE_COLS, *[c for c in VALUE_COLS if c in self.source.columns])
        return rows if preds is None else rows.where(F.col("p").isin(preds) if len(preds) > 1 else F.col("p") == preds[0])

    def iri(self, name: str) -> str:
        if name in ("a", "rdf:type"):
            return RDF_TYPE
        return name if "://" in name or name.startswith(("urn:", "_:")) else self.ns + name

    def _pattern(self, p: Pattern, ranges: dict[str, Range]) -> DataFrame:
        rows, cols, seen = self._some(None if is_var(p.p) else [p.p]), [], set()

        def bind(term, col, kinded=False):
            nonlocal rows
            if isinstance(term, Literal):
                rows = rows.where((F.col(col) == term.text) & (F.col("o_kind") == "lit")
                                  & (F.col("o_type") == term.xsd))
            elif not is_var(term):
                rows = rows.where(F.col(col) == term)
                if kinded:
                    rows = rows.where(F.col("o_kind") == "iri")
            elif term in seen:
                first = {p.s: "s", p.p: "p"}[term]
                rows = rows.where(F.col(col) == F.col(first))
                if kinded:
                    rows = rows.where(F.col("o_kind") == "iri")
            else:
                seen.add(term)
                cols.append(F.col(col).alias(term[1:]))
                if kinded:
                    cols.extend([F.col("o_kind").alias(f"{term[1:]}__kind"),
                                 F.col("o_type").alias(f"{term[1:]}__type")])

        if is_var(p.o) and p.o[1:] in ranges:
            r = ranges[p.o[1:]]
            have = {c for c in VALUE_COLS if c in rows.columns}
            num = F.col("o_num") if "o_num" in have else terms.number(F.col("o"))
            at = F.col("o_at") if "o_at" in have else terms.instant(F.col("o"))
            rows = rows.where(F.col("o_type").isin(*(terms.TIMES if r.temporal else terms.NUMBERS)) & terms.in_range(r, F.col("o"), num, at))
        if is_var(p.p):
            bind(p.p, "p")
        bind(p.s, "s")
        bind(p.o, "o", kinded=True)
        return rows.select(*cols) if cols else rows.select(F.lit(True).alias("__hit"))

    def _joined(self, patterns: list[Pattern], by: set[str] | None = None, ranges: dict[str, Range] | None = None) -> DataFrame:
        """Join patterns. With ``by``, variables that nobody needs any more are counted away (``__n``)."""
        order = in_join_order(patterns, Pattern.variables, Pattern.anchors)
        out, bound = None, set()
        for n, p in enumerate(order):
            part = self._pattern(p, ranges or {})
            mine = {v[1:] for v in p.variables()}
            later = {v[1:] for q in order[n + 1:] for v in q.variables()}
            if by is not None:
                mine_live = {v for v in mine if v in by or v in later or v in bound}
                part, mine = _counted(part, mine, mine_live, None), mine_live
            if out is None:
                out, bound = part, mine
                continue
            for v in sorted(mine & bound):
                # An end that is a subject elsewhere must be an IRI, and needs no type any more.
                if _kinded(out, v) and not _kinded(part, v):
                    out = _only_iris(out, v)
                elif _kinded(part, v) and not _kinded(out, v):
                    part = _only_iris(part, v)
            same = [c for v in sorted(mine & bound) for c in _columns(out, v)]
            renamed = part.select(*[F.col(c).alias(f"__r_{c}") if c in [*same, "__n"] else F.col(c) for c in part.columns])
            cond = reduce(lambda x, y: x & y, [
                F.col(c).eqNullSafe(F.col(f"__r_{c}")) if c.endswith("__type") else F.col(c) == F.col(f"__r_{c}")
                for c in same])
            out = out.join(renamed, cond)
            if by is not None:
                out = out.withColumn("__n", F.col("__n") * F.col("__r___n")).drop("__r___n")
            out = out.drop(*[f"__r_{c}" for c in same])
            bound |= mine
            if by is not None and later:
                live = {v for v in bound if v in by or v in later}
                out, bound = _counted(out, bound, live, "__n"), live
        return out

    def _bind(self, patterns, typed, extras, ranges=None):
        out = self._joined(patterns, None, ranges)
        cols = []
        for v in sorted({v[1:] for p in patterns for v in p.variables()}):
            kind = F.col(f"{v}__kind") if _kinded(out, v) else F.lit("iri")
            xsd = F.col(f"{v}__type") if _kinded(out, v) else F.lit(None).cast("string")
            cols.append((terms.value(v, typed[v]) if v in typed else F.col(v)).alias(v))
            if extras:
                cols += [kind.alias(f"{v}__kind"), xsd.alias(f"{v}__type")]
        return out.select(*cols) if cols else out

    def _aggregate(self, patterns, by, aggs, typed, ranges):
        if any(how != "count" for how, _ in aggs.values()):
            return None
        out = self._joined(patterns, set(by), ranges).select(*[(terms.value(v, typed[v]) if v in typed else F.col(v)).alias(v) for v in by], "__n")
        return out.groupBy(*by).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__n"))

    def star(self, cls: str, props: dict[str, str]) -> DataFrame:
        """Instances of a class with several properties, as ``match`` gives them, in one aggregate.

        ``props`` maps output column to predicate. One shuffle by subject instead of a join per property: values are gathered
        per subject and multiplied out again, so a property with two values gives two rows, and a subject without one of them none.
        """
        preds = {out: self.iri(p) for out, p in props.items()}
        rows = self._some(sorted({RDF_TYPE, *preds.values()}))
        is_cls = (F.col("p") == RDF_TYPE) & (F.col("o") == self.iri(cls))
        out = rows.groupBy(F.col("s").alias("x")).agg(
            F.max(is_cls).alias("__is"),
            *[F.collect_list(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, p in preds.items()]).where("__is").drop("__is")
        for c in preds:
            out = out.withColumn(c, F.explode(c))
        return out
