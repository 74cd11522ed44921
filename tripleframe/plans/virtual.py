"""Graph patterns answered straight from the mapped tables.

A pattern names predicates, so it is known up front which tables can answer it. What is left is to
write the DataFrame a Spark user would write by hand:

* patterns about the same row of the same table become one scan;
* two ends built from the same IRI template are joined on the raw key columns, and IRIs are built
  only in the final projection (and pruned when nobody reads them);
* an IRI constant becomes a predicate on the key columns, so it reaches the scan;
* ends whose templates can never meet are dropped before Spark sees them;
* a parent table is joined for existence only if the query does not read it anyway.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleframe.functions import terms
from tripleframe.model import RDF_TYPE, ClassMap, Link, Mapping, Tbox, Template
from tripleframe.operators.triplify import Widening
from tripleframe.plans.graph import Graph, _plain_aggregates
from tripleframe.plans.patterns import Literal, Pattern, hidden, in_join_order, is_var
from tripleframe.plans.support import union_all


@dataclass(frozen=True)
class Key:
    """IRI made of key columns."""
    tpl: Template
    cols: tuple[str, ...]


@dataclass(frozen=True)
class Text:
    """Literal in a column, with its declared type."""
    col: str
    xsd: str


@dataclass(frozen=True)
class Node:
    """IRI held as text in a column."""
    col: str


@dataclass(frozen=True)
class Const:
    """The same IRI on every row."""
    iri: str


@dataclass
class Piece:
    """One way to answer one or more patterns from one table."""
    df: DataFrame
    owner: ClassMap | None              # class whose table is read, if the row is its instance
    row: str | None                     # variable or IRI that stands for that instance
    unique: bool                        # rows cannot repeat a binding
    terms: dict[str, object] = field(default_factory=dict)
    where: list[Column] = field(default_factory=list)
    needs: list[tuple[ClassMap, tuple[str, ...], str]] = field(default_factory=list)
    anchors: int = 0                    # constants among the patterns answered


def _render(term, df: DataFrame, prefix: str = "") -> Column:
    if isinstance(term, Key):
        dtypes = [df.schema[prefix + c].dataType for c in term.cols]
        return term.tpl.render([F.col(prefix + c) for c in term.cols], dtypes)
    if isinstance(term, Text):
        return terms.lexical(F.col(prefix + term.col), term.xsd, df.schema[prefix + term.col].dataType)
    return F.lit(term.iri) if isinstance(term, Const) else F.col(prefix + term.col)


def _cols(term) -> tuple[str, ...]:
    return term.cols if isinstance(term, Key) else () if isinstance(term, Const) else (term.col,)


def _moved(term, prefix: str):
    if isinstance(term, Key):
        return Key(term.tpl, tuple(prefix + c for c in term.cols))
    return term if isinstance(term, Const) else type(term)(*[prefix + term.col, *([term.xsd] if isinstance(term, Text) else [])])


def _can_meet(a, b) -> bool:
    if isinstance(a, Text) or isinstance(b, Text):
        return isinstance(a, Text) and isinstance(b, Text) and terms.xsd_name(a.xsd) == terms.xsd_name(b.xsd)
    if isinstance(a, Const) and isinstance(b, Const):
        return a.iri == b.iri
    if isinstance(a, Key) and isinstance(b, Key):
        return not a.tpl.disjoint(b.tpl)
    for x, y in ((a, b), (b, a)):
        if isinstance(x, Const) and isinstance(y, Key):
            return x.iri.startswith(y.tpl.base)
    return True


def _plain(dtype: T.DataType) -> str | None:
    if isinstance(dtype, T.IntegralType):
        return "int"
    return "text" if isinstance(dtype, T.StringType) else None


def _exact(term, df: DataFrame) -> bool:
    """Whether two terms of this kind are equal exactly when their raw columns are."""
    kinds = [_plain(df.schema[c].dataType) for c in _cols(term)]
    if isinstance(term, Key):
        return None not in kinds and term.tpl.injective([df.schema[c].dataType for c in term.cols])
    if isinstance(term, Text):
        return kinds[0] == "text" and term.xsd == "string" or \
            kinds[0] == "int" and term.xsd in ("integer", "long", "short")
    return True


def _equal(a, b, da: DataFrame, db: DataFrame) -> Column:
    """Equality of two terms; on raw columns whenever that decides it."""
    if type(a) is type(b) and isinstance(a, (Key, Text)) and _exact(a, da) and _exact(b, db):
        alike = a.tpl == b.tpl if isinstance(a, Key) else True
        kinds = [[_plain(d.schema[c].dataType) for c in _cols(t)] for t, d in ((a, da), (b, db))]
        if alike and kinds[0] == kinds[1]:
            return reduce(lambda x, y: x & y, [F.col(x) == F.col(y) for x, y in zip(_cols(a), _cols(b))])
    return _render(a, da) == _render(b, db)


def _key_test(tpl: Template, cols: tuple[str, ...], df: DataFrame, iri: str) -> list[Column] | None:
    """Conditions on key columns that say the IRI is ``iri``; None when it cannot be."""
    if not iri.startswith(tpl.base):
        return None
    rest = iri[len(tpl.base):]
    parts = [rest] if tpl.arity == 1 else rest.split(tpl.sep) if tpl.sep else []
    dtypes = [df.schema[c].dataType for c in cols]
    if len(parts) != tpl.arity or not all(_plain(t) for t in dtypes):
        return [tpl.render([F.col(c) for c in cols], dtypes) == iri]
    tests = []
    for col, dtype, part in zip(cols, dtypes, parts):
        raw = unquote(part)
        if quote(raw, safe="") != part:
            return None
        if isinstance(dtype, T.IntegralType):
            if not raw.lstrip("-").isdigit() or str(int(raw)) != raw:
                return None
            tests.append(F.col(col) == F.lit(int(raw)))
        else:
            tests.append(F.col(col) == raw)
    return tests


def _counted(df: DataFrame, env: dict, live: dict, n: str | None, states: dict[str, tuple[str, Column]]) -> DataFrame:
    """Rows grouped on the columns of the live variables, with how many rows each stands for in ``__n``, and partial aggregates.

    ``states`` maps a column to how it is put together (``sum``, ``min``, ``max``) and its value in the rows.
    """
    cols = list(dict.fromkeys(c for t in live.values() for c in _cols(t)))
    count = F.lit(1).cast("bigint") if n is None else F.col(n)
    if all(set(_cols(t)) <= set(cols) for t in env.values()):
        return df.select(*cols, count.alias("__n"), *[v.alias(c) for c, (_, v) in states.items()])
    return df.groupBy(*cols).agg(F.sum(count).alias("__n"), *[getattr(F, how)(v).alias(c) for c, (how, v) in states.items()])


class VirtualGraph(Graph):
    def __init__(self, mapping: Mapping, tbox: Tbox | None = None, inverse: bool = False):
        self.m, self.tbox = mapping, tbox
        self.w = Widening.of(mapping, tbox)
        self.inverse = inverse

    def iri(self, name: str) -> str:
        return self.m.iri(name)

    def _source_rows(self) -> int:
        tables = {id(df): df for df in [*(c.df for c in self.m.classes), *(link.edge.df for link in self.m.links if link.edge.df is not None)]}
        return sum(df.count() for df in tables.values())

    def _preds(self, link: Link) -> list[str]:
        p = self.m.iri(link.edge.name)
        return [p, *self.w.super_props.get(p, ())]

    # ------------------------------------------------------------ what can answer a pattern

    def _candidates(self, p: Pattern) -> list[tuple[Piece, object, str, object]]:
        """(table, subject term, predicate, object term) of every mapped output that fits ``p``."""
        m, w, out = self.m, self.w, []
        fits = lambda pred: is_var(p.p) or p.p == pred
        wants_type = fits(RDF_TYPE)
        for cm in m.classes:
            s = Key(m.template(cm), tuple(cm.pk))
            types = w.types(m, cm)

            def add(pred, o, col=None, xsd=None, cm=cm, s=s):
                piece = Piece(cm.df, cm, None, cm.unique)
                piece.where += [F.col(c).isNotNull() for c in dict.fromkeys([*cm.pk, *([col] if col else [])])]
                if xsd is not None:
                    piece.where.append(terms.present(F.col(col), xsd, cm.df.schema[col].dataType))
                out.append((piece, s, pred, o))

            if wants_type:
                for t in types:
                    add(RDF_TYPE, Const(t))
            for prop, (col, xsd) in cm.props.items():
                pred = m.iri(prop)
                if fits(pred):
                    add(pred, Text(col, xsd), col, xsd)
                if wants_type:
                    for t in w.domain.get(pred, ()):
                        if t not in types:
                            add(RDF_TYPE, Const(t), col, xsd)
            for prop, obj in cm.consts.items():
                pred = m.iri(prop)
                for q in [pred, *w.super_props.get(pred, ())]:
                    if fits(q):
                        add(q, Const(m.iri(obj)))
                if wants_type:
                    for t in w.domain.get(pred, ()):
                        if t not in types:
                            add(RDF_TYPE, Const(t))
        for link in m.links:
            pred = m.iri(link.edge.name)
            s, o = Key(m.template(link.domain), link.s_cols), Key(m.template(link.range), link.o_cols)

            def edge(pred, s_, o_, unique, link=link):
                piece = Piece(link.df, link.owner, None, unique)
                piece.where += [F.col(c).isNotNull() for c in dict.fromkeys([*link.s_cols, *link.o_cols])]
                piece.needs += [(cm, cols, "") for cm, cols in link.checks]
                out.append((piece, s_, pred, o_))

            for q in self._preds(link):
                if fits(q):
                    edge(q, s, o, link.unique)
                if self.inverse:
                    for back in w.inverse.get(q, ()):
                        if fits(back):
                            edge(back, o, s, link.unique)
            if wants_type:
                sure = {id(c) for c, _ in link.parents} | ({id(link.owner)} if link.owner else set())
                for end, term, extra in ((link.domain, s, w.domain), (link.range, o, w.range)):
                    given = w.types(m, end) if id(end) in sure else []
                    for t in extra.get(pred, ()):
                        if t not in given:
                            edge(RDF_TYPE, term, Const(t), False)
        return out

    def _pieces(self, p: Pattern, ranges: dict[str, terms.Range]) -> list[Piece]:
        """Ways to answer one pattern that cannot give the same triple twice."""
        fitting = []
        for piece, s, pred, o in self._candidates(p):
            tests: list[Column] = []
            for term, want in ((s, p.s), (o, p.o)):
                if is_var(want):
                    continue
                if isinstance(want, Literal):
                    if not isinstance(term, Text) or terms.xsd_name(term.xsd) != want.xsd:
                        tests = None
                    else:
                        dtype = piece.df.schema[term.col].dataType
                        raw = isinstance(dtype, T.StringType)
                        tests.append((F.col(term.col) if raw else _render(term, piece.df)) == want.text)
                elif isinstance(term, Const):
                    tests = tests if term.iri == want else None
                elif isinstance(term, Key):
                    hit = _key_test(term.tpl, term.cols, piece.df, want)
                    tests = None if hit is None else tests + hit
                else:
                    tests = None
                if tests is None:
                    break
            if tests is not None and is_var(p.o) and p.o[1:] in ranges:
                within = self._in_range(ranges[p.o[1:]], o, piece.df)
                tests = None if within is None else tests + within
            if tests is None:
                continue
            piece.where += tests
            piece.anchors = p.anchors()
            for var, term in ((p.s, s), (p.p, Const(pred)), (p.o, o)):
                if not is_var(var):
                    continue
                if var in piece.terms:
                    old = piece.terms[var]
                    if not _can_meet(old, term):
                        break
                    piece.where.append(_equal(old, term, piece.df, piece.df))
                else:
                    piece.terms[var] = term
            else:
                link_cols = {c: want for t, want in ((s, p.s), (o, p.o)) if isinstance(t, Key) for c in [t.cols]}
                piece.needs = [(cm, cols, link_cols.get(cols, "")) for cm, cols, _ in piece.needs]
                if piece.owner is not None:
                    own = tuple(piece.owner.pk)
                    piece.row = next((want for t, want in ((s, p.s), (o, p.o))
                                      if isinstance(t, Key) and t.cols == own and not isinstance(want, Literal)), None)
                fitting.append((piece, s, Const(pred), o))
        clusters: list[list] = []
        for item in fitting:
            touching = [c for c in clusters
                        if any(all(_can_meet(x, y) for x, y in zip(item[1:], other[1:])) for other in c)]
            merged = [item] + [x for c in touching for x in c]
            clusters = [c for c in clusters if c not in touching] + [merged]
        return [c[0][0] if len(c) == 1 and self._plain_piece(c[0][0]) else self._merged([x[0] for x in c])
                for c in clusters]

    @staticmethod
    def _in_range(r: terms.Range, o, df: DataFrame) -> list[Column] | None:
        """Conditions that a literal's value is in a range: one that the scan can use and the exact one; None if it cannot be."""
        if not isinstance(o, Text) or terms.xsd_name(o.xsd) not in (terms.TIMES if r.temporal else terms.NUMBERS):
            return None
        text, dtype = _render(o, df), df.schema[o.col].dataType
        implied = terms.implied_range(r, F.col(o.col), o.xsd, dtype)
        return ([] if implied is None else [implied]) + [terms.in_range(r, text, terms.number(text), terms.instant(text))]

    @staticmethod
    def _plain_piece(pc: Piece) -> bool:
        """Whether raw rows are enough: no two of them can turn into one binding when written out."""
        return all(_exact(t, pc.df) or (isinstance(t, Text) and pc.unique) for t in pc.terms.values())

    def _merged(self, pieces: list[Piece]) -> Piece:
        """Union of overlapping pieces, made distinct; on raw keys when the shapes agree."""
        variables = list(pieces[0].terms)
        shape = lambda t: t.tpl if isinstance(t, Key) else t if isinstance(t, Const) else type(t)
        raw = {}
        for v in variables:
            ts = [pc.terms[v] for pc in pieces]
            kinds = [[_plain(pc.df.schema[c].dataType) for c in _cols(pc.terms[v])] for pc in pieces]
            raw[v] = len({shape(t) for t in ts}) == 1 and all(k == kinds[0] for k in kinds) \
                and all(_exact(t, pc.df) for t, pc in zip(ts, pieces))
        frames, out_terms = [], {}
        for pc in pieces:
            rows, cols = self._rows(pc, satisfied=()), []
            for n, v in enumerate(variables):
                t = pc.terms[v]
                if isinstance(t, Const) and raw[v]:
                    out_terms[v] = t
                elif raw[v]:
                    names = tuple(f"m{n}_{i}" for i in range(len(_cols(t))))
                    for c, name in zip(_cols(t), names):
                        dt = "bigint" if _plain(rows.schema[c].dataType) == "int" else "string"
                        cols.append(F.col(c).cast(dt).alias(name))
                    out_terms[v] = Key(t.tpl, names) if isinstance(t, Key) else Text(names[0], t.xsd) \
                        if isinstance(t, Text) else Node(names[0])
                else:
                    cols.append(_render(t, rows).alias(f"m{n}"))
                    # The text of a literal is final: re-reading it as a string changes nothing.
                    out_terms[v] = Text(f"m{n}", terms.xsd_name(t.xsd)) if isinstance(t, Text) else Node(f"m{n}")
            frames.append(rows.select(*cols) if cols else rows.select(F.lit(True).alias("__hit")))
        return Piece(union_all(frames).distinct(), None, None, True, out_terms, anchors=pieces[0].anchors)

    # ------------------------------------------------------------ from pieces to rows

    def _rows(self, pc: Piece, satisfied) -> DataFrame:
        rows = pc.df
        if pc.where:
            rows = rows.where(reduce(lambda a, b: a & b, pc.where))
        used = list(dict.fromkeys(c for t in pc.terms.values() for c in _cols(t)))
        needs = [(cm, cols) for cm, cols, end in pc.needs if (id(cm), end) not in satisfied]
        keep = list(dict.fromkeys([*used, *[c for _, cols in needs for c in cols]]))
        rows = rows.select(*keep) if keep else rows.select(F.lit(True).alias("__hit"))
        if not pc.unique:
            rows = rows.distinct()
        for cm, cols in needs:
            keys = cm.df.select(*[F.col(k).alias(f"__pk{i}") for i, k in enumerate(cm.pk)])
            rows = rows.join(keys, [F.col(c) == F.col(f"__pk{i}") for i, c in enumerate(cols)], "left_semi")
        if used and used != keep:
            rows = rows.select(*used)
            rows = rows if pc.unique else rows.distinct()
        return rows

    def _fuse(self, pieces: list[Piece]) -> list[Piece] | None:
        """Put pieces about the same row together; None when they contradict each other."""
        out: list[Piece] = []
        for pc in pieces:
            host = next((h for h in out if pc.owner is not None and pc.row is not None and pc.unique and h.unique
                         and h.owner is pc.owner and h.row == pc.row and h.df is pc.df), None)
            if host is None:
                out.append(Piece(pc.df, pc.owner, pc.row, pc.unique, dict(pc.terms), list(pc.where), list(pc.needs),
                                 pc.anchors))
                continue
            host.anchors += pc.anchors
            for v, t in pc.terms.items():
                if v not in host.terms:
                    host.terms[v] = t
                elif host.terms[v] != t:
                    if not _can_meet(host.terms[v], t):
                        return None
                    host.where.append(_equal(host.terms[v], t, host.df, host.df))
            host.where += pc.where
            host.needs += pc.needs
        return out

    def _fused(self, pieces: list[Piece]) -> list[Piece] | None:
        """Pieces that read one row put together, in join order; None when they contradict each other."""
        seen: dict[str, list] = {}
        for pc in pieces:
            for v, t in pc.terms.items():
                if not all(_can_meet(t, u) for u in seen.setdefault(v, [])):
                    return None
                seen[v].append(t)
        fused = self._fuse(pieces)
        return fused and in_join_order(fused, lambda pc: list(pc.terms), lambda pc: pc.anchors)

    def _joined(self, fused: list[Piece], by: set[str] | None = None, measures: dict[str, set[str]] | None = None,
                typed: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, object]]:
        """Join pieces. With ``by``, variables that nobody needs any more are counted away (column
        ``__n``) before each join and after it, so rows never stand for single bindings.

        ``measures`` says which of ``sum``, ``min``, ``max`` and ``known`` (how many there are) of a variable's value are wanted. They start where the variable is bound, as columns
        ``__sum_v`` and so on, and go through the joins as partial aggregates: a sum counts once for every row of the other side.
        """
        # Reading a class's own table for some end proves that the end exists.
        satisfied = {(id(pc.owner), pc.row) for pc in fused if pc.owner is not None and pc.row}
        out, env, had = None, {}, {}
        for n, pc in enumerate(fused):
            prefix = f"g{n}_"
            rows = self._rows(pc, satisfied)
            rows = rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns])
            mine = {v: _moved(t, prefix) for v, t in pc.terms.items()}
            later = {v for q in fused[n + 1:] for v in q.terms}
            new: dict[str, str] = {}
            if by is not None:
                live = {v: t for v, t in mine.items() if v in by or v in later or v in env}
                states = {}
                for v in (v for v in measures or {} if v in mine):
                    value = self._shown(v[1:], mine[v], rows, typed or {})
                    for how in sorted(measures[v]):
                        # How many values there are is a sum as well.
                        states[f"__{how}_{v[1:]}"] = ("sum", F.when(value.isNotNull(), 1).otherwise(0).cast("bigint")) if how == "known" else (how, value)
                states = {c: x for c, x in states.items() if c not in had}
                new = {c: how for c, (how, _) in states.items()}
                rows = _counted(rows, mine, live, None, states).withColumnRenamed("__n", f"__n{n}")
                mine = live
            if out is None:
                out, env, had = rows, mine, new
                if by is not None:
                    out = out.withColumnRenamed(f"__n{n}", "__n")
                continue
            cond = reduce(lambda a, b: a & b, [_equal(env[v], mine[v], out, rows) for v in mine if v in env])
            out = out.join(rows, cond)
            # Prefer a term that needs no text when both sides know the variable.
            env = {**mine, **env}
            if by is not None:
                out = out.withColumns({c: F.col(c) * F.col(f"__n{n}") for c, how in had.items() if how == "sum"}
                                      | {c: F.col(c) * F.col("__n") for c, how in new.items() if how == "sum"} | {"__n": F.col("__n") * F.col(f"__n{n}")}).drop(f"__n{n}")
                had = {**had, **new}
                live = {v: t for v, t in env.items() if v in by or v in later}
                if later:
                    out = _counted(out, env, live, "__n", {c: (how, F.col(c)) for c, how in had.items()})
                env = live
        return out, env

    def _shown(self, v: str, t, df: DataFrame, typed: dict[str, str]) -> Column:
        if v not in typed:
            return _render(t, df)
        if not isinstance(t, Text) or terms.xsd_name(t.xsd) != terms.xsd_name(typed[v]):
            return terms.value(_render(t, df), typed[v])
        shown = terms.typed(F.col(t.col), t.xsd, df.schema[t.col].dataType)
        same = terms.value_type(t.xsd) == terms.value_type(typed[v])
        return shown if same else shown.cast(terms.value_type(typed[v]))

    def _combinations(self, patterns: list[Pattern], ranges: dict[str, terms.Range] | None = None) -> list[list[Piece]]:
        known = self._known_predicates()
        for p in patterns:
            if not is_var(p.p) and p.p not in known:
                raise ValueError(f"no mapping gives predicate {p.p}")
        ways = product(*[self._pieces(p, ranges or {}) for p in patterns])
        return [fused for fused in (self._fused(list(w)) for w in ways) if fused]

    def _bind(self, patterns, typed, extras, ranges=None):
        names = list(dict.fromkeys(v[1:] for p in patterns for v in p.variables() if not hidden(v)))
        frames = []
        for fused in self._combinations(patterns, ranges):
            out, env = self._joined(fused)
            cols = []
            for v in names:
                t = env["?" + v]
                cols.append(self._shown(v, t, out, typed).alias(v))
                if extras:
                    lit = isinstance(t, Text)
                    cols += [F.lit("lit" if lit else "iri").alias(f"{v}__kind"),
                             F.lit(terms.xsd_name(t.xsd) if lit else None).cast("string").alias(f"{v}__type")]
            frames.append(out.select(*cols) if cols else out.select(F.lit(True).alias("__hit")))
        return union_all(frames) if frames else self._nothing(names, typed, extras)

    def _aggregate(self, patterns, by, aggs, typed, ranges):
        """Aggregates on raw key columns; IRIs and typed values are made of the results.

        Ways to answer the patterns whose results may have a key in common, or whose raw keys may differ where the values do not, are put together once more.
        """
        measures: dict[str, set[str]] = {}
        for how, v in aggs.values():
            if how in ("sum", "avg", "min", "max"):
                measures.setdefault("?" + v, set()).update(("sum", "known") if how == "avg" else (how,))
        apart = list(dict.fromkeys(v for how, v in aggs.values() if how == "count_distinct"))
        ways = self._combinations(patterns, ranges)
        if apart and len(ways) > 1:
            return None  # values of several ways have to be compared as text
        kinds = {f"__{how}_{v[1:]}": "sum" if how == "known" else how for v, hows in measures.items() for how in sorted(hows)}
        frames, keys, exact = [], [], True
        for fused in ways:
            out, env = self._joined(fused, {"?" + v for v in [*by, *apart]}, measures, typed)
            raw = list(dict.fromkeys(c for v in by for c in _cols(env["?" + v])))
            sizes = [F.count_distinct(*[F.col(c) for c in _cols(env["?" + v])] if _exact(env["?" + v], out) and v not in typed else [self._shown(v, env["?" + v], out, typed)]).alias(f"__distinct_{v}")
                     if _cols(env["?" + v]) else F.max(F.lit(1)).cast("bigint").alias(f"__distinct_{v}") for v in apart]
            rows = out.groupBy(*raw).agg(F.sum("__n").alias("__n"), *[getattr(F, how)(c).alias(c) for c, how in kinds.items()], *sizes)
            frames.append(rows.select(*[self._shown(v, env["?" + v], rows, typed).alias(v) for v in by], "__n", *kinds, *[f"__distinct_{v}" for v in apart]))
            exact = exact and all(_exact(env["?" + v], rows) and (v not in typed or _cols(env["?" + v]) and self._as_is(env["?" + v], rows, typed[v])) for v in by)
            keys.append([env["?" + v] for v in by])
        if not frames:
            none = self._nothing([*by, *dict.fromkeys(v for _, v in aggs.values() if v)], typed, False)
            return none.groupBy(*by).agg(*_plain_aggregates(aggs))
        met = any(all(_can_meet(a, b) for a, b in zip(x, y)) for i, x in enumerate(keys) for y in keys[:i])
        out = union_all(frames)
        if met or not exact or not by:
            if apart and by and not exact:
                return None
            out = out.groupBy(*by).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__n"), *[getattr(F, how)(c).alias(c) for c, how in kinds.items()],
                                       *[F.coalesce(F.max(f"__distinct_{v}"), F.lit(0)).alias(f"__distinct_{v}") for v in apart])
        return out

    @staticmethod
    def _as_is(t, df: DataFrame, xsd: str) -> bool:
        return isinstance(t, Text) and df.schema[t.col].dataType.simpleString() == terms.value_type(xsd) == terms.value_type(t.xsd)

    def _nothing(self, names, typed, extras) -> DataFrame:
        cols = [f"{v} {terms.value_type(typed[v]) if v in typed else 'string'}" for v in names]
        if extras:
            cols += [f"{v}__{x} string" for v in names for x in ("kind", "type")]
        return self.m.classes[0].df.sparkSession.createDataFrame([], ", ".join(cols) or "__hit boolean")

    def _known_predicates(self) -> set[str]:
        known = {RDF_TYPE}
        for cm in self.m.classes:
            known |= {self.m.iri(p) for p in cm.props}
            for p in cm.consts:
                known |= {self.m.iri(p), *self.w.super_props.get(self.m.iri(p), ())}
        for link in self.m.links:
            known |= set(self._preds(link))
        return known | ({q for p in list(known) for q in self.w.inverse.get(p, ())} if self.inverse else set())
