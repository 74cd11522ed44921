"""From mapped tables to a set of triples.

Every table is scanned once for its class: type and literal triples come out of one ``inline``
over an array of structs. Edges keep the rows whose parents exist, by left semi joins, so duplicated
parents cannot multiply rows.

The graph is a set, but a shuffle of whole triples is paid only where a duplicate is possible:

* a class with a declared unique key cannot repeat a triple, so its scan needs no shuffle at all;
* an edge over a table without such a key drops duplicates on its raw key columns, before any text
  is built;
* only outputs that two sources may both produce are compared as triples.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.functions import terms
from tripleframe.model import RDF_TYPE, TRIPLE_COLS, TRIPLE_SCHEMA, ClassMap, EdgeMap, Link, Mapping, Tbox, Template
from tripleframe.plans.support import union_all


# ---------------------------------------------------------------- single outputs

def triple_columns(s: Column, p: str | Column, o: Column, kind: str, o_type: str | None) -> list[Column]:
    p = F.lit(p) if isinstance(p, str) else p
    return [s.alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"),
            F.lit(o_type).cast("string").alias("o_type")]


def _keyed(df: DataFrame, cols) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def class_triples(m: Mapping, cm: ClassMap, types: list[str] | None = None) -> DataFrame:
    """``rdf:type`` triples of one class map; rows with a NULL key are left out."""
    keys = _keyed(cm.df.select(*cm.pk), cm.pk)
    if not cm.unique:
        keys = keys.distinct()
    return union_all([
        keys.select(*triple_columns(m.subject(cm, df=keys), RDF_TYPE, F.lit(m.iri(t)), "iri", None))
        for t in types or [cm.name]])


def literal_triples(m: Mapping, cm: ClassMap, prop: str) -> DataFrame:
    """Triples of one literal property; NULL values and NULL keys are left out."""
    col, xsd = cm.props[prop]
    rows = _keyed(cm.df.select(*dict.fromkeys([*cm.pk, col])), [*cm.pk, col])
    out = rows.select(*triple_columns(
        m.subject(cm, df=rows), m.iri(prop),
        terms.lexical(F.col(col), xsd, cm.df.schema[col].dataType), "lit", terms.xsd_name(xsd)))
    return out if cm.unique else out.dropDuplicates(TRIPLE_COLS)


def const_edge(m: Mapping, cm: ClassMap, pred: str, obj: str) -> DataFrame:
    """The same IRI as object of every instance of a class."""
    keys = _keyed(cm.df.select(*cm.pk), cm.pk)
    if not cm.unique:
        keys = keys.distinct()
    return keys.select(*triple_columns(m.subject(cm, df=keys), m.iri(pred), F.lit(m.iri(obj)), "iri", None))


def link_of(m: Mapping, name: str) -> Link:
    for link in m.links:
        if link.edge.name == name:
            return link
    raise KeyError(f"no such edge: {name}")


def edge_keys(link: Link, distinct: bool = True) -> DataFrame:
    """Raw key columns ``s0.. o0..`` of an edge, for rows whose parents exist."""
    rows = _keyed(link.df.select(*dict.fromkeys([*link.s_cols, *link.o_cols])),
                  dict.fromkeys([*link.s_cols, *link.o_cols]))
    if distinct and not link.unique:
        rows = rows.distinct()
    for parent, cols in link.checks:
        rows = rows.join(parent.df.select(*[F.col(k).alias(f"__pk{i}") for i, k in enumerate(parent.pk)]),
                         [F.col(c) == F.col(f"__pk{i}") for i, c in enumerate(cols)], "left_semi")
    return rows.select(*[F.col(c).alias(f"s{i}") for i, c in enumerate(link.s_cols)],
                       *[F.col(c).alias(f"o{i}") for i, c in enumerate(link.o_cols)])


def _end(m: Mapping, cm: ClassMap, keys: DataFrame, tag: str) -> Column:
    return m.subject(cm, [f"{tag}{i}" for i in range(len(cm.pk))], keys)


def edge_triples(m: Mapping, edge: str | EdgeMap, preds: list[str] | None = None) -> DataFrame:
    """Triples of one edge map (all three modes), with optional further predicates for the same pairs."""
    link = link_of(m, edge if isinstance(edge, str) else edge.name)
    keys = edge_keys(link)
    s, o = _end(m, link.domain, keys, "s"), _end(m, link.range, keys, "o")
    if not preds:
        return keys.select(*triple_columns(s, m.iri(link.edge.name), o, "iri", None)).transform(
            lambda d: d if _pairs_injective(m, link) else d.dropDuplicates(TRIPLE_COLS))
    out = keys.select(s.alias("s"), F.explode(F.array(*[F.lit(m.iri(p)) for p in preds])).alias("p"),
                      o.alias("o")).select(*triple_columns(F.col("s"), F.col("p"), F.col("o"), "iri", None))
    return out if _pairs_injective(m, link) else out.dropDuplicates(TRIPLE_COLS)


def _pairs_injective(m: Mapping, link: Link) -> bool:
    dt = [link.df.schema[c].dataType for c in link.s_cols], [link.df.schema[c].dataType for c in link.o_cols]
    return m.template(link.domain).injective(dt[0]) and m.template(link.range).injective(dt[1])


# ---------------------------------------------------------------- ontology, looked up for the mapping

@dataclass
class Widening:
    """Axioms that matter for one mapping; bounded by the size of the mapping, not of the ontology."""
    supers: dict[str, list[str]]
    super_props: dict[str, list[str]]
    domain: dict[str, list[str]]
    range: dict[str, list[str]]
    inverse: dict[str, list[str]]

    @classmethod
    def none(cls) -> "Widening":
        return cls({}, {}, {}, {}, {})

    @classmethod
    def of(cls, m: Mapping, tbox: Tbox | None) -> "Widening":
        if tbox is None:
            return cls.none()
        classes = [m.iri(c.name) for c in m.classes]
        preds = [m.iri(p) for c in m.classes for p in [*c.props, *c.consts]]
        preds += [m.iri(e.edge.name) for e in m.links]

        def climb(part: str, start: list[str]) -> dict[str, list[str]]:
            # Only the ancestors of the mapped names are fetched, level by level.
            edges, up, todo = tbox.frames[part], {}, set(start)
            while todo:
                found: dict[str, set[str]] = {c: set() for c in todo}
                for child, parent in edges.where(F.col("child").isin(list(todo))).collect():
                    found[child].add(parent)
                up.update(found)
                todo = {p for ps in found.values() for p in ps} - up.keys()
            out = {}
            for name in start:
                seen: set[str] = set()
                stack = list(up.get(name, ()))
                while stack:
                    x = stack.pop()
                    if x not in seen:
                        seen.add(x)
                        stack.extend(up.get(x, ()))
                out[name] = sorted(seen)
            return out

        def lookup(part: str, key: str, val: str) -> dict[str, list[str]]:
            out: dict[str, list[str]] = {}
            frame = tbox.frames[part].select(key, val)
            for k, v in frame.where(F.col(key).isin(preds)).distinct().orderBy(key, val).collect():
                out.setdefault(k, []).append(v)
            return out

        domain, rng = lookup("domain", "prop", "cls"), lookup("range", "prop", "cls")
        named = [v for d in (domain, rng) for vs in d.values() for v in vs if not v.startswith(terms.XSD_NS)]
        if named and tbox.frames["classes"].limit(1).count():
            known = {r[0] for r in tbox.frames["classes"].where(F.col("cls").isin(named)).select("cls").collect()}
        else:
            known = set(named)
        keep = lambda d: {p: [v for v in vs if v in known] for p, vs in d.items()}
        inverse: dict[str, list[str]] = {}
        mine = F.col("prop").isin(preds) | F.col("inverse").isin(preds)
        for a, b in tbox.frames["inverse"].where(mine).distinct().collect():
            inverse.setdefault(a, []).append(b)
            inverse.setdefault(b, []).append(a)
        return cls(climb("sub_class", classes), climb("sub_prop", preds), keep(domain), keep(rng), inverse)

    def types(self, m: Mapping, cm: ClassMap) -> list[str]:
        own = m.iri(cm.name)
        return sorted({own, *self.supers.get(own, ())})


# ---------------------------------------------------------------- whole mapping

@dataclass
class Output:
    """Some triples with one subject shape; ``same`` says which outputs could produce equal triples."""
    mapping_id: str
    s_tpl: Template
    pred: str
    o_tpl: Template | None       # None for a literal or constant object
    o_const: str | None
    xsd: str | None

    def may_equal(self, other: "Output") -> bool:
        if self.pred != other.pred or self.s_tpl.disjoint(other.s_tpl):
            return False
        if (self.xsd is None) != (other.xsd is None):
            return False
        if self.xsd is not None:
            return self.xsd == other.xsd
        if self.o_const is not None and other.o_const is not None:
            return self.o_const == other.o_const
        if self.o_tpl is not None and other.o_tpl is not None:
            return not self.o_tpl.disjoint(other.o_tpl)
        const, tpl = (self.o_const, other.o_tpl) if self.o_const is not None else (other.o_const, self.o_tpl)
        return const.startswith(tpl.base)


def _class_outputs(m: Mapping, cm: ClassMap, w: Widening) -> list[tuple[Output, Column]]:
    """Outputs of one scan of a class's table, each with the struct that produces it (o NULL = none)."""
    tpl, mid, out = m.template(cm), f"map-{cm.name.lower()}", []

    def item(pred, o, kind, xsd, o_const=None):
        cols = F.struct(F.lit(pred).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"),
                        F.lit(xsd).cast("string").alias("o_type"))
        out.append((Output(mid, tpl, pred, None, o_const, xsd), cols))

    types = w.types(m, cm)
    for t in types:
        item(RDF_TYPE, F.lit(t), "iri", None, t)
    for prop, (col, xsd) in cm.props.items():
        pred = m.iri(prop)
        o = terms.lexical(F.col(col), xsd, cm.df.schema[col].dataType)
        item(pred, o, "lit", terms.xsd_name(xsd))
        for extra in w.domain.get(pred, ()):
            if extra not in types:
                item(RDF_TYPE, F.when(terms.present(F.col(col), xsd, cm.df.schema[col].dataType), F.lit(extra)), "iri", None, extra)
    for prop, obj in cm.consts.items():
        pred, obj = m.iri(prop), m.iri(obj)
        for p in [pred, *w.super_props.get(pred, ())]:
            item(p, F.lit(obj), "iri", None, obj)
        for extra in w.domain.get(pred, ()):
            if extra not in types:
                item(RDF_TYPE, F.lit(extra), "iri", None, extra)
    return out


def _class_frame(m: Mapping, cm: ClassMap, structs: list[Column], repeats: bool = False) -> DataFrame:
    """Triples of one scan. ``repeats`` drops duplicates while the subject is still its raw key."""
    rows, cells = _keyed(cm.df, cm.pk), F.inline(F.array(*structs))
    if not repeats:
        # The subject is written once per row, below the generator.
        return rows.select(m.subject(cm).alias("s"), cells).where(F.col("o").isNotNull()).select(*TRIPLE_COLS)
    keys = [f"__k{i}" for i in range(len(cm.pk))]
    out = rows.select(*[F.col(c).alias(k) for c, k in zip(cm.pk, keys)], cells).where(F.col("o").isNotNull()).distinct()
    return out.select(m.template(cm).render([F.col(k) for k in keys], cm.dtypes(cm.pk)).alias("s"), *TRIPLE_COLS[1:])


@dataclass
class Part:
    """A frame of triples, the outputs in it, and whether it is free of repeats on its own."""
    frame: DataFrame
    outputs: list[Output]
    distinct: bool


def _edge_parts(m: Mapping, link: Link, w: Widening, wanted: set[str] | None) -> list[Part]:
    pred = m.iri(link.edge.name)
    preds = [p for p in [pred, *w.super_props.get(pred, ())] if wanted is None or p in wanted]
    s_tpl, o_tpl, mid = m.template(link.domain), m.template(link.range), f"map-{link.edge.name.lower()}"
    parts = [Part(edge_triples(m, link.edge, preds),
                  [Output(mid, s_tpl, p, o_tpl, None, None) for p in preds], True)] if preds else []
    if wanted is not None and RDF_TYPE not in wanted:
        return parts
    # Both ends exist in the tables of their classes whenever a parent was joined or the owner was
    # scanned, so their own classes' types are in the graph already; only foreign classes are added.
    sure = {id(parent) for parent, _ in link.parents} | ({id(link.owner)} if link.owner else set())
    for end, tag, extra in ((link.domain, "s", w.domain.get(pred, ())), (link.range, "o", w.range.get(pred, ()))):
        given = w.types(m, end) if id(end) in sure else []
        for t in (t for t in extra if t not in given):
            n = len(end.pk)
            keys = edge_keys(link, distinct=False).select(*[f"{tag}{i}" for i in range(n)]).distinct()
            frame = keys.select(*triple_columns(_end(m, end, keys, tag), RDF_TYPE, F.lit(t), "iri", None))
            parts.append(Part(frame, [Output(mid, m.template(end), RDF_TYPE, None, t, None)],
                              m.template(end).injective([keys.schema[f"{tag}{i}"].dataType for i in range(n)])))
    return parts


def _parts(m: Mapping, w: Widening, wanted: set[str] | None = None) -> list[Part]:
    everything = [(cm, [x for x in _class_outputs(m, cm, w) if wanted is None or x[0].pred in wanted])
                  for cm in m.classes]
    edge_parts = [p for link in m.links for p in _edge_parts(m, link, w, wanted)]
    all_outputs = [(i, o) for i, (_, outs) in enumerate(everything) for o, _ in outs]
    all_outputs += [(len(everything) + i, o) for i, p in enumerate(edge_parts) for o in p.outputs]

    def shared(owner: int, out: Output, within: list[Output]) -> bool:
        if any(out.may_equal(o) for i, o in all_outputs if i != owner):
            return True
        return sum(out.may_equal(o) for o in within) > 1

    parts: list[Part] = []
    for i, (cm, outs) in enumerate(everything):
        within = [o for o, _ in outs]
        exact = m.template(cm).injective(cm.dtypes(cm.pk))
        split: dict[bool, list[tuple[Output, Column]]] = {True: [], False: []}
        for o, c in outs:
            split[exact and not shared(i, o, within)].append((o, c))
        for alone, chosen in split.items():
            if chosen:
                frame = _class_frame(m, cm, [c for _, c in chosen], repeats=alone and not cm.unique)
                parts.append(Part(frame, [o for o, _ in chosen], alone))
    for i, p in enumerate(edge_parts):
        clash = any(shared(len(everything) + i, o, p.outputs) for o in p.outputs)
        parts.append(Part(p.frame, p.outputs, p.distinct and not clash))
    return parts


def materialize(m: Mapping, tbox: Tbox | None = None, preds: list[str] | None = None) -> DataFrame:
    """All triples of a mapping as a set, with one pass of ontology widening when ``tbox`` is given.

    Types get all ancestor classes, edges all super-properties, and both ends of a triple the declared
    domain and range classes; these rules do not feed each other. With ``preds`` only triples of those
    predicates are made, and tables that have none are not read.
    """
    return _materialized(m, Widening.of(m, tbox), None if preds is None else {m.iri(p) for p in preds})


def _materialized(m: Mapping, w: Widening, wanted: set[str] | None) -> DataFrame:
    parts = _parts(m, w, wanted)
    done = [p.frame for p in parts if p.distinct]
    rest = [p.frame for p in parts if not p.distinct]
    if rest:
        done.append(union_all(rest).dropDuplicates(TRIPLE_COLS))
    if not done:
        return m.classes[0].df.sparkSession.createDataFrame([], TRIPLE_SCHEMA)
    return union_all(done)


class MappedTriples:
    """The triples of a mapping before they are a frame: who asks for some predicates gets a frame that reads only the tables of those.

    A frame of all triples hides its predicates from Spark, which then reads every table for each of them. The operators of :mod:`reason`, :mod:`schema` and
    :mod:`audit` that look at some predicates, and ``Graph.materialized``, take this in place of a frame and ask for what they need.
    """

    def __init__(self, m: Mapping, tbox: Tbox | None = None):
        self.m, self.w = m, Widening.of(m, tbox)
        self.kinds: dict[str, set[str]] = {}
        for cm in m.classes:
            for out, _ in _class_outputs(m, cm, self.w):
                self.kinds.setdefault(out.pred, set()).add("iri" if out.xsd is None else "lit")
        for link in m.links:
            pred = m.iri(link.edge.name)
            for p in [pred, *self.w.super_props.get(pred, ())]:
                self.kinds.setdefault(p, set()).add("iri")

    @property
    def sparkSession(self):
        return self.m.classes[0].df.sparkSession

    def predicates(self, kind: str | None = None) -> list[str]:
        """Predicates that the mapping may give, of all kinds of objects or of one (``iri`` or ``lit``)."""
        return sorted(p for p, ks in self.kinds.items() if kind is None or kind in ks)

    def only(self, preds: list[str] | DataFrame | None = None, kind: str | None = None) -> DataFrame:
        """Triples of some predicates (names, or a frame of one column of IRIs) and of one kind of objects."""
        wanted = set(self.predicates(kind))
        if isinstance(preds, DataFrame):
            wanted &= {r[0] for r in preds.where(F.col(preds.columns[0]).isin(sorted(wanted))).distinct().collect()}
        elif preds is not None:
            wanted &= {self.m.iri(p) for p in preds}
        out = _materialized(self.m, self.w, wanted)
        return out if kind is None or all(len(self.kinds[p]) == 1 for p in wanted) else out.where(F.col("o_kind") == kind)

    def counts(self) -> DataFrame:
        """``s_class``, ``p``, ``o_class`` (NULL for literals), ``o_type`` and ``n`` of every output of the mapping, counted on the tables.

        A type is an output with ``o_class`` as its object. One scan per class counts its rows and literals, and the rows of a foreign key in its own table
        with them, on counts per key; every other edge takes a scan of its own. No text is built. Rows of a class without a unique key count each.
        """
        m, w, frames = self.m, self.w, []
        merged: set[int] = set()

        def items(n: Column, pred: str, s_class: str, o_class: str | None, xsd: str | None) -> Column:
            return F.struct(F.lit(s_class).alias("s_class"), F.lit(pred).alias("p"), F.lit(o_class).cast("string").alias("o_class"),
                            F.lit(xsd).cast("string").alias("o_type"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n"))

        def edge_items(link: Link, n: Column) -> list[Column]:
            pred, a, b = m.iri(link.edge.name), m.iri(link.domain.name), m.iri(link.range.name)
            out = [items(n, p, a, b, None) for p in [pred, *w.super_props.get(pred, ())]]
            return out + [items(n, RDF_TYPE, cls, t, None) for cls, extra in ((a, w.domain), (b, w.range)) for t in extra.get(pred, ())]

        for cm in m.classes:
            own = m.iri(cm.name)
            measures = {"__rows": F.lit(1)} | {f"__{i}": F.when(terms.present(F.col(c), x, cm.df.schema[c].dataType), 1).otherwise(0) for i, (c, x) in enumerate(cm.props.values())}
            rows = _keyed(cm.df, cm.pk)
            link = next((x for x in m.links if x.owner is cm and x.df is cm.df and len(x.checks) == 1 and x.unique), None)
            if link is not None:
                merged.add(id(link))
                parent, cols = link.parents[0]
                rows = rows.groupBy(*cols).agg(*[F.sum(v).alias(k) for k, v in measures.items()])
                keys = parent.df.select(*[F.col(k).alias(f"__pk{i}") for i, k in enumerate(parent.pk)], F.lit(1).alias("__hit"))
                keys = keys if parent.unique else keys.distinct()
                rows = rows.join(keys, [F.col(c) == F.col(f"__pk{i}") for i, c in enumerate(cols)], "left")
                one = rows.agg(*[F.sum(k).alias(k) for k in measures], F.sum(F.when(F.col("__hit") == 1, F.col("__rows"))).alias("__edge"))
            else:
                one = rows.agg(*[F.sum(v).alias(k) for k, v in measures.items()])
            n = F.col("__rows")
            cells = [items(n, RDF_TYPE, own, t, None) for t in w.types(m, cm)]
            for i, (prop, (_, x)) in enumerate(cm.props.items()):
                cells.append(items(F.col(f"__{i}"), m.iri(prop), own, None, terms.xsd_name(x)))
                cells += [items(F.col(f"__{i}"), RDF_TYPE, own, t, None) for t in w.domain.get(m.iri(prop), ()) if t not in w.types(m, cm)]
            for prop, obj in cm.consts.items():
                cells += [items(n, p, own, m.iri(obj), None) for p in [m.iri(prop), *w.super_props.get(m.iri(prop), ())]]
                cells += [items(n, RDF_TYPE, own, t, None) for t in w.domain.get(m.iri(prop), ()) if t not in w.types(m, cm)]
            if link is not None:
                cells += edge_items(link, F.col("__edge"))
            frames.append(one.select(F.inline(F.array(*cells))))
        for link in m.links:
            if id(link) not in merged:
                frames.append(edge_keys(link).agg(F.count(F.lit(1)).alias("__n")).select(F.inline(F.array(*edge_items(link, F.col("__n"))))))
        return union_all(frames)

    def typed_apart(self) -> bool:
        """Whether the class of every node is known from where it is made: no two classes share IRIs, keys are unique, ends of edges exist, and no axiom adds types."""
        m, w = self.m, self.w
        tpls = [m.template(cm) for cm in m.classes]
        if not all(cm.unique and m.template(cm).injective(cm.dtypes(cm.pk)) and not cm.consts for cm in m.classes):
            return False
        if any(not a.disjoint(b) for i, a in enumerate(tpls) for b in tpls[:i]) or w.domain or w.range or any(w.super_props.values()) or any(w.supers.values()):
            return False
        names = [m.iri(p) for cm in m.classes for p in cm.props] + [m.iri(x.edge.name) for x in m.links]
        sure = lambda x: {id(c) for c, _ in x.checks} | ({id(x.owner)} if x.owner else set()) >= {id(x.domain), id(x.range)}
        return len(set(m.iri(x.edge.name) for x in m.links)) == len(m.links) and len(names) >= len(set(names)) and all(sure(x) and _pairs_injective(m, x) for x in m.links)


def pick(triples: "DataFrame | MappedTriples", preds: list[str] | DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """Triples that an operator looks at. Of a frame only the kind of objects is cut down, as joins with predicates do the rest, unless ``preds`` is a list."""
    if isinstance(triples, MappedTriples):
        return triples.only(preds, kind)
    if isinstance(preds, list):
        triples = triples.where(F.col("p").isin(preds)) if len(preds) > 1 else triples.where(F.col("p") == preds[0])
    return triples if kind is None else triples.where(F.col("o_kind") == kind)


def emitted(m: Mapping) -> DataFrame:
    """Plain union of all outputs of a mapping, repeats included (parents never multiply rows)."""
    w = Widening.none()
    frames = [_class_frame(m, cm, [c for _, c in _class_outputs(m, cm, w)]) for cm in m.classes]
    for link in m.links:
        keys = edge_keys(link, distinct=False)
        frames.append(keys.select(*triple_columns(
            _end(m, link.domain, keys, "s"), m.iri(link.edge.name), _end(m, link.range, keys, "o"), "iri", None)))
    return union_all(frames)


def _edge_stats(m: Mapping, w: Widening) -> list[DataFrame]:
    frames = []
    for link in m.links:
        pred = m.iri(link.edge.name)
        # An edge output asserts no class of its own, so every domain and range class counts.
        per_row = (1 + len(w.super_props.get(pred, ())) + len(w.domain.get(pred, ())) + len(w.range.get(pred, ())))
        # Rows with an equal key agree on everything a join looks at, so they are counted first.
        cols = list(dict.fromkeys(c for _, k in link.parents for c in k))
        ends = list(dict.fromkeys([*link.s_cols, *link.o_cols]))
        rows = _keyed(link.df.select(*ends), ends).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
        for j, (parent, key) in enumerate(link.parents):
            counts = parent.df.groupBy(*[F.col(k).alias(f"__k{j}_{i}") for i, k in enumerate(parent.pk)]).agg(
                F.count(F.lit(1)).alias(f"__m{j}"))
            rows = rows.join(counts, [F.col(c) == F.col(f"__k{j}_{i}") for i, c in enumerate(key)], "inner")
        total = F.col("n") * per_row
        for j in range(len(link.parents)):
            total = total * F.col(f"__m{j}")
        frames.append(rows.agg(F.coalesce(F.sum(total), F.lit(0).cast("bigint")).alias("n_triples")).select(
            F.lit(f"map-{link.edge.name.lower()}").alias("mapping"), "n_triples"))
    return frames


def edge_stats(m: Mapping) -> DataFrame:
    """The part of :func:`mapping_stats` that concerns edges."""
    return union_all(_edge_stats(m, Widening.none()))


def mapping_stats(m: Mapping, tbox: Tbox | None = None) -> DataFrame:
    """Triples each mapping emits (before duplicates are removed), without building any of them.

    A class costs one aggregate over its table. An edge multiplies counts per key, so a key that holds
    a third of the rows travels as one row per task.
    """
    w = Widening.of(m, tbox)
    frames = []
    for cm in m.classes:
        used = list(dict.fromkeys([*cm.pk, *[c for c, _ in cm.props.values()]]))
        types = len(w.types(m, cm)) + sum(
            1 + len(w.super_props.get(m.iri(p), ())) + len(set(w.domain.get(m.iri(p), ())) - set(w.types(m, cm)))
            for p in cm.consts)
        per_row = F.lit(types).cast("bigint")
        for prop, (col, xsd) in cm.props.items():
            extra = len(set(w.domain.get(m.iri(prop), ())) - set(w.types(m, cm)))
            per_row = per_row + F.when(terms.present(F.col(col), xsd, cm.df.schema[col].dataType), 1 + extra).otherwise(0)
        frames.append(_keyed(cm.df.select(*used), cm.pk).agg(
            F.coalesce(F.sum(per_row), F.lit(0).cast("bigint")).alias("n_triples"),
        ).select(F.lit(f"map-{cm.name.lower()}").alias("mapping"), "n_triples"))
    return union_all(frames + _edge_stats(m, w))


def with_total(stats: DataFrame) -> DataFrame:
    """Append the grand total to per-mapping counts."""
    return stats.rollup("mapping").agg(F.sum("n_triples").alias("n_triples")).select(
        F.coalesce("mapping", F.lit("total")).alias("mapping"), "n_triples")


def direct_map(df: DataFrame, table: str, pk: list[str], unique: bool = False) -> ClassMap:
    """Class map straight from a table: every other flat column becomes a property."""
    props = {}
    for f in df.schema.fields:
        xsd = xsd_for(f.dataType.simpleString())
        if f.name not in pk and xsd:
            props[f.name] = (f.name, xsd)
    return ClassMap(table, df, pk, props=props, unique=unique)


def xsd_for(spark_type: str) -> str | None:
    """Literal type for a Spark type; nested types have none and have to be exploded first."""
    base = spark_type.split("(")[0]
    name = {"bigint": "integer", "int": "integer", "smallint": "short", "tinyint": "short",
            "double": "double", "float": "float", "boolean": "boolean", "date": "date",
            "timestamp": "dateTime", "timestamp_ntz": "dateTime", "string": "string",
            "varchar": "string", "char": "string", "time": "time"}.get(base)
    return spark_type if base == "decimal" else name
