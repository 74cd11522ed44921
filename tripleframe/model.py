"""What a user declares: class maps and edge maps over DataFrames, and the ontology."""
from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleframe.functions import terms
from tripleframe.plans.support import local_frame

RDF_TYPE = terms.RDF_TYPE

# o_kind is 'iri' or 'lit'; o_type is the local name of the literal type, NULL for IRIs.
TRIPLE_SCHEMA = T.StructType([
    T.StructField("s", T.StringType()), T.StructField("p", T.StringType()),
    T.StructField("o", T.StringType()), T.StructField("o_kind", T.StringType()),
    T.StructField("o_type", T.StringType()),
])
TRIPLE_COLS = TRIPLE_SCHEMA.fieldNames()

EDGE_MODES = ("domain_fk", "range_fk", "junction")


def like(col: Column, have: T.DataType, want: T.DataType) -> Column | None:
    """``col`` as a value of type ``want`` to compare it with, NULL if it is none; None where the types compare as they are."""
    whole = isinstance(have, T.IntegralType) and isinstance(want, T.IntegralType)
    return None if whole or have == want or isinstance(want, T.NullType) else col.try_cast(want.simpleString())


@dataclass(frozen=True)
class Template:
    """Shape of the IRIs of a class: two templates with the same shape give comparable keys."""
    base: str
    sep: str
    arity: int

    def render(self, cols: list[Column], dtypes: list[T.DataType] | None = None) -> Column:
        return terms.iri(self.base, cols, self.sep, dtypes)

    def disjoint(self, other: "Template") -> bool:
        """True when no IRI can have both shapes: encoded keys never contain a slash."""
        return self.base != other.base and "/" not in self.sep and "/" not in other.sep

    def injective(self, dtypes: list[T.DataType]) -> bool:
        """True when different keys always give different IRIs.

        A separator inside a text key would make ``a-b`` + ``c`` and ``a`` + ``b-c`` the same IRI,
        unless encoding always escapes the separator.
        """
        if self.arity == 1 or all(isinstance(t, T.IntegralType) and self.sep for t in dtypes):
            return True
        return bool(self.sep) and all(c in "/:|,;@&=+$!*'()#?[]" for c in self.sep)


@dataclass(eq=False)
class ClassMap:
    """Rows of ``df`` are instances of a class; ``props`` maps property name to ``(column, type)``.

    ``unique=True`` promises that ``pk`` identifies a row (a declared primary key). It spares every
    duplicate-removal shuffle; :func:`tripleframe.iri_overlap` checks the promise.
    """
    name: str
    df: DataFrame
    pk: list[str]
    path: str | None = None
    props: dict[str, tuple[str, str]] = field(default_factory=dict)
    sep: str = "-"
    unique: bool = False
    consts: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.path = self.path or self.name.lower()
        if not self.pk:
            raise ValueError(f"class {self.name}: at least one key column is needed")
        have = set(self.df.columns)
        for col in list(self.pk) + [c for c, _ in self.props.values()]:
            if col not in have:
                raise ValueError(f"class {self.name}: column {col} is not in its table")
        for _, xsd in self.props.values():
            terms.xsd_name(xsd)

    def dtypes(self, cols: list[str]) -> list[T.DataType]:
        return [self.df.schema[c].dataType for c in cols]


@dataclass(eq=False)
class EdgeMap:
    """Object property between two classes.

    ``domain_fk``: the domain's table holds the key of the range in ``domain_cols``.
    ``range_fk``: the range's table holds the key of the domain in ``domain_cols``.
    ``junction``: ``df`` links both, by ``domain_cols`` and ``range_cols``.
    ``df`` may be left out for the two foreign-key modes, meaning the class's own table.
    ``unique=True`` promises that the key pairs of a junction (or of a separate ``df``) do not repeat.
    ``enforced=True`` promises that every key finds its parent, as a database constraint would; the joins
    that check it are then left out. :func:`tripleframe.operators.audit.fk_hit_rates` tests that promise.
    """
    name: str
    domain: str
    range: str
    mode: str
    domain_cols: list[str]
    range_cols: list[str] = field(default_factory=list)
    df: DataFrame | None = None
    unique: bool = False
    enforced: bool = False

    def __post_init__(self):
        if self.mode not in EDGE_MODES:
            raise ValueError(f"edge {self.name}: mode must be one of {', '.join(EDGE_MODES)}")
        if self.mode == "junction" and self.df is None:
            raise ValueError(f"edge {self.name}: a junction needs its linking table")


@dataclass(frozen=True)
class Link:
    """An edge map resolved against its classes: where the rows are and what both ends are made of."""
    edge: EdgeMap
    domain: ClassMap
    range: ClassMap
    df: DataFrame
    s_cols: tuple[str, ...]
    o_cols: tuple[str, ...]
    # (class whose table must hold the key, columns of df with that key)
    parents: tuple[tuple[ClassMap, tuple[str, ...]], ...]
    # class whose own table is scanned, when it is one
    owner: ClassMap | None
    # the link on the key columns as they are, where their types differ from those of the parents' keys
    given: "Link | None" = None

    @property
    def as_given(self) -> "Link":
        """The link on raw key columns, for audits of what is in them."""
        return self.given or self

    @property
    def checks(self) -> tuple[tuple[ClassMap, tuple[str, ...]], ...]:
        """Parents whose existence has to be checked."""
        return () if self.edge.enforced else self.parents

    @property
    def unique(self) -> bool:
        return self.edge.unique or (self.owner is not None and self.owner.unique)


@dataclass
class Mapping:
    """Class maps and edge maps under one namespace. Edges that cannot work are left out and reported."""
    ns: str
    classes: list[ClassMap]
    edges: list[EdgeMap] = field(default_factory=list)
    strict: bool = False

    def __post_init__(self):
        self.by_name = {c.name: c for c in self.classes}
        if len(self.by_name) != len(self.classes):
            raise ValueError("class names must be different")
        self.links: list[Link] = []
        self.warnings: list[str] = []
        for e in self.edges:
            link = self._resolve(e)
            if isinstance(link, str):
                if self.strict:
                    raise ValueError(link)
                self.warnings.append(link)
            else:
                self.links.append(link)

    def _resolve(self, e: EdgeMap) -> Link | str:
        a, b = self.by_name.get(e.domain), self.by_name.get(e.range)
        if a is None or b is None:
            return f"edge {e.name}: class {e.domain if a is None else e.range} is not mapped, skipped"
        wanted = {"domain_fk": len(b.pk), "range_fk": len(a.pk), "junction": len(a.pk)}[e.mode]
        if len(e.domain_cols) != wanted or (e.mode == "junction" and len(e.range_cols) != len(b.pk)):
            return f"edge {e.name}: number of key columns does not fit the class it points to, skipped"
        if e.mode == "domain_fk":
            owner, s, o, parents = a, a.pk, e.domain_cols, [(b, e.domain_cols)]
        elif e.mode == "range_fk":
            owner, s, o, parents = b, e.domain_cols, b.pk, [(a, e.domain_cols)]
        else:
            owner, s, o = None, e.domain_cols, e.range_cols
            parents = [(a, e.domain_cols), (b, e.range_cols)]
        df = e.df if e.df is not None else owner.df
        if e.df is not None and owner is not None and e.df is not owner.df:
            owner = None
        missing = [c for c in [*s, *o] if c not in df.columns]
        if missing:
            return f"edge {e.name}: column {', '.join(missing)} is not in its table, skipped"
        link = Link(e, a, b, df, tuple(s), tuple(o), tuple((c, tuple(k)) for c, k in parents), owner)
        return self._fitted(link)

    @staticmethod
    def _fitted(link: Link) -> Link:
        """Key columns brought to the type of the parent's key, so that text `7` finds the number 7 and text `n` finds nothing."""
        new: dict[str, Column] = {}
        parents = []
        for cm, cols in link.parents:
            names = []
            for c, k in zip(cols, cm.pk):
                have, want = link.df.schema[c].dataType, cm.df.schema[k].dataType
                fit = like(F.col(c), have, want)
                name = c if fit is None else f"__{c}_as_{want.simpleString()}"
                if fit is not None:
                    new[name] = fit
                names.append(name)
            parents.append((cm, tuple(names)))
        if not new:
            return link
        ends = {"domain_fk": (link.s_cols, parents[0][1]), "range_fk": (parents[0][1], link.o_cols)}.get(link.edge.mode) or (parents[0][1], parents[1][1])
        return replace(link, df=link.df.withColumns(new), s_cols=ends[0], o_cols=ends[1], parents=tuple(parents), given=link)

    def iri(self, name: str) -> str:
        """Full IRI of a class or property; names that already are IRIs pass through."""
        if name in ("a", "rdf:type"):
            return RDF_TYPE
        return name if "://" in name or name.startswith("urn:") else self.ns + name

    def template(self, cm: ClassMap) -> Template:
        return Template(f"{self.ns}{cm.path}/", cm.sep, len(cm.pk))

    def subject(self, cm: ClassMap, cols: list[str] | tuple[str, ...] | None = None,
                df: DataFrame | None = None, prefix: str = "") -> Column:
        """IRI column of an instance of ``cm`` whose key sits in ``cols`` of ``df``."""
        cols, df = list(cols or cm.pk), df if df is not None else cm.df
        dtypes = [df.schema[c].dataType for c in cols]
        return self.template(cm).render([F.col(prefix + c) for c in cols], dtypes)

    def with_classes(self, **changes: ClassMap) -> "Mapping":
        return replace(self, classes=[changes.get(c.name, c) for c in self.classes])


_TBOX_FRAMES = {
    "classes": ("cls", "label"), "properties": ("prop", "kind", "label"),
    "sub_class": ("child", "parent"), "sub_prop": ("child", "parent"),
    "domain": ("prop", "cls"), "range": ("prop", "cls"), "inverse": ("prop", "inverse"),
    "equivalent": ("a", "b"), "disjoint": ("a", "b"),
}


@dataclass
class Tbox:
    """The ontology as DataFrames of full IRIs; an absent part is an empty frame."""
    spark: SparkSession
    frames: dict[str, DataFrame]

    @classmethod
    def of(cls, spark: SparkSession, ns: str = "", **axioms) -> "Tbox":
        """Build from Python rows or DataFrames; short names get ``ns`` in front."""
        def full(v, is_name):
            if v is None or not is_name or "://" in v:
                return v
            return terms.XSD_NS + v[4:] if v.startswith("xsd:") else ns + v

        frames = {}
        for part, names in _TBOX_FRAMES.items():
            rows = axioms.pop(part, None)
            if isinstance(rows, DataFrame):
                frames[part] = rows.toDF(*names)
                continue
            data = [tuple(full(v, names[i] not in ("label", "kind")) for i, v in enumerate(r))
                    for r in rows or []]
            frames[part] = local_frame(spark, **{n: [r[i] for r in data] for i, n in enumerate(names)})
        if axioms:
            raise ValueError(f"unknown ontology parts: {', '.join(axioms)}")
        return cls(spark, frames)

    def __getattr__(self, part: str) -> DataFrame:
        frames = self.__dict__.get("frames", {})
        if part in frames:
            return frames[part]
        raise AttributeError(part)
