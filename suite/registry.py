"""Named cases: a function of (spark, sf_dir), with the same result as SQL where SQL can say it."""
from __future__ import annotations

CASES: dict = {}
SQL: dict[str, str] = {}

NS = "http://example.org/kg#"
TYPE = "'http://www.w3.org/1999/02/22-rdf-syntax-ns#type'"
NULL = "cast(null as varchar)"


def case(name: str, sql: str | None = None):
    def add(fn):
        CASES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def i(path: str, *cols: str, sep: str = "-") -> str:
    """SQL text of an IRI with plain integer keys."""
    keys = f" || '{sep}' || ".join(f"cast({c} as varchar)" for c in cols)
    return f"'{NS}{path}/' || {keys}"


def n(name: str) -> str:
    return f"'{NS}{name}'"


def money(col: str) -> str:
    return f"cast(cast({col} as decimal(18,2)) as varchar)"


def t(s: str, p: str, o: str, xsd: str | None = None) -> str:
    """SQL select list of a triple."""
    kind, o_type = ("'lit'", f"'{xsd}'") if xsd else ("'iri'", NULL)
    return f"{s} as s, {p} as p, {o} as o, {kind} as o_kind, {o_type} as o_type"
