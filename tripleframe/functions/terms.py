"""Terms of a graph as Spark columns: IRIs, literals, their text forms and typed values.

Everything here is a composition of built-in functions, so it stays inside whole-stage codegen.
"""
from __future__ import annotations

import datetime
import math
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD_NS = "http://www.w3.org/2001/XMLSchema#"

# The literal types a property may be declared with.
XSD_TYPES = ("string", "integer", "long", "short", "double", "float", "decimal", "boolean", "date",
             "time", "dateTime")

_DECIMAL = re.compile(r"decimal\((\d+),\s*(\d+)\)")

# Spark type that the lexical form of each literal type is read back as.
_VALUE_TYPE = {"string": "string", "integer": "bigint", "long": "bigint", "short": "smallint",
               "double": "double", "float": "float", "decimal": "decimal(38,10)",
               "boolean": "boolean", "date": "date", "time": "string", "dateTime": "timestamp_ntz"}


def xsd_name(xsd: str) -> str:
    """Normalise a declared type: ``datetime`` is an alias, ``decimal(p,s)`` is a ``decimal``."""
    name = "decimal" if _DECIMAL.fullmatch(xsd) else {"datetime": "dateTime"}.get(xsd, xsd)
    if name not in XSD_TYPES:
        raise ValueError(f"unsupported literal type {xsd!r}; expected one of {', '.join(XSD_TYPES)}")
    return name


def encode(col: Column, dtype: T.DataType | None = None) -> Column:
    """Percent-encode every character outside the unreserved set. NULL stays NULL.

    Whole numbers hold only digits and a sign, so they need no encoding and cost a plain cast.
    """
    if isinstance(dtype, T.IntegralType):
        return col.cast("string")
    quoted = F.url_encode(col.cast("string"))
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(found), F.lit(wanted))
    return quoted


def iri(base: str, cols: list[Column], sep: str = "-", dtypes: list[T.DataType] | None = None) -> Column:
    """``base`` + encoded columns joined by ``sep``. ``concat`` makes any NULL key give a NULL IRI."""
    parts: list[Column] = [F.lit(base)]
    for i, col in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(encode(col, dtypes[i] if dtypes else None))
    return F.concat(*parts)


def lexical(col: Column, xsd: str, dtype: T.DataType | None = None) -> Column:
    """Text of a literal of the declared type.

    A value that cannot be read as a date, dateTime or decimal where one is declared has no text (NULL), so it gives no
    triple; the conformance audit counts it. Nothing is rounded unless ``decimal(p,s)`` asks for it.
    """
    name = xsd_name(xsd)
    if name == "date":
        return col.try_cast("date").cast("string")
    if name == "time":
        return F.date_format(col, "HH:mm:ss") if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) \
            else col.cast("string")
    if name == "dateTime":
        return F.replace(col.try_cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))
    if name == "decimal":
        exact = _DECIMAL.fullmatch(xsd)
        if exact:
            return col.try_cast(f"decimal({exact[1]},{exact[2]})").cast("string")
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            # Floating text may carry an exponent, which a decimal literal must not. The first scale that holds the
            # value is taken; beyond 38 digits there is no decimal.
            exact_at = [col.try_cast(f"decimal(38,{scale})") for scale in (10, 0, 20, 30, 37)]
            plain = F.coalesce(*[F.when(d.cast("double") == col.cast("double"), d.cast("string")) for d in exact_at])
            return F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return col.cast("string")


def present(col: Column, xsd: str, dtype: T.DataType | None = None) -> Column:
    """Whether a value gives a literal of the declared type: it is there, and its text is too where that may fail."""
    name = xsd_name(xsd)
    sure = (name not in ("date", "dateTime", "decimal") or (name != "decimal" and isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)))
            or (xsd == "decimal" and not isinstance(dtype, (T.DoubleType, T.FloatType))))
    return col.isNotNull() if sure else col.isNotNull() & lexical(col, xsd, dtype).isNotNull()


def typed(col: Column, xsd: str, dtype: T.DataType | None = None) -> Column:
    """Typed value of a source column, equal to ``value(lexical(col, xsd), xsd)`` without the text.

    When the source already has the wanted type there is no cast at all, so that comparisons on
    the result can still be pushed into the scan.
    """
    exact = _DECIMAL.fullmatch(xsd)
    wanted = f"decimal({exact[1]},{exact[2]})" if exact else value_type(xsd)
    if dtype is not None and dtype.simpleString() == wanted:
        return col
    name = xsd_name(xsd)
    if name in ("date", "dateTime") or exact or isinstance(dtype, T.StringType) and name != "time":
        return col.try_cast(wanted)
    if name in ("integer", "long", "short") and isinstance(dtype, T.IntegralType):
        return col.try_cast(wanted)
    return value(lexical(col, xsd, dtype), xsd)


def value_type(xsd: str) -> str:
    exact = _DECIMAL.fullmatch(xsd)
    return f"decimal({exact[1]},{exact[2]})" if exact else _VALUE_TYPE[xsd_name(xsd)]


def value(col: Column | str, xsd: str) -> Column:
    """Typed value of a lexical form; text that does not conform gives NULL, so a filter drops it."""
    col = F.col(col) if isinstance(col, str) else col
    return col.try_cast(value_type(xsd))


def local_name(col: Column | str) -> Column:
    """Part of an IRI after the last ``#``, else after the last ``/``."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(F.instr(col, "#") > 0, F.substring_index(col, "#", -1)).otherwise(
        F.substring_index(col, "/", -1))


def namespace(col: Column | str) -> Column:
    """Part of an IRI up to and including the last ``#``, else the last ``/``."""
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(col, r"^(.*#|[^#]*/)", 1)


def nt_escape(col: Column) -> Column:
    """Escape a literal for an N-Triples line; the backslash has to go first."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        col = F.replace(col, F.lit(raw), F.lit(escaped))
    return col


# Runs of codes of one length; possessive, so that a run of any length is matched in a loop.
_CODES = r"(?:\\u[0-9A-Fa-f]{4})++|(?:\\U[0-9A-Fa-f]{8})++"


def nt_unescape(col: Column) -> Column:
    """Undo N-Triples escapes: those of control characters and quotes, ``\\uXXXX`` and ``\\UXXXXXXXX``.

    Splitting on escaped backslashes first keeps ``\\\\n`` (backslash, n) apart from ``\\n`` (newline). Every
    step is over pieces, so that each piece is computed once; a run of codes is one piece and is decoded at once.
    """
    def plain(piece: Column) -> Column:
        for escaped, raw in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'")):
            piece = F.replace(piece, F.lit(escaped), F.lit(raw))
        return piece

    def chars(run: Column) -> Column:
        short = F.decode(F.unhex(F.replace(run, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        long = F.decode(F.unhex(F.replace(run, F.lit("\\U"), F.lit(""))), "UTF-32")
        return F.when(run.isNull(), "").when(run.startswith("\\u"), short).otherwise(long)

    def coded(piece: Column) -> Column:
        between, runs = F.split(piece, _CODES), F.regexp_extract_all(piece, F.lit(_CODES), F.lit(0))
        return F.array_join(F.zip_with(between, runs, lambda text, run: F.concat(plain(text), chars(run))), "")

    pieces = F.split(col, r"\\\\")
    has_code = F.contains(col, F.lit("\\u")) | F.contains(col, F.lit("\\U"))
    return (F.when(~F.contains(col, F.lit("\\")), col)
            .when(has_code, F.array_join(F.transform(pieces, coded), "\\"))
            .otherwise(F.array_join(F.transform(pieces, plain), "\\")))


def object_to_nt(o: Column, o_kind: Column, o_type: Column) -> Column:
    """N-Triples text of an object column."""
    typed_literal = F.concat(F.lit('"'), nt_escape(o), F.lit(f'"^^<{XSD_NS}'), o_type, F.lit(">"))
    plain = F.concat(F.lit('"'), nt_escape(o), F.lit('"'))
    node = F.when(o.startswith("_:"), o).otherwise(F.concat(F.lit("<"), o, F.lit(">")))
    return (F.when(o_kind == "iri", node)
            .when(o_type.isNull(), plain)
            .when(o_type.startswith("@"), F.concat(plain, o_type))
            .when(F.contains(o_type, F.lit(":")), F.concat(plain, F.lit("^^<"), o_type, F.lit(">")))
            .otherwise(typed_literal))


# ---------------------------------------------------------------- ranges of values

NUMBERS = ("integer", "long", "short", "double", "float", "decimal")
TIMES = ("date", "dateTime")


@dataclass(frozen=True)
class Range:
    """Numbers or points in time that a literal's value must lie in; bounds that are None are open.

    Numbers are compared exactly, whatever their size and digits (up to 38), dates and dateTimes as points in time without a zone. Literals of other
    types are in no range.
    """
    least: object = None
    most: object = None
    above: object = None
    below: object = None

    def __post_init__(self):
        if not self.tests:
            raise ValueError("a range needs a bound")
        if len({self.temporal} | {isinstance(b, datetime.date) for _, b in self.tests}) > 1:
            raise ValueError("the bounds of a range are numbers or points in time, not both")
        if not self.temporal:
            for _, b in self.tests:
                if not Decimal(str(b)).is_finite() or len(Decimal(str(b)).as_tuple().digits) > 37:
                    raise ValueError(f"{b} is no bound: a finite number of at most 37 digits is needed")

    @property
    def tests(self) -> list[tuple[str, object]]:
        named = ((">=", self.least), ("<=", self.most), (">", self.above), ("<", self.below))
        return [(op, b) for op, b in named if b is not None]

    @property
    def temporal(self) -> bool:
        return isinstance(self.tests[0][1], datetime.date)


def _compare(a: Column, op: str, b: Column) -> Column:
    return {">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b}[op]


def number(text: Column) -> Column:
    """The nearest double of a number's text."""
    return text.try_cast("double")


def instant(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def _near(bound: Decimal) -> tuple[float, float]:
    """Doubles below and above a number, two steps off, so that rounding cannot take its double beyond them."""
    f = float(bound)
    low, high = math.nextafter(f, -math.inf), math.nextafter(f, math.inf)
    return math.nextafter(low, -math.inf), math.nextafter(high, math.inf)


def in_range(r: Range, text: Column, num: Column, at: Column) -> Column:
    """Whether a literal is in the range, from its text and the number or time in columns of their own, which files can be skipped by.

    The double decides but next to a bound; there the text is read as a decimal with as many digits behind the point as the bound leaves room for.
    """
    out = None
    for op, bound in r.tests:
        if r.temporal:
            cond = _compare(at, op, instant_literal(bound))
        else:
            b = Decimal(str(bound))
            low, high = _near(b)
            kind = f"decimal(38,{min(37, max(0, 36 - max(b.adjusted(), 0)))})"
            exact = F.coalesce(_compare(text.try_cast(kind), op, F.lit(format(b, "f")).cast(kind)), F.lit(False))
            up = op in (">=", ">")
            cond = (num >= low) & ~F.isnan(num) & ((num > high) | exact) if up else (num <= high) & ((num < low) | exact)
        out = cond if out is None else out & cond
    return out


def instant_literal(bound: datetime.date) -> Column:
    at = bound if isinstance(bound, datetime.datetime) else datetime.datetime(bound.year, bound.month, bound.day)
    return F.lit(at.replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")


def implied_range(r: Range, col: Column, xsd: str, dtype: T.DataType) -> Column | None:
    """A condition on the raw column that every value in the range meets, of a form that reaches the scan; None if there is none."""
    out = None
    exact = _DECIMAL.fullmatch(xsd)
    for op, bound in r.tests:
        up, cond = op in (">=", ">"), None
        if r.temporal and isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            at = bound if isinstance(bound, datetime.datetime) else datetime.datetime(bound.year, bound.month, bound.day)
            # A day of slack covers every zone and what a date leaves out of a time.
            slack = datetime.timedelta(days=0 if isinstance(dtype, T.TimestampNTZType) and xsd_name(xsd) == "dateTime" else 1)
            at = at.replace(tzinfo=None) - slack if up else at.replace(tzinfo=None) + slack
            text = F.lit(at.date().isoformat() if isinstance(dtype, T.DateType) else at.isoformat(" ")).cast(dtype)
            cond = col >= text if up else col <= text
        elif not r.temporal and isinstance(dtype, (T.IntegralType, T.DecimalType, T.DoubleType, T.FloatType)):
            b = Decimal(str(bound))
            slack = Decimal(1).scaleb(-int(exact[2])) if exact else Decimal(0)
            b = b - slack if up else b + slack
            if isinstance(dtype, T.IntegralType):
                whole, top = math.floor(b) if up else math.ceil(b), {"tinyint": 7, "smallint": 15, "int": 31}.get(dtype.simpleString(), 63)
                if -(1 << top) <= whole < 1 << top:
                    cond = col >= F.lit(whole).cast(dtype) if up else col <= F.lit(whole).cast(dtype)
            elif isinstance(dtype, T.DecimalType):
                unit = Decimal(1).scaleb(-dtype.scale)
                fit = (b / unit).to_integral_value("ROUND_FLOOR" if up else "ROUND_CEILING") * unit
                if fit.adjusted() < dtype.precision - dtype.scale:
                    cond = col >= F.lit(format(fit, "f")).cast(dtype) if up else col <= F.lit(format(fit, "f")).cast(dtype)
            elif isinstance(dtype, T.DoubleType):
                low, high = _near(b)
                cond = col >= F.lit(low) if up else col <= F.lit(high)
        if cond is not None:
            out = cond if out is None else out & cond
    return out
