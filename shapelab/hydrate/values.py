"""Values of one column as expressions over the row number.

A cell depends on the seed, the table, the column and its ordinal only, so any
partitioning gives the same rows and a larger table begins with the smaller one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import base36, bound, cell_state, draw, modulo, saturating_long, uniform

UNKNOWN_DISTINCT = 1 << 20


def null_at(ordinal: Column, fraction: float) -> Column:
    """Nulls spread evenly: where floor((i + 1) p) exceeds floor(i p)."""
    return F.floor((ordinal + 1) * F.lit(fraction)) > F.floor(ordinal * F.lit(fraction))


def state(seed: int, table: str, column: str, ordinal: Column) -> Column:
    return cell_state(seed, table, column, ordinal)


def pick(state: Column, n: int) -> Column:
    """The first draw of the cell, modulo n."""
    return modulo(draw(state), n)


def number(ordinal: Column, state: Column, unique: bool, distinct: int | None) -> Column:
    """n of a cell: the ordinal of a unique column, else one of its distinct values."""
    return ordinal if unique else pick(state, distinct if distinct else UNKNOWN_DISTINCT)


def in_range(n: Column, low: int, high: int, unique: bool) -> Column:
    return F.lit(low) + (n if unique else F.pmod(n, F.lit(high - low + 1)))


def histogram_draw(state: Column, bounds: list[float]) -> Column:
    """A bucket by the first draw, a place in it by the second, truncated."""
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    bucket = modulo(draw(state, 1), len(bounds) - 1).cast("int")
    return bound(bucket, lambda b: saturating_long(F.element_at(edges, b + 1) + uniform(draw(state, 2)) * (F.element_at(edges, b + 2) - F.element_at(edges, b + 1))))


def in_time(n: Column, low: str, high: str, unique: bool, distinct: int) -> Column:
    """Spread over the span: n microseconds apart if unique, else n-th part of the span."""
    first = F.unix_micros(F.lit(low).cast("timestamp"))
    span = F.unix_micros(F.lit(high).cast("timestamp")) - first
    step = n if unique else F.floor(n.cast("double") / F.lit(float(max(distinct, 1))) * span).cast("long")
    return F.timestamp_micros(first + step)


# How a value of each class is written.
TEMPLATES = {
    "email": "user_%05d@example.invalid",
    "uuid": "00000000-0000-4000-8000-%012d",
    "url": "https://example.invalid/%d",
    "hostname": "host-%d.example.invalid",
    "slug": "slug-%d",
    "numeric_string": "%d",
    "enum_like": "value_%d",
    "free_text": "sample text %d",
    "default": "val_%d",
}


def template(format_class: str, n: Column, values: list[str] | None = None) -> Column:
    if format_class in ("ipv4", "inet"):
        return F.format_string("192.0.2.%d", F.pmod(n, F.lit(256)))
    if format_class == "enum_like" and values:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))
    return F.format_string(TEMPLATES.get(format_class, TEMPLATES["default"]), n)


def _hex(n: Column, bits: int) -> Column:
    return F.lpad(F.lower(F.hex(F.pmod(n, F.lit(1 << bits)))), bits // 4, "0")


def bit_string(n: Column, width: int) -> Column:
    """The low bits of n, as many as the type is wide (64 at most), the highest first."""
    return F.right(F.lpad(F.bin(n), 64, "0"), F.lit(min(max(width, 1), 64)))


# How a value of each type without a class is written.
TYPED = {
    "bool": lambda n: (F.pmod(n, F.lit(2)) == 0).cast("string"),
    "inet": lambda n: template("ipv4", n),
    "macaddr": lambda n: F.concat(F.lit("08:00:2b:"), F.regexp_replace(_hex(n, 24), "(..)(..)(..)", "$1:$2:$3")),
    "macaddr8": lambda n: F.concat(F.lit("08:00:2b:"), F.regexp_replace(_hex(n, 40), "(..)(..)(..)(..)(..)", "$1:$2:$3:$4:$5")),
    "interval": lambda n: F.format_string("%d seconds", n),
    "json": lambda n: F.lit("{}"),
    "xml": lambda n: F.format_string("<value>%d</value>", n),
    "point": lambda n: F.format_string("(%d,%d)", n, n),
    "bytea": lambda n: F.format_string("\\x%08x", n),
    "uuid": lambda n: template("uuid", n),
}
_ALSO = {"boolean": "bool", "cidr": "inet", "jsonb": "json"}


def has_form(kind: str) -> bool:
    return _ALSO.get(kind, kind) in TYPED


def typed(kind: str, n: Column) -> Column:
    """Values of types without a class, as text."""
    return TYPED.get(_ALSO.get(kind, kind), lambda n: template("default", n))(n)


def one_element(value: Column) -> Column:
    """An array literal of one element, what is structural in it escaped."""
    text = F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('{"'), text, F.lit('"}'))


def fit_width(text: Column, n: Column, width: int | None, unique: bool) -> Column:
    """Cut to width, keeping the part that tells values apart."""
    if not width:
        return text
    tail = F.right(base36(n), F.lit(width))
    short = tail if unique else F.when(F.length(tail) >= width, tail).otherwise(F.concat(F.substring(text, F.lit(1), F.lit(width) - F.length(tail)), tail))
    return F.when(F.length(text) <= width, text).otherwise(short)


def clamp(value: Column, low=None, high=None) -> Column:
    if low is not None:
        value = F.greatest(value, F.lit(low))
    return F.least(value, F.lit(high)) if high is not None else value


def label(state: Column, labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (pick(state, len(labels)) + 1).cast("int"))
