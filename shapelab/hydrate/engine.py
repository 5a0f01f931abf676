"""Tables from facts: one select of column expressions over spark.range."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fanout, values

# Types for which no value can be made.
REFUSED = "tsvector tsquery line lseg box path polygon circle".split()
INTEGERS = "smallint integer int bigint int2 int4 int8 serial bigserial smallserial".split()
NUMBERS = [*INTEGERS, "numeric", "decimal", "real", "double precision", "float4", "float8", "money"]
TIMES = ["date", "timestamp", "timestamptz", "timestamp with time zone", "timestamp without time zone"]


class UnsupportedTypeError(ValueError):
    """A column whose type has no generator; named before any row is made."""


class BudgetError(ValueError):
    """More cells than the caller allows; told before any row is made."""


@dataclass
class Reference:
    """A foreign key: the parent's shape, its key column, and how children spread over parents."""

    parent: TableShape
    column: str
    shape: fanout.Shape | None = None
    orphan_fraction: float = 0.0


@dataclass
class ColumnShape:
    name: str
    data_type: str = "text"
    null_fraction: float = 0.0
    unique: bool = False
    distinct: int | None = None
    low: object = None
    high: object = None
    bounds: list[float] | None = None
    format_class: str | None = None
    labels: list[str] | None = None
    width: int | None = None
    check: tuple | None = None
    reference: Reference | None = None
    generated: bool = False


@dataclass
class TableShape:
    name: str
    rows: int
    columns: list[ColumnShape] = field(default_factory=list)


def base_type(kind: str) -> str:
    return kind.split("(")[0].strip().lower()


def resolve_type(kind: str, domains: dict[str, str] | None) -> str:
    """The base type of a domain, over 16 domains at most."""
    for _ in range(16):
        if not domains or kind not in domains:
            break
        kind = domains[kind]
    return kind


def refuse_unsupported(table: TableShape) -> None:
    for c in table.columns:
        kind = base_type(c.data_type.removesuffix("[]"))
        if not c.reference and (kind in REFUSED or kind.endswith("range")):
            raise UnsupportedTypeError(f"{table.name}.{c.name}: no value can be made for type {c.data_type}")


def cell(seed: int, table: str, c: ColumnShape, ordinal: Column) -> Column:
    """The value of a column that is no reference, before nulls."""
    state = values.state(seed, table, c.name, ordinal)
    kind = base_type(c.data_type)
    if c.labels:
        made = values.label(state, c.labels)
        return values.one_element(made) if c.data_type.endswith("[]") else made
    if c.data_type.endswith("[]"):
        element = ColumnShape(c.name, c.data_type[:-2], unique=c.unique, distinct=c.distinct)
        return values.one_element(cell(seed, table, element, ordinal))
    if kind in NUMBERS:
        if c.bounds and not c.unique:
            out = values.histogram_draw(state, c.bounds)
        else:
            n = values.number(ordinal, state, c.unique, c.distinct)
            low = int(c.low or 0)
            if c.unique and c.check:
                low = max(low, int(c.check[0] if c.check[0] is not None else low))  # keys start where the check allows
            out = values.in_range(n, low, int(c.high), c.unique) if c.high is not None else F.lit(low) + n
        return values.clamp(out, *c.check) if c.check and not c.unique else out
    n = values.number(ordinal, state, c.unique, c.distinct)
    if kind in TIMES:
        return values.in_time(n, str(c.low or "2000-01-01"), str(c.high or "2001-01-01"), c.unique, c.distinct or values.UNKNOWN_DISTINCT)
    if kind in ("boolean", "bool"):
        return F.pmod(n, F.lit(2)) == 0
    if kind in ("bit", "bit varying", "varbit"):
        return values.bit_string(n, int((re.findall(r"\d+", c.data_type) or [1])[0]))
    if values.has_form(kind) and not c.format_class:
        return values.typed(kind, n)
    return values.fit_width(values.template(c.format_class or "default", n), n, c.width, c.unique)


# Names of the types of DataFrames.
_FRAME_TYPES = {"string": "text", "binary": "bytea", "double": "double precision", "float": "real", "tinyint": "smallint", "timestamp_ntz": "timestamp"}


def tables_of(document: dict) -> list[TableShape]:
    """The table shapes of a shape document; a column without facts gets those of its type."""
    value = lambda f: f.get("value") if isinstance(f, dict) else f
    out = {t: TableShape(t, int(value(body.get("rows")) or 0)) for t, body in (document.get("tables") or {}).items()}
    for t, shape in out.items():
        body = document["tables"][t]
        refs = {r["column"]: r for r in body.get("references") or [] if r.get("parent") in out and r.get("parent_column")}
        for c, x in sorted((body.get("columns") or {}).items()):
            kind, span, r, fan = x.get("type") or "text", x.get("range") or {}, refs.get(c), (refs.get(c) or {}).get("fanout")
            ref = Reference(out[r["parent"]], r["parent_column"], fanout.Shape(*[fan.get(k) for k in ("mean", "p50", "p95", "max")]) if fan else None, float(value(r.get("orphan_fraction")) or 0.0)) if r else None
            shape.columns.append(ColumnShape(c, _FRAME_TYPES.get(kind, kind), float(value(x.get("null_fraction")) or 0.0), bool(value(x.get("unique"))), value(x.get("distinct")), span.get("min"), span.get("max"), format_class=x.get("format"), reference=ref))
    return list(out.values())


def parent_key(seed: int, ref: Reference, parents: int, slot: Column) -> Column:
    """The key of a parent by its ordinal: the parent's own expression on that ordinal, so no
    join is needed.  Ordinals from `parents` on are orphans: keys are unique, so no parent
    has the value of one."""
    key = next((c for c in ref.parent.columns if c.name == ref.column), None)
    if key is None or key.reference:
        raise ValueError(f"{ref.parent.name}.{ref.column} is no column of its own that a reference can follow")
    return cell(seed, ref.parent.name, replace(key, unique=True), slot)


def generate(spark: SparkSession, table: TableShape, seed: int, scale: float = 1.0, cap: int | None = None, max_cells: int | None = None) -> DataFrame:
    """The rows of one table, columns in sorted order, `ordinal` first.  References point at
    the rows that the parent's shape gives for the same seed, scale and cap."""
    refuse_unsupported(table)
    if max_cells is not None and cells([table], scale, cap) > max_cells:
        raise BudgetError(f"{table.name}: {cells([table], scale, cap)} cells are more than {max_cells}")
    rows = fanout.plan_rows(table.rows, scale, cap)
    out = spark.range(rows).withColumnRenamed("id", "ordinal")
    for c in sorted(table.columns, key=lambda c: c.name):
        if c.generated:
            continue
        if c.reference:
            parents = fanout.plan_rows(c.reference.parent.rows, scale, cap)
            slots = fanout.assign(spark, rows, parents, table.rows, c.reference.shape, c.reference.orphan_fraction)
            key = parent_key(seed, c.reference, parents, F.col("parent"))
            out = out.join(slots.select(F.col("child").alias("ordinal"), F.when(F.col("parent").isNotNull(), key).alias(c.name)), "ordinal", "left")
        else:
            out = out.withColumn(c.name, cell(seed, table.name, c, F.col("ordinal")))
        if c.null_fraction > 0 and not c.unique:
            out = out.withColumn(c.name, F.when(~values.null_at(F.col("ordinal"), c.null_fraction), F.col(c.name)))
    return out


def cells(tables: list[TableShape], scale: float = 1.0, cap: int | None = None) -> int:
    """How many cells the tables would have."""
    return sum(fanout.plan_rows(t.rows, scale, cap) * len(t.columns) for t in tables)


def load_order(tables: list[TableShape]) -> list[TableShape]:
    """Parents before children; tables of a cycle come last, by name, as they can only be
    loaded with their references checked afterwards."""
    left, out = sorted(tables, key=lambda t: t.name), []
    while left:
        waiting = {t.name for t in left}
        free = [t for t in left if not any(c.reference and c.reference.parent.name in waiting - {t.name} for c in t.columns)]
        out += free or left
        left = [t for t in left if free and t not in free]
    return out


def load(spark: SparkSession, tables: list[TableShape], folder: str, seed: int, scale: float = 1.0, cap: int | None = None, max_cells: int | None = None) -> dict[str, int]:
    """Writes the tables as Parquet, parents first, and checks every reference afterwards;
    (table.column -> orphans beyond those wanted)."""
    if max_cells is not None and cells(tables, scale, cap) > max_cells:
        raise BudgetError(f"{cells(tables, scale, cap)} cells are more than {max_cells}")
    for t in tables:
        refuse_unsupported(t)
    where = lambda t: f"{folder}/{t.name.split('.')[-1]}.parquet"
    for t in load_order(tables):
        generate(spark, t, seed, scale, cap).drop("ordinal").write.mode("overwrite").parquet(where(t))
    missed = {}
    for t in tables:
        for c in t.columns:
            if c.reference and c.reference.parent.name in {p.name for p in tables}:
                children = spark.read.parquet(where(t)).where(F.col(c.name).isNotNull())
                parents = spark.read.parquet(where(c.reference.parent)).select(F.col(c.reference.column).alias("__key"))
                lost = children.join(parents, F.col(c.name) == F.col("__key"), "left_anti").count()
                missed[f"{t.name}.{c.name}"] = max(0, lost - int(children.count() * c.reference.orphan_fraction + 0.5))
    return missed


def insert_script(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement for each row, as text."""
    cols = [c for c in df.columns if c != "ordinal"]
    quoted = lambda name: '"' + name.replace('"', '""') + '"'
    kinds = dict(df.dtypes)
    literal = lambda c: F.coalesce(F.col(c).cast("string") if kinds[c] in ("bigint", "int", "double", "boolean", "smallint", "float") else F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
    head = f"INSERT INTO {'.'.join(quoted(p) for p in table.split('.'))} ({', '.join(quoted(c) for c in cols)}) VALUES ("
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *[literal(c) for c in cols]), F.lit(");")).alias("value"))


def conformance(df: DataFrame, table: TableShape, tolerance: float = 0.005) -> DataFrame:
    """(column_name, problem) where made rows miss their facts; empty if they hold."""
    checks = []
    for c in table.columns:
        nulls = F.avg(F.when(F.col(c.name).isNull(), 1.0).otherwise(0.0))
        checks.append(F.when(F.abs(nulls - c.null_fraction) > tolerance, F.struct(F.lit(c.name).alias("column_name"), F.lit("null fraction").alias("problem"))))
        if c.unique:
            checks.append(F.when(F.count(c.name) != F.countDistinct(c.name), F.struct(F.lit(c.name).alias("column_name"), F.lit("not unique").alias("problem"))))
    return df.agg(F.array_compact(F.array(*checks)).alias("x")).select(F.inline("x"))
