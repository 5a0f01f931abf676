"""DDL text of table shapes: tables, partitions, indexes, constraints, in order of load."""

from __future__ import annotations

from ..hydrate.engine import TableShape


def ident(name: str) -> str:
    return ".".join('"' + p.replace('"', '""') + '"' for p in name.split("."))


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def create_type(name: str, labels: list[str]) -> str:
    return f"CREATE TYPE {ident(name)} AS ENUM ({', '.join(map(literal, labels))});"


def create_table(table: TableShape, partition_key: str | None = None, strategy: str | None = None) -> str:
    body = ", ".join(f"{ident(c.name)} {c.data_type}" + ("" if c.null_fraction > 0 else " NOT NULL") for c in sorted(table.columns, key=lambda c: c.name))
    tail = f" PARTITION BY {strategy.upper()} ({ident(partition_key)})" if partition_key and strategy else ""
    return f"CREATE TABLE {ident(table.name)} ({body}){tail};"


def partitions(name: str, strategy: str, count: int) -> list[str]:
    """Hash partitions by modulus and remainder; one DEFAULT for any other strategy."""
    schema = name.rpartition(".")
    full = lambda suffix: ident(f"{schema[0]}.{schema[2]}_{suffix}" if schema[0] else f"{schema[2]}_{suffix}")
    if strategy == "hash":
        return [f"CREATE TABLE {full(f'p{i}')} PARTITION OF {ident(name)} FOR VALUES WITH (MODULUS {count}, REMAINDER {i});" for i in range(count)]
    return [f"CREATE TABLE {full('default')} PARTITION OF {ident(name)} DEFAULT;"]


def after_load(table: TableShape) -> list[str]:
    """Keys, checks and references, to be added once the rows are there."""
    out = [f"ALTER TABLE {ident(table.name)} ADD UNIQUE ({ident(c.name)});" for c in table.columns if c.unique]
    for c in table.columns:
        if c.check:
            parts = [f"{ident(c.name)} {op} {v}" for op, v in ((">=", c.check[0]), ("<=", c.check[1])) if v is not None]
            out.append(f"ALTER TABLE {ident(table.name)} ADD CHECK ({' AND '.join(parts)});")
    out += [f"ALTER TABLE {ident(table.name)} ADD FOREIGN KEY ({ident(c.name)}) REFERENCES {ident(c.reference.parent.name)} NOT VALID;" for c in table.columns if c.reference]
    return out


def script(tables: list[TableShape]) -> list[str]:
    types = sorted({(c.data_type, tuple(c.labels)) for t in tables for c in t.columns if c.labels})
    ordered = sorted(tables, key=lambda t: t.name)
    return [create_type(n, list(x)) for n, x in types] + [create_table(t) for t in ordered] + [s for t in ordered for s in after_load(t)]
