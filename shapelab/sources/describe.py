"""A shape document for readers: which tables there are, and one table's shape without any
detail that derives from values."""

from __future__ import annotations

INDEX_TABLES = 200


def index(document: dict, most: int = INDEX_TABLES) -> dict:
    """Tables with rows and number of columns; a list that is cut says so."""
    tables = document.get("tables") or {}
    names = sorted(tables)
    out = {"tables": [{"table": n, "rows": tables[n].get("rows"), "columns": len(tables[n].get("columns") or {})} for n in names[:most]]}
    if len(names) > most:
        out["truncated"] = {"shown": most, "total": len(names), "note": "a table that is not listed may still be described by its name"}
    return out


def table(document: dict, name: str) -> dict | None:
    """One table: facts as they are, ranges and histograms only as being there."""
    body = (document.get("tables") or {}).get(name)
    if body is None:
        return None
    facts = ("type", "category", "nullable", "format", "null_fraction", "distinct", "unique")
    columns = [{"name": c} | {f: x[f] for f in facts if f in x} | {"has_range": "range" in x, "has_histogram": "histogram" in x} for c, x in sorted((body.get("columns") or {}).items())]
    return {"table": name, "rows": body.get("rows"), "columns": columns, "references": body.get("references") or [], "constraints": [f"{c['kind']} {c['name']}" for c in body.get("constraints") or []]}
