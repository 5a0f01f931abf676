"""Shape documents: facts without rows, as YAML with a digest over a canonical form."""

from __future__ import annotations

import hashlib
import json

import yaml

VERSION = "1.0"
BUDGET_BYTES, BUDGET_TABLES = 320 * 1024, 200


class DocumentError(ValueError):
    """A document that cannot be read: an unknown major version, or a digest that differs."""


class VersionError(DocumentError):
    """A document of a major version that is not known."""


def number(x: float) -> str:
    """Six significant digits."""
    return f"{x:.6g}"


def _canonical(value):
    if isinstance(value, dict):
        return {str(k): _canonical(v) for k, v in sorted(value.items(), key=lambda kv: str(kv[0])) if v is not None}
    if isinstance(value, (list, tuple)):
        return [_canonical(v) for v in value]
    if isinstance(value, float):
        return number(value)
    return value


def canonical(document: dict) -> bytes:
    """Sorted keys, floats with six digits, without the digest and the time of writing."""
    body = {k: v for k, v in document.items() if k != "meta"}
    meta = {k: v for k, v in document.get("meta", {}).items() if k not in ("digest", "generated_at")}
    return json.dumps(_canonical(body | {"meta": meta}), ensure_ascii=False, separators=(",", ":")).encode()


def digest(document: dict) -> str:
    return "sha256:" + hashlib.sha256(canonical(document)).hexdigest()


def emit(document: dict) -> str:
    """YAML text with the digest set; extension keys (x_*) stay."""
    document = dict(document)
    document["meta"] = dict(document.get("meta", {})) | {"version": document.get("meta", {}).get("version", VERSION)}
    document["meta"]["digest"] = digest(document)
    return yaml.safe_dump(document, sort_keys=True, allow_unicode=True)


def parse(text: str, verify: bool = True) -> dict:
    """A document; a bare scalar fact reads as estimated."""
    document = yaml.safe_load(text)
    if not isinstance(document, dict):
        raise DocumentError("a shape document is a mapping")
    meta = document.get("meta") or {}
    major = str(meta.get("version", VERSION)).split(".")[0]
    if major != VERSION.split(".")[0]:
        raise VersionError(f"major version {major} is not known")
    if verify and meta.get("digest") and meta["digest"] != digest(document):
        raise DocumentError("the digest differs from the contents")
    for table in (document.get("tables") or {}).values():
        table["rows"] = fact(table.get("rows"))
        for column in (table.get("columns") or {}).values():
            for name in ("null_fraction", "distinct", "unique"):
                if name in column:
                    column[name] = fact(column[name])
    return document


def fact(value):
    return value if value is None or isinstance(value, dict) else {"value": value, "confidence": "estimated"}


def over_budget(text: str, tables: int) -> bool:
    return len(text.encode()) > BUDGET_BYTES * max(1.0, tables / BUDGET_TABLES)


def from_profile(facts_rows, generated_at: str | None = None) -> dict:
    """A document from rows of column facts (profile.column_facts, collected: one row a column)."""
    tables: dict = {}
    for r in facts_rows:
        t = tables.setdefault(r["table_name"], {"rows": {"value": r["row_count"], "confidence": "exact"}, "columns": {}})
        column = {"category": r["category"], "null_fraction": {"value": r["null_fraction"], "confidence": "exact"}}
        if r["min_value"] is not None:
            column["range"] = {"min": r["min_value"], "max": r["max_value"], "mean": r["mean_value"], "confidence": "exact"}
        if r["min_time"] is not None:
            column["range"] = {"min": r["min_time"], "max": r["max_time"], "confidence": "exact"}
        if r["min_length"] is not None:
            column["length"] = {"min": r["min_length"], "max": r["max_length"], "mean": r["mean_length"]}
        t["columns"][r["column_name"]] = column
    meta = {"version": VERSION, "mode": "exact"}
    if generated_at:
        meta["generated_at"] = generated_at
    return {"meta": meta, "tables": tables}
