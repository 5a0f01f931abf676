"""Commands: profile, inspect, describe, hydrate, verify, validate, plan, explain, annotate.

    python -m shapelab.cli profile FOLDER > shape.yaml
    python -m shapelab.cli describe shape.yaml [--table TABLE]
    python -m shapelab.cli hydrate shape.yaml FOLDER --seed 42 --scale 0.01
    python -m shapelab.cli verify shape.yaml FOLDER
    python -m shapelab.cli validate shape.yaml migration.sql

Exit codes: 0 PASS, 1 WARN (verify: drift; hydrate: references that do not resolve), 2 FAIL,
3 a tool error, told as JSON with its class."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .hydrate import engine
from .operators import profile
from .plans import diff, render, rules, statements, verdict
from .plans.facts import Facts, again, local
from .session import local_session
from .sources import catalog, describe, documents
from .sources.guards import ToolError

TOOL_ERROR = 3


def facts_of(spark, document: dict) -> Facts:
    """Facts of a shape document as DataFrames."""
    conf = lambda f: (f or {}).get("confidence")
    value = lambda f: (f or {}).get("value")
    tables, columns, refs = [], [], []
    for t, body in (document.get("tables") or {}).items():
        tables.append({"table_name": t, "row_count": value(body.get("rows")), "rows_conf": conf(body.get("rows"))})
        for c, x in (body.get("columns") or {}).items():
            r = x.get("range") or {}
            number = lambda v: float(v) if isinstance(v, (int, float)) else None
            columns.append({"table_name": t, "column_name": c, "data_type": x.get("type"), "null_fraction": number(value(x.get("null_fraction"))), "nulls_conf": conf(x.get("null_fraction")), "is_unique": value(x.get("unique")), "unique_conf": conf(x.get("unique")), "min_value": number(r.get("min")), "max_value": number(r.get("max")), "range_conf": r.get("confidence")})
        for ref in body.get("references") or []:
            fan = ref.get("fanout") or {}
            refs.append({"table_name": t, "column_name": ref.get("column"), "parent_table": ref.get("parent"), "on_delete": ref.get("on_delete"), "fan_mean": fan.get("mean"), "fan_max": fan.get("max"), "orphan_fraction": value(ref.get("orphan_fraction")), "orphan_conf": conf(ref.get("orphan_fraction"))})
    return Facts.of(spark, tables, columns, refs)


def scripts(path: str) -> list[tuple[str, str]]:
    names = [os.path.join(path, n) for n in sorted(os.listdir(path)) if n.endswith(".sql")] if os.path.isdir(path) else [path]
    return [(os.path.basename(n), open(n, encoding="utf-8").read()) for n in names]


def validate(spark, document: dict, files, major: int = 16) -> dict:
    facts = facts_of(spark, document)
    rows = verdict.capped(rules.findings(statements.statements(spark, files), facts, major), verdict.fact_ranks(facts))
    rows = again(verdict.resolvable(rows, facts.tables).drop("weakest"))
    return render.result(verdict.combined(rows).first().asDict(), [r.asDict() for r in rows.collect()], documents.digest(document))


def live(spark, folder: str):
    """The tables of a folder, and their columns."""
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in catalog.list_tables(spark, folder)}
    return tables, catalog.columns(spark, tables)


def verify(spark, document: dict, folder: str) -> list[dict]:
    """How the tables of a folder differ from a shape document."""
    wanted = [(t, c, x["type"], x.get("nullable", True)) for t, b in document["tables"].items() for c, x in (b.get("columns") or {}).items() if x.get("type")]
    expected = local(spark, wanted, "table_name string, column_name string, data_type string, nullable boolean")
    there = live(spark, folder)[1].select("table_name", "column_name", "data_type", "nullable")
    return [r.asDict() for r in diff.drift(expected, there).orderBy("object", "problem").collect()]  # columns of a schema


def _class_of(error: Exception) -> str:
    return error.category if isinstance(error, ToolError) else "unknown_version" if isinstance(error, documents.VersionError) else "fixture_parse" if isinstance(error, documents.DocumentError) else "bad_usage"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="shapelab")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"profile": ["folder"], "inspect": ["document"], "describe": ["document"], "hydrate": ["document", "folder"], "verify": ["document", "folder"], "validate": ["document", "script"], "plan": ["document", "script"], "explain": ["code"], "annotate": ["document", "script"]}.items():
        one = sub.add_parser(name)
        for a in args:
            one.add_argument(a)
        one.add_argument("--json", action="store_true")
        one.add_argument("--major", type=int, default=16)
        if name == "describe":
            one.add_argument("--table")
        if name == "hydrate":
            one.add_argument("--seed", type=int, default=42)
            one.add_argument("--scale", type=float, default=1.0)
            one.add_argument("--max-cells", type=int)
    a = p.parse_args(argv)
    try:
        if a.command == "explain":
            f = rules.RULES.get(a.code)
            if f is None:
                raise ToolError("bad_usage", f"no rule {a.code}; there are {', '.join(sorted(rules.RULES))}")
            print(f"{a.code}: {f.__name__.replace('_', ' ')}")
            return 0
        if a.command == "inspect":
            text = open(a.document, encoding="utf-8").read()
            doc = documents.parse(text)
            shows = sorted((f"{t}.{c}", k) for t, b in doc["tables"].items() for c, x in b.get("columns", {}).items() for k in ("range", "histogram", "values", "frequencies") if k in x)
            print(json.dumps({"bytes": len(text.encode()), "over_budget": documents.over_budget(text, len(doc["tables"])), "leaks": shows}))
            return 0
        if a.command == "describe":
            doc = documents.parse(open(a.document, encoding="utf-8").read())
            said = describe.table(doc, a.table) if a.table else describe.index(doc)
            if said is None:
                raise ToolError("bad_usage", f"no table {a.table}")
            print(json.dumps(said, sort_keys=True, default=str))
            return 0
        spark = local_session()
        if a.command == "profile":
            tables, columns = live(spark, a.folder)
            facts = [r.asDict() for t, df in tables.items() for r in profile.column_facts(df, t).collect()]  # one row a column
            doc = documents.from_profile(facts)
            for r in columns.collect():  # columns of a schema
                doc["tables"][r.table_name]["columns"][r.column_name] |= {"type": r.data_type, "nullable": r.nullable}
            print(documents.emit(doc))
            return 0
        doc = documents.parse(open(a.document, encoding="utf-8").read())
        if a.command == "hydrate":
            missed = engine.load(spark, engine.tables_of(doc), a.folder, a.seed, a.scale, max_cells=a.max_cells)
            print(json.dumps({"tables": sorted(doc["tables"]), "orphans": missed}))
            return 1 if any(missed.values()) else 0
        if a.command == "verify":
            found = verify(spark, doc, a.folder)
            print(json.dumps(found))
            return 1 if found else 0
        files = scripts(a.script)
        if a.command == "plan":
            print(json.dumps([dict(zip(statements._NAMES, r)) for r in statements.parse(files)], default=str))
            return 0
        res = validate(spark, doc, files, a.major)
        print("\n".join(render.annotations(res, os.path.join(a.script, "") if os.path.isdir(a.script) else os.path.join(os.path.dirname(a.script), ""))) if a.command == "annotate" else render.as_json(res) if a.json else render.as_text(res))
        return res["exit_code"]
    except (FileNotFoundError, PermissionError, IsADirectoryError, NotADirectoryError, documents.DocumentError, ToolError, engine.UnsupportedTypeError, engine.BudgetError) as error:
        print(ToolError(_class_of(error), str(error)).payload(), file=sys.stderr)
        return TOOL_ERROR


if __name__ == "__main__":
    sys.exit(main())
