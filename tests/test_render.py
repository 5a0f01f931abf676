"""Rendering, DDL, CHECK domains and the commands."""

import json

import pytest

from shapelab import cli
from shapelab.hydrate import checks
from shapelab.hydrate.engine import ColumnShape, Reference, TableShape
from shapelab.plans import ddl, render
from shapelab.sources import documents

FOUND = {"code": "RS-X-001", "severity": "error", "idx": 0, "file": "m,1.sql", "line": 7, "table_name": "a|b", "message": "100%\nbad", "bucket": "slow"}


def test_results_render():
    res = render.result({"verdict": "FAIL", "exit_code": 2}, [FOUND], "sha256:ab")
    assert render.as_text(res).splitlines()[0].startswith("FAIL")
    assert render.annotations(res, "db/") == ["::error file=db/m%2C1.sql,line=7,title=RS-X-001::100%25%0Abad"]
    rests = FOUND | {"depends_on": ["a.b.unique"], "confidence": 1, "resolve": "a.b"}
    said = render.as_text(render.result({"verdict": "FAIL", "exit_code": 2}, [rests])).splitlines()
    assert [x.strip() for x in said[-3:]] == ["duration: slow", "rests on: a.b.unique [estimated]", "resolve: profile the source again with exact counts to raise a.b"]
    assert "a\\|b" in render.summary(res) and json.loads(render.as_json(res))["exit_code"] == 2
    assert render.as_statement(res, "shape.yaml")["subject"][0]["digest"] == {"sha256": "ab"}
    with pytest.raises(ValueError):
        render.result({"verdict": "FINE", "exit_code": 0}, [])
    assert [render.human_count(n) for n in (7, 1500, 2_500_000, 3 * 10**9)] == ["7", "1.5K", "2.5M", "3.0B"]


def test_ddl():
    t = TableShape("public.a", 5, [ColumnShape("id", "bigint", unique=True), ColumnShape("s", "state", 0.5, labels=["it's"]), ColumnShape("n", "int", check=(1, 9)), ColumnShape("p", "bigint", reference=Reference(TableShape("public.b", 1), "id"))])
    text = ddl.script([t])
    assert text[0] == "CREATE TYPE \"state\" AS ENUM ('it''s');"
    assert text[1].startswith('CREATE TABLE "public"."a" ("id" bigint NOT NULL, "n" int NOT NULL, "p" bigint NOT NULL, "s" state);')
    assert text[2:] == ['ALTER TABLE "public"."a" ADD UNIQUE ("id");', 'ALTER TABLE "public"."a" ADD CHECK ("n" >= 1 AND "n" <= 9);', 'ALTER TABLE "public"."a" ADD FOREIGN KEY ("p") REFERENCES "public"."b" NOT VALID;']
    assert len(ddl.partitions("public.a", "hash", 4)) == 4 and ddl.partitions("a", "range", 9) == ['CREATE TABLE "a_default" PARTITION OF "a" DEFAULT;']


@pytest.mark.parametrize(
    "text, want",
    [
        ("CHECK (((n > 5) AND (n <= 9)))", {"n": (6, 9, None)}),
        ("(n)::integer >= -3", {"n": (-3, None, None)}),
        ("s = ANY (ARRAY['a'::text, 'b''c'::character varying])", {"s": (None, None, ["a", "b'c"])}),
        ("n > 1 OR n < 0", {}),
        ("n = 3", {}),
        ("length(s) > 3", {}),
        ("opaque", {}),
    ],
)
def test_check_domains(text, want):
    got = checks.domains([(text, True)])
    assert {c: (d.low, d.high, d.values) for c, d in got.items()} == want
    assert checks.domains([(text, False)]) == {}


def test_commands(spark, tmp_path, capsys):
    spark.range(10).selectExpr("id", "cast(id as string) AS s").write.parquet(str(tmp_path / "t.parquet"))
    assert cli.main(["profile", str(tmp_path)]) == 0
    text = capsys.readouterr().out
    shape, script = tmp_path / "shape.yaml", tmp_path / "m.sql"
    shape.write_text(text)
    assert documents.parse(text)["tables"]["t"]["rows"] == {"value": 10, "confidence": "exact"}
    script.write_text("SET lock_timeout = '1s'; ALTER TABLE t ALTER s SET NOT NULL;")
    assert cli.main(["validate", str(shape), str(script)]) == 0
    script.write_text("SELECT 1;\n\nDROP TABLE t;")
    assert cli.main(["validate", "--json", str(shape), str(script)]) == 1
    capsys.readouterr()
    assert cli.main(["annotate", str(shape), str(script)]) == 1 and f"::warning file={script},line=3," in capsys.readouterr().out
    assert cli.main(["plan", str(shape), str(script)]) == 0 and cli.main(["inspect", str(shape)]) == 0
    assert cli.main(["verify", str(shape), str(tmp_path)]) == 0
    made = tmp_path / "made"
    assert cli.main(["hydrate", str(shape), str(made), "--scale", "2"]) == 0 and spark.read.parquet(f"{made}/t.parquet").count() == 20
    assert cli.main(["hydrate", str(shape), str(made), "--max-cells", "3"]) == 3
    spark.range(3).selectExpr("cast(id as int) AS id").write.parquet(str(tmp_path / "other" / "t.parquet"))
    assert cli.main(["verify", str(shape), str(tmp_path / "other")]) == 1
    capsys.readouterr()
    assert cli.main(["describe", str(shape)]) == 0 and json.loads(capsys.readouterr().out)["tables"] == [{"table": "t", "rows": {"value": 10, "confidence": "exact"}, "columns": 2}]
    assert cli.main(["describe", str(shape), "--table", "t"]) == 0
    assert [(c["name"], c["type"], c["has_range"]) for c in json.loads(capsys.readouterr().out)["columns"]] == [("id", "bigint", True), ("s", "string", False)]
    assert cli.main(["describe", str(shape), "--table", "none"]) == 3 and json.loads(capsys.readouterr().err)["category"] == "bad_usage"
    old = tmp_path / "old.yaml"
    old.write_text("meta: {version: '9.0'}\ntables: {}\n")
    assert cli.main(["describe", str(old)]) == 3 and json.loads(capsys.readouterr().err)["category"] == "unknown_version"
    assert cli.main(["explain", "RS-LOCK-001"]) == 0 and cli.main(["explain", "none"]) == 3 and cli.main(["validate", "missing.yaml", str(script)]) == 3
