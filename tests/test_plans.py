"""Statements, rules and verdicts on scripts written for them."""

import pytest

from shapelab.plans import rules, verdict
from shapelab.plans.facts import Facts
from shapelab.plans.statements import actions, parse, split, volatility
from shapelab.sources import documents


@pytest.mark.parametrize(
    "text, want",
    [
        ("a; b;; c", ["a", "b", "c"]),
        ("SELECT ';' ; x", ["SELECT ';'", "x"]),
        ("SELECT 'it''s;' ; x", ["SELECT 'it''s;'", "x"]),
        (r"SELECT E'\';' ; x", [r"SELECT E'\';'", "x"]),
        ("DO $a$ b; $$ c; $a$; x", ["DO $a$ b; $$ c; $a$", "x"]),
        ("-- a;\nb /* ; /* ; */ ; */ ; c", ["b", "c"]),
        ('ALTER TABLE "a;b" x; y', ['ALTER TABLE "a;b" x', "y"]),
        ("", []),
        ("'open; end", ["'open; end"]),
        ("/* open", []),
    ],
)
def test_split(text, want):
    assert [s for _, s, _ in split(text)] == want


def test_lines():
    assert [n for n, _, _ in split("\n a;\n\n-- c\nb;\nc")] == [2, 5, 6]


@pytest.mark.parametrize(
    "sql, kind, field, value",
    [
        ("alter table a add column b int default 1", "add_column", "detail", "literal"),
        ("alter table a add b timestamptz default now() not null", "add_column", "detail", "stable"),
        ("alter table a add b uuid default gen_random_uuid()", "add_column", "detail", "volatile"),
        ("alter table a add b int default mine()", "add_column", "detail", "unknown"),
        ("alter table a add b int generated always as (c + 1) stored", "add_column", "detail", "stored"),
        ("ALTER TABLE ONLY s.t ALTER x TYPE varchar(10) USING x::text", "type_change", "new_type", "varchar(10)"),
        ('ALTER TABLE "S"."T" ALTER "X" SET NOT NULL', "set_not_null", "table_name", "S.T"),
        ("create unique index concurrently i on t (a, lower(b))", "create_unique_index", "detail", "undecidable"),
        ("create index on t (a) where b is null", "create_index", "detail", "undecidable"),
        ("alter table t add constraint c check (x >= -2.5) not valid", "add_check", "number", -2.5),
        ("delete from t where id = 3", "delete", "where_kind", "equality"),
        ("update t set a = (select 1 from u where x = 1)", "update", "where_kind", "none"),
        ("update t set a = 1 where id > 5 and id <= 105", "update", "number", 100.0),
        ("update t set a = 1 where id = 1 or b", "update", "where_kind", "other"),
        ("reindex table concurrently t", "reindex", "concurrently", True),
    ],
)
def test_actions(sql, kind, field, value):
    (found,) = actions(split(sql)[0][2])
    assert found["kind"] == kind and found[field] == value


def test_several_actions_and_files():
    rows = parse([("2.sql", "TRUNCATE a, b"), ("1.sql", "ALTER TABLE t ADD x int, DROP COLUMN y")])
    assert [(r[0], r[1], r[2], r[5]) for r in rows] == [(0, 0, "1.sql", "add_column"), (0, 1, "1.sql", "drop_column"), (1, 0, "2.sql", "truncate"), (1, 1, "2.sql", "truncate")]


def test_volatility_of_words():
    assert volatility([("word", "current_date")]) == "stable"


USERS = {"table_name": "public.users", "row_count": 400_000, "rows_conf": "exact"}


def judge(spark, sql, major=16, columns=(), refs=(), indexes=(), tables=(USERS,)):
    from shapelab.plans.statements import statements

    facts = Facts.of(spark, tables, columns, refs, indexes)
    rows = verdict.capped(rules.findings(statements(spark, [("a.sql", sql)]), facts, major), verdict.fact_ranks(facts)).cache()
    return verdict.combined(rows).first().verdict, sorted((r.code, r.severity) for r in rows.collect())


def email(**facts):
    return {"table_name": "public.users", "column_name": "email", "data_type": "text"} | facts


QUIET = "SET lock_timeout = '5s'; "


@pytest.mark.parametrize(
    "sql, columns, want",
    [
        ("ALTER TABLE users ALTER email SET NOT NULL", [email(null_fraction=0.0, nulls_conf="exact")], ("PASS", [])),
        ("ALTER TABLE users ALTER email SET NOT NULL", [email(null_fraction=0.0, nulls_conf="estimated")], ("WARN", [("RS-DATA-001", "warn")])),
        ("ALTER TABLE users ALTER email SET NOT NULL", [email(null_fraction=0.03, nulls_conf="exact")], ("FAIL", [("RS-DATA-001", "error")])),
        ("CREATE UNIQUE INDEX CONCURRENTLY i ON users (email)", [email(is_unique=False, unique_conf="exact")], ("FAIL", [("RS-INDEX-010", "error"), ("RS-TX-001", "warn")])),
        ("ALTER TABLE users ADD CONSTRAINT u UNIQUE (email)", [email(is_unique=True, unique_conf="exact")], ("WARN", [("RS-INDEX-002", "warn")])),
        ("ALTER TABLE users ADD c int DEFAULT 1", [], ("PASS", [])),
        ("ALTER TABLE users ALTER email TYPE varchar", [email()], ("PASS", [])),
        ("UPDATE users SET a = 1 WHERE email = 'x'", [email(is_unique=True, unique_conf="exact")], ("PASS", [])),
        ("UPDATE users SET a = 1 WHERE id BETWEEN 1 AND 500", [], ("PASS", [])),
        ("UPDATE other SET a = 1 WHERE b", [], ("WARN", [("RS-PERF-010", "warn")])),
    ],
)
def test_verdicts(spark, sql, columns, want):
    assert judge(spark, QUIET + sql, columns=columns) == want


def test_default_rewrites_before_major_11(spark):
    assert judge(spark, QUIET + "ALTER TABLE users ADD c int DEFAULT 1", major=10)[1] == [("RS-LOCK-001", "warn")]


def test_validation_in_another_transaction_is_fine(spark):
    sql = QUIET + "BEGIN; ALTER TABLE users ADD CONSTRAINT c CHECK (n > 0) NOT VALID; COMMIT; ALTER TABLE users VALIDATE CONSTRAINT C;"
    assert judge(spark, sql) == ("PASS", [])
    one = QUIET + "ALTER TABLE users ADD CONSTRAINT c CHECK (n > 0) NOT VALID; ALTER TABLE users VALIDATE CONSTRAINT c;"
    assert judge(spark, one)[1] == [("RS-CONSTRAINT-001", "warn")]


def test_documents_keep_their_digest_and_refuse_others():
    doc = {"meta": {"version": "1.0"}, "tables": {"a": {"rows": 5, "columns": {"x": {"null_fraction": 0.25}}}}, "x_more": 1}
    text = documents.emit(doc)
    back = documents.parse(text)
    assert back["tables"]["a"]["rows"] == {"value": 5, "confidence": "estimated"} and back["x_more"] == 1
    with pytest.raises(documents.DocumentError):
        documents.parse(text.replace("0.25", "0.5"))
    with pytest.raises(documents.DocumentError):
        documents.parse(documents.emit({"meta": {"version": "2.0"}}))
    assert documents.digest(doc) == documents.digest({"x_more": 1, "tables": doc["tables"], "meta": {"version": "1.0", "generated_at": "now"}})
