"""Registered queries over scripts, findings, verdicts, differences and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import registry_rules
from .functions.numbers import round6
from .hydrate import checks, engine, fanout
from .operators import privacy, profile, references
from .plans import apply, diff, rules, statements, verdict
from .plans.facts import COLUMNS, INDEXES, REFS, TABLES, Facts, local
from .registry import PAIRS, R6, register, union_all
from .session import table
from .sources import catalog
from .sources.scripts import redact_url, scrub

#: One script that sets off every rule, two files for the transaction rules.
_FILES = {
    "001_change.sql": [
        "ALTER TABLE users ALTER COLUMN email SET NOT NULL, ADD COLUMN token uuid DEFAULT gen_random_uuid()",
        "ALTER TABLE users ADD CONSTRAINT u UNIQUE (email)",
        "CREATE UNIQUE INDEX ON users (lower(email))",
        "CREATE UNIQUE INDEX users_email ON public.users (email)",
        "BEGIN",
        "CREATE INDEX CONCURRENTLY i ON orders (user_id)",
        "COMMIT",
        "ALTER TABLE orders ADD CONSTRAINT fk FOREIGN KEY (user_id) REFERENCES users (id) NOT VALID",
        "ALTER TABLE orders VALIDATE CONSTRAINT fk",
        "ALTER TABLE orders ADD CONSTRAINT c CHECK (amount > 0)",
        "UPDATE orders SET note = 'x; -- y' WHERE amount > 3",
        "UPDATE orders SET note = '' WHERE id BETWEEN 1 AND 1000",
        "DELETE FROM users",
        "/* all /* of */ them */\nALTER TABLE orders ALTER COLUMN amount TYPE integer",
        "REINDEX TABLE orders",
        "DROP INDEX orders_i",
        "TRUNCATE public.orders",
        "DROP TABLE logs",
        "ALTER TABLE users RENAME COLUMN a TO b",
        "ALTER TABLE users REPLICA IDENTITY FULL",
        "ALTER TABLE users ALTER email DROP NOT NULL",
        "ALTER TABLE users DROP COLUMN email",
        "ALTER TABLE parts ATTACH PARTITION parts_1 FOR VALUES IN (1)",
        "VACUUM",
    ],
    "002_more.sql": ["ALTER TABLE orders VALIDATE CONSTRAINT fk"],
}
SCRIPT = [(file, ";\n".join(found)) for file, found in _FILES.items()]
_TABLES = [{"table_name": "public.users", "row_count": 5_000_000, "rows_conf": "exact"}, {"table_name": "public.orders", "row_count": 10_000_000, "rows_conf": "estimated"}]
_COLUMNS = [
    {"table_name": "public.users", "column_name": "email", "data_type": "text", "null_fraction": 0.02, "nulls_conf": "exact", "is_unique": False, "unique_conf": "exact"},
    {"table_name": "public.orders", "column_name": "amount", "data_type": "bigint", "min_value": -4.0, "max_value": 9000.0, "range_conf": "exact"},
]
_REFS = [{"table_name": "public.orders", "column_name": "user_id", "parent_table": "public.users", "parent_column": "id", "on_delete": "cascade", "fan_mean": 8.0, "fan_max": 12_000.0, "orphan_fraction": 0.01, "orphan_conf": "exact"}]
_INDEXES = [{"table_name": "public.orders", "index_name": "orders_i", "bytes": 4_200_000_000, "bloat": 0.45}]


def facts(spark) -> Facts:
    return Facts.of(spark, _TABLES, _COLUMNS, _REFS, _INDEXES)


def script(spark):
    st = statements.statements(spark, SCRIPT)
    return st.withColumn("err_code", F.when(F.col("kind") == "drop_table", "42P01"))


def _values(rows: list[tuple], names: str) -> str:
    quote = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(quote(v) for v in r) + ')' for r in rows)}) v({names})"


_ALL = [(file, sql.split("*/\n")[-1]) for file, found in _FILES.items() for sql in found]
_FACTS = (
    _values([(i, f, q) for i, (f, q) in enumerate(_ALL)], "idx, file, sql"),
    *(_values([tuple(r.get(n.split()[0]) for n in schema.split(", ")) for r in rows], ", ".join(n.split()[0] for n in schema.split(", "))) for rows, schema in ((_TABLES, TABLES), (_COLUMNS, COLUMNS), (_REFS, REFS), (_INDEXES, INDEXES))),
)
_CTES = registry_rules.base(*_FACTS)

# What each statement of the script is, by its text.
_KINDS = {
    "SET NOT NULL": "set_not_null", "ADD COLUMN": "add_column", "ADD CONSTRAINT \\w+ UNIQUE": "add_unique", "^CREATE UNIQUE INDEX": "create_unique_index", "^BEGIN": "begin", "^CREATE INDEX": "create_index", "^COMMIT": "end", "ADD CONSTRAINT \\w+ FOREIGN KEY": "add_fk",
    "VALIDATE CONSTRAINT": "validate", "ADD CONSTRAINT \\w+ CHECK": "add_check", "^UPDATE": "update", "^DELETE": "delete", " TYPE ": "type_change", "^REINDEX": "reindex", "^DROP INDEX": "drop_index", "^TRUNCATE": "truncate", "^DROP TABLE": "drop_table",
    "RENAME COLUMN": "rename_column", "REPLICA IDENTITY": "replica_identity", "DROP NOT NULL": "drop_not_null", "DROP COLUMN": "drop_column", "ATTACH PARTITION": "attach_partition", "^VACUUM": "non_transactional",
}


@register(
    "statements_parsed",
    f"""WITH {_CTES}, k(pattern, kind) AS (VALUES {', '.join(f"('(?i){p}', '{k}')" for p, k in _KINDS.items())}),
a AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY strpos(sql, regexp_extract(sql, pattern))) - 1 AS action FROM p JOIN k ON regexp_matches(sql, pattern))
SELECT idx, CAST(action AS INTEGER) AS action, file, CAST(1 + idx - min(idx) OVER (PARTITION BY file) + CASE WHEN idx >= 13 AND file LIKE '001%' THEN 1 ELSE 0 END AS INTEGER) AS line, kind, raw AS table_name,
  CASE kind WHEN 'set_not_null' THEN regexp_extract(sql, '(?i)COLUMN (\\w+) SET', 1) WHEN 'add_column' THEN regexp_extract(sql, '(?i)ADD COLUMN (\\w+)', 1) WHEN 'add_fk' THEN regexp_extract(sql, '(?i)KEY \\((\\w+)', 1) WHEN 'add_check' THEN regexp_extract(sql, '(?i)CHECK \\((\\w+)', 1)
    WHEN 'type_change' THEN regexp_extract(sql, '(?i)COLUMN (\\w+)', 1) WHEN 'rename_column' THEN regexp_extract(sql, '(?i)COLUMN (\\w+)', 1) WHEN 'drop_column' THEN regexp_extract(sql, '(?i)COLUMN (\\w+)', 1) WHEN 'drop_not_null' THEN regexp_extract(sql, '(?i)ALTER (\\w+) DROP', 1)
    WHEN 'update' THEN nullif(regexp_extract(sql, '(?i)WHERE (\\w+) BETWEEN', 1), '') END AS column_name,
  CASE WHEN kind IN ('update', 'delete') THEN CASE WHEN sql NOT LIKE '%WHERE%' THEN 'none' WHEN sql LIKE '%BETWEEN%' THEN 'range' ELSE 'other' END END AS where_kind FROM a""",
)
def parsed(spark, d):
    return script(spark).select("idx", "action", "file", "line", "kind", "table_name", "column_name", "where_kind")


for _code in sorted(rules.RULES):
    register("rule_" + _code.lower().replace("-", "_"), registry_rules.rule(_code, _CTES))(lambda spark, d, c=_code: rules.findings(script(spark), facts(spark), codes=[c]).select("code", "severity", "idx", "table_name", "column_name", "message", "bucket"))


@register("findings_all", registry_rules.every(_CTES))
def findings_all(spark, d):
    return verdict.capped(rules.findings(script(spark), facts(spark)), verdict.fact_ranks(facts(spark))).select("code", "severity", "idx", "table_name", "column_name", "confidence", "verdict")


_SIMPLE = {"drop_column": "%DROP COLUMN%", "rename_column": "%RENAME COLUMN%", "attach_partition": "%ATTACH PARTITION%", "set_not_null": "%SET NOT NULL%", "drop_not_null": "%DROP NOT NULL%", "replica_identity": "%REPLICA IDENTITY%", "truncate": "TRUNCATE%", "drop_table": "DROP TABLE%"}
_PLAIN = [(i, s) for i, s in enumerate(["ALTER TABLE a DROP COLUMN b", "ALTER TABLE a RENAME COLUMN b TO c", "ALTER TABLE a ATTACH PARTITION p DEFAULT", "ALTER TABLE a ALTER b SET NOT NULL", "ALTER TABLE a ALTER b DROP NOT NULL", "ALTER TABLE a REPLICA IDENTITY FULL", "TRUNCATE a", "DROP TABLE a"])]


@register("statements_kinds", f"SELECT CAST(i AS INTEGER) AS idx, CASE {' '.join(f"WHEN s LIKE '{p}' THEN '{k}'" for k, p in _SIMPLE.items())} END AS kind FROM {_values(_PLAIN, 'i, s')}")
def kinds(spark, d):
    return statements.statements(spark, [("a.sql", ";\n".join(s for _, s in _PLAIN))]).select("idx", "kind")


# --- verdict ---------------------------------------------------------------------

_FOUND = [("A", "error", 0, 3), ("B", "warn", 1, 3), ("C", "info", 2, 3), ("C", "info", 3, 1), ("D", "odd", 4, 2), ("E", "info", 5, -1)]


def _found(spark):
    rows = [(c, s, i, f"t{i}", "c", "m", [f"t{i}.c.unique"]) for i, (c, s, _, _) in enumerate(_FOUND)]
    f = spark.createDataFrame(rows, "code string, severity string, idx int, table_name string, column_name string, message string, depends_on array<string>")
    ranks = spark.createDataFrame([(f"t{i}.c.unique", r) for i, (_, _, _, r) in enumerate(_FOUND) if r >= 0], "path string, rank int")
    return f, ranks


_CAP = f"SELECT code, severity, CAST(i AS INTEGER) AS idx, CAST(conf AS INTEGER) AS confidence, CASE severity WHEN 'error' THEN 2 WHEN 'warn' THEN 1 WHEN 'info' THEN 0 ELSE 1 END AS want FROM {_values(_FOUND, 'code, severity, i, conf')}"
_CAPPED = f"SELECT code, idx, confidence, CASE WHEN want = 0 AND confidence < 2 THEN 1 ELSE want END AS verdict, CASE WHEN severity = 'info' AND confidence < 2 THEN 'warn' ELSE severity END AS severity FROM ({_CAP})"


@register("verdict_cap", f"SELECT * FROM ({_CAPPED}) WHERE NOT (severity = 'info' AND verdict = 0)")
def cap(spark, d):
    f, ranks = _found(spark)
    return verdict.capped(f, ranks).select("code", "idx", "confidence", "verdict", "severity")


@register("verdict_combine", f"SELECT CASE max(verdict) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS verdict, max(verdict) AS exit_code, count(*) AS findings FROM ({_CAPPED}) WHERE NOT (severity = 'info' AND verdict = 0)")
def combine(spark, d):
    f, ranks = _found(spark)
    return verdict.combined(verdict.capped(f, ranks))


_DEPS = [("f1", "a", 3), ("f1", "b", 1), ("f2", "a", 2), ("f3", "c", None)]


@register("verdict_dependency_min", f"SELECT f AS code, CAST(min(coalesce(r, -1)) AS INTEGER) AS confidence FROM {_values(_DEPS, 'f, p, r')} GROUP BY f")
def dependency_min(spark, d):
    on = {f: [p for g, p, _ in _DEPS if g == f] for f, _, _ in _DEPS}
    found = local(spark, [(f, "warn", i, f, "c", "m", [f + "." + p for p in paths]) for i, (f, paths) in enumerate(on.items())], "code string, severity string, idx int, table_name string, column_name string, message string, depends_on array<string>")
    ranks = local(spark, [(f + "." + p, r) for f, p, r in _DEPS if r is not None], "path string, rank int")
    return verdict.capped(found, ranks).select("code", "confidence")


# --- differences, governance --------------------------------------------------------

_WANT = [("u", "id", "bigint", False), ("u", "email", "varchar(20)", False), ("u", "age", "int4", True), ("gone", "x", "text", True)]
_LIVE = [("u", "id", "int8", False), ("u", "email", "character varying(20)", True), ("u", "age", "bigint", True), ("u", "more", "text", True), ("extra", "y", "text", True)]
_SCHEMA = "table_name string, column_name string, data_type string, nullable boolean"
_NORMAL = "replace(replace(replace(data_type, 'int8', 'bigint'), 'int4', 'integer'), 'varchar', 'character varying')"


@register(
    "diff_drift",
    f"""WITH e AS (SELECT table_name, column_name, CASE WHEN data_type LIKE 'char%' THEN data_type ELSE {_NORMAL} END AS t, nullable FROM {_values(_WANT, 'table_name, column_name, data_type, nullable')}),
l AS (SELECT table_name, column_name, CASE WHEN data_type LIKE 'char%' THEN data_type ELSE {_NORMAL} END AS t, nullable FROM {_values(_LIVE, 'table_name, column_name, data_type, nullable')}),
j AS (SELECT coalesce(e.table_name, l.table_name) || '.' || coalesce(e.column_name, l.column_name) AS object, e.t AS want, l.t AS got, e.nullable AS en, l.nullable AS ln FROM (SELECT * FROM e WHERE table_name IN (SELECT table_name FROM l)) e FULL JOIN (SELECT * FROM l WHERE table_name IN (SELECT table_name FROM e)) l ON e.table_name = l.table_name AND e.column_name = l.column_name)
SELECT DISTINCT table_name AS object, 'missing table' AS problem, NULL AS want, NULL AS got FROM e WHERE table_name NOT IN (SELECT table_name FROM l)
UNION ALL SELECT object, 'missing column', want, got FROM j WHERE got IS NULL UNION ALL SELECT object, 'extra column', want, got FROM j WHERE want IS NULL
UNION ALL SELECT object, 'type', want, got FROM j WHERE want <> got UNION ALL SELECT object, 'nullable', want, got FROM j WHERE NOT en AND ln""",
)
def drift(spark, d):
    return diff.drift(spark.createDataFrame(_WANT, _SCHEMA), spark.createDataFrame(_LIVE, _SCHEMA))


_ITEMS = [(0, "add_column", "u", "email"), (1, "add_column", "u", "fresh"), (2, "add_column", "no", "x"), (3, "set_not_null", "no", "x"), (4, "drop_table", "no", None), (5, "drop_table", "u", None), (6, "create_index", "u", None), (7, "other", "no", None)]


@register("diff_plan", f"""WITH s AS (SELECT * FROM {_values(_ITEMS, 'idx, kind, table_name, column_name')}), l AS (SELECT * FROM {_values(_LIVE, 'table_name, column_name, data_type, nullable')})
SELECT CAST(idx AS INTEGER) AS idx, kind, table_name, column_name, CASE WHEN kind = 'add_column' THEN CASE WHEN NOT t THEN 'missing-target' WHEN c THEN 'conflict' ELSE 'ok' END WHEN kind IN ('set_not_null', 'create_index') AND NOT t THEN 'missing-target' WHEN kind = 'drop_table' AND NOT t THEN 'conflict' ELSE 'ok' END AS status
FROM (SELECT s.*, s.table_name IN (SELECT table_name FROM l) AS t, EXISTS (SELECT 1 FROM l WHERE l.table_name = s.table_name AND l.column_name = s.column_name) AS c FROM s)""")
def plan(spark, d):
    live = spark.createDataFrame(_LIVE, _SCHEMA)
    return diff.plan_items(spark.createDataFrame(_ITEMS, "idx int, kind string, table_name string, column_name string"), live, live)


_PUBLISHED = [("u", "age", "range", None, None), ("u", "age", "null_fraction", None, None), ("u", "bio", "length", "free_text", None), ("u", "code", "length", "slug", None), ("u", "state", "values", None, "all"), ("u", "state", "frequencies", None, None), ("u", "pay", "histogram", None, None)]
_PUB_SQL = _values(_PUBLISHED, "table_name, column_name, fact, format_class, redact")
_PUB = "table_name string, column_name string, fact string, format_class string, redact string"


@register("governance_leaks", f"SELECT table_name || '.' || column_name AS location, fact, CASE WHEN fact IN ('range', 'histogram') THEN 'standard' WHEN fact IN ('values', 'frequencies') THEN 'permissive' ELSE 'strict' END AS level FROM {_PUB_SQL} WHERE fact IN ('range', 'histogram', 'values', 'frequencies') OR (fact = 'length' AND format_class = 'free_text')")
def leaks(spark, d):
    return privacy.leaks(spark.createDataFrame(_PUBLISHED, _PUB))


for _level, _drop in privacy.DROPS.items():
    if _level != "all":
        _not_in = f" AND fact NOT IN ({', '.join(repr(x) for x in _drop)})" if _drop else ""
        _own = ", ".join(repr(x) for x in privacy.DROPS["all"])
        register(f"privacy_{_level}", f"SELECT table_name, column_name, fact FROM {_PUB_SQL} WHERE NOT (coalesce(redact = 'all', FALSE) AND fact IN ({_own})){_not_in}")(lambda spark, d, level=_level: privacy.published(spark.createDataFrame(_PUBLISHED, _PUB), level).select("table_name", "column_name", "fact"))

_CLAIMS = [("u", "email", "text", True, "exact", "exact"), ("u", "id", "numeric", True, "estimated", "exact"), ("u", "age", "numeric", True, None, "guessed"), ("u", "ok", "numeric", True, "exact", "measured")]


@register("conformance_emitter", f"WITH c AS (SELECT * FROM {_values(_CLAIMS, 'table_name, column_name, category, has_range, unique_conf, confidence')}) SELECT table_name || '.' || column_name AS object, 'range on text' AS rule FROM c WHERE category = 'text' AND has_range UNION ALL SELECT table_name || '.' || column_name, 'unique must be exact' FROM c WHERE unique_conf <> 'exact' UNION ALL SELECT table_name || '.' || column_name, 'unknown confidence' FROM c WHERE confidence NOT IN ('exact', 'measured', 'estimated', 'declared')")
def emitter(spark, d):
    return diff.violations(spark.createDataFrame(_CLAIMS, "table_name string, column_name string, category string, has_range boolean, unique_conf string, confidence string"))


_SECRETS = [(0, "postgres://joe:pw@db.example:5432/x"), (1, "host=a password='s p' user=joe"), (2, "Key (email)=(a@b.c) already exists"), (3, "bad value 'it''s' here")]


@register("redaction", f"SELECT CAST(i AS INTEGER) AS id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\\b([a-zA-Z][a-zA-Z0-9+.-]*://)[^\\s/@]*@', '\\1***@', 'g'), '\\b(password|user)\\s*=\\s*(''[^'']*''|\\S+)', '\\1=***', 'g'), '''([^'']|'''')*''', '''***''', 'g'), '\\)=\\([^)]*\\)', ')=(***)', 'g') AS clean FROM {_values(_SECRETS, 'i, s')}")
def redaction(spark, d):
    return spark.createDataFrame(_SECRETS, "id int, s string").select("id", scrub(redact_url(F.col("s"))).alias("clean"))


# --- hydration of tables --------------------------------------------------------------


_DECLARED = ("orders", "customer", "lineitem", "region")


@register("hydrate_row_plan", "SELECT table_name, CASE WHEN n <= 0 THEN 0 ELSE greatest(1, CAST(trunc(n * 0.01) AS BIGINT)) END AS planned FROM (" + union_all(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _DECLARED) + ")")
def row_plan(spark, d):
    counts = profile.row_counts({t: table(spark, d, t) for t in _DECLARED}).collect()  # one row a table
    return local(spark, [(r.table_name, fanout.plan_rows(r.row_count, 0.01)) for r in counts], "table_name string, planned long")


def _shape_of(spark, d, name="orders_customer"):
    child, fk, parent, _ = PAIRS[name]
    f = references.fanout(table(spark, d, child), fk).first()
    return table(spark, d, child).count(), table(spark, d, parent).count(), fanout.Shape(f["mean"], f["p50"], f["p95"], f["max"])


@register("hydrate_fk_fanout")
def fk_fanout(spark, d):
    children, parents, shape = _shape_of(spark, d)
    return references.fanout(fanout.assign(spark, children, parents, children, shape), "parent")


@register("hydrate_fk_orphans")
def fk_orphans(spark, d):
    children, parents, shape = _shape_of(spark, d)
    made = fanout.assign(spark, children, parents, children, shape, 0.05)
    return references.orphan_fraction(made, "parent", spark.range(parents), "id")


_OWNERS = engine.TableShape("public.owners", 100, [engine.ColumnShape("id", "bigint", unique=True, low=1000), engine.ColumnShape("code", "uuid", unique=True, format_class="uuid"), engine.ColumnShape("mail", "text", unique=True, format_class="email")])
_CHILDREN = {"id": "bigint", "code": "uuid", "mail": "text"}
_LOST = 0.05


@register("hydrate_fk_resolves", union_all(f"SELECT '{c}' AS key, 2000 AS children, 100 AS orphans, 0 AS nulls" for c in _CHILDREN))
def fk_resolves(spark, d):
    """Whether references to keys of each kind meet the parent's made rows, but for the orphans asked for."""
    parents, parts = engine.generate(spark, _OWNERS, 42), []
    for name, kind in _CHILDREN.items():
        child = engine.TableShape("public.children", 2000, [engine.ColumnShape("owner", kind, reference=engine.Reference(_OWNERS, name, None, _LOST))])
        made = engine.generate(spark, child, 42).join(parents.select(F.col(name).alias("key"), F.lit(1).alias("there")), F.col("owner") == F.col("key"), "left")
        parts.append(made.agg(F.lit(name).alias("key"), F.count("*").cast("int").alias("children"), F.count(F.when(F.col("there").isNull(), 1)).cast("int").alias("orphans"), F.count(F.when(F.col("owner").isNull(), 1)).cast("int").alias("nulls")))
    return profile.union(parts)


_TYPED = {"tags": "int[]", "flags": "bit(4)", "wire": "macaddr8", "card": "macaddr", "doc": "xml", "at": "point", "blob": "bytea", "ok": "boolean", "host": "cidr", "span": "interval", "more": "jsonb", "words": "text[]"}


@register(
    "hydrate_typed",
    """SELECT i AS ordinal, '{"' || i || '"}' AS tags, right(lpad(bin(i), 64, '0'), 4) AS flags, '08:00:2b:00:00:00:' || h[1:2] || ':' || h[3:4] AS wire, '08:00:2b:00:' || h[1:2] || ':' || h[3:4] AS card,
  '<value>' || i || '</value>' AS doc, '(' || i || ',' || i || ')' AS at, '\\x' || lpad(h, 8, '0') AS blob, i % 2 = 0 AS ok, '192.0.2.' || (i % 256) AS host, i || ' seconds' AS span, '{}' AS more, '{"val_' || i || '"}' AS words
FROM (SELECT i, lpad(lower(hex(i)), 4, '0') AS h FROM range(300) t(i))""",
)
def typed(spark, d):
    return engine.generate(spark, engine.TableShape("public.typed", 300, [engine.ColumnShape(c, k, unique=True) for c, k in _TYPED.items()]), 7)


@register("hydrate_table")
def hydrated(spark, d):
    c = engine.ColumnShape
    shape = engine.TableShape(
        "public.accounts",
        2000,
        [c("id", "bigint", unique=True, low=1), c("email", "varchar(24)", 0.032, distinct=900, format_class="email", width=24), c("age", "integer", low=18, high=97, distinct=500), c("state", "order_state", labels=["new", "paid", "sent"]), c("score", "integer", bounds=[0.0, 1.0, 5.0, 1000.0]), c("made_at", "timestamp", low="2024-01-01", high="2024-02-01", distinct=40), c("owner_id", "bigint", reference=engine.Reference(_OWNERS, "id", fanout.Shape(20, 12, 60, 200)))],
    )
    return engine.generate(spark, shape, 42).withColumn("made_at", F.date_format("made_at", "yyyy-MM-dd HH:mm:ss"))


# --- structure, samples, checks of data --------------------------------------------------

_STRUCTURE = [("region", "r_regionkey", "int", "numeric"), ("region", "r_name", "string", "text"), ("events", "ts", "timestamp_ntz", "temporal")]


@register("catalog_columns", f"SELECT * FROM {_values(_STRUCTURE, 'table_name, column_name, data_type, category')}")
def catalog_columns(spark, d):
    found = catalog.columns(spark, {t: table(spark, d, t) for t in ("region", "events")})
    return found.where(F.col("column_name").isin("r_regionkey", "r_name", "ts")).select("table_name", "column_name", "data_type", "category")


@register("catalog_value_sample", union_all(f"SELECT * FROM (SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL ORDER BY sha256(CAST({c} AS VARCHAR)) LIMIT 100)" for t, c in (("customer", "c_name"), ("orders", "o_orderkey"))))
def sample_values(spark, d):
    return profile.union([catalog.value_sample(table(spark, d, "customer"), "customer", "c_name", 100), catalog.value_sample(table(spark, d, "orders"), "orders", "o_orderkey", 100)])


_STATS = [("a", 50.0, 1000), ("b", -0.5, 1001), ("c", -1.0, 77), ("d", 0.0, 10)]


@register("profile_distinct_from_stats", f"SELECT c, CASE WHEN n > 0 THEN CAST(n AS BIGINT) WHEN n < 0 THEN CAST(floor(-n * r + 0.5) AS BIGINT) END AS distinct_count FROM {_values(_STATS, 'c, n, r')}")
def from_stats(spark, d):
    return spark.createDataFrame(_STATS, "c string, n double, r long").select("c", catalog.distinct_from_stats(F.col("n"), F.col("r")).alias("distinct_count"))


@register("profile_binary_length", f"SELECT 'pages' AS table_name, 'html' AS column_name, CAST(min(octet_length(encode(html))) AS BIGINT) AS min_bytes, CAST(max(octet_length(encode(html))) AS BIGINT) AS max_bytes, {R6('avg(octet_length(encode(html)))')} AS mean_bytes FROM pages")
def binary_length(spark, d):
    return catalog.binary_lengths(table(spark, d, "pages").select(F.col("html").cast("binary").alias("html")), "pages", ["html"])


_CHECKED = [("CHECK ((age >= 0) AND (age < 120))", True), ("age > 17", True), ("state = ANY (ARRAY['new'::text, 'paid'::text, 'sent'::text])", True), ("state = ANY (ARRAY['paid'::text, 'sent'::text, 'x'::text])", True), ("n > 5", False), ("a > 1 OR b > 2", True)]


@register("hydrate_check_domains", "SELECT * FROM (VALUES ('age', 18.0::DOUBLE, 119.0::DOUBLE, NULL), ('state', NULL, NULL, 'paid,sent')) v(column_name, low, high, choices)")
def check_domains(spark, d):
    found = checks.domains(_CHECKED)
    return spark.createDataFrame([(c, x.low, x.high, ",".join(x.values) if x.values is not None else None) for c, x in sorted(found.items())], "column_name string, low double, high double, choices string")


_TRIED = """ALTER TABLE customer ALTER c_name SET NOT NULL; ALTER TABLE customer ADD UNIQUE (c_acctbal); ALTER TABLE orders ADD CONSTRAINT p CHECK (o_totalprice > 1000);
ALTER TABLE lineitem ADD FOREIGN KEY (l_orderkey) REFERENCES orders (o_orderkey); CREATE UNIQUE INDEX i ON orders (o_orderkey)"""


@register("apply_checks", """SELECT 0 AS idx, 'set_not_null' AS kind, 'customer' AS table_name, count(*) FILTER (WHERE c_name IS NULL) AS violations FROM customer
UNION ALL SELECT 1, 'add_unique', 'customer', count(*) FROM (SELECT c_acctbal FROM customer GROUP BY c_acctbal HAVING count(*) > 1)
UNION ALL SELECT 2, 'add_check', 'orders', count(*) FILTER (WHERE NOT o_totalprice > 1000) FROM orders
UNION ALL SELECT 3, 'add_fk', 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 4, 'create_unique_index', 'orders', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1)""")
def apply_checks(spark, d):
    rows = [dict(zip(statements._NAMES, r)) for r in statements.parse([("a.sql", _TRIED)])]
    return apply.check_rows(rows, {t: table(spark, d, t) for t in ("customer", "orders", "lineitem")})


_KEYS_DECLARED = [("t", "primary_key", ["id"]), ("t", "unique", ["a", "b"]), ("u", "unique", ["code"])]
_INDEXES_DECLARED = [("t", True, ["email"], 0, None), ("t", True, ["x"], 1, None), ("t", True, ["y"], 0, "z IS NULL"), ("t", False, ["w"], 0, None)]


@register("catalog_proven_unique", "SELECT * FROM (VALUES ('t', 'id'), ('u', 'code'), ('t', 'email')) v(table_name, column_name)")
def proven(spark, d):
    c = spark.createDataFrame(_KEYS_DECLARED, "table_name string, kind string, columns array<string>")
    i = spark.createDataFrame(_INDEXES_DECLARED, "table_name string, is_unique boolean, columns array<string>, expressions int, predicate string")
    return catalog.proven_unique(c, i)
