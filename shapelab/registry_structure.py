"""Registered queries over declared structure, locks, conformance and rules of work."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import adherence, profile
from .plans import conformance, locks, verdict
from .plans.facts import local
from .registry import R6, STAR, register, union_all
from .registry_plans import _values
from .session import table
from .sources import catalog, inventory

# --- declared structure -----------------------------------------------------------

_ATTRIBUTES = [("s.users", 1, "id", "bigint"), ("s.users", 2, "email", "citext"), ("s.users", 3, "made", "timestamp"), ("s.users", 4, "org", "bigint"), ("s.orgs", 1, "id", "bigint"), ("s.orgs", 3, "region", "text"), ("s.staff", 1, "org", "bigint"), ("s.staff", 2, "region", "text")]
_ATTRIBUTE = "table_name string, number int, column_name string, data_type string"
_CONSTRAINTS = [("s.users", "users_pkey", "primary_key", True, None, [1], None), ("s.users", "users_email", "unique", True, True, [2], None), ("s.users", "users_two", "unique", True, False, [4, 2], None), ("s.users", "users_made", "check", False, None, [3], "made > '2020-01-01'")]
_CONSTRAINT = "table_name string, name string, kind string, validated boolean, nulls_not_distinct boolean, keys array<int>, expression string"
_REFERENCES = [("s.users", "users_org", [4], "s.orgs", [1], "cascade", "no action", True), ("s.staff", "staff_org", [2, 1], "s.orgs", [3, 1], "no action", "cascade", False)]
_REFERENCE = "table_name string, name string, keys array<int>, parent_table string, parent_keys array<int>, on_delete string, on_update string, validated boolean"
_INDEXES = [("s.users", "by_email", "btree", True, "made IS NOT NULL", 8192, 1), ("s.users", "by_lower", "btree", True, None, 16384, 1), ("s.users", "by_made", "btree", False, None, 8192, 2), ("s.users", "by_word", "gin", False, None, 24576, 1)]
_PARTS = [("by_email", 0, 2, None, None, False, False), ("by_email", 1, 4, None, None, False, False), ("by_lower", 0, 0, "lower(email)", None, False, False), ("by_made", 0, 3, None, None, True, False), ("by_made", 1, 1, None, None, False, False), ("by_made", 2, 2, None, None, False, False), ("by_word", 0, 2, None, "gin_trgm_ops", False, False)]
_INDEX = "table_name string, name string, method string, is_unique boolean, predicate string, bytes long, key_count int, parts array<struct<number:int,expression:string,opclass:string,descending:boolean,nulls_first:boolean>>"
_A = _values(_ATTRIBUTES, "table_name, number, column_name, data_type")


def _keys(rows, at: int):
    """(table, name, position, number) of the key list that stands in field `at`."""
    return [(r[0], r[1], i, n) for r in rows for i, n in enumerate(r[at])]


@register("catalog_estimated_rows", f"SELECT i AS id, CAST(trunc(greatest(coalesce(x, 0), 0)) AS BIGINT) AS row_count FROM {_values([(0, -1.0), (1, 0.0), (2, 12.7), (3, None), (4, 3e9)], 'i, x')}")
def estimated_rows(spark, d):
    return local(spark, [(0, -1.0), (1, 0.0), (2, 12.7), (3, None), (4, 3e9)], "id int, x double").select("id", inventory.estimated_rows(F.col("x")).alias("row_count"))


@register(
    "catalog_constraints",
    f"""SELECT c.table_name, c.name, c.kind, CASE WHEN any_value(c.kind) <> 'check' THEN string_agg(a.column_name, ',' ORDER BY k.position) END AS columns, c.validated, CASE WHEN c.kind = 'unique' THEN NOT c.nnd END AS nulls_distinct, CASE WHEN c.kind = 'check' THEN c.expression END AS expression
FROM {_values([r[:5] + r[6:] for r in _CONSTRAINTS], 'table_name, name, kind, validated, nnd, expression').replace(') v(', ') c(')}
JOIN {_values(_keys(_CONSTRAINTS, 5), 'table_name, name, position, number').replace(') v(', ') k(')} ON k.table_name = c.table_name AND k.name = c.name
JOIN {_A.replace(') v(', ') a(')} ON a.table_name = c.table_name AND a.number = k.number GROUP BY ALL""",
)
def constraints(spark, d):
    found = inventory.constraint_inventory(local(spark, _CONSTRAINTS, _CONSTRAINT), local(spark, _ATTRIBUTES, _ATTRIBUTE))
    return found.withColumn("columns", F.array_join("columns", ","))


@register(
    "catalog_references",
    f"""SELECT r.table_name, r.name, a.column_name, r.parent || '.' || b.column_name AS refers_to, r.on_delete, r.on_update, r.validated
FROM {_values([(t, n, m, p, q, x, y, v) for t, n, mine, p, theirs, x, y, v in _REFERENCES for m, q in zip(mine, theirs)], 'table_name, name, m, parent, q, on_delete, on_update, validated').replace(') v(', ') r(')}
JOIN {_A.replace(') v(', ') a(')} ON a.table_name = r.table_name AND a.number = r.m JOIN {_A.replace(') v(', ') b(')} ON b.table_name = r.parent AND b.number = r.q""",
)
def references(spark, d):
    return inventory.reference_inventory(local(spark, _REFERENCES, _REFERENCE), local(spark, _ATTRIBUTES, _ATTRIBUTE))


@register(
    "catalog_indexes",
    f"""WITH p AS (SELECT x.*, a.column_name, coalesce(x.expression, a.column_name) || coalesce(' ' || x.opclass, '') || CASE WHEN x.down AND NOT x.nf THEN ' DESC NULLS LAST' WHEN x.down THEN ' DESC' WHEN x.nf THEN ' NULLS FIRST' ELSE '' END AS text
  FROM {_values(_PARTS, 'name, position, number, expression, opclass, down, nf').replace(') v(', ') x(')} LEFT JOIN {_A.replace(') v(', ') a(')} ON a.table_name = 's.users' AND a.number = x.number)
SELECT i.table_name, i.name, i.method, i.is_unique, coalesce(string_agg(p.column_name, ',' ORDER BY p.position) FILTER (WHERE p.position < i.kc AND p.expression IS NULL), '') AS columns,
  CASE WHEN bool_or(p.position < i.kc AND (p.expression IS NOT NULL OR p.text <> p.column_name)) THEN string_agg(p.text, ',' ORDER BY p.position) FILTER (WHERE p.position < i.kc) END AS keys,
  coalesce(string_agg(p.column_name, ',' ORDER BY p.position) FILTER (WHERE p.position >= i.kc), '') AS include, i.predicate, CAST(i.bytes AS BIGINT) AS bytes
FROM {_values(_INDEXES, 'table_name, name, method, is_unique, predicate, bytes, kc').replace(') v(', ') i(')} JOIN p ON p.name = i.name GROUP BY ALL""",
)
def indexes(spark, d):
    names = ("number", "expression", "opclass", "descending", "nulls_first")
    rows = [(*r, [dict(zip(names, p[2:])) for p in _PARTS if p[0] == r[1]]) for r in _INDEXES]
    found = inventory.index_inventory(local(spark, rows, _INDEX), local(spark, _ATTRIBUTES, _ATTRIBUTE))
    return found.withColumns({c: F.array_join(c, ",") for c in ("columns", "keys", "include")})


_USES = [("type", "citext_list"), ("type", "mail"), ("type", "text"), ("opclass", "gin_trgm_ops"), ("type", "block")]
_TYPES = [("citext_list", "citext", None), ("mail", None, "hstore"), ("block", "text", None)]
_MEMBERS = [("type", "citext", "citext", "public"), ("type", "hstore", "hstore", "ext"), ("type", "geometry", "postgis", "public"), ("opclass", "gin_trgm_ops", "pg_trgm", "public"), ("type", "text", "plpgsql", "pg_catalog")]


@register(
    "catalog_extensions",
    f"""WITH u AS (SELECT * FROM {_values(_USES, 'kind, name')}), t AS (SELECT * FROM {_values(_TYPES, 'name, element, base')}),
s AS (SELECT kind, name FROM u UNION SELECT 'type', element FROM t JOIN u USING (name) WHERE kind = 'type' UNION SELECT 'type', base FROM t JOIN u USING (name) WHERE kind = 'type')
SELECT DISTINCT extension, schema FROM {_values(_MEMBERS, 'kind, name, extension, schema').replace(') v(', ') m(')} JOIN s USING (kind, name) WHERE extension <> 'plpgsql'""",
)
def extensions(spark, d):
    return inventory.required_extensions(local(spark, _USES, "kind string, name string"), local(spark, _TYPES, "name string, element string, base string"), local(spark, _MEMBERS, "kind string, name string, extension string, schema string"))


_EDGES = [("log", "log_24"), ("log", "log_25"), ("log_25", "log_25_a"), ("log_25", "log_25_b"), ("evt", "evt_1")]
_SIZES = [("log", 0.0, 0), ("log_24", 900.0, 4000), ("log_25", -1.0, 0), ("log_25_a", 60.0, 300), ("log_25_b", 40.0, 200), ("evt", 0.0, 0), ("evt_1", -1.0, 10)]
_TREE = f"tree(root, table_name, depth) AS (SELECT DISTINCT p, p, 0 FROM {_values(_EDGES, 'p, c')} UNION ALL SELECT t.root, e.c, t.depth + 1 FROM tree t JOIN {_values(_EDGES, 'p, c').replace(') v(', ') e(')} ON e.p = t.table_name)"


@register("catalog_partition_tree", f"WITH RECURSIVE {_TREE} SELECT root, table_name, CAST(depth AS INTEGER) AS depth FROM tree")
def partition_tree(spark, d):
    return inventory.partition_tree(local(spark, _EDGES, "parent string, child string"))


@register(
    "catalog_partition_facts",
    f"""WITH RECURSIVE {_TREE}, s AS (SELECT name, greatest(n, 0) AS n, bytes FROM {_values(_SIZES, 'name, n, bytes')}),
b AS (SELECT root, sum(s.bytes) AS bytes FROM tree JOIN s ON s.name = tree.table_name GROUP BY root)
SELECT e.p AS table_name, count(*) AS partitions, {R6('coalesce(max(s.n) / nullif(sum(s.n), 0), 0)')} AS skew, CAST(sum(s.n) AS BIGINT) AS rows, CAST(any_value(b.bytes) AS BIGINT) AS bytes
FROM {_values(_EDGES, 'p, c').replace(') v(', ') e(')} JOIN s ON s.name = e.c JOIN b ON b.root = e.p GROUP BY e.p""",
)
def partition_facts(spark, d):
    return inventory.partition_facts(local(spark, _EDGES, "parent string, child string"), local(spark, _SIZES, "table_name string, rows double, bytes long"))


@register("catalog_planner_stats", union_all(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {R6(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS null_frac, TRUE AS near FROM {t}" for t in ("orders", "customer") for c in STAR[t][1]))
def planner_stats(spark, d):
    """Statistics of a whole scan, and whether the distinct count they tell is within 5 % of the exact one."""
    out = []
    for t, key in (("orders", "o_orderkey"), ("customer", "c_custkey")):
        df, names = table(spark, d, t), STAR[t][1]
        stats = catalog.planner_stats(df, t, names, key, catalog.sample_share(0))
        exact = profile.distinct_counts(df, t, names).select("column_name", "distinct_count", "non_null")
        told = catalog.distinct_from_stats(F.col("n_distinct"), F.col("non_null"))
        out.append(stats.join(exact, "column_name").select("table_name", "column_name", "null_frac", (F.abs(told - F.col("distinct_count")) <= 0.05 * F.col("distinct_count")).alias("near")))
    return profile.union(out)


# --- locks -----------------------------------------------------------------------------

_HELD = [(0, "users", "RowExclusiveLock"), (0, "orders", "AccessExclusiveLock"), (1, "b", "ShareLock"), (1, "a", "ShareLock"), (1, "c", "ShareUpdateExclusiveLock"), (2, "x", "SIReadLock"), (3, "y", "ShareRowExclusiveLock"), (4, "z", "AccessShareLock"), (5, "z", "RowShareLock"), (6, "z", "ExclusiveLock")]
_SPOKEN = [(1, "AccessShareLock", "ACCESS SHARE"), (2, "RowShareLock", "ROW SHARE"), (3, "RowExclusiveLock", "ROW EXCLUSIVE"), (4, "ShareUpdateExclusiveLock", "SHARE UPDATE EXCLUSIVE"), (5, "ShareLock", "SHARE"), (6, "ShareRowExclusiveLock", "SHARE ROW EXCLUSIVE"), (7, "ExclusiveLock", "EXCLUSIVE"), (8, "AccessExclusiveLock", "ACCESS EXCLUSIVE")]


@register("lock_strongest", f"SELECT CAST(idx AS INTEGER) AS idx, table_name, mode, lock FROM {_values(_HELD, 'idx, table_name, mode').replace(') v(', ') h(')} JOIN {_values(_SPOKEN, 'n, mode, lock').replace(') v(', ') s(')} USING (mode) QUALIFY row_number() OVER (PARTITION BY idx ORDER BY n DESC, table_name) = 1")
def strongest(spark, d):
    return locks.strongest(local(spark, _HELD, "idx int, table_name string, mode string"))


# --- what findings rest on ----------------------------------------------------------------

_PATHS = ["public.users.email.unique", "public.users.rows", "public.users", "public.users.more.id.range", "public.none.x.range"]
_OWNERS = ["public.users", "public.users.more", "public"]


@register("verdict_prefix", f"SELECT path, max_by(t, length(t)) AS table_name, substr(path, max(length(t)) + 2) AS rest FROM {_values([(p,) for p in _PATHS], 'path').replace(') v(', ') p(')} JOIN {_values([(t,) for t in _OWNERS], 't').replace(') v(', ') o(')} ON path = t OR starts_with(path, t || '.') GROUP BY path")
def prefix(spark, d):
    return verdict.owners(local(spark, [(p,) for p in _PATHS], "path string"), local(spark, [(t,) for t in _OWNERS], "table_name string"))


_RESTS = [("A", "warn", 0, ["public.users.email.unique", "public.users.rows"]), ("B", "warn", 1, ["public.users.rows"]), ("C", "error", 2, []), ("D", "warn", 3, ["public.users.id.range"])]
_KNOWN = [("public.users.rows", 1), ("public.users.id.range", 3)]


@register("verdict_resolve", f"SELECT code, CAST(conf AS INTEGER) AS confidence, about AS resolve FROM {_values([('A', -1, 'public.users.email'), ('B', 1, 'public.users'), ('C', 3, None), ('D', 3, None)], 'code, conf, about')}")
def resolve(spark, d):
    found = local(spark, [(c, s, i, "public.users", None, "m", p) for c, s, i, p in _RESTS], "code string, severity string, idx int, table_name string, column_name string, message string, depends_on array<string>")
    rows = verdict.capped(found, local(spark, _KNOWN, "path string, rank int"))
    return verdict.resolvable(rows, local(spark, [("public.users",)], "table_name string")).select("code", "confidence", "resolve")


# --- conformance -------------------------------------------------------------------------

_CLAIMED_INDEXES = [("t", "good", ["a"], None, ["b"]), ("t", "bare", [], None, None), ("t", "worse", None, None, []), ("t", "by_text", [], ["lower(a)"], None), ("t", "both", ["a", "b"], None, ["b", "c", "a"])]


@register("conformance_indexes", "SELECT * FROM (VALUES ('t.bare', 'an index tells its keys'), ('t.worse', 'an index tells its keys'), ('t.both.a', 'payload is no key'), ('t.both.b', 'payload is no key')) v(object, rule)")
def claimed_indexes(spark, d):
    return conformance.index_violations(local(spark, _CLAIMED_INDEXES, "table_name string, name string, columns array<string>, keys array<string>, include array<string>"))


_CLAIMED_TYPES = [("app.status", "enum", 2, ["a", "b"], None), ("app.hidden", "enum", 4, None, None), ("app.none", "enum", 0, [], None), ("app.off", "enum", 3, ["a"], None), ("app.mail", "domain", None, None, "text"), ("app.void", "domain", None, None, ""), ("app.odd", "range", None, None, None), ("app.null", None, None, None, None)]
_CLAIMED_COLUMNS = [("t", "a", "app.status"), ("t", "b", "app.gone"), ("t", "c", "integer"), ("t", "d", "app.mail[]"), ("t", "e", "citext"), ("t", "f", "public.Geometry[]"), ("t", "g", "vector")]


@register("conformance_types", """SELECT * FROM (VALUES ('types.app.none', 'an enum tells its size'), ('types.app.off', 'an enum tells its size'), ('types.app.void', 'a domain names its base'), ('types.app.odd', 'a type is an enum or a domain'), ('types.app.null', 'a type is an enum or a domain'),
  ('t.b', 'used types are defined'), ('t.f', 'used types are defined')) v(object, rule)""")
def claimed_types(spark, d):
    types = local(spark, _CLAIMED_TYPES, "name string, kind string, label_count int, labels array<string>, base string")
    return conformance.type_violations(types, local(spark, _CLAIMED_COLUMNS, "table_name string, column_name string, data_type string"))


@register("conformance_extensions", "SELECT * FROM (VALUES ('t.f', 'needed extensions are declared'), ('t.g', 'needed extensions are declared')) v(object, rule)")
def claimed_extensions(spark, d):
    return conformance.extension_violations(local(spark, _CLAIMED_COLUMNS, "table_name string, column_name string, data_type string"), local(spark, [("citext",)], "extension string"))


@register("conformance_validator", "SELECT * FROM (VALUES ('estimated', 'WARN'), ('proven', 'PASS'), ('missing', 'WARN'), ('0 ms', 'instant'), ('50 ms', 'instant'), ('500 ms', 'fast'), ('5000 ms', 'noticeable'), ('30000 ms', 'slow'), ('120000 ms', 'outage')) v(object, got)")
def validator(spark, d):
    return conformance.validator(spark)


# --- rules of work -------------------------------------------------------------------------

_EVENTS = [("v1", s, i, t, v) for s, steps in {"a": [("describe_shape", None), ("write_sql", None), ("validate", "FAIL"), ("validate", "PASS"), ("open_pr", None)], "b": [("write_sql", None), ("open_pr", None)], "c": [("describe_shape", None), ("validate", "WARN"), ("open_pr", None)]}.items() for i, (t, v) in enumerate(steps)]
_EVENTS += [("v2", "d", 0, "describe_shape", None), ("v2", "e", 0, "validate", None), ("v2", "e", 1, "write_sql", None), ("v2", "e", 2, "describe_shape", None)]


@register(
    "agent_adherence",
    f"""WITH e AS (SELECT *, (SELECT coalesce(x.verdict, '') FROM {_values(_EVENTS, 'label, session, seq, type, verdict').replace(') v(', ') x(')} WHERE x.session = v.session AND x.type = 'validate' AND x.seq <= v.seq ORDER BY x.seq DESC LIMIT 1) AS latest FROM {_values(_EVENTS, 'label, session, seq, type, verdict')}),
s AS (SELECT label, session, min(seq) FILTER (WHERE type = 'write_sql') AS w, min(seq) FILTER (WHERE type = 'describe_shape') AS d, min(seq) FILTER (WHERE type = 'open_pr') AS o, min(seq) FILTER (WHERE type = 'validate') AS c,
  count(*) FILTER (WHERE type = 'open_pr' AND coalesce(latest, '') <> 'PASS') AS waved, count(*) FILTER (WHERE type = 'validate' AND coalesce(verdict, '') <> 'PASS') AS bad, arg_max(coalesce(latest, ''), seq) AS final FROM e GROUP BY label, session)
SELECT label AS rule_label, count(*) AS sessions, {R6('avg((CASE WHEN w IS NULL OR d < w THEN 1 ELSE 0 END + CASE WHEN o IS NULL OR c < o THEN 1 ELSE 0 END + CASE WHEN waved = 0 THEN 1 ELSE 0 END) / 3.0)')} AS adherence_mean, {R6("avg(CASE WHEN bad > 0 AND final = 'PASS' THEN 1.0 ELSE 0.0 END)")} AS closure_rate FROM s GROUP BY label""",
)
def adherence_summary(spark, d):
    return adherence.summary(local(spark, _EVENTS, "rule_label string, session string, seq int, type string, verdict string"))
