"""Findings: statements joined with facts.

Statements are resolved and joined with the facts of their table, column and reference
once.  A row rule is an expression over such a row; all of them are evaluated together, as
one array that is exploded, so the plan has one scan whatever the number of rules.  The
few rules over several statements (or over indexes) are queries of their own, over the
same joined rows.

A script is read on the driver and facts are schema metadata, thousands of rows at most;
the joined rows are brought there once, so that no rule plans or runs the joins again."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import estimate
from .facts import Facts, again, rank, resolve

FINDING = ["code", "severity", "idx", "file", "line", "table_name", "column_name", "message", "depends_on", "bucket"]
_SHAPE = "struct<code:string,severity:string,column_name:string,message:string,depends_on:array<string>,bucket:string>"
RULES = {}
MASS_ROWS = 100_000
TAIL_MAX, TAIL_RATIO = 100, 10


def row_rule(code: str, *kinds: str):
    """f(major) -> (condition, severity, message, depends_on or None, bucket or None) over joined rows."""

    def add(f):
        f.kinds, f.by_row = kinds, True
        RULES[code] = f
        return f

    return add


def rule(code: str):
    """f(rows, facts, major) -> rows of findings."""

    def add(f):
        f.by_row = False
        RULES[code] = f
        return f

    return add


def _say(df: DataFrame, code: str, severity, message, depends=None, bucket=None) -> DataFrame:
    depends = depends if depends is not None else F.array().cast("array<string>")
    bucket = bucket if bucket is not None else F.lit(None).cast("string")
    return df.select(F.lit(code).alias("code"), _column(severity).alias("severity"), "idx", "file", "line", F.coalesce("known", "table_name").alias("table_name"), "column_name", _column(message).alias("message"), depends.alias("depends_on"), bucket.alias("bucket"))


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _kinds(st: DataFrame, *kinds: str) -> DataFrame:
    return st.where(F.col("kind").isin(*kinds))


def _path(fact: str, column: Column | None = None) -> Column:
    column = F.col("column_name") if column is None else column
    return F.array(F.concat_ws(".", "known", column, F.lit(fact)))


def _bucket(op: str) -> Column:
    """What the change may take on the declared rows, where a measured basis may be carried on."""
    ok = estimate.usable(F.col("basis_rows"), F.col("basis_ms"), F.col("row_count"))
    ms = estimate.predicted_ms(F.lit(op), F.col("basis_rows"), F.col("basis_ms"), F.col("row_count"))
    return F.when(ok & F.col("row_count").isNotNull(), estimate.bucket(ms))


# Integer types by width, for narrowing.
_WIDTH = {"smallint": 1, "int2": 1, "integer": 2, "int": 2, "int4": 2, "bigint": 3, "int8": 3}


def _base(kind: Column) -> Column:
    return F.trim(F.regexp_replace(kind, r"\(.*$", ""))


def _size(kind: Column) -> Column:
    return F.regexp_extract(kind, r"\((\d+)", 1).try_cast("int")


def _width(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in _WIDTH.items() for x in kv])[_base(kind)]


def is_string(kind: Column) -> Column:
    return _base(kind).isin("text", "varchar", "character varying")


def is_narrowing(old: Column, new: Column) -> Column:
    ints = _width(new) < _width(old)
    strings = is_string(old) & is_string(new) & _size(new).isNotNull() & (_size(old).isNull() | (_size(new) < _size(old)))
    numbers = (_base(old) == "numeric") & (_base(new) == "numeric") & (_size(new) < _size(old))
    crossing = is_string(old) & ~is_string(new) | ((_base(old) == "numeric") & _width(new).isNotNull())
    return F.coalesce(ints, F.lit(False)) | F.coalesce(strings, F.lit(False)) | F.coalesce(numbers, F.lit(False)) | F.coalesce(crossing, F.lit(False))


def is_widening(old: Column, new: Column) -> Column:
    """Between string types, to no limit or a larger one: no rewrite."""
    grown = _size(new).isNull() | (_size(old).isNotNull() & (_size(new) >= _size(old)))
    return F.coalesce(is_string(old) & is_string(new) & grown, F.lit(False))


# --- rules over one row -----------------------------------------------------------

#: Statements that take the strongest lock on a table, with a rebuild that is not concurrent.
EXCLUSIVE = ("set_not_null", "drop_not_null", "add_unique", "add_primary_key", "add_check", "rename_column", "rename_table", "drop_column", "drop_table", "truncate", "type_change", "drop_constraint", "replica_identity", "add_column")


@row_rule("RS-LOCK-001", "add_column", "type_change")
def lock_rewrite(major):
    detail = F.col("detail")
    added = F.when(detail == "stored", "a stored generated column").when(detail == "volatile", "a volatile default").when(detail == "unknown", "a default of unknown volatility").when(detail.isin("literal", "stable") & F.lit(major < 11), "a default before major 11")
    why = F.when(F.col("kind") == "add_column", added).when(~is_widening(F.col("data_type"), F.col("new_type")), "a type change")
    return why.isNotNull(), "warn", F.concat(F.lit("the table is rewritten under an exclusive lock by "), why), None, _bucket("table_rewrite")


@row_rule("RS-LOCK-003", "attach_partition")
def lock_attach(major):
    return F.lit(True), "warn", "attaching a partition scans its rows under a lock on the parent", None, _bucket("constraint_validation")


@row_rule("RS-DATA-001", "set_not_null")
def not_null(major):
    has, known = _true(F.col("null_fraction") > 0), rank(F.col("nulls_conf")) >= 2
    return F.lit(True), F.when(has & known, "error").when(has, "warn").otherwise("info"), F.when(has, "the column holds nulls").otherwise("no null is known"), _path("null_fraction"), _bucket("constraint_validation")


def _uniqueness(open_):
    """Whether the columns of a statement are known to hold no value twice."""
    many, exact = F.size("columns") > 1, _true(F.col("unique_conf") == "exact")
    one = (F.size("columns") == 1) & ~(exact & _true(F.col("is_unique")))
    severity = F.when(exact & ~many, "error").otherwise("info")
    message = F.when(many, "uniqueness of several columns is not proven").when(exact, "the values repeat").otherwise("uniqueness is not proven")
    return open_ & (many | one), severity, message, F.array(F.concat_ws(".", "known", F.array_join("columns", ","), F.lit("unique"))), None


@row_rule("RS-DATA-014", "add_unique")
def add_unique(major):
    return _uniqueness(F.col("detail").isNull())


@row_rule("RS-INDEX-010", "create_unique_index")
def unique_index(major):
    unsure = _true(F.col("detail") == "undecidable")
    where, severity, message, depends, _ = _uniqueness(F.col("detail").isNull())
    message = F.when(unsure, "a partial or expression index cannot be judged by column facts").otherwise(message)
    return unsure | where, F.when(unsure, "warn").otherwise(severity), message, F.when(unsure, F.array().cast("array<string>")).otherwise(depends), None


@row_rule("RS-DATA-020", "add_fk", "validate")
def orphans(major):
    has, known = _true(F.col("orphan_fraction") > 0), rank(F.col("orphan_conf"))
    now = F.when(F.col("kind") == "add_fk", ~F.col("not_valid")).otherwise(F.col("added") == "add_fk")
    return _true(now) & (has | (known < 2)), F.when(has & (known >= 2), "error").when(has, "warn").otherwise("info"), F.when(has, "rows without a parent exist").otherwise("no orphan is known"), _path("orphan_fraction", F.coalesce("added_column", "column_name")), None


@row_rule("RS-CONSTRAINT-001", "validate")
def same_transaction(major):
    return F.col("epoch") == F.col("epoch_add"), "warn", "NOT VALID and VALIDATE stand in one transaction", None, None


@row_rule("RS-CONSTRAINT-010", "add_check")
def check_conflict(major):
    lo, hi, k, op = F.col("min_value"), F.col("max_value"), F.col("number"), F.col("op")
    breaks = _true(F.when(op == ">", lo <= k).when(op == ">=", lo < k).when(op == "<", hi >= k).otherwise(hi > k))
    unsure = _true(F.col("range_conf") == "estimated") & lo.isNotNull()
    judged = op.isNotNull() & ~F.col("not_valid") & F.col("has_column")
    return judged & (breaks | unsure), F.when(breaks, "error").otherwise("warn"), F.when(breaks, "present values break the check").otherwise("the range is of a sample only"), _path("range"), None


@row_rule("RS-CONSTRAINT-020", "add_check", "add_fk")
def validating_scan(major):
    return ~F.col("not_valid") & F.col("has_table"), "warn", "all rows are checked under an exclusive lock; add NOT VALID, then VALIDATE", None, _bucket("constraint_validation")


@row_rule("RS-INDEX-001", "create_index", "create_unique_index")
def plain_index(major):
    return ~F.col("concurrently"), "warn", "building the index blocks writes; use CONCURRENTLY", None, _bucket("btree_build")


@row_rule("RS-INDEX-002", "add_primary_key", "add_unique")
def constraint_index(major):
    return F.col("detail").isNull(), "warn", "the constraint builds an index under an exclusive lock", None, _bucket("btree_build")


@row_rule("RS-PERF-002", "update", "delete")
def mass_change(major):
    return (F.col("where_kind") == "none") & (F.col("row_count") >= MASS_ROWS), "warn", "every row of a large table is changed at once", None, None


@row_rule("RS-PERF-010", "update", "delete")
def large_change(major):
    single = (F.col("where_kind") == "equality") & _true(F.col("is_unique"))
    bounded = (F.col("where_kind") == "range") & (F.col("number") < MASS_ROWS)
    taken = F.when((F.col("where_kind") == "is_null") & F.col("null_fraction").isNotNull(), F.col("row_count") * F.col("null_fraction")).otherwise(F.col("row_count"))
    unsized = F.col("row_count").isNull()
    return (F.col("where_kind") != "none") & ~_true(single) & ~_true(bounded) & (unsized | (taken >= MASS_ROWS)), "warn", F.when(unsized, "the change cannot be sized").otherwise("many rows are changed in one statement"), None, None


@row_rule("RS-REVERSE-003", "type_change")
def narrowing(major):
    return F.col("has_column") & is_narrowing(F.col("data_type"), F.col("new_type")), "warn", F.concat(F.lit("values may be cut by "), "data_type", F.lit(" to "), "new_type"), None, None


@row_rule("RS-TX-001")
def outside_transaction(major):
    alone = F.col("kind").isin("non_transactional") | (F.col("kind").isin("create_index", "create_unique_index", "drop_index", "reindex") & _true(F.col("concurrently")))
    if major < 12:
        alone |= F.col("kind") == "type_add_value"
    inside = F.col("depth") > 0
    return alone, F.when(inside, "error").otherwise("warn"), F.when(inside, "the statement stands in a transaction block and fails there").otherwise("a runner that opens a transaction would make the statement fail"), None, None


def _simple(code: str, name: str, kinds: tuple[str, ...], message: str):
    def run(major):
        return F.lit(True), "warn", message, None, None

    run.__name__ = name
    row_rule(code, *kinds)(run)


_simple("RS-DEPLOY-001", "rename", ("rename_column", "rename_table"), "running code still uses the old name")
_simple("RS-DEPLOY-002", "replica_identity", ("replica_identity",), "consumers identify rows by the replica identity")
_simple("RS-DEPLOY-003", "drop_not_null", ("drop_not_null",), "running code may rely on the column never being null")
_simple("RS-REVERSE-001", "drop_column", ("drop_column",), "the column's data cannot be brought back")
_simple("RS-REVERSE-002", "drop_table", ("drop_table",), "the table's rows cannot be brought back")
_simple("RS-REVERSE-004", "truncate", ("truncate",), "all rows go and cannot be brought back")


# --- rules over several rows, or over indexes --------------------------------------


def exclusive(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind").isin(*EXCLUSIVE) | ((F.col("kind") == "reindex") & ~F.col("concurrently")))


@rule("RS-LOCK-010")
def lock_timeout(rows, facts, major):
    unset = ~F.exists(F.collect_set("kind").over(Window.partitionBy(F.lit(0))), lambda k: k == "set_lock_timeout")
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("idx", "action"))  # a script's statements
    head = exclusive(rows.withColumn("unset", unset)).withColumn("nth", first).where("nth = 1 AND unset")
    return _say(head, "RS-LOCK-010", "warn", "an exclusive lock is taken and no lock_timeout is set")


@rule("RS-LOCK-011")
def lock_repeated(rows, facts, major):
    found = exclusive(rows).withColumn("of", F.coalesce("known", "table_name")).where("of IS NOT NULL")
    head = F.min(F.struct("idx", "action", "file", "line", "known", F.col("of").alias("table_name"))).alias("x")
    grouped = found.groupBy("of").agg(F.countDistinct("idx").alias("n"), head).where("n > 1").select("n", "x.*", F.lit(None).cast("string").alias("column_name"))
    return _say(grouped, "RS-LOCK-011", "warn", F.concat(F.col("n").cast("string"), F.lit(" statements lock this table exclusively")))


@rule("RS-APPLY-001")
def not_applied(rows, facts, major):
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("idx", "action"))
    head = rows.where(F.col("err_code").isNotNull()).withColumn("nth", first).where("nth = 1")
    return _say(head, "RS-APPLY-001", "error", F.concat(F.lit("the statement failed with "), "err_code"))


@rule("RS-INDEX-003")
def drop_index(rows, facts, major):
    found = facts.indexes.select(F.element_at(F.split("index_name", r"\."), -1).alias("short"), F.col("table_name").alias("of")).dropDuplicates(["short"])
    hit = _kinds(rows, "drop_index").where(~F.col("concurrently")).withColumn("short", F.element_at(F.split("name", r"\."), -1)).join(found, "short", "left")
    return _say(hit.withColumn("known", F.coalesce("known", "of")), "RS-INDEX-003", "warn", "dropping the index locks its table; use CONCURRENTLY")


@rule("RS-INDEX-020")
def reindex(rows, facts, major):
    x = facts.indexes.select(F.col("table_name").alias("of"), F.col("index_name"), "bytes", "bloat")
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    scope, name = F.col("detail"), F.col("name")
    hit = F.when(scope == "index", last("index_name") == last("name")).when(scope == "table", (F.col("of") == name) | (last("of") == name)).when(scope == "schema", F.startswith(F.col("of"), F.concat(name, F.lit(".")))).otherwise(F.lit(True))
    found = _kinds(rows, "reindex").where(~F.col("concurrently")).join(x, hit, "left")  # statements against index metadata: a few rows each
    total = found.groupBy("idx", "file", "line", "detail", "name").agg(F.sum("bytes").alias("bytes"), F.count("bytes").alias("n"), F.max("bloat").alias("bloat"), F.min("of").alias("known"))
    total = total.withColumn("table_name", F.col("known")).withColumn("column_name", F.lit(None).cast("string"))
    message = F.format_string("%d indexes are rebuilt under a lock", "n")
    return _say(total, "RS-INDEX-020", "warn", message, bucket=F.when(F.col("bytes").isNotNull(), estimate.bucket(estimate.reindex_ms(F.col("bytes")))))


@rule("RS-PERF-001")
def cascade(rows, facts, major):
    refs = facts.refs.where("on_delete = 'cascade'").select(F.col("parent_table").alias("known"), F.col("table_name").alias("child"), "fan_mean", "fan_max")
    tail = (F.col("fan_max") >= TAIL_MAX) & (F.col("fan_max") >= TAIL_RATIO * F.col("fan_mean"))
    found = _kinds(rows, "delete", "truncate").join(refs.where(tail), "known")
    return _say(found, "RS-PERF-001", "warn", F.concat(F.lit("the delete cascades into long tails of "), "child"))


def prepared(st: DataFrame, facts: Facts) -> DataFrame:
    """Statements with resolved tables, transaction epoch and depth.  The windows run over a
    script's statements, which are few and stand in one order."""
    order = Window.partitionBy(F.lit(0)).orderBy("idx", "action")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    moved = F.when(F.col("file") != F.lag("file", 1).over(order), 1).otherwise(0)
    marked = st.withColumn("step", F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "end", -1).otherwise(0)).withColumn("moved", moved)
    closed = F.coalesce(F.sum(F.when(F.col("kind") == "end", 1).otherwise(0)).over(before), F.lit(0)) + F.sum("moved").over(upto)
    total = marked.withColumn("epoch", closed).withColumn("sum", F.sum("step").over(upto))
    total = total.withColumn("depth", F.col("sum") - F.least(F.min("sum").over(upto), F.lit(0)))
    return resolve(total.drop("moved", "sum", "step"), facts.tables)


def joined(st: DataFrame, facts: Facts) -> DataFrame:
    """prepared(), each row with what is known of its table, column and reference, and with
    the NOT VALID statement that a VALIDATE completes."""
    ready = prepared(st, facts)
    for name, kind in (("err_code", "string"), ("basis_rows", "long"), ("basis_ms", "double")):
        if name not in ready.columns:
            ready = ready.withColumn(name, F.lit(None).cast(kind))
    adds = _kinds(ready, "add_fk", "add_check").where("not_valid").select(F.upper("name").alias("add_key"), F.col("idx").alias("idx_add"), F.col("kind").alias("added"), F.col("column_name").alias("added_column"), F.col("epoch").alias("epoch_add"))
    key = F.when(F.col("kind") == "validate", F.upper("name"))
    rows = ready.withColumn("key", key).join(adds, (F.col("key") == F.col("add_key")) & (F.col("idx") > F.col("idx_add")), "left").drop("key", "add_key")
    about = F.when(F.size("columns") == 1, F.col("columns")[0]).otherwise(F.coalesce("added_column", "column_name"))
    rows = rows.withColumn("about", F.when(F.col("kind").isin("add_unique", "create_unique_index", "validate", "add_fk"), about).otherwise(F.col("column_name")))
    of = lambda df, *keep: df.select(*[F.col(c) for c in keep])
    columns = of(facts.columns, "table_name", "column_name", "data_type", "null_fraction", "nulls_conf", "is_unique", "unique_conf", "min_value", "max_value", "range_conf").withColumnsRenamed({"table_name": "known", "column_name": "about"}).withColumn("has_column", F.lit(True))
    tables = of(facts.tables, "table_name", "row_count").withColumnRenamed("table_name", "known").withColumn("has_table", F.lit(True))
    refs = of(facts.refs, "table_name", "column_name", "orphan_fraction", "orphan_conf").withColumnsRenamed({"table_name": "known", "column_name": "about"})
    rows = rows.join(columns, ["known", "about"], "left").join(tables, "known", "left").join(refs, ["known", "about"], "left")
    return rows.fillna(False, ["has_column", "has_table"])


@cache
def _one(code: str, major: int) -> Column:
    """What a row rule says of a row, or null."""
    f = RULES[code]
    where, severity, message, depends, bucket = f(major)
    if f.kinds:
        where = F.col("kind").isin(*f.kinds) & where
    column = F.col("column_name")
    if code in ("RS-DATA-014", "RS-INDEX-010"):
        column = F.when(F.col("detail").isNull(), F.array_join("columns", ","))
    elif code == "RS-DATA-020":
        column = F.coalesce("added_column", "column_name")
    depends = F.array().cast("array<string>") if depends is None else depends
    bucket = F.lit(None).cast("string") if bucket is None else bucket
    parts = {"code": F.lit(code), "severity": _column(severity), "column_name": column, "message": _column(message), "depends_on": depends, "bucket": bucket}
    return F.when(_true(where), F.struct(*[v.alias(k) for k, v in parts.items()])).cast(_SHAPE)


def findings(st: DataFrame, facts: Facts, major: int = 16, codes=None) -> DataFrame:
    """All findings; a generic failure is dropped where another error explains it."""
    rows = again(joined(st, facts))
    chosen = {c: RULES[c] for c in sorted(codes or RULES)}
    said = [_one(code, major) for code, f in chosen.items() if f.by_row]
    parts = [f(rows, facts, major).select(*FINDING) for f in chosen.values() if not f.by_row]
    if said:
        found = rows.select("idx", "file", "line", F.coalesce("known", "table_name").alias("table_name"), F.inline(F.array_compact(F.array(*said))))
        parts.insert(0, found.select(*FINDING))
    out = reduce(DataFrame.union, parts)
    explains = F.when((F.col("severity") == "error") & (F.col("code") != "RS-APPLY-001"), 1).otherwise(0)
    errors = F.sum(explains).over(Window.partitionBy(F.lit(0)))  # of the findings, which are few
    return out.withColumn("errors", errors).where("code <> 'RS-APPLY-001' OR errors = 0").drop("errors")
