"""Registered queries of the library and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as classes
from .functions.numbers import round6
from .hydrate import values as hv
from .operators import jsonshape, privacy, profile, references, sketch
from .plans import estimate
from .session import TABLES, table

QUERIES = {}
ORACLES = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


STAR = {
    "customer": (["c_custkey", "c_acctbal"], ["c_name", "c_mktsegment"], []),
    "orders": (["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate"]),
    "lineitem": (["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"], ["l_shipdate"]),
    "events": (["event_id", "user_id", "value"], ["event_type", "props"], ["ts"]),
    "part": (["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"], []),
}
R6 = lambda x: f"round(({x}) * 1e6) / 1e6"


def union_all(parts) -> str:
    return " UNION ALL ".join(parts)


def each(kind: int):
    return [(t, c) for t, cols in STAR.items() for c in cols[kind]]


# --- profile: counts, nulls, distinct ------------------------------------------


@register("profile_row_counts", union_all(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def row_counts(spark, d):
    return profile.row_counts({t: table(spark, d, t) for t in TABLES})


#: The tables hold no null, so this query and its SQL make some by the same rule.
NULLED = {"orders": {"o_orderpriority": ("o_orderkey", 7), "o_totalprice": ("o_custkey", 5)}, "events": {"value": ("event_id", 31)}, "customer": {"c_name": ("c_custkey", 4)}}


@register("profile_null_fractions", union_all(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {R6(f'avg(CASE WHEN {k} % {m} = 0 THEN 1.0 ELSE 0.0 END)')} AS null_fraction FROM {t}" for t, cols in NULLED.items() for c, (k, m) in cols.items()))
def null_fractions(spark, d):
    out = []
    for t, cols in NULLED.items():
        df = table(spark, d, t)
        df = df.select(*[F.when(F.col(k) % m != 0, F.col(c)).alias(c) for c, (k, m) in cols.items()])
        out.append(profile.column_facts(df, t).select("table_name", "column_name", "null_fraction"))
    return profile.union(out)


@register("profile_distinct_exact", union_all(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM {t}" for k in (0, 1) for t, c in each(k)))
def distinct_exact(spark, d):
    return profile.union(profile.distinct_counts(table(spark, d, t), t, n + s).select("table_name", "column_name", "distinct_count") for t, (n, s, _) in STAR.items())


@register("profile_numeric_range", union_all(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, {R6(f'avg({c})')} AS mean_value FROM {t}" for t, c in each(0)))
def numeric_range(spark, d):
    return profile.union(profile.column_facts(table(spark, d, t).select(*n), t).select("table_name", "column_name", "min_value", "max_value", "mean_value") for t, (n, _, _) in STAR.items())


@register("profile_temporal_range", union_all(f"SELECT '{t}' AS table_name, '{c}' AS column_name, strftime(min({c}), '%Y-%m-%dT%H:%M:%SZ') AS min_time, strftime(max({c}), '%Y-%m-%dT%H:%M:%SZ') AS max_time FROM {t}" for t, c in each(2)))
def temporal_range(spark, d):
    return profile.union(profile.column_facts(table(spark, d, t).select(*x), t).select("table_name", "column_name", "min_time", "max_time") for t, (_, _, x) in STAR.items() if x)


TEXTS = [*each(1), ("documents", "text"), ("pages", "url")]


def _texts():
    return {t: [c for x, c in TEXTS if x == t] for t, _ in TEXTS}


@register("profile_text_length", union_all(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(min(length({c})) AS BIGINT) AS min_length, CAST(max(length({c})) AS BIGINT) AS max_length, {R6(f'avg(length({c}))')} AS mean_length FROM {t}" for t, c in TEXTS))
def text_length(spark, d):
    return profile.union(profile.column_facts(table(spark, d, t).select(*c), t).select("table_name", "column_name", "min_length", "max_length", "mean_length") for t, c in _texts().items())


@register("profile_length_p95", union_all(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(quantile_disc(length({c}), 0.95) AS BIGINT) AS p95 FROM {t}" for t, c in TEXTS))
def length_p95(spark, d):
    return profile.union(profile.length_p95(table(spark, d, t), t, c) for t, c in _texts().items())


SHAPED = [("lineitem", "l_extendedprice"), ("lineitem", "l_quantity"), ("events", "value"), ("orders", "o_totalprice")]
_AT = ", ".join(str(i / 16) for i in range(17))


@register("profile_histogram_bounds", union_all(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(i - 1 AS INTEGER) AS bound_no, {R6('b[i]')} AS bound FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), [{_AT}]) AS b FROM {t}), range(1, 18) r(i)" for t, c in SHAPED))
def histogram_bounds(spark, d):
    return _histograms(spark, d).select("table_name", "column_name", F.posexplode("bounds").alias("bound_no", "bound"))


def _histograms(spark, d):
    return profile.union(profile.histogram(table(spark, d, t), t, [c for x, c in SHAPED if x == t]) for t in dict(SHAPED))


_WIDTHS = "list_sort([b[i + 1] - b[i] for i in range(1, 17)])"


@register("profile_histogram_skew", union_all(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CASE WHEN w[9] <= 0 THEN w[16] > 0 ELSE w[16] / w[9] >= 4 END AS is_skewed FROM (SELECT {_WIDTHS} AS w FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), [{_AT}]) AS b FROM {t}))" for t, c in SHAPED))
def histogram_skew(spark, d):
    return _histograms(spark, d).select("table_name", "column_name", "is_skewed")


# --- profile: uniqueness ---------------------------------------------------------

KEYS = {"customer": ["c_custkey", "c_name", "c_acctbal"], "orders": ["o_orderkey", "o_totalprice"], "part": ["p_partkey", "p_name"], "events": ["event_id", "user_id"]}
_KEYS = [(t, c) for t, cs in KEYS.items() for c in cs]


def _unique(spark, d):
    return profile.union(profile.uniqueness(table(spark, d, t), t, c) for t, c in KEYS.items())


@register("profile_unique_probe", union_all(f"SELECT '{t}' AS table_name, '{c}' AS column_name, NOT EXISTS (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1) AS is_unique" for t, c in _KEYS))
def unique_probe(spark, d):
    return _unique(spark, d).select("table_name", "column_name", "is_unique")


@register("profile_duplicate_count", union_all(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) - count(DISTINCT {c}) AS duplicate_rows FROM {t}" for t, c in _KEYS))
def duplicate_count(spark, d):
    return _unique(spark, d).select("table_name", "column_name", "duplicate_rows")


@register("profile_escalation_candidates", union_all(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) / count(*) > 0.95 AS escalate FROM {t}" for t, c in _KEYS))
def escalation(spark, d):
    out = []
    for t, cols in KEYS.items():
        df = table(spark, d, t)
        counts = profile.distinct_counts(df, t, cols).crossJoin(df.agg(F.count("*").alias("row_count")))  # one row
        out.append(counts.select("table_name", "column_name", profile.should_escalate(F.col("distinct_count"), F.col("row_count"), F.lit(False)).alias("escalate")))
    return profile.union(out)


HLL = [("orders", "o_orderkey"), ("orders", "o_custkey"), ("customer", "c_custkey"), ("lineitem", "l_partkey")]
_M64 = "18446744073709551616::UHUGEINT"


def _mix_sql(x: str, shift: int, factor: int) -> str:
    return f"(xor({x}, {x} >> {shift}) * {factor}::UHUGEINT) % {_M64}"


def _hll_sql(t: str, c: str) -> str:
    fold = f"list_reduce(list_prepend({sketch.FNV_OFFSET}::UHUGEINT, [ascii(x)::UHUGEINT for x in string_split(CAST({c} AS VARCHAR), '')]), lambda a, x: (xor(a, x) * {sketch.FNV_PRIME}::UHUGEINT) % {_M64})"
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(least(floor(CASE WHEN raw <= 40960 AND used < 16384 THEN 16384 * ln(16384.0 / (16384 - used)) ELSE raw END + 0.5), seen) AS BIGINT) AS distinct_count FROM (
SELECT 0.7213 / (1 + 1.079 / 16384) * 16384.0 * 16384.0 / (sum(pow(2.0, -r)) + 16384 - count(*)) AS raw, count(*) AS used, sum(n) AS seen FROM (
SELECT reg, max(least(51, CASE WHEN rest = 0 THEN 51 ELSE 64 - floor(log2(CAST(rest AS DOUBLE))) END)) AS r, count(*) AS n FROM (
SELECT h >> 50 AS reg, (h % 1125899906842624::UHUGEINT) * 16384::UHUGEINT AS rest FROM (SELECT xor(h2, h2 >> 31) AS h FROM (SELECT {_mix_sql('h1', 27, sketch.MULTIPLIERS[1])} AS h2 FROM (SELECT {_mix_sql('h0', 30, sketch.MULTIPLIERS[0])} AS h1 FROM (SELECT {fold} AS h0 FROM {t} WHERE {c} IS NOT NULL))))) GROUP BY reg))"""


@register("profile_distinct_hll", union_all(_hll_sql(t, c) for t, c in HLL))
def distinct_hll(spark, d):
    return profile.union(sketch.distinct_hll(table(spark, d, t), [c for x, c in HLL if x == t]).select(F.lit(t).alias("table_name"), "column_name", "distinct_count") for t in dict(HLL))


# --- profile: references, partitions ---------------------------------------------

PAIRS = {
    "orders_customer": ("orders", "o_custkey", "customer", "c_custkey"),
    "lineitem_orders": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "lineitem_part": ("lineitem", "l_partkey", "part", "p_partkey"),
    "lineitem_supplier": ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    "nation_region": ("nation", "n_regionkey", "region", "r_regionkey"),
    "labels_documents": ("labels", "doc_id", "documents", "doc_id"),
}


def _fanout_sql(child: str, fk: str, where: str = "") -> str:
    return f"SELECT count(*) AS parents, {R6('avg(n)')} AS mean, {R6('quantile_cont(n, 0.5)')} AS p50, {R6('quantile_cont(n, 0.95)')} AS p95, max(n) AS max FROM (SELECT count(*) AS n FROM {child} WHERE {fk} IS NOT NULL{where} GROUP BY {fk})"


def _orphan_sql(child: str, fk: str, parent: str, key: str) -> str:
    return f"SELECT count(*) AS children, count(*) FILTER (WHERE k IS NULL) AS orphans, {R6('coalesce(avg(CASE WHEN k IS NULL THEN 1.0 ELSE 0.0 END), 0)')} AS orphan_fraction FROM {child} c LEFT JOIN (SELECT DISTINCT {key} AS k FROM {parent}) p ON c.{fk} = p.k WHERE c.{fk} IS NOT NULL"


for _name, (_child, _fk, _parent, _key) in PAIRS.items():
    register(f"profile_fanout_{_name}", _fanout_sql(_child, _fk))(lambda spark, d, c=_child, fk=_fk: references.fanout(table(spark, d, c), fk))
    register(f"profile_orphan_fraction_{_name}", _orphan_sql(_child, _fk, _parent, _key))(lambda spark, d, c=_child, fk=_fk, p=_parent, k=_key: references.orphan_fraction(table(spark, d, c), fk, table(spark, d, p), k))
register("profile_fanout_events_user", _fanout_sql("events", "user_id"))(lambda spark, d: references.fanout(table(spark, d, "events"), "user_id"))


@register("profile_orphan_fraction_missing_parents", _orphan_sql("lineitem", "l_orderkey", "(SELECT * FROM orders WHERE o_orderkey % 9 <> 0)", "o_orderkey"))
def orphans_missing(spark, d):
    return references.orphan_fraction(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders").where("o_orderkey % 9 <> 0"), "o_orderkey")


@register("profile_fanout_sampled", _fanout_sql("lineitem", "l_orderkey", " AND CAST('0x' || substr(sha256(CAST(l_orderkey AS VARCHAR)), 1, 15) AS BIGINT) % 10000 < 2000"))
def fanout_sampled(spark, d):
    return references.fanout(table(spark, d, "lineitem"), "l_orderkey", 0.2)


def _partition_sql(t: str, key: str) -> str:
    return f"SELECT '{t}' AS table_name, count(*) AS partitions, CAST(sum(n) AS BIGINT) AS row_count, {R6('max(n) / sum(n)')} AS skew FROM (SELECT count(*) AS n FROM {t} GROUP BY {key})"


@register("profile_partition_skew", union_all([_partition_sql("orders", "year(o_orderdate)"), _partition_sql("events", "event_type"), _partition_sql("documents", "source")]))
def partition_skew(spark, d):
    return profile.union([profile.partition_skew(table(spark, d, "orders"), "orders", F.year("o_orderdate")), profile.partition_skew(table(spark, d, "events"), "events", F.col("event_type")), profile.partition_skew(table(spark, d, "documents"), "documents", F.col("source"))])


# --- profile: value sets, classes, JSON ----------------------------------------------

SETS = {"customer": ["c_mktsegment", "c_name"], "orders": ["o_orderstatus", "o_orderpriority"], "events": ["event_type"], "nation": ["n_name"]}


def _set_sql(t: str, c: str) -> str:
    return f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(sum(n) OVER () AS BIGINT) AS total, value, n, {R6('n / sum(n) OVER ()')} AS frequency FROM (SELECT {c} AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE (SELECT count(DISTINCT {c}) FROM {t}) <= 50"


_SETS = union_all(_set_sql(t, c) for t, cs in SETS.items() for c in cs)


@register("profile_value_sets", _SETS)
def value_sets(spark, d):
    return profile.union(profile.value_sets(table(spark, d, t), t, c) for t, c in SETS.items())


@register("privacy_k_gate", f"SELECT table_name, column_name, count(*) AS distinct_count, CAST(min(round(frequency * total)) AS BIGINT) AS least, count(*) <= 50 AND min(round(frequency * total)) >= 20 AS allowed FROM ({_SETS}) GROUP BY table_name, column_name")
def k_gate(spark, d):
    return profile.k_gate(value_sets(spark, d))


CLASSED = {"customer": ["c_name", "c_mktsegment"], "part": ["p_brand", "p_name"], "pages": ["url"], "documents": ["text", "source"], "orders": ["o_orderpriority"], "events": ["event_type"]}


def _share_sql(t: str, c: str) -> str:
    parts = ", ".join(f"coalesce(avg(CASE WHEN regexp_matches({c}, '{p}') THEN 1.0 ELSE 0.0 END), 0) AS {k}" for k, p in classes.CLASSES.items())
    return f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS non_empty, (SELECT count(DISTINCT {c}) FROM {t}) AS distinct_count, {parts}, coalesce(avg(CASE WHEN contains({c}, ' ') AND regexp_matches({c}, '[A-Za-z]') THEN 1.0 ELSE 0.0 END), 0) AS prose FROM {t} WHERE {c} <> ''"


_SHARES = union_all(_share_sql(t, c) for t, cs in CLASSED.items() for c in cs)
_CLASS_CASE = (
    "CASE WHEN non_empty = 0 THEN 'opaque' " + " ".join(f"WHEN {k} >= 0.95 THEN '{k}'" for k in classes.STRONG) + " WHEN distinct_count BETWEEN 1 AND 32 THEN 'enum_like' " + " ".join(f"WHEN {k} >= 0.95 THEN '{k}'" for k in classes.WEAK) + " WHEN prose >= 0.5 THEN 'free_text' ELSE 'opaque' END"
)


@register("profile_format_class", f"SELECT table_name, column_name, {_CLASS_CASE} AS format_class FROM ({_SHARES})")
def format_class(spark, d):
    shares = profile.union(classes.class_shares(table(spark, d, t), t, c) for t, c in CLASSED.items())
    counts = profile.union(profile.distinct_counts(table(spark, d, t), t, c) for t, c in CLASSED.items())
    return classes.format_class(shares, counts)


@register("profile_prose_ratio", f"SELECT table_name, column_name, non_empty, {R6('prose')} AS prose_ratio FROM ({_SHARES})")
def prose_ratio(spark, d):
    return profile.union(classes.class_shares(table(spark, d, t), t, c) for t, c in CLASSED.items()).select("table_name", "column_name", "non_empty", round6(F.col("prose")).alias("prose_ratio"))


@register("profile_json_skeleton", "SELECT path, string_agg(leaf, '|' ORDER BY leaf) AS leaf FROM (SELECT DISTINCT path, CASE WHEN t IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') THEN lower(t) WHEN t = 'VARCHAR' THEN 'string' ELSE 'number' END AS leaf FROM (SELECT '$' AS path, json_type(props) AS t FROM events UNION ALL SELECT '$.' || k AS path, json_type(props, '$.' || k) AS t FROM (SELECT props, unnest(json_keys(props)) AS k FROM events))) GROUP BY path")
def json_skeleton(spark, d):
    return jsonshape.skeleton(table(spark, d, "events"), "props")


_FACT_COLUMNS = {"orders": (["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"])}


def _facts_sql() -> str:
    numbers, texts = _FACT_COLUMNS["orders"]
    rows = []
    for c in numbers + texts:
        facts = {"non_null": f"count({c})", "null_fraction": R6(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)")}
        facts |= {"min_value": f"min({c})", "max_value": f"max({c})", "mean_value": R6(f"avg({c})")} if c in numbers else {"min_length": f"min(length({c}))", "max_length": f"max(length({c}))", "mean_length": R6(f"avg(length({c}))")}
        rows += [f"SELECT 'orders' AS table_name, '{c}' AS column_name, '{k}' AS fact, CAST({v} AS DOUBLE) AS value, 'exact' AS confidence FROM orders" for k, v in facts.items()]
    return union_all(rows)


@register("profile_facts_long", _facts_sql())
def facts_long(spark, d):
    numbers, texts = _FACT_COLUMNS["orders"]
    return profile.facts_long(table(spark, d, "orders").select(*numbers, *texts), "orders")


# --- hydrate -------------------------------------------------------------------------

ROWS = 2000
SEED = 42


def _state_sql(tbl: str, column: str) -> str:
    frame = lambda s: len(s.encode()).to_bytes(8, "big").hex() + s.encode().hex()
    prefix = SEED.to_bytes(8, "big").hex() + frame(tbl) + frame(column)
    return f"CAST('0x' || substr(sha256(unhex('{prefix}' || lpad(hex(i), 16, '0'))), 1, 16) AS UBIGINT)::UHUGEINT"


def _draw_sql(state: str, step: int = 1) -> str:
    add = 0x9E3779B97F4A7C15 * step % 2**64
    s = f"(({state} + {add}::UHUGEINT) % {_M64})"
    a = f"((xor({s}, {s} >> 30) * {0xBF58476D1CE4E5B9}::UHUGEINT) % {_M64})"
    b = f"((xor({a}, {a} >> 27) * {0x94D049BB133111EB}::UHUGEINT) % {_M64})"
    return f"xor({b}, {b} >> 31)"


def _ids(spark):
    return spark.range(0, ROWS).withColumnRenamed("id", "i")


_I = f"(SELECT range AS i FROM range({ROWS}))"


def _numbers_sql(column: str, n: int) -> str:
    return f"CAST({_draw_sql(_state_sql('t', column))} % {n}::UHUGEINT AS BIGINT)"


@register("hydrate_rng_u64", f"SELECT i, CAST({_draw_sql(_state_sql('t', 'a'))} AS VARCHAR) AS u64, CAST({_draw_sql(_state_sql('t', 'a'), 2)} AS VARCHAR) AS second FROM {_I}")
def rng_u64(spark, d):
    from .functions.numbers import draw

    s = hv.state(SEED, "t", "a", F.col("i"))
    text = lambda x: F.conv(F.hex(x), 16, 10)
    return _ids(spark).withColumn("s", s).select("i", text(draw(F.col("s"))).alias("u64"), text(draw(F.col("s"), 2)).alias("second"))


@register("hydrate_null_mask", f"SELECT i, floor((i + 1) * 0.032::DOUBLE) > floor(i * 0.032::DOUBLE) AS is_null FROM {_I}")
def null_mask(spark, d):
    return _ids(spark).select("i", hv.null_at(F.col("i"), 0.032).alias("is_null"))


@register("hydrate_int_bucket", f"SELECT i, {_numbers_sql('b', 97)} AS n, {_numbers_sql('b', 5_000_000_000)} AS wide FROM {_I}")
def int_bucket(spark, d):
    return _ids(spark).withColumn("s", hv.state(SEED, "t", "b", F.col("i"))).select("i", hv.pick(F.col("s"), 97).alias("n"), hv.pick(F.col("s"), 5_000_000_000).alias("wide"))


@register("hydrate_range_ints", f"SELECT i, 18 + {_numbers_sql('age', 500)} % 80 AS v FROM {_I}")
def range_ints(spark, d):
    n = hv.number(F.col("i"), hv.state(SEED, "t", "age", F.col("i")), False, 500)
    return _ids(spark).select("i", hv.in_range(n, 18, 97, False).alias("v"))


@register("hydrate_unique_ints", f"SELECT i, 1000 + i AS v FROM {_I}")
def unique_ints(spark, d):
    return _ids(spark).select("i", hv.in_range(hv.number(F.col("i"), F.lit(0), True, None), 1000, 1100, True).alias("v"))


@register("hydrate_temporal", f"SELECT i, strftime(make_timestamp(1704067200000000 + CAST(floor({_numbers_sql('ts', 365)} / 365.0 * 31536000000000) AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS v FROM {_I}")
def temporal(spark, d):
    n = hv.number(F.col("i"), hv.state(SEED, "t", "ts", F.col("i")), False, 365)
    return _ids(spark).select("i", F.date_format(hv.in_time(n, "2024-01-01 00:00:00 UTC", "2024-12-31 00:00:00 UTC", False, 365), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("v"))


_SPRINTF = {k: v.replace("%", "%") for k, v in hv.TEMPLATES.items()}


@register("hydrate_formats", "SELECT i, " + ", ".join(f"printf('{v}', n) AS {k}" for k, v in _SPRINTF.items() if k != "default") + f", printf('192.0.2.%d', n % 256) AS ipv4 FROM (SELECT i, {_numbers_sql('f', 900)} AS n FROM {_I})")
def formats(spark, d):
    n = hv.number(F.col("i"), hv.state(SEED, "t", "f", F.col("i")), False, 900)
    kinds = [k for k in hv.TEMPLATES if k != "default"] + ["ipv4"]
    return _ids(spark).withColumn("n", n).select("i", *[hv.template(k, F.col("n")).alias(k) for k in kinds])


def _b36(x: str) -> str:
    digits = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST({x} // {36**k} % 36 + 1 AS INTEGER), 1)" for k in range(5, -1, -1))
    return f"CASE WHEN {x} = 0 THEN '0' ELSE ltrim({digits}, '0') END"


@register(
    "hydrate_width_clamp",
    f"""SELECT i, CASE WHEN length(s) <= 8 THEN s ELSE left(s, 8 - length(tail)) || tail END AS v, CASE WHEN length(u) <= 8 THEN u ELSE right(utail, 8) END AS unique_v
FROM (SELECT i, 'sample text ' || n AS s, 'val_' || w AS u, {_b36('n')} AS tail, {_b36('w')} AS utail FROM (SELECT i, i * 1000 AS w, {_numbers_sql('w', 900)} + 40 AS n FROM {_I}))""",
)
def width_clamp(spark, d):
    n = hv.number(F.col("i"), hv.state(SEED, "t", "w", F.col("i")), False, 900) + 40
    rows = _ids(spark).withColumn("n", n).withColumn("w", F.col("i") * 1000)
    return rows.select("i", hv.fit_width(hv.template("free_text", F.col("n")), F.col("n"), 8, False).alias("v"), hv.fit_width(hv.template("default", F.col("w")), F.col("w"), 8, True).alias("unique_v"))


LABELS = ["new", "paid", "sent", "back", "lost"]


@register("hydrate_enum", f"SELECT i, {LABELS}[{_numbers_sql('e', 5)} + 1] AS v FROM {_I}")
def enum(spark, d):
    return _ids(spark).select("i", hv.label(hv.state(SEED, "t", "e", F.col("i")), LABELS).alias("v"))


BOUNDS = [0.0, 1.0, 2.0, 5.0, 10.0, 1000.0]


@register("hydrate_histogram_draw", f"SELECT i, CAST(trunc(b[k] + u * (b[k + 1] - b[k])) AS BIGINT) AS v FROM (SELECT i, {BOUNDS} AS b, CAST({_draw_sql(_state_sql('t', 'h'))} % 5::UHUGEINT AS INTEGER) + 1 AS k, CAST({_draw_sql(_state_sql('t', 'h'), 2)} >> 11 AS DOUBLE) / 9007199254740992.0::DOUBLE AS u FROM {_I})")
def histogram_draw(spark, d):
    return _ids(spark).withColumn("s", hv.state(SEED, "t", "h", F.col("i"))).select("i", hv.histogram_draw(F.col("s"), BOUNDS).alias("v"))


@register("hydrate_check_clamp", f"SELECT i, least(greatest({_numbers_sql('c', 500)}, 100), 300) AS v FROM {_I}")
def check_clamp(spark, d):
    return _ids(spark).select("i", hv.clamp(hv.pick(hv.state(SEED, "t", "c", F.col("i")), 500), 100, 300).alias("v"))


# --- estimates -----------------------------------------------------------------------

GRID = [(op, b, ms, n) for op in estimate.MODELS for b in (0, 1, 1000, 50_000) for ms in (0, 23) for n in (0, 1, 5_000_000)]
_GRID = "(VALUES " + ", ".join(f"('{o}', {b}, {m}, {n})" for o, b, m, n in GRID) + ") g(op, basis_rows, basis_ms, declared)"
_PRED = """CASE WHEN ms <= 0 THEN 0 WHEN d <= 0 THEN ms WHEN op = 'catalog_only' THEN ms
  WHEN op IN ('btree_build', 'index_concurrently') THEN CASE WHEN b <= 1 THEN ms * d ELSE ms * (d * log2(greatest(2, d)) / (b * log2(b))) END
  WHEN b <= 0 THEN ms * d ELSE ms * (d / b) END * CASE WHEN op = 'index_concurrently' THEN 2 ELSE 1 END"""
_BUCKET = "CASE WHEN {x} < 100 THEN 'instant' WHEN {x} < 1000 THEN 'fast' WHEN {x} < 10000 THEN 'noticeable' WHEN {x} < 60000 THEN 'slow' ELSE 'outage' END"


def _grid(spark):
    return spark.createDataFrame(GRID, "op string, basis_rows long, basis_ms long, declared long")


@register("estimate_extrapolate", f"SELECT op, CAST(basis_rows AS BIGINT) AS basis_rows, CAST(basis_ms AS BIGINT) AS basis_ms, CAST(declared AS BIGINT) AS declared, {R6('p')} AS predicted_ms, {_BUCKET.format(x='p')} AS bucket FROM (SELECT *, {_PRED} AS p FROM (SELECT *, basis_rows::DOUBLE AS b, basis_ms::DOUBLE AS ms, declared::DOUBLE AS d FROM {_GRID}))")
def extrapolate(spark, d):
    p = estimate.predicted_ms(F.col("op"), F.col("basis_rows"), F.col("basis_ms"), F.col("declared"))
    return _grid(spark).withColumn("p", p).select("op", "basis_rows", "basis_ms", "declared", round6(F.col("p")).alias("predicted_ms"), estimate.bucket(F.col("p")).alias("bucket"))


@register("estimate_bucket", f"SELECT CAST(range AS BIGINT) AS ms, {_BUCKET.format(x='range')} AS bucket FROM range(0, 70000, 50)")
def buckets(spark, d):
    return spark.range(0, 70000, 50).select(F.col("id").alias("ms"), estimate.bucket(F.col("id")).alias("bucket"))


@register("estimate_reindex", f"SELECT CAST(range AS BIGINT) AS bytes, {_BUCKET.format(x='range / 52428.8')} AS bucket FROM range(0, 4000000000, 10000000)")
def reindex(spark, d):
    return spark.range(0, 4_000_000_000, 10_000_000).select(F.col("id").alias("bytes"), estimate.bucket(estimate.reindex_ms(F.col("id"))).alias("bucket"))


_CAL = "(SELECT 'table_rewrite' AS op, 1000.0::DOUBLE * i AS r1, 10.0 + i AS m1, 2000.0::DOUBLE * i AS r2, 17.0 + 2 * i AS m2, 5000000.0::DOUBLE AS d FROM (SELECT range AS i FROM range(0, 50)))"


@register("estimate_calibrate", f"SELECT CAST(r1 AS BIGINT) AS rows1, {R6('CASE WHEN r1 <> r2 THEN greatest(0, (m2 - m1) / (r2 - r1) * d + m1 - (m2 - m1) / (r2 - r1) * r1) END')} AS predicted_ms FROM {_CAL}")
def calibrate(spark, d):
    g = spark.range(0, 50).select(F.lit("table_rewrite").alias("op"), (F.col("id") * 1000).alias("r1"), (F.col("id") + 10).alias("m1"), (F.col("id") * 2000).alias("r2"), (F.col("id") * 2 + 17).alias("m2"))
    return g.select(F.col("r1").alias("rows1"), round6(estimate.calibrated_ms(F.col("op"), F.col("r1"), F.col("m1"), F.col("r2"), F.col("m2"), F.lit(5_000_000))).alias("predicted_ms"))
