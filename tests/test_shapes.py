"""Profile, sketch and hydration on small tables with known facts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelab.functions.numbers import add64, mul64, modulo, signed
from shapelab.hydrate import engine, fanout
from shapelab.operators import jsonshape, profile, references, sketch
from shapelab.sources.scripts import read_scripts, runner


def test_wrapping_arithmetic(spark):
    rng = random.Random(1)
    pairs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(200)] + [(2**64 - 1, 2**64 - 1), (0, 0), (2**63, 2**63)]
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
    k = 0xBF58476D1CE4E5B9
    got = df.select(add64(F.col("a"), F.col("b")), mul64(F.col("a"), k), modulo(F.col("a"), 97), modulo(F.col("a"), 10**12)).collect()
    assert [tuple(r) for r in got] == [(signed((a + b) % 2**64), signed(a * k % 2**64), a % 97, a % 10**12) for a, b in pairs]


@pytest.mark.parametrize("n", [100, 5000, 60_000])
def test_sketch_error_and_repeats(spark, n):
    df = spark.range(n).select(F.concat(F.lit("value-"), "id").alias("v"))
    got = sketch.distinct_hll(df.union(df), ["v"]).first().distinct_count
    assert abs(got - n) <= 3 * sketch.ERROR * n


def test_sketch_hash_and_ranks():
    h = sketch.hash_bytes(np.frombuffer(b"abc", np.uint8), np.array([0, 3, 3]))
    x = sketch.FNV_OFFSET
    for b in b"abc":
        x = (x ^ b) * sketch.FNV_PRIME % 2**64
    for s, m in ((30, sketch.MULTIPLIERS[0]), (27, sketch.MULTIPLIERS[1])):
        x = (x ^ (x >> s)) * m % 2**64
    assert int(h[0]) == x ^ (x >> 31)
    at, rank = sketch.ranks(np.array([1, 2**64 - 1, 2**49, 0], np.uint64))
    assert at.tolist() == [0, 16383, 0, 0] and rank.tolist() == [50, 1, 1, 51]


def test_facts_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "ab", None), (2, None, None), (2, "", None)], "n int, s string, d date")
    rows = {r.column_name: r for r in profile.column_facts(df, "t").collect()}
    assert rows["s"].null_fraction == 0.333333 and rows["s"].min_length == 0 and rows["d"].null_fraction == 1.0 and rows["d"].min_time is None
    empty = {r.column_name: r for r in profile.column_facts(df.limit(0), "t").collect()}
    assert empty["n"].null_fraction == 0.0 and empty["n"].row_count == 0 and empty["n"].min_value is None
    assert {r.column_name: r.is_unique for r in profile.uniqueness(df, "t", ["n", "s"]).collect()} == {"n": False, "s": True}


def test_fanout_and_orphans(spark):
    child = spark.createDataFrame([(u,) for u in [1] * 500 + [2] * 40 + [3] * 10 + [77] * 11] + [(None,)], "u int")
    parent = spark.createDataFrame([(1,), (1,), (2,), (3,)], "id int")
    f = references.fanout(child, "u").first()
    assert (f.parents, f["max"], f.p50) == (4, 500, 25.5)
    o = references.orphan_fraction(child, "u", parent, "id").first()
    assert (o.children, o.orphans, o.orphan_fraction) == (561, 11, 0.019608)
    assert references.orphan_fraction(child.limit(0), "u", parent, "id").first().orphan_fraction == 0.0


def test_json_skeleton_has_no_values(spark):
    rows = [('{"a": 1, "b": {"c": "x", "d": [1, 2]}}',), ('{"a": "s", "b": {"c": true}}',), ('{"b": 3}',), ("no json",), (None,)]
    got = {r.path: r.leaf for r in jsonshape.skeleton(spark.createDataFrame(rows, "j string"), "j").collect()}
    assert got == {"$": "object", "$.a": "number|string", "$.b": "mixed", "$.b.c": "boolean|string", "$.b.d": "array", "$.b.d[]": "number"}


@pytest.mark.parametrize("children, parents, shape", [(20_000, 1000, (20, 5, 100, 800)), (100, 7, (3, 2, 9, 50)), (5, 10, (3, 2, 9, 50)), (1000, 3, (None, None, None, None)), (500, 400, (1.2, 1, 2, 400)), (50, 60, (1, 9, 9, 9))])
def test_children_are_all_assigned_once(spark, children, parents, shape):
    got = fanout.assign(spark, children, parents, children, fanout.Shape(*shape)).toPandas()
    assert sorted(got.child) == list(range(children)) and got.parent.between(0, parents - 1).all()


def test_long_tail_is_reproduced(spark):
    made = fanout.assign(spark, 20_000, 1000, 20_000, fanout.Shape(20, 5, 100, 800))
    f = references.fanout(made, "parent").first()
    assert 5 / 2.5 <= f.p50 <= 7.5 and 40 <= f.p95 <= 150 and 320 <= f["max"] <= 1200 and f["max"] >= 5 * f["mean"]


_OWNERS = engine.TableShape("o", 50, [engine.ColumnShape("id", "bigint", unique=True, low=1000)])


def _table(rows=3000):
    c = engine.ColumnShape
    return engine.TableShape("public.a", rows, [c("id", "bigint", unique=True, low=1), c("email", "text", 0.1, distinct=900, format_class="email"), c("n", "int", low=5, high=9, check=(6, 8)), c("owner", "bigint", reference=engine.Reference(_OWNERS, "id", None, 0.02))])


def test_rows_depend_on_seed_and_ordinal_only(spark):
    a = engine.generate(spark, _table(), 42)
    b = engine.generate(spark, _table(), 42, scale=0.5).repartition(17)
    rows = {r.ordinal: r for r in a.collect()}
    assert len(rows) == 3000 and all(rows[r.ordinal].email == r.email and rows[r.ordinal].n == r.n for r in b.collect())
    assert a.select("email").exceptAll(engine.generate(spark, _table(), 43).select("email")).count() > 500
    assert engine.conformance(a.drop("owner"), engine.TableShape("t", 0, _table().columns[:3])).count() == 0
    assert a.agg(F.min("n"), F.max("n")).first() == (6, 8)
    assert references.orphan_fraction(a, "owner", engine.generate(spark, _OWNERS, 42), "id").first().orphan_fraction == 0.02


def test_loaded_tables_refer_to_one_another(spark, tmp_path):
    missed = engine.load(spark, [_table(500), _OWNERS], str(tmp_path), 42)
    assert missed == {"public.a.owner": 0} and [t.name for t in engine.load_order([_table(), _OWNERS])] == ["o", "public.a"]
    with pytest.raises(engine.BudgetError):
        engine.load(spark, [_table(500)], str(tmp_path), 42, max_cells=1999)
    with pytest.raises(engine.UnsupportedTypeError, match="t.x"):
        engine.generate(spark, engine.TableShape("t", 5, [engine.ColumnShape("x", "int4multirange")]), 1)
    assert engine.resolve_type("a", {"a": "b", "b": "text"}) == "text" and engine.resolve_type("a", {"a": "a"}) == "a"


def test_a_whale_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(fanout, "BLOCK", 7)
    made = fanout.assign(spark, 100, 5, 100, fanout.Shape(20, 1, 1, 90)).toPandas()
    assert sorted(made.child) == list(range(100)) and made.groupby("parent").size().max() > 80


def test_unsupported_types_are_named(spark):
    with pytest.raises(engine.UnsupportedTypeError, match="t.x"):
        engine.generate(spark, engine.TableShape("t", 5, [engine.ColumnShape("x", "tsvector")]), 1)


def test_scripts_are_read_in_order(spark, tmp_path):
    (tmp_path / "b.sql").write_text("DROP TABLE b;")
    (tmp_path / "a.sql").write_text("TRUNCATE a;")
    (tmp_path / "c.txt").write_text("no")
    assert [(r.file, r.kind) for r in read_scripts(spark, str(tmp_path)).orderBy("idx").collect()] == [("a.sql", "truncate"), ("b.sql", "drop_table")]
    assert runner(["x.py", "alembic.ini"]) == "alembic" and runner([]) is None


def test_streamed_parts_merge_to_the_whole(spark, tmp_path):
    from shapelab.streaming import incremental

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(100).selectExpr("id", "id % 7 AS v").repartition(3).write.parquet(source)
    stream = spark.readStream.schema("id long, v long").option("maxFilesPerTrigger", 1).parquet(source)
    query = incremental.start(stream, "t", out, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    got = {r.column_name: r for r in incremental.merge(spark.read.parquet(out).drop("batch")).collect()}
    assert (got["v"].row_count, got["v"].min_value, got["v"].max_value) == (100, 0.0, 6.0)


def test_registered_json_skeleton_reaches_every_level(spark, tmp_path):
    from shapelab import registry

    doc = "1"
    for _ in range(12):
        doc = '{"k": ' + doc + "}"
    spark.createDataFrame([(doc,), (None,), ('{"a": [{"b": true}]}',)], "props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.path: r.leaf for r in registry.QUERIES["profile_json_skeleton"](spark, str(tmp_path)).collect()}
    assert got["$" + ".k" * 12] == "number" and got["$.a[].b"] == "boolean" and len(got) == 16
