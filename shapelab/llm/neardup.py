"""SimHash near-dedup by similarity: one row of each group of near copies.

Two texts are linked if their sets of five-word shingles share 0.8 or more of their
union.  Every link is decided on the whole sets.  The pairs to decide come from the
deletion-variant index of simhash.py over one fingerprint of the five-word shingles,
and, since fingerprints within three bits are no more than half of the pairs at 0.8
(README), from minimum hashes as well: BANDS bands of ROWS minima each, and texts that
agree in a whole band are compared.  A pair of similarity s is missed by the bands
with a chance of (1 - s**ROWS)**BANDS, 5e-8 at 0.8.  Equal sets are one node and need
no comparison.

Each band's members are compared with one of them first, another one in each band, and
those of one fingerprint with one of them, so a large group of near copies falls together
without its pairs being listed.  Near fingerprints, and what is in one band, are compared
pair by pair if still in different components; in a band only where two
bounds leave room for 0.8: how many shingles of a set stand in any other of these sets
(one that was changed in too many places has too few), and how many residues of its
shingles the other set lacks.  Both hold for every pair, so no link is lost by them.

Defined results: words are split at white space and A-Z lower-cased; a text of one to
four words is one shingle; texts without a word (null, empty, white space) are copies
of one another; texts of any length are taken whole.  Of a group the row with the
smallest key that is not null stays; where keys tie or all are null, that with the
smallest text hash.  Rows that share a key but not a group are judged apart; rows that
repeat key and text are copies, one of which stays.  An empty table stays empty; other
columns pass through whatever their names.  Shingles are told apart by 64 hash bits,
sets and texts by 128.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, distinct, lean, measured_broadcasts, mix64, release, row_slices, stash, unbroadcast
from .simhash import components, links, majority, sharing, shingle_hashes

WIDTH = 5
ROWS, BANDS = 4, 32
WORDS = 16  # of the bitmap of a set
#: Sets of fewer shingles reach 0.8 with equal sets only: 3 of 4 is less.
_LEAST = 4
_FACTORS = mix64(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)
_BAND = mix64(np.arange(1001, 1001 + ROWS, dtype=np.uint64)) | np.uint64(1)


def bands(shingles: np.ndarray) -> np.ndarray:
    """One hash a band of the minima of its ROWS orders of the shingles."""
    low = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), 1024):
        low = np.minimum(low, (_FACTORS[:, None] * shingles[None, a : a + 1024]).min(axis=1))
    return mix64((mix64(low).reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _name(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _lists(arrays) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _prints(docs: DataFrame, key: str) -> DataFrame:
    """key, mark, name of the set, its size, fingerprint and bands, of every row."""

    def run(batches):
        for batch in row_slices(batches, 4 << 20):
            names, sizes, prints, found = [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                hashes = shingle_hashes(text.as_py() or b"", WIDTH)
                shingles = distinct(hashes)
                names.append(_name(shingles))
                sizes.append(len(shingles))
                prints.append(majority(hashes))
                found.append(bands(shingles).view(np.int64) if len(shingles) >= _LEAST else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("__mark"), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), _lists(found)], names=[key, "__mark", "name", "size", "fp", "bands"]
            )

    rows = docs.select(key, "text", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("__mark"))
    return rows.mapInArrow(lean(run), f"`{key}` {dict(docs.dtypes)[key]}, __mark string, name binary, size int, fp long, bands array<long>")


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    """Which of 64 x WORDS residues the shingles have, as numbers of 64 bits."""
    seen = np.zeros(64 * WORDS, bool)
    seen[(shingles % np.uint64(64 * WORDS)).astype(np.int64)] = True
    return np.packbits(seen, bitorder="little").view(np.int64)


def _sets(texts: DataFrame) -> DataFrame:
    """name of each text's set, its shingles and their bitmap."""

    def run(batches):
        for batch in row_slices(batches, 4 << 20):
            found = [distinct(shingle_hashes(text.as_py() or b"", WIDTH)) for text in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in found], pa.binary()), _lists([x.view(np.int64) for x in found]), _lists([_bitmap(x) for x in found])], names=["name", "shingles", "bits"])

    return texts.select("text").mapInArrow(lean(run), "name binary, shingles array<long>, bits array<long>")


def _near_sizes(x, y):
    """Sets of sizes further apart cannot share 0.8 of their union."""
    return 5 * F.least(x, y) >= 4 * F.greatest(x, y)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets share 0.8 of their union, in whole numbers:
    i / (x + y - i) >= 4 / 5."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(9 * shared >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def _shared_sizes(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """nodes(node, size) that can be linked with one another, and `common`, how many of their
    shingles stand in another of these sets, as a stashed table.  What two sets share is
    common, so a set with fewer than 0.8 of common shingles has no partner; without those
    sets, others have fewer common shingles still."""
    now = stash(nodes)
    for _ in range(3):
        each = now.join(sets, "node").select("node", F.explode("shingles").alias("shingle"))
        alone = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
        common = F.col("size") - F.coalesce("alone", F.lit(0))
        then = stash(now.select("node", "size").join(alone, "node", "left").select("node", "size", common.alias("common")).where(5 * F.col("common") >= 4 * F.col("size")))
        release(now)
        now = then
    return now


def _pairs_of(found: DataFrame) -> DataFrame:
    return found.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _leads(nodes: DataFrame) -> DataFrame:
    """fp and one node, lead, of each fingerprint, with its size, as a stashed table."""
    one = F.min(F.struct(F.col("node").alias("lead"), F.col("size").alias("lead_size"))).alias("l")
    return stash(nodes.where(F.col("size") >= _LEAST).groupBy("fp").agg(one).select("fp", "l.*"))


def _near_prints(leads: DataFrame, near: DataFrame) -> DataFrame:
    """(x, y): leads of the fingerprints (a, b) that are near."""
    ends = near.join(leads.select(F.col("fp").alias("a"), F.col("lead").alias("x"), F.col("lead_size").alias("sx")), "a").join(leads.select(F.col("fp").alias("b"), F.col("lead").alias("y"), F.col("lead_size").alias("sy")), "b")
    return ends.where(_near_sizes(F.col("sx"), F.col("sy"))).select("x", "y")


@measured_broadcasts
def grouped(docs: DataFrame, key: str = "doc_id"):
    """((key, __mark, root) of every row of docs(key, text), the tables it reads): rows of one
    root are near copies; __mark is a hash of the text."""
    bound_batches(docs.sparkSession)
    prints = stash(_prints(docs, key))
    named = prints.groupBy("name").agg(F.min(F.struct(key, "__mark")).alias("one"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = stash(named.withColumn("node", F.monotonically_increasing_id()))
    rows = nodes.select("node", "size", F.explode("bands").alias("band"))
    lead = F.min_by(F.struct(F.col("node").alias("lead"), F.col("size").alias("lead_size")), F.xxhash64("node", "band")).alias("l")
    shared = rows.groupBy("band").agg(F.count("*").alias("n"), lead).where("n > 1").select("band", "l.*")
    members = stash(unbroadcast(rows).join(shared, "band"))
    leads = _leads(nodes)
    close = sharing(leads.select("fp"))
    by_band = members.where(_near_sizes(F.col("size"), F.col("lead_size"))).select(F.col("node").alias("x"), F.col("lead").alias("y"))
    by_print = nodes.where(F.col("size") >= _LEAST).join(leads, "fp").where(_near_sizes(F.col("size"), F.col("lead_size"))).select(F.col("node").alias("x"), F.col("lead").alias("y"))
    first = stash(_pairs_of(by_band.union(by_print)))

    wanted = members.select("node").union(first.select("a")).union(first.select("b")).union(leads.join(close.select("fp").distinct(), "fp").select("lead")).distinct().join(nodes.select("node", "name", "one"), "node")
    texts = docs.select(key, "text").join(wanted.select(F.col(f"one.{key}").alias("__least_key"), F.col("one.__mark").alias("__least_mark")).distinct(), F.col(key).eqNullSafe(F.col("__least_key")) & (F.md5(F.coalesce(F.col("text"), F.lit(""))) == F.col("__least_mark")), "left_semi")
    sets = stash(_sets(texts).dropDuplicates(["name"]).join(wanted.select("node", "name"), "name").select("node", "shingles", "bits"))

    alike = stash(_similar(first, sets))
    tree = components(alike)
    root = stash(nodes.select("node").join(tree.select("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    placed = members.select("band", "node", "size").join(root, "node")
    mixed = placed.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("band")
    apart = stash(placed.join(mixed, "band", "left_semi"))
    able = _shared_sizes(apart.select("node", "size").distinct(), sets)
    facts = able.select("node", "common").join(sets.select("node", "bits"), "node").join(nodes.select("node", "bands"), "node")
    left = stash(apart.join(facts, "node"))
    names = {"root": "r", "node": "", "size": "s", "common": "c", "bits": "m", "bands": "l"}
    x, y = (left.select("band", *[F.col(a).alias(b + c) for a, b in names.items()]) for c in "xy")
    lacking = lambda a, b: sum((F.bit_count(F.col(a)[i].bitwiseAND(F.bitwise_not(F.col(b)[i]))) for i in range(WORDS)), F.lit(0))  # noqa: E731  of one set in the other, at least
    most = F.least("cx", "cy", F.col("sx") - lacking("mx", "my"), F.col("sy") - lacking("my", "mx"))
    once = F.array_intersect("lx", "ly")[0] == F.col("band")  # a pair that shares several bands is named in one
    rest = x.join(y, "band").where((F.col("x") < F.col("y")) & (F.col("rx") != F.col("ry")) & (9 * F.least("cx", "cy") >= 4 * (F.col("sx") + F.col("sy"))) & (9 * most >= 4 * (F.col("sx") + F.col("sy"))) & once)
    near = links(leads.select("fp"), shared=close, labels=leads.join(root.withColumnRenamed("node", "lead"), "lead").select("fp", F.col("root").alias("label")))
    rest = stash(_pairs_of(rest.select("x", "y").union(_near_prints(leads, near))).join(first, ["a", "b"], "left_anti"))
    more = _similar(rest, sets).join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    more = stash(more.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    above = components(more)
    release(members, leads, close, near, sets, first, alike, tree, apart, able, left, rest, more)

    top = root.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    rooted = stash(nodes.select("node", "name").join(top, "node").select("name", "root"))
    release(above, root, nodes)
    return prints.select(key, "__mark", "name").join(rooted, "name").select(key, "__mark", "root"), [prints, rooted]


@measured_broadcasts
def one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, as they are."""
    named, used = grouped(docs.select(key, "text"), key)
    row = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.col("__mark").alias("mark"))
    named = stash(named.groupBy("root", key, "__mark").agg(F.count("*").alias("rows")))
    release(*used)
    kept = named.groupBy("root").agg(F.min(row).alias("kept"))
    judged = named.join(kept, "root").select(F.col(key).alias("__judged_key"), F.col("__mark").alias("__judged_mark"), "rows", row.eqNullSafe(F.col("kept")).alias("stays"))
    gone = cut(judged.where("not stays or rows > 1"))
    release(named)
    mark = F.md5(F.coalesce(F.col("text"), F.lit("")))
    this = F.col(key).eqNullSafe(F.col("__judged_key")) & (mark == F.col("__judged_mark"))
    out = docs.join(gone.select("__judged_key", "__judged_mark"), this, "left_anti")
    twice = gone.where("stays").select("__judged_key", "__judged_mark")
    if twice.isEmpty():
        return out
    again = docs.join(twice, this, "left_semi").withColumn("__mark", mark).dropDuplicates([key, "__mark"]).drop("__mark")
    return out.unionByName(again)
