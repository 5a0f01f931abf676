"""SimHash near-duplicate groups through deletion-variant signatures.

A text's fingerprint has bit i set if more than half of its shingle hashes have
it set.  Two fingerprints that differ in at most three bits are linked.  The 64
bits are cut into two segments only, so one of them differs by one bit at most:
each fingerprint is indexed under either segment as it is and with each one of
its bits deleted, and equal signatures are joined.  A signature with a deleted
bit joins only fingerprints that differ in that bit, so nothing is joined twice
over.  Every pair is verified by its differing bits.

A signature that more than `limit` fingerprints share is not joined.  Its members
are indexed anew with the other bits cut in two by the same rule, again and again
if need be; after three times at most 2**8 fingerprints can share a signature.
So no group is ever expanded into all its pairs and no link is lost.

Connected components come from hooking, pointer jumping and contraction over tables;
links, labels and fingerprints stay distributed.

Defined results: texts without a word (null, empty, white space) have the
fingerprint zero and are linked like any other; a text of any length is taken
whole; rows that repeat a fingerprint are one node, so repeated rows and ties in
the fingerprint are one group; component_id is the smallest doc_id that is not
null, or null where a group has none.  An empty table gives an empty result.  Only
the key and text are read, so other columns may have any names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, lean, measured_broadcasts, release, row_slices, shuffle_partitions, stash, unbroadcast

SEED = 42
_HALF = 32
_BIT_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of width words, lower-cased in A-Z, joined by one space."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate([[0], stop[:-1] + 1])
    if len(words) < width:
        pairs = [(0, len(text))]
    else:
        pairs = zip(begin[: len(words) - width + 1].tolist(), stop[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], SEED) for a, b in pairs), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    planes = hashes.view(np.uint8).reshape(-1, 8)
    count = np.concatenate([np.bincount(planes[:, j], minlength=256) @ _BIT_TABLE for j in range(8)])
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", width: int = 3) -> DataFrame:
    """key and fp, the fingerprint, of every row."""

    def run(batches):
        for batch in row_slices(batches, 4 << 20):
            found = [majority(shingle_hashes(text.as_py() or b"", width)) for text in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.int64())], names=[key, "fp"])

    return docs.select(key, "text").mapInArrow(lean(run), f"`{key}` {dict(docs.dtypes)[key]}, fp long")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _first_variants(nodes: DataFrame) -> DataFrame:
    """(fp, mask, wild, last, lo, width): the bits compared, all deleted bits, the last of
    them, and the place of the bits that are still free."""
    kinds = []
    for lo in (0, _HALF):
        segment = ((1 << _HALF) - 1) << lo
        for bit in [0] + [1 << (lo + j) for j in range(_HALF)]:
            kinds.append(F.struct(F.lit(_signed(segment & ~bit)).alias("mask"), F.lit(_signed(bit)).alias("wild"), F.lit(_signed(bit)).alias("last"), F.lit(_HALF - lo).alias("lo"), F.lit(_HALF).alias("width")))
    return nodes.select("fp", F.inline(F.array(*kinds)))


def _next_variants(members: DataFrame) -> DataFrame:
    """Cuts the free bits in two; one half differs by one bit at most."""
    half = F.col("width") / 2
    split = members.withColumn("half", half.cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), 2 * F.col("half") + 1)))
    split = split.withColumn("h", F.floor(F.col("c") / (F.col("half") + 1)).cast("int")).withColumn("j", (F.col("c") % (F.col("half") + 1) - 1).cast("int"))
    split = split.withColumn("at", F.col("lo") + F.col("h") * F.col("half"))
    bits = F.expr("shiftleft(shiftleft(1L, half) - 1L, at)")
    bit = F.expr("case when j >= 0 then shiftleft(1L, at + j) else 0L end")
    split = split.withColumn("bit", bit).withColumn("part", bits.bitwiseAND(F.bitwise_not(F.col("bit"))))
    return split.select(
        "fp",
        F.col("mask").bitwiseOR(F.col("part")).alias("mask"),
        F.col("wild").bitwiseOR(F.col("bit")).alias("wild"),
        F.when(F.col("bit") != 0, F.col("bit")).otherwise(F.col("last")).alias("last"),
        (F.col("lo") + (1 - F.col("h")) * F.col("half")).cast("int").alias("lo"),
        F.col("half").alias("width"),
    ).distinct()


_PLACE = ["mask", "wild", "sig"]


def _sharing(variants: DataFrame) -> DataFrame:
    """The variants whose signature another fingerprint can be linked by, as a stashed table."""
    rows = variants.withColumn("sig", F.col("fp").bitwiseAND(F.col("mask"))).withColumn("side", F.col("fp").bitwiseAND(F.col("last")) != 0)
    sizes = rows.groupBy(*_PLACE).agg(F.count("*").alias("n"), F.min("side").alias("s0"), F.max("side").alias("s1"))
    shared = sizes.where((F.col("n") > 1) & ((F.col("wild") == 0) | (F.col("s0") != F.col("s1")))).select(*_PLACE, "n")
    return stash(unbroadcast(rows).join(shared, _PLACE))  # many times the rows that Spark has measured


@measured_broadcasts
def sharing(nodes: DataFrame) -> DataFrame:
    """The signatures that distinct values fp share, as a stashed table; links() starts from it."""
    # Few bytes become many rows: dealt out before, so that all tasks share the expansion.
    return _sharing(_first_variants(nodes.select("fp").repartition(4 * shuffle_partitions(nodes.sparkSession), "fp")))


def _of_several(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with label, of signatures that stand under several labels."""
    known = members.join(labels, "fp")
    mixed = known.groupBy(*_PLACE).agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 != l1").select(*_PLACE)
    return stash(known.join(mixed, _PLACE))


@measured_broadcasts
def links(nodes: DataFrame, distance: int = 3, limit: int = 64, shared: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of the distinct values fp that differ in at most
    three bits (or fewer, by distance), as a stashed table.  shared is what sharing() gave for
    them, if it has run; with labels(fp, label) pairs of one label are not listed."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments leave one with one differing bit only up to distance 3")
    members, found = sharing(nodes) if shared is None else shared, []
    used = [members] if shared is None else []
    for depth in range(4):
        if labels is not None:
            members = _of_several(members, labels)
            used.append(members)
        small = members.where(F.col("n") <= limit) if depth < 3 else members
        label = ["label"] if labels is not None else []
        a = small.where((F.col("wild") == 0) | ~F.col("side")).select(*_PLACE, F.col("fp").alias("a"), *[F.col(x).alias("la") for x in label])
        b = small.where((F.col("wild") == 0) | F.col("side")).select(*_PLACE, F.col("fp").alias("b"), *[F.col(x).alias("lb") for x in label])
        differ = F.col("a").bitwiseXOR(F.col("b"))
        apart = (F.col("wild") != 0) | (F.col("a") < F.col("b"))
        if label:
            apart = apart & (F.col("la") != F.col("lb"))
        verified = (F.bit_count(differ) <= distance) & (differ.bitwiseAND(F.col("wild")) == F.col("wild"))
        found.append(a.join(b, _PLACE).where(apart & verified).select("a", "b"))
        large = members.where(F.col("n") > limit)
        if depth == 3 or large.isEmpty():
            break
        members = _sharing(_next_variants(large.select("fp", "mask", "wild", "last", "lo", "width")))
        used.append(members)
    pairs = stash(reduce(DataFrame.union, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    release(*used)
    return pairs


@measured_broadcasts
def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b), as a stashed table; root is the least node
    reachable.  Each round hooks nodes to their least neighbours and halves the paths until
    the trees are flat; then only edges between trees are left, by the trees' roots."""
    left, rooted = stash(edges.select("a", "b").distinct()), None
    while True:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")))
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            step = stash(parent.select("node", "root").join(up, "root").select("node", F.col("root").alias("old"), F.col("top").alias("root")))
            release(parent)
            parent = step
            if step.where(F.col("root") != F.col("old")).isEmpty():
                break
        top_a, top_b = (parent.select(F.col("node").alias(x), F.col("root").alias(f"top_{x}")) for x in "ab")
        between = left.join(top_a, "a").join(top_b, "b").where("top_a != top_b")
        then = stash(between.select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct())
        if rooted is None:
            rooted = parent
        else:
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            whole = stash(rooted.select("node", "root").join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
            release(rooted, parent)
            rooted = whole
        release(left)
        left = then
        if left.isEmpty():
            release(left)
            return rooted


@measured_broadcasts
def groups(prints: DataFrame, key: str = "doc_id", distance: int = 3, limit: int = 64) -> DataFrame:
    """prints(key, fp) with component_id: the smallest key of a component names it."""
    nodes = stash(prints.groupBy("fp").agg(F.min(key).alias("least")))
    pairs = links(nodes.select("fp"), distance, limit)
    root = components(pairs)
    rooted = nodes.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(least, "root").select("fp", "component_id"))
    release(nodes, pairs, root)
    return prints.join(unbroadcast(named), "fp").select(key, "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", width: int = 3, distance: int = 3, limit: int = 64) -> DataFrame:
    """key, fp, component_id for every row of docs."""
    bound_batches(docs.sparkSession)
    return groups(cut(fingerprints(docs, key, width)), key, distance, limit)
