"""Removal of repeated long passages through a compacted De Bruijn graph of words.

Every run of k words is an edge.  A graph of all edges is never shuffled: an
edge goes to the bucket of its minimizer (the least hash of the m-word runs
within it), so neighbouring edges travel together as one span and equal edges
meet.  In a bucket the edges that occur more than once are kept, each with its
first source coordinate (document, word), and runs of neighbouring repeated
edges with neighbouring first coordinates, the nonbranching paths inside the
bucket, become one row.  Paths that go on in another bucket are then compacted
by Spark joins on (source, target, diagonal, end = start).  What comes out are
long repeated spans with the coordinates of both places.

Edges are compared by 64 bits over all k words.  That makes candidates only: each
path is then cut at fixed places of its source, the source texts give a 128-bit
digest of the words of each piece, and the texts with repeats compare it with
their own words at their own coordinate.  The edges of a piece whose words differ
are decided again by the digests of their own k words.  So a word goes only where
the words of its window stand earlier, whatever the hashes do.

Skew: equal spans within HOLD bytes of text are reduced to the first before the
shuffle (the later ones are known to be repeats at once), so a passage that a
third of all rows share reaches its bucket once for each HOLD.  A first pass
counts how many different spans lie under each minimizer; the edges of those with
very many (a phrase in ever new surroundings) are dealt out one by one by their
own hash, at most 2**20 such minimizers whatever the size of the corpus.

Defined results: null and empty texts have no words.  Documents are ordered by
doc_id, nulls first; an id may be of any type that sorts.  Rows that repeat doc_id
and text are one document and get the same result, rows that share only the doc_id
are ordered by a text hash.  Equal windows are ties that the smallest coordinate
wins.  A text of any length is taken whole; one longer than SLICE is hashed alone,
piece by piece.  An empty table gives an empty result.  remove_repeats passes other
columns through whatever their names, but for text and the one that counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, bound_batches, cut, distinct, lean, mix64, release, rolling, row_slices, sha256, shuffle_partitions, sliding_min, stash, trim, utf8_view, word_bounds

SLICE = 4 << 20  # bytes hashed at once
HOLD = 32 << 20  # bytes whose spans are compared with one another before the shuffle
PART = 64 << 20  # bytes of text for each partition of the shuffle at most
BUCKETS = 8  # buckets for each of them, which evens out what hashing deals to one partition
HOT = 1 << 13  # different spans under one minimizer, from which on they are dealt out
MOST_HOT = 1 << 20  # hot minimizers at most; HOT grows with the corpus to that end
PIECE = 64  # edges of a path that are verified together
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_RUN = "copy long, doc long, mark long, start int, n int, f_doc long, f_mark long, f_start int"
_COLUMNS = ["copy", "doc", "mark", "start", "n", "f_doc", "f_mark", "f_start"]


def numbering(docs: DataFrame, key: str) -> DataFrame | None:
    """Numbers of ids that are no whole numbers, in their order; None for whole numbers."""
    if isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return None
    return cut(docs.select(F.col(key).alias("__key")).distinct().orderBy("__key").withColumn("__number", F.monotonically_increasing_id()))


def coordinates(docs: DataFrame, numbers: DataFrame | None, key: str = "doc_id", doc: str = "doc", mark: str = "mark") -> DataFrame:
    """docs with the coordinate (doc, mark): the id or its number, nulls least, and a hash of the text."""
    hashed = F.xxhash64(F.coalesce("text", F.lit("")), F.col(key).isNull())
    if numbers is None:
        return docs.withColumn(doc, F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))).withColumn(mark, hashed)
    numbered = docs.join(numbers.withColumnRenamed("__number", doc), F.col(key).eqNullSafe(F.col("__key")))
    return numbered.drop("__key").withColumn(mark, hashed)


# The arrays of a block, in order, with their types.
_LAYOUT = [np.dtype(t) for t in ("i8", "i8", "i8", "u4", "u4", "u4", "u8", "u4", "u4", "u4", "u4", "u4")]


def pack(arrays) -> bytes:
    """Arrays of _LAYOUT as one compressed block; whole bytes of a place stand together."""
    out = [np.array([len(x) for x in arrays], np.uint32).tobytes()]
    for x, kind in zip(arrays, _LAYOUT):
        if len(x):
            out.append(np.ascontiguousarray(x, kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(block: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(block), 4 * len(_LAYOUT), []
    for n, kind in zip(np.frombuffer(raw, np.uint32, len(_LAYOUT)).tolist(), _LAYOUT):
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def edge_spans(hasher, data, offsets, k: int, m: int):
    """Spans of neighbouring edges with one minimizer: (row, start, n, minimizer) and
    the 64 check bits of the edges, span after span."""
    code, _, _, row = hasher(data, offsets)
    n = len(code) - k + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least = sliding_min(rolling(code, m, _A), k - m + 1)
    ok = row[:n] == row[k - 1 :]
    same = np.zeros(n, bool)
    same[1:] = (least[1:] == least[:-1]) & ok[1:] & ok[:-1] & (row[1:n] == row[: n - 1])
    first = np.flatnonzero(ok & ~same)
    edges = np.flatnonzero(ok)
    length = np.diff(np.append(np.searchsorted(edges, first), len(edges)))
    begin = np.searchsorted(row, np.arange(len(offsets) - 1))
    return row[first], first - begin[row[first]], length, least[first], rolling(code, k, _B)[edges]


def content(n, check, at):
    """A hash of the edges of each span and their order."""
    sums = np.zeros(len(check) + 1, np.uint64)
    np.cumsum(mix64(check[1:] + np.uint64(_A) * check[:-1]), out=sums[2:])
    return mix64(check[at]) + sums[at + n] - sums[at + 1]


def crowded(k: int, m: int, seed: int):
    """Arrow batches of text -> (minimizer, spans, bytes): minimizers with two or more
    different spans in HOLD bytes; one row more for the bytes."""

    def run(batches):
        hasher, held, size = WordHasher(seed), [], 0
        for batch in row_slices(batches, SLICE):
            data, offsets = utf8_view(batch.column("text"))
            _, _, n, least, check = edge_spans(hasher, data, offsets, k, m)
            held.append((least, content(n, check, np.cumsum(n) - n)))
            size += len(data)
            if size >= HOLD:
                yield flush(held, size)
                held, size = [], 0
        if held:
            yield flush(held, size)

    def flush(held, size):
        least, total = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        by = np.lexsort((total, least))
        least, total = least[by], total[by]
        new = np.ones(len(by), bool)
        new[1:] = (least[1:] != least[:-1]) | (total[1:] != total[:-1])
        value, count = np.unique(least[new], return_counts=True)
        value, count = value[count > 1], count[count > 1]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(value.view(np.int64), 0)), pa.array(np.append(count, 0)), pa.array(np.append(np.zeros(len(value), np.int64), size))], names=["minimizer", "spans", "bytes"]
        )

    return lean(run)


def hot_minimizers(texts: DataFrame, k: int, m: int, seed: int):
    """(sorted hot minimizers, bytes of all texts).  A span has a byte at least, so the limit
    leaves MOST_HOT of them at most, 8 MB."""
    counted = stash(texts.select("text").mapInArrow(crowded(k, m, seed), "minimizer long, spans long, bytes long"))
    size = int(counted.agg(F.sum("bytes")).first()[0] or 0)
    limit = max(HOT, size // MOST_HOT)
    hot = counted.groupBy("minimizer").agg(F.sum("spans").alias("spans")).where(F.col("spans") >= limit).select("minimizer").toArrow()
    release(counted)
    return np.sort(hot["minimizer"].to_numpy().view(np.uint64)), size


def span_blocks(k: int, m: int, buckets: int, seed: int, shared):
    """Arrow batches of (doc, mark, text) -> (bucket, block)."""

    def run(batches):
        hot = np.frombuffer(shared.value, np.uint64)
        hasher, held, size = WordHasher(seed), [], 0
        copy = TaskContext.get().partitionId() << 24  # tells rows of one document in different blocks apart
        for batch in row_slices(batches, SLICE):
            data, offsets = utf8_view(batch.column("text"))
            held.append((batch.column("doc").to_numpy(), batch.column("mark").to_numpy(), *placed(*edge_spans(hasher, data, offsets, k, m), hot)))
            size += len(data)
            if size >= HOLD:
                yield from flush(held, copy)
                held, size, copy = [], 0, copy + 1
        if held:
            yield from flush(held, copy)

    def placed(row, start, n, least, check, hot):
        """Spans with their bucket; those under a hot minimizer fall into single edges."""
        split = np.zeros(len(n), bool)
        if len(hot):
            split = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least
        if not split.any():
            return row, start, n, (least % np.uint64(buckets)).astype(np.int32), check
        parts = np.where(split, n, 1)
        of = np.repeat(np.arange(len(n)), parts)
        step = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.where(split, 1, n)[of]
        begins = check[np.cumsum(size) - size]
        return row[of], start[of] + step, size, (np.where(split[of], begins, least[of]) % np.uint64(buckets)).astype(np.int32), check

    def flush(held, copy):
        base = np.cumsum([0] + [len(h[0]) for h in held])
        doc, mark = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        row = np.concatenate([h[2] + b for h, b in zip(held, base)])
        start, n, bucket, check = (np.concatenate([h[i] for h in held]) for i in (3, 4, 5, 6))
        held.clear()
        # Coordinates in order, the row of each document once.
        order = np.lexsort((mark, doc))
        again = np.zeros(len(order), bool)
        again[1:] = (doc[order][1:] == doc[order][:-1]) & (mark[order][1:] == mark[order][:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        twin = np.empty(len(order), bool)
        twin[order] = again
        at = np.cumsum(n) - n
        live = np.flatnonzero(~twin[row])
        live = live[np.lexsort((start[live], place[row[live]]))]
        # Equal spans: the same bucket, length and edges throughout.
        total = content(n, check, at)
        s = live[np.lexsort((n[live], total[live], bucket[live]))]  # stable: coordinates stay in order
        equal = np.zeros(len(s), bool)
        equal[1:] = (bucket[s][1:] == bucket[s][:-1]) & (n[s][1:] == n[s][:-1]) & (total[s][1:] == total[s][:-1])
        head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(s))))
        # What is known to repeat meets nothing in a bucket any more; it is dealt out evenly.
        d_row, d_start, d_n, d_of, d_at = joined(row[s[equal]], start[s[equal]], n[s[equal]], row[s[head[equal]]], start[s[head[equal]]])
        d_bucket = ((copy >> 24) * 31 + (copy & 0xFFFFFF) * 17 + np.arange(len(d_row)) // 4096) % buckets
        s = s[~equal]
        d_split = np.argsort(d_bucket, kind="stable")
        edge, d_edge = np.searchsorted(bucket[s], np.arange(buckets + 1)), np.searchsorted(d_bucket[d_split], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edge) + np.diff(d_edge)).tolist():
            spans_, drop = s[edge[b] : edge[b + 1]], d_split[d_edge[b] : d_edge[b + 1]]
            spans_ = spans_[np.lexsort((start[spans_], place[row[spans_]]))]
            used = distinct(np.concatenate([row[spans_], d_row[drop], d_of[drop]]))
            of = lambda x: np.searchsorted(used, x)
            where = np.repeat(at[spans_] - (np.cumsum(n[spans_]) - n[spans_]), n[spans_]) + np.arange(n[spans_].sum())
            block = pack([np.array([copy]), doc[used], mark[used], of(row[spans_]), start[spans_], n[spans_], check[where], of(d_row[drop]), d_start[drop], d_n[drop], of(d_of[drop]), d_at[drop]])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block], pa.binary())], names=["bucket", "block"])

    return lean(run)


def joined(row, start, n, of, at):
    """Runs that go on from one another at both places, as one run each."""
    by = np.lexsort((start, start - at, of, row))
    row, start, n, of, at = (x[by] for x in (row, start, n, of, at))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (of[1:] != of[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (at[1:] != at[:-1] + n[:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(n, first) if len(first) else n
    return row[first], start[first], total, of[first], at[first]


def _rows(copy, doc, mark, start, n, f_doc, f_mark, f_start):
    i32 = np.int32
    return pa.table([copy, doc, mark, start.astype(i32), n.astype(i32), f_doc, f_mark, f_start.astype(i32)], names=_COLUMNS)


def repeats_in_bucket(table: pa.Table) -> pa.Table:
    """All blocks of a bucket -> its nonbranching paths of repeated edges."""
    docs, marks, copies, rows, starts, lengths, checks, out = [], [], [], [], [], [], [], []
    base = 0
    for block in table["block"]:
        copy, doc, mark, row, start, n, check, d_row, d_start, d_n, d_of, d_at = unpack(block.as_py())
        if len(d_row):
            out.append(_rows(np.repeat(copy, len(d_row)), doc[d_row], mark[d_row], d_start, d_n, doc[d_of], mark[d_of], d_at))
        copies.append(np.repeat(copy, len(doc))), docs.append(doc), marks.append(mark), starts.append(start), lengths.append(n), checks.append(check)
        rows.append(row.astype(np.int64) + base)
        base += len(doc)
    copy, doc, mark, row = np.concatenate(copies), np.concatenate(docs), np.concatenate(marks), np.concatenate(rows)
    start, n, check = np.concatenate(starts).astype(np.int64), np.concatenate(lengths).astype(np.int64), np.concatenate(checks)
    # The edges that occur more than once.
    value = np.sort(check)
    value = distinct(value[1:][value[1:] == value[:-1]])
    at = np.flatnonzero(value[np.minimum(np.searchsorted(value, check), len(value) - 1)] == check) if len(value) else np.zeros(0, np.int64)
    if len(at):
        key = np.searchsorted(value, check[at])
        del check
        order = np.lexsort((mark, doc))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (mark[order][1:] != mark[order][:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(fresh) - 1
        name = order[fresh]
        before = np.cumsum(n) - n
        span = np.searchsorted(before, at, side="right") - 1
        pos = start[span] + at - before[span]
        coord = rank[row[span]] << 32 | pos
        first = np.full(len(value), 2**63 - 1, np.int64)
        np.minimum.at(first, key, coord)
        first = first[key]
        later = np.flatnonzero(first < coord)  # an edge's second sight at one coordinate is no repeat
        begins = np.ones(len(later), bool)
        begins[1:] = (np.diff(at[later]) != 1) | (span[later][1:] != span[later][:-1]) | (np.diff(first[later]) != 1)
        a = later[begins]
        length = np.diff(np.append(np.flatnonzero(begins), len(later)))
        of = row[span[a]]
        f = first[a] >> 32
        out.append(_rows(copy[of], doc[of], mark[of], pos[a], length, doc[name[f]], mark[name[f]], first[a] & 0xFFFFFFFF))
    schema = pa.schema([(c, pa.int32() if c in ("start", "n", "f_start") else pa.int64()) for c in _COLUMNS])
    found = pa.concat_tables([x.cast(schema) for x in out]) if out else schema.empty_table()
    trim()
    return found


def repeated_paths(placed: DataFrame, k: int = 20, m: int | None = None, seed: int = 1):
    """Candidates from placed(doc, mark, text): a stashed table (doc, mark, start, n, f_doc,
    f_mark, f_start) of compacted paths: n neighbouring edges from word start on that seem
    to occur earlier, at f_start of document f."""
    spark = placed.sparkSession
    m = m or max(1, (k + 1) // 3)
    hot, size = hot_minimizers(placed, k, m, seed)
    parts = max(shuffle_partitions(spark), -(-size // PART))
    buckets = BUCKETS * parts
    shared = spark.sparkContext.broadcast(hot.tobytes())
    blocks = placed.select("doc", "mark", "text").mapInArrow(span_blocks(k, m, buckets, seed, shared), "bucket int, block binary")
    found = stash(blocks.repartition(parts, "bucket").groupBy("bucket").applyInArrow(repeats_in_bucket, _RUN))
    shared.unpersist()
    # Compaction over the ends of buckets: a path is led by a run that no run leads into.
    # Only the document and a hash of the rest stand for the runs that lead on.
    way = ["copy", "mark", "f_doc", "f_mark", "shift"]
    runs = found.withColumn("shift", F.col("start") - F.col("f_start"))
    start = runs.withColumn("at", F.xxhash64(*way, "start"))
    stop = runs.withColumn("to", F.col("start") + F.col("n")).withColumn("at", F.xxhash64(*way, "to"))
    heads = start.select("doc", *way, "at", "start").join(stop.select("doc", "at"), ["doc", "at"], "left_anti")
    tails = stop.select("doc", *way, "at", "to").join(start.select("doc", "at"), ["doc", "at"], "left_anti")
    way = ["doc", *way]
    edge = lambda df, x: df.groupBy(*way).agg(F.sort_array(F.collect_list(x)).alias(x))  # noqa: E731  a way's paths are within one document
    paths = edge(heads, "start").join(edge(tails, "to"), way).select(*way, F.explode(F.arrays_zip("start", "to")).alias("p"))
    paths = paths.select("doc", "mark", F.col("p.start").alias("start"), (F.col("p.to") - F.col("p.start")).alias("n"), "f_doc", "f_mark", (F.col("p.start") - F.col("shift")).alias("f_start"))
    compact = stash(paths)
    release(found)
    return compact


# --- verification against the source words ----------------------------------


def pieces(paths: DataFrame) -> DataFrame:
    """The paths cut at multiples of PIECE of the source's words, so that a source of W words
    is asked for some PIECE x W pieces at most, however many paths lead to it."""
    stop = F.col("f_start") + F.col("n")
    cell = F.explode(F.sequence(F.expr(f"f_start div {PIECE}"), F.expr(f"(f_start + n - 1) div {PIECE}")))
    low, high = F.greatest("f_start", F.col("cell") * PIECE), F.least(stop, (F.col("cell") + 1) * PIECE)
    cells = paths.withColumn("cell", cell).withColumn("low", low.cast("int")).withColumn("high", high.cast("int"))
    return cells.select("doc", "mark", (F.col("start") + F.col("low") - F.col("f_start")).alias("start"), (F.col("high") - F.col("low")).alias("n"), "f_doc", "f_mark", F.col("low").alias("f_start"))


class Words:
    """Digests of runs of words of one text, joined by one space."""

    def __init__(self, text: bytes):
        words = text.split()
        self.line = memoryview(b" ".join(words))
        self.stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1

    def digest(self, start: int, count: int) -> bytes:
        begin = self.stop[start - 1] + 1 if start else 0
        return xxhash.xxh3_128_digest(self.line[begin : self.stop[start + count - 1]])


def _digested(k: int):
    """(doc, mark, text, asked) -> (f_doc, f_mark, f_start, n, digest) of each run of n edges asked for."""

    def run(batches):
        for batch in row_slices(batches, SLICE):
            for doc, mark, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark")), batch.column("text").cast(pa.binary()), batch.column("asked")):
                words, flat = Words(text.as_py() or b""), asked.values
                start, n = flat.field("start").to_pylist(), flat.field("n").to_pylist()
                found = [words.digest(s, c + k - 1) for s, c in zip(start, n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(n), pa.int64()), pa.array([mark] * len(n), pa.int64()), flat.field("start"), flat.field("n"), pa.array(found, pa.binary())], names=["f_doc", "f_mark", "f_start", "n", "digest"]
                )

    return lean(run)


def _held(words: Words, claims, k: int):
    """(start, n) of the claimed pieces whose words are those of the source, as runs in order,
    and of the others."""
    start, n = claims.field("start").to_numpy(), claims.field("n").to_numpy()
    same = np.array([words.digest(s, c + k - 1) == d for s, c, d in zip(start.tolist(), n.tolist(), claims.field("digest").to_pylist())], bool)
    bad = start[~same], n[~same]
    by = np.argsort(start[same], kind="stable")
    begin, stop = start[same][by], np.maximum.accumulate((start + n)[same][by])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > stop[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(begin))[: new.sum()] - 1
    return (begin[new], stop[last] - begin[new]), bad


def _told(placed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Digests of the runs asked(f_doc, f_mark, f_start, n), from the texts they stand in."""
    lists = asked.distinct().groupBy(F.col("f_doc").alias("doc"), F.col("f_mark").alias("mark")).agg(F.collect_list(F.struct(F.col("f_start").alias("start"), "n")).alias("asked"))
    rows = placed.join(lists, ["doc", "mark"]).select("doc", "mark", "text", "asked")
    told = rows.mapInArrow(_digested(k), "f_doc long, f_mark long, f_start int, n int, digest binary")
    return told.dropDuplicates(["f_doc", "f_mark", "f_start", "n"])  # a row may stand twice


def _decided(placed: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(doc, mark, start) of the edges of parts, on either side, whose k words stand earlier
    among those edges.  Edges of one hash all came to its first place, so what is equal to
    an edge that failed there failed too, or is that place."""
    one = lambda doc, mark, start: parts.select(F.col(doc).alias("f_doc"), F.col(mark).alias("f_mark"), F.explode(F.sequence(F.col(start), F.col(start) + F.col("n") - 1)).alias("f_start"), F.lit(1).alias("n"))
    told = _told(placed, one("doc", "mark", "start").union(one("f_doc", "f_mark", "f_start")), k)
    told = told.withColumn("place", F.struct("f_doc", "f_mark", "f_start"))
    first = told.groupBy("digest").agg(F.min("place").alias("first"))
    return told.join(first, "digest").where(F.col("place") != F.col("first")).select(F.col("f_doc").alias("doc"), F.col("f_mark").alias("mark"), F.col("f_start").alias("start"))


def covered(words: int, starts, counts, k: int) -> np.ndarray:
    """Which words stand in a repeated edge."""
    delta = np.zeros(words + 1, np.int64)
    np.add.at(delta, np.minimum(starts, words), 1)
    np.add.at(delta, np.minimum(np.asarray(starts) + counts + k - 1, words), -1)
    return np.cumsum(delta[:-1]) > 0


_PLACES = "array<struct<start:int,n:int>>"
_PLACES_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))


def _listed(runs):
    return [{"start": s, "n": c} for s, c in zip(runs[0].tolist(), runs[1].tolist())]


def without_repeats(docs: DataFrame, make, schema: str, key: str = "doc_id", k: int = 20) -> DataFrame:
    """make(batch, spans) -> batch for the rows of docs; spans holds for each row None or its
    repeated runs of edges as (starts, counts), each of them verified."""
    bound_batches(docs.sparkSession)
    numbers = numbering(docs, key)
    placed = coordinates(docs.select(key, "text"), numbers, key).select("doc", "mark", "text")
    paths = repeated_paths(placed, k)
    parts, where = pieces(paths), ["f_doc", "f_mark", "f_start", "n"]
    told = stash(_told(placed, parts.select(*where), k))
    claims = parts.join(told, where).groupBy(F.col("doc").alias("__doc"), F.col("mark").alias("__mark")).agg(F.collect_list(F.struct("start", "n", "digest")).alias("__claims"))
    rows = coordinates(docs, numbers, key, "__doc", "__mark")

    def judged(batches):
        for batch in row_slices(batches, SLICE):
            spans, good, bad = [], [], []
            for text, claimed in zip(batch.column("text").cast(pa.binary()), batch.column("__claims")):
                runs, failed = _held(Words(text.as_py() or b""), claimed.values, k) if claimed.is_valid else (None, ((),))
                spans.append(runs)
                good.append(_listed(runs) if len(failed[0]) else None)
                bad.append(_listed(failed) if len(failed[0]) else None)
            out = make(batch, spans)
            more = [batch.column("__doc"), batch.column("__mark"), pa.array(good, _PLACES_ARROW), pa.array(bad, _PLACES_ARROW)]
            yield pa.RecordBatch.from_arrays([*out.columns, *more], names=[*out.schema.names, "__doc", "__mark", "__good", "__bad"])

    done = cut(rows.join(claims, ["__doc", "__mark"], "left").mapInArrow(lean(judged), f"{schema}, __doc long, __mark long, __good {_PLACES}, __bad {_PLACES}"))
    release(told)
    result = done.where("__bad IS NULL").drop("__doc", "__mark", "__good", "__bad")
    failed = done.where("__bad IS NOT NULL").select(F.col("__doc").alias("doc"), F.col("__mark").alias("mark"), "__good", "__bad")
    if failed.isEmpty():
        release(paths)
        return result
    pool = parts.join(failed.select("doc", "mark", F.inline("__bad")).distinct(), ["doc", "mark", "start", "n"])
    again = stash(_decided(placed, pool, k).join(failed.select("doc", "mark").distinct(), ["doc", "mark"]))
    spans = failed.select("doc", "mark", F.inline_outer("__good")).union(again.select("doc", "mark", "start", F.lit(1).alias("n")))
    lists = cut(spans.groupBy(F.col("doc").alias("__doc"), F.col("mark").alias("__mark")).agg(F.collect_set(F.struct("start", "n")).alias("__spans")))
    release(paths, again)

    def decided(batches):
        for batch in row_slices(batches, SLICE):
            flat = [[x for x in runs if x["start"] is not None] for runs in batch.column("__spans").to_pylist()]
            yield make(batch, [(np.array([x["start"] for x in runs], np.int64), np.array([x["n"] for x in runs], np.int64)) for runs in flat])

    return result.union(rows.join(lists, ["__doc", "__mark"]).mapInArrow(lean(decided), schema))


def digest_batch(k: int, key: str):
    """doc_id, n_words, n_removed and the hash of the kept words."""

    def make(batch, spans):
        n_words, n_removed, digest = [], [], []
        for text, runs in zip(batch.column("text").cast(pa.binary()), spans):
            words = (text.as_py() or b"").split()
            n_words.append(len(words))
            if runs is not None:
                gone = covered(len(words), *runs, k)
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            n_removed.append(n_words[-1] - len(words))
            digest.append(sha256(b" ".join(words)))
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return make


def removal_digest(docs: DataFrame, key: str = "doc_id", k: int = 20) -> DataFrame:
    kind = dict(docs.dtypes)[key]
    return without_repeats(docs.select(key, "text"), digest_batch(k, key), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string", key, k)


def strip_text(data: bytes, starts, counts, k: int) -> bytes:
    """The text without its repeated words; white space between kept words stays."""
    view = np.frombuffer(data, np.uint8)
    start, end, _ = word_bounds(view, np.array([0, len(view)]))
    gone = covered(len(start), starts, counts, k)
    begins = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]))
    stops = np.flatnonzero(gone & ~np.concatenate([gone[1:], [False]]))
    out, at = [], 0
    for b, e in zip(begins, stops):
        out.append(data[at : start[b]])
        at = start[e + 1] if e + 1 < len(start) else end[e]
    return b"".join([*out, data[at:]])


def remove_repeats(docs: DataFrame, key: str = "doc_id", k: int = 20, counted: str = "n_removed") -> DataFrame:
    """The rows of docs with repeated passages cut from text; the column `counted` tells the
    words removed and takes the place of one of that name."""
    carried = [c for c in docs.columns if c not in ("text", counted)]
    kinds = dict(docs.dtypes)

    def make(batch, spans):
        texts, removed = [], []
        for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), spans):
            if runs is not None and len(runs[0]):
                kept = strip_text(text, *runs, k)
                removed.append(len(text.split()) - len(kept.split()))
                text = kept
            else:
                removed.append(0)
            texts.append(text)
        return pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(removed, pa.int64())], names=[*carried, "text", counted])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + (", " if carried else "") + f"text string, `{counted}` long"
    return without_repeats(docs, make, schema, key, k)
