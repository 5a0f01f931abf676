"""Language identification by prediction by partial matching (PPM).

For every language a variable-order tree of byte contexts is counted on a
bounded sample of labelled texts.  The counts are then frozen: under each
language, a byte that followed its context c times out of n, with d distinct
followers, costs -log2(c / (n + d)) bits; an unseen byte pays the escape
-log2(d / (n + d)) and is coded again in the next shorter context, down to a
uniform code over 256 bytes (escape method C, no exclusion).  A text's language
is the one that codes the whole text in the fewest bits.

The resolved costs of all languages stand in one table, row = context node,
column = byte, so scoring a text is two gathers for each byte.

Defined results: null texts and texts without a letter are `und` with score 0;
equal code lengths go to the language that sorts first; no labelled row at all
gives `und` throughout.  Texts of any length are scored whole, block by block;
repeated rows get equal results, and an empty table gives an empty one.  Only the
key, text and a column held_out, which is passed through, are read; other columns
may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean, row_slices, utf8_view

ORDER = 3
START = 10  # the byte that is taken to stand before a text
SLICE = 8 << 20
BLOCK = 1 << 20


def gram_rows(batches):
    """Counts of (language, context, byte) over ORDER+1 bytes, for each Arrow slice."""
    for batch in row_slices(batches, 16 << 20):
        langs = batch.column("lang").to_pylist()
        data, offsets = utf8_view(batch.column("text"))
        found: dict[str, list] = {}
        for i, lang in enumerate(langs):
            part = data[offsets[i] : offsets[i + 1]]
            found.setdefault(lang, []).append(np.concatenate([np.full(ORDER, START, np.uint8), part]))
        for lang, parts in found.items():
            grams = []
            for p in parts:
                wide = p.astype(np.uint32)
                grams.append((wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:])
            grams = np.sort(np.concatenate(grams))
            at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
            value, count = grams[at], np.diff(np.append(at, len(grams)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(value)), pa.array(value.astype(np.int64)), pa.array(count.astype(np.int64))],
                names=["lang", "gram", "n"],
            )


class ContextTree:
    """Frozen costs: classes of bytes, context -> node, (node, byte) -> bits by language."""

    def __init__(self, langs, classes, node_of, bits):
        self.langs, self.classes, self.node_of, self.bits = langs, classes, node_of, bits


def build_tree(rows: list[tuple[str, np.ndarray, np.ndarray]], max_nodes: int, min_count: int) -> ContextTree:
    """rows: (language, grams, counts).  Contexts of order 3 are kept if they occur
    min_count times over all languages, the commonest max_nodes of them at most."""
    rows = sorted(rows, key=lambda r: r[0])
    langs = [r[0] for r in rows]
    seen = np.zeros(256, bool)
    seen[START] = True
    for _, grams, _ in rows:
        seen[np.unique(grams & 255)] = True
    classes = np.zeros(256, np.int64)  # class 0: bytes that the sample does not hold
    classes[seen] = np.arange(1, seen.sum() + 1)
    a = int(seen.sum()) + 1
    split = [(lang, [classes[(g >> s) & 255] for s in (24, 16, 8, 0)], n.astype(np.float64)) for lang, g, n in rows]

    weight = np.zeros(a**3)
    for _, (x, y, z, _), n in split:
        weight += np.bincount((x * a + y) * a + z, n, minlength=a**3)
    third = np.flatnonzero(weight >= min_count)
    if len(third) > max_nodes:
        third = np.sort(third[np.lexsort((third, -weight[third]))[:max_nodes]])
    second = np.flatnonzero(weight.reshape(a, a * a).sum(0) > 0)

    # Node numbers: 0 is the empty context, then orders 1, 2, 3.
    n1, n2 = 1, 1 + a
    n3 = n2 + len(second)
    order2 = np.arange(a) + n1  # by the last byte
    node2 = np.repeat(order2[None, :], a, axis=0).reshape(-1)  # by the last two
    node2[second] = n2 + np.arange(len(second))
    node_of = np.repeat(node2[None, :], a, axis=0).reshape(-1)
    node_of[third] = n3 + np.arange(len(third))

    bits = np.empty((n3 + len(third), a, len(langs)), np.float32)
    slot = np.full(a**3, -1, np.int64)
    slot[third] = np.arange(len(third))
    slot2 = np.full(a * a, -1, np.int64)
    slot2[second] = np.arange(len(second))
    for k, (_, (x, y, z, b), n) in enumerate(split):
        below = np.full((1, a), np.log2(256.0))
        below = _level(np.zeros(len(b), np.int64), b, n, 1, a, below[np.zeros(1, np.int64)])
        bits[0, :, k] = below[0]
        one = _level(z, b, n, a, a, np.repeat(below, a, axis=0))
        bits[n1:n2, :, k] = one
        two = _level(slot2[y * a + z], b, n, len(second), a, one[second % a])
        bits[n2:n3, :, k] = two
        at = slot[(x * a + y) * a + z]
        ok = at >= 0
        bits[n3:, :, k] = _level(at[ok], b[ok], n[ok], len(third), a, two[slot2[third % (a * a)]])
    return ContextTree(langs, classes.astype(np.int32), node_of.astype(np.int32), bits.reshape(-1, len(langs)))


def _level(context, byte, n, contexts, a, below):
    """Costs in each context of one order; below: the costs after an escape from it."""
    count = np.bincount(context * a + byte, n, minlength=contexts * a).reshape(contexts, a)
    total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = -np.log2(count / (total + kinds))
        escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
    return np.where(count > 0, hit, escape + below)


def code_lengths(tree: ContextTree, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of every row under every language."""
    rows, a = len(offsets) - 1, int(round(len(tree.node_of) ** (1 / 3)))
    if not len(data):
        return np.zeros((rows, len(tree.langs)))
    start = np.int32(tree.classes[START])
    out = np.zeros((rows, len(tree.langs)))
    for at in range(0, len(data), BLOCK):  # a very long text needs no more memory than a block
        n = min(BLOCK, len(data) - at)
        have = min(at, ORDER)
        cls = np.full(n + ORDER, start, np.int32)
        cls[ORDER - have :] = tree.classes[data[at - have : at + n]]
        first = int(np.searchsorted(offsets, at, side="right")) - 1
        last = int(np.searchsorted(offsets, at + n, side="left"))
        cuts = np.clip(offsets[first : last + 1], at, at + n) - at
        x, y, z = cls[:-3].copy(), cls[1:-2].copy(), cls[2:-1].copy()
        begins = offsets[first:last] - at
        for back in range(ORDER):  # no context reaches into the row before
            p = begins + back
            p = p[(p >= 0) & (p < cuts[1:])]
            x[p] = start
            if back < 2:
                y[p] = start
            if back < 1:
                z[p] = start
        node = tree.node_of[(x * a + y) * a + z]
        bits = np.take(tree.bits, node.astype(np.int64) * a + cls[ORDER:], axis=0)
        full = np.flatnonzero(np.diff(cuts) > 0)
        out[first + full] += np.add.reduceat(bits, cuts[:-1][full], axis=0, dtype=np.float64)
    return out


def train(labelled: DataFrame, docs_per_lang: int = 1500, max_nodes: int = 1 << 15, min_count: int = 3, seed: int = 7):
    """Count contexts on about docs_per_lang labelled texts of each language and freeze
    them.  None if there is no text.  docs_per_lang bounds the labelled rows.  max_nodes and
    min_count bound the frozen tree, which every worker holds (at most (max_nodes + 2**16) x
    257 costs a language, in practice 10 MB): a rarer context is left to the next shorter
    one, as PPM leaves one that it has never seen."""
    bound_batches(labelled.sparkSession)
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / n)))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**31)) / F.lit(float(2**31))
    sample = labelled.where(draw < share[F.col("lang")]).select("lang", "text")
    counted = sample.mapInArrow(lean(gram_rows), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    rows = []
    for lang in sorted(set(counted["lang"].to_pylist())):
        part = counted.filter(pa.compute.equal(counted["lang"], lang))
        rows.append((lang, part["gram"].to_numpy().astype(np.int64), part["n"].to_numpy()))
    return build_tree(rows, max_nodes, min_count) if rows else None


def identify(docs: DataFrame, tree: ContextTree | None, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score and bits_per_byte for every row of docs(key, text)."""
    spark = docs.sparkSession
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(key).alias("doc_id"), "text", has_letter.alias("has_letter"), *[F.col(c) for c in ("held_out",) if c in docs.columns])
    carried = [c for c in rows.columns if c not in ("text", "has_letter")]
    if tree is None:
        return rows.select(*carried, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    bound_batches(spark)
    # Plain arrays: executors unpickle a broadcast without this package on their path.
    shared = spark.sparkContext.broadcast((tree.langs, tree.classes, tree.node_of, tree.bits))
    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in carried)

    def score(batches):
        tree = ContextTree(*shared.value)
        for batch in row_slices(batches, SLICE):
            data, offsets = utf8_view(batch.column("text"))
            total = code_lengths(tree, data, offsets)
            best = total.argmin(1)
            least = total[np.arange(len(best)), best]
            odds = np.exp2(np.clip(least[:, None] - total, -1000, 0)).sum(1)
            letters = batch.column("has_letter").to_numpy(zero_copy_only=False)
            size = np.maximum(np.diff(offsets), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carried]
                + [
                    pa.array([tree.langs[b] if ok else "und" for b, ok in zip(best, letters)], pa.string()),
                    pa.array(np.where(letters, 1 / odds, 0.0)),
                    pa.array(least / size, mask=~letters),
                ],
                names=[*carried, "lang_pred", "score", "bits_per_byte"],
            )

    return rows.mapInArrow(lean(score), f"{kinds}, lang_pred string, score double, bits_per_byte double")
