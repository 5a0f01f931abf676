"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of m words may be found with up to k = floor(budget * m) word edits
(a word inserted, dropped or replaced).  The item is cut into k + 1 pieces; any
passage within k edits holds one of them unchanged.  All pieces of all items go
into one Aho-Corasick automaton that reads each whole text once; around the hits
the passage is verified by Myers' bit-parallel edit distance, word by word.

The items reach the executors by broadcast in slices of at most SLICE_BYTES;
a larger benchmark takes further passes, never a larger broadcast.

Words are runs of \\w, lower-cased.  Defined results: null and empty texts match
nothing; items without a word match nothing; rows of the benchmark with the same
words are all reported; of several places of an item in one text the one of the
least distance counts, the earliest among equals.  Texts of any length are read
whole; repeated rows are reported once each; an empty table on either side gives
no match.  matches() reads the key and text alone, without_matches() passes all
columns through, so other columns may have any names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import reduce
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean, row_slices

BUDGET = 0.2
SLICE_BYTES = 16 << 20
_WORD = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return _WORD(text.lower()) if text else []


def pieces(count: int, errors: int) -> list[tuple[int, int]]:
    """Word ranges of errors + 1 pieces, as even as can be."""
    parts = errors + 1
    return [(count * i // parts, count * (i + 1) // parts) for i in range(parts)]


def masks(pattern: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, w in enumerate(pattern):
        out[w] = out.get(w, 0) | 1 << i
    return out


def distances(mask: dict[str, int], m: int, text: list[str], anchored: bool = False):
    """After each word of text: the least edit distance of the pattern to a passage that
    ends there (anchored: to the whole text so far).  Myers 1999, words as letters."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for word in text:
        eq = mask.get(word, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(horizontal | plus) & full)
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = (up << 1) | anchored
        down <<= 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        yield score


class Matcher:
    """Items as (id, words); finds those that a text holds within their budget."""

    def __init__(self, items: list[tuple[int, list[str]]], budget: float = BUDGET):
        self.items = []
        at: dict[str, list[tuple[int, int]]] = {}
        for ident, words in items:
            if not words:
                continue
            errors = int(budget * len(words) + 1e-9)
            for a, b in pieces(len(words), errors):
                at.setdefault(f" {' '.join(words[a:b])} ", []).append((len(self.items), a))
            self.items.append((ident, len(words), errors, masks(words), masks(words[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in at.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str | None):
        """(id, distance, item words, first word, word after the last) for each item found."""
        if not text or not self.items:
            return []
        words = words_of(text)
        line = f" {' '.join(words)} "
        windows: dict[int, list[int]] = {}
        ends = None
        for last, (length, uses) in self.automaton.iter(line):
            if ends is None:
                ends = list(accumulate(len(w) + 1 for w in words))
            word = bisect_right(ends, last - length + 1)
            for item, offset in uses:
                windows.setdefault(item, []).append(word - offset)
        found = []
        for item, shifts in windows.items():
            ident, m, errors, mask, reverse = self.items[item]
            best = None
            for a, b in _merged(sorted(set(shifts)), m, errors, len(words)):
                for i, d in enumerate(distances(mask, m, words[a:b])):
                    if d <= errors and (best is None or d < best[0]):
                        best = (d, a + i + 1)
            if best:
                d, stop = best
                back = words[max(0, stop - m - errors) : stop][::-1]
                length = next(i + 1 for i, x in enumerate(distances(reverse, m, back, True)) if x == d)
                found.append((ident, d, m, stop - length, stop))
        return found


def _merged(shifts, m, errors, size):
    """Windows around the shifts, joined where they overlap."""
    begin = stop = None
    for s in shifts:
        a, b = max(0, s - errors), min(size, s + m + errors)
        if stop is not None and a <= stop:
            stop = max(stop, b)
        else:
            if stop is not None:
                yield begin, stop
            begin, stop = a, b
    if stop is not None:
        yield begin, stop


def _slices(benchmark: DataFrame):
    """Items in slices of bounded size, one slice on the driver at a time."""
    held, size = [], 0
    for row in benchmark.where(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        words = words_of(row.text)
        held.append((row.item_id, words))
        size += len(row.text.encode())
        if size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", budget: float = BUDGET) -> DataFrame:
    """One row for each text and item found in it: key, item_id, distance, item_words,
    start_word, end_word (the word after the last)."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind, item_kind = dict(docs.dtypes)[key], dict(benchmark.dtypes)["item_id"]
    schema = f"`{key}` {kind}, item_id {item_kind}, distance int, item_words int, start_word long, end_word long"
    rows = docs.where(F.col("text").isNotNull()).select(key, "text")
    parts = []
    for items in _slices(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            matcher = None
            for batch in row_slices(batches, 8 << 20):
                matcher = matcher or Matcher(shared.value, budget)
                keys, found = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    for match in matcher.find(text):
                        keys.append(i)
                        found.append(match)
                if found:
                    ident, d, m, a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(key).take(pa.array(keys)), pa.array(ident, pa.int64() if item_kind == "bigint" else None), pa.array(d, pa.int32()), pa.array(m, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                        names=[key, "item_id", "distance", "item_words", "start_word", "end_word"],
                    )

        parts.append(rows.mapInArrow(lean(run), schema))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def without_matches(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of docs that hold no item, as they are; nothing is shuffled."""
    bound_batches(docs.sparkSession)
    for items in _slices(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            matcher = None
            for batch in row_slices(batches, 8 << 20):
                matcher = matcher or Matcher(shared.value, budget)
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
