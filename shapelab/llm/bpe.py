"""Byte-level BPE by corpus-level merge replay.

A slice of the corpus is split into words by the tokenizer's pattern.  Its
distinct words form one corpus: all their bytes stand in one token array, and an
inverted index leads from the rank of an adjacent token pair to the positions
where it occurs.  Merges are then replayed over that corpus in rank order; a
merge visits only the positions its index lists and updates only the pairs with
the two neighbours.  If a merge makes a pair of a lower rank, that one goes
first, so each word ends as if it had been encoded alone, lowest rank first and
leftmost among equals.  Texts are then read off their words' ids.

Words met before in the same task are kept, up to a bounded number, so
the replay runs over new words only.  Nothing is shuffled.

The corpus of a replay is what a slice of texts adds to the words that its task knows;
one replay over the words of all slices would have to bring ids back to every slice by
shuffling texts or their words, beyond the disk that the tool allows (README).

Defined results: a null text is empty; an empty text has no ids; the digests of
empty texts are those of zero bytes.  A text of any length is encoded whole, and so is
a word: a run without a break of B bytes takes about 40 B bytes while it is replayed.
Equal pairs merge leftmost first; repeated rows get equal results; an empty table gives
an empty one.  Other columns pass through encode and decode but for those of the names
ids and decoded; the digests read only the key and text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bound_batches, lean, row_slices

SLICE = 4 << 20
KEEP_WORDS = 1 << 19
REPLAY_WORDS = 1 << 17


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The lines of a rank file: base64 of a token's bytes, a space, its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of each word, by merges in rank order over all words at once."""
    text = b"".join(words)
    single = [ranks[bytes([b])] for b in range(256)]
    n = len(text)
    begin = bytearray(n + 1)  # 1 where a word starts
    at = 0
    starts = []
    for w in words:
        starts.append(at)
        begin[at] = 1
        at += len(w)
    begin[n] = 1
    # Compact arrays, 16 bytes for each byte of the words, however long a word is.
    token = array("i", np.array(single, np.int32)[np.frombuffer(text, np.uint8)].tobytes())  # id of the token that starts here
    stop = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())  # where that token ends
    back = array("i", np.arange(-1, n, dtype=np.int32).tobytes())  # where the token before starts
    index: dict[int, list[int]] = {}
    pair_rank = array("i", b"\xff" * (4 * (n + 1)))  # rank of the pair that starts here, while it stands
    find = ranks.get
    two: dict[bytes, int] = {}
    for i in range(n - 1):
        if not begin[i + 1]:
            pair = text[i : i + 2]
            rank = two.get(pair)
            if rank is None:
                rank = two[pair] = find(pair, -1)
            if rank >= 0:
                pair_rank[i] = rank
                if rank in index:
                    index[rank].append(i)
                else:
                    index[rank] = [i]
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        for k, i in enumerate(places):
            if pair_rank[i] != rank:
                continue
            mid = stop[i]
            end = stop[mid]
            token[i], stop[i], pair_rank[mid] = rank, end, -1
            lower = False
            if begin[end]:
                pair_rank[i] = -1
            else:
                back[end] = i
                right = pair_rank[i] = find(text[i : stop[end]], -1)
                if right >= 0:
                    if right in index:
                        index[right].append(i)
                    else:
                        index[right] = [i]
                        heapq.heappush(heap, right)
                    lower = right <= rank
            if not begin[i]:
                j = back[i]
                left = pair_rank[j] = find(text[j:end], -1)
                if left >= 0:
                    if left in index:
                        index[left].append(j)
                    else:
                        index[left] = [j]
                        heapq.heappush(heap, left)
                    lower = lower or left <= rank
            if lower and k + 1 < len(places):  # the lower merge comes first in this word
                if rank in index:
                    index[rank].extend(places[k + 1 :])
                else:
                    index[rank] = places[k + 1 :]
                    heapq.heappush(heap, rank)
                break
    out = []
    for w, s in zip(words, starts):
        ids, i, e = [], s, s + len(w)
        while i < e:
            ids.append(token[i])
            i = stop[i]
        out.append(ids)
    return out


class Codec:
    """Encodes and decodes with a rank table, remembering words and their ids; ids are kept
    as decimal text, which is small and is what most results need."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.spelled = {b"%d" % rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) > KEEP_WORDS:
            self.known = {w: self.known[w] for w in pieces if w in self.known}
        left = []
        for w in sorted(pieces.difference(self.known)):
            rank = self.ranks.get(w.encode())
            if rank is None:
                left.append(w)
            else:
                self.known[w] = b"%d" % rank
        for a in range(0, len(left), REPLAY_WORDS):
            part = left[a : a + REPLAY_WORDS]
            for w, ids in zip(part, replay([w.encode() for w in part], self.ranks)):
                self.known[w] = " ".join(map(str, ids)).encode()

    def lines(self, texts: list[str]) -> list[bytes]:
        """The ids of each text in decimal, joined by one space."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        known = self.known
        return [b" ".join([known[w] for w in words]) for words in split]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [numbers(line) for line in self.lines(texts)]

    def decode_line(self, line: bytes) -> bytes:
        """The bytes of ids in decimal."""
        spelled = self.spelled
        return b"".join([spelled[i] for i in line.split()])

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def numbers(line: bytes) -> np.ndarray:
    return np.array(line.split(), np.int32) if line else np.zeros(0, np.int32)


def ids_column(ids: list[np.ndarray]) -> pa.Array:
    cuts = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def _shared(spark, path: str, pattern: str):
    """The rank file's bytes, read once on the driver; a vocabulary is a few MB at most."""
    bound_batches(spark)
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path} is {len(data)} bytes: no rank file, which are broadcast and have a few MB")
    return spark.sparkContext.broadcast((data, pattern))


def _task_codec(shared) -> Codec:
    data, pattern = shared.value
    return Codec(load_ranks(data), pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of docs and ids array<int>, in place of a column of that name."""
    docs = docs.drop("ids")
    shared = _shared(docs.sparkSession, path, pattern)
    carried = docs.columns

    def run(batches):
        codec = None
        for batch in row_slices(batches, SLICE):
            codec = codec or _task_codec(shared)
            ids = codec.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, ids_column(ids)], names=[*carried, "ids"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(lean(run), ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns but ids, and decoded binary."""
    shared = _shared(encoded.sparkSession, path, pattern)
    carried = [c for c in encoded.columns if c not in ("ids", "decoded")]

    def run(batches):
        codec = None
        for batch in batches:
            codec = codec or _task_codec(shared)
            data = [codec.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(data, pa.binary())], names=[*carried, "decoded"])

    kinds = dict(encoded.dtypes)
    return encoded.mapInArrow(lean(run), ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ("," if carried else "") + " decoded binary")


def round_trip_digest(docs: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256, the text decoded from the ids.
    One pass: the ids of a text leave the task as digests only."""
    shared = _shared(docs.sparkSession, path, pattern)

    def run(batches):
        codec = None
        for batch in row_slices(batches, SLICE):
            codec = codec or _task_codec(shared)
            count, ids_digest, text_digest = [], [], []
            for line in codec.lines([t or "" for t in batch.column("text").to_pylist()]):
                count.append(line.count(b" ") + 1 if line else 0)
                ids_digest.append(hashlib.sha256(line).hexdigest())
                text_digest.append(hashlib.sha256(codec.decode_line(line)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(count, pa.int64()), pa.array(ids_digest), pa.array(text_digest)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, "text").mapInArrow(lean(run), f"`{key}` {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_verified(docs: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids, and the digest of what the ids decode to; a text that does not
    come back from its ids stops the job."""
    shared = _shared(docs.sparkSession, path, pattern)

    def run(batches):
        codec = None
        for batch in row_slices(batches, SLICE):
            codec = codec or _task_codec(shared)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = codec.encode(texts)
            digest = []
            for text, own in zip(texts, ids):
                back = codec.decode(own.tolist())
                if back != text.encode():
                    raise ValueError("a text does not come back from its ids")
                digest.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(i) for i in ids], pa.int64()), ids_column(ids), pa.array(digest, pa.string())], names=[key, "n_tokens", "ids", "decoded_sha256"])

    return docs.select(key, "text").mapInArrow(lean(run), f"`{key}` {dict(docs.dtypes)[key]}, n_tokens long, ids array<int>, decoded_sha256 string")
