"""Byte-level BPE: text to ranks and back, by a segment tree over byte positions.

The tree's leaves are the byte positions of one piece.  A leaf holds the rank of the
pair that starts there, joined with the position, so the root is the leftmost pair of
the least rank.  A merge changes three leaves (the pair's, its right half's and the
live left neighbour's) and the paths above them: O(log n) for each merge, O(n log n)
for a piece however long.  Short pieces are worked on many at a time as rows of numpy
arrays, long ones alone; both run the same algorithm.

Null text counts as empty and has no ids.  Every row is encoded alone, so repeated rows
agree, an empty table gives an empty result, and other columns are never read.
Very long texts are taken whole; a tree needs about 200 bytes for each byte of the longest piece.
Surrogates cannot occur in Spark strings; invalid UTF-8 is replaced on reading.

A worker keeps the vocabulary for its next task.  What it remembers of pieces is bounded in bytes
and goes when the task ends.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tamis.llm.batches import release, slices
from tamis.shared import col

_NONE = np.iinfo(np.int64).max
_LONG = 128


class Vocabulary:
    """Ranks of byte strings, and the rank of each joined pair of them."""

    def __init__(self, blob: bytes, pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks, strict=True))
        self.names = {rank: str(rank) for rank in self.bytes_of}
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.bytes_of}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs: dict[int, int] = {}  # left << 32 | right
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        keys = np.array(list(pairs), dtype=np.int64)
        order = np.argsort(keys)
        self._keys, self._joined = keys[order], np.array(list(pairs.values()), dtype=np.int64)[order]

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, or the largest integer where a pair has none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._joined[at], _NONE)

    # -- merging ---------------------------------------------------------------

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one piece by a tree of its own."""
        n = len(piece)
        size = 1 << max(0, n - 1).bit_length()
        ids = [int(self.single[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none, pairs = (_NONE, -1), self.pairs
        tree: list[tuple[int, int]] = [none] * (2 * size)

        def leaf(at: int) -> tuple[int, int]:
            to = after[at]
            rank = pairs.get(ids[at] << 32 | ids[to]) if to < n else None
            return none if rank is None else (rank, at)

        def put(at: int, value: tuple[int, int]) -> None:
            node = size + at
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least

        for at in range(n):
            tree[size + at] = leaf(at)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        live = [True] * n
        while tree[1] != none:
            rank, at = tree[1]
            gone = after[at]
            ids[at], live[gone] = rank, False
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, none)
            put(at, leaf(at))
            if before[at] >= 0:
                put(before[at], leaf(before[at]))
        return [i for i, alive in zip(ids, live, strict=True) if alive]

    def merge_many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Packed ids of pieces of at most ``size`` bytes (a power of two), one tree a row."""
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(n, size)
        places = np.arange(size)
        ids = self.single[raw]
        after = np.tile(places + 1, (n, 1))
        before = np.tile(places - 1, (n, 1))
        live = places < lengths[:, None]
        # a leaf is rank * size + position
        tree = np.full((n, 2 * size), _NONE, dtype=np.int64)
        if size > 1:
            rank = self.joined(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, size - 1)
            known = (rank != _NONE) & (places[1:] < lengths[:, None])
            tree[:, size:-1] = np.where(known, rank * np.where(known, size, 0) + places[:-1], _NONE)
        for lo in (1 << k for k in range(size.bit_length() - 2, -1, -1)):
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + size
            tree[rows, node] = value
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def leaf(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            to = after[rows, at]
            ends = to >= lengths[rows]
            rank = self.joined(ids[rows, at], ids[rows, np.where(ends, 0, to)])
            known = ~ends & (rank != _NONE)
            return np.where(known, np.where(known, rank, 0) * size + at, _NONE)

        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], size)
            gone = after[rows, at]
            to = after[rows, gone]
            ids[rows, at] = rank
            live[rows, gone] = False
            after[rows, at] = to
            inside = to < lengths[rows]
            before[rows[inside], to[inside]] = at[inside]
            put(rows, gone, np.full(len(rows), _NONE))
            put(rows, at, leaf(rows, at))
            left = before[rows, at]
            has = left >= 0
            put(rows[has], left[has], leaf(rows[has], left[has]))
            rows = rows[tree[rows, 1] != _NONE]
        flat, ends = ids[live].astype("<i4").tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [flat[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces, packed as 32-bit numbers."""
        out: dict[bytes, bytes] = {}
        sized: dict[int, list[bytes]] = {}
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                out[piece] = self.packed[whole]
            elif len(piece) > _LONG:
                out[piece] = np.array(self.merge_long(piece), dtype="<i4").tobytes()
            else:
                sized.setdefault(1 << (len(piece) - 1).bit_length(), []).append(piece)
        for size, group in sized.items():
            step = max(1, (1 << 17) // size)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                out.update(zip(part, self.merge_many(part, size), strict=True))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Encoder:
    """A vocabulary with a memory of the pieces that it has encoded, bounded in bytes.

    Pieces are remembered in two generations: when the young one is full, it becomes the old one, and what is not
    met again until the next time is forgotten.  Ids are held as the bytes of 32-bit numbers.
    """

    def __init__(self, vocabulary: Vocabulary, most_bytes: int = 32 << 20) -> None:
        self.vocabulary, self.most_bytes = vocabulary, most_bytes
        self.forget()

    def forget(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.arrays(texts)]

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.held > self.most_bytes // 2:
            self.young, self.old, self.held = {}, self.young, 0
        split, young, old = self.vocabulary.pattern.findall, self.young, self.old
        found = [split(t) for t in texts]
        seen: set[str] = set()
        for pieces in found:
            seen.update(pieces)
        seen.difference_update(young)
        kept = {piece: old[piece] for piece in seen.intersection(old)}
        seen.difference_update(kept)
        new = [*seen]
        raw = [piece.encode() for piece in new]
        ids = self.vocabulary.encode_pieces(raw)
        kept.update(zip(new, map(ids.__getitem__, raw), strict=True))
        young.update(kept)
        self.held += 250 * len(kept) + 4 * sum(map(len, kept)) + sum(map(len, kept.values()))
        return [np.frombuffer(b"".join(map(young.__getitem__, pieces)), dtype="<i4") for pieces in found]

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of the ids as text, and of the bytes that they decode to."""
        numbers = ids.tolist()
        shown = " ".join(map(self.vocabulary.names.__getitem__, numbers))
        return hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(self.vocabulary.decode(numbers)).hexdigest()


_encoders: dict[tuple[int, str], Encoder] = {}


def encoder_of(blob: bytes, pattern: str) -> Encoder:
    """This worker's encoder for a rank file; its vocabulary outlives the task."""
    key = (hash(blob), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(blob, pattern))
    return _encoders[key]


def _sent(spark: SparkSession, path: str):
    """The rank file, read once by the driver and sent to the executors (under 64 MB)."""
    with open(path, "rb") as file:
        blob = file.read()
    if len(blob) > 64 << 20:
        raise ValueError(f"{path}: a rank file of {len(blob)} bytes is too large to send")
    return spark.sparkContext.broadcast(blob)


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False
) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``n_tokens``, the ``ids``, and digests on request."""
    blob = _sent(docs.sparkSession, ranks_path)
    source = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    key_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key_type}, n_tokens bigint"
    schema += ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(blob.value, pattern)
        try:
            for part in slices(batches, most_bytes=2 << 20):  # the pieces of a text take twenty times its bytes
                found = encoder.arrays([t or "" for t in part.column("text").to_pylist()])
                sizes = [len(x) for x in found]
                columns: dict = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64())}
                if ids:
                    ends = np.cumsum([0, *sizes], dtype=np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                if digests:
                    rows = [encoder.digests(x) for x in found]
                    columns["ids_sha256"] = pa.array([r[0] for r in rows], pa.string())
                    columns["decoded_sha256"] = pa.array([r[1] for r in rows], pa.string())
                yield pa.RecordBatch.from_pydict(columns)
        finally:
            encoder.forget()
            release()

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and the ``text`` that its ids stand for; null ids decode to an empty text."""
    blob = _sent(encoded.sparkSession, ranks_path)
    source = encoded.select(col(id_col).alias("doc_id"), col(ids_col).alias("ids"))
    key_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_of(blob.value, pattern).vocabulary
        for part in slices(batches):
            texts = [vocabulary.decode(x or []).decode("utf-8", "replace") for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text": pa.array(texts, pa.string())})

    return source.mapInArrow(run, f"doc_id {key_type}, text string")
