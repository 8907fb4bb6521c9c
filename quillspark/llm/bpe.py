"""Byte-level BPE over length-bucketed, padded numpy matrices.

A text is split by the tokenizer's pattern and each piece is encoded by itself.
Pieces that a worker has not met yet are encoded together: pieces of similar
length share a matrix of ids, one row a piece, padded.  In each round every row
merges its leftmost pair of minimum rank; pair ranks come from a two-choice
hash table held in flat arrays; merged rows are compacted by one gather, and
only the two pairs beside a merge are looked up again.  Rows that have no pair
left leave the matrix.  Very long pieces, for which rounds times width would
grow quadratically, go through a heap over a linked list with equal results.

A worker keeps met pieces in a dictionary that is emptied at ``CACHE_PIECES``;
it changes speed only.  The rank table (about 50,000 entries, under 1 MB) is
broadcast: a tokenizer's size does not depend on the data.

Nulls and edges: a null text is empty and has no ids; decoding gives back the
very bytes of the text; repeated rows and ids are encoded each; other columns
of the input do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG_PIECE, CACHE_PIECES, MATRIX_CELLS = 256, 300_000, 1 << 19
NONE = np.int32(2**31 - 1)
_U = np.uint64


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file's bytes, by Spark's own reader so that any store will do; plain local paths are read here."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Encodes pieces by the ranks in a tiktoken file."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("the rank file lacks single bytes")
        keys, values = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.tables = self._hashed(np.array(keys, _U), np.array(values, np.int32))
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _slot(keys: np.ndarray, k: int, bits: int) -> np.ndarray:
        return ((keys ^ (keys >> _U(29))) * _U(0x9E3779B97F4A7C15 + 2 * 0x51ED2701 * k) >> _U(64 - bits)).astype(np.int64)

    def _hashed(self, keys: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Flat tables in order, sparse ones; a pair that meets a taken slot goes on to the next table."""
        tables = []
        while len(keys):
            bits = max(8, len(keys).bit_length() + 2)
            slot = self._slot(keys, len(tables), bits)
            held, rank = np.full(1 << bits, ~_U(0)), np.full(1 << bits, NONE, np.int32)
            _, first = np.unique(slot, return_index=True)
            held[slot[first]], rank[slot[first]] = keys[first], values[first]
            tables.append((held, rank))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]
        return tables

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(_U) << _U(32) | b.astype(_U)
        out = np.full(keys.shape, NONE, np.int32)
        for k, (held, rank) in enumerate(self.tables):
            slot = self._slot(keys, k, len(held).bit_length() - 1)
            out = np.where(held[slot] == keys, rank[slot], out)
        return out

    def matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of at most ``LONG_PIECE`` bytes, which share one padded matrix."""
        size = np.array([len(p) for p in pieces])
        width = int(size.max())
        ids = np.zeros((len(pieces), width), np.int32)
        fill = np.arange(width) < size[:, None]
        ids[fill] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(pieces), width), NONE, np.int32)
        both = fill[:, 1:]
        rank[:, :-1][both] = self.pair_ranks(ids[:, :-1][both], ids[:, 1:][both])
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        row = np.arange(len(pieces))
        columns = np.arange(width)
        while len(row):
            at = rank.argmin(axis=1)
            here = np.arange(len(row))
            best = rank[here, at]
            over = best == NONE
            if over.any():
                for r in np.flatnonzero(over):
                    out[row[r]] = ids[r, : size[r]].copy()
                go = ~over
                ids, rank, row, size, at, best = ids[go], rank[go], row[go], size[go], at[go], best[go]
                if not len(row):
                    break
                width = int(size.max())
                ids, rank, columns = ids[:, :width], rank[:, :width], columns[:width]
                here = np.arange(len(row))
            gather = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, gather, 1), np.take_along_axis(rank, gather, 1)
            ids[here, at] = best
            size = size - 1
            rank[here, size - 1] = NONE
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pair_ranks(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at + 1 < size)
            rank[right, at[right]] = self.pair_ranks(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap of (rank, place) over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        heap = [(int(r), i) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        part = [piece[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if part[i] else -1
            if j < 0 or self.ranks.get(part[i] + part[j]) != r:
                continue
            part[i], part[j] = part[i] + part[j], b""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (s := self.ranks.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (s, a))
        return np.array([self.ranks[p] for p in part if p], np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces into the dictionary, short ones in buckets of similar length."""
        raw = sorted(((p, p.encode()) for p in pieces), key=lambda x: len(x[1]))
        i = 0
        while i < len(raw):
            if len(raw[i][1]) > LONG_PIECE:
                self.known[raw[i][0]] = self.long(raw[i][1]).astype("<u4").tobytes()
                i += 1
                continue
            j = i
            most = len(raw[i][1]) + max(1, len(raw[i][1]) // 8)
            while j < len(raw) and len(raw[j][1]) <= min(most, LONG_PIECE) and (j - i) * most < MATRIX_CELLS:
                j += 1
            for (name, _), ids in zip(raw[i:j], self.matrix([b for _, b in raw[i:j]]), strict=True):
                self.known[name] = ids.astype("<u4").tobytes()
            i = j

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        for i in range(0, len(texts), 64):
            split = [self.pattern.findall(t) for t in texts[i : i + 64]]
            if len(self.known) > CACHE_PIECES:
                self.known.clear()
            new = {p for pieces in split for p in pieces}.difference(self.known)
            if new:
                self.learn(list(new))
            for pieces in split:
                yield b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        out = []
        every = np.frombuffer(ids, "<u4")
        for i in range(0, len(every), 1 << 16):
            out.append(b"".join(map(self.tokens.__getitem__, every[i : i + (1 << 16)].tolist())))
        return b"".join(out)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(ranks: bytes, pattern: str) -> Encoder:
    """One encoder for each Python worker."""
    key = (hashlib.sha256(ranks).hexdigest(), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``ids`` (binary, little-endian uint32) and ``decoded`` (binary)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))
    source = df.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = list(enc.encode([t or "" for t in part.column("_t").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(ids, pa.binary()), pa.array([enc.decode(x) for x in ids], pa.binary())], [id, "ids", "decoded"])

    schema = source.select(F.col("_id").alias(id), F.lit(b"").alias("ids"), F.lit(b"").alias("decoded")).schema
    return source.mapInArrow(run, schema)


def digests(encoded: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts and digests of what :func:`encode` gives."""
    return encoded.select(
        F.col(id),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
