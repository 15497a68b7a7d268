"""Byte-level BPE by ranks: encoding in two tiers, and decoding.

A text is cut into pre-tokens by the vocabulary's pattern. The first tier is a minimal perfect hash of the vocabulary: keys
are hashed into buckets, and a bucket's displacement sends each of its keys to a slot of its own, one slot a key. All
distinct pre-tokens of a window of texts are looked up in it at once, and a hit is certain, since the letters are compared.
The second tier takes the pre-tokens that the vocabulary doesn't hold whole: their bytes form a linked list, a heap gives
the pair of least rank (leftmost among equals), and a merge links past its right part and pushes its two new pairs. What a
miss gave is remembered by the worker, in bounded room.

The hash is built once on the driver from the vocabulary, whose size bounds it, and broadcast. Encoding is map-only. Ids
are packed as little-endian unsigned 32-bit integers; decoding joins the tokens' bytes, and gives back the text's bytes.

Cases: null and empty texts have no ids and decode to nothing. Ids of documents may be null or repeat: every row is encoded
for itself. A very long text is cut into windows between a letter or sign and a blank followed by another, where no
pre-token spans; a single pre-token of any length is merged whole. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.base import KEPT, batches_of, give_back, share, spool
from tickgrid.llm.token_store import same_letters
from tickgrid.llm.words import numbered

#: Letters that are cut into pre-tokens at once; pre-tokens of the second tier, and bytes in them, that a worker remembers twice over.
WINDOW, MISSES, MISS_BYTES = 1 << 21, 250_000, 10_000_000
#: Texts, and bytes of them, that go to Python at once.
ROWS, SIZE = 4096, 4 << 20
#: Keys a bucket of the hash on average.
PER_BUCKET = 4
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TURN = _U(0xD6E8FEB86659FD93)
_GAP = regex.compile(r"(?<=\S) (?=\S)")
_STATE: dict[str, Encoder] = {}
KEPT.append(_STATE)


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> _U(shift))) * _U(by)
    return h ^ (h >> _U(33))


def hashes(c: np.ndarray, edges: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of the runs of bytes between the edges; every byte counts."""
    power = np.multiply.accumulate(np.array([1] + [base] * int(np.diff(edges).max(initial=0)), np.uint64))
    n = np.diff(edges)
    place = np.arange(edges[-1]) - np.repeat(edges[:-1], n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + _U(1)) * power[place])])
    return _mixed((total[edges[1:]] - total[edges[:-1]]) ^ n.astype(np.uint64))


@dataclass
class PerfectHash:
    """Keys to numbers without gaps: as many slots as keys."""

    base: int
    displaced: np.ndarray  # a bucket's displacement, or -1 - slot of its only key
    letters: np.ndarray  # of all keys in the order of their slots
    edges: np.ndarray
    values: np.ndarray

    @classmethod
    def build(cls, keys: list[bytes], values: list[int]) -> PerfectHash:
        order = np.array(values, np.int64)
        c, edges = joined(keys)
        base = _BASE
        while len(np.unique(h := hashes(c, edges, base))) < len(keys):
            base = (base * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1
        n = len(keys)
        buckets = max(1, n // PER_BUCKET)
        where = (h % _U(buckets)).astype(np.int64)
        size = np.bincount(where, minlength=buckets)
        by_bucket = np.split(np.argsort(where, kind="stable"), np.cumsum(size)[:-1])
        displaced, slot, free = np.zeros(buckets, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        for b in np.argsort(-size, kind="stable").tolist():
            own = by_bucket[b]
            if size[b] <= 1:
                break
            start = 0
            while True:
                tried = np.arange(start, start + 64, dtype=np.uint64)
                to = (_mixed(h[own][None, :] ^ (tried[:, None] * _TURN)) % _U(n)).astype(np.int64)
                apart = np.sort(to, axis=1)
                good = free[to].all(axis=1) & (apart[:, 1:] != apart[:, :-1]).all(axis=1)
                if good.any():
                    at = int(good.argmax())
                    displaced[b], slot[own] = start + at, to[at]
                    free[to[at]] = False
                    break
                start += 64
        single = np.flatnonzero(size == 1)
        left = np.flatnonzero(free)
        displaced[single] = -1 - left
        for b, to in zip(single.tolist(), left.tolist(), strict=True):
            slot[by_bucket[b]] = to
        there = np.empty(n, np.int64)
        there[slot] = np.arange(n)
        c, edges = joined([keys[i] for i in there.tolist()])
        return cls(base, displaced, c, edges, order[there])

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        if not len(keys) or not len(self.values):
            return out
        c, edges = joined(keys)
        h = hashes(c, edges, self.base)
        by = self.displaced[(h % _U(len(self.displaced))).astype(np.int64)]
        slot = np.where(by < 0, -1 - by, (_mixed(h ^ (np.maximum(by, 0).astype(np.uint64) * _TURN)) % _U(len(self.values))).astype(np.int64))
        same = same_letters(c, edges[:-1], np.diff(edges), self.letters, self.edges[slot], self.edges[slot + 1] - self.edges[slot])
        out[same] = self.values[slot[same]]
        return out

    def keys(self) -> list[bytes]:
        raw = self.letters.tobytes()
        return [raw[a:z] for a, z in zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True)]


def joined(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))]).astype(np.int64)


def merged(piece: bytes, rank: dict[bytes, int], longest: int) -> list[int]:
    """Ids of a pre-token: while some neighbours' bytes together have a rank, the pair of least rank is joined, the first of equals."""
    n, get = len(piece), rank.get
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, z = heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != z:  # one of the two parts has been joined since
            continue
        end[i], end[j] = z, 0
        if z < n:
            before[z], right = i, end[z]
            if right - i <= longest and (r := get(piece[i:right])) is not None:
                heappush(heap, (r, i, right))
        left = before[i]
        if left >= 0 and z - left <= longest and (r := get(piece[left:z])) is not None:
            heappush(heap, (r, left, z))
    ids, i = [], 0
    while i < n:
        ids.append(rank[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Texts to ids and back, with what a worker remembers."""

    def __init__(self, whole: PerfectHash, pattern: str):
        self.whole, self.pattern = whole, regex.compile(pattern)
        self.rank = dict(zip(whole.keys(), whole.values.tolist(), strict=True))
        self.longest = max(map(len, self.rank))
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.misses: dict[bytes, list[int]] = {}
        self.older: dict[bytes, list[int]] = {}
        self.held = 0

    def _missed(self, piece: bytes) -> list[int]:
        """Ids of a pre-token of the second tier; when the room is full, what wasn't met since it last was is forgotten."""
        ids = self.misses.get(piece)
        if ids is None:
            ids = self.older.get(piece) or merged(piece, self.rank, self.longest)
            if len(piece) <= 256:
                if len(self.misses) >= MISSES or self.held > MISS_BYTES:
                    self.older, self.misses, self.held = self.misses, {}, 0
                self.misses[piece] = ids
                self.held += len(piece)
        return ids

    def _pieces(self, texts: list[str]) -> Iterator[tuple[list[str], list[int], list[int]]]:
        """Pre-tokens of many texts, whose they are, and how many of each: a long text goes on in the next window."""
        pieces, rows, sizes, letters = [], [], [], 0
        for row, text in enumerate(texts):
            at = 0
            while at < len(text):
                stop = len(text)
                if stop - at > WINDOW and (gap := _GAP.search(text, at + WINDOW)):
                    stop = gap.start()
                own = self.pattern.findall(text, at, stop)
                pieces += own
                rows.append(row)
                sizes.append(len(own))
                letters += stop - at
                at = stop
                if letters >= WINDOW:
                    yield pieces, rows, sizes
                    pieces, rows, sizes, letters = [], [], [], 0
        if rows:
            yield pieces, rows, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and each text's number of ids."""
        n_ids, out = np.zeros(len(texts), np.int64), []
        for pieces, rows, sizes in self._pieces(texts):
            number, distinct = numbered(pieces, "")
            keys = [p.encode() for p in distinct[1:]]
            own = self.whole.find(keys)
            n = np.ones(len(keys), np.int64)
            missed = np.flatnonzero(own < 0).tolist()
            lists = [self._missed(keys[i]) for i in missed]
            n[missed] = [len(x) for x in lists]
            ends = np.cumsum(n)
            flat = np.repeat(own, n)
            flat[flat < 0] = np.fromiter(chain.from_iterable(lists), np.int64)
            at = number - 1
            to = np.cumsum(n[at])
            out.append(flat[np.repeat(ends[at] - to, n[at]) + np.arange(to[-1])].astype("<u4"))
            bounds = np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(sizes)])]
            n_ids += np.bincount(rows, weights=np.diff(bounds), minlength=len(texts)).astype(np.int64)
        return np.concatenate(out) if out else np.zeros(0, "<u4"), n_ids

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@dataclass
class Vocabulary:
    name: str
    pattern: str
    held: Broadcast


def vocabulary(df: DataFrame, path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """A vocabulary of base64 tokens and ranks, one a line, as a perfect hash on all executors.

    Every single byte must be a token. The pattern cuts pre-tokens; by default both are those of the public 50k vocabulary.
    """
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    keys, ranks = [base64.b64decode(a) for a, _ in pairs], [int(b) for _, b in pairs]
    if len(set(keys)) < len(keys) or {bytes([b]) for b in range(256)} - set(keys):
        raise ValueError("a vocabulary holds each token once, and all single bytes")
    return Vocabulary(f"{path} {pattern}", pattern, share(df.sparkSession, PerfectHash.build(keys, ranks)))


def _encoder(v: Vocabulary) -> Encoder:
    if v.name not in _STATE:
        _STATE[v.name] = Encoder(v.held.value, v.pattern)
    return _STATE[v.name]


def _binary(parts: np.ndarray, raw: bytes) -> pa.Array:
    """Runs of raw with these lengths as binary values."""
    ends = np.concatenate([[0], np.cumsum(parts)])
    return pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.binary())


def encode(docs: DataFrame, v: Vocabulary, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and ids (packed) of every text."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = _encoder(v).encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), _binary(4 * n, ids.tobytes())], ["doc_id", "n_tokens", "ids"])
        give_back(keep=True)

    return own.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, n_tokens and ids with ``decoded``, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _encoder(v)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), pa.array([own.decode(x) for x in batch.column("ids").to_pylist()], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])
        give_back(keep=True)

    return rows.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def unpacked(rows: DataFrame) -> DataFrame:
    """doc_id and token_ids as a list of ints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.frombuffer(x, "<u4").astype(np.int32) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, token_ids array<int>")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes, written to the shared folder: few bytes a row."""
    out = rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    with batches_of(rows.sparkSession, ROWS, SIZE):
        return spool(out, "digests")
