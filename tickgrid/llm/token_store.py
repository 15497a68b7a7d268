"""Token ids in Parquet: list columns in id order, with chosen encodings, row groups and page indexes.

Documents are range-partitioned by id, sorted inside each partition and encoded there; every file holds one range, so
that ids ascend through the files by their part number. Ids are written as a list of ints with a dictionary; the
narrow columns (id, part, offset in the part, length) use the delta encodings of Parquet's second version, and row
groups and pages are sized so that the page index lets a reader fetch a range of documents, or only the metadata.
The start of a document among all ids is its offset plus the lengths of the parts before, one row per file.

The tokenizer runs on the distinct pieces of the text, as its own rules cut it: numpy finds the pieces of many texts at
once, equal pieces are met by sorting their hashes and compared letter by letter, and each distinct one is encoded once a
worker while a bounded cache holds it. Words with rarer letters are encoded by themselves, texts with unusual blanks or
control strings as a whole. The vocabulary's added tokens, as <|endoftext|>, are read in a text as the library reads
them: each becomes its own id.

Cases: null text is an empty text: only the end id. Rows with a null id come first; equal ids are ordered by text. An
empty table gives no rows. Very long texts are one list each.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickgrid.llm.base import KEPT, batches_of, fresh, give_back, spool

END = 1
#: Pieces, and letters in them, that a worker remembers; the cache is emptied beyond either.
CACHE, CACHE_LETTERS = 700_000, 11_000_000
#: Letters that are cut into pieces at once.
WINDOW = 1 << 19
#: Texts that go to Python, and are encoded, at once.
ROWS = 512
#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 32 << 20, 256 << 10
#: The letters for which the vocabulary's rules are applied here, its contractions, and blanks it reads otherwise.
_LETTERS = "!-~À-ÖØ-öø-įı-ňŊ-ž"
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_ODD_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_PLAIN = re.compile(rf"[ \t\n\r\f\v{_LETTERS}]*+")
_ODD_WORD = re.compile(rf"(?<!\S)[{_LETTERS}]*+[^\s{_LETTERS}]\S*")
_GAP = re.compile(r"[\s\x00]")
#: Marks that stand for the end of a text and for a part that the library encodes.
_END, _ODD = "\x00", "\x01"
#: 0 blank, 1 letter, 2 digit, 3 sign, 4 end of a text, 5 part for the library.
_CLASS = np.array([4, 5, *(0 if (c := chr(i)).isspace() else 1 if c.isalpha() else 2 if c.isdecimal() else 3 for i in range(2, 0x180))], np.uint8)
_STATE: dict[str, PieceEncoder] = {}
KEPT.append(_STATE)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def same_letters(c: np.ndarray, at: np.ndarray, size: np.ndarray, d: np.ndarray, there: np.ndarray, size_there: np.ndarray) -> np.ndarray:
    """Whether each run of letters of c is the same as its run of d."""
    same = size == size_there
    some = np.flatnonzero(same & ((at != there) | (c is not d)))
    n = size[some]
    runs = np.cumsum(n)
    place = np.arange(runs[-1] if len(runs) else 0)
    differ = np.flatnonzero(c[place + np.repeat(at[some] - runs + n, n)] != d[place + np.repeat(there[some] - runs + n, n)])
    same[some[np.searchsorted(runs, differ, "right")]] = False
    return same


class PieceEncoder:
    """Encodes texts to ids, as the library does for each whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        letters = {chr(i): ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(i))[0][0] for i in [*range(33, 127), *range(0xC0, 0x180)]}
        self.spelled = str.maketrans({a: b for a, b in letters.items() if a != b})
        self.power = self.inverse = np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        """Slot i holds letters[edges[i]:edges[i + 1]] and their ids[bounds[i]:bounds[i + 1]]; slot 0 is a text's end.

        Hashes of pieces are in order, each with its slot: about 60 bytes a piece, with no object of Python's.
        """
        self.room: dict[str, np.ndarray] = {}
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.letters, self.edges = np.zeros(0, np.uint16), np.array([0, 0], np.int64)
        self.ids, self.bounds = np.array([END], np.int32), np.array([0, 1], np.int64)

    def _longer(self, name: str, more: np.ndarray) -> np.ndarray:
        """An array with more at its end, in the room kept behind it; that grows by a quarter when it is full."""
        now = getattr(self, name)
        n, room = len(now), self.room.get(name)
        if room is None or len(room) < n + len(more):
            room = self.room[name] = np.empty((n + len(more)) * 5 // 4 + 64, now.dtype)
            room[:n] = now
        room[n : n + len(more)] = more
        return room[: n + len(more)]

    def learn(self, pieces: list[str]) -> np.ndarray:
        """New slots for pieces, encoded in one call, parted by blanks that no piece holds; ids are cut where the word changes."""
        line = " ".join([p if p.isascii() else p.translate(self.spelled) for p in pieces])
        e = self.bare.encode(line, add_special_tokens=False)
        ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(pieces)), "right")
        new = len(self.bounds) - 1 + np.arange(len(pieces))
        self.bounds = self._longer("bounds", self.bounds[-1] + ends)
        self.ids = self._longer("ids", np.array(e.ids, np.int32))
        self.letters = self._longer("letters", np.frombuffer("".join(pieces).encode("utf-16-le"), "<u2"))
        self.edges = self._longer("edges", self.edges[-1] + np.cumsum([len(p) for p in pieces]))
        return new

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by the end id, and each text's number of ids."""
        odd: list[str] = []

        def set_aside(m: re.Match | str) -> str:
            odd.append(m if isinstance(m, str) else m[0])
            return _ODD

        parts = [set_aside(t) if "<|" in t else t if _PLAIN.fullmatch(t) else set_aside(t) if _ODD_BLANK.search(t) else _ODD_WORD.sub(set_aside, t) for t in batch]
        odd_ids = iter([np.array(e.ids, np.int32) for e in self.whole.encode_batch_fast(odd, add_special_tokens=False)])
        line = "".join(p + _END for p in parts).lower()
        ids, ends, at, done = [], [], 0, 0
        while at < len(line):
            stop = at + WINDOW
            if stop < len(line):  # end after a gap; a longer run without one is taken whole
                gap = max(line.rfind(c, at, stop) for c in (" ", "\n", _END))
                stop = (gap if gap >= at else _GAP.search(line, stop).start()) + 1
            own, own_ends = self._window(line[at:stop], odd_ids)
            ids.append(own)
            ends.append(own_ends + done)
            at, done = stop, done + len(own)
        ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.diff(ends, prepend=0)

    def _pieces(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and classes of the pieces of letters c."""
        k = _CLASS[c]
        new = np.concatenate([[True], k[1:] != k[:-1]]) | (k == 2) | (k >= 4)
        mark = np.flatnonzero(c == ord("'"))
        mark = mark[(mark == 0) | (k[mark - 1] != 3)]  # inside a run of signs it is one of them
        after = np.concatenate([c, np.zeros(3, c.dtype)])
        for form in _CONTRACTIONS:
            at = mark[np.logical_and.reduce([after[mark + i] == ord(x) for i, x in enumerate(form)])]
            new[at + 1] = False
            new[(at + len(form))[at + len(form) < len(c)]] = True
        starts = np.flatnonzero(new)
        kind, ends = k[starts], np.append(starts[1:], len(c))
        held = kind != 0
        return starts[held], ends[held], kind[held]

    def _hashes(self, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(c):
            base = 0x9E3779B97F4A7C15
            self.power, self.inverse = (np.multiply.accumulate(np.array([1] + [b] * len(c), np.uint64)) for b in (base, pow(base, -1, 1 << 64)))
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum((c + np.uint64(1)) * self.power[: len(c)], out=total[1:])
        return (total[ends] - total[starts]) * self.inverse[starts]

    def _slots(self, line: str, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of the pieces: one look-up for all with one hash, and one for each whose letters differ."""
        h, size = self._hashes(c, starts, ends), ends - starts
        order = np.argsort(h)
        h = h[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(first) - 1
        one, h = order[first], h[first]
        at = np.searchsorted(self.hashes, h)
        known = np.flatnonzero(at < len(self.hashes))
        known = known[self.hashes[at[known]] == h[known]]
        slot = np.full(len(one), -1, np.int64)
        slot[known] = self.slots[at[known]]
        wrong = known[~same_letters(c, starts[one[known]], size[one[known]], self.letters, self.edges[slot[known]], self.edges[slot[known] + 1] - self.edges[slot[known]])]
        if len(new := np.flatnonzero(slot < 0)):
            slot[new] = self.learn([line[a:z] for a, z in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)])
            self.hashes, self.slots = np.insert(self.hashes, at[new], h[new]), np.insert(self.slots, at[new], slot[new])
        if len(wrong):
            slot[wrong] = self.learn([line[starts[i] : ends[i]] for i in one[wrong].tolist()])
        twin, slot = one[which], slot[which]
        odd = np.flatnonzero(~same_letters(c, starts, size, c, starts[twin], size[twin]))
        if len(odd):
            slot[odd] = self.learn([line[starts[i] : ends[i]] for i in odd.tolist()])
        return slot

    def _window(self, line: str, odd_ids: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a line of texts, and the places where texts end."""
        if len(self.edges) > CACHE or self.edges[-1] > CACHE_LETTERS:
            self.forget()
        c = np.frombuffer(line.encode("utf-16-le"), "<u2")
        starts, ends, kind = self._pieces(c)
        slot, own = np.zeros(len(kind), np.int64), kind < 4
        slot[own] = self._slots(line, c, starts[own], ends[own])
        ids, bounds = self.ids, self.bounds
        marks = np.flatnonzero(kind == 5)
        if len(marks):
            own = [next(odd_ids) for _ in marks]
            slot[marks] = len(bounds) - 1 + np.arange(len(marks))
            bounds = np.concatenate([bounds, bounds[-1] + np.cumsum([len(x) for x in own])])
            ids = np.concatenate([ids, *own])
        n = bounds[slot + 1] - bounds[slot]
        to = np.cumsum(n)
        out = ids[np.repeat(bounds[slot] - to + n, n) + np.arange(to[-1] if len(to) else 0)]
        return out, to[kind == 4]


def encoder(path: str) -> PieceEncoder:
    if path not in _STATE:
        _STATE[path] = PieceEncoder(path)
    return _STATE[path]


SCHEMA = "doc_id long, part int, offset long, n_tokens long, token_ids array<int>"


def write(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str | None = None, row_group: int = ROW_GROUP, page: int = PAGE) -> DataFrame:
    """Encode and write; returns the files as a DataFrame of SCHEMA."""
    path = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie = fresh(own, "tie")
    ranged = own.withColumn(tie, F.xxhash64("text")).repartitionByRange(max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))), F.asc_nulls_first("doc_id"), tie)
    ranged = ranged.sortWithinPartitions(F.asc_nulls_first("doc_id"), tie, "text").withColumn("part", F.spark_partition_id()).select("doc_id", "text", "part")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = encoder(path), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                ids, n = own.encode(rows.column("text").to_pylist())
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part").cast(pa.int32()), pa.array(done + ends - n), pa.array(n), lists], ["doc_id", "part", "offset", "n_tokens", "token_ids"])
                done += int(ends[-1])
        give_back(keep=True)

    with batches_of(spark, ROWS):
        return spool(
            ranged.mapInArrow(encode, SCHEMA), "tokens", compression="zstd", parquet__writer__version="PARQUET_2_0", parquet__block__size=row_group, parquet__page__size=page, parquet__page__row__count__limit=4000,
            parquet__enable__dictionary="false", **{"parquet.enable.dictionary#token_ids.list.element": "true", "parquet.dictionary.page.size": 1 << 20},
        )


def starts(files: DataFrame) -> DataFrame:
    """part -> ids in the parts before it; one row a file, read from the narrow columns alone."""
    parts = files.groupBy("part").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("n"))
    return parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, token_ids of all documents in the files."""
    return files.join(F.broadcast(starts(files)), "part").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "token_ids")


def read_documents(files: DataFrame, first: int, last: int) -> DataFrame:
    """The documents with ids in [first, last], in order of their ids; row groups and pages outside are skipped."""
    return files.where(F.col("doc_id").between(first, last)).orderBy("doc_id", "part", "offset").select("doc_id", "n_tokens", "token_ids")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids' little-endian bytes, written to the shared folder: few bytes a row."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("token_ids")
            at, raw = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        give_back()

    with batches_of(rows.sparkSession, ROWS):
        return spool(rows.select("doc_id", "start", "n_tokens", "token_ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long"), "checksums")
