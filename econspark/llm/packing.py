"""Bounded-space packing of token ids into sequences.

Each partition keeps a fixed number of open windows. Whole windows are cut off a document at once; its remainder goes to
the open window that it fills best. If it fits nowhere and no window may be opened, its beginning fills up the fullest
window, which is emitted, and the rest is placed again. Windows still open at the end of a partition are
leftovers: groups of partitions lay theirs end to end, cut them at the window length and close the last
part as sequences of powers of two, which need no padding. So no sequence is padded at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import need, send_by_value, written
from ._words import WordHasher, WordTable, chunked, worker_cache

send_by_value(__name__)

WINDOW, OPEN, END_ID = 2048, 16, 1
#: Leftovers of so many partitions meet in one task: at most GROUP * OPEN windows.
GROUP = 64
_MERGED = 1 << 62
SCHEMA = (
    "_id long, _start long, _length long, _crc long, _doc long, _seq long, _at long, _ids binary, _left boolean, _group long"
)


#: After a letter or digit at the end of a word these stand alone.
MARKS = b".,;:!?"


def word_encoder(path: str) -> Callable[[], Callable]:
    """Makes a word encoder from a tokenizer file that lower-cases, splits letters from marks, maps bytes to characters and never lets a
    piece span white space. Words of letters up to U+00FF only want lower case and go straight to its merges; other words are encoded together."""

    def make() -> WordTable:
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        merge = tokenizer.model.tokenize
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        mapped = {i: as_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(0x80, 0x100)}
        def together(words: list[str]) -> list[list[int]]:
            coded = tokenizer.encode(" ".join(words), add_special_tokens=False)
            starts = np.cumsum([0, *[len(w) + 1 for w in words]])
            at = np.searchsorted(starts, np.fromiter((a for a, _ in coded.offsets), np.int64, len(coded)), "right") - 1
            return [ids.tolist() for ids in np.split(np.array(coded.ids), np.searchsorted(at, np.arange(1, len(words))))]

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            coded: list[list[int]] = []
            other: dict[int, str] = {}
            for i, word in enumerate(b"\n".join(words).decode().split("\n")):
                if word.isalpha() and (word.isascii() or max(word) <= "ÿ"):
                    low = word.lower()
                    coded.append([t.id for t in merge(low if low.isascii() else low.translate(mapped))])
                else:
                    other[i] = word
                    coded.append([])
            places = list(other)
            for i in range(0, len(places), 256):
                for place, ids in zip(places[i : i + 256], together([other[p] for p in places[i : i + 256]]), strict=True):
                    coded[place] = ids
            count = np.fromiter(map(len, coded), np.int32, len(coded))
            return np.fromiter(chain.from_iterable(coded), np.int32, int(count.sum())), count

        return encode

    return make


class _Windows:
    """The open windows of one partition. Sequences and pieces are reported as rows of SCHEMA."""

    def __init__(self, first: int, length: int, most: int, keep_ids: bool) -> None:
        self.length, self.most, self.keep, self.next = length, most, keep_ids, first
        self.open: list[list] = []  # [used, pieces]

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        done, n, at = [], len(ids), 0
        while n - at >= self.length:
            done += self._emit([(doc, at, ids[at : at + self.length], n)])
            at += self.length
        while at < n:
            rest = n - at
            fits = [w for w in self.open if w[0] + rest <= self.length]
            if fits:
                window, take = max(fits, key=lambda w: w[0]), rest
            elif len(self.open) < self.most:
                window, take = [0, []], rest
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
                take = self.length - window[0]
            window[1].append((doc, at, ids[at : at + take], n))
            window[0] += take
            at += take
            if window[0] == self.length:
                self.open.remove(window)
                done += self._emit(window[1])
        return done

    def _emit(self, pieces: list[tuple]) -> list[tuple]:
        seq, self.next = self.next, self.next + 1
        return _rows(pieces, seq, self.keep)

    def leftovers(self, group: int) -> list[tuple]:
        return [(d, s, len(i), None, n, None, None, i.astype("<u4").tobytes(), True, group) for _, pieces in self.open for d, s, i, n in pieces]


def _rows(pieces: list[tuple], seq: int, keep: bool) -> list[tuple]:
    rows, at = [], 0
    for doc, start, ids, n in pieces:
        raw = ids.astype("<u4").tobytes()
        rows.append((doc, start, len(ids), zlib.crc32(raw), n, seq, at, raw if keep else None, False, None))
        at += len(ids)
    return rows


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int64()] * 7 + [pa.binary(), pa.bool_(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _pack_partition(make_encoder: Callable, key: tuple, end_id: int, length: int, most: int, keep_ids: bool) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        table, windows = worker_cache(key, lambda: WordTable(make_encoder(), hasher=WordHasher(MARKS))), _Windows(part << 32, length, most, keep_ids)
        for batch in batches:
            docs = zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)
            for chunk in chunked(docs):
                rows: list[tuple] = []
                for (doc, _), words in zip(chunk, table.rows([text or b"" for _, text in chunk]), strict=True):
                    rows += windows.add(doc, np.append(table.gather(words), np.int32(end_id)))
                yield _batch(rows)
        yield _batch(windows.leftovers(part // GROUP))

    return run


def _merge_group(length: int, keep_ids: bool) -> Callable:
    def run(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: (-r["_length"], r["_id"] is None, r["_id"] or 0, r["_start"], r["_ids"]))
        seq, done = _MERGED | ((rows[0]["_group"] if rows else 0) << 32), []
        left = sum(r["_length"] for r in rows)
        room = want = _next_length(left, length)
        pieces: list[tuple] = []
        for r in rows:
            ids, at = np.frombuffer(r["_ids"], "<u4"), 0
            while at < len(ids):
                take = min(room, len(ids) - at)
                pieces.append((r["_id"], r["_start"] + at, ids[at : at + take], r["_doc"]))
                at, room = at + take, room - take
                if not room:
                    done += _rows(pieces, seq, keep_ids)
                    left -= want
                    seq, pieces = seq + 1, []
                    room = want = _next_length(left, length)
        return pa.Table.from_batches([_batch(done)])

    return run


def _next_length(left: int, length: int) -> int:
    """A whole window, or else the largest power of two that is left."""
    return length if left >= length else 1 << max(left.bit_length() - 1, 0)


def pack(docs: DataFrame, tokenizer: str, length: int = WINDOW, open_windows: int = OPEN, keep_ids: bool = True, end_id: int = END_ID, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc`` id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary, little-endian uint32).

    Every document ends with ``end_id``; null and empty texts have that id alone. Repeated rows and repeated or null ids are
    packed as documents of their own. ``keep_ids=False`` leaves ids null. The pieces of the partitions are written once, so that
    emitted windows and leftovers come from the same run of each task.
    """
    need(docs, doc, text)
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = docs.select(F.col(doc).cast("long"), F.col(text).cast("string"))
    first = written(rows.mapInArrow(_pack_partition(word_encoder(tokenizer), ("words", tokenizer), end_id, length, open_windows, keep_ids), SCHEMA), "pack")
    merged = first.where("_left").groupBy("_group").applyInArrow(_merge_group(length, keep_ids), SCHEMA)
    return first.where("not _left").unionByName(merged).select(
        F.col("_id").alias(doc), *[F.col(a).alias(b) for a, b in zip(("_start", "_length", "_crc", "_doc", "_seq", "_at", "_ids"), ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"), strict=True)]
    )
