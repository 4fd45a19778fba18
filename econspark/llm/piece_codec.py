"""SentencePiece encoding and decoding with a batched Viterbi search in numpy.

A text is cut into units that no piece spans: a blank with what follows it up to the next blank or line feed. Each distinct unit is
encoded once per worker table. Units of equal length are rows of one matrix of code points and advance together: at each end position, all
substrings that end there are hashed by differences of running polynomials, looked up in the sorted piece keys, and a row-wise maximum
of path scores stores the best beginning. The path with the highest sum of piece scores wins; ties go to the longer last piece.
Characters of no piece become byte tokens. Decoding concatenates the bytes of the pieces and gives the exact text back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ._shared import need, send_by_value
from ._words import CHUNK, UnitHasher, WordTable, chunked, mix, worker_cache

send_by_value(__name__)

BLANK = "▁"
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Where a model's scores are merge ranks, a piece of rank r counts as about as likely as 1 / (r + RANK_OFFSET), so that sums along a path make sense.
RANK_OFFSET = 100.0
#: Pieces with lower scores are never built from text; an unknown character costs this much more than the worst piece.
LEAST_SCORE, UNKNOWN_PENALTY = -1e8, 10.0
#: Most substrings are no piece: a table over the first bits of the keys tells without a search.
SIEVE_BITS = 21
#: Equal-length groups up to here; longer units share padded groups.
EQUAL_UP_TO = 64


class Codec:
    """A piece model: sorted hash keys, scores, and the bytes of every id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        scores = np.array([model.get_score(i) for i in range(size)])
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.byte_id = np.full(256, -1, np.int32)
        self.bytes: list[bytes] = []
        for i, piece in enumerate(pieces):
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            self.bytes.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else piece.replace(BLANK, " ").encode())
        use = [i for i in range(size) if not special[i] and not model.is_byte(i) and (scores[i] > LEAST_SCORE or len(pieces[i]) == 1)]
        built = scores > LEAST_SCORE
        ranked = np.sort(-scores[built & (scores < 0)])
        if len(ranked) and (ranked == np.floor(ranked)).all() and (np.diff(ranked) > 0).all():  # whole and different: merge ranks
            scores = np.where(built, -np.log(np.maximum(-scores, 0) + RANK_OFFSET), -np.inf)
        self.unknown = float(scores[built].min()) - UNKNOWN_PENALTY
        scores = np.maximum(scores, self.unknown)  # single characters are as likely as unknown ones at least
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte fallback")
        if any("\n" in pieces[i] or BLANK in pieces[i][1:] for i in use):
            raise ValueError("a piece spans blanks or lines")
        self.longest = max(len(pieces[i]) for i in use)
        steps = np.full(4096, _BASE, _U)
        steps[0] = 1
        self.power, steps[1:] = np.cumprod(steps), _INVERSE
        self.inverse = np.cumprod(steps)
        keys = np.array([self._key(pieces[i].replace(BLANK, " ")) for i in use], _U)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array(use, np.int32)[order], scores[use][order]
        self.shift = _U(64 - SIEVE_BITS)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(self.keys >> self.shift).astype(np.intp)] = True
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")

    def _key(self, piece: str) -> int:
        codes = mix(np.frombuffer(piece.encode("utf-32-le"), "<u4").astype(_U) + _U(1))
        return int(mix((codes * self.power[: len(codes)]).sum(keepdims=True) + _U(len(codes)))[0])

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in one array, and each unit's number of ids."""
        texts = [u.decode() for u in units]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        coded: list = [None] * len(texts)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            length = int(lengths[order[at]])
            end = int(np.searchsorted(lengths[order], length, "right")) if length <= EQUAL_UP_TO else at + 1
            while length > EQUAL_UP_TO and end < len(order) and int(lengths[order[end]]) * (end + 1 - at) <= CHUNK:
                end += 1
            end = min(end, at + max(1, CHUNK // (8 * max(length, 1))))
            group = order[at:end]
            for i, ids in zip(group.tolist(), self._viterbi([texts[i] for i in group.tolist()], lengths[group]), strict=True):
                coded[i] = ids
            at = end
        count = np.fromiter(map(len, coded), np.int32, len(coded))
        return (np.concatenate(coded) if coded else np.zeros(0, np.int32)), count

    def _viterbi(self, texts: list[str], lengths: np.ndarray) -> list[np.ndarray]:
        n, longest = len(texts), int(lengths.max())
        if longest >= len(self.power):
            steps = np.full(longest + 1, _BASE, _U)
            steps[0] = 1
            self.power, steps[1:] = np.cumprod(steps), _INVERSE
            self.inverse = np.cumprod(steps)
        codes = np.zeros((n, longest), np.uint32)
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        codes[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        codes[codes == ord(BLANK)] = 0x110000  # the sign itself is not a blank: byte tokens
        running = np.zeros((n, longest + 1), _U)
        np.cumsum(mix(codes.astype(_U) + _U(1)) * self.power[:longest], axis=1, out=running[:, 1:])
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0.0
        back, token = np.zeros((n, longest + 1), np.int32), np.full((n, longest + 1), -1, np.int32)
        every = np.arange(n)
        for end in range(1, longest + 1):
            start = max(0, end - self.longest)
            size = np.arange(end - start, 0, -1).astype(_U)
            keys = mix((running[:, end, None] - running[:, start:end]) * self.inverse[start:end] + size)
            spot, score = np.zeros(keys.shape, np.int64), np.full(keys.shape, -np.inf)
            maybe = np.nonzero(self.sieve[(keys >> self.shift).astype(np.intp)])
            sought = keys[maybe]
            at = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
            found = self.keys[at] == sought
            maybe, at = (maybe[0][found], maybe[1][found]), at[found]
            spot[maybe], score[maybe] = at, self.scores[at]
            hit = score > -np.inf
            score[:, -1] = np.where(hit[:, -1], score[:, -1], self.unknown)
            score += best[:, start:end]
            top = score.argmax(axis=1)
            best[:, end], back[:, end] = score[every, top], start + top
            token[:, end] = np.where(hit[every, top], self.ids[spot[every, top]], -1)
        out = np.empty((n, longest), np.int32)
        begins = np.empty((n, longest), np.int32)
        used, at = np.zeros(n, np.int64), lengths.copy()
        while True:
            live = np.flatnonzero(at > 0)
            if not len(live):
                break
            used[live] += 1
            out[live, longest - used[live]] = token[live, at[live]]
            begins[live, longest - used[live]] = back[live, at[live]]
            at[live] = back[live, at[live]]
        ids = np.split(out[np.arange(longest) >= (longest - used)[:, None]], np.cumsum(used)[:-1])
        for i in np.flatnonzero(((out < 0) & (np.arange(longest) >= (longest - used)[:, None])).any(axis=1)).tolist():
            starts = begins[i, longest - used[i] :].tolist()
            parts = [[t] if t >= 0 else self.byte_id[list(texts[i][s].encode())].tolist() for t, s in zip(ids[i].tolist(), starts, strict=True)]
            ids[i] = np.array([t for part in parts for t in part], np.int32)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of encoded ids; bytes that are not UTF-8 (ids from elsewhere) become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


def _column(docs: DataFrame, name: str) -> tuple[DataFrame, int]:
    need(docs, name)
    return docs, docs.columns.index(name)


def encode_pieces(docs: DataFrame, model: str, text: str = "text", into: str = "pieces") -> DataFrame:
    """``docs`` with the ids of each text (array<int>). Null gives null, an empty text no ids; repeated rows are encoded alike;
    a column named ``into`` is replaced unless it is the text. One pass, no shuffle."""
    need(docs, text)
    docs, at = _column(docs.drop(into) if into != text else docs, text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = worker_cache(("pieces", model), lambda: WordTable(worker_cache(("codec", model), lambda: Codec(model)).encode, hasher=UnitHasher(), most=1 << 20))
        for batch in batches:
            at_row = 0
            for chunk in chunked((None, v.as_py()) for v in batch.column(at).cast(pa.binary())):
                part, at_row = batch.slice(at_row, len(chunk)), at_row + len(chunk)
                coded = [table.gather(rows) for rows in table.rows([t or b"" for _, t in chunk])]
                ends = np.cumsum([0, *map(len, coded)]).astype(np.int32)
                null = np.array([*(t is None for _, t in chunk), False])
                column = pa.ListArray.from_arrays(pa.array(ends, mask=null if null.any() else None), pa.array(np.concatenate(coded), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*batch.schema.names, into])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, ArrayType(IntegerType()))]))


def decode_pieces(docs: DataFrame, model: str, pieces: str = "pieces", into: str = "decoded") -> DataFrame:
    """``docs`` with the text of each row's ids; null gives null, null ids are passed over. A column named ``into`` is replaced."""
    docs, at = _column(docs.drop(into) if into != pieces else docs, pieces)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = worker_cache(("codec", model), lambda: Codec(model))
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [None if v is None else codec.decode([i for i in v if i is not None]) for v in (x.as_py() for x in part.column(at))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, StringType())]))


def byte_tokens(pieces: str, first: int = 3) -> Column:
    """Number of byte tokens among the ids, whose 256 ids start at ``first``."""
    return F.size(F.filter(pieces, lambda i: (i >= first) & (i < first + 256)))

