"""Language model: hashed maximum entropy over n-gram and skip features, with a class-factored softmax.

The probability of a token is that of its class given the tokens before it, times that of the token within its class. The most frequent
tokens (HEAD_CLASSES x WIDTH of them, by training count) lie in classes by rank and have a softmax within their class; all others lie in one class for each
power of two of their training count and share its probability by count. So every token of a vocabulary of any size has its exact
count in its probability, while the weights have a fixed size. A token that training has not seen is in the class of count 0, one
symbol. In training a token counts as if it had been seen once less, which is how that class and its neighbours learn what is new in
unseen text.

Features of a position are the token before, the two before, the second and the third before alone, each hashed to a row of weights: a row
has a weight for every class, or, hashed along with a class, for every member of that class. Training goes through the documents in ROUNDS
slices. A round sums for each weight what was observed and what the model expected; their difference is the gradient of the log likelihood and
the larger of the two bounds its curvature, so their quotient is the step.

On Spark: documents become chunks of local token numbers with a dictionary (hashes and counts); the counts are summed by
token and go back to the chunks that hold it, so no task and no broadcast ever has the vocabulary. Gradients are summed by block of weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from pyspark.sql.window import Window

from ._shared import LARGE_ROWS, need, removed, send_by_value, written
from ._words import WordHasher, worker_cache

send_by_value(__name__)

WIDTH, BANDS = 64, 24
HEAD_CLASSES = WIDTH - BANDS - 1
HEAD = HEAD_CLASSES * WIDTH
CLASS_BITS, MEMBER_BITS = 12, 13
ROUNDS, RATE, SMOOTHING = 6, 0.6, 5.0
BLOCK = 128  # rows of weights
CHUNK, SLICE = 8 << 20, 256  # bytes of text of a chunk, rows that are Python objects at a time
BATCH, PIECE = 1 << 14, 1 << 10  # tokens: taken together, and whose factors lie in a core's cache together
TRANSFER = 8 << 20  # bytes of coded chunks on their way to Python
GROUP, LINES = 16, 1 << 11  # rows of weights that share a matrix product, lines that are sorted at a time

_U = np.uint64
#: Hash of the end of a text, and of what stands before its start.
END, START = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D
#: Odd multipliers of the hashes, one a feature (two for the pair), one for rows, one for classes.
MULTIPLIERS = tuple(_U(m) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
FEATURES = 4
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def bucket(doc: object) -> int:
    """CRC-32 of a document's id as text; a missing id counts as empty text."""
    return zlib.crc32(b"" if doc is None else str(doc).encode())


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**31, compressed: low halves, then high halves."""
    import pyarrow as pa

    halves = np.ascontiguousarray(numbers.astype("<u4")).view("<u2").reshape(-1, 2).T
    return pa.compress(halves.tobytes(), codec="zstd", asbytes=True) if numbers.size else b""


def unpacked(data: bytes, count: int) -> np.ndarray:
    import pyarrow as pa

    if not count:
        return np.zeros(0, np.int32)
    halves = np.frombuffer(pa.decompress(data, decompressed_size=4 * count, codec="zstd"), "<u2").reshape(2, -1)
    return halves[0].astype(np.int32) | halves[1].astype(np.int32) << 16


# documents to chunks


def _make_chunks(schema: StructType) -> Callable:
    """Of each CHUNK of text: ids of documents, their lengths, local token numbers, and the dictionary with its training counts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part, n = to_arrow_schema(schema), TaskContext.get().partitionId(), 0
        hasher = worker_cache(("hasher",), WordHasher)

        def chunk(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            nonlocal n
            words = hasher.split(texts, lambda data, hashes, start, end: hashes)
            lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
            tokens = np.empty(int(lengths.sum()), _U)
            ends = np.cumsum(lengths)
            tokens[ends - 1] = _U(END)
            inner = np.ones(len(tokens), bool)
            inner[ends - 1] = False
            tokens[inner] = np.concatenate(words) if words else 0
            known, local, count = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")  # small numbers for frequent tokens
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            local = place[local]
            trained = np.repeat([bucket(i) % 5 != 1 for i in ids], lengths)
            counts = np.bincount(local[trained], minlength=len(known))
            row = {"chunk": part << 32 | n, "ids": ids, "lengths": lengths.tolist(), "tokens": packed(local), "dictionary": known[order].tobytes(), "counts": counts.astype(np.int64).tobytes()}
            n += 1
            return pa.RecordBatch.from_pylist([row], arrow)

        ids, texts, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    ids.append(doc)
                    texts.append((text or b"").translate(LOWER))
                    size += len(texts[-1]) + 64
                    if size >= CHUNK:
                        yield chunk(ids, texts)
                        ids, texts, size = [], [], 0
        if ids:
            yield chunk(ids, texts)

    return run


def _dictionaries(batches: Iterator) -> Iterator:
    """A row for each token of a chunk, as a signed number."""
    import pyarrow as pa

    for batch in batches:
        for chunk, dictionary, counts in zip(*(batch.column(i) for i in range(3)), strict=True):
            chunk, token, count = chunk.as_py(), np.frombuffer(dictionary.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.int64)
            for at in range(0, len(token), 1 << 16):
                piece = token[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(np.full(len(piece), chunk, np.int64)), pa.array(count[at : at + (1 << 16)])], ["token", "chunk", "count"])


# the vocabulary


@dataclass(frozen=True)
class Vocabulary:
    """What all chunks need to know: training tokens, distinct ones, the head tokens by rank with their counts, and by band (bits of the count)
    the tokens of that many, and of one more."""

    tokens: int
    distinct: int
    head: np.ndarray
    head_counts: np.ndarray
    mass: np.ndarray
    mass_less_one: np.ndarray

    def place(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of head tokens, HEAD + band of others, also with one count less."""
        order = np.argsort(self.head)
        spot = np.minimum(np.searchsorted(self.head, tokens, sorter=order), max(0, len(self.head) - 1))
        rank = order[spot] if len(order) else spot
        is_head = self.head[rank] == tokens if len(order) else np.zeros(len(tokens), bool)
        return np.where(is_head, rank, HEAD + band(counts)), np.where(is_head, rank, HEAD + band(np.maximum(counts - 1, 0)))


def band(counts: np.ndarray) -> np.ndarray:
    """Bits of a count, BANDS at most."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], BANDS)


def _vocabulary(words: DataFrame) -> Vocabulary:
    """``words``: token, count of the training tokens; only figures and the head go to the driver."""
    bits = lambda c: F.least(F.length(F.bin(c)), F.lit(BANDS))
    head = words.orderBy(F.desc("count"), "token").limit(HEAD).collect()
    tokens, counts = np.array([r["token"] for r in head], np.int64), np.array([r["count"] for r in head], np.int64)
    cut = (int(counts[-1]), int(tokens[-1])) if len(head) else (0, 0)
    outside = F.when((F.col("count") < cut[0]) | ((F.col("count") == cut[0]) & (F.col("token") > cut[1])), F.col("count"))
    total, distinct, mass, less = 0, 0, np.zeros(BANDS + 1), np.zeros(BANDS + 1)
    cells = words.select("count", bits(F.col("count")).alias("own"), F.when(F.col("count") == 1, 0).otherwise(bits(F.col("count") - 1)).alias("less"), outside.alias("outside"))
    for r in cells.groupBy("own", "less").agg(F.sum("count").alias("n"), F.count("*").alias("v"), F.sum("outside").alias("t")).collect():
        total, distinct = total + r["n"], distinct + r["v"]
        mass[r["own"]] += r["t"] or 0
        less[r["less"]] += r["t"] or 0
    return Vocabulary(total, distinct, tokens, counts, mass, less)


# chunks with what the corpus knows of their tokens


def _code(vocabulary: Vocabulary, schema: StructType) -> Callable:
    """A chunk and the counts of its tokens that other chunks have too: places of its dictionary's tokens, and by document what needs no weights."""

    def run(chunk, counts):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        if not chunk.num_rows:
            return pa.Table.from_pylist([], arrow)
        row = chunk.to_pylist()[0]
        tokens, count = np.frombuffer(row["dictionary"], np.int64), np.frombuffer(row["counts"], np.int64).copy()
        order = np.argsort(tokens)
        at = order[np.searchsorted(tokens, counts.column("token").to_numpy(), sorter=order)]
        count[at] = counts.column("total").to_numpy()
        own, less = vocabulary.place(tokens, count)
        head = own < HEAD
        count[head] = vocabulary.head_counts[own[head]]
        lengths = np.array(row["lengths"], np.int64)
        local = unpacked(row["tokens"], int(lengths.sum()))
        n, v = vocabulary.tokens, vocabulary.distinct
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        within = np.zeros(len(count))
        shared = ~head & (count > 0)
        within[shared] = np.log(count[shared] / vocabulary.mass[own[shared] - HEAD])
        starts = np.cumsum(lengths) - lengths
        by_doc = lambda values: np.add.reduceat(values[local], starts).tolist() if len(lengths) else []
        feature = (tokens.view(_U) >> _U(32)).astype(np.uint32)
        out = {k: row[k] for k in ("ids", "lengths", "tokens")} | {"features": feature.tobytes(), "places": own.astype(np.uint16).tobytes(), "less": less.astype(np.uint16).tobytes()}
        out |= {"known": by_doc((count > 0).astype(np.int64)), "base": by_doc(base), "within": by_doc(within)}
        return pa.Table.from_pylist([out], arrow)

    return run


# the model


@dataclass(frozen=True)
class Weights:
    """Start values of classes and members, and a row of weights for each hashed feature."""

    class_start: np.ndarray
    member_start: np.ndarray
    classes: np.ndarray
    members: np.ndarray

    @staticmethod
    def start(vocabulary: Vocabulary) -> Weights:
        heads = np.zeros(HEAD_CLASSES * WIDTH)
        heads[: len(vocabulary.head_counts)] = vocabulary.head_counts
        heads = heads.reshape(HEAD_CLASSES, WIDTH)
        chance = np.concatenate((heads.sum(axis=1), vocabulary.mass_less_one))
        chance = (chance + 1e-3) / (chance + 1e-3).sum()
        heads = heads + 1e-6
        inner = np.log(heads / heads.sum(axis=1, keepdims=True))
        weights = lambda bits: np.zeros((1 << bits, WIDTH), np.float32)
        return Weights(np.log(chance).astype(np.float32), inner.astype(np.float32), weights(CLASS_BITS), weights(MEMBER_BITS))

    @cached_property
    def factors(self) -> Weights:
        """Exponentials of all: chances are products of these, and no position has exponentials of its own. A step is below RATE, so products
        stay within exp(FEATURES * ROUNDS * RATE) of the start."""
        return Weights(np.exp(self.class_start), np.exp(self.member_start), np.exp(self.classes), np.exp(self.members))

    def blocks(self) -> dict[int, np.ndarray]:
        both = np.concatenate((self.classes, self.members))
        return {i: both[at : at + BLOCK] for i, at in enumerate(range(0, len(both), BLOCK))}

    def with_blocks(self, blocks: dict[int, np.ndarray]) -> Weights:
        both = np.concatenate([blocks[i] for i in sorted(blocks)])
        return replace(self, classes=both[: len(self.classes)], members=both[len(self.classes) :])


def contexts(features: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Hashes of the features of each position of token ``features``; ``first`` is the position in its text."""

    def before(k: int) -> np.ndarray:
        out = np.empty_like(features)
        out[:k], out[k:] = START >> 32, features[:-k]
        out[first < k] = START >> 32
        return out

    one, two, three = before(1), before(2), before(3)
    a, b, c, d, e = MULTIPLIERS[:5]
    return [one * a, one * b ^ two * c, two * d, three * e]


def class_rows(context: list[np.ndarray]) -> list[np.ndarray]:
    return [(x * MULTIPLIERS[5] >> _U(64 - CLASS_BITS)).astype(np.int16) for x in context]


def member_rows(context: list[np.ndarray], classes: np.ndarray) -> list[np.ndarray]:
    own = (classes.astype(_U) + _U(1)) * MULTIPLIERS[6]
    return [((x ^ own) * MULTIPLIERS[5] >> _U(64 - MEMBER_BITS)).astype(np.int16) for x in context]


class Buffers:
    """What a batch needs room for, made once a chunk: arrays of megabytes cost more to get and to give back than to fill."""

    def __init__(self, sums: int = 0) -> None:
        """``sums``: rows of the largest table that is summed by row, 0 for none."""
        self.chances, self.more = np.empty((BATCH, WIDTH), np.float32), np.empty((PIECE, WIDTH), np.float32)
        if sums:
            self.sorted, self.which = np.empty((FEATURES * BATCH, WIDTH), np.float32), np.empty((FEATURES * BATCH, GROUP), np.float32)
            self.sums = np.empty((sums, WIDTH), np.float32)


def chances(factors: np.ndarray, start: np.ndarray, kind: np.ndarray | None, rows: list[np.ndarray], buffers: Buffers) -> np.ndarray:
    """Start factors (those of a position's ``kind``, if given) times those of all features, over their sum. They hold until the next call."""
    out = buffers.chances[: len(rows[0])]
    for at in range(0, len(out), PIECE):
        piece = slice(at, at + PIECE)
        mine = out[piece]
        more = buffers.more[: len(mine)]
        np.take(factors, rows[0][piece], axis=0, out=mine, mode="clip")
        for r in rows[1:]:
            mine *= np.take(factors, r[piece], axis=0, out=more, mode="clip")
        mine *= start if kind is None else np.take(start, kind[piece], axis=0, out=more, mode="clip")
        mine *= (1 / (mine @ _ONES))[:, None]
    return out


_ONES, _UNITS = np.ones(WIDTH, np.float32), np.eye(GROUP, dtype=np.float32)


def add_rows(into: np.ndarray, rows: list[np.ndarray], values: np.ndarray, buffers: Buffers) -> None:
    """``into[r] += values`` for each of the rows r. Lines of values are sorted by row; those of GROUP rows are summed by the product with a
    matrix that says which is whose, a few groups at a time."""
    at = np.concatenate(rows)
    order = np.argsort(at, kind="stable")
    at, line = at[order], order % len(values)
    bounds = np.searchsorted(at, np.arange(0, len(into) + GROUP, GROUP))
    own, sums, group = at % GROUP, buffers.sums[: len(into)], 0
    while group < len(bounds) - 1:
        stop = max(group + 1, int(np.searchsorted(bounds, bounds[group] + LINES, "right")) - 1)
        edges = bounds[group : stop + 1].tolist()
        few = slice(edges[0], edges[-1])
        lines = np.take(values, line[few], axis=0, out=buffers.sorted[: few.stop - few.start], mode="clip")
        which = np.take(_UNITS, own[few], axis=0, out=buffers.which[: few.stop - few.start], mode="clip").T
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False), group):
            np.dot(which[:, a - few.start : b - few.start], lines[a - few.start : b - few.start], out=sums[k * GROUP : (k + 1) * GROUP])
        group = stop
    into += sums


def _documents(row: dict, chosen: Callable[[int], bool] | None, places: str) -> tuple[np.ndarray, ...]:
    """Of a chunk's chosen documents: features, position in the text, place of each token; and which documents they are."""
    lengths = np.array(row["lengths"], np.int64)
    local = unpacked(row["tokens"], int(lengths.sum()))
    take = np.arange(len(lengths)) if chosen is None else np.array([i for i, doc in enumerate(row["ids"]) if chosen(bucket(doc))], np.int64)
    if len(take) < len(lengths):
        wanted = np.zeros(len(lengths), bool)
        wanted[take] = True
        local = local[np.repeat(wanted, lengths)]
    lengths = lengths[take]
    first = np.arange(len(local)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.frombuffer(row["features"], np.uint32)[local], first.astype(np.int32), np.frombuffer(row[places], np.uint16)[local], take


def _batches(features: np.ndarray, first: np.ndarray, place: np.ndarray) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray]]:
    for at in range(0, len(place), BATCH):
        back = min(at, 3)
        context = contexts(features[at - back : at + BATCH].astype(_U), first[at - back : at + BATCH])
        yield slice(at, at + BATCH), [c[back:] for c in context], place[at : at + BATCH].astype(np.int64)


def class_of(place: np.ndarray) -> np.ndarray:
    return np.where(place < HEAD, place // WIDTH, place - HEAD + HEAD_CLASSES)


def gradient(weights: Weights, row: dict, chosen: Callable[[int], bool], observed: np.ndarray, expected: np.ndarray) -> None:
    """Adds a chunk's share of what was observed and expected: a line for each class or member, rows of classes first and then those of members."""
    features, first, place, _ = _documents(row, chosen, "less")
    edge, factors = len(weights.classes), weights.factors
    buffers = Buffers(max(len(weights.classes), len(weights.members)))
    sums = np.zeros(expected.shape[::-1], np.float32)
    for _, context, there in _batches(features, first, place):
        cls = class_of(there)
        head = np.flatnonzero(there < HEAD)
        parts = [(class_rows(context), factors.classes, factors.class_start, None, cls, 0)]
        if len(head):
            rows = member_rows([c[head] for c in context], cls[head])
            parts.append((rows, factors.members, factors.member_start, cls[head], there[head] % WIDTH, edge))
        for rows, table, start, kind, label, where in parts:
            add_rows(sums[where : where + len(table)], rows, chances(table, start, kind, rows, buffers), buffers)
            seen = label * observed.shape[1] + where
            for r in rows:
                np.add.at(observed.reshape(-1), seen + r, 1.0)
    expected += sums.T


def log_probabilities(weights: Weights, row: dict) -> np.ndarray:
    """Sum by document of the logarithms of class and member probabilities."""
    features, first, place, _ = _documents(row, None, "places")
    total, factors, buffers = np.empty(len(place)), weights.factors, Buffers()
    for at, context, there in _batches(features, first, place):
        cls = class_of(there)
        p = chances(factors.classes, factors.class_start, None, class_rows(context), buffers)
        found = np.log(p[np.arange(len(p)), cls].astype(np.float64))
        head = np.flatnonzero(there < HEAD)
        if len(head):
            own = cls[head]
            p = chances(factors.members, factors.member_start, own, member_rows([c[head] for c in context], own), buffers)
            found[head] += np.log(p[np.arange(len(p)), there[head] % WIDTH].astype(np.float64))
        total[at] = found
    lengths = np.array(row["lengths"], np.int64)
    return np.add.reduceat(total, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0)


# training and scoring on Spark


def _gradients(weights: Weights, turn: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shape = (WIDTH, len(weights.classes) + len(weights.members))
        observed, expected = np.zeros(shape), np.zeros(shape[::-1]).T  # lines are added to the second
        chosen = lambda b: b % 5 != 1 and b // 5 % ROUNDS == turn
        some = False
        for batch in batches:
            for i in range(batch.num_rows):
                gradient(weights, batch.slice(i, 1).to_pylist()[0], chosen, observed, expected)
                some = True
        for i, at in enumerate(range(0, shape[1], BLOCK) if some else ()):
            shares = [np.ascontiguousarray(total[:, at : at + BLOCK].T, np.float32).tobytes() for total in (observed, expected)]
            if observed[:, at : at + BLOCK].any():
                yield pa.RecordBatch.from_pylist([{"block": i, "observed": shares[0], "expected": shares[1]}])

    return run


def _step(blocks: dict[int, np.ndarray]) -> Callable:
    """Sums the shares of each block, and moves its weights along the gradient."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                mine = sums.setdefault(row["block"], [np.zeros(blocks[row["block"]].shape) for _ in range(2)])
                for total, share in zip(mine, (row["observed"], row["expected"]), strict=True):
                    total += np.frombuffer(share, np.float32).reshape(total.shape)
        for i, (observed, expected) in sums.items():
            moved = blocks[i] + RATE * (observed - expected) / (np.maximum(observed, expected) + SMOOTHING)
            yield pa.RecordBatch.from_pylist([{"block": i, "weights": moved.astype(np.float32).tobytes()}])

    return run


def _scored(weights: Weights, vocabulary: Vocabulary, schema: StructType) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                score = (log_probabilities(weights, row) + np.array(row["within"])) / np.log(10)
                n = len(score)
                columns = [row["ids"], [bucket(i) % 5 == 1 for i in row["ids"]], row["lengths"], row["known"], [vocabulary.tokens] * n, row["base"], score]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return run


@contextmanager
def _large_rows(spark: SparkSession) -> Iterator[None]:
    """Tasks of several files hand rows of megabytes to Python a few at a time; at Spark's own 64 MB, executor and worker both hold so much of
    them, the executor in buffers that double as they grow."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, TRANSFER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def score_documents(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``df``, in logarithms to base 10.

    Learns from the documents whose crc32(id as text) mod 5 is not 1 (a missing id counts as empty text). Tokens are the words of the text, A-Z in lower
    case, parted by ASCII white space, then one end; a missing text is empty. ``base_score`` is add-half unigram probability. Rows that repeat
    count as often as they stand. Where no document is learned from, every token is unknown. An empty table gives no rows. Tokens are
    known by 64-bit hash.
    """
    need(df, id, text)
    spark = df.sparkSession
    ids = StructField("ids", ArrayType(df.schema[id].dataType))
    fields = lambda ddl: StructType([ids, *StructType.fromDDL(ddl).fields])
    shape = StructType([StructField("chunk", StructType.fromDDL("c long")["c"].dataType), *fields("lengths array<long>, tokens binary, dictionary binary, counts binary").fields])
    chunks = written(df.select(F.col(f"`{id}`"), F.col(f"`{text}`").cast("string")).mapInArrow(_make_chunks(shape), shape), "lm-chunks", LARGE_ROWS)
    pairs = chunks.select("chunk", "dictionary", "counts").mapInArrow(_dictionaries, "token long, chunk long, count long")
    whole = Window.partitionBy("token")
    pairs = pairs.withColumns({"total": F.sum("count").over(whole), "chunks": F.count("*").over(whole), "last": F.max("chunk").over(whole) == F.col("chunk")})
    pairs = written(pairs.where("total > 0").select("token", "chunk", "total", "chunks", "last"), "lm-words")
    vocabulary = _vocabulary(pairs.where("last").select("token", F.col("total").alias("count")))
    # What a chunk knows itself stays out: tokens that no other chunk has, and those of the head.
    least = int(vocabulary.head_counts[-1]) if len(vocabulary.head_counts) else 0
    sent = pairs.where((F.col("chunks") > 1) & (F.col("total") <= least)).select("chunk", "token", "total")
    shape = fields("lengths array<long>, tokens binary, features binary, places binary, less binary, known array<long>, base array<double>, within array<double>")
    coded = chunks.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(_code(vocabulary, shape), shape)
    coded = written(coded, "lm-coded", LARGE_ROWS)
    removed(chunks)
    removed(pairs)
    weights = Weights.start(vocabulary)
    # A task for each core: the gradients that are sent are bounded by the cluster, not by the table.
    spread = coded.select("ids", "lengths", "tokens", "features", "less").coalesce(spark.sparkContext.defaultParallelism)
    with _large_rows(spark):
        for turn in range(ROUNDS):
            shares = spread.mapInArrow(_gradients(weights, turn), "block long, observed binary, expected binary")
            blocks = weights.blocks()
            moved = shares.repartition("block").mapInArrow(_step(blocks), "block long, weights binary").collect()
            blocks |= {r["block"]: np.frombuffer(r["weights"], np.float32).reshape(-1, WIDTH) for r in moved}
            weights = weights.with_blocks(blocks)
    out = StructType([df.schema[id], *StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    return coded.select("ids", "lengths", "tokens", "features", "places", "known", "base", "within").mapInArrow(_scored(weights, vocabulary, out), out)
