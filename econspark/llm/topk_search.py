"""Exact top-k by inner product, by distributed histogram selection.

Rows lie in blocks of ids and a matrix; so do the queries. Blocks meet in tiles, some row blocks by some query blocks, each of which is one
task's group of a cogroup: no side is small enough to be sent whole to every task, and the copies that the tiles need are not in Spark's estimate of a
join. Every pair of a query block and a row block is scored by one matrix product in its tile. A round counts, for each query, the scores in BINS equal bins of its current range; the sums over all tasks
tell the bin of the k-th score, which is the next, BINS times narrower range. Scores are whole numbers, so after log(range) rounds the range is
one value: the k-th score itself and how many ties at it belong to the result. A last pass emits the scores above it and, of
the ties, the smallest ids. No list of scores is ever gathered or sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import LARGE_ROWS, need, parts, send_by_value, written

send_by_value(__name__)

BINS, QUERY_BLOCK, ROW_BLOCK = 128, 1024, 2048
#: A side of a tile has at most so many blocks, and of row blocks as many bytes if there are several.
TILE_BLOCKS, TILE_BYTES = 32, 16 << 20
#: Scores are exact in single precision while distances between them are.
SINGLE_BELOW = 2**23
_ROWS = "block long, ids binary, wanted binary, mat binary"
_QUERIES = "qb long, q_ids binary, q_block binary, q_pos binary, q_mat binary"


def _matrix(column, width: int, kind: str) -> np.ndarray:
    """List column as rows of floats of a ``kind``, padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), kind)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _make_blocks(width: int, kind: str = "f8") -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                piece = batch.slice(at, ROW_BLOCK)
                ids = piece.column(0).to_numpy()
                order = np.argsort(ids, kind="stable")  # ties are then taken from the left
                wanted = piece.column(1).to_numpy(zero_copy_only=False)[order]
                mat = _matrix(piece.column(2), width, kind)[order]
                row = (part << 32 | n, ids[order].tobytes(), wanted.astype(bool).tobytes(), mat.tobytes())
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([row[0]]), *[pa.array([r], pa.binary()) for r in row[1:]]], ["block", "ids", "wanted", "mat"])

    return run


def _query_rows(width: int, kind: str = "f8") -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for block, ids, wanted, mat in zip(*(batch.column(c) for c in ("block", "ids", "wanted", "mat")), strict=True):
                pos = np.flatnonzero(np.frombuffer(wanted.as_buffer(), bool))
                mat = np.frombuffer(mat.as_buffer(), kind).reshape(-1, width)[pos]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(ids.as_buffer(), np.int64)[pos]), pa.array(np.full(len(pos), block.as_py(), np.int64)), pa.array(pos.astype(np.int64)), pa.array([m.tobytes() for m in mat], pa.binary())],
                    ["id", "block", "pos", "vec"],
                )

    return run


def _query_blocks(batches: Iterator) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, QUERY_BLOCK):
            piece = batch.slice(at, QUERY_BLOCK)
            columns = [piece.column(i).to_numpy().tobytes() for i in range(3)]
            vectors = b"".join(piece.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), *[pa.array([c], pa.binary()) for c in (*columns, vectors)]], ["qb", "q_ids", "q_block", "q_pos", "q_mat"])
            n += 1


def _pairs(rows, sent, width: int, kind: str) -> Iterator:
    """Of a tile's row blocks and query blocks: query block, its range starts and wanted counts, query ids, and for each row block the row ids and scores.

    A query's score with its own row is -inf."""
    held = [
        (block.as_py(), np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(mat.as_buffer(), kind).reshape(-1, width)) for block, ids, mat in zip(*(rows.column(c) for c in ("block", "ids", "mat")), strict=True)
    ]
    for qb, q_ids, q_block, q_pos, q_mat, lo, want in zip(*(sent.column(c) for c in ("qb", "q_ids", "q_block", "q_pos", "q_mat", "lo", "need")), strict=True):
        q = np.frombuffer(q_mat.as_buffer(), kind).reshape(-1, width)
        home, at = np.frombuffer(q_block.as_buffer(), np.int64), np.frombuffer(q_pos.as_buffer(), np.int64)

        def scores(q=q, home=home, at=at) -> Iterator:
            for block, ids, mat in held:
                out = q @ mat.T
                own = np.flatnonzero(home == block)
                out[own, at[own]] = -np.inf
                yield ids, out

        yield qb.as_py(), lo.values.to_numpy().astype(kind), want.values.to_numpy(), np.frombuffer(q_ids.as_buffer(), np.int64), scores()


def _table(pieces: list[list[np.ndarray]], names: list[str]):
    import pyarrow as pa

    return pa.table([pa.array(np.concatenate(c) if pieces else np.empty(0, np.int64), pa.int64()) for c in (zip(*pieces, strict=True) if pieces else names)], names)


def _histograms(width: int, step: int, kind: str = "f8") -> Callable:
    def run(rows, sent):
        pieces = []
        for qb, lo, _, _, scored in _pairs(rows, sent, width, kind):
            total, first = np.zeros(len(lo) * BINS, np.int64), np.arange(len(lo), dtype=kind)[:, None] * BINS
            for _, scores in scored:
                scores -= lo[:, None]
                scores /= step  # a power of two: exact
                inside = (scores >= 0) & (scores < BINS)
                np.floor(scores, out=scores)
                scores += first
                total += np.bincount(scores[inside].astype(np.int64), minlength=len(total))
            pieces.append([np.full(len(lo), qb, np.int64), np.arange(len(lo)), *total.reshape(-1, BINS).T])
        return _table(pieces, ["qb", "pos", *[f"b{i}" for i in range(BINS)]])

    return run


def _narrow(step: int) -> Callable:
    """From each query's histogram: the bin of its k-th score, and how many of that bin are wanted."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts = np.column_stack([batch.column(i + 4).to_numpy() for i in range(BINS)])
            lo, want = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            from_top = np.cumsum(counts[:, ::-1], axis=1)
            enough = from_top >= want[:, None]
            at = np.where(enough.any(axis=1), enough.argmax(axis=1), BINS - 1)  # too few scores: the lowest bin
            above = np.where(at > 0, np.take_along_axis(from_top, np.maximum(at - 1, 0)[:, None], 1)[:, 0], 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lo + (BINS - 1 - at) * step), pa.array(want - above)], ["qb", "pos", "lo", "need"])

    return run


def _first_ties(i: np.ndarray, tie: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Which finds to keep, ordered by query ``i``: all that are no tie, and of each query's ties the first ``want``."""
    first, ties = np.searchsorted(i, i), np.cumsum(tie)
    return ~tie | (ties - (ties - tie)[first] <= want[i])


def _emit(width: int, kind: str = "f8") -> Callable:
    def run(rows, sent):
        pieces = []
        for qb, kth, want, q_ids, scored in _pairs(rows, sent, width, kind):
            finds = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind))]
            for ids, scores in scored:
                i, j = np.nonzero(scores >= kth[:, None])
                found = scores[i, j]
                take = _first_ties(i, found == kth[i], want)
                finds.append((i[take], ids[j[take]], found[take]))
            i, ids, found = map(np.concatenate, zip(*finds, strict=True))
            order = np.lexsort((ids, i))
            i, ids, found = i[order], ids[order], found[order]
            take = _first_ties(i, found == kth[i], want)
            i, ids, found = i[take], ids[take], found[take]
            pieces.append([np.full(len(i), qb, np.int64), i, q_ids[i], ids, found.astype(np.int64)])
        return _table(pieces, ["qb", "pos", "query_id", "id", "score"])

    return run


def _groups(rows: int, queries: int, width: int, kind: str, tasks: int) -> tuple[int, int]:
    """Groups of row blocks and of query blocks: some tiles a task, shaped for few copies, and none beyond its size."""
    row_blocks, query_blocks = max(1, -(-rows // ROW_BLOCK)), max(1, -(-queries // QUERY_BLOCK))
    deep = max(1, min(TILE_BLOCKS, TILE_BYTES // (ROW_BLOCK * width * np.dtype(kind).itemsize)))
    tiles = 16 * tasks
    of_queries = max(-(-query_blocks // deep), min(query_blocks, round((tiles * queries / max(1, rows)) ** 0.5)), 1)
    return max(-(-row_blocks // deep), min(row_blocks, -(-tiles // of_queries))), of_queries


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id`` and ``score`` of each query's ``k`` highest scores; ties go to the smaller id.

    Components x become floor(scale * x); scores are their whole-number inner products (exact below 2**53). A row that
    fits ``is_query`` is a query against every row but itself; with fewer rows all are returned. Vectors that are null or hold null
    or non-finite components, and null ids, take no part. Shorter vectors count as padded with zeros. Rows with an
    id that repeats are rows of their own. Scoring is every query against every row, as stated; row blocks
    are sent to each group of query blocks once per round, and query blocks to each group of row blocks.
    """
    need(vectors, id, vector)
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & usable).select(
        F.col(id).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("wanted"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vec")
    )
    size = rows.agg(
        F.count("*").alias("n"), F.sum(F.col("wanted").cast("long")).alias("q"), F.max(F.size("vec")).alias("d"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")
    ).first()
    n, q, width = size["n"], size["q"] or 0, max(1, size["d"] or 0)
    kind = "f4" if (size["norm"] or 0) < SINGLE_BELOW else "f8"
    if kind == "f4":
        rows = rows.withColumn("vec", F.col("vec").cast("array<float>"))
    files = [max(1, min(parts(vectors.sparkSession), -(-count // block))) for count, block in ((n, ROW_BLOCK), (q, QUERY_BLOCK))]
    blocks = written(rows.repartition(files[0]).mapInArrow(_make_blocks(width, kind), _ROWS), "topk-rows", LARGE_ROWS)
    queries = blocks.mapInArrow(_query_rows(width, kind), "id long, block long, pos long, vec binary")
    queries = written(queries.repartition(files[1]).mapInArrow(_query_blocks, _QUERIES), "topk-queries", LARGE_ROWS)
    lo = -int(size["norm"] or 0)
    reach, steps = 2 * abs(lo) + 1, [1]
    while steps[0] * BINS < reach:
        steps.insert(0, steps[0] * BINS)

    # A tile is one group of row blocks by one group of query blocks; each side is sent once to every tile of its own row or column.
    groups = _groups(n, q, width, kind, vectors.sparkSession.sparkContext.defaultParallelism)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    own = lambda column, of, count: F.pmod(F.shiftright(column, 32) + F.col(column).bitwiseAND(F.lit((1 << 32) - 1)) * of, F.lit(count).cast("long"))
    row_side = blocks.drop("wanted").withColumn("g", own("block", files[0], groups[0])).withColumn("h", every(groups[1])).groupBy("g", "h")

    def tiles(state: DataFrame, run: Callable, schema: str) -> DataFrame:
        held = state.groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "need"))).alias("s"))  # QUERY_BLOCK entries at most
        held = held.select("qb", F.col("s.lo").alias("lo"), F.col("s.need").alias("need"))
        sent = queries.hint("merge").join(held, "qb").withColumn("h", own("qb", files[1], groups[1])).withColumn("g", every(groups[0]))
        return row_side.cogroup(sent.groupBy("g", "h")).applyInArrow(run, schema)

    state = queries.select("qb", F.explode(F.sequence(F.lit(0).cast("long"), (F.length("q_ids") / 8 - 1).cast("long"))).alias("pos"), F.lit(lo).cast("long").alias("lo"), F.lit(k).cast("long").alias("need"))
    bins = [f"b{i}" for i in range(BINS)]
    for step in steps:
        seen = tiles(state, _histograms(width, step, kind), ", ".join(f"{c} long" for c in ("qb", "pos", *bins)))
        summed = seen.groupBy("qb", "pos").agg(*[F.sum(b).alias(b) for b in bins])
        state = written(state.hint("merge").join(summed, ["qb", "pos"]).select("qb", "pos", "lo", "need", *bins).mapInArrow(_narrow(step), "qb long, pos long, lo long, need long"), "topk-state")
    found = tiles(state, _emit(width, kind), "qb long, pos long, query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("qb", "pos").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id), "score")
