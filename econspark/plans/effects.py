"""Level effects of several groupings at once, solved on packed cells.

Cells (one per combination of levels, with a weight and the means of some columns) lie together by the level of the largest effect, whose
effects are eliminated exactly inside a task. What is left is a linear system in the levels of the other effects. Up to DENSE levels its
matrix is summed in one pass and solved at once, and its rank is the number of parameters that the other effects add. Above that, conjugate gradients
take one pass over the packed cells a step; vectors of one number a level and column travel to the tasks and back, in pieces that are summed by piece.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from econspark.session import cut_lineage, drop_written

DENSE = 1024
WINDOW = 1 << 17  # rows that a task collapses at a time
PACK = 1 << 18  # cells of a packed row, but that a level of the largest effect is never cut
PIECE = 1 << 15  # numbers of a piece of a vector
STALLED = 200  # steps without halving the step
_PACKED = "first binary, ids binary, n binary, values binary, inside array<double>"


@dataclass
class PackedCells:
    """``table`` holds the cells; ``sizes`` are the levels of the other effects, numbered one effect after another."""

    table: DataFrame
    sizes: list[int]
    columns: int

    @property
    def levels(self) -> int:
        return sum(self.sizes)


def pack_cells(rows: DataFrame, first: str, others: dict[str, DataFrame], sizes: Sequence[int], columns: Sequence[str]) -> PackedCells:
    """``rows``: ``first``, ``others…`` and the numbers ``columns``, none of them missing.

    ``others`` has the levels of each other effect, and ``sizes`` how many there are, counted by the caller and few enough to be sent to every executor.
    Tasks collapse their own rows to cells before those are dealt out by the largest effect, so that only one number a column travels with a cell,
    and a level with many rows is no more than its cells.
    """
    offset = 0
    numbered = []
    for i, ((key, levels), size) in enumerate(zip(others.items(), sizes)):
        place = (F.row_number().over(Window.orderBy(key)) - 1 + offset).cast("int")  # one row a level, as many as counted
        ids = levels.select(key, place.alias(f"_id{i}"))
        rows = rows.join(F.broadcast(ids), key)
        numbered.append(f"_id{i}")
        offset += size
    g = F.col(first) + F.lit(0.0) if isinstance(rows.schema[first].dataType, (T.FloatType, T.DoubleType)) else F.col(first)  # one zero only
    rows = rows.select(g.alias("g"), *numbered, F.lit(1).cast("long").alias("n"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    shape = T.StructType([*rows.schema.fields, T.StructField("inside", T.BinaryType())])
    cells = rows.mapInArrow(_collapse(len(numbered), len(columns), WINDOW), shape).repartition("g").sortWithinPartitions("g")
    return PackedCells(cut_lineage(cells.mapInArrow(_pack(len(numbered), len(columns), PACK), _PACKED)), list(sizes), len(columns))


def _merged(effects: int, columns: int) -> Callable:
    """Of rows or cells in Arrow: one cell for each combination of levels, in the order in which the largest effect's levels come, and the co-moments of what
    was merged (upper triangle). What is inside of the given cells is left to the caller."""
    upper = np.triu_indices(columns)

    def merge(rows: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = rows.combine_chunks()
        own = rows.column(0).combine_chunks().dictionary_encode()
        code = own.indices.to_numpy(zero_copy_only=False)
        ids = [rows.column(1 + i).to_numpy() for i in range(effects)]
        order = np.lexsort((*ids[::-1], code))
        code, ids = code[order], np.column_stack([x[order] for x in ids])
        n = rows.column(1 + effects).to_numpy()[order].astype(np.float64)
        values = np.column_stack([rows.column(2 + effects + i).to_numpy() for i in range(columns)])[order]
        inside = np.zeros(len(upper[0]))
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        for x in ids.T:
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        if len(starts) < len(code):
            size = np.diff(starts, append=len(code))
            several = np.flatnonzero(size > 1)
            many = np.repeat(size > 1, size)
            run = np.repeat(np.arange(len(several)), size[several])
            own_n, off = n[many], values[many] - values[starts[several]][run]
            total = np.bincount(run, own_n)
            move = np.column_stack([np.bincount(run, own_n * x) for x in off.T]) / total[:, None]
            off = off - move[run]
            inside = ((off * own_n[:, None]).T @ off)[upper]
            code, ids, n, values = code[starts], ids[starts], n[starts], values[starts]
            n[several] = total
            values[several] += move
        return code, own.dictionary, ids, n, values, inside

    return merge


def _inside() -> Callable:
    """Sum of the co-moments that cells bring along."""

    def brought(rows: pa.Table, size: int) -> np.ndarray:
        return sum((np.frombuffer(x) for x in rows.column("inside").drop_null().to_pylist()), np.zeros(size))

    return brought


def _as_cells(effects: int, columns: int) -> Callable:
    """Merged cells as an Arrow table like the one given; the first brings the co-moments inside of all of them."""
    merge, brought = _merged(effects, columns), _inside()

    def cells(rows: pa.Table) -> pa.Table:
        import pyarrow as pa

        code, levels, ids, n, values, inside = merge(rows)
        inside = inside + brought(rows, len(inside))
        first = pa.array([inside.tobytes()] + [None] * (len(n) - 1), rows.schema.field("inside").type)
        arrays = [levels.take(pa.array(code)), *[pa.array(x, pa.int32()) for x in ids.T], pa.array(n.astype(np.int64)), *[pa.array(x) for x in values.T], first]
        return pa.Table.from_arrays(arrays, schema=rows.schema)

    return cells


def _collapse(effects: int, columns: int, most: int) -> Callable:
    """Rows of a task to cells: about ``most`` at a time, which stay for the next ones while they shrink to half."""
    as_cells = _as_cells(effects, columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]).append_column("inside", pa.nulls(batch.num_rows, pa.binary())))
            count += batch.num_rows
            if count >= most:
                cells = as_cells(pa.concat_tables(held))
                if cells.num_rows > most // 2:
                    yield from cells.to_batches()
                    held, count = [], 0
                else:
                    held, count = [cells], cells.num_rows
        if held:
            yield from as_cells(pa.concat_tables(held)).to_batches()

    return run


def _pack(effects: int, columns: int, most: int) -> Callable:
    merge, as_cells, brought = _merged(effects, columns), _as_cells(effects, columns), _inside()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def packed(rows: pa.Table) -> pa.RecordBatch:
            code, _, ids, n, values, inside = merge(rows)
            starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))).astype(np.int64)
            inside = inside + brought(rows, len(inside))
            binary = [np.ascontiguousarray(x).tobytes() for x in (starts, ids.astype(np.int32), n, values)]
            return pa.RecordBatch.from_arrays([*[pa.array([v], pa.binary()) for v in binary], pa.array([inside.tolist()], pa.list_(pa.float64()))], ["first", "ids", "n", "values", "inside"])

        held, full = None, most
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows >= full:
                own = held.column(0)
                same = pc.equal(own, own[-1]).combine_chunks()
                cut = same.index(pa.scalar(True)).as_py()  # the last level may go on
                if cut:
                    yield packed(held.slice(0, cut))
                    held, full = held.slice(cut), most
                else:
                    held = as_cells(held)
                    full = max(most, 2 * held.num_rows)
        if held is not None and held.num_rows:
            yield packed(held)

    return run


def _summed(table: DataFrame, share: Callable[[Iterator[dict]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """``share`` gives a task's pieces by number; equal numbers are added. There is a task for each core, so that what is sent follows the cluster."""

    def shares(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        for number, piece in share(rows).items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.ascontiguousarray(piece, np.float64).tobytes()], pa.binary())], ["number", "piece"])

    def added(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                piece = np.frombuffer(piece)
                total[number] = total[number] + piece if number in total else piece
        for number, piece in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([piece.tobytes()], pa.binary())], ["number", "piece"])

    spread = table.coalesce(max(1, table.sparkSession.sparkContext.defaultParallelism))
    pieces = spread.mapInArrow(shares, "number long, piece binary").repartition("number").mapInArrow(added, "number long, piece binary")
    return {r["number"]: np.frombuffer(r["piece"]) for r in pieces.collect()}


def _in_pieces() -> Callable:
    piece = PIECE

    def split(vector: np.ndarray) -> dict[int, np.ndarray]:
        flat = vector.ravel()
        return {i: flat[at : at + piece] for i, at in enumerate(range(0, len(flat), piece))}

    return split


def _whole(pieces: dict[int, np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    return np.concatenate([pieces[i] for i in sorted(pieces)]).reshape(shape) if pieces else np.zeros(shape)


def _unpacked(effects: int, columns: int) -> Callable:
    """Starts of the levels of the largest effect, ids, weights, values, and the weight of each of its levels."""

    def read(row: dict) -> tuple[np.ndarray, ...]:
        first, n = np.frombuffer(row["first"], np.int64), np.frombuffer(row["n"])
        return first, np.frombuffer(row["ids"], np.int32).reshape(-1, effects), n, np.frombuffer(row["values"]).reshape(-1, columns), np.add.reduceat(n, first)

    return read


def _net() -> Callable:
    """Values less their weighted mean in each level of the largest effect."""

    def net(first: np.ndarray, n: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
        means = np.add.reduceat(values * n[:, None], first, axis=0) / weight[:, None]
        return values - np.repeat(means, np.diff(first, append=len(n)), axis=0)

    return net


def _by_level(levels: int) -> Callable:
    def sums(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros((levels, values.shape[1]))
        for own in ids.T:
            for j in range(values.shape[1]):
                out[:, j] += np.bincount(own, values[:, j], levels)
        return out

    return sums


def _system(levels: int, effects: int, columns: int) -> Callable:
    """The matrix of the other effects net of the largest one, and the right-hand side."""
    read, net, by_level, split = _unpacked(effects, columns), _net(), _by_level(levels), _in_pieces()
    most = 1 << 22

    def share(rows: Iterator[dict]) -> dict[int, np.ndarray]:
        matrix, right = np.zeros(levels * levels), np.zeros((levels, columns))
        some = False
        for row in rows:
            some = True
            first, ids, n, values, weight = read(row)
            right += by_level(ids, net(first, n, weight, values) * n[:, None])
            for a in ids.T:
                for b in ids.T:
                    matrix += np.bincount(a.astype(np.int64) * levels + b, n, levels * levels)
            size = np.diff(first, append=len(n)) * effects
            flat, heavy = ids.ravel().astype(np.int64), np.repeat(n, effects)
            at = 0
            while at < len(first):  # levels of the largest effect whose pairs of cells fit
                upto = at + max(1, int(np.searchsorted(np.cumsum(size[at:].astype(np.int64) ** 2), most, side="right")))
                k = size[at:upto]
                lo = first[at] * effects
                own, mine = flat[lo : lo + k.sum()], heavy[lo : lo + k.sum()]
                if (k.astype(np.int64) ** 2).sum() > levels * levels * len(k) / 16:  # full: a product of matrices is cheaper
                    for g in range(at, upto):
                        part = slice(first[g] * effects, first[g] * effects + size[g])
                        u = np.bincount(flat[part], heavy[part], levels)
                        matrix -= np.outer(u, u / weight[g]).ravel()
                else:
                    start = np.cumsum(k) - k
                    reach = np.repeat(k, k)  # each cell meets all cells of its level
                    left = np.repeat(np.arange(len(own)), reach)
                    within = np.arange(len(left)) - np.repeat(np.cumsum(reach) - reach, reach)
                    other = np.repeat(np.repeat(start, k), reach) + within
                    share_of = mine[left] * mine[other] / np.repeat(np.repeat(weight[at:upto], k), reach)
                    matrix -= np.bincount(own[left] * levels + own[other], share_of, levels * levels)
                at = upto
        if not some:
            return {}
        return split(np.concatenate((matrix, right.ravel())))

    return share


def _product(levels: int, effects: int, columns: int, vector: np.ndarray) -> Callable:
    """The matrix of the system times ``vector`` (levels x columns)."""
    read, net, by_level, split = _unpacked(effects, columns), _net(), _by_level(levels), _in_pieces()

    def share(rows: Iterator[dict]) -> dict[int, np.ndarray]:
        total, some = np.zeros((levels, columns)), False
        for row in rows:
            some = True
            first, ids, n, _, weight = read(row)
            combined = sum(vector[own] for own in ids.T)
            total += by_level(ids, net(first, n, weight, combined) * n[:, None])
        return split(total) if some else {}

    return share


def _right_side(levels: int, effects: int, columns: int) -> Callable:
    """The right-hand side, and the weight of each level (the last column)."""
    read, net, by_level, split = _unpacked(effects, columns), _net(), _by_level(levels), _in_pieces()

    def share(rows: Iterator[dict]) -> dict[int, np.ndarray]:
        total, some = np.zeros((levels, columns + 1)), False
        for row in rows:
            some = True
            first, ids, n, values, weight = read(row)
            total += by_level(ids, np.column_stack((net(first, n, weight, values), np.ones(len(n)))) * n[:, None])
        return split(total) if some else {}

    return share


def _residuals(effects: int, columns: int, effect: np.ndarray) -> Callable:
    """Cross-products of what all effects leave of the values, and the sum of ``inside``."""
    read, net = _unpacked(effects, columns), _net()

    def share(rows: Iterator[dict]) -> dict[int, np.ndarray]:
        cross, inside = np.zeros((columns, columns)), None
        for row in rows:
            first, ids, n, values, weight = read(row)
            left = net(first, n, weight, values - sum(effect[own] for own in ids.T))
            cross += (left * n[:, None]).T @ left
            inside = np.array(row["inside"]) + (0 if inside is None else inside)
        return {} if inside is None else {0: cross.ravel(), 1: inside}

    return share


def _links(levels: int, effects: int) -> Callable:
    """By pair of effects (0 is the largest, k the k-th other one): which levels of the later one hang together, as the
    smallest level of each one's component so far."""

    def component(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``parent`` after joining each a with its b: hooks and shortcuts in whole arrays."""
        while True:
            low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
            if (low == high).all():
                return parent
            np.minimum.at(parent, high, low)
            while True:
                shorter = parent[parent]
                if (shorter == parent).all():
                    break
                parent = shorter

    def share(rows: Iterator[dict]) -> dict[int, np.ndarray]:
        pairs = {(j, k): np.arange(levels) for k in range(1, effects + 1) for j in range(k)}
        some = False
        for row in rows:
            some = True
            first, ids = np.frombuffer(row["first"], np.int64), np.frombuffer(row["ids"], np.int32).reshape(-1, effects)
            begins = np.repeat(first, np.diff(first, append=len(ids)))
            for (j, k), parent in pairs.items():
                if j == 0:
                    pairs[j, k] = component(parent, ids[:, k - 1], ids[begins, k - 1])
                else:
                    pairs[j, k] = component(parent, ids[:, j - 1], ids[:, k - 1])
        return {j * (effects + 1) + k: parent for (j, k), parent in pairs.items()} if some else {}

    return share


def components(cells: PackedCells) -> dict[tuple[int, int], int]:
    """Connected components of the graph of levels of each two effects (0 is the largest).

    Each task links the levels that its own cells join; the forests of two tasks are joined in the same way until one is left. A forest
    has one number a level of the other effects, so its size is as bounded as the packing.
    """
    effects, levels = len(cells.sizes), cells.levels
    bounds = np.cumsum([0, *cells.sizes]).tolist()
    find = _links(levels, effects)
    forest = "number long, parent binary"

    def shares(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        for number, parent in find(rows).items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([parent.astype(np.int64).tobytes()], pa.binary())], ["number", "parent"])

    def joined(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                other = np.frombuffer(data, np.int64)
                if number not in held:
                    held[number] = other.copy()
                    continue
                parent, a = held[number], np.arange(len(other))
                while True:
                    low, high = np.minimum(parent[a], parent[other]), np.maximum(parent[a], parent[other])
                    if (low == high).all():
                        break
                    np.minimum.at(parent, high, low)
                    while not (parent[parent] == parent).all():
                        parent = parent[parent]
                held[number] = parent
        for number, parent in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([parent.tobytes()], pa.binary())], ["number", "parent"])

    spread = cells.table.select("first", "ids").coalesce(max(1, cells.table.sparkSession.sparkContext.defaultParallelism))
    trees = spread.mapInArrow(shares, forest).repartition("number").mapInArrow(joined, forest)
    out = {}
    for row in trees.collect():
        j, k = divmod(row["number"], effects + 1)
        parent = np.frombuffer(row["parent"], np.int64)
        out[j, k] = len(np.unique(parent[bounds[k - 1] : bounds[k]]))
    return out


def components_by_joins(edges: DataFrame, a: str, b: str) -> int:
    """Connected components of a bipartite graph of any size, by hooking labels and shortcuts on written tables.

    Every level of ``b`` begins as its own label. In a round each label hooks onto the smallest label that a level of ``a`` ties it to,
    then labels of labels are taken until nothing changes.
    """
    edges = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    labels = cut_lineage(edges.select("b", F.col("b").alias("label")).distinct())
    while True:
        tied = edges.join(labels, "b")
        low = tied.groupBy("a").agg(F.min("label").alias("low"))
        hooks = cut_lineage(tied.join(low, "a").where("low < label").groupBy("label").agg(F.min("low").alias("to")))
        if hooks.isEmpty():
            count = labels.select("label").distinct().count()
            for table in (edges, labels, hooks):
                drop_written(table)
            return count
        moved = cut_lineage(labels.join(hooks, "label", "left").select("b", F.coalesce("to", "label").alias("label")))
        drop_written(labels)
        drop_written(hooks)
        labels = moved
        while True:
            ends = labels.select(F.col("b").alias("label"), F.col("label").alias("end"))
            moved = cut_lineage(labels.join(ends, "label").select("b", F.col("end").alias("label"), (F.col("end") != F.col("label")).alias("moved")))
            more = not moved.where("moved").isEmpty()
            drop_written(labels)
            labels = moved.drop("moved")
            if not more:
                break


@dataclass
class Solved:
    """Cross-products net of all effects, steps taken, and how many parameters the other effects add to those of the largest one: all levels
    less the redundant ones. ``exact`` is False where that is a bound (three or more effects with many levels)."""

    cross: np.ndarray
    inside: np.ndarray
    steps: int
    added: int
    exact: bool


def solve_effects(cells: PackedCells, scale: np.ndarray, tolerance: float) -> Solved:
    """``scale``: a standard deviation a column; steps stop when they change no effect by more than ``tolerance`` of it."""
    effects, levels, columns = len(cells.sizes), cells.levels, cells.columns
    if levels <= DENSE:
        system = _whole(_summed(cells.table, _system(levels, effects, columns)), (levels * levels + levels * columns,))
        matrix, right = system[: levels * levels].reshape(levels, levels), system[levels * levels :].reshape(levels, columns)
        root = np.sqrt(np.maximum(np.diag(matrix), 0))
        known = root > 1e-6 * max(root.max(initial=0.0), 1e-300)  # a level whose every cell fills a level of the largest effect adds nothing
        size = np.where(known, 1 / np.where(known, root, 1), 0)
        values, vectors = np.linalg.eigh(matrix * size[:, None] * size)
        keep = values > 1e-10
        effect = size[:, None] * (vectors[:, keep] @ ((vectors[:, keep].T @ (size[:, None] * right)) / values[keep, None]))
        rank, steps, exact = int(keep.sum()), 1, True
    else:
        effect, steps = _conjugate_gradients(cells, scale, tolerance)
        counts = components(cells)
        rank = sum(size - max(counts[j, k] for j in range(k)) for k, size in enumerate(cells.sizes, 1))
        exact = effects == 1
    pieces = _summed(cells.table, _residuals(effects, columns, effect))
    return Solved(pieces[0].reshape(columns, columns), pieces[1], steps, rank, exact)


def _conjugate_gradients(cells: PackedCells, scale: np.ndarray, tolerance: float) -> tuple[np.ndarray, int]:
    effects, levels, columns = len(cells.sizes), cells.levels, cells.columns
    start = _whole(_summed(cells.table, _right_side(levels, effects, columns)), (levels, columns + 1))
    left, weight = start[:, :-1].copy(), start[:, -1:]
    effect, towards = np.zeros((levels, columns)), left / weight
    size = (left * towards).sum(axis=0)
    direction, steps, best, since = towards.copy(), 0, math.inf, 0
    while True:
        steps += 1
        moved = _whole(_summed(cells.table, _product(levels, effects, columns, direction)), (levels, columns))
        along = (direction * moved).sum(axis=0)
        live = along > 1e-300
        step = np.where(live, size / np.where(live, along, 1.0), 0.0)
        effect += step * direction
        left -= step * moved
        change = float(np.max(step * np.abs(direction).max(axis=0, initial=0.0) / scale))
        if change < tolerance:
            return effect, steps
        best, since = (change, 0) if change < 0.5 * best else (best, since + 1)
        if since >= STALLED:
            raise RuntimeError(f"absorption stands at steps of {change:.3g} of a standard deviation after {steps} steps")
        towards = left / weight
        after = (left * towards).sum(axis=0)
        direction = towards + np.where(live & (size > 0), after / np.where(size > 0, size, 1.0), 0.0) * direction
        size = after
