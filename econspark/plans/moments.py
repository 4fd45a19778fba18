"""Counts, means and centred cross-products: the one aggregate behind every linear estimator."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from econspark.session import cut_lineage

BUILTIN_PAIRS = 15  # beyond, sums of products around a known shift are faster than covar_pop's four buffers per pair
CODEGEN_COLUMNS = 8  # up to here sums of products stay inside one compiled aggregate
MERGE_SLOTS = (64, 8, 1)  # tasks that merge partial matrices, level by level


@dataclass(frozen=True)
class Moments:
    """n, means and co-moments Σ(v−v̄)(w−w̄) of the named columns.

    ``factor``, where it was taken, is a triangle R of the centred columns themselves: R'R are the co-moments, but R keeps the digits
    that squaring loses in nearly collinear columns.
    """

    cols: tuple[str, ...]
    n: int
    mean: np.ndarray
    comoment: np.ndarray
    factor: np.ndarray | None = None

    def at(self, names: Sequence[str]) -> list[int]:
        return [self.cols.index(c) for c in names]

    @property
    def raw(self) -> np.ndarray:
        return self.comoment + self.n * np.outer(self.mean, self.mean)

    def sd(self, name: str) -> float:
        i = self.cols.index(name)
        return float(np.sqrt(max(self.comoment[i, i], 0.0) / (self.n - 1))) if self.n > 1 else np.nan


def unpack(cols: Sequence[str], n: int, mean, upper) -> Moments:
    p = len(cols)
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = np.asarray(upper, dtype=float)
    full = full + np.triu(full, 1).T
    return Moments(tuple(cols), int(n), np.asarray(mean, dtype=float), full)


def merge(parts: Iterable[Moments]) -> Moments | None:
    total = None
    for m in parts:
        if total is None:
            total = m
            continue
        n = total.n + m.n
        d = m.mean - total.mean
        total = Moments(
            m.cols,
            n,
            total.mean + d * (m.n / n),
            total.comoment + m.comoment + np.outer(d, d) * (total.n * m.n / n),
        )
    return total


def _pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i:]]


def moments_frame(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), shift: dict[str, float] | None = None
) -> DataFrame:
    """One row per group: ``by…, n, mean, comoment`` (upper triangle, row by row).

    ``df`` must hold complete cases with double columns. Without ``by`` the result has one row.
    The built-in covariance keeps its digits at any level of the columns and in any group. Sums of products around
    ``shift`` are cheaper for many columns, and only taken where the caller knows a shift that is close to the means.
    """
    cols, by = list(cols), list(by)
    q = {c: f"`{c}`" for c in cols}
    pairs = _pairs(cols)
    # SQL text, since there are many expressions of the same form
    if shift is None or len(pairs) <= BUILTIN_PAIRS:
        mean = [f"coalesce(avg({q[c]}), 0D)" for c in cols]
        comoment = [f"coalesce(covar_pop({q[a]}, {q[b]}), 0D) * count(*)" for a, b in pairs]
    else:
        off = {c: f"({q[c]} - {shift[c]!r}D)" for c in cols}
        mean = [f"coalesce({shift[c]!r}D + sum({off[c]}) / count(*), 0D)" for c in cols]
        comoment = [
            f"coalesce(sum({off[a]} * {off[b]}) - sum({off[a]}) * sum({off[b]}) / count(*), 0D)" for a, b in pairs
        ]
    return df.groupBy(*[F.col(f"`{k}`") for k in by]).agg(
        F.count("*").alias("n"),
        F.expr(f"array({', '.join(mean)})").alias("mean"),
        F.expr(f"array({', '.join(comoment)})").alias("comoment"),
    )


def well_centred(m: Moments, loss: float = 1e6) -> bool:
    """Did sums taken around zero keep enough digits, or must they be taken again around the means?"""
    spread = np.diag(m.comoment)
    return bool(m.n == 0 or np.all(m.n * m.mean**2 <= loss * spread))


def collect_moments(df: DataFrame, cols: Sequence[str]) -> Moments:
    """Ungrouped moments on the driver: p means and p(p+1)/2 numbers, whatever the row count."""
    cols = list(cols)
    if len(cols) <= CODEGEN_COLUMNS:

        def around(shift: dict[str, float]) -> Moments:
            row = moments_frame(df, cols, shift=shift).first()
            return unpack(cols, row["n"], row["mean"], row["comoment"])

        built_in = len(_pairs(cols)) <= BUILTIN_PAIRS
        m = around(dict.fromkeys(cols, 0.0))
        return m if built_in or well_centred(m) else around(dict(zip(cols, m.mean.tolist())))
    p = len(cols)
    schema = "slot int, n long, mean binary, comoment binary"
    merged = df.select(*[f"`{c}`" for c in cols]).mapInArrow(_partial_moments(cols), schema)
    for slots in MERGE_SLOTS:  # a tree of merges inside tasks; the driver gets one matrix
        merged = merged.withColumn("slot", F.col("slot") % slots).repartition(slots, "slot").mapInArrow(_merge_rows(cols), schema)
    parts = [_moments_of(cols, r) for r in merged.collect()]
    return merge(parts) or Moments(tuple(cols), 0, np.zeros(p), np.zeros((p, p)))


def _record(slot: int, m: Moments) -> dict:
    upper = m.comoment[np.triu_indices(len(m.cols))]
    return {"slot": slot, "n": m.n, "mean": m.mean.tobytes(), "comoment": upper.tobytes()}


def _moments_of(cols: Sequence[str], row) -> Moments:
    return unpack(cols, row["n"], np.frombuffer(row["mean"]), np.frombuffer(row["comoment"]))


def _layout() -> pa.Schema:
    return pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("comoment", pa.binary())])


def _partial_moments(cols: list[str]) -> Callable:
    def run(batches):
        def parts():
            for batch in batches:
                if batch.num_rows:
                    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                    mean = x.mean(axis=0)
                    x = x - mean
                    yield Moments(tuple(cols), len(x), mean, x.T @ x)

        total = merge(parts())
        if total is not None:
            yield pa.RecordBatch.from_pylist([_record(TaskContext.get().partitionId(), total)], schema=_layout())

    return run


def _merge_rows(cols: list[str]) -> Callable:
    """Merges what a task gets, one matrix at a time."""

    def run(batches):
        held: dict[int, Moments] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                m = _moments_of(cols, row)
                held[row["slot"]] = merge([held[row["slot"]], m]) if row["slot"] in held else m
        for slot, m in held.items():
            yield pa.RecordBatch.from_pylist([_record(slot, m)], schema=_layout())

    return run


def collect_factor(df: DataFrame, m: Moments) -> np.ndarray:
    """Triangle of the columns of ``m`` less their means, by tall-skinny QR: each batch is factored, then stacks of triangles, in a tree of
    tasks. The leading column of ones takes what rounding left of the means."""
    cols, mean, p = list(m.cols), m.mean, len(m.cols)
    schema = "slot int, triangle binary"

    def emit(slot: int, triangle: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([np.ascontiguousarray(triangle).tobytes()], pa.binary())], ["slot", "triangle"])

    def local(batches):
        held = np.zeros((0, p + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - mean
                held = np.linalg.qr(np.vstack([held, np.column_stack([np.ones(len(x)), x])]), mode="r")
        if len(held):
            yield emit(TaskContext.get().partitionId(), held)

    def joined(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = np.frombuffer(data).reshape(-1, p + 1)
                held[slot] = np.linalg.qr(np.vstack([held[slot], new]), mode="r") if slot in held else new
        for slot, triangle in held.items():
            yield emit(slot, triangle)

    triangles = df.select(*[f"`{c}`" for c in cols]).mapInArrow(local, schema)
    for slots in MERGE_SLOTS:
        triangles = triangles.withColumn("slot", F.col("slot") % slots).repartition(slots, "slot").mapInArrow(joined, schema)
    found = [np.frombuffer(r["triangle"]).reshape(-1, p + 1) for r in triangles.collect()]
    whole = np.vstack([*found, np.zeros((p + 1, p + 1))])
    return np.linalg.qr(whole, mode="r")[1:, 1:]


class MomentSource:
    """Moments of a table, ungrouped (taken once, then kept) or per group (a lazy DataFrame).

    ``solve`` turns each set of moments into result rows: on the driver for the one ungrouped set,
    inside tasks for groups.
    """

    def __init__(self, df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), centred: bool = False):
        """``centred`` tells that the columns already vary around zero in every group."""
        self.df, self.cols, self.by, self.centred = df, list(dict.fromkeys(cols)), list(by), centred

    @cached_property
    def moments(self) -> Moments:
        if self.by:
            raise ValueError("grouped moments stay distributed; use frame")
        return collect_moments(self.df, self.cols)

    @cached_property
    def frame(self) -> DataFrame:
        return moments_frame(self.df, self.cols, self.by, dict.fromkeys(self.cols, 0.0) if self.centred else None)

    def pin(self) -> MomentSource:
        """Compute grouped moments once, so that several tables can be drawn from them."""
        if self.by:
            self.__dict__["frame"] = cut_lineage(self.frame)
        return self

    def solve(self, fn: Callable[[Moments], list[dict]], schema: str) -> DataFrame:
        spark = self.df.sparkSession
        names = T.StructType.fromDDL(schema).names
        if not self.by:
            rows = [tuple(_plain(r.get(c)) for c in names) for r in fn(self.moments)]
            return spark.createDataFrame(rows, T.StructType.fromDDL(schema))
        return solve_groups(self.frame, self.cols, self.by, fn, schema)


def solve_groups(
    frame: DataFrame, cols: Sequence[str], by: Sequence[str], fn: Callable, schema: str
) -> DataFrame:
    """Apply ``fn`` to every moments row; one small matrix per group, groups spread over tasks."""
    fields = T.StructType.fromDDL(schema)
    names, cols, by = fields.names, list(cols), list(by)
    out = T.StructType([*[frame.schema[k] for k in by], *fields.fields])

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                m = unpack(cols, rec["n"], rec["mean"], rec["comoment"])
                keys = [rec[k] for k in by]
                rows += [keys + [_plain(r.get(c)) for c in names] for r in fn(m)]
            yield pd.DataFrame(rows, columns=[*by, *names]).astype(object)

    return frame.mapInPandas(run, out)


def _plain(v):
    """Python scalars for Spark; NaN becomes NULL."""
    if isinstance(v, (float, np.floating)):
        return None if np.isnan(v) else float(v)
    if isinstance(v, np.bool_):
        return bool(v)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, np.ndarray):
        return [_plain(x) for x in v.tolist()]
    return v
