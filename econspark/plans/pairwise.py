"""Correlations of all pairs of columns, each over the rows that have both, in one read.

A batch becomes a matrix of values less a shift (the means of the task's first batch), zero where missing, and a matrix of marks. Their
products give every pair its count, sums and sums of products at once. A task turns what it has added up into centred
moments and sends them by strips of rows of the matrix; strips are merged where they meet, so no place holds more than one strip of all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from econspark.schema import number

STRIP = 32  # rows of the matrix of pairs


def pairwise_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``var1, var2, n, r`` of every two of ``cols`` in their order; r is NULL below two rows and where a column does not vary."""
    rows = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
    strips = rows.mapInArrow(_strips(len(cols), STRIP), "strip int, moments binary")
    merged = strips.repartition("strip").mapInArrow(_merged(len(cols), STRIP), "a int, b int, n long, r double")
    names = F.array(*[F.lit(c) for c in cols])
    return merged.select(F.get(names, F.col("a")).alias("var1"), F.get(names, F.col("b")).alias("var2"), "n", "r")


def _strips(p: int, strip: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, shift, sums, squares, cross = None, None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            known = ~np.isnan(x)
            if n is None:
                count = known.sum(axis=0)
                shift = np.where(known, x, 0).sum(axis=0) / np.maximum(count, 1)
                n, sums, squares, cross = (np.zeros((p, p)) for _ in range(4))
            x = np.where(known, x - shift, 0.0)
            marks = known.astype(np.float64)
            n += marks.T @ marks
            sums += x.T @ marks
            squares += (x * x).T @ marks
            cross += x.T @ x
        if n is None:
            return
        some = np.maximum(n, 1)
        parts = [n, shift[:, None] + sums / some, shift[None, :] + sums.T / some, squares - sums * sums / some, squares.T - sums.T * sums.T / some, cross - sums * sums.T / some]
        for i, at in enumerate(range(0, p, strip)):
            mine = np.stack([m[at : at + strip] for m in parts])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([mine.tobytes()], pa.binary())], ["strip", "moments"])

    return run


def _merged(p: int, strip: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = np.frombuffer(data).reshape(6, -1, p)
                if i not in held:
                    held[i] = new.copy()
                    continue
                old = held[i]
                n = np.maximum(old[0] + new[0], 1)
                da, db, weight = new[1] - old[1], new[2] - old[2], old[0] * new[0] / n
                share = new[0] / n
                old[3] += new[3] + da * da * weight
                old[4] += new[4] + db * db * weight
                old[5] += new[5] + da * db * weight
                old[1] += da * share
                old[2] += db * share
                old[0] += new[0]
        for i, (n, mean_a, mean_b, m2_a, m2_b, cross) in held.items():
            a, b = np.indices(n.shape)
            a += i * strip
            # what rounding leaves of a constant is no variation
            varies = (m2_a > 1e-26 * n * mean_a**2) & (m2_b > 1e-26 * n * mean_b**2) & (n > 1)
            with np.errstate(all="ignore"):
                r = cross / np.sqrt(m2_a * m2_b)
            take = a < b
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[take], pa.int32()), pa.array(b[take], pa.int32()), pa.array(n[take].astype(np.int64)), pa.array(r[take], mask=~varies[take])], ["a", "b", "n", "r"]
            )

    return run
