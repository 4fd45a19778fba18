"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

* A text is a weighted set of shingles of five words (white-space words; a shorter text is one shingle). The weight is the count in
  the text times ``1 + ln(min(N / df, TAU)) / ln(TAU)``: shingles in at most one of TAU documents have the full weight 2, more
  common ones less, down to 1. Only those more common shingles need a table. They are found exactly in two
  passes: fixed-size bucket counts name the buckets that can hold one, then the shingles in them are counted. There are at most TAU times the
  mean number of shingles per document, whatever the size of the corpus.
* Improved consistent weighted sampling draws SAMPLES samples per text in numpy. ROWS of them make a band; texts that share a band are
  candidates. At similarity 0.8 a pair shares one of the 16 bands with probability 0.9998.
* In each bucket every text is compared with the bucket's pivot: first by signature (38 of 64 samples must agree; a similar pair
  fails that once in 20 000), then by the weighted Jaccard similarity of the whole texts. These links make components, and a bucket of
  copies costs one comparison per text. Where the texts of a bucket are not one component then, blocks of them are compared
  in full by matrix products inside tasks, which emit one link per text at most. So no link between candidates is lost, and no list of pairs is made.
* Classes are the connected components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fewer, need, parts, send_by_value, written
from ._words import CHUNK, WordHasher, chunked, mix, worker_cache

send_by_value(__name__)

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
TAU = 100
#: Signatures of two texts with similarity 0.8 agree in fewer places with probability below 5e-5.
LEAST_AGREE = 38
#: Members of unresolved buckets are compared in blocks of about so many.
BLOCK, BLOCK_BYTES = 512, 1 << 24
FEATURES = 4096
#: Tables of keys and labels come in few files, so row groups bound what their writers hold.
SMALL_GROUPS = {"parquet.block.size": 16 << 20}
COUNT_BITS, COUNT_SLICE = 18, 4096

_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


class Kernel:
    """Tables that tasks need; made once per Python worker."""

    def __init__(self) -> None:
        self.hasher = worker_cache(("hasher",), WordHasher)
        # Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x).
        x = np.concatenate((np.linspace(0, 1, 200_000)[1:], np.geomspace(1, 60, 200_000)))
        gamma = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x)
        self.r, self.ln_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.seeds = mix(np.arange(1, SAMPLES + 1, dtype=_U) * _M3)

    def shingles(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted shingle hashes of each text, with repeats."""
        each = self.hasher.split(texts, lambda data, hashes, start, end: hashes)
        words = np.concatenate(each) if each else np.zeros(0, _U)
        bounds = np.cumsum([0, *map(len, each)])
        n = max(0, len(words) - SHINGLE + 1)
        whole = np.zeros(n, _U)
        for i in range(SHINGLE):
            whole += words[i : n + i] * (_M1 + _U(2 * i))
        whole = mix(whole)
        found = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                found.append(np.sort(whole[a : b - SHINGLE + 1]))
            elif b > a:
                few = words[a:b] * (_M2 + _U(2) * np.arange(b - a, dtype=_U))
                found.append(mix(few.sum(keepdims=True)))
            else:
                found.append(np.zeros(0, _U))
        return found

    def sample(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For consecutive runs of shingles (beginning at ``starts``, none empty): ln a and key of each of SAMPLES minima."""
        runs = len(starts)
        lengths = np.diff(np.append(starts, len(hashes)))
        ln_w = np.log(weights).astype(np.float32)
        least, keys = np.empty((SAMPLES, runs), np.float32), np.empty((SAMPLES, runs), _U)
        run_of = np.repeat(np.arange(runs), lengths)
        for k in range(SAMPLES):
            x = (hashes ^ self.seeds[k]) * _M1
            x ^= x >> _U(32)
            x *= _M2
            r = self.r[(x >> _U(48)).astype(np.intp)]
            ln_c = self.ln_c[((x >> _U(32)) & _U(0xFFFF)).astype(np.intp)]
            beta = ((x >> _U(16)) & _U(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(ln_w / r + beta)
            ln_a = ln_c - r * (t - beta + np.float32(1))
            low = np.minimum.reduceat(ln_a, starts)
            at = np.flatnonzero(ln_a == low[run_of])
            if len(at) > runs:  # ties: the smaller hash, which stands first
                at = at[np.unique(run_of[at], return_index=True)[1]]
            least[k] = low
            keys[k] = mix((hashes[at] + t[at].astype(np.int64).astype(_U) * _M3) ^ self.seeds[k])
        return least, keys


def weighted(sorted_hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their TF-IDF weights."""
    if not len(sorted_hashes):
        return sorted_hashes, np.zeros(0)
    first = np.flatnonzero(np.concatenate(([True], sorted_hashes[1:] != sorted_hashes[:-1])))
    distinct, weight = sorted_hashes[first], np.diff(np.append(first, len(sorted_hashes))) * 2.0
    hashes, idf = common
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
        hit = hashes[at] == distinct
        weight[hit] *= idf[at[hit]] / 2.0
    return distinct, weight


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both) if len(a[0]) and len(b[0]) else 0.0


def _kernel() -> Kernel:
    return worker_cache(("near-dedup",), Kernel)


def _texts(batches: Iterator) -> Iterator[tuple[list, list[bytes]]]:
    """Row keys (all columns but the last) and texts, some CHUNK bytes at a time."""
    import pyarrow as pa

    for batch in batches:
        n = batch.num_columns - 1
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(n)], strict=True)) if n else [()] * batch.num_rows
        values = (v.as_py() for v in batch.column(n).cast(pa.binary()))
        short: list = []
        for chunk in chunked(zip(keys, values, strict=True)):
            for row in chunk:
                if len(row[1] or b"") > CHUNK:
                    yield [row[0]], [row[1]]
                else:
                    short.append(row)
            if short:
                yield [k for k, _ in short], [t or b"" for _, t in short]
                short = []


def common_shingles(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and idf factors of the shingles in more than one of TAU documents, counted over all documents."""
    column = docs.select(F.col(text).cast("string")).where(F.col(text).isNotNull())
    total = column.count()
    floor = total // TAU + 1

    def buckets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts, kernel = np.zeros(1 << COUNT_BITS, np.int64), _kernel()
        for _, texts in _texts(batches):
            for h in kernel.shingles(texts):
                if len(h):
                    distinct = h[np.concatenate(([True], h[1:] != h[:-1]))]
                    np.add.at(counts, (distinct >> _U(64 - COUNT_BITS)).astype(np.intp), 1)
        for i in range(0, len(counts), COUNT_SLICE):
            if counts[i : i + COUNT_SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([counts[i : i + COUNT_SLICE].astype("<i4").tobytes()], pa.binary())], ["i", "counts"])

    def full(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(raw, "<i4").astype(np.int64)
        for i, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(i + np.flatnonzero(s >= floor))], ["bucket"])

    candidates = [r["bucket"] for r in column.mapInArrow(buckets, "i long, counts binary").repartition("i").mapInArrow(full, "bucket long").collect()]  # at most 2 ** COUNT_BITS
    if not candidates:
        return np.zeros(0, _U), np.zeros(0)
    wanted = np.zeros(1 << COUNT_BITS, bool)
    wanted[candidates] = True

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kernel = _kernel()
        for _, texts in _texts(batches):
            held = [h[np.concatenate(([True], h[1:] != h[:-1]))] for h in kernel.shingles(texts) if len(h)]
            flat = np.concatenate(held) if held else np.zeros(0, _U)
            h, n = np.unique(flat[wanted[(flat >> _U(64 - COUNT_BITS)).astype(np.intp)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    rows = column.mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).collect()
    hashes = np.array([r["h"] for r in rows], np.int64).view(_U)
    idf = np.array([1 + math.log(min(total / r["n"], TAU)) / math.log(TAU) for r in rows])
    order = np.argsort(hashes)
    return hashes[order], idf[order]


def _sign(common: tuple[np.ndarray, np.ndarray]) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kernel = _kernel()
        for keys, texts in _texts(batches):
            sets = [weighted(h, common) for h in kernel.shingles(texts)]
            least = np.full((SAMPLES, len(sets)), np.inf, np.float32)
            best = np.zeros((SAMPLES, len(sets)), _U)
            for group in _groups([len(s[0]) for s in sets]):
                parts = [(i, sets[i][0][a:b], sets[i][1][a:b]) for i, a, b in group]
                starts = np.cumsum([0, *[len(p[1]) for p in parts[:-1]]])
                low, key = kernel.sample(np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), starts)
                for j, (i, _, _) in enumerate(parts):  # a long text comes in several parts
                    better = low[:, j] < least[:, i]
                    least[better, i], best[better, i] = low[better, j], key[better, j]
            grid = best.reshape(BANDS, ROWS, -1)
            bands = mix(np.arange(1, BANDS + 1, dtype=_U) * _M1)[:, None]
            for row in range(ROWS):
                bands = mix(bands * _M2 + grid[:, row])
            bands = bands.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.binary()),
                    pa.array([bands[:, i].tolist() if len(s[0]) else [] for i, s in enumerate(sets)], pa.list_(pa.int64())),
                    pa.array([best[:, i].astype(np.uint8).tobytes() for i in range(len(sets))], pa.binary()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["doc", "tk", "bands", "sig", "size"],
            )

    return run


def _groups(sizes: list[int], most: int = 1 << 14) -> Iterator[list[tuple[int, int, int]]]:
    """(text, from, to) in lists of about ``most`` shingles, so that the sampler's arrays stay in cache."""
    held, n = [], 0
    for i, size in enumerate(sizes):
        for a in range(0, size, most):
            held.append((i, a, min(size, a + most)))
            n += held[-1][2] - a
            if n >= most:
                yield held
                held, n = [], 0
    if held:
        yield held


def _agreeing(batches: Iterator) -> Iterator:
    """Pairs whose signatures agree well enough."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SAMPLES) for i in (2, 3))
        keep = pa.array((one == two).sum(axis=1) >= LEAST_AGREE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def _similarities(sets: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of every text of ``rows`` with every other text of ``columns`` (positions in ``sets``).

    A weight is a count times the shingle's factor, so a minimum is the number of count levels that both reach times that
    factor: sums of minima are products of 0/1 matrices, taken some features at a time.
    """
    texts = np.unique(np.concatenate((rows, columns)))
    owner = np.concatenate([np.full(len(sets[t][0]), t) for t in texts.tolist()])
    shingle = np.concatenate([sets[t][0] for t in texts.tolist()])
    weight = np.concatenate([sets[t][1] for t in texts.tolist()])
    order = np.argsort(shingle, kind="stable")
    owner, shingle, weight = owner[order], shingle[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
    size = np.diff(np.append(first, len(shingle)))
    both = np.zeros((len(sets), len(sets)), np.float32)
    shared = np.repeat(size > 1, size)
    owner, weight, size = owner[shared], weight[shared], size[size > 1]
    if len(size):
        # One column for each weight that some text has for a shingle, worth the step up to it from the weight below.
        feature = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((weight, feature))
        owner, weight, feature = owner[order], weight[order], feature[order]
        fresh = np.concatenate(([True], (feature[1:] != feature[:-1]) | (weight[1:] != weight[:-1])))
        column_of, top = feature[fresh], weight[fresh]
        below = np.concatenate(([0.0], top[:-1]))
        below[np.concatenate(([True], column_of[1:] != column_of[:-1]))] = 0.0
        own = np.cumsum(fresh) - 1  # the column of each entry's own weight; it reaches all its shingle's columns up to there
        lowest = np.searchsorted(column_of, feature)
        for a in range(0, len(top), FEATURES):
            b = min(a + FEATURES, len(top))
            held = np.zeros((len(sets), b - a), np.float32)
            some = np.flatnonzero((lowest < b) & (own >= a))
            for up in range(int((own[some] - lowest[some]).max(initial=0)) + 1):
                column = lowest[some] + up
                ok = (column <= own[some]) & (column >= a) & (column < b)
                held[owner[some[ok]], column[ok] - a] = 1.0
            both += (held * (top - below)[a:b].astype(np.float32)) @ held.T
    total = np.array([w.sum() for _, w in sets])
    grid = both[np.ix_(rows, columns)].astype(np.float64)
    union = total[rows][:, None] + total[columns][None, :] - grid
    return np.divide(grid, union, out=np.zeros_like(grid), where=union > 0)


def _block_links(common: tuple[np.ndarray, np.ndarray], threshold: float) -> Callable:
    """Links of two blocks of a bucket (or within one) between different components: one per text at most, each
    to the first text that it is connected with."""

    def run(key, table):
        import pyarrow as pa

        i, j = key[1].as_py(), key[2].as_py()
        block = np.array(table.column("block").to_pylist())
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        tk = table.column("tk").to_pylist()
        names: dict = {}
        comp = np.array([names.setdefault(c, len(names)) for c in table.column("comp").to_pylist()])
        found = []
        if len(left) and len(right) and len(names) > 1:
            kernel = _kernel()
            sets = [weighted(kernel.shingles([t])[0], common) for t in table.column("text").cast(pa.binary()).to_pylist()]
            alike = _similarities(sets, left, right)
            for x, y in np.argwhere(alike >= threshold - 1e-6).tolist():
                a, b = int(left[x]), int(right[y])
                if comp[a] != comp[b] and (1e-6 < alike[x, y] - threshold or jaccard(sets[a], sets[b]) >= threshold - 1e-9):
                    found.append((tk[a], tk[b]))
                    comp[comp == comp[b]] = comp[a]
        return pa.table({"a": pa.array([p[0] for p in found], pa.binary()), "b": pa.array([p[1] for p in found], pa.binary())})

    return run


def _verify(common: tuple[np.ndarray, np.ndarray], threshold: float) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kernel, last = _kernel(), (None, None)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [batch.column(i).cast(pa.binary()) for i in (2, 3)]
            keep = []
            for i in range(batch.num_rows):
                if last[0] != b[i]:
                    last = (b[i], weighted(kernel.shingles([texts[1][i].as_py()])[0], common))
                keep.append(jaccard(weighted(kernel.shingles([texts[0][i].as_py()])[0], common), last[1]) >= threshold - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _table(df: DataFrame, label: str) -> DataFrame:
    return written(fewer(df), label, SMALL_GROUPS)


def components(links: DataFrame) -> DataFrame:
    """``node``, ``comp`` (smallest node of its component) for every end of ``links`` (a, b).

    Each round takes the smallest label of the neighbours, then the label of the label; tables are written between rounds.
    """
    edges = links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    edges = written(edges.repartition(parts(links.sparkSession)), "edges", SMALL_GROUPS)  # finding the links keeps all its tasks
    labels = _table(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp"), F.lit(True).alias("moved")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.least("comp", "near").alias("next"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        labels = _table(step.join(jump, "next").select("node", F.least("next", "far").alias("comp"), (F.least("next", "far") != F.col("old")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", "comp")


def _classes(docs: DataFrame, threshold: float, doc: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, tk: MD5 of the text) and, for each text, (tk, root: its component)."""
    need(docs, doc, text)
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.unhex(F.md5(F.col(text).cast("string"))).alias("tk"), F.col(text).cast("string").alias("text"))
    common = common_shingles(rows, "text")
    signed = written(rows.mapInArrow(_sign(common), "doc long, tk binary, bands array<long>, sig binary, size long"), "signed")
    distinct = signed.where("tk is not null and size(bands) > 0").select("tk", "bands", "sig", "size").dropDuplicates(["tk"])
    banded = distinct.select("tk", "size", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    placed = _table(banded.join(shared, "key").select("key", "tk", "size", "n"), "placed")
    # The pivot of a bucket is the text with most company in all its buckets: in a family of copies that is the original.
    company = placed.groupBy("tk").agg(F.sum("n").alias("company"))
    pivots = placed.join(company, "tk").groupBy("key").agg(F.max(F.struct("company", "tk"))["tk"].alias("pivot"))
    members = _table(placed.join(pivots, "key").where("tk <> pivot"), "members")  # key, tk, size, n, pivot
    texts = rows.select("tk", "text").join(placed.select("tk").distinct().hint("merge"), "tk", "left_semi")
    texts = written(texts.dropDuplicates(["tk"]), "texts")

    sigs = distinct.select("tk", "sig")
    stars = members.select(F.col("tk").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = stars.join(sigs.select(F.col("tk").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("tk").alias("b"), F.col("sig").alias("sb")), "b")
    candidates = stars.select("a", "b", "sa", "sb").mapInArrow(_agreeing, "a binary, b binary")
    both = candidates.join(texts.select(F.col("tk").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("tk").alias("b"), F.col("text").alias("tb")), "b")
    comps = components(both.select("a", "b", "ta", "tb").mapInArrow(_verify(common, threshold), "a binary, b binary"))

    # Buckets whose texts (the pivot is done) are not one component yet are compared in blocks, each set of texts once.
    known = members.join(comps.select(F.col("node").alias("tk"), "comp"), "tk", "left").select("key", "tk", "size", F.coalesce("comp", "tk").alias("comp"))
    known = _table(known, "known")
    same = [F.count("*").alias("m"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("tk")).alias("x"), F.bit_xor(F.xxhash64("tk", F.lit(1))).alias("y")]
    mixed = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *same).where("lo <> hi").groupBy("m", "bytes", "x", "y").agg(F.min("key").alias("key"))
    mixed = mixed.select("key", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("bytes") / BLOCK_BYTES)).alias("blocks"))
    left = known.join(mixed, "key").join(texts, "tk").withColumn("block", F.pmod(F.xxhash64("tk"), F.col("blocks")))
    left = left.select("key", "tk", "comp", "text", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    left = left.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "tk", "comp", "text", "block")
    extra = _table(left.groupBy("key", "i", "j").applyInArrow(_block_links(common, threshold), "a binary, b binary").distinct(), "more-links")
    if not extra.isEmpty():
        to = comps.withColumnRenamed("comp", "c")
        ends = extra.join(to.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a", "left").join(to.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b", "left")
        ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
        joined = components(ends)
        every = comps.unionByName(joined.select("node", F.col("node").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp"))
        up = joined.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        comps = _table(every.join(up, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "comps")

    texts = signed.where("tk is not null").select("tk").distinct()
    return signed.select("doc", "tk"), texts.join(comps.select(F.col("node").alias("tk"), "comp"), "tk", "left").select("tk", F.coalesce("comp", "tk").alias("root"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc`` and ``class_id`` (smallest id of its class).

    Equal texts are one class whatever they hold. A null text is alone in its class (its own id); texts without words have only
    exact copies. Repeated rows and ids keep a row each; null ids never name a class unless a class has no other.
    """
    rows, roots = _classes(docs, threshold, doc, text)
    smallest = rows.where("tk is not null").groupBy("tk").agg(F.min("doc").alias("least")).join(roots, "tk")
    named = smallest.groupBy("root").agg(F.min("least").alias("class_id"))
    of_text = roots.join(named, "root").select("tk", "class_id")
    return fewer(rows.join(of_text, "tk", "left").select(F.col("doc").alias(doc), F.when(F.col("tk").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id")))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id (null ids last), of equal ids with the smallest text MD5.

    Rows with null text are all kept. Of rows that repeat id and text one is kept.
    """
    rows, roots = _classes(docs, threshold, doc, text)
    each = rows.where("tk is not null").groupBy("tk", "doc").agg(F.count("*").alias("n")).join(roots, "tk")
    first = F.min(F.struct(F.col("doc").isNull().alias("last"), F.col("doc").alias("__d"), F.col("tk").alias("__k"), F.col("n").alias("__n")))
    won = each.groupBy("root").agg(first.alias("w")).select("w.__d", "w.__k", "w.__n")
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*names, F.unhex(F.md5(F.col(text).cast("string"))).alias("__key"), F.col(doc).cast("long").alias("__doc"))
    kept = keyed.join(won, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")))
    more = kept.where("__n > 1").dropDuplicates(["__doc", "__key"])
    return kept.where("__n = 1").select(*names).unionByName(more.select(*names)).unionByName(docs.where(F.col(text).isNull()))
