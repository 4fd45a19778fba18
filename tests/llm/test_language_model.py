from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from econspark.llm import maxent_lm as lm

from .cases import awkward_documents


@pytest.fixture(scope="module")
def docs(spark):
    return awkward_documents(spark)


def held(doc) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 5 == 1


def tokens(text) -> list[str]:
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def figures(rows) -> tuple[Counter, dict]:
    """Counts of training tokens; by row what needs no weights."""
    counts = Counter(t for doc, text in rows if not held(doc) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = Counter()
    for doc, text in rows:
        ts = tokens(text)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        out[doc, held(doc), len(ts), sum(counts[t] > 0 for t in ts), n, round(base, 6)] += 1
    return counts, out


def test_counts_against_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = lm.score_documents(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == figures(rows)[1]
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_counts_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 20_000)
    monkeypatch.setattr(lm, "HEAD", 64)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4, "doc_id")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = lm.score_documents(df).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == figures(rows)[1]


def test_nothing_to_learn_from(spark, docs):
    assert lm.score_documents(docs.where("false")).count() == 0
    unseen = next(i for i in range(100) if held(i))
    df = spark.createDataFrame([(unseen, "a b"), (unseen, None)], "doc_id long, text string")
    rows = lm.score_documents(df).collect()
    assert [(r["held_out"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows] == [(True, 0, 0, 0.0)] * 2
    assert all(r["score"] <= 1e-6 for r in rows)
    out = lm.score_documents(spark.createDataFrame([("x", "a"), (None, "")], "doc_id string, text string"))
    assert sorted(r["n_tokens"] for r in out.collect()) == [1, 2]
    with pytest.raises(ValueError):
        lm.score_documents(df.drop("text"))


def test_probabilities_against_plain_sums():
    """The vectors of a batch against one position at a time, and that they sum to one over the vocabulary and the unknown."""
    rng = np.random.default_rng(2)
    vocabulary = 3000
    hashes = rng.integers(-(2**62), 2**62, vocabulary)
    counts = np.sort(rng.zipf(1.5, vocabulary).clip(1, 10**6))[::-1].astype(np.int64)
    rest = counts[lm.HEAD :]
    mass = np.bincount(lm.band(rest), weights=rest, minlength=lm.BANDS + 1)
    v = lm.Vocabulary(int(counts.sum()), vocabulary, hashes[: lm.HEAD], counts[: lm.HEAD], mass, mass)
    start = lm.Weights.start(v)
    weights = lm.replace(start, classes=rng.normal(size=start.classes.shape).astype(np.float32), members=rng.normal(size=start.members.shape).astype(np.float32))
    own, less = v.place(hashes, counts)
    assert own[: lm.HEAD].tolist() == list(range(lm.HEAD)) and (own[lm.HEAD :] == lm.HEAD + lm.band(rest)).all()
    assert [int(lm.band(np.array([c]))[0]) for c in (0, 1, 2, 3, 4, 2**40)] == [0, 1, 2, 2, 3, lm.BANDS]
    features = (hashes.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    text = rng.integers(0, vocabulary, 40)
    row = {"ids": [1, 2], "lengths": [25, 15], "tokens": lm.packed(text), "features": features.tobytes(), "places": own.astype(np.uint16).tobytes()}
    got = lm.log_probabilities(weights, row)

    def row_of(x: int, bits: int) -> int:
        return (x * int(lm.MULTIPLIERS[5]) % 2**64) >> (64 - bits)

    def chances(before: list[int]) -> tuple[np.ndarray, list[int]]:
        one, two, three = before
        m = [int(x) for x in lm.MULTIPLIERS]
        context = [one * m[0] % 2**64, (one * m[1] ^ two * m[2]) % 2**64, two * m[3] % 2**64, three * m[4] % 2**64]
        z = np.array(start.class_start, float) + sum(weights.classes[row_of(x, lm.CLASS_BITS)].astype(float) for x in context)
        return np.exp(z) / np.exp(z).sum(), context

    def within(context: list[int], cls: int) -> np.ndarray:
        key = (cls + 1) * int(lm.MULTIPLIERS[6]) % 2**64
        z = np.array(start.member_start[cls], float) + sum(weights.members[row_of(x ^ key, lm.MEMBER_BITS)].astype(float) for x in context)
        return np.exp(z) / np.exp(z).sum()

    want = []
    for part in (text[:25], text[25:]):
        total = 0.0
        for i, t in enumerate(part):
            before = [int(features[part[i - k]]) if i >= k else lm.START >> 32 for k in (1, 2, 3)]
            p, context = chances(before)
            if i == 0:
                inner = [p[c] * within(context, c) for c in range(lm.HEAD_CLASSES)]
                shares = [p[lm.HEAD_CLASSES + int(lm.band(np.array([c]))[0])] * c / mass[int(lm.band(np.array([c]))[0])] for c in rest]
                empty = sum(p[lm.HEAD_CLASSES + b] for b in range(1, lm.BANDS + 1) if not mass[b])
                assert abs(sum(x.sum() for x in inner) + sum(shares) + p[lm.HEAD_CLASSES] + empty - 1) < 1e-9
            place = int(own[t])
            total += math.log(p[place // lm.WIDTH] * within(context, place // lm.WIDTH)[place % lm.WIDTH]) if place < lm.HEAD else math.log(p[place - lm.HEAD + lm.HEAD_CLASSES])
        want.append(total)
    assert np.allclose(got, want, rtol=1e-4)


def test_gradient_against_plain_sums():
    rng = np.random.default_rng(4)
    start = lm.Weights.start(lm.Vocabulary(10, 3, np.zeros(0, np.int64), np.arange(lm.HEAD, 0, -1), np.ones(lm.BANDS + 1), np.ones(lm.BANDS + 1)))
    weights = lm.replace(start, classes=rng.normal(size=start.classes.shape).astype(np.float32), members=rng.normal(size=start.members.shape).astype(np.float32))
    places = rng.integers(0, lm.HEAD + lm.BANDS + 1, 30).astype(np.uint16)
    text = rng.integers(0, 30, 50)
    features = rng.integers(0, 2**32, 30).astype(np.uint32)
    row = {"ids": [5, 6], "lengths": [20, 30], "tokens": lm.packed(text), "features": features.tobytes(), "less": places.tobytes()}
    shape = (lm.WIDTH, len(weights.classes) + len(weights.members))
    observed, expected = np.zeros(shape), np.zeros(shape)
    lm.gradient(weights, row, lambda b: b == lm.bucket(6), observed, expected)
    n = 30
    heads = int((places[text[20:]] < lm.HEAD).sum())
    assert observed[:, : len(weights.classes)].sum() == lm.FEATURES * n and observed[:, len(weights.classes) :].sum() == lm.FEATURES * heads
    assert np.isclose(expected[:, : len(weights.classes)].sum(), lm.FEATURES * n) and np.isclose(expected.sum(), observed.sum())
    # The difference is the slope of the log likelihood in any one weight.
    score = lambda w: lm.log_probabilities(w, row | {"places": row["less"]})[1]
    for name, edge in (("classes", 0), ("members", len(weights.classes))):
        label, r = np.unravel_index(np.abs(observed - expected)[:, edge : edge + len(getattr(weights, name))].argmax(), (lm.WIDTH, len(getattr(weights, name))))
        moved = []
        for step in (0.05, -0.05):
            other = getattr(weights, name).copy()
            other[r, label] += step
            moved.append(score(lm.replace(weights, **{name: other})))
        assert abs((moved[0] - moved[1]) / 0.1 - (observed - expected)[label, edge + r]) < 0.02


def test_held_out_text_is_better_than_unigrams(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lm.score_documents(df).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better")).first()
    assert out["s"] > 0.92 * out["b"] and out["better"] > 0.95


def test_packed_numbers():
    for n in (0, 1, 70_000):
        x = np.random.default_rng(n).integers(0, 2**31, n)
        assert (lm.unpacked(lm.packed(x), n) == x).all()


def test_words_of_many_short_texts_take_bounded_memory():
    """Eight megabytes of short texts at once: the same words, and no table of powers longer than two pieces of text."""
    from econspark.llm._words import CHUNK, WordHasher

    rng = np.random.default_rng(6)
    texts = [b" ".join(b"w%d" % i for i in rng.integers(0, 5000, 1000)) + b"\n" * (k % 3) for k in range(1500)]
    texts[7], texts[8] = b"", b"one" * CHUNK + b" two"
    hasher = WordHasher()
    size = len(hasher.power)
    words = hasher.split(texts[:7] + texts[9:], lambda data, hashes, start, end: hashes)
    assert sum(map(len, texts[9:])) > 12 * CHUNK and len(hasher.power) == size
    alone = [WordHasher().split([t], lambda data, hashes, start, end: hashes)[0] for t in texts[:12]]
    both = hasher.split(texts, lambda data, hashes, start, end: hashes)
    assert [x.tolist() for x in both[:12]] == [x.tolist() for x in alone]
    assert [x.tolist() for x in both[:7] + both[9:]] == [x.tolist() for x in words] and [len(x) for x in both[7:9]] == [0, 2]


def test_large_rows_lie_in_small_row_groups(spark):
    import pyarrow.parquet as pq

    from econspark.llm._shared import LARGE_ROWS, removed, written

    table = written(spark.range(8, numPartitions=1).select("id", F.expr("encode(array_join(transform(sequence(1, 200000), i -> sha1(cast(i + id as string))), ''), 'utf-8')").alias("data")), "rows", LARGE_ROWS)
    (file,) = table.inputFiles()
    about = pq.ParquetFile(file.removeprefix("file://").removeprefix("file:")).metadata
    assert about.num_row_groups > 1 and table.where("length(data) = 8000000").count() == 8
    removed(table)


def test_lines_summed_by_row_against_columns():
    """Any number of lines, rows without any and one row with most; and far less time than adding a column at a time."""
    import time

    rng = np.random.default_rng(8)

    def by_column(into, rows, values):
        at, columns = np.concatenate(rows).astype(np.int64), np.ascontiguousarray(values.T, np.float64)
        for column, more in zip(into, columns, strict=True):
            column += np.bincount(at, np.tile(more, len(rows)), len(column))

    def best(f, *given) -> float:
        took = []
        for _ in range(5):
            start = time.process_time()
            f(*given)
            took.append(time.process_time() - start)
        return min(took)

    for n, table in ((1, 1 << lm.CLASS_BITS), (700, 1 << lm.MEMBER_BITS), (lm.BATCH, 1 << lm.CLASS_BITS)):
        buffers = lm.Buffers(1 << lm.MEMBER_BITS)
        buffers.sums[:] = np.nan
        values = rng.random((n, lm.WIDTH)).astype(np.float32)
        rows = [np.where(rng.random(n) < share, 5, rng.integers(0, table, n)).astype(np.int16) for share in (0.0, 0.0, 0.3, 0.9)]
        got, want = np.zeros((table, lm.WIDTH), np.float32), np.zeros((lm.WIDTH, table))
        lm.add_rows(got, rows, values, buffers)
        by_column(want, rows, values)
        assert np.allclose(got.T, want, rtol=1e-5) and ((got.T == 0) == (want == 0)).all()
    assert best(lm.add_rows, got, rows, values, buffers) < 0.8 * best(by_column, want, rows, values)


def test_chances_at_the_ends_of_what_weights_can_reach():
    """Weights at RATE a round, all one way or the other, and classes that training hardly saw: finite chances that sum to one."""
    head = np.arange(lm.HEAD, 0, -1)
    head[0] = 10**12
    weights = lm.Weights.start(lm.Vocabulary(10**12, 3, np.zeros(0, np.int64), head, np.zeros(lm.BANDS + 1), np.zeros(lm.BANDS + 1)))
    most = lm.ROUNDS * lm.RATE
    sign = np.where(np.arange(lm.WIDTH) % 2, most, -most).astype(np.float32)
    weights = lm.replace(weights, classes=weights.classes + sign, members=weights.members - sign)
    n = lm.BATCH - 1
    rows = [np.arange(n, dtype=np.int64).astype(np.int16) % 4096 for _ in range(lm.FEATURES)]
    kind = np.arange(n) % lm.HEAD_CLASSES
    for table, start, which in (("classes", "class_start", None), ("members", "member_start", kind)):
        got = lm.chances(getattr(weights.factors, table), getattr(weights.factors, start), which, rows, lm.Buffers())
        z = np.broadcast_to(getattr(weights, start) if which is None else getattr(weights, start)[which], got.shape) + lm.FEATURES * getattr(weights, table)[0].astype(float)
        want = np.exp(z - z.max(axis=1, keepdims=True))
        want /= want.sum(axis=1, keepdims=True)
        assert got.shape == (n, lm.WIDTH) and (got > 0).all() and np.allclose(got, want, rtol=2e-4)


def test_large_rows_go_to_python_a_few_at_a_time(spark):
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(12, numPartitions=12).select(F.expr("encode(repeat('x', 3000000 + cast(id as int)), 'utf-8')").alias("data")).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    with pytest.raises(ZeroDivisionError), lm._large_rows(spark):
        got = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
        raise ZeroDivisionError
    assert sum(got) >= 36_000_000 and max(got) < lm.TRANSFER + 4_000_000 and spark.conf.get(key) == before
