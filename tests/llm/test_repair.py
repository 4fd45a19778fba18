from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from econspark.llm import conversation_repair as cr

WHITE = " \t\n\x0b\f\r"


def cheapest(rows: list[tuple[int, int]]) -> tuple[int, str]:
    """Cost and first audit of rows (initial, fault), by whole audits for each state; insertions anywhere."""

    def with_insertions(best: dict) -> dict:
        best, again = dict(best), True
        while again:
            again = False
            for state, (cost, audit) in list(best.items()):
                to, way = 3 if state == 2 else 2, (cost + 5, audit + "I")
                if to not in best or way < best[to]:
                    best[to], again = way, True
        return best

    best = {0: (0, "")}
    for initial, fault in rows:
        ways: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in with_insertions(best).items():
            moves = [(state, 2, "D")]
            if fault != cr.BAD:
                more = 5 * (fault == cr.CUT)
                moves.append((3 if state == 2 else 2, 1 + more, "R"))
                if (state, initial) in {(0, 1), (0, 2), (1, 2), (3, 2), (2, 3)}:
                    moves.append((initial, more, "K"))
            for to, more, letter in moves:
                ways[to] = min(ways.get(to, (1 << 60, "")), (cost + more, audit + letter))
        best = ways
    best = with_insertions(best)
    return min(best[s] for s in (0, 3) if s in best)


def test_divide_and_conquer_against_whole_audits():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.randrange(4), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 17]))]
        kinds = bytes(4 * fault + initial for initial, fault in rows)
        steps = cr.steps_of(kinds, [1] * len(rows))
        want = cheapest(rows)
        assert "".join(cr.audit_of(kinds, [1] * len(rows), 0, 0, True)) == want[1]
        size = max(1, len(rows) // 3)
        parts = [steps[i : i + size] for i in range(0, len(rows), size)]
        states = cr.crossings([*map(cr.stretch, parts), cr.FINISH], 0, 0)
        audit = ""
        for part, a, b in zip(parts, states, states[1:], strict=False):
            inner = cr.crossings(part, a, b)
            audit += "".join(order[p][q] for (_, order), p, q in zip(part, inner, inner[1:], strict=False))
        assert audit + cr.FINISH[1][states[-2]][0] == want[1]


def brute(table: list[tuple]) -> dict:
    out = {}
    space = lambda v: " " if v is None else str(v)
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            fate, role, text = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, space(role), space(text)
            text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
            rows += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        counts, kinds, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
        for _, role, text in rows:
            body = text.strip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kinds.append((" sua".find(role[0]) if role and role[0] in "sua" else 0, {None: cr.FINE, "truncated": cr.CUT}.get(fault, cr.BAD)))
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit = cheapest(kinds)
        made, state, i = [], 0, 0
        for letter in audit:
            if letter == "K":
                state = kinds[i][0]
                made.append(f"{rows[i][1]}:{rows[i][2]}")
            elif letter != "D":
                state = 3 if state == 2 else 2
                made.append(f"{'user' if state == 2 else 'assistant'}:{rows[i][2] if letter == 'R' else ''}")
            i += letter != "I"
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        out[conv] = {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(made).encode()).hexdigest()}
    return out


def awkward(rng: random.Random) -> list[tuple]:
    texts = ["fine.", "cut", "", " \t\n", None, "really?\x0b ", "wow!", "é. ü", "a\n.", ".  ", "x" * 30_000 + "."]
    roles = ["user", "assistant", "system", None, "", "tool", "sage", "User", "assistant", "user"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randint(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(300)]  # a long one
    rows += [(101, t // 40, rng.choice(["user", "assistant"]), rng.choice(["same.", "same", "other."])) for t in range(400)]  # repeated rows
    rows += [(102, None, "user", "only.")] * 50 + [(-7, -(2**40), "user", "far."), (-7, 2**40, "assistant", "away.")]
    gone = next(c for c in range(200, 400) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    return [*rows, (gone, 1, "user", "dropped.")]


@pytest.mark.parametrize("chunk", [4096, 7])
def test_repair_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(cr, "CHUNK_ROWS", chunk)
    table = awkward(random.Random(chunk))
    df = spark.createDataFrame([(*r, 1, "x") for r in table], "conv_id long, turn long, role string, text string, chunk int, `conversation` string").repartition(5)
    repaired = cr.repair_conversations(cr.damage(df), copies="copies")
    got = {r["conv_id"]: r.asDict() for r in cr.summaries(repaired).collect()}
    want = brute(table)
    assert set(got) == set(want)
    for conv, row in want.items():
        assert {k: got[conv][k] for k in row} == row, conv
    if chunk == 7:
        assert repaired.where("NOT alone").count() > 50


def test_undamaged_rows_and_empty_tables(spark):
    df = spark.createDataFrame([("b", 0, "system", "s."), ("b", 1, "user", "u?"), ("b", 2, "assistant", "a!"), ("a", 0, "assistant", "a.")], "conv_id string, turn int, role string, text string")
    rows = {r["conv_id"]: r for r in cr.repair_conversations(df).collect()}
    assert rows["b"]["audit"] == "KKK" and rows["a"]["audit"] == "D" and rows["a"]["repaired"] == []
    assert [tuple(r) for r in rows["b"]["repaired"]] == [("system", "s."), ("user", "u?"), ("assistant", "a!")]
    assert cr.summaries(cr.repair_conversations(df.where("false"))).count() == 0
    assert cr.damage(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        cr.repair_conversations(df.drop("turn"))


def test_fates(spark):
    df = spark.range(2000).select(F.col("id").alias("conv_id"), F.lit(3).alias("turn"), F.lit("assistant").alias("role"), F.lit("a.b!").alias("text"))
    rows = {r["conv_id"]: (r["role"], r["text"], r["copies"]) for r in cr.damage(df).collect()}
    kind = {0: ("assistant", "a.b!", 0), 1: ("assistant", "", 1), 2: ("assistant", "ab", 1), 3: ("assistant", "a.b!", 2), 4: ("user", "a.b!", 1)}
    assert all(rows[c] == kind.get(zlib.crc32(f"{c}:3".encode()) % 20, ("assistant", "a.b!", 1)) for c in range(2000))
