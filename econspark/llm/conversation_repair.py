r"""Repair of the structure of conversations, by Hirschberg's divide and conquer over a four-state machine.

Legal role initials are ``(s?(ua)+)?``; the states are: nothing yet, after the system row, after a user row, after an assistant row.
A row is kept (0), given the role user or assistant that is due (1), or deleted (2, required for blank and duplicate rows); an
undeleted truncated row costs 5 more; an empty user or assistant row can be inserted anywhere (5). Every row is thus a step with a 4 x 4
matrix of costs, and so is every stretch of rows. Forward costs of the first half and backward costs of the second half meet in the
middle: the crossing state is the cheapest, of several the one whose audit so far sorts first, and either half is solved in the
same way. Only two vectors of four costs are held at a time.

The audit of a stretch is a string of K, R, D, I. A row adds one letter after its insertions, so no audit of the same rows is
the beginning of another, two states are never reached by the same audit, and a forward pass keeps the order of the four audits without having them.

Conversations are cut into chunks of rows (CHUNK_ROWS, CHUNK_BYTES) that lie in range partitions of conversation, turn, role and
text, so a conversation with any share of the rows is spread. Each chunk gives its matrices; the states between the chunks of a
conversation are found by the same divide and conquer over chunks; then every chunk is reconstructed on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._shared import need, send_by_value, written

send_by_value(__name__)

CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 20
FORMS = 1 << 14  # conversations whose letters a task keeps; that changes speed only
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 0  # initial of a role that no state has
FINE, CUT, BAD = range(3)  # a row as it is, truncated, blank or duplicate
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 60
ROLES = {USER: "user", ASSISTANT: "assistant"}
WHITE = " \t\n\x0b\f\r"

#: Costs and what orders the audits, both by state before and state after.
Step = tuple[tuple[tuple[int, ...], ...], tuple[tuple, ...]]


def due(state: int) -> int:
    """The state that an inserted row or one with a new role leads to."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: int) -> bool:
    return {SYSTEM: state == NOTHING, USER: state != USER, ASSISTANT: state == USER}.get(initial, False)


def row_step(initial: int, fault: int) -> Step:
    """A row: for each pair of states the cheapest insertions and edit, of equal ones the first in ASCII order.

    An insertion before a deletion is left out: behind it, it costs the same and sorts first.
    """
    ways: dict[tuple[int, int], tuple[int, str]] = {(p, p): (DELETE, "D") for p in range(4)}
    for p in range(4):
        state, cost, audit = p, TRUNCATED if fault == CUT else 0, ""
        for _ in range(3):
            if fault != BAD:
                moves = [(due(state), REROLE, "R")] + ([(initial, 0, "K")] if _kept(state, initial) else [])
                for q, more, letter in moves:
                    ways[p, q] = min(ways.get((p, q), (NEVER, "")), (cost + more, audit + letter))
            state, cost, audit = due(state), cost + INSERT, audit + "I"
    table = [[ways.get((p, q), (NEVER, "")) for q in range(4)] for p in range(4)]
    return tuple(tuple(w[0] for w in row) for row in table), tuple(tuple(w[1] for w in row) for row in table)


#: Steps of all kinds of rows, which are 4 * fault + initial.
ROW_STEPS = [row_step(initial, fault) for fault in (FINE, CUT, BAD) for initial in range(4)]
#: The end as a step to NOTHING: what is missing is inserted.
FINISH: Step = (tuple((c, NEVER, NEVER, NEVER) for c in (0, 2 * INSERT, INSERT, 0)), tuple((a, "", "", "") for a in ("", "II", "I", "")))


def forward(steps: list[Step], i: int, j: int, start: int) -> tuple[list[int], list[int]]:
    """Costs of the four states after ``steps[i:j]``, and the order of their first audits."""
    cost, rank = [NEVER] * 4, [0] * 4
    cost[start] = 0
    for step, order in steps[i:j]:
        best = [min((min(cost[p] + step[p][q], NEVER), rank[p], order[p][q]) for p in range(4)) for q in range(4)]
        places = sorted({b[1:] for b in best if b[0] < NEVER})
        cost, rank = [b[0] for b in best], [places.index(b[1:]) if b[0] < NEVER else 0 for b in best]
    return cost, rank


def backward(steps: list[Step], i: int, j: int, end: int) -> list[int]:
    cost = [NEVER] * 4
    cost[end] = 0
    for step, _ in reversed(steps[i:j]):
        cost = [min(min(step[p][q] + cost[q], NEVER) for q in range(4)) for p in range(4)]
    return cost


def crossings(steps: list[Step], start: int, end: int) -> list[int]:
    """The state before each step and after the last, on the cheapest way from ``start`` to ``end`` whose audit sorts first."""
    states = [start] * len(steps) + [end]
    open_parts = [(0, len(steps))]
    while open_parts:
        i, j = open_parts.pop()
        if j - i < 2:
            continue
        mid = (i + j) // 2
        there, rank = forward(steps, i, mid, states[i])
        back = backward(steps, mid, j, states[j])
        states[mid] = min(range(4), key=lambda s: (there[s] + back[s], rank[s]))
        open_parts += [(i, mid), (mid, j)]
    return states


def stretch(steps: list[Step]) -> Step:
    """A stretch of steps as one step; its audits are known by their order."""
    passes = [forward(steps, 0, len(steps), p) for p in range(4)]
    return tuple(tuple(c) for c, _ in passes), tuple(tuple(r) for _, r in passes)


def steps_of(kinds: bytes, copies: list[int]) -> list[Step]:
    """Steps of rows of these kinds; all copies of a row but the first are deleted, which changes no state."""
    out = []
    for kind, n in zip(kinds, copies, strict=True):
        cost, order = ROW_STEPS[kind]
        more = DELETE * (n - 1)
        out.append((tuple(tuple(min(c + more, NEVER) for c in row) for row in cost), order) if more else (cost, order))
    return out


def audit_of(kinds: bytes, copies: list[int], start: int, end: int, last: bool) -> list[str]:
    """Letters of each row, and of the end if this is the ``last`` chunk."""
    steps = steps_of(kinds, copies) + [FINISH] * last
    states = crossings(steps, start, end)
    return [order[p][q] for (_, order), p, q in zip(steps, states, states[1:], strict=False)]


def repaired_rows(letters: list[str], roles: list[str], texts: list[str], start: int) -> Iterator[tuple[str, str]]:
    """Role and text of each row that the letters leave or insert."""
    state = start
    for i, audit in enumerate(letters):
        for letter in audit:
            if letter == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[roles[i][0]]
                yield roles[i], texts[i]
            elif letter != "D":
                state = due(state)
                yield ROLES[state], texts[i] if letter == "R" else ""


# Spark


def _nothing_to_space(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(" "))


def damage(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str = "copies") -> DataFrame:
    """Rows of a conversation table with faults by ``crc32(conversation:turn) % 20``, and how often each stands (``copies``).

    0 drops the row (no copies), 1 empties its text, 2 takes every ``[.!?]`` out of it, 3 repeats it, 4 makes its role ``user``. A missing
    value counts as one space, but for the order, where a missing turn stays missing. Other columns are left out.
    """
    need(df, conversation, turn, role, text)
    fate = F.crc32(F.concat(_nothing_to_space(conversation), F.lit(":"), _nothing_to_space(turn)).cast("binary")) % 20
    said = _nothing_to_space(text)
    return df.select(
        F.col(f"`{conversation}`").alias(conversation),
        F.col(f"`{turn}`").alias(turn),
        F.when(fate == 4, "user").otherwise(_nothing_to_space(role)).alias(role),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias(text),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias(copies),
    )


_TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, chunks long"
_STEP = "cost array<long>, rank array<long>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _illegal(before: int, after: int) -> bool:
    return (before, after) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def _make_chunks(schema: StructType) -> Callable:
    """Rows in order, as chunks of a conversation with all that is known of them on their own."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part, n = to_arrow_schema(schema), TaskContext.get().partitionId(), 0
        held: list[dict] = []
        size = 0

        def chunk() -> dict:
            nonlocal n, size
            rows = [r for r in held if r["copies"]]
            kinds = bytes(4 * r["fault"] + r["initial"] for r in rows)
            copies = [r["copies"] for r in rows]
            turns = [r["turn"] for r in rows if r["turn"] is not None]
            cost, rank = stretch(steps_of(kinds, copies))
            out = {"conversation": held[0]["conversation"], "chunk": part << 32 | n, "kinds": kinds, "copies": copies, "roles": [r["role"] for r in rows], "texts": [r["text"] for r in rows]}
            out |= {"first": rows[0]["initial"] if rows else None, "last": rows[-1]["initial"] if rows else None, "first_turn": min(turns, default=None), "last_turn": max(turns, default=None)}
            out |= {"blank": sum(r["copies"] for r in rows if r["blank"]), "duplicate": sum(r["copies"] - (r["fault"] != BAD) for r in rows if not r["blank"]), "truncated": sum(r["fault"] == CUT for r in rows)}
            out |= {"illegal": sum(copies) - len(rows) + sum(_illegal(a["initial"], b["initial"]) for a, b in zip(rows, rows[1:], strict=False)), "turns": len(set(turns))}
            out |= {"cost": [c for row in cost for c in row], "rank": [r for row in rank for r in row]}
            held.clear()
            n, size = n + 1, 0
            return out

        made: list[dict] = []
        weight = 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["conversation"] != held[0]["conversation"] or len(held) >= CHUNK_ROWS or size >= CHUNK_BYTES):
                    made.append(chunk())
                held.append(row)
                size, weight = size + len(row["text"]), weight + len(row["text"]) + 200
                if weight > 4 * CHUNK_BYTES:
                    yield from pa.Table.from_pylist(made, arrow).to_batches()
                    made, weight = [], 0
        if held:
            made.append(chunk())
        yield from pa.Table.from_pylist(made, arrow).to_batches()

    return run


def _square(flat: list) -> tuple[tuple, ...]:
    return tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4))


def _meet(batches: Iterator) -> Iterator:
    """Conversations as lists of chunks: the states between the chunks, and the figures of the conversation at its first one."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for chunks in batch.column(0).to_pylist():
            steps = [*((_square(c["cost"]), _square(c["rank"])) for c in chunks), FINISH]
            states = crossings(steps, NOTHING, NOTHING)
            some = [c for c in chunks if c["first"] is not None]
            dated = [c for c in some if c["first_turn"] is not None]
            pairs = lambda rows: zip(rows, rows[1:], strict=False)
            totals = {k: sum(c[k] for c in chunks) for k in _COUNTS}
            totals["illegal"] += sum(_illegal(a["last"], b["first"]) for a, b in pairs(some))
            turns = totals.pop("turns") - sum(a["last_turn"] == b["first_turn"] for a, b in pairs(dated))
            totals |= {"gaps": dated[-1]["last_turn"] - dated[0]["first_turn"] + 1 - turns if dated else 0}
            totals |= {"cost": sum(cost[p][q] for (cost, _), p, q in zip(steps, states, states[1:], strict=False)), "chunks": len(chunks)}
            for i, c in enumerate(chunks):
                out.append({"chunk": c["chunk"], "start": states[i], "end": states[i + 1], "last": i + 1 == len(chunks), "alone": len(chunks) == 1, **dict.fromkeys(totals), **(totals if i == 0 else {})})
        yield pa.RecordBatch.from_pylist(
            out,
            pa.schema([("chunk", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("last", pa.bool_()), ("alone", pa.bool_()), *[(c.split()[0], pa.int64()) for c in _TOTALS.split(", ")]]),
        )


def _rebuild(batches: Iterator) -> Iterator:
    import pyarrow as pa

    row = pa.struct([("role", pa.string()), ("text", pa.string())])
    forms: dict[tuple, list[str]] = {}  # short conversations have few forms
    for batch in batches:
        audits, rows = [], []
        names = ("kinds", "copies", "roles", "texts", "start", "end", "last")
        for kinds, copies, roles, texts, start, end, last in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
            form = (kinds, tuple(copies), start, end, last)
            letters = forms.get(form) or audit_of(kinds, copies, start, NOTHING if last else end, last)
            if len(kinds) <= 12 and len(forms) < FORMS:
                forms[form] = letters
            more = [*copies, *[1] * last]
            audits.append("".join(a + "D" * (n - 1) for a, n in zip(letters, more, strict=True)))
            rows.append([{"role": r, "text": t} for r, t in repaired_rows(letters, [*roles, ""], [*texts, ""], start)])
        keep = [i for i, c in enumerate(batch.schema.names) if c not in names]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(audits, pa.string()), pa.array(rows, pa.list_(row))], [*[batch.schema.names[i] for i in keep], "audit", "repaired"])


def repair_conversations(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """Chunks of repaired conversations: ``conversation``, ``chunk`` (numbers that rise along a conversation), ``alone`` (the whole
    conversation is this chunk), ``audit``, ``repaired`` (role and text of its rows) and, at a conversation's first chunk, its figures:
    ``gaps, blank, duplicate, truncated, illegal, cost, chunks``.

    Rows are ordered by turn (missing ones first), role and text. ``copies`` names a column that says how often a row stands; a
    conversation whose rows all stand 0 times has no rows but is returned. A missing role or text is one space; rows without conversation form one
    conversation. An empty role, like any other that begins with none of s, u, a, can only be deleted or given another. An empty table gives
    no rows. Other columns are left out. Texts are told apart by MD5 when repeated ones are sought.
    """
    need(df, conversation, turn, role, text, *([copies] if copies else []))
    kind = df.schema[conversation].dataType
    times = F.coalesce(F.col(f"`{copies}`"), F.lit(0)).cast("long") if copies else F.lit(1).cast("long")
    rows = df.select(F.col(f"`{conversation}`").alias("conversation"), F.col(f"`{turn}`").cast("long").alias("turn"), _nothing_to_space(role).alias("role"), _nothing_to_space(text).alias("text"), times.alias("copies"))
    # Rows of no copies tell only that their conversation is there.
    gone = F.col("copies") <= 0
    rows = rows.select("conversation", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").otherwise(F.col("role")).alias("role"), F.when(gone, "").otherwise(F.col("text")).alias("text"), F.greatest("copies", F.lit(0)).alias("copies"))
    rows = rows.groupBy("conversation", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    end = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    rows = written(rows.withColumns({"end": end, "digest": F.md5("text")}), "repair-rows")
    seen = rows.where("copies > 0 AND end <> ''").groupBy("conversation", "role", "digest")
    seen = seen.agg(F.min("turn").alias("from"), F.max(F.col("turn").isNull().cast("int")).alias("undated"), F.count("*").alias("places")).where("places > 1")
    r, s = rows.alias("r"), seen.alias("s")
    rows = r.join(s, F.expr("r.conversation <=> s.conversation AND r.role = s.role AND r.digest = s.digest AND r.end <> ''"), "left")
    blank = F.col("r.end") == ""
    again = F.col("places").isNotNull() & F.col("r.turn").isNotNull() & ((F.col("undated") == 1) | (F.col("r.turn") > F.col("from")))
    initial = F.element_at(F.create_map(*[F.lit(x) for x in ("s", SYSTEM, "u", USER, "a", ASSISTANT)]), F.substring("r.role", 1, 1))
    rows = rows.select(
        "r.conversation", "r.turn", "r.role", "r.text", "r.copies",
        F.coalesce(initial, F.lit(OTHER)).alias("initial"),
        F.when(blank | again, BAD).when(~F.col("r.end").isin(".", "!", "?"), CUT).otherwise(FINE).alias("fault"),
        blank.alias("blank"),
    )
    order = ["conversation", "turn", "role", "text"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    figures = "first int, last int, first_turn long, last_turn long, " + ", ".join(f"{c} long" for c in _COUNTS)
    shape = StructType([StructField("conversation", kind), *StructType.fromDDL(f"chunk long, kinds binary, copies array<long>, roles array<string>, texts array<string>, {figures}, {_STEP}").fields])
    chunks = written(ordered.mapInArrow(_make_chunks(shape), shape), "repair-chunks")
    known = ["chunk", "first", "last", "first_turn", "last_turn", *_COUNTS, "cost", "rank"]
    joined = chunks.groupBy("conversation").agg(F.sort_array(F.collect_list(F.struct(*known))).alias("chunks"))
    states = joined.select("chunks").mapInArrow(_meet, f"chunk long, start int, end int, last boolean, alone boolean, {_TOTALS}")
    parts = chunks.select("conversation", "chunk", "kinds", "copies", "roles", "texts").join(states, "chunk")
    totals = [c.split()[0] for c in _TOTALS.split(", ")]
    parts = parts.select("conversation", "chunk", "alone", *totals, "kinds", "copies", "roles", "texts", "start", "end", "last")
    shape = StructType([StructField("conversation", kind), *StructType.fromDDL(f"chunk long, alone boolean, {_TOTALS}, audit string, repaired array<struct<role: string, text: string>>").fields])
    return parts.mapInArrow(_rebuild, shape).withColumnRenamed("conversation", conversation)


def _streamed(schema: StructType) -> Callable:
    """One row for each conversation of several chunks; its text passes by and is not held."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held, digest, audits, some = to_arrow_schema(schema), None, hashlib.sha256(), [], False
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunks"] is not None:
                    if held:
                        yield pa.RecordBatch.from_pylist([held | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()}], arrow)
                    held, digest, audits, some = row, hashlib.sha256(), [], False
                audits.append(row["audit"])
                if row["lines"] is not None:
                    digest.update((("\n" if some else "") + row["lines"]).encode())
                    some = True
        if held:
            yield pa.RecordBatch.from_pylist([held | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()}], arrow)

    return run


def summaries(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair_conversations``: its figures, the whole audit, and the SHA-256 of the repaired rows
    (``role:text``, joined by line feeds). A digest is made from front to back, so the chunks of one conversation pass through one task, one at a time."""
    conversation = repaired.columns[0]
    totals = [c.split()[0] for c in _TOTALS.split(", ")]
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    whole = [*[c for c in totals if c != "chunks"], "audit"]
    alone = repaired.where("alone").select(f"`{conversation}`", *whole, F.sha2(lines, 256).alias("repaired_sha256"))
    several = repaired.where("NOT alone").select(f"`{conversation}`", "chunk", *totals, "audit", F.when(F.size("repaired") > 0, lines).alias("lines"))
    several = several.repartition(F.col(f"`{conversation}`")).sortWithinPartitions(f"`{conversation}`", "chunk")
    return alone.unionByName(several.mapInArrow(_streamed(alone.schema), alone.schema))
