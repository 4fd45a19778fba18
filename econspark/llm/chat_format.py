r"""Chat formatting from a declarative template, with a finite-state machine over roles.

A template states the mark before and after each turn, which roles are trained on, and which role may follow which.
A conversation becomes a list of segments (text, loss): header, content and end mark of each turn in order. The
formatted string is their concatenation.

Escapes are reversible: within contents a backslash stands before every backslash and every control string. The
end mark follows a line feed, so an unescaped ``\n</turn>`` occurs nowhere but at the end of a turn, and a formatted
string can be split back into its turns (``read_turns``). Roles are percent-encoded in headers.

Rows of a conversation are ordered by turn, role, text (missing turns first); repeated rows stay. Missing text or role: empty.
Rows without conversation id form one conversation. One conversation is one training example and so one row; conversations
are spread over the cluster.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import need


@dataclass(frozen=True)
class Template:
    before_role: str = "### "
    after_role: str = ": "
    end: str = "\n</turn>\n"
    #: Strings that contents must not hold unescaped.
    control: tuple[str, ...] = ("###", "</turn>")
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) -> state; a pair that is not listed ends in ``fault``.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepted: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        if not any(c in self.end for c in self.control) or not self.end.startswith("\n"):
            raise ValueError("the end mark starts with a line feed and holds a control string")
        if re.search(r"[%A-Za-z0-9_.*+-]", self.after_role[:1]):
            raise ValueError("the mark after the role must not start with a character of an encoded role")

    @property
    def _special(self) -> str:
        return "|".join(re.sub(r"([^0-9A-Za-z ])", r"\\\1", c) for c in ("\\", *self.control))

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, f"({self._special})", r"\\$1")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"\\({self._special})", "$1")


FAULT = "fault"


def _end_state(template: Template, roles: Column) -> Column:
    table = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state} {role}", to)])
    step = lambda state, role: F.coalesce(F.element_at(table, F.concat(state, F.lit(" "), role)), F.lit(FAULT))
    return F.aggregate(roles, F.lit(template.start), step)


def format_chats(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: id, ``n_turns``, ``valid``, ``end_state``, ``segments`` array<struct<text, loss>>, ``formatted``.

    ``valid`` is false when the roles leave the machine or stop outside its accepted states; such conversations are
    formatted all the same, so that a caller can filter, repair or count them.
    """
    t = template or Template()
    need(turns, conv, turn, role, text)
    said = turns.select(
        F.col(conv).alias("_c"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("_t"),
    )
    chats = said.groupBy("_c").agg(F.sort_array(F.collect_list("_t")).alias("_ts"))

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(t.before_role), F.url_encode(x["role"]), F.lit(t.after_role))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(piece(head, F.lit(False)), piece(t.escape(x["text"]), x["role"].isin(*t.trained)), piece(F.lit(t.end), F.lit(False)))

    state = _end_state(t, F.transform("_ts", lambda x: x["role"]))
    return (
        chats.select(F.col("_c").alias(conv), F.size("_ts").alias("n_turns"), state.alias("end_state"), F.flatten(F.transform("_ts", segments)).alias("segments"))
        .withColumn("valid", F.col("end_state").isin(*t.accepted))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted string: array<struct<role, text>>."""
    t = template or Template()
    quoted = lambda s: re.sub(r"([^0-9A-Za-z \n])", r"\\\1", s)
    ended = F.split(formatted, quoted(t.end))
    parts = F.slice(ended, F.lit(1), F.size(ended) - 1)  # nothing stands after the last end mark
    head = f"(?s)^{quoted(t.before_role)}(.*?){quoted(t.after_role)}(.*)$"
    return F.transform(parts, lambda p: F.struct(F.url_decode(F.regexp_extract(p, head, 1)).alias("role"), t.unescape(F.regexp_extract(p, head, 2)).alias("text")))


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """Everything under the loss mask, unescaped."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescape(s["text"])), "")
