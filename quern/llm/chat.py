"""Chat formatting: a state machine over roles, a declarative template, loss flags per segment.

The template's control strings begin with ``<|``. Inside texts and role names each ``<``, ``|`` and
``\\`` gets a ``\\`` behind it, so no control string can arise there, and taking that ``\\`` away
again gives the text back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIAL = re.compile(r"([<|\\])")
ESCAPED = re.compile(r"([<|\\])\\")


@dataclass(frozen=True)
class Template:
    """How a conversation is written, and which roles may follow each other.

    ``begin``, ``head`` (with the role), ``close`` and ``end`` are control strings; ``loss`` has the
    roles whose texts are learned; ``follows`` maps a state (the last role, or "" at the start) to
    the roles allowed next; ``final`` has the states in which a conversation may stop.
    """

    begin: str = "<|begin|>"
    head: tuple[str, str] = ("<|role|>", "<|text|>")
    close: str = "<|close|>"
    end: str = "<|end|>"
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    final: frozenset[str] = frozenset({"assistant"})


def escape(text: str) -> str:
    return SPECIAL.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


class Machine:
    """The state machine over roles: each step takes a turn, moves on, and emits segments with their loss flags.

    Its state is the last role ("" at the start) as long as the template allows the order; once it does not,
    ``refused`` says where and why, and the machine goes on emitting, as the turns are written all the same.
    """

    def __init__(self, template: Template):
        self.template, self.role, self.turns, self.refused = template, "", 0, ""

    def start(self) -> Iterator[tuple[str, bool]]:
        yield self.template.begin, False

    def step(self, role: str, text: str) -> Iterator[tuple[str, bool]]:
        t = self.template
        if not self.refused and role not in t.follows.get(self.role, ()):
            self.refused = f"turn {self.turns}: {role or '(none)'} after {self.role or 'start'}"
        self.role, self.turns = role, self.turns + 1
        yield t.head[0] + escape(role) + t.head[1], False
        yield escape(text), role in t.loss
        yield t.close, False

    def stop(self) -> Iterator[tuple[str, bool]]:
        if not self.refused and self.role not in self.template.final:
            self.refused = f"ends after {self.role or 'start'}"
        yield self.template.end, False

    @property
    def state(self) -> str:
        """"ok", or where and why the order of turns breaks off."""
        return self.refused or "ok"


def segments(turns: list[tuple[str, str]], machine: Machine) -> Iterator[tuple[str, bool]]:
    """All that the machine emits for the turns; the learned segments are whole escaped texts."""
    yield from machine.start()
    for role, text in turns:
        yield from machine.step(role, text)
    yield from machine.stop()


def parse(formatted: str, template: Template) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    body = formatted.removeprefix(template.begin).removesuffix(template.end)
    out = []
    for turn in body.split(template.close)[:-1]:
        role, text = turn.removeprefix(template.head[0]).split(template.head[1], 1)
        out.append((unescape(role), unescape(text)))
    return out


SCHEMA = "conv_id bigint, formatted string, spans array<struct<start:bigint,stop:bigint>>, state string"
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(_SPAN)), ("state", pa.string())])


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, spans (code points under the loss mask) and state of each conversation.

    Turns stand in the order of turn, then role, then text; a null role or text is empty, a null turn
    comes first. Repeated rows stay. A conversation whose order the state machine refuses is
    formatted all the same; state says what is wrong. Rows with a null conv_id are one conversation.
    """
    template = template or Template()
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def render(batches):
        for b in batches:
            rows = []
            for conv, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = [(t["role"], t["text"]) for t in turns]
                parts, spans, at, machine = [], [], 0, Machine(template)
                for part, loss in segments(own, machine):
                    if loss:
                        spans.append({"start": at, "stop": at + len(part)})
                    parts.append(part)
                    at += len(part)
                rows.append((conv, "".join(parts), spans, machine.state))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return grouped.mapInArrow(render, SCHEMA)


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What can be read back from the formatted conversations."""
    template = template or Template()
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("state", pa.string())])

    def read(batches):
        for b in batches:
            rows = []
            for conv, text, spans, state in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                turns = parse(text, template)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), state))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return formatted.select("conv_id", "formatted", "spans", "state").mapInArrow(read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, state string")
