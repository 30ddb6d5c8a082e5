"""Conversations as training text: a machine over roles, a template, a loss mask, and the way back.

The machine has a state per role. Reading a row it goes to the state of the row's role, says whether that
turn may follow, and emits the segments that the template has for the role: text with a flag, whether it
counts for the loss. Turns that may not follow are formatted too, and counted.

Texts are escaped so that no control string of the template is left in them: ``ESCAPE`` is doubled, and
one is put behind each ``OPEN``, which starts every control string. In what comes out a control string
is therefore markup, wherever it stands.

Rows are sorted by conversation and turn; each task reads its own as a stream and writes pieces of at
most PIECE characters or one turn, so a conversation needs no more memory than its longest turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What a turn becomes. ``turn`` lists its segments: literal strings, and the fields {role} and {text}."""

    open: str = "<|"
    turn: tuple[str, ...] = ("<|im_start|>", "{role}", "\n", "{text}", "<|im_end|>\n")
    #: Roles whose text counts for the loss.
    learned: tuple[str, ...] = ("assistant",)
    #: state (the last role; empty: none yet) -> roles that may follow; other turns are counted as out of order.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: States that a conversation may end in.
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escaped(text: str, template: Template) -> str:
    """text with ESCAPE doubled and one behind the first letter of each ``open``."""
    return text.replace(ESCAPE, ESCAPE * 2).replace(template.open, template.open[0] + ESCAPE + template.open[1:])


def unescaped(text: str, template: Template) -> str:
    """The text that was escaped: an ESCAPE goes, and what it stands before stays."""
    parts = text.split(ESCAPE * 2)
    return ESCAPE.join(p.replace(ESCAPE, "") for p in parts)


class Machine:
    """Reads the roles of one conversation; ``state`` is the last one."""

    def __init__(self, template: Template) -> None:
        self.template, self.state, self.faults = template, "", 0

    def read(self, role: str, text: str) -> Iterator[tuple[str, bool]]:
        """Takes the step and emits the segments (text, loss) of the turn."""
        t = self.template
        self.faults += role not in t.follows.get(self.state, ())
        self.state = role
        for segment in t.turn:
            if segment == "{role}":
                yield escaped(role, t).replace("\n", ESCAPE + "n"), False  # a newline ends the role
            elif segment == "{text}":
                yield escaped(text, t), role in t.learned
            else:
                yield segment, False

    def done(self) -> int:
        """Turns out of order, and one more if the conversation may not end here."""
        return self.faults + (self.state not in self.template.final)


FORMATTED = "conv_id decimal(20,0), piece long, formatted string, loss array<struct<start:long,end:long>>, n_turns long, faults long"


def format_chats(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """The text of each conversation in pieces: conv_id, piece (from 0), formatted, loss, n_turns, faults.

    loss: the spans of ``formatted`` (code points, end exclusive) that count for the loss. n_turns: turns in
    the piece. faults: turns out of order so far, at the last piece also whether the end is one. Pieces hold
    whole turns, so they are ordinary rows for any conversation, however long; nearly all have one.

    Rows go by turn, nulls first, those of one turn by role, then text. Null roles and texts count as empty;
    rows with a null conv_id are one conversation; repeated rows are turns of their own; unknown roles are
    turns out of order; other columns are left out; an empty table gives an empty one. The pieces of a
    conversation are in one partition, in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, now, piece, parts, size, spans, n = None, None, 0, [], 0, [], 0

        def row(faults: int) -> tuple:
            return now, piece, "".join(parts), spans, n, faults

        for batch in batches:
            out = []
            for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"]):
                if machine is None or conv != now:
                    if machine is not None:
                        out.append(row(machine.done()))
                    machine, now, piece, parts, size, spans, n = Machine(template), conv, 0, [], 0, [], 0
                elif size >= PIECE:
                    out.append(row(machine.faults))
                    piece, parts, size, spans, n = piece + 1, [], 0, [], 0
                for segment, counts in machine.read(role, text):
                    if counts:
                        spans.append({"start": size, "end": size + len(segment)})
                    parts.append(segment)
                    size += len(segment)
                n += 1
            if out:
                yield frame(out)
        if machine is not None:
            yield frame([row(machine.done())])

    columns = [c.split()[0] for c in FORMATTED.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("decimal(20,0)").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInPandas(run, FORMATTED).withColumn("conv_id", F.col("conv_id").cast("long"))


def turns_of(formatted: str, template: Template = CHATML) -> list[tuple[str, str]]:
    """(role, text) of the turns in a piece, found by the template's markup alone."""
    at = {name: template.turn.index(name) for name in ("{role}", "{text}")}
    first = "".join(template.turn[: at["{role}"]])
    between = "".join(template.turn[at["{role}"] + 1 : at["{text}"]])
    last = "".join(template.turn[at["{text}"] + 1 :])
    out, here = [], 0
    while here < len(formatted):
        if not formatted.startswith(first, here):
            raise ValueError(f"no turn starts at {here}")
        start = here + len(first)
        middle = formatted.index(between, start)
        end = formatted.index(last, middle + len(between))
        # a role's own newline is spelled ESCAPE n, which no other escape makes
        role = ESCAPE.join(p.replace(ESCAPE + "n", "\n").replace(ESCAPE, "") for p in formatted[start:middle].split(ESCAPE * 2))
        out.append((role, unescaped(formatted[middle + len(between) : end], template)))
        here = end + len(last)
    return out


READ = "conv_id decimal(20,0), n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, faults long"


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """What the pieces of format_chats say, a row per conversation: turns and learned text, hashed.

    turns_sha256: of role, newline, text, newline of each turn; loss_sha256: of all text under the loss
    spans, unescaped. A hash goes over a whole conversation, so its pieces are read as a stream by one
    task; they must be in one partition, as format_chats leaves them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None

        def row() -> tuple:
            n, turns, chars, loss, size, faults = state
            return now, n, turns.hexdigest(), chars, loss.hexdigest(), size, faults

        for batch in batches:
            out = []
            for conv, text, spans, faults in zip(batch["conv_id"], batch["formatted"], batch["loss"], batch["faults"]):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in turns_of(text, template):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    said = unescaped(text[s["start"] : s["end"]], template)
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
                state[5] = faults
            if out:
                yield pd.DataFrame(out, columns=columns)
        if state is not None:
            yield pd.DataFrame([row()], columns=columns)

    columns = [c.split()[0] for c in READ.split(", ")]
    rows = formatted.sortWithinPartitions("conv_id", "piece").select(F.col("conv_id").cast("decimal(20,0)").alias("conv_id"), "formatted", "loss", "faults")
    return rows.mapInPandas(run, READ).withColumn("conv_id", F.col("conv_id").cast("long"))
