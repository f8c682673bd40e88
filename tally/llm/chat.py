"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags.

Turns of a conversation stream through in order, sorted within one partition by Spark (which spills), so a conversation
of any length is never held: each turn gives a head, a body and a tail segment. The machine judges every turn by the
state that the turns before it have left; a turn out of order is marked and the machine goes on from it, so every
conversation is formatted whole. The last segment of a conversation carries whether it ends in a final state and had
no turn out of order.

The template's marks and the escape character are control strings: inside texts each gets the escape character before
it, so a mark in the output is never text, and removing the escapes gives the text back. `Reader` reads turns, or the
whole output in pieces of any size, back.

All turns of a conversation are one task's, as the machine needs their order; they stream, and only a turn is held.

Defined results: null text and null role count as empty. A role without a header of its own is written with the
template's `other` header, escaped likewise. Turns are ordered by turn (null first), then role, then text; repeated
rows are turns of their own. Rows with a null conv_id are one conversation. Empty table: no rows. Further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = "conv_id long, turn_no long, kind string, segment string, loss boolean, in_order boolean, valid boolean"


@dataclass(frozen=True)
class Template:
    """What to write, and which order of roles is right.

    Control strings are `mark`, `end` and `escape`. A header is mark + name + ": ".
    """

    mark: str = "### "
    end: str = "</turn>"
    escape: str = "\\"
    after: str = "\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    other: str = "Role "
    learn: frozenset[str] = frozenset({"assistant"})
    #: state -> role -> next state; the machine starts at "start".
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: frozenset[str] = frozenset({"answered"})

    def controls(self) -> list[str]:
        return sorted({self.mark, self.mark.strip(), self.end, self.escape}, key=len, reverse=True)

    def quote(self, text: str) -> str:
        return re.sub("|".join(map(re.escape, self.controls())), lambda m: self.escape + m[0], text)

    def head(self, role: str) -> str:
        name = self.names.get(role)
        return f"{self.mark}{name}: " if name is not None else f"{self.mark}{self.other}{self.quote(role)}{self.end}: "

    def tail(self) -> str:
        return self.end + self.after


def state_after(t: Template, state: str, role: str) -> tuple[str, bool]:
    """(next state, whether the role may follow); out of order, the role's own state is taken, or else the state stays."""
    if (to := t.moves.get(state, {}).get(role)) is not None:
        return to, True
    return next((m[role] for m in t.moves.values() if role in m), state), False


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments in order; a conversation's `segment` strings, one after another, are its formatted text."""
    t = template or Template()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SEGMENT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
        pending, before, state, good, no = None, (), "start", True, 0
        for b in batches:
            out: list[tuple] = []
            for conv, role, body in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if before != (conv,):
                    if pending:
                        out.append((*pending, good and state in t.final))
                    pending, before, state, good, no = None, (conv,), "start", True, 0
                if pending:
                    out.append((*pending, None))
                state, ok = state_after(t, state, role)
                good = good and ok
                out.append((conv, no, "head", t.head(role), False, ok, None))
                out.append((conv, no, "body", t.quote(body), role in t.learn, ok, None))
                pending, no = (conv, no, "tail", t.tail(), False, ok), no + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(types)], names)
        if pending:
            last = (*pending, good and state in t.final)
            yield pa.RecordBatch.from_arrays([pa.array([last[i]], k) for i, k in enumerate(types)], names)

    return dealt.mapInArrow(run, SEGMENT)


class Reader:
    """Reads formatted text back: `turn` one turn, `feed` pieces of any size, of which it gives each turn as it ends."""

    def __init__(self, template: Template | None = None):
        self.t = template or Template()
        t = self.t
        self.token = re.compile("|".join([re.escape(t.escape) + "(?:" + "|".join(map(re.escape, t.controls())) + ")", re.escape(t.end), re.escape(t.mark)]))
        self.roles = {v: k for k, v in t.names.items()}
        self.room = len(t.escape) + max(map(len, t.controls())) + len(t.after)
        self.held, self.at = "", 0

    def feed(self, piece: str, last: bool = False) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that end in this piece; `last` marks the last piece, behind which nothing is open."""
        self.held += piece
        safe = len(self.held) - (0 if last else self.room)  # tokens that begin before are whole
        cut = 0
        for m in self.token.finditer(self.held, self.at):
            if m.start() >= safe:
                break
            self.at = m.end()
            if m[0] == self.t.end and self.held.startswith(self.t.after, m.end()):
                end = m.end() + len(self.t.after)
                yield self.turn(self.held[cut:end])
                cut = self.at = end
        self.at = max(self.at, safe) - cut
        self.held = self.held[cut:]
        if last and self.held:
            raise ValueError("a turn that does not end")

    def unquote(self, text: str) -> str:
        e = re.escape(self.t.escape)
        return re.sub(e + "(" + "|".join(map(re.escape, self.t.controls())) + ")", lambda m: m[1], text)

    def turn(self, formatted: str) -> tuple[str, str]:
        """One formatted turn -> (role, text)."""
        t = self.t
        if not (formatted.startswith(t.mark) and formatted.endswith(t.tail())):
            raise ValueError("not a turn")
        marks = [m for m in self.token.finditer(formatted, len(t.mark)) if not m[0].startswith(t.escape)]
        rest = formatted[len(t.mark) :]
        if rest.startswith(t.other):
            end = marks[0]
            role = self.unquote(formatted[len(t.mark) + len(t.other) : end.start()])
            if marks.pop(0)[0] != t.end or not formatted.startswith(": ", end.end()):
                raise ValueError("no header")
            body = end.end() + 2
        else:
            name, _, _ = rest.partition(": ")
            role, body = self.roles[name], len(t.mark) + len(name) + 2
        if [m[0] for m in marks] != [t.end]:
            raise ValueError("a mark inside a text")
        return role, self.unquote(formatted[body : marks[0].start()])


def digests(parts: DataFrame, template: Template | None = None) -> DataFrame:
    """What the output holds, read back from the segments: one row per conversation.

    The rows must come in the order and partitions in which `segments` gives them. Hashes run along, so nothing but a
    turn is held.
    """
    t = template or Template()
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, names = Reader(t), [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        fresh = lambda: [(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0, None]
        now, turn, learnt = fresh(), "", ""
        for b in batches:
            out = []
            for conv, kind, segment, loss, valid in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 6)), strict=True):
                if now[0] != (conv,):
                    if now[0]:
                        out.append(now)
                    now = fresh()
                    now[0] = (conv,)
                turn += segment
                now[5] += len(segment)
                if loss:
                    learnt += segment
                if kind == "tail":
                    role, text = reader.turn(turn)
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    plain = reader.unquote(learnt)
                    now[3] += len(plain)
                    now[4].update(plain.encode("utf-8", "surrogatepass"))
                    now[6], turn, learnt = valid, "", ""
            yield batch(out, types, names)
        if now[0]:
            yield batch([now], types, names)

    def batch(rows, types, names):
        cols = [[r[0][0] for r in rows], [r[1] for r in rows], [r[2].hexdigest() for r in rows], [r[3] for r in rows], [r[4].hexdigest() for r in rows], [r[5] for r in rows], [r[6] for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names)

    return parts.mapInArrow(run, schema)
