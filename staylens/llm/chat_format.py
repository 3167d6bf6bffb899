"""Operator 3: chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Successive turn
prefixes are rendered and consecutive outputs compared: what the longer output adds to
the shorter one is the new turn's span. Where the longer output does not start with the
shorter one, the template rewrites history, and the turn says how many characters changed.
The text inside a span is found by rendering the turn once more with a sentinel for text.

Rows are sorted within their conversation and streamed. Every prefix is rendered whole, from
its first turn: a task holds the turns of one conversation, and the work grows with the
square of its length. A template whose output for a turn depends on, and changes, no more
than a number of turns before it can declare that number as its attribute ``lookback`` (or
the caller passes it): then at least twice as many turns are held, and at most four times.

Defined results: NULL text and NULL role are empty strings; turns sort by (turn, role,
text), NULL turns first; rows with NULL conversation id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens._util import qcol

Turns = list[tuple[str, str]]
_SENTINEL = ""

# The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|\[ROLE\](.*?)\[/ROLE\] (.*?)</s>| (.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    """Doubles every backslash and puts one behind the first character of a control
    string, so that no control string is left; ``unescape`` reverses it."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def instruction_template(turns: Turns) -> str:
    """``<s>[INST] user [/INST] assistant</s>``; other roles are named in [ROLE] marks."""
    out = ["<s>"]
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f" {body}</s>")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE] {body}</s>")
    return "".join(out)


instruction_template.lookback = 1  # a turn's output depends on that turn alone


def read_turns(formatted: str) -> Turns:
    """The turns of a formatted string, or of a part of it cut between turns."""
    at = 3 if formatted.startswith("<s>") else 0
    out = []
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        user, role, other, assistant = m.groups()
        if user is not None:
            out.append(("user", unescape(user)))
        elif role is not None:
            out.append((unescape(role), unescape(other)))
        else:
            out.append(("assistant", unescape(assistant)))
        at = m.end()
    return out


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Renderer:
    """Renders one conversation turn by turn with a black-box template."""

    def __init__(self, template: Callable[[Turns], str], lookback: int | None = None):
        declared = getattr(template, "lookback", None) if lookback is None else lookback
        self.template, self.held = template, None if declared is None else 2 * max(1, declared)
        self.reset()

    def reset(self) -> None:
        self.turns: Turns = []
        self.shown: str | None = None

    def add(self, role: str, text: str) -> tuple[str, int, int, int]:
        """(piece, content start, content end, characters rewritten) of the next turn;
        content positions count from the piece's start."""
        before = self.shown
        if before is None:
            before = ""
        elif self.held is not None and len(self.turns) >= 2 * self.held:
            self.turns = self.turns[-self.held:]
            before = self.template(self.turns)
        self.turns.append((role, text))
        now = self.template(self.turns)
        same = _common(before, now)
        probe = self.template([*self.turns[:-1], (role, _SENTINEL)])
        at = probe.rfind(_SENTINEL)
        start = max(at, same) if at >= 0 else len(now)
        end = len(now) - (len(probe) - at - len(_SENTINEL)) if at >= 0 else len(now)
        self.shown = now
        return now[same:], start - same, max(start, end) - same, len(before) - same


_TURN_DDL = ("conv_id bigint, turn bigint, seq bigint, role string, piece string, start bigint, "
             "content_start bigint, content_end bigint, rewritten bigint")


def format_turns(conversations: DataFrame, template: Callable[[Turns], str] = instruction_template,
                 lookback: int | None = None, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """A row for each turn, in order within its partition: the piece it adds, the piece's
    place in the formatted conversation, the content's place in the piece, and how many
    characters of earlier output the template rewrote."""
    rows = conversations.select(
        qcol(conv).cast("bigint").alias("conv_id"), qcol(turn).cast("bigint").alias("turn"),
        F.coalesce(qcol(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(qcol(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        renderer = Renderer(template, lookback)
        current, seq, at = (), 0, 0
        for batch in batches:
            out = []
            for c, t, r, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if current != (c,):
                    current, seq, at = (c,), 0, 0
                    renderer.reset()
                piece, lo, hi, rewritten = renderer.add(r, x)
                at -= rewritten
                out.append((c, t, seq, r, piece, at, lo, hi, rewritten))
                seq, at = seq + 1, at + len(piece)
            columns = list(zip(*out)) if out else [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(columns, kinds)],
                names=["conv_id", "turn", "seq", "role", "piece", "start", "content_start", "content_end", "rewritten"])

    return rows.mapInArrow(run, _TURN_DDL)


_DIGEST_DDL = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
               "formatted_chars bigint, rewritten_turns bigint")


def digests(formatted: DataFrame, read=read_turns, undo=unescape) -> DataFrame:
    """One row per conversation, read back from the pieces of ``format_turns`` (whose rows
    must still lie in order): what it says, and the text under the loss mask, which is
    the content of each assistant turn."""

    def run(batches):
        names = [x.split()[0] for x in _DIGEST_DDL.split(", ")]
        kinds = [pa.string() if "sha256" in n else pa.int64() for n in names]
        state = None

        def row():
            return (state["c"], state["n"], state["turns"].hexdigest(), state["loss_n"],
                    state["loss"].hexdigest(), state["chars"], state["rewritten"])

        def table(rows):
            columns = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=names)

        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "seq", "role", "piece", "content_start",
                                                             "content_end", "rewritten")]
            for c, seq, role, piece, lo, hi, rewritten in zip(*columns):
                if seq == 0:
                    if state:
                        out.append(row())
                    state = {"c": c, "n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(),
                             "chars": 0, "rewritten": 0}
                for r, t in read(piece):
                    state["n"] += 1
                    state["turns"].update(f"{r}\n{t}\n".encode())
                if role == "assistant":
                    loss = undo(piece[lo:hi])
                    state["loss_n"] += len(loss)
                    state["loss"].update(loss.encode())
                state["chars"] += len(piece) - rewritten
                state["rewritten"] += rewritten > 0
            yield table(out)
        if state:
            yield table([row()])

    return formatted.mapInArrow(run, _DIGEST_DDL)
