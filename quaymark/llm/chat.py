"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to one string.  Successive turn prefixes
are rendered and consecutive outputs compared: what a prefix adds to the one before is the
span of its last turn.  An output that doesn't begin with the one before tells that the template
rewrites history; such conversations are marked, and their later spans aren't used for a loss.
Where the text lies inside a span is found the same way: the turn is rendered with two other
texts, and what all renderings share at both ends is the turn's frame.

Turns arrive sorted and are streamed.  What a turn adds is what the whole prefix before it and the
whole prefix with it say, so a worker holds the turns and the last output of one conversation.  A
turn that comes out otherwise with the last `window` turns alone depends on more history than the
window holds: this is compared at every turn, and raises; without a window nothing is compared
and any template goes.  Only of a template declared `additive` (every turn is rendered alone, as by
the default one) a worker holds at most `window` turns however long the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.text import small_batches

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
WINDOW = 32
SPANS = "conv_id long, seq long, piece string, first long, text_first long, text_length long, loss boolean, rewrites boolean"

_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)


def escaped(text: str) -> str:
    """No control string is left: `<|` gets a backslash inside, and so does what looks escaped."""
    return _PLAIN.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def additive(template: Template) -> Template:
    """Declare that a template renders every turn alone: the output is the turns' outputs one after the other."""
    template.additive = True
    return template


@additive
def marked_turns(turns: Turns) -> str:
    """The default template: every turn between control strings, its text escaped reversibly."""
    return "".join(f"{OPEN}{escaped_role(role)}\n{escaped(text)}{CLOSE}\n" for role, text in turns)


def parsed(output: str) -> Turns:
    """The turns of a default-template output."""
    return [(unescaped_role(m[1]), unescaped(m[2])) for m in _TURN.finditer(output)]


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def frame(template: Template, before: Turns, role: str) -> tuple[int, int]:
    """Lengths of what the template puts before and after a turn's text."""
    base = len(template(before))
    one, two = (template([*before, (role, probe)])[base:] for probe in ("a", "bb"))
    head = _shared(one, two)
    return head, _shared(one[head:][::-1], two[head:][::-1])


class Renderer:
    """Spans of one conversation's turns, in order."""

    def __init__(self, template: Template, window: int | None, learn: frozenset[str]):
        self.template, self.window, self.learn = template, window, learn
        self.additive = window is not None and getattr(template, "additive", False)
        self.turns: Turns = []
        self.output = ""
        self.first, self.seq, self.rewrites = 0, 0, False

    def add(self, role: str, text: str) -> tuple:
        turn, output = (role, text), self.output
        now = self.template([*self.turns, turn])
        if self.window is not None and len(self.turns) >= self.window:
            kept = self.turns[len(self.turns) - (self.window // 2 if self.additive else self.window) :]
            shorter = self.template(kept)
            after = self.template([*kept, turn])
            if now.startswith(output) and after[len(shorter) :] != now[len(output) :]:
                raise ValueError("the template looks further back than the window; give a larger one, or None")
            if self.additive:
                self.turns, output, now = kept, shorter, after
        self.rewrites |= not now.startswith(output)
        piece = now[_shared(now, output) :]
        loss, head, n = role in self.learn and not self.rewrites, 0, 0
        if loss:
            head, tail = frame(self.template, self.turns, role)
            n = len(piece) - head - tail
        row = (self.seq, piece, self.first, self.first + head, n, loss, self.rewrites)
        self.turns, self.output = [*self.turns, turn], now
        self.first, self.seq = self.first + len(piece), self.seq + 1
        return row


def format_chats(
    conversations: DataFrame, template: Template = marked_turns, learn: tuple[str, ...] = ("assistant",), window: int | None = WINDOW
) -> DataFrame:
    """One row per turn, in order within a task: the piece it adds to the output and where its text lies.

    first and text_first count characters of the conversation's output; loss tells that the text
    [text_first, text_first + text_length) is learnt.  Null text and null role are empty; null
    conv_id is one conversation, null turns come first, equal turns are ordered by role and
    text, repeated rows are repeated turns.  window: see above; None takes any template.  Other columns are ignored; no rows give no rows.
    """
    small_batches(conversations.sparkSession)
    names = [part.split()[0] for part in SPANS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    learnt = frozenset(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, conv = None, object()
        for rows in batches:
            out = []
            for conv_id, role, text in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
                if current is None or conv_id != conv:
                    current, conv = Renderer(template, window, learnt), conv_id
                out.append((conv_id, *current.add(role, text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("turn").cast("long").alias("turn"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, SPANS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"


def digests(spans: DataFrame) -> DataFrame:
    """Read the pieces of default-template outputs back: one row per conversation.

    Takes the rows of format_chats as they come, streaming the hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        names = [part.split()[0] for part in DIGESTS.split(", ")]

        def closed(s: list) -> list:
            return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6]]

        def batch(out: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for rows in batches:
            out = []
            for conv_id, seq, piece, first, text_first, n, loss, rewrites in zip(*(rows.column(k).to_pylist() for k in range(8)), strict=True):
                if state is None or seq == 0:
                    if state:
                        out.append(closed(state))
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, text in parsed(piece):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if loss:
                    learnt = unescaped(piece[text_first - first : text_first - first + n])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(piece)
                state[6] |= rewrites
            if out:
                yield batch(out)
        if state:
            yield batch([closed(state)])

    return spans.mapInArrow(run, DIGESTS)
