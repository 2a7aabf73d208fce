"""Chat formatting by incremental black-box rendering.

A template is a function from turns to a string, and nothing else is known of it. Rendering successive
prefixes of a conversation and comparing consecutive outputs shows the span that each turn adds; an
output that does not begin with the one before it shows a template that rewrites history.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turn = tuple[str, str]
START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _CLOSED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
#: Stands for a turn's text when its place in a span is looked for.
PROBE = ""


def escape(text: str) -> str:
    """`<|` becomes `<\\|`, and each such escape one backslash longer; so no `<|` is left."""
    return _OPEN.sub(r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "<|n|>")


def unescape_role(role: str) -> str:
    return unescape(role.replace("<|n|>", "\n"))


def marked_turns(turns: Sequence[Turn]) -> str:
    """The default template: a start mark and the role, the text, an end mark; control strings inside
    roles and texts are escaped."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def read_back(formatted: str) -> list[Turn]:
    """The turns of an output of `marked_turns`; anything else in it is an error."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.find("\n", at)
        end = formatted.find("<|", line + 1) if line >= 0 else -1
        if end < 0 or not formatted.startswith(START, at) or not formatted.startswith(END + "\n", end):
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]]  # of each turn; of a rewriting template, what differs from the output before
    rewrites: bool


def _every_prefix(template: Callable[[Sequence[Turn]], str], turns: Sequence[Turn]) -> Rendered:
    before, spans, rewrites = template([]), [], False
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        same = len(before)
        if not now.startswith(before):
            rewrites = True
            same = next((i for i, (x, y) in enumerate(zip(before, now, strict=False)) if x != y), min(len(before), len(now)))
        spans.append((same, len(now)))
        before = now
    return Rendered(before, spans, rewrites)


def render(template: Callable[[Sequence[Turn]], str], turns: Sequence[Turn]) -> Rendered:
    """The output for all `turns` and the span of each, from all prefixes, whatever the length: a template may rewrite at
    any one of them, and nothing else would show it. So a conversation costs the square of its turns."""
    return _every_prefix(template, turns)


def contents(
    template: Callable[[Sequence[Turn]], str], undo: Callable[[str], str], turns: Sequence[Turn], done: Rendered
) -> list[tuple[int, int] | None]:
    """Where each turn's text stands in the output: the turn is rendered with a probe for its text,
    which shows what the template puts before and behind. None where reading back fails."""
    frames: dict[tuple[str, bool], tuple[str, str]] = {}
    out: list[tuple[int, int] | None] = []
    for k, ((role, text), (start, end)) in enumerate(zip(turns, done.spans, strict=True)):
        place = None
        for attempt in (True, False):
            frame = frames.get((role, k == 0)) if attempt else None
            if frame is None:
                since = max(0, k - 1) if attempt else 0
                before = template(turns[since:k])
                with_probe = template([*turns[since:k], (role, PROBE)])
                head, probe, tail = with_probe[len(before) :].partition(PROBE)
                if not probe or not with_probe.startswith(before):
                    continue
                frame = frames[role, k == 0] = (head, tail)
            low, high = start + len(frame[0]), end - len(frame[1])
            if low <= high and done.text.startswith(frame[0], start) and done.text[high:end] == frame[1] and undo(done.text[low:high]) == text:
                place = (low, high)
                break
        out.append(None if done.rewrites else place)
    return out


_TURN = T.StructType(
    [T.StructField(n, T.StringType() if n == "role" else T.BooleanType() if n == "loss" else T.IntegerType()) for n in ("role", "start", "end", "content_start", "content_end", "loss")]
)


def format_conversations(
    df: DataFrame,
    template: Callable[[Sequence[Turn]], str] = marked_turns,
    undo: Callable[[str], str] = unescape,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_roles: Sequence[str] = ("assistant",),
) -> DataFrame:
    """(key, formatted, turns, rewrites), one row for each conversation.

    turns: array of (role, start, end, content_start, content_end, loss), offsets in code points of
    `formatted`; content offsets are null, and nothing of the turn is under the loss, where the
    template rewrites history or the text cannot be read back. Rows go by turn (null first), then
    role, then text; rows that repeat are turns of their own. Null roles and texts are empty; null
    keys are one conversation. Other columns are not read.

    One shuffle by key; partitions are sorted and streamed, so a task holds one conversation at a time.
    """
    rows = df.select(F.col(key).alias(key), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.repartition(key).sortWithinPartitions(key, "turn", "role", "text")

    def made(name, turns: list[Turn]) -> dict:
        done = render(template, turns)
        places = contents(template, undo, turns, done)
        return {
            key: name,
            "formatted": done.text,
            "turns": [
                {"role": r, "start": s, "end": e, "content_start": p and p[0], "content_end": p and p[1], "loss": p is not None and r in loss_roles}
                for (r, _), (s, e), p in zip(turns, done.spans, places, strict=True)
            ],
            "rewrites": done.rewrites,
        }

    schema = T.StructType([rows.schema[key], T.StructField("formatted", T.StringType()), T.StructField("turns", T.ArrayType(_TURN)), T.StructField("rewrites", T.BooleanType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out, size = None, [], [], 0
        for batch in batches:
            for name, _, r, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and name != at:
                    out.append(made(at, held))
                    size += len(out[-1]["formatted"])
                    held = []
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, size = [], 0
                at = name
                held.append((r, t))
        if held:
            out.append(made(at, held))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def digests(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Read back from the outputs of the default template: turns and what is under the loss mask."""
    rows = df.select(key, "formatted", F.filter("turns", lambda t: t["loss"]).alias("mask"))
    rows = rows.select(key, "formatted", F.transform("mask", lambda t: F.struct(t["content_start"], t["content_end"])).alias("mask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[slice(*m.values())]) for m in mask)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                made.append((len(turns), _sha(whole), len(loss), _sha(loss), len(text)))
            columns = [pa.array([m[i] for m in made], pa.string() if i in (1, 3) else pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType()]
    return rows.mapInArrow(run, T.StructType([df.schema[key], *(T.StructField(n, k) for n, k in zip(names[1:], kinds, strict=True))]))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
