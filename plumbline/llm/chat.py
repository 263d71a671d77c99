r"""Formatting conversations with a template that is treated as a black box.

A template is any function from turns (role, text) to a string.  The formatter renders the prefixes of a conversation
one turn longer each time and compares consecutive outputs: what an output adds to the one before is the new turn's
span.  An output that does not begin with the one before has rewritten history; the first such turn is recorded, spans
of that conversation can't be trusted, and none of it is trained on.  For turns that count for the loss, two more
renderings with the turn's text replaced by two different letters show where the text begins and ends inside the span:
the outputs agree exactly in what stands around it.

The default template writes "### role: text </turn>" and a line break for each turn.  Backslashes, "###" and "</turn>"
in texts, and colons in roles as well, get a backslash before them, which reading takes off again.

A conversation is formatted in one task, so a task needs the memory of its largest conversation; rendering all prefixes
takes time in the square of its turns, as the method has it.  Nothing else grows within a task.

Nulls, ties and the like: a null text or role is empty; turns are ordered by number, then role, then text, null numbers
first; repeated rows are repeated turns; rows with a null conversation form one with the id null; a conversation
without assistant turns has no loss; an empty table gives an empty result; other columns of the table are not used.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]
OPEN, CLOSE = "###", "</turn>"
CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
#: A turn as the default template writes it; what stands between the marks holds whole escapes only.
WRITTEN = re.compile(r"### ((?:[^\\:]++|\\(?:\\|###|</turn>|:))*+): ((?:[^\\< ]++|\\(?:\\|###|</turn>)|<(?!/turn>)| (?!</turn>\n))*+) </turn>\n", re.S)


def escaped(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def marked_turns(turns: Sequence[Turn]) -> str:
    """The default template."""
    return "".join(f"{OPEN} {escaped(role).replace(':', chr(92) + ':')}: {escaped(text)} {CLOSE}\n" for role, text in turns)


def read_turns(formatted: str) -> list[Turn]:
    """The turns that the default template wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = WRITTEN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return out


def text_edges(template: Template, before: Sequence[Turn], role: str) -> tuple[int, int]:
    """Where the text of a turn after `before` begins, from the output's start, and how far before its end it ends."""
    a, b = template([*before, (role, "a")]), template([*before, (role, "b")])
    return len(os.path.commonprefix([a, b])), len(os.path.commonprefix([a[::-1], b[::-1]]))


def formatted_conversation(turns: Sequence[Turn], template: Template = marked_turns, loss_roles: Sequence[str] = ("assistant",)) -> dict:
    """The output, each turn's span (start, end), the loss spans of texts, and the turn that rewrote history, if any."""
    spans, loss, rewritten, before = [], [], None, ""
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            rewritten = k if rewritten is None else rewritten
        else:
            spans.append((len(before), len(now)))
            if role in loss_roles and rewritten is None:
                head, tail = text_edges(template, turns[:k], role)
                if len(before) <= head <= len(now) - tail:
                    loss.append((head, len(now) - tail))
        before = now
    return {"formatted": before, "spans": spans if rewritten is None else [], "loss": loss if rewritten is None else [], "rewritten_at": rewritten}


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
OUT = "formatted string, n_turns long, spans array<struct<start:long,end:long>>, loss array<struct<start:long,end:long>>, rewritten_at int"


def formatted(conversations: DataFrame, template: Template = marked_turns, loss_roles: Sequence[str] = ("assistant",), key: str = "conv_id") -> DataFrame:
    """One row for each conversation: its id, formatted text, number of turns, spans, loss spans, rewritten_at."""
    kind = conversations.schema[key].dataType.simpleString()
    empty = F.lit("")
    turn = F.struct(F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    grouped = conversations.groupBy(F.col(f"`{key}`").alias(key)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = lambda found: [{"start": a, "end": b} for a, b in found]
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: outputs may be long
                turns = [(t["role"], t["text"]) for t in batch.column("turns")[i].as_py()]
                got = formatted_conversation(turns, template, loss_roles)
                arrays = [
                    batch.column(key).slice(i, 1),
                    pa.array([got["formatted"]], pa.string()),
                    pa.array([len(turns)], pa.int64()),
                    pa.array([pairs(got["spans"])], pa.list_(SPAN)),
                    pa.array([pairs(got["loss"])], pa.list_(SPAN)),
                    pa.array([got["rewritten_at"]], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, [key, "formatted", "n_turns", "spans", "loss", "rewritten_at"])

    return grouped.select(key, "turns").mapInArrow(run, f"`{key}` {kind}, {OUT}")


def digests(output: DataFrame, key: str = "conv_id") -> DataFrame:
    """What can be read back from the output: (key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Turns come from the marks in the formatted text, the loss from the loss spans.
    """
    kind = output.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                turns = read_turns(text)
                learned = "".join(unescaped(text[s["start"] : s["end"]]) for s in loss)
                digest = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode())
                rows.append((len(turns), digest.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [pa.array([r[j] for r in rows], kinds[j]) for j in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *arrays], [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return output.select(key, "formatted", "loss").mapInArrow(run, schema)
