"""Chat formatting with a grammar round trip.

A conversation is rendered as turns: ``<|turn|>role`` and a line feed, the text, ``</s>`` and a line feed. Control strings
inside a role or text are escaped reversibly: a backslash goes in after the first sign of the control string, and one
more where backslashes are there already, so that the parser takes one away. A turn is first rendered as it is; the
rendered text is parsed again, and turns are escaped until the parser gives back the source and no control string
is left in a text, which one round of escaping always achieves. The loss mask is the spans of the assistant's texts in the rendered text.

Escaping and the round trip run turn by turn where the rows lie; then the turns are brought together by
conversation, in sorted runs that are read as a stream, so that the memory needed is that of one batch, however long a
conversation is. The digests of a conversation are sequential by nature, so one task reads it all.

Null roles and texts count as empty. Turns are ordered by turn (nulls first), then as they are rendered; equal turns are
interchangeable, and repeated rows are turns of their own. Ids and turns may be numbers or strings; a null conversation id is a
conversation of its own. Very long texts are rendered and parsed in whole. An empty table gives an empty result. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of the template and of widespread chat formats.
OPEN, CLOSE = "<|turn|>", "</s>"
CONTROL = (OPEN, CLOSE, "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ASSISTANT = "assistant"

_FORMS = "|".join(re.escape(c[0]) + r"(\\*)" + re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_GUARDED = re.compile(_FORMS)
_RAW = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.DOTALL)


def escape(text: str) -> str:
    """text without control strings; :func:`unescape` gives it back."""
    return _GUARDED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """Takes one backslash away from every escaped control string."""
    return _GUARDED.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def _name(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def _role(name: str) -> str:
    return unescape(name.replace("%0A", "\n").replace("%25", "%"))


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns (role, text) of a rendered conversation; None if it does not follow the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m:
            return None
        turns.append((_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn and the span of its text in it; escaped only where the round trip fails without."""
    head = f"{OPEN}{_name(role)}\n"
    body = text
    escaped = False
    while _RAW.search(body) or parse(turn := f"{head}{body}{CLOSE}\n") != [(role, text)]:
        if escaped:
            raise ValueError("a turn does not survive the round trip")
        body, escaped = escape(text), True
    return turn, len(head), len(head) + len(body)


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rendered turns: conv_id, turn, role, text, rendered, body_start, body_end (in the rendered turn), for each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [render(r, t) for r, t in zip(frame["role"], frame["text"], strict=True)]
            frame["rendered"], frame["body_start"], frame["body_end"] = ([d[i] for d in done] for i in range(3))
            yield frame

    plain = rows.select(
        F.col(conv_col).cast("string").alias("conv_id"),  # as text: pandas would turn whole numbers with nulls into fractions
        F.col(turn_col).cast("string").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    out = plain.mapInPandas(run, "conv_id string, turn string, role string, text string, rendered string, body_start int, body_end int")
    return out.withColumn("conv_id", F.col("conv_id").cast(rows.schema[conv_col].dataType)).withColumn("turn", F.col("turn").cast(rows.schema[turn_col].dataType))


def conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation of :func:`format_turns`, with digests of what the parser reads back from the rendered turns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, out = None, []

        def done():
            conv, n, turns_sha, loss_chars, loss_sha, chars = held
            out.append((conv, n, turns_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars))

        for frame in frames:
            for conv, rendered, start, end in zip(frame["conv"], frame["rendered"], frame["body_start"], frame["body_end"], strict=True):
                if held is None or held[0] != conv:  # a null id comes as None
                    if held is not None:
                        done()
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ((role, text),) = parse(rendered)
                held[1] += 1
                held[2].update(f"{role}\n{text}\n".encode())
                if role == ASSISTANT:
                    under_mask = unescape(rendered[start:end])
                    held[3] += len(under_mask)
                    held[4].update(under_mask.encode())
                held[5] += len(rendered)
            yield pd.DataFrame(out, columns=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out = []
        if held is not None:
            done()
            yield pd.DataFrame(out, columns=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    # The order needs no copy of the texts: a rendered turn begins with its role and text.
    keyed = turns.select(F.col("conv_id").cast("string").alias("conv"), "turn", "rendered", "body_start", "body_end")
    runs = keyed.repartition("conv").sortWithinPartitions("conv", "turn", "rendered")
    grouped = runs.mapInPandas(run, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return grouped.select(F.col("conv").cast(turns.schema["conv_id"].dataType).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
