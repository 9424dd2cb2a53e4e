"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Each conversation is rendered for its first
turn, its first two turns, and so on. Where an output begins with the output before, the new part is the new turn's
span. Where it does not, the template has rewritten history: the conversation is marked, and spans begin where the two
outputs part. A turn's text is located by rendering the prefix once more with a probe in its place.

``MARKED`` is the template in use. It marks turns by control strings and escapes these, and its escape character, inside
texts, so its output can be read back.

Rows go to tasks by conversation and are streamed in the order of turns; a task holds one conversation at a time, which
is one training sample. Turns with equal numbers are ordered by role and text. Null roles and texts are empty; rows
without a conversation id form one conversation without id. Repeated rows are turns of their own. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[TURN:", "[/TURN]")
IN_TEXT = re.compile("|".join(map(re.escape, CONTROL)))
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Stands for a turn's text while it is located; no template treats private characters specially.
PROBE = "\ue000probe\ue000"

SPANS = "array<struct<role: string, begin: int, stop: int, text_begin: int, text_stop: int, loss: boolean>>"
FORMATTED = f"formatted string, rewritten boolean, spans {SPANS}"


def escape(text: str) -> str:
    """No control string is left in the result; ``unescape`` undoes it."""
    return IN_TEXT.sub(lambda found: f"{found[0][0]}\\{found[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def marked(turns: list[Turn]) -> str:
    """User turns as instructions, assistant turns closed by an end mark, other roles by name."""
    out = ["<s>"]
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escape(text)}</s>")
        else:
            out.append(f"[TURN:{escape(role).replace(']', chr(92) + ']')}] {escape(text)} [/TURN]")
    return "".join(out)


READ = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]"
    r"|\[TURN:(?P<role>(?:\\.|[^\\\]])*)\] (?P<other>.*?) \[/TURN\]"
    r"| (?P<assistant>.*?)</s>",
    re.DOTALL,
)


def read_back(formatted: str) -> list[Turn]:
    """The turns of a formatted conversation."""
    turns, at = [], len("<s>")
    while at < len(formatted):
        found = READ.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        if found["user"] is not None:
            turns.append(("user", unescape(found["user"])))
        elif found["assistant"] is not None:
            turns.append(("assistant", unescape(found["assistant"])))
        else:
            turns.append((unescape(found["role"]), unescape(found["other"])))
        at = found.end()
    return turns


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def located(template: Template, turns: list[Turn], loss_roles: tuple[str, ...]) -> tuple[str, bool, list[dict]]:
    """The rendered conversation, whether the template rewrote history, and a span for each turn.

    A turn whose text the template drops or changes has an empty text span at its end.
    """
    before, rewritten, spans = template([]), False, []
    for count, (role, text) in enumerate(turns, 1):
        now = template(turns[:count])
        begin = len(before)
        if not now.startswith(before):
            rewritten, begin = True, common(before, now)
        probed = template([*turns[: count - 1], (role, PROBE)])
        at = probed.find(PROBE, begin)
        head, tail = (at, len(probed) - at - len(PROBE)) if at >= 0 else (len(now), 0)
        if at < 0 or now[:head] != probed[:head] or tail and now[len(now) - tail :] != probed[len(probed) - tail :]:
            head, tail = len(now), 0
        spans.append(
            {"role": role, "begin": begin, "stop": len(now), "text_begin": head, "text_stop": len(now) - tail,
             "loss": role in loss_roles}
        )
        before = now
    return before, rewritten, spans


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
    """Successive (id, turns) of rows that arrive sorted by id and turn."""
    current, turns = None, []
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("conv_id", "role", "text"))
        for conv, role, text in zip(*columns, strict=True):
            if turns and conv != current:
                yield current, turns
                turns = []
            current = conv
            turns.append((role or "", text or ""))
    if turns:
        yield current, turns


def formatted(rows: DataFrame, template: Template = marked, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, formatted, rewritten, spans)`` for every conversation of ``rows(conv_id, turn, role, text)``.

    Spans count characters of ``formatted``; text spans of turns with ``loss`` are the loss mask.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    made = f"conv_id {kind}, {FORMATTED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        out: list[dict] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema)

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = schema or span_schema(batch.schema.field("conv_id").type)
                yield batch

        for conv, turns in conversations(typed()):
            whole, rewritten, spans = located(template, turns, loss_roles)
            out.append({"conv_id": conv, "formatted": whole, "rewritten": rewritten, "spans": spans})
            size += len(whole)
            if size > 1 << 22:
                yield batch_of()
                out, size = [], 0
        if out:
            yield batch_of()

    narrow = rows.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    sorted_rows = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_rows.mapInArrow(run, made)


def span_schema(conv: pa.DataType) -> pa.Schema:
    span = pa.struct(
        [("role", pa.string()), *((name, pa.int32()) for name in ("begin", "stop", "text_begin", "text_stop")), ("loss", pa.bool_())]
    )
    return pa.schema([("conv_id", conv), ("formatted", pa.string()), ("rewritten", pa.bool_()), ("spans", pa.list_(span))])


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is read back from the formatted conversations, as numbers and digests."""
    for batch in batches:
        out = []
        for conv, whole, spans in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "spans")), strict=True):
            turns = read_back(whole)
            loss = "".join(unescape(whole[x["text_begin"] : x["text_stop"]]) for x in spans if x["loss"])
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append((conv, len(turns), hex_digest(said), len(loss), hex_digest(loss), len(whole)))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def hex_digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def digests(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    return formatted(rows).mapInArrow(
        digest_rows,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
