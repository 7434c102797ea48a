"""Chat formatting: typed content parts flattened into one training string per conversation.

A message is a list of parts: text, image, audio or document. A visitor walks the parts in order. Text
is escaped, every other part becomes a numbered placeholder, and its reference and the number of
tokens that the model expands it to are recorded.

Template, per turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings start with ``<|``. Inside
texts and roles every ``<`` + backslashes + ``|`` gets one backslash more, so no text can hold a control
string, and taking one away restores it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buywave.llm.common import ship

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: Tokens per unit of a part: image tiles, seconds of audio, pages of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}

PART = "struct<type:string,text:string,ref:string,units:bigint>"
FORMATTED = (
    "conv_id bigint, n_turns bigint, formatted string, "
    "loss_spans array<struct<start:bigint,stop:bigint>>, "
    "attachments array<struct<number:int,type:string,ref:string,turn:int,position:bigint,tokens:bigint>>, "
    "expanded_tokens bigint"
)

_TO_ESCAPE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role is one line: backslashes are doubled and newlines written as backslash n."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


@dataclass
class PartVisitor:
    """Flattens the parts of one conversation. ``visit`` calls the method of the part's type."""

    out: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    position: int = 0
    turn: int = 0
    attachments: list[dict] = field(default_factory=list)

    def emit(self, piece: str) -> None:
        self.out.append(piece)
        self.position += len(piece)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(part.get("text") or "")

    def end_text(self) -> None:
        """Neighbouring texts are escaped as one, so that no control string can lie across them."""
        self.emit(escape("".join(self.text)))
        self.text = []

    def visit_image(self, part: dict) -> None:
        self.attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self.attach("document", part)

    def visit_unknown(self, part: dict) -> None:
        """A type the template does not know is kept as its text."""
        self.visit_text(part)

    def attach(self, kind: str, part: dict) -> None:
        self.end_text()
        number = len(self.attachments)
        tokens = TOKENS_PER_UNIT[kind] * max(int(part["units"]) if part.get("units") is not None else 1, 0)
        self.attachments.append(
            {"number": number, "type": kind, "ref": part.get("ref"), "turn": self.turn, "position": self.position, "tokens": tokens}
        )
        self.emit(f"<|{kind}_{number}|>")


def format_conversation(turns: list[tuple[str | None, list[dict]]]) -> dict:
    """The string, its loss spans (code points of assistant content) and its attachments."""
    visitor = PartVisitor()
    spans = []
    for k, (role, parts) in enumerate(turns):
        visitor.turn = k
        visitor.emit(f"{START}{escape_role(role or '')}\n")
        start = visitor.position
        for part in parts:
            visitor.visit(part)
        visitor.end_text()
        if role == LOSS_ROLE:
            spans.append({"start": start, "stop": visitor.position})
        visitor.emit(f"{END}\n")
    return {
        "n_turns": len(turns),
        "formatted": "".join(visitor.out),
        "loss_spans": spans,
        "attachments": visitor.attachments,
        "expanded_tokens": sum(x["tokens"] for x in visitor.attachments),
    }


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation, unescaped; placeholders stay as they are."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


def text_part(text: str | Column) -> Column:
    """A message of one text part; null text is an empty one."""
    column = F.col(text) if isinstance(text, str) else text
    return F.array(F.struct(F.lit("text").alias("type"), column.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def format_chats(messages: DataFrame, parts: str | Column | None = None) -> DataFrame:
    """One row per conv_id with the formatted string, loss spans, attachments and token counts.

    ``messages`` has conv_id, turn, role and either text or ``parts`` (an array of ``PART``). Turns
    are ordered by turn, ties by role and content, nulls first; repeated rows are repeated turns. A
    null role is the empty role, null text is empty, null parts are no parts, and rows with a null
    conv_id form one conversation. A conversation is one output row, so it must fit one task; it is
    gathered by a partial aggregation and formatted in a narrow pass over Arrow batches.
    """
    ship(messages.sparkSession)
    content = text_part("text") if parts is None else (F.col(parts) if isinstance(parts, str) else parts)
    turns = (
        messages.select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), content.cast(f"array<{PART}>").alias("parts")).alias("message"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("message")).alias("messages"))
        .select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["parts"].alias("parts"))).alias("messages"))
    )

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = []
                for row in batch.slice(k, 256).to_pylist():
                    done = format_conversation([(m["role"], m["parts"] or []) for m in row["messages"]])
                    rows.append({"conv_id": row["conv_id"], **done})
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    attachment = pa.struct(
        [("number", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("turn", pa.int32()), ("position", pa.int64()), ("tokens", pa.int64())]
    )
    shape = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("formatted", pa.string()),
            ("loss_spans", pa.list_(span)),
            ("attachments", pa.list_(attachment)),
            ("expanded_tokens", pa.int64()),
        ]
    )
    return turns.mapInArrow(formatted, FORMATTED)
