"""Chat formatting with typed content parts.

Method
------
A turn's content is a list of typed parts: text, image, audio or document.  A
visitor walks the parts in order; text is escaped, an attachment becomes an ordered
placeholder ``<|image:1|>`` (numbered over the conversation), its reference, place
and expanded token count are recorded.  Turns are marked by control strings.
Inside texts (and roles) ``&`` becomes ``&amp;`` and ``<`` becomes ``&lt;``, so no
text, nor several text parts in a row, can forge a turn or a placeholder, and the
escape is undone exactly.  A part of another type than these becomes a placeholder
``<|part:1|>`` that expands to no token unless it says so; its type is recorded.  The loss
mask is a list of spans of the formatted string: the assistants' texts.

Turns are formatted before the shuffle; the only grouping is by conversation, whose
formatted string is by nature one value.

Defined results: a null text or role is empty; turns are ordered by (turn, role,
text), nulls first, so ties and repeated rows have one result and all stay; rows with
a null conv_id are one conversation.  An empty table gives no rows.  Further
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.textops import pieces

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that an attachment expands to, if its part says neither their number nor its size.
EXPANSION = {"image": 576, "audio": 50, "document": 512}
#: Units of a part's size (pixels, milliseconds, characters) for one token.
UNITS = {"image": 784, "audio": 40, "document": 4}
FORMATTED_SCHEMA = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:int,end:int>>, attachments array<struct<placeholder:string,type:string,ref:string,turn:long,place:int,n_tokens:long>>, expanded_tokens long"
READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


class Attachment(NamedTuple):
    placeholder: str
    type: str
    ref: str | None
    turn: int | None
    place: int
    n_tokens: int


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def unescape(text: str) -> str:
    return text.replace("&lt;", "<").replace("&amp;", "&")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "&#10;")


def unescape_role(role: str) -> str:
    return unescape(role.replace("&#10;", "\n"))


class Visitor:
    """Flattens parts to text, one method a type; counts and records attachments over a conversation."""

    def __init__(self) -> None:
        self.attachments: list[Attachment] = []
        self.numbers: dict[str, int] = {}

    def visit(self, part: dict, turn: int | None, at: int) -> str:
        kind = part.get("type")
        return getattr(self, f"visit_{kind}" if kind in ("text", *EXPANSION) else "visit_unknown")(part, turn, at)

    def visit_text(self, part: dict, turn: int | None, at: int) -> str:
        return escape(part.get("text") or "")

    def attach(self, part: dict, turn: int | None, at: int) -> str:
        kind, n, size = part["type"], part.get("n_tokens"), part.get("size")
        if n is None:
            n = EXPANSION[kind] if size is None else -(-int(size) // UNITS[kind])
        return self.record(kind, kind, part, turn, at, int(n))

    def record(self, name: str, kind: str, part: dict, turn: int | None, at: int, n: int) -> str:
        self.numbers[name] = self.numbers.get(name, 0) + 1
        mark = f"<|{name}:{self.numbers[name]}|>"
        self.attachments.append(Attachment(mark, kind, part.get("ref"), turn, at, n))
        return mark

    visit_image = visit_audio = visit_document = attach

    def visit_unknown(self, part: dict, turn: int | None, at: int) -> str:
        return self.record("part", part.get("type") or "", part, turn, at, int(part.get("n_tokens") or 0))


def format_turns(turns: list[tuple[int | None, str, list[dict]]]) -> tuple[str, list[tuple[int, int]], list[Attachment]]:
    """(formatted, loss spans, attachments) of ordered (turn, role, parts)."""
    visitor, out, spans, at = Visitor(), [], [], 0
    for turn, role, parts in turns:
        head = f"{START}{escape_role(role)}\n"
        at += len(head)
        body = []
        for part in parts:
            got = visitor.visit(part, turn, at + sum(map(len, body)))
            body.append(got)
        text = "".join(body)
        if role == "assistant":
            spans.append((at, at + len(text)))
        out += [head, text, f"{END}\n"]
        at += len(text) + len(END) + 1
    return "".join(out), spans, visitor.attachments


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def text_parts(column: str = "text") -> F.Column:
    """A text column as the parts of a turn: one text part."""
    kind = "array<struct<type:string,text:string,ref:string,n_tokens:long>>"
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("n_tokens"))).cast(kind)


def format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("placeholder", pa.string()), ("type", pa.string()), ("ref", pa.string()), ("turn", pa.int64()), ("place", pa.int32()), ("n_tokens", pa.int64())])), pa.int64()]
    for batch in batches:
        for part in pieces(batch):
            rows = []
            for turns in part.column(1).to_pylist():
                text, spans, att = format_turns([(t["turn"], t["role"], [p for p in t["parts"] or () if p is not None]) for t in turns])
                rows.append((len(turns), text, [{"start": a, "end": b} for a, b in spans], [a._asdict() for a in att], sum(a.n_tokens for a in att)))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["conv_id", "n_turns", "formatted", "loss_spans", "attachments", "expanded_tokens"])


def format_chats(turns: DataFrame) -> DataFrame:
    """FORMATTED_SCHEMA, a row for each conversation of turns(conv_id, turn, role, parts or text)."""
    parts = F.col("parts") if "parts" in turns.columns else text_parts()
    rows = turns.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return whole.mapInArrow(format_batches, FORMATTED_SCHEMA)


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        for part in pieces(batch):
            rows = []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)), part.column(3), part.column(4)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"])


def read_chats(formatted: DataFrame) -> DataFrame:
    """READ_SCHEMA: what is read back from the formatted strings and their loss masks."""
    return formatted.select("conv_id", "formatted", "loss_spans", F.size("attachments").cast("long").alias("n"), "expanded_tokens").mapInArrow(read_batches, READ_SCHEMA)


def json_parts(column: str) -> F.Column:
    """Parts of a JSON list such as chat interfaces use; text that is no such list is one text part."""
    kind = "array<struct<type:string,text:string,ref:string,n_tokens:long,size:long>>"
    got = F.from_json(F.col(column), kind)
    plain = F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(column), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("size")))
    parts = F.ltrim(column).startswith("[") & got.isNotNull() & F.forall(got, lambda x: x["type"].isNotNull())
    return F.when(parts, got).otherwise(plain)
