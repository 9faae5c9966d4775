"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them in order:
text is escaped, an attachment becomes a placeholder `<image 0>`, whose number refers to the turn's
attachment records, each with the number of tokens that the placeholder expands to. A turn is written
as::

    <turn role="ROLE">
    CONTENT</turn>

with a line feed after it. Backslash, `<` and `"` inside roles and texts get a backslash before them,
so no text can hold a control string, and unescaping is exact.

Rows are dealt by conversation and sorted inside their partitions; formatting and reading back stream
over them, a turn at a time, so memory does not grow with a conversation. Its turns do pass through
one task, as a digest over their concatenation must.

Defined results: null role or text = empty; turns go by (turn, role, text), null turns first, so ties
have one order and repeated rows stay; a null id is a conversation of its own; a conversation may be empty of
text; a text may be as long as a row can hold; no rows, no rows. Content parts are read from a column only
where the caller names one; null parts mean the text column, no parts an empty turn; a part without a kind
is text, one without a size has size 0, an unknown kind is an error. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column, whole_text

ASSISTANT = "assistant"
_ESCAPED = re.compile(r'[\\<"]')
_UNESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r'<turn role="((?:[^\\<"]++|\\.)*+)">\n((?:[^\\<]++|\\.|<(?:image|audio|document) \d++>)*+)</turn>\n', re.DOTALL)
#: What attachments expand to: a token per square of PATCH pixels a side, AUDIO_RATE a second, PAGE_TOKENS a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class TextPart:
    text: str

    def accept(self, visitor: Visitor) -> None:
        visitor.text(self)


@dataclass(frozen=True)
class ImagePart:
    ref: str
    width: int
    height: int

    def accept(self, visitor: Visitor) -> None:
        visitor.image(self)


@dataclass(frozen=True)
class AudioPart:
    ref: str
    seconds: float

    def accept(self, visitor: Visitor) -> None:
        visitor.audio(self)


@dataclass(frozen=True)
class DocumentPart:
    ref: str
    pages: int

    def accept(self, visitor: Visitor) -> None:
        visitor.document(self)


class Visitor:
    """Flattens parts to escaped text with placeholders, and records the attachments."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def text(self, part: TextPart) -> None:
        self.out.append(escape(part.text))

    def image(self, part: ImagePart) -> None:
        self._attach("image", part.ref, math.ceil(part.width / PATCH) * math.ceil(part.height / PATCH))

    def audio(self, part: AudioPart) -> None:
        self._attach("audio", part.ref, math.ceil(part.seconds * AUDIO_RATE))

    def document(self, part: DocumentPart) -> None:
        self._attach("document", part.ref, part.pages * PAGE_TOKENS)

    def _attach(self, kind: str, ref: str, tokens: int) -> None:
        self.out.append(f"<{kind} {len(self.attachments)}>")
        self.attachments.append({"kind": kind, "ref": ref, "tokens": tokens})


#: The column of parts: size is (width, height) of an image, (seconds,) of audio, (pages,) of a document.
PARTS = "array<struct<kind:string,text:string,ref:string,size:array<double>>>"


def typed(parts: list[dict] | None, text: str | None) -> list:
    """The content parts of a turn; a turn without any is one text."""
    if parts is None:
        return [TextPart(text or "")]
    out = []
    for p in parts:
        size = [x or 0 for x in [*(p["size"] or []), 0, 0]]
        match p["kind"]:
            case "image":
                out.append(ImagePart(p["ref"] or "", int(size[0]), int(size[1])))
            case "audio":
                out.append(AudioPart(p["ref"] or "", size[0]))
            case "document":
                out.append(DocumentPart(p["ref"] or "", int(size[0])))
            case "text" | None:
                out.append(TextPart(p["text"] or ""))
            case other:
                raise ValueError(f"unknown part kind {other!r}")
    return out


def format_turn(role: str, parts: list) -> tuple[str, int, int, list[dict]]:
    """The turn's segment, where its content starts and ends in it, and its attachments."""
    visitor = Visitor()
    for part in parts:
        part.accept(visitor)
    head, content = f'<turn role="{escape(role)}">\n', "".join(visitor.out)
    return f"{head}{content}</turn>\n", len(head), len(head) + len(content), visitor.attachments


def read_turn(segment: str) -> tuple[str, str]:
    """Role and unescaped text of a segment, placeholders left out."""
    found = _TURN.fullmatch(segment)
    if found is None:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(strip_placeholders(found[2]))


def strip_placeholders(content: str) -> str:
    """Escaped content without its placeholders; an escaped `<` begins none, whatever precedes it."""
    if "<" not in content:
        return content
    return "".join(x for x in re.findall(r"(?:[^\\<]++|\\.)++|<(?:image|audio|document) \d++>", content, re.DOTALL) if not x.startswith("<"))


SEGMENTS = "{id} {kind}, role string, segment string, start long, loss_start long, loss_end long, attachments array<struct<kind:string,ref:string,tokens:long>>"


def format_conversations(turns: DataFrame, id_col: str = "conv_id", parts_col: str | None = None) -> DataFrame:
    """One row per turn, conversations together and in order: <id_col>, role, segment, start, loss_start
    and loss_end (code points in the conversation's output; null where no loss is taken), attachments.
    A conversation's output is its segments, joined. parts_col names a column of type PARTS."""
    parts = F.lit(None) if parts_col is None else column(parts_col)
    source = turns.select(column(id_col).alias("id"), F.col("turn").alias("turn"), whole_text("role").alias("role"), whole_text("text").alias("text"), parts.cast(PARTS).alias("parts"))
    # repeated rows must keep one order: ties are broken by all that the output depends on
    dealt = source.repartition("id").sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "role", "text", F.to_json("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, fresh = None, 0, True
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                rows = []
                for conv, role, text, items in zip(*(part.column(c).to_pylist() for c in ("id", "role", "text", "parts")), strict=True):
                    if fresh or conv != now:
                        now, at, fresh = conv, 0, False
                    segment, begin, end, attachments = format_turn(role, typed(items, text))
                    loss = role == ASSISTANT
                    rows.append((conv, role, segment, at, at + begin if loss else None, at + end if loss else None, attachments))
                    at += len(segment)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    id_type = turns.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    record = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
    arrow = pa.schema([(id_col, to_arrow_type(id_type)), ("role", pa.string()), ("segment", pa.string()), ("start", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attachments", record)])
    return dealt.mapInArrow(run, SEGMENTS.format(id=f"`{id_col}`", kind=id_type.simpleString()))


def conversation_digests(segments: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Reads formatted conversations back. segments must come as format_conversations gives them, each
    conversation's whole and in order in one partition: where a segment does not start at the end of the one before,
    this stops with an error, so rows that were dealt anew in between are never taken for conversations.
    Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments,
    attachment_tokens."""
    id_type = segments.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]
    kinds = [to_arrow_type(id_type), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    class State:
        def __init__(self, conv) -> None:
            self.conv, self.turns, self.loss, self.n, self.loss_chars, self.chars, self.files, self.tokens = conv, sha256(), sha256(), 0, 0, 0, 0, 0

        def row(self) -> tuple:
            return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.files, self.tokens

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []
        for batch in batches:
            for conv, segment, start, begin, end, files in zip(*(batch.column(c).to_pylist() for c in (id_col, "segment", "start", "loss_start", "loss_end", "attachments")), strict=True):
                if state is None or conv != state.conv:
                    if state is not None:
                        done.append(state.row())
                    state = State(conv)
                    if len(done) >= 512:
                        yield batch_of(done)
                        done = []
                if start != state.chars:
                    raise ValueError(f"conversation {conv!r}: a segment starts at {start}, while {state.chars} characters came before; its rows were dealt anew")
                role, text = read_turn(segment)
                state.n += 1
                state.turns.update(f"{role}\n{text}\n".encode())
                if begin is not None:
                    learned = unescape(strip_placeholders(segment[begin - start : end - start]))
                    state.loss_chars += len(learned)
                    state.loss.update(learned.encode())
                state.chars += len(segment)
                state.files += len(files)
                state.tokens += sum(f["tokens"] for f in files)
        if state is not None:
            done.append(state.row())
        if done:
            yield batch_of(done)

    columns = zip(names[1:], ["long", "string", "long", "string", "long", "long", "long"], strict=True)
    return segments.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, " + ", ".join(f"{a} {b}" for a, b in columns))
