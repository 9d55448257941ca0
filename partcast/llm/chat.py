"""Chat formatting with typed content parts.

A visitor walks the parts of a turn (text, image, audio, document) and writes
escaped text and numbered placeholders, recording each attachment's reference
and the tokens that its placeholder expands to.  The template marks every turn:

    ### role: content</turn>

with a line feed behind it.  In roles and texts a backslash goes before every
backslash, '#' and '<' (in roles before ':' too), so no text can look like a
mark, and `read_turn` gets the original back.  The loss mask covers what
assistants say.

A conversation is formatted turn by turn, in the order of (turn, role, text):
rows meet by conversation and stream through their task, sorted, so a
conversation of any length takes the memory of one turn.

Defined results: null texts and roles are empty; an empty turn is still marked;
a null conversation id is a conversation; repeated rows are repeated turns; no
rows give no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAIL = "</turn>\n"
LEARNED = "assistant"
#: Typed parts of a turn; `parts` of this type may replace the text column.
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
FORMATTED = ("conv_id long, place long, formatted string, loss array<struct<start:int,end:int>>, "
             "attachments array<struct<kind:string,number:int,ref:string,tokens:int>>, expanded_tokens long")


def escape(text: str, also: str = "") -> str:
    return re.sub(rf"[\\#<{also}]", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass
class Sizes:
    """Tokens that attachments expand to."""

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 256


@dataclass
class Visitor:
    """Flattens the parts of one turn; numbers count up through a conversation."""

    sizes: Sizes
    numbers: dict[str, int]
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = self.sizes.patch
        self._attach("image", part, math.ceil((part.get("width") or 0) / side) * math.ceil((part.get("height") or 0) / side))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.sizes.per_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.sizes.per_page)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        number = self.numbers[kind] = self.numbers.get(kind, -1) + 1
        self.out.append(f"<{kind}:{number}>")
        self.attachments.append({"kind": kind, "number": number, "ref": part.get("ref"), "tokens": max(1, tokens)})


def format_turn(role: str, parts: list[dict], numbers: dict[str, int], sizes: Sizes) -> tuple[str, list[dict], list[dict]]:
    """(formatted, loss spans in code points, attachments)"""
    v = Visitor(sizes, numbers)
    for part in parts:
        v.visit(part)
    head, content = f"### {escape(role, ':')}: ", "".join(v.out)
    loss = [{"start": len(head), "end": len(head) + len(content)}] if role == LEARNED else []
    return head + content + TAIL, loss, v.attachments


_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*)</turn>\n", re.S)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn, placeholders left in place."""
    found = _TURN.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


def _format(batches, sizes: Sizes, typed: bool):
    numbers, last, place = {}, (), 0
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    things = pa.list_(pa.struct([("kind", pa.string()), ("number", pa.int32()), ("ref", pa.string()), ("tokens", pa.int32())]))
    for batch in batches:
        rows = []
        content = batch.column("content").to_pylist()
        for conv, role, c in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), content):
            if last != (conv,):
                numbers, last, place = {}, (conv,), 0
            parts = (c or []) if typed else [{"type": "text", "text": c}]
            rows.append((conv, place, *format_turn(role or "", parts, numbers, sizes)))
            place += 1
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], spans),
            pa.array([r[4] for r in rows], things),
            pa.array([sum(a["tokens"] for a in r[4]) for r in rows], pa.int64())],
            names=["conv_id", "place", "formatted", "loss", "attachments", "expanded_tokens"])


def format_conversations(turns: DataFrame, content_col: str = "text", sizes: Sizes | None = None) -> DataFrame:
    """turns (conv_id, turn, role, content) -> a row per turn (see FORMATTED), each conversation in order in one partition."""
    typed = turns.schema[content_col].dataType.typeName() == "array"
    kept = sizes or Sizes()
    rows = (turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                         F.col(content_col) if typed else F.coalesce(content_col, F.lit("")), )
            .toDF("conv_id", "turn", "role", "content"))
    together = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "content")
    return together.mapInArrow(lambda it: _format(it, kept, typed), FORMATTED)


class _Digest:
    def __init__(self) -> None:
        self.turns = self.loss = self.chars = 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, spans: list[dict]) -> None:
        role, text = read_turn(formatted)
        self.turns += 1
        self.chars += len(formatted)
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for s in spans:
            said = unescape(formatted[s["start"]: s["end"]])
            self.loss += len(said)
            self.learned.update(said.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Output of format_conversations -> a row per conversation with what was read from it (see DIGEST)."""
    def rows(batches):
        now, conv = None, None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in DIGEST.split(", ")]
        table = lambda got: pa.RecordBatch.from_arrays(
            [pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)], names=names)
        for batch in batches:
            done = []
            for c, text, spans in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(),
                                      batch.column("loss").to_pylist()):
                if now is None or c != conv:
                    if now:
                        done.append((conv, *now.row()))
                    now, conv = _Digest(), c
                now.add(text, spans)
            yield table(done)
        yield table([(conv, *now.row())] if now else [])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(rows, DIGEST)
