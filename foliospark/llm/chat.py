"""Chat formatting of typed content parts, with a reversible template.

A visitor flattens the parts of a message in order: text is escaped, and an
image, audio or document part becomes a numbered placeholder, with its
reference and expanded token count recorded as an attachment.  A turn is

    <|im_start|>role\\ncontent<|im_end|>\\n

Inside texts and roles ``<|`` gets a backslash in the middle, as does every
``<\\|`` that is there already, so control strings occur only where the
template puts them and unescaping restores any text exactly.

Turns are formatted where they are read.  Conversations are then dealt out by
id, sorted and streamed: a conversation's digests are updated turn by turn, so
a conversation of any length needs constant memory.

Defined cases: a null text or role counts as empty; equal turns are ordered by
role and text; repeated rows are repeated turns; a null id is a conversation of
its own; no rows give no conversations; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

START, END, GENERATION = "<|im_start|>", "<|im_end|>", "assistant"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_B, _N = "\\", "\n"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "<\\" in text else text


class PartVisitor:
    """Flattens typed parts; ``attachments`` holds (kind, number, ref, tokens)."""

    tokens_per = {"image": 256, "audio": 50, "document": 512}

    def __init__(self):
        self.pieces: list[str] = []
        self.attachments: list[tuple[str, int, str, int]] = []

    def visit(self, part: dict | str | None) -> None:
        part = {"type": "text", "text": part} if part is None or isinstance(part, str) else part
        getattr(self, f"visit_{part.get('type', 'text')}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict) -> None:
        units = max(1, int(part.get("units") or 1))
        number = sum(a[0] == kind for a in self.attachments)
        self.attachments.append((kind, number, part.get("ref") or "", units * self.tokens_per[kind]))
        self.pieces.append(f"<|{kind}_{number}|>")

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)

    def visit_other(self, part: dict) -> None:
        raise ValueError(f"unknown content part {part.get('type')!r}")


def flatten(parts: list) -> tuple[str, list[tuple[str, int, str, int]]]:
    """Content string and attachments of one message's parts."""
    visitor = PartVisitor()
    for p in parts:
        visitor.visit(p)
    return "".join(visitor.pieces), visitor.attachments


def restore(content: str, attachments: list[tuple[str, int, str, int]]) -> list:
    """The parts that ``flatten`` was given, adjacent texts joined."""
    refs = {f"<|{k}_{n}|>": {"type": k, "ref": r, "units": t // PartVisitor.tokens_per[k]} for k, n, r, t in attachments}
    pieces = re.split(r"(<\|(?:image|audio|document)_\d+\|>)", content)
    return [refs[p] if p in refs else {"type": "text", "text": unescape(p)} for p in pieces if p]


def format_turn(role: str, content: str) -> str:
    """One turn; a line break or backslash in the role is written as an escape."""
    return f"{START}{escape(role.replace(_B, _B * 2).replace(_N, _B + 'n'))}\n{content}{END}\n"


def read_role(written: str) -> str:
    return re.sub(r"\\(.)", lambda m: _N if m[1] == "n" else m[1], unescape(written))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, content) of each turn; contents are still escaped."""
    return _TURN.findall(formatted)


PART = "type string, text string, ref string, units int"
ATTACHMENT = "struct<kind:string,number:int,ref:string,tokens:bigint>"
TURNS = f"conv_id long, turn long, role string, text string, formatted string, tokens long, refs array<string>, attachments array<{ATTACHMENT}>, loss_start int, loss_end int"
_ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("number", pa.int32()), ("ref", pa.string()), ("tokens", pa.int64())]))


def format_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, loss_role: str = GENERATION) -> DataFrame:
    """Each row's formatted turn, its attachments with their expanded tokens, and the span under the loss mask.

    The span counts code points of the formatted turn and is that of the content
    of a ``loss_role`` turn, null for others.  ``parts`` names an ``array<struct<type,text,ref,units>>`` column to use in
    place of the text column.
    """
    content = F.col(parts) if parts else F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))

    def run(batches):
        for b in batches:
            formatted, tokens, refs, attachments, loss = [], [], [], [], []
            for r, p in zip(b.column(2).to_pylist(), b.column(4).to_pylist()):
                flat, attached = flatten(p or [])
                formatted.append(format_turn(r or "", flat))
                tokens.append(sum(a[3] for a in attached))
                refs.append([a[2] for a in attached])
                attachments.append([dict(zip(("kind", "number", "ref", "tokens"), a)) for a in attached])
                end = len(formatted[-1]) - len(END) - 1
                loss.append((end - len(flat), end) if r == loss_role else (None, None))
            spans = [pa.array(x, pa.int32()) for x in zip(*loss)] if loss else [pa.array([], pa.int32())] * 2
            columns = [pa.array(formatted, pa.string()), pa.array(tokens, pa.int64()), pa.array(refs, pa.list_(pa.string())), pa.array(attachments, _ATTACHMENTS), *spans]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), *columns], ["conv_id", "turn", "role", "text", "formatted", "tokens", "refs", "attachments", "loss_start", "loss_end"])

    return arrow_map(rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.col(text).alias("text"), content.alias("parts")), run, TURNS)


def restore_parts(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, parts)``: the parts of every formatted turn, read back from it and its attachments."""

    def run(batches):
        for b in batches:
            roles, parts = [], []
            for formatted, attached in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                ((role, content),) = parse(formatted)
                roles.append(read_role(role))
                parts.append([{k: p.get(k) for k in ("type", "text", "ref", "units")} for p in restore(content, [(a["kind"], a["number"], a["ref"], a["tokens"]) for a in attached])])
            kind = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("units", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(roles, pa.string()), pa.array(parts, kind)], ["conv_id", "turn", "role", "parts"])

    return arrow_map(turns.select("conv_id", "turn", "formatted", "attachments"), run, "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:int>>")


class _Digest:
    """Running digests of one conversation, read back from formatted turns."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss_start: int | None, loss_end: int | None) -> None:
        self.chars += len(formatted)
        for role, content in parse(formatted):
            self.turns += 1
            self.all.update(f"{read_role(role)}\n{unescape(content)}\n".encode())
        if loss_start is not None:
            masked = unescape(formatted[loss_start:loss_end])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation, read back from the formatted turns and their loss spans."""

    def run(batches):
        now = None
        for b in batches:
            rows = []
            for conv_id, *turn in zip(*(b.column(i).to_pylist() for i in range(4))):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        rows.append(now.row())
                    now = _Digest(conv_id)
                now.add(*turn)
            yield _table(rows)
        if now is not None:
            yield _table([now.row()])

    def _table(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], DIGESTS)

    # Formatting is injective on (role, text), so it orders equal turns.
    ordered = turns.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return arrow_map(ordered.select("conv_id", "formatted", "loss_start", "loss_end"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
