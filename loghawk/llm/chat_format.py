"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor turns
each into a piece of the formatted turn: text is escaped, an attachment becomes a
placeholder that names its reference and the tokens it will expand to; references are
recorded in order. A formatted turn is

    <turn>ROLE
    BODY</turn>

In roles and texts a backslash goes before every backslash and ``<`` (and, in roles and
references, before a line break or quote), so the template's marks never occur inside
them, and dropping it again gives back the input. The loss mask of a turn covers the
body if the role is one of ``loss_roles``.

Formatting is a projection; no turn is moved. ``read_back`` reads turns in order of
conversation and turn as a stream, keeping running digests of the current conversation
only, so that a conversation of any length needs no more memory than a batch.

Edge cases: null texts, roles and references are empty; a null list of parts is empty;
an unknown part type is an error; null turns come last; equal turns are ordered by
role, then text; a null conversation id is a conversation of its own; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = ("struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")
LOSS_ROLES = ("assistant",)
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 576  # pixels a side of an image token, tokens a second, tokens a page
TURNS = "conv_id long, turn long, role string, formatted string, loss_start int, loss_end int"


def _escaped(value: Column, also: str = "") -> Column:
    out = F.replace(F.coalesce(value, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in "<" + also:
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return out


class PartVisitor:
    """One method a part type; each gives the piece, the reference and the expanded tokens."""

    def visit(self, part: Column) -> Column:
        out = F.when(F.lit(False), F.struct(F.lit("").alias("piece"), F.lit("").alias("ref"),
                                            F.lit("").alias("type"), F.lit(0).cast("long").alias("tokens")))
        for kind in ("text", "image", "audio", "document"):
            piece, ref, tokens = getattr(self, f"visit_{kind}")(part)
            out = out.when(part["type"] == kind, F.struct(
                piece.alias("piece"), ref.alias("ref"), F.lit(kind).alias("type"), tokens.cast("long").alias("tokens")))
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown part type: "), F.coalesce(part["type"], F.lit("null")))))

    def visit_text(self, part):
        return _escaped(part["text"]), F.lit(""), F.lit(0)

    def visit_image(self, part):
        side = lambda pixels: F.ceil(F.coalesce(pixels, F.lit(0)) / PATCH)
        return self._placeholder("image", part, side(part["width"]) * side(part["height"]))

    def visit_audio(self, part):
        return self._placeholder("audio", part, F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))

    def visit_document(self, part):
        return self._placeholder("document", part, F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS)

    def _placeholder(self, kind: str, part, tokens: Column):
        ref = F.coalesce(part["ref"], F.lit(""))
        return (F.concat(F.lit(f'<{kind} ref="'), _escaped(ref, '"\n'), F.lit('" tokens="'),
                         tokens.cast("long").cast("string"), F.lit('"/>')), ref, tokens)


def text_part(text: Column) -> Column:
    """A list with one text part."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none("string").alias("ref"),
                            none("int").alias("width"), none("int").alias("height"),
                            none("double").alias("seconds"), none("int").alias("pages")))


def format_turns(rows: DataFrame, parts: Column, loss_roles=LOSS_ROLES, visitor: PartVisitor | None = None) -> DataFrame:
    """One row per turn: formatted text, loss span within it (-1 if none), attachments and their tokens."""
    seen = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), (visitor or PartVisitor()).visit)
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit("<turn>"), _escaped(role, "\n"), F.lit("\n"))
    staged = rows.select("conv_id", "turn", role.alias("role"), head.alias("head"), seen.alias("seen")).select(
        "*", F.array_join(F.transform("seen", lambda p: p["piece"]), "").alias("body"))
    masked = F.col("role").isin(*loss_roles)
    start = F.length("head")
    return staged.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
        F.concat("head", "body", F.lit("</turn>\n")).alias("formatted"),
        F.when(masked, start).otherwise(-1).alias("loss_start"),
        F.when(masked, start + F.length("body")).otherwise(-1).alias("loss_end"),
        F.transform(F.filter("seen", lambda p: p["type"] != "text"),
                    lambda p: F.struct(p["type"], p["ref"], p["tokens"])).alias("attachments"),
        F.aggregate("seen", F.lit(0).cast("long"), lambda acc, p: acc + p["tokens"]).alias("attachment_tokens"))


_MARK = r'<(?:image|audio|document) ref="[^\\"]*(?:\\.[^\\"]*)*" tokens="\d+"/>'
_TURN = re.compile(rf"<turn>([^\\<\n]*(?:\\.[^\\<\n]*)*)\n([^\\<]*(?:(?:\\.|{_MARK})[^\\<]*)*)</turn>\n", re.S)
_PLACEHOLDER = re.compile(r'([^\\<]*(?:\\.[^\\<]*)*)(?:<(\w+) ref="([^\\"]*(?:\\.[^\\"]*)*)" tokens="(\d+)"/>)?', re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def parse_body(body: str) -> list[tuple]:
    """The parts of a body: ("text", text) and (type, ref, tokens)."""
    out = []
    for m in _PLACEHOLDER.finditer(body):
        if m.group(1):
            out.append(("text", unescape(m.group(1))))
        if m.group(2):
            out.append((m.group(2), unescape(m.group(3)), int(m.group(4))))
    return out


def parse_turn(formatted: str) -> tuple[str, list[tuple]]:
    """Role and parts of one formatted turn."""
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m.group(1)), parse_body(m.group(2))


def _texts(parts: list[tuple]) -> str:
    return "".join(p[1] for p in parts if p[0] == "text")


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss = conv_id, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int) -> None:
        role, parts = parse_turn(formatted)
        self.turns += 1
        self.chars += len(formatted)
        self.all.update(f"{role}\n{_texts(parts)}\n".encode())
        if start >= 0:
            text = _texts(parse_body(formatted[start:end]))
            self.loss += len(text)
            self.masked.update(text.encode())

    def row(self):
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars)


_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def read_back(turns: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted turns alone: digests of its turns and of its masked text."""
    def run(batches):
        now, out = None, []
        for batch in batches:
            for conv, formatted, start, end in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Digest(conv)
                now.add(formatted, start, end)
            yield _batch(out)
            out = []
        if now is not None:
            yield _batch([now.row()])

    ordered = (turns.repartition("conv_id")
               .sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "formatted")
               .select("conv_id", "formatted", "loss_start", "loss_end"))
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                   "loss_sha256 string, formatted_chars long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                      names=_NAMES)
