r"""Conversations formatted by a compiled template, with the marks of what is learned.

A conversation's rows meet in one partition, in order of turn (then role and text), and
are rendered as they stream by: the template's loop holds one turn at a time, and the
output leaves in parts of about ``PART_CHARS``. So a conversation of any number of turns
needs no more memory than its longest text, and shares its task with others; its order
and its digests make one sequence of it, which only one task can follow.

Each part has its place in the conversation's text (``start``), and ``loss``: the spans
under the template's generation marks, in code points of the whole text.

Defined cases: a null text or role counts as empty; equal turns go by role, then text;
null turns come first; repeated rows are turns each; null ids are one conversation; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .chat_template import Escape, Piece, TemplateError, compiled

#: Strings that part turns, and what else a tokenizer may read as a command.
CONTROL = ("<turn>", "<text>", "</turn>", "<|endoftext|>")
TEMPLATE = """
{%- for message in messages -%}
<turn>{{ message.role | escape }}<text>
  {%- if message.role == 'assistant' -%}
    {%- generation -%}{{ message.text | escape }}{%- endgeneration -%}
  {%- else -%}
    {{ message.text | escape }}
  {%- endif -%}
</turn>{{ '\\n' }}
{%- endfor -%}
"""
PART_CHARS = 1 << 20
BATCH_CHARS = 4 << 20


@lru_cache(8)
def _render(template: str, control: tuple[str, ...]):
    return compiled(template, control)


class _Once:
    """The turns of a conversation as they come; they can be read once."""

    def __init__(self, turns: Iterator[dict]):
        self.turns: Iterator[dict] | None = turns

    def __iter__(self) -> Iterator[dict]:
        if self.turns is None:
            raise TemplateError("a template reads the messages once")
        turns, self.turns = self.turns, None
        return turns


def parts(pieces: Iterable[Piece], size: int = PART_CHARS) -> Iterator[tuple[int, str, list[tuple[int, int]]]]:
    """``start, text, spans`` of the parts, cut between pieces; one at least."""
    start = at = 0
    held: list[str] = []
    spans: list[tuple[int, int]] = []
    for text, learned in pieces:
        if not text:
            continue
        if at - start >= size:
            yield start, "".join(held), spans
            start, held, spans = at, [], []
        held.append(text)
        if learned:
            spans.append((at, at + len(text)))
        at += len(text)
    yield start, "".join(held), spans


def turns(texts: Iterable[str], escape: Escape) -> Iterator[tuple[str, str]]:
    """``role, text`` of each turn, read back from the output of ``TEMPLATE``."""
    begin, middle, end = CONTROL[:3]
    rest = ""
    for text in texts:
        *whole, rest = (rest + text).split(f"{end}\n")
        for turn in whole:
            role, mark, said = turn.partition(middle)
            if not turn.startswith(begin) or not mark:
                raise ValueError("a turn lacks its marks")
            yield escape.unescape(role[len(begin) :]), escape.unescape(said)
    if rest:
        raise ValueError("the last turn is not closed")


def format_chats(conversations: DataFrame, template: str = TEMPLATE, control: tuple[str, ...] = CONTROL, part_chars: int = PART_CHARS) -> DataFrame:
    """``conv_id, part, start, formatted, loss`` of each part of each conversation; those
    of one conversation are neighbours, in order, in one partition."""
    _render(template, control)  # a wrong template raises here

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
        out: list[tuple] = []
        held = 0
        for conv_id, group in groupby(rows, key=lambda r: r[0]):
            messages = _Once({"role": r[1] or "", "text": r[2] or ""} for r in group)
            for n, (start, text, spans) in enumerate(parts(_render(template, control)({"messages": messages}), part_chars)):
                out.append((conv_id, n, start, text, [{"start": a, "end": b} for a, b in spans]))
                held += len(text)
                if held > BATCH_CHARS:
                    yield _batch(out, schema)
                    out, held = [], 0
        yield _batch(out, schema)

    given = conversations.select("conv_id", F.col("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    kinds = {"part": "long", "start": "long", "formatted": "string", "loss": "array<struct<start:long,end:long>>"}
    schema = StructType([StructField("conv_id", given.schema["conv_id"].dataType), *[StructField(c, _parse_datatype_string(t)) for c, t in kinds.items()]])
    ordered = given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(formatted, schema)


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = zip(*rows) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


class _Digest:
    """Digests of one conversation, read back from its parts."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def of(self, rows: Iterator[tuple], escape: Escape) -> _Digest:
        def texts() -> Iterator[str]:
            for _, _, start, text, spans in rows:
                self.chars += len(text)
                for span in spans:
                    said = escape.unescape(text[span["start"] - start : span["end"] - start])
                    self.loss_chars += len(said)
                    self.loss.update(said.encode("utf-8", "surrogatepass"))
                yield text

        for role, said in turns(texts(), escape):
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        return self


def chat_digest(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all
    read back from what ``format_chats`` gives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape = Escape(CONTROL)
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "start", "formatted", "loss"))))
        out: list[tuple] = []
        for conv_id, group in groupby(rows, key=lambda r: r[0]):
            d = _Digest().of(group, escape)
            out.append((conv_id, d.n_turns, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars))
            if len(out) == 10_000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    formatted = format_chats(conversations)
    kinds = {"n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long"}
    schema = StructType([formatted.schema["conv_id"], *[StructField(c, _parse_datatype_string(t)) for c, t in kinds.items()]])
    return formatted.mapInArrow(read, schema)  # narrow: the parts stay in order
