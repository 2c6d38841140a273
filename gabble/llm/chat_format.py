r"""Chat formatting from event logs.

A log row is an event of one message: ``open`` sets its role, ``delta`` appends to its text, ``edit`` replaces the
text, ``regenerate`` clears it for another try. Logs are dealt out in ranges of (conversation, message) and sorted by
sequence, so that a conversation of any size spreads over tasks; each task folds a stream of events into final
messages and renders them one by one.

Template: an assistant's turn is ``<s>text</s>``, any other ``[INST]role[ROLE]text[/INST]``. In roles and texts a backslash
is doubled and a control string gets one behind its first character, so texts cannot forge a turn and read back
unchanged. The loss mask holds the spans of the assistant's texts.

Formatted conversations come in pieces of about ``PIECE`` characters, cut between turns; most have one. ``digests`` reads
the pieces back, in order, keeping no conversation in memory.

Edge cases: a null role or text is empty; a message without ``open`` has an empty role; messages are ordered nulls
first, and of turns under one number by role, then by text digest, and equal rows are turns of their own; a null
conversation id is a conversation like any other; an unknown kind of event stops the job; an empty log gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gabble.llm.common import text_of

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]")
ASSISTANT = "assistant"
#: Characters of a piece from which on it ends with the turn.
PIECE = 1 << 20
#: Characters of a streamed delta in :func:`logged`.
DELTA = 400

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>(.*?)</s>|\[INST\](.*?)\[ROLE\](.*?)\[/INST\]", re.S)

_PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("text", pa.string()),
                     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_PIECES_SQL = "conv_id long, piece long, whole boolean, text string, spans array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A turn, and the span of its text if it counts for the loss."""
    body = escape(text)
    if role == ASSISTANT:
        return f"<s>{body}</s>", (3, 3 + len(body))
    return f"[INST]{escape(role)}[ROLE]{body}[/INST]", None


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, read back."""
    at = 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        said, role, text = found.groups()
        yield (ASSISTANT, unescape(said)) if said is not None else (unescape(role), unescape(text))
        at = found.end()


def logged(rows: DataFrame) -> DataFrame:
    """The event log behind finished turns (``conv_id, turn, role, text``): what streaming them would have sent.

    Each text comes in deltas. One in eight assistant turns is tried twice, one in eight others is edited after
    it was sent, both by hash. A message is known by ``turn, said_by, digest, row``, which also orders it.
    """
    role, text = text_of("role"), text_of("text")
    base = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("said_by"),
                       F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("row"), text.alias("_text"))
    again = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    nothing = F.array().cast("array<struct<kind:string,role:string,text:string>>")

    def event(kind, text, role=None):
        return F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("role") if role is None else role.alias("role"),
                        text.cast("string").alias("text"))

    deltas = F.transform(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)), lambda t: event("delta", t))
    by_assistant = F.col("said_by") == ASSISTANT
    retry = F.array(event("delta", F.reverse(F.substring("_text", 1, 40))), event("regenerate", F.lit(None)))
    edited = F.array(event("delta", F.concat(F.substring("_text", 1, 40), F.lit(" ?"))), event("edit", F.col("_text")))
    sent = F.when(again & by_assistant, F.concat(retry, deltas)).when(again, edited).otherwise(deltas)
    events = F.concat(F.array(event("open", F.lit(None), F.col("said_by"))), F.coalesce(sent, nothing))
    return base.select("conv_id", "turn", "said_by", "digest", "row", F.posexplode(events).alias("seq", "e")).select(
        "conv_id", "turn", "said_by", "digest", "row", "seq", "e.kind", "e.role", "e.text")


MESSAGE = ("turn", "said_by", "digest", "row")


class _Fold:
    """One message while its events come in."""

    def __init__(self):
        self.role, self.text = "", []

    def take(self, kind: str, role: str | None, text: str | None) -> None:
        if kind == "open":
            self.role = role or ""
        elif kind == "delta":
            self.text.append(text or "")
        elif kind == "edit":
            self.text = [text or ""]
        elif kind == "regenerate":
            self.text = []
        else:
            raise ValueError(f"unknown kind of event: {kind!r}")


class _Piece:
    """The turns of one conversation that are rendered but not yet out."""

    def __init__(self):
        self.parts, self.spans, self.size = [], [], 0

    def add(self, message: _Fold) -> None:
        turn, span = render(message.role, "".join(message.text))
        if span:
            self.spans.append({"start": self.size + span[0], "end": self.size + span[1]})
        self.parts.append(turn)
        self.size += len(turn)


def formatted(log: DataFrame, message: tuple[str, ...] = MESSAGE, seq: str = "seq", piece: int = PIECE) -> DataFrame:
    """``conv_id, piece, whole, text, spans``: the formatted conversations of a log with ``conv_id, kind, role, text``.

    ``message`` are the columns that tell a conversation's messages apart, in their order. Pieces of a conversation
    follow each other by ``piece``; ``whole`` marks a piece that is known to be its conversation's only one.
    """
    order = [F.col("conv_id"), *map(F.col, message)]
    width = len(message)

    def run(batches):
        last, fold, held = None, None, _Piece()
        number, first, cut = TaskContext.get().partitionId() << 33, True, False

        def out(conv, whole):
            nonlocal held, number
            made = pa.RecordBatch.from_pylist([{"conv_id": conv, "piece": number, "whole": whole, "text": "".join(held.parts),
                                                "spans": held.spans}], _PIECES)
            held, number = _Piece(), number + 1
            return made

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, kind, role, text in zip(zip(*columns[:width + 1]), *columns[width + 1:]):
                if key != last:
                    if last is not None:
                        held.add(fold)
                        if key[0] != last[0]:
                            yield out(last[0], not first and not cut)
                            first = cut = False
                        elif held.size >= piece:
                            yield out(last[0], False)
                            cut = True
                    last, fold = key, _Fold()
                fold.take(kind, role, text)
        if last is not None:
            held.add(fold)
            yield out(last[0], False)

    dealt = log.repartitionByRange(*order).sortWithinPartitions(*order, seq)
    return dealt.select("conv_id", *message, "kind", "role", "text").mapInArrow(run, _PIECES_SQL)


class _Digest:
    """What is read back from the pieces of one conversation."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def take(self, text: str, spans: list[dict]) -> None:
        for role, said in turns(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        for span in spans:
            counted = unescape(text[span["start"]:span["end"]])
            self.loss.update(counted.encode())
            self.loss_chars += len(counted)
        self.chars += len(text)

    def row(self, conv: int | None) -> dict:
        return {"conv_id": conv, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
                "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


_RESULT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_RESULT_SQL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(pieces: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` per conversation.

    Conversations that stand in one piece are read where they are; only the pieces of others travel.
    """
    read = pa.schema([*_RESULT, *(_PIECES.field(n) for n in ("piece", "text", "spans"))])

    def here(batches):
        for batch in batches:
            rows = []
            for p in batch.to_pylist():
                if p["whole"]:
                    (own := _Digest()).take(p["text"], p["spans"])
                    rows.append(own.row(p["conv_id"]))
                else:
                    rows.append({k: p[k] for k in ("conv_id", "piece", "text", "spans")})
            yield pa.RecordBatch.from_pylist(rows, read)

    def join(batches):
        conv, own = None, None
        for batch in batches:
            rows = []
            for p in batch.to_pylist():
                if own and p["conv_id"] != conv:
                    rows.append(own.row(conv))
                    own = None
                if p["n_turns"] is not None:
                    rows.append({k: p[k] for k in _RESULT.names})
                    continue
                conv, own = p["conv_id"], own or _Digest()
                own.take(p["text"], p["spans"])
            yield pa.RecordBatch.from_pylist(rows, _RESULT)
        if own:
            yield pa.RecordBatch.from_pylist([own.row(conv)], _RESULT)

    mixed = pieces.mapInArrow(here, f"{_RESULT_SQL}, piece long, text string, spans array<struct<start:long,end:long>>")
    return mixed.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(join, _RESULT_SQL)
