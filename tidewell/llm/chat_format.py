"""Chat formatting from event logs: partition by conversation, sort by sequence, fold, render.

A log has one row per event, each of one message (``position`` and ``message`` order the messages of a conversation):

* ``open``: a message of ``role`` begins; ``text`` is its first part (may be null).
* ``delta``: ``text`` is appended.
* ``regenerate``: what the message holds is discarded; the deltas that follow make it anew.
* ``edit``: ``text`` replaces what the message holds.

The events of a message are folded in the order of ``seq``, where the log may hold them in any order and
mixed with those of other messages. Events are sorted by conversation, message and sequence, so a task streams
through its conversations with one message in memory, however long a conversation is.

Each final message is rendered as one turn; the turns of a conversation, joined, are its formatted text:

    <s>[INST]user's text[/INST]   [ANS]assistant's text</s>   <s>[ROLE]another role[/ROLE]text[END]

In texts and roles a control string gets a backslash after its first character, and one that
already has some gets one more. So no text holds a control string, and taking one backslash from each such place
gives the text back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.tables import slices

#: Control strings of the template (fixed values).
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[/ROLE]", "[END]")
#: Code points of a delta, and of a draft that is regenerated, in logs made from final messages.
DELTA_CHARS, DRAFT_CHARS = 512, 24

_BODY = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_BODY})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_BODY})")
_TURN = re.compile(r"<s>\[INST\](?P<user>.*?)\[/INST\]|\[ANS\](?P<assistant>.*?)</s>|<s>\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)\[END\]", re.S)

_LOG = "conv_id long, position long, message string, seq long, kind string, role string, text string"
_PIECE = "conv_id long, position long, message string, role string, piece string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(role: str, text: str) -> tuple[str, int | None, int | None]:
    """The turn, and where in it (code points) the loss applies: an assistant's text."""
    own = escape(text)
    if role == "user":
        return f"<s>[INST]{own}[/INST]", None, None
    if role == "assistant":
        return f"[ANS]{own}</s>", len("[ANS]"), len("[ANS]") + len(own)
    return f"<s>[ROLE]{escape(role)}[/ROLE]{own}[END]", None, None


def parse(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of the turns of a formatted text; raises ValueError for anything between or after them."""
    turns, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        kind = turn.lastgroup
        turns.append((unescape(turn["role"]), unescape(turn["text"])) if kind == "text" else (kind, unescape(turn[kind])))
        at = turn.end()
    return turns


def log_of(messages: DataFrame) -> DataFrame:
    """An event log whose fold gives ``messages`` (``conv_id, turn, role, text``) back, in any order of rows.

    Texts stream in deltas of ``DELTA_CHARS`` code points. Of the messages, by a hash of theirs, a third begins
    with a draft that is regenerated, and another third is opened with one that an edit replaces. Rows of one turn
    are told apart, and ordered, by a hash of role and text; a null role or text is empty.
    """
    text = F.coalesce("text", F.lit(""))
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))
    draft = F.reverse(F.substring(text, 1, DRAFT_CHARS))
    way = F.pmod(F.xxhash64("conv_id", "turn", "role"), F.lit(3))

    def event(kind: str, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), body.alias("text"))

    deltas = F.transform(parts, lambda p: event("delta", p))
    none = F.lit(None).cast("string")
    events = (
        F.when(way == 0, F.concat(F.array(event("open", draft), event("delta", draft), event("regenerate", none)), deltas))
        .when(way == 1, F.concat(F.array(event("open", draft), event("edit", F.coalesce(F.get(parts, F.lit(0)), F.lit("")))), F.slice(deltas, F.lit(2), F.greatest(F.size(deltas) - 1, F.lit(0)))))
        .otherwise(F.concat(F.array(event("open", none)), deltas))
    )
    message = F.concat_ws(":", F.lpad(F.hex(F.xxhash64("role", "text")), 16, "0"), F.monotonically_increasing_id())
    rows = messages.select("conv_id", F.col("turn").alias("position"), message.alias("message"), F.coalesce("role", F.lit("")).alias("role"), events.alias("events"))
    rows = rows.select("conv_id", "position", "message", "role", F.posexplode("events").alias("seq", "event"))
    return rows.select("conv_id", F.col("position").cast("long"), "message", F.col("seq").cast("long"), "event.kind", F.when(F.col("event.kind") == "open", F.col("role")).alias("role"), "event.text")


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    named = [x.split(" ") for x in fields.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[kind]) for x, (_, kind) in zip(zip(*rows), named)], [n for n, _ in named])


def format_log(log: DataFrame) -> DataFrame:
    """Turns in order: ``conv_id, position, message, role, piece, loss_start, loss_end``, sorted within the partition of a conversation.

    ``loss_start`` and ``loss_end`` are code points in ``piece`` and null for turns without loss. Messages
    are ordered by ``position`` (nulls first), then ``message``. Null texts add nothing, a null role is an empty one, events
    before a message opens or of unknown kinds raise ValueError. Rows with a null ``conv_id`` are one
    conversation. Other columns are ignored; an empty log gives no turns.
    """
    columns = [f.split(" ")[0] for f in _LOG.split(", ")]
    keys = ["conv_id", "position", "message", "seq"]
    ordered = log.select(*columns).repartition("conv_id").sortWithinPartitions(*(F.asc_nulls_first(k) for k in keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, role, held, out, size = None, None, [], [], 0

        def close() -> None:
            nonlocal size
            if of:
                out.append((*of, role, *render(role, "".join(held))))
                size += len(out[-1][4])

        for b in slices(batches, rows=4096):
            for conv, position, message, _, kind, named, text in zip(*(b.column(c).to_pylist() for c in columns)):
                if (conv, position, message) != of:
                    close()
                    of, role, held = (conv, position, message), None, []
                if kind == "open":
                    role = named or ""
                elif kind not in ("delta", "edit", "regenerate") or role is None:
                    raise ValueError(f"event {kind} of message {of}")
                if kind in ("edit", "regenerate"):
                    held = []
                if text:
                    held.append(text)
                if len(out) >= 4096 or size > 8 << 20:
                    yield _batch(out, _PIECE)
                    out, size = [], 0
        close()
        if out:
            yield _batch(out, _PIECE)

    return ordered.mapInArrow(run, _PIECE)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """Parse the turns that ``format_log`` returns, in their order; per conversation counts and digests of what they say.

    ``pieces`` must come from ``format_log`` without a shuffle between. Digests grow turn by turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state, out = None, None, []

        def close() -> None:
            if state:
                turns, turn_hash, chars, loss_hash, size = state
                out.append((of, turns, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), size))

        for b in slices(batches, "piece", rows=4096):
            for conv, piece, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end"))):
                if state is None or conv != of:
                    close()
                    of, state = conv, [0, sha256(), 0, sha256(), 0]
                for role, text in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    masked = unescape(piece[start:end])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(piece)
            if len(out) >= 1024:
                yield _batch(out, _READ)
                out = []
        close()
        if out:
            yield _batch(out, _READ)

    return pieces.select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(run, _READ)


#: A conversation that says control strings, added to the table by the query's contract.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with conversation -1: a user, then an assistant, both saying ``PROBE``."""
    kept = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = conversations.sparkSession.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE))
    return kept.unionAll(said)
