"""Conversation structure repair: generalised LR parsing over a grammar of roles, with weighted edits.

Role initials of a whole conversation are ``(s?(ua)+)?``: ``S -> . | C | s C`` and ``C -> u a | C u a``. A parser
reads the rows of a conversation with all edits at once: each row may be kept (where its role
fits), given the role that fits, or deleted, and a message may be inserted anywhere. Its stacks form a graph:
they share what lies below, and of tops in the same LR state only the one of least (cost, audit)
stays, as what can follow depends on the top alone. The audit has one letter per edit.

No conversation is brought into one task to be parsed. Rows without their texts are range partitioned by
conversation and turn, so a long conversation lies in several partitions and each part of it is
a segment. A segment is parsed from every stack it may begin on; what that costs, and its audits, are a
4 x 4 table. Tables of the segments of a conversation are then chained in order. Repeated messages are
found by an aggregation over (conversation, role, digest of the text).

Texts are shuffled once, when the edits are applied: the audit of a conversation comes first, its rows follow in
order, and a task streams through them. It holds one batch and one audit, however long the conversation is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.tables import slices
from tidewell.session import materialize

#: Cost of each edit, and of a truncated row that is not deleted.
COST, TRUNCATED = {"K": 0, "R": 2, "D": 3, "I": 2}, 1
#: LR actions of the grammar: states after a shift, (length, symbol) of reductions, states after a reduction.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
REDUCE = {5: (2, "C"), 7: (3, "C")}
GOTO = {(0, "C"): 3, (1, "C"): 4}
#: What a top stands for: nothing read, the system message, an open pair, whole pairs; and the role that can follow.
MEANS = {0: 0, 1: 1, 2: 2, 6: 2, 3: 3, 4: 3}
FOLLOWS = ("user", "user", "assistant", "user")
ACCEPTED = (0, 3)

#: A row's symbol is a letter that says its role initial and its first fault.
INITIALS, FAULTS = "sua?", ("", "blank", "duplicate", "truncated")
#: Rows of a part that is parsed and kept in a worker's table, entries of the table, and about the rows of a segment.
BLOCK_ROWS, BLOCKS, SEGMENT_ROWS = 32, 20_000, 100_000

_WHITE = " \t\n\x0b\f\r"

Best = tuple[int, str]
Table = tuple[tuple["Best | None", ...], ...]


class Top(NamedTuple):
    """Top of a stack in the graph; ``below`` is shared by the stacks that grew from it."""

    state: int
    below: Top | None
    cost: int
    audit: str


def _bottom() -> tuple[Top, ...]:
    """A stack for each thing that a top may stand for, free of cost."""
    start = Top(0, None, 0, "")
    return start, Top(1, start, 0, ""), Top(2, start, 0, ""), Top(3, start, 0, "")


def _shifted(top: Top, initial: str, cost: int, letter: str) -> Top | None:
    """The stack after a shift and the reductions that follow it; None where the initial doesn't fit."""
    state = SHIFT.get((top.state, initial))
    if state is None:
        return None
    new = Top(state, top, top.cost + cost, top.audit + letter)
    while new.state in REDUCE:
        length, symbol = REDUCE[new.state]
        base = new
        for _ in range(length):
            base = base.below
        new = Top(GOTO[base.state, symbol], base, new.cost, new.audit)
    return new


def _merge(tops: dict[int, Top], new: Top | None) -> bool:
    """Put a top among those of other states; of two in one state the lesser (cost, audit) stays."""
    if new is None or new.state in tops and (tops[new.state].cost, tops[new.state].audit) <= (new.cost, new.audit):
        return False
    tops[new.state] = new
    return True


def _with_insertions(tops: dict[int, Top]) -> dict[int, Top]:
    grown, work = dict(tops), list(tops.values())
    while work:
        top = work.pop()
        for initial in "ua":
            new = _shifted(top, initial, COST["I"], "I")
            if _merge(grown, new):
                work.append(new)
    return grown


def _read(tops: dict[int, Top], symbol: str) -> dict[int, Top]:
    """All edits of one row."""
    kind, fault = divmod(ord(symbol) - 97, 4)
    own, more = INITIALS[kind], TRUNCATED * (FAULTS[fault] == "truncated")
    out: dict[int, Top] = {}
    for top in tops.values():
        _merge(out, Top(top.state, top.below, top.cost + COST["D"], top.audit + "D"))
        if FAULTS[fault] not in ("blank", "duplicate"):
            _merge(out, _shifted(top, own, COST["K"] + more, "K"))
            for initial in "ua":
                if initial != own:
                    _merge(out, _shifted(top, initial, COST["R"] + more, "R"))
    return out


@lru_cache(maxsize=BLOCKS)
def parse(symbols: str) -> Table:
    """For each stack that the rows may find and leave: the least (cost, audit), or None where none leads there."""
    rows = []
    for bottom in _bottom():
        tops = _with_insertions({bottom.state: bottom})
        for symbol in symbols:
            tops = _with_insertions(_read(tops, symbol))
        row: list[Best | None] = [None] * 4
        for top in tops.values():
            to = MEANS[top.state]
            row[to] = min(filter(None, (row[to], (top.cost, top.audit))))
        rows.append(tuple(row))
    return tuple(rows)


def follow(row: tuple[Best | None, ...], table: Table) -> tuple[Best | None, ...]:
    """Least (cost, audit) for each stack after one more part."""
    reached = [(at, best) for at, best in enumerate(row) if best]
    return tuple(min(((cost + more[0], audit + more[1]) for at, (cost, audit) in reached if (more := table[at][to])), default=None) for to in range(4))


def parse_long(symbols: str) -> Table:
    """As ``parse``, block by block."""
    rows = parse(symbols[:BLOCK_ROWS])
    for at in range(BLOCK_ROWS, len(symbols), BLOCK_ROWS):
        rows = tuple(follow(row, parse(symbols[at : at + BLOCK_ROWS])) for row in rows)
    return rows


def cheapest(tables: list[Table]) -> Best:
    """Least (cost, audit) that repairs a conversation, given the tables of its parts in order."""
    row: tuple[Best | None, ...] = ((0, ""), None, None, None)
    for table in tables:
        row = follow(row, table)
    return min(row[at] for at in ACCEPTED if row[at])


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy`` after the damage that the query's contract names; nulls of role and text become a space.

    Rows that the damage drops stay, with a null ``copy``, so that no conversation is lost; a repeated row has copies 0 and 1.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    copies = F.when(what == 0, F.array(F.lit(None).cast("int"))).when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return conversations.select("conv_id", "turn", F.when(what == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the columns of ``damaged``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", space("role"), space("text"), F.lit(0).alias("copy"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def _in_turn() -> list[Column]:
    """Order of a conversation's rows; rows of one turn by role and digest of the text."""
    return [F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]


def _symbols(rows: DataFrame, n: int) -> DataFrame:
    """``conv_id, segment, symbols`` and the turns of each segment; ``segment`` numbers parts of a conversation in order."""
    spark = rows.sparkSession
    last = F.substring(F.rtrim("text", F.lit(_WHITE)), -1, 1)
    fault = F.when(last == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = rows.select("conv_id", "turn", "role", _digest(), "copy", kind.alias("kind"), fault.alias("fault"), F.monotonically_increasing_id().alias("salt"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // SEGMENT_ROWS + 1)
    order = [F.asc_nulls_first("conv_id"), *_in_turn(), F.col("salt")]
    placed = light.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("salt").withColumn("at", F.monotonically_increasing_id())
    placed, _ = materialize(placed, "turns")
    first = placed.where("copy is not null").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    judged = placed.join(first, "at", "left")
    fault = F.when((F.col("fault") != 1) & F.col("first").isNull(), 2).otherwise(F.col("fault"))
    symbol = F.when(F.col("copy").isNotNull(), F.char(97 + 4 * F.col("kind") + fault))
    held = F.struct("at", "turn", symbol.alias("symbol"))
    segments = judged.groupBy("conv_id", F.shiftright("at", 33).alias("segment")).agg(F.array_sort(F.collect_list(held)).alias("rows"))
    segments = segments.withColumn("rows", F.filter("rows", lambda r: r["symbol"].isNotNull()))
    turns = F.array_compact(F.array_distinct(F.col("rows.turn")))
    return segments.select("conv_id", "segment", F.array_join("rows.symbol", "").alias("symbols"), F.array_min(turns).alias("low"), F.array_max(turns).alias("high"), F.size(turns).cast("long").alias("turns"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SEGMENT = "conv_id long, segment long, low long, high long, turns long, costs array<long>, audits array<string>, ends string, blank long, duplicate long, truncated long, illegal long"
_VERDICT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


_TYPES = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def _illegal(kinds: np.ndarray) -> int:
    """Neighbours whose initials are not su, ua or au."""
    pairs = 4 * kinds[:-1] + kinds[1:]
    return int((~np.isin(pairs, (1, 4 + 2, 8 + 1))).sum())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def _parse_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(_SEGMENT)
    for b in slices(batches, "symbols"):
        out = []
        for r in b.to_pylist():
            kinds, faults = np.divmod(np.frombuffer(r["symbols"].encode(), np.uint8).astype(np.int64) - 97, 4)
            table = [best or (-1, "") for row in parse_long(r["symbols"]) for best in row]
            ends = INITIALS[kinds[0]] + INITIALS[kinds[-1]] if len(kinds) else ""
            counts = [int((faults == i).sum()) for i in (1, 2, 3)]
            out.append((r["conv_id"], r["segment"], r["low"], r["high"], r["turns"], [c for c, _ in table], [a for _, a in table], ends, *counts, _illegal(kinds)))
        yield _batch(out, schema)


def _chain_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(_VERDICT)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out = []
            for r in batch.slice(at, 256).to_pylist():
                parts = r["parts"]
                seen = [x for x in parts if x["turns"]]
                distinct = sum(x["turns"] for x in seen) - sum(a["high"] == b["low"] for a, b in zip(seen, seen[1:]))
                gaps = seen[-1]["high"] - seen[0]["low"] + 1 - distinct if seen else 0
                ends = "".join(x["ends"] for x in parts)
                between = np.array([INITIALS.index(x) for x in ends[1:-1]], np.int64)
                counts = [sum(x[c] for x in parts) for c in _COUNTS]
                counts[3] += sum(_illegal(between[i : i + 2]) for i in range(0, len(between), 2))
                tables = [tuple(tuple((c, a) if c >= 0 else None for c, a in zip(x["costs"][i : i + 4], x["audits"][i : i + 4])) for i in range(0, 16, 4)) for x in parts]
                out.append((r["conv_id"], gaps, *counts, *cheapest(tables)))
            yield _batch(out, schema)


def judge(rows: DataFrame, n: int) -> DataFrame:
    """Faults, cost and audit of each conversation in ``rows`` (columns of ``damaged``, about ``n`` of them); written to the shared folder."""
    segments = _symbols(rows, n).mapInArrow(_parse_segments, _SEGMENT)
    fields = [c for c in segments.columns if c != "conv_id"]
    parts = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))
    return materialize(parts.mapInArrow(_chain_segments, _VERDICT), "verdicts")[0]


def _walk(batches: Iterator[pa.RecordBatch], begin: Callable[[object], None], message: Callable[[str, str, str], None]) -> Iterator[None]:
    """Apply audits to the rows that follow them; calls ``begin(conv_id)`` and ``message(role, text, edit)``. Yields after each batch."""
    audit, at, means = "", 0, 0

    def move(initial: str) -> None:
        nonlocal means
        means = {"s": 1, "u": 2, "a": 3}[initial]

    def insert() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            role = FOLLOWS[means]
            message(role, "", "I")
            move(role[0])
            at += 1

    for b in slices(batches, rows=4096):
        for conv, is_row, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "is_row", "role", "text"))):
            if not is_row:
                begin(conv)
                audit, at, means = text, 0, 0
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    role = FOLLOWS[means] if edit == "R" else role
                    message(role, text, edit)
                    move(role[0])
            insert()
        yield


def _ordered(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    kept = rows.where("copy is not null").select("conv_id", F.lit(1).alias("is_row"), "turn", "role", _digest(), "text")
    none = F.lit(None)
    audits = verdicts.select("conv_id", F.lit(0).alias("is_row"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("digest"), F.col("audit").alias("text"))
    together = audits.unionByName(kept).repartition("conv_id")
    return together.sortWithinPartitions(F.asc_nulls_first("conv_id"), "is_row", *_in_turn()).select("conv_id", "is_row", "role", "text")


def repaired_messages(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The messages of repaired conversations: ``conv_id, n`` (from 0), ``role, text, edit`` (K, R or I)."""
    schema = _arrow("conv_id long, n long, role string, text string, edit string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, of, n = [], None, 0

        def begin(conv) -> None:
            nonlocal of, n
            of, n = conv, 0

        def message(role: str, text: str, edit: str) -> None:
            nonlocal n
            out.append((of, n, role, text, edit))
            n += 1

        for _ in _walk(batches, begin, message):
            if out:
                yield _batch(out, schema)
                out.clear()

    return _ordered(rows, verdicts).mapInArrow(run, "conv_id long, n long, role string, text string, edit string")


def repaired_digests(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of ``role:text`` of all messages, joined by line feeds. The digest grows message by message."""
    schema = _arrow("conv_id long, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, of, held, n = [], None, None, 0

        def begin(conv) -> None:
            nonlocal of, held, n
            if held:
                out.append((of, held.hexdigest()))
            of, held, n = conv, sha256(), 0

        def message(role: str, text: str, edit: str) -> None:
            nonlocal n
            held.update(("\n" if n else "").encode() + f"{role}:{text}".encode())
            n += 1

        for _ in _walk(batches, begin, message):
            if out:
                yield _batch(out, schema)
                out.clear()
        if held:
            yield _batch([(of, held.hexdigest())], schema)

    return _ordered(rows, verdicts).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(conversations: DataFrame, damage: Callable[[DataFrame], DataFrame] = undamaged) -> DataFrame:
    """Per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are taken by turn, null turns first, those of one turn by role and digest of the text; rows that
    repeat are duplicates. A null role or text counts as a space, so such a text is blank. Rows with a null
    ``conv_id`` are one conversation. Roles that begin with none of s, u and a can only be given another role
    or go. Other columns are ignored. A conversation without rows has zeros, an empty audit and the
    digest of nothing. An empty table gives an empty result.
    """
    rows = damage(conversations.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")}))
    verdicts = judge(rows, conversations.count())
    digests = repaired_digests(rows, verdicts)
    same = verdicts["conv_id"].eqNullSafe(digests["conv_id"])
    return verdicts.join(digests, same).drop(digests["conv_id"])
