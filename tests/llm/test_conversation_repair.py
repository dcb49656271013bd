"""Audits equal an enumeration of all edits; whole rows equal a plain search over a whole table."""

import hashlib
import itertools
import random
import re
import zlib

import compare
import pytest

from tidewell.llm import catalog, conversation_repair as cr

SF = f"{compare.DATA}/sf0.001"
GRAMMAR = re.compile("(s?(ua)+)?")
WORD = re.compile("[^\x20\x09-\x0d]")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def symbol(initial, fault):
    return chr(97 + 4 * "sua?".index(initial) + ["", "blank", "duplicate", "truncated"].index(fault))


def enumerated(rows):
    """Least (cost, audit) over every choice of edits, with at most two insertions in a place."""
    gaps = ["", "u", "a", "uu", "ua", "au", "aa"]
    own = []
    for initial, fault in rows:
        more = fault == "truncated"
        own.append([(3, "D", "")] + ([] if fault in ("blank", "duplicate") else [(more, "K", initial), (2 + more, "R", "u"), (2 + more, "R", "a")]))
    best = None
    for edits in itertools.product(*own):
        if best and sum(e[0] for e in edits) > best[0]:
            continue
        for filled in itertools.product(gaps, repeat=len(rows) + 1):
            text = filled[0] + "".join(e[2] + f for e, f in zip(edits, filled[1:]))
            if GRAMMAR.fullmatch(text):
                cost = sum(e[0] for e in edits) + 2 * sum(map(len, filled))
                audit = "I" * len(filled[0]) + "".join(e[1] + "I" * len(f) for e, f in zip(edits, filled[1:]))
                best = min(best or (cost, audit), (cost, audit))
    return best


def stepwise(rows):
    """The same by a search over what may follow, state by state; gives (cost, audit, initials)."""
    after = {0: "su", 1: "u", 2: "a", 3: "u"}
    to = {"s": 1, "u": 2, "a": 3}

    def inserted(best):
        for _ in range(3):
            for at, (cost, audit, text) in list(best.items()):
                for x in "ua":
                    if x in after[at]:
                        new = (cost + 2, audit + "I", text + x)
                        best[to[x]] = min(best.get(to[x], new), new)
        return best

    best = inserted({0: (0, "", "")})
    for initial, fault in rows:
        grown, more = {}, fault == "truncated"
        for at, (cost, audit, text) in best.items():
            options = [(at, (cost + 3, audit + "D", text + "-"))]
            if fault not in ("blank", "duplicate"):
                options += [(to[x], (cost + (0 if x == initial else 2) + more, audit + ("K" if x == initial else "R"), text + x)) for x in after[at] if x == initial or x != "s"]
            for state, new in options:
                grown[state] = min(grown.get(state, new), new)
        best = inserted(grown)
    return min(best[at] for at in (0, 3) if at in best)


FAULTS = ["", "", "", "truncated", "blank", "duplicate"]


def test_audits_against_enumeration():
    rng = random.Random(3)
    cases = [[(x, f) for x, f in zip(c, fs)] for n in (0, 1, 2) for c in itertools.product("sua?", repeat=n) for fs in itertools.product(["", "truncated", "blank"], repeat=n)]
    cases += [[(rng.choice("ssuuaa?"), rng.choice(FAULTS)) for _ in range(3)] for _ in range(60)]
    for rows in cases:
        want = enumerated(rows)
        assert cr.cheapest([cr.parse_long("".join(symbol(*r) for r in rows))]) == want, rows
        assert stepwise(rows)[:2] == want, rows


def test_tables_of_parts_chain_to_the_whole():
    rng = random.Random(4)
    for _ in range(400):
        rows = [(rng.choice("suuuaaa?"), rng.choice(FAULTS)) for _ in range(rng.randint(0, 90))]
        text = "".join(symbol(*r) for r in rows)
        cuts = sorted(rng.choices(range(len(text) + 1), k=rng.randint(0, 5)))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        assert cr.cheapest([cr.parse_long(p) for p in parts]) == cr.cheapest([cr.parse_long(text)]) == stepwise(rows)[:2]


def slow(rows):
    """The contract's rows, conversation by conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        own += [(turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, symbols = set(), []
        for _, role, text in own:
            words = WORD.findall(text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated"
            seen.add((role, text))
            symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault))
        cost, audit, initials = stepwise(symbols)
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        messages, left = [], iter(own)
        for edit, x in zip(audit, initials):
            role, text = (None, "") if edit == "I" else next(left)[1:]
            if edit != "D":
                messages.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[x]}:{text}")
        faults = [sum(f == k for _, f in symbols) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(messages).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = catalog.op11_conversation_repair(spark, SF)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows)


SCHEMA = "conv_id long, turn long, role string, text string, digest string, at int"


def awkward(rng):
    rows = [(None, t, "user", "hello.", None, 1) for t in range(4)] + [(7, None, None, None, "x", 2), (7, None, "assistant", "yes.", "x", 2), (8, 3, "tool", "done.", None, None)]
    for conv in range(20, 60):
        for turn in range(rng.randint(1, 12)):
            role, text = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rng.choice(["a.", "b!", "b!", "c", " \n", None, "ünï? \t", "long " * 2000 + "."])
            rows += [(conv, rng.choice([turn, turn, turn, 3, None, 50]), role, text, "", 0)] * rng.choice([1, 1, 1, 2])
    return rows + [(99, t, ["user", "assistant"][t % 2], f"turn {t}" + "." * (t % 3 > 0), None, None) for t in range(1500)]


@pytest.mark.parametrize("segment_rows", [100_000, 100])
def test_awkward_rows_and_long_conversations(spark, segment_rows, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT_ROWS", segment_rows)
    rows = awkward(random.Random(8))
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = cr.repair(table, cr.damaged)
    assert got.columns == COLUMNS and sorted(map(tuple, got.collect()), key=str) == slow([r[:4] for r in rows])


def test_a_long_conversation_is_parsed_in_segments(spark, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT_ROWS", 100)
    table = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(1500)], "conv_id long, turn long, role string, text string")
    parts = cr._symbols(cr.undamaged(table), table.count()).collect()
    assert len(parts) >= 8 and sum(len(p.symbols) for p in parts) == 1500 and max(len(p.symbols) for p in parts) < 500


def test_messages_and_empty_tables(spark):
    rows = [(1, 0, "system", "be kind."), (1, 1, "user", "hi."), (1, 2, "user", "hi."), (1, 3, "assistant", "yo."), (1, 4, "user", "bye!"), (2, 0, "tool", "")]
    table = cr.undamaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    verdicts = cr.judge(table, 6)
    assert {r.conv_id: (r.cost, r.audit) for r in verdicts.collect()} == {1: (5, "KKDKKI"), 2: (3, "D")}
    got = [tuple(r) for r in cr.repaired_messages(table, verdicts).orderBy("conv_id", "n").collect()]
    assert got == [(1, 0, "system", "be kind.", "K"), (1, 1, "user", "hi.", "K"), (1, 2, "assistant", "yo.", "K"), (1, 3, "user", "bye!", "K"), (1, 4, "assistant", "", "I")]
    assert cr.repair(spark.createDataFrame([], SCHEMA), cr.damaged).count() == 0
