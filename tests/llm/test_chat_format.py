"""Formatted conversations read back as they were; folds equal plain folds of shuffled logs."""

import hashlib
import random

import compare
import pytest

from tidewell.llm import catalog, chat_format as cf

SF = f"{compare.DATA}/sf0.001"
PARTS = [*cf.CONTROL, "<", "[", "\\", "<\\s>", "[\\\\INST]", "<\\", "/s>", "INST]", "user", "\n", " ", "é", "😀", "<INST]", "s>", "[END", "]"]


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 8)))
        own = cf.escape(text)
        assert cf.unescape(own) == text and not any(c in own for c in cf.CONTROL)


def test_turns_parse_back():
    rng = random.Random(2)
    for _ in range(4000):
        turns = [(rng.choice(["user", "assistant", "system", "", *PARTS]), "".join(rng.choices(PARTS, k=rng.randint(0, 6)))) for _ in range(rng.randint(0, 5))]
        pieces = [cf.render(*t) for t in turns]
        assert cf.parse("".join(p for p, _, _ in pieces)) == turns
        for (role, text), (piece, start, end) in zip(turns, pieces):
            assert (start is not None) == (role == "assistant") and (start is None or cf.unescape(piece[start:end]) == text)
    for broken in ("x", "<s>[INST]a", "[ANS]a</s> ", "<s>[ROLE]r[/ROLE]a</s>"):
        with pytest.raises(ValueError):
            cf.parse(broken)


def test_query_equals_its_sql(spark):
    con = compare.connect(SF)
    got = catalog.op13_chat_format(spark, SF)
    assert compare.difference(got, con, catalog.oracle_sql()["op13_chat_format"]) == ""
    probe = got.where("conv_id = -1").first()
    assert (probe.n_turns, probe.loss_chars) == (2, len(cf.PROBE)) and probe.loss_sha256 == hashlib.sha256(cf.PROBE.encode()).hexdigest()


LOG = "seq long, kind string, text string, conv_id long, position long, message string, role string, piece string"


def test_folds_of_shuffled_logs(spark):
    rng, rows, want = random.Random(5), [], {}
    for conv in [None, *range(12)]:
        for position in [None, *range(rng.randint(0, 6))]:
            role, text = rng.choice(["user", "assistant", "system"]), ""
            events = [("open", rng.choice([None, "a "]))] + [(rng.choice(["delta", "delta", "delta", "edit", "regenerate"]), rng.choice([None, "", "b ", "</s>", "é\n"])) for _ in range(rng.randint(0, 9))]
            for seq, (kind, part) in enumerate(events):
                text = (part or "") if kind in ("edit", "regenerate") else text + (part or "")
                rows.append((seq * 7, kind, part, conv, position, "m", role if seq == 0 else None, "clash"))
            want.setdefault(conv, []).append((role, text))
    rng.shuffle(rows)
    pieces = cf.format_log(spark.createDataFrame(rows, LOG).repartition(3))
    found = {}
    for r in pieces.collect():
        found.setdefault(r.conv_id, []).append(r.piece)
    assert {c: cf.parse("".join(p)) for c, p in found.items()} == want
    read = {r.conv_id: r for r in cf.read_back(pieces).collect()}
    for conv, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (read[conv].n_turns, read[conv].loss_chars, read[conv].formatted_chars) == (len(turns), len(loss), len("".join(found[conv])))
        assert read[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert read[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_logs_of_messages_fold_back(spark):
    rows = [(1, 0, "user", "x" * 5000, 1), (1, 1, "assistant", None, 1), (1, 1, "assistant", None, 1), (2, None, None, "é😀" * 700, 1), (None, 3, "tool", "", 1), (3, 2, "assistant", "a\nb", 1), (3, 1, "assistant", "<\\s>", 1)]
    rows += [(9, t, ["user", "assistant"][t % 2], f"text {t} " * (t % 90), 1) for t in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message int").repartition(4)
    log = cf.log_of(table)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate"}
    assert max(len(r.text or "") for r in log.collect()) <= cf.DELTA_CHARS
    found = {}
    for r in cf.format_log(log).collect():
        found.setdefault(r.conv_id, []).extend(cf.parse(r.piece))
    want = {}
    for conv, _, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert found == want


def test_bad_and_empty_logs(spark):
    assert cf.read_back(cf.format_log(spark.createDataFrame([], LOG))).count() == 0
    for kind in ("delta", "unknown"):
        with pytest.raises(Exception, match="ValueError"):
            cf.format_log(spark.createDataFrame([(0, kind, "a", 1, 0, "m", "user", "")], LOG)).collect()
