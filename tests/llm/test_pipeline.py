"""Packing, and the whole corpus pipeline stage by stage."""

import random
import re
import zlib
from collections import Counter, defaultdict

import cases
import compare
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from test_bpe import ALPHABET
from test_scans import BASE, confirmed
from tokenizers import Tokenizer

import corpus_pipeline
from tidewell.llm import bpe, packing, tables
from tidewell.session import materialize

SF = f"{compare.DATA}/sf0.001"
JSON = P.path("byte_bpe_50k.json")


def test_added_tokens_as_the_library_gives_them():
    plain, own = Tokenizer.from_file(JSON), packing.ids_of(JSON)
    for text in ("<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>\n é", "<|endoftext", "no |endoftext|>", "x  <|endoftext|>  y " * 3):
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want, text
    assert np.frombuffer(own.encode("<|endoftext|>"), "<u4").tolist() == [50256]


def test_ids_are_those_of_the_tokenizers_library():
    own, codec, rng = packing.ids_of(JSON), bpe.codec(JSON), random.Random(5)
    assert own.plain is not None
    for i in range(6000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) if i % 3 else "".join(chr(rng.randrange(0x260)) for _ in range(rng.randint(1, 12)))
        assert own.encode(text) == codec.whole(text), repr(text)
    for text in (" " * 100_000, "=" * 100_000, "a" * 100_000 + "\n" * 9_999, "\t \n" * 9_000):
        assert own.encode(text) == codec.whole(text)


def test_words_are_encoded_once_and_as_the_library_does(monkeypatch):
    own, codec, rng = packing.ids_of(JSON), bpe.codec(JSON), random.Random(11)
    odd = [*ALPHABET, "\u2028", "\u2003", "Ж", "ж", "\u0300", "\u180e", "\ufeff", "\x7f", " \n", "'ll", " é"]
    for i in range(40):
        texts = [None, "", *("".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(60))]
        texts += ["".join(chr(rng.choice([rng.randrange(0x260), rng.randrange(0x3100), 32, 10])) for _ in range(rng.randint(0, 30))) for _ in range(40)]
        rng.shuffle(texts)
        rows = rng.choice([1, 7, 64, 500])
        got = []
        for ids, n in own.encode_all(pa.array(["cut off", *texts], pa.string()).slice(1), rows):
            got += [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]
            assert len(n) <= rows
        assert got == [codec.whole(t or "") for t in texts]
    assert [n.tolist() for _, n in own.encode_all(pa.array([None, ""], pa.string()))] == [[0, 0]]
    seen = []
    monkeypatch.setattr(own, "plain", type("", (), {"encode_ordinary": lambda _, text, f=own.plain.encode_ordinary: seen.append(text) or f(text)})())
    list(own.encode_all(pa.array(["one two three two\none two" + " two three" * 50] * 20)))
    assert len("".join(seen)) < 40


def test_bounds_of_partitions_need_no_second_pass_over_keys(spark, monkeypatch):
    tokens = packing.tokenised(tables.documents(spark, SF), JSON)
    counts = packing.corpus_counts(tokens)
    idf = np.maximum(0, np.log((counts.docs - counts.df + 0.5) / (counts.df + 0.5))).astype(np.float32)
    monkeypatch.setattr(packing, "BOUND_DOCUMENTS", 12)
    rests = packing.by_content(tokens, counts, idf, 1500)
    assert "rangepartitioning" not in rests._jdf.queryExecution().toString()
    assert sorted(r.rest for r in rests.collect()) == sorted(r.rest for r in tokens.where("n_rest > 0 and frequencies is null").collect())
    sizes = [n for n in rests.select(F.spark_partition_id().alias("p")).groupBy("p").count().toPandas()["count"]]
    assert len(sizes) > 3 and max(sizes) < sum(sizes) / 2
    # In one partition, everything stands in the order of keys; several partitions one after another give the same order.
    monkeypatch.setattr(packing, "PARTITION_SHARDS", 1 << 40)
    assert [r.rest for r in packing.by_content(tokens, counts, idf, 1500).collect()] == [r.rest for r in rests.collect()]


def test_keys_are_the_tokens_of_greatest_weight():
    rng = np.random.default_rng(3)
    for _ in range(100):
        size = int(rng.integers(1, 30))
        ids = [rng.integers(0, size, rng.integers(1, 20)).astype("<u4") for _ in range(rng.integers(1, 20))]
        idf, rank = (np.round(rng.random(size) * 3) / 4).astype(np.float32), rng.permutation(size)
        rank[rng.random(size) < rng.choice([0, 0.3, 1])] = -1
        for own, key in zip(ids, packing.keys(ids, idf, rank, 8.0)):
            tf = Counter(own.tolist())
            weight = {t: float(idf[t] * np.int64(n) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own) / 8.0))) for t, n in tf.items() if rank[t] >= 0}
            want = sorted(weight, key=lambda t: (-round(weight[t], 12), t))[:4]
            assert np.frombuffer(key, ">u4").tolist() == [rank[t] for t in want]


def test_counts_of_the_corpus(spark):
    docs, codec = cases.edges(spark), bpe.codec(JSON)
    df, n, total, rests = packing.corpus_counts(packing.tokenised(docs, JSON))
    ids = [np.frombuffer(codec.encode(b or "") + b"\0\0\0\0", "<u4") for _, b, _ in cases.EDGES]
    want = Counter(t for x in ids for t in set(x.tolist()))
    assert (n, total) == (len(ids), sum(map(len, ids))) and rests == sum(len(x) % 1024 for x in ids) and {i: int(k) for i, k in enumerate(df) if k} == want
    assert packing.corpus_counts(packing.tokenised(cases.empty(spark), JSON))[1:] == (0, 0, 0)


def check_packing(pieces, texts):
    codec = bpe.codec(JSON)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = codec.encode(texts[doc] or "") + b"\0\0\0\0"
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) // 4 and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)])
            at += p.length
        assert at == len(ids) // 4
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    return sum(1024 - sum(p.length for p in own) for own in by_sequence.values())


def test_packing(spark):
    docs = tables.documents(spark, SF)
    pieces = packing.pack(docs, JSON).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert check_packing(pieces, {r.doc_id: r.text for r in docs.collect()}) < 1024


def test_packing_edges(spark):
    docs = cases.edges(spark).dropDuplicates()
    check_packing(packing.pack(docs, JSON).withColumn("ids_crc32", F.crc32("ids")).collect(), {a: b for a, b, _ in cases.EDGES})
    check_packing(packing.pack(docs, JSON, shard_tokens=200).withColumn("ids_crc32", F.crc32("ids")).collect(), {a: b for a, b, _ in cases.EDGES})
    assert packing.pack(cases.empty(spark), JSON).count() == 0


def test_rests_and_own_windows(spark):
    docs = cases.edges(spark).dropDuplicates()
    for window in (1, 7, 64):
        pieces = packing.pack(docs, JSON, window=window, shard_tokens=300).withColumn("ids_crc32", F.crc32("ids")).collect()
        check_packing(pieces, {a: b for a, b, _ in cases.EDGES})
        held = Counter()
        for p in pieces:
            held[p.sequence_id] += p.length
        assert max(held.values()) <= window and (window > 1 or set(held.values()) == {1})


def slow_pack(rests, idf, mean, window):
    """Windows of a shard: the longest rest left seeds one, the best unused rests for it fill the space."""
    at, out = [0] * len(rests), []

    def score(query, d):
        got = 0.0
        for t in sorted(set(query)):
            tf = rests[d].count(t)
            got += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(rests[d]) / mean))
        return got

    for seed in sorted(range(len(rests)), key=lambda d: -len(rests[d])):
        query = rests[seed][at[seed] :]
        if not query:
            continue
        others = [d for d in range(len(rests)) if d != seed and at[d] < len(rests[d])]
        row, free = [], window
        for d in [seed, *sorted(others, key=lambda d: -round(score(query, d), 9))]:
            take = min(free, len(rests[d]) - at[d])
            if take:
                row.append((d, at[d], take))
                at[d], free = at[d] + take, free - take
        out.append(row)
    return out


def test_packer_equals_a_slow_one():
    rng = np.random.default_rng(7)
    for _ in range(40):
        ids = [rng.integers(0, 30, rng.integers(1, 16)).astype(np.uint32) for _ in range(rng.integers(1, 25))]
        idf = np.where(rng.random(30) < 0.2, 0, rng.random(30)).astype(np.float32)
        got = defaultdict(list)
        for d, start, n, sequence, offset in packing.Shard(ids, idf, 8.0).pack(16):
            assert offset == sum(x[2] for x in got[sequence])
            got[sequence].append((d, start, n))
        assert list(got.values()) == slow_pack([x.tolist() for x in ids], idf.tolist(), 8.0, 16)


def test_scores_are_bm25():
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint32) for _ in range(30)]
    idf = rng.random(40)
    idf[:5] = 0
    shard = packing.Shard(ids, idf, 25.0)
    query = ids[3]
    for d, own in enumerate(ids):
        want = 0.0
        for t in set(query.tolist()):
            tf = int((own == t).sum())
            want += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / 25.0))
        assert abs(shard.scores(query)[d] - want) < 1e-9


def test_neighbours_fill_the_seed_s_window():
    ids = [np.array(x, np.uint32) for x in ([1, 2, 3, 4, 5], [9, 9, 9, 9], [8, 7, 9, 8], [1, 2, 3, 9])]
    first = [p[0] for p in packing.Shard(ids, np.ones(10), 4.0).pack(8) if p[3] == 0]
    assert first == [0, 3]


def test_neighbours_come_from_the_whole_table(spark):
    rng = np.random.default_rng(5)
    names = ["copper", "violin", "glacier", "tomato", "harbor", "marble", "falcon", "ribbon", "cactus", "lantern", "pepper", "saddle", "anchor", "basket", "walnut", "candle", "helmet", "orchid", "pirate", "quartz"]
    common = ["table", "water", "about", "under", "other", "their", "where", "after"]
    rows = []
    for i in range(160):  # related documents stand 20 rows apart
        own = [names[i % 20]] * 6 + rng.choice(common, 30).tolist()
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id")
    pieces = packing.pack(docs, JSON, window=96, shard_tokens=400).collect()
    held = defaultdict(set)
    for p in pieces:
        held[p.sequence_id].add(p.doc_id)
    shared = [len({d % 20 for d in x}) == 1 for x in held.values() if len(x) > 1]
    assert len(shared) > 40 and np.mean(shared) > 0.5


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def key(row):
    return (row[0] is None, row[0] or 0)


def slow_exact(rows):
    """Of equal texts the row with the smallest id."""
    best = {}
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        best[norm] = min(best.get(norm, r), r, key=key)
    return Counter(best.values())


def slow_near(rows):
    """Of each group of linked fingerprints the row with the smallest id (ties: fingerprint), one if it repeats."""
    fps = [slow_fingerprint(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[find(i)] = find(j)
    best = {}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for i, r in enumerate(rows):
        now = (key(r), signed[i], r)
        g = find(i)
        best[g] = min(best.get(g, now), now, key=lambda x: x[:2])
    return Counter(x[2] for x in best.values())


AWKWARD = [
    (5, "one text that stands here"), (5, "another text altogether, longer than the first"), (7, "one  text that stands here"),
    (3, "another text altogether, longer than the first"), (None, "one text that stands here"), (None, "without any id"), (None, "without any id"),
    (None, "without  any id"), (9, "twice the same"), (9, "twice the same"), (11, None), (12, ""), (13, "word " * 3000), (14, "call me: a@b.example or +1 555 010 9999"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t) if t is not None else None, "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)


def rows_of(frame):
    return Counter((r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in frame.collect())


def plain(rows):
    return Counter({(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")): n for (i, t), n in rows.items()})


def test_stages_take_awkward_tables(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, AWKWARD)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        if name != "packing":
            assert stage(spark, docs, SF).columns == docs.columns
    assert rows_of(stages["exact_dedup"](spark, docs, SF)) == plain(slow_exact(AWKWARD))
    assert rows_of(stages["near_dedup"](spark, docs, SF)) == plain(slow_near(AWKWARD))
    assert sum(rows_of(stages["toxicity"](spark, docs, SF)).values()) == len(AWKWARD)
    clean = stages["pii"](spark, docs, SF).collect()
    assert len(clean) == len(AWKWARD) and {r.text for r in clean if r.doc_id in (11, 14)} == {None, "call me: <EMAIL> or <PHONE>"}
    pieces = stages["packing"](spark, docs, SF).collect()
    codec = bpe.codec(JSON)
    tokens = Counter((i, len(codec.encode(t or "")) // 4 + 1) for i, t in AWKWARD)
    first = Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0)
    assert first == tokens and sum(p.length for p in pieces) == sum(n * k for (_, n), k in tokens.items())


def test_pipeline(spark):
    """Each stage against slow code of its own (toxicity: its labels)."""
    SF = f"{compare.DATA}/sf0.01"
    docs = tables.documents(spark, SF)
    columns = docs.columns
    kept = []
    toxic, clean = ({r.doc_id for r in tables.labels(spark, SF).where(f"toxic = {c}").collect()} for c in (1, 0))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs, _ = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            gone = {i for i, _ in before} - set(after)
            assert len(gone & toxic) > 0.4 * len(toxic) and len(gone & clean) < 0.05 * len(clean)
        elif name == "exact_dedup":
            assert set(after) == {i for i, _ in slow_exact(before)}
        elif name == "near_dedup":
            assert set(after) == {i for i, _ in slow_near(before)}
        else:
            assert set(after) == {i for i, _ in before}
            for text in after.values():
                spans = [m[0] for k in BASE for m in re.finditer(BASE[k], text or "") if confirmed(k, m[0])]
                assert not spans, spans
            assert docs.where("n_chars <> length(text)").count() == 0
        kept.append(len(after))
    assert kept == sorted(kept, reverse=True) and kept[0] < 1000
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), texts)
    check_packing(corpus_pipeline.run(spark, SF).collect(), texts)
