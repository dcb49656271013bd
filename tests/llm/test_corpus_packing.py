"""Neighbours of the whole corpus against brute force, and packings made of them."""

import math
from collections import Counter, defaultdict

import cases
import compare
import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F
from test_pipeline import check_packing

from tidewell.llm import corpus_packing, packing, tables

SF, JSON = f"{compare.DATA}/sf0.001", P.path("byte_bpe_50k.json")


def brute(tokens, counts, k):
    """The k best others of every rest, each scored with each."""
    rests = {r.at: Counter(np.frombuffer(r.rest, "<u4").tolist()) for r in tokens.where("n_rest > 0 and frequencies is null").collect()}
    mean = counts.rests / counts.docs
    idf = {t: math.log((counts.docs - df + 0.5) / (df + 0.5)) for t, df in enumerate(counts.df.tolist())}
    out = {}
    for at, own in rests.items():
        scores = {}
        for other, tf in rests.items():
            size = sum(tf.values())
            score = sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * size / mean)) for t in own if t in tf and idf[t] > 0)
            if other != at and score > 0:
                scores[other] = score
        out[at] = sorted(scores.items(), key=lambda x: -x[1])[:k]
    return out


@pytest.mark.parametrize("block_tokens", [1 << 22, 8000])
def test_neighbours_are_those_of_the_whole_corpus(spark, block_tokens):
    docs = tables.documents(spark, SF)
    tokens = packing.tokenised(docs, JSON)
    counts = packing.corpus_counts(tokens)
    got = defaultdict(list)
    for r in corpus_packing.neighbours(tokens, counts, block_tokens=block_tokens).collect():
        got[r.seed].append((r.other, r.score))
    for at, want in brute(tokens, counts, 10).items():
        own = sorted(got[at], key=lambda x: -x[1])
        assert np.allclose([s for _, s in own], [s for _, s in want], rtol=1e-4)
        least = want[-1][1] if want else 0
        assert {o for o, s in own if s > least * 1.0001} == {o for o, s in want if s > least * 1.0001}


def test_packing(spark):
    docs = tables.documents(spark, SF)
    pieces = corpus_packing.pack(docs, JSON, block_tokens=20_000).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert check_packing(pieces, {r.doc_id: r.text for r in docs.collect()}) < 1024


def test_units_hold_neighbours_once(spark):
    docs = tables.documents(spark, SF)
    tokens = packing.tokenised(docs, JSON)
    counts = packing.corpus_counts(tokens)
    found = corpus_packing.neighbours(tokens, counts)
    listed = {(r.seed, r.other) for r in found.collect()}
    rows = corpus_packing.units(tokens, found).collect()
    rests = {r.at: r.n_rest for r in tokens.where("n_rest > 0 and frequencies is null").collect()}
    assert sorted(r.at for r in rows) == sorted(rests)
    by = defaultdict(list)
    for r in rows:
        by[r.unit].append(r)
        assert r.at == r.unit or (r.unit, r.at) in listed
    for own in by.values():
        *most, _ = sorted(own, key=lambda r: r.place)
        assert sum(rests[r.at] for r in most) < 1024 and min(r.place for r in own) == 0
    assert sum(len(own) for own in by.values() if len(own) > 1) > len(rests) / 2


def test_edges(spark):
    docs = cases.edges(spark).dropDuplicates()
    for window, shard in ((1024, 1 << 19), (64, 300)):
        pieces = corpus_packing.pack(docs, JSON, window=window, shard_tokens=shard, block_tokens=500).withColumn("ids_crc32", F.crc32("ids")).collect()
        check_packing(pieces, {a: b for a, b, _ in cases.EDGES})
    assert corpus_packing.pack(cases.empty(spark), JSON).count() == 0
