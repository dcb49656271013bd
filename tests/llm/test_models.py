"""Held-out accuracy of the trained classifiers, and their edges."""

import zlib

import cases
import compare
import numpy as np
import pytest

from tidewell.llm import quality, tables, toxicity

SF = f"{compare.DATA}/sf0.1"


def rows_of(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_quality(spark):
    got = rows_of(quality.classify(tables.documents(spark, SF), tables.labels(spark, SF)))
    truth = {r.doc_id: r.quality for r in tables.labels(spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.98
    assert np.mean([got[i].predicted for i in held if truth[i]]) > 0.99


def test_toxicity(spark):
    got = rows_of(toxicity.classify(tables.documents(spark, SF), tables.labels(spark, SF)))
    truth = {r.doc_id: r.toxic for r in tables.labels(spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].predicted for i in held if truth[i]]) > 0.85
    assert np.mean([got[i].predicted for i in held if not truth[i]]) < 0.02


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_edges(spark, module, column):
    docs = cases.edges(spark)
    some = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (5, 1), (9, 1), (9, None), (None, 1), (6, 0), (3, 1), (8, 0), (7, 1)], f"doc_id long, {column} int")
    for labels in (some, some.where(f"{column} = 0"), some.limit(0)):
        rows = module.classify(docs, labels).collect()
        assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in cases.EDGES) and all(0 <= r.score <= 1 for r in rows)
        same = [r.score for r in rows if r.doc_id in (1, 5)]
        assert len(set(same)) == 1
    assert module.classify(cases.empty(spark), some).count() == 0


def test_word_vectors_against_slow_sums(spark):
    docs = tables.documents(spark, f"{compare.DATA}/sf0.001").repartition(5)
    texts = [r.text or "" for r in docs.collect()]
    places, signs = quality.random_vectors()
    sums = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for text in texts:
        ids = quality.tokens(text).tolist()
        for i, word in enumerate(ids):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ids):
                    for place, sign in zip(places[ids[j]], signs[ids[j]]):
                        sums[word, place] += sign
    common = [sum(row[d] for row in sums) / np.abs(sums).sum() for d in range(quality.DIMENSIONS)]
    got = quality.word_vectors(docs)
    for bucket in {b for text in texts[:40] for b in quality.tokens(text).tolist()}:
        own = sums[bucket] - np.array(common) * np.abs(sums[bucket]).sum()
        assert np.allclose(got[bucket], own / (np.sqrt((own**2).sum()) + 1e-9), atol=1e-5)
    ids = quality.tokens(texts[0])
    rows = [got[b].astype(float) for b in ids]
    mean = sum(rows) / len(rows)
    spread = np.sqrt(sum((r - mean) ** 2 for r in rows) / len(rows))
    likeness = sum(a @ b for a, b in zip(rows, rows[1:])) / (len(rows) - 1)
    assert np.allclose(quality.pooled(ids, got), [*mean, *spread, likeness, np.log(1 + len(rows))], atol=1e-4)


def test_quality_network_against_finite_differences():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (14, 3))
    y = (x[:, 0] + rng.normal(0, 0.5, 14) > 0).astype(float)
    slow, trained = (quality.Network(x, y, hidden=4, epochs=n) for n in (0, 5))
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)

    def loss(w):
        logit = np.tanh(z @ w[0] + w[1]) @ w[2] + w[3]
        return np.log(1 + np.exp(np.where(y > 0, -logit, logit))).mean() + 0.5e-4 * sum((a**2).sum() for a in w)

    first, second = [0 * w for w in slow.w], [0 * w for w in slow.w]
    for step in range(1, 6):  # Adam, one batch a step
        slopes = [np.zeros(w.shape) for w in slow.w]
        for w, g in zip(slow.w, slopes):
            for at in np.ndindex(w.shape):
                w[at] += 1e-5
                up = loss(slow.w)
                w[at] -= 2e-5
                g[at] = (up - loss(slow.w)) / 2e-5
                w[at] += 1e-5
        for j, g in enumerate(slopes):
            first[j], second[j] = 0.9 * first[j] + 0.1 * g, 0.999 * second[j] + 0.001 * g**2
            slow.w[j] = slow.w[j] - 0.01 * first[j] / (1 - 0.9**step) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(slow.w, trained.w))


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 3))
    y = (x[:, 0] + rng.normal(0, 1, 300) > 0).astype(float)
    net = quality.Network(x[:100], y[:100])
    net.w[2], net.w[3] = 5 * net.w[2], 5 * net.w[3]  # too sure of itself
    net.calibrate(x[100:], y[100:])

    def loss(t):
        p = 1 / (1 + np.exp(-net.logit(x[100:]) / t))
        return -np.mean(np.log(np.where(y[100:] > 0, p, 1 - p) + 1e-300))

    assert net.temperature > 1 and all(loss(net.temperature) <= loss(t) + 1e-9 for t in (0.25, 0.5, 1, 8, net.temperature * 1.1, net.temperature / 1.1))
    assert np.allclose(net.score(x), 1 / (1 + np.exp(-np.clip(net.logit(x) / net.temperature, -30, 30))))


def small_risk(seed=0):
    rng = np.random.default_rng(seed)
    p, u = rng.normal(1, 1, (7, 5)), rng.normal(0, 1, (11, 5))
    n_p, n_u = rng.integers(1, 4, 7).astype(float), rng.integers(1, 9, 11).astype(float)
    net = toxicity.Network(u, n_u)
    for w in net.w:
        w += rng.normal(0, 0.5, w.shape)
    return net, p, n_p, u, n_u


@pytest.mark.parametrize("prior", [0.2, 0.95])
def test_risk_and_its_gradient(prior):
    net, p, n_p, u, n_u = small_risk()
    if net.forward(p)[2].mean() < net.forward(u)[2].mean():
        net.w[2] *= -1
    net.w[2] *= 2
    in_p, in_u = n_p / n_p.sum(), n_u / n_u.sum()
    positive, negative, direction = toxicity.nnpu(net, p, in_p, u, in_u, prior)
    loss = lambda x, y: np.log1p(np.exp(-y * net.forward(x)[2]))
    rows_p, rows_u = np.repeat(p, n_p.astype(int), axis=0), np.repeat(u, n_u.astype(int), axis=0)  # document by document
    assert abs(positive - prior * loss(rows_p, 1).mean()) < 1e-9
    assert abs(negative - (loss(rows_u, -1).mean() - prior * loss(rows_p, -1).mean())) < 1e-9
    assert (negative < 0) == (prior > 0.5)  # both branches

    def aim():
        a, b, _ = toxicity.nnpu(net, p, in_p, u, in_u, prior)
        return a + b if negative >= 0 else -b

    for w, g in zip(net.w, direction):
        for at in np.ndindex(w.shape):
            w[at] += 1e-5
            up = aim()
            w[at] -= 2e-5
            assert abs((up - aim()) / 2e-5 - g[at]) < 1e-6
            w[at] += 1e-5


def test_toxicity_learns_from_all_documents(spark):
    """Counts and cells of the whole table, and positives described without themselves, against slow code."""
    sf = f"{compare.DATA}/sf0.001"
    docs, labels = tables.documents(spark, sf).repartition(5), tables.labels(spark, sf)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    chosen = {r.doc_id for r in labels.where("toxic = 1").collect()}
    held = {i: set(toxicity.features(t).tolist()) for i, t in texts.items()}
    marked = docs.selectExpr("doc_id", "text", f"doc_id in ({','.join(map(str, chosen))}) as positive")
    counts = toxicity.corpus_counts(marked)
    for got, ids in zip(counts, (set(texts), chosen)):
        want = np.bincount([b for i in ids for b in held[i]], minlength=toxicity.BUCKETS)
        assert (got == want).all()
    assert counts[2:] == (len(texts), len(chosen))
    corpus, positive, n, n_p = counts
    weights = toxicity.evidence(np.arange(toxicity.BUCKETS), positive, n_p, corpus, n).astype(np.float32)
    for r in toxicity._described(marked, weights, (positive, n_p, corpus, n)).collect():
        f = sorted(held[r.doc_id])
        assert r.cell == toxicity.describe(weights[f], len(f)) < toxicity.CELLS and (r.own_cell is not None) == (r.doc_id in chosen)
        if r.own_cell is not None:
            others = [held[i] for i in chosen if i != r.doc_id]
            alone = np.array([sum(b in x for x in others) for b in f])
            rest = np.array([sum(b in x for i, x in held.items() if i != r.doc_id) for b in f])
            assert r.own_cell == toxicity.describe(toxicity.evidence(np.arange(len(f)), alone, n_p - 1, rest, n), len(f))


def test_score_agrees_with_classify(spark):
    sf = f"{compare.DATA}/sf0.01"
    docs, labels = tables.documents(spark, sf), tables.labels(spark, sf)
    model = toxicity.fit(docs, labels.where("pmod(crc32(cast(doc_id as string)), 3) <> 1"))
    a = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    b = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-12 for i in a)
