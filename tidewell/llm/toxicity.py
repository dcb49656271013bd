"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives P; all other text is unlabelled U. A feature is a
word, or the first letters of a word, hashed to a bucket. How much more often a bucket occurs
in P than in the corpus (document frequencies over all documents) is its evidence; a document
is described by its strongest evidence. A two-layer numpy network on that description is
trained with the class-prior-corrected risk of Kiryo et al. (NeurIPS 2017):
``pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))``.

Descriptions are quantised to cells of a fixed grid (``CELLS`` at most), so the risk is taken over
all documents: SQL counts the documents of each cell, and training weighs cells by these counts.
The corpus is read twice to learn (counts; descriptions), whatever its size, and what reaches the
driver is one row per bucket and per cell.

Evidence of a positive's own features leaves that document out, so the network sees positives
as it will see new documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.tables import bounded_sample, slices, texts_of, with_fields
from tidewell.session import materialize

#: Hash buckets of features, and letters of the prefixes that are features.
BUCKETS, PREFIXES = 1 << 18, (4, 5, 6)
#: Most labelled positives that training takes (those with the smallest hash of doc_id).
POSITIVES = 12_000
#: Description of a document: which of its strongest evidence (by rank), the step of a cell of these, of the log
#: of their strong sum, and of their density; and how many steps each of the three has.
RANKS, STEPS, LEVELS = (0, 1, 3), (0.4, 0.25, 0.1), (20, 18, 12)
#: Cells of the grid; the ranked values fall, so far fewer can occur.
CELLS = LEVELS[0] ** len(RANKS) * LEVELS[1] * LEVELS[2]
#: Score from which a document is toxic.
THRESHOLD = 0.7
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Entries of a worker's word table.
TABLE_WORDS = 350_000


class _Words(dict):
    """Feature buckets of a word, as bytes."""

    def __missing__(self, word: str) -> bytes:
        plain = word.lower() if word.isalpha() else word.lower().strip(_EDGE)
        parts = [f"={plain}", *(plain[:n] for n in PREFIXES if len(plain) > n)] if plain else []
        found = b"".join([(zlib.crc32(p.encode()) % BUCKETS).to_bytes(4, "little") for p in parts])
        if len(word) <= 40:
            if len(self) >= TABLE_WORDS:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=1)
def _table() -> _Words:
    return _Words()


def features(text: str) -> np.ndarray:
    """Distinct feature buckets of a text, ascending."""
    return np.unique(np.frombuffer(b"".join(map(_table().__getitem__, set(text.split()))), np.int32))


def corpus_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents that hold each bucket, over the whole table and among rows with ``positive``; and how many both are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS + 1), np.int64)  # the last entry counts documents
        for b in slices(batches):
            found = [features(t) for t in texts_of(b)]
            chosen = [f for f, p in zip(found, b.column("positive").to_pylist()) if p]
            for row, own in ((0, found), (1, chosen)):
                if own:
                    total[row, :BUCKETS] += np.bincount(np.concatenate(own), minlength=BUCKETS)
                    total[row, BUCKETS] += len(own)
        at = np.flatnonzero(total[0])
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[0, part]), pa.array(total[1, part])], ["bucket", "n", "p"])

    rows = docs.select("text", "positive").mapInArrow(count, "bucket long, n long, p long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).toArrow()
    out = np.zeros((2, BUCKETS + 1), np.int64)
    at = rows.column("bucket").to_numpy()
    out[0, at], out[1, at] = rows.column("n").to_numpy(), rows.column("p").to_numpy()
    return out[0, :BUCKETS], out[1, :BUCKETS], int(out[0, BUCKETS]), int(out[1, BUCKETS])


def evidence(own: np.ndarray, positive: np.ndarray, n_positive: int, corpus: np.ndarray, n_corpus: int) -> np.ndarray:
    """Log ratio of a bucket's rate in positives to its rate in the corpus, shrunk by how often it was seen."""
    p, c = positive[own], corpus[own]
    expected = np.maximum(c, 0.5) / n_corpus
    ratio = np.log((p + 1.5 * expected) / ((n_positive + 1.5) * expected))
    return ratio * (p / (p + 2.0))


def describe(strength: np.ndarray, n_features: int) -> int:
    """Cell of a document: its strongest evidence, the sum of what is strong, and how dense that is, in steps."""
    best = np.sort(strength)[::-1][: max(RANKS) + 1]
    strong = strength[strength > 1.0]
    values = [(float(best[r]) if r < len(best) else 0.0, STEPS[0], LEVELS[0]) for r in RANKS]
    values += [(float(np.log1p(strong.sum())), STEPS[1], LEVELS[1]), (10 * len(strong) / (n_features + 10), STEPS[2], LEVELS[2])]
    cell = 0
    for value, step, levels in values:
        cell = cell * levels + min(levels - 1, int(max(0.0, value) / step))
    return cell


def inputs(cells: np.ndarray) -> np.ndarray:
    """Network inputs of cells: the steps of each part."""
    levels = [*[LEVELS[0]] * len(RANKS), LEVELS[1], LEVELS[2]]
    return np.stack(np.unravel_index(np.asarray(cells, np.int64), levels), axis=1).astype(float)


class Network:
    """One hidden layer of tanh units, trained by Adam."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, hidden: int = 12, seed: int = 7):
        """``x`` with ``weight`` gives the inputs' mean and spread."""
        rng = np.random.default_rng(seed)
        share = weight / weight.sum()
        self.mean = share @ x
        self.scale = np.sqrt(share @ (x - self.mean) ** 2) + 1e-6
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.w[0] + self.w[1])
        return z, h, h @ self.w[2] + self.w[3]

    def gradient(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Of the sum of ``slope * output``."""
        z, h, _ = self.forward(x)
        back = np.outer(slope, self.w[2]) * (1 - h**2)
        return [z.T @ back, back.sum(axis=0), h.T @ slope, np.array([slope.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[2], -30, 30)))


def nnpu(net: Network, p: np.ndarray, in_p: np.ndarray, u: np.ndarray, in_u: np.ndarray, prior: float) -> tuple[float, float, list[np.ndarray]]:
    """The two parts of the PU risk with the logistic loss (of positives, and of negatives before the bound at 0), and the descent direction.

    ``in_p`` and ``in_u`` are the shares of P and U in each row of ``p`` and ``u``. Where the risk of negatives is
    below 0 the direction steps back from it alone.
    """
    fp, fu = net.forward(p)[2], net.forward(u)[2]
    sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
    positive_risk = prior * float(in_p @ np.logaddexp(0, -fp))
    negative_risk = float(in_u @ np.logaddexp(0, fu)) - prior * float(in_p @ np.logaddexp(0, fp))
    if negative_risk >= 0:
        on_p, on_u = prior * in_p * (sp - 1) - prior * in_p * sp, in_u * su
    else:
        on_p, on_u = prior * in_p * sp, -in_u * su
    return positive_risk, negative_risk, [a + b for a, b in zip(net.gradient(p, on_p), net.gradient(u, on_u))]


def train_nnpu(p: np.ndarray, n_p: np.ndarray, u: np.ndarray, n_u: np.ndarray, prior: float, steps: int = 600, rate: float = 0.02) -> Network:
    """Minimise the non-negative PU risk, full batch; ``n_p`` and ``n_u`` are the documents in each row of ``p`` and ``u``."""
    in_p, in_u = n_p / n_p.sum(), n_u / n_u.sum()
    net = Network(np.concatenate([u, p]), np.concatenate([in_u, 0.1 * in_p]))
    m, v = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w]
    for step in range(1, steps + 1):
        grad = nnpu(net, p, in_p, u, in_u, prior)[2]
        for i, g in enumerate(grad):
            g = g + 1e-4 * net.w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            net.w[i] = net.w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> dict:
    """Train on the rows of ``labels`` (``doc_id, toxic``), which must hold training rows alone.

    ``prior`` is the share of toxic documents in the corpus; by default that among the labelled rows.
    Repeated and null labels are ignored. Without a positive the model is empty and scores 0 everywhere.
    """
    return _learn(docs, labels, prior)[0]


def _learn(docs: DataFrame, labels: DataFrame, prior: float | None) -> tuple[dict, DataFrame | None]:
    """The model, and ``doc_id, cell`` of every document (None with an empty model)."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    chosen = bounded_sample(known.where("toxic = 1").select("doc_id"), "doc_id", POSITIVES).withColumn("positive", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("positive", F.lit(False)).alias("positive"))
    corpus, positive, n_corpus, n_positive = corpus_counts(marked)
    if not n_positive:
        return {}, None
    weights = evidence(np.arange(BUCKETS), positive, n_positive, corpus, n_corpus).astype(np.float32)
    described, _ = materialize(_described(marked, weights, (positive, n_positive, corpus, n_corpus)), "described")
    u = described.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toArrow()
    p = described.where("own_cell is not null").groupBy("own_cell").agg(F.count(F.lit(1)).alias("n")).toArrow()
    sides = []
    for rows in (p, u):
        pairs = np.array(sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())), np.int64)
        sides += [inputs(pairs[:, 0]), pairs[:, 1].astype(float)]
    net = train_nnpu(*sides, float(prior if prior is not None else min(max(share, 0.001), 0.5)))
    return {"net": net, "weights": weights}, described.select("doc_id", "cell")


def _described(marked: DataFrame, weights: np.ndarray, counts: tuple) -> DataFrame:
    """``doc_id, cell`` of every document, and of positives ``own_cell``, by evidence without the document itself."""
    spread = marked.sparkSession.sparkContext.broadcast((weights, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, (positive, n_positive, corpus, n_corpus) = spread.value

        def without_itself(x: np.ndarray) -> int:
            return describe(evidence(np.arange(len(x)), positive[x] - 1, n_positive - 1, np.maximum(corpus[x] - 1, 0), n_corpus), len(x))

        for b in slices(batches):
            found = [features(t) for t in texts_of(b)]
            cells = [describe(weights[f], len(f)) for f in found]
            own = [without_itself(f) if p else None for f, p in zip(found, b.column("positive").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cells, pa.int64()), pa.array(own, pa.int64())], ["doc_id", "cell", "own_cell"])

    return marked.mapInArrow(run, "doc_id long, cell long, own_cell long")


def _scores(model: dict, cells: np.ndarray) -> np.ndarray:
    if not model:
        return np.zeros(len(cells))
    distinct, at = np.unique(cells, return_inverse=True)
    return model["net"].score(inputs(distinct))[at]


def score(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` to the columns ``keep`` (all by default).

    Null and empty texts get the score of a document without evidence. Columns named ``score``
    or ``predicted`` are replaced. Repeated rows score alike; an empty table stays empty.
    """
    frame = docs.drop("score", "predicted")
    names = [c for c in (keep or frame.columns) if c != "text"]
    whole = "text" in (keep or frame.columns)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for b in slices(batches):
            found = [features(t) for t in texts_of(b)] if own else []
            values = _scores(own, np.array([describe(own["weights"][f], len(f)) for f in found], np.int64)) if own else np.zeros(b.num_rows)
            kept = [c for c in b.schema.names if c != "text" or whole]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(values, pa.float64()), pa.array((values >= THRESHOLD).astype(np.int32))], [*kept, "score", "predicted"])

    chosen = frame.select(*[c for c in frame.columns if c in names or c == "text"])
    out = (chosen if whole else chosen.drop("text")).schema
    return chosen.mapInArrow(run, with_fields(out, "score double, predicted int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; learns from labels that are not held out.

    Scores come from the descriptions that training wrote, so texts are not read a third time.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    model, described = _learn(docs, labels.where(~held_out(F.col("doc_id"))), None)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = _scores(spread.value, b.column("cell").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values, pa.float64()), pa.array((values >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    cells = described if described is not None else docs.select("doc_id", F.lit(0).cast("long").alias("cell"))
    scored = cells.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
