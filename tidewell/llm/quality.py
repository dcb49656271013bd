"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Random indexing (Sahlgren 2005): every word has a fixed sparse random vector, and its word
vector is the sum of the random vectors of its neighbours in the whole corpus. Words are hashed
to buckets and split into a core, its final marks and its shape, so the table has a fixed size.
The sums are integers per cell of that table, added in SQL across tasks, so they come out the
same however the corpus is split.

A document is pooled to the mean and the spread of its word vectors. The network (tanh units,
numpy) is trained on a bounded sample of labelled documents; a temperature fitted on a part of
it that training leaves out calibrates its probabilities.
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

#: Hash buckets of words, dimensions of vectors, and non-zero entries of a random vector.
BUCKETS, DIMENSIONS, NONZERO = 1 << 12, 32, 4
#: Most labelled documents that training takes (those with the smallest hash of doc_id).
LABELLED = 20_000
#: Score from which a document's quality is good.
THRESHOLD = 0.3
#: Entries of a worker's word table.
TABLE_WORDS = 500_000
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _bucket_bytes(token: str) -> bytes:
    return (zlib.crc32(token.encode()) % BUCKETS).to_bytes(4, "little")


@lru_cache(maxsize=1024)
def _shape_bytes(case: str, length: int) -> bytes:
    return _bucket_bytes(f"#{case}{length}")


def _shape(core: str) -> bytes:
    case = "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "N" if core.isdigit() else "l"
    return _shape_bytes(case, min(len(core), 20) // 4)


class _Words(dict):
    """Buckets of a word's parts, as bytes."""

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            found = _bucket_bytes("=" + word.lower()) + _shape(word)
        else:
            core = word.strip(_MARKS)
            before, after = (word[: word.index(core)], word[word.index(core) + len(core) :]) if core else (word, "")
            found = b"".join((
                _bucket_bytes("<" + before[:3]) if before else b"",
                _bucket_bytes("=" + core.lower()) + _shape(core) if core else b"",
                _bucket_bytes(">" + after[:3]) if after else b"",
            ))
        if len(word) <= 40:
            if len(self) >= TABLE_WORDS:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=1)
def _table() -> _Words:
    return _Words()


def tokens(text: str) -> np.ndarray:
    """Buckets of a text's word parts, in order."""
    return np.frombuffer(b"".join(map(_table().__getitem__, text.split())), np.int32)


@lru_cache(maxsize=1)
def random_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's random vector."""
    rng = np.random.default_rng(20)
    places = np.array([rng.choice(DIMENSIONS, NONZERO, replace=False) for _ in range(BUCKETS)], np.int64)
    return places, rng.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


def _neighbour_sums(ids: list[np.ndarray]) -> np.ndarray:
    """Sums of the random vectors of neighbours (distance 1 and 2), per bucket."""
    places, signs = random_vectors()
    flat = np.concatenate(ids).astype(np.int64)
    of = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    total = np.zeros(BUCKETS * DIMENSIONS)
    for apart in (1, 2):
        same = of[apart:] == of[:-apart]
        a, b = flat[:-apart][same], flat[apart:][same]
        for word, other in ((a, b), (b, a)):
            for k in range(NONZERO):
                total += np.bincount(word * DIMENSIONS + places[other, k], weights=signs[other, k], minlength=len(total))
    return total.astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors of all buckets from the whole table. ``BUCKETS * DIMENSIONS`` numbers reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIMENSIONS, np.int64)
        for b in slices(batches):
            total += _neighbour_sums([tokens(t) for t in texts_of(b)])
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["cell", "n"])

    rows = docs.select("text").mapInArrow(add, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(BUCKETS * DIMENSIONS)
    sums[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    vectors = sums.reshape(BUCKETS, DIMENSIONS)
    vectors -= vectors.sum(axis=0) / max(1.0, np.abs(vectors).sum()) * np.abs(vectors).sum(axis=1, keepdims=True)  # the corpus's common direction
    return (vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a document's word vectors, likeness of neighbours, and log length."""
    if not len(ids):
        return np.zeros(2 * DIMENSIONS + 2, np.float32)
    own = vectors[ids]
    mean = own.mean(axis=0)
    likeness = (own[1:] * own[:-1]).sum(axis=1).mean() if len(own) > 1 else 0.0
    return np.concatenate([mean, own.std(axis=0), [likeness, np.log1p(len(ids))]]).astype(np.float32)


class Network:
    """Input, tanh layer, logistic output; trained by Adam on mini-batches of a fixed order."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = x.mean(axis=0), x.std(axis=0) + 1e-6, 1.0
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
        m, v, step = [0 * w for w in self.w], [0 * w for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                at = order[i : i + 256]
                z = self._scaled(x[at])
                h = np.tanh(z @ self.w[0] + self.w[1])
                slope = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - y[at]) / len(at)
                back = np.outer(slope, self.w[2]) * (1 - h**2)
                step += 1
                for j, g in enumerate((z.T @ back, back.sum(axis=0), h.T @ slope, np.array([slope.sum()]))):
                    g = g + 1e-4 * self.w[j]
                    m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                    self.w[j] = self.w[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of the least log loss."""
        logit = self.logit(x)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
        loss = [np.logaddexp(0, np.where(y > 0, -logit, logit) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Train on the rows of ``labels`` (``doc_id, quality``), which must hold training rows alone.

    Of contradictory labels the lower counts; null ones are ignored. With labels of one kind only
    (or none) the model scores every document as that kind (or 0.5).
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    vectors = word_vectors(docs)
    rows = _pooled_rows(docs.join(F.broadcast(bounded_sample(known, "doc_id", LABELLED)), "doc_id").select("doc_id", "text", "quality"), vectors)
    if not rows:
        return {"constant": 0.5}
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    if y.min() == y.max():
        return {"constant": float(y[0])}
    part = np.array([zlib.crc32(b"calibrate %d" % r[0]) % 5 == 0 for r in rows])
    net = Network(x[~part], y[~part])
    if part.any():
        net.calibrate(x[part], y[part])
    return {"vectors": vectors, "net": net}


def _pooled_rows(texts: DataFrame, vectors: np.ndarray) -> list[tuple]:
    """Pooled vectors of a bounded sample, on the driver, ordered by doc_id."""
    spread = texts.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [pooled(tokens(t), spread.value).tobytes() for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary()), b.column("quality")], ["doc_id", "x", "quality"])

    rows = texts.select(F.col("doc_id").cast("long"), "text", "quality").mapInArrow(run, "doc_id long, x binary, quality int").toArrow().to_pylist()
    return sorted([(r["doc_id"], np.frombuffer(r["x"], np.float32), r["quality"]) for r in rows], key=lambda r: (r[0], r[1].tobytes()))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Add ``score`` (0 to 1, higher: better) and ``predicted`` to a table; columns so named are replaced.

    Null and empty texts get the score of a document without words. Repeated rows score alike;
    an empty table stays empty.
    """
    frame = docs.drop("score", "predicted")
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for b in slices(batches):
            if "net" in own:
                values = own["net"].score(np.array([pooled(tokens(t), own["vectors"]) for t in texts_of(b)]))
            else:
                values = np.full(b.num_rows, own["constant"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.float64()), pa.array((values >= THRESHOLD).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return frame.mapInArrow(run, with_fields(frame.schema, "score double, predicted int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; learns from labels that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
