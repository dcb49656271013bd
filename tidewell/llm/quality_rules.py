"""Quality rules: counts of a document, and line labelling by a linear-chain conditional random field.

Each line has features (its words, marks, letters, repetition); a CRF with the labels
boilerplate and content scores label sequences by line weights and transitions, and Viterbi
decoding marks every line of a document. The share of characters in content lines decides
retention. Weights are trained here, by gradient ascent on the likelihood (forward and backward
sums), from lines of documents of known quality: those of a good document count as content,
those of a bad one as boilerplate. Most training sequences are good documents with lines of bad
ones spliced in before, after or between theirs, so the chain learns how labels change and marks
menus and footers round an article line by line.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.tables import bounded_sample, slices, texts_of

#: Least words of a document, and greatest share (percent) of words in repeated windows of five.
LEAST_WORDS, REPEATED_PERCENT = 10, 20
#: Least share of characters in content lines.
CONTENT_SHARE = 0.5
#: Most labelled documents that training takes (those with the smallest hash of doc_id), and most
#: successive lines of each of them (from a line chosen by hash). Judging reads whole texts.
LABELLED, TRAINING_LINES = 2000, 120
#: Lines whose features are held at once.
BLOCK_LINES = 4096
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_SYMBOL_BYTES, _UPPER_BYTES, _DIGIT_BYTES = b"#*$%&|<>!=_~^", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
FEATURES = ("bias", "words", "distinct", "symbols", "upper", "digits", "ends", "word_length", "repeated", "blank")


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """Words that lie in a ``k``-word window found twice or more in ``words``, the first included."""
    n = len(words)
    if n <= k:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    code = ids
    for step in range(1, k):  # ids of windows that grow by a word; stop when none repeats
        code = code[:-1] * len(seen) + ids[step:]
        values, code, counts = np.unique(code, return_inverse=True, return_counts=True)
        if len(values) == len(code):
            return 0
    starts = np.flatnonzero(counts[code] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return len(words), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def line_features(text: str, start: int = 0, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of lines, and their characters, in blocks; of all lines, or ``most`` from line ``start`` on."""
    out, sizes, seen = [], [], set()
    for i, line in enumerate(text.split("\n")):
        if most is not None and i >= start + most:
            break
        known = line in seen
        if not known:
            seen.add(line)
        if i < start:
            continue
        raw = line.encode()
        words = raw.split()
        n, size = len(words), max(1, len(raw))
        out.append((
            1.0, min(n, 200) / 50, len(set(words)) / n if n else 1.0, 4 * (len(raw) - len(raw.translate(None, _SYMBOL_BYTES))) / size,
            (len(raw) - len(raw.translate(None, _UPPER_BYTES))) / size, (len(raw) - len(raw.translate(None, _DIGIT_BYTES))) / size,
            float(raw.rstrip()[-1:] in b".?!:;") if n else 0.0, min(size / n, 40) / 10 if n else 0.0, float(n > 0 and known), float(n == 0),
        ))
        sizes.append(len(line))
        if len(out) == BLOCK_LINES:
            yield np.array(out), np.array(sizes, np.int64)
            out, sizes = [], []
    if out:
        yield np.array(out), np.array(sizes, np.int64)


class Padded:
    """Training sequences side by side, longest first, so that at each step those that go on are a prefix."""

    def __init__(self, docs: list[np.ndarray], labels: list[np.ndarray]):
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        self.lengths = np.array([len(docs[i]) for i in order])
        self.active = np.array([np.searchsorted(-self.lengths, -t, side="left") for t in range(self.lengths[0] + 1)])  # sequences of more than t lines
        self.x = np.zeros((self.lengths[0], len(docs), len(FEATURES)))
        self.seen_w, self.seen_m = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
        for j, i in enumerate(order):
            x, y = docs[i], np.asarray(labels[i], np.int64)
            self.x[: len(x), j] = x
            np.add.at(self.seen_w.T, y, x)
            np.add.at(self.seen_m, (y[:-1], y[1:]), 1.0)


class Chain:
    """Linear-chain CRF with two labels (0 boilerplate, 1 content)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves  # (features, 2), (2, 2)

    def lean(self, x: np.ndarray) -> np.ndarray:
        """By how much the features of lines speak for content."""
        return x @ (self.weights[:, 1] - self.weights[:, 0])

    def viterbi(self, lean: np.ndarray) -> np.ndarray:
        """The likeliest labels of a document's lines; ties go to content.

        With two labels only the difference of the best scores that end in each is needed, so
        a text of millions of lines takes a few bytes a line.
        """
        if not len(lean):
            return np.zeros(0, np.int8)
        (m00, m01), (m10, m11) = self.moves.tolist()
        ahead, back = float(lean[0]), (bytearray(len(lean)), bytearray(len(lean)))
        for t in range(1, len(lean)):
            to_0, to_1 = ahead + m10, ahead + m11  # from content; from boilerplate the moves alone
            back[0][t], back[1][t] = to_0 >= m00, to_1 >= m01
            ahead = float(lean[t]) + max(m01, to_1) - max(m00, to_0)
        labels, label = bytearray(len(lean)), int(ahead >= 0)
        for t in range(len(lean) - 1, -1, -1):
            labels[t] = label
            label = back[label][t]
        return np.frombuffer(labels, np.int8)

    def likelihood(self, data: Padded) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of the labels, and its gradient by weights and moves, by forward and backward sums."""
        x, lengths, active = data.x, data.lengths, data.active
        long, n = x.shape[:2]
        emit = x @ self.weights
        ahead = np.zeros((long, n, 2))
        ahead[0] = emit[0]
        for t in range(1, long):
            k = active[t]
            s = ahead[t - 1, :k, :, None] + self.moves
            ahead[t, :k] = np.logaddexp(s[:, 0], s[:, 1]) + emit[t, :k]
        last = ahead[lengths - 1, np.arange(n)]
        z = np.logaddexp(last[:, 0], last[:, 1])
        behind, want_w, want_m = np.zeros((n, 2)), np.zeros_like(self.weights), np.zeros((2, 2))
        for t in range(long - 1, -1, -1):
            k = active[t]
            p = np.exp(ahead[t, :k] + behind[:k] - z[:k, None])
            want_w += x[t, :k].T @ p
            if t:
                into = emit[t, :k] + behind[:k]
                both = ahead[t - 1, :k, :, None] + self.moves + into[:, None, :]
                want_m += np.exp(both - z[:k, None, None]).sum(axis=0)
                s = self.moves + into[:, None, :]
                behind[:k] = np.logaddexp(s[:, :, 0], s[:, :, 1])
        value = float((data.seen_w * self.weights).sum() + (data.seen_m * self.moves).sum() - z.sum())
        return value, data.seen_w - want_w, data.seen_m - want_m

    @classmethod
    def train(cls, docs: list[np.ndarray], labels: list[np.ndarray], steps: int = 80, rate: float = 0.1) -> Chain:
        """Maximise the log likelihood of the labels of lines, by Adam."""
        data = Padded(docs, labels)
        self = cls(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))
        m, v = [0.0, 0.0], [0.0, 0.0]
        for step in range(1, steps + 1):
            grads = self.likelihood(data)[1:]
            for i, name in enumerate(("weights", "moves")):
                now = getattr(self, name)
                g = grads[i] / data.lengths.sum() - 1e-3 * now
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                setattr(self, name, now + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8))
        return self


def spliced(good: list[np.ndarray], bad: list[np.ndarray], seed: int = 3) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Training sequences: the bad, and the good with up to ten lines of bad ones before, after, between or (one in four) nowhere."""
    rng = np.random.default_rng(seed)
    docs, labels = list(bad), [np.zeros(len(x), np.int64) for x in bad]
    for i, x in enumerate(good):
        cuts = {0: [], 1: [0], 2: [len(x)], 3: [0, int(rng.integers(0, len(x) + 1))]}[i % 4]
        y = np.ones(len(x), np.int64)
        for at in sorted(cuts, reverse=True):
            menu = bad[int(rng.integers(len(bad)))]
            first = int(rng.integers(len(menu)))
            menu = menu[first : first + int(rng.integers(1, 11))]
            x, y = np.concatenate([x[:at], menu, x[at:]]), np.concatenate([y[:at], np.zeros(len(menu), np.int64), y[at:]])
        docs.append(x)
        labels.append(y)
    return docs, labels


def fit(docs: DataFrame, labels: DataFrame) -> Chain | None:
    """Train on a bounded sample of labelled documents; None where labels of both kinds are not at hand.

    Null labels are ignored, and of contradictory ones the lower counts.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    halves = [bounded_sample(known.where(f"quality = {c}"), "doc_id", LABELLED // 2) for c in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(halves[0].unionAll(halves[1])), "doc_id").select(F.col("doc_id").cast("long"), "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for i, t in zip(b.column("doc_id").to_pylist(), texts_of(b)):
                start = zlib.crc32(b"lines %d" % i) % max(1, t.count("\n") + 2 - TRAINING_LINES)
                out.append(b"".join(x.astype(np.float32).tobytes() for x, _ in line_features(t, start, TRAINING_LINES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(out, pa.binary())], ["doc_id", "quality", "x"])

    found = rows.mapInArrow(run, "doc_id long, quality int, x binary").toArrow().to_pylist()
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    lines = {c: [np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)).astype(float) for r in found if r["quality"] == c] for c in (0, 1)}
    if not lines[0] or not lines[1]:
        return None
    return Chain.train(*spliced(lines[1], lines[0]))


_RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, content_lines string"


def judge(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """One row per input row: the counts, ``base_failed``, ``kept``, ``content_share``, ``content_lines``.

    ``content_lines`` holds one character per line: ``1`` content, ``0`` boilerplate. Without a
    ``chain`` every line is content. Null and empty texts have no words, so they fail the base
    rules. Repeated rows are judged each; other columns are ignored; an empty table gives an
    empty result.
    """
    spread = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for b in slices(batches, rows=256, size=2 << 20):
            texts = texts_of(b)
            base = [counts(t) for t in texts]
            marked, share = [], []
            for t in texts:
                blocks = [(own.lean(x) if own else np.zeros(len(x)), size) for x, size in line_features(t)]
                lean, size = (np.concatenate(x) for x in zip(*blocks))
                label = own.viterbi(lean) if own else np.ones(len(lean), np.int8)
                marked.append((label + 48).astype(np.uint8).tobytes().decode())
                share.append(float((size * label).sum() / size.sum()) if size.sum() else 0.0)
            failed = [n < LEAST_WORDS or 100 * r > REPEATED_PERCENT * n for n, _, _, _, r in base]
            kept = [not f and s >= CONTENT_SHARE for f, s in zip(failed, share)]
            columns = [b.column("doc_id"), *(pa.array([x[i] for x in base], pa.int64()) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(share), pa.array(marked)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _RESULT)
