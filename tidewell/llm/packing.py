"""Lexical retrieval packing: windows filled by BM25 neighbours of a seed document.

Documents are tokenised once into a table, each distinct word of some hundred documents once; each
task also leaves the number of its documents that hold each token, so document frequencies over the
whole corpus (one number per vocabulary entry) come from that table without another pass over texts.

As many ids as fill windows of their own do so where they stand: such windows need no neighbours
and are never shuffled. What is left of a document, less than a window, is its rest. Rests are
range partitioned and sorted by a lexical key, the tokens that weigh most in the whole document,
so related ones come together wherever the table holds them, a frequent first token is split by
the next ones, and no row of the shuffle is larger than a window. The bounds of partitions come from the keys
of some documents, as Spark's own do, but without computing all keys once more. Rests are read in runs, each run
a shard with its own inverted index of rests; retrieval and filling happen inside a shard, so a
task holds one shard at a time whatever the input's size. Other shards are not asked: README
gives the share of true neighbours found.

A rest may be cut: a neighbour longer than the free space fills it, and what remains stays in
the pool. So only the last window of a shard is not full.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewell.llm import bpe
from tidewell.llm.tables import slices
from tidewell.session import scratch_path

#: Ids of a window, the id that ends a document, and ids of a shard's rests (one window in 512 may be padded).
WINDOW, END, SHARD_TOKENS = 1024, 0, 1 << 19
#: Shards of a partition, about, and tokens of a document's key.
PARTITION_SHARDS, KEY_TOKENS = 8, 4
#: Documents, about, whose keys set the bounds of a partition, and of all.
BOUND_DOCUMENTS, BOUNDS_DOCUMENTS = 200, 1_000_000
#: BM25 saturation and length normalisation.
K1, B = 1.2, 0.75

#: Sequence ids of windows that one document fills have this bit; task and count follow it in all of them.
_OWN, _TASK = 1 << 61, 1 << 32
#: ``at`` numbers a document's windows across the table; ``whole`` fills them and ``rest`` is left.
_TOKENS = "doc_id long, at long, whole binary, rest binary, n_tokens long, n_rest long, frequencies binary, n_docs long"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: The split of byte-level tokenizers files (fixed value), and characters that any Unicode version classes alike.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER = re.compile("[^\x00-\u024f]")
#: Bytes of white space that words are cut at; documents whose tokens are marked at once.
_SPACE, _MARKED = np.isin(np.arange(256), [32, *range(9, 14)]), 64


class Ids:
    """Ids of a tokenizers file, by the quicker tiktoken wherever both libraries are bound to agree.

    That is where the file is plain byte-level BPE whose ids follow its merges (so ids are ranks),
    for texts of Latin characters; all other texts, and those that hold an added token, are encoded by the tokenizers library.
    """

    def __init__(self, path: str):
        self.codec = bpe.codec(path)
        self.size = len(self.codec.bytes_of)
        self.width = np.array([len(x) for x in self.codec.bytes_of], np.int32)
        self.plain = None
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, split = made["model"], made["pre_tokenizer"] or {}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        usual = not made["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if usual and merged == sorted(merged) and not model.get("ignore_merges"):
            ranks = {self.codec.bytes_of[i]: i for i in model["vocab"].values()}
            self.plain = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.plain is None or _OTHER.search(text) or self.codec.has_added(text):
            return self.codec.encode(text)
        return array("I", self.plain.encode_ordinary(text)).tobytes()

    def encode_all(self, texts: pa.Array, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each ``rows`` texts, their ids one after another and how many each has; null is empty. The ids are those of ``encode``.

        Each distinct word is encoded once, with the white space before it: the splitting pattern always
        begins a match at white space that follows a word, and looks no further back.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        data, ends = _bytes_of(texts)
        starts = np.append(np.flatnonzero(self._cuts(data, ends, texts)), len(data))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        known, first, count = self._encode_words(words.dictionary)
        word, bounds = words.indices.to_numpy(), np.searchsorted(starts, ends)
        for i in range(0, len(texts), rows):
            at = bounds[i : i + rows + 1]
            own = word[at[0] : at[-1]]
            n = count[own]
            held = np.append(0, np.cumsum(n))
            yield known[np.repeat(first[own] - held[:-1], n) + np.arange(held[-1])], np.diff(held[at - at[0]])

    def _cuts(self, data: np.ndarray, ends: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Where words begin: at the start of texts, and at white space of ASCII after what is none for certain.

        A text that holds an added token is one word, and so is each if the file is not one for tiktoken.
        """
        cut = np.zeros(len(data), bool)
        if self.plain is not None:
            cut[1:] = _SPACE[data[1:]] & _no_space(data)[:-1]
            for token in self.codec.added:
                for i in np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist():
                    cut[ends[i] : ends[i + 1]] = False
        cut[ends[:-1][ends[:-1] < ends[1:]]] = True
        return cut

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in some order, where those of each word begin, and how many it has.

        Latin words that could be cut on both sides go through tiktoken as one text; the widths of its tokens say where each ends.
        """
        data, ends = _bytes_of(words)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = _SPACE[data[ends[:-1]]] & _no_space(data)[ends[1:] - 1] & np.logical_and.reduceat(data < 0xC9, ends[:-1])
        for token in self.codec.added:
            joined &= ~pc.match_substring(words, token).to_numpy(zero_copy_only=False)
        joined &= self.plain is not None
        count, text = np.zeros(len(words), np.int64), _bytes_of(words.filter(pa.array(joined)))[0].tobytes().decode()
        ids = [array("I", self.plain.encode_ordinary(text)).tobytes() if text else b""]
        held = np.searchsorted(np.cumsum(self.width[np.frombuffer(ids[0], "<u4")]), np.cumsum(np.diff(ends)[joined]), "right")
        count[joined] = np.diff(held, prepend=0)
        ids += [self._encode_word(w.decode()) for w in words.filter(pa.array(~joined)).to_pylist()]
        count[~joined] = [len(x) // 4 for x in ids[1:]]
        first = np.zeros(len(words), np.int64)
        order = np.append(np.flatnonzero(joined), np.flatnonzero(~joined))
        first[order] = np.cumsum(count[order]) - count[order]
        return np.frombuffer(b"".join(ids), "<u4"), first, count

    def _encode_word(self, word: str) -> bytes:
        rest = word[1:]
        if self.plain is not None and word[0] in " \n" and rest.split() == [rest] and _OTHER.search(rest) and not self.codec.has_added(word):
            return self.codec.spaced[rest] if word[0] == " " else self.codec.feed + self.codec.first[rest]
        return self.encode(word)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array with large offsets and no nulls, and where each value begins and the last ends."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def _no_space(data: np.ndarray) -> np.ndarray:
    """Bytes that end a character which is white space in no library: not below U+0021, from U+0080 to U+00BF or from U+1000 to U+3FFF."""
    out = data > 32
    out[1:] &= (data[1:] < 0x80) | (data[:-1] != 0xC2)
    out[2:] &= (data[2:] < 0x80) | (data[1:-1] < 0x80) | (data[:-2] < 0xE1) | (data[:-2] > 0xE3)
    return out


def _holders(ids: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """How many documents hold each token; ``ends`` says where each document begins and the last ends."""
    total, seen = np.zeros(size, np.uint32), np.zeros((_MARKED, size), np.uint8)
    for i in range(0, len(ends) - 1, _MARKED):
        own = ends[i : i + _MARKED + 1]
        seen[:] = 0
        seen[np.repeat(np.arange(len(own) - 1), np.diff(own)), ids[own[0] : own[-1]]] = 1
        total += seen.sum(0, dtype=np.uint8)
    return total


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def tokenised(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Write the token table: ids with the end id, cut at the last full window, and one row per task with its counts."""
    spark = docs.sparkSession
    schema = to_arrow_schema(StructType.fromDDL(_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ids_of(path)
        frequency, rows, total, rests = np.zeros(own.size, np.uint32), 0, 0, 0
        at = TaskContext.get().partitionId() * _TASK
        for b, found, n in ((b.slice(256 * i, 256), *x) for b in slices(batches, rows=1280, size=4 << 20) for i, x in enumerate(own.encode_all(b.column("text"), 256))):
            ids = np.full(len(found) + len(n), END, "<u4")
            ids[np.arange(len(found)) + np.repeat(np.arange(len(n)), n)] = found
            lengths = n + 1
            ends = np.append(0, np.cumsum(lengths))
            frequency += _holders(ids, ends, own.size)
            cut = lengths // window * window
            first = at + np.cumsum(cut // window + 1) - (cut // window + 1)
            rows, total, rests, at = rows + len(n), total + int(lengths.sum()), rests + int((lengths - cut).sum()), int(first[-1] + cut[-1] // window + 1)
            whole, rest = ([ids[a:b].tobytes() for a, b in zip(x.tolist(), y.tolist())] for x, y in ((ends[:-1], ends[:-1] + cut), (ends[:-1] + cut, ends[1:])))
            none = pa.nulls(len(n))
            columns = [b.column("doc_id"), first, whole, rest, lengths, lengths - cut, none, none]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for x, f in zip(columns, schema)], schema=schema)
        counts = [None, None, None, None, total, rests, frequency.tobytes(), rows]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(counts, schema)], schema=schema)

    table = scratch_path(spark, "tokens")
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _TOKENS).write.option("compression", "zstd").parquet(table)
    return spark.read.schema(_TOKENS).parquet(table)


class Counts(NamedTuple):
    """Documents that hold each token, documents, tokens, and tokens of rests, over the whole corpus."""

    df: np.ndarray
    docs: int
    tokens: int
    rests: int


def corpus_counts(tokens: DataFrame) -> Counts:
    """Only the rows of counts are read. One number per vocabulary entry reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = None, np.zeros(3, np.int64)
        for b in batches:
            sums += [sum(b.column(c).to_pylist()) for c in ("n_docs", "n_tokens", "n_rest")]
            for x in b.column("frequencies").to_pylist():
                part = np.frombuffer(x, np.uint32).astype(np.int64)
                total = part if total is None else total + part
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-3, -2, -1], at])), pa.array(np.concatenate([sums, total[at]]))], ["token", "n"])

    counts = tokens.where("frequencies is not null").select("n_tokens", "n_rest", "frequencies", "n_docs")
    rows = counts.mapInArrow(add, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(max(rows.column("token").to_pylist(), default=-1) + 4, np.int64)
    found[rows.column("token").to_numpy() + 3] = rows.column("n").to_numpy()
    return Counts(found[3:], *found[:3].tolist())


def keys(ids: list[np.ndarray], idf: np.ndarray, rank: np.ndarray, mean_length: float) -> list[bytes]:
    """Each document's key: the ranks of its tokens of greatest BM25 weight, big-endian, so that keys sort as bytes.

    Tokens of rank -1 take no part; a document without others has an empty key.
    """
    lengths = np.array([len(x) for x in ids], np.int64)
    flat, of = np.concatenate(ids).astype(np.int64), np.repeat(np.arange(len(ids)), lengths)
    useful = rank[flat] >= 0
    pairs, tf = np.unique(of[useful] * len(rank) + flat[useful], return_counts=True)
    doc, term = pairs // len(rank), pairs % len(rank)
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean_length))
    best = np.full((KEY_TOKENS, len(ids)), -1, np.int64)
    start = np.flatnonzero(np.diff(doc, prepend=-1))
    for place in best if len(doc) else ():  # one after another, as few are kept; ties: the smaller token
        most = np.maximum.reduceat(weight, start)
        at = np.flatnonzero(weight == np.repeat(most, np.diff(start, append=len(doc))))
        at = at[np.diff(doc[at], prepend=-1) > 0]
        at = at[most > -np.inf]
        place[doc[at]] = rank[term[at]]
        weight[at] = -np.inf
    ranks, n = best.T.astype(">u4"), (best >= 0).sum(0)
    return [x[:k].tobytes() for x, k in zip(ranks, n.tolist())]


def by_content(tokens: DataFrame, counts: Counts, idf: np.ndarray, shard_tokens: int) -> DataFrame:
    """``doc_id, n_tokens, rest`` in the order of the documents' keys, in partitions of a few shards.

    Tokens that too few documents hold to fill half a shard would only bring copies together, so they are left out.
    """
    mean_length = max(1, counts.tokens) / max(1, counts.docs)
    used = (idf > 0) & (counts.df >= max(2, shard_tokens * counts.docs / max(1, counts.rests) / 2))
    rank = np.full(len(counts.df), -1, np.int64)
    rank[np.argsort(counts.df, kind="stable")] = np.arange(len(counts.df))
    rank[~used] = -1

    rests = tokens.where("n_rest > 0 and frequencies is null").select("doc_id", "at", "n_tokens", "whole", "rest")

    def keyed(rows: DataFrame, bounds: list[tuple[bytes, int]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "whole", rows=256, size=4 << 20):
                ids = [np.frombuffer(w + r, "<u4") for w, r in zip(b.column("whole").to_pylist(), b.column("rest").to_pylist())]
                own = keys(ids, idf, rank, mean_length)
                part = [bisect_right(bounds, x) for x in zip(own, b.column("at").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "at", "n_tokens", "rest")), pa.array(own, pa.binary()), pa.array(part, pa.int32())], ["doc_id", "at", "n_tokens", "rest", "key", "part"])

        return rows.mapInArrow(run, "doc_id long, at long, n_tokens long, rest binary, key binary, part int")

    parts, bounds = max(1, counts.rests // (PARTITION_SHARDS * shard_tokens)), []
    if parts > 1:
        every = max(1, counts.docs // min(BOUND_DOCUMENTS * parts, BOUNDS_DOCUMENTS))
        some = keyed(rests.where(F.pmod(F.xxhash64("at"), F.lit(every)) == 0), []).select("key", "at").toArrow()
        some = sorted(zip(some.column("key").to_pylist(), some.column("at").to_pylist()))
        bounds = [some[len(some) * i // parts] for i in range(1, parts)] if some else []
    return keyed(rests, bounds).repartitionById(parts, "part").sortWithinPartitions("key", "at").select("doc_id", "n_tokens", "rest")


def own_windows(tokens: DataFrame, window: int) -> DataFrame:
    """Pieces of the windows that documents fill by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "whole", rows=256, size=4 << 20):
            n = pc.binary_length(b.column("whole")).to_numpy() // (4 * window)
            of = np.repeat(np.arange(b.num_rows), n)
            count = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            whole, same = b.column("whole").to_pylist(), np.full(len(of), window)
            ids = [whole[d][4 * window * i : 4 * window * (i + 1)] for d, i in zip(of.tolist(), count.tolist())]
            cols = [b.column("doc_id").take(pa.array(of)), count * window, same, b.column("n_tokens").take(pa.array(of)), b.column("at").to_numpy()[of] + count + _OWN, same * 0, ids]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return tokens.where("n_tokens > n_rest and frequencies is null").select("doc_id", "at", "n_tokens", "whole").mapInArrow(run, _PIECES)


class Shard:
    """Rests of a shard, each shorter than a window, with their inverted index."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.ids = ids
        n = len(ids)
        lengths = np.array([len(x) for x in ids], np.int64)
        flat, of = np.concatenate(ids).astype(np.int64), np.repeat(np.arange(n), lengths)
        useful = idf[flat] > 0  # tokens in over half of all documents weigh nothing
        pairs, tf = np.unique(flat[useful] * n + of[useful], return_counts=True)
        term, self.doc = pairs // n, pairs % n
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / mean_length))
        self.start = np.searchsorted(term, np.arange(len(idf) + 1))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every document for the distinct tokens of ``query``."""
        terms = np.unique(query)
        first, count = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=len(self.ids))

    def pack(self, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
        """Pieces ``(rest, start, length, sequence, offset)``; sequences count from 0 and have no gaps."""
        sequence = 0
        used = np.zeros(len(self.ids), np.int64)  # how many ids of each rest are packed
        left = np.array([len(x) for x in self.ids], np.int64)
        for seed in np.argsort(-left, kind="stable").tolist():
            if not left[seed]:
                continue
            taken, free = [(seed, int(left[seed]))], window - int(left[seed])
            query = self.ids[seed][used[seed] :]
            unused = left > 0
            unused[seed] = False
            pool = np.flatnonzero(unused)
            if free and len(pool):
                score = self.scores(query)[pool]
                for d in pool[np.argsort(-score, kind="stable")].tolist():
                    take = min(free, int(left[d]))
                    taken.append((d, take))
                    free -= take
                    if not free:
                        break
            offset = 0
            for d, take in taken:
                yield d, int(used[d]), take, sequence, offset
                used[d] += take
                left[d] -= take
                offset += take
            sequence += 1


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (little-endian unsigned 32-bit).

    ``path`` is a tokenizers file. Null and empty texts are documents of the end id alone.
    Rows that repeat a ``doc_id`` or a text are packed like others; a null ``doc_id`` passes
    through. Long texts fill windows of their own and their rest is pooled. Other columns
    are ignored. An empty table gives an empty result.
    """
    tokens = tokenised(docs, path, window)
    counts = corpus_counts(tokens)
    idf = np.maximum(0, np.log((counts.docs - counts.df + 0.5) / (counts.df + 0.5))).astype(np.float32)
    mean_rest = max(1, counts.rests) / max(1, counts.docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() * _TASK
        names, sizes, ids, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, names, sizes, ids, held
            pieces = np.array(list(Shard(ids, idf, mean_rest).pack(window)), np.int64)
            name, size, length = pa.array(names, pa.int64()), np.array(sizes), np.array([len(x) for x in ids])
            for i in range(0, len(pieces), 4096):
                d, at, n, sequence, offset = pieces[i : i + 4096].T
                own = [ids[a][b : b + c].tobytes() for a, b, c in zip(d.tolist(), at.tolist(), n.tolist())]
                cols = [name.take(pa.array(d)), size[d] - length[d] + at, n, size[d], base + sequence, offset, own]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            base += int(pieces[-1][3]) + 1
            names, sizes, ids, held = [], [], [], 0

        for b in batches:
            for name, size, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "rest"))):
                names.append(name)
                sizes.append(size)
                ids.append(np.frombuffer(x, "<u4"))
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield from flush()
        if ids:
            yield from flush()

    rests = by_content(tokens, counts, idf, shard_tokens).mapInArrow(run, _PIECES)
    return own_windows(tokens, window).unionAll(rests)
