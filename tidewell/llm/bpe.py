"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Byte-level BPE works on characters that stand for bytes: 188 printable bytes stand for
themselves, the other 68 are moved to code points from 256 on. A tokenizer is read from a
tokenizers file, or built from a rank file; decoding reverses the byte table, so ids whose
bytes split a character decode to exactly those bytes.

Words repeat, so ids are looked up per word: a text whose white space is single spaces and
line feeds falls apart exactly at these for the splitting pattern, and each distinct part is
encoded once per worker. Other lines are encoded whole. Both give the same ids.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Regex, Tokenizer, models, pre_tokenizers  # noqa: E402

from tidewell.llm.tables import slices, texts_of, with_fields  # noqa: E402

#: Entries of a worker's word table; when full it starts anew, so that it stays in bounded memory.
TABLE_WORDS = 450_000
#: Longer parts are encoded each time.
TABLE_WORD_LENGTH = 64
#: Letters below this one are letters for the pattern too, whatever the library's Unicode version.
_LATIN = "\u0250"
#: A line feed between two characters that are not white space.
_LINE = re.compile(r"\n(?=\S)(?<=\S\n)")


def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(moved)) for b in range(256)]


def _from_ranks(path: str, pattern: str) -> Tokenizer:
    """A tokenizer whose merges are all splits of each token into two tokens, in the order of ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    chars = byte_characters()
    spelled = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        splits = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(spelled[a], spelled[b]) for a, b in sorted(splits, key=lambda s: (ranks[s[0]], ranks[s[1]]))]
    made = Tokenizer(models.BPE({spelled[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


class Codec:
    """Encodes texts to ids and decodes ids to bytes; one per vocabulary and process."""

    def __init__(self, path: str, pattern: str | None):
        if pattern is None:
            self.tokenizer = Tokenizer.from_file(path)
        else:
            self.tokenizer = _from_ranks(path, pattern)
        of_char = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of: list[bytes] = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        self.chars = dict(enumerate(byte_characters()))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.first = _Words(self, "")
        self.spaced = _Words(self, " ")
        self.feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def has_added(self, text: str) -> bool:
        return any(token in text for token in self.added)

    def letters(self, word: str, before: str) -> bytes:
        """Ids of letters alone after ``before`` (a space or nothing): one match of the splitting pattern."""
        spelled = (before + word).encode().decode("latin-1").translate(self.chars)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers. A tokenizers file's added tokens keep their own ids."""
        if self.has_added(text):
            return self.whole(text)
        out = []
        for line in _LINE.split(text):
            parts = line.split(" ")
            if "" not in parts and " ".join(line.split()) == line:
                out.append(self.first[parts[0]] + b"".join(map(self.spaced.__getitem__, parts[1:])))
            else:
                out.append(self.whole(line))
        return self.feed.join(out)

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Character offsets (start, end) of each token; parts of one character share its offsets."""
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; raises IndexError for ids outside the vocabulary."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Words(dict):
    def __init__(self, codec: Codec, before: str):
        super().__init__()
        self.codec, self.before = codec, before

    def __missing__(self, word: str) -> bytes:
        # A final punctuation mark after a letter is a token of its own for the pattern.
        if len(word) > 1 and word[-1] in ".,;:!?" and word[-2].isalpha():
            ids = self[word[:-1]] + self.codec.first[word[-1]]
        elif word.isalpha() and max(word) < _LATIN:
            ids = self.codec.letters(word, self.before)
        else:
            ids = self.codec.whole(self.before + word)
        if len(word) <= TABLE_WORD_LENGTH:
            if len(self) >= TABLE_WORDS:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def codec(path: str, pattern: str | None = None) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str | None = None, text: str = "text", offsets: bool = False) -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens`` to a table.

    ``path`` is a tokenizers file, or with ``pattern`` a rank file whose texts are split by that
    pattern. With ``offsets``, ``starts`` and ``ends`` (arrays of int) hold each token's
    characters. Null and empty texts have no tokens. Other columns pass through; those named
    like an added one are replaced. Repeated rows are encoded each. Empty tables stay empty.
    """
    added = ["ids", "n_tokens", *(["starts", "ends"] if offsets else [])]
    kept = [c for c in df.columns if c not in added or c == text]
    frame = df.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in slices(batches, text):
            texts = texts_of(b, text)
            ids = [own.encode(t) for t in texts]
            more = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if offsets:
                spans = [own.offsets(t) for t in texts]
                more += [pa.array([[s[end] for s in x] for x in spans], pa.list_(pa.int32())) for end in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *added])

    fields = "ids binary, n_tokens long" + (", starts array<int>, ends array<int>" if offsets else "")
    return frame.mapInArrow(run, with_fields(frame.schema, fields))


def decode(df: DataFrame, path: str, pattern: str | None = None, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary): the bytes of ``ids``; null ids decode to null, none to no bytes.

    Bytes need not be whole characters: cast to string where they are. Other columns pass through.
    """
    frame = df.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in slices(batches, ids):
            out = pa.array([None if x is None else own.decode(x) for x in b.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, "decoded"])

    return frame.mapInArrow(run, with_fields(frame.schema, "decoded binary"))
