"""Corpus encoding with a public byte-level BPE vocabulary, through a sentencepiece model written from that vocabulary.

The vocabulary file lists byte strings in merge order. :func:`model_bytes` serialises it as a sentencepiece BPE model:
every byte string becomes a piece of byte-mapped characters whose score is its negative rank, with identity
normalisation, so the best-scored merge is the lowest-ranked one. Texts are cut into pre-tokens by the vocabulary's
pattern and each distinct pre-token is encoded once per task. The model (about 1 MB, whatever the corpus) travels with
the tasks; executors need no file.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the pattern of pre-tokens that the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens kept per task before the memory starts afresh.
REMEMBERED = 400_000


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it is printable, else the next free one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def vocabulary(tokenizers: str = TOKENIZERS, name: str = VOCABULARY) -> list[bytes]:
    """Byte strings in order of their ids."""
    ranks: dict[int, bytes] = {}
    with open(f"{tokenizers}/{name}.tiktoken", "rb") as lines:
        for line in lines:
            piece, rank = line.split()
            ranks[int(rank)] = base64.b64decode(piece)
    return [ranks[i] for i in range(len(ranks))]


def _field(number: int, wire: int, payload: bytes) -> bytes:
    return _varint(number << 3 | wire) + (_varint(len(payload)) if wire == 2 else b"") + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def model_bytes(pieces: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: NORMAL pieces with score -rank, one UNKNOWN piece behind them, BPE, no normalisation."""
    mapped = byte_characters()
    out = []
    for rank, piece in enumerate(pieces):
        text = "".join(mapped[b] for b in piece).encode()
        out.append(_field(1, 2, _field(1, 2, text) + _field(2, 5, struct.pack("<f", -float(rank)))))
    out.append(_field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2))))
    out.append(_field(2, 2, _field(3, 0, _varint(2))))  # trainer: model_type BPE
    no = _varint(0)
    out.append(_field(3, 2, _field(1, 2, b"identity") + _field(3, 0, no) + _field(4, 0, no) + _field(5, 0, no)))
    return b"".join(out)


class Encoder:
    """Encodes texts; remembers the ids of pre-tokens it has seen."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(PATTERN).findall
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.seen: dict[str, list[int]] = {}

    def learn(self, new: list[str]) -> None:
        mapped = [w.encode().decode("latin-1").translate(self.table) for w in new]
        self.seen.update(zip(new, self.sp.encode(mapped, num_threads=1)))

    def pretokens(self, texts: list[str | None]) -> list[list[str]]:
        """Pre-tokens of some texts, all of them known afterwards."""
        words = [self.find(t) if t else [] for t in texts]
        new = set(itertools.chain.from_iterable(words)).difference(self.seen)
        if new:
            if len(self.seen) > REMEMBERED:
                self.forget()
                new = set(itertools.chain.from_iterable(words))
            self.learn(list(new))
        return words

    def forget(self) -> None:
        self.seen.clear()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        known = self.seen.__getitem__
        return [list(itertools.chain.from_iterable(map(known, w))) for w in self.pretokens(texts)]


def in_groups(items: list, size: int = 256) -> Iterator[list]:
    """Runs of some texts: new pre-tokens are learnt once per run, and only a run's pre-tokens are held."""
    for at in range(0, len(items), size):
        yield items[at : at + size]


def decode(ids: list[int], pieces: list[bytes]) -> str:
    return b"".join([pieces[i] for i in ids]).decode("utf-8", errors="replace")


def encoded(df: DataFrame, text: str = "text", out: str = "ids", tokenizers: str = TOKENIZERS, vocabulary_name: str = VOCABULARY) -> DataFrame:
    """Add ``out``, the ``array<int>`` of token ids of the column ``text``, without special tokens.

    Null and empty texts have no tokens: an empty array. Names of special tokens in a text are ordinary text. Whole
    texts are encoded, however long. All columns stay; a column named ``out`` is replaced.
    """
    model = model_bytes(vocabulary(tokenizers, vocabulary_name))
    df = df.drop(out)
    at = df.columns.index(text)
    schema = df.withColumn(out, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            lists = [x for group in in_groups(batch.column(at).to_pylist()) for x in encoder.encode(group)]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def counted(df: DataFrame, text: str = "text", out: str = "n_tokens", tokenizers: str = TOKENIZERS, vocabulary_name: str = VOCABULARY) -> DataFrame:
    """Add ``out``, the number of tokens of ``text`` (null and empty: 0), and drop ``text``."""
    model = model_bytes(vocabulary(tokenizers, vocabulary_name))
    at = df.columns.index(text)
    kept = [i for i, c in enumerate(df.columns) if c != text]
    schema = df.drop(text).withColumn(out, F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            n = [sum(map(len, map(encoder.seen.__getitem__, w))) for group in in_groups(batch.column(at).to_pylist()) for w in encoder.pretokens(group)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(n, pa.int32())], names=[*(batch.schema.names[i] for i in kept), out])

    return df.mapInArrow(run, schema)


def decoded(df: DataFrame, ids: str = "ids", out: str = "decoded", tokenizers: str = TOKENIZERS, vocabulary_name: str = VOCABULARY) -> DataFrame:
    """Add ``out``, the text that the token ids of ``ids`` stand for (null ids: null)."""
    pieces = vocabulary(tokenizers, vocabulary_name)
    at = df.columns.index(ids)
    schema = df.withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(x, pieces) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)
