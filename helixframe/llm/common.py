"""Shared parts of the text operators: tables, checkpoints, vectorised word hashing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpoint_folder, cut, send_package  # noqa: F401

#: A word, for every operator here: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that numpy handles at once; longer texts form a block of their own.
BLOCK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    send_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder for tables in the one for checkpoints, which all executors see."""
    return f"{checkpoint_folder(spark).rstrip('/')}/helixframe-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def masked(docs: DataFrame, *kept: str) -> tuple[DataFrame, list[Column]]:
    """docs with every column but `kept` under a name that nothing else here has, and what to select to undo it."""
    names = {c: c if c in kept else f"_masked_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def rows_per_task(n_rows: int, least: int = 1) -> int:
    """Number of hash buckets that keeps about 50,000 rows in each."""
    return max(least, -(-n_rows // 50_000))


# --- vectorised text -------------------------------------------------------------------

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Some texts as one byte array with word boundaries and word hashes.

    starts, ends: byte positions of words; doc: the text of each word; first: for each text the
    index of its first word, with the total at the end; offsets: byte positions of the texts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        word = ~_SPACE[data]
        edge = np.zeros(n + 1, np.int8)
        edge[:n] = word
        change = np.diff(edge, prepend=np.int8(0))
        begin, end = change == 1, change == -1
        # a text boundary inside a run of word bytes ends one word and begins another
        inner = offsets[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < n)])
        joint = inner[word[inner] & word[inner - 1]] if len(inner) else inner
        begin[joint] = True
        end[joint] = True
        self.starts = np.flatnonzero(begin[:n] if n else begin[:0])
        self.ends = np.flatnonzero(end)
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._prefix: np.ndarray | None = None

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_TABLE[self.data] * _power(_BASE, len(self.data)), out=self._prefix[1:])
        return self._prefix

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span, the same wherever equal bytes stand."""
        p = self.prefix()
        raw = (p[ends] - p[starts]) * _power(_BASE_INV, len(self.data) + 1)[starts]
        return mix(raw + (ends - starts).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def count(self, hit: np.ndarray) -> np.ndarray:
        """For each text, how many of its bytes are hit."""
        return np.diff(np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))[self.offsets])


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of so many words, at the run's first word."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD1342543DE82EF95) + words[j : j + n]
    return mix(out)


def blocks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, Block]]:
    """(from, to, Block) over the texts in their order; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1
        to = min(len(texts), max(at + 1, to))
        yield at, to, Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies: the folder in HELIXFRAME_TOKENIZERS, else that of public_tokenizers."""
    folder = os.environ.get("HELIXFRAME_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
