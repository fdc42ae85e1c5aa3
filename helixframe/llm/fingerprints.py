"""Lempel-Ziv fingerprints.

A text's bytes are parsed into phrases as LZ78 does: each phrase is the shortest one that isn't in
the dictionary yet. The set of phrases stands for what a compressor learns from the text, so that the
likeness of two such sets is akin to a compression distance. Phrases are hashed, and the fingerprint
is the signature of the KEEP least hashes; the share of common ones among the least hashes of
both estimates the Jaccard likeness, and is exact for texts of fewer phrases.

To meet each document with the next one in the order of ids, rows are dealt into ranges of ids by
quantiles, and the first document of a range goes to the range before as well, as a look ahead; the
first of all goes to the last. Ranges are read in order as a stream, so their size doesn't matter. An id
that fills several quantiles (such as a null one) has so many ranges, by a hash of the text.

Defined results: null text counts as empty, and has no phrases; two empty texts are alike (1), an
empty and another one are not (0). A null id sorts first. Rows of equal ids follow each other by a hash of
their texts; each row gets a row. A single row is followed by itself. Texts of any length are parsed whole.
An empty table gives an empty result. Only doc_id and text are read, so that other columns of whatever name
don't matter.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEEP = 64
#: Rows for which a range is meant, and ranges at most (their bounds are known to the driver).
RANGE_ROWS, MOST_RANGES = 1000, 10_000


def phrase_ends(data: bytes, at: int, trie: dict[int, int], node: int) -> tuple[list[int], int]:
    """Ends of the new phrases in data, which begins at the text's byte `at`, and the node where it stops."""
    ends: list[int] = []
    get, add, size = trie.get, ends.append, len(trie)
    for at, c in enumerate(data, at + 1):  # noqa: B020
        key = node << 8 | c
        node = get(key, 0)
        if not node:
            size += 1
            trie[key] = size
            add(at)
    return ends, node


def signature(data: bytes, ends: list[int]) -> np.ndarray:
    """The least hashes of the phrases that end there, each of 32 bits."""
    raw = np.frombuffer(data, np.uint8)
    stops = np.array(ends, np.int64)
    starts = np.concatenate((stops[:1] * 0, stops[:-1]))
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(common._TABLE[raw] * common._power(common._BASE, len(raw)), out=prefix[1:])
    hashes = (prefix[stops] - prefix[starts]) * common._power(common._BASE_INV, len(raw) + 1)[starts]
    short = (common.mix(hashes + (stops - starts).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    if len(short) > 4 * KEEP:
        short = short[short <= np.partition(short, 2 * KEEP)[2 * KEEP]]
    return np.unique(short)[:KEEP]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    # above the end of a full signature it is not known which hashes its text has
    top = min([int(x[-1]) for x in (a, b) if len(x) == KEEP], default=1 << 32)
    union = np.union1d(a, b)
    union = union[union <= top][:KEEP]
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


class Text:
    """A document's signature, and what is needed to go on from the place where its end is replaced."""

    def __init__(self, text: str):
        self.n_chars = len(text)
        self.swap = self.n_chars // 4
        self.text, data = text, text.encode()
        self.head = data if not self.swap else text[: self.n_chars - self.swap].encode()
        trie: dict[int, int] = {}
        self.head_ends, self.node = phrase_ends(self.head, 0, trie, 0)
        self.trie = trie.copy() if self.swap else trie
        more, _ = phrase_ends(data[len(self.head) :], len(self.head), trie, self.node)
        self.signature = signature(data, self.head_ends + more)

    def edited(self, following: str) -> tuple[bytes, np.ndarray]:
        if not self.swap:
            return self.head, self.signature
        tail = following[: self.swap].encode()
        more, _ = phrase_ends(tail, len(self.head), self.trie, self.node)
        data = self.head + tail
        return data, signature(data, self.head_ends + more)


def _printed(sign: np.ndarray) -> str:
    return sign.astype(">u4").tobytes().hex()


def _range_of(order: Column, tie: Column, quantiles: list[int]) -> Column:
    """How many of the sorted quantiles are at most `order`, found among coarse ones first, then among those between.

    Ties: a quantile that is there n times has n ranges, in the order of `tie`, a number from 0 to 1.
    """
    splits = sorted(set(quantiles))
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    groups = [splits[i : i + step] for i in range(0, len(splits), step)]
    coarse = F.array(*[F.lit(g[0]) for g in groups])
    above = F.size(F.filter(coarse, lambda x: x <= order))
    fine = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    inner = F.size(F.filter(F.element_at(fine, F.greatest(above, F.lit(1))), lambda x: x <= order))
    got = F.when(above == 0, F.lit(0)).otherwise((above - 1) * step + inner)
    often = {x: n for x, n in Counter(quantiles).items() if n > 1}
    if not often:
        return got
    # ranges are numbered anew with room for the parts of each; what lies above a quantile, below the next, is in its last part
    ends = list(itertools.accumulate([often.get(x, 1) for x in splits], initial=1))
    last = F.element_at(F.array(*[F.lit(x - 1) for x in ends]), got + 1)
    parts = F.try_element_at(F.create_map(*[F.lit(x) for pair in often.items() for x in pair]), order)
    return last - F.coalesce(parts - 1 - F.least(F.floor(tie * parts), parts - 1), F.lit(0))


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, _range, _ahead: sorted in each partition; rows with _ahead = 1 only show what follows a range."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_order"))
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, n // range_rows))
    quantiles: list[int] = []
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        quantiles = sorted(rows.agg(F.percentile_approx("_order", at, 10 * ranges)).head()[0])
    rows = rows.withColumn("_tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    rows = rows.withColumn("_range", _range_of(F.col("_order"), F.col("_tie") / float(1 << 63), quantiles).cast("int"))
    least = F.min(F.struct("_order", "_tie")).alias("first")
    firsts = {r["_range"]: (r["first"]["_order"], r["first"]["_tie"]) for r in rows.groupBy("_range").agg(least).collect()}  # a row for each range
    filled = sorted(firsts)
    before = {r: filled[i - 1] for i, r in enumerate(filled)}
    known = range(max(filled, default=0) + 1)
    order, ties = (F.array(*[F.lit(firsts[r][i] if r in firsts else None).cast("long") for r in known]) for i in (0, 1))
    prior = F.array(*[F.lit(before.get(r)).cast("int") for r in known])
    here = F.struct(F.col("_range").alias("r"), F.lit(0).alias("a"))
    mine = F.col("_range") + 1
    is_first = (F.element_at(order, mine) == F.col("_order")) & (F.element_at(ties, mine) == F.col("_tie"))
    ahead = F.when(is_first, F.struct(F.element_at(prior, mine).alias("r"), F.lit(1).alias("a")))
    dealt = rows.withColumn("_to", F.explode(F.array_compact(F.array(here, ahead))))
    dealt = dealt.select("doc_id", "text", "_order", "_tie", F.col("_to.r").alias("_range"), F.col("_to.a").alias("_ahead"))
    parts = max(1, len(filled))
    return dealt.repartition(parts, "_range").sortWithinPartitions("_range", "_ahead", "_order", "_tie", "text")


def fingerprints(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        out: list[tuple] = []
        waiting: tuple | None = None  # the id and Text of the row before, and its range

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            types = types or [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "_range", "_ahead")]
            for i in range(batch.num_rows):
                doc_id, text, where, ahead = (c[i].as_py() for c in columns)
                if waiting and waiting[2] != where:
                    raise ValueError("a range lacks its look ahead")
                if ahead and not waiting:
                    continue  # a second row with the id that follows
                now = Text(text)
                if waiting:
                    was = waiting[1]
                    data, sign = was.edited(text)
                    out.append((waiting[0], was.n_chars, hashlib.sha256(data).hexdigest(), _printed(was.signature), _printed(sign), likeness(was.signature, sign), likeness(was.signature, now.signature)))
                waiting = None if ahead else (doc_id, now, where)
                if len(out) >= 1000:
                    yield flush()
        if out:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_next(docs, range_rows).select("doc_id", "text", "_range", "_ahead")
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
