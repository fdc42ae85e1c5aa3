"""Masking by extended seed pairs within each record.

A record's letters are read behind each other with those of the other strand: place p below n is a letter of the
record, place n + 1 + j the j-th of its reverse complement, and n the border. Equal k-mers at two places are a seed
pair, and the distance of the places its diagonal. A pair goes on along the diagonal, over letters that differ as
well, up to the end of a strand or a place where both letters are ambiguous. Letters that differ form a chain
while at most one equal letter stands between two of them; the fourth of a chain ends the pair, three letters
before it. Pairs longer than the least length mark both their places.

Pairs are taken in the order of the first place of their k-mer, then of their own places, and one of which either
begins at a marked place is passed over. Marks are kept for both strands, as the first place of a pair may be on
the other strand; those of the second are put where it lies on the record. In the end the record's own strand
counts. As each pair depends on those before, a record is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kmers, masking

#: Differing letters of a chain that end a pair.
CHAIN = 4
#: Candidates that are looked at together.
TOGETHER = 1 << 13


def chained(unlike: np.ndarray) -> np.ndarray:
    """Where (along the last axis) the CHAIN-th letter or a later one of a chain stands."""
    hit = unlike
    for _ in range(CHAIN - 1):
        longer = np.zeros_like(hit)
        longer[..., 1:] = hit[..., :-1]
        longer[..., 2:] |= hit[..., :-2]
        hit = longer & unlike
    return hit


def extension(both: np.ndarray, x: int, y: int, k: int, room: int) -> int:
    """Letters that the pair at x and y goes on, of `room` at most; read in strips that overlap by a chain's length."""
    at, strip, back = k, 64, 2 * CHAIN
    while at < room:
        begin, to = max(k, at - back), min(room, at + strip)
        a, b = both[x + begin : x + to], both[y + begin : y + to]
        blank = np.flatnonzero((a == 4) & (b == 4))
        if len(blank):
            room = to = begin + int(blank[0])
        found = np.flatnonzero(chained((a != b)[: to - begin]))
        if len(found):
            return begin + int(found[0]) - (CHAIN - 1)
        at, strip = to, strip * 4
    return room


def first_long(both: np.ndarray, n: int, x: int, ys: np.ndarray, k: int, min_len: int) -> int:
    """The first of ys with which x makes a pair longer than min_len, or -1: all are read side by side, so far as that takes."""
    for at in range(0, len(ys), TOGETHER):
        some = ys[at : at + TOGETHER]
        room = np.minimum((n if x < n else len(both)) - x, np.where(some < n, n, len(both)) - some)
        some, room = some[room > min_len], room[room > min_len]
        to = min_len + CHAIN
        if to > k and len(some):
            step = np.arange(k, to)
            a = both[np.minimum(x + step, len(both) - 1)]
            b = both[np.minimum(some[:, None] + step, len(both) - 1)]
            inside = step < room[:, None]
            ended = chained((a != b) & inside).any(1) | ((a == 4) & (b == 4) & (step <= min_len)).any(1)
            some = some[~ended]
        if len(some):
            return int(some[0])
    return -1


def masked(codes: np.ndarray, k: int, min_len: int) -> np.ndarray:
    """Which letters are marked, gaps of min_len at most between marks filled."""
    n = len(codes)
    back = np.where(codes[::-1] < 4, 3 - codes[::-1], 4).astype(np.uint8)
    both = np.concatenate((codes, np.array([4], np.uint8), back))
    mark = np.zeros(len(both), bool)
    if n >= k:
        bad = np.concatenate(([0], np.cumsum(both > 3)))
        at = np.flatnonzero(bad[k:] == bad[:-k])
        wide = both.astype(np.int64)
        keys = np.zeros(len(at), np.int64)
        for j in range(k):
            keys = keys << 2 | wide[at + j]
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        cuts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True])))
        groups = [at[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1]
        for group in sorted(groups, key=lambda g: g[0]):
            for i, x in enumerate(group[:-1].tolist()):
                if mark[x]:
                    continue
                later = group[i + 1 :]
                y = first_long(both, n, x, later[~mark[later]], k, min_len)
                if y < 0:
                    continue
                # the shorter pairs before it change nothing, and those after it find x marked
                room = min((n if x < n else len(both)) - x, (n if y < n else len(both)) - y)
                size = extension(both, x, y, k, room)
                mark[x : x + size] = True
                begin = y if y < n else 2 * n + 1 - y - size
                mark[begin : begin + size] = True
    mask = mark[:n]
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for a, b in zip(stop[:-1], first[1:], strict=True):
        if b - a <= min_len:
            mask[a:b] = True
    return mask


def align_runs(seqs: DataFrame, k: int = 19, min_len: int = 80) -> DataFrame:
    """seq_id, first, last: runs of marked letters."""
    kind = kmers._id_type(seqs)
    kmers.checked(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq_id, codes in kmers._records(batches):
            edge = np.diff(np.concatenate(([0], masked(codes, k, min_len).astype(np.int8), [0])))
            first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            yield pa.RecordBatch.from_arrays([pa.repeat(seq_id, len(first)), pa.array(first), pa.array(stop - 1)], names=["seq_id", "first", "last"])

    return seqs.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, first long, last long")


def align_blocks(seqs: DataFrame, k: int = 19, min_len: int = 80, runs: DataFrame | None = None) -> DataFrame:
    """seq_id, start, len: marked runs longer than k, k - 1 longer at their end, put together where they meet, and longer than min_len."""
    found = (align_runs(seqs, k, min_len) if runs is None else runs).where(F.col("last") - F.col("first") + 1 > k)
    return masking.build_blocks(found.withColumn("high", F.lit(2)), seqs.select("seq_id", F.length("seq").cast("long").alias("len")), k, min_len)
