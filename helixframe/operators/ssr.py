"""Tandem repeats of short units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from . import kmers

MAX_UNIT = 14
#: A repeat of units of u bases is so many bases long at least: the greater of LEAST and COPIES * u.
LEAST, COPIES = 12, 3


def tandem_spans(codes: np.ndarray, max_unit: int = MAX_UNIT) -> np.ndarray:
    """Rows (start, end) of the bases in a tandem repeat, merged where they meet."""
    n, spans = len(codes), []
    other = np.where(codes > 3, np.uint8(255), codes)  # what is no base equals nothing
    for u in range(1, min(max_unit, n - 1) + 1):
        same = other[u:] == codes[:-u]
        edge = np.diff(np.concatenate(([0], same.astype(np.int8), [0])))
        first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = stop - first + u
        keep = size >= max(LEAST, COPIES * u)
        spans.append(np.stack((first[keep], first[keep] + size[keep]), 1))
    if not spans:
        return np.zeros((0, 2), np.int64)
    found = np.concatenate(spans)
    found = found[np.argsort(found[:, 0], kind="stable")]
    if not len(found):
        return found
    ends = np.maximum.accumulate(found[:, 1])
    new = np.concatenate(([True], found[1:, 0] > ends[:-1]))
    at = np.flatnonzero(new)
    return np.stack((found[at, 0], ends[np.append(at[1:], len(found)) - 1]), 1)


def ssr_blocks(seqs: DataFrame, max_unit: int = MAX_UNIT) -> DataFrame:
    """seq_id, start, len. Records of some bases together are looked through behind each other, with more than a unit between them."""
    kind = kmers._id_type(seqs)
    apart = np.full(max_unit, 4, np.uint8)

    def found(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        spans = tandem_spans(np.concatenate(parts), max_unit)
        places = np.cumsum([0, *(len(a) + len(b) for a, b in zip(parts[::2], parts[1::2], strict=True))])[:-1]
        of = np.searchsorted(places, spans[:, 0], side="right") - 1
        return pa.RecordBatch.from_arrays([pa.array(ids, ids_type).take(pa.array(of)), pa.array(spans[:, 0] - places[of]), pa.array(spans[:, 1] - spans[:, 0])], names=["seq_id", "start", "len"])

    ids_type = to_arrow_type(seqs.schema["seq_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for seq_id, codes in kmers._records(batches):
            if held and held + len(codes) > kmers.CHUNK:
                yield found(ids, parts)
                ids, parts, held = [], [], 0
            ids.append(seq_id.as_py())
            parts += [codes, apart]
            held += len(codes) + max_unit
        if held:
            yield found(ids, parts)

    return seqs.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, start long, len long")
