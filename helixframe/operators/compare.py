"""Comparison of two soft masks of the same sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = ("compared", "mask1", "mask2", "both", "only1", "only2", "len1", "len2")


def compare_masks(pairs: DataFrame) -> DataFrame:
    """pair, the counts over letters up to the end of the shorter of seq1 and seq2, and percentages."""
    kind = pairs.schema["pair"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x, y = (np.frombuffer((s or "").encode("latin-1", "replace"), np.uint8) for s in (a, b))
                n = min(len(x), len(y))
                p, q = ((z[:n] >= 97) & (z[:n] <= 122) for z in (x, y))
                rows.append((n, p.sum(), q.sum(), (p & q).sum(), (p & ~q).sum(), (q & ~p).sum(), len(x), len(y)))
            cols = list(zip(*rows, strict=True)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(map(int, c), pa.int64()) for c in cols)], names=["pair", *COUNTS])

    got = pairs.select("pair", "seq1", "seq2").mapInArrow(run, f"pair {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    share = lambda part, whole: F.when(whole > 0, F.round(F.col(part) * 100.0 / whole, 4)).otherwise(0.0)
    return got.withColumns(
        {
            "masked1_pct": share("mask1", F.col("len1")),
            "masked2_pct": share("mask2", F.col("len2")),
            "overlap_pct": share("both", F.greatest("mask1", "mask2")),
            "both_pct": share("both", F.col("compared")),
            "only1_pct": share("only1", F.col("mask1")),
            "only2_pct": share("only2", F.col("mask2")),
        }
    )
