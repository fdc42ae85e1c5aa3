"""Repeat blocks from repeated windows, and soft masks.

A base is covered by each repeated window that holds it, on both strands alike. Covered runs with
enough high bases become blocks. All of it works on the starts of repeated windows alone: how many
windows cover the bases up to the next start follows from the starts before, so that there is no row
for a base. Long records are cut into segments; starts near a border are known on both sides, and
the pieces of a run are joined over segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kmers

SEGMENT = 1 << 20
_FAR = 1 << 62


def least_windows(k: int, sensitive: bool = True) -> int:
    """Windows that must cover a high base: twice their number is above k / 2 - 1 (or above k - 1)."""
    top = k // 2 - 1 if sensitive else k - 1
    return top // 2 + 1


def segmented(starts: DataFrame, k: int, least: int) -> DataFrame:
    """starts with _new (a run begins) and _high (high bases up to the next start), still by segment."""
    seg = F.floor(F.col("pos") / SEGMENT)
    inside = F.col("pos") % SEGMENT
    here = F.struct(seg.alias("seg"), F.lit(False).alias("ctx"))
    after = F.when(inside >= SEGMENT - k, F.struct((seg + 1).alias("seg"), F.lit(True).alias("ctx")))
    before = F.when((inside < k) & (seg > 0), F.struct((seg - 1).alias("seg"), F.lit(True).alias("ctx")))
    spread = starts.select("seq_id", "pos", F.explode(F.array_compact(F.array(here, after, before))).alias("_s")).select("seq_id", "pos", "_s.*")
    w = Window.partitionBy("seq_id", "seg").orderBy("pos")
    past, following, back = F.lag("pos").over(w), F.lead("pos").over(w), F.lag("pos", least - 1).over(w) if least > 1 else F.col("pos")
    high = F.greatest(F.lit(0), F.least(F.coalesce(following, F.lit(_FAR)) - 1, back + k - 1) - F.col("pos") + 1)
    high = F.when(back.isNotNull(), high).otherwise(F.lit(0))  # least() would pass over a null
    return spread.withColumn("_new", (past.isNull() | (F.col("pos") - past > k)).cast("long")).withColumn("_high", high).where("not ctx")


def joined(pieces: DataFrame, by: str, begin: str, is_new: Column, aggregates: list[Column]) -> DataFrame:
    """Pieces in the order of begin, those that don't satisfy is_new put together with what is before them."""
    w = Window.partitionBy(by).orderBy(begin)
    numbered = pieces.withColumn("_new", is_new.cast("long")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "_run").agg(*aggregates).drop("_run")


def runs(starts: DataFrame, k: int, least: int) -> DataFrame:
    """seq_id, first, last (base), high: maximal covered runs and their number of high bases."""
    w = Window.partitionBy("seq_id", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = segmented(starts, k, least).withColumn("_run", F.sum("_new").over(w))
    local = local.groupBy("seq_id", "seg", "_run").agg(F.min("pos").alias("first"), F.max("pos").alias("final"), F.sum("_high").alias("high"))
    past = F.lag("final").over(Window.partitionBy("seq_id").orderBy("first"))
    whole = joined(local, "seq_id", "first", past.isNull() | (F.col("first") - past > k), [F.min("first").alias("first"), F.max("final").alias("final"), F.sum("high").alias("high")])
    return whole.select("seq_id", "first", (F.col("final") + k - 1).alias("last"), "high")


def runs_without(starts: DataFrame, k: int, least: int, excluded: DataFrame) -> DataFrame:
    """runs() where the bases of excluded (seq_id, start, len) count as uncovered: segment by segment, from starts and spans alone."""
    kind = kmers._id_type(starts)
    spans = starts.select("seq_id", F.col("pos").alias("first"), (F.col("pos") + k - 1).alias("last"), F.lit(False).alias("barred"))
    bars = excluded.where("len > 0").select("seq_id", F.col("start").alias("first"), (F.col("start") + F.col("len") - 1).alias("last"), F.lit(True).alias("barred"))
    # spans of records that no repeated window is in have nothing to take away
    dealt = spans.unionByName(bars.join(starts.select("seq_id").distinct(), "seq_id", "left_semi"))
    dealt = dealt.withColumn("seg", F.explode(F.sequence(F.floor(F.col("first") / SEGMENT), F.floor(F.col("last") / SEGMENT))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(key[1]) * SEGMENT
        end = min(SEGMENT, int(pdf["last"].max()) - base + 1)
        first, last, barred = (pdf[c].to_numpy() for c in ("first", "last", "barred"))

        def times(mine: np.ndarray) -> np.ndarray:
            edge = np.zeros(end + 1, np.int64)
            np.add.at(edge, np.maximum(first[mine] - base, 0), 1)
            np.add.at(edge, np.minimum(last[mine] - base + 1, end), -1)
            return np.cumsum(edge[:end])

        over = np.where(times(barred) > 0, 0, times(~barred))
        turn = np.diff(np.concatenate(([0], (over > 0).astype(np.int8), [0])))
        begin, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        high = np.concatenate(([0], np.cumsum(over >= least)))
        return pd.DataFrame({"seq_id": [key[0]] * len(begin), "first": begin + base, "last": stop - 1 + base, "high": high[stop] - high[begin]})

    found = dealt.groupBy("seq_id", "seg").applyInPandas(run, f"seq_id {kind}, first long, last long, high long")
    past = F.lag("last").over(Window.partitionBy("seq_id").orderBy("first"))
    return joined(found, "seq_id", "first", past.isNull() | (F.col("first") - past > 1), [F.min("first").alias("first"), F.max("last").alias("last"), F.sum("high").alias("high")])


def runs_of_spans(spans: DataFrame, k: int, least: int, excluded: DataFrame | None = None) -> DataFrame:
    """runs(), or runs_without(), of starts that are given as spans(seq_id, seg, spans) of kmers.shared_spans(): a row for each record and segment."""
    kind = kmers._id_type(spans)
    both = spans.groupBy("seq_id", "seg").agg(F.collect_list("spans").alias("_starts"))
    if excluded is None:
        both = both.withColumn("_bars", F.lit(None).cast("array<struct<first: bigint, last: bigint>>"))
    else:
        last = F.col("start") + F.col("len") - 1
        bars = excluded.where("len > 0").select("seq_id", F.struct(F.col("start").cast("long").alias("first"), last.cast("long").alias("last")).alias("_bar"), F.explode(F.sequence(F.floor(F.col("start") / SEGMENT), F.floor(last / SEGMENT))).alias("seg"))
        both = both.join(bars.groupBy("seq_id", "seg").agg(F.collect_list("_bar").alias("_bars")), ["seq_id", "seg"], "left").select("seq_id", "seg", "_starts", "_bars")

    def marked(first: np.ndarray, last: np.ndarray, base: int, n: int) -> np.ndarray:
        """How often each place from base on is in one of the spans."""
        edge = np.bincount(np.clip(first - base, 0, n), minlength=n + 1) - np.bincount(np.clip(last + 1 - base, 0, n), minlength=n + 1)
        return np.cumsum(edge[:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seg, bars = batch.column(1)[i].as_py(), batch.column(3)[i]
                base, read = seg * SEGMENT, [kmers.span_ends(x, k, seg, SEGMENT) for x in batch.column(2)[i].as_py()]
                first, last = (np.concatenate([x[j] for x in read]) for j in (0, 1))
                low = max(0, int(first.min()) - base)
                n = min(SEGMENT, int(last.max()) + k - base) - low
                # the starts of the windows over a base are itself and k - 1 bases before
                sums = np.concatenate(([0], np.cumsum(marked(first, last, base + low - k + 1, n + k - 1))))
                over = sums[k:] - sums[:-k]
                if bars.is_valid:
                    over[marked(*(bars.values.field(c).to_numpy() for c in ("first", "last")), base + low, n) > 0] = 0
                turn = np.diff(np.concatenate(([0], (over > 0).astype(np.int8), [0])))
                begin, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                high = np.concatenate(([0], np.cumsum(over >= least)))
                columns = [pa.repeat(batch.column(0)[i], len(begin)), *map(pa.array, (begin + base + low, stop - 1 + base + low, high[stop] - high[begin]))]
                yield pa.RecordBatch.from_arrays(columns, names=["seq_id", "first", "last", "high"])

    found = both.mapInArrow(run, f"seq_id {kind}, first long, last long, high long")
    past = F.lag("last").over(Window.partitionBy("seq_id").orderBy("first"))
    return joined(found, "seq_id", "first", past.isNull() | (F.col("first") - past > 1), [F.min("first").alias("first"), F.max("last").alias("last"), F.sum("high").alias("high")])


def build_blocks(covered: DataFrame, lengths: DataFrame, k: int, min_len: int) -> DataFrame:
    """seq_id, start, len: runs with two high bases, k - 1 longer at their end, put together where they meet, and longer than min_len."""
    kept = covered.where("high > 1").join(lengths.select("seq_id", F.col("len").alias("_n")), "seq_id")
    ends = kept.select("seq_id", "first", F.least(F.col("last") + k - 1, F.col("_n") - 1).alias("end"))
    before = F.max("end").over(Window.partitionBy("seq_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    merged = joined(ends, "seq_id", "first", before.isNull() | (before < F.col("first")), [F.min("first").alias("start"), F.max("end").alias("end")])
    return merged.select("seq_id", "start", (F.col("end") - F.col("start") + 1).alias("len")).where(F.col("len") > min_len)


def repeat_blocks(seqs: DataFrame, k: int = 19, min_len: int = 80, shared: bool = False, excluded: DataFrame | None = None, sensitive: bool = True) -> DataFrame:
    """seq_id, start, len of the repeat blocks of seqs(seq_id, seq)."""
    least = least_windows(k, sensitive)
    if shared:
        spans, lengths = kmers.spans_and_lengths(seqs, k, SEGMENT)
        covered = runs_of_spans(spans, k, least, excluded)
    else:
        lengths = seqs.select("seq_id", F.length("seq").cast("long").alias("len"))
        starts = kmers.repeated(seqs, k, False)
        covered = runs(starts, k, least) if excluded is None else runs_without(starts, k, least, excluded)
    return build_blocks(covered, lengths, k, min_len)


def coverage(starts: DataFrame, k: int) -> DataFrame:
    """seq_id, pos, coverage of each covered base: twice the number of repeated windows over it."""
    bases = starts.select("seq_id", F.explode(F.sequence("pos", F.col("pos") + k - 1)).alias("pos"))
    return bases.groupBy("seq_id", "pos").agg((F.count("*") * 2).alias("coverage"))


def case_runs(seqs: DataFrame, upper: bool = False, barred: np.ndarray | None = None) -> DataFrame:
    """seq_id, first, last: runs of letters of one case in seqs(seq_id, seq, and perhaps ssr: (start, len) where no run begins)."""
    kind = kmers._id_type(seqs)
    with_ssr = "ssr" in seqs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer((batch.column(1)[i].as_py() or "").encode("latin-1", "replace"), np.uint8)
                hit = ((data >= 65) & (data <= 90)) if upper else ((data >= 97) & (data <= 122))
                edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
                if with_ssr and len(first):
                    open_ = np.ones(len(data) + 1, bool)
                    for s in batch.column(2)[i].as_py() or []:
                        open_[s["start"] : s["start"] + s["len"]] = False
                    places = np.flatnonzero(open_)
                    first = places[np.searchsorted(places, first)]
                    first, last = first[first <= last], last[first <= last]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(first)), pa.array(first), pa.array(last)], names=["seq_id", "first", "last"])

    return seqs.select("seq_id", "seq", *(["ssr"] if with_ssr else [])).mapInArrow(run, f"seq_id {kind}, first long, last long")


def merged_runs(found: DataFrame, gap: int, min_len: int) -> DataFrame:
    """seq_id, start, len: runs put together where the next begins less than gap after the end, of min_len at least."""
    past = F.lag("last").over(Window.partitionBy("seq_id").orderBy("first"))
    merged = joined(found, "seq_id", "first", past.isNull() | (F.col("first") - past >= gap), [F.min("first").alias("start"), F.max("last").alias("end")])
    return merged.select("seq_id", "start", (F.col("end") - F.col("start") + 1).alias("len")).where(F.col("len") >= min_len)


def soft_mask(seqs: DataFrame, *blocks: DataFrame) -> DataFrame:
    """seqs with seq in upper case, but for the blocks, which are in lower case."""
    spans = blocks[0].select("seq_id", "start", "len")
    for more in blocks[1:]:
        spans = spans.unionByName(more.select("seq_id", "start", "len"))
    each = spans.groupBy("seq_id").agg(F.collect_list(F.struct("start", "len")).alias("_spans"))
    rest = [c for c in seqs.columns if c not in ("seq_id", "seq")]
    frame = seqs.join(each, "seq_id", "left").select("seq_id", "seq", "_spans", *rest)
    schema = seqs.select("seq_id", "seq", *rest).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = np.frombuffer((seq or "").upper().encode("latin-1", "replace"), np.uint8).copy()
                for s in spans or []:
                    data[s["start"] : s["start"] + s["len"]] |= 32
                out.append(data.tobytes().decode("latin-1"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), *batch.columns[3:]], names=["seq_id", "seq", *rest])

    return frame.mapInArrow(run, schema)
