"""Global coordinates: where records would lie one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Records of neighbouring ids that are summed together first.
BUCKET = 4096
#: Bases of a bin of the virtual sequence.
BIN = 1 << 16


def offsets(seqs: DataFrame) -> DataFrame:
    """seq_id, len, offset: sums over buckets of ids first, then inside each, so that no task meets all records."""
    lens = seqs.select("seq_id", F.length("seq").cast("long").alias("len")).withColumn("_b", F.floor(F.col("seq_id") / BUCKET))
    ahead = Window.partitionBy(F.floor(F.col("_b") / BUCKET)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = lens.groupBy("_b").agg(F.sum("len").alias("_sum"))
    tops = sums.groupBy(F.floor(F.col("_b") / BUCKET).alias("_t")).agg(F.sum("_sum").alias("_tsum"))
    top = Window.partitionBy(F.lit(0)).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 16 million ids
    tops = tops.withColumn("_before", F.coalesce(F.sum("_tsum").over(top), F.lit(0)))
    sums = sums.withColumn("_t", F.floor(F.col("_b") / BUCKET)).withColumn("_inner", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).join(tops, "_t")
    own = Window.partitionBy("_b").orderBy("seq_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = lens.join(sums.select("_b", (F.col("_before") + F.col("_inner")).alias("_base")), "_b")
    return placed.select("seq_id", "len", (F.col("_base") + F.coalesce(F.sum("len").over(own), F.lit(0))).cast("long").alias("offset"))


def locate(positions: DataFrame, placed: DataFrame) -> DataFrame:
    """positions(global_pos) with seq_id and pos: a range join by bins of the virtual sequence."""
    lo, hi = F.floor(F.col("offset") / BIN), F.floor((F.col("offset") + F.col("len") - 1) / BIN)
    binned = placed.where("len > 0").select("seq_id", "offset", "len", F.explode(F.sequence(lo, hi)).alias("_bin"))
    asked = positions.withColumn("_bin", F.floor(F.col("global_pos") / BIN))
    inside = (F.col("global_pos") >= F.col("offset")) & (F.col("global_pos") < F.col("offset") + F.col("len"))
    return asked.join(binned, "_bin").where(inside).select(*positions.columns, "seq_id", (F.col("global_pos") - F.col("offset")).alias("pos"))


def clipped(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """The parts of blocks between start and end (exclusive)."""
    lo, hi = F.greatest("start", F.lit(start)), F.least(F.col("start") + F.col("len"), F.lit(end))
    rest = [c for c in blocks.columns if c not in ("start", "len")]
    return blocks.where((F.col("start") < end) & (F.col("start") + F.col("len") > start)).select(*rest, lo.cast("long").alias("start"), (hi - lo).cast("long").alias("len"))
