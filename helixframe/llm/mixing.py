"""Mixing sources to target weights by cube-method balanced sampling.

A source's target divided by its size is how often each of its documents is taken on average:
the whole part for sure, the fraction as an inclusion probability. The cube method (Deville and
Tille, 2004) moves the vector of these probabilities inside the unit cube, along directions in the
null space of the balancing constraints, so that the totals of words and of documents stay as they
are, until coordinates reach 0 or 1. Here the flight runs in blocks of about BLOCK_ROWS documents
of one source, with three documents in the air at a time (one more than constraints); what is left
of each block, two documents at most, flies on in blocks of the next level, until one block per
source is left. Then the landing chooses among the roundings of the last documents, a dozen at most,
that with the least error in words, then in documents.

Documents enter a block by falling size, so that small ones are left to even out large ones. Blocks and coins come
from hashes of the documents and SEED: the same rows give the same mix in any partitioning.

Defined results: null text has size 0; a source without words has target 0 and none of it is
taken; a null doc_id or source is a value like others; equal rows, of which nothing is known but their
number until they are dealt over blocks, are mixed as often as they stand there; texts of any length are
counted whole; an empty table gives an empty result. mix() has the columns it lists; repeat_documents()
gives all columns of docs back, of whatever name.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
BLOCK_ROWS = 512
SEED = 7
#: Documents of a source, of sizes from its upper quarter down, that wait for the landing, besides two at most left by the flight.
LANDING = 10
_EPS = 1e-9


def size_of(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, source_rows, target: one row for each source of sizes(source, size).

    The capped shares are min(cap, weight * level) for the one level at which they add up: the
    sources, in the order of cap / weight at which they fill, are full up to some point. All of it
    is on the table of sources, which has one row for each.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("source_rows"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("_at") % len(WEIGHTS) + 1).cast("int"))
    one = F.lit(0)  # one window over the sources
    totals = totals.withColumn("_at", F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1)
    totals = totals.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * float(MOST_COPIES))
    everything = F.sum("source_size").over(Window.partitionBy(one)) * (SHARE_PERCENT / 100)
    fills = Window.partitionBy(one).orderBy(F.col("_cap") / F.col("_weight"), "_at")
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    after = fills.rowsBetween(0, Window.unboundedFollowing)
    level = (everything - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    # the first source that the level of its own and all later ones doesn't fill sets the level for these
    totals = totals.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("_weight") < F.col("_cap"))
    totals = totals.withColumn("_final", F.min(F.when(F.col("_open"), F.col("_level"))).over(Window.partitionBy(one)))
    totals = totals.withColumn("_first", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_at"))) ).over(Window.partitionBy(one)))
    opened = F.col("_first").isNotNull() & (F.struct(F.col("_cap") / F.col("_weight"), F.col("_at")) >= F.col("_first"))
    first_level = F.min_by("_level", F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_at")))).over(Window.partitionBy(one))
    return totals.withColumn("target", F.when(opened, F.col("_weight") * first_level).otherwise(F.col("_cap"))).select("source", "source_size", "source_rows", "target")


def flight(size: np.ndarray, pi: np.ndarray, rng: random.Random, last: bool) -> np.ndarray:
    """Probabilities after the flight: two at most stay between 0 and 1, none after the last."""
    # what rounding has left beside 0 or 1 is there already
    pi, size = [float(round(p)) if p < _EPS or p > 1 - _EPS else p for p in pi.tolist()], size.tolist()
    air: list[int] = []
    flying = [i for i, p in enumerate(pi) if 0 < p < 1]
    ground = sorted({flying[int(x)] for x in np.linspace(len(flying) // 4, len(flying) - 1, min(LANDING, len(flying)))}) if last and flying else []
    kept = set(ground)
    rest = iter([i for i in flying if i not in kept])
    while True:
        while len(air) < 3 and (i := next(rest, None)) is not None:
            air.append(i)
        if len(air) < 3:
            break
        a, b, c = air
        # orthogonal to (1, 1, 1) and to the sizes
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - pi[i]) / v if v > 0 else -pi[i] / v for i, v in zip(air, u, strict=True) if v)
        down = min(pi[i] / v if v > 0 else (pi[i] - 1) / v for i, v in zip(air, u, strict=True) if v)
        step = up if rng.random() * (up + down) < down else -down
        for i, v in zip(air, u, strict=True):
            pi[i] += step * v
            if pi[i] < _EPS or pi[i] > 1 - _EPS:
                pi[i] = float(round(pi[i]))
        air = [i for i in air if 0 < pi[i] < 1]
    if last and (air := air + ground):
        masks = np.arange(1 << len(air))[:, None] >> np.arange(len(air)) & 1
        sizes, chances = np.array([size[i] for i in air]), np.array([pi[i] for i in air])
        words, number = np.abs(masks @ sizes - chances @ sizes), np.abs(masks.sum(1) - chances.sum())
        best = np.lexsort((np.arange(len(masks)), number, words))[0]
        for i, p in zip(air, masks[best], strict=True):
            pi[i] = float(p)
    return np.array(pi)


def mix(docs: DataFrame, carry: list[str] | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """carry (by default doc_id), source, size, source_size, target, taken.

    carry names the columns that tell documents apart; equal ones are interchangeable.
    """
    carry = carry or ["doc_id"]
    cols = [*dict.fromkeys([*carry, "source"])]
    # equal rows are counted first, so that no task meets all of a large group of them, and get a number each
    rows = docs.select(*cols, size_of().alias("size")).groupBy(*cols, "size").agg(F.count("*").alias("_n"))
    rows = common.cut(rows.withColumn("_at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n"))
    goal = common.cut(targets(rows.select("source", "size")))
    goal = goal.withColumnRenamed("source", "_source")
    if goal.count() <= 20_000:  # a row of some 50 bytes for each source
        goal = F.broadcast(goal)
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    often = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_often", often).withColumn("_whole", F.floor("_often").cast("long"))
    rows = rows.withColumn("_pi", F.col("_often") - F.col("_whole"))
    # a block is some of one source's rows; which one only depends on the row and on how many rows the source has
    rows = rows.withColumn("_key", F.xxhash64(F.lit(seed), *cols, "size", "_at"))
    air = rows.select(*cols, "size", "source_size", "target", "_whole", "_pi", "_key", F.ceil(F.col("source_rows") / block_rows).cast("long").alias("_fan"))
    most = -(-(goal.agg(F.max("source_rows")).head()[0] or 1) // block_rows)  # the largest _fan
    schema = air.schema

    def level(frame: DataFrame, depth: int) -> DataFrame:
        def fly(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "_key"], ascending=[False, True], kind="stable").reset_index(drop=True)
            rng = random.Random(f"{seed}:{depth}:{len(pdf)}:{int(pdf['_key'].iloc[0])}")
            pdf["_pi"] = flight(pdf["size"].to_numpy(float), pdf["_pi"].to_numpy(float), rng, int(pdf["_fan"].iloc[0]) == 1)
            return pdf.drop(columns=["_block"])

        block = F.pmod(F.xxhash64(F.lit(depth), F.col("_key")), F.col("_fan"))
        return frame.withColumn("_block", block).groupBy("source", "_block").applyInPandas(fly, schema)

    done, depth = None, 0
    while True:
        moved = common.cut(level(air, depth))
        landed = moved.where("_pi = 0 or _pi = 1")
        done = landed if done is None else done.unionByName(landed)
        if most == 1:
            break
        # two at most are left of each block
        air = moved.where("_pi > 0 and _pi < 1").withColumn("_fan", F.ceil(F.col("_fan") * 2 / block_rows).cast("long"))
        most = -(-most * 2 // block_rows)
        depth += 1
    taken = ((F.col("_whole") + F.col("_pi").cast("long")) * F.col("size")).alias("taken")
    return done.select(*cols, "size", "source_size", "target", taken, (F.col("_whole") + F.col("_pi").cast("long")).alias("copies"))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it, which may be never."""
    plain, back = common.masked(docs, "doc_id", "source", "text")
    kinds = {c: plain.schema[c].dataType.simpleString() for c in plain.columns}
    keyed = plain.withColumn("_row", F.xxhash64(*[F.col(c) for c in plain.columns if "map" not in kinds[c]]))
    mixed = mix(keyed.select("doc_id", "_row", "source", "text"), ["doc_id", "_row"])
    total = mixed.groupBy("doc_id", "_row").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).withColumnsRenamed({"doc_id": "_id", "_row": "_of"})
    met = keyed.join(total.where("_copies > 0"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_of")))
    # of equal rows one stands for all; they meet in each task before they are shuffled
    one = met.where("_rows = 1").unionByName(met.where("_rows > 1").dropDuplicates(["_id", "_row"]))
    return one.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*back)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
