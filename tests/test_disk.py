"""What stays on disk while a query runs, and how often it reads: shuffles leave with the checkpoint that is made of them."""

import contextlib
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from helixframe.operators import kmers, masking, ssr
from helixframe.plans import runs
from helixframe.runtime import cut

DATA = "/root/testdata/sf0.001"


def on_disk(spark):
    """Bytes of shuffles on disk."""
    total = 0
    for folder in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs():
        for path in Path(folder.getPath()).rglob("shuffle_*.data"):
            with contextlib.suppress(OSError):  # a file may go meanwhile
                total += path.stat().st_size
    return total


def soon(holds):
    """Files are removed a little later."""
    return any(holds() or time.sleep(0.5) for _ in range(20))


def test_cut_leaves_no_shuffle(spark):
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = on_disk(spark), spark.conf.get(conf, None)
    got = cut(spark.range(10000).groupBy((F.col("id") % 997).alias("k")).count())
    assert soon(lambda: on_disk(spark) <= before)
    assert got.count() == 997 and spark.conf.get(conf, None) == was


@pytest.mark.parametrize("name", ["repeat_blocks_joint", "run_homology"])
def test_windows_have_left_the_disk(spark, name):
    """Of what has been shuffled, most isn't on disk any more when the result is there."""
    written = lambda: spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before, first = on_disk(spark), written()
    __spark_entry__.queries()[name](spark, DATA).write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert soon(lambda: on_disk(spark) - before < 0.6 * (written() - first))


def test_lengths_from_packs(spark, monkeypatch):
    monkeypatch.setattr(kmers, "PACK", 70)
    rng = random.Random(3)
    seqs = ["".join(rng.choice("acgtn") for _ in range(n)) for n in (0, 5, 6, 7, 69, 70, 71, 75, 76, 140, 300)]
    _, lengths = kmers.spans_and_lengths(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string").repartition(2), 7, 1 << 20)
    assert sorted(map(tuple, lengths.collect())) == [(i, len(s)) for i, s in enumerate(seqs) if len(s) >= 7]


def test_tandem_repeats_of_records_together(spark, monkeypatch):
    monkeypatch.setattr(kmers, "CHUNK", 200)
    rng = random.Random(5)
    units = ["".join(rng.choice("acgtn") for _ in range(rng.randrange(1, 16))) for _ in range(60)]
    seqs = ["", "a", "acacac", None, *(u * rng.randrange(1, 12) + rng.choice(["", "gattaca"]) for u in units), "ac" * 400]
    want = [(i, int(a), int(b - a)) for i, s in enumerate(seqs) for a, b in ssr.tandem_spans(kmers._CODE[np.frombuffer((s or "").encode(), np.uint8)])]
    got = ssr.ssr_blocks(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string").repartition(2))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_letters_are_read_once(spark):
    """A filter on the letters doesn't make them again."""
    plan = runs._records(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("translate(") == 1


def test_blocks_joint_need_no_second_reading(spark):
    df = runs._records(spark, DATA)
    blocks = masking.repeat_blocks(df, 19, 80, shared=True)
    assert "FileScan" not in blocks._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits", [8, 40, 62, 64])
def test_order_of_keys(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 5000):
        keys = rng.integers(0, 1 << bits, n, np.uint64) if bits < 64 else rng.integers(0, (1 << 64) - 1, n, np.uint64)
        got, order = kmers._order(keys, bits)
        assert (got == np.sort(keys)).all() and (keys[order] == got).all() and sorted(order.tolist()) == list(range(n))
