"""Clustering of all records' blocks by containment: against brute force over small packs, and links that are no rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from helixframe.operators import clustering, kmers
from helixframe.plans import modes

FLIP = str.maketrans("acgt", "tgca")


def made_up(n, seed):
    rng = random.Random(seed)
    phrases = ["".join(rng.choice("acgt") for _ in range(rng.randrange(20, 60))) for _ in range(8)]
    out = []
    for i in range(n):
        s = "".join(rng.choice(phrases) if rng.random() < 0.6 else "".join(rng.choice("acgtn") for _ in range(20)) for _ in range(rng.randrange(1, 6)))
        s = s[::-1].translate(FLIP) if rng.random() < 0.4 else s
        out.append((f"{i}:0", i, 0, len(s), s))
    return [*out, ("x:0", 900, 0, 5, "acgtn"), ("y:0", 901, 0, 0, ""), ("z:0", 902, 0, out[0][3], out[0][4])]


def brute(blocks, k):
    sets = {}
    for name, _, _, _, s in blocks:
        windows = [s[p : p + k] for p in range(len(s) - k + 1)]
        sets[name] = {min(x, x[::-1].translate(FLIP)) for x in windows if set(x) <= set("acgt")}
    order = sorted(blocks, key=lambda b: (-b[3], b[1], b[2]))
    links, seeds, taken = {}, [], {}
    for i, b in enumerate(order):
        mine = sets[b[0]]
        for a in order[:i]:
            shared = len(mine & sets[a[0]])
            if mine and round(shared / len(mine), 6) >= 0.5:
                links[a[0], b[0]] = (shared, len(mine))
        taken[b[0]] = next((a for a in seeds if (a, b[0]) in links), b[0])
        if taken[b[0]] == b[0]:
            seeds.append(b[0])
    return links, taken


@pytest.mark.parametrize("k", [11, 23])
def test_clusters_over_packs(spark, monkeypatch, k):
    monkeypatch.setattr(clustering, "PACK", 900)
    monkeypatch.setattr(clustering, "PART", 300)
    monkeypatch.setattr(clustering, "AT_ONCE", 50)
    monkeypatch.setattr(clustering, "LINKS", 7)
    blocks = made_up(90, k)
    links, taken = brute(blocks, k)
    assert 20 < sum(a != b for a, b in taken.items()) and len(links) > 300
    df = spark.createDataFrame(blocks, "seq_id string, record long, start long, len long, seq string").repartition(3)
    found = {(r["seed"], r["member"]): (r["shared"], r["distinct_kmers"]) for r in clustering.containment(df, k).collect()}
    assert found == links
    rows = clustering.contained_clusters(df, k).collect()
    assert len(rows) == len(blocks) and {r["seq_id"]: r["seed"] for r in rows} == taken


@pytest.mark.parametrize(("more", "look"), [(0, 0), (0.4, 8), (1, 1000)])
@pytest.mark.parametrize("leaf", [1, 5, 1000])
def test_halves_meet_seeds_alone(monkeypatch, more, look, leaf):
    for name, value in (("MORE", more), ("LOOK", look), ("LEAF", leaf), ("PART", 700), ("AT_ONCE", 60)):
        monkeypatch.setattr(clustering, name, value)
    blocks = sorted(made_up(120, 7), key=lambda b: (-b[3], b[1], b[2]))
    codes = [np.append(kmers._CODE[np.frombuffer(b[4].encode(), np.uint8)], clustering.END) for b in blocks]
    size = np.array([len(c) for c in codes])
    by = clustering._Blocks(np.concatenate(codes).astype(np.uint8), np.cumsum(size) - size).clustered(11, 17, 0.5)
    assert {b[0]: blocks[i][0] for b, i in zip(blocks, by.tolist(), strict=True)} == brute(blocks, 11)[1]


@pytest.mark.parametrize("k", [5, 11, 21])
def test_places_of_kmers(k):
    """Each k-mer's blocks, and whether a block is among them, as the plain sets have it."""
    rng = np.random.default_rng(k)
    codes = rng.integers(0, 5, 4000).astype(np.uint8)
    codes[99::100] = clustering.END
    places = np.arange(0, 4000, 100)
    x, keys = clustering._Index(codes, places, k, 17), clustering._Sets(codes, places, k, 17)
    asked = np.unique(np.concatenate((keys.kmer, (keys.kmer + np.uint64(1)) & np.uint64((1 << 2 * k) - 1))))
    low, high = x.places(asked)
    blocks = [keys.owner[keys.kmer == q].tolist() for q in asked]
    assert [x.owner[a:b].tolist() for a, b in zip(low, high, strict=True)] == blocks
    for block in (0, 7, 39):
        assert x.have(low, high, np.full(len(asked), block)).tolist() == [block in b for b in blocks]


@pytest.mark.parametrize("tasks", [1, 3, 50])
def test_links_by_slices(monkeypatch, tasks):
    """Slices of members have all links together, and none where blocks meet too often."""
    blocks = sorted(made_up(60, 9), key=lambda b: (-b[3], b[1], b[2]))
    codes = [np.append(kmers._CODE[np.frombuffer(b[4].encode(), np.uint8)], clustering.END) for b in blocks]
    size = np.array([len(c) for c in codes])
    all_ = clustering._Blocks(np.concatenate(codes).astype(np.uint8), np.cumsum(size) - size)
    got = [all_.links(i, tasks, 11, 17, 0.5) for i in range(tasks)]
    found = [(blocks[s][0], blocks[m][0]) for member, seed in got for m, s in zip(member.tolist(), seed.tolist(), strict=True)]
    assert len(found) == len(set(found)) and set(found) == set(brute(blocks, 11)[0])
    monkeypatch.setattr(clustering, "OFTEN", 1)
    assert all_.links(0, 1, 11, 17, 0.5) is None


@pytest.mark.parametrize("often", [0, 32])
def test_seeds_by_links_or_by_halves(spark, monkeypatch, often):
    for name, value in (("PACK", 900), ("PART", 300), ("AT_ONCE", 50), ("OFTEN", often)):
        monkeypatch.setattr(clustering, name, value)
    blocks = made_up(90, 12)
    df = spark.createDataFrame(blocks, "seq_id string, record long, start long, len long, seq string").repartition(3)
    assert {r["seq_id"]: r["seed"] for r in clustering.contained_clusters(df, 11).collect()} == brute(blocks, 11)[1]


def test_taken_blocks_meet_nothing_more(spark, monkeypatch):
    """Copies that a seed of the first pack has taken are in no later pack's index, and no two packs are counted whole."""
    def refused(*_, **__):
        raise AssertionError("all links of two packs")

    monkeypatch.setattr(clustering, "_met", refused)
    monkeypatch.setattr(clustering, "PACK", 4000)
    monkeypatch.setattr(clustering, "PART", 1000)
    jobs, cut = [], clustering.cut
    monkeypatch.setattr(clustering, "cut", lambda df: jobs.append(df.columns) or cut(df))
    rng = random.Random(4)
    s = "".join(rng.choice("acgt") for _ in range(200))
    df = spark.createDataFrame([(f"{i}:0", i, 0, 200, s) for i in range(100)], "seq_id string, record long, start long, len long, seq string")
    assert {r["seed"] for r in clustering.contained_clusters(df, 11).collect()} == {"0:0"}
    assert sum("seeds" in c for c in jobs) == 2


def test_no_blocks(spark):
    none = spark.createDataFrame([], "seq_id string, record long, start long, len long, seq string")
    assert not clustering.containment(none, 11).count() and not clustering.contained_clusters(none, 11).count()


def test_strands(spark):
    blocks = made_up(30, 5)
    turned = [(f"t{b[0]}", b[1], b[2], b[3], b[4][::-1].translate(FLIP)) for b in blocks]
    pairs = [(b[0], f"t{b[0]}") for b in blocks] + [(b[0], b[0]) for b in blocks]
    df = spark.createDataFrame(blocks + turned, "seq_id string, record long, start long, len long, seq string")
    links = spark.createDataFrame(pairs, "seed string, member string")
    want = {(r["seed"], r["member"]): r["strand"] for r in clustering.with_strand(clustering.cosines(links, clustering.profiles(df))).collect()}
    got = {(r["seed"], r["member"]): r["strand"] for r in clustering.strands(links, df).collect()}
    assert {x: got[x] for x in want} == want and got[blocks[0][0], f"t{blocks[0][0]}"] == "-"


def test_links_are_no_rows(spark):
    """A phrase that recurs links all blocks with each other, and only those of a seed matter."""
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    phrase = letters(150)
    seqs = spark.createDataFrame([(i, f"doc{i}", phrase + letters(90)) for i in range(400)], "seq_id long, name string, seq string")
    blocks = seqs.select("seq_id", F.lit(0).cast("long").alias("start"), F.lit(240).cast("long").alias("len"))
    written = lambda: spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    rows = modes.cluster_blocks(spark, seqs, blocks, modes.Settings(measure="containment").checked(), False).collect()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert {(r["cluster_id"], r["type"]) for r in rows} == {(3, "CRP")} and len(rows) == 400
    assert written() - before < 3_000_000


@pytest.mark.parametrize(("name", "rows"), [("pangenome_summary", 4), ("pangenome_spectrum", 4)])
def test_genomes_without_rows_of_links(spark, monkeypatch, name, rows):
    def refused(*_, **__):
        raise AssertionError("all links as rows")

    for f in ("containment", "clusters", "cosines"):
        monkeypatch.setattr(clustering, f, refused)
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() == rows
