"""Windows of all records: against brute force in small packs and buckets, and what they send."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from helixframe.functions import nucleotide as nt
from helixframe.operators import kmers, masking

DATA = "/root/testdata/sf0.001"
FLIP = str.maketrans("acgt", "tgca")


def made_up(n, seed, letters="acgt"):
    rng = random.Random(seed)
    out = ["", "ac", "n" * 40, "acgt" * 10]
    for _ in range(n):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 150)))
        if out and rng.random() < 0.6:
            t = rng.choice(out)
            t = t[rng.randrange(0, len(t) + 1) :][: rng.randrange(1, 60)]
            s = s[:50] + (t if rng.random() < 0.5 else t[::-1].translate(FLIP)) + s[50:]
        out.append(s)
    return out


def canonical(s, k):
    for p in range(len(s) - k + 1):
        x = s[p : p + k]
        if set(x) <= set("acgt"):
            yield p, min(x, x[::-1].translate(FLIP)), x == x[::-1].translate(FLIP)


def small(monkeypatch):
    monkeypatch.setattr(kmers, "PACK", 70)  # shorter than the longest records
    monkeypatch.setattr(kmers, "BUCKET", 40)


@pytest.mark.parametrize(("k", "letters"), [(5, "acgt"), (6, "acgtn"), (12, "acgt"), (31, "ac")])
def test_group_counts(spark, monkeypatch, k, letters):
    small(monkeypatch)
    seqs = made_up(80, k, letters)
    want = defaultdict(Counter)
    for i, s in enumerate(seqs):
        for _, x, _ in canonical(s, k):
            want[x][i % 2] += 1
    value = lambda x: int("".join(str("acgt".index(c)) for c in x), 4)
    df = spark.createDataFrame([(i % 2, s) for i, s in enumerate(seqs)], "group int, seq string").repartition(3)
    got = {r["ck"]: dict(zip(r["groups"], r["members"], strict=True)) for r in kmers.group_counts(df, k, 2, sum(map(len, seqs))).collect()}
    assert got == {value(x): dict(n) for x, n in want.items() if sum(n.values()) > 1}


@pytest.mark.parametrize("k", [4, 5, 9, 31])
def test_shared_stretches(spark, monkeypatch, k):
    small(monkeypatch)
    seqs = made_up(80, 100 + k, "acgtn" if k == 5 else "acgt")
    n = Counter(x for s in seqs for _, x, _ in canonical(s, k))
    want = {(i, p) for i, s in enumerate(seqs) for p, x, own in canonical(s, k) if n[x] > 1 or own}
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string").repartition(3)
    rows = [(r["seq_id"], p) for r in kmers.shared_stretches(df, k).collect() for p in range(r["first"], r["last"] + 1)]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_runs_of_spans_over_segments(spark, monkeypatch):
    seqs = made_up(80, 7)
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    starts = kmers.repeated(df, 7, True)
    bars = spark.createDataFrame([(i, 20, 15) for i in range(0, 84, 3)] + [(5, 0, 0), (400, 1, 2)], "seq_id long, start long, len long")
    monkeypatch.setattr(masking, "SEGMENT", 16)
    for excluded in (None, bars):
        want = masking.runs(starts, 7, 3) if excluded is None else masking.runs_without(starts, 7, 3, excluded)
        got = masking.runs_of_spans(kmers.shared_spans(df, 7, 16), 7, 3, excluded)
        columns = ("seq_id", "first", "last", "high")
        assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())


def test_no_windows_at_all(spark):
    for seqs in ([], [(0, ""), (1, "nnn")]):
        df = spark.createDataFrame(seqs, "seq_id long, seq string")
        assert not kmers.shared_stretches(df, 19).count()
        assert not kmers.group_counts(df.select(F.lit(0).alias("group"), "seq"), 19, 1, 0).count()


@pytest.mark.parametrize("name", ["genome_summary", "homology_unique", "repeat_blocks_joint", "run_homology", "presence_matrix", "unique_families", "family_presence"])
def test_windows_are_no_rows(spark, name):
    """A window takes few bytes of a shuffle."""
    letters = spark.read.parquet(f"{DATA}/documents.parquet").agg(F.sum(F.length("text"))).head()[0]
    written = lambda: spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    __spark_entry__.queries()[name](spark, DATA).write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert 0 < written() - before < 8 * letters


def test_letters_of_odd_texts(spark):
    odd = ["".join(map(chr, range(0, 400))), "İıſK ß", "a😀b𝐀ć", "", None, "x퟿￿y", "ACGTacgt-\\]^[$1 n"]
    want = ["".join("acgt"[(ord(c.lower()) - 97) % 4] for c in s or "" if c.isascii() and c.isalpha()) for s in odd]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, x string").select("i", nt.from_text(F.col("x")).alias("y")).collect()
    assert [y for _, y in sorted(map(tuple, rows))] == want
