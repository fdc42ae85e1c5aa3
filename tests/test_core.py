"""Operators against brute force on small sequences, and their properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import nucleotide as nt
from helixframe.operators import alignment, clustering, compare, coords, families, kmers, masking, ssr
from helixframe.runtime import send_package

FLIP = str.maketrans("acgt", "tgca")


@pytest.fixture(autouse=True)
def sent(spark):
    send_package(spark)


def table(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id long, seq string")


def random_sequences(n, seed, letters="acgt"):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 150)))
        for _ in range(rng.randint(0, 3)):
            if len(s) > 20:
                a = rng.randrange(len(s) - 10)
                part = s[a : a + rng.randint(5, 40)]
                at = rng.randrange(len(s))
                s = s[:at] + (part[::-1].translate(FLIP) if rng.random() < 0.4 else part) + s[at:]
        out.append(s)
    return out


def brute_coverage(seqs, k, shared, barred=()):
    """Coverage by counting windows on both strands."""
    windows = lambda s: [(i, s[i : i + k]) for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("acgt")]
    counts = []
    for s in seqs:
        c = {}
        for strand in (s, s[::-1].translate(FLIP)):
            for _, w in windows(strand):
                c[w] = c.get(w, 0) + 1
        counts.append(c)
    if shared:
        total = {}
        for c in counts:
            for w, n in c.items():
                total[w] = total.get(w, 0) + n
        counts = [total] * len(seqs)
    out = []
    for i, s in enumerate(seqs):
        cov = [0] * len(s)
        for at, w in windows(s):
            if counts[i][w] > 1:
                for j in range(at, at + k):
                    cov[j] += 2
        for start, size in barred[i] if barred else ():
            cov[start : start + size] = [0] * size
        out.append(cov)
    return out


def brute_blocks(cov, k, min_len):
    top, blocks, i = k // 2 - 1, [], 0
    while i < len(cov):
        j = i
        while j < len(cov) and cov[j] > 1:
            j += 1
        if j > i and sum(c > top for c in cov[i:j]) > 1:
            end = min(len(cov) - 1, j - 1 + k - 1)
            if blocks and blocks[-1][1] >= i:
                blocks[-1][1] = max(blocks[-1][1], end)
            else:
                blocks.append([i, end])
        i = max(j, i + 1)
    return [(a, e - a + 1) for a, e in blocks if e - a + 1 > min_len]


@pytest.mark.parametrize(("k", "shared"), [(3, False), (4, True), (5, False), (7, True), (9, False), (6, False)])
def test_blocks(spark, k, shared):
    seqs = random_sequences(60, k, "acgtn" if k % 2 else "acgt")
    df = table(spark, seqs)
    cov = brute_coverage(seqs, k, shared)
    got = {}
    for r in masking.coverage(kmers.repeated(df, k, shared), k).collect():
        got[r["seq_id"], r["pos"]] = r["coverage"]
    assert got == {(i, p): c for i, row in enumerate(cov) for p, c in enumerate(row) if c}
    want = sorted((i, a, n) for i, row in enumerate(cov) for a, n in brute_blocks(row, k, 12))
    assert sorted(map(tuple, masking.repeat_blocks(df, k, 12, shared).select("seq_id", "start", "len").collect())) == want


def test_blocks_over_segments(spark, monkeypatch):
    monkeypatch.setattr(masking, "SEGMENT", 16)
    monkeypatch.setattr(kmers, "LOCAL_BASES", 40)
    monkeypatch.setattr(kmers, "CHUNK", 11)
    seqs = random_sequences(60, 21)
    want = sorted((i, a, n) for i, row in enumerate(brute_coverage(seqs, 5, False)) for a, n in brute_blocks(row, 5, 12))
    assert sorted(map(tuple, masking.repeat_blocks(table(spark, seqs), 5, 12).select("seq_id", "start", "len").collect())) == want


def test_blocks_without_tandem_repeats(spark):
    seqs = [s + "ca" * 12 + s[:30] for s in random_sequences(30, 4)]
    df = table(spark, seqs)
    found = ssr.ssr_blocks(df).collect()
    barred = [[(r["start"], r["len"]) for r in found if r["seq_id"] == i] for i in range(len(seqs))]
    want = sorted((i, a, n) for i, row in enumerate(brute_coverage(seqs, 5, False, barred)) for a, n in brute_blocks(row, 5, 12))
    got = masking.repeat_blocks(df, 5, 12, excluded=ssr.ssr_blocks(df))
    assert sorted(map(tuple, got.select("seq_id", "start", "len").collect())) == want


def test_blocks_mirror_on_the_other_strand(spark):
    seqs = random_sequences(30, 9)
    one = masking.repeat_blocks(table(spark, seqs), 5, 1).agg(F.count("*")).head()[0]
    cov = masking.coverage(kmers.repeated(table(spark, seqs), 5, False), 5).collect()
    flip = masking.coverage(kmers.repeated(table(spark, [s[::-1].translate(FLIP) for s in seqs]), 5, False), 5).collect()
    assert one and {(r["seq_id"], len(seqs[r["seq_id"]]) - 1 - r["pos"], r["coverage"]) for r in cov} == {tuple(r) for r in flip}


def test_tandem_repeats():
    def brute(s):
        hit = set()
        for u in range(1, 15):
            i = u
            while i < len(s):
                j = i
                while j < len(s) and s[j] == s[j - u] and s[j] in "acgt":
                    j += 1
                if j > i and j - i + u >= max(12, 3 * u):
                    hit.update(range(i - u, j))
                i = max(j, i + 1)
        return hit

    rng = random.Random(2)
    for _ in range(200):
        unit = "".join(rng.choice("acgtn") for _ in range(rng.randint(1, 15)))
        s = "".join(rng.choice("acgt") for _ in range(rng.randint(0, 30))) + unit * rng.randint(0, 6) + "".join(rng.choice("ac") for _ in range(rng.randint(0, 30)))
        spans = ssr.tandem_spans(kmers._CODE[np.frombuffer(s.encode(), np.uint8)])
        assert {i for a, b in spans for i in range(a, b)} == brute(s)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_mask_import(spark):
    rows = [(0, "ACGTacgtACacgtA", None), (1, "acgtACGTAacgt", None), (2, "AAAA", None), (3, "", None), (4, "AAacgtacAA", [(2, 3)]), (5, "AAacgAA", [(0, 7)])]
    df = spark.createDataFrame([(i, s, [{"start": a, "len": n} for a, n in b] if b else None) for i, s, b in rows], "seq_id long, seq string, ssr array<struct<start:long,len:long>>")
    got = masking.merged_runs(masking.case_runs(df), 4, 3).collect()
    # ends 7 and 3: the next runs begin 3 (joined) and 6 (apart) after; record 4 begins after its tandem repeat
    assert sorted((r["seq_id"], r["start"], r["len"]) for r in got) == [(0, 4, 10), (1, 0, 4), (1, 9, 4), (4, 5, 3)]
    upper = masking.merged_runs(masking.case_runs(df.select("seq_id", "seq"), upper=True), 1, 4).collect()
    assert sorted((r["seq_id"], r["start"], r["len"]) for r in upper) == [(0, 0, 4), (1, 4, 5), (2, 0, 4)]


def test_minimal_lengths(spark):
    """A mask's block of just the least length stays when imported, and goes when found."""
    runs = spark.createDataFrame([(0, 0, 79), (0, 200, 278)], "seq_id long, first long, last long")
    assert [r["len"] for r in masking.merged_runs(runs, 38, 80).collect()] == [80]
    covered = spark.createDataFrame([(0, 0, 61, 20)], "seq_id long, first long, last long, high long")
    lengths = spark.createDataFrame([(0, 500)], "seq_id long, len long")
    assert masking.build_blocks(covered, lengths, 19, 80).count() == 0 and masking.build_blocks(covered, lengths, 19, 79).head()["len"] == 80


def test_soft_mask(spark):
    df = spark.createDataFrame([(0, "acgtacgt", "x"), (1, "acg", "y"), (2, "", "z")], "seq_id long, seq string, name string")
    blocks = spark.createDataFrame([(0, 2, 3), (0, 4, 2)], "seq_id long, start long, len long")
    assert {r["seq_id"]: r["seq"] for r in masking.soft_mask(df, blocks).collect()} == {0: "ACgtacGT", 1: "ACG", 2: ""}


def test_alignment_masks_copies(spark):
    rng = random.Random(3)
    unit = "".join(rng.choice("acgt") for _ in range(120))
    edited = list(unit)
    for at in (30, 70, 100):
        edited[at] = {"a": "c", "c": "g", "g": "t", "t": "a"}[edited[at]]
    filler = lambda: "".join(rng.choice("acgt") for _ in range(200))
    seq = filler() + unit + filler() + "".join(edited) + filler() + unit[::-1].translate(FLIP) + filler()
    blocks = alignment.align_blocks(table(spark, [seq, filler(), ""]), 19, 60).collect()
    assert {r["seq_id"] for r in blocks} == {0}
    starts = sorted(r["start"] for r in blocks)
    assert len(starts) == 3 and all(abs(a - b) <= 40 for a, b in zip(starts, (200, 520, 840), strict=True))


def brute_alignment(s, k, least):
    """Marks by reading each pair letter by letter, in order, on both strands."""
    n, code = len(s), {"a": 0, "c": 1, "g": 2, "t": 3}
    own = [code.get(x, 4) for x in s]
    both = own + [4] + [3 - x if x < 4 else 4 for x in reversed(own)]
    end = lambda p: n if p < n else 2 * n + 1
    places = {}
    for p in [*range(n - k + 1), *range(n + 1, 2 * n + 2 - k)]:
        if 4 not in both[p : p + k]:
            places.setdefault(tuple(both[p : p + k]), []).append(p)
    mark = [False] * (2 * n + 1)
    for ps in sorted(places.values()):
        for i, x in enumerate(ps):
            for y in ps[i + 1 :]:
                if mark[x] or mark[y]:
                    continue
                h, chain = k, []
                while h < min(end(x) - x, end(y) - y) and not both[x + h] == both[y + h] == 4:
                    if both[x + h] != both[y + h]:
                        chain = [*chain, h] if chain and h - chain[-1] <= 2 else [h]
                        if len(chain) == 4:
                            h -= 3
                            break
                    h += 1
                if h > least:
                    for r in range(h):
                        mark[x + r] = mark[y + r if y < n else 2 * n - y - r] = True
    hit = [i for i in range(n) if mark[i]]
    out = {*hit}
    for a, b in zip(hit, hit[1:], strict=False):
        if b - a <= least + 1:
            out.update(range(a, b))
    return out


def test_alignment_against_brute_force():
    """Copies on both strands, changed letters, gaps: the marks of all records are those of a pass letter by letter."""
    marked = 0
    for seed in range(400):
        rng = random.Random(seed)
        s = "".join(rng.choice("acgt") for _ in range(rng.randint(0, 120)))
        for _ in range(rng.randint(0, 4)):
            if len(s) > 20:
                a = rng.randrange(len(s) - 10)
                part = list(s[a : a + rng.randint(8, 50)])
                for _ in range(rng.randint(0, 4)):
                    part[rng.randrange(len(part))] = rng.choice("acgtn")
                part, at = "".join(part), rng.randrange(len(s))
                s = s[:at] + (part[::-1].translate(FLIP) if rng.random() < 0.5 else part) + s[at:]
        k, least = rng.choice((3, 4, 5, 7)), rng.choice((3, 6, 10, 14))
        got = alignment.masked(kmers._CODE[np.frombuffer(s.encode(), np.uint8)], k, least)
        assert set(np.flatnonzero(got).tolist()) == brute_alignment(s, k, least)
        marked += got.any()
    assert marked > 200


def test_longest_kmers(spark):
    with pytest.raises(ValueError):
        kmers.windows(table(spark, ["acgt"]), 32)
    assert kmers.windows(table(spark, ["acgt" * 8]), 31).count() == 2


def test_coordinates(spark, monkeypatch):
    monkeypatch.setattr(coords, "BUCKET", 3)
    monkeypatch.setattr(coords, "BIN", 8)
    lens = [random.Random(1).randint(0, 40) for _ in range(50)]
    placed = coords.offsets(spark.createDataFrame([(i, "a" * n) for i, n in enumerate(lens)], "seq_id long, seq string"))
    assert {r["seq_id"]: r["offset"] for r in placed.collect()} == {i: sum(lens[:i]) for i in range(50)}
    asked = spark.range(sum(lens)).select(F.col("id").alias("global_pos"))
    got = {r["global_pos"]: (r["seq_id"], r["pos"]) for r in coords.locate(asked, placed).collect()}
    assert got == {sum(lens[:i]) + p: (i, p) for i, n in enumerate(lens) for p in range(n)}
    blocks = spark.createDataFrame([(0, 0, 5), (0, 8, 10), (0, 30, 5)], "seq_id long, start long, len long")
    assert sorted((r["start"], r["len"]) for r in coords.clipped(blocks, 4, 12).collect()) == [(4, 1), (8, 4)]


def test_families(spark):
    rows = [("a", 1, 2, 20), ("b", 1, 1, 10), ("c", 1, 1, 10), ("a", 2, 1, 5), ("b", 3, 1, 7), ("c", 3, 2, 9), ("a", 1, 1, 1)]
    present = families.presence(spark.createDataFrame(rows, "genome string, family long, members long, bp long")).cache()
    fam = families.categories(present, 3).cache()
    assert {r["family"]: (r["category"], r["frequency"], r["total_bp"]) for r in fam.collect()} == {1: ("core", 3, 41), 2: ("unique", 1, 5), 3: ("accessory", 2, 16)}
    assert [(r["present_in"], r["families"]) for r in families.spectrum(fam, 3).orderBy("present_in").collect()] == [(1, 1), (2, 1), (3, 1)]
    marked = families.marked(present, ["a", "b", "c", "d"], 0)
    pairs = {(r["genome_i"], r["genome_j"]): (r["shared"], r["union_size"], r["jaccard"]) for r in families.pairwise(marked, ["a", "b", "c", "d"]).collect()}
    assert pairs[("a", "b")] == (1, 3, 0.3333) and pairs[("b", "c")] == (2, 2, 1.0) and pairs[("a", "d")] == (0, 2, 0.0) and len(pairs) == 6
    wide = {r["family"]: (r["a"], r["b"], r["c"]) for r in families.matrix(present, fam, ["a", "b", "c"]).collect()}
    assert wide == {1: (3, 1, 1), 2: (1, 0, 0), 3: (0, 1, 2)}
    alone = families.categories(families.presence(spark.createDataFrame([("a", 1, 1, 1)], "genome string, family long, members long, bp long")), 1).head()
    assert alone["category"] == "core"


def test_clusters_equal_the_serial_pass(spark):
    rng = random.Random(5)
    n = 60
    blocks = spark.createDataFrame([(f"b{i}", "r", i, 1000 - i) for i in range(n)], "seq_id string, record string, start long, len long")
    links = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.06}
    taken = {}
    for i in range(n):
        if i not in taken:
            taken[i] = i
            for j in range(i + 1, n):
                if (i, j) in links and j not in taken:
                    taken[j] = i
    got = clustering.clusters(blocks, spark.createDataFrame([(f"b{i}", f"b{j}") for i, j in links], "seed string, member string"))
    assert {r["seq_id"]: r["seed"] for r in got.collect()} == {f"b{i}": f"b{s}" for i, s in taken.items()}


def test_planted_families(spark):
    """Copies on both strands of two units come together, and a lone block stays alone."""
    rng = random.Random(6)
    new = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    units = [new(300), new(260)]
    seqs, kinds = [], []
    for u, unit in enumerate(units):
        for i in range(4):
            s = list(unit[: len(unit) - 10 * i])
            s[50] = "a" if s[50] != "a" else "c"
            s = "".join(s)
            seqs.append(s[::-1].translate(FLIP) if i % 2 else s)
            kinds.append(u)
    seqs.append(new(280))
    blocks = spark.createDataFrame([(f"0:{i}", "0", i, len(s), s) for i, s in enumerate(seqs)], "seq_id string, record string, start long, len long, seq string")
    got = clustering.numbered(blocks, clustering.clusters(blocks, clustering.containment(blocks, 15)))
    ids = {r["start"]: r["cluster_id"] for r in got.collect()}
    assert {ids[i] for i in range(4)} == {3} and {ids[i] for i in range(4, 8)} == {4} and ids[8] == 2
    near = clustering.cosines(clustering.containment(blocks, 15), clustering.profiles(blocks)).collect()
    for r in near:
        a, b = (int(r[c].split(":")[1]) for c in ("seed", "member"))
        assert (r["cosine_reverse"] > r["cosine"]) == (a % 2 != b % 2)


def mutated(rng, s, share):
    return "".join(rng.choice([x for x in "acgt" if x != c]) if rng.random() < share else c for c in s)


def named_blocks(spark, seqs):
    return spark.createDataFrame([(f"0:{i}", "0", i, len(s), s) for i, s in enumerate(seqs)], "seq_id string, record string, start long, len long, seq string")


def test_containment_against_brute_force(spark):
    rng = random.Random(7)
    new = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    hot = new(30)  # stands in all blocks
    units = [new(200) for _ in range(4)]
    seqs = [hot + mutated(rng, rng.choice(units)[rng.randint(0, 60) :], 0.01) + hot for _ in range(40)]
    sets = [{min(s[i : i + 11], s[i : i + 11][::-1].translate(FLIP)) for i in range(len(s) - 10)} for s in seqs]
    order = sorted(range(40), key=lambda i: (-len(seqs[i]), i))
    for least in (0.5, 0.2, 0.9):
        want = {(f"0:{a}", f"0:{b}"): (len(sets[a] & sets[b]), len(sets[b])) for x, a in enumerate(order) for b in order[x + 1 :] if round(len(sets[a] & sets[b]) / len(sets[b]), 6) >= least}
        got = {(r["seed"], r["member"]): (r["shared"], r["distinct_kmers"]) for r in clustering.containment(named_blocks(spark, seqs), 11, least).collect()}
        assert got == want


def test_composition_against_brute_force(spark):
    """Whole blocks and windows of the member's scale, on both strands, over several tiles."""
    rng = random.Random(8)
    new = lambda n: "".join(rng.choice("acgtn" if rng.random() < 0.05 else "acgt") for _ in range(n))
    seqs = [new(rng.randint(3, 260)) for _ in range(30)]
    seqs += [s[20 : 20 + rng.randint(30, 90)][::-1].translate(FLIP) for s in seqs[:6] if len(s) > 120]

    def counts(s):
        out = {}
        for i in range(len(s) - 3):
            if set(s[i : i + 4]) <= set("acgt"):
                out[s[i : i + 4]] = out.get(s[i : i + 4], 0) + 1
        return out

    def cosine(a, b):
        size = sum(x * x for x in a.values()) * sum(x * x for x in b.values())
        return sum(n * b.get(w, 0) for w, n in a.items()) / size**0.5 if size else 0.0

    want = {}
    order = sorted(range(len(seqs)), key=lambda i: (-len(seqs[i]), i))
    for x, a in enumerate(order):
        for b in order[x + 1 :]:
            width = max([w for w in clustering.WIDTHS if w <= len(seqs[b])], default=clustering.WIDTHS[0])
            step, m = width // 4, max(0, len(seqs[a]) - 3)
            parts = [seqs[a]] + [seqs[a][j * step : j * step + width + 3] for j in range(m // step - 3)]
            mine = counts(seqs[b])
            turned = {w[::-1].translate(FLIP): n for w, n in mine.items()}
            both = [max(cosine(counts(p), other) for p in parts) for other in (mine, turned)]
            if max(both) >= 0.6:
                want[f"0:{a}", f"0:{b}"] = tuple(both)
    for tile in (1000, 7):
        got = {(r["seed"], r["member"]): (r["cosine"], r["cosine_reverse"]) for r in clustering.composition(named_blocks(spark, seqs), least=0.6, tile=tile).collect()}
        assert set(got) == set(want) and all(np.allclose(got[p], want[p], atol=1e-6) for p in want)


def simulated(spark, divergence, size, families_, copies, seed):
    """Scores of both measures on planted families in one genome: (precision, recall) over pairs of copies, half of them turned round."""
    rng = random.Random(seed)
    new = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    units = [new(size) for _ in range(families_)]
    placed = [(f, rng.random() < 0.5) for f in range(families_) for _ in range(copies)]
    rng.shuffle(placed)
    seqs, genome = [], ""
    for f, turned in placed:
        s = mutated(rng, units[f], divergence)
        s = s[::-1].translate(FLIP) if turned else s
        seqs.append(s)
        genome += new(300) + s
    blocks = named_blocks(spark, seqs)
    out = {}
    floors = clustering.chance_floor(table(spark, [genome[i : i + 20_000] for i in range(0, len(genome), 20_000)]))
    for measure, links in (("profile", clustering.composition(blocks, floors)), ("containment", clustering.containment(blocks, 11))):
        ids = {r["start"]: r["cluster_id"] for r in clustering.numbered(blocks, clustering.clusters(blocks, links)).collect()}
        together = [(i, j) for i in ids for j in ids if i < j and ids[i] == ids[j] > 2]
        true = sum(placed[i][0] == placed[j][0] for i, j in together)
        out[measure] = (true / max(1, len(together)), true / (families_ * copies * (copies - 1) / 2))
    return out


def test_measures_on_planted_families(spark):
    """Few changes: both measures find the families. Many: exact k-mers are gone, and composition still does."""
    near = simulated(spark, 0.02, 800, 12, 10, 1)
    assert near["profile"][0] >= 0.95 and near["profile"][1] >= 0.9 and near["containment"][0] >= 0.95 and near["containment"][1] >= 0.9
    far = simulated(spark, 0.12, 800, 12, 10, 2)
    assert far["profile"][0] >= 0.9 and far["profile"][1] >= 0.5 and far["profile"][1] > far["containment"][1] + 0.3


def test_part_of_a_longer_block(spark):
    """A short element that copies a part of a long block is linked by windows, where the whole block's composition hides it."""
    rng = random.Random(10)
    new = lambda n, letters="acgt": "".join(rng.choice(letters) for _ in range(n))
    inner = new(240, "aacg")
    long = new(900, "ggtca") + inner + new(1400, "ttacg")
    blocks = named_blocks(spark, [long, mutated(rng, inner, 0.05)])
    windows = clustering.composition(blocks).head()
    whole = clustering.cosines(spark.createDataFrame([("0:0", "0:1")], "seed string, member string"), clustering.profiles(blocks)).head()
    assert windows["cosine"] > 0.9 > whole["cosine"] + 0.05


def test_clusters_of_each_record(spark):
    blocks = spark.createDataFrame([(f"{r}:{i}", r, i, 300 - i, "acgtta" * 50) for r in "ab" for i in range(3)], "seq_id string, record string, start long, len long, seq string")
    links = clustering.containment(blocks, 11, by=("record",))
    got = {r["seq_id"]: (r["seed"], r["cluster_id"]) for r in clustering.numbered(blocks, clustering.clusters(blocks, links), ("record",)).collect()}
    assert got == {f"{r}:{i}": (f"{r}:0", 3) for r in "ab" for i in range(3)}
    assert {r["seed"][0] + r["member"][0] for r in clustering.composition(blocks, by=("record",)).collect()} == {"aa", "bb"}
    sizes = {r["cluster_id"]: r["members"] for r in clustering.family_rows(spark.createDataFrame([(3, 10)], "cluster_id long, len long")).collect()}
    assert sizes == {1: 0, 2: 0, 3: 1}


def test_mask_comparison(spark):
    rows = [("p", "acGTac", "aCgTa"), ("q", "", ""), ("r", "AAA", "aaa")]
    got = {r["pair"]: r for r in compare.compare_masks(spark.createDataFrame(rows, "pair string, seq1 string, seq2 string")).collect()}
    p = got["p"]
    assert [p[c] for c in compare.COUNTS] == [5, 3, 3, 2, 1, 1, 6, 5]
    assert p["overlap_pct"] == 66.6667 and got["q"]["both_pct"] == 0 and got["r"]["only2_pct"] == 100


def test_letters(spark):
    df = spark.createDataFrame([("Aa>nNuIxRy z\n",)], "s string")
    got = df.select(nt.clean(F.col("s")), nt.clean_keep_case(F.col("s")), nt.lenient(F.lit("EFJLIz")), nt.reverse_complement(F.lit("acgtRyn")), nt.reverse_complement_keep_case(F.lit("ACgtn")), nt.wrapped(F.lit("a" * 141)), nt.from_text(F.lit("aZ9"))).head()
    assert got[0] == "aanntcry" and got[1] == "AanNtCRy" and got[2] == "acgtg" and got[3] == "nryacgt" and got[4] == "nacGT" and got[5] == "a" * 70 + "\n" + "a" * 70 + "\na" and got[6] == "ac"
    assert [nt.lenient_int(x) for x in ("19", "1,234", "7.9", "x", "99999999999999", "")] == [19, 1, 7, None, 2**31 - 1, None]
    for k in (1, 5, 19):
        word = "".join(random.Random(k).choice("acgt") for _ in range(k))
        _, ck, _ = kmers.packed(kmers._CODE[np.frombuffer(word.encode(), np.uint8)], k)
        assert spark.range(1).select(nt.kmer_letters(F.lit(int(ck[0])), k)).head()[0] == min(word, word[::-1].translate(FLIP))
