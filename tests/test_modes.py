"""Files in, reports out."""

import random
from pathlib import Path

import pytest

from helixframe import cli
from helixframe.plans import modes
from helixframe.sources import readers
from helixframe.streaming import repeats

FLIP = str.maketrans("acgt", "tgca")


def unit(n=220):
    rng = random.Random(99)
    return "".join(rng.choice("acgt") for _ in range(n))


def genome(seed, copies=3):
    rng = random.Random(seed)
    new = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    shared = unit()
    own = new(200)
    out = new(150)
    for i in range(copies):
        out += (shared[::-1].translate(FLIP) if i % 2 else shared) + new(180) + own + new(120)
    return out + "ca" * 20 + new(100)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("genomes")
    for i, name in enumerate(("b.fa", "a.txt", "c")):
        s = genome(i)
        (top / name).write_text(f">g{i} some words\n" + "\n".join(s[j : j + 60] for j in range(0, len(s), 60)) + "\n\n")
    return str(top)


def test_reading(spark, tmp_path):
    (tmp_path / "x.fa").write_text("acgt\n>r1 tail\tmore\nACgu xN\n\nii\n>\nA\r\nC\n>last")
    got = [(r["rec_no"], r["name"], r["seq"], r["len"]) for r in readers.read_fasta(spark, str(tmp_path / "x.fa")).orderBy("seq_id").collect()]
    assert got == [(1, "r1", "acgtncc", 7), (2, "", "ac", 2), (3, "last", "", 0)]
    cased = readers.read_fasta(spark, str(tmp_path / "x.fa"), keep_case=True).where("rec_no = 1").head()["seq"]
    assert cased == "ACgtNcc"
    (tmp_path / "plain").write_text("ACGT\nacgt\n")
    assert [(r["rec_no"], r["seq"]) for r in readers.read_fasta(spark, str(tmp_path / "plain")).collect()] == [(0, "acgtacgt")]
    assert [r["seq"] for r in readers.from_strings(spark, [">a\nAC", ">b\nGT"]).orderBy("seq_id").collect()] == ["ac", "gt"]
    assert readers.read_library(spark, [str(tmp_path / "missing")]).count() == 0


def test_folder_is_read_in_the_order_of_names(spark, folder):
    assert [r["name"] for r in readers.read_fasta(spark, folder).orderBy("seq_id").collect()] == ["g1", "g0", "g2"]


@pytest.mark.parametrize("mode", ["default", "amask", "contain", "maskonly"])
def test_single_file_runs(spark, folder, tmp_path, mode):
    flags = {"default": [], "amask": ["-amask"], "contain": ["-CONTAIN", "-seqshow", "flanks=5"], "maskonly": ["--maskonly"]}[mode]
    cli.run(spark, [f"{folder}/a.txt", str(tmp_path), *flags, "imgx=2"])
    masked = "".join(p.read_text() for p in (tmp_path / "masked").glob("part-*"))
    assert masked.startswith(">g1 ") and any(c.islower() for c in masked.split("\n", 1)[1])
    if mode == "maskonly":
        assert not list(tmp_path.glob("*.gff"))
        return
    text = (tmp_path / "g1_1.gff").read_text()
    rows = [line.split("\t") for line in text.split("\n") if line.count("\t") >= 7 and not line.startswith("Seqid")]
    assert {r[2] for r in rows} >= {"1", "3"} and all(int(r[4]) - int(r[3]) + 1 == int(r[5]) for r in rows)
    assert {r[6] for r in rows if r[2] not in "12"} == {"+", "-"}
    assert (tmp_path / "g1_1.svg").read_text().startswith("<svg") and (tmp_path / "g1_1.png").read_bytes()[1:4] == b"PNG"
    # the table can be read back
    back = readers.read_annotations(spark, str(tmp_path / "g1_1.gff"))
    assert back.count() == len(rows) and readers.annotated_length(spark, str(tmp_path / "g1_1.gff")) == len(genome(1))
    cli.run(spark, [str(tmp_path / "g1_1.gff"), str(tmp_path / "again"), "-readgff"])
    assert (tmp_path / "again" / "g1_1.svg").exists()


@pytest.mark.parametrize("mode", ["collate", "joint", "homology"])
def test_comparative_runs(spark, folder, tmp_path, mode):
    got = cli.run(spark, [folder, str(tmp_path), f"-{mode}"])
    assert got.count()
    if mode == "homology":
        return
    report = (tmp_path / "pangenome.txt").read_text()
    assert "== Summary ==" in report and "core" in report
    matrix = (tmp_path / "pangenome_matrix.tsv").read_text().split("\n")
    assert matrix[0].split("\t")[0] == "family" and len(matrix) > 2
    assert (tmp_path / "combined.gff").exists() and (tmp_path / "a.txt.gff").exists()


def test_masks_come_back(spark, folder, tmp_path):
    cli.run(spark, [f"{folder}/a.txt", str(tmp_path / "one"), "-maskonly"])
    (tmp_path / "masks").mkdir()
    text = "".join(p.read_text() for p in (tmp_path / "one" / "masked").glob("part-*"))
    (tmp_path / "masks" / "m1").write_text(text)
    (tmp_path / "masks" / "m2").write_text(text.replace("g1", "g2"))
    rows = cli.run(spark, [str(tmp_path / "masks" / "m1"), str(tmp_path / "two"), "-readmask"]).where("cluster_id > 1").count()
    assert rows and cli.run(spark, [str(tmp_path / "masks"), str(tmp_path / "three"), "-combinemask"]).where("cluster_id > 2").count()
    assert cli.run(spark, [str(tmp_path / "masks" / "m1"), str(tmp_path / "four"), "-extunique"]).count()
    report = cli.run(spark, [str(tmp_path / "masks" / "m1"), str(tmp_path / "five"), "-extract"]).head()
    assert report["lower"] and (tmp_path / "five" / "records" / "name=g1").is_dir()
    (tmp_path / "masks.txt").write_text("masks/m1 masks/m2\n")
    pair = cli.run(spark, [str(tmp_path / "masks.txt"), str(tmp_path / "six"), "-maskscomp"]).head()
    assert pair["mask1"] == pair["both"] and pair["overlap_pct"] == 100


def test_library_names_families(spark, folder, tmp_path):
    shared = unit()
    Path(tmp_path / "lib.fa").write_text(f">other thing\n{'acgtt' * 20}\n>known repeat\n{shared}\n")
    got = cli.run(spark, [f"{folder}/a.txt", str(tmp_path / "out"), f"-lib={tmp_path}/lib.fa"])
    assert "2:known repeat" in {r["type"] for r in got.collect()}


def test_settings_come_into_their_ranges():
    s = cli.settings({"nossr"}, {"kmer": "99", "sln": "3", "gap": "1", "flanks": "5000", "imgx": "0", "image": "300x"}).checked()
    assert (s.kmer, s.min_len, s.gap, s.flanks, s.scale, s.width, s.tandem) == (21, 21, 21, 1000, 1, 0, False)
    assert modes.Settings().checked().gap == 38
    assert cli.parse(["in", "-KMER=15", "kmer=17", "-NoSSR"]) == (["in"], {"nossr"}, {"kmer": "15"})


def test_arriving_files(spark, folder, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "first.fa").write_text(Path(folder, "a.txt").read_text())
    watch = repeats.watch_fasta(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    try:
        watch.processAllAvailable()
        (tmp_path / "in" / "second.fa").write_text(Path(folder, "c").read_text())
        watch.processAllAvailable()
    finally:
        watch.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["seq_id"].split("#")[0] for r in got.collect()} == {"first.fa", "second.fa"}


def test_records_are_grouped_by_themselves(spark, folder, tmp_path):
    """A folder without a comparative flag: each record's families are its own, and all reports come from one run."""
    got = cli.run(spark, [folder, str(tmp_path), "-contain"]).collect()
    for r in range(3):
        ids = sorted({x["cluster_id"] for x in got if x["seq_id"] == r and x["cluster_id"] > 2})
        assert ids == list(range(3, 3 + len(ids))) and ids
    names = {p.name for p in tmp_path.iterdir()}
    assert {f"g{g}_{i}.{end}" for i, g in enumerate((1, 0, 2), 1) for end in ("gff", "svg", "png")} <= names and not any(n.startswith("_parts") for n in names)
    svg = (tmp_path / "g0_2.svg").read_text()
    assert svg.startswith("<svg") and svg.endswith("</svg>\n") and svg.count("stroke-width") == len({(x["start"], x["cluster_id"]) for x in got if x["seq_id"] == 1})


def test_pangenome_report(spark, folder, tmp_path):
    got = cli.run(spark, [folder, str(tmp_path), "-joint", "-contain"]).collect()
    text = (tmp_path / "pangenome.txt").read_text()
    assert [line for line in text.split("\n") if line.startswith("==")] == [f"== {t} ==" for t in ("Genomes", "Summary", "Soft core", "Family frequency spectrum", "Per-genome summary", "Pairwise shared families", "Core families", "Genome-specific families")]
    rows = [line.split("\t") for line in text.split("== Per-genome summary ==\n")[1].split("\n== ")[0].split("\n")]
    at = rows[0].index("STR")
    assert sum(int(r[at]) for r in rows[1:] if len(r) > at) == sum(x["cluster_id"] == 1 for x in got)
    assert "mask" in "".join(p.read_text() for p in (tmp_path / "masked").glob("part-*"))


def test_large_files_in_pieces(spark, tmp_path):
    rng = random.Random(4)
    (tmp_path / "fa").mkdir()
    for f in "ab":
        with open(tmp_path / "fa" / f, "w") as out:
            for i in range(30):
                out.write(f">{f}{i} x\n" + "".join("".join(rng.choice("acgtN") for _ in range(rng.randint(0, 30))) + "\n" for _ in range(rng.randint(0, 6))))
    read = lambda: [tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "fa"), keep_case=True).orderBy("seq_id").collect()]
    whole = read()
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert read() == whole and len(whole) == 60 and [r[0] for r in whole] == list(range(60))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    text = "".join((tmp_path / "fa" / f).read_text() for f in "ab")
    assert [(r[3], r[4]) for r in whole] == [(x.split()[0], "".join(x.split("\n")[1:])) for x in text.split(">")[1:]]
