"""Whole runs from files to reports, one function for each way of working.

All of them take records (seq_id, name, seq, and file where several files are read) and a Settings,
and write into a folder. Elements are rows (seq_id, name, type, cluster_id, start, len, strand).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nucleotide as nt
from ..operators import alignment, clustering, compare, coords, families, masking, ssr
from ..runtime import cut, send_package
from ..sources import readers, sinks

#: Records up to which each gets a raster picture as well; these are drawn one by one.
RASTERS = 50


@dataclass(frozen=True)
class Settings:
    """Numbers are brought into their ranges: kmer 9 to 21, min_len at least 1 and kmer, gap at least kmer (0: twice kmer)."""

    kmer: int = 19
    min_len: int = 80
    gap: int = 0
    flanks: int = 0
    scale: int = 10
    width: int = 0
    height: int = 0
    show_sequence: bool = False
    tandem: bool = True
    mask_only: bool = False
    measure: str = "profile"
    libraries: tuple[str, ...] = field(default=())
    pictures: bool = True

    def checked(self) -> Settings:
        kmer = min(21, max(9, self.kmer))
        return replace(self, kmer=kmer, min_len=max(1, kmer, self.min_len), gap=max(kmer, self.gap or 2 * kmer), flanks=min(1000, max(0, self.flanks)), scale=min(30, max(1, self.scale)))


def tandem_blocks(seqs: DataFrame, s: Settings) -> DataFrame:
    found = ssr.ssr_blocks(seqs.withColumn("seq", F.lower("seq")))
    return found if s.tandem else found.where("false")


def k_of(median: Column) -> Column:
    """Odd, 11 to 23, from the median length of blocks."""
    k = F.lit(7) + F.floor(F.length(F.bin(F.greatest(F.lit(1), F.floor(median)).cast("long"))) / 2) + 1
    return F.least(F.lit(23), F.greatest(F.lit(11), k.bitwiseOR(F.lit(1)))).cast("int")


def auto_k(blocks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, median_len, k: k-mers by which blocks(len) are compared, of each record or of all."""
    median = F.percentile("len", 0.5)
    return blocks.groupBy(*by).agg(F.coalesce(median, F.lit(0.0)).alias("median_len")).withColumn("k", k_of(F.col("median_len")))


def block_links(named: DataFrame, seqs: DataFrame, s: Settings, by: tuple[str, ...]) -> DataFrame:
    """seed, member, strand: which of the blocks(seq_id, record, start, len, seq) belong together by the measure."""
    if s.measure != "containment":
        floors = clustering.chance_floor(seqs.withColumn("seq", F.lower("seq")))
        return clustering.with_strand(clustering.composition(named, floors, by=by))
    ks = cut(auto_k(named, by))
    each = cut(named.join(ks, list(by)) if by else named.crossJoin(F.broadcast(ks)))  # a row for each record, or one
    links = None
    for k in [r["k"] for r in ks.select("k").distinct().collect()]:  # 11, 13 .. 23 at most
        found = clustering.containment(each.where(F.col("k") == k), k, by=by).select("seed", "member")
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = each.select(F.col("seq_id").alias("seed"), F.col("seq_id").alias("member")).where("false")
    return clustering.with_strand(clustering.cosines(links, clustering.profiles(named)))


def joint_clusters(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of all records numbered by containment, and seed, member, strand of those that a seed has taken."""
    found = cut(clustering.contained_clusters(named, auto_k(named).head()["k"]))
    taken = found.where("seed <> seq_id").select("seed", F.col("seq_id").alias("member"))
    return cut(clustering.numbered(named, found)), cut(clustering.strands(taken, named))


def cluster_blocks(spark: SparkSession, seqs: DataFrame, blocks: DataFrame, s: Settings, apart: bool) -> DataFrame:
    """seq_id, name, type, cluster_id, start, len, strand of the blocks: families, and blocks alone as cluster 2.

    apart: each record's blocks are clustered and numbered by themselves, else those of all records together.
    """
    by = ("record",) if apart else ()
    named = cut(clustering.block_sequences(seqs.withColumn("seq", F.lower("seq")), blocks))
    if apart or s.measure != "containment":
        links = cut(block_links(named, seqs, s, by).select("seed", "member", "strand"))
        got = cut(clustering.numbered(named, clustering.clusters(named, links), by))
    else:
        got, links = joint_clusters(named)
    got = got.join(links.withColumnRenamed("member", "seq_id"), ["seed", "seq_id"], "left").withColumn("strand", F.coalesce("strand", F.lit("+")))
    library = readers.read_library(spark, list(s.libraries)) if s.libraries else None
    labelled = with_labels(got, named, library, by)
    names = seqs.select(F.col("seq_id").alias("record"), "name")
    return labelled.join(names, "record").select(F.col("record").alias("seq_id"), "name", "type", "cluster_id", "start", "len", "strand")


def with_labels(got: DataFrame, named: DataFrame, library: DataFrame | None, by: tuple[str, ...] = ()) -> DataFrame:
    """got(seed, cluster_id, ..) with type: the library entry that a family's seed shares most k-mers with, as id:name, or its kind."""
    got = got.withColumn("ref_id", F.lit(0).cast("long")).withColumn("ref_name", F.lit(""))
    if library is not None and library.take(1):
        hits = clustering.library_hits(named, library, 11, 5)
        seeds = got.where("cluster_id > 2").select("cluster_id", *by, F.col("seed").alias("seq_id")).distinct()
        best = seeds.join(hits, "seq_id").join(library.select("ref_id", F.col("ref_name").alias("_n")), "ref_id").select("cluster_id", *by, F.col("ref_id").alias("_r"), "_n")
        got = got.join(best, ["cluster_id", *by], "left").withColumn("ref_id", F.coalesce("_r", "ref_id")).withColumn("ref_name", F.coalesce("_n", "ref_name"))
    return got.withColumn("type", sinks.kind(F.col("cluster_id"), F.col("ref_id"), F.col("ref_name")))


def _with_tandem(found: DataFrame, tandem: DataFrame, seqs: DataFrame) -> DataFrame:
    one = tandem.join(seqs.select("seq_id", "name"), "seq_id").select("seq_id", "name", F.lit("STR").alias("type"), F.lit(1).cast("long").alias("cluster_id"), "start", "len", F.lit("+").alias("strand"))
    return cut(one.unionByName(found))


# --- what a run finds, as tables -------------------------------------------------------


def own_blocks(seqs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Blocks of what repeats within a record, and tandem repeats, which are taken out."""
    tandem = cut(tandem_blocks(seqs, s))
    return cut(masking.repeat_blocks(seqs, s.kmer, s.min_len, excluded=tandem)), tandem


def joint_blocks(seqs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """The same of what repeats anywhere."""
    tandem = cut(tandem_blocks(seqs, s))
    return cut(masking.repeat_blocks(seqs, s.kmer, s.min_len, shared=True, excluded=tandem)), tandem


def imported_blocks(seqs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Blocks from lower case, none of which begins in a tandem repeat."""
    tandem = cut(tandem_blocks(seqs, s))
    barred = tandem.groupBy("seq_id").agg(F.collect_list(F.struct("start", "len")).alias("ssr"))
    return cut(masking.merged_runs(masking.case_runs(seqs.join(barred, "seq_id", "left").select("seq_id", "seq", "ssr")), s.gap, s.min_len)), tandem


def aligned_blocks(seqs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of extended seed pairs, from which tandem repeats aren't taken out; these; and the marked runs themselves."""
    runs = cut(alignment.align_runs(seqs, s.kmer, s.min_len))
    return cut(alignment.align_blocks(seqs, s.kmer, s.min_len, runs)), cut(tandem_blocks(seqs, s)), runs


def elements_of(spark: SparkSession, seqs: DataFrame, blocks: DataFrame, tandem: DataFrame, s: Settings, apart: bool) -> DataFrame:
    """seq_id, name, type, cluster_id, start, len, strand: tandem repeats, families, and blocks alone."""
    return _with_tandem(cluster_blocks(spark, seqs, blocks, s, apart), tandem, seqs)


def long_enough(seqs: DataFrame, s: Settings) -> DataFrame:
    return seqs.where(F.length("seq") > s.min_len)


def moved(elements: DataFrame, placed: DataFrame) -> DataFrame:
    """elements in coordinates of all records behind each other."""
    return elements.join(placed.select("seq_id", "offset"), "seq_id").withColumn("start", F.col("start") + F.col("offset")).drop("offset")


# --- reports ---------------------------------------------------------------------------


def facts(seqs: DataFrame, blocks: DataFrame, tandem: DataFrame) -> DataFrame:
    """report, n, gap, repeats, tandem: bases in the records(report, seq_id, seq) of each report."""
    of = seqs.select("seq_id", "report")
    bases = lambda df, name: df.join(of, "seq_id").groupBy("report").agg(F.sum("len").cast("long").alias(name))
    own = seqs.groupBy("report").agg(F.sum(F.length("seq")).cast("long").alias("n"), F.sum(nt.gaps(F.col("seq"))).cast("long").alias("gap"))
    return own.join(bases(blocks, "repeats"), "report", "left").join(bases(tandem, "tandem"), "report", "left").na.fill(0, ["repeats", "tandem"])


def heads(known: DataFrame, s: Settings) -> DataFrame:
    """facts() with heads: the lines above a report, percentages of what isn't a gap."""
    share = lambda x: F.concat(F.format_number(nt.percent(F.col(x), F.col("n") - F.col("gap")), 2), F.lit("%"))
    lines = F.array(
        F.lit(f"kmer={s.kmer}"), F.lit(f"Minimal repeat block size={s.min_len}"), F.concat(F.lit("Sequence length (bp)="), F.col("n")), F.concat(F.lit("Sequence coverage by repeats="), share("repeats")),
        F.concat(F.lit("Short tandem repeat (STR) sequence coverage="), share("tandem")), F.concat(F.lit("Sequence gap (bp)="), F.col("gap"), F.lit(" ("), F.format_number(nt.percent(F.col("gap"), F.col("n"), 4), 4), F.lit("%)")),
    )
    return known.withColumn("heads", lines)


def _prepared(spark: SparkSession, s: Settings) -> Settings:
    send_package(spark)
    return s.checked()


def _reports(out: str, elements: DataFrame, seqs: DataFrame, known: DataFrame, s: Settings, borders: DataFrame | None = None) -> None:
    """A table and a picture for each report of elements(report, ..); known: facts() with a title."""
    if s.show_sequence:
        sequence = sinks.flanked(F.col("start"), F.col("len"), F.col("seq"), F.col("strand"), s.flanks)
        elements = elements.join(seqs.select("seq_id", "seq"), "seq_id").withColumn("Sequence", sequence).drop("seq")
    sinks.write_reports(out, ".gff", sinks.gff_lines(elements, heads(known, s)), "part", "cluster_id", "seq_id", "start")
    if s.pictures:
        sinks.write_reports(out, ".svg", sinks.svg_lines(elements, known, s.scale, s.width, s.height, borders), "part", "x")


def _each_record(out: str, elements: DataFrame, seqs: DataFrame, blocks: DataFrame, tandem: DataFrame, s: Settings) -> None:
    """A report for each record, named after it and numbered from 1: one job for each kind of file, however many records there are."""
    report = F.concat_ws("_", F.when(F.col("name") != "", F.col("name")).otherwise("record"), (F.col("seq_id") + 1).cast("string"))
    named = seqs.withColumn("report", report)
    known = cut(facts(named, blocks, tandem).join(named.select("report", F.col("name").alias("title")), "report"))
    mine = cut(elements.join(named.select("seq_id", "report"), "seq_id"))
    _reports(out, mine, named, known, s)
    if s.pictures:
        for r in known.select("report", "n").orderBy("report").limit(RASTERS).collect():
            sinks.write_png(f"{out}/{r['report']}.png", mine.where(F.col("report") == r["report"]), r["n"] or 1, s.scale, s.width, s.height)


def _write_masks(out: str, seqs: DataFrame, *blocks: DataFrame, joint: bool = False) -> None:
    masked = masking.soft_mask(seqs.select("seq_id", "seq", "name"), *blocks)
    sinks.write_fasta(f"{out}/masked", masked, sinks.mask_label(F.col("name"), F.col("seq"), joint))


def run_default(spark: SparkSession, seqs: DataFrame, out: str, s: Settings = Settings()) -> DataFrame:
    """Tandem repeats, repeat blocks of each record, a soft mask, then families of each record and reports."""
    s = _prepared(spark, s)
    seqs = cut(long_enough(seqs, s))
    blocks, tandem = own_blocks(seqs, s)
    _write_masks(out, seqs, blocks, tandem)
    if s.mask_only:
        return blocks
    elements = elements_of(spark, seqs, blocks, tandem, s, True)
    _each_record(out, elements, seqs, blocks, tandem, s)
    return elements


def run_alignment(spark: SparkSession, seqs: DataFrame, out: str, s: Settings = Settings()) -> DataFrame:
    """The same with blocks from extended seed pairs; the soft mask has the marked letters themselves."""
    s = _prepared(spark, s)
    seqs = cut(long_enough(seqs, s))
    blocks, tandem, runs = aligned_blocks(seqs, s)
    _write_masks(out, seqs, runs.select("seq_id", F.col("first").alias("start"), (F.col("last") - F.col("first") + 1).alias("len")))
    elements = elements_of(spark, seqs, blocks, tandem, s, True)
    _each_record(out, elements, seqs, blocks, tandem, s)
    return elements


def _together(spark: SparkSession, seqs: DataFrame, blocks: DataFrame, tandem: DataFrame, out: str, s: Settings) -> DataFrame:
    """One clustering of all blocks; a report in coordinates of all records behind each other, one for each file, and the genomes' comparison."""
    elements = elements_of(spark, seqs, blocks, tandem, s, False)
    placed = cut(coords.offsets(seqs))
    combined = seqs.withColumn("report", F.lit("combined"))
    known = cut(facts(combined, blocks, tandem).withColumn("title", F.lit("combined")))
    shown = seqs.select("seq_id", "name").orderBy("seq_id").limit(sinks.PICTURE_ROWS)
    borders = shown.join(placed.select("seq_id", F.col("offset").alias("at")), "seq_id").withColumn("report", F.lit("combined"))
    whole = moved(elements, placed).withColumn("report", F.lit("combined"))
    _reports(out, whole, combined, known, replace(s, show_sequence=False), borders)
    if s.pictures:
        for r in known.select("n").collect():  # one row
            sinks.write_png(f"{out}/combined.png", whole, r["n"] or 1, s.scale, s.width, s.height)
    genome = "file" if "file" in seqs.columns else "name"
    pangenome(elements.join(seqs.select("seq_id", F.col(genome).alias("genome")), "seq_id"), out)
    # reports of a file place its records behind each other as well
    named = seqs.withColumn("report", F.regexp_extract(F.col(genome), r"([^/]*)$", 1))
    _reports(out, elements.join(named.select("seq_id", "report"), "seq_id"), named, facts(named, blocks, tandem).withColumn("title", F.col("report")), s)
    return elements


def run_collate(spark: SparkSession, seqs: DataFrame, out: str, s: Settings = Settings()) -> DataFrame:
    """Blocks of each record by its own, families over all."""
    s = _prepared(spark, s)
    seqs = cut(long_enough(seqs, s))
    blocks, tandem = own_blocks(seqs, s)
    _write_masks(out, seqs, blocks, tandem)
    return _together(spark, seqs, blocks, tandem, out, s)


def run_joint(spark: SparkSession, seqs: DataFrame, out: str, s: Settings = Settings()) -> DataFrame:
    """Blocks of what repeats anywhere, families over all."""
    s = _prepared(spark, s)
    seqs = cut(long_enough(seqs, s))
    blocks, tandem = joint_blocks(seqs, s)
    _write_masks(out, seqs, blocks, tandem, joint=True)
    return _together(spark, seqs, blocks, tandem, out, s)


def run_homology(spark: SparkSession, seqs: DataFrame, out: str, s: Settings = Settings()) -> DataFrame:
    """Masks what repeats anywhere, so that the rest is each record's own."""
    s = _prepared(spark, s)
    seqs = cut(long_enough(seqs, s))
    blocks, tandem = joint_blocks(seqs, s)
    _write_masks(out, seqs, blocks, tandem, joint=True)
    return blocks


def run_read_mask(spark: SparkSession, seqs: DataFrame, out: str, s: Settings = Settings()) -> DataFrame:
    """Blocks from the lower case of the records, then families of each record and reports."""
    s = _prepared(spark, s)
    seqs = cut(long_enough(seqs, s))
    blocks, tandem = imported_blocks(seqs, s)
    elements = elements_of(spark, seqs, blocks, tandem, s, True)
    _each_record(out, elements, seqs, blocks, tandem, s)
    return elements


def run_combine_mask(spark: SparkSession, seqs: DataFrame, out: str, s: Settings = Settings()) -> DataFrame:
    s = _prepared(spark, s)
    seqs = cut(long_enough(seqs, s))
    blocks, tandem = imported_blocks(seqs, s)
    return _together(spark, seqs, blocks, tandem, out, s)


def run_read_gff(spark: SparkSession, path: str, out: str, s: Settings = Settings()) -> DataFrame:
    """Pictures of an annotation table, or of each of a folder's."""
    s = _prepared(spark, s)
    rows = cut(readers.read_annotations(spark, path))
    told = readers.annotated_lengths(spark, path)
    report = F.regexp_replace(F.regexp_extract(F.col("file"), r"([^/]*)$", 1), r"\.[^.]*$", "")
    own = rows.groupBy("file").agg(F.max(F.col("start") + F.col("len")).alias("_far"), F.min_by("seqid", F.struct("block", "at")).alias("title"))
    known = cut(own.join(told, "file", "left").select(report.alias("report"), F.coalesce("n", "_far").alias("n"), "title"))
    drawn = cut(rows.withColumn("report", report))
    sinks.write_reports(out, ".svg", sinks.svg_lines(drawn, known, s.scale, s.width, s.height), "part", "x")
    for r in known.orderBy("report").limit(RASTERS).collect():
        sinks.write_png(f"{out}/{r['report']}.png", drawn.where(F.col("report") == r["report"]), r["n"] or 1, s.scale, s.width, s.height)
    return rows


def run_unique(spark: SparkSession, seqs: DataFrame, out: str, s: Settings = Settings()) -> DataFrame:
    """Upper-case regions of soft-masked records."""
    s = _prepared(spark, s)
    blocks = masking.merged_runs(masking.case_runs(seqs, upper=True), s.gap, s.min_len)
    rows = cut(sinks.region_rows(blocks, seqs, s.min_len))
    rows.orderBy("seq_id", "start").select(F.concat(F.lit(">"), "label", F.lit("\n"), "bases").alias("value")).write.mode("overwrite").text(f"{out}/unique")
    return rows


def run_extract(spark: SparkSession, seqs: DataFrame, out: str, s: Settings = Settings()) -> DataFrame:
    """A folder for each record's name, and a table of lengths and lower case."""
    _prepared(spark, s)
    sinks.write_fasta_files(f"{out}/records", seqs.select("name", "seq"))
    rows = sinks.record_rows(seqs)
    sinks.write_table(out, "report.txt", rows, "seq_id")
    return rows


def run_compare(spark: SparkSession, control: str, out: str, s: Settings = Settings()) -> DataFrame:
    """Masks of the first records of each two files that a control file names, beside it."""
    _prepared(spark, s)
    base = control.rpartition("/")[0]
    at = lambda name: f"{base}/{name}" if base else name
    named = [(r["file1"], r["file2"]) for r in readers.read_pairs(spark, control).orderBy("pair").collect()]  # names of files
    if not named:
        return compare.compare_masks(spark.createDataFrame([], "pair string, seq1 string, seq2 string"))
    first = None
    for name in sorted({n for both in named for n in both}):
        one = readers.read_fasta(spark, at(name), keep_case=True).where("rec_no <= 1").select(F.lit(name).alias("_file"), F.col("seq").alias("_seq"))
        first = one if first is None else first.unionByName(one)
    first = cut(first)
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(named)], "_at int, file1 string, file2 string")
    one, two = (first.select(F.col("_file").alias(f), F.col("_seq").alias(x)) for f, x in (("file1", "seq1"), ("file2", "seq2")))
    got = cut(compare.compare_masks(pairs.join(one, "file1").join(two, "file2").select(F.concat_ws(" ", "file1", "file2").alias("pair"), "seq1", "seq2")))
    sinks.write_table(out, "result.txt", got, "pair")
    return got


def pangenome_tables(elements: DataFrame) -> dict[str, DataFrame]:
    """The genomes' comparison by title: elements have genome; families are cluster ids above 2. The last is the matrix."""
    counted = elements.withColumn("class", F.when(F.col("cluster_id") == 1, "STR").when(F.col("cluster_id") == 2, "UCRP").otherwise("CRP"))
    names = [r["genome"] for r in elements.select("genome").distinct().orderBy("genome").collect()]  # a row for each genome
    found = counted.where("class = 'CRP'").select("genome", F.col("cluster_id").alias("family"), F.lit(1).alias("members"), F.col("len").alias("bp"))
    present = cut(families.presence(found))
    fam = cut(families.marked(present, names, 0))
    labels = counted.where("cluster_id > 2").groupBy(F.col("cluster_id").alias("family")).agg(F.min("type").alias("label"))
    plain = families.bare(fam)
    summary = families.genome_summary(present, plain).join(other_elements(counted), "genome", "outer").na.fill(0)
    return {
        "Genomes": elements.sparkSession.createDataFrame(list(enumerate(names, 1)), "number int, genome string"),
        "Summary": families.category_totals(plain),
        "Soft core": families.soft_core(plain, len(names)),
        "Family frequency spectrum": families.spectrum(plain, len(names)),
        "Per-genome summary": summary,
        "Pairwise shared families": families.pairwise(fam, names),
        "Core families": plain.where("category = 'core'").join(labels, "family").select("family", "label", "total_members", "total_bp"),
        "Genome-specific families": present.join(plain.where("category = 'unique'").select("family"), "family").join(labels, "family").select("genome", "family", "label", "members", "bp"),
        "Matrix": families.matrix(present, plain.join(labels, "family"), names),
    }


def other_elements(counted: DataFrame) -> DataFrame:
    """genome, and number and bases of its tandem repeats and of its blocks alone, from elements(genome, class, len)."""
    sums = [f(F.when(F.col("class") == c, what)).cast("long").alias(f"{c}{end}") for c in ("STR", "UCRP") for f, what, end in ((F.count, F.lit(1), ""), (F.sum, F.col("len"), "_bp"))]
    return counted.groupBy("genome").agg(*sums).na.fill(0)


def pangenome(elements: DataFrame, out: str) -> None:
    """Summary and matrix of families in genomes, as one report of sections and one table."""
    tables = pangenome_tables(elements)
    matrix = tables.pop("Matrix")
    lines = None
    for i, (title, rows) in enumerate(tables.items()):
        spark = rows.sparkSession
        head = spark.createDataFrame([(i, 0, f"== {title} =="), (i, 1, "\t".join(rows.columns))], "section int, part int, line string").withColumn("key", F.lit(""))
        # numbers are ordered by their size, names as they are
        key = [F.lpad(F.col(f"`{c}`").cast("string"), 20, "0") if dict(rows.dtypes)[c] in ("int", "bigint") else F.col(f"`{c}`").cast("string") for c in rows.columns[:2]]
        body = rows.select(F.lit(i).alias("section"), F.lit(2).alias("part"), F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]).alias("line"), F.concat_ws("\t", *key).alias("key"))
        both = head.unionByName(body)
        lines = both if lines is None else lines.unionByName(both)
    sinks.write_reports(out, "", lines.withColumn("report", F.lit("pangenome.txt")), "section", "part", "key")
    sinks.write_table(out, "pangenome_matrix.tsv", matrix, "family")
