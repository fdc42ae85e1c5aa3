"""Registered queries for whole runs, readers and reports over the driver's tables, and their SQL.

The runs are those of modes: what they find, as tables, without files. Blocks are grouped by containment where SQL
is to follow, as the floor of the other measure comes from a sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nucleotide as nt
from ..operators import alignment, clustering, compare, coords, kmers, masking, ssr
from ..runtime import cut
from ..sources import readers, sinks
from . import modes
from .catalogue import _BLOCKSEQ, _CASED, _CLEAN, _DNA, _KEPT, _OFFSETS, _PCT, K, MIN_LEN, _block_sequences, _blocks, _caseruns, _greedy, _sequences, _ssr, _windows, cased, documents, query, table

S = modes.Settings(measure="containment").checked()

# --- runs ------------------------------------------------------------------------------

_LONG = _sequences().replace("FROM documents)", f"FROM documents WHERE length({_DNA}) > {MIN_LEN})")
#: Blocks of a soft mask of repeats and tandem repeats: lower-case runs that begin outside of tandem repeats.
_IMPORTED = f"""low AS (SELECT DISTINCT seq_id, base FROM (SELECT seq_id, unnest(range(start, start + len)) AS base FROM blocks UNION ALL SELECT seq_id, base FROM ssrbase)),
isles AS (SELECT *, base - row_number() OVER (PARTITION BY seq_id ORDER BY base) AS g FROM low),
lruns AS (SELECT i.seq_id, min(i.base) FILTER (b.base IS NULL) AS f, max(i.base) AS l FROM isles i LEFT JOIN ssrbase b ON b.seq_id = i.seq_id AND b.base = i.base GROUP BY i.seq_id, g HAVING count(*) FILTER (b.base IS NULL) > 0),
lmrk AS (SELECT *, coalesce(f - lag(l) OVER (PARTITION BY seq_id ORDER BY f) >= {S.gap}, true) AS new FROM lruns),
lnum AS (SELECT *, sum(new::INT) OVER (PARTITION BY seq_id ORDER BY f) AS n FROM lmrk),
imported AS (SELECT seq_id, min(f) AS start, max(l) - min(f) + 1 AS len FROM lnum GROUP BY seq_id, n HAVING max(l) - min(f) + 1 >= {MIN_LEN})"""


def _run_sql(shared: bool, apart: bool, imported: bool = False) -> str:
    """WITH .. elements: seq_id, type, cluster_id, start, len, strand."""
    scope = "record" if apart else "0"
    blocks = "imported" if imported else "blocks"
    bseq = _BLOCKSEQ.replace("FROM blocks b", f"FROM {blocks} b")
    return f"""WITH RECURSIVE {_LONG}, {_ssr()}, {_windows()}, {_blocks(shared, "ssrbase")}{", " + _IMPORTED if imported else ""}, {bseq},
kk AS (SELECT scope, least(23, greatest(11, (7 + length(bin(greatest(1, floor(quantile_cont(len::DOUBLE, 0.5)))::BIGINT)) // 2 + 1) | 1)) AS k FROM (SELECT {scope} AS scope, len FROM bseq) GROUP BY scope),
bk AS (SELECT bseq.*, k FROM bseq JOIN kk ON kk.scope = {scope}),
bw AS (SELECT seq_id, {scope} AS scope, least(x, reverse(translate(x, 'acgt', 'tgca'))) AS ck FROM (SELECT seq_id, record, substr(seq, (p + 1)::BIGINT, k) AS x FROM (SELECT *, unnest(range(0, greatest(length(seq) - k + 1, 0))) AS p FROM bk)) WHERE NOT regexp_matches(x, '[^acgt]')),
sets AS (SELECT DISTINCT seq_id, scope, ck FROM bw), size AS (SELECT seq_id, count(*) AS n FROM sets GROUP BY seq_id),
pairs AS (SELECT a.seq_id AS seed, b.seq_id AS member, count(*) AS shared FROM sets a JOIN sets b USING (scope, ck) JOIN bseq x ON x.seq_id = a.seq_id JOIN bseq y ON y.seq_id = b.seq_id WHERE (-x.len, x.record, x.start) < (-y.len, y.record, y.start) GROUP BY 1, 2),
edges AS (SELECT seed, member FROM pairs JOIN size ON size.seq_id = member WHERE round(shared::DOUBLE / n, 6) >= {clustering.LEAST_CONTAINMENT}),
{_greedy(scope)},
prof AS (SELECT seq_id, w, count(*) AS n FROM (SELECT seq_id, substr(seq, unnest(range(1, greatest(length(seq) - 2, 1))), 4) AS w FROM bseq) WHERE regexp_full_match(w, '[acgt]{{4}}') GROUP BY seq_id, w),
strands AS (SELECT t.seq_id, CASE WHEN coalesce(sum(a.n * b.n) FILTER (b.way = 'r'), 0) > coalesce(sum(a.n * b.n) FILTER (b.way = 'f'), 0) THEN '-' ELSE '+' END AS strand
  FROM taken t JOIN prof a ON a.seq_id = t.seed JOIN (SELECT seq_id, w, n, 'f' AS way FROM prof UNION ALL SELECT seq_id, reverse(translate(w, 'acgt', 'tgca')), n, 'r' FROM prof) b ON b.seq_id = t.seq_id AND b.w = a.w WHERE t.seed <> t.seq_id GROUP BY t.seq_id),
elements AS (SELECT b.record AS seq_id, CASE WHEN cluster_id IS NULL THEN 'UCRP' ELSE 'CRP' END AS type, coalesce(cluster_id, 2)::BIGINT AS cluster_id, b.start, b.len, coalesce(strand, '+') AS strand
  FROM bseq b JOIN taken t USING (seq_id) LEFT JOIN families f ON f.seed = t.seed LEFT JOIN strands s ON s.seq_id = b.seq_id
  UNION ALL SELECT seq_id, 'STR', 1, start, len, '+' FROM ssr)"""


_ELEMENTS = "SELECT seq_id, type, cluster_id, start, len, strand FROM elements"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records that are long enough."""
    return modes.long_enough(documents(spark, sf_dir).withColumn("name", F.concat(F.lit("doc"), F.col("seq_id"))), S)


def _shown(elements: DataFrame) -> DataFrame:
    return elements.select("seq_id", "type", "cluster_id", "start", "len", "strand")


def _masked(seqs: DataFrame) -> DataFrame:
    """Records whose repeats of their own and tandem repeats are in lower case."""
    return cut(masking.soft_mask(seqs, *modes.own_blocks(seqs, S)))


def _found(spark: SparkSession, sf_dir: str, blocks_of, apart: bool, masked: bool = False, s: modes.Settings = S) -> DataFrame:
    seqs = _records(spark, sf_dir)
    seqs = _masked(seqs) if masked else seqs
    blocks, tandem, *_ = blocks_of(seqs, s)
    return modes.elements_of(spark, seqs, blocks, tandem, s, apart)


@query(f"{_run_sql(False, True)} {_ELEMENTS}")
def run_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain run: each record's repeats, grouped within the record."""
    return _shown(_found(spark, sf_dir, modes.own_blocks, True))


@query(f"{_run_sql(False, False)} {_ELEMENTS}")
def run_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's repeats, grouped over all."""
    return _shown(_found(spark, sf_dir, modes.own_blocks, False))


@query(f"{_run_sql(True, False)} {_ELEMENTS}")
def run_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats anywhere, grouped over all."""
    return _shown(_found(spark, sf_dir, modes.joint_blocks, False))


@query(f"{_run_sql(False, True, True)} {_ELEMENTS}")
def run_read_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks from a soft mask, grouped within the record."""
    return _shown(_found(spark, sf_dir, modes.imported_blocks, True, masked=True))


@query(f"{_run_sql(False, False, True)} {_ELEMENTS}")
def run_combine_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks from a soft mask, grouped over all."""
    return _shown(_found(spark, sf_dir, modes.imported_blocks, False, masked=True))


@query()
def run_default_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain run by composition; its floor is measured on a sample, so that there is no SQL."""
    return _shown(_found(spark, sf_dir, modes.own_blocks, True, s=modes.Settings().checked()))


@query()
def run_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of extended seed pairs, which depend on each other's order (align_passages has SQL for them)."""
    return _shown(_found(spark, sf_dir, modes.aligned_blocks, True))


def _masked_sql(hit: str) -> str:
    """masked: seq_id, seq: lower case where the table hit(seq_id, i) has a base."""
    return f"""letters2 AS (SELECT seq_id, unnest(range(0, length(seq))) AS i, unnest(string_split(seq, '')) AS c FROM seqs WHERE length(seq) > 0),
masked AS (SELECT l.seq_id, string_agg(CASE WHEN h.i IS NULL THEN upper(c) ELSE c END, '' ORDER BY l.i) AS seq FROM letters2 l LEFT JOIN {hit} h ON h.seq_id = l.seq_id AND h.i = l.i GROUP BY l.seq_id)"""


_HIT = "hit AS (SELECT DISTINCT seq_id, i FROM (SELECT seq_id, unnest(range(start, start + len)) AS i FROM blocks UNION ALL SELECT seq_id, base FROM ssrbase))"
_WRAPPED = "rtrim(regexp_replace(seq, '(.{70})', '\\1' || chr(10), 'g'), chr(10))"
_SHARE = "printf('%.2f', round(length(regexp_replace(seq, '[^a-z]', '', 'g')) * 100.0::DOUBLE / length(seq), 2))"


@query(f"WITH {_LONG}, {_ssr()}, {_windows()}, {_blocks(False, 'ssrbase')}, {_HIT}, {_masked_sql('hit')} SELECT seq_id, '>doc' || seq_id || ' ' || {_SHARE} || '%' || chr(10) || {_WRAPPED} AS text FROM masked")
def run_mask_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The soft-masked file of a plain run, a row for each record."""
    seqs = _records(spark, sf_dir)
    masked = masking.soft_mask(seqs, *modes.own_blocks(seqs, S))
    return masked.select("seq_id", sinks.fasta_text(sinks.mask_label(F.col("name"), F.col("seq")), F.col("seq")).alias("text"))


@query(f"WITH {_LONG}, {_ssr()}, {_windows()}, {_blocks(True, 'ssrbase')}, {_HIT}, {_masked_sql('hit')} SELECT seq_id, '>doc' || seq_id || ' mask' || chr(10) || {_WRAPPED} AS text FROM masked")
def run_homology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The soft-masked file of what repeats anywhere, whose heads name no share."""
    seqs = _records(spark, sf_dir)
    masked = masking.soft_mask(seqs, *modes.joint_blocks(seqs, S))
    return masked.select("seq_id", sinks.fasta_text(sinks.mask_label(F.col("name"), F.col("seq"), True), F.col("seq")).alias("text"))


@query(
    f"""WITH {_LONG}, {_ssr()}, {_windows()}, {_blocks(False, "ssrbase")}, {_HIT},
free2 AS (SELECT seq_id, i FROM (SELECT seq_id, unnest(range(0, length(seq))) AS i FROM seqs WHERE length(seq) > 0) a WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.seq_id = a.seq_id AND h.i = a.i)),
uisl AS (SELECT *, i - row_number() OVER (PARTITION BY seq_id ORDER BY i) AS g FROM free2), uruns AS (SELECT seq_id, min(i) AS f, max(i) AS l FROM uisl GROUP BY seq_id, g),
umrk AS (SELECT *, coalesce(f - lag(l) OVER (PARTITION BY seq_id ORDER BY f) >= {S.gap}, true) AS new FROM uruns), unum AS (SELECT *, sum(new::INT) OVER (PARTITION BY seq_id ORDER BY f) AS n FROM umrk),
ub AS (SELECT seq_id, min(f) AS start, max(l) - min(f) + 1 AS len FROM unum GROUP BY seq_id, n HAVING max(l) - min(f) + 1 > {MIN_LEN}), {_masked_sql("hit")}
SELECT u.seq_id, (start + 1) || '-' || (start + len) AS label, substr(seq, (start + 1)::BIGINT, len::BIGINT) AS bases FROM ub u JOIN masked m ON m.seq_id = u.seq_id"""
)
def run_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that a soft mask leaves in capitals."""
    masked = _masked(_records(spark, sf_dir))
    blocks = masking.merged_runs(masking.case_runs(masked, upper=True), S.gap, S.min_len)
    return sinks.region_rows(blocks, masked, S.min_len).select("seq_id", "label", "bases")


@query(f"WITH {_sequences(_CASED)} SELECT seq_id, 'doc' || seq_id AS name, length(seq)::BIGINT AS len, length(regexp_replace(seq, '[^a-z]', '', 'g'))::BIGINT AS lower, {_PCT.format("length(regexp_replace(seq, '[^a-z]', '', 'g'))", 'length(seq)')} AS lower_pct FROM seqs")
def run_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run that splits records."""
    return sinks.record_rows(cased(spark, sf_dir).withColumn("name", F.concat(F.lit("doc"), F.col("seq_id"))))


@query(
    f"""WITH {_sequences(_CASED)}, asked AS (SELECT seq_id AS a, lead(seq_id) OVER (ORDER BY seq_id) AS b FROM seqs QUALIFY b IS NOT NULL),
l AS (SELECT seq_id, unnest(range(0, length(seq))) AS i, unnest(string_split(seq, '')) AS c FROM seqs WHERE length(seq) > 0),
met AS (SELECT a, count(*) AS compared, count(*) FILTER (regexp_matches(x.c, '[a-z]')) AS mask1, count(*) FILTER (regexp_matches(y.c, '[a-z]')) AS mask2, count(*) FILTER (regexp_matches(x.c, '[a-z]') AND regexp_matches(y.c, '[a-z]')) AS "both"
  FROM asked JOIN l x ON x.seq_id = a JOIN l y ON y.seq_id = b AND y.i = x.i GROUP BY a)
SELECT 'doc' || asked.a || ' doc' || b AS pair, coalesce(compared, 0) AS compared, coalesce(mask1, 0) AS mask1, coalesce(mask2, 0) AS mask2, coalesce("both", 0) AS "both", coalesce(mask1 - "both", 0) AS only1, coalesce(mask2 - "both", 0) AS only2, length(s.seq)::BIGINT AS len1, length(t.seq)::BIGINT AS len2
FROM asked LEFT JOIN met ON met.a = asked.a JOIN seqs s ON s.seq_id = asked.a JOIN seqs t ON t.seq_id = b"""
)
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A control file that names each document and the next one, and what their letters' case has in common."""
    seqs = cased(spark, sf_dir).withColumn("file", F.concat(F.lit("doc"), F.col("seq_id")))
    # neighbours by rank, so that no task meets all documents
    placed = coords.offsets(seqs.withColumn("seq", F.lit("x"))).select("seq_id", "offset")
    after = placed.select((F.col("offset") - 1).alias("offset"), F.col("seq_id").alias("_next"))
    lines = placed.join(after, "offset").select(F.col("seq_id").alias("pair"), F.concat(F.lit(" doc"), F.col("seq_id"), F.lit(" \t doc"), F.col("_next"), F.lit(" tail")).alias("line"))
    one, two = (seqs.select(F.col("file").alias(f), F.col("seq").alias(x)) for f, x in (("file1", "seq1"), ("file2", "seq2")))
    met = readers.pairs(lines).join(one, "file1").join(two, "file2").select(F.concat_ws(" ", "file1", "file2").alias("pair"), "seq1", "seq2")
    return compare.compare_masks(met).select("pair", *compare.COUNTS)


# --- reports ---------------------------------------------------------------------------

_FACTS = f"""facts AS (SELECT s.seq_id, length(seq)::BIGINT AS n, length(regexp_replace(seq, '[^nN]', '', 'g'))::BIGINT AS gap, coalesce(r, 0)::BIGINT AS repeats, coalesce(t, 0)::BIGINT AS tandem
  FROM seqs s LEFT JOIN (SELECT seq_id, sum(len) AS r FROM blocks GROUP BY seq_id) b USING (seq_id) LEFT JOIN (SELECT seq_id, sum(len) AS t FROM ssr GROUP BY seq_id) c USING (seq_id))"""
_CELL = "concat_ws(chr(9), 'doc' || seq_id, type, cluster_id, start + 1, start + len, len, CASE WHEN cluster_id <= 2 THEN '+' ELSE strand END, '')"
_P2 = "printf('%.2f', CASE WHEN {1} = 0 THEN 0.0 ELSE round({0} * 100.0::DOUBLE / {1}, 2) END) || '%'"
_P4 = "printf('%.4f', CASE WHEN {1} = 0 THEN 0.0 ELSE round({0} * 100.0::DOUBLE / {1}, 4) END) || '%'"


@query(
    f"""{_run_sql(False, True)}, {_FACTS},
top AS (SELECT seq_id, unnest(range(0, 8)) AS part, unnest(['#kmer={S.kmer}', '#Minimal repeat block size={S.min_len}', '#Sequence length (bp)=' || n, '#Sequence coverage by repeats=' || {_P2.format("repeats", "(n - gap)")},
  '#Short tandem repeat (STR) sequence coverage=' || {_P2.format("tandem", "(n - gap)")}, '#Sequence gap (bp)=' || gap || ' (' || {_P4.format("gap", "n")} || ')', '', '{"' || chr(9) || '".join(sinks.COLUMNS)}']) AS line FROM facts)
SELECT 'doc' || seq_id AS report, part, line FROM top UNION ALL SELECT 'doc' || seq_id, 1073741824, {_CELL} FROM elements"""
)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each record's annotation table in a plain run: head with totals, then its rows."""
    seqs = cut(_records(spark, sf_dir).withColumn("report", F.col("name")))
    blocks, tandem = modes.own_blocks(seqs, S)
    elements = modes.elements_of(spark, seqs, blocks, tandem, S, True).withColumn("report", F.col("name"))
    return sinks.gff_lines(elements, modes.heads(modes.facts(seqs, blocks, tandem), S)).select("report", "part", "line")


@query(f"{_run_sql(False, False)}, {_OFFSETS} SELECT 'doc' || seq_id AS Seqid, type AS Repeat, cluster_id AS ClusterID, start + 1 + \"offset\" AS Start, start + len + \"offset\" AS Stop, len AS Length, CASE WHEN cluster_id <= 2 THEN '+' ELSE strand END AS Strand, '' AS Phase FROM elements JOIN placed USING (seq_id)".replace(", len AS Length", ", elements.len AS Length").replace("start + len +", "start + elements.len +"))
def combined_gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of a collated run, in coordinates of all records behind each other."""
    seqs = cut(_records(spark, sf_dir))
    return sinks.gff_rows(modes.moved(_found(spark, sf_dir, modes.own_blocks, False), coords.offsets(seqs)))


@query(f"{_run_sql(False, True)} SELECT 'doc' || seq_id AS seqid, type, cluster_id::INT AS cluster_id, start, len, CASE WHEN cluster_id <= 2 THEN '+' ELSE strand END AS strand FROM elements")
def run_read_gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation tables written line by line, heads and all, and read again."""
    lines = report_lines(spark, sf_dir).select(F.col("report").alias("file"), F.lit(0).alias("block"), F.col("part").alias("at"), "line")
    return readers.annotations(lines).select("seqid", "type", "cluster_id", "start", "len", "strand")


@query(
    f"""{_run_sql(False, True)}, wide AS (SELECT seq_id, length(seq) AS n, least(greatest(floor(10 * sqrt(length(seq))), 4000), 120000) AS w FROM seqs), top AS (SELECT seq_id, max(cluster_id) AS rows FROM elements GROUP BY seq_id)
SELECT DISTINCT 'doc' || seq_id AS report, cluster_id, (50 + round(start::DOUBLE * w / n))::BIGINT AS x, CASE cluster_id WHEN 1 THEN 90 WHEN 2 THEN 130 ELSE 180 + (cluster_id - 3) * CASE WHEN rows > 500 THEN 10 WHEN rows > 400 THEN 11 WHEN rows > 300 THEN 12 WHEN rows > 200 THEN 13 WHEN rows > 100 THEN 14 ELSE 16 END END::BIGINT AS y,
  greatest(1, round((start + len)::DOUBLE * w / n) - round(start::DOUBLE * w / n))::BIGINT AS w FROM elements JOIN wide USING (seq_id) JOIN top USING (seq_id) WHERE cluster_id <= {sinks.PICTURE_ROWS}"""
)
def picture_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strokes of each record's picture in a plain run."""
    seqs = cut(_records(spark, sf_dir))
    elements = _found(spark, sf_dir, modes.own_blocks, True).join(seqs.select("seq_id", F.length("seq").alias("n")), "seq_id")
    return sinks.picture(elements.withColumn("report", F.concat(F.lit("doc"), F.col("seq_id"))), "n", by=("report",)).distinct()


def _genomes(sql: str) -> str:
    return f"{sql}, el AS (SELECT e.*, coalesce(lang, '') AS genome FROM elements e JOIN documents ON doc_id = seq_id), names AS (SELECT DISTINCT genome FROM el), fam AS (SELECT cluster_id, count(DISTINCT genome) AS f FROM el WHERE cluster_id > 2 GROUP BY cluster_id)"


@query(
    f"""{_genomes(_run_sql(True, False))}, own AS (SELECT genome, count(DISTINCT cluster_id) AS families, count(DISTINCT cluster_id) FILTER (f = (SELECT count(*) FROM names)) AS core, count(DISTINCT cluster_id) FILTER (f > 1 AND f < (SELECT count(*) FROM names)) AS accessory,
  count(DISTINCT cluster_id) FILTER (f = 1 AND (SELECT count(*) FROM names) > 1) AS "unique", sum(len) AS bp FROM el JOIN fam USING (cluster_id) GROUP BY genome)
SELECT genome, coalesce(max(families), 0) AS families, coalesce(max(core), 0) AS core, coalesce(max(accessory), 0) AS accessory, coalesce(max("unique"), 0) AS "unique", coalesce(max(bp), 0)::BIGINT AS bp, count(*) FILTER (cluster_id = 1) AS "STR", coalesce(sum(len) FILTER (cluster_id = 1), 0)::BIGINT AS "STR_bp",
  count(*) FILTER (cluster_id = 2) AS "UCRP", coalesce(sum(len) FILTER (cluster_id = 2), 0)::BIGINT AS "UCRP_bp" FROM el LEFT JOIN own USING (genome) GROUP BY genome"""
)
def pangenome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language as a genome in a joint run: its families by category, tandem repeats and blocks alone."""
    genome = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.coalesce("lang", F.lit("")).alias("genome"))
    return modes.pangenome_tables(cut(_found(spark, sf_dir, modes.joint_blocks, False).join(genome, "seq_id")))["Per-genome summary"]


@query(f"{_genomes(_run_sql(True, False))} SELECT f AS present_in, count(*) AS families FROM fam GROUP BY f UNION ALL SELECT n, 0 FROM (SELECT unnest(range(1, (SELECT count(*) FROM names) + 1)) AS n) WHERE n NOT IN (SELECT f FROM fam)")
def pangenome_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    genome = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.coalesce("lang", F.lit("")).alias("genome"))
    return modes.pangenome_tables(cut(_found(spark, sf_dir, modes.joint_blocks, False).join(genome, "seq_id")))["Family frequency spectrum"].select("present_in", "families")


# --- clusters --------------------------------------------------------------------------

_BASE = f"{_sequences()}, {_windows()}, {_blocks(False)}, {_BLOCKSEQ}"


@query(f"WITH {_BASE} SELECT quantile_cont(len::DOUBLE, 0.5) AS median_len, least(23, greatest(11, (7 + length(bin(greatest(1, floor(quantile_cont(len::DOUBLE, 0.5)))::BIGINT)) // 2 + 1) | 1))::INT AS k FROM bseq")
def block_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k for containment, from the median length of blocks."""
    return modes.auto_k(_block_sequences(spark, sf_dir))


@query(f"{_run_sql(False, False)} SELECT i AS cluster_id, count(e.cluster_id) AS members, coalesce(sum(len), 0)::BIGINT AS bp FROM (SELECT 1 AS i UNION SELECT 2 UNION SELECT cluster_id FROM elements) LEFT JOIN elements e ON e.cluster_id = i GROUP BY i")
def family_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a collated run, those of tandem repeats and blocks alone always."""
    return clustering.family_rows(_found(spark, sf_dir, modes.own_blocks, False))


@query(
    f"""{_run_sql(False, False)}, lib AS (SELECT item_id AS seq_id, text, {_DNA} AS seq FROM benchmark), {_windows(11, "lib").replace("w AS", "lw AS", 1)}, {_windows(11, "bseq").replace("w AS", "b11 AS", 1)},
hits AS (SELECT a.seq_id, b.seq_id AS ref_id, count(DISTINCT a.ck) AS shared FROM b11 a JOIN lw b USING (ck) GROUP BY 1, 2 HAVING count(DISTINCT a.ck) >= 5),
best AS (SELECT seq_id, ref_id FROM hits QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY shared DESC, ref_id) = 1)
SELECT b.record AS seq_id, b.start, coalesce(cluster_id, 2)::BIGINT AS cluster_id, CASE WHEN cluster_id IS NULL THEN 'UCRP' WHEN ref_id > 0 THEN ref_id || ':entry ' || ref_id ELSE 'CRP' END AS type
FROM bseq b JOIN taken t USING (seq_id) LEFT JOIN families f ON f.seed = t.seed LEFT JOIN best ON best.seq_id = t.seed AND cluster_id IS NOT NULL"""
)
def library_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of a collated run named by the passage that their seed shares most k-mers with."""
    seqs = _records(spark, sf_dir)
    named = cut(clustering.block_sequences(seqs, modes.own_blocks(seqs, S)[0]))
    links = cut(modes.block_links(named, seqs, S, ()))
    got = clustering.numbered(named, clustering.clusters(named, links))
    library = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), F.concat(F.lit("entry "), F.col("item_id")).alias("ref_name"), nt.from_text(F.col("text")).alias("seq"))
    return modes.with_labels(got, named, library).select(F.col("record").alias("seq_id"), "start", "cluster_id", "type")


# --- readers and scalar functions ------------------------------------------------------

_CLEAN_TEXT = f"translate(regexp_replace(coalesce(text, ''), '{_KEPT}', '', 'g'), 'uiABCDGHIKMNRSTUVWY', 'tcabcdghckmnrsttvwy')"


@query(
    f"""WITH files AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), before AS (SELECT conv_id, coalesce(sum(n) OVER (ORDER BY lpad(conv_id::VARCHAR, 12, '0') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM files),
rec AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rec_no, regexp_extract(trim(coalesce(role, '')), '^(\\S*)', 1) AS name, {_CLEAN_TEXT} AS seq FROM conversations)
SELECT (b + rec_no - 1)::BIGINT AS seq_id, lpad(conv_id::VARCHAR, 12, '0') AS file, rec_no, name, seq, length(seq)::BIGINT AS len FROM rec JOIN before USING (conv_id)"""
)
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files of a folder, read in the order of their names and numbered through."""
    return readers._records(_conversation_lines(spark, sf_dir), False, False, "block")


def _conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, block, at, line: a head with the role and more words, then the text, whose line breaks and head signs are no letters."""
    turns = table(spark, sf_dir, "conversations")
    text = F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ")
    two = F.array(F.concat(F.lit(">"), F.coalesce("role", F.lit("")), F.lit(" of some words")), F.regexp_replace(text, "^>+", ""))
    lines = turns.select(F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("file"), F.floor(F.col("turn") / 2).alias("block"), "turn", F.posexplode(two).alias("i", "line"))
    return lines.select("file", "block", (F.col("turn") * 2 + F.col("i")).alias("at"), "line")


@query(f"WITH {_sequences(_CLEAN)} SELECT row_number() OVER (ORDER BY lpad(seq_id::VARCHAR, 12, '0')) AS ref_id, 'doc' || seq_id || ' and more words' AS ref_name, seq FROM seqs")
def library_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with one entry each, whose names are kept whole."""
    docs = table(spark, sf_dir, "documents")
    text = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\n\r", "  "), "^>+", "")
    two = F.array(F.concat(F.lit(">doc"), F.col("doc_id"), F.lit(" and more words")), text)
    lines = docs.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file"), F.lit(0).alias("block"), F.posexplode(two).alias("at", "line"))
    return readers.library(readers._records(lines, False, True, "block"))


@query(
    """WITH line AS (SELECT conv_id, turn, regexp_replace(translate(coalesce(text, ''), chr(10) || chr(13), '  '), '^[\t ]+|[\t ]+$', '', 'g') AS l FROM conversations), part AS (SELECT conv_id, turn, string_split_regex(l, '[\t ]+') AS d FROM line)
SELECT conv_id * 1000 + turn AS pair, d[1] AS file1, d[2] AS file2 FROM part WHERE len(d) >= 2"""
)
def control_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of each line of a control file."""
    turns = table(spark, sf_dir, "conversations")
    return readers.pairs(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair"), F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ").alias("line")))


@query(
    """WITH t AS (SELECT page_id, url AS x FROM pages UNION ALL SELECT page_id, ' -' || page_id || '.5' FROM pages UNION ALL SELECT page_id, page_id || ',' || page_id FROM pages UNION ALL SELECT page_id, '9' || page_id || '00000000000x' FROM pages),
h AS (SELECT page_id, x, regexp_extract(x, '^([^.,]*)', 1) AS head FROM t), d AS (SELECT page_id, x, head, substr(regexp_replace(head, '[^0-9]', '', 'g'), 1, 11) AS digits FROM h)
SELECT page_id, x AS text, CASE WHEN digits = '' OR digits IS NULL THEN NULL ELSE greatest(-2147483648, least(2147483647, CASE WHEN starts_with(ltrim(head), '-') THEN -digits::BIGINT ELSE digits::BIGINT END)) END AS value FROM d"""
)
def lenient_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in addresses and in odd writings, as the command line reads them."""
    pages = table(spark, sf_dir, "pages")
    i = F.col("page_id").cast("string")
    texts = F.array(F.col("url"), F.concat(F.lit(" -"), i, F.lit(".5")), F.concat(i, F.lit(","), i), F.concat(F.lit("9"), i, F.lit("00000000000x")))
    return pages.select("page_id", F.explode(texts).alias("text")).select("page_id", "text", nt.lenient_int_of(F.col("text")).alias("value"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, format('{:,}', length(html) * 1000) AS thousands FROM pages")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", nt.escaped(F.col("html")).alias("escaped"), nt.thousands(F.length("html") * 1000).alias("thousands"))


# --- letters that are no base ----------------------------------------------------------

_GAPPED = f"translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), '{nt.TEXT_LETTERS + nt.TEXT_LETTERS.upper()}', '{nt.GAPPED_BASES * 2}')"


def _gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), nt.from_text_with_gaps(F.col("text")).alias("seq"))


@query(f"WITH {_sequences(_GAPPED)}, {_windows(11)} SELECT ck AS kmer, count(*) AS n FROM w GROUP BY ck HAVING count(*) > 1")
def kmer_repeated_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with a letter that is no base are left out."""
    return kmers.counts(_gapped(spark, sf_dir), 11).where("n > 1").select(nt.kmer_letters(F.col("ck"), 11).alias("kmer"), "n")


@query(f"WITH {_sequences(_GAPPED)}, {_windows()}, {_blocks(False)} SELECT seq_id, start, len FROM blocks")
def repeat_blocks_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.repeat_blocks(_gapped(spark, sf_dir), K, MIN_LEN)


@query(
    f"""WITH {_sequences(_GAPPED)}, {_ssr()}, {_windows()}, {_blocks(False, "ssrbase")}, {_FACTS}
SELECT seq_id, n AS len, gap AS gap_bp, repeats AS repeat_bp, tandem AS ssr_bp, {_PCT.format("repeats", "(n - gap)")} AS repeat_pct, {_PCT.format("tandem", "(n - gap)")} AS ssr_pct, {_PCT.format("gap", "n")} AS gap_pct FROM facts"""
)
def repeat_stats_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of what isn't a gap, of each record."""
    seqs = _gapped(spark, sf_dir).withColumn("report", F.col("seq_id"))
    known = modes.facts(seqs, *modes.own_blocks(seqs, S))
    share = lambda x, of: nt.percent(F.col(x), of)
    free = F.col("n") - F.col("gap")
    return known.select(F.col("report").alias("seq_id"), F.col("n").alias("len"), F.col("gap").alias("gap_bp"), F.col("repeats").alias("repeat_bp"), F.col("tandem").alias("ssr_bp"), share("repeats", free).alias("repeat_pct"), share("tandem", free).alias("ssr_pct"), share("gap", F.col("n")).alias("gap_pct"))


@query(f"WITH {_sequences()}, {_windows()}, {_blocks(False).replace(f'r >= {masking.least_windows(K)}', f'r >= {masking.least_windows(K, False)}')} SELECT seq_id, start, len FROM blocks")
def repeat_blocks_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The less sensitive kind of high bases."""
    return masking.repeat_blocks(documents(spark, sf_dir), K, MIN_LEN, sensitive=False)


@query(f"WITH {_sequences()}, {_ssr()}, {_windows()}, {_blocks(False, 'ssrbase')}, {_IMPORTED} SELECT seq_id, start, len FROM imported")
def softmask_import_ssr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a soft mask, none of which begins in a tandem repeat."""
    return modes.imported_blocks(_masked(documents(spark, sf_dir)), S)[0]


# --- alignment masking -----------------------------------------------------------------

A_K, A_LEN = 7, 14
_ALIGNED = f"""seqs AS (SELECT item_id AS seq_id, {_DNA} AS seq FROM benchmark WHERE length({_DNA}) >= {A_K}),
bo AS (SELECT seq_id, length(seq) AS n, seq || '!' || reverse(translate(seq, 'acgt', 'tgca')) AS b FROM seqs),
seed AS (SELECT seq_id, p, substr(b, (p + 1)::BIGINT, {A_K}) AS w FROM (SELECT *, unnest(range(0, length(b) - {A_K} + 1)) AS p FROM bo) WHERE NOT contains(substr(b, (p + 1)::BIGINT, {A_K}), '!')),
turn AS (SELECT *, min(p) OVER (PARTITION BY seq_id, w) AS t FROM seed),
duo AS (SELECT a.seq_id, a.t, a.p AS x, b.p AS y, least(CASE WHEN a.p < n THEN n ELSE 2 * n + 1 END - a.p, CASE WHEN b.p < n THEN n ELSE 2 * n + 1 END - b.p) AS room FROM turn a JOIN turn b ON a.seq_id = b.seq_id AND a.w = b.w AND a.p < b.p JOIN bo ON bo.seq_id = a.seq_id),
miss AS (SELECT seq_id, x, y, h FROM (SELECT d.seq_id, x, y, b, unnest(range({A_K}, room)) AS h FROM duo d JOIN bo USING (seq_id) WHERE room > {A_LEN}) WHERE substr(b, (x + h + 1)::BIGINT, 1) <> substr(b, (y + h + 1)::BIGINT, 1)),
gaps AS (SELECT *, h - lag(h, 1) OVER z AS g1, lag(h, 1) OVER z - lag(h, 2) OVER z AS g2, lag(h, 2) OVER z - lag(h, 3) OVER z AS g3 FROM miss WINDOW z AS (PARTITION BY seq_id, x, y ORDER BY h)),
stop AS (SELECT seq_id, x, y, min(h) - 3 AS h FROM gaps WHERE g1 <= 2 AND g2 <= 2 AND g3 <= 2 GROUP BY seq_id, x, y),
pair AS (SELECT d.seq_id, t, x, y, coalesce(h, room) AS h FROM duo d LEFT JOIN stop USING (seq_id, x, y) WHERE coalesce(h, room) > {A_LEN}),
spans AS (SELECT p.seq_id, t, x, y, [{{'a': x, 'z': x + h, 'c': CASE WHEN y < n THEN y ELSE 2 * n + 1 - y - h END, 'd': CASE WHEN y < n THEN y + h ELSE 2 * n + 1 - y END, 'x': x, 'y': y}}] AS s FROM pair p JOIN bo USING (seq_id)),
fold AS (SELECT seq_id, list_reduce(list(s ORDER BY t, x, y), lambda got, e: CASE WHEN len([q for q in got if (q.a <= e[1].x AND e[1].x < q.z) OR (q.c <= e[1].x AND e[1].x < q.d) OR (q.a <= e[1].y AND e[1].y < q.z) OR (q.c <= e[1].y AND e[1].y < q.d)]) > 0 THEN got ELSE got || e END) AS f FROM spans GROUP BY seq_id),
kept AS (SELECT seq_id, unnest(f) AS q FROM fold),
marks AS (SELECT DISTINCT k.seq_id, i FROM (SELECT seq_id, unnest(range(q.a, q.z)) AS i FROM kept UNION ALL SELECT seq_id, unnest(range(q.c, q.d)) FROM kept) k JOIN bo USING (seq_id) WHERE i < n),
mnum AS (SELECT seq_id, i, coalesce(i - lag(i) OVER (PARTITION BY seq_id ORDER BY i) > {A_LEN} + 1, true) AS new FROM marks),
mrun AS (SELECT *, sum(new::INT) OVER (PARTITION BY seq_id ORDER BY i) AS g FROM mnum), aruns AS (SELECT seq_id, min(i) AS first, max(i) AS last FROM mrun GROUP BY seq_id, g)"""


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), nt.from_text(F.col("text")).alias("seq"))


@query(f"WITH {_ALIGNED} SELECT seq_id, first, last FROM aruns")
def align_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that extended seed pairs mark in short passages, whose pairs SQL can put in order."""
    return alignment.align_runs(_passages(spark, sf_dir), A_K, A_LEN)


@query(
    f"""WITH {_ALIGNED}, ext AS (SELECT seq_id, first AS f, least(last + {A_K - 1}, length(seq) - 1) AS e FROM aruns JOIN seqs USING (seq_id) WHERE last - first + 1 > {A_K}),
emrk AS (SELECT *, coalesce(max(e) OVER (PARTITION BY seq_id ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < f, true) AS new FROM ext), enum AS (SELECT *, sum(new::INT) OVER (PARTITION BY seq_id ORDER BY f) AS g FROM emrk)
SELECT seq_id, min(f) AS start, max(e) - min(f) + 1 AS len FROM enum GROUP BY seq_id, g HAVING max(e) - min(f) + 1 > {A_LEN}"""
)
def align_passage_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_blocks(_passages(spark, sf_dir), A_K, A_LEN)
