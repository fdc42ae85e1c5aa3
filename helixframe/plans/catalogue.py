"""Registered queries over the driver's tables, and their SQL.

documents are the sequences: their letters stand for nucleotides (nucleotide.from_text), or, where
case or the alphabet matters, those that are in the alphabet are kept as they are. Languages or
sources are genomes, benchmark passages the library, pages and conversations text with lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nucleotide as nt
from ..operators import alignment, clustering, compare, coords, families, kmers, masking, ssr
from ..runtime import cut, send_package
from ..sources import readers, sinks

K, MIN_LEN = 19, 80

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    send_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """seq_id, seq (nucleotides), and more columns; dealt anew only where there are fewer partitions than cores."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), "text", *more)
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores)
    # through explode() no filter is pushed that would read the letters a second time
    return docs.select("seq_id", F.explode(F.array(nt.from_text(F.col("text")))).alias("seq"), *more)


def cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), nt.clean_keep_case(F.coalesce("text", F.lit(""))).alias("seq"))


# --- SQL that several queries share ---------------------------------------------------

_DNA = f"translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), '{nt.TEXT_LETTERS + nt.TEXT_LETTERS.upper()}', '{nt.TEXT_BASES * 2}')"
_KEPT = "[^abcdghikmnrstuvwyABCDGHIKMNRSTUVWY]"
_CASED = f"translate(regexp_replace(coalesce(text, ''), '{_KEPT}', '', 'g'), 'uiUI', 'tcTC')"
_CLEAN = f"translate(regexp_replace(coalesce(text, ''), '{_KEPT}', '', 'g'), 'uiABCDGHIKMNRSTUVWY', 'tcabcdghckmnrsttvwy')"
_COMPLEMENT = f"translate({{0}}, '{nt._CASED}', '{nt.COMPLEMENTS * 2}')"


def _sequences(sql: str = _DNA, more: str = "") -> str:
    return f"seqs AS (SELECT doc_id AS seq_id, {sql} AS seq{more} FROM documents)"


def _windows(k: int = K, name: str = "seqs") -> str:
    """w: seq_id, pos, ck (canonical k-mer), own (own reverse complement)."""
    flip = "reverse(translate(x, 'acgt', 'tgca'))"
    return (
        f"w AS (SELECT seq_id, pos, least(x, {flip}) AS ck, x = {flip} AS own FROM (SELECT seq_id, unnest(range(0, greatest(length(seq) - {k - 1}, 0))) AS pos, "
        f"substr(seq, (unnest(range(0, greatest(length(seq) - {k - 1}, 0))) + 1)::BIGINT, {k}) AS x FROM {name}) WHERE NOT regexp_matches(x, '[^acgt]'))"
    )


def _blocks(shared: bool, without: str = "", k: int = K, min_len: int = MIN_LEN, given: bool = False) -> str:
    """blocks: seq_id, start, len, by one row for each covered base. without: a table (seq_id, base) of bases that don't count."""
    by = "ck" if shared else "seq_id, ck"
    least = masking.least_windows(k)
    barred = f"WHERE NOT EXISTS (SELECT 1 FROM {without} b WHERE b.seq_id = c.seq_id AND b.base = c.base)" if without else ""
    return f"""rep AS (SELECT seq_id, pos FROM w JOIN (SELECT {by} FROM w GROUP BY {by} HAVING count(*) > 1 OR bool_or(own)) USING ({by})),
cov AS (SELECT seq_id, base, count(*) AS r FROM (SELECT seq_id, unnest(range(pos, pos + {k})) AS base FROM rep) GROUP BY seq_id, base),
free AS (SELECT * FROM cov c {barred}),
isl AS (SELECT *, base - row_number() OVER (PARTITION BY seq_id ORDER BY base) AS g FROM free),
runs AS (SELECT seq_id, min(base) AS f, max(base) AS l, count(*) FILTER (r >= {least}) AS high FROM isl GROUP BY seq_id, g HAVING count(*) FILTER (r >= {least}) > 1),
ext AS (SELECT seq_id, f, least(l + {k - 1}, length(seq) - 1) AS e FROM runs JOIN seqs USING (seq_id)),
mrk AS (SELECT *, coalesce(max(e) OVER (PARTITION BY seq_id ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < f, true) AS new FROM ext),
num AS (SELECT *, sum(new::INT) OVER (PARTITION BY seq_id ORDER BY f) AS n FROM mrk),
blocks AS (SELECT seq_id, min(f) AS start, max(e) - min(f) + 1 AS len FROM num GROUP BY seq_id, n HAVING max(e) - min(f) + 1 > {min_len})"""


def _ssr() -> str:
    """ssr: seq_id, start, len; ssrbase: seq_id, base. Each unit's islands of letters that equal the one a unit before."""
    return f"""letters AS (SELECT seq_id, unnest(range(0, length(seq))) AS i, unnest(string_split(seq, '')) AS c FROM seqs WHERE length(seq) > 0),
lagged AS (SELECT seq_id, i, c, {", ".join(f"lag(c, {u}) OVER (PARTITION BY seq_id ORDER BY i) AS c{u}" for u in range(1, ssr.MAX_UNIT + 1))} FROM letters),
eq AS ({" UNION ALL ".join(f"SELECT seq_id, i, {u} AS u FROM lagged WHERE c = c{u} AND c IN ('a', 'c', 'g', 't')" for u in range(1, ssr.MAX_UNIT + 1))}),
eqi AS (SELECT *, i - row_number() OVER (PARTITION BY seq_id, u ORDER BY i) AS g FROM eq),
tan AS (SELECT seq_id, min(i) - u AS s, max(i) AS e FROM eqi GROUP BY seq_id, u, g HAVING count(*) + u >= greatest({ssr.LEAST}, {ssr.COPIES} * u)),
tmk AS (SELECT *, coalesce(max(e) OVER (PARTITION BY seq_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 < s, true) AS new FROM tan),
tnm AS (SELECT *, sum(new::INT) OVER (PARTITION BY seq_id ORDER BY s, e) AS n FROM tmk),
ssr AS (SELECT seq_id, min(s) AS start, max(e) - min(s) + 1 AS len FROM tnm GROUP BY seq_id, n),
ssrbase AS (SELECT seq_id, unnest(range(start, start + len)) AS base FROM ssr)"""


def _caseruns(upper: bool, gap: int, min_len: int) -> str:
    letter = "[A-Z]" if upper else "[a-z]"
    return f"""letters AS (SELECT seq_id, unnest(range(0, length(seq))) AS i, unnest(string_split(seq, '')) AS c FROM seqs WHERE length(seq) > 0),
hit AS (SELECT *, i - row_number() OVER (PARTITION BY seq_id ORDER BY i) AS g FROM letters WHERE regexp_matches(c, '{letter}')),
runs AS (SELECT seq_id, min(i) AS f, max(i) AS l FROM hit GROUP BY seq_id, g),
mrk AS (SELECT *, coalesce(f - lag(l) OVER (PARTITION BY seq_id ORDER BY f) >= {gap}, true) AS new FROM runs),
num AS (SELECT *, sum(new::INT) OVER (PARTITION BY seq_id ORDER BY f) AS n FROM mrk),
blocks AS (SELECT seq_id, min(f) AS start, max(l) - min(f) + 1 AS len FROM num GROUP BY seq_id, n HAVING max(l) - min(f) + 1 >= {min_len})"""


# --- scans and scalar functions -------------------------------------------------------


def _scalar(column: Callable, sql: str, base=cased, base_sql: str = _CASED):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return base(spark, sf_dir).select("seq_id", column(F.col("seq")).alias("value"))

    return run, f"WITH {_sequences(base_sql)} SELECT seq_id, {sql} AS value FROM seqs"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.coalesce("text", F.lit("")).alias("seq"))


for _name, (_run, _sql) in {
    "fasta_normalize": _scalar(nt.clean, _CLEAN.replace("coalesce(text, '')", "seq"), _raw, "coalesce(text, '')"),
    "fasta_raw_filter": _scalar(nt.clean_keep_case, _CASED.replace("coalesce(text, '')", "seq"), _raw, "coalesce(text, '')"),
    "lenient_normalize": _scalar(nt.lenient, "translate(regexp_replace(seq, '[^abcdefghijklmnrstuvwyABCDEFGHIJKLMNRSTUVWY]', '', 'g'), 'efjliuABCDEFGHIJKLMNRSTUVWY', 'acgtgtabcdacghggktmnrsttvwy')", _raw, "coalesce(text, '')"),
    "complement": _scalar(nt.complement, _COMPLEMENT.format("seq")),
    "reverse_sequence": _scalar(F.reverse, "reverse(seq)"),
    "reverse_complement": _scalar(nt.reverse_complement, f"reverse({_COMPLEMENT.format('seq')})"),
    "complement_case": _scalar(nt.reverse_complement_keep_case, f"reverse(translate(seq, '{nt._CASED}', '{nt._CASED_COMPLEMENTS}'))"),
    "base_code": _scalar(nt.base_codes, "translate(regexp_replace(seq, '[^atcg]', 'n', 'g'), 'atcgn', '01234')"),
    "complement_code": _scalar(lambda x: nt.complement_codes(nt.base_codes(x)), "translate(translate(regexp_replace(seq, '[^atcg]', 'n', 'g'), 'atcgn', '01234'), '0123', '1032')"),
    "ambiguity_count": _scalar(nt.ambiguous, "length(regexp_replace(seq, '[acgtACGT]', '', 'g'))::BIGINT"),
    "gap_count": _scalar(nt.gaps, "length(regexp_replace(seq, '[^nN]', '', 'g'))::BIGINT"),
    "lower_count": _scalar(lambda x: nt.count_of(x, "a-z"), "length(regexp_replace(seq, '[^a-z]', '', 'g'))::BIGINT"),
    "gc_content": _scalar(lambda x: nt.percent(nt.count_of(x, "gcGC"), F.length(x)), "CASE WHEN length(seq) = 0 THEN 0.0 ELSE round(length(regexp_replace(seq, '[^gcGC]', '', 'g')) * 100.0::DOUBLE / length(seq), 2) END::DOUBLE"),
    "line_wrap": _scalar(nt.wrapped, "rtrim(regexp_replace(seq, '(.{70})', '\\1' || chr(10), 'g'), chr(10))"),
}.items():
    QUERIES[_name], ORACLES[_name] = _run, _sql


@query(
    f"""WITH lines AS (SELECT conv_id, turn, text AS line FROM conversations),
parts AS (SELECT conv_id, turn AS rec_no, role AS name, translate(regexp_replace(coalesce(text, ''), '{_KEPT}', '', 'g'), 'uiABCDGHIKMNRSTUVWY', 'tcabcdghckmnrsttvwy') AS seq FROM conversations)
SELECT conv_id AS file, row_number() OVER (PARTITION BY conv_id ORDER BY rec_no) AS rec_no, coalesce(name, '') AS name, seq FROM parts"""
)
def fasta_split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a file whose turns are records: a header line with the role, then the text."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), "turn", "role", "text")
    two = F.array(F.concat(F.lit(">"), F.coalesce("role", F.lit(""))), F.coalesce("text", F.lit("")))
    lines = turns.select("file", "turn", F.posexplode(two).alias("i", "line")).withColumn("at", F.col("turn") * 2 + F.col("i"))
    got = readers.split_records(lines, "at", nt.clean(F.col("line")), F.col("i") == 0)
    return got.select("file", "rec_no", "name", "seq")


@query(
    """WITH parts AS (SELECT page_id, unnest(string_split(html, '><')) AS line FROM pages)
SELECT page_id, count(*) AS n_lines, count(*) FILTER (contains(line, '>')) AS n_headers, coalesce(max(length(line)), 0) AS longest FROM parts GROUP BY page_id"""
)
def line_header_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a header sign anywhere."""
    lines = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split("html", "><")).alias("line"))
    return lines.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.count(F.when(F.contains("line", F.lit(">")), 1)).alias("n_headers"), F.max(F.length("line")).cast("long").alias("longest"))


# --- k-mers ----------------------------------------------------------------------------


@query(f"WITH {_sequences()}, {_windows()} SELECT count(*) AS distinct_kmers, sum(n)::BIGINT AS windows, max(n) AS most FROM (SELECT ck, count(*) AS n FROM w GROUP BY ck)")
def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.counts(documents(spark, sf_dir), K).agg(F.count("*").alias("distinct_kmers"), F.sum("n").alias("windows"), F.max("n").alias("most"))


@query(f"WITH {_sequences()}, {_windows()} SELECT ck AS kmer, count(*) AS n FROM w GROUP BY ck HAVING count(*) > 1")
def kmer_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.counts(documents(spark, sf_dir), K).where("n > 1").select(nt.kmer_letters(F.col("ck"), K).alias("kmer"), "n")


@query(f"WITH {_sequences()}, {_windows()} SELECT ck AS kmer, count(*) AS n FROM w GROUP BY ck ORDER BY n DESC, kmer LIMIT 100")
def kmer_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = kmers.counts(documents(spark, sf_dir), K).orderBy(F.desc("n"), "ck").limit(100)
    return top.select(nt.kmer_letters(F.col("ck"), K).alias("kmer"), "n")


@query(f"WITH {_sequences()}, {_windows()} SELECT n, count(*) AS kmers FROM (SELECT ck, count(*) AS n FROM w GROUP BY ck) GROUP BY n")
def kmer_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.counts(documents(spark, sf_dir), K).groupBy("n").agg(F.count("*").alias("kmers"))


@query(f"WITH {_sequences()}, {_windows(12)} SELECT ck AS kmer, count(*) AS n FROM w WHERE own GROUP BY ck")
def kmer_palindromes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.windows(documents(spark, sf_dir), 12).where("own").groupBy("ck").agg(F.count("*").alias("n")).select(nt.kmer_letters(F.col("ck"), 12).alias("kmer"), "n")


# --- masking ---------------------------------------------------------------------------


@query(f"WITH {_sequences()}, {_windows()}, {_blocks(False)} SELECT seq_id, base AS pos, r * 2 AS coverage FROM cov")
def coverage_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.coverage(kmers.repeated(documents(spark, sf_dir), K, False), K)


@query(f"WITH {_sequences()}, {_windows()}, {_blocks(False)} SELECT seq_id, start, len FROM blocks")
def repeat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.repeat_blocks(documents(spark, sf_dir), K, MIN_LEN)


@query(f"WITH {_sequences()}, {_windows()}, {_blocks(True)} SELECT seq_id, start, len FROM blocks")
def repeat_blocks_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.repeat_blocks(documents(spark, sf_dir), K, MIN_LEN, shared=True)


_PCT = "CASE WHEN {1} = 0 THEN 0.0 ELSE round({0} * 100.0::DOUBLE / {1}, 2) END::DOUBLE"
_STATS = f"stats AS (SELECT s.seq_id, lang, length(seq) AS len, coalesce(bp, 0)::BIGINT AS repeat_bp, coalesce(n, 0) AS blocks FROM seqs s LEFT JOIN (SELECT seq_id, sum(len) AS bp, count(*) AS n FROM blocks GROUP BY seq_id) USING (seq_id))"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = documents(spark, sf_dir, "lang")
    found = masking.repeat_blocks(seqs, K, MIN_LEN).groupBy("seq_id").agg(F.sum("len").alias("repeat_bp"), F.count("*").alias("blocks"))
    got = seqs.select("seq_id", "lang", F.length("seq").cast("long").alias("len")).join(found, "seq_id", "left")
    return got.na.fill(0, ["repeat_bp", "blocks"])


@query(f"WITH {_sequences(more=', lang')}, {_windows()}, {_blocks(False)}, {_STATS} SELECT seq_id, len, blocks, repeat_bp, {_PCT.format('repeat_bp', 'len')} AS repeat_pct FROM stats")
def repeat_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("seq_id", "len", "blocks", "repeat_bp", nt.percent(F.col("repeat_bp"), F.col("len")).alias("repeat_pct"))


@query(
    f"WITH {_sequences(more=', lang')}, {_windows()}, {_blocks(False)}, {_STATS} SELECT coalesce(lang, 'all') AS genome, count(*) AS sequences, sum(len)::BIGINT AS len, sum(blocks)::BIGINT AS blocks, sum(repeat_bp)::BIGINT AS repeat_bp, {_PCT.format('sum(repeat_bp)', 'sum(len)')} AS repeat_pct FROM stats GROUP BY ROLLUP (lang)"
)
def repeat_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _stats(spark, sf_dir).rollup("lang").agg(F.count("*").alias("sequences"), *[F.sum(c).alias(c) for c in ("len", "blocks", "repeat_bp")])
    return got.select(F.coalesce("lang", F.lit("all")).alias("genome"), "sequences", "len", "blocks", "repeat_bp", nt.percent(F.col("repeat_bp"), F.col("len")).alias("repeat_pct"))


@query(
    f"""WITH {_sequences()}, {_windows()}, {_blocks(False)}, hit AS (SELECT seq_id, unnest(range(start, start + len)) AS i FROM blocks),
letters AS (SELECT seq_id, unnest(range(0, length(seq))) AS i, unnest(string_split(seq, '')) AS c FROM seqs WHERE length(seq) > 0)
SELECT s.seq_id, coalesce(m.seq, '') AS seq FROM seqs s LEFT JOIN (SELECT l.seq_id, string_agg(CASE WHEN h.i IS NULL THEN upper(c) ELSE c END, '' ORDER BY l.i) AS seq FROM letters l LEFT JOIN hit h ON h.seq_id = l.seq_id AND h.i = l.i GROUP BY l.seq_id) m USING (seq_id)"""
)
def soft_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = documents(spark, sf_dir)
    return masking.soft_mask(seqs, masking.repeat_blocks(seqs, K, MIN_LEN))


@query(f"WITH {_sequences(_CASED)}, {_caseruns(False, 2 * K, MIN_LEN)} SELECT seq_id, start, len FROM blocks")
def softmask_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.merged_runs(masking.case_runs(cased(spark, sf_dir)), 2 * K, MIN_LEN)


@query(f"WITH {_sequences(_CASED)}, {_caseruns(True, 6, 4)} SELECT seq_id, start, len FROM blocks")
def unique_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of capitals. Capitals are rare in prose, hence a small gap and length."""
    return masking.merged_runs(masking.case_runs(cased(spark, sf_dir), upper=True), 6, 4)


@query(
    f"""WITH {_sequences()}, {_windows()}, {_blocks(True)}
SELECT s.seq_id, length(seq) AS len, (length(seq) - coalesce(bp, 0))::BIGINT AS unique_bp, CASE WHEN length(seq) = 0 THEN 0 ELSE floor(coalesce(bp, 0) * 100 / length(seq)) END::BIGINT AS homology_pct
FROM seqs s LEFT JOIN (SELECT seq_id, sum(len)::BIGINT AS bp FROM blocks GROUP BY seq_id) USING (seq_id)"""
)
def homology_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not shared between sequences, and the whole percents that are."""
    seqs = documents(spark, sf_dir)
    bp = masking.repeat_blocks(seqs, K, MIN_LEN, shared=True).groupBy("seq_id").agg(F.sum("len").alias("bp"))
    got = seqs.select("seq_id", F.length("seq").cast("long").alias("len")).join(bp, "seq_id", "left").na.fill(0, ["bp"])
    return got.select("seq_id", "len", (F.col("len") - F.col("bp")).alias("unique_bp"), F.when(F.col("len") == 0, 0).otherwise(F.floor(F.col("bp") * 100 / F.col("len"))).cast("long").alias("homology_pct"))


@query(f"WITH {_sequences()}, {_ssr()} SELECT seq_id, start, len FROM ssr")
def ssr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ssr.ssr_blocks(documents(spark, sf_dir))


@query(f"WITH {_sequences()}, {_ssr()} SELECT s.seq_id, coalesce(count(start), 0) AS blocks, coalesce(sum(ssr.len), 0)::BIGINT AS ssr_bp FROM seqs s LEFT JOIN ssr USING (seq_id) GROUP BY s.seq_id")
def ssr_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = documents(spark, sf_dir)
    each = ssr.ssr_blocks(seqs).groupBy("seq_id").agg(F.count("*").alias("blocks"), F.sum("len").alias("ssr_bp"))
    return seqs.select("seq_id").join(each, "seq_id", "left").na.fill(0, ["blocks", "ssr_bp"])


@query(f"WITH {_sequences()}, {_ssr()}, {_windows()}, {_blocks(False, 'ssrbase')} SELECT seq_id, start, len FROM blocks")
def repeat_minus_ssr(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = documents(spark, sf_dir)
    return masking.repeat_blocks(seqs, K, MIN_LEN, excluded=ssr.ssr_blocks(seqs))


@query()
def align_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_blocks(documents(spark, sf_dir), K, MIN_LEN)


# --- coordinates -----------------------------------------------------------------------

_OFFSETS = "placed AS (SELECT seq_id, length(seq)::BIGINT AS len, (sum(length(seq)) OVER (ORDER BY seq_id) - length(seq))::BIGINT AS \"offset\" FROM seqs)"


@query(f"WITH {_sequences()}, {_OFFSETS} SELECT * FROM placed")
def seq_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.offsets(documents(spark, sf_dir))


@query(
    f"""WITH {_sequences()}, {_OFFSETS}, asked AS (SELECT DISTINCT item_id * 104729 % (SELECT greatest(sum(len), 1) FROM placed) AS global_pos FROM benchmark)
SELECT global_pos::BIGINT AS global_pos, seq_id, (global_pos - "offset")::BIGINT AS pos FROM asked JOIN placed ON global_pos >= "offset" AND global_pos < "offset" + len"""
)
def locate_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = cut(coords.offsets(documents(spark, sf_dir)))
    total = placed.agg(F.greatest(F.sum("len"), F.lit(1)).alias("total"))
    asked = table(spark, sf_dir, "benchmark").crossJoin(F.broadcast(total))  # one row
    return coords.locate(asked.select((F.col("item_id") * 104729 % F.col("total")).alias("global_pos")).distinct(), placed)


@query(f"WITH {_sequences()}, {_windows()}, {_blocks(False)} SELECT seq_id, greatest(start, 100) AS start, least(start + len, 1000) - greatest(start, 100) AS len FROM blocks WHERE start < 1000 AND start + len > 100")
def slice_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.clipped(masking.repeat_blocks(documents(spark, sf_dir), K, MIN_LEN), 100, 1000)


# --- families and genomes --------------------------------------------------------------


def _families_sql(genome: str) -> str:
    """Families are the k-mers that stand at least twice in all; genomes the values of a column."""
    return f"""{_sequences(more=f", coalesce({genome}, '') AS genome")}, {_windows()},
pres AS (SELECT genome, ck AS family, count(*) AS members, count(*) * {K} AS bp FROM w JOIN seqs USING (seq_id) GROUP BY genome, ck),
fam AS (SELECT family, count(*) AS frequency, sum(members)::BIGINT AS total_members, sum(bp)::BIGINT AS total_bp,
  CASE WHEN count(*) = (SELECT count(DISTINCT genome) FROM seqs) THEN 'core' WHEN count(*) = 1 THEN 'unique' ELSE 'accessory' END AS category FROM pres GROUP BY family HAVING sum(members) > 1),
present AS (SELECT pres.* FROM pres JOIN fam USING (family))"""


def _families(spark: SparkSession, sf_dir: str, genome: str) -> tuple[DataFrame, list[str]]:
    """families (marked with their genomes, and how often they are in each), names of the genomes."""
    seqs = documents(spark, sf_dir, genome).withColumn("genome", F.coalesce(genome, F.lit("")))
    sizes = {r["genome"]: r["n"] for r in seqs.groupBy("genome").agg(F.sum(F.length("seq")).alias("n")).collect()}  # a row for each genome
    names = sorted(sizes)
    place = F.create_map(*[F.lit(x) for i, g in enumerate(names) for x in (g, i)])[F.col("genome")] if names else F.lit(0)
    counted = kmers.group_counts(seqs.select(place.alias("group"), "seq"), K, len(names), sum(sizes.values()))
    return families.from_lists(counted, names, K), names


def _letters(df: DataFrame) -> DataFrame:
    return df.withColumn("family", nt.kmer_letters(F.col("family"), K))


@query(f"WITH {_families_sql('lang')} SELECT genome, family, members, bp FROM present")
def family_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    fam, names = _families(spark, sf_dir, "lang")
    return _letters(families.listed(fam, names, K)).select("genome", "family", "members", "bp")


@query(f"WITH {_families_sql('lang')} SELECT * FROM fam")
def family_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(families.bare(_families(spark, sf_dir, "lang")[0]))


@query(f"WITH {_families_sql('lang')} SELECT category, count(*) AS families, sum(total_bp)::BIGINT AS bp FROM fam GROUP BY category")
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.category_totals(_families(spark, sf_dir, "lang")[0])


@query(f"WITH {_families_sql('source')}, g AS (SELECT count(DISTINCT genome) AS n FROM seqs) SELECT n AS genomes, ceil(n * 95 / 100.0)::BIGINT AS least_genomes, (SELECT count(*) FROM fam WHERE frequency >= ceil(n * 95 / 100.0)) AS families FROM g")
def soft_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    fam, names = _families(spark, sf_dir, "source")
    return families.soft_core(fam, len(names))


@query(f"WITH {_families_sql('source')} SELECT present_in, count(family) AS families, coalesce(sum(total_bp), 0)::BIGINT AS bp FROM (SELECT unnest(range(1, (SELECT count(DISTINCT genome) FROM seqs) + 1)) AS present_in) LEFT JOIN fam ON frequency = present_in GROUP BY present_in")
def frequency_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    fam, names = _families(spark, sf_dir, "source")
    return families.spectrum(fam, len(names))


@query(
    f"WITH {_families_sql('source')} SELECT genome, count(*) AS families, count(*) FILTER (category = 'core') AS core, count(*) FILTER (category = 'accessory') AS accessory, count(*) FILTER (category = 'unique') AS \"unique\", sum(bp)::BIGINT AS bp FROM present JOIN fam USING (family) GROUP BY genome"
)
def genome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fam, names = _families(spark, sf_dir, "source")
    return families.summed_by_genome(families.listed(fam, names, K))


@query(
    f"""WITH {_families_sql('source')}, names AS (SELECT DISTINCT genome FROM seqs), size AS (SELECT genome, count(family) AS n FROM names LEFT JOIN present USING (genome) GROUP BY genome),
shared AS (SELECT a.genome AS genome_i, b.genome AS genome_j, count(*) AS shared FROM present a JOIN present b USING (family) WHERE a.genome < b.genome GROUP BY 1, 2)
SELECT a.genome AS genome_i, b.genome AS genome_j, coalesce(shared, 0) AS shared, a.n + b.n - coalesce(shared, 0) AS union_size, CASE WHEN a.n + b.n - coalesce(shared, 0) = 0 THEN 0.0 ELSE round(coalesce(shared, 0)::DOUBLE / (a.n + b.n - coalesce(shared, 0)), 4) END::DOUBLE AS jaccard
FROM size a JOIN size b ON a.genome < b.genome LEFT JOIN shared s ON s.genome_i = a.genome AND s.genome_j = b.genome"""
)
def pairwise_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    fam, names = _families(spark, sf_dir, "source")
    return families.pairwise(fam, names)


@query(
    f"WITH {_families_sql('lang')} SELECT fam.*, wide.* EXCLUDE (family) FROM fam JOIN (SELECT family, "
    + ", ".join(f"coalesce(sum(members) FILTER (genome = '{g}'), 0)::BIGINT AS {g}" for g in ("de", "en", "es", "fr"))
    + " FROM present GROUP BY family) wide ON wide.family = fam.family"
)
def presence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    fam, names = _families(spark, sf_dir, "lang")
    return _letters(families.side_by_side(fam, names))


@query(f"WITH {_families_sql('lang')} SELECT genome, family, members, bp FROM present JOIN fam USING (family) WHERE category = 'unique'")
def unique_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    fam, names = _families(spark, sf_dir, "lang")
    return _letters(families.listed(fam.where("category = 'unique'"), names, K)).select("genome", "family", "members", "bp")


@query(f"WITH {_families_sql('lang')} SELECT family, total_members, total_bp FROM fam WHERE category = 'core'")
def core_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(_families(spark, sf_dir, "lang")[0].where("category = 'core'")).select("family", "total_members", "total_bp")


# --- clusters --------------------------------------------------------------------------

_BLOCKSEQ = "bseq AS (SELECT b.seq_id || ':' || b.start AS seq_id, b.seq_id AS record, b.start, b.len, substr(seq, (b.start + 1)::BIGINT, b.len::BIGINT) AS seq FROM blocks b JOIN seqs s ON s.seq_id = b.seq_id)"
_BLOCK_BASE = f"{_sequences()}, {_windows()}, {_blocks(False)}, {_BLOCKSEQ}"
_EDGES = f"""{_windows(name='bseq').replace('w AS', 'bw AS', 1)}, sets AS (SELECT DISTINCT seq_id, ck FROM bw), size AS (SELECT seq_id, count(*) AS n FROM sets GROUP BY seq_id),
pairs AS (SELECT a.seq_id AS seed, b.seq_id AS member, count(*) AS shared FROM sets a JOIN sets b USING (ck) JOIN bseq x ON x.seq_id = a.seq_id JOIN bseq y ON y.seq_id = b.seq_id WHERE (-x.len, x.record, x.start) < (-y.len, y.record, y.start) GROUP BY 1, 2),
edges AS (SELECT seed, member, shared, n AS distinct_kmers, round(shared::DOUBLE / n, 6) AS containment FROM pairs JOIN size ON size.seq_id = member WHERE round(shared::DOUBLE / n, 6) >= {clustering.LEAST_CONTAINMENT})"""


def _block_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = documents(spark, sf_dir)
    return cut(clustering.block_sequences(seqs, masking.repeat_blocks(seqs, K, MIN_LEN)))


@query(f"WITH {_BLOCK_BASE}, {_EDGES} SELECT * FROM edges")
def containment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.containment(_block_sequences(spark, sf_dir), K)


def _greedy(scope: str = "0") -> str:
    """taken: seq_id, seed; families: seed, cluster_id. A pass over blocks by falling length, which keeps the list of seeds."""
    return f"""ord AS MATERIALIZED (SELECT seq_id, {scope} AS scope, row_number() OVER (ORDER BY -len, record, start) AS rn FROM bseq),
lk AS MATERIALIZED (SELECT m.rn AS m, list(s.rn) AS ss FROM edges JOIN ord s ON s.seq_id = seed JOIN ord m ON m.seq_id = member GROUP BY m.rn),
step AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS seeds, 0::BIGINT AS got
  UNION ALL SELECT i + 1, CASE WHEN t IS NULL THEN list_append(seeds, i + 1) ELSE seeds END, coalesce(t, i + 1)
  FROM (SELECT i, seeds, list_min(list_intersect(ss, seeds)) AS t FROM step LEFT JOIN lk ON m = i + 1 WHERE i < (SELECT count(*) FROM ord))),
taken AS (SELECT m.seq_id, s.seq_id AS seed, s.rn, m.scope FROM step JOIN ord m ON m.rn = i JOIN ord s ON s.rn = got WHERE i > 0),
families AS (SELECT seed, dense_rank() OVER (PARTITION BY scope ORDER BY rn) + 2 AS cluster_id FROM (SELECT seed, rn, scope FROM taken GROUP BY seed, rn, scope HAVING count(*) > 1))"""


@query(f"WITH RECURSIVE {_BLOCK_BASE}, {_EDGES}, {_greedy()} SELECT record, start, len, seed, coalesce(cluster_id, 2)::BIGINT AS cluster_id FROM bseq JOIN taken USING (seq_id) LEFT JOIN families USING (seed)")
def containment_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _block_sequences(spark, sf_dir)
    got = clustering.numbered(blocks, clustering.clusters(blocks, clustering.containment(blocks, K)))
    return got.select("record", "start", "len", "seed", "cluster_id")


@query(f"WITH {_BLOCK_BASE} SELECT seq_id, kmer, count(*) AS n FROM (SELECT seq_id, substr(seq, unnest(range(1, greatest(length(seq) - 2, 1))), 4) AS kmer FROM bseq) WHERE regexp_matches(kmer, '^[acgt]{{4}}$') GROUP BY seq_id, kmer")
def profile_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.profiles(_block_sequences(spark, sf_dir))


@query(
    f"""WITH {_BLOCK_BASE}, {_EDGES}, prof AS (SELECT seq_id, kmer, count(*) AS n FROM (SELECT seq_id, substr(seq, unnest(range(1, greatest(length(seq) - 2, 1))), 4) AS kmer FROM bseq) WHERE regexp_matches(kmer, '^[acgt]{{4}}$') GROUP BY seq_id, kmer),
norm AS (SELECT seq_id, sqrt(sum(n * n)) AS norm FROM prof GROUP BY seq_id)
SELECT seed, member, round(coalesce((SELECT sum(a.n * b.n) FROM prof a JOIN prof b ON a.kmer = b.kmer WHERE a.seq_id = seed AND b.seq_id = member), 0) / (x.norm * y.norm), 6) AS cosine,
  round(coalesce((SELECT sum(a.n * b.n) FROM prof a JOIN prof b ON a.kmer = reverse(translate(b.kmer, 'acgt', 'tgca')) WHERE a.seq_id = seed AND b.seq_id = member), 0) / (x.norm * y.norm), 6) AS cosine_reverse
FROM edges JOIN norm x ON x.seq_id = seed JOIN norm y ON y.seq_id = member"""
)
def profile_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _block_sequences(spark, sf_dir)
    return clustering.cosines(clustering.containment(blocks, K), clustering.profiles(blocks))


@query(
    """WITH mean AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i),
part AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 4) AS cosine FROM part JOIN mean USING (label, i) GROUP BY vec_id"""
)
def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the mean of its label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    mean = vectors.groupBy("label", "i").agg(F.avg("x").alias("m"))
    met = vectors.join(mean, ["label", "i"]).groupBy("vec_id").agg(F.sum(F.col("x") * F.col("m")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("m") * F.col("m")).alias("b"))
    return met.select("vec_id", F.round(F.col("d") / (F.sqrt("a") * F.sqrt("b")), 4).alias("cosine"))


_WIDTHS = f"widths AS (SELECT unnest([{', '.join(map(str, clustering.WIDTHS))}]) AS width)"
_COMPOSITION = f"""{_WIDTHS}, quad AS (SELECT seq_id, p, substr(seq, (p + 1)::BIGINT, 4) AS w FROM (SELECT seq_id, seq, unnest(range(0, greatest(length(seq) - 3, 0))) AS p FROM bseq)),
good AS (SELECT * FROM quad WHERE regexp_full_match(w, '[acgt]{{4}}')),
mem AS (SELECT b.*, coalesce((SELECT max(width) FROM widths WHERE width <= b.len), {clustering.WIDTHS[0]}) AS width FROM bseq b),
prof AS (SELECT seq_id, w, count(*) AS n FROM good GROUP BY seq_id, w), norm AS (SELECT seq_id, sqrt(sum(n * n)) AS norm FROM prof GROUP BY seq_id),
spread AS (SELECT g.seq_id, width, p // (width // 4) + unnest([-3, -2, -1, 0]) AS j, w FROM good g, (SELECT DISTINCT width FROM mem)),
win AS (SELECT s.seq_id, width, j, w, count(*) AS n FROM spread s JOIN bseq b ON b.seq_id = s.seq_id WHERE j >= 0 AND j + 3 < greatest(length(seq) - 3, 0) // (width // 4) GROUP BY s.seq_id, width, j, w),
part AS (SELECT seq_id, width, j, w, n FROM win UNION ALL SELECT seq_id, 0, -1, w, n FROM prof), pnorm AS (SELECT seq_id, width, j, sqrt(sum(n * n)) AS norm FROM part GROUP BY ALL),
flip AS (SELECT seq_id, w, n, 'f' AS way FROM prof UNION ALL SELECT seq_id, reverse(translate(w, 'acgt', 'tgca')), n, 'r' FROM prof),
dots AS (SELECT a.seq_id AS seed, m.seq_id AS member, a.width, j, way, sum(a.n * f.n) AS d FROM part a JOIN flip f ON f.w = a.w JOIN mem m ON m.seq_id = f.seq_id AND a.width IN (0, m.width) JOIN bseq x ON x.seq_id = a.seq_id WHERE (-x.len, x.record, x.start) < (-m.len, m.record, m.start) GROUP BY ALL),
near AS (SELECT seed, member, round(coalesce(max(d / (p.norm * n.norm)) FILTER (way = 'f'), 0), 6) AS cosine, round(coalesce(max(d / (p.norm * n.norm)) FILTER (way = 'r'), 0), 6) AS cosine_reverse
  FROM dots JOIN pnorm p ON p.seq_id = seed AND p.width = dots.width AND p.j = dots.j JOIN norm n ON n.seq_id = member GROUP BY seed, member)"""


@query(f"WITH {_BLOCK_BASE}, {_COMPOSITION} SELECT seed, member, cosine, cosine_reverse FROM near WHERE greatest(cosine, cosine_reverse) >= 0.9")
def profile_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition against the best window of the member's scale, or the whole seed: all pairs that come near."""
    return clustering.composition(_block_sequences(spark, sf_dir), least=0.9)


@query()
def chance_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cosine chance gives windows of each scale; on a stated sample, so that there is no SQL."""
    return clustering.chance_floor(documents(spark, sf_dir))


@query()
def profile_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links are pairs whose composition, by windows, is closer than chance at the member's scale."""
    blocks = _block_sequences(spark, sf_dir)
    links = cut(clustering.with_strand(clustering.composition(blocks, clustering.chance_floor(documents(spark, sf_dir)))))
    got = clustering.numbered(blocks, clustering.clusters(blocks, links))
    strand = links.select("seed", F.col("member").alias("seq_id"), "strand")
    return got.join(strand, ["seed", "seq_id"], "left").select("record", "start", "len", "seed", "cluster_id", F.coalesce("strand", F.lit("+")).alias("strand"))


@query(
    f"""WITH {_BLOCK_BASE}, lib AS (SELECT item_id AS seq_id, {_DNA} AS seq FROM benchmark), {_windows(13, 'bseq').replace('w AS', 'bw AS', 1)}, {_windows(13, 'lib').replace('w AS', 'lw AS', 1)},
shared AS (SELECT a.seq_id, b.seq_id AS ref_id, count(DISTINCT a.ck) AS shared FROM bw a JOIN lw b USING (ck) GROUP BY 1, 2)
SELECT seq_id, ref_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY shared DESC, ref_id) AS r FROM shared) WHERE r = 1"""
)
def library_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), nt.from_text(F.col("text")).alias("seq"))
    return clustering.library_hits(_block_sequences(spark, sf_dir), library, 13)


# --- comparison and output -------------------------------------------------------------

_MASKPAIR = "hit AS (SELECT seq_id, unnest(range(start, start + len)) AS i FROM blocks), l AS (SELECT seq_id, unnest(range(0, length(seq))) AS i FROM seqs WHERE length(seq) > 0)"


@query(
    f"""WITH {_sequences()}, {_ssr()}, {_windows()}, {_blocks(False)}, {_MASKPAIR},
c AS (SELECT l.seq_id, count(*) AS compared, count(h.i) AS mask1, count(b.base) AS mask2, count(*) FILTER (h.i IS NOT NULL AND b.base IS NOT NULL) AS "both" FROM l LEFT JOIN hit h ON h.seq_id = l.seq_id AND h.i = l.i LEFT JOIN ssrbase b ON b.seq_id = l.seq_id AND b.base = l.i GROUP BY l.seq_id),
d AS (SELECT s.seq_id AS pair, coalesce(compared, 0) AS compared, coalesce(mask1, 0) AS mask1, coalesce(mask2, 0) AS mask2, coalesce("both", 0) AS "both", coalesce(mask1 - "both", 0) AS only1, coalesce(mask2 - "both", 0) AS only2, length(seq) AS len1, length(seq) AS len2 FROM seqs s LEFT JOIN c USING (seq_id))
SELECT *, """
    + ", ".join(
        f"CASE WHEN {w} = 0 THEN 0.0 ELSE round({p} * 100.0::DOUBLE / {w}, 4) END::DOUBLE AS {n}"
        for n, p, w in (("masked1_pct", "mask1", "len1"), ("masked2_pct", "mask2", "len2"), ("overlap_pct", '"both"', "greatest(mask1, mask2)"), ("both_pct", '"both"', "compared"), ("only1_pct", "only1", "mask1"), ("only2_pct", "only2", "mask2"))
    )
    + " FROM d"
)
def mask_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask of repeats against that of tandem repeats."""
    seqs = documents(spark, sf_dir)
    one = masking.soft_mask(seqs, masking.repeat_blocks(seqs, K, MIN_LEN)).select(F.col("seq_id").alias("pair"), F.col("seq").alias("seq1"))
    two = masking.soft_mask(seqs, ssr.ssr_blocks(seqs)).select(F.col("seq_id").alias("pair"), F.col("seq").alias("seq2"))
    return compare.compare_masks(one.join(two, "pair"))


_ELEMENTS = "el AS (SELECT seq_id, 'STR' AS type, 1 AS cluster_id, start, len FROM ssr UNION ALL SELECT seq_id, 'UCRP', 2, start, len FROM blocks)"


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = documents(spark, sf_dir)
    tandem = ssr.ssr_blocks(seqs)
    one = tandem.select("seq_id", F.lit("STR").alias("type"), F.lit(1).alias("cluster_id"), "start", "len")
    two = masking.repeat_blocks(seqs, K, MIN_LEN, excluded=tandem).select("seq_id", F.lit("UCRP").alias("type"), F.lit(2).alias("cluster_id"), "start", "len")
    return one.unionByName(two).withColumn("name", F.col("seq_id").cast("string")).withColumn("strand", F.lit("+"))


@query(f"WITH {_sequences()}, {_ssr()}, {_windows()}, {_blocks(False, 'ssrbase')}, {_ELEMENTS} SELECT seq_id::VARCHAR AS Seqid, type AS Repeat, cluster_id AS ClusterID, start + 1 AS Start, start + len AS Stop, len AS Length, '+' AS Strand, '' AS Phase FROM el")
def gff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.gff_rows(_elements(spark, sf_dir))


@query(
    f"""WITH {_sequences()}, {_ssr()}, {_windows()}, {_blocks(False, 'ssrbase')}, {_ELEMENTS}, {_OFFSETS}, tot AS (SELECT sum(len)::BIGINT AS n FROM placed), wide AS (SELECT n, least(greatest(floor(10 * sqrt(n)), 4000), 120000) AS w FROM tot),
pos AS (SELECT cluster_id, el.start + "offset" AS s, el.len AS m FROM el JOIN placed USING (seq_id))
SELECT cluster_id, (50 + round(s::DOUBLE * w / n))::BIGINT AS x, CASE cluster_id WHEN 1 THEN 90 ELSE 130 END::BIGINT AS y, greatest(1, round((s + m)::DOUBLE * w / n) - round(s::DOUBLE * w / n))::BIGINT AS w FROM pos, wide"""
)
def svg_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes of one picture of all documents behind each other."""
    placed = coords.offsets(documents(spark, sf_dir))
    n = placed.agg(F.sum("len")).head()[0] or 1
    moved = _elements(spark, sf_dir).join(placed.select("seq_id", "offset"), "seq_id").withColumn("start", F.col("start") + F.col("offset"))
    return sinks.picture(moved, n)
