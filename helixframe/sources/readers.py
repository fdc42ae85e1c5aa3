"""Readers of sequence text: FASTA, annotation tables, lists of pairs.

Lines come from Spark's text reader with their place in the file, so that a file is cut into records
by a running count of header lines. Files are taken in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nucleotide

GFF_SCHEMA = "seqid string, type string, cluster_id int, start long, stop long, len long, strand string, phase string, sequence string"


def split_records(lines: DataFrame, order: str, letters: Column, header: Column | None = None, by: str = "file", block: str | None = None) -> DataFrame:
    """by, rec_no (from 1), header, name (up to the first blank), seq: lines(by, order, line) cut at headers.

    Letters before the first header are dropped; text without any header is record 0 with an empty name.
    block tells pieces of a file apart, in their order; headers are then counted in each piece and
    summed over pieces, so that no task meets all lines of a large file.
    """
    marked = lines.withColumn("_block", F.lit(0) if block is None else F.col(block)).withColumn("_head", (header if header is not None else F.col("line").startswith(">")).cast("long"))
    heads = marked.groupBy(by, "_block").agg(F.sum("_head").alias("_heads"))
    whole = Window.partitionBy(by)
    before = F.coalesce(F.sum("_heads").over(whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(by, "_block", before.alias("_before"), F.sum("_heads").over(whole).alias("_any"))
    inside = Window.partitionBy(by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_own", F.sum("_head").over(inside)).join(heads, [by, "_block"])
    marked = marked.withColumn("rec_no", F.col("_before") + F.col("_own")).where("rec_no > 0 or _any = 0")
    part = F.when(F.col("_head") == 1, F.lit("")).otherwise(letters)
    got = marked.groupBy(by, "rec_no").agg(F.max(F.when(F.col("_head") == 1, F.trim(F.regexp_replace("line", "^[^>]*>", "")))).alias("header"), F.array_sort(F.collect_list(F.struct(F.col("_block"), F.col(order).alias("at"), part.alias("part")))).alias("_parts"))
    seq = F.array_join(F.transform("_parts", lambda x: x["part"]), "")
    return got.select(by, "rec_no", F.coalesce("header", F.lit("")).alias("header"), F.regexp_extract(F.coalesce("header", F.lit("")), r"^(\S*)", 1).alias("name"), seq.alias("seq"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where the piece of the file begins), at (rises along a piece), line; large files are read in pieces."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def _numbered(records: DataFrame, lines: DataFrame) -> DataFrame:
    """records with seq_id, by the order of file names and records: files are summed up, one row for each, not records."""
    each = lines.groupBy("file").agg(F.greatest(F.sum(F.col("line").startswith(">").cast("long")), F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select("file", F.coalesce(before, F.lit(0)).alias("_before"))
    return records.join(each, "file").withColumn("seq_id", (F.col("_before") + F.greatest(F.col("rec_no") - 1, F.lit(0))).cast("long"))


def _records(lines: DataFrame, keep_case: bool, whole_names: bool, block: str | None) -> DataFrame:
    letters = nucleotide.clean_keep_case(F.col("line")) if keep_case else nucleotide.clean(F.col("line"))
    got = _numbered(split_records(lines, "at", letters, block=block), lines)
    name = F.col("header") if whole_names else F.col("name")
    return got.select("seq_id", "file", "rec_no", name.alias("name"), "seq", F.length("seq").cast("long").alias("len"))


def read_fasta(spark: SparkSession, path: str, keep_case: bool = False, whole_names: bool = False) -> DataFrame:
    """seq_id (by file name and record), file, rec_no, name, seq, len. A folder is read whole, whatever its files are called."""
    return _records(_lines(spark, path).where("line <> ''"), keep_case, whole_names, "block")


def read_library(spark: SparkSession, paths: list[str]) -> DataFrame:
    """ref_id (from 1), ref_name (whole header), seq: the libraries one after another. Missing files are none."""
    got = None
    n = 0
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            continue
        one = library(read_fasta(spark, path, whole_names=True)).withColumn("ref_id", F.col("ref_id") + n)
        n += one.count()  # ids go on from one library to the next, without a window over their sequences
        got = one if got is None else got.unionByName(one)
    return spark.createDataFrame([], "ref_id long, ref_name string, seq string") if got is None else got


def library(records: DataFrame) -> DataFrame:
    """ref_id (from 1), ref_name, seq of records(seq_id from 0, name, seq)."""
    return records.select((F.col("seq_id") + 1).alias("ref_id"), F.col("name").alias("ref_name"), "seq")


def from_strings(spark: SparkSession, texts: list[str], keep_case: bool = False) -> DataFrame:
    """As read_fasta(), from text in memory: each element is a file."""
    rows = [(f"{i:09d}", n, line) for i, t in enumerate(texts) for n, line in enumerate(t.splitlines()) if line]
    return _records(spark.createDataFrame(rows, "file string, at int, line string"), keep_case, False, None)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """seqid, type, cluster_id, start (from 0), len, strand, file, block, at: the rows of an annotation table with seven fields at least."""
    return annotations(_lines(spark, path))


def annotations(lines: DataFrame) -> DataFrame:
    """The same of lines(file, block, at, line)."""
    d = F.split("line", "\t")
    rows = lines.where(~F.col("line").startswith("#") & ~F.col("line").startswith("Seqid") & (F.size(d) >= 7))
    field = lambda i: F.trim(d[i])
    return rows.select(
        d[0].alias("seqid"), d[1].alias("type"), field(2).try_cast("int").alias("cluster_id"), (field(3).try_cast("long") - 1).alias("start"), field(5).try_cast("long").alias("len"), field(6).alias("strand"), "file", "block", "at"
    ).where("cluster_id is not null and start is not null and len is not null")


def annotated_lengths(spark: SparkSession, path: str) -> DataFrame:
    """file, n: the length that the head of each annotation table tells, with or without a number sign."""
    told = F.regexp_extract("line", r"^#?Sequence length \(bp\)=\s*(\d+)", 1).try_cast("long")
    return _lines(spark, path).select("file", "block", "at", told.alias("n")).where("n is not null").groupBy("file").agg(F.min_by("n", F.struct("block", "at")).alias("n"))


def annotated_length(spark: SparkSession, path: str) -> int:
    """The same of one table; 0 if it tells none."""
    row = annotated_lengths(spark, path).limit(1).collect()
    return row[0]["n"] if row else 0


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """pair, file1, file2: names beside each other, apart by blanks or tabs."""
    return pairs(_lines(spark, path).withColumn("pair", F.col("block") * (1 << 33) + F.col("at")))


def pairs(lines: DataFrame) -> DataFrame:
    """The same of lines(pair, line)."""
    d = F.split(F.regexp_replace("line", "^[\t ]+|[\t ]+$", ""), "[\t ]+")
    return lines.where(F.size(d) >= 2).select("pair", d[0].alias("file1"), d[1].alias("file2"))
