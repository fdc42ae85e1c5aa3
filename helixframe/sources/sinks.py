"""Writers: annotation tables, masked sequences, reports, pictures.

A report is a file of lines: rows (report, line and what orders them) that Spark sorts and its executors write, so
that any number of reports is one job, and none passes the driver. It only names the files in the end. A raster
picture has a bounded number of strokes and is drawn on the driver.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nucleotide

COLUMNS = ("Seqid", "Repeat", "ClusterID", "Start", "Stop", "Length", "Strand", "Phase")
#: Rows of clusters that a picture shows at most.
PICTURE_ROWS = 500
COLOURS = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")
#: Dots per metre that a raster picture names: 1200 to the inch.
RESOLUTION = 47_244
#: Pixels across, at most, of a raster picture.
RASTER = 8000


def kind(cluster: Column, ref_id: Column, ref_name: Column) -> Column:
    """STR for cluster 1, UCRP for 2, else CRP or the library entry as id:name."""
    return F.when(cluster == 1, "STR").when(ref_id > 0, F.concat_ws(":", ref_id, ref_name)).when(cluster == 2, "UCRP").otherwise("CRP")


# --- reports ---------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_reports(out: str, suffix: str, lines: DataFrame, *order: str) -> None:
    """A file out/<report><suffix> for each report of lines(report, line), its lines in the order of the columns named."""
    spark = lines.sparkSession
    fs, top = _files(spark, out)
    fs.mkdirs(top)
    parts = f"{out.rstrip('/')}/_parts-{uuid.uuid4().hex}"
    # a report that is known not to be null keeps the order that it is written in
    named = lines.withColumn("report", F.coalesce(F.regexp_replace(F.col("report").cast("string"), "[/\\\\\\\\:]", "_"), F.lit("")))
    sorted_ = named.repartition("report").sortWithinPartitions("report", *order)
    sorted_.select("report", F.col("line").alias("value")).write.partitionBy("report").text(parts)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in fs.listStatus(path(parts)):
        name = folder.getPath().getName()
        if name.startswith("report="):
            for file in fs.listStatus(folder.getPath()):  # one, as each report is one task's
                to = path(f"{out.rstrip('/')}/{unquote(name.removeprefix('report='))}{suffix}")
                fs.delete(to, False)
                fs.rename(file.getPath(), to)
    fs.delete(path(parts), True)


def write_table(out: str, name: str, rows: DataFrame, *order: str) -> None:
    """A file out/name with a head and tab-separated rows."""
    head = rows.sparkSession.createDataFrame([("\t".join(rows.columns),)], "line string")
    body = rows.withColumn("line", F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]))
    at = [F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)]
    none = [F.lit(None).cast(body.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)]
    lines = head.select(F.lit(0).alias("_part"), *none, "line").unionByName(body.select(F.lit(1).alias("_part"), *at, "line"))
    write_reports(out, "", lines.withColumn("report", F.lit(name)), "_part", *[f"_o{i}" for i in range(len(order))])


def gff_rows(elements: DataFrame) -> DataFrame:
    """Seqid .. Phase of elements(name, type, cluster_id, start from 0, len, strand): places from 1, ends included."""
    return elements.select(
        F.col("name").alias("Seqid"), F.col("type").alias("Repeat"), F.col("cluster_id").alias("ClusterID"), (F.col("start") + 1).alias("Start"), (F.col("start") + F.col("len")).alias("Stop"),
        F.col("len").alias("Length"), F.when(F.col("cluster_id") <= 2, "+").otherwise(F.col("strand")).alias("Strand"), F.lit("").alias("Phase"),
    )


def gff_lines(elements: DataFrame, facts: DataFrame) -> DataFrame:
    """report, part, cluster_id, seq_id, start, line: tables of elements(report, seq_id, .., and perhaps Sequence).

    facts(report, heads): the lines above a table, without their number sign.
    """
    with_sequence = "Sequence" in elements.columns
    title = "\t".join(COLUMNS + (("Sequence",) if with_sequence else ()))
    above = F.concat(F.transform("heads", lambda h: F.concat(F.lit("#"), h)), F.array(F.lit(""), F.lit(title)))
    nothing = [F.lit(None).cast(elements.schema[c].dataType).alias(c) for c in ("cluster_id", "seq_id", "start")]
    head = facts.select("report", F.posexplode(above).alias("part", "line")).select("report", "part", *nothing, "line")
    cells = [*COLUMNS, *(["Sequence"] if with_sequence else [])]
    flat = elements.withColumns(
        {
            "Seqid": F.col("name"), "Repeat": F.col("type"), "ClusterID": F.col("cluster_id"), "Start": F.col("start") + 1, "Stop": F.col("start") + F.col("len"), "Length": F.col("len"),
            "Strand": F.when(F.col("cluster_id") <= 2, "+").otherwise(F.col("strand")), "Phase": F.lit(""),
        }
    )
    rows = flat.select("report", F.lit(1 << 30).alias("part"), "cluster_id", "seq_id", F.col("start"), F.concat_ws("\t", *[F.col(c).cast("string") for c in cells]).alias("line"))
    return head.unionByName(rows)


def flanked(start: Column, length: Column, seq: Column, strand: Column, flank: int) -> Column:
    """A block's letters between capitals of its flanks, turned round on the minus strand."""
    before = F.upper(F.substr(seq, (F.greatest(start - flank, F.lit(0)) + 1).cast("int"), F.least(start, F.lit(flank)).cast("int")))
    after = F.upper(F.substr(seq, (start + length + 1).cast("int"), F.lit(flank)))
    whole = F.concat(before, F.substr(seq, (start + 1).cast("int"), length.cast("int")), after)
    return F.when(strand == "-", nucleotide.reverse_complement_keep_case(whole)).otherwise(whole)


def fasta_text(name: Column, seq: Column, width: int = 70) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), nucleotide.wrapped(seq, width))


def mask_label(name: Column, masked: Column, joint: bool = False) -> Column:
    """Head of a masked record: its name and the share of it that is masked, or in a joint run the word mask alone."""
    share = F.format_number(nucleotide.percent(nucleotide.count_of(masked, "a-z"), F.length(masked)), 2)
    return F.concat_ws(" ", name, F.lit("mask")) if joint else F.concat_ws(" ", name, F.concat(share, F.lit("%")))


def write_fasta(path: str, seqs: DataFrame, label: Column) -> None:
    """One text file for each partition: label and seq."""
    seqs.select(fasta_text(label, F.col("seq")).alias("value")).write.mode("overwrite").text(path)


def write_fasta_files(path: str, seqs: DataFrame) -> None:
    """A folder name=... for each record's name."""
    seqs.select("name", fasta_text(F.col("name"), F.col("seq")).alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def region_rows(blocks: DataFrame, seqs: DataFrame, least: int) -> DataFrame:
    """seq_id, label (start-end from 1, ends included), bases of blocks longer than least."""
    got = blocks.where(F.col("len") > least).join(seqs.select("seq_id", "seq"), "seq_id")
    label = F.concat_ws("-", F.col("start") + 1, F.col("start") + F.col("len"))
    return got.select("seq_id", "start", label.alias("label"), F.substr("seq", (F.col("start") + 1).cast("int"), F.col("len").cast("int")).alias("bases"))


def record_rows(seqs: DataFrame) -> DataFrame:
    """seq_id, name, len, lower, lower_pct of records."""
    lower = nucleotide.count_of(F.col("seq"), "a-z")
    return seqs.select("seq_id", "name", F.length("seq").cast("long").alias("len"), lower.alias("lower"), nucleotide.percent(lower, F.length("seq")).alias("lower_pct"))


# --- pictures --------------------------------------------------------------------------


def _wide(n_bases: Column, scale: int, width: int) -> Column:
    return F.lit(width) if width else F.least(F.greatest(F.floor(scale * F.sqrt(n_bases)), F.lit(4000)), F.lit(120_000))


def picture(elements: DataFrame, n_bases: int | str, scale: int = 10, width: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """by, cluster_id, x, y, w: the strokes of a picture (of each `by`) of elements(cluster_id, start, len) on n_bases, a number or a column's name.

    Widths from 4,000 to 120,000, a margin of 50, and rows at 90, 130 and from 180 on are fixed values of the format.
    """
    n = F.greatest(F.col(n_bases) if isinstance(n_bases, str) else F.lit(n_bases), F.lit(1))
    w = _wide(n, scale, width)
    top = elements.groupBy(*by).agg(F.max("cluster_id").alias("_rows"))
    shown = elements.where(F.col("cluster_id") <= PICTURE_ROWS)
    shown = shown.join(top, list(by)) if by else shown.crossJoin(F.broadcast(top))  # one row, or one for each picture
    step = nucleotide.svg_step(F.col("_rows"))
    y = F.when(F.col("cluster_id") == 1, 90).when(F.col("cluster_id") == 2, 130).otherwise(F.lit(180) + (F.col("cluster_id") - 3) * step)
    x = lambda p: F.lit(50) + F.round(p * w / n)
    return shown.select(*by, "cluster_id", x(F.col("start")).cast("long").alias("x"), y.cast("long").alias("y"), F.greatest(F.lit(1), x(F.col("start") + F.col("len")) - x(F.col("start"))).cast("long").alias("w"))


def svg_lines(elements: DataFrame, facts: DataFrame, scale: int = 10, width: int = 0, height: int = 0, borders: DataFrame | None = None) -> DataFrame:
    """report, part, x, line: pictures of elements(report, cluster_id, start, len) with facts(report, title, n).

    borders(report, name, at): where records begin. Strokes that can't be told apart are one.
    """
    strokes = picture(elements.join(facts.select("report", F.col("n").alias("_n")), "report"), "_n", scale, width, ("report",)).distinct()
    size = strokes.groupBy("report").agg(F.max("y").alias("_y"), F.max("cluster_id").alias("_rows"))
    one = facts.join(size, "report", "left").withColumn("_wide", _wide(F.greatest("n", F.lit(1)), scale, width).cast("long"))
    tall = F.lit(height) if height else F.greatest(F.lit(300), F.coalesce("_y", F.lit(180)) + 40)
    thick = F.floor(F.greatest(F.lit(12), F.lit(20) - F.least(F.coalesce("_rows", F.lit(2)), F.lit(PICTURE_ROWS)) / 100)).cast("long")
    one = one.withColumn("_tall", tall.cast("long")).withColumn("_thick", thick)
    text = F.format_string
    head = [
        text('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d">', F.col("_wide") + 100, "_tall"), F.lit('<rect width="100%" height="100%" fill="white"/>'),
        text('<text x="50" y="30" font-size="20">%s (%s bp)</text>', nucleotide.escaped(F.col("title")), nucleotide.thousands(F.col("n"))), text('<line x1="50" y1="50" x2="%d" y2="50" stroke="black"/>', F.col("_wide") + 50),
    ]
    for i in range(11):
        x = (F.lit(50) + F.floor(F.col("_wide") * i / 10)).cast("long")
        head.append(text('<line x1="%d" y1="45" x2="%d" y2="55" stroke="black"/><text x="%d" y="70" font-size="12">%s</text>', x, x, x, nucleotide.thousands(F.floor(F.col("n") * i / 10))))
    no_x = F.lit(None).cast("long").alias("x")
    top = one.select("report", F.posexplode(F.array(*head)).alias("part", "line")).select("report", "part", no_x, "line")
    end = one.select("report", F.lit(1 << 30).alias("part"), no_x, F.lit("</svg>").alias("line"))
    colour = F.element_at(F.array(*[F.lit(c) for c in COLOURS]), (F.col("cluster_id") % len(COLOURS) + 1).cast("int"))
    drawn = strokes.join(one.select("report", "_thick"), "report")
    line = text('<line x1="%d" y1="%d" x2="%d" y2="%d" stroke="%s" stroke-width="%d"/>', "x", "y", F.col("x") + F.col("w"), "y", colour, "_thick")
    drawn = drawn.select("report", (F.col("cluster_id") + 1000).cast("int").alias("part"), "x", line.alias("line"))
    got = top.unionByName(end).unionByName(drawn)
    if borders is not None:
        place = (F.lit(50) + F.round(F.col("at") * F.col("_wide") / F.greatest("n", F.lit(1)))).cast("long")
        marks = borders.join(one, "report").withColumn("x", place)
        line = text('<line x1="%d" y1="45" x2="%d" y2="%d" stroke="#cccccc"/><text x="%d" y="42" font-size="12">%s</text>', "x", "x", "_tall", F.col("x") + 4, nucleotide.escaped(F.col("name")))
        got = got.unionByName(marks.select("report", F.lit(900).alias("part"), "x", line.alias("line")))
    return got


def write_png(path: str, elements: DataFrame, n_bases: int, scale: int = 10, width: int = 0, height: int = 0) -> None:
    """The strokes of one picture as pixels, at most RASTER across: as many as can be told apart, by so many rows."""
    spark = elements.sparkSession
    wide = (width or min(max(int(scale * math.sqrt(n_bases)), 4000), 120_000)) + 100
    shrink = max(1, -(-wide // RASTER))
    seen = picture(elements, n_bases, scale, width).groupBy("cluster_id", "y", F.floor(F.col("x") / shrink).alias("x")).agg(F.max(F.floor((F.col("x") + F.col("w")) / shrink)).alias("to"))
    strokes = seen.orderBy("cluster_id", "x").collect()  # at most RASTER of each of PICTURE_ROWS
    tall = height or max(300, max((s["y"] for s in strokes), default=180) + 40)
    thick = int(max(12, 20 - min(max((s["cluster_id"] for s in strokes), default=2), PICTURE_ROWS) / 100))
    w, h = wide // shrink + 1, tall // shrink + 1
    image = [bytearray(b"\xff" * (3 * w)) for _ in range(h)]
    for s in strokes:
        colour = bytes.fromhex(COLOURS[s["cluster_id"] % len(COLOURS)][1:])
        a, b = s["x"], min(w, s["to"] + 1)
        for y in range(max(0, (s["y"] - thick // 2) // shrink), min(h, (s["y"] + thick // 2) // shrink + 1)):
            image[y][3 * a : 3 * b] = colour * (b - a)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    dots = struct.pack(">IIB", RESOLUTION // shrink, RESOLUTION // shrink, 1)
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"pHYs", dots) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in image))) + chunk(b"IEND", b"")
    fs, where = _files(spark, path)
    stream = fs.create(where, True)
    stream.write(bytearray(data))
    stream.close()
