"""Repeat blocks of sequences that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import masking
from ..runtime import send_package
from ..sources import readers


def watch_fasta(spark: SparkSession, folder: str, out: str, state: str, k: int = 19, min_len: int = 80) -> StreamingQuery:
    """Each new file of the folder is cut into records, and their blocks are appended to the table at out, by batch.

    A batch that is done again after a failure replaces what it wrote, as its number names the part.
    """
    send_package(spark)
    files = spark.readStream.schema("value string").text(folder, wholetext=True).selectExpr("value", "_metadata.file_name AS file")

    def one(batch: DataFrame, number: int) -> None:
        lines = batch.selectExpr("file", "posexplode(split(value, '\\r\\n|\\r|\\n')) AS (at, line)").where("line <> ''")
        from ..functions import nucleotide
        from pyspark.sql import functions as F

        records = readers.split_records(lines, "at", nucleotide.clean(F.col("line")))
        seqs = records.select(F.concat_ws("#", "file", "rec_no").alias("seq_id"), "seq")
        masking.repeat_blocks(seqs, k, min_len).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", state).start()
