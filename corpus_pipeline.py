"""From raw documents to packed sequences: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read again before
the next one. All but the last have the columns of docs, in their order and of whatever name.

Every stage reads whole texts of any length, takes a null in any column for a value (a null text for an
empty one), and of an empty table makes an empty one. What ties and repeated rows give is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import common, mixing, neardup, packing, pii, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the thresholds of their language and source keep.

    A null or empty text has no words, and goes. Null languages and sources form groups of their own. Each of
    repeated rows is judged, all alike.
    """
    common.send_package(spark)
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near-duplicates.

    Texts without words, null or empty, are copies of each other. A null id stands for a hash of the text. Of
    rows with equal ids the one of least text stays, by the other columns where texts are equal.
    """
    common.send_package(spark)
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with personal data replaced by its kind, and n_chars of the new text.

    A row without such data stays as it is, a null text null. Of overlapping spans the first counts. Repeated
    rows are changed alike.
    """
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them.

    A text without words, null or empty, has size 0, and is taken as often as its source's others on average; a
    source of such texts alone is not taken. Null sources are one source. Equal rows share what is taken of them.
    """
    common.send_package(spark)
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, of the columns that packing.pack_documents() names.

    A null or empty text has just the closing id. Of ties and repeated rows each is packed, and which lies
    where is undefined, as they can't be told apart.
    """
    common.send_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL has no Order MinHash, cube method or tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = common.shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    common.remove(spark, folder)  # packing has checkpointed its pieces
    return docs
