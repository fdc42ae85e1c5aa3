"""Packing token sequences by shortest-pack-first over the length histogram.

Each document's tokens, closed by END_ID, are cut into pieces of the full length and one shorter
rest; full pieces are sequences of their own. The rests meet only in a histogram of their lengths,
of at most `size` entries. From the longest length down, its rests are put into the pack with the
most room that still takes them; packs of equal content are one pattern with a count, so the work
depends on the number of lengths, not of documents. A pack that ends at a power of two needs no
padding. The patterns are joined back by rank: the r-th rest of a length takes the r-th place that
the patterns have for it.

Ranks come from salted groups: rests of one length are dealt over hash buckets, numbered inside
each, and shifted by the counts of the buckets before.

Defined results: null or empty text has just END_ID; a null doc_id is a value like others; texts of any
length are read whole; equal rows are packed as often as they stand
there (they are interchangeable, so it is undefined which copy lies where); an empty table gives an
empty result. Only doc_id and text are read, so that other columns of whatever name don't matter.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SIZE = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k"
#: How that tokenizer splits a text before it merges bytes (a fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_tokenizers: dict[str, tuple] = {}
_exact: dict[str, bool] = {}


def tokenizer(name: str):
    """(encode, reference): text to an array of ids, fast; and the tokenizers library's own tokenizer.

    The file name.tiktoken has the vocabulary of name.json as merge ranks, for an encoder that takes
    a fifth of the time. Its regular expressions fail on very long runs of white space; such texts are
    left to the reference. is_exact() tells whether the two give the same ids for every text.
    """
    if name not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        reference = Tokenizer.from_file(common.tokenizer_file(f"{name}.json"))
        fast = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=_ranks(name), special_tokens={token.content: i for i, token in reference.get_added_tokens_decoder().items()})

        def encode(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its stack for backtracking is full
                return np.array(reference.encode(text, add_special_tokens=False).ids, np.uint32)

        _tokenizers[name] = encode, reference
    return _tokenizers[name]


def _ranks(name: str) -> dict[bytes, int]:
    with open(common.tokenizer_file(f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def same_merges(name: str) -> bool:
    """Whether merging by rank, as the fast encoder does, must give what the tokenizer's list of merges gives.

    It must if each merge makes a token of its own, whose rank rises along the list: then both apply merges in
    one order, and when a merge's turn comes, a run of bytes that it could make has been read from left to right
    by all lesser ones alone, which leaves just the two parts that the list names.
    """
    with open(common.tokenizer_file(f"{name}.json"), "rb") as f:
        model = json.load(f)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = _ranks(name)
    own = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
    if any(own.get(token) != i for token, i in ranks.items()):
        return False
    made = []
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        if not max(model["vocab"][a], model["vocab"][b]) < model["vocab"][a + b] or len(a + b) < 2:
            return False
        made.append(model["vocab"][a + b])
    return made == sorted(set(made)) and len(made) + 256 == len(ranks)


#: Characters that are tried together, and those that are tried: all that are assigned to letters, digits, spaces or signs.
TRIED = 512
_TRIED = (*range(0, 0x32000, TRIED), *range(0xE0000, 0xE0200, TRIED))


def cut_alike(name: str, first: int) -> bool:
    """Whether both encoders give the same ids for texts with each of the characters from first on between others."""
    encode, reference = tokenizer(name)
    text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}\n" for c in range(first, first + TRIED) if not 0xD800 <= c < 0xE000)
    return encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def is_exact(spark: SparkSession, name: str) -> bool:
    """Whether the fast encoder gives the reference's ids for every text: equal merges, and texts are cut alike at every character.

    Where a text is cut depends on what kind of letter, digit, space or other sign each character is, so that each is
    tried between them. Tasks do so, once in a session; the driver holds no tokenizer. Without it all texts are left to the reference.
    """
    if name not in _exact:
        first = F.element_at(F.array(*[F.lit(c) for c in _TRIED]), (F.col("id") + 1).cast("int"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([cut_alike(name, c) and (c > 0 or same_merges(name)) for c in batch.column(0).to_pylist()], pa.bool_())], names=["same"])

        tried = spark.range(0, len(_TRIED), 1, min(16, spark.sparkContext.defaultParallelism)).select(first.alias("first")).mapInArrow(run, "same boolean")
        _exact[name] = bool(tried.agg(F.min("same")).head()[0])
    return _exact[name]


def pieces(docs: DataFrame, size: int = SIZE, name: str = TOKENIZER) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's tokens in pieces of at most `size`."""
    fast = is_exact(docs.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, reference = tokenizer(name)
        if not fast:
            encode = lambda text: np.array(reference.encode(text, add_special_tokens=False).ids, np.uint32)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 500):
                rows: list[tuple[int, int, int, int, int]] = []
                for i in range(at, min(at + 500, len(texts))):
                    tokens = np.append(encode(texts[i].as_py() or "").astype("<u4"), np.uint32(END_ID))
                    rows += [(i, s, min(size, len(tokens) - s), zlib.crc32(tokens[s : s + size].tobytes()), len(tokens)) for s in range(0, len(tokens), size)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0])), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths of the pattern) for a histogram {length: count}."""
    by_room: dict[int, list[list]] = defaultdict(list)  # room left: [count, lengths]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in by_room.items() if r >= length and packs), default=0)
            if not room:
                each = size // length  # only new packs: as many as fill whole ones
                room_after = size - length
                by_room[room_after].append([left, (length,)])
                if room_after >= length and left > 1:  # refill these packs from the same length
                    packs, rest = divmod(left, each)
                    by_room[room_after].pop()
                    if packs:
                        by_room[size - each * length].append([packs, (length,) * each])
                    if rest:
                        by_room[size - rest * length].append([1, (length,) * rest])
                left = 0
                continue
            pack = by_room[room].pop()
            used = min(pack[0], left)
            if pack[0] > used:
                by_room[room].append([pack[0] - used, pack[1]])
            by_room[room - length].append([used, (*pack[1], length)])
            left -= used
    return [(count, lengths) for room in sorted(by_room) for count, lengths in by_room[room]]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): the r-th rest of a length lies in sequence first + r - rank."""
    out, rank, sequence = [], defaultdict(int), 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            out.append((length, rank[length], rank[length] + count - 1, sequence, offset))
            rank[length] += count
            offset += length
        sequence += count
    return out


def numbered(df: DataFrame, by: str, order: list[str], n_rows: int, name: str) -> DataFrame:
    """df with the rank from 0 of each row among those of equal `by`, through salted groups."""
    buckets = common.rows_per_task(n_rows, 64)
    salted = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = salted.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(by, "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    local = salted.withColumn("_at", F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)) - 1)
    return local.join(before, [by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_at")).drop("_before", "_at", "_bucket")


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """cut (of pieces()) with sequence_id and offset."""
    spark = cut.sparkSession
    cut = common.cut(cut)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    patterns = shortest_pack_first(histogram, size)
    rows = places(patterns)
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    ranked = numbered(cut, "length", order, sum(histogram.values()), "_rank")
    # Long lengths have few patterns; a length's ranges of ranks are found by bins, so that the join stays an equi-join.
    step = max(1, sum(histogram.values()) // 4096)
    spread = [(length, b, first, last, seq, off) for length, first, last, seq, off in rows for b in range(first // step, last // step + 1)]
    table = spark.createDataFrame(spread or [(0, 0, 0, 0, 0, 0)], "length long, _bin long, _first long, _last long, _sequence long, offset long")
    ranked = ranked.withColumn("_bin", F.floor(F.col("_rank") / step))
    # The table has a row for each place of a pattern and 4096 bins more at most: some 2,000 patterns, whatever the number of documents.
    if len(spread) <= 100_000:
        table = F.broadcast(table)
    got = ranked.join(table, ["length", "_bin"]).where("_rank between _first and _last")
    return got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, size: int = SIZE, name: str = TOKENIZER) -> DataFrame:
    return pack(pieces(docs, size, name), size)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
