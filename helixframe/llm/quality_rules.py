"""Quality rules with adaptive thresholds.

Every text yields counts. Each rate made of them is put into a quantile sketch per language and
source: a histogram whose bins keep SKETCH_BITS leading bits, so that counts of equal bins add up
in any order and a quantile is known to 1 part in 2 ** (SKETCH_BITS - 1). A text is rejected where
one of its rates is far above what its language and source have: above the median plus SPREADS
times the distance between the median and the lower quartile, plus the rule's slack. Both quantiles lie
below the median, so that a source may be junk by half and still be told what is usual. As a rate
of a short text is a coarse figure, so many hits must be there as well. Where half of a group's texts and
more have a rate of 0, the slack alone is the limit. Groups of fewer than MIN_GROUP texts use the
merged sketch of their language, and languages of so few the one of all texts. Fixed base rules come first.

Defined results: null text counts as empty (no words, base_failed); null language or source form
a group of their own; texts of any length are counted whole; repeated rows each get a row; an empty table
gives an empty result. quality_rules() has the columns it lists; filter_documents() gives all columns of
docs back, of whatever name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SKETCH_BITS = 6
SPREADS = 10
#: Percents of the lower quantile and the middle.
LOWER, MIDDLE = 25, 50
MIN_GROUP = 100
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

#: Rate in thousandths: (numerator, denominator, slack, least numerator).
RULES: dict[str, tuple[str, str, int, int]] = {
    "symbols": ("n_symbols", "n_words", 40, 4),
    "capitals": ("n_capitals", "word_chars", 40, 8),
    "marks": ("n_marks", "n_words", 40, 4),
    "dup_lines": ("n_dup_lines", "n_lines", 250, 4),
    "same_words": ("n_same_words", "n_words", 40, 4),
    "repeat_words": ("n_repeat_words", "n_words", 150, 32),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_same_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?~^=_\\{}[]")] = True


def repeated(block: common.Block, words: np.ndarray) -> np.ndarray:
    """Of each word, whether it is in a window of WINDOW words found twice or more in its text."""
    if len(words) < WINDOW:
        return np.zeros(len(words), bool)
    hashes = common.window_hash(words, WINDOW)
    at = np.flatnonzero(block.doc[: len(hashes)] == block.doc[WINDOW - 1 :])
    keys = hashes[at] ^ common.mix(block.doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    hit = at[twice]
    edge[hit] += 1
    edge[hit + WINDOW] -= 1
    return np.cumsum(edge)[:-1] > 0


def lines(block: common.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the lines with a word."""
    data = block.data
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, block.offsets[:-1])
    cuts = cuts[cuts < len(data)]
    stops = np.append(cuts[1:], len(data)) if len(cuts) else cuts
    if len(cuts):
        stops = stops - ((stops > cuts) & (data[stops - 1] == 10))
        filled = np.searchsorted(block.starts, stops) > np.searchsorted(block.starts, cuts)
        cuts, stops = cuts[filled], stops[filled]
    return cuts, stops, np.searchsorted(block.offsets, cuts, "right") - 1


def seen_before(block: common.Block, cuts: np.ndarray, stops: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Of each line, whether it equals an earlier one of its text."""
    keys = block.span_hash(cuts, stops) ^ common.mix(owner.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(keys, return_index=True)
    again = np.ones(len(cuts), bool)
    again[first] = False
    return again


def text_counts(block: common.Block) -> dict[str, np.ndarray]:
    """The counts of each text in a block."""
    data, n_docs = block.data, len(block.offsets) - 1
    words = block.words()
    out = {"n_words": np.diff(block.first)}
    lead = (data & 0xC0) != 0x80
    out["word_chars"] = block.count(lead & ~common._SPACE[data])
    out["n_symbols"] = block.count(_SYMBOL[data])
    out["n_marks"] = block.count(_MARK[data])
    capital = (data >= 65) & (data <= 90)
    if len(data) > 1:  # capitals of Latin-1: C3 80 .. C3 9E but for the times sign
        capital[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out["n_capitals"] = block.count(capital)

    out["n_repeat_words"] = np.bincount(block.doc[repeated(block, words)], minlength=n_docs)

    again = np.zeros(len(words), bool)
    if len(words) > 1:
        again[1:] = (words[1:] == words[:-1]) & (block.doc[1:] == block.doc[:-1])
    out["n_same_words"] = np.bincount(block.doc[again], minlength=n_docs)

    cuts, stops, owner = lines(block)
    out["n_lines"] = np.bincount(owner, minlength=n_docs)
    out["n_dup_lines"] = np.bincount(owner[seen_before(block, cuts, stops, owner)], minlength=n_docs)
    return out


def count_texts(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns in carry, and the counts of text."""
    frame = docs.select(*dict.fromkeys([*carry, "text"]))
    schema = frame.select(*carry).schema
    for name in COUNTS:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [text_counts(b) for _, _, b in common.blocks(batch.column("text"))]
            arrays = [batch.column(c) for c in carry]
            for name in COUNTS:
                values = np.concatenate([p[name] for p in parts]) if parts else np.zeros(0)
                arrays.append(pa.array(values.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, *COUNTS])

    return frame.mapInArrow(run, schema)


def rate(rule: str) -> Column:
    over, under, *_ = RULES[rule]
    return F.when(F.col(under) > 0, F.floor(F.lit(1000) * F.col(over) / F.col(under))).otherwise(F.lit(0)).cast("long")


def bin_floor(value: Column) -> Column:
    """The least value in the sketch's bin of a value: its leading SKETCH_BITS bits."""
    drop = F.greatest(F.lit(0), F.length(F.bin(value)) - SKETCH_BITS)
    step = F.pow(F.lit(2), drop).cast("long")
    return (value - value % step).cast("long")


def thresholds(counts: DataFrame) -> DataFrame:
    """lang, source and a column limit_<rule> for each rule, from mergeable sketches."""
    long = counts.select("lang", "source", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), bin_floor(rate(r)).alias("bin")) for r in RULES])))
    fine = common.cut(long.groupBy("lang", "source", "rule", "bin").agg(F.count("*").alias("n")))

    def limits(sketch: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by, "rule").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        total = Window.partitionBy(*by, "rule")
        at = sketch.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(total))
        low, mid = (F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bin"))) for q in (LOWER, MIDDLE))
        slack = F.create_map(*[F.lit(x) for r in RULES for x in (r, RULES[r][2])])[F.col("rule")]
        got = at.groupBy(*by, "rule").agg(low.alias("low"), mid.alias("mid"), F.max("total").alias("total"))
        got = got.withColumn("limit", F.col("mid") + SPREADS * (F.col("mid") - F.col("low")) + slack)
        one = [F.max(F.when(F.col("rule") == r, F.col("limit"))).alias(f"limit_{r}") for r in RULES]
        return got.groupBy(*by).agg(F.max("total").alias("total"), *one)

    by_source = limits(fine, ["lang", "source"])
    by_lang = limits(fine.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n")), ["lang"])
    over_all = limits(fine.groupBy("rule", "bin").agg(F.sum("n").alias("n")), [])
    a, b, c = by_source.alias("a"), by_lang.alias("b"), over_all.alias("c")
    joined = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang"))).crossJoin(F.broadcast(c))  # c is one row
    pick = lambda x: F.when(F.col("a.total") >= MIN_GROUP, F.col(f"a.{x}")).when(F.col("b.total") >= MIN_GROUP, F.col(f"b.{x}")).otherwise(F.col(f"c.{x}"))
    return joined.select("a.lang", "a.source", *[pick(f"limit_{r}").alias(f"limit_{r}") for r in RULES])


def _judged(counts: DataFrame, limit: DataFrame) -> DataFrame:
    """counts with base_failed, rejected_by and kept."""
    if limit.count() <= 20_000:  # a row for each language and source: at most some 2 MB
        limit = F.broadcast(limit)
    limit = limit.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    hit = F.coalesce(*[F.when((rate(r) > F.col(f"limit_{r}")) & (F.col(RULES[r][0]) >= RULES[r][3]), F.lit(r)) for r in RULES])
    return counts.join(limit, on, "left").select(*counts.columns, failed.alias("base_failed"), hit.alias("rejected_by"), (~failed & hit.isNull()).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, the rule that rejects (or null), and kept."""
    counts = common.cut(count_texts(docs, ["doc_id", "lang", "source"]))
    return _judged(counts, common.cut(thresholds(counts)))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep.

    The texts are counted twice, for the thresholds and for the filter, rather than stored or shuffled.
    """
    plain, back = common.masked(docs, "lang", "source", "text")
    limit = common.cut(thresholds(count_texts(plain, ["lang", "source"])))
    return _judged(count_texts(plain, plain.columns), limit).where("kept").select(*back)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def _oracle() -> str:
    """The same in DuckDB's SQL: rows for words, windows and lines, and the sketches as counts of bins."""
    rates = ", ".join(f"CASE WHEN {d} > 0 THEN floor(1000.0::DOUBLE * {n} / {d}) ELSE 0 END::BIGINT AS x_{r}" for r, (n, d, *_) in RULES.items())
    long = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, {slack} AS slack, x_{r} AS x FROM rated" for r, (_, _, slack, _) in RULES.items())

    def level(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        low, mid = (f"min(bin) FILTER (upto * 100 >= total * {q})" for q in (LOWER, MIDDLE))
        return f"""{name}_at AS (SELECT {by}rule, slack, bin, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY {by}rule ORDER BY bin) AS upto, sum(sum(n)) OVER (PARTITION BY {by}rule) AS total FROM fine GROUP BY {by}rule, slack, bin),
{name} AS (SELECT {by}rule, max(total) AS total, {mid} + {SPREADS} * ({mid} - {low}) + max(slack) AS bound FROM {name}_at GROUP BY {by}rule)"""

    bound = f"CASE WHEN a.total >= {MIN_GROUP} THEN a.bound WHEN b.total >= {MIN_GROUP} THEN b.bound ELSE c.bound END"
    order = ", ".join(f"max(CASE WHEN rule = '{r}' AND x_{r} > bound AND {n} >= {hits} THEN '{r}' END)" for r, (n, _, _, hits) in RULES.items())
    space = "\\x20\\x09-\\x0D"
    return f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
word AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS w FROM (SELECT r, regexp_extract_all(t, '[^{space}]+') AS w FROM doc)),
win AS (SELECT r, i, list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS k, w = lag(w) OVER (PARTITION BY r ORDER BY i) AS same FROM word),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win WHERE len(k) = {WINDOW}) WHERE n > 1),
hit AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM twice) GROUP BY r),
words AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM word GROUP BY r),
again AS (SELECT r, count(*) FILTER (same) AS n_same_words FROM win GROUP BY r),
line AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM doc) WHERE regexp_matches(l, '[^{space}]') GROUP BY r),
base AS (SELECT doc.r, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_same_words, 0) AS n_same_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^!?~^=_\\\\{{}}\\[\\]]', '', 'g')) AS n_marks, length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_capitals
  FROM doc LEFT JOIN words USING (r) LEFT JOIN hit USING (r) LEFT JOIN again USING (r) LEFT JOIN line USING (r)),
rated AS (SELECT *, {rates} FROM base),
fine AS (SELECT lang, source, rule, slack, x - x % (2 ** greatest(0, length(bin(x)) - {SKETCH_BITS}))::BIGINT AS bin, count(*) AS n FROM ({long}) GROUP BY ALL),
{level("a", "lang, source")},
{level("b", "lang")},
{level("c", "")},
bounds AS (SELECT a.lang, a.source, a.rule, {bound} AS bound FROM a JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.rule = b.rule JOIN c ON c.rule = a.rule),
judged AS (SELECT r, coalesce({order}) AS rejected_by FROM rated JOIN bounds ON rated.lang IS NOT DISTINCT FROM bounds.lang AND rated.source IS NOT DISTINCT FROM bounds.source GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed,
  NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}) AND rejected_by IS NULL AS kept, rejected_by
FROM rated JOIN judged USING (r)
"""


ORACLE = _oracle()
