"""Text quality by a linear-chain conditional random field over lines.

Each line with a word is good or bad. What speaks for good is linear in features of the line and of
its two neighbours; a further weight stands for each pair of labels of neighbouring lines. Forward
and backward sums give each line's probability to be good, and their mean, weighted by the lines'
lengths, is the document's quality; a logistic function with two fitted numbers turns it into the
probability that the document's label is 1.

The field is trained here, by its likelihood, on labelled documents, all lines having the
document's label: on the TRAIN_DOCS of least hash among those whose crc32(doc_id) modulo FOLDS is
not 0, as far as they have at most TRAIN_LINES lines. Scoring reads whole texts of any length.

Defined results: a text without words (null, empty) has the share of label 1 among such training
documents, or among all if there is none; without any usable label all scores are 0.5; with labels of
one kind only they are this kind's share, 0 or 1. A null doc_id isn't held out. Of contradictory
labels of a document the least counts, and of texts with the same doc_id the least is learned from. Equal
rows each get a row; an empty table an empty result. Only doc_id and text are read, so that other columns
of whatever name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, quality_rules

FOLDS = 5
TRAIN_DOCS, TRAIN_LINES = 2000, 256
STEPS, RATE, RIDGE = 200, 0.1, 1e-3
CUT = 0.3
FEATURES = ("one", "words", "word_length", "capitals", "symbols", "bars", "marks", "digits", "same_words", "repeated", "seen", "stop")
_N = len(FEATURES)


def features(block: common.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of features for each line with a word, its bytes, and its text."""
    data = block.data
    cuts, stops, owner = quality_rules.lines(block)
    words = block.words()
    a, b = np.searchsorted(block.starts, cuts), np.searchsorted(block.starts, stops)
    n_words = np.maximum(b - a, 1)

    def chars(hit: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
        return total[stops] - total[cuts]

    def of_words(hit: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
        return total[b] - total[a]

    size = np.maximum(chars((data & 0xC0) != 0x80), 1)
    capital = (data >= 65) & (data <= 90)
    if len(data) > 1:
        capital[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    same = np.zeros(len(words), bool)
    if len(words) > 1:
        same[1:] = (words[1:] == words[:-1]) & (block.doc[1:] == block.doc[:-1])
    last = data[np.maximum(stops, 1) - 1] if len(stops) else data[:0]
    columns = [
        np.ones(len(cuts)),
        np.minimum(np.log2(1 + n_words) / 10, 1),
        np.minimum(size / n_words / 20, 1),
        chars(capital) / size,
        np.minimum(chars(quality_rules._SYMBOL[data] & (data != 124)) / n_words / 3, 1),
        np.minimum(chars(data == 124) / n_words, 1),
        np.minimum(chars(data == 33) / n_words, 1),
        chars((data >= 48) & (data <= 57)) / size,
        of_words(same) / n_words,
        of_words(quality_rules.repeated(block, words)) / n_words,
        quality_rules.seen_before(block, cuts, stops, owner),
        np.isin(last, [33, 46, 63]),
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], 1), (stops - cuts), owner


def shifted(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Features of a line beside those of the line before and after it, 0 at the ends of a text."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = (owner[1:] == owner[:-1])[:, None]
    before[1:] = x[:-1] * same
    after[:-1] = x[1:] * same
    return np.concatenate((x, before, after), 1)


def marginals(unary: np.ndarray, pair: np.ndarray, counts: np.ndarray, pairs: bool = False):
    """P(good) of each line; and, if asked for, the sum of P(label, next label) over all, and log Z.

    unary: what speaks for good in each line, text after text; counts: lines of each text (none is 0).
    Texts advance together, by falling length, each step over those that still have a line.
    """
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    size = counts[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    fore = np.zeros((len(unary), 2))
    for t in range(longest):
        k = active[t]
        at = starts[:k] + t
        if t:
            was = fore[at - 1]
            now = np.logaddexp(was[:, :1] + pair[:1], was[:, 1:] + pair[1:])
        else:
            now = np.zeros((k, 2))
        now[:, 1] += unary[at]
        fore[at] = now
    ends = starts + size - 1
    log_z = np.logaddexp(fore[ends, 0], fore[ends, 1])
    back = np.zeros((len(unary), 2))
    both = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        k = active[t + 1]
        at = starts[:k] + t
        after = back[at + 1].copy()
        after[:, 1] += unary[at + 1]
        if pairs:
            for i in (0, 1):
                for j in (0, 1):
                    both[i, j] += np.exp(fore[at, i] + pair[i, j] + after[:, j] - log_z[:k]).sum()
        back[at] = np.logaddexp(pair[:, 0] + after[:, :1], pair[:, 1] + after[:, 1:])
    z = np.empty(len(unary))
    for_line = np.repeat(np.arange(len(counts)), counts)
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    z = log_z[rank[for_line]]
    good = np.exp(np.minimum(fore[:, 1] + back[:, 1] - z, 0))
    return (good, both, log_z) if pairs else good


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray
    slope: float
    shift: float
    empty: float

    def document(self, x: np.ndarray, length: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
        """Mean marginal of each text, its lines weighted by length; nan if it has none."""
        counts = np.bincount(owner, minlength=n_docs)
        out = np.full(n_docs, np.nan)
        has = counts > 0
        if has.any():
            own = x @ self.weights.reshape(3, _N).T
            unary = own[:, 0].astype(float)
            same = owner[1:] == owner[:-1]
            unary[1:] += own[:-1, 1] * same
            unary[:-1] += own[1:, 2] * same
            good = marginals(unary, self.pair, counts[has])
            out[has] = (np.bincount(owner, good * length, n_docs) / np.maximum(np.bincount(owner, length, n_docs), 1))[has]
        return out

    def score(self, mean: np.ndarray) -> np.ndarray:
        if not np.isfinite(self.slope):
            return np.full(len(mean), self.empty)
        return np.where(np.isnan(mean), self.empty, 1 / (1 + np.exp(-(self.slope * (mean - 0.5) + self.shift))))


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """docs: features and lengths of the lines, and the label."""
    labels = np.array([y for *_, y in docs], float)
    share = float(labels.mean()) if len(labels) else 0.5
    bare = [y for x, _, y in docs if not len(x)]
    empty = float(np.mean(bare)) if bare else share
    full = [d for d in docs if len(d[0])]
    if len({y for *_, y in full}) < 2:
        return Model(np.zeros(3 * _N), np.zeros((2, 2)), np.nan, 0.0, share)
    counts = np.array([len(x) for x, *_ in full])
    owner = np.repeat(np.arange(len(full)), counts)
    x = shifted(np.concatenate([x for x, *_ in full]), owner).astype(float)
    y = np.array([label for *_, label in full])
    good = np.repeat(y, counts).astype(float)
    # each document counts the same, whatever its lines are
    held = np.zeros((2, 2))
    held[0, 0], held[1, 1] = (counts - 1)[y == 0].sum(), (counts - 1)[y == 1].sum()
    theta = np.zeros(3 * _N + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = 1 / len(x)
    for step in range(1, STEPS + 1):
        p, both, _ = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), counts, True)
        grad = np.concatenate((x.T @ (good - p), (held - both).ravel())) * scale - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0, empty)
    mean = np.nan_to_num(model.document(np.concatenate([d[0] for d in full]), np.concatenate([d[1] for d in full]), owner, len(full)), nan=0.5) - 0.5
    a, b = 4.0, 0.0  # Newton's steps of the two numbers' logistic regression, slightly held back
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * mean + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * mean).sum() - 0.1 * (a - 4), (y - p).sum()])
        h = np.array([[(w * mean * mean).sum() + 0.1, (w * mean).sum()], [(w * mean).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    model.slope, model.shift = a, b
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_lines(docs: DataFrame, labels: DataFrame, n: int = TRAIN_DOCS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    usable = labels.where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most n rows
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))  # one for each id, however often it stands there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality, ids, rows, sizes = batch.column(1).to_pylist(), batch.column(2).to_pylist(), [], []
            for at, to, block in common.blocks(batch.column(0)):
                x, length, owner = features(block)
                for i in range(to - at):
                    own = owner == i
                    fits = own.sum() <= TRAIN_LINES
                    rows.append(x[own].astype("<f4").tobytes() if fits else None)
                    sizes.append(length[own].astype("<i8").tobytes() if fits else None)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(sizes, pa.binary()), pa.array(quality, pa.int32()), pa.array([str(i) for i in ids])], names=["x", "length", "quality", "id"])

    got = texts.select("text", F.col("quality").cast("int").alias("quality"), "doc_id").mapInArrow(run, "x binary, length binary, quality int, id string")
    rows = sorted((r["id"], bytes(r["x"]), bytes(r["length"]), r["quality"]) for r in got.where("x is not null").collect())
    return [(np.frombuffer(x, "<f4").reshape(-1, _N), np.frombuffer(length, "<i8"), y) for _, x, length, y in rows]


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(training_lines(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for at, to, block in common.blocks(batch.column(2)):
                scores.append(model.score(model.document(*features(block), to - at)))
            score = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
