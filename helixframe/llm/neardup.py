"""Near-duplicates by Order MinHash.

A text's k-mers are its runs of SHINGLE words, each labelled with its number among equal ones. For
each of SKETCHES hash functions the sketch takes the LEAST k-mers of least hash and keeps them in
the order of the text (Marcais, DeBlasio, Pandey and Kingsford, 2019). Two texts meet where a sketch
is equal: likely for a small edit distance, unlikely for the same words in another order. With a
shingle similarity of 0.8, a sketch is equal with probability 0.8 ** 5 or so, and one in 24 at least with
0.9998 or more where either text has over 40 words. Texts of SHORT words at most have too few shingles for
that; they are all compared, behind the exact filter below.

Candidates are verified: the Jaccard similarity of the sets of shingles is a bound that most
wrong ones miss, then a banded alignment of the words gives the edit distance. A link needs both
similarities to reach SIMILARITY.

Texts of the same words are one node from the start. Nodes that share a sketch aren't all paired. One
of them, the hub, is compared with the others first; where that joins them, nothing is left to do, as
classes are connected components. What then still lies in different components of one bucket is
compared across components, with an exact filter that spares pairs that can't reach SIMILARITY; so are
all short texts, whatever they share. The components are those of all links among candidates.

Defined results: null text counts as empty; texts without words are copies of each other; texts of
fewer words than a shingle are one shingle of all their words. Class ids are the least doc_id of the
class. A null doc_id stands for a hash of its text. Equal doc_ids are one document, compared by one of its
texts, the same in every run. Texts of any length are read whole. An empty table gives an empty result.
Only doc_id and text are read; keep_one() gives all columns back, of whatever name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
SKETCHES = 24
LEAST = 5
#: Words of a short text. Texts alike to one of up to 40 words have no more.
SHORT = 50
SIMILARITY = 0.8
#: Shingles of a prefix up to which it is carried along as a list.
LISTED = 64
#: Edits that are looked for without the whole band first.
FEW = 40

_rng = np.random.Generator(np.random.PCG64(4))
_MUL = _rng.integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
_FOLD = np.uint64(0xD1342543DE82EF95)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of `size` words, or of all words if there are fewer."""
    return common.window_hash(words, min(size, len(words))) if len(words) else words


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the shingles with their number among equal ones."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return hashes
    starts = np.flatnonzero(new)
    number = np.empty(len(hashes), np.uint64)
    number[order] = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    return np.where(number > 0, common.mix(hashes + number * np.uint64(0x9E3779B97F4A7C15)), hashes)


def order_sketch(keys: np.ndarray, least: int = LEAST) -> np.ndarray:
    """For each hash function, one hash of the least labelled k-mers in text order."""
    n, take = len(keys), min(least, len(keys))
    step = max(1, (1 << 22) // max(1, n))
    out = np.empty(SKETCHES, np.uint64)
    for j in range(0, SKETCHES, step):
        if take < n:
            values = keys[None, :] * _MUL[j : j + step, None] + _ADD[j : j + step, None]
            at = np.sort(np.argpartition(values, take - 1, axis=1)[:, :take], axis=1)
        else:
            at = np.broadcast_to(np.arange(n), (len(_MUL[j : j + step]), n))
        picked = keys[at]
        folded = np.zeros(len(picked), np.uint64)
        for c in range(take):
            folded = folded * _FOLD + picked[:, c]
        out[j : j + step] = common.mix(folded)
    return out


def node_id() -> Column:
    return F.coalesce(F.col("doc_id"), F.xxhash64(F.lit("no id"), F.coalesce("text", F.lit(""))))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, id (never null), high, low (hash of the words), n_words, sketch (empty if there is no word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, n_words, out = [], [], [], []
            for _, _, block in common.blocks(batch.column(2)):
                words = block.words()
                for a, b in zip(block.first[:-1], block.first[1:], strict=True):
                    own = words[a:b]
                    n_words.append(len(own))
                    spread = own * common._power(common._BASE, len(own)) + np.uint64(1)
                    high.append(int(common.mix(spread).sum(dtype=np.uint64).view(np.int64)))
                    low.append(int((common.mix(spread + _FOLD) * _FOLD).sum(dtype=np.uint64).view(np.int64)))
                    out.append(order_sketch(labelled(shingles(own))).view(np.int64) if len(own) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            values = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(n_words, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                names=["doc_id", "id", "high", "low", "n_words", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", node_id().alias("id"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, id {kind}, high long, low long, n_words int, sketch array<long>")


def word_arrays(docs: DataFrame) -> DataFrame:
    """node, words: the hashes of the words, 32 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, block in common.blocks(batch.column(1)):
                short = (block.words() >> np.uint64(32)).astype(np.uint32)
                rows = [short[a:b].tobytes() for a, b in zip(block.first[:-1], block.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(rows, pa.binary())], names=["node", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(node_id().alias("node"), F.col("text").cast("string")).mapInArrow(run, f"node {kind}, words binary")


def few_edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two arrays, or most + 1 if it is larger, by the furthest points that each number of edits reaches."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    breaks: dict[int, np.ndarray] = {}

    def slide(x: int, d: int) -> int:
        """How far the matches go on diagonal d (b is d ahead of a) from a's place x."""
        if d not in breaks:
            lo, hi = max(0, -d), min(n, m - d)
            breaks[d] = np.append(np.flatnonzero(a[lo:hi] != b[lo + d : hi + d]) + lo, hi)
        at = breaks[d]
        return int(at[np.searchsorted(at, x)]) if x <= at[-1] else x

    reach = {0: slide(0, 0)}
    for e in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return e
        ahead: dict[int, int] = {}
        for d in range(max(-e - 1, -most, -n), min(e + 1, most, m) + 1):
            x = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            x = min(x, n, m - d)
            if x >= max(0, -d):
                ahead[d] = slide(x, d)
        reach = ahead
    return most + 1


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The same by rows of the alignment's matrix, of which only the band of `most` to each side is made."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    width = 2 * most + 1
    step = np.arange(width)
    padded = np.full(m + 2 * width, -1, np.int64)  # b stands at most, what lies outside matches nothing
    padded[most + 1 : most + 1 + m] = b.view(np.int64) if b.dtype == np.uint64 else b
    row = np.where(step >= most, step - most, most + 1)  # cell c of row i is column i - most + c
    row[step - most > m] = most + 1
    for i, x in enumerate(a.view(np.int64) if a.dtype == np.uint64 else a, 1):
        new = row + (padded[i : i + width] != x)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        if i <= most:
            new[: most - i] = most + 1
            new[most - i] = i
        new = np.minimum.accumulate(new - step) + step
        last = m - i + most  # beyond it there is no column
        if last + 1 < width:
            new[max(0, last + 1) :] = most + 1
        if new.min() > most:
            return most + 1
        row = np.minimum(new, most + 1)
    return int(row[m - n + most])


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two arrays, or most + 1 if it is larger; what they begin and end with in common is left out."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    head = int(apart[0]) if len(apart) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(apart[0]) if len(apart) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    few = min(most, FEW)
    got = few_edits(a, b, few)
    return got if got <= few or few == most else banded_distance(a, b, most)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the shingles' Jaccard similarity and the words' edit similarity reach it."""
    x, y = np.unique(shingles(a)), np.unique(shingles(b))
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    common_part = len(np.intersect1d(x, y, assume_unique=True))
    if common_part < least * (len(x) + len(y) - common_part) - 1e-9:
        return False
    longest = max(len(a), len(b))
    return edit_distance(a, b, int((1 - least) * longest + 1e-9)) <= (1 - least) * longest + 1e-9


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """a, b, same for each of pairs(a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(i) for i in (2, 3))
            got = [similar(*(np.frombuffer(c[i].as_py(), np.uint32).astype(np.uint64) for c in (left, right))) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.bool_())], names=["a", "b", "same"])

    kind = words.schema["node"].dataType.simpleString()
    one, two = (words.select(F.col("node").alias(x), F.col("words").alias(f"words_{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "words_a", "words_b").mapInArrow(run, f"a {kind}, b {kind}, same boolean")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for the nodes of edges(a, b): least labels spread over links, then labels of labels."""
    both = common.cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = common.cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("_near"))
        least = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "_near").alias("component"), F.col("component").alias("_was"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        stepped = common.cut(least.join(up, "component", "left").select("node", F.least("component", "_up").alias("component"), (F.least("component", "_up") < F.col("_was")).alias("_moved")))
        labels = stepped.select("node", "component")
        if not stepped.where("_moved").take(1):
            return labels


def labelled_by(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """nodes(node, ..) with component: that of labels, or the node itself."""
    if labels is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(labels.withColumnRenamed("component", "_component"), "node", "left").withColumn("component", F.coalesce("_component", "node")).drop("_component")


def shingle_rows(words: DataFrame) -> DataFrame:
    """node, shingle: a row for each distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.unique(shingles(np.frombuffer(batch.column(1)[i].as_py(), np.uint32).astype(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(own)), pa.array(own)], names=["node", "shingle"])

    kind = words.schema["node"].dataType.simpleString()
    return words.select("node", "words").mapInArrow(run, f"node {kind}, shingle long")


def across(words: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """a, b: pairs of words(node, component, words) of different components that may be so similar.

    Two sets of so high a similarity share one of the rarest (1 - least) of either's shingles, whatever the
    order of rarity is, as long as it is one for all (the prefix filter). Which are rare is counted
    among these nodes. A shingle that only one component has joins nothing.
    """
    rows = common.cut(shingle_rows(words))
    rare = rows.groupBy("shingle").agg(F.count("*").alias("_df"))
    by_rarity = Window.partitionBy("node").orderBy("_df", "shingle")
    ranked = rows.join(rare, "shingle").withColumn("_at", F.row_number().over(by_rarity)).withColumn("size", F.count("*").over(Window.partitionBy("node")))
    size, at = F.col("size"), F.col("_at")
    first = lambda share: at <= size - F.ceil(size * share - 1e-9) + 1
    # of two sets, the larger one's rarest shingles meet the even rarer ones of the lesser, which must share more of its own
    prefix = ranked.where(first(least) & (F.col("_df") > 1)).select("node", "shingle", "size", first(2 * least / (1 + least)).alias("inner"), at.alias("at"))
    prefix = common.cut(prefix.join(words.select("node", "component"), "node"))
    # stored before the join, so that the join reads two plain shuffles, of which Spark can split a large part
    mixed = common.cut(prefix.groupBy("shingle").agg(F.min("component").alias("_c0"), F.max("component").alias("_c1")).where("_c0 < _c1").select("shingle"))
    prefix = common.cut(prefix.join(mixed, "shingle"))
    # sets of few such shingles carry them along, so that a join can tell all that two have in common
    listed = prefix.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "shingle"))).alias("_l")).where(F.size("_l") <= LISTED)
    prefix = prefix.join(listed.select("node", F.col("_l.shingle").alias("list"), F.col("_l.at").alias("places")), "node", "left")
    one, two = prefix.alias("x"), prefix.where("inner").alias("y")
    order = lambda p: F.struct(f"{p}.size", f"{p}.node")
    need = F.ceil((F.col("x.size") + F.col("y.size")) * least / (1 + least) - 1e-9)
    # what two sets have in common is what they have up to a shared shingle, and what can follow there
    here = F.least("x.at", "y.at") + F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    both = F.array_intersect("x.list", "y.list")
    place = lambda p: F.element_at(F.col(f"{p}.places"), F.array_position(F.col(f"{p}.list"), F.element_at(both, -1)).cast("int"))
    exact = (F.element_at(both, 1) == F.col("shingle")) & (F.size(both) + F.least(F.col("x.size") - place("x"), F.col("y.size") - place("y")) >= need)
    told = F.col("x.list").isNotNull() & F.col("y.list").isNotNull()
    alike = (F.col("y.size") >= F.col("x.size") * least) & (order("y") < order("x")) & (F.col("x.component") != F.col("y.component")) & (here >= need) & F.when(told, exact).otherwise(F.lit(True))
    met = one.join(two.withColumnRenamed("shingle", "_s"), F.col("shingle") == F.col("_s")).where(alike)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id: one row for each row of docs."""
    docs = docs.select("doc_id", "text")
    sketched = common.cut(sketches(docs))
    texts = common.cut(sketched.groupBy("high", "low").agg(F.min("id").alias("node"), F.min("n_words").alias("n_words"), F.min_by("sketch", "id").alias("sketch")))
    bands = texts.select("node", F.posexplode("sketch").alias("band", "value"))
    sizes = bands.groupBy("band", "value").agg(F.count("*").alias("_n")).where("_n > 1")
    members = common.cut(bands.join(sizes, ["band", "value"]))
    # the hub of a bucket is its node that meets most others in all buckets: the middle of a group of edited copies
    met = members.groupBy("node").agg(F.sum("_n").alias("_met"))
    hubs = members.join(met, "node").groupBy("band", "value").agg(F.max_by("node", F.struct("_met", "node")).alias("hub"))
    members = common.cut(members.select("node", "band", "value").join(hubs, ["band", "value"]))
    short = texts.where(F.col("n_words").between(1, SHORT)).select("node")
    nodes = members.select("node").union(short).distinct()
    words = word_arrays(docs.join(nodes, node_id() == F.col("node"), "left_semi"))
    words = common.cut(words.groupBy("node").agg(F.min("words").alias("words")))  # of rows with equal ids always the same one

    pairs = members.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    tried = common.cut(verified(pairs, words))
    edges = tried.where("same").select("a", "b")
    labels = common.cut(components(edges)) if edges.take(1) else None

    # what is left: nodes of different components in one bucket, which need not be alike to the hub, and short texts
    placed = labelled_by(members.select("node", "band", "value"), labels)
    apart = placed.groupBy("band", "value").agg(F.min("component").alias("_c0"), F.max("component").alias("_c1"), F.count("*").alias("_n")).where("_c0 < _c1 and _n > 2")
    left = placed.join(apart.select("band", "value"), ["band", "value"]).select("node", "component").union(labelled_by(short, labels).select("node", "component"))
    left = common.cut(left.distinct().join(words, "node"))
    if left.take(1):
        more = common.cut(across(left).join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        found = common.cut(verified(more, left).where("same").select("a", "b"))
        if found.take(1):  # links between components
            ends = labelled_by(labelled_by(found.withColumnRenamed("a", "node"), labels).select(F.col("component").alias("a"), F.col("b").alias("node")), labels)
            merged = components(ends.select("a", F.col("component").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("_root"))
            labels = common.cut(labelled_by(nodes, labels).join(merged, "component", "left").select("node", F.coalesce("_root", "component").alias("component")))
    texts = labelled_by(texts.select("high", "low", "node"), labels).select("high", "low", F.col("component").alias("class_id"))
    return sketched.select("doc_id", "high", "low").join(texts, ["high", "low"]).select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of docs that gives each class its id; of rows with equal ids the one of the least text."""
    stay = classes(docs.select("doc_id", "text")).select(F.col("class_id").alias("_class")).distinct()
    plain, back = common.masked(docs, "doc_id", "text")
    mine = plain.withColumn("_node", node_id()).join(stay, F.col("_node") == F.col("_class"), "left_semi")
    order = ["text", *[c for c in plain.columns if c.startswith("_masked_") and "map" not in plain.schema[c].dataType.simpleString()]]
    return mine.withColumn("_at", F.row_number().over(Window.partitionBy("_node").orderBy(*order))).where("_at = 1").select(*back)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = classes(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


#: All pairs that share a shingle, for small tables. SQL has the shingles' similarity, not the alignment, which
#: only tells apart texts of the same shingles in another order.
ORACLE = f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [['']] ELSE [w[i:i + {SHINGLE - 1}] for i in range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)] END) AS s FROM doc),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE pair.n >= {SIMILARITY} * (x.n + y.n - pair.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM size UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, class_id, doc_id = class_id AS kept FROM doc JOIN class USING (doc_id)
"""
