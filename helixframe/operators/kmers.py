"""k-mers of sequences (seq_id, seq): windows, counts and repeated places.

A window is packed to two bits a base and stands for both strands by the lesser of itself and its
reverse complement. Windows that hold another letter than a, c, g, t are left out.

Where windows of all records meet, none is a row: those of some million bases are sorted by a number that
mixes their bits, cut into buckets of its range, and sent as differences, about two bytes a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Windows that one batch holds.
CHUNK = 1 << 18
#: Bases of the records that are packed together, and windows that meet in one bucket.
PACK, BUCKET = 1 << 23, 1 << 21
#: Longest record whose own repeats are counted where it is read, without a shuffle.
LOCAL_BASES = 1 << 24

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("acgt"):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i


def checked(k: int) -> int:
    """k, if a window of so many bases fits into the 62 bits that stay positive."""
    if not 1 <= k <= 31:
        raise ValueError(f"k-mers have 1 to 31 bases, not {k}")
    return k


def packed(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the valid windows, their canonical values, and whether they are their own reverse complement."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    at = np.flatnonzero(bad[k:] == bad[:-k])
    wide = (codes & 3).astype(np.int64)
    fore, back, have = wide, 3 - wide, 1
    for bit in bin(k)[3:]:  # windows of twice the bases so far, and one more
        fore, back = fore[:-have] << (2 * have) | fore[have:], back[:-have] | back[have:] << (2 * have)
        have *= 2
        if bit == "1":
            fore, back = fore[:-1] << 2 | wide[have:], back[:-1] | (3 - wide[have:]) << (2 * have)
            have += 1
    fore, back = fore[at], back[at]
    return at, np.minimum(fore, back), fore == back


def _id_type(seqs: DataFrame) -> str:
    return seqs.schema["seq_id"].dataType.simpleString()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i], _CODE[np.frombuffer((batch.column(1)[i].as_py() or "").encode("latin-1", "replace"), np.uint8)]


def windows(seqs: DataFrame, k: int) -> DataFrame:
    """seq_id, pos (from 0), ck (packed canonical k-mer), own (it is its own reverse complement)."""
    kind = _id_type(seqs)
    checked(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq_id, codes in _records(batches):
            for start in range(0, max(0, len(codes) - k + 1), CHUNK):
                at, ck, own = packed(codes[start : start + CHUNK + k - 1], k)
                yield pa.RecordBatch.from_arrays([pa.repeat(seq_id, len(at)), pa.array(at + start), pa.array(ck), pa.array(own)], names=["seq_id", "pos", "ck", "own"])

    return seqs.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, pos long, ck long, own boolean")


def counts(seqs: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """by, ck, n: how often each canonical k-mer stands there."""
    return windows(seqs, k).groupBy(*(by or []), "ck").agg(F.count("*").alias("n"), F.max("own").alias("own"))


def _own_repeats(seqs: DataFrame, k: int) -> DataFrame:
    """seq_id, pos: windows repeated within their record, each record read as a whole."""
    kind = _id_type(seqs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq_id, codes in _records(batches):
            at, ck, own = packed(codes, k)
            _, inverse, n = np.unique(ck, return_inverse=True, return_counts=True)
            hit = at[(n[inverse] > 1) | own]
            for start in range(0, len(hit), CHUNK):
                part = hit[start : start + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.repeat(seq_id, len(part)), pa.array(part)], names=["seq_id", "pos"])

    return seqs.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, pos long")


# --- windows of all records ------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15


def _mixed(ck: np.ndarray, k: int) -> np.ndarray:
    """Another number of 2k bits for each packed k-mer, whose upper bits are even."""
    return (ck.astype(np.uint64) * np.uint64(_ODD)) & np.uint64((1 << 2 * k) - 1)


def _unmixed(mixed: np.ndarray, k: int) -> np.ndarray:
    return ((mixed * np.uint64(pow(_ODD, -1, 1 << 2 * k))) & np.uint64((1 << 2 * k) - 1)).astype(np.int64)


def bucket_bits(windows: int, k: int) -> int:
    """The buckets are 2 to this power."""
    return min(2 * k, max(0, -(-windows // BUCKET) - 1).bit_length())


def _squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers by planes of their bytes, compressed."""
    wide = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T
    return bytes([wide]) + len(numbers).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _spread_out(data: bytes) -> np.ndarray:
    wide, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :wide] = np.frombuffer(pa.Codec("zstd").decompress(data[9:], wide * n, asbytes=True), np.uint8).reshape(wide, n).T
    return out.reshape(-1).view("<u8")


def _bits(flags: np.ndarray) -> bytes:
    return _squeezed(np.packbits(flags))


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(_spread_out(data).astype(np.uint8), count=n).astype(bool)


def _dealt(keys: np.ndarray, shift: int) -> tuple[np.ndarray, list[slice]]:
    """Of sorted keys: the buckets that have any, and where they lie."""
    if not len(keys):
        return np.zeros(0, np.int64), []
    edges = [0]
    while edges[-1] < len(keys):  # a search for each bucket, as keys are many more
        edges.append(int(np.searchsorted(keys, ((keys[edges[-1]] >> np.uint64(shift)) + np.uint64(1)) << np.uint64(shift))))
    return (keys[edges[:-1]] >> np.uint64(shift)).astype(np.int64), [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _steps(mixed: np.ndarray) -> bytes:
    return _squeezed(np.concatenate((mixed[:1], np.diff(mixed))))


#: Sorts behind every window.
_NONE = np.uint64((1 << 64) - 1)


def _keys(codes: np.ndarray, k: int, low: Callable[[np.ndarray, np.ndarray], np.ndarray], more: int) -> np.ndarray:
    """For each place the mixed k-mer, then `more` bits of low(places, own); _NONE where no window is. By parts that stay in the processor's cache."""
    out = np.full(max(0, len(codes) - k + 1), _NONE, np.uint64)
    for i in range(0, len(out), CHUNK):
        at, ck, own = packed(codes[i : i + CHUNK + k - 1], k)
        at += i
        out[at] = _mixed(ck, k) << np.uint64(more) | low(at, own).astype(np.uint64)
    return out


def _valid(keys: np.ndarray) -> np.ndarray:
    """Sorted keys without the places where no window is."""
    return keys[: np.searchsorted(keys, _NONE)]


def _pieces(records: Iterator[tuple[object, np.ndarray]], k: int, size: int) -> Iterator[tuple[list, list[int], list[int], np.ndarray]]:
    """Names, first bases, places and codes of records put behind each other, a sign that is no base after each.

    A longer record is cut into pieces that have each window once.
    """
    names: list = []
    firsts: list[int] = []
    places: list[int] = []
    parts: list[np.ndarray] = []
    held, stop = 0, np.array([4], np.uint8)
    for name, codes in records:
        for start in range(0, max(0, len(codes) - k + 1), size):
            part = codes[start : start + size + k - 1]
            if held and held + len(part) > size:
                yield names, firsts, places, np.concatenate(parts)
                names, firsts, places, parts, held = [], [], [], [], 0
            names.append(name)
            firsts.append(start)
            places.append(held)
            parts += [part, stop]
            held += len(part) + 1
    if held:
        yield names, firsts, places, np.concatenate(parts)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where sorted values differ from the one before."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def _order(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of so many bits, and where each was. With their places in the lower bits, where these fit, they sort several times as fast."""
    place = max(1, len(keys).bit_length())
    if bits + place > 64:
        order = np.argsort(keys)
        return keys[order], order
    both = keys << np.uint64(place) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    return both >> np.uint64(place), (both & np.uint64((1 << place) - 1)).astype(np.int64)


def group_counts(seqs: DataFrame, k: int, groups: int, windows: int, least: int = 2) -> DataFrame:
    """ck, groups, members: the k-mers of seqs(group, seq) that stand `least` times in all, the groups they are in and how often in each.

    group is a whole number below `groups`; windows says how many there are about, and only deals them.
    """
    bits, more = bucket_bits(windows, checked(k)), max(0, groups - 1).bit_length()
    if 2 * k + more > 63:
        raise ValueError(f"k-mers of {k} bases and {groups} groups don't fit into 63 bits")
    mask = np.uint64((1 << more) - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, _, places, codes in _pieces(_records(batches), k, PACK):
            owners = np.array([x.as_py() for x in names], np.int64)
            keys = _keys(codes, k, lambda at, _, owners=owners, places=places: owners[np.searchsorted(places, at, side="right") - 1], more)
            keys.sort()
            keys = _valid(keys)
            first = _firsts(keys)
            n = np.diff(first, append=len(keys))
            keys = keys[first]
            buckets, parts = _dealt(keys, 2 * k + more - bits)
            columns = [pa.array([f(p) for p in parts], pa.binary()) for f in (lambda p: _steps(keys[p] >> np.uint64(more)), lambda p: _squeezed(keys[p] & mask), lambda p: _squeezed(n[p]))]  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array(buckets), *columns], names=["bucket", "steps", "owners", "ns"])

    def meet(got: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(_spread_out(x)) for x in got["steps"].to_pylist()])
        owners, n = (np.concatenate([_spread_out(x) for x in got[c].to_pylist()]) for c in ("owners", "ns"))
        keys, order = _order(keys << np.uint64(more) | owners, 2 * k + more)
        n = n[order].astype(np.int64)
        first = _firsts(keys)
        keys, n = keys[first], np.add.reduceat(n, first)
        family = keys >> np.uint64(more)
        first = _firsts(family)
        size = np.diff(first, append=len(family))
        kept = np.add.reduceat(n, first) >= least
        rows = np.repeat(kept, size)
        edge = pa.array(np.concatenate(([0], np.cumsum(size[kept]))), pa.int32())
        lists = [pa.ListArray.from_arrays(edge, pa.array(x[rows], kind)) for x, kind in (((keys & mask).astype(np.int32), pa.int32()), (n, pa.int64()))]
        return pa.Table.from_arrays([pa.array(_unmixed(family[first][kept], k)), *lists], names=["ck", "groups", "members"])

    sent = seqs.select(F.col("group").cast("int").alias("seq_id"), "seq").mapInArrow(send, "bucket long, steps binary, owners binary, ns binary")
    return sent.groupBy("bucket").applyInArrow(meet, "ck long, groups array<int>, members array<long>")


def span_ends(spans: bytes, k: int, seg: int, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last starts of the stretches that shared_spans() has for a segment."""
    ends = np.cumsum(_spread_out(spans)).astype(np.int64) + seg * segment - k
    return ends[::2], ends[1::2]


def shared_stretches(seqs: DataFrame, k: int) -> DataFrame:
    """seq_id, first, last: starts that follow each other, of windows found twice in all records."""
    kind = _id_type(seqs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first, last = span_ends(batch.column(1)[i].as_py(), k, 0, 0)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(first)), pa.array(first), pa.array(last)], names=["seq_id", "first", "last"])

    return shared_spans(seqs, k, 1 << 62).select("seq_id", "spans").mapInArrow(run, f"seq_id {kind}, first long, last long")


def shared_spans(seqs: DataFrame, k: int, segment: int) -> DataFrame:
    """spans_and_lengths() without the lengths."""
    return spans_and_lengths(seqs, k, segment)[0]


def spans_and_lengths(seqs: DataFrame, k: int, segment: int) -> tuple[DataFrame, DataFrame]:
    """seq_id, seg, spans: stretches of starts that follow each other, of windows found twice in all records on the two strands together.

    Packs of records send their k-mers, get a bit for each back, and are read again. A k-mer that is its own
    reverse complement repeats itself. A segment has all starts whose windows reach into it; where a pack ends
    within it, it has more than one row. span_ends() reads the stretches. And seq_id, len of the records that have a
    window, from the packs, so that no record is read for its length alone.
    """
    kind = _id_type(seqs)
    checked(k)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, firsts, places, codes in _pieces(_records(batches), k, PACK):
            ids = pa.array([x.as_py() for x in names], names[0].type)
            each = [pa.ListArray.from_arrays([0, len(names)], x) for x in (ids, pa.array(firsts, pa.int64()), pa.array(places, pa.int64()))]
            data = pa.Codec("zstd", 1).compress(codes.tobytes(), asbytes=True)
            yield pa.RecordBatch.from_arrays([*each, pa.array([data], pa.binary()), pa.array([len(codes)], pa.int64())], names=["ids", "firsts", "places", "codes", "n"])

    def codes_of(data: pa.Scalar, n: pa.Scalar) -> np.ndarray:
        return np.frombuffer(pa.Codec("zstd").decompress(data.as_py(), n.as_py(), asbytes=True), np.uint8)

    packs = cut(seqs.select("seq_id", "seq").mapInArrow(pack, f"ids array<{kind}>, firsts array<long>, places array<long>, codes binary, n long").withColumn("pack", F.monotonically_increasing_id()))
    bits = bucket_bits(packs.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0], k)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = _keys(codes_of(batch.column(1)[i], batch.column(2)[i]), k, lambda _, own: own, 1)
                keys.sort()
                keys = _valid(keys)
                first = _firsts(keys)
                twice = np.diff(first, append=len(keys)) > 1
                keys = keys[first]
                buckets, parts = _dealt(keys, 2 * k + 1 - bits)
                columns = [pa.array([f(p) for p in parts], pa.binary()) for f in (lambda p: _steps(keys[p] >> np.uint64(1)), lambda p: _bits(twice[p] | ((keys[p] & np.uint64(1)) > 0)))]  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.repeat(batch.column(0)[i], len(parts)), *columns], names=["bucket", "pack", "steps", "twice"])

    def meet(got: pa.Table) -> pa.Table:
        lists = [np.cumsum(_spread_out(x)) for x in got["steps"].to_pylist()]
        keys, twice = np.concatenate(lists), np.concatenate([_unbits(x, len(y)) for x, y in zip(got["twice"].to_pylist(), lists, strict=True)])
        keys, order = _order(keys, 2 * k)
        same = np.flatnonzero(keys[1:] == keys[:-1])
        twice[order[same]] = twice[order[same + 1]] = True
        edge = np.cumsum([0, *map(len, lists)])
        found = pa.array([_bits(twice[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
        return pa.Table.from_arrays([got["pack"], got["bucket"], found], names=["pack", "bucket", "found"])

    def mark(mine: pa.Table, got: pa.Table) -> pa.Table:
        codes = codes_of(mine["codes"][0], mine["n"][0])
        place = len(codes).bit_length()
        if 2 * k + place < 64:
            keys = _keys(codes, k, lambda at, _: at, place)
            keys.sort()
            keys = _valid(keys)
            order = (keys & np.uint64((1 << place) - 1)).astype(np.int64)
            keys >>= np.uint64(place)
        else:
            keys = _keys(codes, k, lambda at, _: np.zeros(len(at), np.uint64), 0)
            order = np.argsort(keys)
            keys = _valid(keys[order])
        first = _firsts(keys)
        n = np.diff(first, append=len(keys))
        buckets, parts = _dealt(keys[first], 2 * k - bits)
        found = dict(zip(got["bucket"].to_pylist(), got["found"].to_pylist(), strict=True)) if got.num_rows else {}
        hit = np.zeros(len(codes) + 2, np.int8)
        if parts:
            flags = np.concatenate([_unbits(found[b], p.stop - p.start) for b, p in zip(buckets.tolist(), parts, strict=True)])
            hit[order[: len(keys)] + 1] = np.repeat(flags, n)
        turn = np.diff(hit)
        begin, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1
        places = mine["places"][0].values.to_numpy()
        of = np.searchsorted(places, begin, side="right") - 1
        move = mine["firsts"][0].values.to_numpy()[of] - places[of]
        begin, last = begin + move, last + move
        seg, end = begin // segment, (last + k - 1) // segment
        more = np.repeat(np.arange(len(begin)), end - seg + 1)
        seg = seg[more] + np.arange(len(more)) - np.searchsorted(more, more)
        begin, last, of = np.maximum(begin[more], seg * segment - k + 1), np.minimum(last[more], seg * segment + (segment - 1)), of[more]
        kept = np.lexsort((begin, seg, of))
        of, seg = of[kept], seg[kept]
        ends = np.stack((begin[kept], last[kept]), 1) - (seg * segment - k)[:, None]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), (of[1:] != of[:-1]) | (seg[1:] != seg[:-1]))))
        spans = [_steps(ends[a:b].reshape(-1)) for a, b in zip(new.tolist(), [*new[1:].tolist(), len(of)], strict=True)] if len(new) else []
        return pa.Table.from_arrays([mine["ids"][0].values.take(pa.array(of[new])), pa.array(seg[new]), pa.array(spans, pa.binary())], names=["seq_id", "seg", "spans"])

    sent = packs.select("pack", "codes", "n").mapInArrow(send, "bucket long, pack long, steps binary, twice binary")
    # a few hundredths of what was sent, which leaves the disk before packs are shuffled
    found = cut(sent.groupBy("bucket").applyInArrow(meet, "pack long, bucket long, found binary"))
    spans = packs.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(mark, f"seq_id {kind}, seg long, spans binary")
    ends = F.expr("transform(places, (p, i) -> firsts[i] + if(i + 1 < size(places), places[i + 1], n) - 1 - p)")
    pieces = packs.select("ids", "firsts", "places", "n").select(F.explode(F.arrays_zip("ids", ends.alias("ends"))).alias("_p"))
    return spans, pieces.groupBy(F.col("_p.ids").alias("seq_id")).agg(F.max("_p.ends").alias("len"))


def repeated(seqs: DataFrame, k: int, shared: bool) -> DataFrame:
    """seq_id, pos of windows found twice on the two strands together: in all records (shared), or in their own.

    Own repeats of records up to LOCAL_BASES need no shuffle; those of longer records are counted
    by rows. A k-mer that is its own reverse complement repeats itself.
    """

    def spread(part: DataFrame, keys: list[str]) -> DataFrame:
        w = windows(part, k)
        twice = w.groupBy(*keys).agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n > 1 or own")
        return w.join(twice.select(*keys), keys, "left_semi").select("seq_id", "pos")

    if shared:
        return shared_stretches(seqs, k).select("seq_id", F.explode(F.sequence("first", "last")).alias("pos"))
    short = F.length("seq") <= LOCAL_BASES
    return _own_repeats(seqs.where(short), k).unionByName(spread(seqs.where(~short), ["seq_id", "ck"]))
