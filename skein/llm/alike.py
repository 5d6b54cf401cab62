"""Near-duplicate join of sets under the Jaccard distance, exact.

Documents with the same set collapse to one class first.  Regions of the join
are ranges of the hashes of shingles: a class is replicated to the regions of
its prefix, the shingles of which a partner at the threshold must share at least
one, rarest first.  A first pass over the regions counts how many classes have a
shingle, so that prefixes leave out what is unique and begin with what is rare.
Matches of prefixes are summed over the regions; pairs whose sizes, matches and
places bound the distance above the threshold fall away, and what is left is
verified on the whole sets.

What travels between the passes is packed: entries are sorted by the number of
their class, and only the gaps between numbers are sent (about a byte each at
any number of regions).

Why no pivots of Voronoi regions: at a distance of at most one half, twice the
radius is the diameter of the Jaccard space, so that the triangle inequality
excludes nothing and every document would be replicated to every region; see
the README for figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.shared import written

#: Hashes (6 to 8 bytes each) that one region should hold.
REGION_ENTRIES = 1_500_000
#: Pairs generated at a time within a region.
PAIR_CHUNK = 1_000_000
#: Numbers of classes (8 bytes each) up to which a list of them is broadcast.
BROADCAST_CLASSES = 500_000

_WIDTH = 6  # bytes of a stored hash: a false match within a pair of 1000-shingle texts has a chance below 1e-8
_RUN = np.int64(12)  # classes whose numbers agree but for these bits go to one bucket


def pack(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of sorted 64-bit hashes."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    """Sorted 48-bit hashes as uint64."""
    n = len(blob) // _WIDTH
    wide = np.zeros((n, 8), np.uint8)
    wide[:, 8 - _WIDTH :] = np.frombuffer(blob, np.uint8).reshape(n, _WIDTH)
    return np.unique(wide.view(">u8").ravel().astype(np.uint64))


def class_key(blob: bytes) -> int:
    """64-bit key of a set, signed."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(blob))))


def gaps(numbers: np.ndarray) -> bytes:
    """Sorted int64 numbers as their first, and gaps of a byte (255: in the list of large ones ahead)."""
    d = np.diff(numbers)
    large = d[d >= 255]
    return np.array([len(large), numbers[0], *large], np.int64).tobytes() + np.minimum(d, 255).astype(np.uint8).tobytes()


def ungaps(blob: bytes) -> np.ndarray:
    n_large, first = np.frombuffer(blob, np.int64, 2)
    small = np.frombuffer(blob, np.uint8, offset=16 + 8 * int(n_large))
    d = small.astype(np.int64)
    d[small == 255] = np.frombuffer(blob, np.int64, int(n_large), 16)
    return first + np.concatenate([[0], np.cumsum(d)])


def _rows(key: np.ndarray, no: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    """``(key, gaps of no, blob of each other array)`` for every key, sorted by ``no``."""
    order = np.lexsort((no, key))
    key, no, more = key[order], no[order], [x[order] for x in more]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
    for lo, hi in zip(at, [*at[1:], len(key)]):
        yield (int(key[lo]), gaps(no[lo:hi]), *(x[lo:hi].tobytes() for x in more))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("r", "c", "o") else pa.binary()) for n, c in zip(names, columns)], names=names)


def _per_group(work):
    """Call ``work(group, rows)`` for the rows of each value of the first column, which come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            for r, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if r != current and rows:
                    yield from work(current, rows)
                    rows = []
                current = r
                rows.append(tuple(row))
        if rows:
            yield from work(current, rows)

    return run


def _sets_by_region(n_regions: int):
    """``(r, numbers, hashes)`` of the sets of each batch."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [unpack(s) for s in b.column(1).to_pylist()]
            if sets:
                key = np.concatenate(sets)
                # 24 bits choose the region, the 24 others and 8 of the first are compared: equal hashes stay equal.
                region = ((key >> np.uint64(24)) * np.uint64(n_regions)) >> np.uint64(24)
                no = np.repeat(np.array(b.column(0).to_pylist(), np.int64), [len(s) for s in sets])
                yield _batch(list(_rows(region, no, (key & np.uint64(0xFFFFFFFF)).astype(np.uint32))), ["r", "no", "h"])

    return emit


def _bucket(no: np.ndarray, n_buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (no >> _RUN).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)


def _sizes(n_buckets: int):
    """``(c, o = -1, numbers, sizes)``: how many hashes each class has, by bucket of the class."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            no, size = np.array(b.column(0).to_pylist(), np.int64), np.array(b.column(1).to_pylist(), np.int32)
            yield _batch([(c, -1, g, s, b"") for c, g, s in _rows(_bucket(no, n_buckets), no, size)], ["c", "o", "no", "h", "df"])

    return emit


def _shared(n_buckets: int):
    """Entries of a region that more than one class has, with how many (in steps of an eighth of a power of two), by bucket of the class."""

    def work(region: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        no, h = np.concatenate([ungaps(g) for g, _ in rows]), np.concatenate([np.frombuffer(x, np.uint32) for _, x in rows])
        order = np.argsort(h, kind="stable")
        no, h = no[order], h[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(start, len(h)))
        df = np.repeat(np.minimum(255, np.round(8 * np.log2(count))).astype(np.uint8), count)
        keep = np.repeat(count > 1, count)
        no, h, df = no[keep], h[keep], df[keep]
        yield _batch([(c, region, *x) for c, *x in _rows(_bucket(no, n_buckets), no, h, df)], ["c", "o", "no", "h", "df"])

    return _per_group(work)


def _prefixes(threshold: float):
    """The part of each class's prefix that other classes share, rarest first, back to the regions."""

    def work(_: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        known = [r for r in rows if r[0] < 0]
        rows = [r for r in rows if r[0] >= 0]
        if not rows:
            return
        owner, sizes = np.concatenate([ungaps(g) for _, g, _, _ in known]), np.concatenate([np.frombuffer(s, np.int32) for _, _, s, _ in known])
        order = np.argsort(owner)
        owner, sizes = owner[order], sizes[order].astype(np.int64)
        no, h, df = np.concatenate([ungaps(r[1]) for r in rows]), np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows]), np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows])
        region = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[2]) // 4 for r in rows])
        order = np.lexsort((h, region, df, no))
        no, h, region = no[order], h[order], region[order]
        size = sizes[np.searchsorted(owner, no)]
        start = np.flatnonzero(np.concatenate([[True], no[1:] != no[:-1]]))
        length = np.diff(np.append(start, len(no)))
        place = np.arange(len(no)) - np.repeat(start, length) + (size - np.repeat(length, length))  # behind what only this class has
        keep = place < size - np.ceil(threshold * size - 1e-9) + 1
        no, h, region, place, size = no[keep], h[keep], region[keep], place[keep], size[keep]
        # Places in 256ths of the set, rounded down: a bound stays one.
        yield _batch(list(_rows(region, no, h, size.astype(np.int32), (place * 256 // size).astype(np.uint8))), ["r", "no", "h", "size", "p"])

    return _per_group(work)


def _matches(threshold: float):
    """Matches of prefixes within a region: for each pair (the smaller class, or number, first) how many, and the furthest places."""

    def work(_: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, h = np.concatenate([ungaps(r[0]) for r in rows]), np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows])
        size, p = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows]).astype(np.int64), np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows])
        p = (p * size // 256).astype(np.int32)
        # By hash, then by size: the larger partners of an entry follow it, as far as they may be alike.
        order = np.lexsort((key, size, h))
        key, size, h, p = key[order], size[order], h[order], p[order]
        classes, key = np.unique(key, return_inverse=True)
        both = h.astype(np.int64) << 31 | size
        last = np.searchsorted(both, h.astype(np.int64) << 31 | np.floor(size / threshold + 1e-9).astype(np.int64), side="right")
        # The first hash that alike classes share stands in the shorter prefix of the smaller one.
        fan = np.where(p < size - np.ceil(2 * threshold / (1 + threshold) * size - 1e-9) + 1, last - np.arange(len(h)) - 1, 0)
        start, held = 0, [_summed(*(np.empty(0, np.int64),) * 6)]
        while start < len(h):
            total = np.cumsum(fan[start : start + 500_000])
            stop = start + max(1, int(np.searchsorted(total, PAIR_CHUNK, side="right")))
            f = fan[start:stop]
            left = np.repeat(np.arange(start, min(stop, len(h))), f)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(f) - f, f)
            # Shared hashes before this one are no more than the places before it, those after it no more than the places left.
            ahead = np.minimum(p[left] + size[left] // 256, p[right] + size[right] // 256) + 1
            ok = (ahead + 1 + np.minimum(size[left] - p[left], size[right] - p[right]) >= (size[left] + size[right]) * (threshold / (1 + threshold))) & (key[left] != key[right])
            left, right = left[ok], right[ok]
            held.append(_summed(key[left] * len(classes) + key[right], np.ones(len(left), np.int64), p[left], p[right], size[left], size[right]))
            if sum(len(x[0]) for x in held) > 4 * PAIR_CHUNK:
                held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
            start = stop
        pair, m, pa_, pb, na, nb = _summed(*(np.concatenate(x) for x in zip(*held)))
        for lo in range(0, len(pair), 200_000):
            s = slice(lo, lo + 200_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes[pair[s] // len(classes)]), pa.array(classes[pair[s] % len(classes)]), *(pa.array(x[s].astype(np.int32)) for x in (m, pa_, pb, na, nb))],
                names=["a", "b", "m", "pa", "pb", "na", "nb"],
            )

    return _per_group(work)


def _summed(pair: np.ndarray, m: np.ndarray, pa_: np.ndarray, pb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(pair):
        return pair, m, pa_, pb, na, nb
    order = np.argsort(pair, kind="stable")
    pair, m, pa_, pb, na, nb = (x[order] for x in (pair, m, pa_, pb, na, nb))
    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    return pair[start], np.add.reduceat(m, start), np.maximum.reduceat(pa_, start), np.maximum.reduceat(pb, start), na[start], nb[start]


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = unpack(x), unpack(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= threshold * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return run


def _few(df: DataFrame) -> DataFrame:
    """``df`` for a join, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES else df


def alike_classes(docs: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` of class keys whose sets have a Jaccard similarity of ``threshold`` or more.

    ``docs`` is a written table with ``no`` (a number of its own for each row),
    ``ck`` (class key) and ``sets`` (packed hashes); rows of one class count
    once, empty sets belong to no pair.
    """
    first = docs.groupBy("ck").agg(F.min("no").alias("no"), F.count(F.lit(1)).alias("rows"))
    again = docs.join(_few(first.where("rows > 1")).withColumnRenamed("no", "least"), "ck").where(F.col("no") > F.col("least")).select("no")
    single = docs.join(_few(written(again, "again")), "no", "left_anti").withColumn("n", (F.length("sets") / _WIDTH).cast("int"))
    entries = docs.agg(F.coalesce(F.sum(F.length("sets")), F.lit(0))).first()[0] // _WIDTH
    n_regions = int(max(12, -(-entries // REGION_ENTRIES)))
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_regions)
    grouped = lambda df, by: df.repartition(width, by).sortWithinPartitions(by)
    by_bucket = "c int, o int, no binary, h binary, df binary"
    regions = single.select("no", "sets").mapInArrow(_sets_by_region(n_regions), "r int, no binary, h binary")
    shared = grouped(regions, "r").mapInArrow(_shared(n_regions), by_bucket).unionByName(single.select("no", "n").mapInArrow(_sizes(n_regions), by_bucket))
    prefixes = grouped(shared, "c").mapInArrow(_prefixes(threshold), "r int, no binary, h binary, size binary, p binary")
    matches = grouped(prefixes, "r").mapInArrow(_matches(threshold), "a bigint, b bigint, m int, pa int, pb int, na int, nb int")
    both = matches.groupBy("a", "b").agg(F.sum("m").alias("m"), *[F.max(c).alias(c) for c in ("pa", "pb", "na", "nb")])
    # What is not matched yet lies behind the last match and behind the prefix that ends first; the smaller one's is shorter.
    behind_a = F.ceil(F.col("na") * (2 * threshold / (1 + threshold)) - 1e-9) - 1
    behind_b = F.ceil(F.col("nb") * threshold - 1e-9) - 1
    rest = F.greatest(F.least(behind_a, F.col("nb") - 1 - F.col("pb")), F.least(behind_b, F.col("na") - 1 - F.col("pa")))
    enough = F.col("m") + rest >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-6
    pairs = written(both.where(enough).select("a", "b"), "candidates")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct()
    sets = docs.select("no", "ck", "sets").join(_few(needed), "no", "left_semi")
    side = lambda x: sets.select(F.col("no").alias(x), F.col("ck").alias(f"c{x}"), F.col("sets").alias(f"s{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("ca", "cb", "sa", "sb")
    return joined.mapInArrow(_verified(threshold), "a bigint, b bigint")
