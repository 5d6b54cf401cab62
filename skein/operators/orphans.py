"""References to records that do not exist, no longer exist or came later.

Method: keys are range-partitioned (ranges of a 64-bit hash of the key, so that
any key distribution gives even ranges), the parents of a range are stored as
arrays sorted by that hash, batches of reference keys are probed by vectorised
binary search, and hits are compared by the key itself.  References are collapsed to one row per distinct key before they are
shuffled, so no key is hot; only keys with a miss go back to the referring rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.shared import clean_id, parts_for, written

#: Parents whose sorted arrays one range should hold (16 bytes and the key each).
PARENTS_PER_RANGE = 100_000
#: Offending keys up to which they are broadcast to the referring rows (about 70 bytes each).
BROADCAST_KEYS = 200_000

#: Referring rows of one key that one task should join.
ROWS_PER_TASK = 200_000

_LONG_MIN = -(2**63)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, parents first: keep a range's arrays, sorted by hash, and probe what follows."""
    current, hashes, keys, born, gone = None, np.empty(0, np.int64), None, None, None
    for t in batches:
        if t.num_rows == 0:
            continue
        ranges = t.column(0).to_numpy(zero_copy_only=False)
        is_parents = t.column(1).to_numpy(zero_copy_only=False) == 0
        edges = np.flatnonzero(np.diff(ranges) | np.diff(is_parents.astype(np.int8)) | is_parents[1:]) + 1
        for lo, hi in zip([0, *edges], [*edges, len(ranges)]):
            if is_parents[lo]:
                current = ranges[lo]
                held = t.column(2)[lo].values
                hashes, keys = held.field("h").to_numpy(), held.field("id")
                born, gone = (held.field(c).fill_null(_LONG_MIN).to_numpy() for c in ("born", "gone"))
                continue
            h, ids, low, high, n_rows = (t.column(i).slice(lo, hi - lo) for i in range(3, 8))
            h, low, high = h.to_numpy(zero_copy_only=False), low.fill_null(_LONG_MIN).to_numpy(), high.fill_null(_LONG_MIN).to_numpy()
            n = len(h)
            found, b, g = np.zeros(n, bool), np.full(n, _LONG_MIN), np.full(n, _LONG_MIN)
            if current == ranges[lo] and len(hashes):
                at = np.searchsorted(hashes, h)
                open_ = np.flatnonzero((at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == h))
                while len(open_):  # keys of one hash stand side by side
                    same = pc.equal(keys.take(pa.array(at[open_])), ids.take(pa.array(open_))).to_numpy(zero_copy_only=False)
                    hit = open_[same]
                    found[hit], b[hit], g[hit] = True, born[at[hit]], gone[at[hit]]
                    open_ = open_[~same]
                    at[open_] += 1
                    open_ = open_[(at[open_] < len(hashes)) & (hashes[np.minimum(at[open_], len(hashes) - 1)] == h[open_])]
            late = (b != _LONG_MIN) & (low != _LONG_MIN) & (low < b)
            deleted = (g != _LONG_MIN) & (high != _LONG_MIN) & (high >= g)
            out = np.flatnonzero(~found | late | deleted)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(out)), pa.array(found[out]), pa.array(b[out], pa.int64(), mask=b[out] == _LONG_MIN), pa.array(g[out], pa.int64(), mask=g[out] == _LONG_MIN), n_rows.take(pa.array(out))],
                names=["id", "known", "born", "gone", "n"],
            )


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    *,
    fields: tuple[str, ...] = ("source_node_id", "target_node_id"),
    row_key: str = "edge_id",
    stored_at: str = "created_at",
    parent_key: str = "node_id",
    born_at: str = "created_at",
    gone_at: Column | None = None,
) -> DataFrame:
    """References of ``fields`` to keys that ``parents`` lacks, with reason and month.

    Returns distinct ``(edge_id, field_name, reason, month_key)``.  Keys compare
    without surrounding white space and letter case; null or blank keys are no
    references.  ``missing``: no parent has the key; ``late``: the parent was
    created after the referring row; ``deleted``: the parent was removed at or
    before it.  A null time on either side is neither late nor deleted, a row
    without a time has a null month, a null ``row_key`` is kept as null.  If a
    parent key is repeated its earliest creation counts, and its latest removal,
    provided that every repetition is removed.  Empty ``parents`` make every
    reference missing; empty ``refs`` give no rows.  Other columns are ignored.
    """
    if gone_at is None:
        gone_at = F.element_at(F.col("metadata"), "removed_at").try_cast("timestamp_ntz")
    base = refs.select(F.col(row_key).alias("row_key"), F.col(stored_at).alias("at"), *[clean_id(F.col(f)).alias(f"f{i}") for i, f in enumerate(fields)])
    long = base.select("row_key", "at", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"f{i}").alias("id")) for i, f in enumerate(fields)])).alias("r")).select("row_key", "at", "r.*").where(F.col("id").isNotNull())

    kept = (
        parents.select(clean_id(F.col(parent_key)).alias("id"), _micros(F.col(born_at)).alias("born"), _micros(gone_at).alias("gone"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("born").alias("born"), F.when(F.count("gone") == F.count(F.lit(1)), F.max("gone")).alias("gone"))
    )
    n_ranges = parts_for(parents.count(), PARENTS_PER_RANGE)
    in_range = F.shiftright(F.shiftrightunsigned(F.xxhash64("id"), 33) * F.lit(n_ranges), 31).cast("int")
    held = "array<struct<h:bigint,id:string,born:bigint,gone:bigint>>"
    arrays = (
        kept.groupBy(in_range.alias("rng"))
        .agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("id").alias("h"), "id", "born", "gone"))).alias("held"))
        .select("rng", F.lit(0).alias("kind"), F.col("held").cast(held), *[F.lit(None).cast(t).alias(c) for c, t in (("h", "bigint"), ("id", "string"), ("low", "bigint"), ("high", "bigint"), ("n", "bigint"))])
    )
    asked = (
        long.groupBy("id")
        .agg(F.min(_micros(F.col("at"))).alias("low"), F.max(_micros(F.col("at"))).alias("high"), F.count(F.lit(1)).alias("n"))
        .select(in_range.alias("rng"), F.lit(1).alias("kind"), F.lit(None).cast(held).alias("held"), F.xxhash64("id").alias("h"), "id", "low", "high", "n")
    )
    misses = written(
        arrays.unionByName(asked)
        .repartition("rng")
        .sortWithinPartitions("rng", "kind")
        .mapInArrow(_probe, "id string, known boolean, born bigint, gone bigint, n bigint"),
        "misses",
    )
    if misses.count() <= BROADCAST_KEYS:
        back = long.join(F.broadcast(misses), "id")
    else:
        # Keys with very many referring rows are joined in salted parts; they are few, as each has so many rows.
        parts = (F.col("n") / ROWS_PER_TASK).cast("int")
        hot = misses.where(parts > 0).select("id", parts.alias("last"))
        few = hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        placed = long.join(F.broadcast(hot) if few else hot, "id", "left").withColumn("part", F.pmod(F.xxhash64("row_key", "at"), F.coalesce("last", F.lit(0)) + 1).cast("int")).drop("last")
        back = placed.join(misses.withColumn("part", F.explode(F.sequence(F.lit(0), parts))), ["id", "part"])
    at = _micros(F.col("at"))
    reason = F.when(~F.col("known"), "missing").when(F.col("born") > at, "late").when(F.col("gone") <= at, "deleted")
    return (
        back.select(F.col("row_key").alias(row_key), "field_name", reason.alias("reason"), F.date_format("at", "yyyy-MM").alias("month_key"))
        .where(F.col("reason").isNotNull())
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Misses per field, reason and month."""
    return orphans.groupBy("field_name", "reason", "month_key").agg(F.count(F.lit(1)).alias("n_refs"))
