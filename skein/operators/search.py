"""Vector search and clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.stats import components
from skein.shared import written

#: Queries searched at a time (shipped to every task; 64 floats each take 0.5 KB).
QUERY_BLOCK = 20_000
#: Vectors that one region of a neighbour join should hold, and pivots at most (shipped to every task).
ROWS_PER_REGION, MAX_PIVOTS = 2_000, 2_000
#: Vectors that the exact hierarchical clustering takes (distances take 8 n^2 bytes).
MAX_WARD = 4_000


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return q @ x.T
    if metric == "cosine":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.divide(q @ x.T, n, out=np.zeros((len(q), len(x))), where=n > 0)
    if metric == "euclidean":
        d2 = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T)
        return 1 / (1 + np.sqrt(np.maximum(d2, 0)))
    raise ValueError(f"unknown metric {metric!r}")


def _searcher(ids: list, vectors: np.ndarray, k: int, metric: str, threshold: float | None):
    """The best ``k`` of every batch for each query; ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine = np.array(b.column(0).to_pylist(), np.int64)
            lists = b.column(1).to_pylist()
            ok = np.array([v is not None and len(v) == vectors.shape[1] and None not in v for v in lists], bool)
            if not ok.any():
                continue
            mine, x = mine[ok], np.array([v for v, o in zip(lists, ok) if o], np.float64)
            out: list[tuple] = []
            for lo in range(0, len(ids), 256):
                s = _scores(x, vectors[lo : lo + 256], metric)
                s6 = np.round(s, 9)
                for r, row in enumerate(s6):
                    order = np.lexsort((mine, -row))[:k]
                    out += [(ids[lo + r], int(mine[j]), float(s[r, j])) for j in order if threshold is None or s[r, j] >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["query_id", "vec_id", "similarity"])

    return run


def search(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", top_k: int = 10, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """Exact top-k of every query: ``(query_id, vec_id, similarity, rank)``, ties by id.

    The query set is shipped in blocks of bounded size, every block against all
    rows; a task keeps the best k of each batch, so that what is shuffled does
    not grow with the table.  Null vectors and ones of another length match
    nothing.  Similarities below ``threshold`` are left out.
    """
    asked = queries.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).where("k is not null and v is not null")
    n = asked.count()
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).where(F.col("k").isNotNull())
    out = None
    blocks = max(1, -(-n // QUERY_BLOCK))
    for block in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block)).orderBy("k").collect()
        width = max((len(r["v"]) for r in part), default=1)
        part = [r for r in part if len(r["v"]) == width]
        found = rows.mapInArrow(_searcher([r["k"] for r in part], np.array([r["v"] for r in part], np.float64).reshape(len(part), width), top_k, metric, threshold), "query_id bigint, vec_id bigint, similarity double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def _regions(pivots: np.ndarray, reach: float):
    """Each row to the region of its nearest pivot, and to those where a partner within ``reach`` (an angle) may be at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1).to_pylist()
            ok = np.array([len(v) == pivots.shape[1] and None not in v for v in lists], bool)
            if not ok.any():
                continue
            x = np.array([v for v, o in zip(lists, ok) if o], np.float64)
            angle = np.arccos(np.clip(_scores(x, pivots, "cosine").T, -1, 1))
            home = angle.argmin(axis=1)
            row, region = np.nonzero(angle <= angle.min(axis=1)[:, None] + 2 * reach + 1e-9)
            at = np.flatnonzero(ok)[row]
            yield pa.RecordBatch.from_arrays([pa.array(region.astype(np.int32)), pa.array(home[row].astype(np.int32)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["r", "home", "k", "v"])

    return run


def _within(eps: float):
    """Pairs of a region, one of them at home in it; pairs of two homes come from the lesser one's region."""

    def work(region: int, home: list, keys: list, vs: list) -> Iterator[pa.RecordBatch]:
        home, keys, x = np.array(home), np.array(keys, np.int64), np.array(vs, np.float64)
        mine = np.flatnonzero(home == region)
        for lo in range(0, len(mine), 256):
            part = mine[lo : lo + 256]
            i, j = np.nonzero(1 - _scores(x, x[part], "cosine") <= eps)
            i = part[i]
            keep = np.where(home[j] == region, keys[i] < keys[j], home[j] > region)
            a, b = keys[i[keep]], keys[j[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, ([], [], [])
        for batch in batches:
            for r, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if r != current and held[0]:
                    yield from work(current, *held)
                    held = ([], [], [])
                current = r
                for column, x in zip(held, row):
                    column.append(x)
        if held[0]:
            yield from work(current, *held)

    return run


def near_pairs(vectors: DataFrame, *, eps: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Pairs ``(a, b)``, a < b, of different vectors within a cosine distance of ``eps``, exact.

    Pivots drawn by a hash (at most ``MAX_PIVOTS``) divide the rows into
    regions; by the triangle inequality of angles a row goes to every region
    where a partner may be at home as well, so that each region joins on its own.
    The wider ``eps``, the more regions a row goes to.  Null vectors, and those
    of another length than the pivots, belong to no pair.
    """
    rows = written(vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).where("k is not null and v is not null"), "vectors")
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("k"), "k").limit(int(min(MAX_PIVOTS, max(1, n // ROWS_PER_REGION)))).collect()
    width = max((len(r["v"]) for r in drawn), default=1)
    pivots = np.array([r["v"] for r in drawn if len(r["v"]) == width and None not in r["v"]] or [[0.0] * width], np.float64)
    placed = rows.mapInArrow(_regions(pivots, float(np.arccos(max(-1.0, 1 - eps)))), "r int, home int, k bigint, v array<double>" if dict(rows.dtypes)["v"] == "array<double>" else "r int, home int, k bigint, v array<float>")
    return placed.repartition("r").sortWithinPartitions("r").mapInArrow(_within(eps), "a bigint, b bigint")


def dbscan(vectors: DataFrame, *, eps: float = 0.5, min_samples: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Density clustering under the cosine distance: ``(vec_id, cluster)``.

    A cluster is named by its least core id; a border point joins its least
    neighbouring core's cluster; noise has -1.  Equal vectors are one point with
    a count, so that a group of copies is never paired with itself.
    """
    every = vectors.select(F.col(key).cast("long").alias("a"), F.col(vector).alias("v")).where("a is not null")
    points = written(every.where("v is not null").groupBy("v").agg(F.min("a").alias("k"), F.count_distinct("a").alias("n")), "points")
    pairs = written(near_pairs(points, eps=eps, key="k", vector="v"), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = points.select(F.col("k").alias("b"), "n")
    around = both.join(sizes, "b").groupBy("a").agg(F.sum("n").alias("near"))
    core = points.select(F.col("k").alias("a"), "n").join(around, "a", "left").where(F.col("n") + F.coalesce("near", F.lit(0)) >= min_samples).select("a")
    links = both.join(core, "a", "left_semi").join(core.withColumnRenamed("a", "b"), "b", "left_semi")
    text = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    named = components(core.select(text("a").alias("node_id")), links.select(text("a").alias("source_node_id"), text("b").alias("target_node_id")))
    cores = named.select(F.col("node_id").cast("long").alias("a"), F.col("component").cast("long").alias("cluster"))
    border = both.join(cores.withColumnRenamed("a", "b"), "b").join(core, "a", "left_anti").groupBy("a").agg(F.min(F.struct("b", "cluster"))["cluster"].alias("cluster"))
    found = cores.unionByName(border).join(points.select(F.col("k").alias("a"), "v"), "a").select("v", "cluster")
    return every.select("a", "v").distinct().join(found, "v", "left").groupBy(F.col("a").alias(key)).agg(F.coalesce(F.min("cluster"), F.lit(-1)).alias("cluster"))


def kmeans(vectors: DataFrame, k: int, *, seed: int = 42, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, cluster)`` by k-means; fewer than two vectors give no rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    n = rows.count()
    if n < 2:
        return rows.select(key, F.lit(0).alias("cluster")).limit(0)
    return KMeans(k=min(k, n), seed=seed, maxIter=20).fit(rows).transform(rows).select(key, F.col("prediction").alias("cluster"))


def bisecting(vectors: DataFrame, k: int, *, seed: int = 42, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Hierarchical clustering from the top, for any number of vectors."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    return BisectingKMeans(k=k, seed=seed).fit(rows).transform(rows).select(key, F.col("prediction").alias("cluster"))


def ward(vectors: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Agglomerative clustering with Ward's criterion; more than ``MAX_WARD`` vectors are an error (:func:`bisecting` takes any number)."""
    rows = vectors.select(F.col(key).cast("long").alias(key), F.col(vector).alias("v")).where(F.col(key).isNotNull() & F.col("v").isNotNull())
    if (n := rows.count()) > MAX_WARD:
        raise ValueError(f"ward: {n} vectors, at most {MAX_WARD}; bisecting() takes any number, with another method")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vs = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            vs += b.column(1).to_pylist()
        if len(ids) < 2:
            return
        order = np.argsort(ids)
        ids, x = np.array(ids)[order], np.array(vs, np.float64)[order]
        n = len(ids)
        d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1) if n <= 600 else np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T, 0)
        d = d / 2
        np.fill_diagonal(d, np.inf)
        size, label, alive = np.ones(n), np.arange(n), n
        while alive > min(k, n):
            i, j = divmod(int(np.argmin(d)), n)
            i, j = min(i, j), max(i, j)
            a, b = size[i], size[j]
            with np.errstate(invalid="ignore"):
                new = ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / (a + b + size)
            d[i], d[:, i] = new, new
            d[i, i] = np.inf
            d[j], d[:, j] = np.inf, np.inf
            size[i] = a + b
            label[label == j] = i
            alive -= 1
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.unique(label, return_inverse=True)[1].astype(np.int32))], names=[key, "cluster"])

    return rows.repartition(1).mapInArrow(run, f"`{key}` bigint, cluster int")
