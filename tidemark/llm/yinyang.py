"""Exact k-means with one lower bound per group of centroids (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpoint_path, drop_table, ship_package

#: Integers beyond this are set to it, so that squared distances fit into 64 bits.
LARGEST = 1 << 27
#: Bounds are widened by this share, far over the rounding of doubles, before a filter trusts them.
SLACK = 1e-9
STATE = "v array<int>, was int, cluster int, upper double, lower array<double>, distance long"


def group_centroids(c: np.ndarray, size: int = 10, rounds: int = 5) -> np.ndarray:
    """The group of every centroid: a few rounds of k-means over the centroids themselves, about ``size`` to a group."""
    t = max(1, len(c) // size)
    heads = c[:t].astype(float)
    for _ in range(rounds):
        d = ((c[:, None, :] - heads[None]) ** 2).sum(2)
        group = d.argmin(1)
        heads = np.stack([c[group == g].mean(0) if (group == g).any() else heads[g] for g in range(t)])
    return np.unique(group, return_inverse=True)[1]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid, or to a centroid each, exactly."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def first_bounds(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper bound and the lower bound per group (without the own centroid) of rows that have none yet."""
    d = np.stack([squared(x, y) for y in c], axis=1)
    a = d.argmin(1)
    far = np.sqrt(d.astype(float))
    upper = far[np.arange(len(x)), a]
    far[np.arange(len(x)), a] = np.inf
    return a, upper, np.stack([far[:, group == g].min(1) for g in range(group.max() + 1)], axis=1)


def next_bounds(
    x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, group: np.ndarray, drift: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds after the centroids have moved by ``drift`` to ``c``, and how many distances that took.

    Global filter: a row whose upper bound is under all its lower bounds keeps its centroid, at first by
    the old distance plus the drift, then by its exact distance. Group filter: a group whose bound is
    above the distance is left out. In the groups left, a centroid whose own drift cannot have brought
    it near is left out too; all others are measured exactly. Only a bound strictly above the distance
    filters, so ties are always measured, and the smaller number wins.
    """
    most = np.array([drift[group == g].max() for g in range(group.max() + 1)])
    before, a = lower, a.copy()
    upper = (upper + drift[a]) * (1 + SLACK)
    lower = (lower - most) * (1 - SLACK) - SLACK
    live = np.flatnonzero(upper >= lower.min(1))
    took = len(live)
    near = squared(x[live], c[a[live]])
    upper[live] = np.sqrt(near.astype(float)) * (1 + SLACK)
    still = upper[live] >= lower[live].min(1)
    live, near = live[still], near[still]
    if not len(live):
        return a, upper, lower, took
    best, at, old = near.copy(), a[live].copy(), a[live]
    bound = np.full((len(live), len(c)), np.inf)
    for k in range(len(c)):
        g = group[k]
        seen = (lower[live, g] <= upper[live]) & (old != k)
        bound[:, k] = np.where(seen, (before[live, g] - drift[k]) * (1 - SLACK) - SLACK, np.inf)
        rows = np.flatnonzero(seen & (bound[:, k] <= upper[live]))
        took += len(rows)
        d = squared(x[live[rows]], c[k])
        bound[rows, k] = np.sqrt(d.astype(float)) * (1 - SLACK)
        wins = (d < best[rows]) | ((d == best[rows]) & (k < at[rows]))
        best[rows[wins]], at[rows[wins]] = d[wins], k
    bound[np.arange(len(live)), old] = np.sqrt(near.astype(float)) * (1 - SLACK)
    bound[np.arange(len(live)), at] = np.inf
    for g in range(group.max() + 1):
        opened = lower[live, g] <= upper[live]
        inside = bound[:, group == g].min(1)
        left = (group[old] == g) & (old != at)  # the centroid a row leaves bounds its group from now on
        lower[live, g] = np.where(opened, inside, np.where(left, np.minimum(lower[live, g], inside), lower[live, g]))
    a[live], upper[live] = at, np.sqrt(best.astype(float)) * (1 + SLACK)
    return a, upper, lower, took


def _pass(c: np.ndarray, group: np.ndarray, drift: np.ndarray | None, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column("v").flatten()
            x = flat.to_numpy().astype(np.int64).reshape(b.num_rows, -1)
            if drift is None:
                was = np.full(b.num_rows, -1)
                a, upper, lower = first_bounds(x, c, group)
            else:
                was = b.column("cluster").to_numpy().astype(np.int64)
                lower = b.column("lower").flatten().to_numpy().reshape(b.num_rows, -1)
                a, upper, lower, _ = next_bounds(x, was, b.column("upper").to_numpy(), lower, c, group, drift)
            d = squared(x, c[a]) if last else np.zeros(len(x), np.int64)
            offsets = pa.array(np.arange(0, lower.size + 1, lower.shape[1], dtype=np.int32))
            made = [b.column("v"), pa.array(was, pa.int32()), pa.array(a, pa.int32()), pa.array(upper), pa.ListArray.from_arrays(offsets, pa.array(lower.ravel())), pa.array(d)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["__id", "v", "was", "cluster", "upper", "lower", "distance"])

    return run


def _moves(state: DataFrame, dims: int) -> DataFrame:
    """Per centroid what joined it less what left it: count and componentwise sums, one row a centroid."""
    both = state.where("cluster <> was").select("v", F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("s")))).alias("__m"))
    both = both.where("__m.c >= 0").select(F.col("__m.c").alias("c"), F.col("__m.s").cast("long").alias("s"), "v")
    return both.groupBy("c").agg(F.sum("s").alias("n"), F.array(*[F.sum(F.col("s") * F.col("v")[i]) for i in range(dims)]).alias("sums"))


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(__id, v): vectors with ``dims`` components, none null or not finite, as integers floor(scale * x)."""
    x: Column = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda y: F.greatest(F.least(F.floor(y * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return vectors.where(F.size(x) == dims).where(finite).select(F.col(id_col).alias("__id"), whole.alias("v"))


def yinyang_clusters(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", group_size: int = 10, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Clusters of integer vectors by ``rounds`` of k-means and a last assignment, exact as if every distance were taken.

    Centroids start as the ``k`` vectors of least SHA-256 of salt and id (equal hashes: by vector; null
    ids last) and are put into groups once. A vector carries its cluster, an upper bound of the distance
    to it and one lower bound per group from pass to pass; each pass is a map over its rows without a
    shuffle, written to the shared folder. Centroids stay whole sums of integers: only vectors that have
    changed cluster are added and subtracted, so the driver sees k rows a round.

    Vectors of another length, or with a null or non-finite component, are left out; integers beyond
    2^27 count as 2^27. Fewer vectors than ``k`` give as many centroids; repeated ids are rows of their
    own; other columns are ignored; an empty table gives no rows. Returns id, cluster, distance
    (squared), cluster_inertia, inertia, centroid_sha256.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable_vectors(vectors, id_col, vec_col, dims, scale)
    first = F.sha2(F.concat(F.lit(salt), F.col("__id").cast("string")), 256)
    seeds = rows.select(first.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    c = np.array([r.v for r in seeds], np.int64).reshape(len(seeds), dims)
    kind = vectors.schema[id_col].dataType.simpleString()
    folder = f"{checkpoint_path(spark)}/yinyang-{uuid4().hex}"
    state, drift = rows, None
    if seeds:
        group = group_centroids(c, group_size)
        n, sums = [0] * len(c), [[0] * dims for _ in c]
        for r in range(rounds + 1):
            state.mapInArrow(_pass(c, group, drift, r == rounds), f"__id {kind}, {STATE}").write.parquet(f"{folder}/{r}")
            state = spark.read.parquet(f"{folder}/{r}")
            if r:
                drop_table(spark, f"{folder}/{r - 1}")
            if r == rounds:
                break
            for m in _moves(state, dims).collect():
                n[m.c] += m.n
                sums[m.c] = [a + b for a, b in zip(sums[m.c], m.sums)]
            moved = np.array([[s // n[j] for s in sums[j]] if n[j] else c[j] for j in range(len(c))], np.int64)
            drift, c = np.sqrt(squared(moved, c).astype(float)) * (1 + SLACK), moved
    else:
        state = rows.select("__id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
    spent = {r.cluster: int(r.d) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = sum(spent.values())
    about = [(j, spent[j], total, hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j in sorted(spent)]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.select(F.col("__id").alias(id_col), "cluster", "distance").join(F.broadcast(about), "cluster")
    return out.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
