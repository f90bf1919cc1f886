"""Centroid clustering filtered by n-simplex projection.

A few pivots span a base simplex. The distances of a vector to the pivots, computed once and
written beside it, become the coordinates of an apex over that base: one coordinate per edge of
the base and, last, its height above it. Two apexes give a lower bound of the distance of their
vectors (heights on the same side) and an upper bound (heights on opposite sides). In each round
only centroids whose lower bound does not pass the least upper bound are compared, by exact
integer distances.

The driver holds centroids and pivots (a documented number of them) and sums of their size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, settle
from .vectors import SMALL, arrays, distances, finite, floored, group_sums, matrix, summed

CENTROIDS = 16
ROUNDS = 3
SCALE = 64
DIMENSION = 64
PIVOTS = 8  # at most; also the number of cached distances of a vector
FLAT = 1e-6  # a pivot lower than this share of its edge above the others would make the base flat
SLICE = 4096  # rows bounded and compared at a time
SLACK = 1e-7  # of the squared lengths at hand: rounding of a bound must not lose a centroid


def base_of(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivots out of ``points`` and their base simplex: row i holds the coordinates of pivot i + 1
    over the pivots before it, the first pivot lies at the origin.

    Taken in the order given; a point that lies in the span of those already taken is passed over.
    """
    pivots, base = points[:1], np.zeros((0, 0))
    for p in points[1:]:
        if len(pivots) == most:
            break
        d = distances(p[None, :], pivots).astype(np.float64)
        flat, height = project(d, base)
        if height[0] > FLAT * np.sqrt(max(d.max(), 1.0)):
            base = np.block([[base, np.zeros((len(base), 1))], [flat, height[:, None]]])
            pivots = np.vstack([pivots, p[None, :]])
    return pivots, base


def project(d: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in the base and heights of apexes, from squared distances to the pivots.

    For the pivot p_i at row b_i of the base, 2 b_i . y = d_0 - d_i + |b_i|^2.
    """
    if not len(base):
        return np.zeros((len(d), 0)), np.sqrt(d[:, 0])
    right = 0.5 * (d[:, :1] - d[:, 1:] + (base * base).sum(axis=1)[None, :])
    flat = np.linalg.solve(base, right.T).T  # lower triangular, its diagonal is bounded away from 0
    return flat, np.sqrt(np.maximum(d[:, 0] - (flat * flat).sum(axis=1), 0.0))


def bounds(x: tuple[np.ndarray, np.ndarray], c: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of the apexes ``x`` to the apexes ``c``."""
    flat = ((x[0][:, None, :] - c[0][None, :, :]) ** 2).sum(axis=2)
    return flat + (x[1][:, None] - c[1][None, :]) ** 2, flat + (x[1][:, None] + c[1][None, :]) ** 2


def nearest(x: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the smaller number of equals), its exact squared distance, and how many
    distances were computed."""
    own = distances(centroids, pivots).astype(np.float64)
    lower, upper = bounds(project(cached.astype(np.float64), base), project(own, base))
    slack = SLACK * (1.0 + cached.max(axis=1, initial=0) + own.max(initial=0.0))
    row, k = np.nonzero(lower <= upper.min(axis=1)[:, None] + slack[:, None])  # rows in order, centroids ascending
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * top * top * max(1, x.shape[1]) < SMALL else np.int64
    apart = x.astype(kind)[row] - centroids.astype(kind)[k]
    d = np.einsum("ij,ij->i", apart, apart).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    least = np.minimum.reduceat(d, first)
    size = np.diff(np.append(first, len(row)))
    hit = np.flatnonzero(d == np.repeat(least, size))
    best = np.full(len(x), -1)
    best[row[hit][::-1]] = k[hit][::-1]  # the first of equals is written last
    return best, least, len(row)


def cache(pivots_of) -> Callable:
    """Squared distances of every row to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = pivots_of.value
        for batch in batches:
            d = distances(matrix(batch.column("v")), pivots)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), arrays(d, pa.int64())], names=["id", "v", "d"])

    return run


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


def sum_up(model) -> Callable:
    """Rows and componentwise sums of every centroid's vectors in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, pivots, base = model.value
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in slices(batches):
            v = matrix(batch.column("v"))
            best, _, _ = nearest(v, matrix(batch.column("d")), centroids, pivots, base)
            n, s = group_sums(best, v, len(centroids))
            counts += n
            sums += s
        held = np.flatnonzero(counts)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held]), arrays(sums[held], pa.int64())], names=["cluster", "n", "sums"])

    return run


def assign(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            best, d, _ = nearest(matrix(batch.column("v")), matrix(batch.column("d")), *model.value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def cluster(
    df: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIMENSION, pivots: int = PIVOTS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Kept are vectors of exactly ``dim`` components, none null or non-finite. Components beyond
    2**27 after scaling are held there. Repeated rows are rows of their own, also as starts (rows
    of one hash stand in the order of their components). A row without an id starts no centroid
    but is assigned like any other; where no kept row has an id there is no centroid and no row
    comes back. With fewer rows than centroids there are fewer of them. An empty table gives no
    rows; other columns are not read.
    """
    spark = df.sparkSession
    kind = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    x = F.col(vector_col)
    rows = df.filter(finite(x) & (F.size(x) == dim)).select(F.col(id_col).cast("long").alias("id"), floored(x, scale).alias("v"))
    kept = settle(rows, "cluster-rows")
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    start = kept.filter("id is not null").orderBy(hashed, "v").select("v").limit(centroids).collect()
    if not start:
        discard(kept)
        return spark.createDataFrame([], kind)
    now = np.array([r.v for r in start], np.int64)
    points, base = base_of(now, pivots)
    held = settle(kept.mapInArrow(cache(spark.sparkContext.broadcast(points)), "id long, v array<int>, d array<long>"), "cluster-pivots")
    discard(kept)
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((now, points, base))
        each = held.select("v", "d").mapInArrow(sum_up(model), "cluster int, n long, sums array<long>")
        sums = each.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        new = now.copy()
        for r in sums.collect():  # at most centroids x components
            new[r.cluster, r["at"]] = r.s // r.n  # whole numbers of Python: floors go down
        model.unpersist()
        if (new == now).all():  # later rounds change nothing
            break
        now = new
    model = spark.sparkContext.broadcast((now, points, base))
    done = settle(held.mapInArrow(assign(model), "vec_id long, cluster int, distance long"), "cluster-assigned")
    discard(held)
    totals = done.groupBy("cluster").agg(summed("distance").alias("t")).collect()  # at most one row a centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    every = min(sum(r.t for r in totals), 2**63 - 1)
    facts = spark.createDataFrame([(r.cluster, r.t, every, digest[r.cluster]) for r in totals], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds() -> str:
    out = []
    for k in range(ROUNDS + 1):
        out.append(f"""
a{k} as materialized (
  select r, min(d * {CENTROIDS} + e) as m from (
    select v.r, c.e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept v, c{k} c) group by r)""")
        if k < ROUNDS:
            out.append(f"""
s{k} as materialized (
  select e, i, sum(y)::bigint as s, count(*) as n from (
    select a.m % {CENTROIDS} as e, unnest(v.x) as y, unnest(range(1, len(v.x) + 1)) as i from a{k} a join kept v on a.r = v.r) group by e, i),
c{k + 1} as materialized (
  select c.e, coalesce(u.x, c.x) as x from c{k} c left join (
    select e, list((s - ((s % n + n) % n)) // n order by i) as x from s{k} group by e) u on c.e = u.e)""")
    return ",".join(out)


#: DuckDB SQL for the rows of ``op13_simplex_clusters``.
ORACLE = f"""
with kept as materialized (
  select row_number() over (order by vec_id, embedding) as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as x
  from embeddings where len(embedding) = {DIMENSION} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as materialized (
  select row_number() over (order by sha256('1:' || vec_id), x) - 1 as e, x from kept where vec_id is not null qualify e < {CENTROIDS}),{_rounds()},
done as (select k.vec_id, (a.m % {CENTROIDS})::int as cluster, (a.m // {CENTROIDS})::bigint as distance from a{ROUNDS} a join kept k on a.r = k.r)
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from done join c{ROUNDS} c on done.cluster = c.e
"""
