"""Vector codes and centroid clusters against plain versions that look at every entry."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from kerbline.llm import centroids, codebooks, vectors

NAN, INF = float("nan"), float("inf")


def usable(v, dim) -> bool:
    return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)


def apart(a, b) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


def lloyd(points: list, start: list, rounds: int) -> tuple[list, list]:
    """Codebook and ``(distance, index)`` of every point by full scans."""
    book = [list(c) for c in start]
    find = lambda: [min((apart(p, c), k) for k, c in enumerate(book)) for p in points]
    for _ in range(rounds):
        at = find()
        for k in range(len(book)):
            own = [p for p, (_, j) in zip(points, at) if j == k]
            if own:
                book[k] = [sum(col) // len(own) for col in zip(*own)]
    return book, find()


def odd_rows(rng, dim: int, n: int) -> list:
    rows = [(i, rng.normal(size=dim).round(1).tolist(), int(rng.integers(3))) for i in range(n)]
    rows += [(i, [0.5] * dim, None) for i in range(n, n + n // 2)]  # a third of all rows are one vector
    rows += [(5, rows[5][1], 7), (5, rows[6][1], None), (None, [0.25] * dim, 1), (9000, [3.0] * dim, None)]
    rows += [(9001, None, 1), (9002, [None] * dim, 1), (9003, [NAN] * dim, 1), (9004, [INF] + [0.0] * (dim - 1), 1), (9005, [], 1), (9006, [1.0, 2.0, 3.0], 1)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, code int, id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)


def test_codes_match_full_scans(spark):
    rng = np.random.default_rng(3)
    rows = odd_rows(rng, 8, 120)
    got = sorted(map(tuple, codebooks.compress(frame(spark, rows), entries=16, rounds=3, scale=8).collect()), key=str)
    kept = [(i, [math.floor(8 * x) for x in v], k) for i, v, k in rows if usable(v, 8)]
    start = sorted((i, v) for i, v, _ in kept if i is not None)[:16]
    code, error, flat = [""] * len(kept), [0] * len(kept), []
    for p in range(4):
        cut = slice(2 * p, 2 * p + 2)
        book, at = lloyd([v[cut] for _, v, _ in kept], [v[cut] for _, v in start], 3)
        flat += [x for c in book for x in c]
        for r, (d, k) in enumerate(at):
            code[r] += f"{k:02x}"
            error[r] += d
    total: dict = {}
    for (_, _, k), e in zip(kept, error):
        total[k] = total.get(k, 0) + e
    digest = hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()
    assert got == sorted(((i, c, e, total[k], digest) for (i, _, k), c, e in zip(kept, code, error)), key=str)


def test_codes_of_few_or_no_rows(spark):
    got = codebooks.compress(frame(spark, [(2, [0.1, -0.2, 0.3, 1e300], None), (1, [1.0] * 4, None)])).collect()
    assert {r.vec_id: r.code for r in got} == {1: "00000000", 2: "01010101"} and all(r.error == r.label_error == 0 for r in got)
    assert codebooks.compress(frame(spark, [(None, [1.0] * 4, 1)])).count() == 0
    assert codebooks.compress(frame(spark, [(1, None, 1)])).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert codebooks.compress(empty).count() == 0 and codebooks.compress(empty).columns[0] == "vec_id"


def test_reassigning_keeps_ties_low_and_skips_fixed_entries():
    rng = np.random.default_rng(0)
    for _ in range(60):
        x, book = rng.integers(-3, 4, (200, 2)), rng.integers(-3, 4, (12, 2))
        code, dist = codebooks.nearest(x, book)
        moved = rng.random(12) < 0.3
        book = book.copy()
        book[moved] += rng.integers(-2, 3, (int(moved.sum()), 2))
        again, d, rescans = codebooks.reassign(x, book, moved, code, dist)
        full = codebooks.nearest(x, book)
        assert (again == full[0]).all() and (d == full[1]).all()
        assert rescans == moved[code].sum()  # all others looked at moved entries only


def test_distances_are_exact_beyond_doubles():
    rng = np.random.default_rng(1)
    x, c = (rng.integers(-(1 << 27), 1 << 27, (n, 16)) for n in (20, 5))
    assert vectors.distances(x, c).tolist() == [[apart(a, b) for b in c.tolist()] for a in x.tolist()]


def test_totals_of_hot_keys_are_dealt_over_tasks(spark):
    """Two hot keys, one of them null, beside many small ones."""
    rows = [(i, 1 if i % 3 == 0 else None if i % 3 == 1 else i, i) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, label int, error long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = vectors.with_total(df, "label", "error", "t")
        got = out.collect()
        tasks = [r["count"] for r in out.filter("label is null").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(rows) and all(t == sum(e for _, k, e in rows if k == label) for _, label, _, t in got)
    assert sum(tasks) == 400 and max(tasks) < 200
    assert vectors.with_total(df.limit(0), "label", "error", "t").count() == 0


def test_clusters_match_full_scans(spark):
    rng = np.random.default_rng(4)
    rows = odd_rows(rng, 6, 150)
    df = frame(spark, rows)
    got = sorted(map(tuple, centroids.cluster(df, centroids=7, scale=8, dim=6, pivots=4).collect()), key=str)
    kept = [(i, [math.floor(8 * x) for x in v]) for i, v, _ in rows if usable(v, 6)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:7]
    book, at = lloyd([v for _, v in kept], [v for _, v in start], 3)
    inertia = [sum(d for d, j in at if j == k) for k in range(7)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book]
    assert got == sorted(((i, k, d, inertia[k], sum(inertia), sha[k]) for (i, _), (d, k) in zip(kept, at)), key=str)
    assert centroids.cluster(df.limit(0)).count() == 0 and centroids.cluster(frame(spark, [(None, [0.0] * 64, 1)])).count() == 0
    few = centroids.cluster(frame(spark, [(1, [0.5] * 64, 1), (1, [0.5] * 64, 1)])).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in few] == [(0, 0, 0)] * 2  # ties go to the smaller number


def test_simplex_bounds_hold_and_filter():
    rng = np.random.default_rng(2)
    centre = rng.integers(-60, 60, (16, 64))
    x = (centre[rng.integers(0, 16, 3000)] + rng.integers(-9, 10, (3000, 64))).astype(np.int64)
    points, base = centroids.base_of(np.vstack([centre[:1], centre[:1], centre]), 8)  # a repeated point is no second pivot
    assert len(points) == 8 and base.shape == (7, 7) and (np.triu(base, 1) == 0).all()
    cached, true = vectors.distances(x, points), vectors.distances(x, centre)
    low, high = centroids.bounds(centroids.project(cached.astype(float), base), centroids.project(vectors.distances(centre, points).astype(float), base))
    assert (low <= true * (1 + 1e-9) + 1e-6).all() and (high >= true * (1 - 1e-9) - 1e-6).all()
    best, d, compared = centroids.nearest(x, cached, centre, points, base)
    assert (best == true.argmin(axis=1)).all() and (d == true.min(axis=1)).all()
    assert compared < 0.4 * true.size  # the bounds exclude most centroids


def test_points_on_a_line_need_two_pivots():
    line = np.outer(np.arange(5), [1, 2, 3, 4])
    points, base = centroids.base_of(line, 8)
    assert len(points) == 2 and base.shape == (1, 1)
    best, d, _ = centroids.nearest(line, vectors.distances(line, points), line, points, base)
    assert best.tolist() == list(range(5)) and not d.any()
