"""Exact top-k inner products over norm buckets.

Candidates are sorted by length and cut into buckets of a bounded size; each bucket travels as
one packed row, and so does each block of queries. A first pass scores every query block against
the bucket of the longest vectors, which gives each query a threshold: its k-th best score so
far. In the second pass a bucket turns the threshold of a query into a local cosine threshold,
threshold / (|query| * longest vector). Above 1 the whole bucket is skipped: only pairs of a block
and a bucket that some query can reach are formed, from lengths and thresholds alone, before any
matrix is sent. Otherwise, where the threshold is high, candidates are pruned by coordinates (the
largest query coordinate bounds the angle), else by length; what is left is verified by exact
products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

BUCKET = 4096  # candidates per bucket, on average
BLOCK = 1024  # queries per block, on average
SCALE = 256
COORDINATE_FROM = 0.8  # local cosine threshold from which coordinates are looked at
EXACT = float(1 << 53)  # products below this are exact in doubles
SLACK = 1e-6  # rounding of the bounds must not prune a tie
STRIP = 16  # blocks of queries that share a copy of a bucket
BINS = 8  # of a doubling of the length; the driver holds the last bucket of each bin


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: floor(256 * x) of every component, repeated rows once.

    Rows without an id, null vectors and vectors with a null or non-finite component are left
    out. An empty vector has only zero products.
    """
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"))
    x = F.col(vector_col)
    fine: Column = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return df.filter(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).distinct()


def packed(df: DataFrame, parts: int) -> DataFrame:
    """One row per range partition of (length, id): ids, matrix, dimension and bounds of the length.

    Vectors of different dimension are filled up with zeros. A third of all rows with one length
    are split by id like any other range.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, rows = [], []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            v = batch.column("v")
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
            rows += np.split(flat, np.cumsum(ends)[:-1])
        if not ids:
            return
        m = np.zeros((len(rows), max(1, *map(len, rows))))
        for k, r in enumerate(rows):
            m[k, : len(r)] = r
        size = np.sqrt((m * m).sum(axis=1))
        order = np.lexsort((np.array(ids), -size))
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "dim": pa.array([m.shape[1]], pa.int32()), "longest": [float(size.max())],
                "ids": [np.array(ids)[order].astype("<i8").tobytes()], "m": [m[order].astype("<f8").tobytes()],
            }
        )

    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    ranged = df.select("vec_id", "v", norm.alias("n")).repartitionByRange(parts, F.desc("n"), F.asc("vec_id"))
    return settle(ranged.select("vec_id", "v").mapInArrow(pack, "part int, dim int, longest double, ids binary, m binary"), "vectors")


def _matrix(raw: bytes, dim: int, width: int) -> np.ndarray:
    m = np.frombuffer(raw, "<f8").reshape(-1, dim)
    return np.pad(m, ((0, 0), (0, width - dim))) if dim < width else m


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer products; where doubles could round, Python integers, held to the range of a long."""
    if len(q) and len(m) and np.abs(q).max() * np.abs(m).max() * q.shape[1] < EXACT:
        return (q @ m.T).astype(np.int64)
    big = np.vectorize(int, otypes=[object])
    exact = big(q) @ big(m).T if len(q) and len(m) else np.zeros((len(q), len(m)))
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best_of(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, floor: np.ndarray | None, k: int) -> list[tuple[int, int, int]]:
    """``(query, candidate, score)``: the k best of a bucket for each query, from ``floor`` up.

    ``floor`` is a score that every result must reach, or None.
    """
    out, size, longest = [], np.sqrt((m * m).sum(axis=1)), 0.0
    qsize = np.sqrt((q * q).sum(axis=1))
    longest = float(size.max(initial=0.0))
    slack = SLACK * (1.0 + qsize * longest)
    asked = np.arange(len(q))
    if floor is not None:
        asked = asked[(floor - slack <= qsize * longest)]  # local threshold at most 1
    if not len(asked):
        return out
    local = np.where(qsize * longest > 0, (floor - slack) / np.maximum(qsize * longest, 1e-300), -1.0) if floor is not None else np.full(len(q), -1.0)
    # by length: sorted descending, so the candidates that can reach the floor are a prefix
    for group in (asked[local[asked] < COORDINATE_FROM], asked[local[asked] >= COORDINATE_FROM]):
        for lo in range(0, len(group), 128):
            part = group[lo : lo + 128]
            reach = len(m)
            if floor is not None:
                need = np.where(qsize[part] > 0, (floor - slack)[part] / np.maximum(qsize[part], 1e-300), -np.inf).min()
                reach = int(np.searchsorted(-size, -need, side="right")) if need > 0 else len(m)
            near = np.arange(reach)
            if len(part) and local[part[0]] >= COORDINATE_FROM:
                near = near[_by_coordinate(q[part], qsize[part], m[:reach], size[:reach], (floor - slack)[part])]
            if not len(near):
                continue
            scores = _products(q[part], m[near])
            for row, i in enumerate(part):
                s = scores[row]
                keep = (ids[near] != qids[i]) & (s >= floor[i] if floor is not None else True)
                at = np.flatnonzero(keep)
                if len(at) > 4 * k:
                    cut = np.partition(s[at], len(at) - k)[len(at) - k]
                    at = at[s[at] >= cut]
                at = at[np.lexsort((ids[near][at], -s[at]))][:k]
                out += [(int(qids[i]), int(ids[near][j]), int(s[j])) for j in at]
    return out


def _by_coordinate(q: np.ndarray, qsize: np.ndarray, m: np.ndarray, size: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Candidates that some query can still reach, by each query's largest coordinate f:
    q.p <= q_f p_f + sqrt(|q|^2 - q_f^2) sqrt(|p|^2 - p_f^2)."""
    f = np.abs(q).argmax(axis=1)
    qf, pf = q[np.arange(len(q)), f], m[:, f]
    rest = np.sqrt(np.maximum(qsize**2 - qf**2, 0))[None, :] * np.sqrt(np.maximum(size[:, None] ** 2 - pf**2, 0))
    return np.flatnonzero((qf[None, :] * pf + rest >= floor[None, :]).any(axis=1))


def needed_length(q: np.ndarray, floor: np.ndarray) -> float:
    """Least length a vector needs to reach the floor of some query."""
    size = np.sqrt((q * q).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(size > 0, (floor - SLACK) / (size * (1 + SLACK)), np.where(floor > SLACK, np.inf, -np.inf))
    return float(need.min(initial=np.inf))


def length_bin(longest: Column) -> Column:
    """Bins of the length, an eighth of a doubling each; -100,000 holds length 0."""
    return F.when(longest > 0, F.floor(F.log2(longest) * BINS)).otherwise(F.lit(-100_000)).cast("int")


def top_products(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of each query, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``, candidates all rows with another id.
    Vectors that are null or hold null or non-finite components take no part; identical rows
    count once; a query with fewer candidates returns all of them; scores beyond a long are held
    at its ends. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = quantised(df, id_col, vector_col)
    asked = rows.filter(F.col("vec_id") % every == 0)
    n, n_asked = (x or 0 for x in rows.select(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first())
    kind = "query_id long, vec_id long, score long"
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    buckets, blocks = packed(rows, max(1, -(-n // BUCKET))), packed(asked, max(1, -(-n_asked // BLOCK)))
    b = buckets.select(F.col("part").alias("bucket"), F.col("dim").alias("b_dim"), "longest", F.col("ids").alias("b_ids"), F.col("m").alias("b_m"))
    width = buckets.agg(F.max("dim")).first()[0]
    first = buckets.agg(F.min_by("part", F.struct(-F.col("longest"), F.col("part")))).first()[0]

    def score(k: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list = []
                for row in range(batch.num_rows):
                    x = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                    floor = None if x.get("floors") is None else np.frombuffer(x["floors"], "<f8")
                    q, m = _matrix(x["m"], x["dim"], width), _matrix(x["b_m"], x["b_dim"], width)
                    out += best_of(np.frombuffer(x["ids"], "<i8"), q, np.frombuffer(x["b_ids"], "<i8"), m, floor, k)
                cols = list(zip(*out)) if out else [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

        return run

    # every block meets the first bucket; copies of it are dealt over the tasks by a salt
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = b.filter(F.col("bucket") == first).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = blocks.drop("longest").withColumn("salt", F.col("part") % salts).join(copies, "salt").drop("salt")
    seen = settle(pairs.mapInArrow(score(k), kind), "top-first")
    # a query's floor is its k-th best score in the first bucket, where that holds k candidates
    floors = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k)

    # buckets are numbered by falling length: those of a length or more end with the last of their bins
    bins = buckets.groupBy(length_bin(F.col("longest")).alias("bin")).agg(F.max("part").alias("last")).orderBy(F.desc("bin")).collect()
    bin_of, last_in = np.array([r.bin for r in bins]), np.maximum.accumulate([r.last for r in bins])

    def with_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors, needs, reach = [], [], []
            for ids, known, raw, dim in zip(*(batch.column(c).to_pylist() for c in ("ids", "known", "m", "dim"))):
                ids = np.frombuffer(ids, "<i8")
                held = {x["query_id"]: x["floor"] for x in known or ()}
                floor = np.array([held.get(i, -np.inf) for i in ids.tolist()], "<f8")
                need = needed_length(_matrix(raw, dim, dim), floor)
                least = np.floor(np.log2(need) * BINS) - 1 if 0 < need < np.inf else np.inf if need > 0 else -np.inf
                inside = np.flatnonzero(bin_of >= least)
                floors.append(floor.tobytes())
                needs.append(need)
                reach.append(int(last_in[inside[-1]]) if len(inside) else -1)
            keep = [c for c in batch.schema.names if c != "known"]
            more = [pa.array(floors, pa.binary()), pa.array(needs, pa.float64()), pa.array(reach, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more], names=[*keep, "floors", "need", "reach"])

    members = blocks.mapInArrow(_members, "part int, query_id long")
    known = members.join(floors, "query_id").groupBy("part").agg(F.collect_list(F.struct("query_id", "floor")).alias("known"))
    columns = "part int, dim int, longest double, ids binary, m binary, floors binary, need double, reach int"
    ready = settle(blocks.join(known, "part", "left").mapInArrow(with_floors, columns), "top-blocks")
    asked_of = ready.filter("reach >= 0").select("part", "need", F.explode(F.sequence(F.lit(0), F.col("reach"))).alias("bucket"))
    lengths = buckets.select(F.col("part").alias("bucket"), F.col("longest").alias("b_longest"))
    met = asked_of.filter(F.col("bucket") != first).join(lengths, "bucket").filter(F.col("b_longest") >= F.col("need")).select("part", "bucket")
    strip = F.floor(F.col("part") / STRIP).alias("strip")
    met = settle(met.select("part", "bucket", strip), "top-pairs")
    left = met.join(ready.select("part", "dim", "ids", "m", "floors"), "part")
    right = met.select("bucket", "strip").distinct().join(b.drop("longest"), "bucket")
    rest = left.join(right, ["bucket", "strip"]).drop("strip").mapInArrow(score(k), kind)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    best = seen.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, ids in zip(batch.column("part").to_pylist(), batch.column("ids").to_pylist()):
            ids = np.frombuffer(ids, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part), pa.int32()), pa.array(ids)], names=["part", "query_id"])


#: DuckDB SQL for the rows of ``op7_top_products``.
ORACLE = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
