"""Vector codes by active-entry Lloyd rounds over the parts of the vectors.

Every row keeps, for each of its parts, the index of its codebook entry and the exact squared
distance to it. After a round the driver knows which entries moved. A part whose entry stayed
where it was compares only the moved entries with the distance it holds: no other entry got
nearer. All other parts look at the whole codebook. Both ways give the nearest entry with the
lowest index.

One pass over the rows assigns them and adds up, per task, the parts of each entry; both are
written at once, so a lost executor repeats tasks of one pass only. The driver holds the codebooks
(parts x entries x width) and their sums, nothing that grows with the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, settle
from .vectors import arrays, distances, finite, floored, group_sums, matrix, with_total

PARTS = 4
ENTRIES = 256  # of a codebook; two hex digits hold an index
ROUNDS = 4
SCALE = 1024
SLICE = 4096  # rows compared at a time


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the lowest of equals, and its squared distance."""
    d = distances(x, book)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``code`` and ``dist`` of the rows after the entries marked in ``moved`` changed, and how many
    rows had to look at the whole codebook."""
    code, dist = code.copy(), dist.copy()
    rescan = moved[code]
    active = np.flatnonzero(moved)
    fixed = np.flatnonzero(~rescan)
    if len(active) and len(fixed):
        best, d = nearest(x[fixed], book[active])
        best = active[best]
        won = (d < dist[fixed]) | ((d == dist[fixed]) & (best < code[fixed]))
        code[fixed[won]], dist[fixed[won]] = best[won], d[won]
    again = np.flatnonzero(rescan)
    if len(again):
        code[again], dist[again] = nearest(x[again], book)
    return code, dist, len(again)


def pass_over(model, parts: int, last: bool) -> Callable:
    """One pass: assign the rows of a task; unless it is the last, add a row of sums per entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved = model.value
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        names = ["id", "label", "v", "code", "dist", "part", "entry", "n", "sums"]
        kinds, label = [pa.int64(), None, pa.list_(pa.int32()), pa.list_(pa.int16()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())], pa.null()
        for whole in batches:
            label = whole.column("label").type
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                v, n = matrix(batch.column("v")), batch.num_rows
                width = v.shape[1] // parts
                first = moved is None
                code = np.zeros((n, parts), np.int64) if first else matrix(batch.column("code")).astype(np.int64)
                dist = np.zeros((n, parts), np.int64) if first else matrix(batch.column("dist"))
                dist = dist.copy()
                for p in range(parts):
                    x = v[:, p * width : (p + 1) * width]
                    if first:
                        code[:, p], dist[:, p] = nearest(x, books[p])
                    else:
                        code[:, p], dist[:, p], _ = reassign(x, books[p], moved[p], code[:, p], dist[:, p])
                    if not last:
                        k, s = group_sums(code[:, p], x, books.shape[1])
                        counts[p] += k
                        sums[p] += s
                own = [batch.column("id"), batch.column("label"), batch.column("v"), arrays(code.astype(np.int16), pa.int16()), arrays(dist, pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(n, t) for t in kinds[5:])], names=names)
        part, entry = np.nonzero(counts)
        if len(part):
            kinds[1], k = label, len(part)
            own = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), arrays(sums[part, entry], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in kinds[:5]), *own], names=names)

    return run


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry that has parts becomes their componentwise floor(sum / count)."""
    each = state.filter("part is not null").select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
    rows = each.groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # at most parts x entries x width
    new = books.copy()
    for r in rows:
        new[r.part, r.entry, r["at"]] = r.s // r.n  # whole numbers of Python: floors go down
    return new


def compress(
    df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that takes part.

    Vectors that are null or hold null or non-finite components are left out. One table has one
    dimension: the most frequent one that ``parts`` divides (the smaller of equals); vectors of
    another dimension are left out too. Components beyond 2**27 after scaling are held there.
    Repeated rows are rows of their own, also among the first ``entries`` (rows of one id stand in
    the order of their components); rows without an id are coded but start no entry, and where no
    row has an id nothing is coded. With fewer rows than entries the codebooks are shorter. Rows
    without a label share one label error. An empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    spark, kind = df.sparkSession, "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    x = F.col(vector_col)
    given = df.filter(finite(x) & (F.size(x) > 0) & (F.size(x) % parts == 0))
    dim = given.groupBy(F.size(x).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dim is None:
        return spark.createDataFrame([], kind)
    rows = given.filter(F.size(x) == dim.dim).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), floored(x, scale).alias("v"))
    state = settle(rows, "codes-rows")
    start = state.filter("id is not null").orderBy("id", "v").select("v").limit(entries).collect()
    if not start:
        discard(state)
        return spark.createDataFrame([], kind)
    books = np.array([r.v for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    fields = [*state.schema.fields, *T._parse_datatype_string("code array<short>, dist array<long>, part int, entry int, n long, sums array<long>").fields]
    moved = None
    for k in range(rounds + 1):
        model = spark.sparkContext.broadcast((books, moved))
        source = state if k == 0 else state.filter("part is null").select("id", "label", "v", "code", "dist")
        held = state
        state = settle(source.mapInArrow(pass_over(model, parts, k == rounds), T.StructType(fields)), f"codes-{k}")
        discard(held)
        model.unpersist()
        if k < rounds:
            new = moved_books(state, books)
            moved, books = (new != books).any(axis=2), new
            if not moved.any():  # later rounds change nothing
                break
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    error = F.aggregate("dist", F.lit(0).cast("long"), lambda a, d: a + d)
    coded = state.filter("part is null").select(F.col("id").alias("vec_id"), "label", hexed.alias("code"), error.alias("error"))
    return with_total(coded, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _rounds() -> str:
    """The rounds of ``ORACLE``: assignments a0..a4 and codebooks c0..c4, one set of tables each."""
    out = []
    for k in range(ROUNDS + 1):
        out.append(f"""
a{k} as materialized (
  select r, p, min(d * 256 + e) as m from (
    select v.r, v.p, c.e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from parts v join c{k} c on v.p = c.p) group by r, p)""")
        if k < ROUNDS:
            out.append(f"""
s{k} as materialized (
  select p, e, i, sum(y)::bigint as s, count(*) as n from (
    select a.p, a.m % 256 as e, unnest(v.x) as y, unnest(range(1, len(v.x) + 1)) as i from a{k} a join parts v on a.r = v.r and a.p = v.p) group by p, e, i),
c{k + 1} as materialized (
  select c.p, c.e, coalesce(u.x, c.x) as x from c{k} c left join (
    select p, e, list((s - ((s % n + n) % n)) // n order by i) as x from s{k} group by p, e) u on c.p = u.p and c.e = u.e)""")
    return ",".join(out)


#: DuckDB SQL for the rows of ``op11_vector_codes``.
ORACLE = f"""
with kept as materialized (
  select row_number() over (order by vec_id, embedding) as r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as x
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
parts as materialized (
  select r, p, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] as x from kept, (select unnest(range({PARTS})) as p)),
c0 as materialized (select p, r - 1 as e, x from parts where r <= {ENTRIES}),{_rounds()},
digest as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as h from c{ROUNDS}),
coded as (
  select k.vec_id, k.label, string_agg(printf('%02x', (a.m % 256)::int), '' order by a.p) as code, sum(a.m // 256)::bigint as error
  from a{ROUNDS} a join kept k on a.r = k.r group by k.r, k.vec_id, k.label)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from coded, digest
"""
