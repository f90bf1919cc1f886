"""Boxes, rasters, sizes, goals, pairs and benchmark rows derived from the given tables.

Each has a Spark form and an SQL form of the same rows. Depth is in whole centimetres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scale import settle_by_rows

CM = 100.0  # raster units per metre


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is read once per process."""
    path = f"{sf}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def int_boxes(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as image_id",
        "cast(l_linenumber + 10 * l_suppkey + 10000000 * l_partkey as bigint) as box_no",
        "l_partkey % 15 as label_id",
        "(l_partkey * 7 + l_linenumber * 13) % 70 as x1",
        "(l_suppkey * 11 + l_linenumber * 17) % 70 as y1",
        "cast(l_quantity as bigint) % 25 as dw",
        "l_partkey % 25 as dh",
        "50 + l_partkey % 50 as score_pct",
    ).selectExpr("image_id", "box_no", "label_id", "x1", "y1", "x1 + 5 + dw as x2", "y1 + 5 + dh as y2", "score_pct")


INT_BOXES = """int_boxes AS (
  SELECT l_orderkey AS image_id, l_linenumber + 10*l_suppkey + 10000000*l_partkey AS box_no, l_partkey % 15 AS label_id,
         (l_partkey*7 + l_linenumber*13) % 70 AS x1, (l_suppkey*11 + l_linenumber*17) % 70 AS y1,
         (l_partkey*7 + l_linenumber*13) % 70 + 5 + l_quantity::BIGINT % 25 AS x2,
         (l_suppkey*11 + l_linenumber*17) % 70 + 5 + l_partkey % 25 AS y2,
         50 + l_partkey % 50 AS score_pct
  FROM lineitem)"""


def boxes(spark, sf) -> DataFrame:
    return int_boxes(spark, sf).select(
        "image_id",
        "box_no",
        F.concat(F.lit("label"), F.col("label_id").cast("string")).alias("label"),
        (F.col("x1") / 100.0).alias("x_min"),
        (F.col("y1") / 100.0).alias("y_min"),
        (F.col("x2") / 100.0).alias("x_max"),
        (F.col("y2") / 100.0).alias("y_max"),
        (F.col("score_pct") / 100.0).alias("score"),
    )


def boxes_of(spark, sf, images: DataFrame) -> DataFrame:
    """The boxes of ``images(image_id)``, written once. Where the images are too many to be sent to
    every task the whole of ``lineitem`` is shuffled, in as many tasks as its rows ask for."""
    kept = boxes(spark, sf).join(images.select("image_id"), "image_id", "left_semi")
    return settle_by_rows(kept, table(spark, sf, "lineitem").count(), "boxes")


BOXES = (
    INT_BOXES
    + """, boxes AS (
  SELECT image_id, box_no, 'label' || label_id AS label, x1/100.0::DOUBLE AS x_min, y1/100.0::DOUBLE AS y_min,
         x2/100.0::DOUBLE AS x_max, y2/100.0::DOUBLE AS y_max, score_pct/100.0::DOUBLE AS score
  FROM int_boxes)"""
)


def frames(spark, sf) -> DataFrame:
    """One frame per order, from its key."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey as image_id",
        "(o_orderkey % 40) / 100.0D as f_x1",
        "(o_custkey % 40) / 100.0D as f_y1",
        "(o_orderkey % 40 + 50) / 100.0D as f_x2",
        "(o_custkey % 40 + 45) / 100.0D as f_y2",
    )


FRAMES = """frames AS (
  SELECT o_orderkey AS image_id, (o_orderkey % 40)/100.0::DOUBLE AS f_x1, (o_custkey % 40)/100.0::DOUBLE AS f_y1,
         (o_orderkey % 40 + 50)/100.0::DOUBLE AS f_x2, (o_custkey % 40 + 45)/100.0::DOUBLE AS f_y2
  FROM orders)"""


def sizes(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey as image_id",
        "cast(320 + (p_size * 37) % 1600 as bigint) as w",
        "cast(240 + (p_size * 53 + p_partkey) % 1200 as bigint) as h",
    )


SIZES = """sizes AS (
  SELECT p_partkey AS image_id, (320 + (p_size*37) % 1600)::BIGINT AS w,
         (240 + (p_size*53 + p_partkey) % 1200)::BIGINT AS h FROM part)"""


def raster(spark, sf) -> DataFrame:
    return (
        table(spark, sf, "embeddings")
        .select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "z"))
        .selectExpr(
            "image_id",
            "8L as h",
            "8L as w",
            "cast(p div 8 as bigint) as y",
            "cast(p % 8 as bigint) as x",
            "cast(floor(abs(cast(z as double)) * 4000) as double) as depth",
        )
    )


RASTER = """raster AS MATERIALIZED (
  SELECT image_id, 8 AS h, 8 AS w, p // 8 AS y, p % 8 AS x, floor(abs(z::DOUBLE) * 4000)::DOUBLE AS depth
  FROM (SELECT vec_id AS image_id, unnest(range(len(embedding))) AS p, unnest(embedding) AS z FROM embeddings))"""


def raster_goals(spark, sf) -> DataFrame:
    """Goal cell and the shares it comes from."""
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id as image_id",
        "8L as h",
        "8L as w",
        "vec_id % 4 as gy",
        "(vec_id * 5) % 8 as gx",
        "((vec_id * 5) % 8) / 8.0D as cx",
        "(vec_id % 4) / 8.0D as cy",
        "7L as sy",
        "4L as sx",
        "8L as raw_sy",
        "4L as raw_sx",
    )


RASTER_GOALS = """rgoals AS (
  SELECT vec_id AS image_id, 8 AS h, 8 AS w, vec_id % 4 AS gy, (vec_id*5) % 8 AS gx FROM embeddings)"""


def raster_paths(spark, sf, n: int = 6) -> DataFrame:
    """Straight pixel path from the start cell to the goal cell of each raster."""
    from ..operators import paths

    ends = raster_goals(spark, sf).selectExpr(
        "image_id", "h", "w", "4.0D / 8 as x1", "1.0D as y1", "gx / 8.0D as x2", "gy / 8.0D as y2"
    )
    line = paths.straight_line(ends, n).drop("x1", "y1", "x2", "y2")
    return paths.pixel_path(line.drop("h", "w"), raster_goals(spark, sf))


def raster_paths_sql(n: int = 6) -> str:
    return f"""line AS (
  SELECT image_id, i AS seq,
         CASE WHEN i = {n - 1} THEN gx/8.0::DOUBLE ELSE 0.5::DOUBLE + i*((gx/8.0::DOUBLE - 0.5::DOUBLE)/{n - 1}) END AS x,
         CASE WHEN i = {n - 1} THEN gy/8.0::DOUBLE ELSE 1.0::DOUBLE + i*((gy/8.0::DOUBLE - 1.0::DOUBLE)/{n - 1}) END AS y
  FROM rgoals, range({n}) r(i)),
pts AS (
  SELECT image_id, seq, x, y, greatest(0, least(trunc(x*8)::BIGINT, 7)) AS px,
         greatest(0, least(trunc(y*8)::BIGINT, 7)) AS py FROM line)"""


def turns(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations")


def pairs(spark, sf) -> DataFrame:
    """User turn t against assistant turn t+1."""
    c = turns(spark, sf)
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("truth"))
    a = c.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred")
    )
    return u.join(a, ["conv_id", "turn"]).withColumn(
        "pair_id", F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    )


PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS truth, a.text AS pred, u.conv_id || '|' || u.turn AS pair_id
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""


def chat_events(spark, sf, streaming: bool = False) -> DataFrame:
    if streaming:
        from ..streaming.logs import stream_table

        raw = stream_table(spark, sf, "events.parquet", table(spark, sf, "events").schema)
    else:
        raw = table(spark, sf, "events")
    return raw.selectExpr(
        "event_id",
        "cast(ts as timestamp) as ts",
        "user_id",
        "concat('m', cast(user_id % 5 as string)) as model",
        "case event_type when 'view' then 'chat' when 'click' then 'upvote' when 'error' then 'downvote' "
        "when 'signup' then 'flag' end as type",
        "0.0D as start",
        "cast(event_id % 100 as double) / 4 as finish",
        "props",
    )


CHAT = """chat AS (
  SELECT event_id, ts, user_id, 'm' || (user_id % 5) AS model,
         CASE event_type WHEN 'view' THEN 'chat' WHEN 'click' THEN 'upvote' WHEN 'error' THEN 'downvote'
                         WHEN 'signup' THEN 'flag' END AS type,
         0.0::DOUBLE AS start, (event_id % 100)::DOUBLE/4 AS finish, props FROM events)"""


def choice_problems(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "doc_id as question_id", "cast(3 + doc_id % 3 as int) as n_choices", "(doc_id * 3) % 5 as answer"
    )


PROBLEMS = """problems AS (
  SELECT doc_id AS question_id, (3 + doc_id % 3)::INT AS n_choices, (doc_id*3) % 5 AS answer FROM documents)"""


def choice_predictions(spark, sf) -> DataFrame:
    """Answers of several shapes: bare letters, 'A. …', statements, two statements, none."""
    return table(spark, sf, "documents").filter("doc_id % 11 <> 0").selectExpr(
        "doc_id as question_id",
        "case doc_id % 6 when 0 then chr(cast(65 + doc_id % 5 as int)) "
        "when 1 then concat(chr(cast(65 + doc_id % 5 as int)), '. because') "
        "when 2 then concat('The answer is ', chr(cast(65 + doc_id % 5 as int)), '.') "
        "when 3 then 'The answer is A. The answer is B.' "
        "when 4 then concat('The answer is ', chr(cast(65 + doc_id % 5 as int))) "
        "else text end as text",
        "case when doc_id % 2 = 0 then concat('<image> ', lang) else lang end as prompt",
    )


PREDICTIONS = """preds AS (
  SELECT doc_id AS question_id,
    CASE doc_id % 6 WHEN 0 THEN chr((65 + doc_id % 5)::INT)
      WHEN 1 THEN chr((65 + doc_id % 5)::INT) || '. because'
      WHEN 2 THEN 'The answer is ' || chr((65 + doc_id % 5)::INT) || '.'
      WHEN 3 THEN 'The answer is A. The answer is B.'
      WHEN 4 THEN 'The answer is ' || chr((65 + doc_id % 5)::INT)
      ELSE text END AS text,
    CASE WHEN doc_id % 2 = 0 THEN '<image> ' || lang ELSE lang END AS prompt
  FROM documents WHERE doc_id % 11 <> 0)"""
