"""Boxes, goals and image sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import boxes as B
from ..operators import goals as GO
from ..operators import images as I
from . import fixtures as D
from .registry import query

RESOLUTIONS = [(336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008)]
GOAL_LABELS = ["label1", "label4", "label9"]
DROPPED_LABELS = ["label0", "label7"]


def _labels(spark, sf, wanted):
    """Label table taken from the boxes themselves."""
    return D.boxes(spark, sf).select("label").distinct().filter(F.col("label").isin(wanted))


def _sql_list(values):
    return ", ".join(f"'{v}'" for v in values)


@query(
    "boxes_clean",
    f"""WITH {D.INT_BOXES}
    SELECT image_id, box_no, least(greatest(x1*7/500.0::DOUBLE, 0), 1) AS x_min, least(greatest(y2*7/400.0::DOUBLE, 0), 1) AS y_max,
           score_pct/100.0::DOUBLE AS score
    FROM int_boxes WHERE score_pct > 70""",
)
def boxes_clean(spark, sf):
    """Pixel boxes of a 500 x 400 image clamped to shares; strict score limit."""
    raw = D.int_boxes(spark, sf).select(
        "image_id", "box_no",
        *[(F.col(c) * 7).cast("double").alias(n) for c, n in zip(("x1", "y1", "x2", "y2"), B.XYXY)],
        (F.col("score_pct") / 100.0).alias("score"),
    )
    kept = raw.filter(F.col("score") > 0.7)
    return kept.select(
        "image_id", "box_no",
        G.clamp(F.col("x_min") / 500.0, 0.0, 1.0).alias("x_min"),
        G.clamp(F.col("y_max") / 400.0, 0.0, 1.0).alias("y_max"),
        "score",
    )


@query(
    "boxes_clean_counts",
    f"""WITH {D.INT_BOXES}
    SELECT label_id, count(*) AS n, sum((x2*7 >= 500)::INT)::BIGINT AS n_clamped
    FROM int_boxes WHERE label_id = 3 OR score_pct > 70 GROUP BY label_id""",
)
def boxes_clean_counts(spark, sf):
    """Missing scores count as 1: label 3 loses its scores and passes the limit."""
    raw = D.int_boxes(spark, sf).select(
        "image_id", "box_no", "label_id",
        *[(F.col(c) * 7).cast("double").alias(n) for c, n in zip(("x1", "y1", "x2", "y2"), B.XYXY)],
        F.when(F.col("label_id") != 3, F.col("score_pct") / 100.0).alias("score"),
        F.lit(500.0).alias("width"), F.lit(400.0).alias("height"),
    )
    return B.clean_boxes(raw, 0.7).groupBy("label_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x_max") >= 1.0).alias("n_clamped")
    )


_OVERLAP = """o AS (
  SELECT b.*, f.*,
    CASE WHEN least(x_max, f_x2) < greatest(x_min, f_x1) OR least(y_max, f_y2) < greatest(y_min, f_y1) THEN 0
         ELSE (least(x_max, f_x2) - greatest(x_min, f_x1)) * (least(y_max, f_y2) - greatest(y_min, f_y1)) END AS inter,
    (x_max - x_min) * (y_max - y_min) AS area_a, (f_x2 - f_x1) * (f_y2 - f_y1) AS area_b
  FROM boxes b JOIN frames f USING (image_id))"""


@query(
    "boxes_frame_iou",
    f"""WITH {D.BOXES}, {D.FRAMES}, {_OVERLAP}
    SELECT image_id, box_no, inter AS intersection, area_a, area_b, area_a + area_b - inter AS union_area,
           inter / (area_a + area_b - inter) AS iou FROM o""",
)
def boxes_frame_iou(spark, sf):
    both = D.boxes(spark, sf).join(D.frames(spark, sf), "image_id")
    o = B.overlap(B.XYXY, ("f_x1", "f_y1", "f_x2", "f_y2"))
    return both.select("image_id", "box_no", *[c.alias(n) for n, c in o.items()])


@query(
    "boxes_inside_frame",
    f"""WITH {D.BOXES}, {D.FRAMES}, {_OVERLAP}
    SELECT image_id, box_no, label FROM o WHERE area_a > 0 AND inter / area_a > 0.5""",
)
def boxes_inside_frame(spark, sf):
    return B.inside_frame(D.boxes(spark, sf), D.frames(spark, sf), 0.5).select("image_id", "box_no", "label")


@query(
    "boxes_rebased",
    f"""WITH {D.BOXES}, {D.FRAMES}
    SELECT image_id, box_no,
      greatest(0, least((x_min - f_x1) * (1.0::DOUBLE/(f_x2 - f_x1)), 1)) AS x_min,
      greatest(0, least((y_min - f_y1) * (1.0::DOUBLE/(f_y2 - f_y1)), 1)) AS y_min,
      greatest(0, least((x_max - f_x1) * (1.0::DOUBLE/(f_x2 - f_x1)), 1)) AS x_max,
      greatest(0, least((y_max - f_y1) * (1.0::DOUBLE/(f_y2 - f_y1)), 1)) AS y_max
    FROM boxes JOIN frames USING (image_id)""",
)
def boxes_rebased(spark, sf):
    both = D.boxes(spark, sf).join(D.frames(spark, sf), "image_id")
    return B.rebase(both).select("image_id", "box_no", *B.XYXY)


@query(
    "boxes_label_removal",
    f"""WITH {D.BOXES} SELECT image_id, box_no, label FROM boxes WHERE label NOT IN ({_sql_list(DROPPED_LABELS)})""",
)
def boxes_label_removal(spark, sf):
    return B.drop_labels(D.boxes(spark, sf), _labels(spark, sf, DROPPED_LABELS)).select("image_id", "box_no", "label")


@query(
    "goal_candidate_points",
    f"""WITH {D.BOXES} SELECT image_id, box_no, label, (x_min + x_max)/2 AS cx, y_max AS cy
    FROM boxes WHERE label IN ({_sql_list(GOAL_LABELS)})""",
)
def goal_candidate_points(spark, sf):
    return B.goal_candidates(D.boxes(spark, sf), _labels(spark, sf, GOAL_LABELS))


@query(
    "goal_candidate_boxes",
    f"""WITH {D.BOXES} SELECT image_id, box_no, label, x_min, y_min, x_max, y_max
    FROM boxes WHERE label IN ({_sql_list(GOAL_LABELS)})""",
)
def goal_candidate_boxes(spark, sf):
    return B.goal_candidates(D.boxes(spark, sf), _labels(spark, sf, GOAL_LABELS), as_box=True)


@query(
    "goal_seeded_pick",
    f"""WITH {D.BOXES}, c AS (
      SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5('17|' || image_id || '|' || box_no), box_no, label, (x_min + x_max)/2, y_max) AS rn
      FROM boxes WHERE label IN ({_sql_list(GOAL_LABELS)}))
    SELECT image_id, box_no, label, (x_min + x_max)/2 AS cx, y_max AS cy FROM c WHERE rn = 1""",
)
def goal_seeded_pick(spark, sf):
    return GO.pick_one(goal_candidate_points(spark, sf), 17)


@query(
    "boxes_merged_sources",
    f"""WITH {D.BOXES}, im AS (
      SELECT o_orderkey AS image_id, o_custkey % 3 <> 0 AS has_stored, o_custkey % 5 <> 0 AS has_truth FROM orders)
    SELECT image_id, box_no, label, 'stored' AS origin FROM boxes WHERE box_no % 3 = 0 AND score > 0.7
    UNION ALL SELECT image_id, box_no, label, 'truth' FROM boxes WHERE box_no % 3 = 1
    UNION ALL SELECT image_id, box_no, label, 'detector' FROM boxes JOIN im USING (image_id)
      WHERE box_no % 3 = 2 AND NOT (has_stored AND has_truth)""",
)
def boxes_merged_sources(spark, sf):
    b = D.boxes(spark, sf)
    images = D.table(spark, sf, "orders").selectExpr(
        "o_orderkey as image_id", "o_custkey % 3 <> 0 as has_stored", "o_custkey % 5 <> 0 as has_truth"
    )
    return B.merge_sources(
        b.filter("box_no % 3 = 0 and score > 0.7"), b.filter("box_no % 3 = 1"), b.filter("box_no % 3 = 2"), images
    ).select("image_id", "box_no", "label", "origin")


_ORDER_IMAGES = "im AS (SELECT o_orderkey AS image_id FROM orders)"


@query(
    "goal_fallback_chain",
    f"""WITH {D.BOXES}, {_ORDER_IMAGES}, det AS (
      SELECT image_id, label, (x_min + x_max)/2 AS cx, y_max AS cy,
        row_number() OVER (PARTITION BY image_id ORDER BY md5('17|' || image_id || '|' || box_no), box_no, label, (x_min + x_max)/2, y_max) AS rn
      FROM boxes WHERE label IN ({_sql_list(GOAL_LABELS)})),
    anno AS (SELECT o_orderkey AS image_id, 'point' AS label, (o_custkey % 640)/640.0::DOUBLE AS cx,
                    (o_custkey % 480)/480.0::DOUBLE AS cy FROM orders WHERE o_custkey % 4 = 0),
    front AS (SELECT o_orderkey AS image_id, 0.25::DOUBLE AS cx, (o_orderkey % 8)/8.0::DOUBLE AS cy
              FROM orders WHERE o_custkey % 7 = 0)
    SELECT im.image_id,
      CASE WHEN d.image_id IS NOT NULL THEN 'select_det' WHEN a.image_id IS NOT NULL THEN 'load_anno'
           WHEN f.image_id IS NOT NULL THEN 'front' ELSE 'default' END AS method,
      coalesce(d.label, 'point') AS label, coalesce(d.cx, a.cx, f.cx, 0.5) AS cx, coalesce(d.cy, a.cy, f.cy, 0.75) AS cy
    FROM im LEFT JOIN det d ON d.image_id = im.image_id AND d.rn = 1
      LEFT JOIN anno a ON a.image_id = im.image_id LEFT JOIN front f ON f.image_id = im.image_id""",
)
def goal_fallback_chain(spark, sf):
    orders = D.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "image_id")
    anno = GO.goals_from_pixels(
        orders.filter("o_custkey % 4 = 0").selectExpr("image_id", "o_custkey % 640 as px", "o_custkey % 480 as py"),
        orders.selectExpr("image_id", "640 as w", "480 as h"),
    )
    front = orders.filter("o_custkey % 7 = 0").selectExpr("image_id", "0.25D as cx", "(image_id % 8)/8.0D as cy")
    return GO.resolve_goals(
        orders.select("image_id"),
        [("select_det", goal_seeded_pick(spark, sf)), ("load_anno", anno)],
        front,
    )


@query(
    "goal_cache_fill",
    """SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 3 = 0 THEN 'cached' ELSE 'computed' END AS origin,
         CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey * 2 END AS v FROM orders""",
)
def goal_cache_fill(spark, sf):
    orders = D.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "image_id")
    cached = orders.filter("image_id % 3 = 0").selectExpr("image_id", "'cached' as origin", "o_custkey as v")
    return GO.fill_cache(
        orders.select("image_id"), cached,
        lambda missing: missing.selectExpr("image_id", "'computed' as origin", "image_id * 2 as v"),
    )


@query(
    "images_unfinished",
    """SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey NOT IN
         (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 5)""",
)
def images_unfinished(spark, sf):
    images = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    done = D.table(spark, sf, "lineitem").filter("l_linenumber = 5").select(F.col("l_orderkey").alias("image_id"))
    return GO.unfinished(images, done)


@query(
    "segment_division_points",
    f"""WITH {D.BOXES} SELECT image_id, box_no, i AS step,
      x_min + i*((x_max - x_min)/4) AS px, y_min + i*((y_max - y_min)/4) AS py FROM boxes, range(1, 4) r(i)""",
)
def segment_division_points(spark, sf):
    return B.segment_points(D.boxes(spark, sf), 3, *B.XYXY).select(
        "image_id", "box_no", F.col("step").cast("bigint").alias("step"), "px", "py"
    )


@query(
    "crops_along_goal",
    f"""WITH {D.SIZES}, g AS (
      SELECT image_id, w::DOUBLE AS w, h::DOUBLE AS h, (image_id*13) % w AS gx, (image_id*29) % h AS gy FROM sizes),
    p AS (SELECT *, i AS step, w*0.5/2.0 AS hw, h*0.5/2.0 AS hh, w/2.0 AS sx, h - h*0.5/2.0 AS sy
          FROM g, range(0, 4) r(i)),
    q AS (SELECT *, CASE WHEN step = 3 THEN gx ELSE sx + step*((gx - sx)/3) END AS px,
                    CASE WHEN step = 3 THEN gy ELSE sy + step*((gy - sy)/3) END AS py FROM p),
    e AS (SELECT *, px - hw AS ax, px + hw AS bx, py - hh AS ay, py + hh AS by_ FROM q)
    SELECT image_id, step, px, py,
      CASE WHEN ax < 0 THEN 0 WHEN bx > w THEN w - (bx - ax) ELSE ax END AS x1,
      CASE WHEN ay < 0 THEN 0 WHEN by_ > h THEN h - (by_ - ay) ELSE ay END AS y1,
      CASE WHEN ax < 0 THEN bx - ax WHEN bx > w THEN w ELSE bx END AS x2,
      CASE WHEN ay < 0 THEN by_ - ay WHEN by_ > h THEN h ELSE by_ END AS y2 FROM e""",
)
def crops_along_goal(spark, sf):
    g = D.sizes(spark, sf).selectExpr(
        "image_id", "cast(w as double) as w", "cast(h as double) as h",
        "cast((image_id * 13) % w as double) as gx", "cast((image_id * 29) % h as double) as gy",
    )
    return B.crops_along(g, 0.5, 2).withColumn("step", F.col("step").cast("bigint"))


@query(
    "camera_intrinsics",
    """WITH n AS (SELECT p_partkey AS image_id,
        CASE p_partkey % 6 WHEN 0 THEN 'MP_' WHEN 1 THEN 'ZED' WHEN 2 THEN 'img_R' WHEN 3 THEN 'x_GOPR'
             WHEN 4 THEN 'ZED_R' ELSE 'plain' END || p_partkey AS filename,
        20 + p_size AS fov, 100 + p_size AS depth_cm FROM part)
    SELECT image_id, filename,
      CASE WHEN contains(filename, 'MP_') THEN 0.6285861494594773::DOUBLE * 1.8::DOUBLE
           WHEN contains(filename, 'ZED') THEN 0.5553062574145965::DOUBLE * 3.0::DOUBLE
           WHEN contains(filename, '_R') THEN 0.49078759599228894::DOUBLE * 4.5::DOUBLE
           WHEN contains(filename, '_GOPR') THEN 0.4830019884684673::DOUBLE * 4.0::DOUBLE
           ELSE 0.6::DOUBLE * 3::DOUBLE END AS fx_ratio,
      trunc(1.0 / (depth_cm/100.0::DOUBLE) * 1000)::BIGINT AS half_px
    FROM n""",
)
def camera_intrinsics(spark, sf):
    n = D.table(spark, sf, "part").selectExpr(
        "p_partkey as image_id",
        "concat(case p_partkey % 6 when 0 then 'MP_' when 1 then 'ZED' when 2 then 'img_R' when 3 then 'x_GOPR' "
        "when 4 then 'ZED_R' else 'plain' end, cast(p_partkey as string)) as filename",
        "(100 + p_size) / 100.0D as depth",
    )
    fx = G.camera_ratios("filename")[0]
    left, right = G.metric_bounds(F.lit(5000), F.col("depth"), 1.0, F.lit(1000), F.lit(100000))
    return n.select("image_id", "filename", fx.alias("fx_ratio"), (right - 5000).alias("half_px"))


@query(
    "metric_bounds_by_depth",
    """SELECT l_orderkey AS image_id, l_linenumber::BIGINT AS box_no,
      greatest((l_partkey % 640) - trunc(1.0 / l_quantity::DOUBLE * 384)::BIGINT, 0) AS left_x,
      least((l_partkey % 640) + trunc(1.0 / l_quantity::DOUBLE * 384)::BIGINT, 639) AS right_x,
      trunc(2.0 / l_quantity::DOUBLE * ((384 + 288)/2.0::DOUBLE))::BIGINT AS radius_px FROM lineitem""",
)
def metric_bounds_by_depth(spark, sf):
    li = D.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as image_id", "cast(l_linenumber as bigint) as box_no", "l_partkey % 640 as x",
        "cast(l_quantity as double) as depth",
    )
    left, right = G.metric_bounds("x", "depth", 1.0, F.lit(384), F.lit(640))
    return li.select(
        "image_id", "box_no", left.alias("left_x"), right.alias("right_x"),
        G.metric_radius("depth", 2.0, F.lit(384), F.lit(288)).alias("radius_px"),
    )


@query(
    "field_of_view_focal",
    """SELECT p_size, (1920/2.0::DOUBLE) / tan(radians((40 + p_size)::DOUBLE)/2) > 900 AS is_long, count(*) AS n
       FROM part GROUP BY ALL""",
)
def field_of_view_focal(spark, sf):
    p = D.table(spark, sf, "part").select("p_size", G.focal_from_fov(F.lit(1920), F.col("p_size") + 40).alias("fx"))
    return p.groupBy("p_size", (F.col("fx") > 900).alias("is_long")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "goal_side_buckets",
    f"""WITH {D.BOXES} SELECT image_id, box_no,
      CASE WHEN (x_min + x_max)/2 < 0.33::DOUBLE THEN 'left' WHEN (x_min + x_max)/2 > 0.66::DOUBLE THEN 'right' ELSE 'center' END AS side
    FROM boxes""",
)
def goal_side_buckets(spark, sf):
    return D.boxes(spark, sf).select(
        "image_id", "box_no", G.side_bucket((F.col("x_min") + F.col("x_max")) / 2).alias("side")
    )


@query(
    "points_rescaled",
    f"""WITH {D.SIZES} SELECT image_id, trunc((image_id % w) * (518/w::DOUBLE))::BIGINT AS x,
      greatest(1, least(trunc((image_id % h) * (392/h::DOUBLE))::BIGINT, 390)) AS y FROM sizes""",
)
def points_rescaled(spark, sf):
    s = D.sizes(spark, sf)
    return s.select(
        "image_id",
        G.truncate((F.col("image_id") % F.col("w")) * (F.lit(518) / F.col("w"))).alias("x"),
        G.within_margin(G.truncate((F.col("image_id") % F.col("h")) * (F.lit(392) / F.col("h"))), F.lit(392), 1).cast("bigint").alias("y"),
    )


# ---- image sizes ------------------------------------------------------------------------

_FITS = ", ".join(f"({i}, {w}, {h})" for i, (w, h) in enumerate(RESOLUTIONS))
_BEST = f"""cand(pos, tw, th) AS (VALUES {_FITS}),
fit AS (
  SELECT s.*, c.*, least(trunc(w*least(tw/w::DOUBLE, th/h::DOUBLE))::BIGINT * trunc(h*least(tw/w::DOUBLE, th/h::DOUBLE))::BIGINT, w*h) AS eff
  FROM sizes s, cand c),
best AS (
  SELECT image_id, w, h, tw AS best_w, th AS best_h FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY eff DESC, tw*th - eff, pos) AS rn FROM fit) WHERE rn = 1)"""


@query("image_best_resolution", f"WITH {D.SIZES}, {_BEST} SELECT image_id, best_w::BIGINT AS best_w, best_h::BIGINT AS best_h FROM best")
def image_best_resolution(spark, sf):
    return I.with_best_resolution(D.sizes(spark, sf), RESOLUTIONS).select(
        "image_id", F.col("best_w").cast("bigint").alias("best_w"), F.col("best_h").cast("bigint").alias("best_h")
    )


_PADDED = """padded AS (
  SELECT *, CASE WHEN best_w/w::DOUBLE < best_h/h::DOUBLE THEN best_w ELSE least(ceil(w*(best_h/h::DOUBLE))::BIGINT, best_w) END AS new_w,
    CASE WHEN best_w/w::DOUBLE < best_h/h::DOUBLE THEN least(ceil(h*(best_w/w::DOUBLE))::BIGINT, best_h) ELSE best_h END AS new_h FROM best)"""


@query(
    "image_resize_and_pad",
    f"""WITH {D.SIZES}, {_BEST}, {_PADDED}
    SELECT image_id, new_w::BIGINT AS new_w, new_h::BIGINT AS new_h, ((best_w - new_w)//2)::BIGINT AS paste_x, ((best_h - new_h)//2)::BIGINT AS paste_y FROM padded""",
)
def image_resize_and_pad(spark, sf):
    best = I.with_best_resolution(D.sizes(spark, sf), RESOLUTIONS)
    geo = G.padded_resize("w", "h", "best_w", "best_h")
    return best.select("image_id", *[c.cast("bigint").alias(n) for n, c in geo.items()])


@query(
    "image_patch_boxes",
    f"""WITH {D.SIZES}, t AS (SELECT image_id, i, j, ((w + 335)//336) AS n FROM sizes, range(0, 10) r(i), range(0, 10) c(j)
      WHERE i < (h + 335)//336 AND j < (w + 335)//336)
    SELECT image_id, (i*n + j)::BIGINT AS patch_no, (j*336)::BIGINT AS x1, (i*336)::BIGINT AS y1, (j*336 + 336)::BIGINT AS x2, (i*336 + 336)::BIGINT AS y2 FROM t""",
)
def image_patch_boxes(spark, sf):
    return I.patch_boxes(D.sizes(spark, sf), 336).select("image_id", "patch_no", "x1", "y1", "x2", "y2")


@query(
    "image_tile_manifest",
    f"""WITH {D.SIZES}, {_BEST}, {_PADDED}, t AS (
      SELECT image_id, i*(best_w//336) + j + 1 AS tile, j*336 AS x1, i*336 AS y1, j*336 + 336 AS x2, i*336 + 336 AS y2
      FROM padded, range(0, 4) r(i), range(0, 4) c(j) WHERE i < best_h//336 AND j < best_w//336
      UNION ALL SELECT image_id, 0, 0, 0, w, h FROM padded)
    SELECT image_id, tile::BIGINT AS tile, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2 FROM t""",
)
def image_tile_manifest(spark, sf):
    return I.processed_sizes(D.sizes(spark, sf), "anyres", RESOLUTIONS, 336).select(
        "image_id", "tile", "x1", "y1", "x2", "y2"
    )


@query(
    "image_square_canvas",
    f"""WITH {D.SIZES} SELECT image_id, greatest(w, h) AS side, (greatest(w, h) - w)//2 AS paste_x, (greatest(w, h) - h)//2 AS paste_y FROM sizes""",
)
def image_square_canvas(spark, sf):
    return I.processed_sizes(D.sizes(spark, sf), "pad", RESOLUTIONS, 336).select("image_id", "side", "paste_x", "paste_y")


@query(
    "image_served_sizes",
    f"""WITH {D.SIZES}, m AS (SELECT *, CASE image_id % 4 WHEN 0 THEN 'Pad' WHEN 1 THEN 'Default' WHEN 2 THEN 'Crop' ELSE 'Resize' END AS mode FROM sizes),
    a AS (SELECT *, CASE mode WHEN 'Pad' THEN greatest(w, h) WHEN 'Resize' THEN 336 ELSE w END AS w1,
                    CASE mode WHEN 'Pad' THEN greatest(w, h) WHEN 'Resize' THEN 336 ELSE h END AS h1 FROM m),
    b AS (SELECT *, greatest(w1, h1)/least(w1, h1)::DOUBLE AS asp FROM a),
    c AS (SELECT *, trunc(least(1344/asp, 672, least(w1, h1)))::BIGINT AS s FROM b)
    SELECT image_id, mode,
      CASE WHEN greatest(w1, h1) > 1344 THEN CASE WHEN h1 > w1 THEN s ELSE trunc(s*asp)::BIGINT END ELSE w1 END AS out_w,
      CASE WHEN greatest(w1, h1) > 1344 THEN CASE WHEN h1 > w1 THEN trunc(s*asp)::BIGINT ELSE s END ELSE h1 END AS out_h FROM c""",
)
def image_served_sizes(spark, sf):
    s = D.sizes(spark, sf).withColumn(
        "mode", F.expr("element_at(array('Pad','Default','Crop','Resize'), cast(image_id % 4 as int) + 1)")
    )
    geo = G.served_size("w", "h", "mode")
    return s.select("image_id", "mode", *[c.alias(n) for n, c in geo.items()])


_UNPAD = """gs AS (SELECT *, best_w//336 AS gw, best_h//336 AS gh, best_w//336*24 AS cw, best_h//336*24 AS ch FROM best),
un AS (SELECT *, CASE WHEN w/h::DOUBLE > cw/ch::DOUBLE THEN 0 ELSE (cw - trunc(w*(ch/h::DOUBLE))::BIGINT)//2 END AS pad_x,
                CASE WHEN w/h::DOUBLE > cw/ch::DOUBLE THEN (ch - trunc(h*(cw/w::DOUBLE))::BIGINT)//2 ELSE 0 END AS pad_y FROM gs)"""


@query(
    "image_unpadded_window",
    f"""WITH {D.SIZES}, {_BEST}, {_UNPAD} SELECT image_id, pad_x::BIGINT AS pad_x, pad_y::BIGINT AS pad_y,
       (cw - 2*pad_x)::BIGINT AS out_w, (ch - 2*pad_y)::BIGINT AS out_h FROM un""",
)
def image_unpadded_window(spark, sf):
    g = I.grid_shape(D.sizes(spark, sf), RESOLUTIONS, 336)
    win = G.unpadded_window("w", "h", F.col("grid_w") * 24, F.col("grid_h") * 24)
    return g.select("image_id", *[c.cast("bigint").alias(n) for n, c in win.items()])


@query(
    "image_expected_tokens",
    f"""WITH {D.SIZES}, {_BEST}, {_UNPAD} SELECT image_id, gw::BIGINT AS grid_w, gh::BIGINT AS grid_h, ((gw*gh + 1)*576)::BIGINT AS flat_tokens,
       (576 + (ch - 2*pad_y)*(cw - 2*pad_x + 1))::BIGINT AS unpad_tokens FROM un""",
)
def image_expected_tokens(spark, sf):
    flat = I.expected_tokens(D.sizes(spark, sf), RESOLUTIONS, 336, 24, "flat").withColumnRenamed("image_tokens", "flat_tokens")
    return I.expected_tokens(flat, RESOLUTIONS, 336, 24, "spatial_unpad").select(
        "image_id", "grid_w", "grid_h", "flat_tokens", F.col("image_tokens").alias("unpad_tokens")
    )


@query(
    "box_phrases",
    f"""WITH {D.INT_BOXES} SELECT image_id, box_no,
      'label' || label_id || ' [' || array_to_string(list_transform([x1, y1, x2, y2], lambda v:
        CASE WHEN v % 100 = 0 THEN (v//100) || '.0' WHEN v % 10 = 0 THEN (v//100) || '.' || (v % 100)//10
             ELSE (v//100) || '.' || lpad((v % 100)::VARCHAR, 2, '0') END), ', ') || ']' AS phrase FROM int_boxes""",
)
def box_phrases(spark, sf):
    from ..operators.prompts import box_phrase

    return D.boxes(spark, sf).select("image_id", "box_no", box_phrase().alias("phrase"))


@query(
    "pixel_box_counts",
    f"""WITH {D.BOXES} SELECT label, count(*) AS n, sum((trunc(x_max*640) - trunc(x_min*640)) * (trunc(y_max*480) - trunc(y_min*480)))::BIGINT AS px
    FROM boxes GROUP BY label""",
)
def pixel_box_counts(spark, sf):
    from ..sources.readers import pixel_boxes

    images = D.table(spark, sf, "orders").selectExpr("o_orderkey as image_id", "640L as w", "480L as h")
    px = pixel_boxes(D.boxes(spark, sf), images)
    return px.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(G.area(*B.XYXY)).alias("px"))


