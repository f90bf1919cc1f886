"""Images to records: goals, paths, regions, region boxes, requests, answers, records.

One lazy plan up to the requests; the answers of each stage are written once, because calls
are costly. The search settles its rounds on the checkpoint folder. A run can leave out finished
images, start from cached goals, take answers of earlier records, or ask for all answers in one turn.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import prompt_texts as P
from ..session import cut_lineage, settle
from . import boxes as B
from . import goals, inference, paths, prompts, records, regions


@dataclass(frozen=True)
class Settings:
    """Defaults of the training-set run; lengths in metres."""

    library: str = "region_views"
    planner: str | None = "depth_lpp"  # None: straight lines only
    line_points: int = 500
    front_difference: float = 10.0
    front_crop: int = 10
    front_zero_base: bool = True
    front_max_degree: float = 0.0  # 0: the centre column; else a seeded bearing within these degrees
    front_circle: bool = False  # a front goal is called a circle, not a point
    path_half_width: float = 1.0
    goal_radius_px: int = 25
    depth_buffer: float = 5.0
    goal_uses_path_mask: bool = True
    camera_by_name: bool = False
    whole_image: bool = False  # every question sees the whole image and all boxes
    box_share: float = 0.1
    per_metre: float = 1.0  # raster units per metre
    single_turn: bool = False  # one request per image asks for all answers
    seed: int = 17


class Run(NamedTuple):
    """``goals`` are the next run's goal cache, ``records`` its finished images."""

    records: DataFrame
    points: DataFrame
    goals: DataFrame


Source = str | tuple[str, DataFrame]


def choose_goals(
    images: DataFrame, depth: DataFrame, sources: list[Source], s: Settings, inputs: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Goals by source: a name of ``goals.GOAL_METHODS``, fed from ``inputs``, or a table with a name."""
    given = goals.GoalInputs(
        images, depth=depth, difference=s.front_difference * s.per_metre, crop=s.front_crop, zero_base=s.front_zero_base,
        max_degree=s.front_max_degree, seed=s.seed, **(inputs or {}),
    )
    tables = [(m, goals.GOAL_METHODS[m](given)) if isinstance(m, str) else m for m in sources if m != "set_front"]
    return goals.resolve_goals(images, tables, goals.GOAL_METHODS["set_front"](given), s.front_circle)


def image_paths(images: DataFrame, depth: DataFrame, goal: DataFrame, stored: DataFrame | None, s: Settings) -> DataFrame:
    """``(image_id, seq, x, y, origin)``: stored, planned or straight path of every image.

    Only images without a stored path are planned, and only their raster is read for it.
    """
    ends = goal.join(images.select("image_id", "h", "w"), "image_id")
    # a row becomes ``line_points`` of them: dealt to all tasks, a small table would else be one
    parts = int(goal.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = paths.straight_line(
        ends.repartition(parts, "image_id").select("image_id", F.lit(0.5).alias("x1"), F.lit(1.0).alias("y1"), F.col("cx").alias("x2"), F.col("cy").alias("y2")),
        s.line_points,
    ).select("image_id", F.col("seq").cast("bigint").alias("seq"), "x", "y")
    none = line.limit(0)
    planned = none
    if s.planner is not None:
        open_ends = ends if stored is None else ends.join(stored.select("image_id").distinct(), "image_id", "left_anti")
        seen = depth if stored is None else depth.join(open_ends.select("image_id"), "image_id", "left_semi")
        points = paths.PLANNERS[s.planner](seen, open_ends.select("image_id", "h", "w", "cx", "cy"), s.per_metre)[1]
        planned = points.select("image_id", "seq", F.col("nx").alias("x"), F.col("ny").alias("y"))
    return cut_lineage(paths.choose_paths(images, none if stored is None else stored, planned, line))


def region_masks(images: DataFrame, depth: DataFrame, goal: DataFrame, path: DataFrame, s: Settings) -> DataFrame:
    """Runs of the regions ``L R P`` and, if configured, ``D``."""
    ratio = G.camera_ratios("filename")[0] if s.camera_by_name else F.lit(0.6)
    sized = images.withColumn("fx", F.col("w") * ratio)
    points = paths.pixel_path(path.select("image_id", "seq", "x", "y"), images).join(
        sized.select("image_id", "fx"), "image_id"
    )
    at_goal = goal.join(images.select("image_id", "h", "w"), "image_id").select(
        "image_id", "h", "w", G.project("cy", "h").alias("py"), G.project("cx", "w").alias("px")
    )
    copies = (("D", "P"),) if s.goal_uses_path_mask else ()
    return regions.final_regions(depth, points, at_goal, s.path_half_width * s.per_metre, s.goal_radius_px, s.depth_buffer * s.per_metre, copies)


def region_boxes(images: DataFrame, boxes: DataFrame, masks: DataFrame | None, s: Settings) -> DataFrame:
    """Boxes with their region; without masks, or for an unmasked goal, all boxes count."""
    every = lambda names: boxes.withColumn("region", F.explode(F.array(*[F.lit(n) for n in names])))
    if masks is None:
        return every(["D", "L", "R", "P"])
    inside = regions.boxes_in_regions(boxes, masks, images, s.box_share)
    kept = boxes.join(inside.select("image_id", "region", "box_no"), ["image_id", "box_no"])
    return kept if s.goal_uses_path_mask else kept.unionByName(every(["D"]).select(kept.columns))


def generate_records(
    images: DataFrame,
    depth: DataFrame,
    boxes: DataFrame,
    sources: list[Source],
    clients,
    settings: Settings = Settings(),
    dropped_labels: DataFrame | None = None,
    stored_paths: DataFrame | None = None,
    inputs: dict[str, DataFrame] | None = None,
    finished: DataFrame | None = None,
    goal_cache: DataFrame | None = None,
    earlier: DataFrame | None = None,
    reuse: dict[str, bool] | None = None,
    **calls,
) -> Run:
    """Records, path points and goals of ``images(image_id, filename, h, w)``.

    ``sources`` are goal methods by name or goal tables, in order of preference; ``inputs`` are the
    tables the named methods read (``goals.GoalInputs``), boxes apart. Images of ``finished`` are
    left out, so a second run over the same images makes no call. ``goal_cache`` gives the goals it
    has; only other images look for one. ``reuse`` flags record fields whose answer comes from
    ``earlier`` records without a call; an image that lacks a flagged answer has no record. Else
    five region answers, the decision over them and the summary are asked for; records with a
    missing answer are left out.
    """
    s = settings
    if finished is not None:
        images = cut_lineage(goals.unfinished(images, finished))
    used = settle(boxes if dropped_labels is None else B.drop_labels(boxes, dropped_labels), "boxes")  # read five times
    find = lambda todo: choose_goals(
        todo, depth.join(todo.select("image_id"), "image_id", "left_semi"), sources, s, {"boxes": used, **(inputs or {})}
    )
    columns = ["image_id", "label", "cx", "cy", "method"]
    if goal_cache is None:
        goal = cut_lineage(find(images).select(*columns))
    else:
        goal = cut_lineage(goals.fill_cache(images, goal_cache.select(*columns), lambda todo: find(todo).select(*columns)))
    path = image_paths(images, depth, goal, stored_paths, s)
    sizes = images.select("image_id", "filename", "h", "w")
    if s.single_turn:
        asked = prompts.single_turn_facts(goal, used)
        keep = (*records.ANSWER_KEYS, "prompt")
        answers = settle(inference.run_requests(asked, clients, keep=keep, build=prompts.single_turn_fan, **calls), "answers")
        return Run(records.assemble_single(answers, goal, sizes), path, goal)
    masks = None if s.whole_image else region_masks(images, depth, goal, path, s)
    facts = prompts.region_facts(goal.select("image_id", "label", "cx", "cy"), region_boxes(images, used, masks, s), used)
    flags = {t: bool((reuse or {}).get(field)) for t, (_, field) in records.RECORD_FIELDS.items()}
    kept = records.earlier_answers(earlier, images, [t for t, on in flags.items() if on]) if any(flags.values()) else None

    def ask(what: DataFrame, build, name: str, targets: list[str]) -> DataFrame:
        """Answers of the flagged targets from earlier records, of the others from calls."""
        todo, out = [t for t in targets if not flags[t]], None
        if todo:
            answered = inference.run_requests(
                what, clients, keep=records.ANSWER_KEYS, build=lambda df: build(df, todo), each=len(todo), **calls
            )
            out = settle(records.region_answers(answered), name)
        if kept is None:
            return out
        old = kept.filter(F.col("target").isin(targets))
        return old if out is None else out.unionByName(old, allowMissingColumns=True)

    first = ask(facts, lambda df, todo: prompts.fan_out(df, s.library, targets=todo), "regions", list(P.TARGETS))
    lists = prompts.box_lists(used, ["image_id"])
    decide = records.decision_facts(records.wide_answers(first), lists)
    second = ask(decide, lambda df, _: records.decision_fan(df, s.library), P.DECISION, [P.DECISION])
    so_far = first.unionByName(second, allowMissingColumns=True)
    third = ask(records.summary_facts(records.wide_answers(so_far)), lambda df, _: records.summary_requests(df), "summaries", ["Sum"])
    wide = records.wide_answers(so_far.unionByName(third, allowMissingColumns=True))
    return Run(records.assemble(wide, goal, sizes, s.library, tuple(t for t, on in flags.items() if not on)), path, goal)
