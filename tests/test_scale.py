"""Hot keys, ordered numbering, batches; no plan that pulls a key into one task."""

from __future__ import annotations

import pathlib
import time

import pytest
from pyspark.sql import functions as F

from kerbline import scale
from kerbline.operators import batches as B
from kerbline.operators import benchmarks as BM
from kerbline.operators import inference as INF
from kerbline.operators import prompts as PR
from kerbline.operators import paths as P
from kerbline.operators import regions as M
from kerbline.plans import fixtures as D
from kerbline.plans import QUERIES
from kerbline.session import SHUFFLES_GO, settle
from kerbline.streaming import logs as L

SOURCE = pathlib.Path(__file__).resolve().parents[1] / "kerbline"


@pytest.fixture(scope="module")
def hot(spark):
    """One key owns two thirds of the rows."""
    return spark.range(3000).selectExpr("id", "case when id % 3 < 2 then 'hot' else concat('k', id % 7) end as k", "id % 11 as v")


def test_settled_table_leaves_no_shuffle_files(spark):
    def files() -> set[str]:
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in held.mkString(",").split(",") if "/shuffle_" in f}

    before, option = files(), spark.conf.get(SHUFFLES_GO, None)
    table = settle(spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count().join(spark.range(100).withColumnRenamed("id", "k").hint("merge"), "k"), "shuffled")
    end = time.monotonic() + 10
    while files() - before and time.monotonic() < end:  # executors delete them in the background
        time.sleep(0.1)
    assert not files() - before and table.count() == 100 and spark.conf.get(SHUFFLES_GO, None) == option


def test_ordered_index_within_hot_key(hot):
    got = scale.ordered_index(hot, ["v", "id"], "n", within=["k"]).collect()
    by_key: dict = {}
    for r in hot.collect():
        by_key.setdefault(r.k, []).append((r.v, r.id))
    want = {(k, i): n + 1 for k, rows in by_key.items() for n, (_, i) in enumerate(sorted(rows))}
    assert {(r.k, r.id): r.n for r in got} == want


def test_ordered_index_over_texts(hot):
    rows = scale.ordered_index(hot, ["k", "id"], "n").orderBy("n").collect()
    assert [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in hot.collect())
    assert [r.n for r in rows] == list(range(1, 3001))


def test_running_mean_of_hot_key(hot):
    got = scale.running_mean(hot.filter("k = 'hot'"), ["k"], ["id"], "v").orderBy("id").collect()
    total = 0
    for n, r in enumerate(got, 1):
        total += r.v
        assert r.n_so_far == n and r.running_mean == total / n


def test_chunks_are_contiguous_and_may_be_fewer(spark):
    df = spark.range(10)
    rows = B.chunked(df, ["id"], 4).orderBy("id").collect()
    assert [r.chunk for r in rows] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert [r.chunk for r in B.chunked(spark.range(5), ["id"], 4).orderBy("id").collect()] == [0, 0, 1, 1, 2]
    assert B.get_chunk(spark.range(5), ["id"], 4, 3).count() == 0


def greedy(lengths, n):
    chunks, load = [[] for _ in range(n)], [0.0] * n
    if len(lengths) % n:
        return [lengths[i::n] for i in range(n)]
    for v in lengths:
        k = min(range(n), key=lambda i: load[i])
        chunks[k].append(v)
        load[k] = float("inf") if len(chunks[k]) == len(lengths) // n else load[k] + v
    return chunks


@pytest.mark.parametrize("rows", [96, 101])
def test_batches_over_ranks(spark, rows):
    df = spark.range(rows).selectExpr("id", "(id * 37) % 91 + 1 as len")
    got = B.length_batches(df, "id", "len", batch_size=4, world_size=3).collect()
    assert sorted(r.id for r in got) == list(range(rows))
    for mega in {r.mega for r in got}:
        part = [r for r in got if r.mega == mega]
        dealt = [[r.len for r in sorted((p for p in part if p["rank"] == k), key=lambda p: p.slot)] for k in range(3)]
        # equal lengths may swap places, the lengths in each place may not
        assert dealt == greedy(sorted((r.len for r in part), reverse=True), 3)


def test_modality_batches_cover_every_row_once(spark):
    df = spark.range(203).selectExpr("id", "case when id % 3 = 0 then id + 1 else -(id + 1) end as len")
    rows = B.modality_batches(df, "id", "len", 4, world_size=2).collect()
    assert sorted(r.id for r in rows) == list(range(203))
    last = max(r.batch_no for r in rows)
    for b in {r.batch_no for r in rows}:
        part = [r for r in rows if r.batch_no == b]
        if b == last:
            assert {r.modality for r in part} == {"image", "text"}
            assert [r.id for r in sorted(part, key=lambda r: r.place)] == sorted(r.id for r in part)
        else:
            assert len({r.modality for r in part}) == 1 and len(part) == 8
    assert len({(r.batch_no, r.place) for r in rows}) == 203


def test_one_modality_has_no_mixed_batch(spark):
    df = spark.range(20).selectExpr("id", "id + 1 as len")
    rows = B.modality_batches(df, "id", "len", 8).collect()
    assert sorted({r.batch_no for r in rows}) == [0, 1, 2]
    for b in (0, 1, 2):
        lens = [r.len for r in sorted((r for r in rows if r.batch_no == b), key=lambda r: r.place)]
        assert lens == sorted(lens, reverse=True)


def test_silent_gaps_of_hot_source(spark):
    ev = spark.range(500).selectExpr(
        "case when id % 5 < 4 then 'hot' else 'cold' end as s", "timestamp_seconds(id * 60 + case when id > 250 then 9000 else 0 end) as ts"
    )
    rows = L.silent_gaps(ev, "s", 3600).collect()
    assert sorted(r.s for r in rows) == ["cold", "hot"]


def test_slice_ends_keep_every_silence_of_a_hot_source(spark, tmp_path):
    """A busy source leaves a few rows per task and slice, and the stream reports what brute force does."""
    rows = spark.range(40_000).selectExpr(
        "case when id % 3 = 0 then concat('s', id % 50) else 'hot' end as s",
        "timestamp_seconds(id + case when id > 20000 then 90000 else 0 end + case when id > 30000 then 7200 else 0 end) as ts",
    ).repartition(8)
    ends = L.slice_ends(rows, "s", 3600)
    hot = ends.filter("s = 'hot'")
    n = hot.count()
    assert n <= 2 * 8 * 16 and hot.select(F.spark_partition_id()).distinct().count() == 8
    rows.unionByName(rows.selectExpr("s", "cast(null as timestamp) as ts").limit(5)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    got = L.run_available(L.stale_sources(stream, "s", 3600), "stale").filter("next_ts is not null")
    want = L.silent_gaps(rows, "s", 3600)
    key = lambda df: sorted((r.s, r.last_seen, r.next_ts) for r in df.collect())
    assert key(got) == key(want) and len(key(want)) >= 100


def test_an_update_rewrites_touched_buckets_only(spark, tmp_path):
    out = str(tmp_path / "table")
    rows = spark.range(1000).selectExpr("id as k", "id as v")
    assert L.read_versions(spark, out, rows.schema).count() == 0
    assert L.merge_batch(rows, 0, out, ["k"], 16) == list(range(16))
    change = spark.createDataFrame([(3, -3), (5000, 1)], rows.schema)
    touched = L.merge_batch(change, 1, out, ["k"], 16)
    assert 1 <= len(touched) <= 2

    def versions() -> dict:
        return {p.name: sorted(v.name for v in p.iterdir() if v.is_dir()) for p in (tmp_path / "table").glob("bucket=*")}

    assert {b for b, v in versions().items() if "version=1" in v} == {f"bucket={b}" for b in touched}
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / "table").glob(f"bucket=*/version={v}/*.parquet"))
    assert size(1) < size(0) / 4  # bytes written by the second batch
    L.merge_batch(change, 1, out, ["k"], 16)  # a repeated micro-batch changes nothing
    got = {r.k: r.v for r in L.read_versions(spark, out, rows.schema).collect()}
    assert got == {**{i: i for i in range(1000)}, 3: -3, 5000: 1}
    L.merge_batch(spark.createDataFrame([(3, 9)], rows.schema), 2, out, ["k"], 16)
    assert all(len(v) <= 2 for v in versions().values()) and len([v for v in versions().values() if v == ["version=1", "version=2"]]) == 1
    assert {r.k: r.v for r in L.read_versions(spark, out, rows.schema).collect()}[3] == 9


def test_a_stream_without_input_gives_an_empty_table(spark, tmp_path):
    spark.range(0).selectExpr("'a' as tag", "'b' as metric", "1.0D as value").write.parquet(str(tmp_path / "none"))
    stream = spark.readStream.schema("tag string, metric string, value double").parquet(str(tmp_path / "none"))
    for mode in ("update", "complete"):
        assert L.run_available(L.running_scores(stream), "none", mode, ("tag", "metric")).count() == 0


def test_calling_tasks_follow_the_requests(spark):
    assert [INF.calling_tasks(n) for n in (0, 1, 256, 257, 10**6)] == [1, 1, 1, 2, INF.IN_FLIGHT]
    requests = spark.range(1000).coalesce(1).selectExpr("id as req_id", "'' as system", "'a b' as prompt", "cast(null as string) as picture")
    answers = INF.run_requests(requests, INF.EchoClient, tries=1)
    assert answers.rdd.getNumPartitions() == 4 and answers.count() == 1000


def test_a_round_of_turns_reads_its_own_files(spark):
    questions = INF.by_turn(spark.range(60).selectExpr("id % 20 as conv_id", "id div 20 as i", "'x' as text"))
    one = questions.filter("i = 1")
    assert one.count() == 20 and {r.f.rsplit("/", 2)[1] for r in one.select(F.input_file_name().alias("f")).collect()} == {"i=1"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(i" in plan


def test_modality_batches_have_a_short_plan(spark):
    rows = spark.range(200).selectExpr("id", "case when id % 3 = 0 then id + 1 else -(id + 1) end as len")
    plan = B.modality_batches(rows, "id", "len", 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 20 and plan.count("Scan parquet") <= 2


@pytest.mark.parametrize("name", ["mask_final_regions", "mask_box_share"])
def test_masks_read_each_table_a_few_times(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 10 and plan.count("Exchange") <= 20


def test_last_duplicate_uses_an_aggregate(hot):
    plan = BM.last_per_key(hot.select("k", "id", "v"), "k", "id")._jdf.queryExecution().toString()
    assert "Window" not in plan and "partial_max_by" in plan


@pytest.mark.parametrize("name", ["boxes_frame_iou", "conversation_prompts", "choice_accuracy", "review_summary", "depth_mask_nearer"])
def test_scans_read_needed_columns_only(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for unused in ("l_extendedprice", "l_comment", "o_totalprice", "props", "label:"):
        assert unused not in plan


def test_filters_reach_the_scan(spark, sf):
    plan = D.pairs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,user)" in plan and "EqualTo(role,assistant)" in plan


def test_no_forced_broadcasts_or_local_checkpoints():
    for f in SOURCE.rglob("*.py"):
        text = f.read_text()
        assert "localCheckpoint(" not in text and "F.broadcast(" not in text, f
        assert "crossJoin(" not in text, f
        assert ".rdd" not in text and "parallelize(" not in text, f


def test_checkpoint_folder_comes_from_the_session(spark):
    from kerbline.session import checkpoint_root

    named = spark.conf.get("spark.checkpoint.dir", None)
    root = checkpoint_root(spark)
    assert root and (named is None or root == named)
    assert scale.seeded_hash(17, F.lit(1)) is not None


def test_update_mode_needs_keys(spark):
    stream = spark.readStream.format("rate").load().groupBy("value").count()
    with pytest.raises(ValueError):
        L.run_available(stream, "x", "update")


@pytest.mark.parametrize("n", [2, 3, 20, 50, 129])
def test_densified_paths_reach_the_count(spark, n):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 2.0), (2, 0, 0.5, 0.5), (3, 0, 0.0, 0.0), (3, 1, 1.0, 0.0), (3, 2, 1.0, 9.0)], "image_id long, seq int, x double, y double")
    rows = P.densify(df, n).collect()
    by = {k: sorted((r.seq, r.x, r.y) for r in rows if r.image_id == k) for k in (1, 2, 3)}
    assert len(by[1]) >= n and len(by[3]) >= n and len(by[2]) == 1
    for path, first, last in ((by[1], (0.0, 0.0), (1.0, 2.0)), (by[3], (0.0, 0.0), (1.0, 9.0))):
        assert [p[0] for p in path] == list(range(len(path))) and path[0][1:] == first and path[-1][1:] == last


def test_points_without_depth_are_rejects(spark):
    raster = spark.createDataFrame([(1, 0, x, 4, 4, float(x % 3)) for x in range(4)], "image_id long, y int, x int, h int, w int, depth double")
    points = spark.createDataFrame([(1, s, s, 0, 4, 4, 100.0, 80.0) for s in range(4)], "image_id long, seq int, px int, py int, h int, w int, fx double, fy double")
    assert sorted(r.seq for r in M.points_without_depth(points, raster).collect()) == [0, 3]
    assert M.path_mask(points, raster, 0.01).count() > 0 and M.path_disc_mask(points, raster, 0.01).count() > 0


def test_a_given_number_of_shards_is_cut_where_they_are_long(spark, monkeypatch):
    rows = spark.range(100).selectExpr("cast(id as string) as req_id", "'' as system", "concat('a b ', id) as prompt", "cast(null as string) as picture")
    assert INF.run_requests(rows, INF.EchoClient, parallel=4, tries=1).rdd.getNumPartitions() == 4
    monkeypatch.setattr(INF, "SHARD_CALLS", 10)
    out = INF.run_requests(rows, lambda: INF.EchoClient(1), parallel=4, tries=1)
    assert out.rdd.getNumPartitions() == 12 and sorted(int(r.text) for r in out.collect()) == list(range(100))


def test_prompts_are_neither_written_nor_shuffled(spark, monkeypatch):
    """The facts of an image are dealt to the calls, and its texts made there; the requests stay the same."""
    goals = spark.createDataFrame([(1, "door", 0.1, 0.2), (2, "car", 0.5, 0.5), (None, "x", 0.0, 0.0)], "image_id long, label string, cx double, cy double")
    boxes = spark.createDataFrame([(1, r, k, "box", 0.1, 0.2, 0.3, 0.4) for r in "LR" for k in (2, 1)], "image_id long, region string, box_no long, label string, x_min double, y_min double, x_max double, y_max double")
    written, real = [], INF.settle
    monkeypatch.setattr(INF, "settle", lambda df, name: written.append(df.columns) or real(df, name))
    facts = PR.region_facts(goals, boxes, boxes)
    got = INF.run_requests(facts, INF.EchoClient, tries=1, keep=("image_id", "target", "system", "prompt"), build=PR.fan_out, each=5).drop("elapsed_s")
    assert written and not {"system", "prompt"} & {c for cols in written for c in cols}
    requests = {(r.image_id, r.target): r for r in PR.region_requests(goals, boxes, boxes).collect()}
    rows = got.collect()
    assert len(rows) == len(requests) == 15
    assert all((r.system, r.prompt) == (requests[r.image_id, r.target].system, requests[r.image_id, r.target].prompt) for r in rows)
    phrase = "box [0.1, 0.2, 0.3, 0.4]"
    assert {t: requests[1, t].system.count(phrase) for t in ("D", "L", "R", "P", "Desc")} == {"D": 0, "L": 2, "R": 2, "P": 0, "Desc": 4}


def test_a_score_trigger_takes_a_part(spark, sf, tmp_path, monkeypatch):
    """The number of batches does not grow with the number of files."""
    spark.read.parquet(f"{sf}/events.parquet").repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    seen, real = [], L.merge_batch
    monkeypatch.setattr(L, "merge_batch", lambda batch, number, *rest: seen.append(number) or real(batch, number, *rest))
    rows = {(r.tag, r.metric): (r.total, r.n) for r in QUERIES["stream_scores_continued"](spark, str(tmp_path)).collect()}
    assert seen == [0, 1, 2]
    assert rows == {(r.tag, r.metric): (r.total, r.n) for r in QUERIES["stream_running_scores"](spark, sf).collect()}


def test_shapes_keep_their_tasks(spark, monkeypatch):
    """A small table of path moves becomes many runs: it is not merged into one task."""
    points = spark.createDataFrame([(i, s, 4 - s, 7 - s, 8, 8) for i in range(20) for s in range(4)], "image_id long, seq int, px long, py long, h long, w long")
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert M.side_runs(points).rdd.getNumPartitions() == own and M.side_runs(points, parts=23).rdd.getNumPartitions() == 23
    assert M._tasks(points) == own
    monkeypatch.setattr(M, "ROWS_PER_TASK", 20)
    assert M._tasks(points) == 32
    assert sorted(M.side_runs(points, parts=23).collect()) == sorted(M.side_runs(points).collect())


def test_boxes_of_images_are_shuffled_by_their_rows(spark, sf, monkeypatch):
    """A task of the shuffle reads the same share of ``lineitem`` at any size."""
    images, seen, real = D.raster_goals(spark, sf).select("image_id"), [], scale.settle
    own, rows = spark.conf.get("spark.sql.shuffle.partitions"), D.table(spark, sf, "lineitem").count()
    monkeypatch.setattr(scale, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(scale, "settle", lambda df, name: seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))) or real(df, name))
    got = D.boxes_of(spark, sf, images)
    assert seen == [-(-rows // 100)] and seen[0] > int(own) and spark.conf.get("spark.sql.shuffle.partitions") == own
    assert sorted(got.collect()) == sorted(D.boxes(spark, sf).join(images, "image_id", "left_semi").collect())
