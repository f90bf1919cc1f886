"""Write, read back, compare; small files of every input form."""

from __future__ import annotations

import gzip
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader

from kerbline.operators import conversations as C
from kerbline.operators import goals as GO
from kerbline.operators import records as RC
from kerbline.plans import QUERIES
from kerbline.sources import readers as RD
from kerbline.sources import writers as WR
from kerbline.streaming import logs as L


def write(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, content in files.items():
        mode = "wb" if isinstance(content, bytes) else "w"
        with open(folder / name, mode) as f:
            f.write(content)
    return str(folder)


def test_images_by_suffix_and_name(spark, tmp_path):
    path = write(tmp_path / "img", {"b.png": b"x", "a.JPG": b"y", "c.txt": b"z", "d.PNG": b"w", "e.jpeg": b"x"})
    assert [r.filename for r in RD.list_images(spark, path).collect()] == ["a.JPG", "b.png", "e.jpeg"]
    unique = RD.unique_images(RD.list_images(spark, path, with_content=True))
    assert unique.count() == 2


VOC = """<annotation><size><width>200</width><height>100</height></size>
<object><name>car</name><bndbox><xmin>10</xmin><ymin>5</ymin><xmax>250</xmax><ymax>50</ymax></bndbox><score>0.7</score></object>
<object><name>door</name><bndbox><xmin>-5</xmin><ymin>0</ymin><xmax>100</xmax><ymax>99</ymax></bndbox></object></annotation>"""


def test_detections(spark, tmp_path):
    path = write(tmp_path / "voc", {"p1.xml": VOC})
    rows = RD.read_detections(spark, path, min_score=0.7).collect()  # the limit is strict, a missing score is 1
    assert [(r.image_id, r.label, r.x_min, r.y_min, r.x_max, r.y_max, r.score) for r in rows] == [
        ("p1", "door", 0.0, 0.0, 0.5, 0.99, 1.0)
    ]
    assert RD.read_detections(spark, path).count() == 2
    car = RD.read_detections(spark, path).filter("label = 'car'").first()
    assert (car.x_max, car.y_min) == (1.0, 0.05)


def test_goal_files(spark, tmp_path):
    xml = write(tmp_path / "g", {"a.xml": "<annotation><goal_position><x>0.25</x><y>0.5</y></goal_position></annotation>", "b.xml": "<annotation><other>1</other></annotation>"})
    assert [(r.image_id, r.cx, r.cy) for r in RD.read_goal_xml(spark, xml).collect()] == [("a", 0.25, 0.5)]
    text = write(tmp_path / "t", {"a.txt": "320 120\nnote\n"})
    sizes = spark.createDataFrame([("a", 640, 480)], "image_id string, w int, h int")
    row = GO.goals_from_pixels(RD.read_goal_text(spark, text), sizes).first()
    assert (row.cx, row.cy) == (0.5, 0.25)
    rec = write(tmp_path / "r", {"a.xml": "<Annotation><goal_position_xy>[0.5, 0.75]</goal_position_xy><goal_object_label>door</goal_object_label></Annotation>"})
    row = RD.read_goal_record(spark, rec).first()
    assert (row.image_id, row.label, row.cx, row.cy) == ("a", "door", 0.5, 0.75)


def test_npy_rasters_and_size_check(spark, tmp_path):
    grid = np.arange(12, dtype=np.float32).reshape(3, 4)
    buf = io.BytesIO()
    np.save(buf, grid)
    path = write(tmp_path / "npy", {"a.npy": buf.getvalue(), "b.npy": buf.getvalue()})
    raster = RD.read_npy_rasters(spark, path)
    got = {(r.y, r.x): r.depth for r in raster.filter("image_id = 'a'").collect()}
    assert got == {(y, x): float(grid[y, x]) for y in range(3) for x in range(4)}
    sizes = spark.createDataFrame([("a", 3, 4), ("b", 3, 5)], "image_id string, h long, w long")
    good, rejects = RD.check_raster_sizes(raster, sizes)
    assert good.select("image_id").distinct().first().image_id == "a"
    assert [r.image_id for r in rejects.collect()] == ["b"]


def test_stored_paths(spark, tmp_path):
    path = write(
        tmp_path / "paths",
        {"a.json": json.dumps({"result": "Path is planned.", "path": [[3, 1], [0, 2]]}), "b.json": json.dumps({"result": "No path found", "path": []})},
    )
    sizes = spark.createDataFrame([("a", 4, 8), ("b", 4, 8)], "image_id string, w long, h long")
    points, failed = RD.read_stored_paths(spark, path, sizes)
    assert [(r.seq, r.x, r.y) for r in points.orderBy("seq").collect()] == [(0, 0.25, 0.375), (1, 0.5, 0.0)]
    assert [(r.image_id, r.x, r.y) for r in failed.collect()] == [("b", 0.0, 0.0)]


def test_lines_labels_examples(spark, tmp_path):
    path = write(tmp_path / "l", {"labels.txt": " door \nstairs\n\n"})
    assert [r.label for r in RD.read_labels(spark, path).collect()] == ["door", "stairs"]
    images = write(tmp_path / "ex" / "images", {"b.png": b"1", "a.jpg": b"1", "c.JPG": b"1"})
    prompts = write(tmp_path / "ex" / "prompt", {"a.txt": "q1\n\nq2\nskip\n", "b.txt": "x\ny\nz", "c.txt": "no\n"})
    rows = RD.read_examples(spark, images, prompts).collect()
    assert [(r.filename, r.prompt_lines) for r in rows] == [("a.jpg", ["q1", "q2"]), ("b.png", ["x", "z"])]


def test_records_xml_round_trip(spark, tmp_path):
    rows = [("a.jpg", "there & here", "walk <now>"), ("b.jpg", "x", None)]
    df = spark.createDataFrame(rows, "filename string, dest_desc string, recommend string")
    df = df.withColumn("goal_position_xy", F.array(F.lit(0.5), F.lit(0.75)))
    path = str(tmp_path / "rec")
    WR.write_record_xml(df, path)
    got = {(r.filename, r.dest_desc, r.recommend, r.left_desc) for r in RD.read_records(spark, path).collect()}
    assert got == {("a.jpg", "there & here", "walk <now>", None), ("b.jpg", "x", None, None)}
    goals = RD.read_goal_record(spark, path).collect()
    assert sorted((r.image_id, r.cx, r.cy) for r in goals) == [("a", 0.5, 0.75), ("b", 0.5, 0.75)]


def test_truth_takes_the_first_simple_text(spark, tmp_path):
    xml = "<annotation><dest><complex>long</complex><simple>short</simple></dest><left><simple>L</simple></left><left><simple>L2</simple></left><recommend>go</recommend></annotation>"
    path = write(tmp_path / "gt" / "deep", {"a.xml": xml})
    row = RD.read_truth(spark, str(tmp_path / "gt")).first()
    assert (row.filename, row.dest, row.left, row.right, row.path, row.recommend) == ("a.xml", "short", "L", None, None, "go")
    assert path


def test_answer_pairs_and_samples(spark, tmp_path):
    path = write(tmp_path / "pairs", {"a.xml": "<Annotation><image_filename>p.v1.jpg</image_filename><answer>go on</answer></Annotation>"})
    pairs = RD.read_answer_pairs(spark, path)
    out = str(tmp_path / "samples")
    WR.write_samples(pairs, out, image="image_filename", answer="answer")
    sample = spark.read.schema(RD.SAMPLE_SCHEMA).json(out).first()
    assert (sample.id, sample.image) == ("p", "p.v1.jpg")
    assert sample.conversations[1]["from"] == "navigation assistant" and sample.conversations[1]["value"] == "go on"


def test_sample_turns_feed_lengths(spark, tmp_path):
    data = [
        {"id": "a", "image": "a.jpg", "conversations": [{"from": "human", "value": "<image>\nhi there"}, {"from": "gpt", "value": "ok"}]},
        {"id": "b", "conversations": [{"from": "human", "value": "one"}, {"from": "gpt", "value": "two three"}]},
    ]
    path = write(tmp_path / "s", {"train.json": json.dumps(data)})
    turns = RD.sample_turns(RD.read_samples(spark, path))
    got = {r.conv_id: (r.length, r.modality_length) for r in C.conversation_lengths(turns).collect()}
    assert got == {"a": (132, 4), "b": (3, -3)}


def test_last_line_of_a_key_wins(spark, tmp_path):
    lines = [{"question_id": 1, "text": "old"}, {"question_id": 2, "text": "two"}, {"question_id": 1, "text": "new"}]
    path = write(tmp_path / "j", {"a.jsonl": "\n".join(json.dumps(x) for x in lines)})
    got = {r.question_id: r.text for r in RD.read_keyed_jsonl(spark, path, "question_id long, text string", "question_id").collect()}
    assert got == {1: "new", 2: "two"}


def test_keyed_maps_and_splits(spark, tmp_path):
    path = write(tmp_path / "m", {"problems.json": json.dumps({"7": {"choices": ["a", "b"], "answer": 1}})})
    row = RD.read_keyed_map(spark, path, "struct<choices:array<string>,answer:int>", "question_id").first()
    assert (row.question_id, row.choices, row.answer) == ("7", ["a", "b"], 1)
    splits = write(tmp_path / "sp", {"pid_splits.json": json.dumps({"test": ["7", "9"], "train": ["8"]})})
    rows = RD.read_keyed_map(spark, splits, "array<string>", "split").collect()
    assert sorted((r.split, r.member) for r in rows) == [("test", "7"), ("test", "9"), ("train", "8")]


def test_tsv_and_base64(spark, tmp_path):
    path = write(tmp_path / "tsv", {"q.tsv": "index\tquestion\timage\n3\twhat\tYWJj\n"})
    row = RD.decode_images(RD.read_tsv(spark, path, "index int, question string, image string")).first()
    assert (row["index"], bytes(row.content)) == (3, b"abc")


def test_chat_log_batch_and_stream(spark, tmp_path):
    events = [
        {"tstamp": 1704067200.5, "type": "chat", "model": "m", "ip": "x", "start": 1.0, "finish": 3.5, "images": ["h"]},
        {"tstamp": 1704067300.25, "type": "upvote", "model": "m", "ip": "x"},
        {"tstamp": 1704240000.0, "type": "flag", "model": "m", "ip": "x"},
    ]
    path = write(tmp_path / "log", {"2024-01-01-conv.json": "\n".join(json.dumps(e) for e in events)})
    batch = RD.read_chat_log(spark, path)
    votes = L.votes_per_model(batch).collect()
    assert sum(v.upvote for v in votes) == 1 and sum(v.flag for v in votes) == 1
    assert L.chat_latency(batch).first().mean_s == 2.5
    closed = L.run_available(L.daily_log(RD.read_chat_log(spark, path, streaming=True)), "daily-test")
    assert sorted((r.type, r.n) for r in closed.collect()) == [("chat", 1), ("upvote", 1)]


def test_score_report(spark, tmp_path):
    scores = spark.createDataFrame([("a", "dest", "m", 1.0), ("b", "dest", "m", 2.0)], "filename string, tag string, metric string, value double")
    errors = spark.createDataFrame([("c", "left", "gt")], "filename string, tag string, missing_side string")
    folder = str(tmp_path / "report")
    WR.write_score_report(scores, errors, folder)
    row = spark.read.parquet(f"{folder}/avg_scores").first()
    assert (row.tag, row.metric, row.mean_value, row.n) == ("dest", "m", 1.5, 2)
    assert spark.read.parquet(f"{folder}/tag_scores").count() == 2 and spark.read.parquet(f"{folder}/errors").count() == 1


def test_reviews_resume(spark, tmp_path):
    path = str(tmp_path / "reviews")
    todo = spark.range(1, 6).selectExpr("id", "concat('r', id) as content")
    WR.append_reviews(todo.filter("id <= 2"), path)
    rest = WR.pending_reviews(todo, spark.read.schema("id long, content string").json(path))
    assert sorted(r.id for r in rest.collect()) == [3, 4, 5]
    WR.append_reviews(rest, path)
    assert spark.read.schema("id long").json(path).count() == 5


def test_result_maps_and_web_table(spark, tmp_path):
    rows = spark.createDataFrame([(2, 1, "B"), (1, 0, "A")], "question_id long, result long, output string")
    rows = rows.unionByName(spark.createDataFrame([(10, None, 'say "no",\n{}: \\ é')], rows.schema)).repartition(3)
    path = str(tmp_path / "results")
    WR.write_result_map(rows, spark.createDataFrame([(50.0, 1, None)], "acc double, correct long, n long"), path)
    lines = [line for f in sorted((tmp_path / "results").glob("part-*")) for line in f.read_text().splitlines()]
    whole = json.loads("\n".join(lines))
    assert whole["results"] == {"1": 0, "10": None, "2": 1} and list(whole["outputs"]) == ["1", "10", "2"]
    assert whole["outputs"]["10"] == 'say "no",\n{}: \\ é' and (whole["acc"], whole["correct"], whole["n"]) == (50.0, 1, None)
    back = RD.read_result_map(spark, path)
    assert {(int(r.question_id), r.result, r.output) for r in back.collect()} == {tuple(r) for r in rows.collect()}
    plan = WR.result_map_lines(rows, spark.range(1))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "map_from_entries" not in plan
    WR.write_result_map(rows.limit(0), spark.range(1), path)
    assert json.loads("\n".join(line for f in sorted((tmp_path / "results").glob("part-*")) for line in f.read_text().splitlines())) == {"id": 0, "results": {}, "outputs": {}}
    recs = spark.createDataFrame(
        [(2, "c", "q", "x", "y", "e", 8.0, 9.0), (1, "c", "q", "x", "y", "e", 1.0, 2.0)],
        "id int, category string, question string, answer1 string, answer2 string, evaluation string, score1 double, score2 double",
    )
    path = str(tmp_path / "web")
    WR.write_web_table(recs, path)
    assert [json.loads(r.value)["id"] for r in spark.read.text(path).collect()] == [1, 2]


def test_answers_are_appended(spark, tmp_path):
    path = str(tmp_path / "answers")
    df = spark.createDataFrame([(1, "a", {})], "question_id long, text string, metadata map<string,string>")
    WR.write_answers(df, path)
    WR.write_answers(df, path)
    assert spark.read.json(path).count() == 2


def test_reuse_without_flags_is_no_reuse(spark):
    fresh = spark.createDataFrame([(1, "n")], "image_id long, dest_desc string")
    old = spark.createDataFrame([(1, "o")], "image_id long, dest_desc string")
    assert RC.reuse_answers(fresh, old, None).first().dest_desc == "n"
    assert RC.reuse_answers(fresh, old.limit(0), {"dest_desc": True}).first().dest_desc is None


@pytest.mark.parametrize("cached", [0, 1])
def test_cache_computes_missing_only(spark, cached):
    images = spark.range(3).withColumnRenamed("id", "image_id")
    have = images.filter(F.col("image_id") < cached).withColumn("v", F.lit("cached"))
    got = GO.fill_cache(images, have, lambda m: m.withColumn("v", F.lit("new")))
    assert sorted((r.image_id, r.v) for r in got.collect()) == [(i, "cached" if i < cached else "new") for i in range(3)]


def test_stream_of_a_table_in_part_files(spark, tmp_path):
    rows = spark.range(10).selectExpr("id as image_id", "id * 2 as n").repartition(3)
    rows.write.parquet(str(tmp_path / "many.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "other.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("part-*.parquet")).rename(tmp_path / "one.parquet")
    for name in ("many.parquet", "one.parquet"):
        out = str(tmp_path / f"out-{name}")
        for _ in range(2):
            L.generate_incrementally(L.stream_table(spark, str(tmp_path), name, rows.schema), out, lambda todo: todo)
        assert sorted(r.n for r in spark.read.parquet(out).collect()) == list(range(0, 20, 2))


def test_files_are_dealt_to_bounded_tasks(spark, tmp_path, monkeypatch):
    """One partition of 95 rows is written by ten tasks, each into a folder of its own."""
    monkeypatch.setattr(WR, "FILES_PER_TASK", 10)
    rows = spark.range(95).coalesce(1).selectExpr("concat(id, '.png') as name", "concat('text ', id) as content")
    assert WR.write_files(rows, str(tmp_path / "nested"), nested=True) == 95
    folders = [sorted(f.name for f in d.iterdir() if not f.name.startswith(".")) for d in (tmp_path / "nested").iterdir()]
    assert len(folders) == 10 and max(map(len, folders)) < 40
    assert sorted(n for f in folders for n in f) == sorted(f"{i}.png" for i in range(95))
    assert WR.write_files(rows, str(tmp_path / "flat")) == 95 and (tmp_path / "flat" / "7.png").read_text() == "text 7"


def test_a_listing_is_written_before_it_is_sorted(spark, tmp_path):
    """Sorting reads its input twice; the files are looked up once, and many of them by one task."""
    rows = spark.range(70).selectExpr("concat(id, '.png') as name", "'x' as content")
    WR.write_files(rows, str(tmp_path / "f"), nested=True)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    listed = RD.list_images(spark, f"{tmp_path}/f/*")
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "binaryFile" not in plan
    assert [r.filename for r in listed.collect()] == sorted(f"{i}.png" for i in range(70))
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost


def folders_of(tmp_path, files):
    """Three folders of equal files below one, and the pattern that names them."""
    for k in range(3):
        write(tmp_path / "many" / str(k), {name.format(k): content for name, content in files.items()})
    return str(tmp_path / "many") + "/*"


def test_image_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Neither the listing nor the bytes go through a reader whose files the driver holds."""
    path = folders_of(tmp_path, {"b{}.png": b"x", "a{}.jpeg": b"yy", ".h{}.png": b"z", "e{}.png": b"", "n{}.txt": b"n"})
    monkeypatch.setattr(DataFrameReader, "format", lambda self, kind: pytest.fail(kind))
    want = [(f"a{k}.jpeg", 2) for k in range(3)] + [(f"b{k}.png", 1) for k in range(3)]
    assert [(r.filename, r.length) for r in RD.list_images(spark, path).collect()] == want
    rows = RD.list_images(spark, path, with_content=True).collect()
    assert [(r.image_id, bytes(r.content)) for r in rows] == [(f"a{k}", b"yy") for k in range(3)] + [(f"b{k}", b"x") for k in range(3)]
    assert rows[0].path == f"file:{path[:-1]}0/a0.jpeg"


def test_goal_texts_are_read_by_tasks(spark, tmp_path, monkeypatch):
    path = folders_of(tmp_path, {"p {}.txt": "1 2\nx", "q{}.txt": " 3\n", "e{}.txt": "", "_h{}.txt": "5 6"})
    monkeypatch.setattr(DataFrameReader, "text", lambda *a, **k: pytest.fail("text"))
    got = sorted((r.image_id, r.px, r.py) for r in RD.read_goal_text(spark, path).collect())
    assert got == [(f"p%20{k}", 1.0, 2.0) for k in range(3)] + [(f"q{k}", None, 3.0) for k in range(3)]


def test_packed_texts_and_key_folders_are_left_to_the_engine(spark, tmp_path):
    packed = write(tmp_path / "z", {"a.txt.gz": gzip.compress(b"1 2"), "b.txt": "3 4"})
    assert sorted((r.image_id, r.px) for r in RD.read_goal_text(spark, packed).collect()) == [("a.txt", 1.0), ("b", 3.0)]
    write(tmp_path / "keys" / "day=1", {"a.png": b"1"})
    write(tmp_path / "keys" / "day=2", {"b.png": b"22"})
    assert [(r.filename, r.length) for r in RD.list_images(spark, str(tmp_path / "keys")).collect()] == [("a.png", 1), ("b.png", 2)]


def test_examples_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    images = folders_of(tmp_path / "i", {"a{}.png": b"1", "b{}.JPG": b"1"})
    texts = folders_of(tmp_path / "t", {"a{}.txt": "q\nskip\n r \n", "b{}.txt": "no"})
    monkeypatch.setattr(DataFrameReader, "format", lambda self, kind: pytest.fail(kind))
    monkeypatch.setattr(DataFrameReader, "text", lambda *a, **k: pytest.fail("text"))
    rows = RD.read_examples(spark, images, texts).collect()
    assert [(r.filename, r.prompt_lines) for r in rows] == [(f"a{k}.png", ["q", "r"]) for k in range(3)]


def test_goal_xml_is_read_some_files_at_a_time(spark, tmp_path, monkeypatch):
    goal = "<annotation><goal_position><x>0.25</x><y>{}</y></goal_position></annotation>"
    path = folders_of(tmp_path, {"a{}.xml": goal.format(1), "b{}.xml": f"<r>{goal.format(2)}{goal.format(3)}</r>", "c{}.xml": "<annotation/>"})
    (tmp_path / "many" / "0").rename(tmp_path / "many" / "[0]{x}")
    asked, load = [], DataFrameReader.load
    monkeypatch.setattr(RD, "FILES_AT_ONCE", 6)
    monkeypatch.setattr(DataFrameReader, "load", lambda self, path=None, *a, **k: (asked.append(path), load(self, path, *a, **k))[1])
    got = sorted((r.image_id, r.cy) for r in RD.read_goal_xml(spark, path).collect())
    assert got == [(f"a{k}", 1.0) for k in range(3)] + [(f"b{k}", y) for k in range(3) for y in (2.0, 3.0)]
    assert sorted(map(len, asked)) == [1, 2]


def test_record_files_are_read_some_files_at_a_time(spark, tmp_path, monkeypatch):
    """Many files a task, and no plan over all files."""
    monkeypatch.setattr(RD, "FILES_AT_ONCE", 100)
    monkeypatch.setattr(WR, "FILES_PER_TASK", 40)
    docs = spark.createDataFrame([(i, f" text {i} ", "en") for i in range(300)], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    asked, load = [], DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "load", lambda self, path=None, *a, **k: (asked.append(path), load(self, path, *a, **k))[1])
    rows = QUERIES["record_files"](spark, str(tmp_path)).collect()
    assert sorted((r.filename, r.dest_desc, r.recommend, r.file) for r in rows) == sorted((f"{i}.jpg", f"text {i}", "en", f"{i}.xml") for i in range(300))
    assert len(asked) > 2 and sum(map(len, asked)) == 8
