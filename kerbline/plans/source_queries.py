"""Round trips: tables are written by a sink, read back by a source and compared with their origin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import readers as RD
from ..sources import writers as WR
from . import fixtures as D
from .registry import query

_BLANK = r"regexp_replace(text, '^[\s]+|[\s]+$', '', 'g')"


def _documents(spark, sf):
    return D.table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))


def _records(spark, sf) -> str:
    rows = _documents(spark, sf).select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("filename"),
        F.col("text").alias("dest_desc"),
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("<"), F.col("lang"), F.lit("> & "), F.col("source"))).alias("recommend"),
        F.array((F.col("doc_id") % 7) / 8, (F.col("doc_id") % 5) / 4).alias("goal_position_xy"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("goal_object_label"),
    )
    path = scratch_path(spark, "records")
    WR.write_record_xml(rows, path)
    return path


@query(
    "records_xml_goals",
    "SELECT doc_id::VARCHAR AS image_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'point' END AS label, (doc_id % 7)/8.0::DOUBLE AS cx, (doc_id % 5)/4.0::DOUBLE AS cy FROM documents",
)
def records_xml_goals(spark, sf):
    """Goals of earlier records, each under the image its record names."""
    return RD.read_goal_record(spark, _records(spark, sf))


@query(
    "records_xml_texts",
    f"SELECT doc_id || '.jpg' AS filename, {_BLANK} AS dest_desc, CASE WHEN doc_id % 3 > 0 THEN '<' || lang || '> & ' || source END AS recommend FROM documents",
)
def records_xml_texts(spark, sf):
    return RD.read_records(spark, _records(spark, sf)).select("filename", "dest_desc", "recommend")


@query(
    "truth_xml_texts",
    f"SELECT {_BLANK} AS dest, lang AS \"left\", NULL::VARCHAR AS \"right\", source AS path, doc_id::VARCHAR AS recommend FROM documents",
)
def truth_xml_texts(spark, sf):
    """The simple text of each field; a field that is absent is null."""
    both = lambda simple: F.struct(simple.alias("simple"), F.lit("long").alias("complex"))
    rows = _documents(spark, sf).select(
        both(F.col("text")).alias("dest"), both(F.col("lang")).alias("left"), both(F.col("source")).alias("path"), F.col("doc_id").cast("string").alias("recommend")
    )
    path = scratch_path(spark, "truth")
    WR.write_record_xml(rows, path, "annotations", "annotation")
    return RD.read_truth(spark, path).drop("filename")


@query("labels_text", "SELECT lang || source AS label, count(*) AS n FROM documents GROUP BY 1")
def labels_text(spark, sf):
    """Label lists: one per line, blanks around them and empty lines dropped."""
    lines = D.table(spark, sf, "documents").select(F.explode(F.array(F.concat(F.lit("  "), "lang", "source", F.lit(" ")), F.lit(""))).alias("value"))
    path = scratch_path(spark, "labels")
    lines.write.text(path)
    return RD.read_labels(spark, path).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "answer_pairs_xml_samples",
    f"SELECT doc_id::VARCHAR AS conv_id, doc_id || '.jpg' AS image, 'navigation assistant' AS role, {_BLANK} AS text FROM documents WHERE {_BLANK} <> ''",
)
def answer_pairs_xml_samples(spark, sf):
    """Answer pairs from XML to training samples to turns; the assistant's turn is the answer."""
    rows = _documents(spark, sf).filter("text <> ''").select(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image_filename"), F.col("text").alias("answer"))
    pairs, samples = scratch_path(spark, "pairs"), scratch_path(spark, "samples")
    WR.write_record_xml(rows, pairs)
    WR.write_samples(RD.read_answer_pairs(spark, pairs), samples, "image_filename", "answer")
    turns = RD.sample_turns(spark.read.schema(RD.SAMPLE_SCHEMA).json(samples))
    return turns.filter("turn = 1").select("conv_id", "image", "role", "text")


@query("questions_tsv", "SELECT doc_id AS \"index\", text AS question, lang AS \"A\", n_chars AS n FROM documents")
def questions_tsv(spark, sf):
    """Tab-separated questions with line breaks, quotes and whole texts."""
    path = scratch_path(spark, "tsv")
    rows = D.table(spark, sf, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("question"), F.col("lang").alias("A"), F.col("n_chars").alias("n"))
    rows.write.option("sep", "\t").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return RD.read_tsv(spark, path, "index long, question string, A string, n long")


@query(
    "chat_log_json",
    "SELECT event_type AS type, user_id::VARCHAR AS ip, epoch_us(ts) // 1000000 AS second, count(*) AS n FROM events GROUP BY 1, 2, 3",
)
def chat_log_json(spark, sf):
    """Log lines written as JSON and read back with their event time."""
    path = scratch_path(spark, "log")
    events = D.table(spark, sf, "events").select(
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double").alias("tstamp"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("ip")
    )
    WR.write_json(events, path)
    return RD.read_chat_log(spark, path).groupBy("type", "ip", F.unix_seconds("ts").alias("second")).agg(F.count(F.lit(1)).alias("n"))


@query("answers_jsonl", f"SELECT doc_id AS question_id, {_BLANK} AS text, lang AS model_id FROM documents")
def answers_jsonl(spark, sf):
    """Answers appended in two runs, the second repeating a third of the first; the last one wins."""
    path = scratch_path(spark, "answers")
    rows = _documents(spark, sf).select(F.col("doc_id").alias("question_id"), "text", F.col("lang").alias("model_id"))
    again = rows.filter("question_id % 3 = 0")
    WR.write_answers(again.withColumn("text", F.lit("old")), f"{path}/run=1")
    WR.write_answers(rows, f"{path}/run=2")
    return RD.read_keyed_jsonl(spark, path, "question_id long, text string, model_id string", "question_id").drop("run")



def _named(spark, sf, suffix: str, content) -> str:
    """One file per document, named by its id; the folders they are in."""
    folder = scratch_path(spark, "files")
    WR.write_files(D.table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(suffix)).alias("name"), content.alias("content")), folder, nested=True)
    return f"{folder}/*"


@query("images_listed", "SELECT doc_id::VARCHAR AS image_id, doc_id || '.png' AS filename, octet_length(encode(text))::BIGINT AS length FROM documents")
def images_listed(spark, sf):
    """Image files of a folder; the text stands for the bytes."""
    return RD.list_images(spark, _named(spark, sf, ".png", F.col("text"))).select("image_id", "filename", "length")


@query(
    "images_in_order",
    "SELECT doc_id || '.png' AS filename, row_number() OVER (ORDER BY doc_id || '.png') - 1 AS place FROM documents",
)
def images_in_order(spark, sf):
    """The listing written in its order and read back line by line."""
    path = scratch_path(spark, "listing")
    RD.list_images(spark, _named(spark, sf, ".png", F.col("lang"))).select("filename").write.text(path)
    lines = spark.read.text(path).select(F.col("value").alias("filename"), F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("i"))
    at = F.row_number().over(Window.partitionBy("f").orderBy("i")) - 1
    sizes = lines.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("f", (F.sum("n").over(Window.orderBy("f")) - F.col("n")).alias("before"))  # one row a part file
    return lines.withColumn("at", at).join(before, "f").select("filename", (F.col("at") + F.col("before")).alias("place"))


@query("goal_xml_files", "SELECT doc_id::VARCHAR AS image_id, 'point' AS label, (doc_id % 7)/8.0::DOUBLE AS cx, (doc_id % 5)/4.0::DOUBLE AS cy FROM documents WHERE doc_id % 3 > 0")
def goal_xml_files(spark, sf):
    """One annotation file per image; files without a goal give none."""
    xy = F.struct(((F.col("doc_id") % 7) / 8).alias("x"), ((F.col("doc_id") % 5) / 4).alias("y"))
    goal = F.struct(F.col("lang").alias("folder"), F.when(F.col("doc_id") % 3 > 0, xy).alias("goal_position"))
    return RD.read_goal_xml(spark, _named(spark, sf, ".xml", F.to_xml(goal, {"rowTag": "annotation"})))


@query("goal_text_files", "SELECT doc_id::VARCHAR AS image_id, (doc_id % 640)::DOUBLE AS px, (doc_id % 480) + 0.5::DOUBLE AS py FROM documents")
def goal_text_files(spark, sf):
    """Pixel points, one text file per image."""
    line = F.concat((F.col("doc_id") % 640).cast("string"), F.lit(" "), (F.col("doc_id") % 480).cast("string"), F.lit(".5\n"), "lang")
    return RD.read_goal_text(spark, _named(spark, sf, ".txt", line))


@query(
    "example_prompts_read",
    "SELECT doc_id || '.png' AS filename, array_to_string(list_transform(list_filter(list_zip(range(len(l)), l), lambda z: z[1] % 2 = 0), lambda z: trim(z[2], ' \t\n\r')), '|') AS lines FROM (SELECT doc_id, string_split('first ' || lang || chr(10) || 'answer' || chr(10) || ' second ' || source || chr(10) || 'answer', chr(10)) AS l FROM documents)",
)
def example_prompts_read(spark, sf):
    """Example images with the prompt lines beside them."""
    text = F.concat(F.lit("first "), "lang", F.lit("\nanswer\n second "), "source", F.lit("\nanswer\n"))
    shown = RD.read_examples(spark, _named(spark, sf, ".png", F.col("lang")), _named(spark, sf, ".txt", text))
    return shown.select("filename", F.array_join("prompt_lines", "|").alias("lines"))


@query(
    "record_files",
    f"SELECT doc_id || '.jpg' AS filename, {_BLANK} AS dest_desc, lang AS recommend, doc_id || '.xml' AS file FROM documents",
)
def record_files(spark, sf):
    """One XML file per record, named after its image."""
    folder = scratch_path(spark, "record-files")
    rows = _documents(spark, sf).select(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("filename"), F.col("text").alias("dest_desc"), F.col("lang").alias("recommend"))
    WR.write_record_files(rows, folder, nested=True)
    raw = RD.read_xml(spark, f"{folder}/*", "Annotation", "filename string, dest_desc string, recommend string")
    return raw.select("filename", F.coalesce("dest_desc", F.lit("")).alias("dest_desc"), "recommend", "file")


@query(
    "score_report",
    """SELECT 'avg_scores' AS part, lang AS tag, sum(n_chars)/count(*)::DOUBLE AS value, count(*) AS n FROM documents GROUP BY lang
    UNION ALL SELECT 'tag_scores', lang, n_chars, 1 FROM documents UNION ALL SELECT 'errors', source, NULL, 1 FROM documents WHERE doc_id % 9 = 0""",
)
def score_report(spark, sf):
    """Averages, scores and errors of a report, read back from its three tables."""
    docs, folder = D.table(spark, sf, "documents"), scratch_path(spark, "report")
    scores = docs.select(F.col("lang").alias("tag"), F.lit("length").alias("metric"), F.col("n_chars").cast("double").alias("value"))
    WR.write_score_report(scores, docs.filter("doc_id % 9 = 0").select(F.col("source").alias("tag")), folder)
    part = lambda name, value, n: spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("part"), "tag", value.alias("value"), n.alias("n"))
    one = F.lit(1).cast("bigint")
    return part("avg_scores", F.col("mean_value"), F.col("n")).unionByName(part("tag_scores", F.col("value"), one)).unionByName(
        part("errors", F.lit(None).cast("double"), one)
    )
