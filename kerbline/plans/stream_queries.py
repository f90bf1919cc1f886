"""Streams over the event table: each is drained once and compared on closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import logs as L
from . import fixtures as D
from .registry import ORACLES, query

_CLOSED = "d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM chat)"


def _day(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "stream_daily_log",
    f"""WITH {D.CHAT} SELECT strftime(d, '%Y-%m-%d') AS day, type, n FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS d, type, count(*) AS n FROM chat GROUP BY 1, 2) WHERE {_CLOSED}""",
)
def stream_daily_log(spark, sf):
    return _day(L.run_available(L.daily_log(D.chat_events(spark, sf, True)), "daily"))


@query(
    "batch_daily_log",
    f"""WITH {D.CHAT} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, type, count(*) AS n FROM chat GROUP BY 1, 2""",
)
def batch_daily_log(spark, sf):
    return _day(L.daily_log(D.chat_events(spark, sf)))


@query(
    "stream_votes_per_model",
    f"""WITH {D.CHAT} SELECT strftime(d, '%Y-%m-%d') AS day, model, upvote, downvote, flag FROM (
      SELECT date_trunc('day', ts)::TIMESTAMP AS d, model, count(*) FILTER (type = 'upvote') AS upvote, count(*) FILTER (type = 'downvote') AS downvote, count(*) FILTER (type = 'flag') AS flag
      FROM chat WHERE type IN ('upvote', 'downvote', 'flag') GROUP BY 1, 2) WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM chat)""",
)
def stream_votes_per_model(spark, sf):
    return _day(L.run_available(L.votes_per_model(D.chat_events(spark, sf, True)), "votes"))


@query(
    "stream_chat_latency",
    f"""WITH {D.CHAT} SELECT strftime(d, '%Y-%m-%d') AS day, model, n, mean_s, p95_s FROM (
      SELECT date_trunc('day', ts)::TIMESTAMP AS d, model, count(*) AS n, avg(finish - start) AS mean_s, quantile_disc(finish - start, 0.95) AS p95_s FROM chat WHERE type = 'chat' GROUP BY 1, 2) WHERE {_CLOSED}""",
)
def stream_chat_latency(spark, sf):
    return _day(L.run_available(L.chat_latency(D.chat_events(spark, sf, True)), "latency"))


@query(
    "stream_running_scores",
    """SELECT event_type AS tag, 'm' || (user_id % 5) AS metric, sum(event_id % 10)::DOUBLE AS total, count(*) AS n, sum(event_id % 10)/count(*)::DOUBLE AS mean_value FROM events GROUP BY 1, 2""",
)
def stream_running_scores(spark, sf):
    raw = L.stream_table(spark, sf, "events.parquet", D.table(spark, sf, "events").schema)
    scores = raw.selectExpr("event_type as tag", "concat('m', cast(user_id % 5 as string)) as metric", "cast(event_id % 10 as double) as value")
    return L.run_available(L.running_scores(scores), "scores", mode="complete")


@query("stream_scores_continued", ORACLES["stream_running_scores"])
def stream_scores_continued(spark, sf):
    """Update mode over files that arrive between two runs; the second run reads only the new ones.

    A trigger takes as many files as a part has, so their number does not grow with the table.
    """
    folder, out, state = (scratch_path(spark, f"scores-{x}") for x in ("in", "out", "state"))
    events = D.table(spark, sf, "events").selectExpr("event_type as tag", "concat('m', cast(user_id % 5 as string)) as metric", "cast(event_id % 10 as double) as value", "event_id % 3 as part")
    files = None
    for parts in ((0, 1), (2,)):
        for part in parts:
            events.filter(F.col("part") == part).drop("part").write.mode("append").parquet(folder)
            files = files or len(spark.read.schema(events.drop("part").schema).parquet(folder).inputFiles())
        scores = spark.readStream.schema(events.drop("part").schema).option("maxFilesPerTrigger", files).parquet(folder)
        result = L.run_available(L.running_scores(scores), "scores", "update", ("tag", "metric"), out, state)
    return result


@query(
    "stream_first_copies",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, md5(props) AS content_hash FROM events GROUP BY 1, 2",
)
def stream_first_copies(spark, sf):
    """One row per day and content; which copy is kept does not matter."""
    unique = L.first_copies(D.chat_events(spark, sf, True).select("ts", "props"), F.col("props"))
    return _day(L.run_available(unique.select("day", "content_hash"), "copies"))


_GAPS = """g AS (SELECT user_id, ts AS last_seen, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next_ts FROM events)"""
_MICROS = "epoch_us(next_ts) - epoch_us(last_seen)"


@query(
    "silent_gaps",
    f"""WITH {_GAPS} SELECT user_id, epoch_us(last_seen) AS last_us, {_MICROS} AS gap_us FROM g WHERE {_MICROS} > 28800000000""",
)
def silent_gaps(spark, sf):
    """Silences of more than eight hours, batch form."""
    out = L.silent_gaps(D.chat_events(spark, sf), "user_id", 8 * 3600)
    return out.select("user_id", F.unix_micros("last_seen").alias("last_us"), "gap_us")


@query(
    "stream_stale_sources",
    f"""WITH {_GAPS} SELECT user_id, epoch_us(last_seen) AS last_us, epoch_us(next_ts) AS next_us FROM g WHERE {_MICROS} > 28800000000
    UNION ALL SELECT user_id, epoch_us(last_seen), NULL FROM g WHERE next_ts IS NULL
      AND epoch_ms(last_seen) + 28800000 < (SELECT epoch_ms(max(ts)) - 600000 FROM events)""",
)
def stream_stale_sources(spark, sf):
    """The same silences noticed in a stream, and sources silent at its end."""
    out = L.run_available(L.stale_sources(D.chat_events(spark, sf, True), "user_id", 8 * 3600), "stale")
    return out.select("user_id", F.unix_micros("last_seen").alias("last_us"), F.unix_micros("next_ts").alias("next_us"))


@query("stream_incremental_generation", "SELECT doc_id, n_chars FROM documents")
def stream_incremental_generation(spark, sf):
    """Documents stand for new images; a second run over the same input adds nothing."""
    path = scratch_path(spark, "finished")
    for _ in range(2):
        images = L.stream_table(spark, sf, "documents.parquet", D.table(spark, sf, "documents").schema)
        rows = images.select(F.col("doc_id").alias("image_id"), "n_chars")
        L.generate_incrementally(rows, path, lambda todo: todo)
    return spark.read.parquet(path).withColumnRenamed("image_id", "doc_id")


@query(
    "log_models",
    f"WITH {D.CHAT} SELECT DISTINCT model FROM chat",
)
def log_models(spark, sf):
    """Distinct models over all events, each event naming a list."""
    lists = D.chat_events(spark, sf).select(F.array("model").alias("models"))
    return lists.select(F.explode("models").alias("model")).distinct()
