"""Batch model calls as Spark jobs: routing, bounded retries, caches, chained turns.

A client is any object with ``generate(system, prompt, picture) -> str``; the job gets a
factory, so each Python worker opens its own. Calls are costly: results are written once
(``settle``) and never sit in a plan that may run twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompt_texts as P
from ..functions import text as X
from ..session import scratch_path, settle
from . import conversations as C

CALLS_PER_TASK = 256  # a task makes its calls one after the other
SHARD_CALLS = 16_384  # most requests of a task where the number of tasks is given
IN_FLIGHT = 256  # most calling tasks, so most calls at a time whatever the number of cores
FAILED_TEXT = "#ERROR#"  # fixed value: text of a failed answer where a text is required


class Client(Protocol):
    def generate(self, system: str, prompt: str, picture: str | None) -> str: ...


class EchoClient:
    """Deterministic stand-in: the last ``words`` words of the prompt."""

    def __init__(self, words: int = 8):
        self.words = words

    def generate(self, system: str, prompt: str, picture: str | None) -> str:
        return " ".join(prompt.split()[-self.words :])


class DummyClient:
    def generate(self, system: str, prompt: str, picture: str | None) -> str:
        return "hello world"


ClientFactory = Callable[[], Client]


def calling_tasks(n: int) -> int:
    """Tasks for ``n`` requests."""
    return max(1, min(IN_FLIGHT, -(-n // CALLS_PER_TASK)))


def run_requests(
    requests: DataFrame,
    clients: ClientFactory | dict[str, ClientFactory],
    tries: int = 5,
    wait_s: float = 2.0,
    failure_text: str | None = None,
    parallel: int | None = None,
    keep: tuple[str, ...] = (),
    answer: str = "text",
    build: Callable[[DataFrame], DataFrame] | None = None,
    each: int = 1,
) -> DataFrame:
    """``requests(req_id, system, prompt, picture[, client])`` → ``answers(req_id, text, elapsed_s, tries, error)``.

    ``keep`` names request columns to carry along, which spares joining the answers back;
    ``answer`` names the text column of the result.

    ``client`` names the entry of ``clients`` that answers the row. A call that fails
    ``tries`` times leaves ``failure_text`` (NULL by default) and its error.

    ``parallel`` is the number of shards, dealt by ``req_id``; a shard is one calling task, and more
    of them where it would hold over ``SHARD_CALLS`` requests. Left out, the requests are written
    once and counted: a task per ``CALLS_PER_TASK`` of them, ``IN_FLIGHT`` at most, dealt evenly.

    With ``build`` the rows are facts that it turns into ``each`` requests where they are called, row
    by row, so that the texts are neither written nor shuffled.
    """
    routed = isinstance(clients, dict)
    factories: dict[str, ClientFactory] = clients if routed else {"": clients}
    cols = list(dict.fromkeys(["req_id", "system", "prompt", "picture", *keep]))
    asked = lambda df: df.select(*cols, F.col("client") if routed else F.lit("").alias("client"))
    src = asked(requests) if build is None else requests
    results = [answer, "elapsed_s", "tries", "error"]
    if parallel:
        tasks = parallel * max(1, -(-src.count() * each // (parallel * SHARD_CALLS)))
        src = src.repartition(tasks, "req_id") if build is None else src.repartition(tasks)
    else:
        src = settle(src, "requests")
        src = src.repartition(calling_tasks(src.count() * each))
    if build is not None:
        src = asked(build(src))

    def call(rows):
        opened: dict[str, Client] = {}
        for pdf in rows:
            out = []
            for r in pdf.itertuples(index=False):
                text, error, started, attempt = failure_text, None, time.monotonic(), 0
                for attempt in range(1, tries + 1):
                    try:
                        if r.client not in opened:
                            opened[r.client] = factories[r.client]()
                        text, error = opened[r.client].generate(r.system, r.prompt, r.picture), None
                        break
                    except Exception as e:  # any client error is retried, then reported
                        error = f"{type(e).__name__}: {e}"
                        if attempt < tries:
                            time.sleep(wait_s)
                out.append((text, time.monotonic() - started, attempt, error))
            answered = pd.DataFrame(out, columns=results, index=pdf.index)
            yield pd.concat([pdf[["req_id", *keep]], answered], axis=1)

    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in ("req_id", *keep))
    return src.mapInPandas(call, f"{kinds}, `{answer}` string, elapsed_s double, tries bigint, error string")


def answer_table(requests: DataFrame, clients, **kwargs) -> DataFrame:
    """Run the requests once and keep the answers on shared storage."""
    return settle(run_requests(requests, clients, **kwargs), "answers")


def judge_key(truth: Column, answer: Column, version: str) -> Column:
    return F.md5(F.concat_ws("\x1f", F.lit(version), truth, answer))


def with_cache(requests: DataFrame, cache: DataFrame, clients, **kwargs) -> tuple[DataFrame, DataFrame]:
    """``(answers, new_rows)``: reuse cached answers by ``req_id``, call for the rest.

    With ``judge_key`` as ``req_id`` a changed text is a new key, so a stale answer cannot be
    reused. Append ``new_rows`` to the cache.
    """
    todo = requests.dropDuplicates(["req_id"]).join(cache.select("req_id"), "req_id", "left_anti")
    fresh = answer_table(todo, clients, **kwargs)
    known = cache.join(requests.select("req_id").distinct(), "req_id", "left_semi")
    cols = ["req_id", "text", "error"]
    return known.select(*cols).unionByName(fresh.select(*cols)), fresh.filter("error is null").select(*cols)


def by_turn(questions: DataFrame) -> DataFrame:
    """``questions(conv_id, text, i)`` as a written table partitioned by ``i``."""
    spark, path = questions.sparkSession, scratch_path(questions.sparkSession, "questions")
    rows = questions.select("conv_id", "text", F.col("i").cast("bigint").alias("i"))
    rows.write.partitionBy("i").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def chain_turns(
    questions: DataFrame,
    clients,
    template: str = P.DEFAULT_TEMPLATE,
    history: str = "all",
    system: str = "",
    **kwargs,
) -> DataFrame:
    """Multi-turn runs: answer n is part of prompt n+1.

    ``questions(conv_id, i, text)``, ``i`` from 0 without gaps. ``history="all"`` renders the
    whole conversation so far with the template; ``"last"`` puts only the previous exchange in
    front of the question. One round asks turn ``i`` of every conversation in parallel. The
    questions are computed once and written by turn number; a round reads the files of its turn.
    """
    if history not in ("all", "last"):
        raise ValueError("history is 'all' or 'last'")
    questions = by_turn(questions)
    last = questions.agg(F.max("i")).first()[0]
    so_far = questions.filter("i = 0").select("conv_id", F.lit("").alias("before"), F.lit("").alias("exchange"))
    done = None
    for k in range(0, (last if last is not None else -1) + 1):
        asked = C.with_template(questions.filter(F.col("i") == k).drop("i").join(so_far, "conv_id"), template)
        asked = asked.withColumn("i", F.lit(2 * k)).withColumn("role", F.lit("human")).withColumn("piece", C.turn_piece())
        if history == "all":
            prompt = C.prompt_text(F.concat("before", "piece", C.opening_of_answer()))
        else:
            prompt = F.when(F.col("exchange") == "", F.col("text")).otherwise(
                F.concat_ws(" ", "exchange", "role0", F.lit("\n"), "text")
            )
        asked = asked.select(
            "conv_id", "before", "text", "piece", prompt.alias("prompt"),
            F.concat_ws("|", F.col("conv_id").cast("string"), F.lit(str(k))).alias("req_id"),
            F.lit(system).alias("system"), F.lit(None).cast("string").alias("picture"),
        )
        answered = run_requests(asked, clients, keep=("conv_id", "before", "text", "piece", "prompt"), answer="answer", **kwargs)
        round_rows = settle(answered, "turns")
        rows = round_rows.select("conv_id", F.lit(k).cast("bigint").alias("i"), "prompt", "answer")
        done = rows if done is None else done.unionByName(rows)
        question = F.col("text")
        back = C.with_template(round_rows, template).withColumn("question", question)
        back = back.withColumn("i", F.lit(2 * k + 1)).withColumn("role", F.lit("gpt"))
        back = back.withColumn("text", F.coalesce("answer", F.lit("")))
        so_far = back.select(
            "conv_id",
            F.concat("before", "piece", C.turn_piece()).alias("before"),
            F.concat_ws(" ", "role0", F.lit("\n"), "question", F.lit("\n"), "role1", F.lit("\n"), "text", F.lit("\n")).alias("exchange"),
        )
    if done is None:
        kind = questions.schema["conv_id"].dataType.simpleString()
        return questions.sparkSession.createDataFrame([], f"conv_id {kind}, i bigint, prompt string, answer string")
    return done


def join_answers(answers: DataFrame) -> DataFrame:
    """Several answers of one request to one text, in order, with the fixed separator."""
    return answers.groupBy("req_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda s: s["text"]),
            X.ANSWER_SEPARATOR,
        ).alias("text")
    )


# ---- question runs -------------------------------------------------------------------

def picture_question(question: Column, start_end: tuple[str, str] | None = None) -> Column:
    token = X.IMAGE_TOKEN if start_end is None else start_end[0] + X.IMAGE_TOKEN + start_end[1]
    return F.concat(F.lit(token + "\n"), question)


def question_prompts(questions: DataFrame, template: str, start_end: tuple[str, str] | None = None) -> DataFrame:
    """``questions(question_id, text)`` to ``cur_prompt`` (as logged) and ``prompt`` (as asked)."""
    system, role0, role1, style, sep, _, _, _ = P.TEMPLATES[template]
    asked = picture_question(F.col("text"), start_end)
    if style in ("SINGLE", "TWO"):
        prompt = F.concat(F.lit(system + sep + role0 + ": "), asked, F.lit(sep + role1 + ":"))
    elif style == "MPT":
        prompt = F.concat(F.lit(system + sep + role0), asked, F.lit(sep + role1))
    elif style == "LLAMA_2":
        opening = f"<<SYS>>\n{system}\n<</SYS>>\n\n" if system else ""
        prompt = F.concat(F.lit("[INST] " + opening), asked, F.lit(" [/INST]"))
    else:
        prompt = F.concat(F.lit(system), asked, F.lit(sep))
    return questions.withColumn("cur_prompt", F.col("text")).withColumn("prompt", prompt)


def answer_questions(
    asked: DataFrame,
    clients,
    model_id: str,
    shards: int | None = None,
    keep: tuple[str, ...] = (),
    **kwargs,
) -> DataFrame:
    """Sharded answer run over ``asked(question_id, cur_prompt, prompt)``; rows as in the answer log.

    ``answer_id`` is md5(question|model), so a repeated run gives the same ids.
    """
    ids = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("question_id", *keep)], F.lit(model_id)))
    requests = asked.withColumn("req_id", ids).withColumn("system", F.lit("")).withColumn(
        "picture", F.col("image") if "image" in asked.columns else F.lit(None).cast("string")
    )
    answers = answer_table(requests, clients, parallel=shards, **kwargs)
    return requests.join(answers.select("req_id", F.col("text").alias("_answer")), "req_id").select(
        "question_id",
        *keep,
        F.col("cur_prompt").alias("prompt"),
        X.strip("_answer").alias("text"),
        F.col("req_id").alias("answer_id"),
        F.lit(model_id).alias("model_id"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
