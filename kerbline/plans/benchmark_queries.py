"""Answer normalisation, benchmark scorers, reviews and question preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import prompt_texts as PT
from ..functions import text as X
from ..operators import benchmarks as BM
from ..sources import readers as RD
from ..sources import writers as WR
from ..scale import spread
from ..session import scratch_path
from . import fixtures as D
from .conversation_queries import q
from .registry import query


def _map_sql(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items()) + "}"


def _normalise_ctes(source: str, text: str, key: str) -> str:
    """CTE ``norm(key, answer)``: the normaliser step by step."""
    punct = "n2"
    for mark in A.PUNCTUATION:
        m = q(mark)
        cond = f"contains(n2, {q(mark + ' ')}) OR contains(n2, {q(' ' + mark)}) OR regexp_matches(n2, '[0-9],+[0-9]')"
        punct = f"replace({punct}, {m}, CASE WHEN {cond} THEN '' ELSE ' ' END)"
    ws = " \t\n\r"
    return f"""n1 AS (SELECT {key}, trim(replace(replace(replace(lower({text}), ',', ''), '?', ''), '''s', ' ''s'), '{ws}') AS n1 FROM {source}),
    n2 AS (SELECT {key}, trim(replace(replace(n1, chr(10), ' '), chr(9), ' '), '{ws}') AS n2 FROM n1),
    n3 AS (SELECT {key}, regexp_replace(regexp_replace({punct}, '\\.+([^0-9.]|$)', '\\1', 'g'), '\\.+(\\.[0-9])', '\\1', 'g') AS n3 FROM n2),
    norm AS (SELECT {key}, array_to_string(list_transform(list_filter(list_transform(
        list_filter(regexp_split_to_array(lower(n3), '\\s+'), lambda w: w <> ''),
        lambda w: coalesce({_map_sql(A.NUMBER_WORDS)}[w], w)), lambda w: w NOT IN ('a', 'an', 'the')),
        lambda w: coalesce({_map_sql(A.CONTRACTIONS)}[w], w)), ' ') AS answer FROM n3)"""


@query(
    "answers_normalised",
    f"""WITH src AS (SELECT doc_id, text FROM documents), {_normalise_ctes("src", "text", "doc_id")} SELECT doc_id, answer FROM norm""",
)
def answers_normalised(spark, sf):
    return spread(D.table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", A.normalise_answer("text").alias("answer")
    )


_TRICKY = [
    "The cat's hat, isnt it?", "two-three (one) [none] don't", "1,000.50 dollars. ok", "a. b .c 3.5 x..5 y...", "Im \\ wont\nyall've _x_ 10/12",
    "the an a", "Three;four five", "end.", "", "@home `tick` \"quoted\" {x}=y+z>w<v!",
]


@query(
    "answers_normalised_tricky",
    f"""WITH src AS (SELECT doc_id, CASE doc_id % {len(_TRICKY)} {" ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(_TRICKY))} END || ' ' || lang AS text FROM documents),
    {_normalise_ctes("src", "text", "doc_id")} SELECT doc_id, answer FROM norm""",
)
def answers_normalised_tricky(spark, sf):
    pick = F.element_at(F.array(*[F.lit(t) for t in _TRICKY]), (F.col("doc_id") % len(_TRICKY)).cast("int") + 1)
    return D.table(spark, sf, "documents").select(
        "doc_id", A.normalise_answer(F.concat(pick, F.lit(" "), "lang")).alias("answer")
    )


# ---- yes / no ---------------------------------------------------------------------------

_YES = "CASE WHEN list_has_any(string_split(replace(string_split(text, '.')[1], ',', ''), ' '), ['No', 'not', 'no']) THEN 'no' ELSE 'yes' END"
_SAID = "CASE WHEN doc_id % 4 = 0 THEN 'No, there is not' WHEN doc_id % 4 = 1 THEN 'It is, not here' ELSE text END"


@query("answers_yes_no", f"WITH d AS (SELECT doc_id, {_SAID} AS text FROM documents) SELECT doc_id, {_YES} AS answer FROM d")
def answers_yes_no(spark, sf):
    return _said(D.table(spark, sf, "documents")).select("doc_id", A.yes_no("text").alias("answer"))


def _said(docs):
    return docs.withColumn(
        "text",
        F.when(F.col("doc_id") % 4 == 0, "No, there is not")
        .when(F.col("doc_id") % 4 == 1, "It is, not here")
        .otherwise(F.col("text")),
    )


@query(
    "yes_no_scores_by_category",
    f"""WITH d AS (SELECT doc_id, lang, {_SAID} AS text FROM documents),
    p AS (SELECT lang AS category, {_YES} = 'yes' AS p, quality = 1 AS t FROM d JOIN labels USING (doc_id)),
    c AS (SELECT category, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND NOT t) AS tn, count(*) FILTER (NOT p AND t) AS fn FROM p GROUP BY category),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp/(tp + fp)::DOUBLE END AS precision_, CASE WHEN tp + fn > 0 THEN tp/(tp + fn)::DOUBLE END AS recall_ FROM c)
    SELECT *, CASE WHEN precision_ + recall_ > 0 THEN 2*precision_*recall_/(precision_ + recall_) END AS f1, (tp + tn)/(tp + fp + tn + fn)::DOUBLE AS accuracy, (tp + fp)/(tp + fp + tn + fn)::DOUBLE AS yes_ratio FROM r""",
)
def yes_no_scores_by_category(spark, sf):
    docs = _said(D.table(spark, sf, "documents")).select(F.col("lang").alias("category"), F.col("doc_id").alias("position"), "text")
    truth = D.table(spark, sf, "labels").select(
        F.col("doc_id").alias("position"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("label")
    )
    return BM.yes_no_scores(docs, truth, ["position"])


# ---- multiple choice --------------------------------------------------------------------

_LETTER = "CASE WHEN len(regexp_extract_all({0}, 'The answer is ([A-Z]).', 1)) = 1 THEN regexp_extract_all({0}, 'The answer is ([A-Z]).', 1)[1] ELSE 'FAILED' END"
_PARSED = (
    "CASE WHEN pred_text IN ('A','B','C','D','E') THEN pred_text WHEN length(pred_text) >= 3 AND left(pred_text, 1) IN ('A','B','C','D','E') AND substr(pred_text, 2, 2) = '. ' THEN left(pred_text, 1) ELSE "
    + _LETTER.format("pred_text") + " END"
)
_IDX = "CASE WHEN coalesce(list_position(['A','B','C','D','E'][1:n_choices], {0}), 0) > 0 THEN list_position(['A','B','C','D','E'], {0}) - 1 ELSE {1} END"
_ANALYSIS = f"""{D.PROBLEMS}, {D.PREDICTIONS},
j AS (SELECT question_id, n_choices, answer, coalesce(text, 'FAILED') AS pred_text, coalesce(prompt, 'Unknown') AS prompt FROM problems LEFT JOIN preds USING (question_id)),
pa AS (SELECT *, {_PARSED} AS parsed FROM j),
an AS (SELECT *, {_IDX.format("parsed", "-1")} AS pred_idx, contains(prompt, '<image>') AS with_image FROM pa)"""


def _analysis(spark, sf):
    return BM.choice_analysis(D.choice_problems(spark, sf), D.choice_predictions(spark, sf))


@query("choice_answers_parsed", f"WITH {_ANALYSIS} SELECT question_id, parsed, pred_idx, pred_idx = answer AS is_correct, with_image FROM an")
def choice_answers_parsed(spark, sf):
    return _analysis(spark, sf).select("question_id", "parsed", "pred_idx", "is_correct", "with_image")


@query(
    "choice_answers_guessed",
    f"""WITH {_ANALYSIS} SELECT question_id, {_IDX.format("parsed", "(('0x' || substr(md5('17|' || question_id), 1, 12))::BIGINT % n_choices)")} AS pred_idx FROM an""",
)
def choice_answers_guessed(spark, sf):
    """Failed parses get a seeded guess instead of -1."""
    from ..scale import seeded_hash

    out = BM.choice_analysis(D.choice_problems(spark, sf), D.choice_predictions(spark, sf), seeded_hash(17, "question_id"))
    return out.select("question_id", "pred_idx")


@query(
    "choice_accuracy",
    f"""WITH {_ANALYSIS} SELECT count(*) AS n, count(*) FILTER (pred_idx = answer) AS n_correct, 100.0::DOUBLE*count(*) FILTER (pred_idx = answer)/count(*) AS acc,
      100.0::DOUBLE*count(*) FILTER (pred_idx = answer AND with_image)/count(*) FILTER (with_image) AS image_acc FROM an""",
)
def choice_accuracy(spark, sf):
    return BM.choice_accuracy(_analysis(spark, sf))


@query("choice_result_rows", f"WITH {_ANALYSIS} SELECT question_id, pred_idx AS result, pred_text AS output FROM an")
def choice_result_rows(spark, sf):
    return BM.choice_result_rows(_analysis(spark, sf))


@query("choice_result_map", f"WITH {_ANALYSIS} SELECT question_id::VARCHAR AS question_id, pred_idx AS result, pred_text AS output FROM an")
def choice_result_map(spark, sf):
    """The result file of a run: one JSON object over part files, read back line by line."""
    analysis, path = _analysis(spark, sf), scratch_path(spark, "results")
    WR.write_result_map(BM.choice_result_rows(analysis), BM.choice_accuracy(analysis), path)
    return RD.read_result_map(spark, path)


@query(
    "choice_split_restricted",
    f"""WITH {D.PROBLEMS} SELECT question_id, n_choices, answer FROM problems WHERE question_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def choice_split_restricted(spark, sf):
    split = D.table(spark, sf, "labels").select(
        F.when(F.col("quality") == 1, "test").otherwise("train").alias("split"), F.col("doc_id").alias("question_id")
    )
    return BM.restrict_to_split(D.choice_problems(spark, sf), split, "test")


def _other(spark, sf, shift: int, skip: int):
    return D.table(spark, sf, "documents").filter(f"doc_id % {skip} <> 1").selectExpr(
        "doc_id as question_id",
        f"case when (doc_id + {shift}) % 4 = 0 then 'no idea' else concat('The answer is ', chr(cast(65 + (doc_id * {shift}) % 5 as int)), '.') end as text",
    )


def _other_sql(name: str, shift: int, skip: int) -> str:
    return f"""{name} AS (SELECT doc_id AS question_id, CASE WHEN (doc_id + {shift}) % 4 = 0 THEN 'no idea' ELSE 'The answer is ' || chr((65 + (doc_id*{shift}) % 5)::INT) || '.' END AS text
      FROM documents WHERE doc_id % {skip} <> 1)"""


_OPINIONS = f"""{D.PROBLEMS}, {_other_sql("ours", 3, 7)}, {_other_sql("other", 2, 5)}, {_other_sql("again", 1, 3)},
lt AS (SELECT p.*, {_LETTER.format("o.text")} AS ol, {_LETTER.format("t.text")} AS tl, {_LETTER.format("coalesce(a.text, 'MISSING')")} AS al, a.text IS NULL AS missing
  FROM problems p JOIN ours o USING (question_id) JOIN other t USING (question_id) LEFT JOIN again a USING (question_id)),
ix AS (SELECT *, {_IDX.format("ol", "-1")} AS oi, {_IDX.format("tl", "-1")} AS ti, {_IDX.format("al", "-1")} AS ai FROM lt)"""


@query(
    "choice_ensemble_counts",
    f"""WITH {_OPINIONS}, f AS (SELECT *, CASE WHEN tl = 'FAILED' THEN oi ELSE ti END AS fi FROM ix)
    SELECT count(*) AS n, count(*) FILTER (fi = answer) AS correct, count(*) FILTER (fi = answer OR oi = answer) AS correct_upper, count(*) FILTER (tl = 'FAILED') AS other_failed FROM f""",
)
def choice_ensemble_counts(spark, sf):
    return BM.ensemble_counts(D.choice_problems(spark, sf), _other(spark, sf, 3, 7), _other(spark, sf, 2, 5))


@query(
    "choice_requery_counts",
    f"""WITH {_OPINIONS} SELECT count(*) AS total, count(*) FILTER (missing) AS missing_requery, count(*) FILTER (oi = answer) AS our_correct, count(*) FILTER (ti = answer) AS other_correct,
      count(*) FILTER (tl = 'FAILED') AS other_failed, count(*) FILTER (CASE WHEN tl = 'FAILED' THEN oi = answer ELSE ti = answer END) AS other_or_ours_correct,
      count(*) FILTER (CASE WHEN al = 'FAILED' THEN oi = answer ELSE ai = answer END) AS requery_correct, count(*) FILTER (ti = answer OR oi = answer) AS correct_upper FROM ix""",
)
def choice_requery_counts(spark, sf):
    return BM.requery_counts(
        D.choice_problems(spark, sf), _other(spark, sf, 3, 7), _other(spark, sf, 2, 5), _other(spark, sf, 1, 3)
    )


@query("caption_rows", "SELECT doc_id AS image_id, text AS caption FROM documents")
def caption_rows(spark, sf):
    return BM.caption_rows(D.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("question_id"), "text"))


@query(
    "last_duplicate_wins",
    """SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""",
)
def last_duplicate_wins(spark, sf):
    ev = D.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return BM.last_per_key(ev, "user_id", "event_id")


# ---- open answers -----------------------------------------------------------------------

_ANSWER_SQL = "list_transform(range(10), lambda k: CASE WHEN (doc_id + k) % 4 = 0 THEN 'Two ' || lang || '.' WHEN (doc_id + k) % 4 = 1 THEN 'the ' || lang ELSE lang || ' ' || k END)"


def _reading(spark, sf):
    docs = D.table(spark, sf, "documents")
    prompt = F.expr(
        "case doc_id % 3 when 0 then concat('OCR tokens: x\\nQuestion: What IS ', lang, '? Short answer:') "
        "when 1 then concat('What IS ', lang, '?\\nReference OCR token: a\\nAnswer') else concat('What IS ', lang, '?\\nAnswer the question') end"
    )
    results = docs.select(
        F.col("doc_id").alias("question_id"), prompt.alias("prompt"),
        F.expr("case when doc_id % 2 = 0 then concat('2 ', upper(lang)) else concat('A ', lang) end").alias("text"),
    )
    answers = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda k: F.when((F.col("doc_id") + k) % 4 == 0, F.concat(F.lit("Two "), F.col("lang"), F.lit(".")))
        .when((F.col("doc_id") + k) % 4 == 1, F.concat(F.lit("the "), F.col("lang")))
        .otherwise(F.concat(F.col("lang"), F.lit(" "), k.cast("string"))),
    )
    annotations = docs.select(
        F.col("doc_id").alias("image_id"), F.concat(F.lit("what is "), "lang", F.lit("?")).alias("question"), answers.alias("answers")
    )
    return results, annotations


@query(
    "reading_soft_scores",
    f"""WITH ans AS (SELECT doc_id, lang, unnest({_ANSWER_SQL}) AS raw, unnest(range(10)) AS k FROM documents),
    src AS (SELECT doc_id, k, raw AS text FROM ans UNION ALL SELECT doc_id, -1, CASE WHEN doc_id % 2 = 0 THEN '2 ' || upper(lang) ELSE 'A ' || lang END FROM documents),
    {_normalise_ctes("src", "text", "doc_id, k")},
    pr AS (SELECT doc_id, answer AS pred FROM norm WHERE k = -1),
    m AS (SELECT n.doc_id, n.k, answer, pred FROM norm n JOIN pr USING (doc_id) WHERE n.k >= 0),
    lo AS (SELECT a.doc_id, a.k, count(*) FILTER (b.k <> a.k AND b.answer = b.pred) AS others, any_value(a.pred) AS pred FROM m a JOIN m b USING (doc_id) GROUP BY 1, 2),
    sc AS (SELECT doc_id, sum(least(1.0, others/3.0::DOUBLE)) AS s FROM lo GROUP BY doc_id),
    hit AS (SELECT doc_id, bool_or(answer = pred) AS known FROM m GROUP BY doc_id)
    SELECT doc_id AS question_id, 'what is ' || lang || '?' AS question, round(CASE WHEN known THEN s/10 ELSE 0.0 END, 9) AS score FROM documents JOIN sc USING (doc_id) JOIN hit USING (doc_id)""",
)
def reading_soft_scores(spark, sf):
    """Leave-one-out scores in closed form; the SQL leaves each of the ten answers out in turn."""
    return BM.reading_scores(*_reading(spark, sf)).withColumn("score", F.round("score", 9))


@query(
    "reading_accuracy",
    f"""WITH ans AS (SELECT doc_id, lang, unnest({_ANSWER_SQL}) AS raw, unnest(range(10)) AS k FROM documents),
    src AS (SELECT doc_id, k, raw AS text FROM ans UNION ALL SELECT doc_id, -1, CASE WHEN doc_id % 2 = 0 THEN '2 ' || upper(lang) ELSE 'A ' || lang END FROM documents),
    {_normalise_ctes("src", "text", "doc_id, k")},
    pr AS (SELECT doc_id, answer AS pred FROM norm WHERE k = -1),
    m AS (SELECT n.doc_id, count(*) FILTER (answer = pred) AS c, count(DISTINCT answer) AS n_distinct FROM norm n JOIN pr USING (doc_id) WHERE n.k >= 0 GROUP BY 1)
    SELECT count(*) AS n, count(*) FILTER (c > 0) AS n_exact, sum(n_distinct)::BIGINT AS n_distinct FROM m""",
)
def reading_accuracy(spark, sf):
    """Exact matches and distinct normalised answers."""
    results, annotations = _reading(spark, sf)
    both = results.join(annotations.withColumnRenamed("image_id", "question_id"), "question_id")
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(BM.exact_match(F.col("text"), F.col("answers"))).cast("bigint").alias("n_exact"),
        F.sum(F.size(BM.distinct_answers(F.col("answers")))).alias("n_distinct"),
    )




@query(
    "edit_similarity_best",
    """WITH t AS (SELECT o_orderkey, lower(o_orderpriority) AS a, [lower(o_orderpriority || o_orderstatus), lower(substr(o_orderpriority, 3)), 'zzz'] AS ts FROM orders),
    s AS (SELECT o_orderkey, 1.0::DOUBLE - levenshtein(a, b)/greatest(length(a), length(b))::DOUBLE AS sim FROM (SELECT o_orderkey, a, unnest(ts) AS b FROM t))
    SELECT o_orderkey, max(CASE WHEN sim >= 0.5 THEN sim ELSE 0 END) AS score FROM s GROUP BY o_orderkey""",
)
def edit_similarity_best(spark, sf):
    rows = D.table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("pred"),
        F.array(F.concat("o_orderpriority", "o_orderstatus"), F.expr("substring(o_orderpriority, 3)"), F.lit("zzz")).alias("answers"),
    )
    return BM.best_edit_similarity(rows, "o_orderkey", "pred", "answers")


# ---- reviews ----------------------------------------------------------------------------

_REVIEWS = """rv AS (SELECT event_id AS question_id, event_type AS category, (event_id % 10 + 1)::DOUBLE AS score1, ((event_id*7) % 10 + 1)::DOUBLE AS score2,
  CASE WHEN user_id % 2 = 0 THEN 'run_0613' ELSE 'run_a' END AS config FROM events)"""


def _reviews(spark, sf):
    return D.table(spark, sf, "events").selectExpr(
        "event_id as question_id", "event_type as category", "cast(event_id % 10 + 1 as double) as score1",
        "cast((event_id * 7) % 10 + 1 as double) as score2", "case when user_id % 2 = 0 then 'run_0613' else 'run_a' end as config",
    )


@query(
    "review_summary",
    f"""WITH {_REVIEWS}, k AS (SELECT * FROM rv WHERE question_id NOT IN (3, 14)), l AS (SELECT *, category AS level FROM k UNION ALL SELECT *, 'all' FROM k)
    SELECT config, level AS category, sum(score1)/count(*) AS mean1, sum(score2)/count(*) AS mean2, count(*) AS n FROM l GROUP BY config, level""",
)
def review_summary(spark, sf):
    return BM.review_summary(_reviews(spark, sf), ignore=[3, 14]).select("config", "category", "mean1", "mean2", "n")


@query(
    "review_summary_version",
    f"""WITH {_REVIEWS}, k AS (SELECT * FROM rv WHERE config = 'run_0613'), l AS (SELECT *, category AS level FROM k UNION ALL SELECT *, 'all' FROM k)
    SELECT level AS category, count(*) AS n, 0 AS n_failed FROM l GROUP BY level""",
)
def review_summary_version(spark, sf):
    return BM.review_summary(_reviews(spark, sf), version="0613", select=["run"]).select("category", "n", "n_failed")




@query(
    "review_scores_parsed",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 8 WHEN 1 THEN 7.5 WHEN 5 THEN -3 ELSE -1 END::DOUBLE AS score1,
       CASE event_id % 6 WHEN 0 THEN 9 WHEN 1 THEN 6 WHEN 5 THEN 4.25 ELSE -1 END::DOUBLE AS score2 FROM events""",
)
def review_scores_parsed(spark, sf):
    text = F.expr(
        "case event_id % 6 when 0 then '8 9\\nfine' when 1 then '7.5,6' when 2 then '7, 6' when 3 then 'none given' when 4 then '1 2 3' else '-3 +4.25' end"
    )
    pair = A.score_pair(text)
    return D.table(spark, sf, "events").select("event_id", pair[0].alias("score1"), pair[1].alias("score2"))


_TIDY = "'**Assistant 1** wins over **Assistant 2** in ' || event_type || chr(10) || 'end'"


@query(
    "review_records",
    f"""SELECT CASE WHEN y = 7 THEN 1 WHEN y < 7 THEN y + 1 ELSE y END AS id, question_id, category, question, answer1, answer2, evaluation, score1, score2, winner FROM (
      SELECT CASE WHEN x <= 50 THEN x + 10 WHEN x > 50 AND x <= 60 THEN x - 50 ELSE x END AS y, * FROM (
        SELECT CASE WHEN event_id <= 20 THEN event_id + 60 ELSE event_id - 20 END AS x, event_id AS question_id, event_type AS category, 'q ' || event_id AS question, 'a ' || value AS answer1, 'b ' || user_id AS answer2,
          {_TIDY} AS evaluation, (event_id % 10 + 1)::DOUBLE AS score1, ((event_id*7) % 10 + 1)::DOUBLE AS score2,
          CASE WHEN event_id % 10 = (event_id*7) % 10 THEN 'tie' WHEN event_id % 10 > (event_id*7) % 10 THEN 'first' ELSE 'second' END AS winner FROM events))""",
)
def review_records(spark, sf):
    return _records(spark, sf)


def _records(spark, sf):
    ev = D.table(spark, sf, "events")
    questions = ev.selectExpr("event_id as question_id", "event_type as category", "concat('q ', event_id) as text")
    a1 = ev.selectExpr("event_id as question_id", "concat('a ', cast(value as string)) as text")
    a2 = ev.selectExpr("event_id as question_id", "concat('b ', user_id) as text")
    reviews = _reviews(spark, sf).join(
        ev.selectExpr(
            "event_id as question_id",
            "concat(case when event_id % 3 = 0 then '8, 9\\n' else '' end, 'Assistant 1 wins over Assistant 2 in ', event_type, '\\nend') as content",
        ),
        "question_id",
    )
    return BM.review_records(questions, a1, a2, reviews)


@query("review_web_rows", f"SELECT count(*) AS n, count(*) FILTER (event_id % 10 = (event_id*7) % 10) AS n_ties FROM events")
def review_web_rows(spark, sf):
    """The JSON text of every record parses back to its own scores."""
    rows = WR.web_rows(_records(spark, sf)).select(F.get_json_object("record", "$.scores.first").alias("s"))
    pair = rows.select(F.from_json("s", "array<double>").alias("p"))
    return pair.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p")[0] == F.col("p")[1]).alias("n_ties"))


_RULES = [("click", "Assistant", "Rate the clicks."), ("view", "Viewer", "Rate the views."), ("default", "Judge", "Rate in general.")]
_RULE_SQL = "rules(category, role, prompt) AS (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in _RULES) + ")"


@query(
    "review_prompts_with_rules",
    f"""WITH {_RULE_SQL} SELECT event_id, '[Context]' || chr(10) || 'cap ' || user_id || chr(10) || chr(10) || 'car: [0.5, 1.25]' || chr(10) || chr(10) || '[Question]' || chr(10) || 'q ' || event_id || chr(10) || chr(10)
      || '[' || r.role || ' 1]' || chr(10) || 'one' || chr(10) || chr(10) || '[End of ' || r.role || ' 1]' || chr(10) || chr(10) || '[' || r.role || ' 2]' || chr(10) || 'two' || chr(10) || chr(10) || '[End of ' || r.role || ' 2]' || chr(10) || chr(10)
      || '[System]' || chr(10) || r.prompt || chr(10) || chr(10) AS content
    FROM events e JOIN rules r ON r.category = CASE WHEN e.event_type IN ('click', 'view') THEN e.event_type ELSE 'default' END""",
)
def review_prompts_with_rules(spark, sf):
    questions = D.table(spark, sf, "events").selectExpr("event_id", "event_type as category", "user_id")
    rules = spark.createDataFrame(_RULES, "category string, role string, prompt string")
    matched = BM.review_rules(questions, rules)[0]
    boxes = BM.instance_lines(F.array(F.struct(F.lit("car").alias("category"), F.array(F.lit(0.5), F.lit(1.25)).alias("bbox"))))
    return matched.select(
        "event_id",
        BM.review_content(
            F.concat(F.lit("q "), F.col("event_id").cast("string")), F.lit("one"), F.lit("two"), F.col("role"), F.col("prompt"),
            F.concat(F.lit("cap "), F.col("user_id").cast("string")), boxes,
        ).alias("content"),
    )


@query(
    "review_rules_required",
    f"""WITH {_RULE_SQL} SELECT event_type AS category, event_type IN ('click', 'view') AS has_rule, count(*) AS n FROM events GROUP BY 1, 2""",
)
def review_rules_required(spark, sf):
    """Without a fallback, unknown categories are rejects."""
    questions = D.table(spark, sf, "events").selectExpr("event_id", "event_type as category")
    rules = spark.createDataFrame(_RULES, "category string, role string, prompt string")
    good, bad = BM.review_rules(questions, rules, fallback=None)
    both = good.select("category", F.lit(True).alias("has_rule")).unionByName(bad.select("category", F.lit(False).alias("has_rule")))
    return both.groupBy("category", "has_rule").agg(F.count(F.lit(1)).alias("n"))


@query("reviews_pending", "SELECT event_id AS id, event_type FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents)")
def reviews_pending(spark, sf):
    todo = D.table(spark, sf, "events").selectExpr("event_id as id", "event_type")
    return WR.pending_reviews(todo, D.table(spark, sf, "documents").select(F.col("doc_id").alias("id")))


# ---- question preparation ----------------------------------------------------------------

def _option_rows(spark, sf):
    return D.table(spark, sf, "documents").selectExpr(
        "doc_id as index", "concat('Which ', lang) as question",
        "case doc_id % 3 when 0 then 'nan' when 1 then 'a hint' else null end as hint",
        "concat('opt a', doc_id) as A", "'opt b' as B",
        "case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then 'None' else 'opt c' end as C", "'opt d' as D",
    )


@query(
    "option_rounds",
    f"""WITH r AS (SELECT doc_id, 'Which ' || lang AS question, CASE doc_id % 3 WHEN 1 THEN 'a hint' END AS hint,
        CASE WHEN doc_id % 4 <= 1 THEN ['opt a' || doc_id, 'opt b'] ELSE ['opt a' || doc_id, 'opt b', 'opt c', 'opt d'] END AS o FROM documents),
    t AS (SELECT *, len(o) AS k, i AS round_id, o[i+1:] || o[1:i] AS opts, (['A','B','C','D'][1:len(o)])[i+1:] || (['A','B','C','D'][1:len(o)])[1:i] AS chars FROM r, range(4) x(i) WHERE i < len(o))
    SELECT doc_id AS question_id, round_id, array_to_string(opts, '|') AS options, array_to_string(chars, '') AS option_char,
      CASE WHEN hint IS NULL THEN '' ELSE hint || chr(10) END || question || array_to_string(list_transform(range(1, k + 1), lambda j: chr(10) || chr((64 + j)::INT) || '. ' || opts[j]), '') || chr(10) || {q(PT.LETTER_HINT)} AS text FROM t""",
)
def option_rounds(spark, sf):
    out = BM.option_rounds(_option_rows(spark, sf))
    return out.select(
        "question_id", "round_id", F.array_join("options", "|").alias("options"), F.array_join("option_char", "").alias("option_char"), "text"
    )


@query(
    "choice_questions_prepared",
    f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<image>' || chr(10) ELSE '' END || lang || ' what?' || chr(10) || {q(PT.LETTER_HINT)} AS text FROM documents""",
)
def choice_questions_prepared(spark, sf):
    docs = D.table(spark, sf, "documents")
    raw = F.concat(F.lit("<image>\n "), "lang", F.lit(" what? "))
    return docs.select("doc_id", BM.choice_question(raw, F.col("doc_id") % 2 == 0).alias("text"))


@query(
    "model_names_from_paths",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || '-7b' ELSE lang || '-7b_checkpoint-' || doc_id END AS name FROM documents""",
)
def model_names_from_paths(spark, sf):
    path = F.expr("case when doc_id % 2 = 0 then concat('/models/', lang, '-7b/') else concat('models/', lang, '-7b/checkpoint-', doc_id) end")
    return D.table(spark, sf, "documents").select("doc_id", X.model_name(path).alias("name"))


@query(
    "completions_cut",
    """SELECT doc_id, trim(string_split(text, '.')[1], ' ' || chr(9) || chr(10) || chr(13)) AS answer FROM documents""",
)
def completions_cut(spark, sf):
    """The answer between the prompt's role header and the next separator."""
    docs = D.table(spark, sf, "documents")
    decoded = F.concat(F.lit("PROMPT. x"), F.lit("Bot: "), "text")
    return docs.select("doc_id", X.completion(decoded, F.lit("PROMPT. x"), F.lit("Bot"), F.lit(".")).alias("answer"))


@query(
    "stop_words_trimmed",
    """SELECT doc_id, CASE WHEN ends_with(text, '.') THEN left(text, length(text) - 1) ELSE text END AS text FROM documents""",
)
def stop_words_trimmed(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", X.cut_at("text", ".").alias("text"))


@query(
    "inputs_capped",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN left(text, 1200) || CASE WHEN contains(left(text, 1200), '<image>') THEN '' ELSE chr(10) || '<image>' END ELSE left(text, 1536) END AS text FROM documents""",
)
def inputs_capped(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", X.capped_input("text", F.col("doc_id") % 2 == 0).alias("text"))


@query(
    "token_budgets",
    """SELECT doc_id, CASE WHEN b >= 1 THEN b END AS budget FROM (SELECT doc_id, least(least(doc_id % 1500, 1024), 2048 - n_chars - CASE WHEN doc_id % 2 = 0 THEN 576 ELSE 0 END) AS b FROM documents)""",
)
def token_budgets(spark, sf):
    budget = X.token_budget(
        F.col("doc_id") % 1500, F.lit(2048), F.col("n_chars"), F.when(F.col("doc_id") % 2 == 0, 576).otherwise(0)
    )
    return D.table(spark, sf, "documents").select("doc_id", budget.alias("budget"))


@query("review_head_lines_dropped", """SELECT doc_id, 'tail ' || lang AS text FROM documents""")
def review_head_lines_dropped(spark, sf):
    text = F.concat(F.lit(" one\n two \n\ntail "), "lang")
    return D.table(spark, sf, "documents").select("doc_id", A.drop_head_lines(text, 2).alias("text"))


@query("content_unique", "SELECT count(DISTINCT md5(text)) AS n_unique, count(*) AS n FROM documents")
def content_unique(spark, sf):
    """One copy per content hash, counted against all copies."""
    docs = D.table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return RD.unique_images(docs).agg(F.count(F.lit(1)).alias("n_unique")).withColumn("n", n)


@query("base64_images_decoded", "SELECT doc_id, md5(text) AS h FROM documents")
def base64_images_decoded(spark, sf):
    rows = D.table(spark, sf, "documents").select("doc_id", F.base64(F.col("text").cast("binary")).alias("image"))
    return RD.decode_images(rows).select("doc_id", F.md5("content").alias("h"))


@query(
    "keyed_json_maps",
    """SELECT doc_id::VARCHAR AS id, lang, n_chars FROM documents""",
)
def keyed_json_maps(spark, sf):
    """Each source's problems packed as one JSON object per row, then read as rows."""
    docs = D.table(spark, sf, "documents")
    packed = docs.select(
        F.to_json(F.create_map(F.col("doc_id").cast("string"), F.struct("lang", "n_chars"))).alias("value")
    )
    return RD.explode_map(packed, "value", "struct<lang:string,n_chars:bigint>")


@query(
    "stored_paths_split",
    f"""WITH {D.SIZES}, p AS (SELECT *, image_id % 5 = 0 AS bad FROM sizes)
    SELECT image_id, CASE WHEN bad THEN 0 ELSE i END AS seq, CASE WHEN bad THEN 0 ELSE (image_id % w + i)/w::DOUBLE END AS x, CASE WHEN bad THEN 0 ELSE (image_id % h)/h::DOUBLE END AS y, NOT bad AS res
    FROM p, range(3) r(i) WHERE NOT bad OR i = 0""",
)
def stored_paths_split(spark, sf):
    s = D.sizes(spark, sf)
    raw = s.select(
        "image_id",
        F.when(F.col("image_id") % 5 == 0, "No path found").otherwise("ok").alias("result"),
        F.transform(
            F.sequence(F.lit(0), F.lit(2)),
            lambda i: F.array((F.col("image_id") % F.col("h")).cast("double"), (F.col("image_id") % F.col("w") + i).cast("double")),
        ).alias("path"),
    )
    good, bad = RD.split_stored_paths(raw, s)
    return good.withColumn("res", F.lit(True)).unionByName(bad.drop("reason").withColumn("res", F.lit(False))).withColumn(
        "seq", F.col("seq").cast("bigint")
    )


@query(
    "raster_size_rejects",
    f"""WITH {D.RASTER} SELECT image_id, 8 AS want_h, CASE WHEN image_id % 10 = 0 THEN 9 ELSE 8 END AS want_w FROM raster WHERE image_id % 10 = 0 OR image_id % 25 = 3 GROUP BY image_id""",
)
def raster_size_rejects(spark, sf):
    """Wrong width for every tenth image; one pixel missing in some others."""
    r = D.raster(spark, sf).filter("not (image_id % 25 = 3 and y = 0 and x = 0)")
    sizes = D.raster_goals(spark, sf).selectExpr("image_id", "8L as h", "case when image_id % 10 = 0 then 9L else 8L end as w")
    return RD.check_raster_sizes(r, sizes)[1].select("image_id", "want_h", "want_w")


_ANSWERED = """an AS (SELECT doc_id AS pair_id, lang AS pred, list_transform(range(10), lambda i: CASE WHEN (doc_id + i*i) % 3 = 0 THEN lang WHEN i % 2 = 0 THEN lang || 'x' ELSE source END) AS answers FROM documents),
k AS (SELECT *, len(list_filter(answers, lambda a: a = pred))::DOUBLE AS hits FROM an),
e AS (SELECT pair_id, unnest(answers) AS a, pred FROM an), s AS (SELECT pair_id, 1 - levenshtein(pred, a)/greatest(length(pred), length(a))::DOUBLE AS sim FROM e)"""


@query(
    "evaluators_by_name",
    f"""WITH {_ANSWERED} SELECT pair_id, 'soft_accuracy' AS metric, round((hits*least(1, (hits - 1)/3) + (10 - hits)*least(1, hits/3))/10, 9) AS value FROM k WHERE hits > 0
    UNION ALL SELECT pair_id, 'soft_accuracy', 0 FROM k WHERE hits = 0 UNION ALL SELECT pair_id, 'exact_match', (hits > 0)::INT FROM k
    UNION ALL SELECT pair_id, 'edit_similarity', round(max(CASE WHEN sim >= 0.5 THEN sim ELSE 0 END), 9) FROM s GROUP BY 1
    UNION ALL SELECT NULL, 'bleu', 0""",
)
def evaluators_by_name(spark, sf):
    """Every registered evaluator over the same answers; one-word texts have no four-word hit."""
    docs = D.table(spark, sf, "documents").select("doc_id", "lang", "source")
    choice = lambda i: F.when((F.col("doc_id") + i * i) % 3 == 0, F.col("lang")).when(i % 2 == 0, F.concat("lang", F.lit("x"))).otherwise(F.col("source"))
    rows = docs.select(F.col("doc_id").alias("pair_id"), F.col("lang").alias("pred"), F.transform(F.sequence(F.lit(0), F.lit(9)), choice).alias("answers"))
    return BM.score_answers(rows).withColumn("value", F.round("value", 9))
