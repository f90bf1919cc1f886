"""Scorers of the question-answering benchmarks and pairwise reviews."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import prompt_texts as P
from ..functions import text as X
from . import textmetrics


def last_per_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """The last duplicate wins: an aggregate, so a key with many copies needs no sort."""
    cols = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*cols), F.col(position)).alias("_r"))
        .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])
    )


# ---- yes / no (object hallucination) ---------------------------------------------------

def yes_no_scores(answers: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts and rates per category; NULL where a rate has no base.

    ``answers(category, position, text)``, ``labels(category, position, label)``: aligned by an
    explicit position within the category.
    """
    both = answers.join(labels, keys).select(
        "category",
        (A.yes_no("text") == "yes").alias("p"),
        (F.col("label") != "no").alias("t"),
    )
    n = lambda p, t: F.count_if((F.col("p") == p) & (F.col("t") == t))
    counted = both.groupBy("category").agg(
        n(True, True).alias("tp"),
        n(True, False).alias("fp"),
        n(False, False).alias("tn"),
        n(False, True).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    total = tp + fp + tn + fn
    return (
        counted.withColumn("precision_", precision)
        .withColumn("recall_", recall)
        .withColumn("f1", F.try_divide(2 * F.col("precision_") * F.col("recall_"), F.col("precision_") + F.col("recall_")))
        .withColumn("accuracy", (tp + tn) / total)
        .withColumn("yes_ratio", (tp + fp) / total)
    )


# ---- multiple choice ------------------------------------------------------------------

def choice_analysis(problems: DataFrame, predictions: DataFrame, guess: Column | None = None) -> DataFrame:
    """``problems(question_id, n_choices, answer)`` with the last prediction of each, if any."""
    joined = problems.join(predictions, "question_id", "left").select(
        "question_id",
        "n_choices",
        "answer",
        F.coalesce("text", F.lit(A.FAILED)).alias("pred_text"),
        F.coalesce("prompt", F.lit("Unknown")).alias("prompt"),
    )
    out = joined.withColumn("parsed", A.option_letter("pred_text"))
    return out.withColumn("pred_idx", A.option_index("parsed", "n_choices", guess_key=guess)).withColumn(
        "is_correct", F.col("pred_idx") == F.col("answer")
    ).withColumn("with_image", F.contains("prompt", F.lit(X.IMAGE_TOKEN)))


def choice_accuracy(analysis: DataFrame) -> DataFrame:
    image = F.col("with_image")
    return analysis.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_correct").alias("n_correct"),
        (100.0 * F.count_if("is_correct") / F.count(F.lit(1))).alias("acc"),
        F.try_divide(100.0 * F.count_if(F.col("is_correct") & image), F.count_if(image)).alias("image_acc"),
    )


def choice_result_rows(analysis: DataFrame) -> DataFrame:
    """``question_id → index, text``: the result and output maps as rows, for any size."""
    return analysis.select("question_id", F.col("pred_idx").alias("result"), F.col("pred_text").alias("output"))


def restrict_to_split(problems: DataFrame, split_ids: DataFrame, split: str) -> DataFrame:
    """``split_ids(split, question_id)``."""
    wanted = split_ids.filter(F.col("split") == split).select("question_id")
    return problems.join(wanted, "question_id", "left_semi")


def ensemble_counts(problems: DataFrame, ours: DataFrame, other: DataFrame) -> DataFrame:
    """Second opinion with our answer as fallback; problems without both answers are skipped."""
    both = (
        problems.join(ours.select("question_id", F.col("text").alias("our_text")), "question_id")
        .join(other.select("question_id", F.col("text").alias("other_text")), "question_id")
        .withColumn("our_idx", A.option_index(A.stated_letter("our_text"), "n_choices"))
        .withColumn("other_letter", A.stated_letter("other_text"))
        .withColumn("other_failed", F.col("other_letter") == A.FAILED)
        .withColumn("other_idx", A.option_index("other_letter", "n_choices"))
        .withColumn("idx", F.when(F.col("other_failed"), F.col("our_idx")).otherwise(F.col("other_idx")))
    )
    right = F.col("idx") == F.col("answer")
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(right).alias("correct"),
        F.count_if(right | (F.col("our_idx") == F.col("answer"))).alias("correct_upper"),
        F.count_if("other_failed").alias("other_failed"),
    )


def requery_counts(problems: DataFrame, ours: DataFrame, other: DataFrame, requery: DataFrame) -> DataFrame:
    """Three opinions: ours and the other are required, the repeated question is optional."""
    rows = (
        problems.join(ours.select("question_id", F.col("text").alias("our_text")), "question_id")
        .join(other.select("question_id", F.col("text").alias("other_text")), "question_id")
        .join(requery.select("question_id", F.col("text").alias("re_text")), "question_id", "left")
        .withColumn("missing", F.col("re_text").isNull())
        .withColumn("our_idx", A.option_index(A.stated_letter("our_text"), "n_choices"))
        .withColumn("other_letter", A.stated_letter("other_text"))
        .withColumn("other_idx", A.option_index("other_letter", "n_choices"))
        .withColumn("re_letter", A.stated_letter(F.coalesce("re_text", F.lit("MISSING"))))
        .withColumn("re_idx", A.option_index("re_letter", "n_choices"))
    )
    ans = F.col("answer")
    ours_ok, other_ok, re_ok = F.col("our_idx") == ans, F.col("other_idx") == ans, F.col("re_idx") == ans
    other_failed, re_failed = F.col("other_letter") == A.FAILED, F.col("re_letter") == A.FAILED
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("missing").alias("missing_requery"),
        F.count_if(ours_ok).alias("our_correct"),
        F.count_if(other_ok).alias("other_correct"),
        F.count_if(other_failed).alias("other_failed"),
        F.count_if(F.when(other_failed, ours_ok).otherwise(other_ok)).alias("other_or_ours_correct"),
        F.count_if(F.when(re_failed, ours_ok).otherwise(re_ok)).alias("requery_correct"),
        F.count_if(other_ok | ours_ok).alias("correct_upper"),
    )


def caption_rows(results: DataFrame) -> DataFrame:
    return results.select(F.col("question_id").cast("bigint").alias("image_id"), F.col("text").alias("caption"))


# ---- open answers ----------------------------------------------------------------------

def soft_accuracy(pred: Column, answers: Column) -> Column:
    """Leave-one-out agreement with ten normalised human answers.

    With k of the ten equal to the prediction, each left-out answer sees k-1 or k matches.
    """
    normal = F.transform(F.concat(F.array(pred), answers), A.normalise_answer)
    share = lambda m: F.least(F.lit(1.0), m / 3)
    score = lambda k: F.when(k > 0, (k * share(k - 1) + (10 - k) * share(k)) / 10).otherwise(0.0)
    matches = X.bind(normal, lambda n: (F.size(F.filter(n, lambda a: a == n[0])) - 1).cast("double"))
    return X.bind(matches, score)


def reading_scores(results: DataFrame, annotations: DataFrame) -> DataFrame:
    """``results(question_id, prompt, text)`` with ``annotations(image_id, question, answers[10])``.

    Joined on the image and the lower-case question found in the prompt.
    """
    asked = results.withColumn("_q", A.asked_question("prompt"))
    truth = annotations.select(
        F.col("image_id").alias("question_id"), F.lower("question").alias("_q"), "answers"
    )
    return asked.join(truth, ["question_id", "_q"]).select(
        "question_id",
        F.col("_q").alias("question"),
        soft_accuracy(F.col("text"), F.col("answers")).alias("score"),
    )


def distinct_answers(answers: Column) -> Column:
    return F.array_distinct(F.transform(answers, A.normalise_answer))


def exact_match(pred: Column, answers: Column) -> Column:
    normal = F.transform(F.concat(F.array(pred), answers), A.normalise_answer)
    hits = X.bind(normal, lambda n: F.size(F.filter(n, lambda a: a == n[0])) - 1)
    return F.when(hits > 0, 1.0).otherwise(0.0)


def edit_similarity(pred: Column, truth: Column) -> Column:
    """1 − distance / longer length, 0 below one half; NULL if both are empty."""
    a, b = X.strip(F.lower(pred)), X.strip(F.lower(truth))
    sim = F.lit(1.0) - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))
    return F.when(sim >= 0.5, sim).when(sim < 0.5, 0.0)


def best_edit_similarity(rows: DataFrame, key: str, pred: str, answers: str) -> DataFrame:
    best = F.array_max(F.transform(F.col(answers), lambda t: edit_similarity(F.col(pred), t)))
    return rows.select(key, best.alias("score"))


# ---- evaluators by name -------------------------------------------------------------------

def _each(score: Callable[[Column, Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.select("pair_id", score(F.col("pred"), F.col("answers")).alias("value"))


def _corpus_bleu(rows: DataFrame) -> DataFrame:
    refs = rows.select("pair_id", F.posexplode("answers").alias("ref_no", "text"))
    whole = textmetrics.bleu(rows.select("pair_id", F.col("pred").alias("text")), refs)
    return whole.select(F.lit(None).cast(rows.schema["pair_id"].dataType).alias("pair_id"), F.col("bleu").alias("value"))


def _closest_answer(pred: Column, answers: Column) -> Column:
    return F.array_max(F.transform(answers, lambda t: edit_similarity(pred, t)))


EVALUATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "soft_accuracy": _each(soft_accuracy),
    "exact_match": _each(exact_match),
    "edit_similarity": _each(_closest_answer),
    "bleu": _corpus_bleu,
}


def register_evaluator(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """An evaluator maps ``rows(pair_id, pred, answers)`` to ``(pair_id, value)``; a score of the
    whole corpus has no ``pair_id``."""
    EVALUATORS[name] = fn


def score_answers(rows: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Long scores ``(pair_id, metric, value)`` of the named evaluators, all by default."""
    parts = [EVALUATORS[n](rows).select("pair_id", F.lit(n).alias("metric"), F.col("value").cast("double").alias("value")) for n in names or EVALUATORS]
    return reduce(DataFrame.unionByName, parts)


# ---- pairwise reviews -------------------------------------------------------------------

def review_rules(questions: DataFrame, rules: DataFrame, fallback: str | None = "default") -> tuple[DataFrame, DataFrame]:
    """``(matched, rejects)``: rule by category; with ``fallback`` an unknown one gets that rule."""
    known = questions.join(rules, "category", "left")
    if fallback is None:
        return known.filter("prompt is not null"), known.filter("prompt is null").drop("prompt", "role")
    base = rules.filter(F.col("category") == fallback).select(
        F.col("prompt").alias("_p"), F.col("role").alias("_r")
    )
    p, r = base.select("_p").scalar(), base.select("_r").scalar()
    filled = known.withColumn("prompt", F.coalesce("prompt", p)).withColumn("role", F.coalesce("role", r))
    return filled, questions.limit(0)


def review_content(
    question: Column, answer1: Column, answer2: Column, role: Column, rule: Column,
    context: Column | None = None, boxes: Column | None = None,
) -> Column:
    """Text handed to the reviewer, with the picture context first if there is one."""
    lead = F.lit("")
    if context is not None:
        lead = F.concat(F.lit("[Context]\n"), context, F.lit("\n\n"))
        if boxes is not None:
            lead = F.concat(lead, boxes, F.lit("\n\n"))
    block = lambda n, text: F.concat(
        F.lit("["), role, F.lit(f" {n}]\n"), text, F.lit("\n\n[End of "), role, F.lit(f" {n}]\n\n")
    )
    return F.concat(
        lead, F.lit("[Question]\n"), question, F.lit("\n\n"), block(1, answer1), block(2, answer2),
        F.lit("[System]\n"), rule, F.lit("\n\n"),
    )


def instance_lines(instances: Column) -> Column:
    """``category: [x, y, x, y]`` lines of ``instances ARRAY<STRUCT<category, bbox ARRAY<DOUBLE>>>``."""
    return F.array_join(
        F.transform(
            instances,
            lambda s: F.concat(
                s["category"],
                F.lit(": ["),
                F.array_join(F.transform(s["bbox"], lambda v: X.decimal_text(v)), ", "),
                F.lit("]"),
            ),
        ),
        "\n",
    )


def review_version(config: Column) -> Column:
    return F.when(F.contains(config, F.lit("0613")), "0613").otherwise("0314")


def review_summary(
    reviews: DataFrame, ignore: list[int] = (), version: str | None = None, select: list[str] = ()
) -> DataFrame:
    """Mean pair per (config, category) and for ``all`` of a config; failed reviews count.

    ``reviews(config, question_id, category, score1, score2)``; a NULL category counts in
    ``all`` only.
    """
    kept = reviews
    if ignore:
        kept = kept.filter(~F.col("question_id").isin(list(ignore)))
    for part in select:
        kept = kept.filter(F.contains("config", F.lit(part)))
    if version is not None:
        kept = kept.filter(review_version(F.col("config")) == version)
    level = F.explode(
        F.when(F.col("category").isNull(), F.array(F.lit("all"))).otherwise(F.array(F.col("category"), F.lit("all")))
    )
    means = kept.withColumn("level", level).groupBy("config", "level").agg(
        (F.sum("score1") / F.count("score1")).alias("mean1"),
        (F.sum("score2") / F.count("score2")).alias("mean2"),
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("score1") == -1) & (F.col("score2") == -1)).alias("n_failed"),
    )
    m1, m2 = F.round("mean1", 3), F.round("mean2", 3)
    return means.select(
        "config",
        F.col("level").alias("category"),
        "mean1",
        "mean2",
        "n",
        "n_failed",
        F.round(F.try_divide(m2, m1) * 100, 1).alias("ratio"),
        F.round(m1 * 10, 1).alias("score1_x10"),
        F.round(m2 * 10, 1).alias("score2_x10"),
    )


def review_records(questions: DataFrame, answers1: DataFrame, answers2: DataFrame, reviews: DataFrame) -> DataFrame:
    """Question, both answers and the tidied review side by side, renumbered for display."""
    return (
        questions.select("question_id", "category", F.col("text").alias("question"))
        .join(answers1.select("question_id", F.col("text").alias("answer1")), "question_id")
        .join(answers2.select("question_id", F.col("text").alias("answer2")), "question_id")
        .join(reviews.select("question_id", "content", "score1", "score2"), "question_id")
        .select(
            A.display_id("question_id").alias("id"),
            "question_id",
            "category",
            "question",
            "answer1",
            "answer2",
            A.tidy_evaluation("content").alias("evaluation"),
            "score1",
            "score2",
            A.winner("score1", "score2").alias("winner"),
        )
    )


# ---- question preparation ---------------------------------------------------------------

def option_rounds(rows: DataFrame, letters: list[str] = A.OPTION_LETTERS[:4], all_rounds: bool = True, hint: str | None = P.LETTER_HINT) -> DataFrame:
    """One row per rotation of the options: ``rows(index, question, hint, A…D)``.

    The text is the hint, the question and the options in their current order, listed under
    A, B, C …; ``option_char`` keeps each option's own letter.
    """
    opts = A.options_until_missing(*letters)
    base = rows.withColumn("_o", opts).withColumn("_k", F.size("_o"))
    last = (F.col("_k") - 1) if all_rounds else F.least(F.col("_k") - 1, F.lit(0))
    turned = base.filter("_k > 0").withColumn("round_id", F.explode(F.sequence(F.lit(0), last)))
    n, r = F.col("_k"), F.col("round_id")
    rotate = lambda a: F.concat(F.slice(a, r + 1, n - r), F.slice(a, F.lit(1), r))
    own = F.slice(F.array(*[F.lit(x) for x in letters]), F.lit(1), n)
    turned = turned.withColumn("options", rotate(F.col("_o"))).withColumn("option_char", rotate(own))
    head = F.when(A.is_missing("hint"), F.col("question")).otherwise(F.concat("hint", F.lit("\n"), F.col("question")))
    lines = F.zip_with(own, F.col("options"), lambda c, o: F.concat(F.lit("\n"), c, F.lit(". "), o))
    cur = F.concat(head, F.array_join(lines, ""))
    tail = F.lit("\n" + hint) if hint else F.lit("")
    return turned.select(
        F.col("index").alias("question_id"),
        F.col("round_id").cast("bigint").alias("round_id"),
        cur.alias("cur_prompt"),
        F.concat(cur, tail).alias("text"),
        "options",
        "option_char",
    )


def choice_question(question: Column, has_image: Column, hint: bool = True) -> Column:
    """Strip ``<image>``, put it back in front if there is a picture, add the letter hint."""
    bare = X.strip(X.swap(question, X.IMAGE_TOKEN, ""))
    out = F.when(has_image, F.concat(F.lit(X.IMAGE_TOKEN + "\n"), bare)).otherwise(bare)
    return F.concat(out, F.lit("\n" + P.LETTER_HINT)) if hint else out
