"""Records against ground truth, text metrics, judge runs, generation of records."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import prompt_texts as PT
from ..functions.text import word_count, words
from ..operators import boxes as BX
from ..operators import evaluate as EV
from ..operators import generate as GEN
from ..operators import goals as GO
from ..operators import inference as INF
from ..operators import prompts as PR
from ..operators import records as RC
from ..operators import textmetrics as TM
from .. import scale
from ..session import settle
from . import fixtures as D
from .conversation_queries import q
from .raster_queries import _REGIONS
from .registry import query
from .stem_sql import stems

# ---- records and truth from documents -----------------------------------------------------
# a document is a row of records with five sentences each; field k of the truth is sentence k of
# its record, of the prediction sentences k and k+1

_TAGS = [t for t, _, _ in PT.EVALUATED_FIELDS]


def _truth_and_pred(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "text").withColumn("all", F.split("text", r"\."))
    parts = docs.withColumn("c", F.explode(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / 5).cast("int"))))
    docs = parts.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.concat(F.col("c").cast("string"), F.lit(".xml"))).alias("filename"),
        F.slice("all", F.col("c") * 5 + 1, F.lit(6)).alias("s"),
    )
    s = F.col("s")
    truth = docs.select("filename", *[F.get(s, F.lit(k)).alias(t) for k, t in enumerate(_TAGS)])
    pred = docs.select(
        "filename",
        *[F.concat(F.get(s, F.lit(k)), F.lit(" India "), F.get(s, F.lit(k + 1))).alias(f) for k, (_, f, _) in enumerate(PT.EVALUATED_FIELDS)],
    )
    return truth.withColumn("dest", F.concat(F.lit('In "India" '), "dest")), pred


_WS = " \t\n\r"
_FIELDS = f"""tags(k, tag) AS (VALUES {", ".join(f"({k}, '{t}')" for k, t in enumerate(_TAGS))}),
fp AS (SELECT doc_id || '-' || c || '.xml' AS filename, tag,
    trim(CASE WHEN k = 0 THEN 'In "India" ' || s[1] ELSE s[k+1] END, '{_WS}') AS t0, trim(s[k+1] || ' India ' || s[k+2], '{_WS}') AS pred
  FROM (SELECT doc_id, c, a[c*5+1:c*5+6] AS s FROM (SELECT doc_id, string_split(text, '.') AS a, unnest(range(0, (len(string_split(text, '.')) - 1)//5 + 1)) AS c FROM documents)), tags),
fields AS (SELECT filename, tag, pred, replace(replace(t0, 'India', 'sidewalk'), '"', '') AS truth FROM fp)"""


@query("evaluation_pairs", f"WITH {_FIELDS} SELECT filename, tag, pred, truth FROM fields WHERE pred IS NOT NULL AND truth IS NOT NULL")
def evaluation_pairs(spark, sf):
    truth, pred = _truth_and_pred(spark, sf)
    return EV.field_pairs(pred, truth)[0].drop("pair_id")


@query(
    "evaluation_errors",
    f"WITH {_FIELDS} SELECT filename, tag, CASE WHEN pred IS NULL THEN 'pred' ELSE 'gt' END AS missing_side FROM fields WHERE pred IS NULL OR truth IS NULL",
)
def evaluation_errors(spark, sf):
    truth, pred = _truth_and_pred(spark, sf)
    return EV.field_pairs(pred, truth)[1]


def _rouge_sql(pairs: str, n: int) -> str:
    toks = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    grams = f"list_transform(range(1, len({{0}}) - {n} + 2), lambda i: array_to_string({{0}}[i:i+{n - 1}], ' '))"
    return f"""tk AS (SELECT pair_id, {toks.format("truth")} AS t, {toks.format("pred")} AS p FROM {pairs}),
    gt AS (SELECT pair_id, g, count(*) AS c FROM (SELECT pair_id, unnest({grams.format("t")}) AS g FROM tk) GROUP BY 1, 2),
    gp AS (SELECT pair_id, g, count(*) AS c FROM (SELECT pair_id, unnest({grams.format("p")}) AS g FROM tk) GROUP BY 1, 2),
    h AS (SELECT pair_id, sum(least(gt.c, gp.c)) AS hits FROM gt JOIN gp USING (pair_id, g) GROUP BY 1),
    r AS (SELECT tk.pair_id, coalesce(hits, 0)::BIGINT AS hits, greatest(len(t) - {n - 1}, 0) AS n_truth, greatest(len(p) - {n - 1}, 0) AS n_pred FROM tk LEFT JOIN h USING (pair_id)),
    rouge AS (SELECT *, CASE WHEN hits > 0 THEN 2*(hits/n_pred::DOUBLE)*(hits/n_truth::DOUBLE)/(hits/n_pred::DOUBLE + hits/n_truth::DOUBLE) ELSE 0 END AS value FROM r)"""


@query("rouge_one_words", f"WITH {D.PAIRS}, {_rouge_sql('pairs', 1)} SELECT pair_id, hits, n_truth, n_pred, value FROM rouge")
def rouge_one_words(spark, sf):
    return TM.rouge_n(D.pairs(spark, sf), 1, stemmed=False)


@query("rouge_two_words", f"WITH {D.PAIRS}, {_rouge_sql('pairs', 2)} SELECT pair_id, hits, n_truth, n_pred, value FROM rouge")
def rouge_two_words(spark, sf):
    return TM.rouge_n(D.pairs(spark, sf), 2, stemmed=False)


_ROUGE_TOKENS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_F_MEASURE = "CASE WHEN hits > 0 THEN 2*(hits/n_pred::DOUBLE)*(hits/n_truth::DOUBLE)/(hits/n_pred::DOUBLE + hits/n_truth::DOUBLE) ELSE 0 END AS value"
# words with their place and stem; words of up to three letters are not stemmed
_STEMMED = f"""{D.PAIRS}, raw AS MATERIALIZED (SELECT pair_id, side, unnest(tok) AS word, unnest(range(1, len(tok) + 1)) AS pos FROM (
    SELECT pair_id, 't' AS side, {_ROUGE_TOKENS.format("truth")} AS tok FROM pairs UNION ALL SELECT pair_id, 'p', {_ROUGE_TOKENS.format("pred")} FROM pairs)),
{stems("SELECT word FROM raw", 4)},
tok AS MATERIALIZED (SELECT pair_id, side, pos, stem FROM raw JOIN stems USING (word)),
sizes AS (SELECT pairs.pair_id, count(pos) FILTER (side = 't') AS n_truth, count(pos) FILTER (side = 'p') AS n_pred FROM pairs LEFT JOIN tok USING (pair_id) GROUP BY 1)"""


@query(
    "rouge_one_stemmed",
    f"""WITH {_STEMMED}, c AS (SELECT pair_id, stem, count(*) FILTER (side = 't') AS t, count(*) FILTER (side = 'p') AS p FROM tok GROUP BY 1, 2),
    h AS (SELECT pair_id, sum(least(t, p))::BIGINT AS hits FROM c GROUP BY 1),
    r AS (SELECT pair_id, coalesce(hits, 0) AS hits, n_truth, n_pred FROM sizes LEFT JOIN h USING (pair_id))
    SELECT *, {_F_MEASURE} FROM r""",
)
def rouge_one_stemmed(spark, sf):
    """Stemmed tokens; the SQL takes the suffixes off in a chain of tables."""
    return TM.rouge_n(D.pairs(spark, sf), 1)


# The places of each truth token in the prediction, last place first, are fed one by one into the
# list of the smallest ends of common subsequences of every length (it starts with a 0).
_LONGEST = """feed AS (SELECT a.pair_id, list([b.pos] ORDER BY a.pos, b.pos DESC) AS places FROM tok a JOIN tok b
    ON a.pair_id = b.pair_id AND a.stem = b.stem AND a.side = 't' AND b.side = 'p' GROUP BY 1),
lcs AS (SELECT pair_id, len(list_reduce(list_concat([[0::BIGINT]], places), lambda ends, p:
    list_concat(list_filter(ends, lambda e: e < p[1]), p, (list_filter(ends, lambda e: e >= p[1]))[2:]))) - 1 AS hits FROM feed)"""


@query(
    "rouge_longest_sequence",
    f"""WITH {_STEMMED}, {_LONGEST}, r AS (SELECT pair_id, coalesce(hits, 0) AS hits, n_truth, n_pred FROM sizes LEFT JOIN lcs USING (pair_id))
    SELECT *, {_F_MEASURE} FROM r""",
)
def rouge_longest_sequence(spark, sf):
    """Longest common subsequence of stems; the SQL grows it by increasing places."""
    return TM.rouge_l(D.pairs(spark, sf))


_WORD_LIST = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"


def _meteor_sql(synonyms: bool) -> str:
    """Stages match the k-th last free word of a key in one text with the k-th last in the other."""
    keys = ["word", "stem", *(["grp"] if synonyms else [])]
    out = [
        f"""raw AS MATERIALIZED (SELECT pair_id, side, lower(unnest(tok)) AS word, unnest(range(1, len(tok) + 1)) AS pos FROM (
    SELECT pair_id, 't' AS side, {_WORD_LIST.format("truth")} AS tok FROM pairs UNION ALL SELECT pair_id, 'p', {_WORD_LIST.format("pred")} FROM pairs))""",
        stems("SELECT word FROM raw", 1),
        f"""f0 AS MATERIALIZED (SELECT pair_id, side, pos, word, stem{", coalesce(grp, word) AS grp" if synonyms else ""} FROM raw JOIN stems USING (word){" LEFT JOIN syn USING (word)" if synonyms else ""})""",
    ]
    for k, key in enumerate(keys):
        out.append(f"r{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_id, side, {key} ORDER BY pos DESC) AS k FROM f{k})")
        out.append(f"m{k} AS MATERIALIZED (SELECT p.pair_id, p.pos AS i, t.pos AS j FROM r{k} p JOIN r{k} t ON p.pair_id = t.pair_id AND p.{key} = t.{key} AND p.k = t.k AND p.side = 'p' AND t.side = 't')")
        out.append(
            f"f{k + 1} AS MATERIALIZED (SELECT f.* FROM f{k} f WHERE NOT EXISTS (SELECT 1 FROM m{k} m WHERE m.pair_id = f.pair_id AND CASE WHEN f.side = 'p' THEN m.i ELSE m.j END = f.pos))"
        )
    hits = " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(len(keys)))
    out.append(f"hit AS (SELECT *, lag(i) OVER w AS pi, lag(j) OVER w AS pj FROM ({hits}) WINDOW w AS (PARTITION BY pair_id ORDER BY i))")
    out.append("n AS (SELECT pair_id, count(*)::DOUBLE AS hits, 1 + count(*) FILTER (pi IS NOT NULL AND NOT (i = pi + 1 AND j = pj + 1)) AS chunks FROM hit GROUP BY 1)")
    out.append("s AS (SELECT pairs.pair_id, count(pos) FILTER (side = 't') AS n_t, count(pos) FILTER (side = 'p') AS n_p FROM pairs LEFT JOIN raw USING (pair_id) GROUP BY 1)")
    mean = "(hits/n_p)*(hits/n_t)/(0.9*(hits/n_p) + 0.1*(hits/n_t))"
    return f"WITH {D.PAIRS}, {{more}}{', '.join(out)} SELECT pair_id, round(coalesce((1 - 0.5*(chunks/hits)**3)*({mean}), 0), 9) AS value FROM s LEFT JOIN n USING (pair_id)"


@query(
    "metrics_by_name",
    f"""WITH {D.PAIRS}, {_rouge_sql("pairs", 2)} SELECT pair_id, 'plain2' AS metric, round(value, 9) AS value FROM rouge
    UNION ALL SELECT pair_id, 'word_gap', abs({"len(" + _WORD_LIST.format("truth") + ")"} - {"len(" + _WORD_LIST.format("pred") + ")"}) FROM pairs""",
)
def metrics_by_name(spark, sf):
    """Metrics registered under names of their own and scored by these names."""
    TM.register_metric("plain2", lambda pairs: TM.rouge_n(pairs, 2, stemmed=False).select("pair_id", "value"))
    TM.register_metric("word_gap", lambda pairs: pairs.select("pair_id", F.abs(word_count("truth") - word_count("pred")).cast("double").alias("value")))
    try:
        return TM.score_pairs(D.pairs(spark, sf), ["plain2", "word_gap"]).withColumn("value", F.round("value", 9))
    finally:
        for name in ("plain2", "word_gap"):
            TM.METRICS.pop(name)


@query("meteor_scores", _meteor_sql(False).replace("{more}", ""))
def meteor_scores(spark, sf):
    """Exact and stem stage."""
    return TM.meteor(D.pairs(spark, sf)).withColumn("value", F.round("value", 9))


_SYNONYMS = f"""syn AS MATERIALIZED (SELECT word, left(word, 2) AS grp FROM (SELECT DISTINCT lower(unnest({_WORD_LIST.format("text")})) AS word FROM conversations) WHERE length(word) BETWEEN 4 AND 6), """


@query("meteor_with_synonyms", _meteor_sql(True).replace("{more}", _SYNONYMS))
def meteor_with_synonyms(spark, sf):
    """All three stages; words of four to six letters that start alike count as synonyms."""
    said = D.turns(spark, sf).select(F.explode(F.transform(words("text"), F.lower)).alias("word")).distinct()
    table = said.filter(F.char_length("word").between(4, 6)).select("word", F.substring("word", 1, 2).alias("grp"))
    return TM.meteor(D.pairs(spark, sf), table).withColumn("value", F.round("value", 9))


def _token_vectors(spark, sf, shift: int = 0):
    """Eight tokens of eight whole numbers out of each embedding."""
    z = F.transform("embedding", lambda v: F.floor(v.cast("double") * 100).cast("double"))
    vecs = D.table(spark, sf, "embeddings").select((F.col("vec_id") - shift).alias("pair_id"), z.alias("z"))
    return vecs.select("pair_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos"), "z").select(
        "pair_id", F.col("pos").cast("bigint").alias("pos"), F.slice("z", F.col("pos") * 8 + 1, F.lit(8)).alias("vec")
    )


_VECS = """tv AS (SELECT vec_id, k AS pos, list_transform(embedding[k*8+1:k*8+8], lambda v: floor(v::DOUBLE*100)) AS vec FROM embeddings, range(8) r(k)),
nv AS (SELECT *, sqrt(list_sum(list_transform(vec, lambda v: v*v))) AS nrm FROM tv),
cs AS (SELECT t.vec_id AS pair_id, t.pos AS tp, p.pos AS pp, list_sum(list_transform(range(1, 9), lambda i: t.vec[i]*p.vec[i]))/(t.nrm*p.nrm) AS c
  FROM nv t JOIN nv p ON p.vec_id = t.vec_id + 1 WHERE t.nrm > 0 AND p.nrm > 0)"""


@query(
    "vector_token_scores",
    f"""WITH {_VECS}, r AS (SELECT pair_id, avg(m) AS recall FROM (SELECT pair_id, tp, max(c) AS m FROM cs GROUP BY 1, 2) GROUP BY 1),
    p AS (SELECT pair_id, avg(m) AS precision FROM (SELECT pair_id, pp, max(c) AS m FROM cs GROUP BY 1, 2) GROUP BY 1)
    SELECT pair_id, round(precision, 9) AS precision, round(recall, 9) AS recall, round(2*precision*recall/(precision + recall), 9) AS f1 FROM r JOIN p USING (pair_id)""",
)
def vector_token_scores(spark, sf):
    out = TM.vector_score(_token_vectors(spark, sf), _token_vectors(spark, sf, 1), block=3)
    return out.select("pair_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "noun_similarity_best",
    f"""WITH {_VECS}, ids AS (SELECT vec_id AS pair_id FROM embeddings UNION SELECT vec_id - 1 FROM embeddings)
    SELECT pair_id, round(greatest(coalesce(max(c) FILTER (tp % 2 = 0 AND tp <> 4 AND pp % 2 = 0 AND pp <> 4), 0), 0), 9) AS value FROM ids LEFT JOIN cs USING (pair_id) GROUP BY 1""",
)
def noun_similarity_best(spark, sf):
    """Even positions count as nouns, position 4 as a stop word."""
    tag = lambda df: df.withColumn("tag", F.when(F.col("pos") % 2 == 0, "NOUN").otherwise("VERB")).withColumn("is_stop", F.col("pos") == 4)
    out = TM.noun_similarity(tag(_token_vectors(spark, sf)), tag(_token_vectors(spark, sf, 1)), block=5)
    return out.select("pair_id", F.round("value", 9).alias("value"))


_BLEU_TOK = "list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(
    "bleu_corpus",
    f"""WITH {D.PAIRS}, tk AS (SELECT pair_id, {_BLEU_TOK.format("pred")} AS p, {_BLEU_TOK.format("truth")} AS t, {_BLEU_TOK.format("pred || ' ' || truth")} AS u FROM pairs),
    gp AS (SELECT pair_id, n, unnest(list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(p[i:i+n-1], ' '))) AS g FROM tk, range(1, 5) r(n)),
    g1 AS (SELECT pair_id, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i+n-1], ' '))) AS g FROM tk, range(1, 5) r(n)),
    g2 AS (SELECT pair_id, n, unnest(list_transform(range(1, len(u) - n + 2), lambda i: array_to_string(u[i:i+n-1], ' '))) AS g FROM tk, range(1, 5) r(n)),
    cp AS (SELECT pair_id, n, g, count(*) AS c FROM gp GROUP BY ALL),
    cap AS (SELECT pair_id, n, g, max(c) AS cap FROM (SELECT pair_id, n, g, count(*) AS c FROM g1 GROUP BY ALL UNION ALL SELECT pair_id, n, g, count(*) FROM g2 WHERE pair_id LIKE '%3' GROUP BY ALL) GROUP BY ALL),
    o AS (SELECT n, sum(least(c, coalesce(cap, 0)))::DOUBLE AS hits, sum(c)::DOUBLE AS total FROM cp LEFT JOIN cap USING (pair_id, n, g) GROUP BY n),
    s AS (SELECT sum(len(p))::DOUBLE AS lp, sum(CASE WHEN pair_id LIKE '%3' AND abs(len(u) - len(p)) < abs(len(t) - len(p)) THEN len(u) WHEN pair_id LIKE '%3' AND abs(len(u) - len(p)) = abs(len(t) - len(p)) THEN least(len(u), len(t)) ELSE len(t) END)::DOUBLE AS lt FROM tk)
    SELECT round(CASE WHEN min(hits) = 0 THEN 0 ELSE exp(CASE WHEN any_value(lp) >= any_value(lt) THEN 0 ELSE 1 - any_value(lt)/any_value(lp) END + sum(ln(hits/total))/4) END, 9) AS bleu,
      any_value(lp)::BIGINT AS len_pred, any_value(lt)::BIGINT AS len_truth FROM o, s""",
)
def bleu_corpus(spark, sf):
    """One reference per pair, two for pairs whose id ends in 3."""
    p = D.pairs(spark, sf)
    refs = p.select("pair_id", F.lit(0).alias("ref_no"), F.col("truth").alias("text")).unionByName(
        p.filter(F.col("pair_id").endswith("3")).select("pair_id", F.lit(1).alias("ref_no"), F.concat("pred", F.lit(" "), "truth").alias("text"))
    )
    out = TM.bleu(p.select("pair_id", F.col("pred").alias("text")), refs)
    return out.select(F.round("bleu", 9).alias("bleu"), "len_pred", "len_truth")


def _plain_scores(spark, sf):
    truth, pred = _truth_and_pred(spark, sf)
    pairs = settle(EV.field_pairs(pred, truth)[0], "pairs")  # read three times
    scored = TM.rouge_n(pairs, 1, stemmed=False).select("pair_id", "value")
    return scored.join(pairs.select("pair_id", "filename", "tag"), "pair_id").select(
        "filename", "tag", F.lit("rouge1").alias("metric"), "value"
    )


@query(
    "evaluation_averages",
    f"""WITH {_FIELDS}, ep AS (SELECT filename || '|' || tag AS pair_id, tag, truth, pred FROM fields WHERE pred IS NOT NULL AND truth IS NOT NULL),
    {_rouge_sql("ep", 1)} SELECT tag, 'rouge1' AS metric, round(sum(value)/count(*), 9) AS mean_value, count(*) AS n FROM rouge JOIN ep USING (pair_id) GROUP BY tag""",
)
def evaluation_averages(spark, sf):
    return EV.averages(_plain_scores(spark, sf)).withColumn("mean_value", F.round("mean_value", 9))


_WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"


@query(
    "evaluation_running_means",
    f"""WITH {_FIELDS}, ep AS (SELECT filename, tag, {_WORDS.format("pred")}::DOUBLE AS value FROM fields WHERE pred IS NOT NULL AND truth IS NOT NULL)
    SELECT filename, tag, 'word_count' AS metric, value, sum(value) OVER w/count(*) OVER w AS running_mean, count(*) OVER w AS n_so_far FROM ep
    WINDOW w AS (PARTITION BY tag ORDER BY filename ROWS UNBOUNDED PRECEDING)""",
)
def evaluation_running_means(spark, sf):
    """Mean words so far per field, in file order."""
    pairs = evaluation_pairs(spark, sf)
    scores = pairs.select("filename", "tag", F.lit("word_count").alias("metric"), word_count("pred").cast("double").alias("value"))
    return EV.running_averages(scores)


@query(
    "inference_running_time",
    """SELECT event_id, (sum(event_id % 97) OVER w)/count(*) OVER w::DOUBLE AS running_mean FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def inference_running_time(spark, sf):
    """Running mean over the whole table, no key to split on."""
    ev = D.table(spark, sf, "events").selectExpr("event_id", "cast(event_id % 97 as double) as elapsed_s")
    return scale.running_mean(ev, [], ["event_id"], "elapsed_s").select("event_id", "running_mean")


# ---- judge -------------------------------------------------------------------------------

class RatingClient:
    """Judge stand-in: rates by the length of the prompt, every fifth reply lacks a rating."""

    def generate(self, system, prompt, picture):
        n = len(prompt)
        return "No idea." if n % 5 == 0 else f"Good. Rating: [[{n % 10 + 1}]]"


def _judge_pairs(spark, sf):
    return D.pairs(spark, sf).select(F.col("conv_id").cast("string").alias("filename"), F.col("pair_id").alias("tag"), "truth", "pred")


_JUDGE = f"""{D.PAIRS}, jp AS (SELECT conv_id::VARCHAR AS filename, pair_id AS tag, truth, pred,
    {q(PT.JUDGE_REFERENCE[0])} || truth || {q(PT.JUDGE_REFERENCE[1])} || {q(PT.JUDGE_ANSWER[0])} || pred || {q(PT.JUDGE_ANSWER[1])} AS prompt FROM pairs)"""


@query("judge_requests", f"WITH {_JUDGE} SELECT filename, tag, {q(PT.JUDGE_SYSTEM)} AS system, prompt, {_WORDS.format('pred')} AS word_count, md5('v1|plain' || chr(31) || truth || chr(31) || pred) AS req_id FROM jp")
def judge_requests(spark, sf):
    return EV.judge_requests(_judge_pairs(spark, sf)).drop("picture")


@query(
    "judge_scores",
    f"""WITH {_JUDGE} SELECT filename, tag, 'judge' AS metric, (length(prompt) % 10 + 1)::DOUBLE AS value FROM jp WHERE length(prompt) % 5 <> 0
    UNION ALL SELECT filename, tag, 'word_count', {_WORDS.format("pred")}::DOUBLE FROM jp WHERE length(prompt) % 5 <> 0
    UNION ALL SELECT filename, tag, 'no rating', NULL FROM jp WHERE length(prompt) % 5 = 0""",
)
def judge_scores(spark, sf):
    requests = EV.judge_requests(_judge_pairs(spark, sf))
    answers = INF.answer_table(requests.dropDuplicates(["req_id"]), RatingClient, tries=1)
    scores, errors = EV.judge_scores(requests, answers)
    return scores.unionByName(
        errors.select("filename", "tag", F.col("missing_side").alias("metric"), F.lit(None).cast("double").alias("value"))
    )


@query(
    "judge_cache_reuse",
    f"""WITH {_JUDGE} SELECT count(*) AS n, count(*) FILTER (conv_id % 2 = 0) AS n_cached FROM pairs""",
)
def judge_cache_reuse(spark, sf):
    """Half of the requests are answered from the cache, the rest by calls."""
    requests = EV.judge_requests(_judge_pairs(spark, sf))
    even = requests.filter(F.col("filename").cast("bigint") % 2 == 0)
    cache = settle(
        even.dropDuplicates(["req_id"]).select("req_id", F.lit("from cache").alias("text"), F.lit(None).cast("string").alias("error")), "cache"
    )
    answers, _new = INF.with_cache(requests, cache, RatingClient, tries=1)
    joined = requests.join(answers, "req_id")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == "from cache").alias("n_cached"))


@query(
    "ratings_parsed",
    """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN (event_id % 10 + 1)::DOUBLE + CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0 END END AS rating FROM events""",
)
def ratings_parsed(spark, sf):
    text = F.expr(
        "case when event_id % 7 = 0 then 'Rating: 7' else concat('First. Rating: [[', cast(event_id % 10 + 1 as string), case when event_id % 2 = 0 then '.5' else '' end, ']] then Rating: [[99]]') end"
    )
    return D.table(spark, sf, "events").select("event_id", A.rating(text).alias("rating"))


@query(
    "keyword_prompts",
    f"""WITH {D.PAIRS}, s AS (SELECT pair_id, 'truth' AS side, truth AS text, turn FROM pairs UNION ALL SELECT pair_id, 'pred', pred, turn FROM pairs)
    SELECT pair_id, side, 'Description: ' || text || CASE turn % 3 WHEN 0 THEN {q(PT.KEYWORD_QUESTIONS["recommend"])} WHEN 1 THEN {q(PT.KEYWORD_QUESTIONS["destination"])}
      ELSE {q(PT.KEYWORD_QUESTIONS["other"].replace("{target}", "left"))} END AS prompt FROM s""",
)
def keyword_prompts(spark, sf):
    tag = F.expr("case turn % 3 when 0 then 'recommend' when 1 then 'dest' else 'left' end")
    pairs = D.pairs(spark, sf).withColumn("filename", F.col("pair_id")).withColumn("tag", tag)
    return EV.keyword_requests(pairs).select("pair_id", "side", "prompt")


@query(
    "keyword_pairs",
    f"""WITH {D.PAIRS} SELECT pair_id, array_to_string((list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> ''))[-6:], ' ') AS truth FROM (
      SELECT pair_id, lower(replace(replace(replace('Description: ' || truth || {q(PT.KEYWORD_QUESTIONS["recommend"])}, '.', ''), '"', ''), '''', '')) AS p FROM pairs)""",
)
def keyword_pairs(spark, sf):
    pairs = D.pairs(spark, sf).withColumn("filename", F.col("pair_id")).withColumn("tag", F.lit("recommend"))
    requests = EV.keyword_requests(pairs)
    answers = INF.answer_table(requests, lambda: INF.EchoClient(6), tries=1)
    return EV.keyword_pairs(requests, answers).select("pair_id", "truth")


# ---- requests and records -----------------------------------------------------------------

def _order_goals(spark, sf):
    orders = scale.spread(D.table(spark, sf, "orders").select("o_orderkey", "o_custkey"))
    return orders.selectExpr(
        "o_orderkey as image_id", "'point' as label", "(o_orderkey % 101) / 100.0D as cx", "(o_custkey % 101) / 100.0D as cy"
    )


def _region_boxes(spark, sf):
    """Each box in the regions its number selects."""
    regions = F.element_at(F.array(*[F.lit(r) for r in ("D", "L", "R", "P")]), (F.col("box_no") % 4).cast("int") + 1)
    return D.boxes(spark, sf).withColumn("region", regions)


_NUM = "CASE WHEN ({0}) % 100 = 0 THEN (({0})//100) || '.0' WHEN ({0}) % 10 = 0 THEN (({0})//100) || '.' || (({0}) % 100)//10 ELSE (({0})//100) || '.' || lpad((({0}) % 100)::VARCHAR, 2, '0') END"


def _library_sql(lib: str) -> str:
    return "CASE target " + " ".join(f"WHEN '{t}' THEN {q(text)}" for t, text in PR.library(lib).items()) + " END"


_REQUESTS = f"""{D.INT_BOXES}, ph AS (SELECT image_id, box_no, (['D','L','R','P'])[box_no % 4 + 1] AS region,
    'label' || label_id || ' [' || {_NUM.format("x1")} || ', ' || {_NUM.format("y1")} || ', ' || {_NUM.format("x2")} || ', ' || {_NUM.format("y2")} || ']' AS phrase FROM int_boxes),
bl AS (SELECT image_id, region AS target, string_agg(phrase, ', ' ORDER BY box_no, phrase) AS bx FROM ph GROUP BY 1, 2 UNION ALL SELECT image_id, 'Desc', string_agg(phrase, ', ' ORDER BY box_no, phrase) FROM ph GROUP BY 1),
og AS (SELECT o_orderkey AS image_id, 'point [' || {_NUM.format("o_orderkey % 101")} || ', ' || {_NUM.format("o_custkey % 101")} || ']' AS dest,
  CASE WHEN (o_orderkey % 101)/100.0::DOUBLE < 0.33 THEN 'left' WHEN (o_orderkey % 101)/100.0::DOUBLE > 0.66 THEN 'right' ELSE 'center' END AS side FROM orders),
tg AS (SELECT unnest(['D', 'L', 'R', 'P', 'Desc']) AS target)"""
_SYSTEM = f"{q(PT.SYSTEM_BASE)} || CASE WHEN bx IS NULL THEN '' ELSE {q(' ' + PT.BOXES_LEAD)} || bx || '.' || chr(10) END"


@query(
    "region_requests",
    f"""WITH {_REQUESTS} SELECT og.image_id, target, md5(og.image_id || '|region_views|' || target) AS req_id, {_SYSTEM} AS system,
      replace({_library_sql("region_views")}, '{{destination}}', dest || ' on the ' || side || ' side of the image') AS prompt
    FROM (SELECT * FROM og, tg) og LEFT JOIN bl USING (image_id, target)""",
)
def region_requests(spark, sf):
    goals = _order_goals(spark, sf)
    return PR.region_requests(goals, _region_boxes(spark, sf), D.boxes(spark, sf), with_side=True).drop("picture")


@query(
    "region_requests_all_libraries",
    " UNION ALL ".join(
        f"""(WITH {_REQUESTS} SELECT image_id, '{lib}' AS library, target, md5(replace({_library_sql(lib)}, '{{destination}}', dest)) AS digest FROM og, tg)"""
        for lib in PT.PROMPT_LIBRARIES
    ),
)
def region_requests_all_libraries(spark, sf):
    """Prompt text of every library, target and image, as digests."""
    goals = _order_goals(spark, sf).select(
        "image_id", PR.destination_phrase(F.col("label"), ["cx", "cy"]).alias("dest")
    )
    fan = goals.withColumn("target", F.explode(F.array(*[F.lit(t) for t in PT.TARGETS])))
    each = F.array(
        *[
            F.struct(F.lit(lib).alias("library"), PR.user_prompt(lib, F.col("target"), F.col("dest")).alias("prompt"))
            for lib in PT.PROMPT_LIBRARIES
        ]
    )
    rows = fan.select("image_id", "target", F.explode(each).alias("p"))
    return rows.select("image_id", "target", "p.library", F.md5("p.prompt").alias("digest"))


@query(
    "requests_of_registered_library",
    f"""WITH {_REQUESTS} SELECT image_id, target, 'Ask ' || target || ' of ' || dest || '?' AS prompt FROM og, tg""",
)
def requests_of_registered_library(spark, sf):
    """A prompt library of the user's own, by name."""
    PR.register_library("asked", {t: f"Ask {t} of {{destination}}?" for t in [*PT.TARGETS, PT.DECISION]})
    none = _region_boxes(spark, sf).limit(0)
    return PR.region_requests(_order_goals(spark, sf), none, none, "asked").select("image_id", "target", "prompt")


@query(
    "single_turn_requests",
    f"""WITH {_REQUESTS} SELECT og.image_id, {q(PT.SYSTEM_BASE + PT.DECISION_RULES)} || CASE WHEN bx IS NULL THEN '' ELSE {q(' ' + PT.BOXES_LEAD)} || bx || '.' || chr(10) END AS system,
      replace({q(PT.SINGLE_TURN_PROMPT)}, '{{destination}}', dest) AS prompt FROM og LEFT JOIN bl ON bl.image_id = og.image_id AND target = 'Desc'""",
)
def single_turn_requests(spark, sf):
    return PR.single_turn_requests(_order_goals(spark, sf), D.boxes(spark, sf)).select("image_id", "system", "prompt")


_SINGLE = "CASE doc_id % 4 WHEN 0 THEN 'just text' WHEN 1 THEN '1: a' || chr(10) || '2: b' || chr(10) || '3: c' || chr(10) || '4: d' || chr(10) || '5: e:f' || chr(10) || '6: g' WHEN 2 THEN '1: a' || chr(10) || 'no colon' ELSE 'a:1' || chr(10) || 'b:2' END"


@query(
    "single_turn_records",
    f"""SELECT doc_id AS image_id, CASE WHEN doc_id % 4 = 1 THEN ' a' ELSE {_SINGLE} END AS dest_desc, CASE WHEN doc_id % 4 = 1 THEN ' e:f' ELSE {_SINGLE} END AS desc_before_llm, CASE WHEN doc_id % 4 = 1 THEN ' g' ELSE {_SINGLE} END AS recommend FROM documents""",
)
def single_turn_records(spark, sf):
    text = F.expr(
        "case doc_id % 4 when 0 then 'just text' when 1 then '1: a\\n2: b\\n3: c\\n4: d\\n5: e:f\\n6: g' when 2 then '1: a\\nno colon' else 'a:1\\nb:2' end"
    )
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), text.alias("text"))
    return RC.single_turn_record(docs).select("image_id", "dest_desc", "desc_before_llm", "recommend")


def _last_words(text: str, n: int = 8) -> str:
    return " ".join(text.split()[-n:])


def generated_records(spark, sf):
    """The whole generation run with the echo client: regions, decision, summary, records."""
    goals, boxes = _order_goals(spark, sf), D.boxes(spark, sf)

    def ask(facts, build, name, each=1):
        answered = INF.run_requests(facts, INF.EchoClient, tries=1, keep=RC.ANSWER_KEYS, build=build, each=each)
        return settle(RC.region_answers(answered), name)

    first = ask(PR.region_facts(goals, _region_boxes(spark, sf), boxes), PR.fan_out, "regions", len(PT.TARGETS))
    lists = PR.box_lists(boxes, ["image_id"])
    second = ask(RC.decision_facts(RC.wide_answers(first), lists), RC.decision_fan, "decisions")
    so_far = first.unionByName(second)
    third = ask(RC.summary_facts(RC.wide_answers(so_far)), RC.summary_requests, "summaries")
    sizes = goals.selectExpr("image_id", "640 as w", "480 as h")
    return RC.assemble(RC.wide_answers(so_far.unionByName(third)), goals, sizes)


_A = {t: _last_words(PR.library("region_views")[t].replace("{destination}", "point [0.1, 0.2]")) for t in PT.TARGETS}
_DECIDE_ANSWER = _last_words(PR.library("region_views")["Decs"] + PT.DECISION_TAIL)


@query(
    "records_generated",
    f"""SELECT o_orderkey::VARCHAR AS filename, 'point' AS goal_object_label, {q(_A["D"])} AS dest_desc, {q(_A["L"])} AS left_desc, {q(_A["P"])} AS path_desc, {q(_DECIDE_ANSWER)} AS recommend,
      {q(_last_words(_DECIDE_ANSWER))} AS summary_answer,
      {q(PT.DECISION_LEAD + " ".join(_A[t] for t in PT.TARGETS) + " " + PR.library("region_views")["Decs"] + PT.DECISION_TAIL)} AS recommend_query,
      {q(PT.SUMMARY_COMMAND + PT.SUMMARY_LEAD + " ".join([_A["D"], _A["L"], _A["R"], _A["P"], _DECIDE_ANSWER]))} AS summary_query, (o_orderkey % 101)/100.0::DOUBLE AS cx FROM orders""",
)
def records_generated(spark, sf):
    return generated_records(spark, sf).select(
        "filename", "goal_object_label", "dest_desc", "left_desc", "path_desc", "recommend", "summary_answer",
        "recommend_query", "summary_query", F.col("goal_position_xy")[0].alias("cx"),
    )


@query(
    "records_from_images",
    f"""WITH {D.RASTER}, {D.BOXES}, im AS (SELECT vec_id AS image_id FROM embeddings),
    det AS (SELECT image_id, label, (x_min + x_max)/2 AS cx, row_number() OVER (PARTITION BY image_id ORDER BY md5('17|' || image_id || '|' || box_no), box_no, label, (x_min + x_max)/2, y_max) AS rn
            FROM boxes WHERE label IN ('label1', 'label4')),
    fr AS (SELECT DISTINCT image_id FROM raster WHERE x = 4 AND depth >= 600)
    SELECT im.image_id || '.png' AS filename, coalesce(d.label, 'point') AS goal_object_label, coalesce(d.cx, 0.5) AS cx, {q(_A["L"])} AS left_desc, {q(_DECIDE_ANSWER)} AS recommend, {q(_last_words(_DECIDE_ANSWER))} AS summary_answer
    FROM im LEFT JOIN det d ON d.image_id = im.image_id AND d.rn = 1 LEFT JOIN fr ON fr.image_id = im.image_id""",
)
def records_from_images(spark, sf):
    """From rasters and boxes to records: goals, search, masks, requests, three rounds of answers."""
    images = D.raster_goals(spark, sf).select(
        "image_id", "h", "w", F.concat(F.col("image_id").cast("string"), F.lit(".png")).alias("filename")
    )
    boxes = D.boxes_of(spark, sf, images)
    wanted = boxes.select("label").distinct().filter(F.col("label").isin("label1", "label4"))
    found = GO.pick_one(BX.goal_candidates(boxes, wanted))
    settings = GEN.Settings(front_difference=6.0, goal_radius_px=2, per_metre=D.CM)
    depth = D.raster(spark, sf).withColumn("depth", F.greatest("depth", F.lit(1.0)))
    recs = GEN.generate_records(images, depth, boxes, [("select_det", found)], INF.EchoClient, settings, tries=1).records
    return recs.select(
        "filename", "goal_object_label", F.col("goal_position_xy")[0].alias("cx"), "left_desc", "recommend", "summary_answer"
    )


@query(
    "records_complete",
    """SELECT o_orderkey AS image_id, o_orderkey % 5 <> 0 AS is_complete FROM orders""",
)
def records_complete(spark, sf):
    """One missing answer makes a record incomplete."""
    wide = D.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        *[F.when((F.col("o_orderkey") % 5 != 0) | F.lit(t != "R"), F.lit("x")).alias(f"a_{t}") for t in RC.RECORD_FIELDS],
    )
    return wide.select("image_id", RC.complete(wide).alias("is_complete"))


@query(
    "records_reuse_merge",
    """SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 3 = 0 THEN 'old d ' || o_custkey END AS dest_desc, 'new l ' || o_orderkey AS left_desc FROM orders""",
)
def records_reuse_merge(spark, sf):
    orders = D.table(spark, sf, "orders")
    fresh = orders.selectExpr("o_orderkey as image_id", "concat('new d ', o_orderkey) as dest_desc", "concat('new l ', o_orderkey) as left_desc")
    old = orders.filter("o_orderkey % 3 = 0").selectExpr("o_orderkey as image_id", "concat('old d ', o_custkey) as dest_desc", "concat('old l ', o_custkey) as left_desc")
    return RC.reuse_answers(fresh, old, {"dest_desc": True, "left_desc": False})


class BoxListClient:
    """Answers with the boxes its system text names, so that regions show in the records."""

    def generate(self, system, prompt, picture):
        at = system.find(PT.BOXES_LEAD)
        return "no boxes" if at < 0 else system[at + len(PT.BOXES_LEAD) :].removesuffix(".\n")


# straight path of six points to the annotated goal; half a width of one metre in centimetres, a
# focal length of 0.6 widths
_SHOWN = f"""{_REGIONS.replace("1.0/depth*1000.0::DOUBLE", "100.0/depth*4.8::DOUBLE")}, {D.BOXES},
one AS (SELECT image_id, box_no FROM int_boxes SEMI JOIN rgoals USING (image_id) GROUP BY 1, 2 HAVING count(*) = 1),
ph AS (SELECT image_id, box_no, x1, y1, x2, y2, 'label' || label_id || ' [' || {_NUM.format("x1")} || ', ' || {_NUM.format("y1")} || ', ' || {_NUM.format("x2")} || ', ' || {_NUM.format("y2")} || ']' AS phrase
  FROM int_boxes SEMI JOIN one USING (image_id, box_no)),
kb AS (SELECT *, trunc(x1/100.0::DOUBLE*8)::BIGINT AS px1, trunc(y1/100.0::DOUBLE*8)::BIGINT AS py1, trunc(x2/100.0::DOUBLE*8)::BIGINT AS px2, trunc(y2/100.0::DOUBLE*8)::BIGINT AS py2 FROM ph),
hit AS (SELECT image_id, region, box_no, phrase FROM kb JOIN regions USING (image_id) WHERE px2 > px1 AND py2 > py1 AND y >= py1 AND y < py2 AND x >= px1 AND x < px2
  GROUP BY image_id, region, box_no, phrase, px1, py1, px2, py2 HAVING count(*)/((px2 - px1)*(py2 - py1))::DOUBLE >= 0.1),
bl AS (SELECT image_id, region, string_agg(phrase, ', ' ORDER BY box_no) AS bx FROM hit GROUP BY 1, 2 UNION ALL SELECT image_id, 'Desc', string_agg(phrase, ', ' ORDER BY box_no) FROM ph GROUP BY 1),
shown AS (SELECT image_id, image_id || '.png' AS filename, gx/8.0::DOUBLE AS cx, gy/8.0::DOUBLE AS cy,
  {", ".join(f"coalesce((SELECT any_value(bx) FROM bl WHERE bl.image_id = g.image_id AND region = '{t}'), 'no boxes') AS {n}_desc" for t, n in (("D", "dest"), ("L", "left"), ("R", "right"), ("P", "path"), ("Desc", "scene")))}
  FROM rgoals g)"""
_WALKED = "(SELECT string_agg(px || ':' || py, ' ' ORDER BY seq) FROM pts WHERE pts.image_id = shown.image_id) AS walked"


def _image_tables(spark, sf):
    """Images, rasters and boxes of one number each."""
    images = D.raster_goals(spark, sf).select(
        "image_id", "h", "w", F.concat(F.col("image_id").cast("string"), F.lit(".png")).alias("filename")
    )
    boxes = D.boxes_of(spark, sf, images)
    once = boxes.groupBy("image_id", "box_no").count().filter("count = 1").select("image_id", "box_no")
    return images, D.raster(spark, sf), settle(boxes.join(once, ["image_id", "box_no"]), "boxes")


def _annotated(spark, sf) -> dict:
    """Annotated goal pixels."""
    return {"points": D.raster_goals(spark, sf).selectExpr("image_id", "cast(gx as double) as px", "cast(gy as double) as py")}


_STRAIGHT = GEN.Settings(planner=None, line_points=6, goal_radius_px=2, depth_buffer=1.5, per_metre=D.CM)


@query(
    "records_with_regions",
    f"WITH {_SHOWN} SELECT filename, cx, cy, dest_desc, left_desc, right_desc, path_desc, scene_desc, scene_desc AS recommend, 'no boxes' AS summary_answer, {_WALKED} FROM shown",
)
def records_with_regions(spark, sf):
    """From rasters with depth 0 and named goals to records whose answers show the boxes of each
    region, beside the path walked."""
    images, depth, boxes = _image_tables(spark, sf)
    run = GEN.generate_records(images, depth, boxes, ["load_anno"], BoxListClient, _STRAIGHT, inputs=_annotated(spark, sf), tries=1)
    points = run.points.join(images.select("image_id", "h", "w"), "image_id")
    cell = F.concat_ws(":", F.floor(F.least(F.col("x") * F.col("w"), F.col("w") - 1)).cast("string"), F.floor(F.least(F.col("y") * F.col("h"), F.col("h") - 1)).cast("string"))
    walked = points.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("seq", cell.alias("c")))).alias("s"))
    return run.records.join(walked, "image_id").select(
        "filename", F.col("goal_position_xy")[0].alias("cx"), F.col("goal_position_xy")[1].alias("cy"), "dest_desc", "left_desc", "right_desc",
        "path_desc", F.col("desc_before_llm").alias("scene_desc"), "recommend", "summary_answer", F.array_join("s.c", " ").alias("walked"),
    )


@query(
    "records_resumed",
    f"WITH {_SHOWN} SELECT filename, CASE WHEN image_id % 2 = 0 THEN left_desc ELSE 'second' END AS left_desc, CASE WHEN image_id % 2 = 0 THEN 1 ELSE 2 END AS run FROM shown",
)
def records_resumed(spark, sf):
    """A run over half of the images, one over all, one that finds all finished and makes no call."""
    images, depth, boxes = _image_tables(spark, sf)
    out, cache, finished = None, None, None
    for k, client in enumerate((BoxListClient, lambda: INF_SECOND, NoCalls)):
        todo = images.filter("image_id % 2 = 0") if k == 0 else images
        run = GEN.generate_records(
            todo, depth, boxes, ["load_anno"], client, _STRAIGHT, inputs=_annotated(spark, sf), finished=finished, goal_cache=cache, tries=1
        )
        made = settle(run.records.select("image_id", "filename", "left_desc", F.lit(k + 1).alias("run")), "finished")
        out, cache = made if out is None else out.unionByName(made), run.goals if cache is None else cache.unionByName(run.goals)
        finished = out
    return out.drop("image_id")


class _Second:
    def generate(self, system, prompt, picture):
        return "second"


INF_SECOND = _Second()


class NoCalls:
    """A client that must not be called."""

    def generate(self, system, prompt, picture):
        raise AssertionError("a call for a finished image")


@query(
    "records_recycled",
    f"WITH {_SHOWN} SELECT filename, 'earlier ' || image_id AS dest_desc, left_desc, 'kept ' || image_id AS recommend FROM shown WHERE image_id % 3 <> 0",
)
def records_recycled(spark, sf):
    """Two answers come from earlier records without a call; an image that lacks one has no record."""
    images, depth, boxes = _image_tables(spark, sf)
    text = lambda word: F.concat(F.lit(word + " "), F.col("image_id").cast("string"))
    empty = [F.lit(None).cast("string").alias(c) for pair in RC.RECORD_FIELDS.values() for c in pair if c not in ("dest_query", "dest_desc", "recommend_query", "recommend")]
    earlier = images.select(
        "image_id", F.lit("q").alias("dest_query"), text("earlier").alias("dest_desc"), F.lit("q").alias("recommend_query"),
        F.when(F.col("image_id") % 3 != 0, text("kept")).alias("recommend"), *empty,
    )
    run = GEN.generate_records(
        images, depth, boxes, ["load_anno"], BoxListClient, _STRAIGHT, inputs=_annotated(spark, sf), earlier=earlier,
        reuse={"dest_desc": True, "recommend": True}, tries=1,
    )
    return run.records.select("filename", "dest_desc", "left_desc", "recommend")


class SixLineClient:
    """Six numbered lines, the fifth with the boxes of the image."""

    def generate(self, system, prompt, picture):
        return "\n".join(f"{k}: {BoxListClient().generate(system, prompt, picture) if k == 5 else 'text ' + str(k)}" for k in range(1, 7))


@query(
    "records_single_turn",
    f"WITH {_SHOWN} SELECT filename, cx, ' text 2' AS left_desc, ' ' || scene_desc AS scene_desc, ' text 6' AS recommend FROM shown",
)
def records_single_turn(spark, sf):
    """One request per image instead of seven."""
    images, depth, boxes = _image_tables(spark, sf)
    run = GEN.generate_records(
        images, depth, boxes, ["load_anno"], SixLineClient, dataclasses.replace(_STRAIGHT, single_turn=True), inputs=_annotated(spark, sf), tries=1
    )
    return run.records.select("filename", F.col("goal_position_xy")[0].alias("cx"), "left_desc", F.col("desc_before_llm").alias("scene_desc"), "recommend")


@query(
    "goals_by_method",
    f"""WITH {D.RASTER}, {D.RASTER_GOALS}, {D.BOXES},
    det AS (SELECT image_id, label, (x_min + x_max)/2 AS cx, y_max AS cy, row_number() OVER (PARTITION BY image_id ORDER BY md5('17|' || image_id || '|' || box_no), box_no, label, (x_min + x_max)/2, y_max) AS rn
            FROM boxes WHERE label IN ('label1', 'label4')),
    fr AS (SELECT image_id, max(y)/8.0::DOUBLE AS cy FROM raster WHERE x = 4 AND depth >= 600 GROUP BY 1),
    src AS (SELECT image_id, 1 AS o, 'load_output_typed_xml' AS method, 'old' AS label, 0.25::DOUBLE AS cx, 0.5::DOUBLE AS cy FROM rgoals WHERE image_id % 5 = 0
      UNION ALL SELECT image_id, 2, 'load_xml', 'point', 0.75, 0.25 FROM rgoals WHERE image_id % 5 = 1
      UNION ALL SELECT image_id, 3, 'load_anno', 'point', gx/8.0::DOUBLE, gy/8.0::DOUBLE FROM rgoals WHERE image_id % 5 = 2
      UNION ALL SELECT image_id, 4, 'select_det', label, cx, cy FROM det WHERE rn = 1
      UNION ALL SELECT image_id, 5, 'front', 'circle', 0.5, cy FROM fr
      UNION ALL SELECT image_id, 6, 'default', 'point', 0.5, 0.75 FROM rgoals)
    SELECT image_id, method, label, cx, cy FROM src SEMI JOIN rgoals USING (image_id) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY o) = 1""",
)
def goals_by_method(spark, sf):
    """All goal methods by name, in order of preference."""
    g = D.raster_goals(spark, sf)
    images = g.select("image_id", "h", "w", F.col("image_id").cast("string").alias("filename"))
    boxes = D.boxes(spark, sf).join(images.select("image_id"), "image_id", "left_semi")
    given = GO.GoalInputs(
        images, boxes, D.raster(spark, sf), boxes.select("label").distinct().filter(F.col("label").isin("label1", "label4")),
        points=g.filter("image_id % 5 = 2").selectExpr("image_id", "cast(gx as double) as px", "cast(gy as double) as py"),
        marked=g.filter("image_id % 5 = 1").selectExpr("image_id", "0.75D as cx", "0.25D as cy"),
        records=g.filter("image_id % 5 = 0").selectExpr("image_id", "'old' as label", "0.25D as cx", "0.5D as cy"),
        difference=600.0,
    )
    names = ["load_output_typed_xml", "load_xml", "load_anno", "select_det"]
    return GO.goals_by_name(given, names, circle=True).select("image_id", "method", "label", "cx", "cy")


@query(
    "records_with_lists",
    f"""WITH {D.BOXES} SELECT image_id, count(*) AS n_boxes, sum((x_min = 0.05::DOUBLE)::INT)::BIGINT AS n_edge FROM boxes GROUP BY image_id""",
)
def records_with_lists(spark, sf):
    """Boxes nested into each record, counted back out."""
    b = D.boxes(spark, sf)
    points = b.selectExpr("image_id", "box_no as seq", "x_min as x", "y_min as y")
    nested = RC.attach_lists(b.select("image_id").distinct(), b, points)
    return nested.select(
        "image_id", F.size("bboxes").cast("bigint").alias("n_boxes"),
        F.size(F.filter("path_array", lambda p: p["x"] == 0.05)).cast("bigint").alias("n_edge"),
    )


@query(
    "training_samples",
    f"""SELECT doc_id || '' AS id, doc_id || '.v1.jpg' AS image, 'human' AS from0, {q(PT.EXPORT_QUESTION)} AS value0, 'navigation assistant' AS from1, text AS value1 FROM documents""",
)
def training_samples(spark, sf):
    recs = D.table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".v1.jpg")).alias("filename"), F.col("text").alias("summary_answer"))
    c = F.col("conversations")
    return RC.training_samples(recs).select(
        "id", "image", c[0]["from"].alias("from0"), c[0]["value"].alias("value0"), c[1]["from"].alias("from1"), c[1]["value"].alias("value1")
    )


# ---- calls --------------------------------------------------------------------------------

@query(
    "answers_echoed",
    f"""SELECT doc_id, array_to_string((list_filter(regexp_split_to_array(text, '[\\s]+'), lambda w: w <> ''))[-8:], ' ') AS text, 'echo' AS client FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 'hello world', 'dummy' FROM documents WHERE doc_id % 2 = 1""",
)
def answers_echoed(spark, sf):
    """Rows routed to two clients."""
    docs = D.table(spark, sf, "documents")
    client = F.when(F.col("doc_id") % 2 == 0, "echo").otherwise("dummy")
    requests = docs.select(
        F.col("doc_id").alias("req_id"), F.lit("").alias("system"), F.col("text").alias("prompt"),
        F.lit(None).cast("string").alias("picture"), client.alias("client"),
    )
    answers = INF.answer_table(requests, {"echo": INF.EchoClient, "dummy": INF.DummyClient}, tries=1)
    return answers.join(requests.select("req_id", "client"), "req_id").select(F.col("req_id").alias("doc_id"), "text", "client")


class FlakyClient:
    """Fails on every prompt that starts with a capital E."""

    def generate(self, system, prompt, picture):
        if prompt.startswith("E"):
            raise RuntimeError("busy")
        return "fine"


@query(
    "answers_with_retries",
    """SELECT doc_id, CASE WHEN starts_with(text, 'E') THEN '#ERROR#' ELSE 'fine' END AS text, CASE WHEN starts_with(text, 'E') THEN 3 ELSE 1 END AS tries,
       CASE WHEN starts_with(text, 'E') THEN 'RuntimeError: busy' END AS error FROM documents""",
)
def answers_with_retries(spark, sf):
    requests = D.table(spark, sf, "documents").select(
        F.col("doc_id").alias("req_id"), F.lit("").alias("system"), F.col("text").alias("prompt"), F.lit(None).cast("string").alias("picture")
    )
    answers = INF.answer_table(requests, FlakyClient, tries=3, wait_s=0.0, failure_text=INF.FAILED_TEXT)
    return answers.select(F.col("req_id").alias("doc_id"), "text", "tries", "error")


@query(
    "answers_chained",
    """WITH RECURSIVE t AS (SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS i, text FROM conversations),
    w AS (SELECT conv_id, i, array_to_string((list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))[-4:], ' ') AS tail FROM t)
    SELECT conv_id, i, tail AS answer FROM w""",
)
def answers_chained(spark, sf):
    """Turn by turn over all conversations; the echo answers with the last words of the question."""
    t = D.turns(spark, sf)
    first = t.groupBy("conv_id").agg(F.min("turn").alias("t0"))
    questions = t.join(first, "conv_id").select("conv_id", (F.col("turn") - F.col("t0")).alias("i"), "text")
    return INF.chain_turns(questions, lambda: INF.EchoClient(4), history="last", tries=1).select("conv_id", "i", "answer")


@query(
    "answers_joined",
    """SELECT conv_id AS req_id, string_agg(text, '[!@#$NEXT!@#$]' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""",
)
def answers_joined(spark, sf):
    return INF.join_answers(D.turns(spark, sf).select(F.col("conv_id").alias("req_id"), F.col("turn").alias("part"), "text"))


@query(
    "answers_cleaned",
    """SELECT doc_id, text FROM documents""",
)
def answers_cleaned(spark, sf):
    """Control tokens put into each text and removed again."""
    from ..functions.text import remove_tokens

    noisy = F.concat(F.lit("<|startoftext|>"), "text", F.lit("[!@#$NEXT!@#$]<|im_end|>"))
    return D.table(spark, sf, "documents").select("doc_id", remove_tokens(noisy).alias("text"))


@query(
    "question_run",
    f"""SELECT doc_id AS question_id, text AS prompt, 'ASSISTANT:' AS text, md5(doc_id || '|m1') AS answer_id, 'm1' AS model_id FROM documents""",
)
def question_run(spark, sf):
    """Answer log of a sharded run; the echo returns the last word of the rendered prompt."""
    questions = D.table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"), "text")
    asked = INF.question_prompts(questions, "vision_v1")
    return INF.answer_questions(asked, lambda: INF.EchoClient(1), "m1", shards=4, tries=1).drop("metadata")
