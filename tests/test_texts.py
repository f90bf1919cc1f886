"""Hand-worked rows for parsers, prompts, metrics and label masks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kerbline.functions import answers as A
from kerbline.functions import geometry as G
from kerbline.functions import prompt_texts as PT
from kerbline.functions import text as X
from kerbline.functions.stemming import stem
from kerbline.operators import benchmarks as BM
from kerbline.operators import conversations as C
from kerbline.operators import evaluate as EV
from kerbline.operators import inference as INF
from kerbline.operators import prompts as PR
from kerbline.operators import textmetrics as TM
from kerbline.operators import tokens as K


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text, want",
    [
        ("The cat's hat", "cat 's hat"),
        ("Two dogs, isnt it?", "2 dogs isn't it"),
        ("a-b", "b"),  # the mark stands between letters, so it becomes a space; 'a' is an article
        ("x -y", "x y"),
        ("none", "0"),
        ("3.5 cm.", "3.5 cm"),
        ("", ""),
    ],
)
def test_normalised_answers(spark, text, want):
    assert one(spark, A.normalise_answer("t"), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [("Yes, there is.", "yes"), ("There is not. Yes", "no"), ("Nothing here", "yes"), ("No", "no"), ("Yes. No", "yes"), ("no,ne", "yes")],
)
def test_yes_no(spark, text, want):
    assert one(spark, A.yes_no("t"), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("A", "A"), ("B. yes", "B"), ("The answer is C.", "C"),
        ("The answer is C", "FAILED"),  # one more character is needed
        ("The answer is A. The answer is B.", "FAILED"), ("F", "FAILED"), ("", "FAILED"),
    ],
)
def test_option_letters(spark, text, want):
    assert one(spark, A.option_letter("t"), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [("8 9\nbest", [8, 9]), ("8,9", [8, 9]), ("8, 9", [-1, -1]), ("8 9 1", [-1, -1]), ("a b", [-1, -1]), ("8d 9", [-1, -1]), ("", [-1, -1])],
)
def test_score_pairs(spark, text, want):
    assert one(spark, A.score_pair("t"), t=text) == want


def test_rating(spark):
    assert one(spark, A.rating("t"), t="x Rating: [[7.5]] Rating: [[1]]") == 7.5
    assert one(spark, A.rating("t"), t="Rating: 7") is None


def test_options_stop_at_the_first_missing(spark):
    row = spark.createDataFrame([("a", "b", "NaN", "d")], "A string, B string, C string, D string")
    assert row.select(A.options_until_missing("A", "B", "C", "D").alias("v")).first().v == ["a", "b"]


def test_asked_question(spark):
    ask = lambda t: one(spark, A.asked_question("t"), t=t)
    assert ask("OCR tokens: a\nQuestion: What\nIs it? Short answer:") == "what\nis it?"
    assert ask("Reference OCR token: a\nWhat?\nAnswer") == "what?"
    assert ask("What?\nReference OCR token: a\nAnswer") == "what?"
    assert ask("What?\nAnswer") == "what?"
    assert ask("What?") is None


def test_edit_similarity(spark):
    sim = lambda a, b: one(spark, BM.edit_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert sim("Kitten ", "sitten") == pytest.approx(5 / 6)
    assert sim("abc", "xyz") == 0.0
    assert sim("", "") is None


@pytest.mark.parametrize("value, want", [(0.5, "0.5"), (1.0, "1.0"), (0.1234, "0.1234"), (0.00012, "0.0001"), (-0.25, "-0.25"), (0.0, "0.0"), (12.3, "12.3")])
def test_decimal_text(spark, value, want):
    assert one(spark, X.decimal_text("x"), x=value) == want


def test_tidy_and_renumber(spark):
    assert one(spark, A.tidy_evaluation("t"), t=" 8, 9\nAssistant 1 wins\n") == "**Assistant 1** wins"
    assert one(spark, A.drop_head_lines("t", 2), t="a\nb\nc") == "c"
    ids = spark.createDataFrame([(i,) for i in (1, 20, 21, 27, 70, 75, 80)], "i int").select("i", A.display_id("i").alias("d"))
    assert {r.i: r.d for r in ids.collect()} == {i: _renumber(i) for i in (1, 20, 21, 27, 70, 75, 80)}


def _renumber(i):
    i = i + 60 if i <= 20 else i - 20
    if i <= 50:
        i += 10
    elif i <= 60:
        i -= 50
    return 1 if i == 7 else i + 1 if i < 7 else i


def test_camera_markers_first_match(spark):
    fx = G.camera_ratios("n")[0]
    assert one(spark, fx, n="ZED_R1") == pytest.approx(0.5553062574145965 * 3.0)
    assert one(spark, fx, n="plain") == pytest.approx(1.8)


# ---- prompts ---------------------------------------------------------------------------

def test_single_answer_split(spark):
    split = lambda t: one(spark, PR.split_single_answer("t"), t=t)
    six = "\n".join(f"{k}: v{k}" for k in range(6))
    assert split(six) == [f" v{k}" for k in range(6)]
    assert split("no colon") == ["no colon"] * 6
    assert split("a: 1\nb: 2") == ["a: 1\nb: 2"] * 6


def test_unknown_target_has_no_prompt(spark):
    row = spark.createDataFrame([("Not",), ("D",)], "t string")
    got = row.select(PR.user_prompt("region_views", F.col("t"), F.lit("x")).alias("p")).collect()
    assert got[0].p is None and "orange x" in got[1].p


def test_library_registry():
    with pytest.raises(ValueError):
        PR.register_library("broken", {"D": "x"})
    PR.register_library("mine", {t: f"{t} {{destination}}" for t in [*PT.TARGETS, PT.DECISION]})
    assert PR.library("mine")["L"] == "L {destination}"


def turns(spark, texts, roles=None):
    roles = roles or ["human", "gpt"] * len(texts)
    return spark.createDataFrame([(1, i, r, t) for i, (t, r) in enumerate(zip(texts, roles))], "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize(
    "template, want",
    [
        ("vision_v0", "{s}###Human: q###Assistant: a###"),
        ("vicuna_v1", "{s} USER: q ASSISTANT: a</s>"),
        ("mpt", "{s}<|im_end|><|im_start|>user\nq<|im_end|><|im_start|>assistant\na<|im_end|>"),
        ("llama_2", "[INST] <<SYS>>\n{s}\n<</SYS>>\n\nq [/INST] a </s>"),
        ("mistral_instruct", "[INST] q [/INST] a </s>"),
        ("plain", "q\na"),
    ],
)
def test_rendering(spark, template, want):
    good, rejects = C.index_turns(turns(spark, ["q", "a"]))
    prompt = C.render_prompts(C.with_template(good, template)).first().prompt
    assert prompt == want.replace("{s}", PT.TEMPLATES[template][0]) and rejects.count() == 0


def test_open_turn_ends_with_the_role(spark):
    good, _ = C.index_turns(turns(spark, ["q", ""]))
    assert C.render_prompts(C.with_template(good, "vicuna_v1")).first().prompt.endswith("USER: q ASSISTANT:")


def test_leading_gpt_turn_is_dropped(spark):
    good, rejects = C.index_turns(turns(spark, ["hi", "q", "a"], ["gpt", "human", "gpt"]))
    assert [r.text for r in good.orderBy("i").collect()] == ["q", "a"] and rejects.count() == 0
    _, rejects = C.index_turns(turns(spark, ["q", "q2"], ["human", "human"]))
    assert rejects.first().reason == "roles do not alternate"


def test_a_repeat_that_hides_a_gap_is_rejected(spark):
    rows = [(1, t, "human" if t % 2 == 0 else "gpt", "x") for t in (0, 1, 2, 2, 3, 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    good, rejects = C.index_turns(df)
    assert good.count() == 0 and rejects.first().reason == "gap in turns"


# ---- labels ------------------------------------------------------------------------------

def test_two_separator_labels_keep_answers(spark):
    tok = K.WordTokenizer()
    good, _ = C.index_turns(turns(spark, ["one two", "three four five", "six", "seven"]))
    prompts = C.render_prompts(C.with_template(good, "vision_v1"))
    row = K.label_by_style(prompts, tok, "vision_v1").first()
    assert not row.mismatch and len(row.labels) == len(row.input_ids)
    words = [w for w in row.prompt.replace("</s>", " </s> ").split()]
    kept = [w for w, lab in zip(["<bos>", *words], row.labels) if lab != K.IGNORE]
    # the instruction is two ids shorter than its text, so the role marker stays with the answer
    assert kept == ["ASSISTANT:", "three", "four", "five", "</s>", "ASSISTANT:", "seven", "</s>"]


def test_mismatch_ignores_everything(spark):
    tok = K.WordTokenizer(specials=())  # '</s>' sticks to words, so lengths disagree
    good, _ = C.index_turns(turns(spark, ["one", "two", "three", "four"]))
    row = K.label_by_style(C.render_prompts(C.with_template(good, "vision_v1")), tok, "vision_v1").first()
    assert row.mismatch and set(row.labels) == {K.IGNORE}


def test_image_labels_count_image_places(spark):
    tok = K.WordTokenizer()
    good, _ = C.index_turns(turns(spark, ["<image>\nwhat is it", "a cat"]))
    prompts = C.render_prompts(C.with_template(good, "vision_v1"))
    row = K.label_by_style(prompts, tok, "vision_v1", has_image=True).first()
    assert row.input_ids.count(K.IMAGE_ID) == 1 and not row.mismatch
    assert sum(lab != K.IGNORE for lab in row.labels) == 4  # role marker, a, cat, </s>


def test_plain_rejects(spark):
    df = spark.createDataFrame([(1, ["<image>", "a b"]), (2, ["no", "a"]), (3, ["<image>"])], "conv_id long, texts array<string>")
    rows, rejects = K.label_plain(df, K.WordTokenizer())
    row = rows.first()
    assert row.labels[:2] == [K.IGNORE] * 2 and row.labels[2:] == row.input_ids[2:]
    assert sorted(r.conv_id for r in rejects.collect()) == [2, 3]


def test_arrow_tokenizer_agrees_with_builtin(spark):
    plug = K.ArrowTokenizer(lambda: lambda t: [1, *[len(w) for w in t.split()]])
    df = spark.createDataFrame([(1, "ab <image> cde f")], "conv_id long, text string")
    assert K.image_token_ids(df, "text", plug).first().input_ids == [1, 2, K.IMAGE_ID, 3, 1]


# ---- metrics -----------------------------------------------------------------------------

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_against_the_table(spark):
    import random

    rnd = random.Random(5)
    data = [([rnd.choice("abcd") for _ in range(rnd.randrange(90))], [rnd.choice("abcd") for _ in range(rnd.randrange(90))]) for _ in range(60)]
    df = spark.createDataFrame(data, "a array<string>, b array<string>").select("a", "b", TM.lcs_length("a", "b").alias("n"))
    for r in df.collect():
        assert r.n == lcs(r.a, r.b)


def test_meteor_worked(spark):
    """Six matches in six chunks; an equal text; no match; a match by stem only."""
    data = [
        ("1", "the cat sat on the mat", "on the mat sat the cat"),
        ("2", "the cat sat on the mat", "the cat sat on the mat"),
        ("3", "a b", "c d"),
        ("4", "walking dogs", "walked dog"),
        ("5", "", "x"),
    ]
    got = {r.pair_id: r.value for r in TM.meteor(spark.createDataFrame(data, "pair_id string, truth string, pred string")).collect()}
    assert got["1"] == pytest.approx(1 - 0.5 * (6 / 6) ** 3)
    assert got["2"] == pytest.approx(1 - 0.5 * (1 / 6) ** 3)
    assert got["3"] == 0.0 and got["5"] == 0.0
    assert got["4"] == pytest.approx(1 - 0.5 * (1 / 2) ** 3)


def test_rouge_stemmed(spark):
    df = spark.createDataFrame([("1", "The runners were running", "a runner runs")], "pair_id string, truth string, pred string")
    row = TM.rouge_n(df, 1).first()
    assert (row.hits, row.n_truth, row.n_pred) == (2, 4, 3)  # runner, run


@pytest.mark.parametrize(
    "word, want",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("agreed", "agre"), ("plastered", "plaster"),
        ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"),
        ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("operator", "oper"),
        ("hopefulness", "hope"), ("formalize", "formal"), ("electrical", "electr"), ("goodness", "good"),
        ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("activate", "activ"), ("rate", "rate"),
        ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
    ],
)
def test_stems_of_published_words(word, want):
    assert stem(word) == want


def test_vector_score_blocks_agree(spark):
    rows = [(1, i, [float((i * 7 + j * 3) % 5 + 1) for j in range(4)]) for i in range(23)]
    other = [(1, i, [float((i * 5 + j) % 6 + 1) for j in range(4)]) for i in range(17)]
    a = spark.createDataFrame(rows, "pair_id long, pos long, vec array<double>")
    b = spark.createDataFrame(other, "pair_id long, pos long, vec array<double>")
    x, y = TM.vector_score(a, b, block=4).first(), TM.vector_score(a, b, block=100).first()
    assert x.f1 == pytest.approx(y.f1) and x.precision == pytest.approx(y.precision)


def test_errors_on_both_sides(spark):
    truth = spark.createDataFrame([("a.xml", "d", None, "r", "p", "go")], "filename string, dest string, left string, right string, path string, recommend string")
    pred = spark.createDataFrame(
        [("a.xml", "d", "l", None, "p", "go"), ("b.xml", "x", "x", "x", "x", "x")],
        "filename string, dest_desc string, left_desc string, right_desc string, path_desc string, recommend string",
    )
    pairs, errors = EV.field_pairs(pred, truth)
    assert sorted(r.tag for r in pairs.collect()) == ["dest", "path", "recommend"]
    assert sorted((r.filename, r.tag, r.missing_side) for r in errors.collect()) == sorted(
        [("a.xml", "left", "gt"), ("a.xml", "right", "pred"), *[("b.xml", t, "gt") for t in ("dest", "left", "right", "path", "recommend")]]
    )


def test_review_summary_keeps_failed_scores(spark):
    rows = [("r", 1, "conv", 8.0, 4.0), ("r", 2, "conv", -1.0, -1.0), ("r", 3, None, 6.0, 6.0)]
    df = spark.createDataFrame(rows, "config string, question_id long, category string, score1 double, score2 double")
    got = {r.category: r for r in BM.review_summary(df).collect()}
    assert got["conv"].mean1 == 3.5 and got["conv"].n_failed == 1 and got["conv"].ratio == 42.9
    assert got["all"].n == 3 and got["all"].score1_x10 == 43.3


# ---- calls -------------------------------------------------------------------------------

def second_time():
    """A client that fails on the first try of each prompt."""

    class Client:
        def __init__(self):
            self.seen = set()

        def generate(self, system, prompt, picture):
            if prompt not in self.seen:
                self.seen.add(prompt)
                raise OSError("not yet")
            return prompt.upper()

    return Client


def requests(spark, n=4):
    return spark.range(n).selectExpr("id as req_id", "'' as system", "concat('p', id) as prompt", "cast(null as string) as picture")


def test_retry_then_answer(spark):
    rows = INF.run_requests(requests(spark), second_time(), tries=2, wait_s=0).collect()
    assert {(r.text, r.tries, r.error) for r in rows} == {(f"P{i}", 2, None) for i in range(4)}


def test_failed_calls_leave_an_error(spark):
    rows = INF.run_requests(requests(spark), second_time(), tries=1, wait_s=0).collect()
    assert all(r.text is None and r.error == "OSError: not yet" and r.elapsed_s >= 0 for r in rows)


def test_cache_asks_only_new_keys(spark):
    req = requests(spark)
    cache = spark.createDataFrame([(1, "old", None), (99, "other", None)], "req_id long, text string, error string")
    answers, fresh = INF.with_cache(req, cache, INF.DummyClient, tries=1)
    assert {r.req_id: r.text for r in answers.collect()} == {0: "hello world", 1: "old", 2: "hello world", 3: "hello world"}
    assert sorted(r.req_id for r in fresh.collect()) == [0, 2, 3]


def test_chained_prompts_carry_answers(spark):
    q = spark.createDataFrame([(1, 0, "a b"), (1, 1, "c"), (2, 0, "x")], "conv_id long, i long, text string")
    last = INF.chain_turns(q, INF.DummyClient, history="last", tries=1).collect()
    assert {(r.conv_id, r.i): r.prompt for r in last} == {
        (1, 0): "a b", (1, 1): "USER \n a b \n ASSISTANT \n hello world \n USER \n c", (2, 0): "x"
    }
    full = {(r.conv_id, r.i): r.prompt for r in INF.chain_turns(q, INF.DummyClient, template="vicuna_v1", tries=1).collect()}
    system = PT.TEMPLATES["vicuna_v1"][0]
    assert full[1, 1] == f"{system} USER: a b ASSISTANT: hello world</s>USER: c ASSISTANT:"
    assert full[2, 0] == f"{system} USER: x ASSISTANT:"


def test_a_long_pair_is_dealt_over_many_tasks(spark):
    """A third of all tokens belong to one pair; its grid is joined under many keys."""
    tokens = spark.range(3000).selectExpr(
        "case when id < 1000 then 'long' else concat('p', id % 100) end as pair_id",
        "case when id < 1000 then id else id div 100 - 10 end as pos",
        "array(cast(id % 7 + 1 as double), cast(id % 5 as double), cast(id % 3 as double)) as vec",
    )
    other = tokens.withColumn("vec", F.transform("vec", lambda v: v * v + 1.0))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        grid = TM.token_grid(tokens, other, block=16, strip=2).filter("pair_id = 'long'")
        tasks = [r["count"] for r in grid.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(tasks) == 63 * 63 and len(tasks) >= 6 and max(tasks) < 0.4 * sum(tasks)
    key = lambda df: {(r.pair_id, r.side, r.pos): round(r.best, 12) for r in df.collect()}
    assert key(TM.best_partners(tokens, other, block=16)) == key(TM.best_partners(tokens, other, block=4096))


def test_stems_in_sql_agree():
    import duckdb

    from kerbline.functions.stemming import stem
    from kerbline.plans.stem_sql import stems

    listed = (
        "relational rationally conditional formalli valenci digitizer conformabli radically differently vileli analogousli vietnamization "
        "predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti archaeologi logi geologi triplicate "
        "formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant "
        "replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease "
        "controll roll sky skies dying news happy say by enjoy toy syzygy yyy flies dies tie ties hopping tanned falling hissing fizzed failing "
        "filing feed agreed plastered bled motoring sing conflated troubled sized caresses ponies caress cats nationally spied died a is oed eed ied "
        "fully nationalli hoping yes eye eyes owed bay boy's caf\u00e9s x1ed 12ing inning ee ll all"
    ).split()
    con = duckdb.connect()
    con.execute("CREATE TABLE v (word VARCHAR)")
    con.executemany("INSERT INTO v VALUES (?)", [(w,) for w in listed])
    for least, want in ((1, stem), (4, lambda w: stem(w) if len(w) > 3 else w)):
        got = dict(con.execute(f"WITH {stems('SELECT word FROM v', least)} SELECT word, stem FROM stems").fetchall())
        assert got == {w: want(w) for w in listed}


def test_meteor_synonyms_come_from_a_table(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, "the car stops", "the auto stops"), (2, "a b", "c d")], "pair_id int, truth string, pred string")
    table = spark.createDataFrame([("car", "vehicle"), ("auto", "vehicle"), ("auto", "z")], "word string, grp string")
    plain = {r.pair_id: r.value for r in TM.meteor(pairs).collect()}
    met = {r.pair_id: r.value for r in TM.meteor(pairs, table).collect()}
    assert met[1] > 0.9 > plain[1] and met[2] == plain[2] == 0.0
    monkeypatch.setattr(TM, "FEW_SYNONYMS", 1)
    assert {r.pair_id: r.value for r in TM.meteor(pairs, table).collect()} == met


def test_vectors_as_a_metric(spark):
    encode = lambda t: t.select("pair_id", "pos", F.array(F.length("token").cast("double"), F.lit(1.0)).alias("vec"))
    TM.register_metric("vector", TM.vector_metric(encode))
    try:
        pairs = spark.createDataFrame([("a", "one three", "two seven")], "pair_id string, truth string, pred string")
        (row,) = TM.score_pairs(pairs, ["vector"]).collect()
    finally:
        TM.METRICS.pop("vector")
    assert row.metric == "vector" and abs(row.value - 1.0) < 1e-12


def test_rouge_shuffles_texts_not_words(spark):
    """Rows of one pair count together, n-grams do not reach from one to the next."""
    rows = [("a", "x y x", "x x z"), ("a", "y", "y q"), ("b", "One, two!", "two one"), ("c", None, "x"), ("c", "x", "x"), ("d", "x", None), (None, "x", "x"), ("e", "", "")]
    pairs = spark.createDataFrame(rows, "pair_id string, truth string, pred string")
    got = {n: sorted((r.pair_id or "", r.hits, r.n_truth, r.n_pred) for r in TM.rouge_n(pairs, n, stemmed=False).collect()) for n in (1, 2)}
    assert got[1] == [("", 0, 0, 0), ("a", 3, 4, 5), ("a", 3, 4, 5), ("b", 2, 2, 2), ("c", 1, 1, 1), ("c", 1, 1, 1), ("d", 0, 0, 0), ("e", 0, 0, 0)]
    assert got[2] == [("", 0, 0, 0), ("a", 0, 2, 3), ("a", 0, 2, 3), ("b", 0, 1, 1), ("c", 0, 0, 0), ("c", 0, 0, 0), ("d", 0, 0, 0), ("e", 0, 0, 0)]
    plan = TM.rouge_n(pairs, 1, stemmed=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
