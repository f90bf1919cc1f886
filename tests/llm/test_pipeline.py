"""The registered queries and every stage of the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import struct
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import canonical
from kerbline.llm import near_dups
from kerbline.llm.queries import ORACLES, QUERIES
from kerbline.session import settle
from test_sets import brute_classes, brute_targets
from test_text_scans import brute_personal
from test_tokens import library

ROWS = [
    (1, "the house is on the hill and the river is below it", "en", "a", 50, "x"),
    (1, "the house is on the hill and the river is below it", "en", "a", 50, "x"),
    (2, "The house is on the hill, and the river is below it!", "en", "b", 51, "x"),
    (None, "write to a@b.cc about the garden and the old wall behind it", "en", None, 59, "x"),
    (4, None, None, "a", None, "x"),
    (5, "", "fr", "a", 0, "x"),
    (6, "123 456 !!", "en", "b", 10, "x"),
    (7, "la maison est sur la colline et le jardin est derrière le mur", "fr", "b", 61, "x"),
    (8, "one two three four " * 3000, None, "c", 57000, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long, row string")


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_on_the_smallest_tables(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).fetchdf()
        assert canonical(got) == canonical(want)
    else:
        table = "pages" if name.startswith("op2") else "documents"
        assert len(got) == duck.execute(f"select count(*) from {table}").fetchone()[0]


def test_language_stage_keeps_texts_with_letters(spark, docs, sf):
    out = corpus_pipeline.language(spark, docs, sf)
    assert out.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(r.text for r in out.collect()) == sorted(r[1] for r in ROWS if r[1] and any(map(str.isalpha, r[1])))


def test_language_stage_keeps_texts_where_nothing_is_learned(spark, docs, sf):
    out = corpus_pipeline.language(spark, docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars"), sf)
    assert sorted(r.text for r in out.collect()) == sorted(r[1] for r in ROWS if r[1] and any(map(str.isalpha, r[1])))


def test_duplicate_stage_keeps_one_of_each_class(spark, docs, sf):
    out = corpus_pipeline.distinct_texts(spark, docs, sf).collect()
    texts = [r.text or "" for r in out]
    assert sum(t.lower().startswith("the house") for t in texts) == 1 and len(out) == len(ROWS) - 3
    ids = near_dups.near_duplicates(docs).filter("doc_id is not null").select("class_id").distinct().count()
    assert ids == len({r.doc_id for r in out} - {None})


def test_personal_stage_replaces_spans(spark, docs, sf):
    out = corpus_pipeline.without_personal_data(spark, docs, sf).collect()
    assert len(out) == len(ROWS) and sum("[EMAIL]" in (r.text or "") for r in out) == 1
    for r in out:
        assert r.text is None or (not brute_personal(r.text) and r.n_chars == len(r.text))


def test_mixing_stage_repeats_and_drops(spark, docs, sf):
    out = corpus_pipeline.mixed(spark, docs, sf)
    texts = [r.text for r in out.collect()]
    assert out.columns == list(corpus_pipeline.COLUMNS) and all(texts.count(t) <= 2 * sum(r[1] == t for r in ROWS) for t in texts)
    assert "" not in texts and None not in texts


def test_stages_on_an_empty_table(spark, docs, sf):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


PROSE = {
    "en": "the river of and was seen by all people in this town that day when rain came down from hills then went for rest year".split(),
    "fr": "la maison sur cette colline avec le jardin derrière les murs dans une rue que nous avons vue pendant toute année".split(),
}


def corpus() -> list[tuple]:
    """Groups of copies and near copies, three sources, nulls, mail addresses, repeated rows."""
    rng, rows = random.Random(8), []
    for i in range(60):
        lang = "fr" if i % 4 == 0 else "en"
        words = [rng.choice(PROSE[lang]) + (str(rng.randrange(9000)) if rng.random() < 0.5 else "").translate(DIGITS) for _ in range(rng.randint(20, 90))]
        text = " ".join(words) + (f" write to user{i}@mail.example.org now" if i % 7 == 0 else "")
        source = ("hot", "hot", "b", None)[i % 4]
        known = None if i % 9 == 5 else lang
        rows.append((i, text, known, source, len(text), "x"))
        for k in range(i % 3):  # near copies: one word of many differs
            near = words[:]
            near[rng.randrange(len(near))] = f"zz{'abc'[k]}"
            rows.append((100 + 3 * i + k, " ".join(near) + text[len(" ".join(words)) :], known, "b", None, "y"))
    rows += [rows[3], rows[3], (None, rows[8][1], "en", "b", 7, "z"), (900, None, "en", "hot", 0, "z"), (901, "", None, None, None, "z"), (902, "12 34!", "fr", "b", 6, "z")]
    return rows


DIGITS = str.maketrans("0123456789", "abcdefghij")


def as_rows(df) -> list[tuple]:
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def test_run_matches_a_plain_version(spark, tmp_path):
    """Every stage against plain Python on what the stage before kept, and ``run`` against the last."""
    rows = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept: dict[str, list[tuple]] = {}
    for name in list(stages)[:-1]:
        docs = settle(stages[name](spark, docs, folder), f"test-{name}")
        kept[name] = as_rows(docs)

    lettered = [r[:5] for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    language = lambda t: "fr" if sum(w in PROSE["fr"] for w in t.split()) > sum(w in PROSE["en"] for w in t.split()) else "en"
    want = [(i, t, lang or language(t), s, n) for i, t, lang, s, n in lettered]
    assert sorted(kept["language"], key=str) == sorted(want, key=str)

    texts = [r[1] for r in kept["language"]]
    classes = brute_classes(texts)
    class_of = dict(zip(texts, classes))
    assert len(kept["near_duplicates"]) == len(set(classes)) < len(texts) and set(kept["near_duplicates"]) <= set(kept["language"])
    assert sorted(class_of[r[1]] for r in kept["near_duplicates"]) == sorted(set(classes))

    mail = lambda t: re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[EMAIL]", t)
    clean = [(i, mail(t), lang, s, len(mail(t))) for i, t, lang, s, _ in kept["near_duplicates"]]
    assert sorted(kept["personal_data"], key=str) == sorted(clean, key=str) and any("[EMAIL]" in r[1] for r in clean)

    size = lambda t: len(t.split())
    sizes: dict = {}
    for r in clean:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    taken = Counter(kept["mixing"])
    assert set(taken) <= set(clean) and max(taken.values()) <= 2
    longest = {s: max(size(r[1]) for r in clean if r[3] == s) for s in sizes}
    for s, target in brute_targets(sizes).items():
        words = sum(n * size(r[1]) for r, n in taken.items() if r[3] == s)
        assert abs(words - target) <= longest[s], (s, words, target)

    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    encoding = library()
    plain: Counter = Counter()
    for i, t, *_ in kept["mixing"]:
        ids = encoding.encode_ordinary(t)
        plain[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == plain


def test_registered_operators_are_whole(spark):
    names = entry.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "byte_pairs"]
