"""Language, mixing, top products, near duplicates and the pipeline."""

from __future__ import annotations

import math
import os
import random
import re

import numpy as np
import pytest

from kerbline.llm import lang_id, mixing, near_dups, shingles, topk


def test_language_on_the_held_out_fold(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "lang").join(lang_id.identify(docs), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_counts_match_brute_force():
    texts = ["das ist ein haus", "ÉTÉ, 12 l'eau!!", "  x "]
    two, three, starts, ends = lang_id.grams([t.lower() for t in texts])
    for k, t in enumerate(texts):
        plain = " " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " "
        assert ends[k] - starts[k] == len(plain) - 2
        alone = lang_id.grams([t.lower()])
        assert (two[starts[k] : ends[k]] == alone[0]).all() and (three[starts[k] : ends[k]] == alone[1]).all()


def test_language_edge_cases(spark):
    rows = [(1, "the house is on the hill", "en", "x"), (3, "la maison est sur la colline", "fr", "x"), (2, None, None, "x"), (4, "", "en", "x"), (5, "123 !!", "en", "x"), (None, "the house", "en", "x"), (1, "the house is on the hill", "en", "x"), (9, "la maison", None, "x")]
    got = lang_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"en", "fr", "und"}
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (2, 4, 5))
    untaught = lang_id.identify(spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")).collect()
    assert untaught[0].lang_pred == "und"
    assert lang_id.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_knapsack_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(150):
        k = int(rng.integers(1, 30))
        lengths, counts = np.sort(rng.choice(np.arange(1, 400), k, False)), rng.integers(1, 20, k)
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 2))
        take = mixing.fit(lengths, counts, budget)
        words = int((take * lengths).sum())
        assert (take >= 0).all() and (take <= counts).all() and words <= budget
        if budget <= mixing.WINDOW * lengths.max():
            sums = {0}
            for size, n in zip(lengths.tolist(), counts.tolist()):
                sums = {x + size * j for x in sums for j in range(n + 1) if x + size * j <= budget}
            assert words == max(sums)


def brute_targets(sizes: dict) -> dict:
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += share * weight[s]
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 50, 51, 200]))), "hot" if i % 3 else rng.choice(["a", "b", None, "é", ""]), 7) for i in range(900)]
    rows += [(None, "a\x0bb\tc d", None, 7), (5, rows[5][1], rows[5][2], 7), (2000, None, "only", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.source_size, r.target, r.taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and len(got) == len(rows) and key(got[0])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, texts = brute_targets(sizes), {(r[0]): (size(r[1]), r[2]) for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        n, s = texts[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s]) and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken in (0, n, 2 * n)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert mixing.mix(df.limit(0)).count() == 0


def test_top_products_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).round(2).tolist()) for i in range(600)]
    rows += [(i, [1.0] * 8) for i in range(600, 900)]
    rows += [(2300, None), (2350, [1.0, None]), (2400, [float("nan")] * 8), (2450, [2.0, 3.0]), (None, [1.0] * 8), (2500, []), (50, rows[50][1]), (2550, [1e300] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(map(tuple, topk.top_products(df).collect()))
    whole = {(i, tuple(math.floor(256 * x) for x in e)) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for i, q in whole:
        if i % 50 == 0:
            scores = sorted((-max(min(sum(a * b for a, b in zip(q, c)), 2**63 - 1), -(2**63)), j) for j, c in whole if j != i)
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores[:5])]
    assert got == sorted(want)
    assert topk.top_products(df.limit(0)).count() == 0


def test_top_products_form_only_pairs_within_reach(spark, monkeypatch):
    """Short vectors cannot beat long ones: their buckets meet no block, and no loop joins tables."""
    monkeypatch.setattr(topk, "BUCKET", 32)
    monkeypatch.setattr(topk, "BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = [(i, (abs(rng.normal(size=6)) * (20 if i % 8 == 1 else 0.05 if i % 50 else 1)).tolist()) for i in range(800)]
    made = []
    monkeypatch.setattr(topk, "settle", lambda df, name, was=topk.settle: made.append((name, was(df, name))) or made[-1][1])
    out = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    pairs = dict(made)["top-pairs"].count()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and pairs < 0.5 * 2 * 25
    want = []
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    for i, q in whole:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in whole if j != i)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def brute_classes(texts: list[str]) -> list[int]:
    owner, h, counts = shingles.shingles(texts)
    df = np.bincount(shingles.df_bucket(h), minlength=1 << shingles.DF_BITS)
    codes = shingles.rarity(df, len(set(owner.tolist())))[shingles.df_bucket(h)]
    sets = [shingles.unpack_set(shingles.pack_set(h[owner == k], counts[owner == k], codes[owner == k])) for k in range(len(texts))]
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            linked = len(sets[i][0]) and len(sets[j][0]) and shingles.weighted_jaccard(sets[i], sets[j]) >= near_dups.SIMILARITY
            if texts[i] == texts[j] or linked:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_match_brute_force(spark):
    rng, texts = random.Random(5), []
    for _ in range(20):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 6, 30, 120]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            words = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = f"z{rng.random()}"
            texts += [" ".join(words)] * (1 + (rng.random() < 0.3))
    texts += ["", "", None, "!!", "!!", "  "]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, root int, a int").repartition(4)
    got = {r.doc_id: r for r in near_dups.near_duplicates(df).collect()}
    want = brute_classes([t or "" for t in texts])
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(got[i].class_size == want.count(want[i]) for i in range(len(texts)))


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_write_no_set_of_a_text_without_a_bucket(spark, monkeypatch):
    rng, written, plain = random.Random(6), {}, near_dups.settle
    texts = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(2000)) for _ in range(300)]
    texts += [texts[0] + " end", texts[1] + " end"]

    def settle(df, name):
        table = plain(df, name)
        written[name] = sum(os.path.getsize(f.removeprefix("file:")) for f in table.inputFiles())
        if name == "dup-sets":
            written["sets"] = table.count()
        return table

    monkeypatch.setattr(near_dups, "settle", settle)
    got = near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i for i in range(300)} | {300: 0, 301: 1}
    assert written.pop("sets") == 4 and sum(written.values()) < sum(map(len, texts)) / 4


def test_marks_hold_the_digests_given(spark):
    keys = [bytes([0, 0, 0, 9]), bytes([0, 0, 1, 1]), bytes([0, 128, 0, 1]), bytes([255, 255, 255, 2]), bytes([255, 255, 255, 3])]
    bits = np.unpackbits(near_dups.marks(spark.createDataFrame([(k,) for k in keys], "text_key binary")), bitorder="little")
    assert len(bits) == 1 << 24 and np.flatnonzero(bits).tolist() == sorted({int.from_bytes(k[:3], "big") for k in keys})


def test_samples_estimate_weighted_jaccard():
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(2000)]
    texts = []
    for edits in (0, 10, 40, 100):
        words = base[:]
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"z{rng.random()}"
        texts.append(" ".join(words))
    owner, h, counts = shingles.shingles(texts)
    codes = np.full(len(h), 100, np.uint8)
    samples = shingles.consistent_samples(owner, h, shingles.weights(counts, codes), len(texts))
    sets = [shingles.unpack_set(shingles.pack_set(h[owner == k], counts[owner == k], codes[owner == k])) for k in range(len(texts))]
    for k in range(len(texts)):
        assert abs(float((samples[0] == samples[k]).mean()) - shingles.weighted_jaccard(sets[0], sets[k])) < 0.2


def test_bands_find_close_pairs():
    """At least 0.9 of the pairs from 0.8 up share a band."""
    rng, found, close = random.Random(8), 0, 0
    for _ in range(60):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
        words = base[:]
        for _ in range(rng.randint(1, 8)):
            words[rng.randrange(len(words))] = f"z{rng.random()}"
        owner, h, counts = shingles.shingles([" ".join(base), " ".join(words)])
        w = shingles.weights(counts, np.full(len(h), 128.0))
        bands = shingles.band_keys(shingles.consistent_samples(owner, h, w, 2))
        a, b = ((h[owner == k].astype(np.int64), w[owner == k]) for k in (0, 1))
        if shingles.weighted_jaccard(a, b) >= 0.8:
            close, found = close + 1, found + bool((bands[0] == bands[1]).any())
    assert close > 20 and found >= 0.9 * close


@pytest.mark.parametrize("chain", [2, 9, 40])
def test_components_of_chains_and_stars(spark, chain):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(1, chain)] + [(b"\xf0", bytes([200 + i])) for i in range(20)]
    roots = {bytes(r.node): bytes(r.root) for r in near_dups.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert all(roots[bytes([i])] == bytes([1]) for i in range(1, chain + 1)) and len(set(roots.values())) == 2
