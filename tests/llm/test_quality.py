"""The byte network: forward pass against plain loops, gradients, held-out accuracy, odd rows."""

from __future__ import annotations

import zlib

import numpy as np

from kerbline.llm import byte_net as B


def plain_logit(net, raw: bytes) -> float:
    n = max(1, -(-len(raw) // B.BLOCK))
    padded = list(raw) + [B.PAD] * (n * B.BLOCK - len(raw) + B.WIDTH - 1)
    out = [np.maximum(np.concatenate([net["embed"][c] for c in padded[i : i + B.WIDTH]]) @ net["filters"] + net["bias"], 0) for i in range(n * B.BLOCK)]
    spans = [(k * B.BLOCK, (k + 2) * B.BLOCK) for k in range(n - 1)] or [(0, B.BLOCK)]
    hidden = []
    for lo, hi in spans:
        full = sum(c != B.PAD for c in padded[lo:hi]) / (2 * B.BLOCK)
        x = np.append(np.max(out[lo:hi], axis=0), full)
        hidden.append(np.maximum(x @ net["dense"] + net["dense_bias"], 0))
    return float(np.max(hidden, axis=0) @ net["out"] + net["out_bias"][0])


def a_net(seed: int = 0):
    rng = np.random.default_rng(seed)
    net = B.fresh(rng)
    for k in ("bias", "dense_bias", "out_bias"):
        net[k] = rng.normal(size=net[k].shape).astype(np.float32) * 0.1
    return net


def test_forward_pass_matches_plain_loops():
    net, rng = a_net(), np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 7, 255, 256, 257, 512, 700, 1300)]
    want = [plain_logit(net, t) for t in texts]
    assert np.allclose(B.logits(net, texts), want, atol=1e-4)
    assert np.allclose([B.logits(net, [t])[0] for t in texts], want, atol=1e-4)


def test_a_long_text_goes_in_pieces(monkeypatch):
    net, raw = a_net(), bytes(np.random.default_rng(2).integers(0, 256, 5000, dtype=np.uint8))
    whole = B.logits(net, [raw])
    monkeypatch.setattr(B, "SLICE", 1024)
    assert np.allclose(B.logits(net, [raw]), whole, atol=1e-5)
    for n in (1023, 1024, 1025, 1031, 2048):
        assert np.allclose(B.logits(net, [raw[:n]]), B.logits(net, [raw[:n], b""])[0], atol=1e-5)


def test_every_byte_is_seen():
    net = a_net(3)
    base = bytearray(b"a" * 2000)
    marks = [bytes(base[:k]) + b"\xf0\x9f\x98\x80!?#%" + bytes(base[k:]) for k in (0, 500, 1000, 1996, 2000)]
    plain = B.features(net, bytes(base))[0].max(axis=0)
    assert all((B.features(net, m)[0].max(axis=0) != plain).any() for m in marks)


def test_gradients_match_differences():
    net = {k: v.astype(np.float64) for k, v in a_net(5).items()}
    rng = np.random.default_rng(6)
    b, n, fill = B.blocks([bytes(rng.integers(97, 123, k, dtype=np.uint8)) for k in (30, 300, 800)])
    y = np.array([0.0, 1.0, 0.0])

    def loss() -> float:
        top = np.concatenate([np.maximum((B.windows(net, b[k : k + 1]) @ net["filters"]).max(axis=0) + net["bias"], 0)[None] for k in range(len(b))])
        p = 1 / (1 + np.exp(-B.forward(net, top, fill, n)["logit"]))
        return -float(np.mean(np.where(y == 1, np.log(p), np.log(1 - p))))

    grads = B.gradients(net, b, n, fill, y)
    for name, g in grads.items():
        flat = net[name].reshape(-1)
        for at in np.argsort(-np.abs(g.reshape(-1)))[:4]:
            was, eps = flat[at], 1e-6
            flat[at] = was + eps
            up = loss()
            flat[at] = was - eps
            down = loss()
            flat[at] = was
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[at]) < 2e-3 * max(1e-2, abs(g.reshape(-1)[at])), name


def test_quality_of_the_held_out_fold(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # 399 labels; the smaller table has two bad held-out documents
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = B.score(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    pairs = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.95 and sum(s >= 0.3 for s in good) >= 0.97 * len(good)


def test_quality_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(B, "STEPS", 20)
    monkeypatch.setattr(B.fit, "__defaults__", (20,))
    kind = "doc_id long, text string, score double, held_out int, y int"
    docs = [(i, ("good words here " if i % 2 else "BAD!! ") * (i % 40), 0.0, 1, 1) for i in range(200)]
    docs += [(None, "x", 0.0, 1, 1), (300, None, 0.0, 1, 1), (301, "", 0.0, 1, 1), (302, "é" * 70000, 0.0, 1, 1), (7, docs[7][1], 0.0, 1, 1)]
    labels = [(i, i % 2, 1) for i in range(150)] + [(None, 1, 1), (9999, 0, 1), (302, 1, 1), (3, None, 1), (5, 0, 1), (5, 1, 0), (6, 4, 1)]
    ldf = spark.createDataFrame(labels, "doc_id long, quality int, score int")
    df = spark.createDataFrame(docs, kind).repartition(3)
    got = B.score(df, ldf).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.score, r.predicted, r.held_out))
    assert all(len(v) == 1 for v in by.values()) and by[300] and {s for s, _, _ in by[300]} == {s for s, _, _ in by[301]}
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    again = {r.doc_id: r.score for r in B.score(df.repartition(5), ldf).collect()}
    assert again == {r.doc_id: r.score for r in got}
    one = B.score(df, ldf.filter("quality = 1")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.9
    assert {r.score for r in B.score(df, ldf.limit(0)).collect()} == {0.5}
    assert B.score(df.limit(0), ldf).count() == 0


def test_sample_is_bounded_and_of_the_training_fold(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)] + [(1, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 > 0) for i in range(500)], "doc_id long, q boolean").selectExpr("doc_id", "int(q) as quality")
    rows = B.training_sample(docs, B.taught(labels), size=30).collect()
    assert len(rows) == 60 and sum(r.y for r in rows) == 30 and len({r.doc_id for r in rows}) == 60
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
