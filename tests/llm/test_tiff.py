"""TIFF codecs, files and the document query against brute force."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from kerbline.llm import tiff


@pytest.mark.parametrize("values", [2, 4, 256])
def test_codecs_round_trip(values):
    rng = np.random.default_rng(values)
    for n in (0, 1, 2, 127, 128, 129, 600, 5000):
        data = rng.integers(0, values, n, dtype=np.uint8).tobytes()
        for code in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE):
            assert tiff.unpack(tiff.pack(data, code), code, n) == data


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 16), (32, 48)])
@pytest.mark.parametrize("predictor", [1, 2])
def test_files_round_trip(order, tile, predictor):
    rng = np.random.default_rng(7)
    for code in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
        pages = [rng.integers(0, 255, (h, w, s), dtype=np.uint8) for h, w, s in ((1, 1, 1), (33, 70, 3), (50, 20, 1))]
        data = tiff.write_tiff(pages, code, predictor, 7, tile, order, "note")
        read = [(tags, tiff.read_page(data, tags)) for _, tags in tiff.directories(data)]
        assert len(read) == 3 and all((a == b).all() for (_, a), b in zip(read, pages))
        assert read[0][0][tiff.DESCRIPTION] == (b"note\0",)


def test_pages_of_good_and_broken_files(spark):
    good = tiff.write_tiff([np.zeros((4, 5), np.uint8), np.ones((2, 3), np.uint8)])
    loop = bytearray(good)
    rows = [(1, good), (2, None), (3, b"II*\0"), (4, b"nonsense"), (5, good[:60]), (1, good), (6, bytes(loop))]
    out = tiff.tiff_pages(spark.createDataFrame(rows, "id long, media binary")).collect()
    by = {k: [r for r in out if r.id == k] for k in range(1, 7)}
    assert [(r.page, r.pages, r.width, r.height) for r in by[1]] == [(0, 2, 5, 4), (1, 2, 3, 2)] * 2
    assert all(r.error for k in (2, 3, 4, 5) for r in by[k]) and by[6][0].error is None
    assert tiff.tiff_pages(spark.createDataFrame([], "id long, media binary")).count() == 0


def test_text_media_matches_brute_force(spark):
    texts = [None, "", "a", "é" * 288, "x" * 576, "y" * 577, "long " * 40000, "a"]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, media string, id int")
    rows = {r.doc_id: r for r in tiff.text_media(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
    same = [rows[i].asDict() | {"doc_id": 0} for i in (2, 7)]
    assert same[0] == same[1]


def test_long_text_takes_several_pages(spark, monkeypatch):
    monkeypatch.setattr(tiff, "PAGE_ROWS", 3)
    text = "".join(chr(97 + i % 26) for i in range(576 * 7 + 5))
    pages = tiff.tiff_pages(tiff.text_tiffs(spark.createDataFrame([(9, text)], "doc_id long, text string"))).collect()
    assert b"".join(bytes(p.data) for p in pages) == tiff.payload_of(text)[0]


def test_every_decoder_reads_a_share_of_the_texts(spark):
    texts = [f"text {i} " * (i % 90) for i in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen: dict = {}
    for r in tiff.text_tiffs(df).collect():
        order, tags = next(tiff.directories(bytes(r.media)))
        seen.setdefault("compression", []).append(tags[tiff.COMPRESSION][0])
        seen.setdefault("tiled", []).append(tiff.TILE_OFFSETS in tags)
        seen.setdefault("predictor", []).append(tags[tiff.PREDICTOR][0])
        seen.setdefault("order", []).append(order)
        seen.setdefault("tiled by code", []).append((tags[tiff.COMPRESSION][0], tiff.TILE_OFFSETS in tags))
    share = {k: {x: v.count(x) / len(v) for x in set(v)} for k, v in seen.items()}
    assert set(share["compression"]) == {tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE}
    assert min(share["compression"].values()) > 0.08 and share["tiled"][True] > 0.15
    assert min(share["predictor"].values()) > 0.4 and min(share["order"].values()) > 0.4 and len(share["tiled by code"]) == 10
    rows = {r.doc_id: r for r in tiff.text_media(df).collect()}
    assert all(rows[i].payload_sha256 == hashlib.sha256(tiff.payload_of(t)[0]).hexdigest() for i, t in enumerate(texts))
