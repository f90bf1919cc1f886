"""Token counts and byte-pair ids against the libraries."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from kerbline.llm import bpe, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "▁", "漢", "0", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "\t", " a", "😀", "   ", " ", "​", "ﬁ", "①", "'s", "***", "²", "----"]


def odd_texts(n: int) -> list[str | None]:
    rng = random.Random(1)
    texts: list[str | None] = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 150))) for _ in range(n)]
    return texts + [None, "", " ", "  ", "▁", "a" * 3000, " " * 500, "ab" * 2000, "=" * 1001, texts[3]]


@pytest.mark.parametrize("step", [token_counts.TEXT_STEP, 50])
def test_counts_match_the_library(spark, monkeypatch, step):
    monkeypatch.setattr(token_counts, "TEXT_STEP", step)
    monkeypatch.setattr(token_counts, "BLOCK", 3000)
    sp, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), odd_texts(600)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0)], "doc_id long, text string, n_tokens int")
    rows = token_counts.token_counts(df, PIECES, limit=100).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = texts[r.doc_id] or ""
        n = len(sp.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 100)


def test_counts_of_an_empty_table(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


def test_packed_blocks_round_trip():
    words, owners = ["b", "a", "a", "c", "a"], np.array([0, 0, 0, 2, 2])
    data, vocab = token_counts.pack_block(3, words, owners)
    n, owner, code, freq = token_counts.unpack_block(data)
    assert n == 3
    assert sorted((int(o), vocab[c], int(f)) for o, c, f in zip(owner, code, freq)) == [(0, "a", 2), (0, "b", 1), (2, "a", 1), (2, "c", 1)]


def library():
    ranks = bpe.coder(RANKS, public_tokenizers.PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("limits", [(bpe.SLICE, bpe.KEEP, bpe.TEXT_STEP), (2000, 50, 7)])
def test_ids_match_the_library(spark, monkeypatch, limits):
    for name, value in zip(("SLICE", "KEEP", "TEXT_STEP"), limits):
        monkeypatch.setattr(bpe, name, value)
    enc, texts = library(), odd_texts(600)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = bpe.bpe_round_trip(df, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_appends_and_edits_equal_a_fresh_encoding():
    c, enc, rng = bpe.coder(RANKS, public_tokenizers.PATTERN), library(), random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("abcdeinghrt on'") for _ in range(25)).encode()
        table = bpe.PrefixTable(c)
        for k in range(0, len(word), 4):
            table.append(word[k : k + 4])
        assert table.ids() == [i for i in enc._encode_single_piece(word)] or len(table.ids()) == 1 or word in c.ranks
        at = rng.randrange(len(word))
        edited = word[:at] + b"z" + word[at + 1 :]
        table.replace(edited)
        fresh = bpe.PrefixTable(c)
        fresh.append(edited)
        assert table.last == fresh.last and table.ids() == fresh.ids()
