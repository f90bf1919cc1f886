"""Token ids and label masks for training rows.

A tokenizer turns an array of texts into an array of id arrays, as a column. The default one
is a word tokenizer made of built-in functions; ``ArrowTokenizer`` wraps any Python encoder.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prompt_texts as P
from ..functions import text as X

# Label of ignored positions, id of an image place.
IGNORE = -100
IMAGE_ID = -200


@dataclass(frozen=True)
class WordTokenizer:
    """Words and special marks to md5-based ids; begins every text with ``bos_id``."""

    bos_id: int | None = 1
    pad_id: int = 0
    model_max_length: int = 2048
    legacy: bool = True
    specials: tuple[str, ...] = ("</s>", "<s>", "<|im_start|>", "<|im_end|>", "###")

    def ids(self, text: Column) -> Column:
        marked = F.regexp_replace(text, "(" + "|".join(re.escape(s) for s in self.specials) + ")", " $1 ")
        word_ids = F.transform(
            X.words(marked), lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int") + 10)
        )
        return word_ids if self.bos_id is None else F.concat(F.array(F.lit(self.bos_id)), word_ids)

    def encode(self, texts: Column) -> Column:
        return F.transform(texts, self.ids)


@dataclass(frozen=True)
class ArrowTokenizer:
    """Any encoder: ``factory()`` is called once per Python worker and returns ``text -> ids``."""

    factory: Callable[[], Callable[[str], list[int]]]
    bos_id: int | None = 1
    pad_id: int = 0
    model_max_length: int = 2048
    legacy: bool = True

    def encode(self, texts: Column) -> Column:
        factory, cache = self.factory, {}

        @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
        def run(batch: pd.Series) -> pd.Series:
            if "encode" not in cache:
                cache["encode"] = factory()
            return batch.map(lambda parts: [list(cache["encode"](p)) for p in parts])

        return run(texts)


def _without_bos(chunks: Column, tok) -> Column:
    """Chunk ids with the leading BOS cut off, when the first chunk starts with one."""
    if tok.bos_id is None:
        return chunks
    bos = (F.size(chunks[0]) > 0) & (F.get(chunks[0], F.lit(0)) == tok.bos_id)
    return F.when(bos, F.transform(chunks, lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))))).otherwise(chunks)


def splice_chunks(chunks: Column, tok) -> Column:
    """Ids of the texts between image tokens → one id list with IMAGE_ID between them."""
    bare = _without_bos(chunks, tok)
    body = F.flatten(
        F.transform(bare, lambda c, i: F.when(i > 0, F.concat(F.array(F.lit(IMAGE_ID)), c)).otherwise(c))
    )
    if tok.bos_id is None:
        return body
    bos = (F.size(chunks[0]) > 0) & (F.get(chunks[0], F.lit(0)) == tok.bos_id)
    return F.when(bos, F.concat(F.array(F.lit(tok.bos_id)), body)).otherwise(body)


def image_token_ids(df: DataFrame, text: str, tok, out: str = "input_ids") -> DataFrame:
    """Tokenise around ``<image>`` and put IMAGE_ID in its place; one BOS at most."""
    return (
        df.withColumn("_ch", tok.encode(F.split(F.col(text), re.escape(X.IMAGE_TOKEN))))
        .withColumn(out, splice_chunks(F.col("_ch"), tok))
        .drop("_ch")
    )


def plain_ids(df: DataFrame, text: str, tok, out: str = "input_ids") -> DataFrame:
    """Tokenise and truncate; ``out_len`` counts ids that are not padding."""
    ids = F.slice(tok.encode(F.array(F.col(text)))[0], 1, tok.model_max_length)
    return df.withColumn(out, ids).withColumn(
        f"{out}_len", F.size(F.filter(F.col(out), lambda t: t != tok.pad_id)).cast("bigint")
    )


def _lengths(df: DataFrame, texts: str, tok, has_image: bool, out: str) -> DataFrame:
    """Token count of each text in an array column."""
    if not has_image:
        return df.withColumn(out, F.transform(tok.encode(F.col(texts)), lambda c: F.size(c)))
    # with image tokens: ids of all pieces, one BOS, one place per image
    split = F.transform(F.col(texts), lambda t: F.split(t, re.escape(X.IMAGE_TOKEN)))
    flat = df.withColumn("_sp", split).withColumn("_enc", tok.encode(F.flatten("_sp")))
    sizes = F.transform("_sp", lambda s: F.size(s))
    bos = 1 if tok.bos_id is not None else 0
    starts = F.transform(
        F.sequence(F.lit(0), F.size("_sp") - 1),
        lambda k: F.aggregate(F.slice(F.col("_sz"), F.lit(1), k), F.lit(0), lambda a, s: a + s),
    )
    return (
        flat.withColumn("_sz", sizes)
        .withColumn("_st", starts)
        .withColumn(
            out,
            F.zip_with(
                "_st",
                "_sz",
                lambda st, sz: F.aggregate(
                    F.slice(F.col("_enc"), st + 1, sz), F.lit(0), lambda a, c: a + F.size(c) - bos
                )
                + (sz - 1)
                + bos,
            ),
        )
        .drop("_sp", "_enc", "_sz", "_st")
    )


def _keep_to_labels(df: DataFrame, keep: Column, cur_len: Column, tok, check: bool = True) -> DataFrame:
    """Ids where ``keep`` is 1, IGNORE elsewhere and behind its end; all ignored on a mismatch."""
    n = F.size("input_ids")
    padded = F.slice(F.concat(keep, F.array_repeat(F.lit(0), n)), F.lit(1), n)
    masked = F.zip_with("input_ids", padded, lambda t, k: F.when(k == 1, t).otherwise(F.lit(IGNORE)))
    total = F.size(F.filter(F.col("input_ids"), lambda t: t != tok.pad_id))
    clash = (cur_len < tok.model_max_length) & (cur_len != total) if check else F.lit(False)
    return df.withColumn("mismatch", clash).withColumn(
        "labels", F.when(clash, F.array_repeat(F.lit(IGNORE), n)).otherwise(masked)
    )


def _masked_rounds(
    df: DataFrame, rounds: Column, sep: str, tok, has_image: bool, lead: int, trim: int,
    later_round: int = 0,
) -> DataFrame:
    """Labels for prompts cut into rounds; each round masks its part up to and with ``sep``.

    Rounds stop at the first empty one and at the first that does not split in two.
    """
    out = df.withColumn("_r", rounds).withColumn("_parts", F.transform("_r", lambda r: F.split(r, re.escape(sep))))
    good = F.transform(F.arrays_zip("_r", "_parts"), lambda z: (z["_r"] != "") & (F.size(z["_parts"]) == 2))
    stop = F.array_position(good, F.lit(False))
    n_ok = F.when(stop == 0, F.size("_r")).otherwise(stop - 1).cast("int")
    out = out.withColumn("_n", n_ok).withColumn("_r", F.slice("_r", F.lit(1), F.col("_n")))
    out = out.withColumn(
        "_inst", F.transform(F.slice("_parts", F.lit(1), F.col("_n")), lambda p: F.concat(p[0], F.lit(sep)))
    )
    out = _lengths(out, "_r", tok, has_image, "_rl")
    out = _lengths(out, "_inst", tok, has_image, "_il")
    extra = lambda i: F.when(i > 0, F.lit(later_round)).otherwise(F.lit(0))
    out = out.withColumn("_rl", F.transform("_rl", lambda v, i: v + extra(i))).withColumn(
        "_il", F.transform("_il", lambda v, i: F.greatest(v - trim + extra(i), F.lit(0)))
    )
    spans = F.flatten(
        F.zip_with(
            "_rl",
            "_il",
            lambda r, i: F.concat(
                F.array_repeat(F.lit(0), F.least(i, r)), F.array_repeat(F.lit(1), F.greatest(r - i, F.lit(0)))
            ),
        )
    )
    keep = F.concat(F.array_repeat(F.lit(0), lead), spans)
    cur = F.aggregate("_rl", F.lit(lead), lambda a, v: a + v)
    return _keep_to_labels(out, keep, cur, tok).drop("_r", "_parts", "_n", "_inst", "_rl", "_il")


def _prompt_ids(prompts: DataFrame, tok, has_image: bool) -> DataFrame:
    if has_image:
        return image_token_ids(prompts, "prompt", tok)
    return plain_ids(prompts, "prompt", tok).drop("input_ids_len")


def label_two_separators(prompts: DataFrame, tok, template: str = "vision_v1", has_image: bool = False) -> DataFrame:
    """``prompts(conv_id, prompt)`` in the TWO style: only assistant answers keep labels."""
    _, _, role1, _, sep, sep2, _, _ = P.TEMPLATES[template]
    ids = _prompt_ids(prompts, tok, has_image)
    later = 0 if tok.legacy else -1
    return _masked_rounds(
        ids, F.split("prompt", re.escape(sep2)), sep + role1 + ": ", tok, has_image, lead=1, trim=2, later_round=later
    )


def label_bracketed(prompts: DataFrame, tok, template: str = "vision_llama_2", has_image: bool = False) -> DataFrame:
    """The LLAMA_2 style: everything up to ``[/INST]`` is ignored."""
    sep2 = P.TEMPLATES[template][5]
    ids = _prompt_ids(prompts, tok, has_image)
    return _masked_rounds(ids, F.split("prompt", re.escape(sep2)), "[/INST] ", tok, has_image, lead=1, trim=2)


def label_turn_marks(prompts: DataFrame, tok, template: str = "mpt", has_image: bool = False) -> DataFrame:
    """The MPT style: system + human + gpt is the first round, then pairs."""
    _, _, role1, _, sep, _, _, _ = P.TEMPLATES[template]
    ids = _prompt_ids(prompts, tok, has_image).withColumn("_cut", F.split("prompt", re.escape(sep)))
    pairs = F.when(
        F.size("_cut") > 3,
        F.transform(
            F.sequence(F.lit(4), F.size("_cut"), F.lit(2)),
            lambda k: F.array_join(F.slice(F.col("_cut"), k, F.lit(2)), sep),
        ),
    ).otherwise(F.array().cast("array<string>"))
    rounds = F.concat(F.array(F.array_join(F.slice("_cut", 1, 3), sep)), pairs)
    return _masked_rounds(
        ids, rounds, sep + role1, tok, has_image, lead=0, trim=1, later_round=1 if tok.legacy else 0
    ).drop("_cut")


def label_plain(pairs: DataFrame, tok, template: str = "plain") -> tuple[DataFrame, DataFrame]:
    """``pairs(conv_id, texts)``: exactly two turns, the first with an image; ``(rows, rejects)``."""
    sep = P.TEMPLATES[template][4]
    fits = (F.size("texts") == 2) & F.contains(F.col("texts")[0], F.lit(X.IMAGE_TOKEN))
    rows = pairs.filter(fits).withColumn(
        "prompt", F.concat(F.lit(X.IMAGE_TOKEN), F.col("texts")[1], F.lit(sep))
    )
    rows = image_token_ids(rows, "prompt", tok)
    masked = 1 + (1 if tok.bos_id is not None else 0)
    n = F.size("input_ids")
    labels = F.slice(
        F.concat(F.array_repeat(F.lit(IGNORE), masked), F.slice("input_ids", F.lit(masked + 1), F.greatest(n - masked, F.lit(0)))),
        F.lit(1),
        n,
    )
    return rows.withColumn("labels", labels).drop("texts"), pairs.filter(~fits).select("conv_id")


def label_signalled(signalled: DataFrame, tok, has_image: bool = False) -> DataFrame:
    """Default style: the header and human spans are ignored, two ids of each span stay.

    ``signalled(conv_id, header, pieces, roles, prompt)``.
    """
    out = _prompt_ids(signalled, tok, has_image).withColumn("_all", F.concat(F.array("header"), F.col("pieces")))
    out = _lengths(out, "_all", tok, has_image, "_len")
    spans = F.flatten(
        F.zip_with(
            F.slice("_len", F.lit(2), F.greatest(F.size("_len") - 1, F.lit(0))),
            "roles",
            lambda n, role: F.when(
                role == "human",
                F.concat(F.array_repeat(F.lit(1), F.least(n, F.lit(2))), F.array_repeat(F.lit(0), F.greatest(n - 2, F.lit(0)))),
            ).otherwise(F.array_repeat(F.lit(1), n)),
        )
    )
    # behind the last span the ids keep their labels
    keep = F.concat(F.array_repeat(F.lit(0), F.col("_len")[0]), spans, F.array_repeat(F.lit(1), F.size("input_ids")))
    return _keep_to_labels(out, keep, F.lit(0), tok, check=False).drop("_all", "_len", "mismatch")


def label_by_style(prompts: DataFrame, tok, template: str, has_image: bool = False) -> DataFrame:
    """Label mask by the template's style and version; ``prompts`` as that style needs them."""
    _, _, _, style, _, _, version, _ = P.TEMPLATES[template]
    if style == "PLAIN":
        return label_plain(prompts, tok, template)[0]
    if style == "LLAMA_2":
        return label_bracketed(prompts, tok, template, has_image)
    if version.startswith("v1"):
        return label_two_separators(prompts, tok, template, has_image)
    if version == "mpt":
        return label_turn_marks(prompts, tok, template, has_image)
    return label_signalled(prompts, tok, has_image)


def splice_image_places(
    rows: DataFrame,
    n_tokens: Column,
    max_length: int | None = None,
    batch: str | None = None,
    padding_side: str = "right",
) -> DataFrame:
    """Replace each IMAGE_ID by ``n_tokens`` places; labels there are ignored.

    Truncates to ``max_length``; with a ``batch`` column pads to the longest row of the batch
    and adds ``attention_mask`` and ``position_ids``.
    """
    places = lambda v: F.array_repeat(F.lit(v), n_tokens.cast("int"))
    ids = F.flatten(
        F.transform("input_ids", lambda t: F.when(t == IMAGE_ID, places(IMAGE_ID)).otherwise(F.array(t)))
    )
    labels = F.flatten(
        F.zip_with(
            "input_ids", "labels", lambda t, lab: F.when(t == IMAGE_ID, places(IGNORE)).otherwise(F.array(lab))
        )
    )
    out = rows.withColumn("labels", labels).withColumn("input_ids", ids)
    if max_length is not None:
        out = out.withColumn("input_ids", F.slice("input_ids", 1, max_length)).withColumn(
            "labels", F.slice("labels", 1, max_length)
        )
    if batch is None:
        return out
    return pad_batches(out, batch, padding_side=padding_side)


def pad_batches(
    rows: DataFrame,
    batch: str,
    pad_id: int = 0,
    max_length: int | None = None,
    padding_side: str = "right",
) -> DataFrame:
    """Pad ids and labels to the longest row of the batch; ``attention_mask`` marks real ids.

    The longest row comes from a grouped maximum joined back, not from a window per batch.
    """
    out = rows
    if max_length is not None:
        out = out.withColumn("input_ids", F.slice("input_ids", 1, max_length)).withColumn(
            "labels", F.slice("labels", 1, max_length)
        )
    longest = out.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_max"))
    n = F.size("input_ids")
    gap = F.col("_max") - n
    left = padding_side == "left"

    def padded(values: Column, filler: Column) -> Column:
        fill = F.array_repeat(filler, gap)
        return F.concat(fill, values) if left else F.concat(values, fill)

    real = F.transform("input_ids", lambda t: F.lit(True) if pad_id is None else t != pad_id)
    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return (
        out.join(longest, batch)
        .withColumn("_mask", padded(real, F.lit(False)))
        .withColumn("position_ids", padded(positions, F.lit(0)))
        .withColumn("labels", padded(F.col("labels"), F.lit(IGNORE)))
        .withColumn("input_ids", padded(F.col("input_ids"), F.lit(pad_id)))
        .withColumnRenamed("_mask", "attention_mask")
        .drop("_max")
    )
