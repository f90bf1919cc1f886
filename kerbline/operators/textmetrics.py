"""Text metrics between a true and a predicted text.

``pairs(pair_id, truth, pred)`` → one value per pair. N-grams are counted inside the pair (BLEU joins
them); LCS and word alignment run per pair in Arrow batches; vector metrics run on blocks of tokens, so
no task emits all token pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stemming import stem
from ..functions.text import words
from ..session import settle

VECTOR_BLOCK = 256
STRIP = 8  # blocks of a side that meet as many of the other side in one grid cell


def rouge_tokens(text: Column, stemmed: bool) -> Column:
    """Lower-case runs of a-z and 0-9; with ``stemmed`` words longer than three letters are stemmed."""
    cleaned = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")
    tokens = F.filter(F.split(cleaned, " "), lambda t: t != "")
    return stem_words(tokens) if stemmed else tokens


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_words(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}  # per Arrow batch

    def short(w: str) -> str:
        if len(w) <= 3:
            return w
        if w not in known:
            known[w] = stem(w)
        return known[w]

    return tokens.map(lambda ws: [short(w) for w in ws])


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams as texts; empty for shorter lists. ``tokens`` is a column, not a formula."""
    if n == 1:
        return tokens

    def gram(first: Column, i: Column) -> Column:
        rest = [part for k in range(1, n) for part in (F.lit(" "), F.get(tokens, i + k))]
        return F.concat(first, *rest)

    return F.transform(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0))), gram)


def f_measure(hits: Column, n_pred: Column, n_truth: Column) -> Column:
    p, r = F.try_divide(hits, n_pred), F.try_divide(hits, n_truth)
    return F.when((hits > 0), 2 * p * r / (p + r)).otherwise(F.lit(0.0))


@F.pandas_udf(T.LongType())
def clipped_hits(truth: pd.Series, pred: pd.Series) -> pd.Series:
    """What two lists share, repeats counted."""
    return pd.Series([sum((Counter(t) & Counter(p)).values()) for t, p in zip(truth, pred)], dtype="int64")


def rouge_n(pairs: DataFrame, n: int, stemmed: bool = True) -> DataFrame:
    """``(pair_id, hits, n_truth, n_pred, value)`` with clipped n-gram counts.

    Rows of one ``pair_id`` count together; only the texts of repeated ones are shuffled, no n-grams.
    ``pairs`` is read for its ids first.
    """
    ids = pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and pair_id is not null")
    repeated = settle(ids.select("pair_id"), "repeated")
    cleaned = pairs.select(
        "pair_id",
        *[F.array_join(rouge_tokens(F.col(c), stemmed), " ").alias(a) for c, a in (("truth", "t"), ("pred", "p"))],
    ).filter("t is not null and p is not null")
    texts = cleaned.select("pair_id", F.array("t").alias("t"), F.array("p").alias("p"))
    if not repeated.isEmpty():
        many = cleaned.join(repeated, "pair_id", "left_semi").groupBy("pair_id").agg(F.collect_list("t").alias("t"), F.collect_list("p").alias("p"))
        texts = texts.join(repeated, "pair_id", "left_anti").unionByName(many)
    tokens = lambda c: F.transform(c, lambda s: F.filter(F.split(s, " "), lambda w: w != "")).alias(c)
    grams = lambda c: F.flatten(F.transform(c, lambda ws: ngrams(ws, n))).alias(c)
    lists = texts.select("pair_id", tokens("t"), tokens("p")).select("pair_id", grams("t"), grams("p"))
    sums = lists.select(
        "pair_id", clipped_hits("t", "p").alias("hits"), F.size("t").cast("bigint").alias("n_truth"), F.size("p").cast("bigint").alias("n_pred")
    )
    full = pairs.select("pair_id").join(sums, "pair_id", "left").na.fill(0, ["hits", "n_truth", "n_pred"])
    return full.withColumn("value", f_measure(F.col("hits"), F.col("n_pred"), F.col("n_truth")))


@F.pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence of two token lists, one bit per token of the first."""

    def one(x, y) -> int:
        places: dict[str, int] = {}
        for i, t in enumerate(x):
            places[t] = places.get(t, 0) | (1 << i)
        full = (1 << len(x)) - 1
        row = full
        for t in y:
            u = row & places.get(t, 0)
            row = ((row + u) | (row - u)) & full
        return len(x) - row.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def rouge_l(pairs: DataFrame, stemmed: bool = True) -> DataFrame:
    toks = pairs.select(
        "pair_id", rouge_tokens(F.col("truth"), stemmed).alias("t"), rouge_tokens(F.col("pred"), stemmed).alias("p")
    )
    return toks.select(
        "pair_id",
        lcs_length("t", "p").alias("hits"),
        F.size("t").cast("bigint").alias("n_truth"),
        F.size("p").cast("bigint").alias("n_pred"),
    ).withColumn("value", f_measure(F.col("hits"), F.col("n_pred"), F.col("n_truth")))


def _align(pred: list[str], truth: list[str], groups: list[Callable[[str], str]]) -> list[tuple[int, int]]:
    """Matched positions, stage by stage; each stage runs from the end and takes the last free partner."""
    left_p, left_t, matched = list(range(len(pred))), list(range(len(truth))), []
    for key in groups:
        free: dict[str, list[int]] = {}
        for j in left_t:
            free.setdefault(key(truth[j]), []).append(j)
        used_p, used_t = set(), set()
        for i in reversed(left_p):
            stack = free.get(key(pred[i]))
            if stack:
                j = stack.pop()
                matched.append((i, j))
                used_p.add(i)
                used_t.add(j)
        left_p = [i for i in left_p if i not in used_p]
        left_t = [j for j in left_t if j not in used_t]
    return sorted(matched)


FEW_SYNONYMS = 100_000  # words of a synonym table from which on a word's pairs are salted


def _known_groups(pairs: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``(pair_id, groups)``: the synonym group of every word of a pair that has one, as a map.

    Words are made distinct per pair first. The table is written, so that the optimiser knows its
    size and broadcasts a small one. A larger one is copied per salt, so that a word that stands in
    every pair is dealt over many tasks.
    """
    table = settle(synonyms.groupBy("word").agg(F.min("grp").alias("grp")), "synonyms")
    each = pairs.select("pair_id", F.explode(F.array_distinct(F.concat("t", "p"))).alias("word"))
    if table.count() <= FEW_SYNONYMS:
        met = each.join(table, "word")
    else:
        salts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = each.withColumn("_salt", F.pmod(F.xxhash64("pair_id"), F.lit(salts)).cast("int")).join(copies, ["word", "_salt"])
    return met.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "grp"))).alias("groups"))


def meteor(
    pairs: DataFrame,
    synonyms: DataFrame | None = None,
    alpha: float = 0.9,
    beta: float = 3.0,
    gamma: float = 0.5,
) -> DataFrame:
    """Exact, stem and synonym matches with a chunk penalty.

    ``synonyms(word, grp)`` names the group of a lower-case word (the first group in order if there
    are several); words without one are their own group. Without the table that stage finds nothing.
    """

    @F.pandas_udf(T.DoubleType())
    def score(truth: pd.Series, pred: pd.Series, groups: pd.Series) -> pd.Series:
        known: dict[str, str] = {}  # per Arrow batch

        def stemmed(w: str) -> str:
            if w not in known:
                known[w] = stem(w)
            return known[w]

        def one(t, p, g) -> float:
            stages: list[Callable[[str], str]] = [lambda w: w, stemmed]
            if g is not None:
                g = dict(g)
                stages.append(lambda w: g.get(w, w))
            hits = _align(list(p), list(t), stages)
            if not hits:
                return 0.0
            chunks = 1 + sum(
                1 for (a, b), (c, d) in zip(hits, hits[1:]) if not (c == a + 1 and d == b + 1)
            )
            precision, recall = len(hits) / len(p), len(hits) / len(t)
            mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
            return (1 - gamma * (chunks / len(hits)) ** beta) * mean

        return pd.Series([one(t, p, g) for t, p, g in zip(truth, pred, groups)], dtype=float)

    lower = lambda c: F.transform(words(c), F.lower)
    toks = pairs.select("pair_id", lower("truth").alias("t"), lower("pred").alias("p"))
    if synonyms is None:
        toks = toks.withColumn("groups", F.lit(None).cast("map<string,string>"))
    else:
        toks = toks.join(_known_groups(toks, synonyms), "pair_id", "left")
    return toks.select("pair_id", score("t", "p", "groups").alias("value"))


# ---- token vectors -------------------------------------------------------------------

def _blocks(tokens: DataFrame, side: str, block: int) -> DataFrame:
    return (
        tokens.withColumn(f"{side}_block", F.floor(F.col("pos") / block))
        .groupBy("pair_id", f"{side}_block")
        .agg(F.collect_list(F.struct("pos", "vec")).alias(side))  # at most ``block`` tokens
    )


def best_partners(truth: DataFrame, pred: DataFrame, block: int = VECTOR_BLOCK) -> DataFrame:
    """Highest cosine of each token with any token of the other side: ``(pair_id, side, pos, best)``.

    Inputs are ``(pair_id, pos, vec ARRAY<DOUBLE>)``. A pair of blocks is one matrix product;
    it returns one maximum per token, and the maxima of all its blocks are combined.
    """
    id_type = truth.schema["pair_id"].dataType.simpleString()

    def products(rows):
        for pdf in rows:
            out = {"pair_id": [], "side": [], "pos": [], "best": []}
            for pair_id, t, p in zip(pdf["pair_id"], pdf["t"], pdf["p"]):
                a = np.array([r["vec"] for r in t], dtype=float)
                b = np.array([r["vec"] for r in p], dtype=float)
                na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
                cos = (a @ b.T) / (na[:, None] * nb[None, :])
                for side, cells, top in (("truth", t, cos.max(axis=1)), ("pred", p, cos.max(axis=0))):
                    out["pair_id"] += [pair_id] * len(cells)
                    out["side"] += [side] * len(cells)
                    out["pos"] += [int(r["pos"]) for r in cells]
                    out["best"] += top.tolist()
            yield pd.DataFrame(out)

    partial = token_grid(truth, pred, block).select("pair_id", "t", "p").mapInPandas(
        products, f"pair_id {id_type}, side string, pos bigint, best double"
    )
    return partial.groupBy("pair_id", "side", "pos").agg(F.max("best").alias("best"))


def token_grid(truth: DataFrame, pred: DataFrame, block: int = VECTOR_BLOCK, strip: int = STRIP) -> DataFrame:
    """Every block of truth tokens beside every block of predicted tokens of the same pair.

    The grid of a pair is cut into cells of ``strip`` x ``strip`` blocks, and the blocks are joined
    on (pair, row of cells, column of cells). So a long pair is dealt over as many tasks as it has
    cells, a block is sent once per cell it is part of, and a cell holds a bounded number of blocks.
    Strips are told how many strips the other side has under the key (pair, strip), which spreads a
    long pair as well.
    """
    t = _blocks(truth, "t", block).withColumn("t_strip", F.floor(F.col("t_block") / strip))
    p = _blocks(pred, "p", block).withColumn("p_strip", F.floor(F.col("p_block") / strip))
    last = lambda df, name: df.groupBy("pair_id").agg(F.floor(F.max("pos") / (block * strip)).alias(name))
    ends = last(truth, "last_t").join(last(pred, "last_p"), "pair_id")
    rows = ends.select("pair_id", "last_p", F.explode(F.sequence(F.lit(0).cast("bigint"), "last_t")).alias("t_strip"))
    cols = ends.select("pair_id", "last_t", F.explode(F.sequence(F.lit(0).cast("bigint"), "last_p")).alias("p_strip"))
    left = t.join(rows, ["pair_id", "t_strip"]).withColumn("p_strip", F.explode(F.sequence(F.lit(0).cast("bigint"), "last_p")))
    right = p.join(cols, ["pair_id", "p_strip"]).withColumn("t_strip", F.explode(F.sequence(F.lit(0).cast("bigint"), "last_t")))
    return left.drop("last_p").join(right.drop("last_t"), ["pair_id", "t_strip", "p_strip"])


def vector_score(truth: DataFrame, pred: DataFrame, block: int = VECTOR_BLOCK) -> DataFrame:
    """Precision, recall and F1 of greedy token matching over supplied vectors."""
    sides = best_partners(truth, pred, block).groupBy("pair_id").agg(
        F.avg(F.when(F.col("side") == "pred", F.col("best"))).alias("precision"),
        F.avg(F.when(F.col("side") == "truth", F.col("best"))).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return sides.withColumn("f1", F.try_divide(2 * p * r, p + r))


def noun_similarity(truth: DataFrame, pred: DataFrame, block: int = VECTOR_BLOCK) -> DataFrame:
    """Highest similarity of any noun pair, 0 at least; inputs add ``tag`` and ``is_stop``."""
    nouns = lambda df: df.filter((F.col("tag") == "NOUN") & ~F.col("is_stop")).select("pair_id", "pos", "vec")
    best = best_partners(nouns(truth), nouns(pred), block).groupBy("pair_id").agg(F.max("best").alias("best"))
    ids = truth.select("pair_id").union(pred.select("pair_id")).distinct()
    return ids.join(best, "pair_id", "left").select(
        "pair_id", F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)).alias("value")
    )


# ---- corpus BLEU ---------------------------------------------------------------------

def bleu(pred: DataFrame, truths: DataFrame, max_n: int = 4) -> DataFrame:
    """Corpus BLEU over ``pred(pair_id, text)`` and ``truths(pair_id, ref_no, text)``.

    Tokens are lower-case words without punctuation. Counts are clipped by the largest count in
    any reference; the reference length closest to the prediction counts, the shorter on a tie.
    """
    tokens = lambda c: F.filter(
        F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != ""
    )
    p = pred.select("pair_id", tokens(F.col("text")).alias("tok"))
    t = truths.select("pair_id", "ref_no", tokens(F.col("text")).alias("tok"))


    def sized(n: int) -> Column:
        return F.transform(ngrams(F.col("tok"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))

    grams = lambda df, by: df.select(
        *by,
        F.explode(
            F.concat(
                *[sized(n) for n in range(1, max_n + 1)]
            )
        ).alias("e"),
    ).groupBy(*by, F.col("e.n").alias("n"), F.col("e.g").alias("g")).agg(F.count(F.lit(1)).alias("c"))
    limit = grams(t, ["pair_id", "ref_no"]).groupBy("pair_id", "n", "g").agg(F.max("c").alias("cap"))
    hit = grams(p, ["pair_id"]).join(limit, ["pair_id", "n", "g"], "left")
    orders = hit.groupBy("n").agg(
        F.sum(F.least(F.col("c"), F.coalesce("cap", F.lit(0)))).alias("hits"), F.sum("c").alias("total")
    )
    length = p.select("pair_id", F.size("tok").alias("lp"))
    gap = F.abs(F.size("tok") - F.col("lp"))
    closest = (
        t.join(length, "pair_id")
        .groupBy("pair_id", "lp")
        .agg(F.min(F.struct(gap.alias("gap"), F.size("tok").alias("lr"))).alias("m"))
    )
    sizes = closest.agg(F.sum("lp").alias("len_pred"), F.sum("m.lr").alias("len_truth"))
    wide = orders.groupBy().agg(
        *[F.max(F.when(F.col("n") == n, F.col(c))).alias(f"{c}_{n}") for n in range(1, max_n + 1) for c in ("hits", "total")]
    )
    both = wide.select("*", *[sizes.select(c).scalar().alias(c) for c in ("len_pred", "len_truth")])
    log_mean = sum((F.log(F.col(f"hits_{n}") / F.col(f"total_{n}")) for n in range(1, max_n + 1)), F.lit(0.0)) / max_n
    brevity = F.when(F.col("len_pred") >= F.col("len_truth"), 0.0).otherwise(1 - F.col("len_truth") / F.col("len_pred"))
    no_hit = F.exists(F.array(*[F.coalesce(F.col(f"hits_{n}"), F.lit(0)) for n in range(1, max_n + 1)]), lambda h: h == 0)
    return both.withColumn("bleu", F.when(no_hit, 0.0).otherwise(F.exp(brevity + log_mean)))


METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "meteor": meteor,
    "rouge1": lambda pairs: rouge_n(pairs, 1).select("pair_id", "value"),
    "rouge2": lambda pairs: rouge_n(pairs, 2).select("pair_id", "value"),
    "rougeL": lambda pairs: rouge_l(pairs).select("pair_id", "value"),
}


def register_metric(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """A metric maps ``pairs(pair_id, truth, pred)`` to ``(pair_id, value)``."""
    METRICS[name] = fn


def vector_metric(encode: Callable[[DataFrame], DataFrame], block: int = VECTOR_BLOCK) -> Callable[[DataFrame], DataFrame]:
    """The F1 of ``vector_score`` as a metric. ``encode`` maps ``(pair_id, pos, token)`` to
    ``(pair_id, pos, vec)``; tokens are the words of a text."""

    def tokens(pairs: DataFrame, side: str) -> DataFrame:
        return pairs.select("pair_id", F.posexplode(words(side)).alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))

    def score(pairs: DataFrame) -> DataFrame:
        return vector_score(encode(tokens(pairs, "truth")), encode(tokens(pairs, "pred")), block).select("pair_id", F.col("f1").alias("value"))

    return score


def score_pairs(pairs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Long scores ``(pair_id, metric, value)``."""
    out = None
    for name in names or list(METRICS):
        part = METRICS[name](pairs).select("pair_id", F.lit(name).alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    return out
