"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded; filters over ``WIDTH`` bytes slide over the whole text. Their outputs are
max-pooled over chunks of two blocks that overlap by one block, so every place of the text lies in
a chunk; a small layer reads each chunk, its outputs are max-pooled over the chunks of the text
and combined into one probability.

The network is fitted in one task on a bounded sample of labelled documents (``SAMPLE`` of each
label, whole texts of at most ``LONGEST`` bytes). The share of label 1 that the score is calibrated
to is counted over all training labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import cut_batches

SAMPLE = 1500  # training documents of each label, at most
LONGEST = 1 << 15  # bytes of a training document; longer ones are scored but not learned from
THRESHOLD = 0.3  # score from which a text is predicted to be good
BLOCK = 256  # bytes; a chunk is two blocks, the next one starts a block later
WIDTH, EMBEDDED, FILTERS, HIDDEN = 8, 6, 32, 16
PAD = 256  # stands behind the last byte of a text
STEPS, BATCH, RATE = 940, 16, 4e-3  # half of a batch is of either label
SEED = 11
SLICE = 1 << 21  # text bytes held as blocks at a time
STEP = 64  # blocks convolved at a time

Net = dict[str, np.ndarray]


def blocks(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each block with the ``WIDTH - 1`` bytes behind it, blocks of each text, and how full
    each block is. An empty text is one block of padding."""
    sizes = np.array([len(r) for r in raw], np.int64)
    n = np.maximum(1, -(-sizes // BLOCK))
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    flat = np.full(int(n.sum()) * BLOCK, PAD, np.uint16)
    for r, at in zip(raw, starts * BLOCK):
        flat[at : at + len(r)] = np.frombuffer(r, np.uint8)
    own = flat.reshape(-1, BLOCK)
    behind = np.full((len(own), WIDTH - 1), PAD, np.uint16)
    behind[:-1] = own[1:, : WIDTH - 1]
    behind[starts + n - 1] = PAD
    return np.concatenate([own, behind], axis=1), n, (own != PAD).mean(axis=1).astype(np.float32)


def windows(net: Net, b: np.ndarray) -> np.ndarray:
    """Embedded bytes under the filters at every place: places x (WIDTH * EMBEDDED)."""
    x = net["embed"][b]
    view = np.lib.stride_tricks.sliding_window_view(x.reshape(len(b), -1), WIDTH * EMBEDDED, axis=1)[:, ::EMBEDDED]
    return np.ascontiguousarray(view).reshape(-1, WIDTH * EMBEDDED)


def pooled(net: Net, b: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest filter output of every block and, if asked for, where it stands."""
    out, at = np.empty((len(b), FILTERS), np.float32), np.empty((len(b), FILTERS), np.int64) if places else None
    for lo in range(0, len(b), STEP):
        y = (windows(net, b[lo : lo + STEP]) @ net["filters"]).reshape(-1, BLOCK, FILTERS)
        out[lo : lo + STEP] = y.max(axis=1)
        if places:
            at[lo : lo + STEP] = y.argmax(axis=1)
    return np.maximum(out + net["bias"], 0), at


def chunks(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second block of every chunk, and chunks of each text. A text of one block is one chunk."""
    m = np.maximum(1, n - 1)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    first = np.arange(m.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(m)[:-1])), m)
    return first, first + np.repeat(n > 1, m), m


def forward(net: Net, top: np.ndarray, fill: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Logit of each text from the pooled filters of its blocks."""
    a, b, m = chunks(n)
    x = np.concatenate([np.maximum(top[a], top[b]), ((fill[a] + np.where(a == b, 0, fill[b])) / 2)[:, None]], axis=1)
    h = np.maximum(x @ net["dense"] + net["dense_bias"], 0)
    starts = np.concatenate(([0], np.cumsum(m)[:-1]))
    best = np.maximum.reduceat(h, starts, axis=0)
    return {"a": a, "b": b, "m": m, "x": x, "h": h, "best": best, "logit": best @ net["out"] + net["out_bias"][0]}


def gradients(net: Net, b: np.ndarray, n: np.ndarray, fill: np.ndarray, y: np.ndarray) -> Net:
    """Gradients of the mean log loss. Pooling passes a gradient to the first largest place only."""
    top, at = pooled(net, b, places=True)
    f = forward(net, top, fill, n)
    g = ((1 / (1 + np.exp(-f["logit"])) - y) / len(y)).astype(np.float32)
    out = {"out": f["best"].T @ g, "out_bias": np.array([g.sum()], np.float32)}
    text = np.repeat(np.arange(len(n)), f["m"])
    dh = np.zeros_like(f["h"])
    for k in range(HIDDEN):  # the first chunk of a text that reaches its maximum
        hit = np.flatnonzero((f["h"][:, k] == f["best"][text, k]) & (f["h"][:, k] > 0))
        own, first = np.unique(text[hit], return_index=True)
        dh[hit[first], k] = g[own] * net["out"][k]
    out["dense"], out["dense_bias"] = f["x"].T @ dh, dh.sum(axis=0)
    dx = (dh @ net["dense"].T)[:, :FILTERS]
    dtop = np.zeros_like(top)
    from_a = top[f["a"]] >= top[f["b"]]
    np.add.at(dtop, f["a"], np.where(from_a, dx, 0))
    np.add.at(dtop, f["b"], np.where(from_a, 0, dx))
    dtop *= top > 0
    out["bias"] = dtop.sum(axis=0)
    blk, flt = np.nonzero(dtop)
    d = dtop[blk, flt]
    under = b[blk[:, None], at[blk, flt][:, None] + np.arange(WIDTH)]  # bytes below the winning places
    x = net["embed"][under].reshape(len(blk), -1) * d[:, None]
    out["filters"] = np.zeros_like(net["filters"])
    np.add.at(out["filters"].T, flt, x)
    de = (net["filters"].T[flt] * d[:, None]).reshape(-1, EMBEDDED)
    out["embed"] = np.stack([np.bincount(under.ravel(), weights=de[:, k], minlength=PAD + 1) for k in range(EMBEDDED)], axis=1).astype(np.float32)
    out["embed"][PAD] = 0
    return out


def fresh(rng: np.random.Generator) -> Net:
    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.normal(size=shape) * scale).astype(np.float32)

    net = {
        "embed": draw(PAD + 1, EMBEDDED, scale=0.5), "filters": draw(WIDTH * EMBEDDED, FILTERS, scale=(2 / WIDTH / EMBEDDED) ** 0.5), "bias": np.zeros(FILTERS, np.float32),
        "dense": draw(FILTERS + 1, HIDDEN, scale=(2 / FILTERS) ** 0.5), "dense_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN, scale=(1 / HIDDEN) ** 0.5), "out_bias": np.zeros(1, np.float32),
    }
    net["embed"][PAD] = 0
    return net


def fit(texts: list[bytes], y: np.ndarray, steps: int = STEPS) -> Net:
    """Network fitted by Adam over seeded batches of whole texts, half of each label, both taken in
    turn from shuffled rounds. Both labels must be there."""
    rng = np.random.default_rng(SEED)
    net = fresh(rng)
    one, two = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}
    turns: tuple[list[int], list[int]] = ([], [])
    for t in range(1, steps + 1):
        part: list[int] = []
        for label, queue in enumerate(turns):
            while len(queue) < BATCH // 2:
                queue.extend(rng.permutation(np.flatnonzero(y == label)).tolist())
            part += queue[: BATCH // 2]
            del queue[: BATCH // 2]
        b, n, fill = blocks([texts[k] for k in part])
        rate = RATE * (1 - (t - 1) / steps)
        for k, g in gradients(net, b, n, fill, y[part].astype(np.float32)).items():
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.999 * two[k] + 0.001 * g * g
            net[k] = (net[k] - rate * one[k] / (1 - 0.9**t) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def features(net: Net, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Pooled filters and fill of the blocks of one text of any length, a piece at a time."""
    tops, fills = [], []
    for lo in range(0, max(1, len(raw)), SLICE):
        b, _, fill = blocks([raw[lo : lo + SLICE + WIDTH - 1]])
        keep = -(-min(SLICE, len(raw) - lo) // BLOCK) or 1  # without the block begun by the bytes behind
        tops.append(pooled(net, b[:keep])[0])
        fills.append(fill[:keep])
    return np.concatenate(tops), np.concatenate(fills)


def logits(net: Net, raw: list[bytes]) -> np.ndarray:
    """Logit of each text on the sample's terms, where both labels are equally frequent."""
    if len(raw) == 1:
        top, fill = features(net, raw[0])
        return forward(net, top, fill, np.array([len(top)]))["logit"].astype(np.float64)
    b, n, fill = blocks(raw)
    return forward(net, pooled(net, b)[0], fill, n)["logit"].astype(np.float64)


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def taught(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``doc_id, y`` of the training fold: one row per document, the higher of two labels."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    return rows.filter(F.col("y").isin(0, 1) & (fold("doc_id") != 0)).groupBy("doc_id").agg(F.max("y").alias("y"))


def training_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``doc_id, y, text``: at most ``size`` documents of each label, in the order of a seeded hash.

    Twice as many ids are drawn, as some may have no document or too long a one. They are a written
    table of at most 4 x ``size`` rows, small enough to be broadcast, so no text is shuffled but the
    sample's. Documents that repeat an id count once.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.col("doc_id")
    parts = [labels.filter(F.col("y") == k).orderBy(*order).limit(2 * size) for k in (0, 1)]
    ids = settle(parts[0].unionByName(parts[1]), "training-ids")
    short = docs.filter(F.octet_length("text") <= LONGEST)
    found = short.join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sides = [found.filter(F.col("y") == k).orderBy(*order).limit(size) for k in (0, 1)]
    return sides[0].unionByName(sides[1])


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[Net | None, float]:
    """The network (None where a label is missing) and the logit of the share of label 1."""
    counts = {r.y: r["count"] for r in labels.groupBy("y").count().collect()}
    prior = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("y").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()))
        y = np.array([r[1] for r in rows])
        if 0 < y.sum() < len(y):
            net = fit([r[2] for r in rows], y)
            yield pa.RecordBatch.from_pydict({"name": list(net), "shape": [list(v.shape) for v in net.values()], "raw": [v.astype("<f4").tobytes() for v in net.values()]})

    sample = training_sample(docs, labels, size).repartition(1)  # bounded: 2 x SAMPLE x LONGEST bytes
    net = {r.name: np.frombuffer(r.raw, "<f4").reshape(r["shape"]) for r in sample.mapInArrow(run, "name string, shape array<long>, raw binary").collect()}
    return net or None, prior


def score(
    docs: DataFrame, labels: DataFrame, size: int = SAMPLE, threshold: float = THRESHOLD,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every text.

    Learns from labels 0 and 1 of documents whose ``crc32(id as text) mod 5`` is not 0; null
    labels, null ids and labels without a document teach nothing, and a document labelled twice
    has its higher label. Null and empty texts are one block of padding and are scored like any
    other. Where a label is missing every text scores the smoothed share of label 1 (0.5 without
    labels). A null id is not held out. Equal texts have equal scores, repeated rows repeat, an
    empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    net, prior = train(rows, taught(labels, id_col, label_col), size)
    model = docs.sparkSession.sparkContext.broadcast((net, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, prior = model.value
        for batch in cut_batches(batches, SLICE):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            logit = np.clip((logits(net, raw) if net and raw else np.zeros(len(raw))) + prior, -60, 60)
            p = np.round(1 / (1 + np.exp(-logit)), 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = rows.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted")
