"""Secrets in texts: fixed formats, and values in credential contexts by guess cost.

The guess cost of a value is the cheapest way to build it from common words, dates, repeats,
keyboard walks and brute-force characters, as the decimal logarithm of the guesses needed. Words
are a fixed list and those of the documents by the number of documents they stand in, credential
values aside. The
costs of the parts add up, so a dynamic program over the prefixes finds the minimum. A value
that needs ``10 ** STRONG`` guesses or more was not made to be remembered: it is a span.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import cut_batches, id_and_text

STRONG = 10.0
SLICE = 8 << 20
KINDS = ("assign", "access", "hex", "guess")

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # shorter runs fail, and no part of one can pass

#: Words that announce a credential; a value follows after ``:``, ``=``, ``:=`` or ``=>``: in quotes up to the closing one or the line's end.
CREDENTIALS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "credential", "apikey", "api_key", "api-key", "access_key", "access-key", "private_key", "authorization", "bearer")
CONTEXT = re.compile(
    r"(?:" + "|".join(re.escape(w) for w in CREDENTIALS) + r""")s?["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*"""
    + r"""(?:"SCHEME((?:[^"\\\r\n]|\\[^\r\n])++)|'SCHEME((?:[^'\\\r\n]|\\[^\r\n])++)|SCHEME["']?([^\s"'<>,;]+))""".replace("SCHEME", r"(?:(?:bearer|basic)[\x20\t]+)?"),
    re.I | re.A,
)
USERINFO = re.compile(r"://[^\s/:@]+:([^\s/@]+)@")

#: Common words of remembered passwords, most common first; their place is their rank.
WORDS = (
    "password pass qwerty letmein admin welcome login master dragon monkey abc iloveyou sunshine princess football baseball "
    "shadow superman michael secret test guest root user hello freedom whatever trustno starwars summer winter spring autumn "
    "changeme default access server system example sample demo token key api love money computer internet service manager "
    "company office house family flower cookie cheese pepper ginger tiger killer hunter ranger soccer hockey batman jordan "
    "thomas george charlie andrew daniel jessica jennifer ashley the and you that this with from have monday friday january "
    "june july august black white green blue red orange purple silver golden"
).split()
RANK = {w: k + 1 for k, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
#: Words of the documents: runs of letters that make up one in ``RARE`` of all (word, document) pairs,
#: so there are ``RARE`` at most, and stand in ``LEAST`` documents.
RARE, LEAST = 100_000, 3
LETTERS = re.compile(r"(?<![^\W_])[^\W\d_]{3,30}(?![^\W_])")
HELD = 100_000  # distinct words a task counts before it hands them on
UNITS = 128  # longest unit whose repeats are looked for at every place
LEET = str.maketrans("4@8310!57$", "aabeloists")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:\d{1,2}[-/._]\d{1,2}[-/._](?:\d{4}|\d{2})|(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d|(?:19|20)\d\d)", re.A)


def neighbours() -> dict[str, dict[str, tuple[int, float]]]:
    """Keys that touch on a staggered keyboard, and alphabet neighbours, each with its direction."""
    at = {c: (r, k + r * 0.5) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
    near = {c: {d: (r - at[c][0], x - at[c][1]) for d, (r, x) in at.items() if d != c and abs(r - at[c][0]) <= 1 and abs(x - at[c][1]) <= 1} for c in at}
    for run in ("abcdefghijklmnopqrstuvwxyz", "0123456789"):
        for a, b in zip(run, run[1:]):
            near[a].setdefault(b, (9, 1))
            near[b].setdefault(a, (9, -1))
    return near


NEAR = neighbours()
WALK_START, WALK_STEP = math.log10(47), math.log10(4.6)


def brute(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26)
    return math.log10(33) if c.isascii() else 2.0


def guess_cost(value: str, rank_of: dict[str, int] = RANK, longest: int = LONGEST) -> float:
    """Decimal logarithm of the guesses of the cheapest segmentation.

    Units of repeats have any length, in values of any length. Up to ``UNITS`` characters they start
    anywhere; longer ones start and end at cuts of the cheapest segmentation of what stands before
    their second copy, as far as that one is weak: a few dozen cuts, so the time stays linear.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters change length in lower case
        low = value
    plain = low.translate(LEET)
    best = [0.0] * (n + 1)
    dates: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        if low[i].isdigit() and (m := DATE.match(low, i)):
            dates.setdefault(m.end(), []).append((i, 2.1 if m.end() - i == 4 else math.log10(366 * 150)))
    widest = min(n // 2, UNITS)
    cut = [0] * (n + 1)  # where the last part of the cheapest segmentation starts
    ahead: dict[int, list[tuple[int, float]]] = {}  # ends that copies of a long unit reach
    runs, walk, turns, way = [0] * widest, 0, 0, None
    units: dict[str, float] = {}
    for end in range(1, n + 1):
        c = low[end - 1]
        cost, cut[end], copied = best[end - 1] + brute(c) + (math.log10(2) if value[end - 1].isupper() else 0.0), end - 1, False
        for size in range(2, min(longest, end) + 1):
            rank = rank_of.get(plain[end - size : end])
            if rank:
                part = value[end - size : end]
                changed = sum(a != b for a, b in zip(part, plain[end - size : end]))
                whole = best[end - size] + math.log10(rank) + math.log10(2) * (1 + changed)
                if whole < cost:
                    cost, cut[end] = whole, end - size
        for start, price in dates.get(end, ()):
            if best[start] + price < cost:
                cost, cut[end] = best[start] + price, start
        for u in range(1, min(widest, end - 1) + 1):  # repeats of a unit of u characters
            if c != low[end - 1 - u]:
                runs[u - 1] = 0
                continue
            runs[u - 1] += 1
            times = runs[u - 1] // u + 1
            if runs[u - 1] >= max(2, u):
                start = end - times * u
                unit = low[start : start + u]
                if unit not in units:
                    units[unit] = guess_cost(unit, rank_of, longest) if u > 4 else sum(map(brute, unit))
                whole = best[start] + units[unit] + math.log10(times)
                if whole < cost:
                    cost, cut[end], copied = whole, start, True
        for start, whole in ahead.pop(end, ()):
            if whole < cost:
                cost, cut[end], copied = whole, start, True
        if end > 1 and c in NEAR.get(low[end - 2], {}):
            step = NEAR[low[end - 2]][c]
            walk, turns = walk + 1, turns + (walk > 0 and step != way)
            way = step
            if walk >= 2:
                whole = best[end - walk - 1] + WALK_START + math.log10(walk + 1) + WALK_STEP * min(turns, walk)
                if whole < cost:
                    cost, cut[end], copied = whole, end - walk - 1, False
        else:
            walk, turns, way = 0, 0, None
        best[end] = cost
        start = cut[end] if cost < STRONG else 0
        if copied:  # copies of copies are copies of the shorter unit
            start = cut[start]
        while cost < STRONG and end - start <= n - end:
            unit, times = low[start:end] if end - start > UNITS and low[start : start + 16] == low[end : end + 16] else "", 1
            while unit and low.startswith(unit, end + (times - 1) * len(unit)):
                times += 1
                ahead.setdefault(start + times * len(unit), []).append((start, cost + math.log10(times)))
            if not start:
                break
            start = cut[start]
    return best[n]


def credential_values(text: str, low: str) -> set[tuple[int, int]]:
    values = set()
    if any(w in low for w in CREDENTIALS):
        values |= {m.span(m.lastindex) for m in CONTEXT.finditer(text)}
    if "://" in text:
        values |= {m.span(1) for m in USERINFO.finditer(text)}
    return values


def spans_of(text: str, rank_of: dict[str, int] = RANK, longest: int = LONGEST) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base kinds and of strong credential values, in that order."""
    low, out = text.lower(), []
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out += [(a, 3, b) for a, b in credential_values(text, low) if guess_cost(text[a:b], rank_of, longest) >= STRONG]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def learn_words(texts: DataFrame) -> dict[str, int]:
    """Rank of every word: by documents, or in the fixed list where that is better."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        held: Counter[str] = Counter()
        for batch in cut_batches(batches, SLICE):
            for text in batch.column("text").to_pylist():
                at, left = 0, []
                for a, b in sorted(credential_values(text, text.lower())):
                    left.append(text[at:a])
                    at = max(at, b)
                held.update({w for part in (*left, text[at:]) for w in LETTERS.findall(part.lower())})
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    counts = settle(texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "secret-words")
    total = counts.agg(F.sum("n")).head()[0] or 0
    words = counts.filter((F.col("n") >= LEAST) & (F.col("n") >= total / RARE)).collect()
    ranked = {r.word: k + 1 for k, r in enumerate(sorted(words, key=lambda r: (-r.n, r.word)))}
    return ranked | {w: min(k, ranked.get(w, k)) for w, k in RANK.items()}


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans`` of every text.

    Offsets are code points, ends exclusive. A null, empty or clean text has no spans and the
    digest of an empty list. Spans of different kinds may overlap. Repeated rows repeat; an
    empty table gives no rows. The texts are read twice, first for the words.
    """
    asked = id_and_text(df, id_col, text_col)
    words = df.sparkSession.sparkContext.broadcast(learn_words(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = words.value
        longest = max(map(len, rank_of))
        names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]
        for batch in cut_batches(batches, SLICE):
            cols: list[list] = [[] for _ in names[1:]]
            for text in batch.column("text").to_pylist():
                spans = spans_of(text, rank_of, longest)
                for k in range(4):
                    cols[k].append(sum(s[1] == k for s in spans))
                cols[4].append(hashlib.sha256(joined([s for s in spans if s[1] < 3]).encode()).hexdigest())
                cols[5].append(joined(spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return asked.mapInArrow(run, schema)
