"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Generators propose overlapping spans: the four base formats, and loose forms of numbers, account
numbers and written-out addresses. Base spans that pass their check stay, and so do loose spans
with a check of their own that holds: account numbers by the remainder modulo 97, written-out
addresses that decode to the email format. Boosted trees over format and context features judge
all others. They learn from all documents, each kind from its own label: the checks just named,
and for numbers a checked phone or card at the same place. No feature sees what decides a label:
neither the plus of a phone nor a check sum; a phone also trains without its country code, as the
number would stand in a national text. Features are small integers, so the training table is one row per feature vector with counts, bounded by the number of vectors and not by the
documents; each split of a tree is one aggregation over it. Thresholds are calibrated on a fold
of documents that did not train.

Everything about one document happens inside its row; no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

BASE = ("email", "ip", "card", "phone")
LOOSE = ("number", "account", "address")
KINDS = (*BASE, *LOOSE)

#: Leftmost non-overlapping matches in linear time: a match starts at the start of its run or
#: where the last match ended, and possessive loops never look back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"[0-9](?:[\x20().-]{0,2}[0-9])++",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[{]\x20?(?i:at)\x20?[)\]}]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20\.\x20|\x20?[(\[{]\x20?(?i:dot)\x20?[)\]}]\x20?)[A-Za-z0-9-]{1,63}){0,8}",
    # Numbers inside a long run of digits: one without spaces, or groups up to ten digits or more, or the rest.
    "part": r"[0-9](?:[().-]{0,2}[0-9]){6,14}(?![().-]{0,2}[0-9])|[0-9](?:[\x20().-]{0,2}[0-9]){9}[0-9]*+|[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
}
#: Cheap tests that a text without a match fails.
GUARDS = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+[0-9]",
    "number": r"[0-9](?:[\x20().-]{0,2}[0-9]){6}",
    "account": r"[A-Z]{2}[0-9]{2}",
    "address": r"(?i:at)\x20?[)\]}]",
    "part": r"[0-9]",
}
RUN = 19  # digits of the longest card; a run of more is also proposed in parts
BEFORE, AFTER = 24, 8  # characters of context
CHUNK = 1024  # code points of a text cut out at a time
CUE = r"(?i)(?:tel|phone|fax|mobile|cell|call|mail|contact|card|visa|account|acct|iban|ssn|passport|licen[cs]e|id|no|nr|number|nummer|numéro|teléfono|addr(?:ess)?)[\x20.:#=]{0,3}$"
FEATURES = ("kind", "digits", "groups", "longest", "marks", "letters", "dots", "distinct", "glued", "cue")

TREES, LEARNING, REGULAR = 8, 0.5, 1.0
PRECISION = 0.95  # asked of the spans above a threshold, on the held-out fold
SPAN = "array<struct<kind:int,start:int,end:int>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression; the optimiser would copy a plain reference."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """All earlier values merged at each place, in steps of 256 so that long arrays stay cheap."""
    fold = lambda xs: F.aggregate(xs, zero, merge)

    def by_block(xs: Column) -> Column:
        blocks = F.sequence(F.lit(0), ((F.size(xs) - 1) / 256).cast("int"))
        sums = F.transform(blocks, lambda b: fold(F.slice(xs, b * 256 + 1, F.lit(256))))
        return let(
            sums,
            lambda s: let(
                F.transform(s, lambda _, b: fold(F.slice(s, F.lit(1), b))),
                lambda before: F.transform(
                    xs, lambda _, i: merge(F.element_at(before, (i / 256).cast("int") + 1), fold(F.slice(xs, (i / 256).cast("int") * 256 + 1, i % 256)))
                ),
            ),
        )

    return let(values, by_block)


def running_starts(sizes: Column) -> Column:
    """Sum of all earlier sizes at each place."""
    return running(sizes, F.lit(0), lambda a, x: a + x)


def matches(text: Column, kind: str) -> Column:
    """``array<struct<value, before, after, start, end>>`` of one generator, code point offsets."""
    pattern = F.lit(PATTERNS[kind])

    def build(pieces: Column, values: Column) -> Column:
        sizes = F.zip_with(F.slice(pieces, F.lit(1), F.size(values)), values, lambda p, v: F.char_length(p) + F.char_length(v))
        return let(
            running_starts(sizes),
            lambda starts: F.transform(
                values,
                lambda v, i: let(
                    F.element_at(starts, i + 1) + F.char_length(F.element_at(pieces, i + 1)),
                    lambda start: F.struct(
                        v.alias("value"),
                        F.right(F.element_at(pieces, i + 1), F.lit(BEFORE)).alias("before"),
                        F.left(F.element_at(pieces, i + 2), F.lit(AFTER)).alias("after"),
                        start.cast("int").alias("start"),
                        (start + F.char_length(v)).cast("int").alias("end"),
                    ),
                ),
            ),
        )

    found = let(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda values: F.when(
            F.size(values) > 0, let(F.split(text, PATTERNS[kind], -1), lambda pieces: build(pieces, values))
        ),
    )
    none = F.array().cast("array<struct<value:string,before:string,after:string,start:int,end:int>>")
    return F.coalesce(F.when(text.rlike(GUARDS[kind]), found), none)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the check sum."""

    def total(d: Column) -> Column:
        def weigh(a: Column, i: Column) -> Column:
            x = F.ascii(F.substring(d, F.char_length(d) - i, F.lit(1))) - 48
            y = F.when(i % 2 == 1, x * 2).otherwise(x)
            return a + F.when(y > 9, y - 9).otherwise(y)

        return F.aggregate(F.sequence(F.lit(0), F.char_length(d) - 1), F.lit(0), weigh) % 10 == 0

    return F.coalesce(let(digits, lambda d: F.when(F.char_length(d).between(13, 19), total(d))), F.lit(False))


def passes(kind: str, value: Column) -> Column:
    """The check of a base kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        strip = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.char_length(strip(p)) < 3) | ((F.char_length(strip(p)) == 3) & (strip(p) <= "255")))
    if kind == "card":
        return luhn(only_digits(value))
    return F.char_length(only_digits(value)).between(9, 15)


def iban(value: Column) -> Column:
    """Whether 15 to 34 letters and digits leave the remainder 1 modulo 97."""

    def rest(s: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            code = F.ascii(F.substring(s, i, F.lit(1)))
            return F.when(code < 65, a * 10 + code - 48).otherwise(a * 100 + code - 55) % 97

        return F.aggregate(F.sequence(F.lit(1), F.char_length(s)), F.lit(0), step) == 1

    plain = F.regexp_replace(value, "\x20", "")
    turned = let(plain, lambda s: F.concat(F.substring(s, F.lit(5), F.char_length(s)), F.left(s, F.lit(4))))
    return F.coalesce(let(turned, lambda s: F.when(F.char_length(s).between(15, 34), rest(s))), F.lit(False))


def decoded(value: Column) -> Column:
    """An address with its written-out signs replaced."""
    at = F.regexp_replace(value, r"\x20?[(\[{]\x20?(?i:at)\x20?[)\]}]\x20?", "@")
    return F.regexp_replace(at, r"\x20?[(\[{]\x20?(?i:dot)\x20?[)\]}]\x20?|\x20\.\x20", ".")


def holds(kind: str, value: Column) -> Column:
    """The check of a loose kind; a number has none of its own."""
    if kind == "account":
        return iban(value)
    if kind == "address":
        return decoded(value).rlike(f"^(?:{PATTERNS['email']})$")
    return F.lit(False)


def numbers(text: Column) -> Column:
    """Runs of 7 to 34 digits, and the parts of runs of more than ``RUN``; what stands before a
    run stands before each of its parts."""
    found = matches(text, "number")
    size = lambda c: F.char_length(only_digits(c["value"]))

    def place(c: Column, p: Column) -> Column:
        return F.struct(
            p["value"].alias("value"),
            c["before"].alias("before"),
            F.left(F.concat(p["after"], c["after"]), F.lit(AFTER)).alias("after"),
            (c["start"] + p["start"]).alias("start"),
            (c["start"] + p["end"]).alias("end"),
        )

    def parts(c: Column) -> Column:
        """Parts of a long run but for the run itself, which is proposed anyway if it is not too long."""
        whole = lambda p: (p["start"] == c["start"]) & (p["end"] == c["end"]) & (size(c) <= 34)
        places = F.transform(matches(c["value"], "part"), lambda p: place(c, p))
        return F.filter(places, lambda p: size(p).between(7, 34) & ~whole(p))

    return let(
        found,
        lambda runs: F.concat(
            F.filter(runs, lambda c: size(c).between(7, 34)), F.flatten(F.transform(F.filter(runs, lambda c: size(c) > RUN), parts))
        ),
    )


def national(text: Column) -> Column:
    """Checked phones without their country code, at the place of the phone; they only train."""
    found = F.filter(matches(text, "phone"), lambda c: passes("phone", c["value"]) & c["value"].rlike(r"^\+[0-9]+[^0-9]"))
    bare = F.transform(found, lambda c: c.withField("value", F.regexp_replace(c["value"], r"^\+[0-9]+[^0-9]+", "")))
    return F.filter(bare, lambda c: F.char_length(only_digits(c["value"])) >= 7)


def features(c: Column, kind: int) -> Column:
    """Small whole numbers about the form of a candidate and what stands around it."""
    v, before, after = c["value"], c["before"], c["after"]
    count = lambda keep: F.char_length(F.regexp_replace(v, keep, ""))
    runs = F.filter(F.split(v, "[^0-9]+"), lambda x: x != "")
    most = lambda x, n: F.least(x, F.lit(n)).cast("int")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    return F.struct(
        F.lit(kind).alias("kind"),
        most(count("[^0-9]"), 20).alias("digits"),
        most(F.size(runs), 8).alias("groups"),
        most(F.coalesce(F.array_max(F.transform(runs, F.char_length)), F.lit(0)), 20).alias("longest"),
        most(count("[A-Za-z0-9]"), 8).alias("marks"),
        most(count("[^A-Za-z]"), 20).alias("letters"),
        most(count(r"[^.]"), 5).alias("dots"),
        most(F.size(F.array_distinct(F.split(only_digits(v), ""))), 10).alias("distinct"),
        (flag(before.rlike("[A-Za-z0-9]$")) + flag(after.rlike("^[A-Za-z0-9]"))).alias("glued"),
        flag(F.regexp_replace(before, r"[+(]+$", "").rlike(CUE)).alias("cue"),
    )


def with_candidates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_base`` (checked base spans, by kind, then start) and ``_loose`` (candidates with
    features, label, whether a base span covers them, and span); no row is moved."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def checked(kind: str) -> Column:
        k = F.lit(BASE.index(kind))
        found = F.filter(matches(text, kind), lambda c: passes(kind, c["value"]))
        return F.transform(found, lambda c: F.struct(k.alias("kind"), c["start"].alias("start"), c["end"].alias("end")))

    base = F.concat(*map(checked, BASE))

    def candidates(kind: str) -> Column:
        k = KINDS.index(kind)
        found = F.concat(numbers(text), national(text)) if kind == "number" else matches(text, kind)
        return F.transform(found, lambda c: F.struct(F.lit(k).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), features(c, k).alias("f"), holds(kind, c["value"]).alias("holds")))

    some = text.rlike("[0-9@]") | text.rlike(GUARDS["address"])
    both = F.when(some, F.struct(base.alias("base"), F.concat(*map(candidates, LOOSE)).alias("loose")))
    out = df.withColumn("_both", both)
    return out.withColumns({"_base": F.col("_both.base"), "_loose": judged(F.col("_both.base"), F.col("_both.loose"))}).drop("_both")


FAR = (1 << 31) - 1
FORM = "struct<" + ",".join(f"{f}:int" for f in FEATURES) + ">"


def judged(base: Column, loose: Column) -> Column:
    """The loose candidates with ``label`` and ``base``, whether a checked base span covers them.

    Both lists are sorted as one. A base span meets a candidate if it stands before it and ends
    behind its start, or stands after it and starts before its end. So the furthest end so far and
    the next start tell, and a text with many numbers costs no pairs.
    """
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(None).cast(FORM).alias("f"), F.lit(None).cast("boolean").alias("holds"), F.lit(True).alias("checked")))
    open_ones = F.transform(loose, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["f"].cast(FORM).alias("f"), c["holds"].alias("holds"), F.lit(False).alias("checked")))
    numeric = [BASE.index("card"), BASE.index("phone")]

    def ends(all_: Column, kinds: Sequence[int]) -> Column:
        each = F.transform(all_, lambda e: F.when(e["checked"] & e["kind"].isin(*kinds), e["end"]).otherwise(F.lit(0)))
        return running(each, F.lit(0), lambda a, x: F.greatest(a, x))

    def starts(all_: Column, kinds: Sequence[int]) -> Column:
        each = F.transform(F.reverse(all_), lambda e: F.when(e["checked"] & e["kind"].isin(*kinds), e["start"]).otherwise(F.lit(FAR)))
        return F.reverse(running(each, F.lit(FAR), lambda a, x: F.least(a, x)))

    def tell(all_: Column) -> Column:
        facts = F.struct(
            ends(all_, range(len(BASE))).alias("end"), starts(all_, range(len(BASE))).alias("start"),
            ends(all_, numeric).alias("n_end"), starts(all_, numeric).alias("n_start"),
        )
        return let(facts, lambda x: F.filter(F.transform(all_, lambda e, i: one(e, i, x)), lambda c: ~c["checked"]))

    def one(e: Column, i: Column, x: Column) -> Column:
        meets = lambda end, start: (F.get(x[end], i) > e["start"]) | (F.get(x[start], i) < e["end"])
        label = e["holds"] | ((e["kind"] == KINDS.index("number")) & meets("n_end", "n_start"))
        return F.struct(
            e["kind"].alias("kind"), e["start"].alias("start"), e["end"].alias("end"), e["f"].alias("f"), e["holds"].alias("holds"),
            label.alias("label"), meets("end", "start").alias("base"), e["checked"].alias("checked"),
        )

    return let(F.array_sort(F.concat(plain, open_ones)), tell)


# -- boosted trees --------------------------------------------------------------------------


def margin(trees: Sequence[dict], get: Callable[[str], Column]) -> Column:
    """Sum of the leaves a feature vector falls into."""

    def grow(node: dict) -> Column:
        if "leaf" in node:
            return F.lit(node["leaf"])
        return F.when(get(node["feature"]) <= node["at"], grow(node["low"])).otherwise(grow(node["high"]))

    return sum((grow(t) for t in trees), F.lit(0.0))


def probability(trees: Sequence[dict], get: Callable[[str], Column]) -> Column:
    return 1 / (1 + F.exp(-margin(trees, get)))


def best_splits(stats: DataFrame, trees: Sequence[dict], node: Column) -> dict[int, tuple[str, int, float, float, float, float]]:
    """Per node the split of highest gain: feature, value, and sums of gradient and curvature of
    both sides. One aggregation over the training table."""
    p = probability(trees, F.col)
    each = stats.select(
        node.alias("node"), (F.col("pos") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in FEATURES))).alias("x"),
    )
    sums = each.groupBy("node", "x.feature", "x.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    side = Window.partitionBy("node", "feature")
    low = side.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    worth = lambda g, h: g * g / (h + REGULAR)
    rows = (
        sums.select("node", "feature", "v", F.sum("g").over(low).alias("gl"), F.sum("h").over(low).alias("hl"), F.sum("g").over(side).alias("g"), F.sum("h").over(side).alias("h"))
        .withColumn("gain", worth(F.col("gl"), F.col("hl")) + worth(F.col("g") - F.col("gl"), F.col("h") - F.col("hl")) - worth(F.col("g"), F.col("h")))
        .groupBy("node").agg(F.max_by(F.struct("feature", "v", "gl", "hl", (F.col("g") - F.col("gl")).alias("gr"), (F.col("h") - F.col("hl")).alias("hr")), F.struct("gain", "feature", "v")).alias("best"))
    )
    return {r.node: tuple(r.best) for r in rows.collect()}


def train(candidates: DataFrame, id_col: str) -> tuple[list[dict], dict[int, float]]:
    """Trees of depth two, and the probability from which each loose kind counts as personal.

    ``candidates`` has ``_loose``. One fifth of the documents by hash of the id calibrates: a
    kind's threshold is the lowest tenth, not below one half, above which ``PRECISION`` of the
    fold is positive; of a kind that never gets there the trees select nothing.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    rows = candidates.select(held.alias("held"), F.explode("_loose").alias("c")).select("held", "c.f.*", F.col("c.label").cast("long").alias("pos"))
    table = settle(rows.groupBy("held", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos")), "pii-vectors")
    stats = table  # one row per feature vector; sums are made where the rows are
    fit = stats.filter(~F.col("held"))
    trees: list[dict] = []
    leaf = lambda g, h: {"leaf": LEARNING * g / (h + REGULAR)}
    for _ in range(TREES):
        root = best_splits(fit, trees, F.lit(0)).get(0)
        if root is None:
            return [], {}
        feature, at, *_ = root
        halves = best_splits(fit, trees, (F.col(feature) > at).cast("int"))
        tree = {"feature": feature, "at": at}
        for side, name in enumerate(("low", "high")):
            if side in halves:
                f, v, gl, hl, gr, hr = halves[side]
                tree[name] = {"feature": f, "at": v, "low": leaf(gl, hl), "high": leaf(gr, hr)}
            else:
                tree[name] = {"leaf": 0.0}
        trees.append(tree)
    tenth = F.floor(probability(trees, F.col) * 10)
    bins = stats.filter("held").groupBy("kind", tenth.alias("bin")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()
    thresholds = {}
    for kind in {r.kind for r in bins}:
        n = pos = 0
        for r in sorted((r for r in bins if r.kind == kind), key=lambda r: -r.bin):
            n, pos = n + r.n, pos + r.pos
            if pos < PRECISION * n or r.bin < 5:
                break
            thresholds[kind] = r.bin / 10
    return trees, thresholds


def chosen(trees: Sequence[dict], thresholds: dict[int, float]) -> Column:
    """Loose candidates whose own check holds, or at or above the threshold of their kind, that no
    checked base span covers."""
    none = F.array().cast(SPAN)

    def fits(c: Column) -> Column:
        p = probability(trees, lambda f: c["f"][f])
        enough = c["holds"]
        for kind, t in sorted(thresholds.items()):
            enough = enough | ((c["kind"] == kind) & (p >= t))
        return ~c["base"] & enough

    picked = F.transform(F.filter("_loose", fits), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return F.coalesce(picked, none)


def joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every text.

    Offsets are code points, ends exclusive; spans by kind, then start. A null, empty or clean
    text has no spans and the digest of an empty list. Repeated rows repeat and train once each.
    Without candidates nothing is learned and nothing added; where the trees learn nothing, loose
    spans whose own check holds are added still. An empty table gives no rows.
    """
    asked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = settle(with_candidates(asked).drop("text"), "pii-candidates")
    trees, thresholds = train(held, "doc_id")
    base = F.coalesce("_base", F.array().cast(SPAN))
    out = held.select("doc_id", base.alias("base"), chosen(trees, thresholds).alias("added"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == BASE.index(kind))).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id", *map(count, BASE), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", F.array_sort("added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with every span in ``text_col`` replaced by its kind in brackets.

    Overlapping spans become one, named by the first. Null texts stay null.
    """
    columns = df.columns
    found = with_candidates(df, text_col)
    trees, thresholds = train(found.select(id_col, "_loose"), id_col)
    by_start = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    spans = F.array_sort(F.transform(F.concat(F.coalesce("_base", F.array().cast(SPAN)), chosen(trees, thresholds)), by_start))
    text = F.col(text_col)
    name = lambda s: F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), s["kind"] + 1)

    def cut(chunks: Column, lo: Column, hi: Column) -> Column:
        """Code points ``lo`` to ``hi`` of a text in chunks; a piece costs its own length only."""
        a, b = (lo / CHUNK).cast("int"), (hi / CHUNK).cast("int")
        at = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
        inside = F.substring(at(a), lo % CHUNK + 1, hi - lo)
        across = F.concat(F.substring(at(a), lo % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(at(b), F.lit(1), hi % CHUNK))
        return F.when(a == b, inside).otherwise(across)

    def pieces(chunks: Column, spans_: Column) -> Column:
        """What stands before each span that begins behind all earlier ones, and its name; the rest."""
        before = running(F.transform(spans_, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x))

        def each(at: Column) -> Column:
            named = F.transform(spans_, lambda s, i: F.when(s["start"] >= F.get(at, i), F.concat(cut(chunks, F.get(at, i), s["start"]), name(s))).otherwise(F.lit("")))
            last = F.greatest(F.get(at, F.size(spans_) - 1), F.get(spans_, F.size(spans_) - 1)["end"])
            return F.concat(F.array_join(named, ""), cut(chunks, last, F.char_length(text)))

        return let(before, each)

    clean = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), lambda chunks: let(F.col("_spans"), lambda x: pieces(chunks, x)))
    out = found.withColumn("_spans", spans)
    return out.withColumn(text_col, F.when(text.isNotNull() & (F.size("_spans") > 0), clean).otherwise(text)).select(*columns)
