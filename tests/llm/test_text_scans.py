"""Page text, secrets and personal data."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kerbline.llm import html_text, pii, secret_scan

PAGE = """<html><head><title>T</title><script>var t="</p><p>no";</script></head><body>
<div id="cookie-notice">We use cookies and the site is good for you and all of us here today</div>
<header><h1>Site</h1></header><div class="menu"><a href=x>Home</a> <a>About</a></div>
<div class=content><h2>Title &amp; here</h2><p>{long}</p><p>Short   one.</p><p>{long} &#233;<br>x</p></div>
<ul><li><a href=1>Related story number one in the list</a><li><a href=2>Another</a></ul>
<form><p>{long}</p></form><div class="comments"><p>{long}</p></div><footer>bye</footer>"""
LONG = "The quick brown fox is a very nice animal and it was seen by all of the people in the town on that day when the rain came down from the hills and the river was full of it. And so on it went for the rest of the year that they had."


def test_page_without_article():
    assert html_text.main_text(PAGE.format(long=LONG)) == f"Title & here\n{LONG}\nShort one.\n{LONG} é x"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<script>", "<!--", "&#0;&#xD800;", "<a" * 2000, "</p>" * 500, "<div>" * 3000])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_text.main_text(page), str)


def test_article_is_kept_whole(spark, sf):
    """All text of the article element of every given page, by a plain reading of its markup."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for r in rows:
        inner = re.search("<article>(.*?)(?:</article>|<footer)", r.html, re.S)[1]
        blocks = re.split("</?(?:p|h1)>", inner.replace("<br>", " "))
        lines = [t for b in blocks if (t := " ".join(html_text.html.unescape(re.sub("</?b>", "", b)).split()))]
        assert got[r.page_id].text == "\n".join(lines) and got[r.page_id].n_chars == len("\n".join(lines))


def test_blocks_outside_an_article_are_judged():
    page = f"<body><div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div><article><p>Read more of it soon.</p></article>"
    assert html_text.main_text(page) == f"Title\n{LONG}\n{LONG}"
    page = f"<body><article><h1>Title</h1><p>Short one.</p><p>{LONG}</p><p>End.</p></article><div>Odd.</div>"
    assert html_text.main_text(page) == f"Title\nShort one.\n{LONG}\nEnd."


@pytest.mark.parametrize("around", ["class='content has-sidebar'", "class='site no-sidebar'", "class='post with-comments'", "style='overflow: hidden'", "class=sidebar", "id=header"])
def test_names_do_not_take_the_page(around):
    assert html_text.main_text(f"<body><div {around}><article><p>{LONG}</p></article></div><div class='side-bar'>x</div>") == LONG
    assert html_text.main_text(f"<body><div {around}><p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG}\n{LONG}"
    assert html_text.main_text(f"<body><form {around}><p>{LONG}</p><p>{LONG}</p></form><div class=comments><p>{LONG}</p></div>") == f"{LONG}\n{LONG}"
    assert html_text.main_text(f"<body><p>{LONG}</p><div class='site-footer'><p>{LONG}</p></div><div style='color:red; display: none'><p>{LONG}</p></div><div hidden=''><p>{LONG}</p></div>") == LONG


def test_stop_words_come_from_the_pages(spark):
    """Pages of languages without a fixed list and without an article element keep their prose only."""
    rng = random.Random(2)
    prose = {
        "ru": lambda: " ".join(rng.choice(["и", "в", "не", "на", "что", "с", "".join(rng.choices("абвгдежзиклмнопрстуф", k=7))]) for _ in range(80)),
        "zh": lambda: "".join(rng.choice(["的", "是", "了", "在", chr(rng.randrange(0x4E00, 0x9000))]) for _ in range(200)),
        "pl": lambda: " ".join(rng.choice(["i", "w", "nie", "na", "się", "że", "".join(rng.choices("abcdefghijklmnopqrstuwyz", k=7))]) for _ in range(80)),
    }
    names = " ".join("".join(rng.choices("абвгдежзиклмнопрстуф", k=9)) for _ in range(30))
    want, rows = {}, []
    for i in range(90):
        lang = ("ru", "zh", "pl")[i % 3]
        want[i] = f"{prose[lang]()}\n{prose[lang]()}"
        rows.append((i, "u", f'<html lang="{lang}"><body><div><p>' + want[i].replace("\n", "</p><p>") + "</p></div>" + (f"<div>{names} {i}</div>" if lang == "ru" and i < 3 else "")))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert html_text.main_text(rows[0][2].replace("ru", "sr")) != ""  # nothing learned: length and links decide


def test_pages_edge_cases(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in html_text.extract(df).collect()] == [("", 0)] * 3
    assert html_text.extract(df.limit(0)).count() == 0


def brute_secrets(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_match_brute_force(spark):
    rng = random.Random(4)
    parts = ["password", "PassWD", "ſecret", "toKen", "token", "api_key", "ApiKey", "=", ": ", ' "', "'", "abc", "123456", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "😀", " ", "\n", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, "", "a" * 200000, "token=" * 20000, "://" * 20000 + ":a@"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    for r in secret_scan.scan(df).collect():
        want = brute_secrets(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(secret_scan.joined(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in want) for k in range(3)]
        assert set(secret_scan.joined(want).split(",")) - {""} <= set(r.spans.split(","))


def test_guess_cost_is_the_minimum():
    def parts(v: str) -> float:  # every segmentation into brute-force runs and ranked words
        best = [0.0]
        for end in range(1, len(v) + 1):
            options = [best[end - 1] + secret_scan.brute(v[end - 1])]
            options += [best[end - len(w)] + secret_scan.math.log10(k) + secret_scan.math.log10(2) for w, k in secret_scan.RANK.items() if v[:end].endswith(w)]
            best.append(min(options))
        return best[-1]

    for v in ("password", "xzdragonqk", "monkeymonkex", "kqzvbj"):
        assert secret_scan.guess_cost(v) <= parts(v) + 1e-9
    weak = ("hunter2", "qwertyuiop", "aaaaaaaaaaaa", "20240101", "P@ssw0rd123", "abcabcabcabc", "1" * 5000)
    strong = ("kd83jfK29dm", "1eb9c654e721b4f812088970e66a6345", "Xq7$kP2!vN")
    assert all(secret_scan.guess_cost(v) < secret_scan.STRONG <= secret_scan.guess_cost(s) for v in weak for s in strong)
    assert secret_scan.spans_of("pwd: Xq7$kP2!vN now")[0] == (5, 3, 15)
    assert not secret_scan.spans_of("password is qwerty, passphrase: sunshine")


@pytest.mark.parametrize("value", ["ab,Xq7$kP2!vN9w", "a;kd83jfK29dmQ", "my Xq7$kP2!vN", "x<y>Kd83jf,K29", "it's;Kd83jfK29"])
def test_quoted_credential_values_are_whole(value):
    for before, after in (('password="', '"'), ('pwd\t:\t"', '" x'), ('"secret" => "Bearer ', '"'), ('passphrase: "', "\nnext line")):
        spans = secret_scan.spans_of(before + value + after)
        assert (len(before), 3, len(before + value)) in spans
    assert secret_scan.spans_of("pwd\t=\tXq7$kP2!vN now") == [(6, 3, 16)]
    assert secret_scan.spans_of("pwd = Bearer 'Xq7$kP2!vN'") == [(14, 3, 24)]


def test_words_come_from_the_documents(spark):
    """Ordinary words after a credential word are no secret, a copied value of letters stays one."""
    prose = [f"this identification document number {i} was written" for i in range(40)]
    asked = ["Authorization: document", "credential: identification", "secret: zqjxkvwpq", "token: zqjxkvwpq", "pwd: zqjxkvwpq", "pwd: zqjxkvwpq"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*asked, *prose])], "doc_id long, text string")
    got = {r.doc_id: r.n_guess for r in secret_scan.scan(df).collect()}
    assert [got[i] for i in range(6)] == [0, 0, 1, 1, 1, 1] and not any(got[i] for i in range(6, 46))


def test_repeats_of_any_unit():
    for unit in ("zqjxk", "sunshinemonkey"):
        once = secret_scan.guess_cost(unit)
        assert secret_scan.guess_cost(unit * 5) <= once + 0.7 < secret_scan.STRONG


def brute_personal(t: str) -> str:
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        check = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        out += [(2, *m.span())] * (13 <= len(d) <= 19 and check % 10 == 0)
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(out))


def test_personal_data_matches_brute_force(spark):
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "x", "1", "22", "255", "0", ".", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "é", "😀", "a@b.cc", "_", "1.2.3.4", "\n", "+1 (499) 555-6503", "256.1.1.1", "000.00001.1.2", " (at) ex (dot) com", "DE89 3704 0044 0532 0130 00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", "1" * 20000, "a" * 50000, "1 " * 10000, "a@b" + ".c" * 20000, "+" * 3000 + "1" * 3000, "1.2.3.4 " * 1500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "+1 (499) 555-6503")], "doc_id long, text string").withColumn("_base", F.lit(1))
    rows = pii.find(df).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = brute_personal(texts[r.doc_id] or "") if r.doc_id is not None else "phone:0:17"
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.spans == want or r.spans.startswith(want) and r.n_added > 0
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len([x for x in want.split(",") if x])
    assert pii.find(df.limit(0)).count() == 0


def test_loose_spans_are_learned(spark):
    """Numbers written like checked phones but without the plus are added, plain numbers are not."""
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    phones = [(i, f"call: +1 ({digits(3)}) {digits(3)}-{digits(4)} now") for i in range(300)]
    plain = [(1000 + i, f"item {digits(9)} sold") for i in range(300)]
    rows = pii.find(spark.createDataFrame([*phones, *plain, (5000, "call: (499) 555-1234 now")], "doc_id long, text string")).collect()
    assert all(r.n_added == 0 for r in rows if 1000 <= r.doc_id < 5000) and all(r.n_phone == 1 for r in rows if r.doc_id < 1000)


def test_loose_kinds_have_labels_of_their_own(spark):
    """National numbers, account numbers, written-out addresses and numbers side by side are added."""
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    phones = [(i, f"call: +1 ({digits(3)}) {digits(3)}-{digits(4)} now") for i in range(300)]
    plain = [(1000 + i, f"item {digits(9)} sold") for i in range(300)]
    row = "(499) 555-1234 (499) 555-1235 (499) 555-1236 (499) 555-1237"
    texts = {
        5000: "call: (499) 555-1234 now", 5001: "pay DE89 3704 0044 0532 0130 00 today", 5002: "pay DE88 3704 0044 0532 0130 00 today",
        5003: "ask john (at) ex (dot) com. Then wait", 5004: "we met (at) noon", 5005: f"call: {row} now", 5006: "call: 499 555 1234 499 555 1235 499 555 1236 499 555 1237 now",
    }
    df = spark.createDataFrame([*phones, *plain, *texts.items()], "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][int(a) : int(b)] for _, a, b in (x.split(":") for x in r.spans.split(",") if x)] for r in pii.find(df).collect() if r.doc_id >= 5000}
    assert got == {
        5000: ["499) 555-1234"], 5001: ["DE89 3704 0044 0532 0130 00"], 5002: [], 5003: ["john (at) ex (dot) com"], 5004: [],
        5005: [f"499) 555-123{k}" for k in range(4, 8)], 5006: [f"499 555 123{k}" for k in range(4, 8)],
    }


def test_redaction(spark):
    texts = ["mail a@b.cc, ip 1.2.3.4!", None, "clean é😀", "😀 +1 (499) 555-6503"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out == {0: "mail [EMAIL], ip [IP]!", 1: None, 2: "clean é😀", 3: "😀 [PHONE]"}


def test_spans_that_meet_match_brute_force(spark):
    """Labels and covers of candidates against all pairs, over one long text of numbers."""
    rng = random.Random(6)
    shapes = ["+49 30 %07d x", "%016d ", "n %04d-%04d-%04d ", "x@y%d.com ", "10.0.%d.7 ", "+1%09d, ", "4111 1111 1111 1111 ", "5%d" * 30 + " "]
    text = "".join(p % tuple(rng.randrange(900) for _ in range(p.count("%"))) for p in rng.choices(shapes, k=1500))
    df = spark.createDataFrame([(1, text), (2, "no digits"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.with_candidates(df).collect()}
    assert rows[2]._loose is None and rows[3]._loose is None
    base, loose = rows[1]._base, rows[1]._loose
    assert len(loose) > 1000 and len(base) > 300
    for c in loose:
        met = [s for s in base if s.start < c.end and s.end > c.start]
        assert c.base == bool(met)
        number = c.kind == pii.KINDS.index("number") and any(pii.BASE[s.kind] in ("card", "phone") for s in met)
        assert c.label == (c.holds or number)


def test_redaction_over_chunks_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pii, "CHUNK", 16)
    rng = random.Random(3)
    text = "".join(rng.choice(["é word ", "a@b.org ", "10.2.3.4", " +49 30 1234567 ", "\U0001f600" * 20, "x" * 40 + " "]) for _ in range(300))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [s.split(":") for s in pii.find(df).first().spans.split(",")]
    order = sorted((int(a), pii.KINDS.index(k), int(b)) for k, a, b in spans)
    want, at = "", 0
    for a, k, b in order:
        if a >= at:
            want += text[at:a] + f"[{pii.KINDS[k].upper()}]"
        at = max(at, b)
    assert pii.redact(df).first().text == want + text[at:]


def test_copies_of_long_units_count_at_any_length():
    unit = "a" * 100 + "7" * 100
    once = secret_scan.guess_cost(unit)
    assert secret_scan.guess_cost(unit[50:150] * 2) < secret_scan.guess_cost(unit[50:150] * 3) < secret_scan.STRONG
    for k in (2, 3, 30):
        assert abs(secret_scan.guess_cost(unit * k) - once - secret_scan.math.log10(k)) < 1e-9
    assert not [s for s in secret_scan.spans_of(f"pwd = {unit * 3}") if s[1] == 3]
