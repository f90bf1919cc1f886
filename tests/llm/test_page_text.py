"""Page text: a plain version of the second pass, odd markup, depth, several readings."""

from __future__ import annotations

import random
import re
import time

import pytest

from kerbline.llm import html_text

LONG = "The quick brown fox is a very nice animal and it was seen by all of the people in the town on that day when the rain came down from the hills and the river was full of it. And so on it went for the rest of the year that they had."


def plain_pass_two(labels: list[str], headings: list[bool], articles: list[int]) -> list[bool]:
    """Looks outward from every undecided block, step by step."""

    def side(k: int, step: int) -> bool:
        here, j = articles[k], k + step
        while 0 <= j < len(labels):
            if articles[j] != here:
                if here:
                    return True  # the end of an article with a good block
                here = articles[j]  # outside, an article's nearest decided block counts, else its end
            if labels[j] in ("good", "bad"):
                return labels[j] == "good"
            if labels[j] == "low" and not here:
                return False
            j += step
        return bool(here)

    out = []
    for k, label in enumerate(labels):
        if label in ("good", "bad"):
            out.append(label == "good")
        elif label == "low" and not articles[k]:
            out.append(False)
        else:
            a, b = side(k, -1), side(k, 1)
            one = bool(articles[k]) or label == "near" and not any(articles)
            out.append(a and b or (a or b) and one or b and headings[k])
    return out


def test_second_pass_matches_a_plain_version():
    rng = random.Random(4)
    for _ in range(3000):
        n = rng.randint(0, 12)
        labels = [rng.choice(["good", "bad", "near", "low", "short", "short"]) for _ in range(n)]
        headings = [rng.random() < 0.3 for _ in range(n)]
        articles, a = [], 0
        for _ in range(n):
            a = rng.choice([a, a, a, 0, len(articles) + 1]) if rng.random() < 0.6 else 0
            articles.append(a)
        assert html_text.settle_blocks(labels, headings, articles) == plain_pass_two(labels, headings, articles), (labels, headings, articles)


def test_first_pass_by_its_rules():
    def plain(text: str, links: int, heading: bool) -> str:
        words = re.findall("[a-z]+(?:'[a-z]+)?", text.lower())
        share = sum(w in html_text.STOP_WORDS for w in words) / max(len(words), 1)
        if links > 0.33 * len(text):
            return "bad"
        if heading or len(text) < 70:
            return "short"
        if share >= 0.30:
            return "good" if len(text) > 200 else "near"
        return "near" if share >= 0.15 else "low"

    rng = random.Random(7)
    for _ in range(500):
        text = " ".join(rng.choice(["the", "of", "and", "fox", "house", "don't", "river", "x9"]) for _ in range(rng.randint(1, 90)))
        links, heading = rng.randint(0, len(text)), rng.random() < 0.2
        assert html_text.judge(text, links, heading) == plain(text, links, heading)


@pytest.mark.parametrize("depth", [1, 31, 32, 40, 300])
def test_parts_are_remembered_at_any_depth(depth):
    inner = "<form>" * depth + f"<p>{LONG}</p>" + "</form>" * depth
    page = f"<body><p>{LONG} One.</p><p>{LONG} Two.</p><p>{LONG} Three.</p><div class=comments>{inner}</div>"
    assert html_text.main_text(page) == f"{LONG} One.\n{LONG} Two.\n{LONG} Three."
    nested = "<article><p>Short one.</p>" + "<article>" * depth + f"<p>{LONG}</p>" + "</article>" * depth + "</article><p>End.</p>"
    assert html_text.main_text(f"<body>{nested}") == f"Short one.\n{LONG}"


@pytest.mark.parametrize(
    "unit", ["<a ", '<a "', "<div>", "<a<a", "<p><div>", "<form>", "<article>", "<!", "<!--", "</p>", "<a '\"", "<b x='", "<x y='>", "<li>", "<a href=\"<\">"]
)
def test_broken_markup_takes_linear_time(unit):
    page = unit * (1_000_000 // len(unit)) + "end"
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 12


def plain_tags(page: str) -> list[tuple[str, str]]:
    """Tags by the rules, character by character, each from scratch."""
    out, at = [], 0
    while (k := page.find("<", at)) >= 0:
        at = k + 1
        if page.startswith("<!--", k):
            end = page.find("-->", k + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[k + 1 : k + 2] in ("!", "?"):
            end = page.find(">", k)
            at = end + 1 if end >= 0 else at
            continue
        start = k + 1 + page.startswith("</", k)
        if not re.match("[A-Za-z]", page[start : start + 1]):
            continue
        stop = start
        while stop < len(page) and not re.match(r"[\s/>]", page[stop]):
            stop += 1
        j, quote = stop, ""
        while j < len(page) and (quote or page[j] != ">"):
            quote = "" if quote and page[j] == quote else quote or (page[j] if page[j] in "\"'" else "")
            j += 1
        if j < len(page):
            out.append((page[start:stop], page[stop:j]))
            at = j + 1
    return out


def test_tags_match_a_plain_reading():
    rng = random.Random(9)
    for _ in range(4000):
        page = "".join(rng.choice(["<", "<", ">", '"', "'", "a", "b ", " ", "/", "</", "<!--", "-->", "<!", "x='", 'y="', "<p>", "</p>"]) for _ in range(rng.randint(0, 24)))
        tags, at, got = html_text.Tags(page), 0, []
        while tag := tags.after(at):
            if tag[3]:
                got.append(tag[3:])
            at = tag[1]
        assert got == plain_tags(page), page


def test_script_follows_all_letters():
    blocks = html_text.text_blocks("<p>" + "abc " * 60 + "</p><p>" + "где " * 200 + "</p>")[0]
    assert html_text.tongue('<html lang="RU">', blocks) == "ru:CYRILLIC"
    assert html_text.tongue("", html_text.text_blocks("<p>12 !?</p>")[0]) == ":"


def test_more_words_than_a_reading_holds(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {(r.page_id, r.text) for r in html_text.extract(pages).collect()}
    monkeypatch.setattr(html_text, "BROADCAST", 50)
    got = html_text.extract(pages).collect()
    assert len(got) == pages.count() and {(r.page_id, r.text) for r in got} == want
