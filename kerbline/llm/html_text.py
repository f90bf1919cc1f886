"""Main text of web pages by two-pass block rules.

Pass one judges each block alone, by its length, link density and stop-word density: good, bad,
nearly good, or short. Pass two settles the rest from the nearest decided blocks on both sides.
All blocks of a page are judged. An article element that holds a good block stands in for a good
neighbour at its ends, and keeps what is undecided beside a good neighbour; one without, such as a
teaser, changes nothing unless the page has no good block at all. Navigation, page heads and feet,
asides, forms, adverts, notices and comments never count. A form or a part known by a class name
counts after all if it holds an article element or most of the good text of the page.

Stop words are the fixed lists and, for each language and script, the words that make up at least
one in ``RARE`` of the words of long blocks without links, counted over all pages.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, settle
from .common import cut_batches

SLICE = 4 << 20
SHORT, LONG = 70, 200  # characters
LINKS, STOP_LOW, STOP_HIGH = 0.33, 0.15, 0.30  # shares of characters and of words

RARE = 1000  # at most so many stop words for a language and script
ENOUGH = 2000  # words of a language and script from which its stop words are learned
HELD = 200_000  # distinct words a task counts before it hands them on
BROADCAST = 500_000  # most stop words that a reading of the pages holds; more take further readings
REMEMBERED = 20_000  # names of elements whose verdict a worker keeps
LISTED = ("", "en", "fr", "de", "es")

# Fixed word lists: the most frequent function words of the languages.
STOP_WORDS = frozenset(
    (
        "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so what up said its about than into them can only other time new some could these two may then do first any my now such like our over man me even most made after also did many off before must well back through years much where your way down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year come since against go came right used take three "
        "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou cette mais on aux comme son elle ont ses nous vous leur même sans deux été fait tout aussi être peut lui ces dont sa si entre où très bien encore "
        "der die und den von zu das mit sich ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei "
        "el los las del y por con una para su al lo como más pero sus le ya este sí porque esta cuando muy sin sobre ser tiene también me hasta hay donde quien desde todo nos durante uno ni contra otros ese eso ante ellos e esto mí antes algunos unos yo otro"
    ).split()
)

# Fixed names of elements.
RAW = ("script", "style", "textarea", "title", "template", "noscript", "iframe", "svg", "math", "xmp", "noembed", "noframes")
NEVER = frozenset((*RAW, "head", "nav", "aside", "button", "select", "option", "label", "dialog", "menu", "object", "audio", "video", "canvas", "footer"))
WRAPPERS = frozenset(("form", "fieldset"))  # parts too, but some pages lie in one as a whole
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr rp rt ruby nobr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Class names and ids that mark a part which is not article: such words alone or joined to each other,
#: to numbers and to words of place and form. ``has-sidebar`` or ``with-comments`` say something else.
WORDS = r"(?:ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|foot|masthead|topbar|header|comments?|commentlist|respond|reply|replies|disqus|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|social|share|sharing|related|recommended|widget|toolbar|pagination|pager|copyright|disclaimer|skip|hidden)"
PLACES = r"(?:site|page|main|global|top|bottom|left|right|upper|lower|primary|secondary|tertiary|first|last|inner|outer|wrap|wrapper|container|box|block|area|section|bar|list|item|items|row|col|column|link|links|slot|unit|buttons?|icons?|group|panel|body|content|text|form|title|area|message|js|\d+)"
PARTS = re.compile(rf"(?:{PLACES}[_-]+)*{WORDS}(?:[_-]+(?:{WORDS}|{PLACES}))*", re.I)
COMMENTS = re.compile(r"comment|respond|repl(?:y|ies)|disqus", re.I)
#: A tag without a further angle bracket in it, which nearly all are; no match looks beyond the next bracket.
PLAIN_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/<>"']*+)(?=[\s/>])((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
#: The same, comments and declarations, for pages where no "<" stands in the text.
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|{PLAIN_TAG.pattern}|<[!?][^<>]*+>", re.S)
NAME_END, TAG_MARK = re.compile(r"[\s/>]"), re.compile(r"""[>"']""")
OF_INTEREST = re.compile(r"class|id|style|role|hidden", re.I)  # attributes that decide something
ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])", re.I)
LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})(?![A-Za-z])""", re.I)
#: Scripts without spaces between words count each letter as a word, and as so many letters of others.
DENSE, DENSE_LENGTH = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff", 3
DENSE_LETTER = re.compile(f"[{DENSE}]")
ASCII_WORD = re.compile("[a-z]+(?:'[a-z]+)?")
NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
WORD = re.compile(rf"[{DENSE}]|[^\W\d_{DENSE}]+(?:['’][^\W\d_{DENSE}]+)?")
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"))


class Part:
    """A container that its name marks as no article, and the one around it."""

    __slots__ = ("comments", "spared", "parent", "around", "good", "clear")

    def __init__(self, comments: bool) -> None:
        self.comments, self.spared, self.parent = comments, False, None
        self.around = False  # holds an article element
        self.good, self.clear = 0, False


class Article:
    """An article element, and the one around it."""

    __slots__ = ("parent", "trusted")

    def __init__(self, parent: "Article | None") -> None:
        self.parent, self.trusted = parent, False


class Block:
    __slots__ = ("parts", "links", "article", "never", "named", "heading")

    def __init__(self, article: Article | None, never: bool, named: Part | None, heading: bool) -> None:
        self.parts, self.links, self.article, self.never, self.named, self.heading = [], [], article, never, named, heading


KEEP, NEVER_COUNTS, IS_PART, IS_COMMENTS = range(4)
_verdicts: dict[tuple[str, str, bool], int] = {}


def unwanted(name: str, attrs: str, in_article: bool) -> int:
    """Whether an element never counts, is a part by its name, or a part of comments."""
    if name in NEVER:
        return NEVER_COUNTS
    wrapper = name in WRAPPERS or name == "header" and not in_article
    if not attrs or not OF_INTEREST.search(attrs):
        return IS_PART if wrapper else KEEP
    key = (name, attrs, in_article)
    known = _verdicts.get(key)
    if known is None:
        if len(_verdicts) >= REMEMBERED:
            _verdicts.clear()
        known = _verdicts[key] = _judged(name, attrs, wrapper)
    return known


def _judged(name: str, attrs: str, wrapper: bool) -> int:
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attrs)}
    bare = re.sub(r"""("[^"]*"|'[^']*')""", "", attrs)
    if HIDDEN.search(bare) or UNSEEN.search(found.get("style", "")) or found.get("aria-hidden", "").lower() == "true":
        return NEVER_COUNTS
    role = found.get("role", "").lower()
    if role in ROLES and role != "form":
        return NEVER_COUNTS
    names = f"{found.get('class', '')} {found.get('id', '')}"
    comments = any(COMMENTS.search(x) and marked(x) for x in names.split())
    if name == "article":
        teaser = re.search("comment|reply|related|promo|teaser", found.get("class", ""), re.I) is not None
        return NEVER_COUNTS if teaser and marked(found.get("class", "")) else KEEP
    if wrapper or role == "form" or name not in ("html", "body", "main") and marked(names):
        return NEVER_COUNTS if name in INLINE else IS_COMMENTS if comments else IS_PART
    return KEEP


def marked(names: str) -> bool:
    return any(PARTS.fullmatch(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", x)) for x in names.split())


class Tags:
    """The tags of a page, first to last: ``(start, end, closing, name, attributes)``.

    A tag ends at the first ``>`` outside quotes; where there is none its ``<`` is text. The time is
    linear in the page whatever its markup: positions that were found are kept, and a quote from
    which no tag can end is looked at once.
    """

    def __init__(self, page: str) -> None:
        self.page, self.size = page, len(page)
        self.plain = PLAIN_TAG.search(page)
        self.name_end = self.mark = -1
        self.closes: dict[int, int] = {}  # quote that opens outside quotes -> end of its tag, -1 if none
        self.lasts = {q: page.rfind(q) for q in ">\"'"}

    def _next(self, pattern: re.Pattern, known: int, at: int) -> int:
        if known >= at:
            return known
        m = pattern.search(self.page, at)
        return m.start() if m else self.size

    def _end(self, at: int) -> int:
        """Place behind the ``>`` that ends a tag whose attributes start here, or -1."""
        page, seen = self.page, []
        while True:
            if seen:
                m = TAG_MARK.search(page, at)
                k = m.start() if m else self.size
            else:  # also what the next "<" meets first, if it lies before
                k = self.mark = self._next(TAG_MARK, self.mark, at)
            if k >= self.size:
                end = -1
                break
            if page[k] == ">":
                end = k + 1
                break
            if k in self.closes:
                end = self.closes[k]
                break
            seen.append(k)
            close = page.find(page[k], k + 1) if self.lasts[page[k]] > k else -1
            if close < 0:
                end = -1
                break
            at = close + 1
        for k in seen:
            self.closes[k] = end
        return end

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """The first tag, comment or declaration from ``at`` on."""
        page = self.page
        while True:
            m = self.plain
            if m is not None and m.start() < at:
                m = self.plain = PLAIN_TAG.search(page, at)
            k = page.find("<", at)
            if k < 0:
                return None
            if m is not None and m.start() == k:
                return k, m.end(), m[1], m[2], m[3]
            odd = page[k + 1 : k + 2]
            if odd == "!" or odd == "?":
                if page.startswith("<!--", k):
                    end = page.find("-->", k + 4)
                    return k, end + 3 if end >= 0 else self.size, "", "", ""
                end = page.find(">", k) if self.lasts[">"] > k else -1
                if end >= 0:
                    return k, end + 1, "", "", ""
            else:
                start = k + 1 + (odd == "/")
                first = page[start : start + 1]
                if first.isascii() and first.isalpha():
                    self.name_end = self._next(NAME_END, self.name_end, start)
                    if self.name_end < self.size:
                        end = self._end(self.name_end)
                        if end >= 0:
                            return k, end, odd if odd == "/" else "", page[start : self.name_end], page[self.name_end : end - 1]
            at = k + 1


def blocks_of(page: str) -> tuple[list[Block], list[Part]]:
    """Runs of text between block elements with what surrounds them, and all marked parts, an outer
    one before those in it."""
    stack: list[tuple[str, Article | None, bool, bool, Part | None]] = []  # name, article, never, in link, part
    opened: dict[str, int] = defaultdict(int)  # elements of each name on the stack
    article: Article | None = None
    named: Part | None = None
    never = link = heading = False
    out: list[Block] = []
    parts: list[Part] = []
    block, at, size, token, tags = Block(None, False, None, False), 0, len(page), TOKEN.search, None

    def close_from(depth: int) -> None:
        nonlocal article, never, link, named
        for k in range(len(stack) - 1, depth - 1, -1):
            opened[stack[k][0]] -= 1
        del stack[depth:]
        article, never, link, named = stack[-1][1:] if stack else (None, False, False, None)

    def last_of(name: str) -> int:
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)

    while at < size:
        if tags is None:
            m = token(page, at)
            start = m.start() if m else size
            if page.find("<", at, start) >= 0:  # a "<" in the text or a tag with brackets in its quotes
                tags = Tags(page)
        if tags is not None:
            tag = tags.after(at)
            start, end, closing, name, attrs = tag or (size, size, "", "", "")
        elif m:
            end = m.end()
            closing, name, attrs = m.groups()
        else:
            end, name = size, ""
        if start > at and not never:
            text = page[at:start]
            block.parts.append(text)
            if link:
                block.links.append(text)
        at = end
        if not name:
            continue
        name = name.lower()
        inline = name in INLINE
        if name == "br" and not never:
            block.parts.append(" ")
        if closing:
            if not inline and block.parts:
                out.append(block)
            if opened[name]:
                close_from(len(stack) - 1 if stack[-1][0] == name else last_of(name))
            if not inline:
                heading = False
                block = Block(article, never, named, heading)
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            if name in ("script", "style", "title", "textarea", "xmp") or end:
                close = page.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else size
            continue
        if not inline and block.parts:
            out.append(block)
        if name in VOID:
            if not inline:
                block = Block(article, never, named, heading)
            continue
        if not inline:
            if opened["p"] and name in CLOSES_P:
                close_from(last_of("p"))
            if name in ("li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
                close_from(len(stack) - 1)
        if attrs.endswith("/"):
            if not inline:
                block = Block(article, never, named, heading)
            continue
        verdict = NEVER_COUNTS if never else unwanted(name, attrs, article is not None)
        is_article = name in ("article", "main")
        inside = Article(article) if is_article and not never else article
        if is_article and verdict == KEEP:
            p = named
            while p is not None and not p.around:  # those around a marked one are marked
                p.around = True
                p.spared = not p.comments
                p = p.parent
        if verdict >= IS_PART:
            part = Part(verdict == IS_COMMENTS)
            part.parent, named = named, part
            parts.append(part)
        stack.append((name, inside, verdict == NEVER_COUNTS, link or name == "a", named))
        opened[name] += 1
        article, never, link, named = stack[-1][1:]
        if not inline:
            heading = len(name) == 2 and name[0] == "h" and name[1] in "123456"
            block = Block(article, never, named, heading)
    if block.parts:
        out.append(block)
    return out, parts


def clear_parts(parts: list[Part]) -> None:
    """Marks the parts that are spared like all parts around them."""
    for p in parts:
        p.clear = p.spared and (p.parent is None or p.parent.clear)


def clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def length(text: str) -> int:
    return len(text) if text.isascii() else len(text) + (DENSE_LENGTH - 1) * len(DENSE_LETTER.findall(text))


def judge(text: str, links: int, heading: bool, stop: frozenset[str] | set[str] | None = STOP_WORDS) -> str:
    """Pass one: ``good``, ``bad``, ``near`` (nearly good), ``low`` (few stop words) or ``short``.

    Where no stop words are known, length and links decide alone.
    """
    if links > LINKS * len(text):
        return "bad"
    size = length(text)
    if size < SHORT or heading:
        return "short"
    words = words_of(text)
    density = 1.0 if stop is None and words else sum(map((stop or frozenset()).__contains__, words)) / max(len(words), 1)
    if density >= STOP_HIGH:
        return "good" if size > LONG else "near"
    return "near" if density >= STOP_LOW else "low"


def settle_blocks(labels: list[str], headings: list[bool], articles: list[int]) -> list[bool]:
    """Pass two: undecided blocks take the label of the nearest decided ones on both sides.

    Where the two differ the block is good if it is nearly good, or a heading of what follows.
    Beyond both ends of the page is bad. ``articles`` numbers the article with a good block a
    block is in, else 0: its ends are good, a block in it of few stop words is undecided too, and
    one good side is enough. Beside such an article other blocks need two good sides.
    """

    def nearest(order: Iterator[tuple[str, int]]) -> list[bool]:
        out, last, inside = [], False, 0
        for label, a in order:
            if a != inside:
                last, inside = bool(a) or last, a
            out.append(last)
            last = {"good": True, "bad": False}.get(label, last if a or label != "low" else False)
        return out

    before = nearest(zip(labels, articles))
    after = nearest(zip(reversed(labels), reversed(articles)))[::-1]
    beside = any(articles)

    def kept(label: str, heading: bool, article: int, a: bool, b: bool) -> bool:
        if label in ("good", "bad") or label == "low" and not article:
            return label == "good"
        return a and b or (a or b) and (bool(article) or label == "near" and not beside) or b and heading

    return [kept(*x) for x in zip(labels, headings, articles, before, after)]


def text_blocks(page: str | None) -> tuple[list[tuple[Block, str]], list[Part]]:
    blocks, parts = blocks_of(page or "")
    return [(b, t) for b in blocks if not b.never and (t := clean(b.parts))], parts


_scripts: dict[str, str] = {}


def script_of(letter: str) -> str:
    known = _scripts.get(letter)
    if known is None:
        known = _scripts[letter] = unicodedata.name(letter, "?").split()[0] if letter.isalpha() else ""
    return known


def tongue(page: str | None, blocks: list[tuple[Block, str]]) -> str:
    """Language a page names and the script of most of its letters."""
    text = "".join([t for _, t in blocks])
    scripts: Counter[str] = Counter()
    scripts["LATIN"] = len(text.encode("ascii", "ignore").translate(None, NO_LETTERS))
    if not text.isascii():
        for letter, n in Counter(BEYOND_ASCII.findall(text)).items():
            scripts[script_of(letter)] += n
    named = LANG.search(page or "")
    found = [k for k, n in scripts.items() if k and n]
    return f"{named[1].lower() if named else ''}:{min(found, key=lambda k: (-scripts[k], k)) if found else ''}"


def words_of(text: str) -> list[str]:
    low = text.lower()
    return (ASCII_WORD if low.isascii() else WORD).findall(low)


def stop_words(key: str, learned: dict[str, set[str]]) -> frozenset[str] | set[str] | None:
    lang, script = key.split(":")
    fixed = STOP_WORDS if script in ("LATIN", "") and lang in LISTED else frozenset()
    return (fixed | learned.get(key, set())) or None


def spare(blocks: list[tuple[Block, str]], labels: list[str], parts: list[Part]) -> None:
    """Spares the parts that hold most of the good text; of comments all of it."""
    total = 0
    for (b, t), label in zip(blocks, labels):
        if label == "good":
            total += len(t)
            if b.named is not None:
                b.named.good += len(t)
    for p in reversed(parts):  # an inner part before those around it
        if p.parent is not None:
            p.parent.good += p.good
        if p.good:
            p.spared = p.spared or (p.good == total if p.comments else 2 * p.good > total)


def is_left(block: Block) -> bool:
    return block.named is None or block.named.clear


def main_text(page: str | None, learned: dict[str, set[str]] | None = None) -> str:
    blocks, parts = text_blocks(page)
    return text_of(blocks, parts, stop_words(tongue(page, blocks), learned or {}))


def text_of(blocks: list[tuple[Block, str]], parts: list[Part], stop: frozenset[str] | set[str] | None) -> str:
    labels = [judge(t, len(clean(b.links)) if b.links else 0, b.heading, stop) for b, t in blocks]
    spare(blocks, labels, parts)
    clear_parts(parts)
    left = [k for k, (b, _) in enumerate(blocks) if is_left(b)]
    blocks, labels = [blocks[k] for k in left], [labels[k] for k in left]
    some = "good" in labels
    for (b, _), label in zip(blocks, labels):
        if label == "good" or not some:
            a = b.article
            while a is not None and not a.trusted:  # those around a trusted one are trusted
                a.trusted, a = True, a.parent
    numbers: dict[Article, int] = {}
    articles = [numbers.setdefault(b.article, len(numbers) + 1) if b.article is not None and b.article.trusted else 0 for b, _ in blocks]
    kept = settle_blocks(labels, [b.heading for b, _ in blocks], articles)
    return "\n".join(t for (_, t), good in zip(blocks, kept) if good)


def share(tongue: Column, readings: int) -> Column:
    """The reading of the pages that a language and script belongs to."""
    return F.crc32(tongue.cast("binary")) % readings


def count_words(page: str | None, held: dict[str, Counter[str]]) -> None:
    """Words of a page's long blocks without links, under its language and script."""
    blocks, parts = text_blocks(page)
    words = held[tongue(page, blocks)]
    clear_parts(parts)
    for b, t in blocks:
        if not b.heading and is_left(b) and length(t) >= SHORT and (not b.links or len(clean(b.links)) <= LINKS * len(t)):
            words.update(words_of(t))


def word_counts(pages: DataFrame) -> DataFrame:
    """``tongue, word, n, least``: the words that are frequent enough to be stop words, at most
    ``RARE`` for each language and script with ``ENOUGH`` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            flat = [(k, w, n) for k, words in held.items() for w, n in words.items()]
            tongues, words, n = zip(*flat) if flat else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(tongues, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["tongue", "word", "n"])

        held: dict[str, Counter[str]] = defaultdict(Counter)
        for batch in cut_batches(batches, SLICE, "html"):
            for page in batch.column("html").to_pylist():
                count_words(page, held)
            if sum(map(len, held.values())) > HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    each = pages.select("html").mapInArrow(count, "tongue string, word string, n long")
    counts = settle(each.groupBy("tongue", "word").agg(F.sum("n").alias("n")), "page-words")
    least = counts.groupBy("tongue").agg(F.sum("n").alias("all")).filter(F.col("all") >= ENOUGH)
    stop = counts.join(least, "tongue").filter(F.col("n") * RARE >= F.col("all")).select("tongue", "word")
    kept = settle(stop, "stop-words")
    discard(counts)
    return kept


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null or empty page, and one without main text, has an empty text. Broken markup is read
    as far as it goes, in time linear in the page. Repeated rows repeat; an empty table gives no
    rows. The pages are read twice, first for the stop words. A worker holds at most ``BROADCAST``
    of these; where there are more, each further reading settles the pages of some languages and
    scripts.
    """
    asked = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    stop = word_counts(asked)
    readings = max(1, -(-stop.count() // BROADCAST))

    def reading(k: int) -> DataFrame:
        learned: dict[str, set[str]] = {}
        for r in stop.filter(share(F.col("tongue"), readings) == k).collect():
            learned.setdefault(r.tongue, set()).add(r.word)
        model = df.sparkSession.sparkContext.broadcast(learned)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in cut_batches(batches, SLICE, "html"):
                texts, rows = [], []
                for row, page in enumerate(batch.column("html").to_pylist()):
                    blocks, parts = text_blocks(page)
                    key = tongue(page, blocks)
                    if zlib.crc32(key.encode()) % readings == k:
                        texts.append(text_of(blocks, parts, stop_words(key, model.value)))
                        rows.append(row)
                own = batch if len(rows) == batch.num_rows else batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([own.column("page_id"), own.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return asked.mapInArrow(run, "page_id long, url string, text string, n_chars long")

    return reduce(DataFrame.unionByName, map(reading, range(readings)))
