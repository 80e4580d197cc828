"""Main text of web pages, by two passes of rules over blocks.

A page is cut into blocks at block-level tags. What markup names as other than the article (menus, forms,
scripts, adverts, comments) is left out with all that it holds. First pass: of the other blocks, those
with many links are bad, those long enough with enough stop words are good, short ones are undecided, save that
a copyright line is bad. Second pass: undecided blocks take the label of the nearest decided block of
their region (the article, where markup marks one, or the rest). Of the two regions the one with more good
text is the result, the article where they are alike.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docql.llm.common import ship

#: Frequent function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset(
    """the of and to a in is that it for was on with as be by are this at from or an have not but his her they which you were
    der die das und in zu den von mit sich auf für ist im dem nicht ein eine als auch es an er hat aus bei sie nach wie
    de la le et les des en un du une que est pour qui dans par sur au plus pas ce il sont avec se ou son mais
    el los las y del por con una su para al lo como más o pero sus le ha me sin sobre este ya entre cuando
    di che e il per non sono della nel alla più anche dei gli
    do da os em um no na uma com dos ao mais foi são
    het een van op te voor zijn dat niet aan om ook""".split()
)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
LEFT_OUT = frozenset("nav footer aside form head script style noscript template iframe object svg canvas button select textarea dialog menu audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id values that mark what isn't the article.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner
    cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall
    sidebar sidebars side widget widgets related recommended recommendations share sharing social
    menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar masthead topbar header footer footnav
    comment comments commentlist reply replies disqus discussion respond login search skip copyright disclaimer""".split()
)
#: Those of them that count inside the article, too, on paragraphs and headings.
STRONG_MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice newsletter subscribe comment comments reply replies disqus".split())
#: Words of class and id values of what holds the article where no article or main element does.
CONTENT_MARKS = frozenset("article post entry story content main articlebody maincontent bodytext".split())
#: These hold the article, whatever their class says.
HOLDERS = frozenset("html body main article".split())
LINK_DENSITY, LONG, VERY_LONG, STOP_DENSITY, LOW_STOP_DENSITY = 0.5, 70, 200, 0.2, 0.08

ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile(r"""[>"']""")
WORD = re.compile(r"[^\W\d_]+")
COPYRIGHT = re.compile(r"©|\(c\)\s*\d{4}|\bcopyright\b|\ball rights reserved\b", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OPTIONAL_END = frozenset("p li td th tr dd dt option".split())


@dataclass
class Block:
    text: str
    linked: int = 0
    article: bool = False
    heading: bool = False
    label: bool | None = None


def marks_of(raw: str) -> tuple[dict[str, str], set[str]]:
    """Attributes, and the words of class and id."""
    found = {k.lower(): references.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(raw)}
    said = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower()
    return found, set(re.split(r"[^a-z]+", said))


def hidden(tag: str, raw: str, in_article: bool) -> bool:
    if tag in LEFT_OUT:
        return True
    if tag in HOLDERS:
        return False
    if tag == "header" and not in_article:
        return True
    if "=" not in raw and "hidden" not in raw:
        return False
    found, words = marks_of(raw)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    narrow = in_article and (tag in ("p", "header") or tag in HEADINGS)
    return not words.isdisjoint(STRONG_MARKS if narrow else MARKS)


def holds_article(raw: str) -> bool:
    found, words = marks_of(raw)
    return found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody" or not words.isdisjoint(CONTENT_MARKS)


class Scanner:
    """Cuts a page into texts and tags, in time that grows with its length whatever the page holds."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.quotes = True  # whether quoted values may hold >

    def end_of_tag(self, at: int) -> int:
        """The place of the > that ends the tag, -1 where there is none."""
        if at > self.last[">"]:
            return -1
        if not self.quotes:
            return self.page.find(">", at)
        k = at
        while m := STOP.search(self.page, k):
            if m[0] == ">":
                return m.start()
            k = m.end()
            before = m.start() - 1
            while before > at and self.page[before] in " \t\n\r\f":
                before -= 1
            if self.page[before] == "=":  # else a stray quote
                if k > self.last[m[0]]:
                    break
                k = self.page.find(m[0], k) + 1
        # A quote that doesn't end: from here on quotes mean nothing, so that no part is searched time and again.
        self.quotes = False
        return self.page.find(">", at)

    def parts(self) -> Iterator[tuple[str, str, bool, str]]:
        """(text, tag, whether it ends, what else the tag holds), text before the tag; tag is empty for comments and at the end."""
        page, at, said = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            start = at
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                yield page[said:start], "", False, ""
                at = said = end + 3 if end >= 0 else len(page)
                continue
            closing = page.startswith("/", at + 1)
            name = NAME.match(page, at + 1 + closing)
            if not (name or page[at + 1 : at + 2] in ("!", "?")):
                at += 1
                continue
            end = self.end_of_tag(name.end() if name else at + 1)
            if end < 0:
                break
            at = end + 1
            tag = name[0].lower() if name else ""
            yield page[said:start], tag, closing, page[name.end() : end] if name else ""
            said = at
            if tag in RAW and not closing:
                at = said = self.after_raw(tag, at)
        yield page[said:], "", False, ""

    def after_raw(self, tag: str, at: int) -> int:
        close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
        return close.end() if close else len(self.page)


class Open:
    """The elements that are open: blocks, and all that is left out; with counts, so that stray end tags cost nothing."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []  # tag, whether it is left out, whether it is in an article
        self.counts = [Counter()]  # of each holder that is open, and before any
        self.holders: Counter = Counter()

    @property
    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def push(self, tag: str, out_of: bool, inside: bool) -> None:
        self.counts[-1][tag] += 1
        self.stack.append((tag, out_of, inside))
        if tag in HOLDERS:
            self.holders[tag] += 1
            self.counts.append(Counter())

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        if tag in HOLDERS:
            self.holders[tag] -= 1
            self.counts.pop()
        self.counts[-1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """A stray end tag closes nothing beyond the article."""
        if self.counts[-1][tag] or self.holders[tag]:
            while self.pop() != tag:
                pass


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    open_now = Open()
    parts: list[str] = []
    linked: list[str] = []
    link = heading = False
    named = not re.search(r"<(?:article|main)\b", page, re.I)  # whether class and id tell where the article is

    def end() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, sum(len("".join(x.split())) for x in linked), open_now.state[1], heading))
        parts.clear()
        linked.clear()

    for text, tag, closing, raw in Scanner(page).parts():
        if text and not open_now.state[0]:
            parts.append(references.unescape(text))
            if link:
                linked.append(parts[-1])
        if tag in BLOCKS:
            end()
            link = link and tag == "li" and closing
            heading = tag in HEADINGS and not closing
        elif tag == "br":
            parts.append(" ")
        if closing:
            link = link and tag != "a"
            open_now.close(tag)
            continue
        if tag == "a":
            link = True
        if not tag or tag in RAW or tag in VOID or raw.endswith("/"):
            continue
        if tag in OPTIONAL_END and open_now.stack and open_now.stack[-1][0] == tag:
            open_now.pop()
        out_of, inside = open_now.state
        out_of = out_of or hidden(tag, raw, inside)
        if not out_of:
            inside = inside or tag in ("article", "main") or named and tag in ("div", "section", "td") and "=" in raw and holds_article(raw)
        if out_of or tag in BLOCKS:
            open_now.push(tag, out_of, inside)
    end()
    return out


def first_pass(blocks: list[Block]) -> None:
    """Labels by length, links and stop words; short blocks stay undecided.

    A page whose texts of some length have next to no stop word is in a language without a list here: length and links
    decide there.
    """
    sizes = [len(b.text) for b in blocks]
    counts = []
    for b in blocks:
        words = WORD.findall(b.text.lower())
        counts.append((sum(w in STOP_WORDS for w in words), len(words)))
    texts = [c for b, size, c in zip(blocks, sizes, counts, strict=True) if size >= LONG and 2 * b.linked <= size]
    foreign = sum(c[0] for c in texts) < LOW_STOP_DENSITY * sum(c[1] for c in texts)
    for b, size, (stops, words) in zip(blocks, sizes, counts, strict=True):
        density = stops / words if words else 0.0
        if b.linked > LINK_DENSITY * len(b.text.replace(" ", "")) or (size < VERY_LONG and not b.article and COPYRIGHT.search(b.text)):
            b.label = False
        elif size >= LONG and (foreign or density >= STOP_DENSITY) or size >= VERY_LONG and density >= LOW_STOP_DENSITY:
            b.label = True
        elif size >= VERY_LONG and not b.article:
            b.label = False


def nearest(blocks: list[Block], labels: list[bool | None]) -> list[tuple[int, bool] | None]:
    """For each block the distance and label of the nearest decided one before it."""
    out, seen = [], None
    for i, label in enumerate(labels):
        out.append(seen and (i - seen[0], seen[1]))
        if label is not None:
            seen = (i, label)
    return out


def second_pass(blocks: list[Block]) -> None:
    """Undecided blocks inherit from the nearest decided one on either side; of two as near a good one counts.

    A heading goes with what it heads: it is good if a good block comes before the next heading. Where nothing is
    decided, all is good.
    """
    first = [b.label for b in blocks]
    before = nearest(blocks, first)
    after = nearest(blocks, first[::-1])[::-1]
    heads = False
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if b.label is None:
            sides = [x for x in (before[i], after[i]) if x]
            gap = min((x[0] for x in sides), default=0)
            b.label = b.heading and heads or any(x[1] for x in sides if x[0] == gap) or not sides
        heads = first[i] is True or heads and not b.heading


def classify(blocks: list[Block]) -> None:
    """Both passes, over what markup names as the article and over the rest apart; the rest counts only where it has more good text."""
    first_pass(blocks)
    article, rest = ([b for b in blocks if b.article is inside] for inside in (True, False))
    size = [sum(len(b.text) for b in part if b.label) for part in (article, rest)]
    second_pass(article)
    second_pass(rest)
    if article:
        for b in rest if size[0] >= size[1] else article:
            b.label = False


def main_text(page: str | None) -> str:
    """The good blocks in page order, joined by one space; empty where there are none."""
    blocks = blocks_of(page or "")
    classify(blocks)
    return " ".join(b.text for b in blocks if b.label)


SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame) -> DataFrame:
    """Per input row: page_id, url, text, n_chars (code points).

    Null and empty pages have an empty text. Rows are neither merged nor dropped; other columns are not
    looked at. Broken markup is read as far as it goes: unended tags, quotes and comments end with the page.
    """
    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=SCHEMA.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
