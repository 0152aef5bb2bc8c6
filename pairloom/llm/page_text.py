"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks, the runs of text between tags of block elements, each with the open elements around it.
A block's features tell its innermost element, the kinds of elements and the words in their class and id around
it, and how its text looks (length, share of links, punctuation, first signs). The field has two labels, main text and
the rest; neighbouring labels weigh on each other, and Viterbi's path decides for all blocks of a page together.

Labelled pages for training are made from a bounded sample of the corpus (``LEARN_PAGES`` pages of at most
``LEARN_CHARS`` signs, those with the least hash): pages whose markup names its article are labelled by that markup, and
their texts are set again into layouts with and without such markup, among menus, headers, sidebars, notices,
adverts, forms, reader comments and footers, whose labels are known because they were put there.

Markup is scanned once from left to right: where a tag that starts at any place would end is known beforehand, so pages
full of open quotes or open tags cost no more than others of their size.

Defined results: a null or empty page has an empty text; comments, scripts and the like that are never closed end with
the page; a tag that is never closed, or whose quotes are not, is text; comments end as browsers end them (``-->``,
``--!>``, ``<!-->``, ``<!--->``); rows are kept one by one, repeated ids included; extra columns are left out unless
named in ``keep``.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.pieces import blocks as byte_blocks

LEARN_PAGES = 200
LEARN_CHARS = 100_000
BLOCK = 1 << 20  # bytes of pages held as Python's strings together
EPOCHS = 8
SEED = 11
REST, MAIN = 0, 1

COMMENT_END = re.compile(r"--!?>")
# Elements whose content is no text of the page.
SKIPPED = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style template textarea svg iframe".split()}
NAME_END = re.compile(r"[\s/>]|\Z")
SIGNS = re.compile(r"[>\"']")
MARK = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
NAME = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
SECTIONS = frozenset("article main nav header footer aside form head menu dialog table figure".split())
CLOSES_P = frozenset(
    "address article aside blockquote dir div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul".split()
)
ROOTS = frozenset(["html", "body"])
NAMED = frozenset(["article", "main"])


class Block(NamedTuple):
    text: str
    tags: tuple[str, ...]  # open elements, outermost first
    marks: tuple[str, ...]  # words of their class, id and role, without html's and body's
    linked: int  # signs of the text inside links
    inner: tuple[tuple[str, tuple[str, ...]], ...] = ()  # elements from the outermost article or main on, and their words


class Tag(NamedTuple):
    start: int
    end: int
    name: str | None = None  # None: markup that opens and closes nothing
    closing: bool = False
    attributes: str = ""


def tags(page: str) -> Iterator[Tag]:
    """Markup of a page in order: tags, and comments, declarations and skipped elements as tags without a name."""
    signs = [match.start() for match in SIGNS.finditer(page)]
    # ends[k]: end of a tag that reaches signs[k] outside quotes, -1 if it has none; from the back, as quotes look ahead.
    ends, later = [-1] * (len(signs) + 1), {"'": -1, '"': -1}
    for k in range(len(signs) - 1, -1, -1):
        sign = page[signs[k]]
        if sign == ">":
            ends[k] = signs[k] + 1
        else:
            ends[k] = ends[later[sign] + 1] if later[sign] >= 0 else -1
            later[sign] = k
    last = page.rfind(">")
    at, name_end = page.find("<"), 0
    while 0 <= at < last or (at >= 0 and page.startswith("<!--", at)):
        found, sign = None, page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            near = ">" if page.startswith(">", at + 4) else "->" if page.startswith("->", at + 4) else ""
            close = None if near else COMMENT_END.search(page, at + 4)
            found = Tag(at, at + 4 + len(near) if near else close.end() if close else len(page))
        elif sign in ("!", "?"):
            found = Tag(at, page.find(">", at) + 1)
        else:
            closing = sign == "/"
            begin = at + 1 + closing
            if page[begin : begin + 1].isascii() and page[begin : begin + 1].isalpha():
                if name_end <= begin:
                    name_end = NAME_END.search(page, begin).start()
                end = ends[bisect_left(signs, name_end)]
                if end >= 0:
                    name = page[begin:name_end].lower()
                    found = Tag(at, end, name, closing, page[name_end : end - 1])
                    if not closing and name in SKIPPED and not (name == "svg" and page[end - 2] == "/"):
                        close = SKIPPED[name].search(page, end)
                        found = Tag(at, close.end() if close else len(page))
                    elif not closing and name == "svg":
                        found = Tag(at, end)
        if found:
            yield found
        at = page.find("<", found.end if found else at + 1)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, white space as one space, character references decoded."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()  # open elements by name, so that a name without any is not looked for
    parts: list[tuple[str, bool]] = []
    links = 0

    def close_block():
        nonlocal parts
        if parts:
            text = " ".join(html.unescape("".join(part for part, _ in parts)).split())
            if text:
                linked = sum(len(part) for part, in_link in parts if in_link)
                around = [(tag, own) for tag, own in stack if tag not in ROOTS]
                tags = tuple(tag for tag, _ in around)
                named = next((i for i, tag in enumerate(tags) if tag in NAMED), len(tags))
                marks = tuple(mark for _, own in around for mark in own)
                found.append(Block(text, tags, marks, linked, tuple(around[named:])))
            parts = []

    def drop(index: int):
        nonlocal links
        for tag, _ in stack[index:]:
            opened[tag] -= 1
            links -= tag == "a"
        del stack[index:]

    at = 0
    for start, end, tag, closing, attributes in tags(page):
        if start > at:
            parts.append((page[at:start], links > 0))
        at = end
        if tag is None:
            continue
        if tag not in INLINE:
            close_block()
        if closing:
            for index in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[index][0] == tag:
                    drop(index)
                    break
                if tag in INLINE and stack[index][0] not in INLINE:
                    break
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = ("p",) if tag in CLOSES_P else (tag,)
            for index in range(len(stack) - 1, -1, -1) if any(opened[name] for name in same) else ():
                if stack[index][0] in same:
                    drop(index)
                    break
                if stack[index][0] not in INLINE:
                    break
        if tag in VOID:
            continue
        marks = tuple(
            word for _, value in MARK.findall(attributes) for word in NAME.findall(value.lower())
        ) if attributes else ()
        stack.append((tag, marks))
        opened[tag] += 1
        links += tag == "a"
    if at < len(page):
        parts.append((page[at:], links > 0))
    close_block()
    return found


def features(block: Block, before: Block | None, after: Block | None) -> list[str]:
    text, tags = block.text, block.tags
    inner = next((tag for tag in reversed(tags) if tag not in INLINE), "")
    share = min(1.0, block.linked / len(text))
    words = text.count(" ") + 1
    out = [
        "any",
        f"in={inner}",
        f"words={min(int(math.log2(words)), 7)}",
        f"links={0 if share == 0 else 1 if share < 0.5 else 2}",
        f"stop={text[-1] in '.!?…。'}",
        f"sign={text[0] in '©®»›•|+'}",
        f"commas={min(text.count(','), 3)}",
        f"first={before is None}",
        f"last={after is None}",
    ]
    sections = {tag for tag in tags if tag in SECTIONS}
    out += [f"within={tag}" for tag in sections]
    if not sections:
        out.append("within=none")
    out += [f"mark={mark}" for mark in set(block.marks)]
    if before is not None:
        out.append(f"same={before.tags == tags}")
    if not sections and not block.marks:
        out.append(f"bare={inner}:{min(int(math.log2(words)), 7)}")
    return out


def page_features(found: list[Block]) -> list[list[str]]:
    around = [None, *found, None]
    return [features(block, around[i], around[i + 2]) for i, block in enumerate(found)]


class Field:
    """Weights (main text against the rest) of features and of neighbouring labels."""

    def __init__(self, weights: dict[str, float] | None = None, steps: list[float] | None = None):
        self.weights = weights or {}
        self.steps = steps or [0.0, 0.0, 0.0, 0.0]  # from rest to rest, rest to main, main to rest, main to main

    def levels(self, rows: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(name, 0.0) for name in row) for row in rows]

    def path(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        if not rows:
            return []
        rr, rm, mr, mm = self.steps
        rest, main, back = 0.0, 0.0, []
        for i, level in enumerate(self.levels(rows)):
            if i == 0:
                main = level
                continue
            to_rest = (rest + rr, REST) if rest + rr >= main + mr else (main + mr, MAIN)
            to_main = (main + mm, MAIN) if main + mm >= rest + rm else (rest + rm, REST)
            back.append((to_rest[1], to_main[1]))
            rest, main = to_rest[0], to_main[0] + level
        labels = [MAIN if main > rest else REST]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def marginals(self, rows: list[list[str]]) -> tuple[list[float], list[list[float]]]:
        """How likely each block is main text, and each pair of neighbouring labels."""
        levels = [max(-30.0, min(30.0, level)) for level in self.levels(rows)]
        weights = [math.exp(level) for level in levels]
        rr, rm, mr, mm = (math.exp(step) for step in self.steps)
        forward = [_scaled(1.0, weights[0])]
        for w in weights[1:]:
            rest, main = forward[-1]
            forward.append(_scaled(rest * rr + main * mr, (rest * rm + main * mm) * w))
        backward = [(0.5, 0.5)]
        for w in reversed(weights[1:]):
            rest, main = backward[-1]
            backward.append(_scaled(rr * rest + rm * w * main, mr * rest + mm * w * main))
        backward.reverse()
        single = [_scaled(f[0] * b[0], f[1] * b[1])[1] for f, b in zip(forward, backward)]
        pairs = []
        for i, w in enumerate(weights[1:]):
            (rest, main), (out_rest, out_main) = forward[i], backward[i + 1]
            four = [rest * rr * out_rest, rest * rm * w * out_main, main * mr * out_rest, main * mm * w * out_main]
            total = sum(four)
            pairs.append([x / total for x in four])
        return single, pairs

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, seed: int = SEED) -> Field:
        """Adaptive gradient steps on the likelihood of the labels, page by page."""
        order, chance = list(range(len(pages))), random.Random(seed)
        seen: dict[str, float] = {}
        seen_steps = [1e-6] * 4
        for _ in range(epochs):
            chance.shuffle(order)
            for rows, labels in (pages[i] for i in order):
                if not rows:
                    continue
                single, pairs = self.marginals(rows)
                slope: dict[str, float] = {}
                for row, label, p in zip(rows, labels, single):
                    for name in row:
                        slope[name] = slope.get(name, 0.0) + label - p
                for name, g in slope.items():
                    g -= 0.002 * self.weights.get(name, 0.0)
                    seen[name] = seen.get(name, 1e-6) + g * g
                    self.weights[name] = self.weights.get(name, 0.0) + 0.3 * g / math.sqrt(seen[name])
                for k in range(4):
                    real = sum(2 * a + b == k for a, b in zip(labels, labels[1:]))
                    g = real - sum(four[k] for four in pairs) - 0.002 * self.steps[k]
                    seen_steps[k] += g * g
                    self.steps[k] += 0.3 * g / math.sqrt(seen_steps[k])
        return self

    def main_text(self, page: str) -> str:
        found = blocks(page)
        labels = self.path(page_features(found))
        return " ".join(block.text for block, label in zip(found, labels) if label == MAIN)


def _scaled(rest: float, main: float) -> tuple[float, float]:
    total = rest + main
    return rest / total, main / total


# ---- Labelled pages ---------------------------------------------------------------------------------------------

APART = frozenset("nav header footer aside form menu dialog head".split())
APART_MARKS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies footer menu modal nav navbar navigation newsletter notice pager pagination popup "
    "promo promotion recommended related reply respond share sharing sidebar social sponsor sponsored subscribe "
    "subscription widget".split()
)


def labelled_by_markup(page: str) -> tuple[list[Block], list[int]] | None:
    """Blocks and labels of a page whose article is named by its markup, else None.

    Names of adverts, comments and the like count on elements inside the article or main, not on these themselves (a
    post may be called comments-open) nor around them. Comments may be articles inside main, so all below the outermost
    one is judged; where that leaves nothing (a wrapper called with-sidebar), only what is below the innermost one.
    """
    found = blocks(page)

    def is_main(block: Block, innermost: bool) -> bool:
        if not block.inner or APART & set(block.tags):
            return False
        last = max(i for i, (tag, _) in enumerate(block.inner) if tag in NAMED)
        below = block.inner[last:] if innermost else block.inner
        return not any(tag not in NAMED and APART_MARKS & set(own) for tag, own in below)

    for innermost in (False, True):
        labels = [int(is_main(block, innermost)) for block in found]
        if MAIN in labels:
            return found, labels
    return None


MAIN_SIGN = "\u0001"
WRAPS = (
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
    ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post-body entry">', "</div>"),
    ('<section class="article-body">', "</section>"), ('<div class="story">', "</div>"), ("<div>", "</div>"),
)


class Layouts:
    """Sets given texts into pages with known labels."""

    def __init__(self, paragraphs: list[str], lines: list[str], seed: int = SEED):
        self.chance = random.Random(seed)
        self.paragraphs = paragraphs or ["One line of text that stands for a paragraph, with a few more words in it."]
        self.lines = lines or ["Home", "About us", "Read more"]

    def line(self, most: int = 6) -> str:
        return html.escape(" ".join(self.chance.choice(self.lines).split()[: self.chance.randint(1, most)]))

    def paragraph(self) -> str:
        return html.escape(self.chance.choice(self.paragraphs), quote=False)

    def links(self, count: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.line(3)}</a></li>' for i in range(count))

    def rest(self) -> Iterator[str]:
        """Parts that are no main text, in the order of a page: above, inside and below the article."""
        pick, say = self.chance.choice, self.line
        yield pick([
            lambda: f"<nav><ul>{self.links(pick([3, 5, 8]))}</ul></nav>",
            lambda: f'<header><div class="logo">{say()}</div><ul class="menu">{self.links(5)}</ul></header>',
            lambda: f'<div class="menu"><ul>{self.links(6)}</ul></div>',
            lambda: f'<div id="navbar">{"".join(f"<a href=/x>{say(2)}</a> " for _ in range(4))}</div>',
            lambda: f'<header><h2>{say()}</h2><p>{say(9)}</p></header><nav>{say(3)}</nav>',
        ])()
        yield pick([
            lambda: f'<div class="cookie-notice"><p>{self.paragraph()}</p><button>{say(2)}</button></div>',
            lambda: f'<div class="notice">{self.paragraph()}</div>',
            lambda: f'<div class="ad">{self.paragraph()}</div>',
            lambda: f'<div class="ads sponsored">{say(9)}</div>',
            lambda: f'<div role="alert" class="banner">{self.paragraph()}</div>',
            lambda: "",
        ])()
        yield pick([
            lambda: f'<aside><h3>{say()}</h3><p>{self.paragraph()}</p></aside>',
            lambda: f'<div class="sidebar"><h3>{say()}</h3><ul>{self.links(4)}</ul><p>{self.paragraph()}</p></div>',
            lambda: f'<aside class="related"><ul>{self.links(5)}</ul></aside>',
            lambda: f'<div class="ad">{self.paragraph()}</div>',
            lambda: "",
        ])()
        yield pick([
            lambda: f'<div class="ad">{self.paragraph()}</div>',
            lambda: f'<div class="advert promo">{self.paragraph()}</div>',
            lambda: f'<aside>{self.paragraph()}</aside>',
            lambda: f'<form class="newsletter"><label>{say()}</label><input name=a><button>{say(2)}</button></form>',
            lambda: f'<div class="share social"><a href=/s>{say(2)}</a></div>',
            lambda: "", lambda: "", lambda: "",
        ])()
        yield pick([
            lambda: f'<form><p>{say(8)}</p><label>{say()}</label><select><option>{say(1)}</option></select></form>',
            lambda: f'<div class="related"><h3>{say()}</h3><ul>{self.links(4)}</ul></div>',
            lambda: "", lambda: "",
        ])()
        comments = "".join(f'<div class="comment"><b>{say(2)}</b><p>{self.paragraph()}</p></div>' for _ in range(pick([1, 2, 4])))
        yield pick([
            lambda: f'<div class="comments"><h3>{say(2)}</h3>{comments}</div>',
            lambda: f'<section id="comments">{comments}</section>',
            lambda: f'<ol class="comment-list"><li>{self.paragraph()}</li><li>{self.paragraph()}</li></ol>',
            lambda: "", lambda: "",
        ])()
        yield pick([
            lambda: f"<footer>&copy; {say(2)} &middot; {self.paragraph()}</footer>",
            lambda: f'<footer><ul>{self.links(4)}</ul><p>{say(8)}</p></footer>',
            lambda: f'<div class="footer"><p>&copy; {say(5)}</p></div>',
            lambda: f'<div id="footer">{self.paragraph()}</div>',
        ])()

    def article(self, insert: str) -> str:
        pick, own = self.chance.choice, lambda: MAIN_SIGN + self.paragraph()
        count = pick([1, 2, 3, 5, 8])
        parts = [pick(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<blockquote>{}</blockquote>"]) for _ in range(count)]
        body = [part.format(own()) for part in parts]
        if pick([True, False, False]):
            body.append(f"<h2>{MAIN_SIGN}{self.line()}</h2><ul><li>{own()}</li><li>{MAIN_SIGN}{self.line(9)}</li></ul>")
        body.insert(self.chance.randint(0, len(body)), insert)
        return f"<h1>{MAIN_SIGN}{self.line(12)}</h1>" + "".join(body)

    def page(self) -> tuple[list[Block], list[int]]:
        menu, notice, side, inside, form, comments, footer = self.rest()
        begin, end = self.chance.choice(WRAPS)
        within = self.chance.choice([True, False])
        article = begin + self.article(inside) + (form + comments if within else "") + end + ("" if within else form + comments)
        body = [menu, notice, *([side, article] if self.chance.random() < 0.6 else [article, side]), footer]
        title = f"<head><meta charset=utf-8><title>{self.line(12)}</title></head>"
        found = blocks(f"<!DOCTYPE html><html>{title}<body>{''.join(body)}</body></html>")
        labels = [int(MAIN_SIGN in block.text) for block in found]
        return [block._replace(text=block.text.replace(MAIN_SIGN, "") or ".") for block in found], labels


def train(sample: list[str], seed: int = SEED) -> Field:
    """A field from labelled pages made of a bounded sample of pages."""
    named = [found for found in map(labelled_by_markup, sample) if found is not None]
    every = [block for page in sample for block in blocks(page)]
    layouts = Layouts(
        [block.text for block in every if " " in block.text], [block.text for block in every if len(block.text) < 200], seed
    )
    made = [layouts.page() for _ in range(3 * LEARN_PAGES)]
    return Field().fit([(page_features(found), labels) for found, labels in [*named, *made]], seed=seed)


def learn(pages: DataFrame, column: str = "html") -> Field:
    rows = pages.select(F.xxhash64(column).alias("_key"), F.col(column).alias("_html"))
    rows = rows.filter(F.length("_html").between(1, LEARN_CHARS))
    # Keys are chosen first, so that no more than the pages of the sample reach the driver; equal pages count once.
    keys = [row._key for row in rows.select("_key").distinct().orderBy("_key").limit(LEARN_PAGES).collect()]

    def once(batches):
        seen = set()
        for batch in batches:
            fresh = [i for i, key in enumerate(batch.column("_key").to_pylist()) if not (key in seen or seen.add(key))]
            if fresh:
                yield batch.take(pa.array(fresh))

    chosen = rows.filter(F.col("_key").isin(keys)).mapInArrow(once, rows.schema).groupBy("_key").agg(F.min("_html").alias("_html"))
    return train([row._html for row in sorted(chosen.collect(), key=lambda row: row._key)])


def extract(pages: DataFrame, field: Field, keep: list[str], column: str = "html") -> DataFrame:
    """Columns of ``keep``, then the main text of each page."""
    chosen = pages.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(column).alias("_html"))
    fields = [T.StructField(f"_k{i}", chosen.schema[i].dataType) for i in range(len(keep))]
    schema = T.StructType([*fields, T.StructField("_out", T.StringType())])

    def extracted(batches):
        for batch in (part for whole in batches for part in byte_blocks(whole, "_html", BLOCK)):
            texts = [field.main_text(page or "") for page in batch.column("_html").to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=schema.names)

    found = chosen.mapInArrow(extracted, schema)
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_out").alias("text"))
