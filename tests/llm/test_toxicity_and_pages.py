"""Toxicity and main text: held-out accuracy, folding, exceptions, and odd input."""

import zlib

import pytest

from pairloom.llm import page_text, queries, toxicity


def test_folding(spark):
    row = spark.createDataFrame([(" 1D10T, Mоrоn! ｓｔｕpid\n",), (None,), ("",)], "text string").select(toxicity.folded("text")).collect()
    assert [r[0] for r in row] == [" idiot moron stupid ", "  ", "  "]


def test_exceptions_and_beginnings():
    lexicon = toxicity.Lexicon({" trash ": 5.0, " lowe": 4.0}, (" trash can ",))
    automaton = lexicon.automaton()
    assert [h[2] for h in lexicon.hits(automaton, " a trash can and trash loweb low ")] == [5.0, 4.0]
    assert lexicon.level(automaton, " ") == 0.0


def test_learning(spark):
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        noise = " ".join(f"w{(i * 7 + j) % 97}x" .replace("0", "q") for j in range(i % 40))
        insult = f" zork{chr(97 + i % 7)} {noise[:3]} grumf " if toxic else " trash can " if i % 3 == 0 else " "
        docs.append((i, noise + insult + noise[::-1], 0.5, 1))
        labels.append((i, int(toxic)))
    docs += [(None, "zorka", 0.5, 1), (900, None, 0.5, 1), (901, "", 0.5, 1), (902, "grumf " * 4000, 0.5, 1), (5, docs[5][1], 0.5, 1)]
    labels += [(None, 1), (901, None), (5, 1), (902, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double, predicted int").repartition(3)
    lexicon = toxicity.learn(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert " zork" in lexicon.terms or " zor" in str(lexicon.terms)
    found = toxicity.score(frame, lexicon, ["doc_id"]).collect()
    assert len(found) == len(docs)
    wrong = [r for r in found if r.doc_id is not None and r.doc_id < 600 and r.predicted != int(r.doc_id % 5 == 0)]
    assert not wrong
    assert all(0 <= r.score <= 1 for r in found)
    clean = toxicity.without_toxic(frame, lexicon)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {i for i in range(600) if i % 5} | {900, 901}


def test_long_words_and_many_excused_hits(spark):
    import time

    lexicon = toxicity.Lexicon({" bad ": 2.0, " ba": 1.0}, (" not bad ", " bad luck "))
    automaton, start = lexicon.automaton(), time.process_time()
    text = " not bad luck" * 100_000 + " bad " + "ba" * 10
    hits = lexicon.hits(automaton, text + " ")
    assert sorted((text[a:b], w) for a, b, w in hits) == sorted([(" bad ", 2.0), (" ba", 1.0), (" ba", 1.0)])
    assert time.process_time() - start < 10
    words = [chr(97 + i) + "x" * 1_000_000 for i in range(3)] + ["ba" + "d" * 1_000_000 + c for c in "xyz"]
    docs = spark.createDataFrame([(i, f"you {w} {j}") for i, (w, j) in enumerate((w, j) for w in words for j in "abc")], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic")
    start = time.time()
    toxicity.learn(docs, labels)
    assert time.time() - start < 30


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "what an idiot"), (2, "fine")], "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.doc_id: r.predicted for r in toxicity.score(docs, lexicon, ["doc_id"]).collect()} == {1: 1, 2: 0}
    assert toxicity.score(docs.filter("doc_id > 5"), lexicon, ["doc_id"]).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = queries.op9_toxicity(spark, folder).toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    held = found[found.held_out].merge(labels, on="doc_id")
    toxic, marked = held.toxic == 1, held.predicted == 1
    assert (toxic & marked).sum() / toxic.sum() > 0.8
    assert (toxic & marked).sum() / marked.sum() > 0.95


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy it now, it is very cheap.</div>
<article><h1>Title &amp; more</h1><p><b>First  part</b>
of it.<br><p>Second&nbsp;part.</article><aside>Other things to read, all of them good.</aside>
<div class="comments"><p>I like this page very much, really.</p></div><footer>&copy; them</footer>"""


@pytest.fixture(scope="module")
def field(spark, sf_dir):
    return page_text.learn(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_main_text(field):
    assert field.main_text(PAGE) == "Title & more First part of it. Second part."
    assert field.main_text("") == ""


def test_leaf_blocks():
    found = page_text.blocks("<div class='a b'><p>x <i>y</i>z<p>u<table><tr><td>1<td>2</table></div>w<li>v")
    assert [b.text for b in found] == ["x yz", "u", "1", "2", "w", "v"]
    assert found[0].tags == ("div", "p") and found[0].marks == ("a", "b")
    assert page_text.blocks("<p>never <b>closed <!-- x") [0].text == "never closed"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<!-->b<p>c", "ab c"),
        ("<p>a<!--->b<p>c", "ab c"),
        ("<p>a<!-- x --!>b<p>c<!-- y -->d", "ab cd"),
        ("<p>a<!-- x -- > y -->b", "ab"),
        ("<p>a<!-- never closed <p>b", "a"),
        ("<p>a<script>if (a<b) '</p>'</script >b<STYLE>p</style>c", "abc"),
        ("<p>a<script>never <p>closed", "a"),
        ("<p>a<noscript>b</noscript> <object data=x>c</object>", "a b c"),
        ("<p>a<b title='x > y' data=\"'\">b</b>c", "abc"),
        ("<p>1 < 2 <3 <p title='open>x", "1 < 2 <3 <p title='open>x"),
        ("<!DOCTYPE html><?xml x?><p>a</ p>b</x>c", "a</ p>bc"),
        ("a<", "a<"),
    ],
)
def test_markup(page, text):
    assert "".join(b.text for b in page_text.blocks(page)).replace(" ", "") == text.replace(" ", "")


@pytest.mark.parametrize("part", ['<a "', "<script ", "<a ", "<a", "<!", "<!-", "</x ", "<a \"<b '", "</b>", "<b><hr>", "<script>", "'<i>\""])
def test_broken_markup_takes_linear_time(part):
    import time

    page, start = "<p>" + part * (1_000_000 // len(part)), time.process_time()
    page_text.blocks(page)
    assert time.process_time() - start < 10


def test_sample_holds_equal_pages_once(spark):
    rows = [(i, PAGE.replace("First", f"First{i % 7}")) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(5)
    once = spark.createDataFrame(rows[:7], "page_id long, html string")
    few, many = page_text.learn(once), page_text.learn(pages)
    assert many.weights == few.weights and many.steps == few.steps


def test_icons(field):
    """A self-closed svg, and an element whose name only begins like one that is skipped, take no text with them."""
    icons = ('<svg class="icon"/>', '<svg viewBox="0 0 1 1" />', "<svg/>", "<svg><path d='M0'/>x</svg>", "<svg-icon></svg-icon>")
    for icon in icons:
        assert " ".join(b.text for b in page_text.blocks(f"<p>a {icon} b<p>c")) == "a b c"
        page = PAGE.replace("First", f"{icon}First")
        assert field.main_text(page) == "Title & more First part of it. Second part."


def test_held_out_layouts(field, spark, sf_dir):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(40).collect()]
    texts = [b.text for page in pages for b in page_text.blocks(page)]
    layouts = page_text.Layouts([t for t in texts if " " in t], ["Start", "Contact us", "More"], seed=99)
    right = total = 0
    for _ in range(200):
        found, labels = layouts.page()
        right += sum(a == b for a, b in zip(field.path(page_text.page_features(found)), labels))
        total += len(labels)
    assert right / total > 0.97


def test_path_is_the_likeliest(field):
    """Viterbi and marginals against all label sequences of a short page."""
    import itertools
    import math

    rows = page_text.page_features(page_text.blocks(PAGE))[:7]
    levels = field.levels(rows)

    def weight(labels):
        return sum(x for x, y in zip(levels, labels) if y) + sum(field.steps[2 * a + b] for a, b in zip(labels, labels[1:]))

    every = list(itertools.product((0, 1), repeat=len(rows)))
    assert tuple(field.path(rows)) == max(every, key=weight)
    total = sum(math.exp(weight(labels)) for labels in every)
    single, _ = field.marginals(rows)
    for i, p in enumerate(single):
        assert p == pytest.approx(sum(math.exp(weight(labels)) for labels in every if labels[i]) / total, rel=1e-6, abs=1e-9)


WRAPPED = (
    ('<body class="home blog">', "<article>", "</article>"),
    ('<body><div id="page">', "<article>", "</article>"),
    ("<body>", '<article class="post comments-open">', "</article>"),
    ("<body>", '<main id="content"><div class="with-sidebar"><article id="post-1">', "</article></div></main>"),
)


@pytest.mark.parametrize("body, begin, end", WRAPPED)
def test_names_around_the_article(spark, sf_dir, body, begin, end):
    def wrapped(page):
        return page.replace("<body>", body).replace("<article>", begin).replace("</article>", end)

    found, labels = page_text.labelled_by_markup(wrapped(PAGE))
    assert [b.text for b, y in zip(found, labels) if y] == ["Title & more", "First part of it.", "Second part."]
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").limit(60).collect()]
    field = page_text.train([wrapped(page) for page in pages])
    assert field.main_text(wrapped(PAGE)) == "Title & more First part of it. Second part."


def test_names_inside_the_article():
    page = """<main><article class="post"><p class="lead">One.</p><div class="ad">Buy.</div><p>Two.</p></article>
    <ol class="comment-list"><li class="comment"><article class="comment-body"><p>Nice.</p></article></ol></main>"""
    found, labels = page_text.labelled_by_markup(page)
    assert [b.text for b, y in zip(found, labels) if y] == ["One.", "Two."]
    assert page_text.labelled_by_markup("<main><p class=ad>Buy.</p></main><p>x") is None
    assert page_text.labelled_by_markup("<div class=home><p>x") is None


def test_odd_pages(field, spark):
    rows = [(1, None), (2, ""), (None, PAGE), (3, PAGE), (3, PAGE), (4, "<p>" + "word " * 60_000), (5, "<<<>>><p"), (6, "</p></div>")]
    pages = spark.createDataFrame([(i, h, "x") for i, h in rows], "page_id long, html string, text string")
    found = page_text.extract(pages, field, ["page_id"]).collect()
    assert len(found) == len(rows)
    assert page_text.extract(pages.filter("page_id > 9"), field, ["page_id"]).count() == 0
    assert page_text.learn(pages.filter("page_id > 9")).main_text(PAGE).startswith("Title")


def test_query(spark, sf_dir):
    import html
    import re

    def article(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", inner))
        return " ".join(" ".join(html.unescape(part) for part in parts).split())

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for row in queries.op10_page_text(spark, sf_dir).collect():
        assert row.text == article(pages[row.page_id].html)
        assert (row.url, row.n_chars) == (pages[row.page_id].url, len(row.text))
