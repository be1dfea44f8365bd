"""Main text of pages: the reader, the field against enumeration, held-out pages."""

import html
import itertools
import random
import re
import time

import numpy as np
import pytest

from framewright.llm import html_extract, page_layouts
from framewright.llm.page_blocks import blocks_of
from framewright.llm.queries import LLM_QUERIES
from tests.conftest import SF_DIR


def texts(page):
    return [block.text for block in blocks_of(page)]


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("", []),
        ("just text", ["just text"]),
        ("a<b>b</b> c<p>x &amp y&nbsp;z<br>q", ["ab c", "x & y z q"]),
        ("<p>one<p>two<li>three<li>four", ["one", "two", "three", "four"]),
        ("<script>var a='<p>no</p>';</script>yes<style>p{}</style>", ["yes"]),
        ("<SCRIPT>no</Script >yes<!-- no <p> -->.", ["yes."]),
        ("<head><title>no</title><meta x>no<body><p>yes", ["yes"]),
        ("<title>no</title><select><option>no</select>yes", ["yes"]),
        ("x < 5 and 6 > y <3", ["x < 5 and 6 > y <3"]),
        ("<p title=\"a > b\">yes</p><p title='>'>too", ["yes", "too"]),
        ("<p title=\"never ends>yes</p>", ["yes"]),
        ("<div>a<div>b</div>c</div>d</p></ul>e", ["a", "b", "c", "de"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
        ("&#65;&#x42;&#0;&#xD800;&#99999999999999999999;&eacute;&zzz;", ["AB���é&zzz;"]),
        ("yes<!-- never ends", ["yes"]),
        ("yes<p no", ["yes"]),
        ("\x00\n   a　b", ["\x00 a b"]),
    ],
)
def test_blocks(page, wanted):
    assert texts(page) == wanted


@pytest.mark.parametrize(
    "page",
    ["<", "<a ", "<div>", "<!-- ", "<script ", "<script>", '<a "> " ', "<a '> ' ", "&#9", "<li><ul>"]
    + ["<dd><dl>", "<p>", "</", '<b class="', "<svg>", "<a>", "&", "<?", "<!x", "</p>", "<div class=aB>"],
)
def test_any_markup_takes_linear_time(page):
    began = time.process_time()
    blocks_of(page * 50_000)
    blocks_of("<div>" * 50_000 + page * 50_000 + "</td>" * 50_000)
    assert time.process_time() - began < 10


def enumerated(scores, steps, start):
    """Weight of each labelling of a chain, by all labellings."""
    found = {}
    for labels in itertools.product((0, 1), repeat=len(scores)):
        total = sum(s for s, label in zip(scores, labels) if label) + start * labels[0]
        found[labels] = total + sum(steps[a][b] for a, b in zip(labels, labels[1:]))
    return found


def test_viterbi_and_marginals_are_those_of_all_labellings(monkeypatch):
    rng = random.Random(3)
    lengths = [1, 2, 3, 7, 5]
    steps, start = [[0.3, -0.9], [-0.4, 1.1]], -0.7
    rows = [[rng.gauss(0, 2) for _ in range(n)] for n in lengths]
    table = np.zeros((len(rows), max(lengths)))
    for i, row in enumerate(rows):
        table[i, : len(row)] = row
    chance, pairs = html_extract.marginals(table, np.array(steps), start, np.array(lengths))
    wanted_pairs = np.zeros((2, 2))
    field = html_extract.Field({}, 0.0, tuple(map(tuple, steps)), start)
    for i, row in enumerate(rows):
        weights = enumerated(row, steps, start)
        total = sum(np.exp(w) for w in weights.values())
        for at in range(len(row)):
            one = sum(np.exp(w) for labels, w in weights.items() if labels[at])
            assert chance[i, at] == pytest.approx(one / total)
        for labels, w in weights.items():
            for a, b in zip(labels, labels[1:]):
                wanted_pairs[a, b] += np.exp(w) / total
        monkeypatch.setattr(html_extract.Field, "scores", lambda self, blocks: list(blocks))
        assert tuple(field.labels(row)) == max(weights, key=weights.get)
    assert pairs == pytest.approx(wanted_pairs)


def test_held_out_pages():
    """Pages put together from another seed; training pages have SEED."""
    model, wrong, total = html_extract.fitted(), 0, 0
    for page in page_layouts.labelled_pages(300, html_extract.SEED + 1):
        blocks, labels = html_extract.labelled_blocks(page)
        total += len(labels)
        wrong += sum(a != b for a, b in zip(labels, model.labels(blocks)))
    assert wrong < 0.01 * total


UNSEEN = """<!doctype html><html><body><header class="masthead"><a href=/>Site</a></header>
<div class=main-nav><a href=/>One</a> <a href=/>Two</a></div><div class="story-content">
<h1>Title   here</h1><p>Some first paragraph that is long
enough &ndash; to be one.</p><div class="advertising">Buy now this thing.</div><p>Yes.</p>
<p>Second, with <a href=x>a link</a> in it.</p><aside>Aside thing.</aside></div>
<section class="comment-list"><h2>3 comments</h2><div class="c"><b>Bob</b><p>I really liked
this article, thank you.</p></div></section><form><p>Sign up</p><input></form>
<footer><p>Copyright. All rights reserved.</p></footer></body></html>"""


def test_layout_that_no_training_page_has():
    model = html_extract.fitted()
    assert html_extract.main_text(UNSEEN, model, frozenset(model.weights)) == (
        "Title here Some first paragraph that is long enough – to be one. Yes. "
        "Second, with a link in it."
    )


def test_pages_of_the_tables(spark):
    """Their main text stands in one element, so a pattern finds it, too."""
    found = {r["page_id"]: r for r in LLM_QUERIES["op11_html_text"].run(spark, SF_DIR).collect()}
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    assert len(found) == len(pages)
    for page in pages:
        body = re.search("<article>(.*)</article>", page["html"], re.DOTALL)[1]
        body = re.sub("</?(p|h1|br)[^>]*>", " ", body)
        wanted = " ".join(html.unescape(re.sub("<[^>]*>", "", body)).split())
        row = found[page["page_id"]]
        assert (row["text"], row["n_chars"], row["url"]) == (wanted, len(wanted), page["url"])


def test_edge_rows(spark):
    long = "<article>" + "<p>" + "word. " * 40_000 + "</p>" + "<p>x</p>" * 3000 + "</article>"
    rows = [(1, None, None, 1), (2, "u", "", 1), (2, "u", "", 1), (None, "v", "<nav>x</nav>", 1)]
    rows += [(3, "w", long, 1), (4, "w", "<script>x", 1)]
    schema = "page_id bigint, url string, html string, `text` int"
    df = spark.createDataFrame(rows, schema)
    found = [tuple(r) for r in html_extract.extract(df).collect()]
    assert [r[:2] for r in found] == [r[:2] for r in rows]
    assert [r[2:] for r in found[:4]] == [("", 0)] * 4 and found[5][2:] == ("", 0)
    assert found[4][3] == len(found[4][2]) == 40_000 * 6 - 1 + 3000 * 2
    assert html_extract.extract(df.limit(0)).collect() == []
