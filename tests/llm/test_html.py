import random
import time
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import html

TEXT = "".join


def text(page):
    blocks, _ = html.parse(page)
    return " ".join(t for (t, _, _), s in zip(blocks, html.states(blocks), strict=True) if not s)


@pytest.mark.parametrize(("page", "want"), [
    (None, ""),
    ("", ""),
    ("<p>a  b<br>c</p>d", "a b c d"),
    ("<article><h1>T&amp;x</h1><p><b>one<br><p>two &copy; &lt;x&gt; a&ampb</article><footer>f</footer>", "T&x one two © <x> a&b"),
    ("<nav>n</nav><div class='ad'>x</div><div id='cookie-notice'>c</div><main><p>m<span>i</span>n</p><aside>s</aside><form>f</form></main>", "min"),
    ("<body><div class='sidebar'>s</div><p>keep</p><section class='comments'><p>c</p></section><script>var a='</p>';</script><style>p{}</style></body>", "keep"),
    ("<article><p>a</p><!-- <p>no</p> --><div class='share'>s</div><ul><li>x<li>y</ul></article>", "a x y"),
    ("<article>a <i>b</i>c<p>d</article><article class='comment'>no</article>", "a bc d"),
    ("<header>h</header><article><header><h1>t</h1></header><p>b</p><footer>by</footer></article>", "t b"),
    ("<p hidden>h</p><p style='display: none'>n</p><p aria-hidden='true'>x</p><p>v</p>", "v"),
    ("<article><p>1 < 2 and <b x='>'>3</b></p>", "1 < 2 and 3"),
    ("<div class='with-sidebar'><p>body</p><div class='sidebar'>s</div></div>", "body"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    # the main content is not given up for a card inside it, nor for a small one beside it
    ("<main><p>The body of the page</p><article class='card'>Other story</article></main>", "The body of the page Other story"),
    ("<article class='card'>Other</article><div><p>A page without any name for its long body text</p></div>", "Other A page without any name for its long body text"),
    ("<div class='content'><article><p>The long story of the day</p></article><div>more</div></div>", "The long story of the day"),
    # names that only have a boilerplate word in them stay inside main content
    ("<main><section class='search-algorithms'><p>binary</p></section><div class='form-of-government'>monarchy</div><div class='tags'>x</div></main>", "binary monarchy x"),
    ("<main><p>a</p><div class='related-posts'>r</div><div class='notice'>n</div></main>", "a"),
    ("<div class='notice'><p>all there is</p></div>", "all there is"),
])
def test_parse(page, want):
    assert text(page) == want


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, blocks int")


def test_templates_recurring_on_a_host_go(spark):
    rows = [(i, f"http://a.example/{i}", f"<div class=x><p>Welcome to our site</p></div><div><p>story {i} is a good deal longer</p></div>", "h", 1) for i in range(8)]
    rows += [(20 + i, f"http://b{i}.example/", f"<div class=x><p>Welcome to our site</p></div><div><p>other text on host {i}</p></div>", "h", 1) for i in range(8)]
    rows += [(50, None, None, None, None), (51, "http://a.example/x", "", "h", 1)]
    for sent in (html.SENT_KEYS, 0):  # keys sent to the tasks, and joined
        got = {r["page_id"]: r for r in html.main_text(pages(spark, rows), sent_keys=sent).collect()}
        assert all(got[i]["text"] == f"story {i} is a good deal longer" and got[i]["n_template"] == 1 for i in range(8))
        assert all(got[20 + i]["text"] == f"Welcome to our site other text on host {i}" for i in range(8))
        assert got[50]["text"] == got[51]["text"] == "" and got[50]["n_chars"] == 0
        assert got[3]["n_chars"] == len(got[3]["text"]) and len(got) == len(rows)


def test_captures_and_copies_are_no_template(spark):
    page = "<article><h1>Title</h1><p>Some text of the article.</p></article>"
    rows = [(i, "http://c.example/a", page, "h", 1) for i in range(8)]
    rows += [(20 + i, f"http://d.example/{i}", page + f"<footer>{i}</footer>", "h", 1) for i in range(8)]
    rows += [(40 + i, f"http://e.example/{i}", f"<body><p>Short.</p><article><p>Own {i}.</p><p>Short.</p></article></body>", "h", 1) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html.main_text(pages(spark, rows)).collect()}
    assert all(got[i] == got[20 + i] == "Title Some text of the article." for i in range(8))
    assert all(got[40 + i] == f"Own {i}. Short." for i in range(8))


class Tree(HTMLParser):
    """(tag, class, children) of well-formed pages; a text is a child."""

    def __init__(self, page):
        super().__init__()
        self.root = ("", "", [])
        self.open = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        e = (tag, dict(attrs).get("class", ""), [])
        self.open[-1][2].append(e)
        self.open.append(e)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def leaves(e):
    return [e] if isinstance(e, str) else [x for c in e[2] for x in leaves(c)]


def shape(e):
    return e if isinstance(e, str) else (e[0], tuple(map(shape, e[2])))


def brute(rows):
    """page_id -> text, by comparing all subtrees of all pages of a host as they are."""
    trees = {i: Tree(h).root for i, _, h in rows}
    seen = defaultdict(set)

    def main(e, ruled=False, within=False):
        if isinstance(e, str):
            return [] if ruled else [e]
        return [x for c in e[2] for x in main(c, ruled or e[0] == "nav" or e[1] == "ad", within)]

    def walk(e, f, ruled=False, within=False):
        if not isinstance(e, str):
            f(e, ruled, within)
            ruled = ruled or e[0] == "nav" or e[1] == "ad"
            for c in e[2]:
                walk(c, f, ruled, within or e[0] == "article")

    def eligible(i, e, ruled, within):
        size = sum(map(len, main(e, ruled)))
        return e[0] and not (within and not ruled and e[0] in ("p", "h1")) and 2 * size <= sum(map(len, main(trees[i])))

    for i, url, _ in rows:
        walk(trees[i], lambda e, r, w, i=i, url=url: seen[url.split("/")[2], shape(e)].add(url) if eligible(i, e, r, w) else None)
    out = {}
    for i, url, _ in rows:
        host, gone = url.split("/")[2], 0

        def text(e, ruled=False, within=False, i=i, host=host):
            nonlocal gone
            if isinstance(e, str):
                return [] if ruled else [e]
            if eligible(i, e, ruled, within) and len(seen[host, shape(e)]) >= html.MIN_PAGES:
                gone += len(leaves(e))
                return []
            return [x for c in e[2] for x in text(c, ruled or e[0] == "nav" or e[1] == "ad", within or e[0] == "article")]

        found = text(trees[i])
        out[i] = (" ".join(found), gone)
    return out


def test_against_all_subtrees(spark):
    """Random pages whose article holds most of the text, against a comparison of all subtrees."""
    rng, rows = random.Random(2), []
    word = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    banners = [f"<div><p>{word(2)}</p><p>{word(3)}</p></div>" for _ in range(4)]
    for i in range(60):
        body = "".join(f"<p>{word(8)}</p>" + rng.choice(["", "<p>again</p>", f"<div><p>{'see also'}</p></div>"]) for _ in range(4))
        menu = "".join(f"<li>{rng.choice('xyz')}</li>" for _ in range(3))
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<body><nav><ul>{menu}</ul></nav>{rng.choice(banners)}<div class=\"ad\">{word(2)}</div><article><h1>{word(3)}</h1>{body}</article></body>"))
    want = brute(rows)
    got = html.main_text(pages(spark, [(*r, "h", 1) for r in rows])).collect()
    for r in got:
        text, gone = want[r["page_id"]]
        assert r["n_template"] == gone
        # what stands outside the article and recurs too seldom is left to the choice of the main content
        assert text.endswith(r["text"]) and (r["text"] == text or r["n_outside"])
    assert sum(r["n_template"] for r in got) > 60


def test_deep_pages_take_linear_time():
    blocks, elements = html.parse("<div>x" * 20_000)
    assert len(blocks) == len(elements) == 20_000


def test_empty_table(spark):
    assert html.main_text(pages(spark, [])).count() == 0


def test_templates_are_searched_and_not_passed_over_for_each_page():
    templates = np.arange(0, 3 << 20, 3, dtype=np.int64)
    pages = [(["a", "b", "c"], [0, 1, 0], [3 * k, 3 * k + 1, -1], [0, 1, 2], [1, 2, 3]) for k in range(300)] + [([], [], [], [], [])]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
    columns = [pa.array([None, *c], pa.list_(kind)).slice(1) for c, kind in zip(map(list, zip(*pages, strict=True)), kinds, strict=True)]
    began = time.process_time()
    got = html._assemble(templates).func(*columns).to_pylist()
    assert time.process_time() - began < 2
    assert got[:300] == [{"text": "c", "n_template": 1, "n_rules": 1, "n_outside": 0}] * 300 and got[300]["text"] == ""
    none = html._assemble(templates[:0]).func(*columns).to_pylist()
    assert none[:300] == [{"text": "a c", "n_template": 0, "n_rules": 1, "n_outside": 0}] * 300
    marked = html._assemble(None).func(*columns[:2], pa.array([[1, 1, 0]] * 300 + [[]], pa.list_(pa.int64())), *columns[3:]).to_pylist()
    assert marked[0] == {"text": "c", "n_template": 2, "n_rules": 0, "n_outside": 0}
