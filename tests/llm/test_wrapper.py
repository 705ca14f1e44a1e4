"""Tree matching against plain recursion, wide and deep pages, parts of articles, and all pages of the tables."""

import html
import os
import random
import re
import time

import pytest

from docweave.llm import html_extract


def random_page(rng, depth=4):
    if depth == 0:
        return "x"
    return "".join(f"<{t}>{random_page(rng, depth - 1)}</{t}>" for t in rng.choices(["div", "ul", "section", "h2"], k=rng.randint(0, 4)))


def brute(a, b):
    """Simple tree matching by its definition."""
    if a.label != b.label:
        return 0
    rows = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, k in enumerate(a.kids, 1):
        for j, m in enumerate(b.kids, 1):
            rows[i][j] = max(rows[i - 1][j], rows[i][j - 1], rows[i - 1][j - 1] + brute(k, m))
    return rows[-1][-1] + 1


def check_pairs(a, b, pairs):
    """Pairs have equal labels, their parents are a pair, and order is kept."""
    match = {id(x): y for x, y in pairs}
    assert len(match) == len(pairs) == len({id(y) for _, y in pairs}) and match[id(a)] is b
    for x, y in pairs:
        assert x.label == y.label
        place = {id(k): n for n, k in enumerate(y.kids)}
        at = [place[id(match[id(k)])] for k in x.kids if id(k) in match]
        assert at == sorted(at)


def trees(rng):
    return [html_extract._tree(html_extract.parse(f"<body>{random_page(rng)}</body>")) for _ in range(2)]


def test_matching_equals_plain_recursion():
    rng = random.Random(2)
    for _ in range(150):
        a, b = trees(rng)
        total, pairs = html_extract.tree_match(a, b)
        assert total == len(pairs) == brute(a, b)
        check_pairs(a, b, pairs)


def test_matching_in_parts_keeps_order_and_finds_most(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(html_extract, "CELLS", 3)
    found = best = 0
    for _ in range(150):
        a, b = trees(rng)
        total, pairs = html_extract.tree_match(a, b)
        assert total == len(pairs) <= brute(a, b)
        check_pairs(a, b, pairs)
        found, best = found + total, best + brute(a, b)
    assert found >= 0.85 * best


def test_wide_and_deep_pages():
    rng = random.Random(4)
    wide = ["<body><div>" + "".join(f'<div class="r{rng.choice("abcdef")}">{"<p>x</p>" * rng.randint(1, 6)}<p>{rng.random()} {k}</p></div>' for k in range(8000)) + "</div></body>" for _ in range(3)]
    deep = [f"<body>{'<div>' * 4000}text {i} of some words{'</div>' * (4000 - i)}</body>" for i in range(4)]
    began = time.perf_counter()
    assert html_extract.wrapper(wide).content and html_extract.wrapper(deep) is not None
    assert time.perf_counter() - began < 30


def test_parts_of_an_article_stay_whatever_their_names():
    page = '<article><p>one two</p><p class="legal">three</p><section class="search-results"><p>four</p></section><div class="tags">five</div><div id="related"><p>six</p></div></article>'
    assert html_extract.main_text(page) == "one two three four five six"
    around = '<div class="tags">a b</div><article><p>one</p><aside>x</aside><div class="comments">y</div><div class="ad-box">z</div></article><div class="related">c d</div>'
    assert html_extract.main_text(around) == "one"
    # In a content slot, too, what varies from page to page stays.
    words = [" ".join(random.Random(i).choices("abcdefghij", k=30)) for i in range(6)]
    pages = [f'<body><div class="share">s s</div><div class="page"><p>{w}</p><div class="toc">{w[::-1]}</div></div><div class="legal">t t</div></body>' for w in words]
    wrapper = html_extract.wrapper(pages)
    assert wrapper.content and [html_extract.main_text(p, wrapper) for p in pages] == [f"{w} {w[::-1]}" for w in words]


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_all_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        inner = re.sub(r"</?b>", "", inner)
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_pages(pages).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()} and len(want) > 200


def test_wrappers_come_from_all_pages(spark):
    # A text on 57 of 60 pages is a template text, whichever pages lack it; a few pages would not tell on every host.
    rng = random.Random(31)
    say = lambda k: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(k))
    rows = []
    for host in range(12):
        for i in range(60):
            links = "".join(f"<li><a href='/'>{say(1)}</a></li>" for _ in range(4))
            parts = "".join(f"<p>{say(20)}</p>" for _ in range(rng.randint(1, 5)))
            note = "<div class='x3'>Read by members</div>" if i >= 3 else ""
            rows.append((len(rows), f"https://h{host}.site/{i}", f"<body><ul class='x1'>{links}</ul><div class='x2'>{parts}{note}</div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: (r.content % (1 << 64), set(r.marks), {x % (1 << 64) for x in r.links}) for r in html_extract.wrappers(df).collect()}
    assert len(got) == 12
    for host in range(12):
        want = html_extract.wrapper([html for _, url, html in rows if url.startswith(f"https://h{host}.")])
        assert got[f"h{host}.site"] == (want.content, want.marks, want.links) and want.content and len(want.marks) == 1 and len(want.links) == 1
    texts = [r.text for r in html_extract.extract_pages(df).collect()]
    assert len(texts) == 720 and not any("Read by members" in t for t in texts)
