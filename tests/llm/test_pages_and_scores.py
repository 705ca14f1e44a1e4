import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import html_extract, quality, toxicity
from docweave.llm.features import statistics
from docweave.llm.gbt import auc, fit, isotonic
from docweave.llm.html_extract import blocks, induce, main_text, parse, tree_match

DOCS = "doc_id long, text string"


# --- pages ---
@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>A &amp; B</h1><p>one<br>two  <b>th</b>ree<p>four&nbsp;&#x41;</article>", "A & B one two three four A"),
        ("<body><nav>menu</nav><main><p>x</p><aside>side</aside></main><footer>f</footer>", "x"),
        ("<article><p>a<script>var t='</p>'</script></p><div class='ad-box'>buy</div><form>q<input></form><p>b</p><section id=comments><p>hi</p></section></article>", "a b"),
        ("<header>site</header><article><header><h2>T</h2></header><p>x</article><div class=cookie-notice>c</div>", "T x"),
        ("<!-- c --><p>only <i>text</i></p> tail", "only text tail"),
        ("plain text, no tags", "plain text, no tags"),
        ("<article><p><b>bold<br><p>next</p></article>", "bold next"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
        ("<article>a < b and c > d <p title='x > y'>e</p></article>", "a < b and c > d e"),
        ("<div hidden>no</div><div style='display: none'>no</div><div role=navigation>no</div><article>yes", "yes"),
        ("<article>cut off <p>her", "cut off her"),
        ("", ""),
        (None, ""),
        ("<script>never closed", ""),
        ("</p></div></article>x", "x"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_densest_part_without_marks():
    body = "<p>" + "long words in a sentence here now " * 3 + "</p>"
    page = f"<body><div><div>Top links</div></div><div><div>{body * 4}</div><div>See also</div></div></body>"
    assert main_text(page) == " ".join(["long words in a sentence here now " * 3] * 4).replace("  ", " ").strip()


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert len(main_text("<article>" + "<p>w w</p>" * 20_000 + "</article>")) == 20_000 * 4 - 1
    assert main_text("<a href='" * 2000 + "x") is not None


def test_tree_matching_and_template():
    page = lambda i: f"<body><div><h1>Title {i}</h1><p>Read more on our site</p><p>body {i} {'w%d ' % i * 40}</p></div></body>"
    a, b = (html_extract._tree(parse(page(i))) for i in (1, 2))
    assert tree_match(a, b)[0] == a.size
    marks = induce([page(i) for i in range(4)])
    assert len(marks) == 1
    assert "Read more" in main_text(page(1)) and "Read more" not in main_text(page(1), set(marks))
    assert induce([page(1)] * 5) == [] and induce([page(1), page(2)]) == []


def test_extraction_over_a_table(spark):
    rows = [(i, "http://Host.x/p", f"<article><p>Share this</p><p>text {i} {' '.join('v%d' % (i * j) for j in range(50))}</p></article>") for i in range(40)]
    rows += [(100, "http://other/", rows[0][2]), (101, None, "<p>t</p>"), (102, "u", None), (None, "u", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract_pages(df).collect()}
    assert len(got) == len(rows)
    assert got[3].text.startswith("text 3 v0 v3") and got[100].text.startswith("Share this text 0")
    assert got[101].text == "t" and got[102].text == "" and got[None].n_chars == 0 and got[102].url == "u"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_an_article_split_over_sibling_divs_stays_whole():
    long = "".join(f"<p>Sentence {i} of the first part has quite a few words in it.</p>" for i in range(7))
    short = "".join(f"<p>Sentence {i} of the second part has quite a few words too.</p>" for i in range(3))
    text = main_text(f"<html><body><div><a href='/'>Start</a></div><div><div>{long}</div><div>{short}</div></div></body></html>")
    assert text.count("first part") == 7 and text.count("second part") == 3 and "Start" not in text


def _layouts(rng, host, n):
    """Pages of a host without telling names, each with its true main text."""
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9))) for _ in range(300)]
    say = lambda lo, hi: " ".join(rng.choices(words, k=rng.randint(lo, hi)))
    notice = say(40, 50)  # a long text that stands on every page
    for _ in range(n):
        title, parts = say(3, 8), [say(10, 60) for _ in range(rng.randint(2, 9))]
        links = "".join(f"<li><a href='/{say(1, 1)}'>{say(1, 2)}</a></li>" for _ in range(5))
        body = "".join(f"<p>{p}</p>" for p in parts)
        blocks = [f"<div class='x1'><ul>{links}</ul></div>", f"<div class='x2'>{say(6, 9)}</div>", f"<div class='x3-{rng.randint(1, 999)}'><h2>{title}</h2>{body}<div class='x5'>{notice}</div></div>", f"<div class='x4'>{say(5, 8)}</div>"]
        if host % 2:
            blocks[2] = f"<table><tr><td>{blocks[0]}</td><td>{blocks[2]}</td></tr></table>"
        yield "<html><body>" + "".join(blocks) + "</body></html>", " ".join([title, *parts])


def test_wrappers_find_the_content_where_no_name_tells_it(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for host in range(6):
        for page, text in _layouts(rng, host, 40):
            want[len(rows)] = text
            rows.append((len(rows), f"https://h{host}.site/{len(rows)}", page))
    rows += [(10_000, rows[3][1], rows[3][2])] * 2  # repeated rows
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    assert html_extract.extract_pages(df).count() == len(rows) and got[10_000] == got[3]
    assert {i: got[i] for i in want} == want


def test_wrappers_agree_with_marked_articles():
    # The ablation: without what names and elements tell, the wrapper alone
    # finds the article's text.
    rng = random.Random(22)
    pages = []
    for page, text in _layouts(rng, 0, 30):
        pages.append(page.replace("<div class='x3", "<article><div class='x3", 1).replace("</div></div><div class='x4'", "</div></div></article><div class='x4'", 1))
    w = html_extract.wrapper(pages[:8])
    assert w.content and sum(main_text(p, w) == main_text(p, w, marked=False) for p in pages) == len(pages)


def test_large_pages_take_little_time_and_memory():
    import time

    began = time.process_time()
    table = lambda i: "<table>" + "".join("<tr>" + "".join(f"<td>{i}.{r}.{c}</td>" for c in range(90)) for r in range(90)) + "</table>"
    html_extract.wrapper([table(i) for i in range(3)])
    assert main_text("<div class='a b'>" * 50_000 + "deep") == "deep"
    html_extract.wrapper(["".join(f"<div class='x{j % 7}'>t{i}{j}" for j in range(20_000)) for i in range(3)])
    main_text("<div>" * 3000 + "</section>" * 100_000 + "x")
    assert time.process_time() - began < 30


def test_template_texts_are_counted_over_all_pages(spark):
    # A text that stands on the drawn pages only by chance is content elsewhere.
    rng = random.Random(24)
    say = lambda k: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(k))
    rows = [(i, "http://t.site/", f"<body><article><p>{say(30)}</p><p>{'Now and then' if i % 10 else 'Always here'}</p><div>Printed by all</div></article></body>") for i in range(60)]
    got = [r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert not any("Printed by all" in t for t in got) and sum("Always here" in t for t in got) == 6


# --- boosted trees ---
def test_trees_learn_and_flat_arrays_predict():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(int)
    f = fit(x[:2000], y[:2000], trees=40, depth=3)
    assert auc(f.probability(x[2000:]), y[2000:]) > 0.97
    one = [f.margin(r[None, :])[0] for r in x[:20]]
    assert np.allclose(one, f.margin(x[:20]))
    assert f.margin(x[:0]).shape == (0,)


def test_isotonic_is_monotone_and_pools():
    knots, values = isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.5]), np.array([0, 1, 0, 1, 1, 0]))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()


def test_statistics_of_odd_texts():
    texts = ["", "a", "é" * 10, "!!!", "A B C D E F G A B C D E F G\n", "id1ot f*ck", "x " * 3000]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    x, names, _ = statistics(raw, off)
    assert x.shape == (len(texts), len(names)) and np.isfinite(x).all()
    for i, t in enumerate(texts):  # each row alone gives the same
        one = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(statistics(one, np.array([0, len(one)]))[0][0], x[i])
    assert x[5][names.index("obfuscated")] == 1.0


def _counted(t):
    """The statistics of an ASCII text, by plain loops."""
    import math
    import re

    words, tokens, size = re.findall("[A-Za-z]+", t), re.findall(r"[^\x20\x09-\x0D]+", t), max(len(t), 1)
    low = [w.lower() for w in words]
    n, m = max(len(words), 1), max(len(tokens), 1)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    share = lambda letters: sum(c in letters for c in t) / size
    windows = [tuple(low[i : i + 5]) for i in range(len(low) - 4)]
    odd = lambda w: any(w[i].isalpha() and not w[i + 1].isalpha() and w[i + 2].isalpha() for i in range(len(w) - 2))
    upper, punctuation = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\"'()+,-./:;=?@[\\]^_`{}~"
    return {
        "log_words": math.log1p(len(words)), "log_chars": math.log1p(len(t)), "chars_per_word": size / m, "mean_word": mean,
        "spread_word": max(sum(x * x for x in lengths) / n - mean**2, 0) ** 0.5, "capitals": share(upper), "digits": share("0123456789"), "punctuation": share(punctuation),
        "symbols": share("#*$%&|<>"), "exclamation": share("!"), "spaces": share(" "), "non_ascii": 0.0, "words_per_line": len(words) / (t.count("\n") + 1), "distinct": len(set(low)) / n,
        "doubled": sum(a == b for a, b in zip(low, low[1:])) / n, "repeats": (len(windows) - len(set(windows))) / n, "title_words": sum(w[0] in upper for w in words) / n,
        "capital_words": sum(len(w) > 1 and w[0] in upper and w[-1] in upper for w in words) / n, "obfuscated": sum(map(odd, tokens)) / m, "bare_tokens": len(words) / m,
    }


def test_statistics_match_plain_counts():
    rng = random.Random(41)
    bits = ["you", "You", "IDIOT", "f*ck", "a1b", "...", "#1", "no!", "x", "\n", "end.", "(so)", "AbC", "7", "$5", "-"]
    texts = [" ".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(80)] + ["a b c d e " * 9, "!!", "\n\n"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    x, names, _ = statistics(raw, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    for i, t in enumerate(texts):
        want = _counted(t)
        assert {n: round(v, 9) for n, v in zip(names, x[i].tolist(), strict=True)} == {n: round(want[n], 9) for n in names}, t


def test_toxic_features_match_plain_counts():
    import re

    from docweave.llm import features as feats

    rng = random.Random(43)
    bits = ["you", "idiot", "moron", "1d1ot", "tree", "your", "house", "STUPID", "river", "ur"]
    texts = [" ".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(60)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    none = [(np.zeros(0, np.uint64), np.zeros(0))] * 6
    x = toxicity.extractor(none)(raw, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    bad, second = set(feats.INSULTS.split()), set(feats.SECOND_PERSON.split())
    for i, t in enumerate(texts):
        w = re.findall("[a-z]+", t.lower())
        n, hit = max(len(w), 1), [v in bad for v in w]
        close = sum(any(v in second for v in w[max(k - 3, 0) : k + 4]) for k, h in enumerate(hit) if h)
        assert np.allclose([x[i, 0], x[i, 8], x[i, 9]], [sum(hit) / n, sum(v in second for v in w) / n, close / n]), t


@pytest.fixture(scope="module")
def scored_corpus(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        w = rng.choices(words, k=rng.randint(20, 120))
        toxic, junk = int(rng.random() < 0.2), int(rng.random() < 0.3)
        if toxic:
            for _ in range(len(w) // 10):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "you moron", "zkrag" + rng.choice("abcdefgh"), "zkrag" + rng.choice("ijklmnop")])
        if junk:
            w = [x.upper() + "###" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, 1 - junk, toxic))
    rows += [(5000, None), (5001, ""), (None, "no id"), (7, rows[7][1]), (5002, "word " * 40_000)]
    df = spark.createDataFrame([(*r, 9.0, True) for r in rows], DOCS + ", score double, held_out boolean")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5001, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    return df, lab, {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize(("op", "at", "parts", "held", "cut"), [(toxicity, 1, 3, 1, 0.7), (quality, 0, 5, 0, 0.3)])
def test_scores_separate_held_out_rows(spark, scored_corpus, op, at, parts, held, cut):
    import zlib

    df, lab, truth = scored_corpus
    got = op.judged(df, lab).collect()
    assert len(got) == df.count() and {c for c in got[0].asDict()} == {"doc_id", "held_out", "score", "predicted"}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert auc(np.array([r.score for r in test]), np.array([truth[r.doc_id][at] for r in test])) > 0.93
    again = {(r.doc_id, r.score) for r in op.judged(df, lab).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_scores_without_labels_or_rows(spark, scored_corpus):
    df, lab, _ = scored_corpus
    for op in (toxicity, quality):
        assert op.judged(df.limit(0), lab).count() == 0
        assert {r.score for r in op.judged(df.limit(5), lab.limit(0)).collect()} == {0.5}
        one = lab.where("doc_id < 30").withColumn("toxic", F.lit(0)).withColumn("quality", F.lit(1))
        assert op.judged(df.limit(30), one).select("score").distinct().count() == 1
