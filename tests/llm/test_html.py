import itertools
import random
import re

import numpy as np

from weighbridge.llm import op8_html as h


def text_of(page):
    return h.parse(page).texts


def test_parse():
    assert text_of("<p>a &amp; b&#33;\n  c<br>d<p>e<!-- x <p> --><b>f</b>g</p>") == ["a & b! c d", "efg"]
    assert text_of("<script>var t='</p>';</script><style>p{}</style>x<!-- never ends <p>y") == ["x"]
    assert text_of("a < b <") == ["a < b <"] and text_of("") == [] and text_of("<ul><li>1<li>2</ul>3") == ["1", "2", "3"]
    assert text_of('<p title="a > b">t</p><div a="unclosed') == ["t"]
    assert len(text_of("<div>" * 20000 + "x")) == 1 and text_of("&lt;p&gt;") == ["<p>"]


def test_viterbi_and_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    f = h.Field()
    f.w, f.t, f.s = rng.normal(size=f.w.shape), rng.normal(size=(2, 2)), rng.normal(size=2)
    x = (rng.random((6, len(h.FEATURES))) < 0.2).astype(float)
    e = x @ f.w

    def score(y):
        return f.s[y[0]] + sum(e[i, y[i]] for i in range(6)) + sum(f.t[a, b] for a, b in itertools.pairwise(y))

    every = list(itertools.product((0, 1), repeat=6))
    assert tuple(f.decode(x)) == max(every, key=score)
    weights = np.exp([score(y) for y in every])
    # the first label's score belongs to the first marginal too
    p, _ = f._marginals(e)
    for i in range(6):
        assert abs(p[i, 1] - sum(w for y, w in zip(every, weights) if y[i]) / weights.sum()) < 1e-9


def test_held_out_layouts_and_query(spark, tmp_path):
    pages = h.layouts(40, seed=77)
    f = h.Field()
    f.train([h.labelled(p) for p in h.layouts(60)])
    right = total = 0
    for p in pages:
        x, y = h.labelled(p)
        x[:, h.GIVEN] = 0
        right += (f.decode(x) == y).sum()
        total += len(y)
    assert right >= 0.97 * total
    article = "<body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>T</h1><p>One two, three.</p><p>Four &amp; five six.</p></article><footer>&copy; x</footer>"
    rows = [(i, f"http://h/{i}", p, "x") for i, p in enumerate(pages)] + [(100, "u", article, "x"), (101, None, None, None), (102, "v", "", None), (None, "w", "<p></p>", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in h.query(spark, str(tmp_path)).collect()}
    assert got[100].text == "T\n\nOne two, three.\n\nFour & five six." and got[100].n_chars == len(got[100].text)
    assert got[101].text == got[102].text == got[None].text == "" and len(got) == len(rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert h.query(spark, str(tmp_path)).count() == 0


def test_long_and_broken_pages_take_linear_time():
    n = 40_000
    assert text_of('<a ">"' * n) and text_of("<a" * n) is not None
    assert text_of("<div>" * n + "x" + "</b>" * n) == ["x"]
    assert text_of("<p>" + "word " * n + "</p>") == [("word " * n).strip()]


def test_known_unclosed_tags_change_nothing(monkeypatch):
    r = random.Random(5)
    pages = ["".join(r.choice(["<a ", "<p", ">", '"', "'", " x", "/", "</p>", "<", "=", "<b y='", '<i z="', "w"]) for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    got = [text_of(p) for p in pages]
    monkeypatch.setattr(h, "OPEN", re.compile("(?!)"))
    assert got == [text_of(p) for p in pages]


def test_the_sample_is_bounded(spark):
    marked = "<article><p>{} One two, three.</p></article><footer>x</footer>"
    pages = [(None, None, marked.format("same"))] * 500 + [(None, None, marked.format(i)) for i in range(500)]
    seen = []
    real, h.labelled = h.labelled, lambda x: seen.append(x) or real(x)
    try:
        h.train(spark.createDataFrame(pages, "page_id long, url string, html string"), sample=20)
    finally:
        h.labelled = real
    table = [x for x in seen if "One two, three." in x]
    assert len(table) == len(set(table)) == 20
