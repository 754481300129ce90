import html as lib

import pytest

from skylattice.llm import html_text
from skylattice.llm.blocks import leaves
from skylattice.llm.labeller import BAD, GOOD, Labeller, _Author, label, padded, trained, vectors

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
    '<!-- ad <p>no</p> --><div class="ad">Buy this thing now.</div><article><h1>A &amp; B</h1><p><b>First   line<br>goes on.<br><p>Second &lt;one&gt; here, with words enough to be read.</p></article>'
    "<footer>&copy; site.example &middot; words</footer></body></html>"
)


def test_page():
    assert html_text.main_text([PAGE], trained()) == ["A & B\nFirst line goes on.\nSecond <one> here, with words enough to be read."]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- x", "<script>x", "</p></p>", "<a href=\"x>", "<p>" * 50, "&#xD800; &bogus; &#0;"])
def test_any_input(page):
    assert isinstance(html_text.main_text([page], trained())[0], str)


def test_blocks():
    found = leaves("x<div id='Side-Bar' hidden>a<i>b</i> <a>c</a><p>d<p>e</div><ul><li>f<li>g</ul><textarea>h</textarea>")
    assert [f.text for f in found] == ["x", "ab c", "d", "e", "f", "g", "h"]
    assert found[1].path == ("div @hidden .side .bar",) or "@hidden" in found[1].path[0]
    assert found[1].linked == 1 and found[4].path == ("ul", "li")


def test_slash_ends_no_script():
    """Unquoted attributes may end in a slash; only foreign elements can be empty."""
    texts = lambda page: [x.text for x in leaves(page)]
    assert texts("<p>a</p><script src=https://x.com/a/>var leak = 1;</script><p>b</p>") == ["a", "b"]
    assert texts("<style media=x/>p { leak }</style><p>b</p><template id=t/><p>leak</p></template>") == ["b"]
    assert texts("<p>a<svg viewBox='0 0 1 1'/>b</p><p>c<math/>d</p>") == ["ab", "cd"]
    assert texts("<p>a<svg><title>leak</title></svg>b</p><p>c<noscript>shown when unclosed") == ["ab", "cshown when unclosed"]


def test_unclosed_elements_take_linear_time():
    import time

    for name in ("svg", "noscript", "iframe", "object"):
        began = time.process_time()
        assert len(leaves(f"<p>x<{name}>" * 100_000)) == 100_000
        assert time.process_time() - began < 20


def test_held_out_layouts():
    author, good, total = _Author(123), 0, 0
    for _ in range(120):
        blocks, truth = author.page()
        blocks = [type(b)(b.path, b.text.replace(GOOD, "").replace(BAD, ""), b.linked) for b in blocks]
        keep = [k for k, b in enumerate(blocks) if b.text]
        got = label(trained(), [[blocks[k] for k in keep]])[0]
        good += sum(g == truth[k] for g, k in zip(got, keep, strict=True))
        total += len(keep)
    assert good / total > 0.97


def test_hidden_text_goes():
    body = "<p>The ship left the harbour early, as it did on most days, and nobody saw it go.</p>"
    for how in ("hidden", 'style="display: none"', 'style="visibility:hidden"'):
        page = f"<html><body><article><h1>A title</h1>{body}<div {how}><p>Some words that nobody is to see, and more of them.</p></div>{body}</article></body></html>"
        assert "nobody is to see" not in html_text.main_text([page], trained())[0]


def test_names_never_drawn(monkeypatch):
    """Layouts whose parts have names that no training page has: tags, links and place must do."""
    other = ["zq1", "kappa", "blk-7", "unit", "w-93", "lorem"]
    drawn = _Author.named
    monkeypatch.setattr(_Author, "named", lambda self, names, tags: drawn(self, other, tags))
    author, good, total = _Author(321), 0, 0
    for _ in range(120):
        blocks, truth = author.page()
        blocks = [type(b)(b.path, b.text.replace(GOOD, "").replace(BAD, ""), b.linked) for b in blocks]
        keep = [k for k, b in enumerate(blocks) if b.text]
        got = label(trained(), [[blocks[k] for k in keep]])[0]
        good += sum(g == truth[k] for g, k in zip(got, keep, strict=True))
        total += len(keep)
    assert good / total > 0.85, good / total


BODY = ["The old harbour was built in the spring, and its walls still keep the sea away from the town.", "Nobody knows who laid the first stone, but every family tells a story about it.", "When the wind turns, the boats come home early and the market opens late."]


def test_bare_divisions():
    page = "<html><body><div><a href='/'>Home</a> <a href='/n'>News</a> <a href='/a'>About</a></div>" + "".join(f"<div>{x}</div>" for x in BODY) + "<div>&copy; 2024 Harbour Times</div></body></html>"
    assert html_text.main_text([page], trained()) == ["\n".join(BODY)]


def test_table_layout():
    page = "<html><body><table><tr><td><a href='/1'>Menu one</a> <a href='/2'>Menu two</a></td><td>" + "".join(f"<p>{x}</p>" for x in BODY) + "</td></tr><tr><td>Contact us | Privacy</td></tr></table></body></html>"
    assert html_text.main_text([page], trained()) == ["\n".join(BODY)]


def test_bare_layouts_held_out():
    author, good, total = _Author(77), 0, 0
    for _ in range(300):
        blocks, truth = author.page()
        if not author.bare:
            continue
        blocks = [type(b)(b.path, b.text.replace(GOOD, "").replace(BAD, ""), b.linked) for b in blocks]
        keep = [k for k, b in enumerate(blocks) if b.text]
        got = label(trained(), [[blocks[k] for k in keep]])[0]
        good += sum(g == truth[k] for g, k in zip(got, keep, strict=True))
        total += len(keep)
    assert total > 400 and good / total > 0.95, good / total


def test_long_pages_in_parts_equal_whole():
    page = leaves("<article>" + "".join(f"<p>word {i}, and more of it.</p><ul><li><a>x{i}</a></ul>" for i in range(300)) + "</article>")
    whole = label(trained(), [page])[0]
    assert (label(trained(), [page], chunk=64)[0] == whole).all()
    x, mask = padded([vectors(page)])
    import numpy as np

    assert np.allclose(trained().margins_of_long(page, 37), trained().margins(x, mask)[0], atol=1e-4)


def test_gradients():
    import numpy as np

    model = Labeller(1)
    x, mask = padded([vectors(leaves(PAGE)), vectors(leaves("<p>a</p>"))])
    x = x.astype(np.float64)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    y = np.zeros(mask.shape, bool)
    y[0, 2:4] = True
    _, grad = model.gradients(x, mask, y)
    for name in ("xf", "hb", "cf", "o"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        old = model.p[name][at]
        losses = []
        for d in (1e-4, -1e-4):
            model.p[name][at] = old + d
            losses.append(model.gradients(x, mask, y)[0])
        model.p[name][at] = old
        assert abs((losses[0] - losses[1]) / 2e-4 - grad[name][at]) < 1e-3 * max(1, abs(grad[name][at]))


def test_query_rows(spark):
    rows = [(1, "u", PAGE, 3), (1, "u", PAGE, 3), (None, None, None, 3), (2, "v", "", 3), (3, "w", "<article>" + "<p>word word word, and more.</p>" * 3000 + "</article>", 3)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert sum(r.page_id == 1 for r in got) == 2 and [r.text for r in got if r.page_id in (None, 2)] == ["", ""]
    assert next(r for r in got if r.page_id == 3).text.count("\n") == 2999
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_table(spark):
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(lib.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert got[r.page_id] == "\n".join(p for p in parts if p)
