"""Main text of pages: planted articles among clutter, the host's vote, awkward markup and rows."""

from __future__ import annotations

import random

import pytest

from hustings.llm import maintext, markup

PAGES = "page_id long, url string, html string, host string, path string, best long, salt int"


def own_text(html):
    """What a page alone makes of itself."""
    page = markup.read(html)
    stays = markup.kept(page)
    best = markup.best_container(page, markup.path_scores(page, stays))
    return "" if best is None else "\n".join(t for i, (t, s) in enumerate(zip(page.blocks, stays, strict=True)) if s and page.starts[best] <= i < page.ends[best])


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(n)) + "."


def page_of(body):
    return f"<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{{}}</style><script>var x='<p>no</p>';</script></head><body>{body}</body></html>"


CLUTTER = """<header class="top"><h1>Site</h1><nav><a href="/">Home</a></nav></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies for a long list of reasons that nobody reads, and then some more.</p></div><aside class="sidebar"><p>Sidebar text that is long enough to look like an article, is it not.</p></aside>"""
AFTER = """<section id="comments"><article class="comment"><p>First! A reader's comment that goes on and on for quite a while.</p></article></section>
<form action="/s"><input><label>Subscribe</label><p>Your mail please</p></form><div class="ad"><p>Buy now, this is an advert of many words indeed.</p></div><footer>&copy; all rights</footer>"""
LAYOUTS = ['<article class="post-{i}">{a}</article>', '<main id="content">{a}</main>', '<div class="wrap"><div class="entry-content">{a}</div></div>', '<div class="c{i}"><div class="x9">{a}</div><div class="x3"><a href="/x">More of this</a> <a href="/y">And that</a></div></div>', '<table><tr><td class="nav"><a href="/">x</a></td><td class="z">{a}</td></tr></table>', '<form id="aspnet"><main>{a}</main></form>']


@pytest.mark.parametrize("layout", LAYOUTS)
def test_planted_articles_come_out_whole(layout):
    rnd = random.Random(8)
    for i in range(20):
        title, texts = prose(rnd, 5), [prose(rnd, rnd.randint(4, 60)) for _ in range(rnd.randint(2, 8))]
        inner = f"<h1>{title}</h1>" + "".join(f"<p>{t}</p>" for t in texts)
        inner = inner.replace("</p><p>", '</p><div class="share"><a href="#">Share it</a></div><p>', 1)
        assert own_text(page_of(CLUTTER + layout.format(i=i, a=inner) + AFTER)) == "\n".join([title, *texts])


def test_markup_as_it_comes():
    assert own_text("<article><p>one<p>two <b>bold<p>three &lt;x&gt; &eacute;&nbsp;&#x41;&am</article>") == "one\ntwo bold\nthree <x> é A&am"
    assert own_text("<article><h2>a</h2>loose\n\n text<br>here<ul><li>x<li>y <i>z</i></ul><pre>p\n  q</pre></article>") == "a\nloose text here\nx\ny z\np q"
    assert own_text("<article><p title='a > b' data-x=it's>kept</p><!-- <p>not</p> --><p hidden>gone</p><p style='display: none'>gone</p><p title='the hidden one'>here</p></article>") == "kept\nhere"
    assert own_text("<article><p>a < b and 1<2</p><script>if (a</b) '</article>'</script><p>c</p></article>") == "a < b and 1<2\nc"
    assert own_text("<article><header class='h'><h1>Title</h1><p>by line</p></header><p>x</p><footer>tags</footer></article>") == "Title\nx"
    assert own_text("<nav><a href=x>only a menu</a></nav><p class=cookie>and a notice</p>") == ""
    assert own_text("<body class='has-sidebar no-comments'><div class='content sidebar-left'><p>Some text that is the article of it.</p></div>") == "Some text that is the article of it."
    assert own_text("<article><p>cut tag</p><p>open <a href='x") == "cut tag\nopen"
    assert own_text("plain words, no markup at all") == "plain words, no markup at all"
    assert own_text("") == "" and own_text("<") == "<"


def test_deep_and_long_pages_take_linear_time():
    assert own_text("<div>" * 50_000 + "<p>deep down</p>") == "deep down"
    assert own_text("<article>" + "<p><b>x y<br>" * 50_000).count("\n") == 49_999
    assert own_text("<p>" + "<a href='" * 20_000 + "</p>") is not None
    assert len(own_text("<p>" + "word " * 400_000)) == 1_999_999


@pytest.fixture(scope="module")
def site():
    """Of one host most pages have a plain layout, and one whose own best container is not the host's; of another host one page; others without host."""
    rnd = random.Random(2)
    rows, want = [], {}
    for i in range(30):
        text = [prose(rnd, 40), prose(rnd, 30)]
        rows.append((i, "http://Big.example:80/x?y", page_of(f'<div class="a{i}"><div class="b">{"".join(f"<p>{t}</p>" for t in text)}</div><div class="c">{prose(rnd, 6)}</div></div>')))
        want[i] = "\n".join(text)
    rows.append((30, "https://big.example/short", page_of(f'<div class="a7"><div class="b"><p>Short.</p></div><div class="d"><p>{prose(rnd, 80)}</p></div></div>')))
    want[30] = "Short."
    for i, url in ((31, "http://lone.example"), (32, None), (33, "no host"), (34, "http://")):
        rows.append((i, url, page_of(f'<div class="q"><div class="d"><p>{(text := prose(rnd, 50))}</p></div></div>')))
        want[i] = text
    rows += [(35, "http://big.example/", None), (36, "http://big.example/", ""), (None, "http://big.example/", rows[3][2]), (37, "http://big.example/", "<nav><a>x</a></nav>")]
    return rows, want


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_the_host_decides(spark, site, broadcast):
    rows, want = site
    frame = spark.createDataFrame([(*r, "h", "p", 1, 2) for r in rows + rows[:2]], PAGES).repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = maintext.main_texts(frame).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == len(rows) + 2 and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert texts == want | {35: "", 36: "", 37: "", None: want[3]}
    assert own_text(rows[30][2]) != "Short." and next(r.path for r in got if r.page_id == 30) == "html>body>div.aN>div.b"


def test_no_pages(spark):
    assert maintext.main_texts(spark.createDataFrame([], PAGES)).count() == 0
