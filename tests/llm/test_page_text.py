import html
import random
import re
from collections import Counter, defaultdict

import pytest

from eventskim.llm.page_text import Page, main_text, op12_main_text

PAGES = "page_id long, url string, html string"

FULL = """<!DOCTYPE html><!-- a > b --><html><head><title>T &amp; t</title><style>p{}</style>
<script>var t="</p><article>x</article>";</script></head><body class="has-sidebar">
<header class="site"><h1>Site</h1><nav><ul><li><a href="/">Home</a><li><a href='>'>More</a></ul></nav></header>
<div id="cookie-notice">We use <b>cookies</b>.</div><aside>Side <p>bar</aside>
<div class="banner-wrap"><article class="post"><header><h1>The\n head&shy;line</h1><p>By A&nbsp;B</p></header>
<p>One <b>two<i>three</b> &lt;four&gt;<br>five<p title="a>b">Six &eacute;&#233;&#xe9; AT&T &am
<div class="ad-slot">Buy!</div><ul><li>first<li>second <a href=x>link</a></ul>
<form><label>Mail<input name=q></label><button>Send</button></form>
<table><tr><td>c1<td>c2<tr><td>c3</table><div hidden>no</div><div style="display: none">no</div>
<blockquote>said</blockquote> tail <noscript>no js</noscript>
<section class="related"><article>Other</article></section></article></div>
<section id="comments"><article class="comment"><p>First!</p></article></section>
<footer>&copy; me</footer><script>x()</body></html>"""


def test_whole_page():
    assert Page(FULL).text().split("\n\n") == [
        "The head\xadline", "By A B", "One twothree <four> five", "Six ééé AT&T &am", "first", "second link",
        "c1", "c2", "c3", "said", "tail",
    ]


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("", ""), ("plain  &amp; text", "plain & text"), ("a < b <c", "a < b"), ("<p>a<!-- b", "a"), ("<p>a</ >b</p >c", "ab\n\nc"),
        ("<p a='>x", ""), ("<p a=b'c>x'", "x'"), ("<main>m<footer>f</footer></main>out", "m"), ("a<!-->b<!--->c", "abc"),
        ("<div role=main>m</div>out", "m"), ("<div class='entry-content'><p>m</div>out", "m"), ("<article></article><p>out", "out"),
        ("<form><article>a</article><input></form>b", "a"), ("<aside><article class=teaser>t</article></aside>b", "b"),
        ("<article>a</article>x<article>b</article>", "a\n\nb"), ("<article><div class=sharing>s</div>a</article>", "a"),
        ("<div class='content no-sidebar'>c</div>", "c"), ("<div class=top-Nav>n</div><div id=site_alert>a</div>b", "b"),
        ("<div class=ads-box>n</div><div class=adsorption>a</div>", "a"), ("<p>a<p>b<span>c</span>d</p>", "a\n\nbcd"), ("<b><p>x</b>y</p>z", "xy\n\nz"),
        ("<plaintext", ""), ("<textarea><p>a</textarea>b", "b"), ("<SCRIPT>a</sCript >b", "b"), ("<script>a</scripty>b", ""),
        ("x\x00y\x1cz\xa0&nbsp;w", "x\x00y z w"), ("&notit; &#0; &amp;lt;", "¬it; � &lt;"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\n\nb\n\nc"),
    ],
)
def test_markup(markup, text):
    assert Page(markup).text() == text


def article_of(markup):
    """Blocks of the generated pages' article element, by patterns."""
    inner = markup[markup.index("<article>") + 9 : markup.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub(r"<br>|</?b>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", inner))
    return "\n\n".join(filter(None, blocks))


def test_table(small):
    pages = {r.page_id: r for r in small("pages").collect()}
    out = op12_main_text(small("pages")).collect()
    assert len(out) == len(pages) > 0
    for r in out:
        assert r.url == pages[r.page_id].url and r.text == article_of(pages[r.page_id].html) and r.n_chars == len(r.text)


def words(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(999)}" for _ in range(n))


def site_pages():
    """Pages without an article element on one host, with templates that only their counts show."""
    rng = random.Random(6)
    top, left = "<div class=x1><p>Welcome to all</p><ul><li>One<li>Two</ul></div>", "<div><span>Left</span> side</div>"
    rows, texts = [], []
    for i in range(60):
        body = [words(rng, 12) for _ in range(3)]
        rows.append((i, f"http://u@Big.Example.com:80/{i}", f"{top}<div>{left if i % 4 else ''}<p>{'<p>'.join(body)}</div>"))
        texts.append("\n\n".join(body))
    rows += [(100 + i, f"https://small.org/{i}", f"{top}<p>own {i}") for i in range(4)]
    texts += [f"Welcome to all\n\nOne\n\nTwo\n\nown {i}" for i in range(4)]
    rows += [(200 + i, u, f"{top}<p>none {i}") for i in range(9) for u in (None, "not a url")]
    texts += [f"Welcome to all\n\nOne\n\nTwo\n\nnone {i}" for i in range(9) for _ in "12"]
    # Copies of a page are one page; an article's paragraphs stay however often they recur.
    rows += [(300 + i, f"https://copies.org/{i}", "<div><p>Copied</div><p>page") for i in range(30)]
    texts += ["Copied\n\npage"] * 30
    shared = words(rng, 40)
    for i in range(30):
        notice = "<div class=k>Read more of this</div>"
        rows.append((400 + i, f"https://news.org/{i}", f"<article><h1>{i}</h1>{notice}<p>{shared}<p>{words(rng, 20)}</article>"))
        texts.append(f"{i}\n\n{shared}\n\n" + rows[-1][2].split("<p>")[-1][:-10])
    return rows, texts


def test_templates(spark):
    rows, texts = site_pages()
    extra = [(*r, "old", 1, "h") for r in rows]
    pages = spark.createDataFrame(extra, f"{PAGES}, text string, print int, host string").repartition(7)
    out = {(r.page_id, r.url): r.text for r in op12_main_text(pages).collect()}
    assert out == {(r[0], r[1]): t for r, t in zip(rows, texts)}
    kept = main_text(pages, into="host").collect()
    assert Counter((r.text, r.print) for r in kept) == {("old", 1): len(rows)}
    none = {r.page_id: r.text for r in main_text(pages, least=1000).collect()}
    assert none[0].startswith("Welcome to all") and "Read more" in none[400]
    share = {r.page_id: r.text for r in main_text(pages, share=0.8).collect()}
    assert share[1].startswith("Left side") and not share[1].startswith("Welcome")


def test_templates_against_brute_force(spark):
    """Counts of subtrees by a plain loop over random pages, of hosts of all sizes."""
    rng = random.Random(8)
    pieces = [f"<div class=c{i}><p>{words(rng, 3)}</p>{'<hr>' * (i % 2)}</div>" for i in range(12)]
    rows = []
    for i in range(300):
        host = f"h{min(rng.randrange(12), 4)}"
        own = f"<section>{words(rng, 5)}</section>"
        page = "".join(rng.sample(pieces, rng.randrange(5))) + own
        rows.append((i, f"http://{host}/{i}", f"<article>{page}</article>" if i % 3 == 0 else page))
    on, per_host = defaultdict(set), defaultdict(set)
    for _, url, markup in rows:
        page = Page(markup)
        for h in page.hashes(page.candidates()).values():
            on[url[7:9], h].add(page.text())
            per_host[url[7:9]].add(page.text())
    gone = defaultdict(set)
    for (host, h), texts in on.items():
        if len(texts) >= 5 and len(texts) >= 0.2 * len(per_host[host]):
            gone[host].add(h)
    want = {i: Page(m).text(frozenset(gone[u[7:9]])) for i, u, m in rows}
    out = main_text(spark.createDataFrame(rows, PAGES), share=0.2).collect()
    assert {r.page_id: r.text for r in out} == want
    assert any(want[i] != Page(m).text() for i, _, m in rows)


def test_odd_pages(spark):
    long = "<article>" + "".join(f"<p>w{i} &amp;" for i in range(40_000)) + "</article>"
    rows = [(1, None, None), (None, "http://a.b", ""), (2, "", "<" * 50_000), (3, "http://a.b", "<div>" * 20_000 + "deep"), (4, "x", long)]
    rows += [(5, "http://a.b", "<p>same")] * 3 + [(6, "http://a.b", '<a "' * 30_000), (7, "http://a.b", "<!--" * 30_000)]
    out = op12_main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(out) == len(rows)
    text = {r.page_id: r.text for r in out}
    assert text[1] == text[None] == "" and text[2] == "<" * 50_000 and text[3] == "deep" and text[5] == "same"
    assert text[4] == "\n\n".join(f"w{i} &" for i in range(40_000)) and text[7] == ""
    assert op12_main_text(spark.createDataFrame([], PAGES)).collect() == []
