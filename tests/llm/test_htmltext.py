import html
import random
import re
from collections import Counter

from creditline.llm import queries
from creditline.llm.htmltext import extract, host_of, outside, page_blocks
from tests.conftest import MEDIUM

PAGES = "page_id bigint, url string, html string, row string, blocks string, gone string, host string"


def text(page):
    return " ".join(page_blocks(page)[0])


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav>menu</nav><div id="cookie-notice">ok?</div>
    <div id="main-content"><article class="post with-comments"><h1>T&eacute;st &lt;b&gt; &amp &am</h1><p>One<b>two</b>three
    <p>four<br>five <script>if(a<b) x="</p>"</script>&nbsp; six<!-- not <p>this</p> --><div class="share-buttons">share</div>
    <ul><li>a<li>b</ul><table><tr><td>x<td>y</table><form><input value=">">f</form><aside>see also</aside>
    <section id=comments><p>bad</section><p hidden>not shown</article><article class="comment">a reader</article></div>
    <div class="sidebar">s</div><footer>f</footer></body></html>"""
    assert text(page) == "Tést <b> & &am Onetwothree four five six a b x y"


def test_pages_without_article_and_broken_markup():
    assert text("<body><nav>n</nav><main><p>a</main><p>b</body>") == "a"
    assert text("<p>a<p>b <i>c</i>d &#x41;&#66;") == "a b cd AB"
    assert text("only text, 1 < 2 & 3") == "only text, 1 < 2 & 3"
    assert text("<article><p>open <b>end") == "open end"
    assert text("<article><p>a<script>x") == "a"
    # a quote that never closes ends with its tag
    assert text("<article><div class='x>y'>a</div><div class=\"b>a") == "a a"
    assert text("") == "" and text("<!-- only") == "" and text("<") == "<"
    assert text("<div>" * 5000 + "deep") == "deep"


def test_hosts():
    assert host_of("https://u:p@WWW.Ex.com:80/a?b") == "www.ex.com"
    assert (host_of(None), host_of("foo.com/x"), host_of("")) == ("", "foo.com", "")


def test_query_against_plain_reading_of_these_pages(spark):
    rows = {r.page_id: r for r in queries.op1_html_text(spark, MEDIUM).collect()}
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)(?:>|$)", " ", re.sub(r"</?b(?:>|$)", "", inner))).split())
        assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want) and rows[p.page_id].url == p.url


def test_templates_by_host(spark):
    def page(i, box):
        return f"<body><div><div><div>Shop {box}</div></div><p>Story {i} of the day</p><p>Buy now</p></div></body>"

    rows = [(i, f"https://a.example/{i}", page(i, "one")) for i in range(8)]
    rows += [(100 + i, f"https://b.example/{i}", page(i, "two")) for i in range(3)]
    # copies of one page make no template of its text
    rows += [(200 + i, f"https://c.example/{i}", page(7, "three")) for i in range(40)]
    rows += [(300, None, None), (None, "https://a.example/x", ""), (0, "https://a.example/0", page(0, "one"))]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES).repartition(3)
    got = {(r.page_id, r.url): r.text for r in extract(df).collect()}
    assert extract(df).count() == len(rows)
    assert all(got[i, f"https://a.example/{i}"] == f"Story {i} of the day" for i in range(8))
    assert all(got[100 + i, f"https://b.example/{i}"] == f"Shop two Story {i} of the day Buy now" for i in range(3))
    assert all(got[200 + i, f"https://c.example/{i}"] == "Shop three Story 7 of the day Buy now" for i in range(40))
    assert got[300, None] == "" and got[None, "https://a.example/x"] == ""


def test_recurring_prose_of_articles_stays(spark):
    rows = [(i, "http://h/", f"<article><h1>T{i}</h1><div><p>Shared words</p></div><div>More from us</div></article>") for i in range(9)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES)
    assert {r.text for r in extract(df).collect()} == {f"T{i} Shared words" for i in range(9)}


def test_recurring_boxes_of_prose_in_articles_go(spark):
    rows = [(i, "http://h/", f"<article><h1>T</h1><div><p>Story {i}</p><blockquote>Quoted</blockquote></div><p>Said</p><div><p>Write to us</p></div></article>")
            for i in range(30)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES)
    assert {r.page_id: r.text for r in extract(df).collect()} == {i: f"T Story {i} Quoted Said" for i in range(30)}


def test_template_bar_does_not_grow_with_the_host(spark):
    rows = [(i, "http://h/", f"<body><p>Page {i}</p>{'<div>Old notice</div>' if i < 55 else ''}{'<div>Rare</div>' if i >= 5960 else ''}</body>") for i in range(6000)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES)
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert got == {i: f"Page {i}{' Rare' if i >= 5960 else ''}" for i in range(6000)}


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], PAGES)).collect() == []


def test_templates_against_a_recount_of_all_pages(spark):
    """Random trees from few pieces, so that subtrees of all sizes recur: counted and cut on the trees themselves."""
    rng = random.Random(8)

    def tree(depth):
        tag = rng.choice(("div", "section", "ul")) if depth else "p"
        parts = [rng.choice(("sun", "sea", "sky", "salt", "sand", f"own {rng.random()}")) if not depth or rng.random() < 0.3 else tree(depth - 1)
                 for _ in range(rng.randint(1, 3))]
        return tag, tuple(parts)

    def markup(node):
        return node if isinstance(node, str) else f"<{node[0]}>{' '.join(map(markup, node[1]))}</{node[0]}>"

    def subtrees(node):
        return set() if isinstance(node, str) else {canon(node)}.union(*map(subtrees, node[1]))

    def canon(node):  # neighbouring pieces of text are one
        out = []
        for p in node[1]:
            if isinstance(p, str) and out and isinstance(out[-1], str):
                out[-1] += " " + p
            else:
                out.append(p if isinstance(p, str) else canon(p))
        return node[0], tuple(out)

    def words(node, gone):
        if isinstance(node, str):
            return [node]
        return [] if canon(node) in gone else [w for p in node[1] for w in words(p, gone)]

    pool = [tree(rng.randint(0, 3)) for _ in range(40)]
    pages = [(i, f"h{rng.choice('aab')}.example", [rng.choice(pool) if rng.random() < 0.6 else tree(2) for _ in range(4)]) for i in range(300)]
    pages += [(1000 + i, host, body) for i, (_, host, body) in enumerate(pages[:30])]
    df = spark.createDataFrame(
        [(i, f"http://{h}/{i}", f"<html><body>{' '.join(map(markup, b))}</body></html>", "x", "x", "x", "x") for i, h, b in pages], PAGES)
    got = {r.page_id: r.text for r in extract(df.repartition(5), min_pages=3, min_share=0.02).collect()}
    cut = 0
    for host in ("ha.example", "hb.example"):
        distinct = {" ".join(w for n in b for w in words(n, ())): b for _, h, b in pages if h == host}
        count = Counter(s for b in distinct.values() for s in set().union(*map(subtrees, b)))
        gone = {s for s, n in count.items() if n >= 3 and n >= 0.02 * len(distinct)}
        for i, h, b in pages:
            if h == host:
                assert got[i] == " ".join(w for n in b for w in words(n, gone)), i
                cut += got[i] != " ".join(w for n in b for w in words(n, ()))
    assert len(got) == len(pages) and 100 < cut


def test_pages_of_deep_elements_take_linear_memory(spark):
    deep = "<div>" * 100_000
    blocks, spans, subtrees = page_blocks(f"<body>{deep}a</div>b{'</div>' * 99_999}<p>c</body>")
    assert blocks == ["a", "b", "c"] and len(spans) == 100_001 == len(subtrees)
    assert {(a, e) for _, a, e in spans} == {(0, 1), (0, 2), (2, 3)}
    rows = [(i, "http://h/", f"<body>{deep}same{'</div>' * 100_000}<p>page {i}", "x", "x", "x", "x") for i in range(6)]
    assert {r.page_id: r.text for r in extract(spark.createDataFrame(rows, PAGES)).collect()} == {i: f"page {i}" for i in range(6)}


def test_blocks_outside_spans():
    assert outside(5, [1, 1, 3], [2, 3, 4]).tolist() == [True, False, False, False, True]
    assert outside(2, [], []).tolist() == [True, True] and outside(0, [], []).tolist() == []
