import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.llm import html_extraction, queries
from textloom.llm.html_extraction import Page

SCHEMA = "page_id long, url string, html string"
WORDS = ["salt", "river", "stone", "amber", "north", "cedar", "lamp", "quiet", "mill", "thorn"]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n)) + f" {rng.random()}."


def site(rng, host, pages, first):
    """Pages whose menu, offer and footer have no telling names or tags; paragraphs are their own."""
    out, want = [], {}
    offers = [f"Our great offer number {k} ends soon" for k in range(3)]
    for i in range(pages):
        blocks = [prose(rng, rng.randint(8, 40)) for _ in range(rng.randint(1, 5))]
        head = prose(rng, 4)
        html = (
            f'<html><body><div class="x1"><span>Start</span> <span>News</span> <span>Contact {host}</span></div><div id="m{i}"><h1>{head}</h1>' + "".join(f"<p>{b[:5]}<b>{b[5:]}</b></p>" for b in blocks)
            + f'<div class="x2"><p>{rng.choice(offers)}</p></div></div><div class="x3"><p>All rights with {host}</p></div></body></html>'
        )
        out.append((first + i, f"https://{host}/{i}", html))
        want[first + i] = "\n\n".join([head, *blocks])
    return out, want


@pytest.fixture(scope="module")
def sites():
    rng, rows, want = random.Random(2), [], {}
    for k, (host, pages) in enumerate((("big.example", 150), ("b.example", 40), *[(f"small{n}.example", 2) for n in range(10)])):
        own, texts = site(rng, host, pages, 1000 * k)
        rows, want = rows + own, want | texts
    return rows, want


@pytest.mark.parametrize("broadcast", [html_extraction.BROADCAST_PATHS, -1])
def test_what_pages_of_a_host_share_goes(spark, sites, broadcast, monkeypatch):
    """Menus, offers and footers without any mark, by the host's tree, of small hosts by the tree of all; by broadcast and by join."""
    from textloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows, want = sites
    df = spark.createDataFrame([*rows, rows[3], rows[3], (None, None, None), (7777, None, ""), (7778, "no url", "<p>alone")], SCHEMA).repartition(3)
    df = df.withColumns({x: F.lit("z") for x in ("host", "text", "gone", "of", "path", "page")})
    found = html_extraction.extracted(df, carry=("host", "text"), broadcast_paths=broadcast)
    assert found.columns == ["page_id", "url", "text", "n_chars", "host", "text"]
    got = Counter((r[0], r[2], r[3], r[4]) for r in found.collect())
    full = want | {7777: "", None: "", 7778: "alone"}
    assert got == Counter({(i, t, len(t), "z"): 3 if i == rows[3][0] else 1 for i, t in full.items()})


def test_importances_by_hand(spark, sites):
    """Presentation and content of each path against the formulas, taken over the pages of each host."""
    rows = sites[0]
    ways, texts = defaultdict(Counter), defaultdict(Counter)
    for _, url, html in rows:
        for path, (way, found) in Page(html).features().items():
            key = url.split("/")[2], path
            ways[key][way] += 1
            texts[key].update(found)
    want = {}
    for key, own in ways.items():
        m = sum(own.values())
        shape = -sum(n / m * math.log(n / m, m) for n in own.values()) if m > 1 else 1.0
        content = 1 - sum(math.log(n, m) for n in texts[key].values()) / len(texts[key]) if m > 1 and texts[key] else shape
        want[key] = m, 0.1 * shape + 0.9 * content
    features = [(*key, kind, feature, n) for table, kind in ((ways, False), (texts, True)) for key, own in table.items() for feature, n in own.items()]
    df = spark.createDataFrame(features, "host string, path long, is_text boolean, feature long, pages long")
    found = {(r["host"], r["path"]): (r["pages"], r["importance"]) for r in html_extraction.importances(df).collect()}
    assert found.keys() == want.keys()
    assert all(found[k] == (want[k][0], pytest.approx(want[k][1])) for k in want)


def test_copies_of_an_article_stay(spark):
    """A host whose pages are mostly, or all, one article: what is marked as an article is not lost."""
    page = '<body><nav>a</nav><article><h1>Title here</h1><p>The same text on each page.</p><p>And more of it.</p></article><p>Footer line</p></body>'
    rows = [(i, "https://copies.example/x", page) for i in range(60)]
    found = html_extraction.extracted(spark.createDataFrame(rows, SCHEMA)).select("text").distinct().collect()
    assert [r["text"] for r in found] == ["Title here\n\nThe same text on each page.\n\nAnd more of it."]


CASES = {
    "<p>a &amp; b&nbsp;c &lt;i&gt; &#233;<br>d": "a & b c <i> é d",
    "<article><header><h1>T</h1></header><p>one<p>two <b>bold<br><p>three</article><footer>f</footer>": "T\n\none\n\ntwo bold\n\nthree",
    '<main><p>x</p><section id="comments"><article class="comment"><p>Nice!</p></article></section></main>': "x",
    '<form class="page"><article><p>A long text of this page, wrapped in a form.</p></article><input value="x"></form>': "A long text of this page, wrapped in a form.",
    "<body class='has-sidebar'><p>kept</p><div class='leftSidebar'>gone</div><div role=banner>gone</div></body>": "kept",
    "<p>1 < 2 and <!-- no <p> --> 3 > 2</p><script>if (a < b) '</p>'</script><style>p{}</style><p>end": "1 < 2 and 3 > 2\n\nend",
    "<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>": "one\n\ntwo\n\na\n\nb\n\nc",
    '<p title="a > b">quoted</p><p>x': "quoted\n\nx",
    "<div><nav>only a menu</nav></div>": "",
    "<script>": "",
    "plain": "plain",
    "<": "<",
    "": "",
    "</p></div><p>closed too often</p></body></html>": "closed too often",
    '<div class="article-header">gone</div><article><div class="article-header"><h1>H</h1></div><p>t</p><div class="share">x</div></article>': "H\n\nt",
}


@pytest.mark.parametrize("html", CASES)
def test_markup(html):
    assert Page(html).text(set(), set()) == CASES[html]


def test_long_and_broken_pages():
    """Pages of a million unclosed, or unopened, or nested elements are read in one go."""
    for html in ("<p>a" * 100_000, "<div>" * 20_000 + "deep" + "</div>" * 20_000, "<a href=\"x" * 50_000, "</p>" * 100_000 + "end", "<" * 100_000):
        assert Page(html).text(set(), set()) is not None
        Page(html).features()


def test_query_and_its_sql(spark):
    """Whole fixture: the contract's columns; articles as SQL finds them."""
    path = "/root/testdata/sf0.001"
    df = queries.op12_html_extraction(spark, path)
    assert df.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    duckdb.sql(f"create or replace view pages as select * from '{path}/pages.parquet'")
    want = duckdb.sql(f"select page_id, url, text, n_chars from ({queries.oracle_sql()['op12_html_extraction']}) order by page_id").fetchall()
    assert [tuple(r) for r in df.orderBy("page_id").collect()] == want and sum(r[3] for r in want) > 1000


def test_no_pages(spark):
    assert html_extraction.extracted(spark.createDataFrame([], SCHEMA)).collect() == []
