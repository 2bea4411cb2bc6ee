import glob
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests import local_web
from textloom.session import stored
from textloom.sources import feeds, html, pages, sinks


@pytest.fixture
def web(tmp_path_factory, monkeypatch):
    folder = tmp_path_factory.mktemp("web")
    monkeypatch.setenv("TEXTLOOM_TEST_WEB", str(folder))
    return folder


@pytest.fixture
def opener(web, monkeypatch, tmp_path, spark):
    """A module of its own for this folder, sent to the workers."""
    name = f"local_web_{abs(hash(str(web)))}"
    path = tmp_path / f"{name}.py"
    with open(local_web.__file__) as f:
        path.write_text(f"import os\nos.environ['TEXTLOOM_TEST_WEB'] = {str(web)!r}\n" + f.read())
    spark.sparkContext.addPyFile(str(path))
    monkeypatch.syspath_prepend(str(tmp_path))
    return f"{name}:open_local"


def board(numbers):
    rows = "".join(f'<tr><td>{n}</td><td><a href="/view?no={n}">A post with number {n}</a></td><td>2026-09-{n % 28 + 1:02d}</td></tr>' for n in numbers)
    return f"<html><body><table>{rows}</table></body></html>"


NOW = datetime(2026, 9, 26, 3, 0)


def listed(spark, opener, urls, **options):
    found = stored(pages.fetched(urls, opener, delay=0, backoff=0, **options), "pages").where("ok")
    text = found.select(F.col("ordinal").cast("int").alias("page"), html.decoded(F.col("page")).alias("html"), F.col("url").alias("base"))
    posts = html.posts(html.candidate_groups(text, "page", "html", "base"), F.lit(NOW).cast("timestamp"))
    return [(r["rank"], r["url"]) for r in html.across_pages(posts).orderBy("rank").collect()]


def test_board_over_pages(spark, web, opener):
    """Pages of a list are fetched and joined; a broken connection is tried again; a missing page and one without new posts end the list."""
    base = "http://board.example/list"
    urls = pages.list_pages(spark, base, "page", 1, 4)
    assert [r["url"] for r in urls.orderBy("ordinal").collect()] == [f"{base}?page={i}" for i in range(1, 5)]
    local_web.put(f"{base}?page=1", board([9, 8, 7]), failures=2)
    local_web.put(f"{base}?page=2", board([7, 6, 5]))
    local_web.put(f"{base}?page=3", board([6, 5, 7]))
    local_web.put(f"{base}?page=4", board([1, 2, 3]))
    view = lambda n: f"http://board.example/view?no={n}"
    assert listed(spark, opener, urls) == [(i + 1, view(n)) for i, n in enumerate([9, 8, 7, 6, 5])]
    assert local_web.requests()[f"{base}?page=1"] == 3 and local_web.requests()["http://board.example/robots.txt"] >= 1


def test_failures_and_rules(spark, web, opener):
    """What is never answered, what is refused, what the rules forbid, and other origins, which are not kept waiting."""
    local_web.put("http://a.example/robots.txt", "User-agent: *\nDisallow: /closed/")
    for path in ("open", "closed/x", "late"):
        local_web.put(f"http://a.example/{path}", path, failures=99 if path == "late" else 0)
    local_web.put("http://b.example/gone", "no", status=410)
    local_web.put("http://b.example/robots.txt", "User-agent: *\nDisallow: /", status=500)
    rows = ["http://a.example/open", "http://a.example/closed/x", "http://a.example/late", "http://b.example/gone", "ftp://c/x", " ", None, "http://a.example/missing", "http://a.example/open"]
    df = spark.createDataFrame(list(enumerate(rows)), "ordinal int, url string")
    found = {r["ordinal"]: r for r in pages.fetched(df, opener, delay=0, backoff=0).collect()}
    assert sorted(found) == [0, 1, 2, 3, 4, 7, 8]
    assert [(found[i]["allowed"], found[i]["ok"], found[i]["status"], found[i]["attempts"]) for i in sorted(found)] == [(True, True, 200, 1), (False, False, None, 0), (True, False, None, 3), (True, False, 410, 1), (True, False, None, 0), (True, False, 404, 1), (True, True, 200, 1)]
    assert bytes(found[0]["page"]) == b"open" and found[2]["error"].startswith("ConnectionResetError")
    asked = local_web.requests()
    assert "http://a.example/closed/x" not in asked and asked["http://a.example/late"] == 3 and asked["http://a.example/robots.txt"] == 1
    free = pages.fetched(df.where("ordinal = 1"), opener, delay=0, robots=False).first()
    assert free["ok"] and bytes(free["page"]) == b"closed/x"


def test_waiting(monkeypatch, web):
    """A delay between requests of one origin, none before the first or at another origin, and growing waits between attempts."""
    waits = []
    monkeypatch.setattr(pages.time, "sleep", waits.append)
    local_web.put("http://a.example/3", "x", failures=2)
    for url in ("http://a.example/1", "http://a.example/2", "http://b.example/1"):
        local_web.put(url, "x")
    rows = [(i, u) for i, u in enumerate(["http://a.example/1", "http://a.example/2", "http://b.example/1"])]
    assert all(r[4] for r in pages.fetch(iter(rows), local_web.open_local, delay=1.5)) and waits == [1.5]
    waits.clear()
    assert [r[6] for r in pages.fetch(iter([(0, "http://a.example/3")]), local_web.open_local)] == [3] and waits == [2.0, 4.0]


def test_a_stream_goes_on(spark, web, opener, tmp_path):
    """Lines that are added make the next micro-batch; a restart asks for no page twice; a line without an end waits."""
    spark.dataSource.register(pages.PageSource)
    urls, out = tmp_path / "urls.txt", str(tmp_path / "out")
    for i in range(6):
        local_web.put(f"http://s{i % 2}.example/{i}", f"page {i}")

    def run():
        stream = spark.readStream.format("textloom_pages").option("opener", opener).option("delay", "0").load(str(urls))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out)
        query.awaitTermination(120)
        return {r["url"]: bytes(r["page"]).decode() for r in spark.read.schema(pages.PAGE).parquet(out).collect()}

    urls.write_text("http://s0.example/0\nhttp://s1.example/1\n\nhttp://s0.example/2")
    assert run() == {"http://s0.example/0": "page 0", "http://s1.example/1": "page 1"}
    urls.write_text("http://s0.example/0\nhttp://s1.example/1\n\nhttp://s0.example/2\nhttp://s1.example/3\n")
    assert len(run()) == 4 and len(run()) == 4
    assert all(n == 1 for u, n in local_web.requests().items() if "robots" not in u)
    batch = spark.read.format("textloom_pages").option("opener", opener).option("delay", "0").load(str(urls))
    assert batch.count() == 4 and batch.rdd.getNumPartitions() == 2


def test_search_over_pages(spark, web, opener):
    """A first page that fails is told, a later one ends the keyword, and so does a short page; ranks go on from page to page."""
    feeds.register(spark)
    url = "http://search.example/?q={query}&start={start}&n={display}&sort={sort}"
    answer = lambda first, n: json.dumps({"items": [{"title": f"<b>t{i}</b>", "originallink": f"http://x/{i}", "pubDate": "?"} for i in range(first, first + n)]})
    asked = lambda q, start, n: url.format(query=q, start=start, display=n, sort="date")
    local_web.put(asked("tea", 1, 100), answer(1, 100))
    local_web.put(asked("tea", 101, 100), answer(101, 30))
    local_web.put(asked("tea", 201, 50), answer(201, 50))
    local_web.put(asked("later", 1, 100), answer(1, 100))
    local_web.put(asked("later", 101, 100), "broken {")
    local_web.put(asked("never", 1, 100), "", status=500)
    found = spark.read.format("textloom_search").option("keywords", "tea\n later \n\nnever\nmissing").option("url", url).option("count", "250").option("sort", " Date ").option("opener", opener).load()
    assert {(r["keyword"], r["page"], r["ok"], len(r["items"])) for r in found.collect()} == {("tea", 0, True, 100), ("tea", 1, True, 30), ("later", 0, True, 100), ("never", 0, False, 0), ("missing", 0, False, 0)}
    hits = feeds.search_hits(found, ["tea"])
    assert [r["rank"] for r in hits.orderBy("rank").collect()] == list(range(1, 131))


def test_one_csv_file(spark, tmp_path):
    """Order, quoting, mark and header; many tasks, one file, no parts left."""
    path = str(tmp_path / "out.csv")
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit('say "x",\n한글 '), "id")).alias("text")).repartition(7).orderBy(F.desc("id"))
    sinks.write_csv(df, path)
    data = open(path, "rb").read()
    assert data.startswith(b'\xef\xbb\xbf"id","text"\n"999",""\n"998","say ""x"",\n')
    import csv

    with open(path, encoding="utf-8-sig", newline="") as f:
        rows = list(csv.reader(f))
    assert rows[1:] == [[str(i), "" if i % 3 == 0 else f'say "x",\n한글 {i}'] for i in range(999, -1, -1)]
    assert os.listdir(tmp_path) == ["out.csv"]
    with pytest.raises(Exception, match="FileExistsError"):
        sinks.write_csv(df, path)
    sinks.write_csv(df.limit(0), path, overwrite=True)
    assert open(path, "rb").read() == b'\xef\xbb\xbf"id","text"' and os.listdir(tmp_path) == ["out.csv"]


def test_one_article_file(spark, tmp_path):
    """Statistics, the latest date, and articles with lists, dates and nulls; read back as JSON."""
    path = str(tmp_path / "out.json")
    rows = [(i, None if i == 3 else f"2026-09-{i + 1:02d}", ["a", None], datetime(2026, 1, 1, i), {"k": i}) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, published string, words array<string>, at timestamp, counts map<string,int>").repartition(5).orderBy("id")
    sinks.write_articles(df, path, {"collected": 25, "deduped": 20})
    found = json.load(open(path))
    assert found["stats"] == {"collected": 25, "deduped": 20} and found["latest_published"] == "2026-09-20"
    assert [a["id"] for a in found["articles"]] == list(range(20))
    assert found["articles"][3] == {"id": 3, "published": None, "words": ["a", None], "at": "2026-01-01T03:00:00", "counts": {"k": 3}}
    sinks.write_articles(df.limit(0), path, overwrite=True)
    assert json.load(open(path)) == {"stats": {}, "latest_published": None, "articles": []}


def test_a_task_that_dies_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    df = spark.range(100).repartition(4).select("id", F.expr("if(id = 77, raise_error('dies'), id)").alias("x"))
    with pytest.raises(Exception, match="dies"):
        sinks.write_csv(df, path)
    assert glob.glob(f"{tmp_path}/*") == []


PARAGRAPH = "This is a paragraph of the text, and it goes on for a while so that it counts."
PLAIN_PAGE = f"""<html><head><title>T</title></head><body><div><a href="/1">Home</a> <a href="/2">A longer link of the menu</a></div><div>Short line</div>
<div><h2>Head</h2><p>{PARAGRAPH}</p><p>Short.</p><div>{PARAGRAPH}<br>{PARAGRAPH} <a href="/x">with a link</a></div><p>{PARAGRAPH}</p></div>
<ul><li><a href="/3">Another article to read</a></li><li><a href="/4">And one more of these links here</a></li></ul><p>Tail</p><footer>{PARAGRAPH}</footer></body></html>"""


def test_main_text_without_article():
    """The best stretch of blocks: short lines within stay, menus and lists of links around it go."""
    body = html.extracted(PLAIN_PAGE)[0]
    assert body == "\n".join([PARAGRAPH, "Short.", PARAGRAPH, f"{PARAGRAPH} with a link", PARAGRAPH])
    blocks = html.blocks_of(html.Tree(PLAIN_PAGE).first("body"), html.CHROME)
    scores = [len(t) - 2 * n - html.STRICT_COST for t, n in blocks]
    best = max((sum(scores[a:b]), -b, -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))
    assert html.best_stretch(blocks, html.STRICT_COST) == "\n".join(t for t, _ in blocks[-best[2] : -best[1]])


def test_short_texts_get_a_loose_pass():
    """Under 250 characters the whole body is read again, even what the strict pass leaves out, and the longer text stays."""
    page = f"<body><article><p>{PARAGRAPH}</p></article><aside><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></aside><nav><a href=1>{'link ' * 40}</a></nav></body>"
    assert html.extracted(page)[0] == "\n".join([PARAGRAPH] * 3)
    assert html.extracted(f"<article><p>{PARAGRAPH * 4}</p></article><aside><p>{PARAGRAPH * 9}</p></aside>")[0] == PARAGRAPH * 4
    assert html.extracted("<body><nav><a href=1>only links</a></nav></body>")[0] == html.extracted("")[0] == ""
    assert html.extracted(f"<main><p>{PARAGRAPH * 4}</p></main><p>{PARAGRAPH * 9}</p>")[0] == PARAGRAPH * 4


def test_body_by_selector(spark):
    """The first element that is named; where there is none, the page's main text."""
    page = f'<div class="b c"><p>one</p> two</div><div class="b">three</div><article>{PARAGRAPH * 4}</article>'
    df = spark.createDataFrame([(1, page, None, "P", None), (2, f"<article>{PARAGRAPH * 4}</article>", "own", None, None), (3, "", None, None, None), (4, None, None, None, None)], "id int, page string, title string, publisher string, published string")
    found = {r["id"]: (r["body"], r["title"], r["publisher"]) for r in html.with_content(df, "page", "div.b").collect()}
    assert found == {1: ("one\ntwo", "", "P"), 2: (PARAGRAPH * 4, "own", "")}


def test_word_files(spark):
    files = ['﻿"단어","품사"\r\n"태권도","NNG"\r\n , x\r\n겨루기,VV\r\n', "word\nA,NNP\n", "a\nword\n", "", None]
    df = spark.createDataFrame(list(enumerate(files)), "i int, t string")
    assert [tuple(r) for r in feeds.words_from_csv(df, "t", "i").orderBy("i", "word").collect()] == [(0, "겨루기", None), (0, "태권도", "NNG"), (1, "A", "NNP"), (2, "a", None), (2, "word", None)]
    pasted = spark.createDataFrame([("a, b\n\n ,c ,NNG",), (None,)], "t string")
    assert sorted(r["word"] for r in feeds.words_from_text(pasted, "t").collect()) == ["NNG", "a", "b", "c"]


def test_references_that_are_cut(spark):
    """Only whole references are decoded: a title that ends within one keeps what is left of it, in page_title, page_extract and filled_articles."""
    page = '<html><title>a &amp; b&lt;c &amp</title><body><article><p>x &ampx; &#38; &nosuch; &amp</p></article><a href="/l?a=1&copy=2&amp;b=3">n</a><script>a && b</script></body></html>'
    pages = spark.createDataFrame([(1, page, None, None, None)], "page_id int, html string, title string, publisher string, published string")
    found = pages.select(html.page_content("html").alias("c"), html.all_links("html", F.lit("http://h/")).alias("l")).first()
    assert (found["c"]["title"], found["c"]["body"]) == ("a & b<c &amp", "x &ampx; & &nosuch; &amp")
    assert [x["url"] for x in found["l"]] == ["http://h/l?a=1&copy=2&b=3"]
    filled = html.with_content(pages, "html").first()
    assert (filled["title"], filled["body"]) == ("a & b<c &amp", "x &ampx; & &nosuch; &amp")
