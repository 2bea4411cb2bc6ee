import random
from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import analysis, clean, collect, dedup, insights, search
from textloom.plans import catalog
from textloom.sources import feeds, html

BODY = "본문 문장은 이렇게 이어지며 사실을 전한다. " * 6
STEPS = [
    ("caption_lines", "사진 | 설명|\n" + BODY, BODY), ("caption_lines", "|표 하나|\n|표 둘|\n끝", "|표 하나|\n|표 둘|\n끝"),
    ("summary_box", "요약 하나\n전체 내용을 이해하기 위해서는 기사 본문과 함께 읽어야 합니다.\n본문", "본문"),
    ("agency_prefixes", "(서울=연합뉴스) 홍길동 기자 = 첫 문장\n[도쿄(일본)=뉴시스] 김철수 기자 = 사진 2026.7.29\n[서울=뉴시스] 사진 *재판매 및 DB 금지\n문장 *재판매 및 DB 금지", "첫 문장\n문장 "),
    ("boilerplate_lines", "부산=홍길동 기자\n무단 전재 금지\n" + BODY + "ⓒ 매체. 무단 전재 및 재배포 금지\n◎공감언론 뉴시스\n기사 본문 영역", BODY + "ⓒ 매체. "),
    ("bylines", "앞 [매체 홍길동 기자] 뒤 <최지훈\n기자> 끝\n(매체 김수아 기자) 줄", "앞  뒤  끝\n줄"),
    ("unmarked_captions", "선수가 웃고 있는 모습.\n그는 이겼다.", "그는 이겼다."), ("terminator", "가\n (끝)\n나", "가"), ("terminator", "가\n나", "가\n나"),
    ("section_headers", "포토뉴스\n" + BODY + "\n◆ 관련기사\n남의 기사", BODY), ("section_headers", "짧다\n관련기사\n계속", "짧다\n계속"),
    ("inline_headers", "가" * 120 + "관련 기사 다른 제목", "가" * 120), ("inline_headers", "가" * 50 + "관련 기사 다른 제목", "가" * 50 + "관련 기사 다른 제목"), ("inline_headers", "가" * 120 + " 관련 기사를 보면", "가" * 120 + " 관련 기사를 보면"),
    ("photo_captions", "캡션이다 2026.10.1 ⓒ 뉴스1 안은나 기자대한민국이 이겼다.", "대한민국이 이겼다."), ("photo_captions", BODY * 2 + "캡션 ⓒ 뉴스1 안은나 기자끝", (BODY * 2) + " 끝"),
    ("edge_lists", "▶ 부제\n\n본문\n- 목록\n본문\n▷제보\n\n", "본문\n- 목록\n본문"), ("edge_lists", "▶ 하나\n- 둘", ""),
    ("emails", "문의 홍길동@x.co.kr 또는 [email protected] 로", "문의  또는  로"), ("foreign_lines", "WT 선수\n" + "long english line " * 4 + "\n한국어", "WT 선수\n한국어"), ("whitespace", " 가\t 나 | 다 \n\n\n\n라 ", "가 나 다\n\n라"),
]


@pytest.mark.parametrize(("name", "given", "want"), STEPS)
def test_steps(spark, name, given, want):
    step = next(s for s in clean.STEPS if s.name == name)
    assert clean.applied(spark.createDataFrame([(given,)], "t string"), step, "t").first()[0] == want


def test_whole_cleaning(spark):
    text = "대회 결과 안내\n짧은 부제\n" + BODY + "\n(끝)\n▶ 다른 기사"
    df = spark.createDataFrame([(1, text, "대회 결과 안내"), (2, "  ", "x"), (3, None, None)], "id int, body string, title string")
    rows = {r["id"]: r for r in clean.cleaned(df, "body", "out", "title", report_col="report").collect()}
    assert rows[1]["out"] == BODY.strip()
    assert [x["step"] for x in rows[1]["report"]] == ["terminator", "whitespace", "title_block"] or rows[1]["report"][-1]["step"] == "title_block"
    assert rows[2]["out"] == rows[3]["out"] == ""
    once = spark.createDataFrame([(1, rows[1]["out"], "대회 결과 안내")], "id int, body string, title string")
    assert clean.cleaned(once, "body", "out", "title").first()["out"] == rows[1]["out"]
    gates = spark.createDataFrame([(rows[1]["out"],), ("짧다",), ("long english text " * 20,)], "out string")
    assert clean.gated(gates, "out", 100).count() == 1


def fold(rows):
    urls, titles, kept = set(), set(), []
    for o, u, t in sorted(rows):
        if u not in urls and not (t and t in titles):
            kept.append(o)
            urls.add(u)
            titles.add(t)
    return kept


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_two_keys(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"u{rng.randint(0, 8)}", rng.choice(["", *[f"t{k}" for k in range(8)]])) for i in range(rng.randint(0, 30))]
    df = spark.createDataFrame(rows, "ordinal int, normalized_url string, title_key string")
    assert sorted(r[0] for r in dedup.dedup_two_keys(df, "ordinal", "normalized_url", "title_key").collect()) == fold(rows)


def test_two_keys_leave_free_what_fell(spark):
    rows = [(0, "u1", "t1"), (1, "u2", "t1"), (2, "u2", "t2")]
    df = spark.createDataFrame(rows, "ordinal int, normalized_url string, title_key string")
    assert sorted(r[0] for r in dedup.dedup_two_keys(df, "ordinal", "normalized_url", "title_key").collect()) == [0, 2]
    jobs = df.withColumn("job", F.lit(1))
    assert sorted(r[0] for r in dedup.fold_by_job(jobs, ["job"], "ordinal", "normalized_url", "title_key").collect()) == [0, 2]
    assert sorted(r[0] for r in dedup.first_per_key(df, "normalized_url", "ordinal").collect()) == [0, 1]


@pytest.mark.parametrize(
    ("mentions", "density", "title", "length", "want"),
    [(2, 9.0, True, 1000, "passing"), (3, 9.0, True, 1000, "partial"), (4, 1.5, True, 1000, "main"), (4, 1.49, True, 1000, "partial"), (4, 2.9, False, 1000, "partial"), (4, 3.0, False, 1000, "main"), (4, 0.1, False, 599, "main"), (4, 0.1, False, 600, "partial")],
)
def test_judge(spark, mentions, density, title, length, want):
    c = [F.lit(x) for x in (mentions, density, title, length)]
    assert spark.range(1).select(analysis.judge(*c)).first()[0] == want
    assert want != "main" or spark.range(1).select(analysis.judge(*c[:2], F.lit(False), c[3], analysis.Settings(require_title=True))).first()[0] == "partial"


def test_top_words(spark):
    terms = spark.createDataFrame([(1, "가", "NNG", 6), (1, "하다", "VV", 3), (1, "abc", "SL", 1), (1, "나", "NNG", 2)], "id int, term string, pos string, count int")
    found = lambda s, stop=None: [(r["term"], r["share"]) for r in analysis.top_words(terms, "id", s, stop).orderBy("rank").collect()]
    assert found(analysis.Settings(top_n=2)) == [("가", 54.5), ("하다", 27.3)]
    assert found(analysis.Settings(denom="noun", pos_range="noun")) == [("가", 75.0), ("나", 25.0)]
    assert found(analysis.Settings(), spark.createDataFrame([("가",)], "word string")) == [("하다", 60.0), ("나", 40.0)]
    with pytest.raises(ValueError):
        analysis.validated(analysis.Settings(top_n=0))


def test_metrics(spark):
    df = spark.createDataFrame([(1, "태권도 대회. 태권도 abc 12!\n끝"), (2, "..."), (3, None)], "id int, t string")
    rows = {r["id"]: r for r in analysis.text_metrics(df, "t").collect()}
    assert (rows[1]["tokens"], rows[1]["unique_tokens"], rows[1]["nouns"], rows[1]["sentences"]) == (6, 5, 4, 3)
    assert rows[1]["ttr"] == 0.833
    assert (rows[2]["tokens"], rows[2]["sentences"], rows[3]["ttr"]) == (0, 0, 0.0)


def test_recency_and_stages(spark):
    df = spark.createDataFrame([(1, "2026-09-25"), (2, "2026-09-20"), (3, None)], "id int, d string").withColumn("at", F.col("d").cast("timestamp"))
    ids = lambda cutoffs: sorted(r[0] for r in df.where(collect.recent(F.col("at"), cutoffs)).collect())
    assert ids([]) == [1, 2, 3]
    assert ids([datetime(2026, 9, 24), datetime(2026, 9, 22)]) == [1, 3]
    stages = spark.range(1).select(collect.all_stages(F.create_map(F.lit("collected"), F.lit(9), F.lit("cleaned"), F.lit(2))).alias("m")).first()["m"]
    assert stages == {"collected": 9, "deduped": 9, "recent": 9, "unseen": 9, "extracted": 9, "cleaned": 2}


def test_url_check(spark):
    rows = [(True, False, 0, 0.0, "robots"), (False, False, 0, 0.0, "fail"), (False, True, 5, 0.0, "short"), (False, True, 500, 0.1, "foreign"), (False, True, 500, 0.9, "ok")]
    df = spark.createDataFrame(rows, "b boolean, f boolean, n int, s double, want string")
    assert df.where(collect.url_check(F.col("b"), F.col("f"), F.col("n"), F.col("s"), 100) != F.col("want")).count() == 0


def test_order_and_pages(spark):
    df = spark.createDataFrame([(1, "2026-01-02"), (2, None), (3, "2026-01-03"), (4, "2026-01-03"), (5, None)], "id int, d string")
    ids = lambda x: [r["id"] for r in x.collect()]
    assert ids(search.ordered(df, "d")) == [4, 3, 1, 5, 2]
    assert ids(search.ordered(df, "d", False)) == [1, 3, 4, 2, 5]
    assert ids(search.paged(search.ordered(df, "d"), 2, 2)) == [1, 5]
    assert ids(search.paged(search.ordered(df, "d"), 9, 2)) == []
    titles = spark.createDataFrame([("오늘 100% 할인",), ("1000 원",), ("ABC",)], "t string")
    assert titles.where(search.contains_literally(F.col("t"), "100%")).count() == 1
    assert titles.where(search.contains_literally(F.col("t"), "abc")).count() == 1
    with pytest.raises(ValueError):
        search.ContentQuery("x", page=0)


def test_pushdown(spark, tmp_path, capsys):
    """Day ranges reach the scan as literals."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, datetime(2026, 1, 1), "x")], "id int, at timestamp, body string").write.parquet(path)
    search.daily_counts(spark.read.parquet(path), "at", date(2026, 1, 1), date(2026, 1, 2)).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(at" in plan
    assert "body" not in plan


def test_html(spark):
    first = "첫 문단이 이어진다. " * 25
    page = '<html><head><title>제목 &amp; 끝</title><meta property="og:site_name" content="매체"></head><body><nav><a href="/n/1">x</a></nav><article><p>' + first + '</p><script>var a</script><p>둘째<br>줄</p></article><footer>꼬리</footer></body></html>'
    row = spark.createDataFrame([(page,)], "h string").select(html.page_content("h").alias("c")).first()["c"]
    assert (row["title"], row["site"]) == ("제목 & 끝", "매체")
    assert row["body"] == first.strip() + "\n둘째\n줄"
    assert "var a" not in row["body"]
    assert spark.createDataFrame([("가나다".encode("cp949"),)], "b binary").select(html.decoded("b")).first()[0] == "가나다"


def test_board(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.kr/", '<a href="/about">Über uns</a>'), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = [(r["title"], r["published"]) for r in catalog.board_groups(spark, str(tmp_path)).collect()]
    assert ("대회 결과 안내", "2026-09-26T14:32:00+09:00") in found
    pages = spark.createDataFrame([(1, catalog.BOARD, "https://b.example/list")], "page int, html string, base string")
    groups = html.candidate_groups(pages, "page", "html", "base")
    assert groups.select("shape").distinct().count() == 1
    now = F.lit(datetime(2026, 9, 26, 3, 0)).cast("timestamp")
    assert html.posts(groups, now, pinned="gone").count() == 0
    assert html.posts(groups, now).count() == 4


def test_selectors(spark):
    page = '<ul class="list top"><li class="row"><b class="t">제목 하나</b><a href="/v?no=1">x</a><i>2026-09-01</i></li><li class="row">공지 <a href="/v?no=2">알림</a></li><li class="row"><a href="javascript:x">y</a></li></ul>'
    pages = spark.createDataFrame([(1, page, "http://b.kr/l"), (2, page, "http://b.kr/l?page=2"), (3, page.replace("no=1", "no=9"), "http://b.kr/l?page=3")], "page int, html string, base string")
    now = F.lit(datetime(2026, 9, 26, 3, 0)).cast("timestamp")
    found = html.selected_posts(pages, "page", "html", "base", now, "ul.list li.row", title=".t", day="i", exclude_notice=True)
    assert [(r["title"], r["url"], r["published"]) for r in found.where("page = 1").collect()] == [("제목 하나", "http://b.kr/v?no=1", datetime(2026, 8, 31, 15))]
    assert [(r["rank"], r["url"]) for r in html.across_pages(found).collect()] == [(1, "http://b.kr/v?no=1")]
    with pytest.raises(ValueError):
        html.simple("a > b")


def test_search_hits(spark):
    items = [("<b>가</b> &amp; 나", "http://a/1", "http://l/1", "요약", "Fri, 25 Sep 2026 10:00:00 +0900"), ("없음", "", "", "", "?"), ("다", " ", "http://l/3", "", "어제")]
    df = spark.createDataFrame([("k1", 0, True, items), ("k2", 0, False, [])], feeds.RESPONSE)
    rows = feeds.search_hits(df, [" k2", "k1", ""]).orderBy("rank").collect()
    assert [(r["rank"], r["url"], r["title"], r["published"]) for r in rows] == [(1, "http://a/1", "가 & 나", "2026-09-25T10:00:00+09:00"), (3, "http://l/3", "다", "어제")]
    assert [r[0] for r in feeds.failed_keywords(df).collect()] == ["k2"]
    assert feeds.page_requests(250) == [(1, 100), (101, 100), (201, 50)]
    assert [(r["url"], r["rank"]) for r in feeds.url_list(spark, [" http://a/1 ", "", "http://a/1/", "http://b"]).orderBy("rank").collect()] == [("http://a/1", 1), ("http://b", 2)]


@pytest.mark.parametrize(("kind", "config"), [("news_keyword", {"count": 1001}), ("news_keyword", {"sort": "x"}), ("news_keyword", {"cuont": 1}), ("board", {"list_url": "ftp://x"}), ("board", {"list_url": "http://x", "include_pattern": "("}), ("url_list", {"urls": [" "]})])
def test_bad_configs(kind, config):
    with pytest.raises(Exception):  # noqa: B017
        feeds.validated_config(kind, config)


def test_insights(spark):
    jobs = spark.createDataFrame([(i, 1, "success", 0) for i in range(3)] + [(9, 2, "failed", 0), (10, 2, "success", 4), (11, 2, "success", 0)], "id int, source_id int, status string, n int")
    assert [r[0] for r in insights.empty_runs(jobs, "source_id", F.desc("id"), "n").collect()] == [1]
    stats = spark.createDataFrame([(0.1,), (1.6,), (3.1,), (3.2,)], "density double")
    assert {(r["bin"], r["n"], r["preview"]) for r in insights.density_histogram(stats, 3.0).collect()} == {(0.0, 1, "passing"), (1.5, 1, "partial"), (3.0, 2, "main")}
    words = spark.createDataFrame([("w", "a", True, False), ("w", "b", True, True)], "workspace_id string, word string, enabled boolean, is_system boolean").withColumn("pos", F.lit("NNG"))
    new = spark.createDataFrame([("w", " a ", None), ("w", "c", "NNP"), ("w", "c", None), ("w", "", None)], "workspace_id string, word string, pos string")
    assert sorted(r["word"] for r in insights.add_words(words, new).collect()) == ["a", "b", "c"]
    assert sorted(r["word"] for r in insights.delete_words(words, ["a", "b"]).collect()) == ["b"]


def test_words_beyond_the_top_count(spark, tmp_path):
    """core_words and related_words count all terms of a document, not its 15 most frequent ones."""
    often = [" ".join(f"{w}{x} {w}{x}" for x in "abcdefghijklmnop") for w in ("qa", "qb", "qc")]
    rows = [(i, f"{t} zz der") for i, t in enumerate(often)] + [(3, "alone"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit("s"), "n_chars": F.lit(1)}).write.parquet(f"{tmp_path}/documents.parquet")
    core = [(r["word"], r["docs"], r["mean_share"]) for r in catalog.core_words(spark, str(tmp_path)).collect()]
    assert core[:3] == [("der", 3, 2.9), ("zz", 3, 2.9), ("alone", 1, 100.0)]
    assert len(core) == 8
    related = [(r["word"], r["docs"]) for r in catalog.related_words(spark, str(tmp_path)).collect()]
    assert related[:2] == [("zz", 3), ("qaa", 1)]
    assert len(related) == 20


def test_long_chains(spark):
    """Rows that share a URL with the row before and a title with the row behind: no number of rounds is too many."""
    rows = [(i, f"u{i // 2}", f"t{(i + 1) // 2}") for i in range(1000)] + [(2000, "u1", ""), (2001, None, None), (2002, "", "t0")]
    df = spark.createDataFrame(rows, "o int, u string, t string")
    want = fold([(o, u or "", t or "") for o, u, t in rows])
    assert sorted(r["o"] for r in dedup.dedup_two_keys(df, "o", "u", "t").collect()) == want
    short = df.where("o < 24 or o >= 2000")
    want = fold([(o, u or "", t or "") for o, u, t in rows if o < 24 or o >= 2000])
    # Groups that are too large for a fold go through rounds.
    assert sorted(r["o"] for r in dedup.dedup_two_keys(short, "o", "u", "t", 1, 5).collect()) == want


def test_words_within_the_row(spark):
    """The same words, places and shares as from stored terms."""
    texts = [(1, "b a b 가나 가나 b c1 D d"), (2, ""), (3, None), (4, "x")]
    df = spark.createDataFrame(texts, "id int, text string")
    for denom in ("content", "noun"):
        own = analysis.Settings(pos_range="foreign", denom=denom, top_n=100)
        stored = analysis.top_words(analysis.term_counts(df, "id", "text"), "id", own)
        found = analysis.document_words(df, "id", "text", own)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, stored.select(*found.columns).collect()))
    assert {r["term"]: r["count"] for r in analysis.term_counts(df, "id", "text").where("id = 1").collect()} == {"b": 3, "a": 1, "가나": 2, "c": 1, "D": 1, "d": 1}


def test_charsets(spark):
    pages = [("한글 문서입니다 가나다라마바사".encode("cp949"), "한글 문서입니다 가나다라마바사"), ("한글".encode(), "한글"), (b"plain", "plain"), (None, None)]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages)], "i int, p binary")
    assert [r["t"] for r in df.select("i", html.decoded(F.col("p")).alias("t")).orderBy("i").collect()] == [t for _, t in pages]


def test_clashing_rows_of_a_view(spark):
    from datetime import date as day

    contents = spark.createDataFrame([(1, "Alpha", None, datetime(2026, 9, 25, 16)), (2, "b", "alpha", datetime(2026, 9, 20)), (3, "c", "d", datetime(2026, 9, 26))], "id int, title string, summary string, collected_at timestamp")
    verdicts = spark.createDataFrame([(1, "passing"), (3, "main")], "content_id int, relevance string")
    show = lambda **k: {r["id"]: r["dimmed"] for r in search.view(contents, verdicts, day(2026, 9, 26), **k).collect()}
    assert show() == {1: True, 2: False, 3: False}
    assert show(days=1) == {1: True, 3: False}
    assert show(text="Alpha", passing_mode="show") == {1: False}
    assert show(text=" c d ") == {3: False}
    assert show(text="ALPHA") == {}
    assert show(passing_mode="hide", relevance="passing") == {1: False}
    with pytest.raises(ValueError):
        show(days=0)
    assert show(passing_mode="hide") == {2: False, 3: False}


def test_words_are_counted_without_ids_in_a_shuffle(spark, tmp_path):
    """core_words, related_words, related_flags and top_words_without_stopwords count within rows: no document's id is a key of an exchange."""
    import re

    from textloom.plans import catalog

    rows = [(1, "der a a The b", "en", "s", 5), (2, "der b", "en", "s", 5), (3, "a", "en", "s", 5), (4, None, "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("core_words", "related_words", "related_flags", "top_words_without_stopwords"):
        found = catalog.queries()[name](spark, str(tmp_path))
        assert not re.search(r"hashpartitioning\([^)]*(doc_id|content_id)", found._jdf.queryExecution().executedPlan().toString()), name
    top = catalog.queries()["top_words_without_stopwords"](spark, str(tmp_path))
    assert {(r["doc_id"], r["rank"], r["term"], r["share"]) for r in top.collect()} == {(1, 1, "a", 66.7), (1, 2, "b", 33.3), (2, 1, "b", 100.0), (3, 1, "a", 100.0)}


def test_steps_leave_texts_that_they_need_not_see(spark):
    """Each step tells by a plain search which texts it may change; all others it would give back as they are, so their lines are not split."""
    rng = random.Random(4)
    bits = ["기사", "관련기사", "포토뉴스", "Ⓒ", "copyrıght", "홍길동 기자", "웃는 모습.", "(끝)", "▶ ", "- ", "-", "•\t", "long english line " * 3, "홍길동@x.co.kr", "[email protected]", "|", " ", "　", "\r", "  ", "\n\n\n", "본문이다.", "x"]
    texts = [None, "", "Plain text.\nIt has two lines."] + ["".join(rng.choice(bits) + rng.choice(["", "\n", " "]) for _ in range(rng.randint(1, 8))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").cache()
    for step in clean.STEPS:
        # Without needs, the step itself works on every text.
        whole = clean.applied(df, clean.Step(step.name, step.apply), "t").select("id", F.col("t").alias("whole"))
        rows = df.select("id", "t", F.coalesce(step.needs(F.col("t")), F.lit(False)).alias("needed")).join(whole, "id").collect()
        assert all(r["needed"] or r["t"] is None or r["whole"] == r["t"] for r in rows), step.name
        assert not next(r for r in rows if r["id"] == 2)["needed"], step.name
