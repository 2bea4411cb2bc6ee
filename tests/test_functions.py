from datetime import date, datetime
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from textloom.functions import text, times, urls


def one(spark, column, **values):
    return spark.range(1).select(column(*[F.lit(v) for v in values.values()]).alias("x")).first()[0]


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_strip_and_collapse(spark):
    given = ["  a\t b  ", "\n\n", "x", None]
    assert column(spark, given, text.strip) == ["a\t b", "", "x", None]
    assert column(spark, given, text.collapse) == ["a b", "", "x", None]
    assert column(spark, ["a" * 119 + " b tail"], text.excerpt) == ["a" * 119]


def test_title_key(spark):
    assert column(spark, ["대회 결과! - 신문", "A - B - C", "no suffix", ""], text.title_key) == ["대회결과", "AB", "nosuffix", ""]


def test_mentions(spark):
    rows = [("승단 심사", "승단심사와 승단  심사, 승단\n심사", 3), ("Abc", "abc ABC aBcabc", 4), ("a.b", "a.b axb", 1), ("  ", "anything", 0), ("x\\Ey", "x\\Ey xy", 1), ("k", None, 0), ("태권도", "태권도장 태권 도", 1), ("태권 도", "태권도장 태권 도", 2)]
    df = spark.createDataFrame(rows, "k string, b string, n int")
    assert df.where(text.mentions(F.col("b"), F.col("k")) != F.col("n")).collect() == []


def test_script_ratio(spark):
    given = ["한글 abc", "https://example.com/a/b 한글", "me@x.com 가", "123 .,", None]
    assert column(spark, given, text.script_ratio) == [2 / 5, 1.0, 1.0, 0.0, 0.0]


def test_density_rounds_half_even(spark):
    df = spark.createDataFrame([(1, 8000, 0.12), (3, 8000, 0.38), (5, 0, 0.0)], "m int, n int, d double")
    assert df.where(text.density(F.col("m"), F.col("n")) != F.col("d")).count() == 0


def test_title_lines(spark):
    rows = [("대회 결과 안내", "대회결과 안내", True), ("대회 결과 안내문이 나왔습니다", "대회 결과 안내문이 나왔...", True), ("짧은", "짧…", False), ("", "", False), ("x", None, False)]
    df = spark.createDataFrame(rows, "l string, t string, y boolean")
    assert df.where(text.is_title_line(F.col("l"), F.col("t")) != F.col("y")).collect() == []


URLS = [
    "https://Example.com/A/?utm_source=x&id=3#top", "HTTP://a.kr", "http://a.kr/", "http://a.kr/view?no=1&ref=y&b=", "http://a.kr/x?q=a+b%20c&UTM_Medium=1", "not a url", "  http://a.kr/p/  ", "//a.kr/x", "http://a.kr/?a",
    "http://a.kr/한글?제목=값", "http://a.kr/x?a=1;b=2", "http://u:p@a.kr:80/x//", "http://a.kr/x?a==b", "mailto:x@y.z", "", "http://a.kr?x=1&&y=2",
    "http://a.kr/x?%zz=1&a=%E3%81", "http://a.kr/x?a=*~b c", "http://[a.kr/x", "http://a.kr/x?a=%ff", "HTTP://A.kr/%7Eb/?Gclid=1&%72ef=2&x=%26", "ftp://X.y//",
]
CANONICAL = [
    "https://example.com/A?id=3", "http://a.kr/", "http://a.kr/", "http://a.kr/view?no=1&b=", "http://a.kr/x?q=a+b+c", "not a url", "http://a.kr/p", "//a.kr/x", "http://a.kr/?a=",
    "http://a.kr/한글?%EC%A0%9C%EB%AA%A9=%EA%B0%92", "http://a.kr/x?a=1%3Bb%3D2", "http://u:p@a.kr:80/x", "http://a.kr/x?a=%3Db", "mailto:x@y.z", "", "http://a.kr/?x=1&y=2",
    "http://a.kr/x?%25zz=1&a=%EF%BF%BD", "http://a.kr/x?a=%2A~b+c", "http://[a.kr/x", "http://a.kr/x?a=%EF%BF%BD", "http://a.kr/%7Eb?x=%26", "ftp://x.y/",
]


def test_canonical_url(spark):
    found = column(spark, URLS, urls.canonical_url)
    assert found == CANONICAL
    assert column(spark, [None], urls.canonical_url) == [None]
    again = column(spark, found, urls.canonical_url)
    assert again == found


def test_shapes(spark):
    given = ["http://a.kr/view/12/3?no=45&b=x", "http://a.kr/list?page=2", "http://a.kr/list?page=2&no=1", "http://a.kr/list/3?page=2"]
    assert column(spark, given, urls.url_shape) == ["a.kr/view/{n}/{n}?b=x&no={n}", "a.kr/list?page={n}", "a.kr/list?no={n}&page={n}", "a.kr/list/{n}?page={n}"]
    assert column(spark, given, urls.is_paging) == [False, True, False, False]
    assert column(spark, ["http://a.kr/l?page=1&b=2"], lambda c: urls.page_url(c, "page", F.lit(3))) == ["http://a.kr/l?b=2&page=3"]
    assert column(spark, ["http://www.a.kr/x"], lambda c: urls.outlet(F.lit(" "), c)) == ["a.kr"]
    assert urlsplit(given[0]).netloc == "a.kr"


def iso(values):
    return [v and v.isoformat() for v in values]


def test_parse_dt(spark):
    given = ["2026-09-25T10:00:00+09:00", "2026-09-25T01:00:00Z", "2026-09-25 10:00:00", "2026-09-25", "20260925", "soon", None]
    assert iso(column(spark, given, times.parse_dt)) == ["2026-09-25T01:00:00"] * 3 + ["2026-09-24T15:00:00"] * 2 + [None, None]
    # The times of 2026-09-25 at ten in the zone, in each way to write it, and what is no date.
    same = ["2026-09-25T10:00+0900", "2026-09-25T10:00+09", "2026-09-25T01:00:00+0000", "20260925T100000", "20260925T1000+0900", "2026-W39-5T10:00", "2026W395T100000+0900", "2026-09-25T10:00:00.000000+0900", "2026-09-24 20:00-0500", "2026-09-25T01Z"]
    assert iso(column(spark, same, times.parse_dt)) == ["2026-09-25T01:00:00"] * len(same)
    weeks = ["2026-W39-5", "2026W395", "2026-W39", "2020-W53-7", "2021-W53-1", "2026-W00-1", "2026-W54-1", "2026-W39-8", "2024-W01-1", "9999-W53-7"]
    assert iso(column(spark, weeks, times.parse_dt)) == ["2026-09-24T15:00:00"] * 2 + ["2026-09-20T15:00:00", "2021-01-02T15:00:00", None, None, None, None, "2023-12-31T15:00:00", None]
    assert iso(column(spark, ["Fri, 25 Sep 2026 10:00:00 +0900", "?"], times.rfc2822)) == ["2026-09-25T01:00:00", None]


@pytest.mark.parametrize(
    ("given", "want"),
    [("2025.12.01", "2025-12-01T00:00:00+09:00"), ("25-12-01", "2025-12-01T00:00:00+09:00"), ("2025년 3월 4일", "2025-03-04T00:00:00+09:00"), ("3분 전", "2026-09-26T11:57:00+09:00"), ("2 시간 전", "2026-09-26T10:00:00+09:00"), ("1일 전", "2026-09-25T12:00:00+09:00"),
     ("09-25", "2026-09-25T00:00:00+09:00"), ("12-30", "2025-12-30T00:00:00+09:00"), ("14:32", "2026-09-26T14:32:00+09:00"), ("2026-02-31", None), ("02-31", None), ("13-40 14:32", "2026-09-26T14:32:00+09:00"), ("", None), (None, None),
     ("99999999999999999999일 전", None), ("3000000000000000일 전", None), ("9223372036854775807분 전", None), ("740000일 전", None), ("20000일 전", "1971-12-24T12:00:00+09:00"), ("00000000000000000000001일 전", "2026-09-25T12:00:00+09:00")],
)
def test_board_date(spark, given, want):
    now = F.lit(datetime(2026, 9, 26, 3, 0)).cast("timestamp")
    found = spark.createDataFrame([(given,)], "v string").select(times.display_iso(times.board_date(F.col("v"), now))).first()[0]
    assert found == want


def test_days(spark):
    assert times.day_range(date(2026, 9, 30), date(2026, 9, 30)) == (datetime(2026, 9, 29, 15), datetime(2026, 9, 30, 15))
    with pytest.raises(ValueError):
        times.day_range(date(2026, 9, 30), date(2026, 9, 29))
    with pytest.raises(ValueError):
        times.recent_days(0)
    rows = [("2026-09-29 14:59:59", False), ("2026-09-29 15:00:00", True), ("2026-09-30 14:59:59", True), ("2026-09-30 15:00:00", False)]
    df = spark.createDataFrame(rows, "t string, y boolean").withColumn("t", F.col("t").cast("timestamp"))
    assert df.where(times.within(F.col("t"), date(2026, 9, 30), date(2026, 9, 30)) != F.col("y")).count() == 0
    run = lambda now: one(spark, lambda n, c: times.next_daily_run(n.cast("timestamp"), c), now=now, clock="09:00")
    assert [run(datetime(2026, 9, 29, 23, 59)), run(datetime(2026, 9, 30, 0, 0))] == [datetime(2026, 9, 30, 0, 0), datetime(2026, 10, 1, 0, 0)]
