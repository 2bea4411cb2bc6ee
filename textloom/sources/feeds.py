"""Search responses, URL lists and files in and out."""

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textloom.functions.text import plain, strip
from textloom.functions.times import display_iso, rfc2822
from textloom.functions.urls import canonical_url
from textloom.sources.html import unescaped
from textloom.sources.pages import HEADERS, TIMEOUT, PageSource, opener_of

#: Limits of the search interface.
PAGE, LAST_OFFSET, MOST_ITEMS = 100, 1000, 1000
RESPONSE = "keyword string, page int, ok boolean, items array<struct<title:string,originallink:string,link:string,description:string,pubDate:string>>"


def page_requests(count: int) -> list[tuple[int, int]]:
    """(offset, size) of the requests for a count, which is brought into 1 to MOST_ITEMS."""
    count = min(max(1, count), MOST_ITEMS)
    return [(start, min(PAGE, count - start + 1)) for start in range(1, count + 1, PAGE) if start <= LAST_OFFSET]


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in enumerate(k.strip() for k in self.options.get("keywords", "").split("\n")) if k[1]]

    def read(self, partition: InputPartition):
        """A row for each page of a keyword. A first page that fails gives ok = false; a later one ends the keyword. Short pages end it too."""
        import json
        from urllib.parse import quote

        _, keyword = partition.value
        sort = self.options.get("sort", "sim").strip().lower()
        sort = sort if sort in ("sim", "date") else "sim"
        opener = opener_of(self.options.get("opener"))
        for number, (start, size) in enumerate(page_requests(int(self.options.get("count", "30")))):
            url = self.options["url"].format(query=quote(keyword), start=start, display=size, sort=sort)
            try:
                status, body, _ = opener(url, HEADERS, TIMEOUT)
                items = json.loads(body).get("items", []) if status < 400 else None
            except (OSError, ValueError):
                items = None
            if items is None:
                if not number:
                    yield keyword, number, False, []
                return
            yield keyword, number, True, [tuple(i.get(x) for x in ("title", "originallink", "link", "description", "pubDate")) for i in items]
            if len(items) < size:
                return


class SearchSource(DataSource):
    """spark.read.format("textloom_search").option("keywords", "a\\nb").option("url", "http://...{query}...{start}...{display}...{sort}")"""

    @classmethod
    def name(cls) -> str:
        return "textloom_search"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchSource)
    spark.dataSource.register(PageSource)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored responses as JSON lines: keyword, page, ok, items."""
    return spark.read.schema(RESPONSE).json(path)


def failed_keywords(responses: DataFrame) -> DataFrame:
    return responses.where(~F.col("ok")).select("keyword").distinct()


def search_hits(responses: DataFrame, keywords: list[str]) -> DataFrame:
    """keyword, rank, ordinal, title, url, summary, published, published_raw in the order of keywords and ranks.

    The rank is the place in the raw response, before items without a URL are left out. A date that can't be read stays as given.
    """
    wanted = responses.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(k.strip() for k in keywords if k.strip()))), "place int, keyword string")
    each = responses.where("ok").join(F.broadcast(wanted), "keyword").select("keyword", "place", "page", F.posexplode("items").alias("pos", "i"))
    rank = F.col("page") * PAGE + F.col("pos") + 1
    url = F.coalesce(F.nullif(strip(F.col("i.originallink")), F.lit("")), F.nullif(strip(F.col("i.link")), F.lit("")))
    text = lambda c: strip(unescaped(plain(F.coalesce(F.col(c), F.lit("")))))
    out = each.select("keyword", rank.alias("rank"), F.struct("place", rank.alias("rank")).alias("ordinal"), text("i.title").alias("title"), url.alias("url"), text("i.description").alias("summary"), rfc2822(F.col("i.pubDate")).alias("published_at"), F.col("i.pubDate").alias("published_raw"))
    return out.where(F.col("url").isNotNull()).withColumn("published", F.coalesce(display_iso(F.col("published_at")), "published_raw"))


def url_list(spark: SparkSession, urls: list[str]) -> DataFrame:
    """url, rank from 1: trimmed, without blanks, the first of each canonical URL."""
    rows = spark.createDataFrame(list(enumerate(urls)), "ordinal int, url string").withColumn("url", strip(F.col("url"))).where("url <> ''")
    once = rows.withColumn("key", canonical_url(F.col("url"))).groupBy("key").agg(F.min_by("url", "ordinal").alias("url"), F.min("ordinal").alias("ordinal"))
    ordered = once.agg(F.array_sort(F.collect_list(F.struct("ordinal", "url"))).alias("u")).select(F.posexplode("u").alias("pos", "x"))
    return ordered.select(F.col("x.url").alias("url"), (F.col("pos") + 1).alias("rank"))


# What the first cell of a header says.
HEADERS_OF_WORDS = ("단어", "복합어", "word")


def words_from_csv(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """word, pos and the columns to keep, of the text of CSV files: a line each, quotes around cells gone; a second cell counts as part of speech if it is one. A file's first word may be a header and then goes."""
    lines = F.split(F.regexp_replace(F.coalesce(column, F.lit("")), "^\ufeff", ""), "\r?\n")
    cells = F.transform(lines, lambda line: F.transform(F.split(line, ","), lambda c: strip(F.regexp_replace(c, '^"|"$', ""))))
    words = F.filter(cells, lambda c: c[0] != "")
    header = F.lower(F.coalesce(F.get("_w", 0)[0], F.lit(""))).isin(*HEADERS_OF_WORDS)
    named = rows.select(*keep, words.alias("_w"))
    own = named.select(*keep, F.when(header, F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1)))).otherwise(F.col("_w")).alias("_w"))
    each = own.select(*keep, F.explode("_w").alias("c"))
    pos = F.try_element_at("c", F.lit(2))
    return each.select(*keep, F.col("c")[0].alias("word"), F.when(pos.rlike("^NN[PG]$"), pos).alias("pos"))


def words_from_text(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """word, pos (none) and the columns to keep, of pasted text: split at line ends and commas, without blank ones."""
    words = rows.select(*keep, F.explode(F.transform(F.split(column, "[\n,]"), strip)).alias("word"))
    return words.where("word <> ''").withColumn("pos", F.lit(None).cast("string"))


# Settings of sources, checked when a plan is made.
KEYS = {
    "news_keyword": {"count": 30, "sort": "sim", "days": 3},
    "board": {"list_url": "", "item_selector": "", "link_selector": "a", "title_selector": "", "date_selector": "", "body_selector": "", "page_param": "", "start_page": 1, "max_pages": 1, "max_items": 50, "include_pattern": "", "exclude_notice": False, "list_pattern": "", "days": None},
    "url_list": {"urls": []},
}


def validated_config(kind: str, config: dict) -> dict:
    """The config with defaults; unknown keys and values out of range are refused."""
    import re

    if unknown := set(config) - set(KEYS[kind]):
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    out = KEYS[kind] | config
    if kind == "news_keyword" and not (1 <= out["count"] <= MOST_ITEMS and out["sort"] in ("sim", "date")):
        raise ValueError("count must lie between 1 and 1000, sort be sim or date")
    if out.get("days") is not None and out["days"] < 1:
        raise ValueError("days must be 1 or more")
    if kind == "board":
        if urlparse(out["list_url"]).scheme not in ("http", "https"):
            raise ValueError("list_url must begin with http:// or https://")
        re.compile(out["include_pattern"])
    if kind == "url_list":
        out["urls"] = list(dict.fromkeys(u.strip() for u in out["urls"] if u.strip()))
        if not out["urls"]:
            raise ValueError("urls must not be empty")
    return out
