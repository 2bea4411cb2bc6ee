"""Pages over HTTP, fetched by Spark tasks: one origin is one task, which keeps to its rules, waits between its requests and tries again.

`fetched` fetches the URLs of a table. The data source `textloom_pages` reads a list of URLs from a file, one to a line, in a batch
or as a stream: a stream's offset is a place in the file, so lines that are added later make the next micro-batch, and a restart
goes on behind the last one that was done.

Rules of robots.txt are read once for each origin and task; an origin without readable ones allows everything. Broken connections
and timeouts are tried again RETRIES times, after BACKOFF and then twice BACKOFF seconds; other failures are not. Every request
goes through an opener, `(url, headers, timeout) -> (status, body, charset)`, which raises OSError where no answer comes.

Defined cases: a blank URL is left out; one without scheme or host gives a row with ok = false and no request; a URL that rules
forbid gives allowed = false and no request; repeated URLs are fetched each.
"""

import time
from collections.abc import Callable, Iterator
from importlib import import_module
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from textloom.functions.urls import page_url
from textloom.sources.files import opened

# How requests are made.
TIMEOUT, RETRIES, BACKOFF, DELAY = 10.0, 2, 2.0, 1.0
HEADERS = {"User-Agent": "Mozilla/5.0 (compatible; textloom)", "Accept": "text/html,application/xhtml+xml,*/*;q=0.8", "Accept-Language": "ko-KR,ko;q=0.9,en;q=0.8"}
Opener = Callable[[str, dict, float], tuple[int, bytes, str | None]]
PAGE = "ordinal long, url string, origin string, allowed boolean, ok boolean, status int, attempts int, charset string, page binary, error string"
NAMES = [x.split()[0] for x in PAGE.split(", ")]
ARROW = pa.schema(list(zip(NAMES, [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()], strict=True)))


def over_http(url: str, headers: dict, timeout: float) -> tuple[int, bytes, str | None]:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
            return answer.status, answer.read(), answer.headers.get_content_charset()
    except urllib.error.HTTPError as e:
        return e.code, b"", None


def opener_of(name: str | None) -> Opener:
    """module:function, found where the task runs."""
    if not name:
        return over_http
    module, function = name.split(":")
    return getattr(import_module(module), function)


def origin_of(url: str) -> str:
    try:
        parts = urlsplit(url)
    except ValueError:
        return ""
    return f"{parts.scheme}://{parts.netloc}".lower() if parts.scheme in ("http", "https") and parts.netloc else ""


def tried(url: str, opener: Opener, retries: int = RETRIES, backoff: float = BACKOFF) -> tuple[int | None, bytes, str | None, int, str | None]:
    """status, body, charset, attempts, error of a request that is made again where the connection breaks."""
    origin, error = origin_of(url), None
    for attempt in range(1, retries + 2):
        try:
            status, body, charset = opener(url, HEADERS | {"Referer": f"{origin}/"}, TIMEOUT)
            return status, body, charset, attempt, None if status < 400 else f"status {status}"
        except OSError as e:
            error = f"{type(e).__name__}: {e}"
            if attempt <= retries:
                time.sleep(backoff * attempt)
        except ValueError as e:
            return None, b"", None, attempt, f"{type(e).__name__}: {e}"
    return None, b"", None, retries + 1, error


def rules_of(origin: str, opener: Opener) -> RobotFileParser | None:
    try:
        status, body, _ = opener(f"{origin}/robots.txt", HEADERS, TIMEOUT)
    except (OSError, ValueError):
        return None
    if status != 200:
        return None
    rules = RobotFileParser()
    rules.parse(body.decode("utf-8", "replace").splitlines())
    return rules


def fetch(rows: Iterator[tuple[int, str]], opener: Opener, delay: float = DELAY, retries: int = RETRIES, backoff: float = BACKOFF, robots: bool = True) -> Iterator[tuple]:
    """PAGE's columns for each (ordinal, url); rows of one origin stand together, and one origin's rules are held at a time."""
    now, rules, waits = None, None, False
    for ordinal, url in rows:
        url = url.strip()
        origin = origin_of(url)
        if not origin:
            yield ordinal, url, origin, True, False, None, 0, None, None, "not an http URL"
            continue
        if origin != now:
            now, rules, waits = origin, rules_of(origin, opener) if robots else None, False
        if rules is not None and not rules.can_fetch("*", url):
            yield ordinal, url, origin, False, False, None, 0, None, None, "robots.txt"
            continue
        if waits:
            time.sleep(delay)
        waits = True
        status, body, charset, attempts, error = tried(url, opener, retries, backoff)
        yield ordinal, url, origin, True, error is None, status, attempts, charset, body if error is None else None, error


def fetched(urls: DataFrame, opener: str | None = None, delay: float = DELAY, retries: int = RETRIES, backoff: float = BACKOFF, robots: bool = True) -> DataFrame:
    """PAGE's columns for a table of (ordinal, url): origins go to tasks, whose requests follow each other in the order of ordinals.

    Store what comes back (session.stored): a plan that reads it twice asks twice.
    """
    given = urls.select(F.col("ordinal").cast("long").alias("ordinal"), F.trim("url").alias("url")).where("url <> ''")
    origin = F.lower(F.regexp_extract("url", r"^(https?://[^/?#]*)", 1))
    spread = given.withColumn("of", origin).repartition("of").sortWithinPartitions("of", "ordinal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((o, u) for batch in batches for o, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for row in fetch(rows, opener_of(opener), delay, retries, backoff, robots):
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, row, strict=True))], ARROW)

    return spread.select("ordinal", "url").mapInArrow(run, PAGE)


def list_pages(spark: SparkSession, list_url: str, page_param: str = "", start_page: int = 1, max_pages: int = 1) -> DataFrame:
    """ordinal, url of the pages of a board's list: from the first on, or the list's URL alone if it has no page parameter."""
    if not page_param:
        return spark.createDataFrame([(0, list_url)], "ordinal int, url string")
    pages = spark.range(start_page, start_page + max(1, max_pages)).select(F.col("id").cast("int").alias("ordinal"))
    return pages.select("ordinal", page_url(F.lit(list_url), page_param, F.col("ordinal")).alias("url"))


class Settings:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.opener = options.get("opener")
        self.delay, self.backoff = float(options.get("delay", DELAY)), float(options.get("backoff", BACKOFF))
        self.retries, self.robots = int(options.get("retries", RETRIES)), options.get("robots", "true") != "false"

    def lines(self, start: int, end: int | None = None) -> tuple[list[tuple[int, str]], int]:
        """Whole lines of the list between two places, each with the place where it begins, and where the last one ends."""
        with opened(self.path) as f:
            f.seek(start)
            data = f.read(None if end is None else end - start)
        if end is None and not data.endswith(b"\n"):
            # A line that is still being written waits for its end.
            data = data[: data.rfind(b"\n") + 1]
        out, at = [], start
        for line in data.splitlines(keepends=True):
            out.append((at, line.decode("utf-8", "replace").strip()))
            at += len(line)
        return [x for x in out if x[1]], at

    def partitions(self, rows: list[tuple[int, str]]) -> list[InputPartition]:
        by_origin: dict[str, list] = {}
        for row in rows:
            by_origin.setdefault(origin_of(row[1]), []).append(row)
        return [InputPartition(x) for x in by_origin.values()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return fetch(iter(partition.value), opener_of(self.opener), self.delay, self.retries, self.backoff, self.robots)


class PageReader(DataSourceReader):
    def __init__(self, settings: Settings):
        self.settings = settings

    def partitions(self) -> list[InputPartition]:
        with opened(self.settings.path) as f:
            end = f.size()
        return self.settings.partitions(self.settings.lines(0, end)[0])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.settings.read(partition)


class PageStream(DataSourceStreamReader):
    def __init__(self, settings: Settings):
        self.settings = settings

    def initialOffset(self) -> dict:
        return {"place": 0}

    def latestOffset(self) -> dict:
        return {"place": self.settings.lines(0)[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.settings.partitions(self.settings.lines(start["place"], end["place"])[0])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.settings.read(partition)


class PageSource(DataSource):
    """spark.read (or readStream) .format("textloom_pages").load(path of a list of URLs); options delay, retries, backoff, robots, opener. The ordinal is a URL's place in the file."""

    @classmethod
    def name(cls) -> str:
        return "textloom_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return PageReader(Settings(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(Settings(self.options))
