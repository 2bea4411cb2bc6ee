"""One file for a whole result, written by tasks: CSV for spreadsheets, and JSON with statistics around its articles.

Each task writes its rows to a part of its own beside the file and tells the driver its name, number of rows and latest date; a
task that fails takes its part away. When all are done the parts are strung together, in the order of partitions, by a stream that
holds a piece of one part; the file then gets its name at once. No row is collected. A job that fails leaves neither file nor parts.

CSV: a mark of byte order, a header, every cell quoted and quotes doubled, lines joined by newlines; null is an empty cell. JSON:
{"stats": ..., "latest_published": ..., "articles": [...]}, one article to a line; null stays null, and the latest date is that of
the column named by the option `latest` (default `published`), as text.

Defined cases: an empty result gives a header, or a list without articles and null as latest date; a file that is there is replaced
in mode overwrite, else refused.
"""

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from textloom.sources.files import exists, located

PIECE = 1 << 20
MARK = b"\xef\xbb\xbf"


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int
    latest: str | None


def text_of(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return value.isoformat(" ") if isinstance(value, datetime) else "" if value is None else str(value)


def plain(value):
    """As JSON has it."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value.isoformat() if isinstance(value, (date, datetime)) else value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


class OneFile(DataSourceWriter):
    """before, between, after: what stands around rows."""

    between = b"\n"

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.options, self.names, self.overwrite = dict(options), schema.names, overwrite
        self.uri = self.options["path"]
        files, path = located(self.uri)
        if not overwrite and exists(files, path):
            raise FileExistsError(self.uri)
        self.parts = f"{self.uri}.parts-{uuid.uuid4().hex}"
        folder = located(self.parts)
        folder[0].create_dir(folder[1], recursive=True)

    def line(self, row: Row) -> bytes:
        raise NotImplementedError

    def before(self, parts: list[Part]) -> bytes:
        return b""

    def after(self) -> bytes:
        return b""

    def write(self, rows: Iterator[Row]) -> Part:
        own = f"{self.parts}/{uuid.uuid4().hex}"
        files, path = located(own)
        count, latest, dated = 0, None, self.options.get("latest", "published")
        try:
            with files.open_output_stream(path) as out:
                for row in rows:
                    out.write((self.between if count else b"") + self.line(row))
                    count += 1
                    day = row[dated] if dated in self.names else None
                    if day is not None and (latest is None or text_of(day) > latest):
                        latest = text_of(day)
        except BaseException:
            files.delete_file(path)
            raise
        return Part(TaskContext.get().partitionId(), own, count, latest)

    def commit(self, messages: list[Part]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        files, path = located(f"{self.parts}/whole")
        with files.open_output_stream(path) as out:
            out.write(self.before(parts))
            begun = False
            for part in parts:
                if not part.rows:
                    continue
                if begun:
                    out.write(self.between)
                begun = True
                own, name = located(part.path)
                with own.open_input_stream(name) as given:
                    while piece := given.read(PIECE):
                        out.write(piece)
            out.write(self.after())
        target = located(self.uri)[1]
        if exists(files, target) and not self.overwrite:
            raise FileExistsError(self.uri)
        if exists(files, target):
            files.delete_file(target)
        files.move(path, target)
        self.clear()

    def abort(self, messages: list[Part]) -> None:
        self.clear()

    def clear(self) -> None:
        files, folder = located(self.parts)
        if exists(files, folder):
            files.delete_dir(folder)


class CsvFile(OneFile):
    def cells(self, values) -> bytes:
        return ",".join('"' + text_of(v).replace('"', '""') + '"' for v in values).encode("utf-8", "surrogatepass")

    def line(self, row: Row) -> bytes:
        return self.cells(row)

    def before(self, parts: list[Part]) -> bytes:
        return MARK + self.cells(self.names) + (b"\n" if any(p.rows for p in parts) else b"")


class ArticleFile(OneFile):
    between = b",\n"

    def line(self, row: Row) -> bytes:
        return json.dumps(plain(row), ensure_ascii=False).encode("utf-8", "surrogatepass")

    def before(self, parts: list[Part]) -> bytes:
        latest = max((p.latest for p in parts if p.latest is not None), default=None)
        head = f'{{"stats": {json.dumps(json.loads(self.options.get("stats", "{}")), ensure_ascii=False)},\n"latest_published": {json.dumps(latest)},\n"articles": [\n'
        return head.encode()

    def after(self) -> bytes:
        return b"\n]}\n"


class CsvSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textloom_csv"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return CsvFile(self.options, schema, overwrite)


class ArticleSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textloom_articles"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArticleFile(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CsvSink)
    spark.dataSource.register(ArticleSink)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """df as one CSV file, in its order."""
    register(df.sparkSession)
    df.write.format("textloom_csv").mode("overwrite" if overwrite else "append").save(path)


def write_articles(df: DataFrame, path: str, stats: dict[str, int] | None = None, latest: str = "published", overwrite: bool = False) -> None:
    """df as one JSON file with the counts of its run's stages and its latest date."""
    register(df.sparkSession)
    df.write.format("textloom_articles").option("stats", json.dumps(stats or {})).option("latest", latest).mode("overwrite" if overwrite else "append").save(path)
