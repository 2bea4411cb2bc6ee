"""A collection's stages over article rows: duplicates, recency, what is stored already, body, cleaning and gates.

Rows carry an `ordinal`: the order in which they were found, which decides who wins. Names of the stages differ by kind of
source.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import LATIN, HANGUL, script_ratio, strip, title_key
from textloom.functions.urls import canonical_url
from textloom.operators.clean import cleaned
from textloom.operators.dedup import dedup_two_keys, first_per_key

#: The stages that each kind of source counts.
STAGES = {
    "news_keyword": ("collected", "deduped", "recent", "unseen", "extracted", "cleaned"),
    "board": ("collected", "recent", "unseen", "cleaned"),
    "url_list": ("collected", "unseen", "extracted", "cleaned"),
}
#: A stage that a kind of source lacks shows the count of the one before.
ALL_STAGES = ("collected", "deduped", "recent", "unseen", "extracted", "cleaned")
LEAST_BODY = {"news_keyword": 100, "board": 30, "url_list": 30}


def in_order(frames: list[DataFrame], order: str = "ordinal") -> DataFrame:
    """Frames one after the other: their rows keep their order within, and earlier frames come first."""
    out = None
    for i, df in enumerate(frames):
        own = df.withColumn(order, F.struct(F.lit(i).alias("frame"), F.col(order).alias("row")))
        out = own if out is None else out.unionByName(own)
    return out


def recent(published: Column, cutoffs: list[datetime]) -> Column:
    """The widest of the windows given; a date that can't be read passes; no window, no filter."""
    return F.lit(True) if not cutoffs else published.isNull() | (published >= F.lit(min(cutoffs)))


def keyed(articles: DataFrame, url_col: str = "url", title_col: str = "title") -> DataFrame:
    return articles.withColumns({"normalized_url": canonical_url(F.col(url_col)), "title_key": title_key(F.coalesce(F.col(title_col), F.lit("")))})


def deduped(articles: DataFrame, by_title: bool = True, order: str = "ordinal") -> DataFrame:
    """articles: keyed. By URL and title in order, or by URL alone (boards have many equal titles)."""
    return dedup_two_keys(articles, order, "normalized_url", "title_key") if by_title else first_per_key(articles, "normalized_url", order)


def unseen(articles: DataFrame, contents: DataFrame) -> DataFrame:
    return articles.join(contents.select("normalized_url").distinct(), "normalized_url", "left_anti")


def has_body(body: Column) -> Column:
    return F.coalesce(strip(body) != "", F.lit(False))


def allowed(articles: DataFrame, robots: DataFrame, origin: Column) -> DataFrame:
    """robots: origin, blocked (array of path prefixes). An origin without rules allows all."""
    from textloom.functions.urls import path

    rules = robots.select(F.col("origin").alias("_origin"), "blocked")
    joined = articles.withColumn("_own", origin).join(rules, F.col("_own") == F.col("_origin"), "left")
    return joined.where(F.coalesce(~F.exists("blocked", lambda p: path(F.col("url")).startswith(p)), F.lit(True))).drop("_own", "_origin", "blocked")


def stage_flags(articles: DataFrame, body_col: str, cutoffs: list[datetime], least_length: int, least_share: float | None = 0.5, script: str = HANGUL, others: str = LATIN) -> DataFrame:
    """Flags of how far each row comes, for counts in one pass: is_recent, is_extracted, is_cleaned."""
    out = cleaned(articles, body_col, "cleaned_body")
    long_enough = F.length("cleaned_body") >= least_length
    right = F.lit(True) if least_share is None else script_ratio(F.col("cleaned_body"), script, others) >= least_share
    out = out.withColumn("is_recent", recent(F.col("published_at"), cutoffs)).withColumn("is_extracted", F.col("is_recent") & has_body(F.col(body_col)))
    return out.withColumn("is_cleaned", F.col("is_extracted") & long_enough & right)


def stage_counts(flags: DataFrame, by: list[str]) -> DataFrame:
    return flags.groupBy(*by).agg(F.count("*").alias("collected"), F.count_if("is_recent").alias("recent"), F.count_if("is_extracted").alias("extracted"), F.count_if("is_cleaned").alias("cleaned"))


def all_stages(counts: Column) -> Column:
    """A map of stage counts as one over ALL_STAGES: a missing stage has the count of the one before."""
    values, last = [], F.lit(0)
    for name in ALL_STAGES:
        last = F.coalesce(counts[name], last)
        values += [F.lit(name), last]
    return F.create_map(*values)


def watermark(articles: DataFrame, stored: Column | None = None) -> DataFrame:
    """The latest readable date: the next collection's `since`. It only moves forward."""
    latest = F.max("published_at")
    return articles.agg((latest if stored is None else F.greatest(latest, stored)).alias("latest_published"))


def url_check(blocked: Column, fetched: Column, length: Column, share: Column, least_length: int, least_share: float | None = 0.5) -> Column:
    """What the check of a URL says; the first that holds."""
    foreign = F.lit(False) if least_share is None else share < least_share
    return F.when(blocked, "robots").when(~fetched, "fail").when(length < least_length, "short").when(foreign, "foreign").otherwise("ok")
