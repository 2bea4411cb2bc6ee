"""Ordered removal of duplicates: the row that comes first wins."""

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.components import components
from textloom.session import stored


def first_per_key(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The first row of each key; Spark limits the window's groups before it shuffles."""
    keys = [key] if isinstance(key, str) else key
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_first", F.row_number().over(window)).where(F.col("_first") == 1).drop("_first")


def ranked(df: DataFrame, order: str, group: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Places from 1 in each group (of a job's size)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(order)))


def fold_by_job(df: DataFrame, group: list[str], order: str, url_key: str, other_key: str) -> DataFrame:
    """The definition of two-key removal, for jobs of bounded size: rows in order, a row is dropped if either of its keys was
    registered before; a dropped row registers neither; an empty second key counts for nothing."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        urls, titles, kept = set(), set(), []
        pdf = pdf.sort_values(order)
        for url, title in zip(pdf[url_key], pdf[other_key].fillna(""), strict=True):
            new = url not in urls and not (title and title in titles)
            kept.append(new)
            if new:
                urls.add(url)
                titles.add(title)
        return pdf[kept]

    return df.groupBy(*group).applyInPandas(fold, df.schema)


def decided(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over rows (o, u, t): what is kept, and what is still open."""
    by_url, by_other = (rest.groupBy(k).agg(F.min("o").alias(f"first_{k}")) for k in ("u", "t"))
    placed = rest.join(by_url, "u").join(by_other, "t")
    kept = stored(placed.where((F.col("o") == F.col("first_u")) & (F.col("o") == F.col("first_t"))).select("o", "u", "t"), "kept")
    return kept, stored(rest.join(kept.select("u"), "u", "left_anti").join(kept.select("t"), "t", "left_anti"), "open")


def folded(rest: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows (o, u, t) that hang together by shared keys, up to `most` of them, are folded in one task: what is kept, and the rows of larger groups."""
    links = None
    for k in ("u", "t"):
        first = rest.groupBy(k).agg(F.min("o").alias("b"))
        own = rest.join(first, k).select(F.col("o").alias("a"), "b").where("a <> b")
        links = own if links is None else links.unionByName(own)
    groups = components(links).withColumnsRenamed({"node": "o", "component": "group"})
    placed = rest.join(groups, "o", "left").withColumn("group", F.coalesce("group", "o"))
    sizes = placed.groupBy("group").agg(F.count("*").alias("n"))
    small = stored(placed.join(sizes, "group").select("o", "u", "t", "group", (F.col("n") <= most).alias("small")), "groups")
    kept = fold_by_job(small.where("small").drop("small"), ["group"], "o", "u", "t").select("o", "u", "t")
    return kept, stored(small.where("not small").select("o", "u", "t"), "open")


def dedup_two_keys(df: DataFrame, order: str, url_key: str, other_key: str, rounds_first: int = 3, most_folded: int = 100_000) -> DataFrame:
    """The same as the fold, for any size: rounds over (order, keys) only, then one semi join.

    In each round, the rows that are first in both their groups are kept, and undecided rows that share a key with a kept one
    go. Nearly all rows are settled so after a few rounds. What is left then are chains, whose rows share one key with the row
    before and the other with the row behind: groups of up to most_folded rows that hang together are folded in a task each,
    and larger ones go through further rounds, as many as they need. Null keys are compared as ""; order must tell rows apart.
    """
    alone = F.concat(F.lit("\x00"), F.col(order).cast("string"))
    rest = stored(df.select(F.col(order).alias("o"), F.coalesce(url_key, F.lit("")).alias("u"), F.coalesce(F.nullif(F.col(other_key), F.lit("")), alone).alias("t")), "open")
    found, n = [], 0
    while not rest.isEmpty():
        some, rest = folded(rest, most_folded) if n == rounds_first else decided(rest)
        found.append(some.select("o"))
        n += 1
    if not found:
        return df.limit(0)
    kept = reduce(lambda a, b: a.unionByName(b), found)
    return df.join(kept, df[order] == kept["o"], "left_semi")


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys are not stored yet."""
    return incoming.join(stored.select(*keys), keys, "left_anti")


def distinct_in_order(df: DataFrame, column: str, order: str) -> DataFrame:
    return df.groupBy(column).agg(F.min(order).alias(order)).orderBy(order)
