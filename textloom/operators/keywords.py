"""Mentions of many keywords in one pass over each text.

An Aho-Corasick automaton holds all keywords without white space and in one case. A text is read without its white space as well;
a keyword's words may stand with or without space between them, but a hit with space inside of a word is none. Of hits of one
keyword that overlap, the first counts, as in a search from left to right. Only keywords that a text holds make rows: nothing is
as large as documents times keywords.

Keywords go to the tasks by broadcast, in groups of at most GROUP_CHARS characters, each of which reads the texts once more: so
what a task holds is bounded whatever their number. Texts go in small batches, and no text goes twice for one group.

Defined cases: a blank keyword is never found; a null text holds nothing; equal keywords count once; keywords that differ in case
or in white space alone are found each for itself.
"""

import sys
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from textloom.functions.batches import released, small_batches
from textloom.functions.text import collapse, density

GROUP_CHARS = 2_000_000
# Unicode's white space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
HITS = T.ArrayType(T.StructType([T.StructField("keyword", T.StringType()), T.StructField("mentions", T.IntegerType()), T.StructField("title_has", T.BooleanType())]))


@cache
def one_case() -> dict[int, int]:
    """Characters that another one stands for: letters whose upper case has one lower case, by themselves and not in context."""
    out = {}
    for code in range(sys.maxunicode + 1):
        upper = chr(code).upper()
        lower = (upper if len(upper) == 1 else chr(code)).lower()
        if ord(lower[0]) != code:
            out[code] = ord(lower[0])
    return out


@cache
def space_flags() -> np.ndarray:
    out = np.zeros(max(SPACES) + 1, bool)
    out[SPACES] = True
    return out


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(one_case())


def squashed(text: str) -> tuple[str, np.ndarray | None]:
    """The text in one case without white space; for each of its characters how many times white space stood before it, or None if there is none within."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    flags = space_flags()
    own = np.flatnonzero(~flags[np.minimum(codes, len(flags) - 1)] | (codes >= len(flags)))
    if len(own) == len(codes):
        return folded(text), None
    gaps = np.cumsum(np.concatenate([[0], np.diff(own) > 1])) if len(own) else None
    return folded(codes[own].tobytes().decode("utf-32-le", "surrogatepass")), gaps


def first_of_overlapping(ends: np.ndarray, length: int) -> int:
    """How many hits of one keyword a search from left to right finds."""
    if len(ends) < 2 or np.diff(ends).min() >= length:
        return len(ends)
    found, free = 0, -1
    for end in ends.tolist():
        if end - length >= free:
            found, free = found + 1, end
    return found


class Searcher:
    def __init__(self, keywords: Iterable[str]):
        #: For each squashed keyword the keywords behind it, each with where its words begin and end.
        self.entries: list[list[tuple[str, list[tuple[int, int]]]]] = []
        self.automaton = ahocorasick.Automaton()
        places: dict[str, int] = {}
        for keyword in keywords:
            words = "".join(" " if ord(c) in SPACES else c for c in keyword).split(" ")
            ends = np.cumsum([len(w) for w in words if w]).tolist()
            key = folded("".join(words))
            if not key:
                continue
            if key not in places:
                places[key] = len(self.entries)
                self.automaton.add_word(key, len(self.entries))
                self.entries.append([])
            self.entries[places[key]].append((keyword, list(zip([0, *ends], ends, strict=False))))
        if places:
            self.automaton.make_automaton()
        self.lengths = [e[0][1][-1][1] for e in self.entries]

    def find(self, text: str | None) -> dict[str, int]:
        """Keywords in the text and how often they stand in it."""
        if not text or not self.entries:
            return {}
        plain, gaps = squashed(text)
        hits = np.fromiter((x for hit in self.automaton.iter(plain) for x in hit), np.int64).reshape(-1, 2)
        if not len(hits):
            return {}
        order = np.argsort(hits[:, 1], kind="stable")
        ends, keys = hits[order, 0] + 1, hits[order, 1]
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        out = {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            key, own = int(keys[a]), ends[a:b]
            starts = own - self.lengths[key]
            for keyword, words in self.entries[key]:
                whole = own
                if gaps is not None:
                    # No white space between the first and the last character of a word.
                    fine = np.ones(len(own), bool)
                    for first, last in words:
                        fine &= gaps[starts + first] == gaps[starts + last - 1]
                    whole = own[fine]
                if count := first_of_overlapping(whole, self.lengths[key]):
                    out[keyword] = count
        return out


def hits_of(sent: Broadcast):
    @pandas_udf(HITS)
    def found(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        searcher = Searcher(sent.value)
        for titles, bodies in parts:
            out = []
            for title, body in zip(titles, bodies, strict=True):
                own = searcher.find(body)
                head = own if title == body else searcher.find(title)
                out.append([(k, own.get(k, 0), k in head) for k in [*own, *(k for k in head if k not in own)]])
            yield pd.Series(out)
            released()

    return found


def groups_of(keywords: Iterator[str], group_chars: int) -> Iterator[list[str]]:
    held, size = [], 0
    for keyword in keywords:
        if held and size + len(keyword) > group_chars:
            yield held
            held, size = [], 0
        held.append(keyword)
        size += len(keyword)
    yield held


def with_hits(df: DataFrame, keywords: DataFrame | Iterable[str], title: Column, body: Column, as_col: str = "hits", group_chars: int = GROUP_CHARS) -> DataFrame:
    """df with an array of (keyword, mentions in the body, title_has) of the keywords that its title or body holds. keywords: texts, or a table with a column `keyword`."""
    spark = df.sparkSession
    small_batches(spark)
    each = (r[0] for r in keywords.select("keyword").where("keyword is not null").distinct().toLocalIterator()) if isinstance(keywords, DataFrame) else iter(dict.fromkeys(keywords))
    parts = [hits_of(spark.sparkContext.broadcast(group))(title, body) for group in groups_of(each, group_chars)]
    return df.withColumn(as_col, F.concat(*parts) if len(parts) > 1 else parts[0])


def keyword_hits(df: DataFrame, keywords: DataFrame | Iterable[str], id_col: str, title: Column, body: Column, group_chars: int = GROUP_CHARS) -> DataFrame:
    """id, keyword, mentions, density (for each 1,000 characters of the body), title_has, length (of the body): a row for each keyword that a document holds."""
    found = with_hits(df.select(F.col(id_col), title.alias("_title"), body.alias("_body")), keywords, F.col("_title"), F.col("_body"), "_hits", group_chars)
    # Outer, as for a plain one Spark would add a filter on the array, for which Python would read each text twice.
    narrow = found.select(id_col, F.length(F.coalesce("_body", F.lit(""))).alias("length"), F.explode_outer("_hits").alias("h")).where("h is not null")
    return narrow.select(id_col, "h.keyword", "h.mentions", density(F.col("h.mentions"), F.col("length")).alias("density"), "h.title_has", "length")


def of_all_keywords(df: DataFrame, keywords: list[str], id_col: str, title: Column, body: Column) -> DataFrame:
    """As keyword_hits, with a row of no mentions for each keyword of a short, fixed list that a document does not hold."""
    found = with_hits(df.select(F.col(id_col), title.alias("_title"), body.alias("_body")), keywords, F.col("_title"), F.col("_body"), "_hits")
    narrow = found.select(id_col, F.length(F.coalesce("_body", F.lit(""))).alias("length"), F.map_from_entries(F.transform("_hits", lambda h: F.struct(h["keyword"], h))).alias("_of"), F.explode(F.array(*[F.lit(k) for k in dict.fromkeys(keywords)])).alias("keyword"))
    own = F.try_element_at("_of", F.col("keyword"))
    mentions = F.coalesce(own["mentions"], F.lit(0))
    return narrow.select(id_col, "keyword", mentions.alias("mentions"), density(mentions, F.col("length")).alias("density"), F.coalesce(own["title_has"], F.lit(False)).alias("title_has"), "length")


def of_pairs(pairs: DataFrame, texts: DataFrame, id_col: str, title: Column, body: Column) -> DataFrame:
    """pairs (with columns id and keyword) with mentions, density, title_has and length: the keywords that each document was found by.

    The texts are read once for all keywords; what they hold meets the pairs, narrow rows both.
    """
    wanted = texts.join(pairs.select(id_col).distinct(), id_col, "left_semi")
    found = keyword_hits(wanted, pairs.select("keyword"), id_col, title, body).drop("length")
    lengths = wanted.select(id_col, F.length(F.coalesce(body, F.lit(""))).alias("length"))
    out = pairs.join(lengths, id_col).join(found, [id_col, "keyword"], "left")
    return out.withColumns({"mentions": F.coalesce("mentions", F.lit(0)), "density": F.coalesce("density", F.lit(0.0)), "title_has": F.coalesce("title_has", F.lit(False))})


def normalized(keywords: DataFrame) -> DataFrame:
    """keyword: trimmed, with single spaces, without blank and repeated ones."""
    return keywords.select(collapse(F.col("keyword")).alias("keyword")).where("keyword <> ''").distinct()
