import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import keywords
from textloom.operators.keywords import Searcher

SPACE = "[" + "".join(map(re.escape, map(chr, keywords.SPACES))) + "]"


def by_search(keyword, text):
    """One pattern for each keyword, as it would be searched from left to right."""
    words = [w for w in re.split(SPACE, keyword) if w]
    return len(re.findall((SPACE + "*").join(map(re.escape, words)), text, re.I)) if words else 0


CASES = [
    ("승단 심사", "승단심사와 승단  심사, 승단\n심사", 3), ("Abc", "abc ABC aBcabc", 4), ("a.b", "a.b axb", 1), ("  ", "anything", 0), ("태권도", "태권도장 태권 도", 1), ("태권 도", "태권도장 태권 도", 2), ("aa", "aaaa aaa", 3),
    ("a a", "aaa a", 2), ("É", "é É", 2), ("x　y", "x y xy x y", 3), ("aba", "ababa aba", 2), ("\U0001d538b", "\U0001d538B \U0001d538 b", 1), ("k", "K", 1),
]


@pytest.mark.parametrize(("keyword", "text", "count"), CASES)
def test_one_keyword(keyword, text, count):
    assert Searcher([keyword]).find(text).get(keyword, 0) == count == by_search(keyword, text)


@pytest.mark.parametrize("seed", range(4))
def test_overlapping_and_spaced_keywords(seed):
    """Prefixes, suffixes and infixes of each other, with spaces at different places, over a small alphabet."""
    rng = random.Random(seed)
    own = list({"".join(rng.choices("abcAB \n", k=rng.randint(1, 6))) for _ in range(300)})
    searcher = Searcher(own)
    for _ in range(20):
        text = "".join(rng.choices("abcAB  \t", k=rng.randint(0, 300)))
        want = {k: n for k in own if (n := by_search(k, text))}
        assert searcher.find(text) == want


@pytest.mark.parametrize("group_chars", [keywords.GROUP_CHARS, 5_000])
def test_ten_thousand_keywords(spark, group_chars):
    """Rows for what is found only, whatever the groups; nothing as large as documents times keywords."""
    rng = random.Random(5)
    words = ["".join(rng.choices("kamilotz", k=rng.randint(3, 7))) for _ in range(3000)]
    own = list({" ".join(rng.choices(words, k=rng.randint(1, 2))) for _ in range(10_500)})[:10_000] + ["", " ", None]
    texts = [(i, " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=60))) for i in range(40)] + [(100, None, None), (101, "", "")]
    df = spark.createDataFrame(texts, "id int, title string, body string").withColumn("hits", F.lit(1))
    table = spark.createDataFrame([(k,) for k in [*own, own[0]]], "keyword string")
    found = keywords.keyword_hits(df, table, "id", F.col("title"), F.col("body"), group_chars)
    assert found.columns == ["id", "keyword", "mentions", "density", "title_has", "length"]
    got = {(r["id"], r["keyword"]): (r["mentions"], r["title_has"]) for r in found.collect()}
    one = Searcher([k for k in own if k])
    want = {}
    for i, title, body in texts:
        head, rest = one.find(title), one.find(body)
        want |= {(i, k): (rest.get(k, 0), k in head) for k in head.keys() | rest.keys()}
    assert got == want and 2_000 < len(got) < 42 * 10_000 // 50
    some = rng.sample(sorted(want), 50) + [(texts[3][0], k) for k in rng.sample(own[:10_000], 50)]
    for i, k in some:
        assert want.get((i, k), (0, False)) == (by_search(k, texts[i][2]), by_search(k, texts[i][1]) > 0)


def test_pairs_and_lists(spark):
    """Pairs keep their rows and columns; a short list gives a row for each of its keywords."""
    docs = spark.createDataFrame([(1, "About tea", "Tea and tea. " * 3), (2, "x", "coffee"), (3, None, None)], "content_id int, title string, body string")
    pairs = spark.createDataFrame([(1, "tea", "w"), (1, "milk", "w"), (2, "tea", "v"), (3, "tea", "v")], "content_id int, keyword string, workspace_id string")
    found = keywords.of_pairs(pairs, docs, "content_id", F.col("title"), F.col("body")).orderBy("content_id", "keyword")
    assert [(r["content_id"], r["keyword"], r["workspace_id"], r["mentions"], r["title_has"], r["length"]) for r in found.collect()] == [(1, "milk", "w", 0, False, 39), (1, "tea", "w", 6, True, 39), (2, "tea", "v", 0, False, 6), (3, "tea", "v", 0, False, 0)]
    listed = keywords.of_all_keywords(docs, ["tea", "coffee", "tea"], "content_id", F.col("title"), F.col("body"))
    assert {(r["content_id"], r["keyword"]): (r["mentions"], r["density"], r["title_has"]) for r in listed.collect()} == {
        (1, "tea"): (6, 153.85, True), (1, "coffee"): (0, 0.0, False), (2, "tea"): (0, 0.0, False), (2, "coffee"): (1, 166.67, False), (3, "tea"): (0, 0.0, False), (3, "coffee"): (0, 0.0, False),
    }
    assert {r[0] for r in keywords.normalized(spark.createDataFrame([(" a  b ",), ("a b",), (" ",), (None,)], "keyword string")).collect()} == {"a b"}


def test_texts_go_to_python_once_in_small_batches(spark):
    """keyword_hits reads each text once for a group of keywords, and no batch grows with the table."""
    from textloom.functions import batches

    for setting in (batches.RECORDS_SETTING, batches.BYTES_SETTING):
        spark.conf.unset(setting)
    df = spark.createDataFrame([(1, "a", "tea and tea"), (2, "b", "none"), (3, None, None)], "id int, title string, body string")
    found = keywords.keyword_hits(df, ["tea"], "id", F.col("title"), F.col("body"))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert spark.conf.get(batches.RECORDS_SETTING) == str(batches.MOST_RECORDS) and spark.conf.get(batches.BYTES_SETTING).rstrip("b") == str(batches.MOST_BYTES)
    assert [(r["id"], r["keyword"], r["mentions"]) for r in found.collect()] == [(1, "tea", 2)]
