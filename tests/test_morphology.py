import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.operators import analysis, morphology

SENTENCES = [
    "태권도는 태권도를 태권도 가르친다", "태권도의 도장에서 겨루기를 했다", "학교에서 학생들이 태권도를 배우고 학교는 열렸다", "대회가 열리는 학교", "학생이 학생을 가르치고 배운다", "대회는 끝났다 대회를 했고 열렸고",
    "겨루기가 겨루기는 도장이 도장은 도장을", "발표하는 발표했다 발표한다 발표를 발표가", "학교 학생 대회", "가르쳤다 배웠다 배우는 열리고 했지만",
]


def built(spark):
    df = spark.createDataFrame(list(enumerate([*SENTENCES, None, "", "no Hangul 12"])), "id int, text string")
    return df, morphology.stem_statistics(morphology.word_counts(df, F.col("text")))


def test_statistics_by_hand(spark):
    """Varieties and counts against a plain count over all ways."""
    df, statistics = built(spark)
    endings, total = defaultdict(set), Counter()
    for word, n in Counter(" ".join(SENTENCES).split()).items():
        for kind, stem, ending in morphology.ways(word):
            if kind == morphology.NOUN or ending not in morphology.PARTICLE_SET:
                endings[kind, stem].add(ending)
                total[kind, stem] += n
    found = {(r["kind"], r["stem"]): (r["variety"], r["n"]) for r in statistics.collect()}
    assert found == {k: (len(x), total[k]) for k, x in endings.items()}
    assert found["n", "태권도"] == (4, 5) and found["v", "열리"] == (3, 3) and found["v", "발표하"] == (2, 2)


def test_words_of_one_stem_are_one_term(spark):
    df, statistics = built(spark)
    stems = morphology.lexicon(statistics)
    read = morphology.with_tokens(df, "text", stems)
    terms = Counter()
    for r in analysis.term_counts(read, "id", "text", "tokens").collect():
        terms[r["term"], r["pos"]] += r["count"]
    assert terms["태권도", "NNG"] == 5 and terms["학교", "NNG"] == 4 and terms["대회", "NNG"] == 4 and terms["도장", "NNG"] == 4
    assert terms["열리다", "VV"] == 4 and terms["배우다", "VV"] == 4 and terms["발표하다", "VV"] == 3 and terms["발표", "NNG"] == 2
    assert not {t for t, _ in terms} & {"태권도는", "태권도를", "열렸다"}
    rows = {r["id"]: r["tokens"] for r in read.collect()}
    assert [tuple(t) for t in rows[0]][:4] == [("태권도", "NNG", "태권도"), ("는", "JX", "는"), ("태권도", "NNG", "태권도"), ("를", "JX", "를")]
    assert rows[10] == rows[11] == [] and [t["form"] for t in rows[12]] == ["no", "Hangul", "12"]


def test_bounds_of_the_lexicon(spark):
    """The stems of the largest variety, at most as many as are asked for; words without a way stay whole."""
    df, statistics = built(spark)
    first = morphology.lexicon(statistics, 1).collect()
    assert len(first) == 1 and first[0]["variety"] == max(r["variety"] for r in statistics.collect())
    none = morphology.with_tokens(df, "text", morphology.lexicon(statistics, 0))
    assert [t["form"] for t in none.where("id = 0").first()["tokens"]] == SENTENCES[0].split()
    empty = morphology.lexicon(morphology.stem_statistics(morphology.word_counts(df.limit(0), F.col("text"))))
    assert empty.collect() == []
    assert morphology.analysed("가" * 30, {("n", "가" * 30): 9}) == [("가" * 30, "NNG", "가" * 30)]


def test_syllables_are_opened():
    """Each final with each vowel: what is opened is a syllable without a final, of the same lead."""
    for final, pair in morphology.OPEN_OF.items():
        assert len(pair) == 19 * 21
        for given, stem in pair.items():
            assert (ord(given) - 0xAC00) % 28 == morphology.FINALS[final] and (ord(stem) - 0xAC00) % 28 == 0
            assert (ord(given) - 0xAC00) // 588 == (ord(stem) - 0xAC00) // 588
    assert [morphology.OPEN_OF["ᆻ"][x] for x in "했렸왔웠됐갔"] == list("하리오우되가")


def test_random_words_are_split_as_they_were_joined(spark):
    """Nouns with several particles each, in a corpus of their own: the joined words come apart again."""
    rng = random.Random(4)
    syllables = [chr(0xAC00 + 28 * k) for k in range(0, 399, 7)]
    nouns = list({"".join(rng.choices(syllables, k=3)) for _ in range(60)})
    particles = ["를", "는", "의", "에서", "부터", ""]
    texts = [" ".join(n + rng.choice(particles) for n in rng.choices(nouns, k=40)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    stems = morphology.lexicon(morphology.stem_statistics(morphology.word_counts(df, F.col("text"))))
    found = analysis.term_counts(morphology.with_tokens(df, "text", stems), "id", "text", "tokens").groupBy("term").agg(F.sum("count").alias("n")).collect()
    assert sum(r["n"] for r in found if r["term"] in nouns) >= 0.99 * 1200


def test_terms_are_counted_where_words_are_read(spark):
    """with_terms gives what with_tokens and term_counts give; a term of two parts of speech is one document's once, without a shuffle of ids."""
    from textloom.operators import insights

    texts = ["가다가 가고 가다 가며 abc 12 abc", "학교에 학교는 학교 갔다 갔고", None, "힣" * 25 + " " + "x" * 120]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    stems = spark.createDataFrame([("n", "학교", 3), ("v", "가", 5), ("n", "가다", 2)], "kind string, stem string, variety int")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    counted = morphology.with_terms(df, "text", stems)
    assert rows(analysis.term_counts(counted, "id", "text", terms_col="terms")) == rows(analysis.term_counts(morphology.with_tokens(df, "text", stems), "id", "text", "tokens"))
    two = spark.createDataFrame([(1, [("가다", "NNG", 1), ("가다", "VV", 2), ("b", "SL", 1)])], "id int, terms array<struct<term:string,pos:string,count:int>>")
    words = analysis.document_words(two, "id", "text", analysis.Settings(), terms_col="terms", firsts=True)
    found = insights.core_words(words, "id", first=F.col("first"))
    assert [(r["word"], r["docs"], r["mean_share"]) for r in found.collect()] == [("가다", 1, 50.0)]
    assert "count(distinct" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_ways_of_equal_rank(spark):
    """A cut between syllables comes before one within, whatever the order of the lexicon: the SQL's row_number leaves this tie open."""
    given = [("v", "호는하", 2), ("v", "호는한", 2)]
    for rows in (given, given[::-1]):
        stems = spark.createDataFrame(rows, "kind string, stem string, variety long")
        found = morphology.with_terms(spark.createDataFrame([(1, "호는한다")], "id int, t string"), "t", stems).first()["terms"]
        assert [(t["term"], t["pos"], t["count"]) for t in found] == [("호는한다", "VV", 1)]
    better = spark.createDataFrame([("v", "호는하", 3), ("v", "호는한", 2)], "kind string, stem string, variety long")
    found = morphology.with_terms(spark.createDataFrame([(1, "호는한다")], "id int, t string"), "t", better).first()["terms"]
    assert [t["term"] for t in found] == ["호는하다"]


def texts_by_the_whole_lexicon(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(("학교", "학생", "대회", "열리", "배우", "호는하", "호는한", "가", "하")) + rng.choice(("은", "를", "다", "고", "에서", "한다", "했다", "")) for _ in range(30)) for _ in range(20)]
    texts += [*SENTENCES, None, "", "no Hangul 12", "힣" * 25 + " " + "x" * 120 + "가a", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return df, morphology.stem_statistics(morphology.word_counts(df, F.col("text")))


def test_no_stem_is_left_out(spark):
    """The lexicon holds every stem with endings enough, whatever their number, and a small one that is given is not cut without a word."""
    made = spark.range(morphology.MOST_STEMS + 5).select(F.lit("n").alias("kind"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("stem"), F.lit(2).cast("long").alias("variety"), F.lit(3).cast("long").alias("n"))
    assert morphology.lexicon(made).count() == morphology.MOST_STEMS + 5
    with pytest.raises(ValueError):
        morphology.with_terms(spark.createDataFrame([(1, "가")], "id int, text string"), "text", morphology.lexicon(made))


def test_words_are_read_by_joins_as_one_by_one(spark):
    """words_read against `analysed` with the whole lexicon, for each word."""
    df, statistics = texts_by_the_whole_lexicon(spark)
    varieties = {(r["kind"], r["stem"]): r["variety"] for r in morphology.lexicon(statistics).collect()}
    found = morphology.words_read(morphology.word_counts(df, F.col("text")), morphology.lexicon(statistics)).collect()
    assert len(found) > 60
    for r in found:
        form, tag, lemma = morphology.analysed(r["word"], varieties)[0]
        assert (r["term"], r["pos"]) == (lemma if tag == "VV" else form, tag), r["word"]


def test_document_terms_do_not_depend_on_what_is_sent(spark):
    """Whether all terms go to the tasks, some or none: the terms that the whole lexicon gives, in order, for each row."""
    df, statistics = texts_by_the_whole_lexicon(spark)
    wanted = {r["id"]: [tuple(t) for t in r["terms"]] for r in morphology.with_terms(df, "text", morphology.lexicon(statistics)).collect()}
    for most in (morphology.MOST_TERMS, 5, 0):
        found = morphology.document_terms(df, "id", "text", most)
        assert found.dtypes == [("id", "int"), ("terms", "array<struct<term:string,pos:string,count:int>>")]
        assert {r["id"]: [tuple(t) for t in r["terms"]] for r in found.collect()} == wanted, most
    twice = morphology.document_terms(df.union(df), "id", "text", 5).collect()
    assert len(twice) == 2 * len(wanted) and all([(t, p, n) for t, p, n in r["terms"]] == wanted[r["id"]] for r in twice)
    assert morphology.document_terms(df.limit(0), "id", "text", 5).collect() == []


@pytest.mark.parametrize("name", ["korean_terms", "korean_core_words"])
def test_no_cap_on_stems_in_the_queries(spark, name):
    """Neither query's SQL has a limit on stems, and neither plan asks lexicon for one."""
    from textloom.plans import catalog

    assert "limit 100000" not in catalog.oracle_sql()[name] and "variety >= 2" in catalog.oracle_sql()[name]


def test_stems_beyond_the_sent_ones_in_the_query(spark, tmp_path, monkeypatch):
    """korean_terms with a lexicon larger than what would be sent gives what its SQL gives."""
    import duckdb

    from textloom.plans import catalog

    monkeypatch.setattr(morphology.document_terms, "__defaults__", (3,))
    rows = [(i, t) for i, t in enumerate(["dog dogs doge the cat cats cate", "cat cate dogs then there", None, "", "Über dogs cat", "dogf dogm dogb catb catf"])]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    found = sorted(tuple(r) for r in catalog.queries()["korean_terms"](spark, str(tmp_path)).collect())
    own = duckdb.connect()
    own.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    assert found == sorted(own.execute(catalog.oracle_sql()["korean_terms"]).fetchall()) and len(found) > 10
