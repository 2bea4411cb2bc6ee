"""Stems and endings of Korean words, told apart by how many endings the corpus puts behind a stem.

A word (a run of Hangul) can be split into a stem and an ending in several ways: at each syllable, and within a syllable whose final
consonant may be the ending's first letter (갔다 is 가 and ᆻ다; contracted vowels are opened: 했다 is 하 and ᆻ다, 열렸다 is 열리 and
ᆻ다). Endings are a closed class: particles behind nouns, none among them, and verb endings. Statistics over the corpus decide
between the ways: a stem's variety is the number of different endings that follow it. One grouped count gives the distinct words,
another the varieties; neither holds texts.

The lexicon is every stem with LEAST_VARIETY endings at least. For verbs only endings count that are no particles. A word's best way
has the largest sum of ln(1 + variety) and its stem's length in syllables (ties: nouns before verbs, then the longer stem, then the
ending that begins a syllable: 한다 is 한 and 다 if 하 and ᆫ다 is no better); a word without a way in the lexicon stays whole, as a noun.

document_terms reads a corpus by its own lexicon, however large: the best way of each distinct word is found by a join, the words of
the most frequent terms (MOST_TERMS) go to the tasks by broadcast, and a document's other words are joined. with_tokens and with_terms
are for a lexicon that is given and small: it goes to the tasks whole, and one of over MOST_STEMS stems is refused.

Tokens are (form, tag, lemma): nouns NNG, verbs and adjectives VV with 다 behind the stem as lemma, particles JX, verb endings EF;
Latin runs, digits and the rest are as in analysis.tokens. It is an approximation: tags are no finer, compounds stay whole, and
irregular verbs have as many stems as forms.

Defined cases: a null text has no tokens; words of over LONGEST syllables stay whole; an empty corpus has an empty lexicon.
"""

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from textloom.functions.batches import released, small_batches
from textloom.operators.analysis import RUNS, TERM_LENGTH, WORD_RUNS
from textloom.session import stored

# Particles (none is one), and endings of verbs and adjectives, some of which begin with a final consonant.
PARTICLES = (
    "", "은", "는", "이", "가", "을", "를", "의", "에", "에는", "에도", "에서", "에서는", "에서도", "에게", "에게는", "으로", "으로는", "으로도", "로", "로는", "로도", "와", "와의", "과", "과의", "도", "만", "만은", "부터", "까지", "까지는",
    "보다", "처럼", "마다", "나", "이나", "란", "이란", "라", "이라", "라는", "이라는", "라고", "이라고", "께", "께서", "한테", "밖에", "조차", "들", "들은", "들이", "들을", "들의", "들에게", "이다", "입니다", "였다", "이었다",
)
ENDINGS = (
    "다", "는다", "ᆫ다", "고", "는", "ᆫ", "은", "ᆯ", "을", "며", "으며", "면", "으면", "지", "지만", "기", "기를", "게", "는데", "ᆫ데", "던", "도록", "려고", "으려고", "려면", "자", "네", "요", "세요", "으세요", "니", "으니", "니까", "으니까",
    "므로", "으므로", "거나", "아", "아서", "어", "어서", "았다", "았고", "았지만", "았습니다", "었다", "었고", "었지만", "었습니다", "ᆻ다", "ᆻ고", "ᆻ으며", "ᆻ는데", "ᆻ던", "ᆻ지만", "ᆻ습니다", "ᆸ니다", "습니다",
)
#: Final consonants that endings begin with, and their places among a syllable's finals; vowels that a past tense opens, by their places.
FINALS = {"ᆫ": 4, "ᆯ": 8, "ᆸ": 17, "ᆻ": 20}
OPENED = {1: 0, 6: 20, 9: 8, 10: 11, 14: 13}
FIRST, SYLLABLES_OF_A_VOWEL, VOWELS, LEADS = 0xAC00, 28, 21, 19
LONGEST, LONGEST_ENDING = 20, 4
MOST_STEMS, LEAST_VARIETY = 100_000, 2
#: A term has few words, as endings are a closed class.
MOST_TERMS = 50_000
NOUN, VERB = "n", "v"
TERMS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("count", T.IntegerType())]))
READ = T.StructType([T.StructField("terms", TERMS), T.StructField("rest", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("count", T.IntegerType())])))])
TOKEN = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("form", "tag", "lemma")]))


PARTICLE_SET, ENDING_SET = frozenset(PARTICLES), frozenset(ENDINGS)
#: What is an ending as it stands is not cut within its first syllable: 은 is no 으 and ᆫ.
WHOLE_SET = PARTICLE_SET | ENDING_SET


def opened(final: str) -> tuple[str, str]:
    """All syllables with this final, and those that they are of a stem before an ending that begins with it."""
    given, stems = [], []
    for lead in range(LEADS):
        for vowel in range(VOWELS):
            at = FIRST + (lead * VOWELS + vowel) * SYLLABLES_OF_A_VOWEL
            own = OPENED.get(vowel, vowel) if final == "ᆻ" else vowel
            given.append(chr(at + FINALS[final]))
            stems.append(chr(FIRST + (lead * VOWELS + own) * SYLLABLES_OF_A_VOWEL))
    return "".join(given), "".join(stems)


OPEN = {final: opened(final) for final in FINALS}
OPEN_OF = {final: dict(zip(*pair, strict=True)) for final, pair in OPEN.items()}


def ways(word: str) -> Iterator[tuple[str, str, str]]:
    """kind, stem, ending of each way to split a word."""
    for i in range(max(1, len(word) - LONGEST_ENDING), len(word) + 1):
        stem, rest = word[:i], word[i:]
        if rest in PARTICLE_SET:
            yield NOUN, stem, rest
        if rest in ENDING_SET:
            yield VERB, stem, rest
        for final, open_of in OPEN_OF.items():
            if stem[-1] in open_of and final + rest in ENDING_SET and stem[-1] + rest not in WHOLE_SET:
                yield VERB, stem[:-1] + open_of[stem[-1]], final + rest


def word_counts(df: DataFrame, text: Column) -> DataFrame:
    """word, n: the distinct Hangul words of up to LONGEST syllables."""
    words = df.select(F.explode_outer(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[가-힣]+"), F.lit(0))).alias("word")).where("word is not null")
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.length("word") <= LONGEST)


def word_ways(words: DataFrame) -> DataFrame:
    """word, n, kind, stem, ending, plain: each way to split a word, as `ways` has them; plain: cut between syllables. words: word, n."""
    size = F.length("word")
    at = words.select("word", "n", F.explode(F.sequence(F.greatest(F.lit(1), size - LONGEST_ENDING), size)).alias("_at"))
    cuts = at.select("word", "n", F.expr("left(word, _at)").alias("stem"), F.expr(f"substring(word, _at + 1, {LONGEST_ENDING})").alias("ending"))
    stem, ending, last = F.col("stem"), F.col("ending"), F.right("stem", F.lit(1))
    given, stems = ("".join(x) for x in zip(*OPEN.values(), strict=True))
    place = (F.ascii(last) - FIRST) % SYLLABLES_OF_A_VOWEL
    final = F.coalesce(*[F.when(place == at, f) for f, at in FINALS.items()])
    within = F.concat(final, ending)
    way = lambda when, kind, of, end, plain: F.when(when, F.struct(F.lit(kind).alias("kind"), of.alias("stem"), end.alias("ending"), F.lit(plain).alias("plain")))
    found = F.array(
        way(ending.isin(*PARTICLES), NOUN, stem, ending, True),
        way(ending.isin(*ENDINGS), VERB, stem, ending, True),
        way(within.isin(*ENDINGS) & ~F.concat(last, ending).isin(*sorted(WHOLE_SET)), VERB, F.concat(F.expr("left(stem, length(stem) - 1)"), F.translate(last, given, stems)), within, False),
    )
    # Outer, as for a plain one Spark would add a filter on the array, which computes it twice.
    return cuts.select("word", "n", F.explode_outer(found).alias("w")).where("w is not null").select("word", "n", "w.*")


def stem_statistics(words: DataFrame) -> DataFrame:
    """kind, stem, variety, n: of each stem in any way to split a word how many endings follow it, and how many words are split so. words: word, n."""
    counted = word_ways(words).where((F.col("kind") == NOUN) | ~F.col("ending").isin(*PARTICLES))
    return counted.groupBy("kind", "stem", "ending").agg(F.sum("n").alias("n")).groupBy("kind", "stem").agg(F.count("*").alias("variety"), F.sum("n").alias("n"))


def lexicon(statistics: DataFrame, most: int | None = None) -> DataFrame:
    """kind, stem, variety: every stem with LEAST_VARIETY endings, or the `most` of the largest variety (ties: more occurrences, then the alphabet)."""
    found = statistics.where(F.col("variety") >= LEAST_VARIETY)
    return (found if most is None else found.orderBy(F.desc("variety"), F.desc("n"), "stem", "kind").limit(most)).select("kind", "stem", "variety")


def words_read(words: DataFrame, stems: DataFrame) -> DataFrame:
    """word, n, term, pos: each word by its best way, as `analysed` has it. words: word, n; stems: what lexicon gives, of any size."""
    place = F.struct((F.log1p("variety") + F.length("stem")).alias("sum"), (F.col("kind") == NOUN).alias("noun"), F.length("stem").alias("length"), "plain", "kind", "stem")
    ranked = word_ways(words).join(stems, ["kind", "stem"], "left").select("word", "n", F.when(F.col("variety").isNotNull(), place).alias("way"))
    best = ranked.groupBy("word").agg(F.max("n").alias("n"), F.max("way").alias("w"))
    verb = F.coalesce(F.col("w.kind") == VERB, F.lit(False))
    term = F.when(verb, F.concat("w.stem", F.lit("다"))).otherwise(F.coalesce("w.stem", "word"))
    return best.select("word", "n", term.alias("term"), F.when(verb, "VV").otherwise("NNG").alias("pos"))


def analysed(word: str, varieties: dict[tuple[str, str], int]) -> list[tuple[str, str, str]]:
    """The tokens of a word's best way."""
    best = None
    for kind, stem, ending in ways(word) if len(word) <= LONGEST else ():
        variety = varieties.get((kind, stem))
        if variety:
            place = math.log(1 + variety) + len(stem), kind == NOUN, len(stem)
            if best is None or place > best[0]:
                best = place, kind, stem, ending
    if best is None:
        return [(word, "NNG", word)]
    _, kind, stem, ending = best
    own = (stem, "NNG", stem) if kind == NOUN else (stem, "VV", stem + "다")
    return [own, *([(ending, "JX" if kind == NOUN else "EF", ending)] if ending else [])]


def sent_lexicon(spark: SparkSession, stems: DataFrame) -> Broadcast:
    small_batches(spark)
    found = stems.limit(MOST_STEMS + 1).collect()
    if len(found) > MOST_STEMS:
        raise ValueError(f"over {MOST_STEMS} stems: document_terms reads by a lexicon of any size")
    return spark.sparkContext.broadcast({(r["kind"], r["stem"]): r["variety"] for r in found})


def with_tokens(df: DataFrame, text_col: str, stems: DataFrame, as_col: str = "tokens") -> DataFrame:
    """df with an array of (form, tag, lemma) for each text. stems: what lexicon gives. A text's runs go to Python and come back as tokens, in time in proportion to them."""
    sent = sent_lexicon(df.sparkSession, stems)

    @pandas_udf(TOKEN)
    def of_runs(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, known = sent.value, {}

        def read(run: str) -> list[tuple[str, str, str]]:
            if run not in known:
                if len(known) > MOST_STEMS:
                    known.clear()
                known[run] = analysed(run, own) if "가" <= run[0] <= "힣" else [(run, "SN" if "0" <= run[0] <= "9" else "SL", run)]
            return known[run]

        for rows in parts:
            yield pd.Series([[token for run in runs for token in read(run)] for runs in rows])
            released()

    runs = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(RUNS), F.lit(0))
    return df.withColumn(as_col, of_runs(runs))


def with_terms(df: DataFrame, text_col: str, stems: DataFrame, as_col: str = "terms") -> DataFrame:
    """df with an array of (term, pos, count) for each text: what analysis.counted_terms makes of with_tokens, counted where words are read, so that no token leaves Python."""
    sent = sent_lexicon(df.sparkSession, stems)

    @pandas_udf(TERMS)
    def of_runs(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, known = sent.value, {}

        def read(run: str) -> tuple[str, str]:
            if run not in known:
                if len(known) > MOST_STEMS:
                    known.clear()
                # A word's first token is its only content word.
                form, tag, lemma = analysed(run, own)[0] if "가" <= run[0] <= "힣" else (run, "SL", run)
                known[run] = (lemma if tag == "VV" else form)[:TERM_LENGTH], tag
            return known[run]

        for rows in parts:
            yield pd.Series([[(*term, n) for term, n in sorted(Counter(map(read, runs)).items())] for runs in rows])
            released()

    # Numbers are no terms.
    runs = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(WORD_RUNS), F.lit(0))
    return df.withColumn(as_col, of_runs(runs))


def lists(rows: list[tuple], ends: list[int], field: T.StructField) -> pa.Array:
    """An array of lists of structs as the field has them, from the rows of all lists, one after another, and where each list ends."""
    own = field.dataType.elementType
    columns = [pa.array([r[i] for r in rows], pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string()) for i, f in enumerate(own)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [f.name for f in own]))


def document_terms(df: DataFrame, id_col: str, text_col: str, most: int = MOST_TERMS) -> DataFrame:
    """id, terms: for each row an array of (term, pos, count) in order, read by the lexicon of all of df's texts, of any size.

    The words of the `most` most frequent terms are counted where they are read. All words of a term are among them or none is, so
    the other words of a row, which are joined, have other terms. What df's texts are read for is stored: word counts, ways, and the rows if there are such words.
    """
    spark = df.sparkSession
    small_batches(spark)
    words = stored(word_counts(df, F.col(text_col)), "words")
    read = stored(words_read(words, lexicon(stem_statistics(words))), "words-read")
    first = read.groupBy("term", "pos").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term", "pos").limit(most).select("term", "pos")
    # As pairs of Python's own types; a term's words share one.
    terms: dict[tuple[str, str], tuple[str, str]] = {}
    near = {r["word"]: terms.setdefault((r["term"], r["pos"]), (r["term"], r["pos"])) for r in read.join(F.broadcast(first), ["term", "pos"], "left_semi").collect()}
    sent, all_near = spark.sparkContext.broadcast(near), len(near) == read.count()

    @arrow_udf(READ)
    def of_runs(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = sent.value
        for rows in parts:
            found, others, ends, rest_ends = [], [], [0], [0]
            for runs in rows.to_pylist():
                counts = Counter()
                for run, n in Counter(runs.split()).items():
                    hangul = "가" <= run[0] <= "힣"
                    term = known.get(run) if hangul else (run[:TERM_LENGTH], "SL")
                    if term is None and len(run) <= LONGEST:
                        others.append((run, n))
                    else:
                        counts[term or (run[:TERM_LENGTH], "NNG")] += n
                found += [(*term, n) for term, n in sorted(counts.items())]
                ends.append(len(found))
                rest_ends.append(len(others))
            # Column by column: rows of structs would be converted one by one.
            yield pa.StructArray.from_arrays([lists(found, ends, READ["terms"]), lists(others, rest_ends, READ["rest"])], [f.name for f in READ])
            released()

    # Numbers are no terms. A text's runs go as one string: they hold no white space.
    runs = F.array_join(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(WORD_RUNS), F.lit(0)), " ")
    rows = df.select(F.col(id_col), of_runs(runs).alias("_read"))
    if all_near:
        return rows.select(id_col, "_read.terms")
    rows = stored(rows.select(id_col, "_read.*", F.monotonically_increasing_id().alias("_row")), "document-terms")
    rest = rows.select("_row", F.explode("rest").alias("w")).select("_row", "w.*").join(read.select("word", "term", "pos"), "word").groupBy("_row", "term", "pos").agg(F.sum("count").cast("int").alias("count"))
    others = rest.groupBy("_row").agg(F.collect_list(F.struct("term", "pos", "count")).alias("_others"))
    both = F.when(F.col("_others").isNull(), F.col("terms")).otherwise(F.sort_array(F.concat("terms", "_others")))
    return rows.drop("rest").join(others, "_row", "left").select(id_col, both.alias("terms"))
