"""Named queries on words of Hangul, and DuckDB SQL for the same results.

The fixtures are in Latin script, so each letter is written as a syllable: some are particles, endings, or hold an ending's first
letter as their final consonant, so that words come apart in all the ways that the library knows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import analysis, insights, morphology
from textloom.plans.catalog import query, table

# The letters and their syllables.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SYLLABLES = "하버추도는포고호이지코날면한왔표규를에다우벼와했요갑"


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and its whole text in Hangul."""
    text = F.translate(F.coalesce("text", F.lit("")), LETTERS + LETTERS.upper(), SYLLABLES * 2)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def _among(endings) -> str:
    return ", ".join(f"'{e}'" for e in endings)


_PARTICLES, _ENDINGS = _among(morphology.PARTICLES), _among(morphology.ENDINGS)
_FINAL = "(unicode(right(stem, 1)) - 44032) % 28"
_VOWEL = "(unicode(right(stem, 1)) - 44032) // 28 % 21"

#: w: distinct words; p: cut between syllables; y: all ways; s: statistics.
WAYS = f"""
    h as (select doc_id, translate(coalesce(text, ''), '{LETTERS + LETTERS.upper()}', '{SYLLABLES * 2}') as text from documents),
    t as (select doc_id, unnest(regexp_extract_all(text, '[가-힣]+|\\p{{Latin}}+')) as word from h),
    w as (select word, count(*) as n from t where word >= '가' and word <= '힣힣' and length(word) <= 20 group by word),
    p as (select word, n, word[1:i] as stem, word[i + 1:] as ending from (select word, n, unnest(range(greatest(1, length(word) - 4), length(word) + 1)) as i from w)),
    y as (
        select word, n, 'n' as kind, stem, ending, true as counts from p where ending in ({_PARTICLES})
        union all select word, n, 'v', stem, ending, ending not in ({_PARTICLES}) from p where ending in ({_ENDINGS})
        union all
        select word, n, 'v', stem[1:length(stem) - 1] || chr((unicode(right(stem, 1)) - {_FINAL}
                 + case when {_FINAL} = 20 then 28 * case {_VOWEL} when 1 then -1 when 6 then 14 when 9 then -1 when 10 then 1 when 14 then -1 else 0 end else 0 end)::int), chr((4519 + {_FINAL})::int) || ending, true
        from p where {_FINAL} in (4, 8, 17, 20) and chr((4519 + {_FINAL})::int) || ending in ({_ENDINGS}) and right(stem, 1) || ending not in ({_PARTICLES}, {_ENDINGS})),
    s as (select kind, stem, count(distinct ending) as variety, sum(n)::bigint as n from y where counts group by all)"""
#: A lexicon that korean_stems names and does not read; that query's SQL stands as it was.
UNREAD = """
    lx as (select kind, stem, variety from s where variety >= 2 order by variety desc, n desc, stem, kind limit 100000)"""


@query(f"with {WAYS},{UNREAD} select kind, stem, variety, n from s")
def korean_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many endings follow each stem, over all words of all documents."""
    return morphology.stem_statistics(morphology.word_counts(spelled(spark, sf_dir), F.col("text")))


def korean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.document_terms(spelled(spark, sf_dir), "doc_id", "text")


#: lx: the lexicon; b: each word's best way.
TERMS = f"""{WAYS},
    lx as (select kind, stem, variety from s where variety >= 2),
    b as (select y.word, y.kind, y.stem from y join lx on lx.kind = y.kind and lx.stem = y.stem
          qualify row_number() over (partition by word order by ln(1 + variety) + length(y.stem) desc, y.kind, length(y.stem) desc) = 1),
    tc as (
        select doc_id, case when kind = 'v' then stem || '다' else coalesce(stem, t.word) end[1:100] as term,
               case when kind = 'v' then 'VV' when regexp_matches(t.word, '^[가-힣]') then 'NNG' else 'SL' end as pos, count(*)::int as count
        from t left join b on b.word = t.word group by all)"""


@query(f"with {TERMS} select doc_id, term, pos, count from tc")
def korean_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content words of each document, forms of one stem as one term."""
    return analysis.term_counts(korean_counts(spark, sf_dir), "doc_id", "text", terms_col="terms")


@query(f"""with {TERMS}, k as (select *, round_even(count * 100.0::double / sum(count) over (partition by doc_id), 1) as share from tc where pos <> 'SL'),
    g as (select term as word, count(distinct doc_id) as docs, round_even(avg(share), 2) as mean_share from k group by term)
    select *, case when mean_share >= 5 then 'center' else 'background' end as kind from g order by docs desc, word limit 8""")
def korean_core_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core words of nouns, verbs and adjectives, as the default settings have them."""
    words = analysis.document_words(korean_counts(spark, sf_dir), "doc_id", "text", analysis.Settings(), terms_col="terms", firsts=True)
    return insights.core_words(words, "doc_id", first=F.col("first"))
