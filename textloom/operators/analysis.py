"""Text metrics, term counts and relevance verdicts."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import strip

NOUNS, VERBS, FOREIGN = ("NNG", "NNP"), ("VV", "VA"), ("SL",)
TERMS = NOUNS + VERBS + FOREIGN
#: Marks are no tokens, but these kinds of S tags are.
KEPT_SYMBOLS = ("SL", "SH", "SN")
POS_RANGES = {"noun": NOUNS, "vva": NOUNS + VERBS, "foreign": TERMS}
PASSING_MOST = 2


@dataclass(frozen=True)
class Settings:
    """What is stored are numbers; verdicts and top words follow from them and these settings. The defaults."""

    version: int = 1
    top_n: int = 15
    ttr_warn: float = 0.35
    min_body: int | None = None
    denom: str = "content"
    pos_range: str = "vva"
    density_warn: float = 8
    warn_min_count: int = 3
    warn_min_nouns: int = 50
    min_mentions: int = 4
    dens_title: float = 1.5
    dens_no_title: float = 3.0
    dens_min_len: int = 600
    require_title: bool = False
    passing_mode: str = "dim"


#: Least and most that an administrator allows for a setting.
BOUNDS = {"top_n": (1, 100), "ttr_warn": (0, 1), "density_warn": (0, 100), "warn_min_count": (1, 1000), "warn_min_nouns": (0, 10_000), "min_mentions": (1, 100), "dens_title": (0, 100), "dens_no_title": (0, 100), "dens_min_len": (0, 100_000)}


def validated(settings: Settings, bounds: dict[str, tuple[float, float]] = BOUNDS) -> Settings:
    for name, (low, high) in bounds.items():
        if not low <= getattr(settings, name) <= high:
            raise ValueError(f"{name} must lie between {low} and {high}")
    if settings.denom not in ("noun", "content") or settings.pos_range not in POS_RANGES or settings.passing_mode not in ("hide", "dim", "show"):
        raise ValueError("unknown denom, pos_range or passing_mode")
    return settings


#: The built-in tokenizer: runs of Hangul as nouns, of Latin letters as foreign words, of digits as numbers; no lemmas. It stands
#: in for a morphological analyser, whose own function (text column to array of form, tag, lemma) can be given instead.
WORD_RUNS = r"[가-힣]+|\p{IsLatin}+"
RUNS = WORD_RUNS + r"|\d+"
TERM_LENGTH = 100


def tokens(text: Column) -> Column:
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUNS), F.lit(0))
    tag = lambda w: F.when(w.rlike("^[가-힣]"), "NNG").when(w.rlike(r"^\d"), "SN").otherwise("SL")
    return F.transform(runs, lambda w: F.struct(w.alias("form"), tag(w).alias("tag"), w.alias("lemma")))


def kept_tokens(found: Column) -> Column:
    return F.filter(found, lambda t: ~t["tag"].startswith("S") | t["tag"].isin(*KEPT_SYMBOLS))


def sentences(text: Column) -> Column:
    """Parts that end with a mark and white space, or a line."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")


def text_metrics(df: DataFrame, text_col: str, tokens_col: str | None = None) -> DataFrame:
    """tokens, unique_tokens, nouns, sentences, avg_sentence_len (1 place), ttr (3 places); all 0 without tokens."""
    found = df.withColumn("_tokens", kept_tokens(F.col(tokens_col) if tokens_col else tokens(F.col(text_col)))).withColumn("_sentences", sentences(F.col(text_col)))
    # As plain strings, of which distinct ones are found by hash: structs would be compared pair by pair.
    names = F.transform("_tokens", lambda t: F.concat(t["tag"], F.lit(" "), t["form"]))
    counted = found.withColumns({"_unique": F.size(F.array_distinct(names)), "_length": F.length(F.array_join("_sentences", ""))})
    n, some, parts = F.size("_tokens"), F.size("_tokens") > 0, F.size("_sentences")
    return counted.withColumns({
        "tokens": n,
        "unique_tokens": F.col("_unique"),
        "nouns": F.size(F.filter("_tokens", lambda t: t["tag"].isin(*NOUNS))),
        "sentences": F.when(some, parts).otherwise(0),
        "avg_sentence_len": F.when(some & (parts > 0), F.bround(F.col("_length") / parts, 1)).otherwise(0.0),
        "ttr": F.when(some, F.bround(F.col("_unique") / n, 3)).otherwise(0.0),
    }).drop("_tokens", "_sentences", "_unique", "_length")


#: Between a term and its part of speech where both are one string; tags do not hold it.
MARK = "\x00"


def counted_terms(df: DataFrame, id_col: str, text_col: str, tokens_col: str | None = None, terms_col: str | None = None) -> DataFrame:
    """id, terms: an array of (term, pos, count), counted within the row: no token becomes a row. terms_col: such an array, if there is one.

    Terms are sorted as plain strings, and the places where they change give their counts; only distinct ones become structs.
    """
    if terms_col:
        return df.select(id_col, F.col(terms_col).alias("terms"))
    if tokens_col:
        name = lambda t: F.concat(F.substring(F.coalesce(F.when(t["tag"].isin(*VERBS), t["lemma"]), t["form"]), 1, TERM_LENGTH), F.lit(MARK), t["tag"])
        names = F.transform(F.filter(F.col(tokens_col), lambda t: t["tag"].isin(*TERMS)), name)
        pos = lambda s: F.substring_index(s, MARK, -1)
        term = lambda s: F.left(s, F.length(s) - F.length(pos(s)) - 1)
    else:
        # Numbers are no terms, and the tag follows from the first letter.
        names = F.transform(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(WORD_RUNS), F.lit(0)), lambda w: F.substring(w, 1, TERM_LENGTH))
        pos = lambda s: F.when(s.rlike("^[가-힣]"), "NNG").otherwise("SL")
        term = lambda s: s
    in_order = df.select(F.col(id_col), F.sort_array(names).alias("_t"))
    first = F.filter(F.transform("_t", lambda t, i: F.when((i == 0) | (F.get("_t", i - 1) != t), i)), lambda i: i.isNotNull())
    changes = in_order.select(id_col, "_t", first.alias("_first"))
    row = lambda i, k: F.struct(term(F.get("_t", i)).alias("term"), pos(F.get("_t", i)).alias("pos"), (F.coalesce(F.get("_first", k + 1), F.size("_t")) - i).alias("count"))
    return changes.select(id_col, F.transform("_first", row).alias("terms"))


def term_counts(df: DataFrame, id_col: str, text_col: str, tokens_col: str | None = None, terms_col: str | None = None) -> DataFrame:
    """id, term (lemma of verbs, form of others; up to 100 characters), pos, count of content words. df: a row for each id."""
    # Outer, as for a plain one Spark would add a filter on the array below, which computes it again for each of its elements.
    return counted_terms(df, id_col, text_col, tokens_col, terms_col).select(id_col, F.explode_outer("terms").alias("t")).where("t is not null").select(id_col, "t.*")


def document_words(df: DataFrame, id_col: str, text_col: str, settings: Settings | None = None, tokens_col: str | None = None, terms_col: str | None = None, stopwords: DataFrame | None = None, top: int | None = None, firsts: bool = False) -> DataFrame:
    """id, rank, term, pos, count, share: what term_shares gives for all words of each document (or the first `top`), with their places, without a shuffle.

    df: a row for each id. Words of the same count stand in the order of term and part of speech. Stop words (a short table with a
    column `word`, which goes to all tasks) leave both the words and the denominator. firsts: with a column `first`, true in one row of each term of a document.
    """
    settings = settings or Settings()
    allowed = POS_RANGES.get(settings.pos_range, POS_RANGES["vva"])
    counted = counted_terms(df, id_col, text_col, tokens_col, terms_col)
    kept = F.filter("terms", lambda t: t["pos"].isin(*allowed))
    if stopwords is not None:
        counted = counted.crossJoin(F.broadcast(stopwords.agg(F.collect_set("word").alias("_stop"))))
        kept = F.filter("terms", lambda t: t["pos"].isin(*allowed) & ~F.array_contains("_stop", t["term"]))
    less = lambda t: F.struct((-t["count"]).alias("less"), t["term"].alias("term"), t["pos"].alias("pos"))
    if firsts:
        # Terms are in order, so one of several parts of speech stands next to itself.
        counted, kept = counted.select(id_col, kept.alias("_k")), F.col("_k")
        less = lambda t, i: F.struct((-t["count"]).alias("less"), t["term"].alias("term"), t["pos"].alias("pos"), ((i == 0) | (F.get("_k", i - 1)["term"] != t["term"])).alias("first"))
    ranked = counted.select(id_col, F.sort_array(F.transform(kept, less)).alias("_w"))
    for_total = NOUNS if settings.denom == "noun" else allowed
    total = F.aggregate(F.filter("_w", lambda w: w["pos"].isin(*for_total)), F.lit(0).cast("long"), lambda a, w: a - w["less"])
    share = lambda w, s: F.when(s["total"] > 0, F.bround(-w["less"] * 100 / s["total"], 1)).otherwise(0.0)
    first = lambda words: words if top is None else F.slice(words, 1, top)
    row = lambda s: F.transform(first(s["words"]), lambda w: F.struct(w["term"].alias("term"), w["pos"].alias("pos"), (-w["less"]).alias("count"), share(w, s).alias("share"), *([w["first"].alias("first")] if firsts else [])))
    # An array of one gives the total a name within the row: a column of its own would be computed for each word.
    words = ranked.select(id_col, F.transform(F.array(F.struct(total.alias("total"), F.col("_w").alias("words"))), row)[0].alias("_words"))
    each = words.select(id_col, F.posexplode_outer("_words").alias("_place", "w")).where("w is not null")
    return each.select(id_col, (F.col("_place") + 1).alias("rank"), "w.term", "w.pos", "w.count", "w.share", *(["w.first"] if firsts else []))


def term_shares(terms: DataFrame, id_col: str, settings: Settings = Settings(), stopwords: DataFrame | None = None) -> DataFrame:
    """id, term, pos, count, share (% of the denominator, 1 place): all words of each document.

    Stop words (a column `word`) leave both the words and the denominator.
    """
    allowed = POS_RANGES.get(settings.pos_range, POS_RANGES["vva"])
    kept = terms.where(F.col("pos").isin(*allowed))
    if stopwords is not None:
        kept = kept.join(stopwords.select(F.col("word").alias("term")), "term", "left_anti")
    counted = F.when(F.col("pos").isin(*(NOUNS if settings.denom == "noun" else allowed)), F.col("count")).otherwise(0)
    total = F.sum(counted).over(Window.partitionBy(id_col))
    share = F.when(total > 0, F.bround(F.col("count") * 100 / total, 1)).otherwise(0.0)
    return kept.withColumn("share", share).select(id_col, "term", "pos", "count", "share")


def top_words(terms: DataFrame, id_col: str, settings: Settings = Settings(), stopwords: DataFrame | None = None) -> DataFrame:
    """id, rank, term, pos, count, share: the most frequent words of each document, with their term_shares."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("count"), "term", "pos"))
    return term_shares(terms, id_col, settings, stopwords).withColumn("rank", rank).where(F.col("rank") <= settings.top_n).select(id_col, "rank", "term", "pos", "count", "share")


def judge(mentions: Column, density: Column, title_has: Column, length: Column, settings: Settings = Settings()) -> Column:
    """main: mentioned often, densely (or the body is short), in the title if that is asked for; passing: hardly mentioned."""
    dense = (length < settings.dens_min_len) | (density >= F.when(title_has, settings.dens_title).otherwise(settings.dens_no_title))
    main = (mentions >= settings.min_mentions) & dense & (title_has | F.lit(not settings.require_title))
    return F.when(mentions <= PASSING_MOST, "passing").when(main, "main").otherwise("partial")


def strength(relevance: Column) -> Column:
    return F.when(relevance == "main", 0).when(relevance == "partial", 1).when(relevance == "passing", 2)


def best_relevance(df: DataFrame, id_col: str, relevance_col: str = "relevance") -> DataFrame:
    """The strongest verdict of each document; null if it has none."""
    least = F.min(strength(F.col(relevance_col)))
    return df.groupBy(id_col).agg(F.when(least == 0, "main").when(least == 1, "partial").when(least == 2, "passing").alias("relevance"))


def warnings(metrics: DataFrame, words: DataFrame, id_col: str, settings: Settings = Settings()) -> DataFrame:
    """low_ttr, and the number of words that fill too much of a document that has enough nouns."""
    dense = words.where((F.col("share") >= settings.density_warn) & (F.col("count") >= settings.warn_min_count)).groupBy(id_col).agg(F.count("*").alias("n"))
    out = metrics.join(dense, id_col, "left")
    return out.withColumns({"low_ttr": (F.col("tokens") > 0) & (F.col("ttr") < settings.ttr_warn), "dense_words": F.when(F.col("nouns") >= settings.warn_min_nouns, F.coalesce("n", F.lit(0))).otherwise(0)}).drop("n")
