"""Documents that hold passages of benchmark items, found by winnowing, with DataFrame functions only.

The hash of the least k-gram in each sliding window of k-grams is kept, for documents and for items. Two texts that share a
span of WINDOW words share the windows in it, so they share the kept hash, at the same place: no such span is missed.
Documents whose hashes meet an item's are extended: the word windows around each hit are compared word by word with the
items' windows. Items of fewer than WINDOW words are one window each; their lengths (at most WINDOW - 1 different ones) are
looked up with k-grams of that length.

Texts are split once for their hashes and word counts, of which a stored table of narrow rows keeps the counts and those
hashes that an item has too. Only texts with such a hash are read again (a filter of fixed size keeps the others out before
anything is shuffled), and only their places and windows are joined. Item hashes are sent to all workers only where their
measured number is at most BROADCAST_ROWS; else both sides are shuffled by hash, and Spark splits the parts of frequent ones.

Defined cases: a null text has no words; a null id stays null and its rows are told apart by their texts; rows that share an
id and a text are counted the same; an item without words occurs nowhere; an empty table on either side gives no hits; other
columns are not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import by_name, marked, stored

WINDOW = 10
GRAM = 5
BROADCAST_ROWS = 100_000
#: What stands between words: ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z in lower case, split; no words for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def gram_hashes(words: Column, k: int) -> Column:
    """The 64-bit hash of each run of k words."""
    runs = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(runs, lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(k)]))


def winnowed(hashes: Column, width: int) -> Column:
    """The distinct least hashes of all runs of `width` hashes."""
    if width == 1:
        return F.array_distinct(hashes)
    runs = F.when(F.size(hashes) >= width, F.sequence(F.lit(1), F.size(hashes) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(runs, lambda i: F.least(*[F.element_at(hashes, i + j) for j in range(width)])))


def gram_of(length: int, window: int, gram: int) -> int:
    """A short item's only gram is the item; of a full window, the least gram is kept."""
    return gram if length == window and window > gram else length


def fingerprints(rows: DataFrame, lengths: list[int], window: int, gram: int, keep: list[str]) -> DataFrame:
    """keep, length, hash: a row for each kept hash of the column words and each length of windows, and one with length 0 for the row itself.

    Each step is a projection of its own: what a lambda reads is then computed once.
    """
    ks = sorted({gram_of(x, window, gram) for x in lengths})
    hashed = rows.select(*keep, *[gram_hashes(F.col("words"), k).alias(f"hashes_{k}") for k in ks])
    kept = hashed.select(*keep, *[winnowed(F.col(f"hashes_{gram_of(x, window, gram)}"), x - gram_of(x, window, gram) + 1).alias(f"kept_{x}") for x in lengths])
    entry = lambda length: lambda h: F.struct(F.lit(length).alias("length"), h.alias("hash"))
    # The row's own entry has a hash that spreads.
    parts = [F.array(entry(0)(F.xxhash64(*keep))), *[F.transform(f"kept_{x}", entry(x)) for x in lengths]]
    return kept.select(*keep, F.explode(F.concat(*parts)).alias("f")).select(*keep, "f.length", "f.hash")


def sent(small: DataFrame, rows: int) -> DataFrame:
    """Broadcast behind a check of its size."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def found_windows(texts: DataFrame, side: DataFrame, lengths: list[int], window: int, gram: int, rows: int) -> DataFrame:
    """id, tie, length, begin, run: the windows around all grams of the texts whose hash an item's windows kept. texts: id, tie, text."""
    split = texts.select("id", "tie", words(F.col("text")).alias("words"))
    places = None
    for k in sorted({gram_of(x, window, gram) for x in lengths}):
        # Outer, as for a plain one Spark would add a filter on the array below, which computes the words again for each gram.
        own = split.select("id", "tie", gram_hashes(F.col("words"), k).alias("hashes")).select("id", "tie", F.posexplode_outer("hashes").alias("pos", "hash"))
        some = own.join(sent(side.where(F.col("length").isin([x for x in lengths if gram_of(x, window, gram) == k])), rows), "hash")
        some = some.select("id", "tie", "length", F.lit(k).alias("k"), (F.col("pos") + 1).alias("place"))
        places = some if places is None else places.unionByName(some)
    gathered = places.groupBy("id", "tie").agg(F.collect_set(F.struct("length", "k", "place")).alias("places")).withColumnsRenamed({"id": "own_id", "tie": "own_tie"})
    both = split.join(gathered, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("tie") == F.col("own_tie")))
    last = lambda length: F.size("words") - (length - 1)
    begins = lambda p: F.when(last(p["length"]) >= 1, F.transform(F.sequence(F.greatest(F.lit(1), p["place"] - (p["length"] - p["k"])), F.least(p["place"], F.greatest(last(p["length"]), F.lit(1)))), lambda b: F.struct(p["length"].alias("length"), b.alias("begin"))))
    starts = both.select("id", "tie", "words", F.flatten(F.transform("places", lambda p: F.coalesce(begins(p), F.array().cast("array<struct<length:int,begin:int>>")))).alias("starts"))
    runs = starts.select("id", "tie", F.explode(F.transform("starts", lambda s: F.struct(s["length"].alias("length"), s["begin"].alias("begin"), F.array_join(F.slice("words", s["begin"], s["length"]), " ").alias("run")))).alias("s"))
    return runs.select("id", "tie", "s.length", "s.begin", "s.run").distinct()


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurring window), items (sorted ids as text), contaminated, and the columns to carry."""
    given = by_name(docs, id=id_col, text=text_col, **{f"carried_{i}": c for i, c in enumerate(carry)})
    key = [F.col("id"), F.xxhash64("text").alias("tie")]
    carried = [f"carried_{i}" for i in range(len(carry))]

    tests = by_name(items, item=item_id_col, text=item_text_col).select(F.col("item").cast("string").alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    # Each item's windows as (length, text of its words): the whole item if it is short.
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)))
    windows = tests.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("run"))
    windows = stored(windows.groupBy(F.size("run").alias("length"), F.array_join("run", " ").alias("run")).agg(F.array_sort(F.collect_set("item")).alias("items")), "windows")
    sizes = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lengths, n_windows = sorted(sizes), sum(sizes.values())

    split = given.select(*key, words(F.col("text")).alias("words")).select("id", "tie", "words", F.size("words").cast("long").alias("n_words"))
    own = fingerprints(split, lengths, window, gram, ["id", "tie", "n_words"])
    side = windows.limit(0).select("length", F.lit(0).cast("long").alias("hash"))
    for x in lengths:
        runs = windows.where(F.col("length") == x).select(F.lit(0).alias("none"), F.split("run", " ").alias("words"))
        side = side.unionByName(fingerprints(runs, [x], window, gram, ["none"]).where("length > 0").select("length", "hash"))
    side = stored(side.distinct().withColumn("wanted", F.lit(True)), "item-hashes")
    first = stored(own.join(sent(side, n_windows), ["length", "hash"], "left").where("length = 0 or wanted").drop("wanted"), "fingerprints")
    counted = first.where("length = 0").select("id", "tie", "n_words")

    hits = first.limit(0).select("id", "tie", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    if lengths:
        near = stored(first.where("length > 0").select("id", "tie").distinct(), "near")
        own_key = near.select(F.col("id").alias("near_id"), F.col("tie").alias("near_tie"))
        texts = marked(given.select(*key, "text"), near, ["id", "tie"]).where("marked").select("id", "tie", "text").dropDuplicates(["id", "tie"])
        texts = stored(texts.join(own_key, F.col("id").eqNullSafe(F.col("near_id")) & (F.col("tie") == F.col("near_tie")), "left_semi"), "near-texts")
        runs = found_windows(texts, side, lengths, window, gram, n_windows).join(sent(windows, n_windows), ["length", "run"])
        found = runs.groupBy("id", "tie").agg(F.collect_set(F.struct("begin", "length")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["begin"], s["begin"] + s["length"] - 1))))
        hits = found.select("id", "tie", F.size(covered).cast("long").alias("n_hit"), "items")
    hits = stored(hits, "hits")

    # Rows without hits stay where they are.
    every = given.select(*key, F.size(words(F.col("text"))).cast("long").alias("n_words"), *carried) if carry else counted
    told = marked(every, hits, ["id", "tie"], "may_hit")
    own_hits = hits.select(F.col("id").alias("hit_id"), F.col("tie").alias("hit_tie"), "n_hit", "items")
    some = told.where("may_hit").join(own_hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("tie") == F.col("hit_tie")), "left").select("id", "n_words", "n_hit", "items", *carried)
    out = some.unionByName(told.where("not may_hit").select("id", "n_words", *carried), allowMissingColumns=True)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"), *[F.col(x).alias(c) for x, c in zip(carried, carry, strict=True)])
