import random

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from tests.llm import brute

WORDS = [a + b for a in ("ta", "ri", "mo", "su") for b in ("n", "ka", "lo", "xi", "")]


def test_pipeline(spark, tmp_path):
    """The stages against plain Python, on documents with a shared line, copies, a leak and rejects."""
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    leak, line = text(14), "this very line stands in many documents"
    texts = [text(60) for _ in range(20)] + [f"{text(30)}\n{line}" for _ in range(4)]
    texts += [texts[0], texts[1] + " more", texts[2].upper(), text(20) + " " + leak + " " + text(9), None, "123 !", ""]
    docs = [(i, t, "xx" if i % 5 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_lines", F.lit(1)).withColumn("items", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b1", leak)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = [(i, t) for i, t, *_ in docs if t and any(c.isalpha() for c in t)]
    holders = max(i for i, t in kept if line in t)
    kept = [(i, t if i == holders else t.replace("\n" + line, "")) for i, t in kept]
    near = brute.near(kept)
    kept = [(i, t) for i, t in kept if near[i][2]]
    hits = brute.contamination(kept, [("b1", leak)])
    kept = [(i, t) for i, t in kept if not hits[i][1]]
    assert sorted(found) == [i for i, _ in kept]
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    assert all(found[i]["ids"] == library.encode(t) and found[i]["round_trip"] and found[i]["lang"] == "xx" for i, t in kept)


def test_stages_keep_columns(spark, tmp_path):
    rows = [(1, "some plain words are here today", "en", "s", 1), (1, "some plain words are here today", "en", "s", 1), (None, "other words without any id at all", None, None, None), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({x: F.lit(None).cast("string") for x in ("n_lines", "n_words", "kept_key", "tie", "score", "id", "items")})
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns
            now = corpus_pipeline.stored(now, "t")
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == (2 if start is docs else 0)


def test_rows_with_one_id_or_none(spark, tmp_path):
    """Near copies go whatever their ids; what only shares an id stays."""
    rng = random.Random(3)
    text, other, third = (" ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(3))
    rows = [(1, text), (5, text), (5, other), (None, text + " more"), (None, text.upper()), (None, third), (None, third + " end"), (7, third), (5, other), (9, other + " x y")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()), key=str)
    assert len(found) == 3
    assert {(i, t[:20].lower()) for i, t in found} == {(None, text[:20]), (5, other[:20]), (None, third[:20])}
