import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from textloom.llm import common, decontamination, language_id, line_dedup, near_dedup, sentencepiece_codec, sharding, substring_dedup, token_counts, token_store, topk_search, vector_packs
from textloom.llm.common import scratch_path
from textloom.operators.components import components
from textloom.llm.fm_index import FmIndex
from textloom.llm.mph import PerfectHash
from textloom.llm.shingles import shingles_of, signature, signature_seeds

WORD_MODEL, PIECE_MODEL = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = [a + b for a in ("ta", "Ri", "mo", "su", "é") for b in ("n", "ka", "lo.", "xX", "")]


def text_of(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared lines and passages, short, empty, missing and long texts."""
    rng = random.Random(7)
    texts = [text_of(rng, rng.randint(0, 120)) for _ in range(40)]
    base, passage, line = text_of(rng, 200), text_of(rng, 70), "A line that many documents share."
    texts += [base] * 5
    for k in range(25):
        words = base.split(" ")
        for _ in range(k // 3):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 999)}"
        texts.append(" ".join(words))
    texts += [text_of(rng, 15) + " " + passage + " " + text_of(rng, 15) for _ in range(8)]
    texts += [text_of(rng, 12) + "\n" + line + ("  " if k % 2 else "") + "\n" + text_of(rng, 12) for k in range(6)]
    texts += ["", None, "   ", "\n\n", "one", "One", "two words", "two  WORDS", "x " * 30_000, "long" * 20_000, "<|endoftext|> don't ÉTÉ 日本語 a▁b\x00", "\ttab\r\nline"]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    found = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes()).find(keys)
    assert sorted(found.tolist()) == list(range(len(keys)))
    assert PerfectHash.build(np.empty(0, np.uint64)).find(keys[:2]).tolist() == [-1, -1]


def test_token_store(spark, docs, corpus):
    path = scratch_path(spark, "t")
    token_store.write_store(docs, path, WORD_MODEL, 1, block_bytes=4000)
    store = token_store.read_store(spark, path)
    found = by_id(token_store.scan(store, token_store.crc32_of_ids, "ids_crc32 long", token_store.CRC32), "start", "n_tokens", "ids_crc32")
    library, start = Tokenizer.from_file(WORD_MODEL), 0
    for i, text in corpus:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert found[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = {r["doc_id"]: r["ids"] for r in token_store.look_up(store, [0, 9, 10, 123]).collect()}
    assert set(some) == {0, 9, 123}
    assert some[9] == [*library.encode(corpus[3][1], add_special_tokens=False).ids, 1]


def test_token_counts(docs, corpus):
    library = Tokenizer.from_file(WORD_MODEL)
    for words in (3, 50_000):
        found = by_id(token_counts.token_counts(docs, WORD_MODEL, 100, table_words=words), "n_bytes", "n_tokens", "over_limit")
        for i, text in corpus:
            n = len(library.encode(text or "", add_special_tokens=False).ids)
            assert found[i] == (len((text or "").encode()), n, n > 100)


def test_near_duplicates(docs, corpus):
    found = by_id(near_dedup.near_duplicates(docs), "n_shingles", "component_id", "kept")
    assert found == brute.near(corpus)
    assert sum(not x[2] for x in found.values()) > 20


def test_near_duplicates_in_small_blocks(docs, corpus, monkeypatch):
    """Groups in many parts, a filter that keeps nothing out, every frequent key a hot one."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(common, "FILTER_WORDS", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 0)
    assert by_id(near_dedup.near_duplicates(docs), "n_shingles", "component_id", "kept") == brute.near(corpus)


def test_signatures_find_what_is_similar():
    rng, seeds = random.Random(3), signature_seeds(near_dedup.COMPONENTS)
    missed = 0
    for _ in range(200):
        both, own = [f"s{rng.random()}" for _ in range(300)], [f"o{rng.random()}" for _ in range(100)]
        a, b = (np.unique(np.array([hash(x) & (2**63 - 1) for x in w], np.uint64)) for w in (both + own[:50], both + own[50:]))
        x, y = signature(a, seeds), signature(b, seeds)
        chunks = (x != y)[: near_dedup.CHUNKS * near_dedup.CHUNK].reshape(near_dedup.CHUNKS, near_dedup.CHUNK).sum(1)
        missed += not ((chunks <= near_dedup.ERRORS).any() and (x == y).sum() >= near_dedup.NEAR)
    assert missed == 0
    assert len(shingles_of("a b c d e f a b c d e f")) == 6
    assert len(shingles_of("a b")) == 1


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(40, 41), (50, 50), (61, 60), (62, 60), (63, 62)]
    found = dict(components(spark.createDataFrame(links, "a int, b int")).collect())
    assert found == {i: 1 for i in range(1, 31)} | {40: 40, 41: 40} | {i: 60 for i in range(60, 64)}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_BYTES, -1])
def test_lines(docs, corpus, limit):
    kept = line_dedup.dedup_lines(docs, broadcast_bytes=limit)
    found = by_id(kept.withColumn("sha", F.sha2("text", 256)), "n_lines", "n_dropped", "sha")
    assert found == brute.lines(corpus)
    assert sum(x[1] for x in found.values()) >= 5


@pytest.mark.parametrize("options", [{}, {"hot_segments": 1, "shard_words": 200}])
def test_passages(docs, corpus, options):
    found = by_id(substring_dedup.repeated_words(docs, **options).withColumn("sha", F.sha2("kept", 256)), "n_words", "n_removed", "sha")
    assert found == brute.passages(corpus)
    assert sum(x[1] > 0 for x in found.values()) > 10


def test_passages_beyond_the_filter(docs, corpus, monkeypatch):
    """What is joined with a full filter and with hot keys alone is the same."""
    monkeypatch.setattr(common, "FILTER_WORDS", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 0)
    found = by_id(substring_dedup.repeated_words(docs, hot_segments=1).withColumn("sha", F.sha2("kept", 256)), "n_words", "n_removed", "sha")
    assert found == brute.passages(corpus)


def test_filter_and_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7, None if i % 5 == 0 else str(i % 11), i) for i in range(500)], "a int, b string, n int")
    keys = common.stored(rows.where("a = 3").select("a", "b").distinct(), "t")
    for words in (1, 1 << 20):
        monkeypatch.setattr(common, "FILTER_WORDS", words)
        flags = common.marked(rows, keys, ["a", "b"])
        assert flags.where("a = 3 and not marked").count() == 0
        assert flags.count() == 500
        assert (flags.where("a <> 3 and marked").count() > 0) == (words == 1)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    counts = common.stored(rows.where("a < 5").groupBy("a").count(), "t")
    hot = common.hot_keys(counts, ["a"], "count")
    assert hot.count() == 5
    monkeypatch.setattr(common, "MOST_HOT", 2)
    hot = common.hot_keys(counts, ["a"], "count")
    assert hot.count() == 2
    for how in ("inner", "left_semi"):
        assert sorted(common.joined(rows, counts, ["a"], hot, how).select("n").collect()) == sorted(rows.where("a < 5").select("n").collect())


def test_matching_statistics():
    rng = random.Random(5)
    texts = [np.array([rng.randint(1, 3) for _ in range(rng.randint(3, 40))]) for _ in range(15)]
    patterns = [np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 40))]) for _ in range(15)]
    least = np.array([rng.randint(0, 99) for _ in texts])
    for depth in (5, 8):
        for p, (lengths, values) in zip(patterns, FmIndex(texts, depth).statistics(patterns, least), strict=True):
            for i in range(len(p)):
                best, value = 0, np.iinfo(np.int64).max
                for n in range(1, min(depth, len(p) - i) + 1):
                    at = [v for v, t in zip(least, texts, strict=True) if any(t[q : q + n].tolist() == p[i : i + n].tolist() for q in range(len(t) - n + 1))]
                    if not at:
                        break
                    best, value = n, min(at) if n == depth else value
                assert (lengths[i], values[i]) == (best, value)


def test_contamination(spark, docs, corpus):
    words = corpus[30][1].split()
    items = [(1, " ".join(words[2:20])), ("x2", "Two words!"), (3, None), (4, "... -"), (5, corpus[41][1].upper()), (6, "日本語")]
    table = spark.createDataFrame([(str(i), t) for i, t in items], "item_id string, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.decontaminated(docs, table).collect()}
    assert found == brute.contamination(corpus, items)
    assert sum(x[1] > 0 for x in found.values()) >= 8


def test_contamination_beyond_broadcast(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    items = [("1", corpus[41][1])]
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.decontaminated(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert found == brute.contamination(corpus, items)


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(10)] + [(400, None), (401, [float("nan")] * 8), (402, [1.0, None]), (403, [float("inf")] * 8), (None, [1.0] * 8), (450, [0.0] * 8), (500, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").select("vec_id", vector_packs.whole_numbers(F.col("v"), 256).alias("vector"))
    good = {i: [int(np.floor(256 * x)) for x in v] + [0] * (8 - len(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for shard, block in ((8192, 512), (16, 3)):
        found = {}
        for r in topk_search.top_k(df.repartition(3), F.col("id") % 50 == 0, 5, shard_vectors=shard, query_block=block).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        want = {q: sorted(((i, sum(a * b for a, b in zip(good[q], v, strict=True))) for i, v in good.items() if i != q), key=lambda x: (-x[1], x[0]))[:5] for q in good if q % 50 == 0}
        assert found == want


def test_large_components(spark):
    """Products beyond 32 and 64 bits; scores that do not fit are compared as they are and given as the nearest number that fits."""
    rows = [(50, [1.0, 2.0]), (1, [1e8, 0.0]), (2, [5.0, 5.0]), (3, [1e30, 0.0]), (4, [1e31, -1.0]), (5, [-1e30, 0.0]), (6, [-1e31, 0.0]), (100, [3e15, 3e15]), (7, [0.0, float("nan")])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").select("vec_id", vector_packs.whole_numbers(F.col("v"), 256).alias("vector"))
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if all(np.isfinite(x) for x in v)}
    for shard in (2048, 2):
        found = {}
        for r in topk_search.top_k(df, F.col("id") % 50 == 0, 8, shard_vectors=shard).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        for q in (50, 100):
            want = sorted(((i, sum(a * b for a, b in zip(good[q], v, strict=True))) for i, v in good.items() if i != q), key=lambda x: (-x[1], x[0]))[:8]
            assert found[q] == [(i, min(max(x, -(2**63)), 2**63 - 1)) for i, x in want]


def test_other_tokenizer_files(spark, docs, corpus, tmp_path):
    """A file whose texts can't be taken apart at white space."""
    model = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(model)
    counts = by_id(token_counts.token_counts(docs, model, 100), "n_tokens")
    path = scratch_path(spark, "t")
    token_store.write_store(docs, path, model, 1)
    ids = {r["doc_id"]: r["ids"] for r in token_store.look_up(token_store.read_store(spark, path), [i for i, _ in corpus]).collect()}
    for i, text in corpus:
        own = library.encode(text or "", add_special_tokens=False).ids
        assert counts[i] == (len(own),)
        assert ids[i] == [*own, 1]


def test_absent_ids_are_not_found(spark, docs, corpus):
    path = scratch_path(spark, "t")
    token_store.write_store(docs, path, WORD_MODEL, 1)
    store = token_store.read_store(spark, path)
    absent = np.array([i for i in range(-200_000, 200_000) if i not in dict(corpus)])
    assert token_store.look_up(store, absent[199_950:200_050].tolist()).count() == 0
    for row in store.collect():
        block = token_store.Block(row.asDict())
        block.prints = token_store.prints_of(absent)[np.zeros(len(block.prints), int)]
        # Even with a fingerprint that fits.
        assert (block.find(absent[:1])[0] == -1).all()
        assert (token_store.Block(row.asDict()).find(absent)[0] == -1).all()


def test_pieces(docs, corpus):
    library = sentencepiece_codec.codec(PIECE_MODEL).other
    found = by_id(sentencepiece_codec.encoded(docs, PIECE_MODEL), "ids", "decoded", "round_trip")
    for i, text in corpus:
        ids = library.encode(text or "")
        assert found[i] == (ids, library.decode(ids), library.decode(ids) == (text or ""))
    assert sentencepiece_codec.encoded(docs, PIECE_MODEL).where("n_different > 0").count() == 0


def test_a_wrong_rebuild_is_told(corpus, monkeypatch):
    """Wrong merges show in n_different, and the ids stay right; a wrong decoder is refused."""
    with open(PIECE_MODEL, "rb") as f:
        data = f.read()
    right, joins = sentencepiece_codec.rebuilt, sentencepiece_codec.merges
    monkeypatch.setattr(sentencepiece_codec, "merges", lambda pieces: joins(pieces)[::-1])
    own = sentencepiece_codec.Codec(data)
    texts = [t for _, t in corpus if t][:30]
    ids, offsets, wrong = own.encode(texts)
    assert wrong.sum() > 0
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == own.other.encode(texts)
    monkeypatch.setattr(sentencepiece_codec, "rebuilt", lambda model: right(model._replace(pieces=[(p[::-1] if len(p) == 3 and p.isalpha() else p, s, k) for p, s, k in model.pieces])))
    with pytest.raises(ValueError, match="decoder differs"):
        sentencepiece_codec.Codec(data)


def piece(text, score, kind=1):
    import struct

    body = b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
    return b"\x0a" + bytes([len(body)]) + body


def test_chunks_in_groups_have_the_ids_of_each_alone():
    """Random letters, marks, line ends, bytes and control characters; an empty chunk and a very long one."""
    rng = random.Random(8)
    letters = "abcdeTHE.,\n\t\x00\x1féß日本語😀가<s>0'"
    chunks = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(3_000)} | {"", "<unk>", "</s>", "<0x41>", "x" * 20_000})
    rng.shuffle(chunks)
    own = sentencepiece_codec.codec(PIECE_MODEL)
    assert own.chunked and own.checked_chunks(chunks) == own.checked(chunks)


def test_a_group_that_differs_is_taken_apart():
    with open(PIECE_MODEL, "rb") as f:
        own = sentencepiece_codec.Codec(f.read())

    class Other:
        """Has another id for one chunk."""

        def __init__(self, library):
            self.library = library

        def encode(self, texts):
            return [[*x[:-1], 0] if "odd" in t else x for t, x in zip(texts, self.library.encode(texts), strict=True)]

    own.other = Other(own.other)
    chunks = [f"even{i}" for i in range(200)] + ["odd"]
    assert [c for c, (_, differs) in zip(chunks, own.checked_chunks(chunks), strict=True) if differs] == ["odd"]
    assert own.encode(["even1 odd even2 odd", "even3", ""])[2].tolist() == [2, 0, 0]


def test_unigram_model():
    """A model file made by hand: scores, byte fallback, blanks that are trimmed."""
    pieces = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3) + b"".join(piece(f"<0x{i:02X}>", -20.0, 6) for i in range(256))
    pieces += b"".join(piece(t, s) for t, s in (("▁", -3.0), ("a", -4.0), ("b", -4.5), ("ab", -5.0), ("▁a", -4.2), ("▁ab", -6.0), ("ba", -5.5), ("c", -7.0)))
    trainer = b"\x18\x01" + b"\x98\x02\x01"  # unigram, byte fallback
    normaliser = b"\x0a\x08identity" + b"\x18\x01\x20\x01\x28\x01"
    data = pieces + b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(normaliser)]) + normaliser
    own = sentencepiece_codec.Codec(data)
    texts = ["ab ba", "aab  bab", " cab é", "", "abababab", "日"]
    ids, offsets, wrong = own.encode(texts)
    assert wrong.tolist() == [0] * len(texts)
    for text, a, b in zip(texts, offsets, offsets[1:], strict=False):
        assert ids[a:b].tolist() == own.other.encode(text)
        assert own.decode(ids[a:b]) == own.other.decode(own.other.encode(text))


def test_language(spark):
    rng = random.Random(4)
    sounds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["esch", "ung", "ver", "ein"], "cc": ["eau", "oi", "re", "que"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[lang], k=rng.randint(1, 3))) for _ in range(30)), lang) for i, lang in enumerate(rng.choices(list(sounds), k=300))]
    rows += [(900, None, "aa"), (901, "12 -", "aa"), (902, "kalo mitu", None), (None, "verein", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held_out = language_id.fold_of(F.col("id")) == 2
    found = {r["id"]: (r["lang_pred"], r["score"]) for r in language_id.language_of(df, ~held_out).collect()}
    assert all(found[i][0] == lang and 0 <= found[i][1] <= 1 for i, _, lang in rows[:300])
    assert found[900] == found[901] == ("und", 0.0)
    assert found[902][0] == "aa"
    assert found[None][0] == "bb"
    alone = language_id.language_of(df.where("lang = 'aa' or lang is null"), F.lit(True)).collect()
    assert {r["lang_pred"] for r in alone} == {"aa", "und"}
    assert {r["lang_pred"] for r in language_id.language_of(df, F.lit(False)).collect()} == {"und"}


def test_more_languages_than_a_group(spark, monkeypatch):
    """Every label is learned, and groups of languages give what one model gives."""
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 280)]
    words = {f"l{k:02}": [x + y for x in letters[4 * k : 4 * k + 4] for y in letters[4 * k : 4 * k + 4]] for k in range(70)}
    rng = random.Random(6)
    rows = [(3 * k + i, " ".join(rng.choices(own, k=20)), lang) for k, (lang, own) in enumerate(words.items()) for i in range(3)] + [(900, None, "l00"), (None, "12", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    result = lambda: {r["id"]: (r["lang_pred"], round(r["score"], 9), round(r["entropy"], 9), r["text"]) for r in language_id.language_of(df, F.lit(True), carry=("text",)).collect()}
    found = result()
    assert all(found[i][0] == lang for i, _, lang in rows[:210])
    assert found[900][:3] == found[None][:3] == ("und", 0.0, 0.0)
    monkeypatch.setattr(language_id, "GROUP_LANGUAGES", 1000)
    assert result() == found


def test_languages_by_brute_force(spark):
    """Prediction, score and entropy against a parse by plain search, with phrases over word ends and stretches."""
    rng = random.Random(9)
    words = {"aa": ["kalo", "mitu", "loka"], "bb": ["esch", "ungver", "ein"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(1, 90))).capitalize() + rng.choice(["", ". 3", "\n"]), lang) for i, lang in enumerate(rng.choices(["aa", "bb"], k=40))]
    rows += [(50, "Kalo-mitu, ein ungver!", "aa"), (51, "ωω kalo", "bb"), (52, "x" * 600, None), (53, "kalo", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = lambda t: " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
    found = {r["id"]: (r["lang_pred"], r["score"], r["entropy"]) for r in language_id.language_of(df, F.lit(True)).collect()}
    hashes = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64(F.col("doc_id"), "text").alias("h")).collect()}
    model = {}
    for lang in words:
        some = sorted((hashes[i], i) for i, t, own_lang in rows if own_lang == lang)[: language_id.SAMPLE_DOCS]
        model[lang] = " " + "".join(own(dict((r[0], r[1]) for r in rows)[i])[1:] for _, i in some)

    def phrases(text, known):
        n = 0
        for start in range(0, len(text), language_id.STRETCH):
            rest = text[start : start + language_id.STRETCH]
            while rest:
                size = max([k for k in range(1, len(rest) + 1) if rest[:k] in known], default=1)
                n, rest = n + 1, rest[size:]
        return n

    for i, text, _ in rows:
        letters = sum(c.isalpha() for c in text)
        largest = np.log2(max(map(len, model.values())) + 1)
        rates = {lang: (phrases(own(text), known) * largest + sum(c not in known for c in own(text)) * np.log2(0x110000)) / letters for lang, known in model.items()}
        best = min(sorted(rates), key=rates.get)
        assert found[i] == (best, pytest.approx(1 - rates[best] / max(rates.values())), pytest.approx(rates[best]))


def test_long_texts_are_learned_where_there_are_no_others(spark):
    rows = [(1, "ka lo mi " * 600, "aa"), (2, "ka lo mi " * 700, "aa"), (3, "esch ein", "bb"), (4, "mi lo", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["id"]: r["lang_pred"] for r in language_id.language_of(df, F.lit(True), long_text=100).collect()} == {1: "aa", 2: "aa", 3: "bb", 4: "aa"}


def test_small_models_take_nothing_from_large_ones(spark):
    """One short row of a further language changes no prediction of the others."""
    rng = random.Random(4)
    words = {"aa": ["kalo", "mitu", "loka", "ze"], "bb": ["esch", "ungver", "ein", "zu"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(2, 60))), lang) for i, lang in enumerate(rng.choices(["aa", "bb"], k=60))]
    want = {i: lang for i, _, lang in rows}
    for tiny in ("zzz", "esch ein", "ka mi"):
        df = spark.createDataFrame([*rows, (1000, tiny, "cc")], "doc_id long, text string, lang string")
        found = {r["id"]: r["lang_pred"] for r in language_id.language_of(df, F.col("id") % 2 == 0).collect()}
        assert {i: found[i] for i in want} == want


def test_equal_rows_are_learned(spark):
    """A label all of whose rows are one row, a thousand times over."""
    rows = [(None, "kalo mitu", "qq")] * 1000 + [(i, f"esch ungver {i}", "bb") for i in range(30)] + [(99, "mitu kalo", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.language_of(df, F.lit(True)).groupBy("id", "lang_pred").count().collect()
    assert {(r["lang_pred"], r["count"]) for r in found if r["id"] in (None, 99)} == {("qq", 1000), ("qq", 1)}


def test_the_stretch_decides_nothing(docs, spark):
    """Predictions with phrases of any length and with ends after 256 characters."""
    rng = random.Random(3)
    words = {"aa": ["kalo", "mitu", "loka", "ze"], "bb": ["esch", "ungver", "ein", "zu"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(100, 3000))), lang) for i, lang in enumerate(rng.choices(["aa", "bb"], k=30))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = [{r["id"]: r["lang_pred"] for r in language_id.language_of(df, F.col("id") < 12, stretch=n).collect()} for n in (1 << 20, 256)]
    assert found[0] == found[1] == {i: lang for i, _, lang in rows}


def test_automaton_knows_substrings():
    text, rng = "abracadabra abba ßa", random.Random(1)
    own = " " + text + " "
    known = {own[a:b] for a in range(len(own)) for b in range(a + 1, len(own) + 1)}
    model = language_id.Model(["x"], [language_id.Automaton.of(own)])

    def phrases(rest):
        n = 0
        while rest:
            size = max([k for k in range(1, len(rest) + 1) if rest[:k] in known], default=1)
            n, rest = n + 1, rest[size:]
        return n

    texts = [" abracadabra ", " cad xyz ", " dab ", "aaaa", " ßa ", " "] + ["".join(rng.choices("abcdrß ", k=rng.randint(1, 200))) for _ in range(200)]
    found, lacking = model.phrases(texts)
    assert found[:, 0].tolist() == [phrases(t) for t in texts]
    assert lacking[:, 0].tolist() == [sum(c not in own for c in t) for t in texts]


def test_sharding(docs, corpus):
    found = sharding.sharded(docs).collect()
    assert len(found) == len(corpus)
    slots = {}
    texts = dict(corpus)
    for r in sorted(found, key=lambda r: r["doc_id"]):
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, brute.crc(data), "key")
        assert (r["shard"], r["grown_shard"]) == (brute.jump(r["doc_id"], 8), brute.jump(r["doc_id"], 9))
        assert r["grown_shard"] in (r["shard"], 8)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(s == list(range(len(s))) for s in slots.values())


def nasty(spark, rows):
    """Nulls, repeated rows, a repeated id, and columns named like those that operators make."""
    names = ["id", "tie", "key", "cid", "sig", "n", "hash", "start", "spans", "at", "shard", "slot", "size", "words", "near", "items", "carried_0", "kept", "ids", "score", "of", "law", "rank"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({x: F.lit(None).cast("string") for x in names})


ROWS = [(1, "alpha beta gamma delta epsilon zeta", "en", "s", 3), (1, "alpha beta gamma delta epsilon zeta", "en", "s", 3), (1, "other words stand here now today", None, None, None), (None, None, None, None, None), (None, "text without an id at all today", "en", None, 1), (5, "", "de", "s", 0)]

OPERATORS = {
    "store": lambda spark, df: stored_rows(spark, df),
    "counts": lambda spark, df: token_counts.token_counts(df, WORD_MODEL, 5),
    "near": lambda spark, df: near_dedup.near_duplicates(df),
    "lines": lambda spark, df: line_dedup.dedup_lines(df, carry=("lang", "kept", "id")),
    "lines, sharded": lambda spark, df: line_dedup.dedup_lines(df, broadcast_bytes=-1),
    "passages": lambda spark, df: substring_dedup.repeated_words(df),
    "contamination": lambda spark, df: decontamination.decontaminated(df, spark.createDataFrame([("1", "beta gamma"), (None, "words stand")], "item_id string, text string"), carry=("text", "id")),
    "no items": lambda spark, df: decontamination.decontaminated(df, spark.createDataFrame([], "item_id string, text string")),
    "pieces": lambda spark, df: sentencepiece_codec.encoded(df, PIECE_MODEL, carry=("lang", "ids")),
    "language": lambda spark, df: language_id.language_of(df, F.lit(True), carry=("text", "id", "lang")),
    "shards": lambda spark, df: sharding.sharded(df),
}


def stored_rows(spark, df):
    path = scratch_path(spark, "t")
    token_store.write_store(df, path, WORD_MODEL, 1)
    return token_store.scan(token_store.read_store(spark, path), token_store.crc32_of_ids, "ids_crc32 long", token_store.CRC32)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    assert len(OPERATORS[name](spark, nasty(spark, ROWS)).collect()) == len(ROWS)
    assert OPERATORS[name](spark, nasty(spark, [])).collect() == []


def test_odd_vectors(spark):
    df = spark.createDataFrame([(50, [1, 2], 1), (50, [1, 2], 1), (1, [3, 4], None), (1, [3, 4], None), (None, [1, 1], 1), (2, None, 1)], "vec_id long, vector array<long>, id int")
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(df, F.col("id") % 50 == 0, 5).orderBy("rank").collect()]
    assert found == [(50, 1, 1, 11), (50, 2, 1, 11)]
    assert topk_search.top_k(df.limit(0), F.col("id") % 50 == 0, 5).collect() == []


def test_chunks_are_listed_without_arrow_objects():
    """Strings and numbers come as to_pylist gives them, and texts have the library's ids with chunks that repeat, differ in case or hold marks."""
    import pyarrow as pa

    from textloom.llm import pretokens

    for column in (pa.array(["", "a", "é😀", "x\x00y"], pa.large_string()), pa.array([3, 0, 3], pa.int32()), pa.array([], pa.large_string())):
        assert pretokens.listed(column) == column.to_pylist()
    own = pretokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Straße, straße; 12 a.b x\x00y", None, "", "don't <|endoftext|> Straße,"]
    found, offsets = own.encode(texts)
    for text, a, b in zip(texts, offsets, offsets[1:], strict=False):
        assert found[a:b].tolist() == own.library.encode(text or "", add_special_tokens=False).ids
