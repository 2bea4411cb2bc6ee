"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text: the whole texts of a bounded sample of rows, one after the other. A
document's text (runs of letters in lower case, a space between them) is parsed from left to right into the longest phrases
that occur in the automaton, across word ends, whole texts long. A phrase costs log2(N) bits, with N the characters of the
largest model: one price under all languages, else a tiny model's many short phrases would be the cheapest. A letter that the
model lacks is a phrase of its own and is spelled out as well, for LETTER_BITS more. The sum for each of n letters estimates the
cross entropy, and the language with the least wins (ties: the first in the alphabet).

So that many texts are parsed side by side, a phrase also ends at every `stretch` characters of a text (STRETCH, if not given).

Model bounds: SAMPLE_DOCS labelled rows for each language, taken by a hash of id and text among those of at most LONG_TEXT
characters, so a language's model does not grow with the corpus; of a language that has only longer texts, the shortest one.
Rows with the same id and text count as one. Every language with labelled text is learned, and all rows are scored under all of them: in groups of languages where the
automata outgrow one worker.

Defined cases: a null text and one without a letter are "und" with score 0, as are all where there is no labelled text; a
null id counts as an empty one; score is how much smaller the winner's entropy is than the next language's (1 if it is
alone); repeated rows are told alike; an empty table gives no rows; other columns are read only to be carried along.
"""

import math
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import by_name, scratch_path, stored, text_slices

SAMPLE_DOCS = 24
LONG_TEXT = 4_000
STRETCH = 256
#: Stretches that are parsed side by side.
ABREAST = 8_192
#: What one worker holds at a time; further languages make further groups.
GROUP_BYTES, GROUP_LANGUAGES = 128 << 20, 64
#: More labels than these are not broadcast.
BROADCAST_LABELS = 1_000_000
UNKNOWN = "und"
#: Stands between words and at both ends of a text.
EDGE = " "
CODES = 0x110000
#: What it takes to spell a letter out by its code point.
LETTER_BITS = math.log2(CODES)
#: Parts of an automaton that are stored, as arrays of 64-bit numbers.
ARRAYS = ("letters", "base", "slots", "root")


def spelled(texts: list[str | None]) -> list[str]:
    """Runs of letters in lower case, with EDGE between and around them; no letter, only EDGE."""
    lower = pc.utf8_lower(pc.fill_null(pa.array(texts, pa.large_string()), ""))
    words = pc.replace_substring_regex(lower, r"[^\pL]+", EDGE).to_pylist()
    return [EDGE + w.strip(EDGE) + EDGE if w.strip(EDGE) else EDGE for w in words]


def automaton(text: str) -> list[dict[str, int]]:
    """The suffix automaton of a text, as its states' edges: a path from state 0 for every substring and for nothing else."""
    following: list[dict[str, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        now = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = now
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return following


class Automaton(NamedTuple):
    """A suffix automaton's edges in one array: those of a state lie at its base plus their letters' numbers, with the state beside them.

    So its size follows the number of edges, whatever the alphabet.
    """

    size: int
    letters: np.ndarray
    base: np.ndarray
    slots: np.ndarray
    root: np.ndarray

    @classmethod
    def of(cls, text: str) -> "Automaton":
        following = automaton(text)
        letters = np.array(sorted({ord(c) for out in following for c in out}), np.int64)
        number = {chr(c): i + 1 for i, c in enumerate(letters.tolist())}
        width, edges = len(number) + 1, sum(map(len, following))
        used, base = bytearray(2 * edges + 2 * width), np.zeros(len(following), np.int64)
        slots = np.full(len(used), -1 << 32, np.int64)
        free = 0
        for state in sorted((s for s, out in enumerate(following) if len(out) > 1), key=lambda s: -len(following[s])):
            own = sorted(number[c] for c in following[state])
            free = at = used.find(0, max(free, own[0]))
            tries = 0
            while any(used[at - own[0] + c] for c in own):
                at, tries = used.find(0, at + 1), tries + 1
                if tries == 64:
                    # Hardly anything is left among these slots for states of several edges.
                    free = at
                if at + width >= len(used):
                    more = len(used)
                    used.extend(bytes(more))
                    slots = np.concatenate([slots, np.full(more, -1 << 32, np.int64)])
            base[state] = at - own[0]
            for c, to in following[state].items():
                used[at - own[0] + number[c]] = 1
                slots[at - own[0] + number[c]] = state << 32 | to
        single = [(s, number[c], to) for s, out in enumerate(following) if len(out) == 1 for c, to in out.items()]
        if single:
            states, codes, to = np.array(single, np.int64).T
            empty = np.flatnonzero(np.frombuffer(used, np.uint8) == 0)
            empty = empty[empty >= width]
            if len(empty) < len(single):
                slots = np.concatenate([slots, np.full(len(single), -1 << 32, np.int64)])
                empty = np.concatenate([empty, np.arange(len(used), len(used) + len(single))])
            empty = empty[: len(single)]
            base[states] = empty - codes
            slots[empty] = states << 32 | to
        last = int(np.flatnonzero(slots >= 0).max(initial=0))
        slots = np.concatenate([slots[: last + 1], np.full(width, -1 << 32, np.int64)])
        # A state without edges may look at any slot: none there is its own.
        root = np.zeros(width, np.int64)
        for c, to in following[0].items():
            root[number[c]] = to
        return cls(len(text), letters, base, slots, root)

    @property
    def bytes(self) -> int:
        return self.slots.nbytes + self.base.nbytes


class Model:
    """The automata of some languages, for many texts at a time."""

    def __init__(self, languages: list[str], automata: list[Automaton], largest: int | None = None, stretch: int = STRETCH):
        """largest: the characters of the largest model among all languages, if there are more than these."""
        self.languages, self.automata, self.stretch = languages, automata, stretch
        self.phrase_bits = math.log2((largest or max((a.size for a in automata), default=1)) + 1)
        letters = np.unique(np.concatenate([a.letters for a in automata])) if automata else np.empty(0, np.int64)
        self.codes = np.zeros(CODES, np.int32)
        self.codes[letters] = np.arange(1, len(letters) + 1)
        self.own = []
        for a in automata:
            own = np.zeros(CODES, np.int32)
            own[a.letters] = np.arange(1, len(a.letters) + 1)
            self.own.append(np.concatenate([[0], own[letters]]).astype(np.int64))

    def bits(self, texts: list[str]) -> np.ndarray:
        """What each text (rows) costs under each language (columns)."""
        phrases, lacking = self.phrases(texts)
        return phrases * self.phrase_bits + lacking * LETTER_BITS

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of phrases of each text (rows) under each language (columns), and of letters that the language lacks."""
        out, lacking = np.zeros((2, len(texts), len(self.automata)), np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = self.codes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        many = -(-sizes // self.stretch)
        owner = np.repeat(np.arange(len(texts)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        starts = (np.cumsum(sizes) - sizes)[owner] + nth * self.stretch
        lengths = np.minimum(sizes[owner] - nth * self.stretch, self.stretch)
        whose = np.repeat(np.arange(len(texts)), sizes)
        for j, own in enumerate(self.own):
            lacking[:, j] = np.bincount(whose[own[codes] == 0], minlength=len(texts))
        order = np.argsort(-lengths, kind="stable")
        for k in range(0, len(order), ABREAST):
            some = order[k : k + ABREAST]
            own = lengths[some]
            steps = np.arange(int(own[0]))[:, None]
            letters = codes[np.minimum(starts[some] + steps, len(codes) - 1)]
            active = np.searchsorted(-own, -np.arange(int(own[0])), "left")
            for j, a in enumerate(self.automata):
                count, state = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
                for row, n in zip(letters, active.tolist(), strict=True):
                    now, c = state[:n], self.own[j][row[:n]]
                    edge = a.slots[a.base[now] + c]
                    known = edge >> 32 == now
                    # Where the letter does not go on, the phrase in hand ends and the letter begins the next; one that the model lacks is a phrase itself.
                    to = np.where(known, edge & 0xFFFFFFFF, a.root[c])
                    count[:n] += (~known & (now > 0)).astype(np.int64) + (to == 0)
                    state[:n] = to
                np.add.at(out[:, j], owner[some], count + (state > 0))
        return out, lacking


def learned(docs: DataFrame, sample_docs: int, long_text: int) -> tuple[int, Iterator[tuple[str, Automaton]]]:
    """The characters of the largest model; languages in order, each with the automaton of its sample, built in a task of its own.

    docs: id, text, lang, all labelled.
    """
    size, place = F.length("text"), F.xxhash64("id", "text")
    short = size <= long_text
    # The least hash among short texts, or else the shortest text: at least that one is learned.
    least = F.min(F.struct((~short).alias("long"), F.when(short, 0).otherwise(size).alias("size"), place.alias("place")))
    counts = stored(docs.groupBy("lang").agg(F.approx_count_distinct(F.when(short, place)).alias("n"), least.alias("least")), "labels")
    few = counts.count() <= BROADCAST_LABELS
    # Hashes below a language's bound: about three times the sample, which is then cut in the order of the hashes.
    bound = (F.least(F.lit(1.0), F.lit(3.0 * sample_docs) / F.col("n")) * 2.0**64 - 2.0**63).cast("long")
    picked = docs.join(F.broadcast(counts) if few else counts, "lang")
    picked = picked.where((short & (place <= bound)) | ((short != F.col("least.long")) & (place == F.col("least.place"))))
    order = Window.partitionBy("lang").orderBy("place", "text")
    best = picked.select("lang", "text", place.alias("place")).dropDuplicates(["lang", "place"]).withColumn("number", F.row_number().over(order)).where(F.col("number") <= sample_docs)

    def build(rows: pa.Table) -> pa.Table:
        """One row; none for a language without letters."""
        rows = rows.sort_by("number")
        text = EDGE + "".join(x[1:] for x in spelled(rows.column("text").to_pylist()))
        found = [(rows.column("lang")[0].as_py(), Automaton.of(text))] if len(text) > 1 else []
        columns = {"lang": pa.array([lang for lang, _ in found], pa.string()), "size": pa.array([a.size for _, a in found], pa.int64())}
        return pa.table(columns | {x: pa.array([getattr(a, x).tobytes() for _, a in found], pa.binary()) for x in ARRAYS})

    built = best.select("lang", "text", "number").groupBy("lang").applyInArrow(build, f"lang string, size long, {', '.join(f'{x} binary' for x in ARRAYS)}")
    found = stored(built, "automata")
    each = ((row["lang"], Automaton(row["size"], *[np.frombuffer(bytes(row[x]), np.int64) for x in ARRAYS])) for row in found.orderBy("lang").toLocalIterator())
    return found.agg(F.max("size")).first()[0] or 0, each


def groups_of(learned: Iterator[tuple[str, Automaton]], group_bytes: int) -> Iterator[tuple[list[str], list[Automaton]]]:
    """Languages and automata, as many at a time as one worker holds."""
    languages, automata, size = [], [], 0
    for lang, a in learned:
        if languages and (size + a.bytes > group_bytes or len(languages) == GROUP_LANGUAGES):
            yield languages, automata
            languages, automata, size = [], [], 0
        languages.append(lang)
        automata.append(a)
        size += a.bytes
    yield languages, automata


def entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The estimate for each text under each language (one column at least), and its letters."""
    own = spelled(texts)
    letters = np.fromiter((len(x) - x.count(EDGE) for x in own), np.int64, len(own))
    if not model.automata:
        return np.zeros((len(texts), 1)), letters
    return model.bits(own) / np.maximum(letters, 1)[:, None], letters


def best_of_groups(given: DataFrame, groups: Iterator[tuple[list[str], list[Automaton]]], largest: int, stretch: int) -> DataFrame:
    """given with lang_pred, score, entropy: each group of languages reads the texts once, and each row keeps the best of all."""
    spark = given.sparkSession
    rows = stored(given.withColumn("row", F.monotonically_increasing_id()), "language_rows")
    path = scratch_path(spark, "language_groups")
    for group in groups:
        sent = spark.sparkContext.broadcast(group)

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model = Model(*sent.value, largest, stretch)
            names = np.array(model.languages, object)
            for batch in batches:
                for ids, texts in text_slices(iter([batch]), 0, 1):
                    found, total = entropies(model, texts)
                    second = pa.array(np.partition(found, 1, 1)[:, 1]) if found.shape[1] > 1 else pa.nulls(len(texts), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found.min(1)), pa.array(names[found.argmin(1)].tolist(), pa.string()), second, pa.array(total)], ["row", "least", "lang", "second", "total"])

        rows.select("row", "text").mapInArrow(score, "row long, least double, lang string, second double, total long").write.mode("append").parquet(path)
        sent.destroy()
    each = spark.read.schema("row long, least double, lang string, second double, total long").parquet(path)
    best = each.groupBy("row").agg(F.min_by("lang", F.struct("least", "lang")).alias("lang"), F.first("total").alias("total"), F.sort_array(F.flatten(F.collect_list(F.array_compact(F.array("least", "second"))))).alias("all"))
    known, least = F.col("total") > 0, F.col("all")[0]
    best = best.select(
        "row",
        F.when(known, F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, 1 - least / F.col("all")[1]).otherwise(0.0).alias("score"),
        F.when(known, least).otherwise(0.0).alias("entropy"),
    )
    return rows.join(best, "row")


def language_of(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = (), sample_docs: int = SAMPLE_DOCS, long_text: int = LONG_TEXT, group_bytes: int = GROUP_BYTES, stretch: int = STRETCH) -> DataFrame:
    """id, lang_pred, score, entropy (bits for each letter, of the winner), and the columns to carry along, the text among them.

    learn: a condition on the columns id and lang; the rows that meet it are the labelled text.
    """
    others = [c for c in carry if c != text_col]
    given = by_name(docs, id=id_col, text=text_col, lang=lang_col, **{f"carried_{i}": c for i, c in enumerate(others)})
    labelled = given.select("id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    back = {text_col: "text"} | {c: f"carried_{i}" for i, c in enumerate(others)}
    largest, automata = learned(labelled, sample_docs, long_text)
    groups = groups_of(automata, group_bytes)
    first, more = next(groups), next(groups, None)
    if more:
        wanted = given.select("id", "text", *[f"carried_{i}" for i in range(len(others))])
        found = best_of_groups(wanted, chain([first, more], groups), largest, stretch)
        return found.select("id", "lang_pred", "score", "entropy", *[F.col(back[c]).alias(c) for c in carry])
    sent = docs.sparkSession.sparkContext.broadcast(first)
    carried = ([given.schema["text"]] if text_col in carry else []) + [given.schema[f"carried_{i}"] for i in range(len(others))]
    key = given.schema["id"]
    schema = ", ".join([f"id {key.dataType.simpleString()}", "lang_pred string", "score double", "entropy double", *[f"{x.name} {x.dataType.simpleString()}" for x in carried]])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value, largest, stretch)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            at = 0
            for _, texts in text_slices(iter([batch]), 0, 1):
                part = batch.slice(at, len(texts))
                at += len(texts)
                found, total = entropies(model, texts)
                known = (total > 0) & bool(model.automata)
                best = np.where(known, found.argmin(1), len(names) - 1)
                least = found.min(1)
                score = np.where(known, 1 - least / np.where(known, np.partition(found, 1, 1)[:, 1], 1) if found.shape[1] > 1 else 1.0, 0.0)
                rate = np.where(known, least, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(rate), *part.columns[1 if text_col in carry else 2 :]], ["id", "lang_pred", "score", "entropy", *[x.name for x in carried]])

    found = given.select("id", "text", *[f"carried_{i}" for i in range(len(others))]).mapInArrow(predict, schema)
    return found.select("id", "lang_pred", "score", "entropy", *[F.col(back[c]).alias(c) for c in carry])


def fold_of(key: Column, folds: int = 4) -> Column:
    """crc32 of the id as text, mod folds."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
