"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, and links confirmed on full sets.

Documents with the same set of shingles form a class, and only classes are compared. A signature has COMPONENTS numbers of
16 bits. The first CHUNKS * CHUNK of them are cut into chunks; two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1
of these have, by the pigeonhole principle, a chunk with at most ERRORS differences. So each chunk is a key once for every
choice of ERRORS components that are left out, and classes that share a key meet: all pairs under that distance do. At a
similarity of 0.75 exactly, signatures have more errors in every chunk with a probability of 1.5e-6 (10 chunks of 4
components, 1 error); above it the probability falls fast.

No bucket is expanded into all its pairs, and none is cut off:
1. Each class is compared with one class: of the least ones of its buckets, that which it meets in most of them. Links found
   so form first components.
2. Buckets that still hold several components are compared in blocks, signature against signature. Classes of different
   components that are near enough (at least NEAR of COMPONENTS equal; at similarity 0.75 that fails with a probability below
   1e-6) form groups, one row for each class, and the full sets of a group's classes are compared with each other, in parts of
   about BLOCK_SHINGLES shingles, so that no task holds a whole group. What comes out are the links that join components.
Links are always confirmed on full sets, and components follow from links alone.

Defined cases: a null text has no words, hence an empty set, and is linked with nothing; a null id is smaller than any
other; rows that share an id are documents each, told apart by a hash of their texts; ties are settled by the smaller id; an
empty table gives no rows; other columns are not read.
"""

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import NULL_ID, by_name, hot_keys, joined, marked, mixed, shuffle_partitions, stored, text_slices
from textloom.operators.components import components
from textloom.llm.shingles import SHINGLE, shingles_of, signature, signature_seeds

COMPONENTS = 256
CHUNKS, CHUNK, ERRORS = 10, 4, 1
NEAR = 158
#: A similarity of 75 of 100.
SHARE = 75
#: Of sets that meet in one group: shingles of each side.
BLOCK_SHINGLES = 1_000_000
#: Of signatures that meet in one group.
BLOCK_ROWS = 2048


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sets_of(rows: DataFrame, size: int) -> DataFrame:
    """id, tie, n, cid (the class: a digest of the set; null for an empty one), sig."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = signature_seeds(COMPONENTS)
        for batch in batches:
            at = 0
            for ids, texts in text_slices(iter([batch]), 0, 2):
                ties = batch.column(1).slice(at, len(ids))
                at += len(ids)
                ns, cids, sigs = [], [], []
                for text in texts:
                    found = shingles_of(text, size)
                    ns.append(len(found))
                    cids.append(digest_of(found) if len(found) else None)
                    sigs.append(signature(found, seeds).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), ties, pa.array(ns, pa.int64()), pa.array(cids, pa.binary()), pa.array(sigs, pa.binary())], ["id", "tie", "n", "cid", "sig"])

    return rows.select("id", "tie", "text").mapInArrow(read, "id long, tie long, n long, cid binary, sig binary")


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COMPONENTS)


def index_keys(classes: DataFrame) -> DataFrame:
    """key, number (of the chunk and the choice), cid: a row for each chunk of a class and each choice of components left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sig = matrix(part.column(1)).astype(np.uint64)
                keys = []
                for c in range(CHUNKS):
                    for number, kept in enumerate(itertools.combinations(range(c * CHUNK, (c + 1) * CHUNK), CHUNK - ERRORS)):
                        key = np.zeros(len(sig), np.uint64)
                        for i in kept:
                            key = mixed(key ^ sig[:, i], 64 * c + number)
                        keys.append(key)
                n = len(keys)
                cids = part.column(0).take(pa.array(np.tile(np.arange(len(sig)), n)))
                numbers = pa.array(np.repeat(np.arange(n, dtype=np.int32), len(sig)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), numbers, cids], ["key", "number", "cid"])

    return classes.select("cid", "sig").mapInArrow(read, "key long, number int, cid binary")


def met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between a home and its visitors, confirmed on full sets.

    pairs: home (a group), part (of the group), home_cids or visitor cids as rows (role 0 or 1, cid). Each visitor gives at
    most one link for each part.
    """
    rows = pairs.join(sets, "cid").select("home", "part", "role", "cid", "shingles")
    spread = rows.repartition(shuffle_partitions(pairs.sparkSession), "home", "part").sortWithinPartitions("home", "part", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, homes, values, owners, sizes = None, [], None, None, None
        for batch in batches:
            found = []
            for home, part, role, cid, data in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if group != (home, part):
                    group, homes, values = (home, part), [], None
                shingles = np.frombuffer(data, np.uint64)
                if role == 0:
                    homes.append((cid, shingles))
                    continue
                if not homes:
                    continue
                if values is None:
                    sizes = np.array([len(x) for _, x in homes])
                    values, owners = np.concatenate([x for _, x in homes]), np.repeat(np.arange(len(homes)), sizes)
                    if len(homes) > 1:
                        order = np.argsort(values, kind="stable")
                        values, owners = values[order], owners[order]
                low = np.searchsorted(values, shingles, "left")
                if len(homes) == 1:
                    both = np.array([int((values[np.minimum(low, len(values) - 1)] == shingles).sum())])
                else:
                    own = np.searchsorted(values, shingles, "right") - low
                    at = np.repeat(low - np.cumsum(own) + own, own) + np.arange(int(own.sum()))
                    both = np.bincount(owners[at], minlength=len(homes))
                linked = np.flatnonzero(100 * both >= SHARE * (sizes + len(shingles) - both))
                if len(linked):
                    found.append((homes[linked[0]][0], cid))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])

    return spread.mapInArrow(compare, "a binary, b binary")


def parted(members: DataFrame, group: str, part: str) -> DataFrame:
    """The parts of each group, of about BLOCK_SHINGLES shingles each: group, part, cid, parts."""
    total = members.groupBy(group).agg((F.floor(F.sum("n") / BLOCK_SHINGLES) + 1).alias("parts")).withColumnRenamed(group, "of")
    joined = members.join(total, F.col(group) == F.col("of"))
    return joined.select(group, F.pmod(F.xxhash64("cid"), "parts").alias(part), "cid", "parts")


def confirmed(pairs: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between members of the component `home` and members of the component `visitor`.

    pairs: home, visitor, distinct. members: component, cid, n. Homes are cut into parts and visitors into slices; every
    part of a home meets every slice of its visitors, in a group of its own.
    """
    homes = members.join(pairs.select("home").distinct(), F.col("component") == F.col("home"), "left_semi").select(F.col("component").alias("home"), "cid", "n")
    visitors = pairs.join(members, F.col("visitor") == F.col("component")).select("home", "cid", "n").distinct()
    home_parts, visitor_parts = parted(homes, "home", "block"), parted(visitors, "home", "slice")
    slices = visitor_parts.groupBy("home").agg(F.max("parts").alias("slices")).withColumnRenamed("home", "of")
    blocks = home_parts.groupBy("home").agg(F.max("parts").alias("blocks")).withColumnRenamed("home", "of")
    some = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = home_parts.join(slices, F.col("home") == F.col("of")).select("home", "block", "cid", some("slices").alias("slice"), F.lit(0).alias("role"))
    right = visitor_parts.join(blocks, F.col("home") == F.col("of")).select("home", some("blocks").alias("block"), "cid", "slice", F.lit(1).alias("role"))
    both = left.select("home", "block", "slice", "cid", "role").union(right.select("home", "block", "slice", "cid", "role"))
    return met(both.select("home", F.struct("block", "slice").alias("part"), "role", "cid"), sets)


#: For the components of a chunk that are equal, as bits: the first choice of components that are all among them.
KEPT = [sum(1 << i for i in kept) for kept in itertools.combinations(range(CHUNK), CHUNK - ERRORS)]
FIRST_CHOICE = np.array([next((k for k, kept in enumerate(KEPT) if kept & bits == kept), len(KEPT)) for bits in range(1 << CHUNK)])


def first_number(same: np.ndarray) -> np.ndarray:
    """The number of the first key that two classes share, given which components are equal."""
    bits = same[:, : CHUNKS * CHUNK].reshape(-1, CHUNKS, CHUNK) @ (1 << np.arange(CHUNK))
    choice = FIRST_CHOICE[bits]
    chunk = (choice < len(KEPT)).argmax(1)
    return chunk * len(KEPT) + choice[np.arange(len(same)), chunk]


def near_groups(rows: DataFrame) -> DataFrame:
    """group, component, cid, n: classes of one bucket that hang together by near enough signatures of different components.

    rows: key, number, cid, component, n, sig of buckets with several components. Of the keys that two classes share, only the
    first one compares them. There is at most a row for each row of a bucket's block, whatever the number of pairs.
    """
    counts = rows.groupBy("key").agg((F.floor(F.count("*") / BLOCK_ROWS) + 1).cast("int").alias("blocks")).withColumnRenamed("key", "of")
    own = rows.join(counts, F.col("key") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    # A block meets itself and each other block once.
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = own.select("key", "number", "cid", "component", "n", "sig", "block", partner.alias("partner"))
    dealt = dealt.select("key", F.least("block", "partner").alias("one"), F.greatest("block", "partner").alias("two"), "number", "cid", "component", "n", "sig")
    spread = dealt.repartition(shuffle_partitions(rows.sparkSession), "key", "one", "two").sortWithinPartitions("key", "one", "two")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, held, out = None, None, [], []

        def close() -> None:
            if len({x[1] for x in held}) < 2:
                return
            names = {c: k for k, c in enumerate({x[1] for x in held})}
            code, n = np.array([names[x[1]] for x in held]), np.array([x[2] for x in held])
            sig = np.frombuffer(b"".join(x[3] for x in held), np.uint16).reshape(-1, COMPONENTS)
            roots = Roots(len(held))
            for i in range(len(held) - 1):
                other = np.flatnonzero((code[i + 1 :] != code[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= SHARE * np.maximum(n[i + 1 :], n[i]))) + i + 1
                if len(other):
                    same = sig[other] == sig[i]
                    for j in other[(same.sum(1) >= NEAR) & (first_number(same) == number)].tolist():
                        roots.join(i, j)
            for i, x in enumerate(held):
                if roots.joined[i]:
                    name = hashlib.blake2b(repr((group, roots.of(i))).encode(), digest_size=8).digest()
                    out.append((int.from_bytes(name, "little", signed=True), x[1], x[0], x[2]))

        for batch in batches:
            for key, one, two, own_number, cid, component, n, sig in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                if group != (key, one, two):
                    close()
                    group, number, held = (key, one, two), own_number, []
                held.append((cid, component, n, sig))
            if len(out) > 50_000:
                yield grouped(out)
                out.clear()
        close()
        yield grouped(out)

    def grouped(out: list) -> pa.RecordBatch:
        kinds = {"group": pa.int64(), "component": pa.binary(), "cid": pa.binary(), "n": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    return spread.mapInArrow(compare, "group long, component binary, cid binary, n long")


class Roots:
    """Which of some numbers were joined."""

    def __init__(self, n: int):
        self.parent, self.joined = list(range(n)), [False] * n

    def of(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.of(i), self.of(j)
        self.parent[max(a, b)] = min(a, b)
        self.joined[i] = self.joined[j] = True
        return a != b


def links_within(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between components, confirmed on the full sets of all classes of a group; as many as join a group's components, not all.

    groups: group, component, cid, n. A large group is cut into parts; each meets itself and every other one, in a task's group of its own.
    """
    total = groups.groupBy("group").agg((F.floor(F.sum("n") / BLOCK_SHINGLES) + 1).cast("int").alias("parts")).withColumnRenamed("group", "of")
    own = groups.join(total, F.col("group") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("cid"), "parts").cast("int"))
    met = own.select("group", "component", "cid", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("partner"))
    rows = met.join(sets, "cid").select("group", F.least("part", "partner").alias("one"), F.greatest("part", "partner").alias("two"), "component", "shingles")
    spread = rows.repartition(shuffle_partitions(groups.sparkSession), "group", "one", "two").sortWithinPartitions("group", "one", "two")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = None, [], []

        def close() -> None:
            if len(held) < 2:
                return
            names = {c: k for k, c in enumerate(dict.fromkeys(x[0] for x in held))}
            code, sizes = [names[x[0]] for x in held], np.array([len(x[1]) for x in held])
            values, owners = np.concatenate([x[1] for x in held]), np.repeat(np.arange(len(held)), sizes)
            order = np.argsort(values, kind="stable")
            values, owners, roots = values[order], owners[order], Roots(len(names))
            for i, (component, shingles) in enumerate(held):
                low = np.searchsorted(values, shingles, "left")
                own = np.searchsorted(values, shingles, "right") - low
                both = np.bincount(owners[np.repeat(low - np.cumsum(own) + own, own) + np.arange(int(own.sum()))], minlength=len(held))
                for j in np.flatnonzero(100 * both >= SHARE * (sizes + len(shingles) - both)).tolist():
                    if j > i and roots.join(code[i], code[j]):
                        out.append((component, held[j][0]))

        for batch in batches:
            for g, one, two, component, data in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if group != (g, one, two):
                    close()
                    group, held = (g, one, two), []
                held.append((component, np.frombuffer(data, np.uint64)))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["a", "b"])

    return spread.mapInArrow(compare, "a binary, b binary")


def labelled(shared: DataFrame, found: DataFrame) -> DataFrame:
    """The component of each class, itself where it has no link."""
    return shared.join(found, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid")).drop("node")


def roots(links: DataFrame) -> DataFrame:
    """node, component of links a < b with one a for each b: everyone takes its parent's parent until all hang on roots."""
    parents = stored(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")), "parents")
    while True:
        up = parents.select(F.col("node").alias("above"), F.col("component").alias("higher"))
        parents = stored(parents.join(up, F.col("component") == F.col("above"), "left").select("node", F.coalesce("higher", "component").alias("component"), F.col("higher").isNotNull().alias("moved")), "parents")
        moved = parents.where("moved").limit(1).count()
        parents = parents.select("node", "component")
        if not moved:
            return parents


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, ties: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach), kept (doc_id = component_id).

    ties: also tie (xxhash64 of the text) and first: of the rows of a component, those with its smallest (id, tie) are. It tells
    rows apart that share an id, or have none.
    """
    rows = by_name(docs, id=id_col, text=text_col).select(F.coalesce("id", F.lit(NULL_ID)).cast("long").alias("id"), F.xxhash64("text").alias("tie"), "text")
    every = stored(sets_of(rows, size), "sets")
    of_class = every.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min(F.struct("id", "tie")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("rows"))
    classes = stored(of_class, "classes")

    keys = index_keys(classes)
    firsts = keys.groupBy("key").agg(F.count("*").alias("many"), F.min("cid").alias("first")).where(F.col("many") > 1).select(F.col("key").alias("of"), "first")
    shared = stored(keys.join(firsts, F.col("key") == F.col("of")).select("key", "number", "cid", "first"), "shared")

    # The sets of classes that share a key, once; other texts are not shuffled for them.
    needed = stored(shared.select("cid").distinct().join(classes.select("cid", "rep", "n", "sig"), "cid"), "needed")
    wanted = needed.select("cid", F.col("rep.id").alias("id"), F.col("rep.tie").alias("tie"))
    texts = marked(rows, wanted, ["id", "tie"]).where("marked").select("id", "tie", "text").dropDuplicates(["id", "tie"]).join(wanted, ["id", "tie"]).select("cid", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cids, some in text_slices(batches, 0, 1):
            found = [(c, x.tobytes()) for c, x in ((c, shingles_of(t, size)) for c, t in zip(cids, some, strict=True)) if digest_of(x) == c]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["cid", "shingles"])

    sets = stored(texts.mapInArrow(full, "cid binary, shingles binary"), "full-sets")

    alone = needed.select(F.col("cid").alias("component"), "cid", "n")
    # Of the least classes of its buckets, each class is compared with the one that it meets most often.
    often = shared.where(F.col("cid") != F.col("first")).groupBy("cid", "first").agg(F.count("*").alias("times"))
    stars = often.groupBy("cid").agg(F.max(F.struct("times", "first")).alias("most")).select(F.col("most.first").alias("home"), F.col("cid").alias("visitor"))
    first = roots(confirmed(stars, alone, sets))

    comps = stored(labelled(needed, first), "components")
    several = labelled(shared.select("key", "cid"), first).groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") != F.col("high")).select(F.col("key").alias("of"))
    open_rows = shared.select("key", "number", "cid").join(several, F.col("key") == F.col("of"), "left_semi").join(comps.select("cid", "component", "n", "sig"), "cid")
    links = links_within(near_groups(open_rows), sets)
    second = components(links).select(F.col("node").alias("first_component"), F.col("component").alias("last_component"))

    last = comps.join(second, F.col("component") == F.col("first_component"), "left").select("cid", "rep", F.coalesce("last_component", "component").alias("component"))
    least = last.groupBy("component").agg(F.min("rep").alias("least")).withColumnRenamed("component", "of")
    reached = last.join(least, F.col("component") == F.col("of")).select(F.col("cid").alias("linked"), "least")
    # Classes without a shared key are on their own, and so is each row without a set. Rows of a class with very many copies are not shuffled.
    class_ids = classes.join(reached, F.col("cid") == F.col("linked"), "left").select("cid", F.coalesce("least", "rep").alias("least"))
    own = every.select("id", "tie", "n", "cid")
    placed = joined(own.where(F.col("cid").isNotNull()), stored(class_ids, "class-ids"), ["cid"], hot_keys(classes, ["cid"], "rows")).select("id", "tie", "n", "least")
    out = placed.unionByName(own.where(F.col("cid").isNull()).select("id", "tie", "n", F.struct("id", "tie").alias("least")))
    back = lambda c: F.when(c != NULL_ID, c)
    more = [F.col("tie"), (F.struct("id", "tie") == F.col("least")).alias("first")] if ties else []
    return out.select(back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.col("least.id")).alias("component_id"), (F.col("id") == F.col("least.id")).alias("kept"), *more)
