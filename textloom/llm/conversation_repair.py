"""Repair of the structure of conversations at the least cost, by a run-length dynamic program over min-plus matrices.

A conversation's rows stand in the order of their turns (nulls first; rows of one turn by md5 of `role:text`). Each row has a
symbol: the first letter of its role (s, u, a or another one) and its fault, which is the first of blank (nothing but blanks),
duplicate (its role and text came before in the conversation), truncated (the last character that is no blank is none of .!?).
Edits are Keep (0), Rerole to user or assistant (1), Delete (2, the only one for a blank or a duplicate) and Insert of an empty
text of user or assistant at any place (5); a truncated row that stays costs 5 more. What is left has role initials of the form
(s?(ua)+)?. The audit is the initials of the cheapest edits in order; of several, the first in the order of ASCII. It fixes the
repaired rows, as an inserted or reroled one can only be what comes next.

How: the rows are sorted once by ranges of (conversation, turn), so that a long conversation takes many tasks, and cut into
segments of at most `segment_rows` rows and about SEGMENT_CHARS characters. A state is what came last: nothing, s, u or a. A symbol's transition (inserts, then the
row) is a 4 x 4 min-plus matrix; equal symbols in a row form a run, and a run's matrix comes from cached binary powers. The
product over its runs is all that is known of a segment outside its task: one pass over segments from the last to the first gives
what it costs to go on from each segment's end, segments then choose their edits for each state they may be entered in, and a
second pass from the first to the last finds the state. Both passes stream segments, not rows, and hold one vector.

Whether a row came before is found by the least (segment, place) of each role and text: a grouped minimum, not a window. A
conversation's digest has to be taken over its text in order, so its segments' texts (not its rows) go through one task, as a
stream.

Defined cases: a null role or text counts as one space; a null conversation is one of its own; an empty role can't be kept; a
conversation without rows is not known here; repeated rows are duplicates; an empty table gives no rows; other columns are not
read, whatever their names.
"""

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import by_name, shuffle_partitions, stored

SEGMENT_ROWS, SEGMENT_CHARS = 1024, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, or the initial of the last row. What is inserted or reroled in a state is what comes next there.
START, S, U, A = range(4)
NEXT = (U, U, A, U)
ROLES = {U: "user", A: "assistant"}
INITIALS = "sua"
#: Faults that a row's own text shows, and the one that it does not.
SOUND, BLANK, CUT, REPEATED = range(4)
NEVER = 1 << 40
Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def symbol(role: str, fault: int) -> int:
    """A number below 16 for the class of the role's initial and the fault."""
    return (INITIALS.find(role[:1]) if role else -1) + 1 << 2 | fault


@cache
def choices(sign: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state, the edits that take up a row with this symbol: initial, cost and next state, in the order of ASCII."""
    kept, fault = (sign >> 2) - 1, sign & 3
    out = []
    for state in range(4):
        found = [("D", DELETE, state)]
        if fault in (SOUND, CUT):
            more = TRUNCATED * (fault == CUT)
            if kept >= 0 and (state == START if kept == 0 else NEXT[state] == kept + 1):
                found.append(("K", more, kept + 1))
            found.append(("R", REROLE + more, NEXT[state]))
        out.append(tuple(found))
    return tuple(out)


def with_inserts(vector: Vector) -> Vector:
    """The least cost from each state, if any number of inserts may come first."""
    after = lambda state: min(vector[NEXT[state]], INSERT + vector[NEXT[NEXT[state]]])
    return tuple(min(vector[s], INSERT + after(s)) for s in range(4))


#: What is left to pay at the end of a conversation.
END = with_inserts((0, NEVER, NEVER, 0))


def product(a: Matrix, b: Matrix) -> Matrix:
    columns = tuple(zip(*b, strict=True))
    return tuple(tuple(min(NEVER, *map(sum, zip(row, column, strict=True))) for column in columns) for row in a)


def applied(a: Matrix, vector: Vector) -> Vector:
    return tuple(min(NEVER, *map(sum, zip(row, vector, strict=True))) for row in a)


IDENTITY: Matrix = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))


@cache
def power(sign: int, doubled: int) -> Matrix:
    """The transition of 2**doubled rows with one symbol: from each state, inserts and edits of these rows, to each state."""
    if doubled:
        half = power(sign, doubled - 1)
        return product(half, half)
    columns = [with_inserts(tuple(min([cost for _, cost, to in choices(sign)[s] if to == t], default=NEVER) for s in range(4))) for t in range(4)]
    return tuple(tuple(min(NEVER, column[s]) for column in columns) for s in range(4))


@cache
def run(sign: int, length: int) -> Matrix:
    out = IDENTITY
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            out = product(out, power(sign, bit))
    return out


def matrix_of(signs: bytes) -> Matrix:
    out = IDENTITY
    for sign, same in groupby(signs):
        out = product(out, run(sign, sum(1 for _ in same)))
    return out


@cache
def chosen(sign: int, after: Vector) -> tuple[Vector, int, tuple[tuple[str, int], ...]]:
    """For one row: the cost to go from before it and what was taken off that, and for each state the edits up to this row and the state behind.

    after: the cost to go from behind it, less its minimum; so few vectors ever occur, and their choices are kept.
    """
    row = tuple(min(cost + after[to] for _, cost, to in own) for own in choices(sign))
    before = with_inserts(row)
    out = []
    for state in range(4):
        edits, now = "", state
        while True:
            ways = [(edit, to, True) for edit, cost, to in choices(sign)[now] if cost + after[to] == before[now]]
            if INSERT + before[NEXT[now]] == before[now]:
                ways.append(("I", NEXT[now], False))
            edit, now, done = min(ways)
            edits += edit
            if done:
                break
        out.append((edits, now))
    least = min(before)
    return tuple(x - least for x in before), least, tuple(out)


def last_inserts(state: int) -> str:
    return {START: "", A: "", U: "I", S: "II"}[state]


def unrolled(signs: bytes, end: Vector, states: tuple[int, ...]) -> list[tuple[str, int]]:
    """The edits of these rows and the state behind them, for each state in which they are entered."""
    least = min(end)
    vector, steps = tuple(x - least for x in end), []
    for sign in reversed(signs):
        vector, _, own = chosen(sign, vector)
        steps.append(own)
    out = []
    for state in states:
        edits = []
        for own in reversed(steps):
            some, state = own[state]
            edits.append(some)
        out.append(("".join(edits), state))
    return out


def repaired_rows(audit: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """edit, role and text of each row that is left."""
    at = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else (roles[at], texts[at])
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = INITIALS.find(role[0]) + 1
        else:
            state = NEXT[state]
            role = ROLES[state]
        yield edit, role, text


def sorted_segments(rows: DataFrame, segment_rows: int) -> DataFrame:
    """conv, segment (numbers in the order of conversations and their rows), roles, texts, signs, pairs (a digest of role and text each), turns."""
    spark = rows.sparkSession
    keyed = rows.withColumns({"tie": F.md5(F.concat("role", F.lit(":"), "text")), "row": F.monotonically_increasing_id()})
    stripped = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(stripped == "", BLANK).when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)
    # The row's number splits even equal rows of one turn among tasks.
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "tie", "row"]
    ranged = keyed.withColumn("fault", fault).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    conv = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {conv}, segment long, roles array<string>, texts array<string>, signs binary, pairs array<binary>, turns array<long>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, key = TaskContext.get().partitionId() << 32, [], 0, None

        def segment() -> pa.RecordBatch:
            _, turns, roles, texts, faults = zip(*held, strict=True)
            pairs = [hashlib.blake2b(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass"), digest_size=16).digest() for r, t in zip(roles, texts, strict=True)]
            signs = bytes(map(symbol, roles, faults))
            columns = [pa.array([key], kinds[0]), pa.array([number], pa.int64()), pa.array([roles], pa.list_(pa.string())), pa.array([texts], pa.list_(pa.string())), pa.array([signs], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([pairs], pa.list_(pa.binary())), pa.array([turns], pa.list_(pa.int64()))], ["conv", "segment", "roles", "texts", "signs", "pairs", "turns"])

        for batch in batches:
            kinds = batch.schema.types
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (row[0] != key or len(held) >= segment_rows or size + len(row[3]) > SEGMENT_CHARS):
                    yield segment()
                    number, held, size = number + 1, [], 0
                key = row[0]
                held.append(row)
                size += len(row[3])
        if held:
            yield segment()

    return ranged.select("conv", F.col("turn").cast("long").alias("turn"), "role", "text", "fault").mapInArrow(cut, schema)


def marked_segments(segments: DataFrame) -> DataFrame:
    """conv, segment, signs with duplicates, matrix, and what counts and joins with the neighbours need."""
    first = F.min(F.struct("segment", "place"))
    firsts = segments.select("conv", "segment", F.posexplode("pairs").alias("place", "pair")).groupBy("conv", "pair").agg(first.alias("first"))
    places = firsts.groupBy(F.col("first.segment").alias("segment")).agg(F.collect_list("first.place").alias("firsts"))
    narrow = segments.select("conv", "segment", "signs", "turns", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"))
    own = narrow.join(places, "segment", "left")
    conv = segments.schema["conv"].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for signs, turns, initials, firsts in zip(*[batch.column(i).to_pylist() for i in range(2, 6)], strict=True):
                new = set(firsts or ())
                signs = bytes(x if x & 3 == BLANK or i in new else x & ~3 | REPEATED for i, x in enumerate(signs))
                faults = [sum(x & 3 == f for x in signs) for f in (BLANK, REPEATED, CUT)]
                pairs = list(zip(initials, initials[1:], strict=False))
                known = [t for t in turns if t is not None]
                rows.append((signs, [x for row in matrix_of(signs) for x in row], *faults, sum(a + b not in ("su", "ua", "au") for a, b in pairs), initials[0], initials[-1], len(set(known)), turns[0], turns[-1], min(known, default=None), max(known, default=None)))
            columns = list(zip(*rows, strict=True)) or [[]] * 13
            kinds = [pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns, kinds)], names)

    names = ["conv", "segment", "signs", "matrix", "blank", "duplicate", "truncated", "illegal", "opens", "closes", "turns", "first_turn", "last_turn", "least_turn", "most_turn"]
    kinds = [conv, "long", "binary", "array<long>", *["long"] * 4, "string", "string", *["long"] * 5]
    return own.select("conv", "segment", "signs", "turns", "initials", "firsts").mapInArrow(mark, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def costs_to_go(marks: DataFrame) -> DataFrame:
    """marks from each conversation's last segment to its first: end (cost to go on from each state behind it), whether it is the first and the last, and the cost of all (at the first)."""
    spark = marks.sparkSession
    streamed = marks.repartition(shuffle_partitions(spark), "conv").sortWithinPartitions("conv", F.desc("segment"))
    at = {name: i for i, name in enumerate(marks.columns)}
    schema = marks.schema.simpleString()[7:-1] + ",end:array<bigint>,first:boolean,last:boolean,cost:bigint"

    def pass_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vector = None, END
        for batch in batches:
            out = []
            for row in map(list, zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                last = held is None or held[0] != row[0]
                if held is not None:
                    out.append([*held[:-1], last, held[-1], vector[START] if last else None])
                if last:
                    vector = END
                else:
                    # The held one comes behind this one.
                    row[at["illegal"]] += row[at["closes"]] + held[at["opens"]] not in ("su", "ua", "au")
                    row[at["turns"]] -= row[at["last_turn"]] is not None and row[at["last_turn"]] == held[at["first_turn"]]
                matrix = row[at["matrix"]]
                held = [*row, list(vector), last]
                vector = applied(tuple(tuple(matrix[i : i + 4]) for i in (0, 4, 8, 12)), vector)
            yield table(out)
        if held is not None:
            yield table([[*held[:-1], True, held[-1], vector[START]]])

    fields = [(f.name, f.dataType.simpleString()) for f in marks.schema] + [("end", "array<bigint>"), ("first", "boolean"), ("last", "boolean"), ("cost", "bigint")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}

    def table(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return streamed.mapInArrow(pass_back, schema)


def chosen_edits(costs: DataFrame) -> DataFrame:
    """conv, segment, entered (state), audit of each segment. costs: a stored table."""
    spark = costs.sparkSession
    conv = costs.schema["conv"].dataType.simpleString()

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, exits = [], []
            for signs, end, first, last in zip(*[batch.column(i).to_pylist() for i in range(2, 6)], strict=True):
                found = unrolled(signs, tuple(end), (START,) if first else (START, S, U, A))
                audits.append([text + (last_inserts(state) if last else "") for text, state in found])
                exits.append([state for _, state in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(4), batch.column(5), pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))], ["conv", "segment", "first", "last", "audits", "exits"])

    spread = costs.select("conv", "segment", "signs", "end", "first", "last").repartition(shuffle_partitions(spark), "segment")
    ways = stored(spread.mapInArrow(unroll, f"conv {conv}, segment long, first boolean, last boolean, audits array<string>, exits array<int>"), "repair_ways")
    alone = F.col("first") & F.col("last")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = START
        for batch in batches:
            entered, audits = [], []
            for first, ways, exits in zip(*[batch.column(i).to_pylist() for i in range(2, 5)], strict=True):
                state = START if first else state
                entered.append(state)
                audits.append(ways[state])
                state = exits[state]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(entered, pa.int32()), pa.array(audits, pa.string())], ["conv", "segment", "entered", "audit"])

    several = ways.where(~alone).select("conv", "segment", "first", "audits", "exits").repartition(shuffle_partitions(spark), "conv").sortWithinPartitions("conv", "segment")
    found = several.mapInArrow(enter, f"conv {conv}, segment long, entered int, audit string")
    return ways.where(alone).select("conv", "segment", F.lit(START).alias("entered"), F.col("audits")[0].alias("audit")).unionByName(found)


class Repaired(NamedTuple):
    #: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of the repaired `role:text`, joined by newlines).
    conversations: DataFrame
    #: conv, segment, number, edit, role, text: the rows that are left, in the order of (segment, number).
    turns: DataFrame


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_rows: int = SEGMENT_ROWS) -> Repaired:
    spark = rows.sparkSession
    given = by_name(rows, conv=conv_col, turn=turn_col, role=role_col, text=text_col).withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    segments = stored(sorted_segments(given, segment_rows), "repair_segments")
    costs = stored(costs_to_go(marked_segments(segments)), "repair_costs")
    edits = stored(chosen_edits(costs), "repair_edits")
    conv = given.schema["conv"].dataType.simpleString()
    alone = F.col("first") & F.col("last")
    applied_to = segments.select("segment", "roles", "texts").join(edits.join(costs.select("segment", alone.alias("alone")), "segment"), "segment").select("conv", "segment", "roles", "texts", "entered", "audit", "alone")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a segment that is a whole conversation the digest, of others the text."""
        for batch in batches:
            for i in range(batch.num_rows):
                roles, texts, entered, audit, whole = (batch.column(c)[i].as_py() for c in range(2, 7))
                text = "\n".join(f"{role}:{text}" for _, role, text in repaired_rows(audit, entered, roles, texts)).encode("utf-8", "surrogatepass")
                found = [hashlib.sha256(text).hexdigest() if whole else None], [None if whole else text]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array(found[0], pa.string()), pa.array(found[1], pa.binary())], ["conv", "segment", "digest", "piece"])

    pieces = stored(applied_to.mapInArrow(write, f"conv {conv}, segment long, digest string, piece binary"), "repair_pieces")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task streams a conversation's pieces; it holds a batch of them and the state of the digest."""
        key, state, begun = None, None, False
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([state.hexdigest()], pa.string())], ["conv", "digest"])
        for batch in batches:
            kind = batch.column(0).type
            for i in range(batch.num_rows):
                own, piece = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                if state is None or own != key:
                    if state is not None:
                        yield done()
                    key, state, begun = own, hashlib.sha256(), False
                if piece:
                    state.update(b"\n" * begun + piece)
                    begun = True
        if state is not None:
            yield done()

    long = pieces.where(F.col("digest").isNull()).select("conv", "segment", "piece").repartition(shuffle_partitions(spark), "conv").sortWithinPartitions("conv", "segment")
    digests = pieces.where(F.col("digest").isNotNull()).select("conv", "digest").unionByName(long.mapInArrow(digest, f"conv {conv}, digest string"))
    counts = costs.groupBy("conv").agg(
        F.coalesce(F.max("most_turn") - F.min("least_turn") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")],
    )
    audits = edits.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    each = counts.join(audits.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    each = each.join(digests.select(F.col("conv").alias("of"), F.col("digest").alias("repaired_sha256")), F.col("conv").eqNullSafe(F.col("of"))).drop("of")

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                roles, texts, entered, audit = (batch.column(c)[i].as_py() for c in range(2, 6))
                left = list(repaired_rows(audit, entered, roles, texts))
                key, segment = ([batch.column(c)[i].as_py()] * len(left) for c in (0, 1))
                edits, roles, texts = zip(*left, strict=True) if left else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(key, batch.column(0).type), pa.array(segment, pa.int64()), pa.array(range(len(left)), pa.int32()), *[pa.array(x, pa.string()) for x in (edits, roles, texts)]], ["conv", "segment", "number", "edit", "role", "text"])

    return Repaired(each, applied_to.drop("alone").mapInArrow(turns, f"conv {conv}, segment long, number int, edit string, role string, text string"))
