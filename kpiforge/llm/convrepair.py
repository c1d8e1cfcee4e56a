"""Conversation structure repair by a square-root checkpointed DP.

A conversation is repaired by the cheapest edits - Keep, Rerole, Delete,
Insert - after which its roles read system (at most once, first), then
user and assistant in turn, ending with the assistant; an empty
conversation is fine too. Among equally cheap edits those whose initials
come first in ASCII are taken.

The state is what the repaired conversation ends with so far (nothing,
system, user, assistant); each of the four letters leads from a state to
one state, so the backward vector of four costs says which letters are
tight, and walking forward along the least tight letter gives the least
string. Vectors are stored only at checkpoints, every square root of the
rows; the walk recomputes one block of vectors at a time. Up to a
constant there are few different vectors, so a step is one look-up in a
table that fills itself.

On Spark the same idea is applied once more, so that no conversation has
to fit a task. Rows are put in order by ranges and cut into blocks of
``BLOCK``; the rows of one conversation in one block are a piece (a byte a
row). Then, over pieces:

1. the min-plus matrix of each piece (in parallel), multiplied backwards
   along each conversation: the checkpoint at the end of each piece;
2. where each of the four states leads through a piece (in parallel),
   followed forwards: the state in which each piece begins;
3. the walk through each piece (in parallel), inside it with square-root
   checkpoints.

The two chains stream over pieces, sorted by Spark, and keep four numbers.

Null ids are one conversation; null turns come first; rows of one turn are
in order of role, then of the text's first 64 characters, then of its
digest. Null roles and texts count as one blank. Repeated rows are rows
like others (all but the first are duplicates). Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import written

BLOCK = 4096
BLANKS = " \t\n\x0b\x0c\r"
ROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3      # costs of edits, and of keeping a truncated row

# ---- the repair automaton --------------------------------------------------------

START, SYSTEM, USER, ASSISTANT = range(4)
#: The user or assistant row that may follow in each state.
NEXT = (USER, USER, ASSISTANT, USER)
END = (0, 6, 3, 0)            # cost of ending here: inserts up to an assistant's row
MUST_GO = 0                   # row class of blank and duplicate rows


def row_class(initial: str, must_go: bool, truncated: bool) -> int:
    """Rows of one class are repaired alike."""
    return MUST_GO if must_go else 1 + 2 * ("sua".find(initial) if initial else -1) % 8 + truncated


def _edits(kind: int, state: int):
    """(letter, cost, state after) of the edits that use up a row."""
    yield "D", DELETE, state
    if kind == MUST_GO:
        return
    initial, truncated = divmod(kind - 1, 2)
    more = UNFINISHED * truncated
    if initial == 0 and state == START:
        yield "K", more, SYSTEM
    elif initial in (1, 2) and NEXT[state] == initial + 1:
        yield "K", more, NEXT[state]
    yield "R", ROLE + more, NEXT[state]


class Repair:
    """Backward steps and tight edits, each worked out once."""

    def __init__(self):
        self.steps: dict = {}
        self.tight: dict = {}

    def before(self, after: tuple, kind: int) -> tuple[tuple, float]:
        """The cost vector ahead of a row, less its least cost, and that
        cost; ``after`` is the vector behind the row."""
        got = self.steps.get((after, kind))
        if got is None:
            v = [min(c + after[to] for _, c, to in _edits(kind, q)) for q in range(4)]
            for q in (USER, ASSISTANT, USER, START, SYSTEM):       # inserts ahead of the row
                v[q] = min(v[q], INSERT + v[NEXT[q]])
            least = min(v)
            got = self.steps[after, kind] = tuple(x - least for x in v), least
        return got

    def edit(self, after: tuple, kind: int, state: int) -> tuple[str, str, int]:
        """The edits up to and at a row that starts in ``state``: letters,
        role initials (``-``: none or its own), and the state behind it."""
        got = self.tight.get((after, kind, state))
        if got is None:
            here, least = self.before(after, kind)
            letters = roles = ""
            q, done = state, False
            while not done:
                ways = [(x, c + after[to] - least, to, True) for x, c, to in _edits(kind, q)] + [("I", INSERT + here[NEXT[q]], NEXT[q], False)]
                x, _, q, done = min(w for w in ways if w[1] == here[q])
                letters += x
                roles += "-sua"[q] if x in "IR" else "-"
            got = self.tight[after, kind, state] = letters, roles, q
        return got

    def matrix(self, kinds: bytes) -> list[list[float]]:
        """Cheapest cost through the rows, from state to state."""
        columns = []
        for to in range(4):
            v, total = tuple(0 if q == to else math.inf for q in range(4)), 0
            for kind in reversed(kinds):
                v, least = self.before(v, kind)
                total += least
            columns.append([x + total for x in v])
        return [[columns[to][q] for to in range(4)] for q in range(4)]

    def walk(self, kinds: bytes, end: tuple, state: int):
        """(letters, roles) of each row, walking from ``state``; ``end`` is
        the vector behind the last row. Returns the last state."""
        n = len(kinds)
        size = math.isqrt(n) + 1
        marks = {}
        v = end
        for i in range(n - 1, -1, -1):
            if (i + 1) % size == 0:
                marks[i + 1] = v
            v, _ = self.before(v, kinds[i])
        for a in range(0, n, size):
            b = min(a + size, n)
            v = end if b == n else marks[b]
            block = [v]
            for i in range(b - 1, a, -1):
                v, _ = self.before(v, kinds[i])
                block.append(v)
            for i in range(a, b):
                letters, roles, state = self.edit(block.pop(), kinds[i], state)
                yield letters, roles
        return state

    def leads_to(self, kinds: bytes, end: tuple, state: int) -> int:
        steps = self.walk(kinds, end, state)
        while True:
            try:
                next(steps)
            except StopIteration as e:
                return e.value


def closing(state: int) -> tuple[str, str]:
    """Inserts behind the last row."""
    letters = roles = ""
    while END[state]:
        state = NEXT[state]
        letters += "I"
        roles += "-sua"[state]
    return letters, roles


def normal(vector) -> tuple:
    least = min(vector)
    return tuple(x - least for x in vector)


# ---- rows -------------------------------------------------------------------------

def damage(table: DataFrame) -> DataFrame:
    """The contract's damage, by crc32(``conv_id:turn``) % 20: 0 drops a
    row, 1 empties its text, 2 removes its full stops, exclamation and
    question marks, 3 repeats it, 4 makes it the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = table.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def ordered(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (conv_id, turn, role, text) with ``digest`` of role and text,
    and their place in the order of conversations: ``block``, ``idx``.
    Ranges of the whole order, so that a conversation may span many tasks;
    written once."""
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    rows = rows.withColumn("__head", F.substring("text", 1, 64)).withColumn("__uid", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "__head", "digest", "__uid"]
    rows = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).drop("__head", "__uid")

    def number(batches):
        n, part = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            at = range(n, n + b.num_rows)
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part + i // block for i in at], pa.int64()), pa.array([i % block for i in at], pa.int32())], names=[*b.schema.names, "block", "idx"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return written(rows.mapInArrow(number, f"{names}, block long, idx int"), "conversation_rows")


def _ends() -> tuple[Column, Column]:
    """Whether the text is blank; whether its last character that is not
    blank ends no sentence."""
    text = F.rtrim(F.col("text"), F.lit(BLANKS))
    return text == "", ~F.right(text, F.lit(1)).isin(".", "!", "?")


def faulty(rows: DataFrame) -> DataFrame:
    """conv_id, turn, block, idx, initial and fault (blank, duplicate,
    truncated, null) of ordered rows. The first row of each role and text is
    found by a minimum that every task takes on its own rows first."""
    first = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("block", "idx")).alias("at")).select(F.col("at.block").alias("block"), F.col("at.idx").alias("idx"), F.lit(True).alias("first"))
    blank, truncated = _ends()
    narrow = rows.select("conv_id", "turn", "block", "idx", F.left("role", F.lit(1)).alias("initial"), blank.alias("blank"), truncated.alias("truncated"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    return written(narrow.join(first, ["block", "idx"], "left").select("conv_id", "turn", "block", "idx", "initial", fault.alias("fault")), "conversation_faults")


# ---- pieces -----------------------------------------------------------------------

PIECE = "conv_id long, block long, start int, kinds binary, illegal long, first string, last string, matrix array<long>"
LEGAL = ("su", "ua", "au")


def _table(schema: str, rows: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=names)


def _listed(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batched(schema: str, rows, size: int = 2048):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _table(schema, held)
            held = []
    if held:
        yield _table(schema, held)


def pieces(faults: DataFrame) -> DataFrame:
    """The runs of one conversation in one block, with their matrix (-1: no
    way) and the adjacent roles inside that are out of turn."""
    def run(batches):
        repair = Repair()

        def each():
            for (conv, block), rows in groupby(_listed(batches), key=lambda r: (r[0], r[1])):
                rows = list(rows)
                kinds = bytes(row_class(r[3], r[4] in ("blank", "duplicate"), r[4] == "truncated") for r in rows)
                illegal = sum(a[3] + b[3] not in LEGAL for a, b in zip(rows, rows[1:]))
                yield conv, block, rows[0][2], kinds, illegal, rows[0][3], rows[-1][3], [-1 if x == math.inf else x for r in repair.matrix(kinds) for x in r]

        return _batched(PIECE, each())

    dealt = faults.select("conv_id", "block", "idx", "initial", "fault").repartition("block").sortWithinPartitions("block", "idx")
    return dealt.mapInArrow(run, PIECE)


def checkpoints(cut: DataFrame) -> DataFrame:
    """Backwards along each conversation: the cost vector ``end`` behind each
    piece, and at the first piece the whole ``cost``."""
    schema = "conv_id long, block long, start int, kinds binary, illegal long, first string, last string, end array<long>, tail boolean, ahead array<long>"

    def run(batches):
        def each():
            conv, end = (), None
            for c, *piece, matrix in _listed(batches):
                tail = (c,) != conv
                conv, end = (c,), END if tail else end
                rows = [[math.inf if x < 0 else x for x in matrix[4 * q:4 * q + 4]] for q in range(4)]
                here = [min(m + e for m, e in zip(row, end)) for row in rows]
                yield c, *piece, list(end), tail, here
                end = here

        return _batched(schema, each())

    dealt = cut.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("block").desc(), F.col("start").desc())
    return written(dealt.mapInArrow(run, schema), "conversation_checkpoints")


def entered(marked: DataFrame) -> DataFrame:
    """The state in which each piece begins: where the four states lead, in
    parallel, then forwards along each conversation. ``illegal`` now counts
    the border to the piece before; ``cost`` is set at the first piece."""
    held = "conv_id long, block long, start int, kinds binary, illegal long, first string, last string, end array<long>, tail boolean, cost long, leads array<long>"
    schema = "conv_id long, block long, start int, kinds binary, illegal long, end array<long>, tail boolean, cost long, state int"

    def leads(batches):
        repair = Repair()

        def each():
            for *piece, end, tail, ahead in _listed(batches):
                v = normal(end)
                yield *piece, end, tail, ahead[START], [repair.leads_to(piece[3], v, q) for q in range(4)]

        return _batched(held, each())

    def follow(batches):
        def each():
            conv, state, before = (), START, None
            for c, block, start, kinds, illegal, first, last, end, tail, cost, to in _listed(batches):
                if (c,) != conv:
                    conv, state, before = (c,), START, None
                else:
                    illegal, cost = illegal + (before + first not in LEGAL), 0
                yield c, block, start, kinds, illegal, end, tail, cost, state
                state, before = to[state], last

        return _batched(schema, each())

    somewhere = marked.repartition("block", "start").mapInArrow(leads, held)
    return written(somewhere.repartition("conv_id").sortWithinPartitions("conv_id", "block", "start").mapInArrow(follow, schema), "conversation_entries")


def edits(entries: DataFrame) -> DataFrame:
    """block, idx, letters, roles: the tight edits at each row (inserts ahead
    of it first; at a conversation's last row also those behind it)."""
    schema = "block long, idx int, letters string, roles string"

    def run(batches):
        repair = Repair()

        def each():
            for _, block, start, kinds, _, end, tail, _, state in _listed(batches):
                steps, i = repair.walk(kinds, normal(end), state), start
                held = None
                while True:
                    try:
                        step = next(steps)
                    except StopIteration as e:
                        more = closing(e.value) if tail else ("", "")
                        yield block, i - 1, held[0] + more[0], held[1] + more[1]
                        break
                    if held:
                        yield block, i - 1, *held
                    held, i = step, i + 1

        return _batched(schema, each(), 1 << 16)

    return entries.repartition("block", "start").mapInArrow(run, schema)


# ---- the operator -----------------------------------------------------------------

def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Repairs conversations (conv_id, turn, role, text).

    First result: one row an edit: conv_id, block, idx, step (their order),
    edit (its initial), turn, and role and text of the repaired row (null
    where it is deleted). Second: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost."""
    placed = ordered(rows, block)
    faults = faulty(placed)
    entries = entered(checkpoints(pieces(faults)))
    each = placed.join(edits(entries), ["block", "idx"]).select("conv_id", "block", "idx", "turn", "role", "text", "roles", F.posexplode(F.split("letters", "")).alias("step", "edit"))
    to = F.substring("roles", F.col("step") + 1, F.lit(1))
    named = F.when(to == "u", "user").when(to == "a", "assistant")
    done = each.select("conv_id", "block", "idx", "step", "edit", F.when(F.col("edit") != "I", F.col("turn")).alias("turn"),
                       F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") != "D", named).alias("role"),
                       F.when(F.col("edit").isin("K", "R"), F.col("text")).when(F.col("edit") == "I", "").alias("text"))
    turns = faults.groupBy("conv_id", "turn").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    wide = F.col("turn").cast("decimal(38,0)")
    gaps = F.coalesce((F.max(wide) - F.min(wide) + 1 - F.count("turn")).cast("long"), F.lit(0))
    counts = turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    costs = entries.groupBy(F.col("conv_id").alias("__conv")).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    return done, counts.join(costs, counts["conv_id"].eqNullSafe(costs["__conv"])).drop("__conv")


def digests(done: DataFrame) -> DataFrame:
    """conv_id, audit (the edits' initials) and repaired_sha256 (the repaired
    ``role:text`` lines). A digest of a whole conversation can only be taken
    in order, so this - not the repair - streams each conversation through
    one task; it holds one row and the audit."""
    schema = "conv_id long, audit string, repaired_sha256 string"

    def run(batches):
        def each():
            for conv, rows in groupby(_listed(batches), key=lambda r: r[0]):
                audit, digest, some = [], hashlib.sha256(), False
                for _, edit, role, text in rows:
                    audit.append(edit)
                    if edit != "D":
                        digest.update((("\n" if some else "") + f"{role}:{text}").encode())
                        some = True
                yield conv, "".join(audit), digest.hexdigest()

        return _batched(schema, each())

    dealt = done.repartition("conv_id").sortWithinPartitions("conv_id", "block", "idx", "step").select("conv_id", "edit", "role", "text")
    return dealt.mapInArrow(run, schema)


def audit(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """The contract's row for every original conversation."""
    done, counts = repair(damage(table), block)
    found = digests(done).withColumnRenamed("conv_id", "__id")
    out = table.select(F.col("conv_id").cast("long").alias("__original")).distinct()
    out = out.join(counts, out["__original"].eqNullSafe(counts["conv_id"]), "left").join(found, out["__original"].eqNullSafe(found["__id"]), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("__original").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
