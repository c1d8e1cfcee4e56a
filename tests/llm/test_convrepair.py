import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import types as T

from kpiforge.llm import convrepair, queries
from tests.llm.fixtures import CLASH, SF

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       *[T.StructField(c, T.StringType()) for c in [*CLASH, "block", "idx", "step", "edit", "kind", "copy", "digest2"]]])


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * (len(SCHEMA) - 4)) for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """rows: (role, text, must go, truncated). Least (cost, audit, lines) by a
    search over whole edit strings."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best: dict = {}
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if best.setdefault((i, last), (cost, audit)) < (cost, audit):
            continue
        to = after[last]
        name = {"u": "user", "a": "assistant"}[to]
        ways = [(3, "I", i, to, (*lines, name + ":"))]
        if i < len(rows):
            role, text, must, cut = rows[i]
            ways.append((4, "D", i + 1, last, lines))
            if not must:
                ways.append((3 + 3 * cut, "R", i + 1, to, (*lines, f"{name}:{text}")))
                first = role[:1]
                if first == to or first == "s" and last == "":
                    ways.append((3 * cut, "K", i + 1, first, (*lines, f"{role}:{text}")))
        for c, x, j, q, done in ways:
            heapq.heappush(heap, (cost + c, audit + x, j, q, done))


def brute(original):
    out = []
    rows = damaged(original)
    for conv in {r[0] for r in original}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, marked, n = set(), [], [0, 0, 0]
        for _, role, text in own:
            stripped = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not stripped else 1 if (role, text) in seen else 2 if stripped[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            marked.append((role, text, fault in (0, 1), fault == 2))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(marked)
        out.append((conv, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, block=convrepair.BLOCK):
    return sorted((tuple(r) for r in convrepair.audit(table(spark, rows), block).collect()), key=str)


def test_row_classes():
    assert [convrepair.row_class(i, False, False) for i in ("s", "u", "a", "x", "", " ")] == [1, 3, 5, 7, 7, 7]
    assert convrepair.row_class("u", False, True) == 4 and convrepair.row_class("u", True, True) == 0


def test_walk_against_a_search_over_edit_strings():
    rng = random.Random(1)
    repair = convrepair.Repair()
    for _ in range(300):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), "t", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 9))]
        kinds = bytes(convrepair.row_class(r[:1], must, cut and not must) for r, _, must, cut in rows)
        rows = [(r, t, must, cut and not must) for r, t, must, cut in rows]
        cost, audit, _ = cheapest(rows)
        steps = repair.walk(kinds, convrepair.END, convrepair.START)
        got = ""
        while True:
            try:
                got += next(steps)[0]
            except StopIteration as e:
                got += convrepair.closing(e.value)[0]
                break
        matrix = repair.matrix(kinds)
        assert got == audit
        assert min(m + e for m, e in zip(matrix[convrepair.START], convrepair.END)) == cost


def test_few_vectors_are_ever_stored():
    """The table of steps stays small, so a step is a look-up."""
    rng = random.Random(2)
    repair = convrepair.Repair()
    list(repair.walk(bytes(rng.randrange(9) for _ in range(20_000)), convrepair.END, 0))
    assert len(repair.steps) < 2_000


def test_query_against_brute_force(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op12_conversation_repair"](spark, SF).collect()), key=str)
    assert got == brute(rows)


def _random_rows(rng, conv, n):
    texts = ["Hello.", "Why?", "no end", " ", "", "same.", "x!  \n", "dots. and more", " .", "ü?\u0085"]
    return [(conv, rng.choice([None, *range(n)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice([*texts, None, f"text {rng.random()}."])) for _ in range(n)]


@pytest.mark.parametrize("block", [3, 4096])
def test_pieces_of_any_size_give_the_same_repair(spark, block):
    rng = random.Random(block)
    rows = [r for conv in (None, 1, 2, 3, 4, 5, 6) for r in _random_rows(rng, conv, rng.choice([1, 2, 5, 9, 17]))]
    assert run(spark, rows, block) == brute(rows)


def test_repaired_rows_and_edges(spark):
    rows = [(1, 0, "system", "Be nice."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi?"), (1, 3, "user", "Hi?"), (2, None, None, None)]
    done, counts = convrepair.repair(table(spark, rows))
    got = [(r.edit, r.role, r.text) for r in done.orderBy("conv_id", "block", "idx", "step").collect()]
    assert got == [("K", "system", "Be nice."), ("I", "user", ""), ("K", "assistant", "Hello."), ("K", "user", "Hi?"), ("D", None, None), ("I", "assistant", ""), ("D", None, None)]
    assert {r.conv_id: (r.blank, r.duplicate, r.illegal, r.cost) for r in counts.collect()} == {1: (0, 1, 2, 10), 2: (1, 0, 0, 4)}
    assert run(spark, []) == []
    # Everything dropped, one very long text, one row repeated often.
    gone = [(c, t, "user", "a.") for c in range(50) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    rows = [*gone, (900, 1, "user", "long " * 200_000 + "."), *[(901, 4, "assistant", "again.")] * 30]
    assert gone and run(spark, rows) == brute(rows)
