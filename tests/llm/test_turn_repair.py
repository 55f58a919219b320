"""Turn repair against exhaustive search, and in segments against whole conversations."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from seqweave.llm import turn_repair as T

BLANK = re.compile(r"^[\x20\x09-\x0D]*$")
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """All edits of a conversation's rows, tried one by one. rows: role, text and first fault."""
    best = None
    fillings = [x for n in range(3) for x in itertools.product("ua", repeat=n)]

    def go(i, cost, audit, roles, lines):
        nonlocal best
        if re.fullmatch(r"(s(u(au)*)?|u(au)*|(s?(ua)+)?)", roles) is None or best and cost > best[0]:
            return
        for put in fillings:
            more = [{"u": "user:", "a": "assistant:"}[x] for x in put]
            c, a, r, x = cost + 5 * len(put), audit + "I" * len(put), roles + "".join(put), lines + more
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", r) and (best is None or (c, a) < best[:2]):
                    best = (c, a, x)
                continue
            role, text, fault = rows[i]
            go(i + 1, c + 2, a + "D", r, x)
            if fault not in ("blank", "duplicate"):
                late = 5 if fault == "truncated" else 0
                if role:
                    go(i + 1, c + late, a + "K", r + role[0], [*x, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    go(i + 1, c + late + 1, a + "R", r + new[0], [*x, f"{new}:{text}"])

    go(0, 0, "", "", [])
    return best


def judged(rows):
    """What a conversation's rows (turn, role, text) should give."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(T.SPACES)
        faults.append("blank" if BLANK.match(text) else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, lines = cheapest([(r, x, f) for (_, r, x), f in zip(rows, faults, strict=True)])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(n, longest, seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", None, ""], ["Yes.", "No!", "cut", " \n", "", None, "é?\t ", "Done. \x0b"]
    return [(k, rng.choice([None, i, i, i + rng.randint(0, 2)]), rng.choices(roles, [6, 6, 2, 1, 1, 1])[0], rng.choices(texts, [6, 6, 3, 1, 1, 1, 5, 5])[0]) for k in [*range(n), None] for i in range(rng.randint(1, longest))]


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_repairs_as_exhaustive_search(spark):
    rows = conversations(40, 4, 1)
    by = {}
    for k, *row in rows:
        by.setdefault(k, []).append(row)
    assert found(T.repaired(spark.createDataFrame(rows, SCHEMA))) == {k: judged(v) for k, v in by.items()}


@pytest.mark.parametrize(("segment", "chars", "block"), [(2, 1 << 20, 2), (3, 7, 1), (1, 1, 256)])
def test_segments_as_whole_conversations(spark, segment, chars, block):
    turns = spark.createDataFrame(conversations(12, 40, 2), SCHEMA).repartition(3)
    assert found(T.repaired(turns, segment=segment, chars=chars, block=block)) == found(T.repaired(turns))


def test_a_conversation_of_all_rows(spark):
    turns = spark.range(6000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('Turn ', id, '.') AS text")
    (row,) = T.repaired(turns).collect()
    text = "\n".join(f"{'assistant' if k % 2 else 'user'}:Turn {k}." for k in range(6000))
    assert (row["cost"], row["audit"], row["gaps"], row["repaired_sha256"]) == (0, "K" * 6000, 0, hashlib.sha256(text.encode()).hexdigest())


def test_damage(spark):
    rows = [(k, t, "assistant", "A. B?") for k in (1, 2, None) for t in (*range(60), None)]
    want = []
    for k, t, role, text in rows:
        f = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
        if f:
            want += [(k, t, "user" if f == 4 else role, {1: "", 2: "A B"}.get(f, text))] * (2 if f == 3 else 1)
    assert sorted(map(str, map(tuple, T.damaged(spark.createDataFrame(rows, SCHEMA)).collect()))) == sorted(map(str, want))


def test_sql_on_faulty_rows(spark, tmp_path):
    rows = [*conversations(60, 12, 3), *[(99, None, None, None)] * 3, *((98, k, "user", "x" * 3_000_000) for k in range(2))]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, __text string, __at long")
    frame.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = T.op12_turn_repair(spark, str(tmp_path)), con.sql(T.OP12_SQL)
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
