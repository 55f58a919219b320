"""Piecewise hashing against plain rewritings."""

import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqweave.llm import piecewise_hash as P

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi é中".split()


def plain_fingerprint(text):
    """Byte by byte, block size by block size."""
    raw = text.encode()
    ends = []
    for t in range(len(raw)):
        h = sum((raw[t - i] + 1) * pow(P._PRIME, i, 1 << 32) for i in range(min(P.WINDOW, t + 1))) % (1 << 32)
        h ^= h >> 15
        h = h * 0x85EBCA6B % (1 << 32)
        ends.append(h ^ (h >> 13))

    def signature(k):
        out, start = [], 0
        for t in range(len(raw)):
            if ends[t] % (3 << k) == (3 << k) - 1 or t == len(raw) - 1:
                h = sum((b + 1) * pow(P._BASE, i, 1 << 64) for i, b in enumerate(raw[start : t + 1])) + t + 1 - start
                h %= 1 << 64
                h = (h ^ (h >> 33)) * int(P._MIX) % (1 << 64)
                out.append(chr(P.ALPHABET[h >> 58]))
                start = t + 1
        return "".join(out)

    k = next(k for k in range(40) if len(signature(k)) <= P.MOST)
    return f"{3 << k}:{signature(k)}:{signature(k + 1)}"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def plain_likeness(x, y):
    if x == y:
        return 1.0
    (p, *a), (q, *b) = x.split(":"), y.split(":")
    sizes = {int(p): a[0], 2 * int(p): a[1]}
    best = 0.0
    for size, v in ((int(q), b[0]), (2 * int(q), b[1])):
        u = sizes.get(size, "")
        run = max(1, min(P.GATE, min(len(u), len(v)) // 2))
        if any(u[i : i + run] in v for i in range(len(u) - run + 1)):
            best = max(best, 1 - plain_distance(u, v) / max(len(u), len(v)))
    return best


@given(st.lists(st.one_of(st.text(max_size=300), st.tuples(st.text(min_size=1, max_size=4), st.integers(1, 300)).map(lambda x: x[0] * x[1])), max_size=5))
@settings(max_examples=40, deadline=None)
def test_fingerprints(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["", "x"]
    assert P.fingerprints_of(pa.array(texts)).to_pylist() == [plain_fingerprint(t) for t in texts]


@given(st.lists(st.tuples(st.text("ABC", max_size=64), st.text("ABCD", max_size=64)), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_edit_distances(pairs):
    (a, n), (b, m) = (P._packed([p[k].encode() for p in pairs]) for k in (0, 1))
    assert P.distances(a, n, b, m).tolist() == [plain_distance(*p) for p in pairs]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_likeness_follows_what_texts_share():
    rng = random.Random(4)
    for n in (30, 200, 3000):
        a, b = text(rng, n), "".join(chr(rng.randint(97, 122)) for _ in range(6 * n))
        one, half, moved, other = P.fingerprints_of(pa.array([a, a[: len(a) // 2] + b[: len(b) // 2], "put before " + a, b]))
        near = lambda x: P.likeness(pa.array([one]), pa.array([x]))[0]  # noqa: E731, B023
        assert near(one) == 1 and 0.2 < near(half) < 0.8 and near(moved) > 0.8 and near(other) < 0.2


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_neighbours_as_brute_force(spark, partitions):
    rng = random.Random(5)
    rows = [(k, text(rng, rng.choice([0, 1, 3, 60, 400]))) for k in range(40)] + [(7, "a second row of one id"), (None, "no id"), (50, None), (51, "many " * 2000), (52, "z" * (3 << 20))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = P.neighbours(spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, __text string, __id string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    from xxhash import xxh64_intdigest

    signed = lambda t: (h := xxh64_intdigest((t or "").encode(), 42)) - (h >> 63 << 64) if t is not None else 42
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])), reverse=True)
    want = []
    for (k, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        prints = P.fingerprints_of(pa.array([t, edited, u])).to_pylist()
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints[:2], plain_likeness(*prints[:2]), plain_likeness(prints[0], prints[2])))
    key = lambda r: (str(r[0]), r[2])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_compared_columns(spark):
    docs = spark.createDataFrame([(1, "one text and another"), (2, None)], "k int, text string")
    prints = P.fingerprints(docs, ["k"])
    assert {r["k"]: r["__fingerprint"] for r in prints.collect()} == {1: plain_fingerprint("one text and another"), 2: "3::"}
    pairs = spark.createDataFrame([("3:ab:a", "3:ab:a"), ("3:ab:a", None)], "a string, b string")
    assert [r["__likeness"] for r in P.compared(pairs, "a", "b").collect()] == [1.0, None]
