"""Known answers for column functions."""

import random

import pytest
from pyspark.sql import functions as F

from seqweave.functions import alleles as A
from seqweave.functions import context as X
from seqweave.functions import reads as R
from seqweave.operators import genome as G


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def first(df):
    return df.first()[0]


@pytest.mark.parametrize(("name", "want"), [(" chrM ", "MT"), ("CHRx", "X"), ("chrUn_gl1", "Un_gl1"), ("chr", ""), ("7", "7")])
def test_canonical_chrom(spark, name, want):
    assert first(one(spark, c=name).select(A.canonical_chrom(F.col("c")))) == want


@pytest.mark.parametrize(("info", "want"), [("A=1;FUNC=x;y;B=2", "A=1"), ("FUNC=q", "."), ("A=1", "A=1")])
def test_sanitized_info(spark, info, want):
    assert first(one(spark, c=info).select(A.sanitized_info(F.col("c")))) == want


@pytest.mark.parametrize(("filters", "gt", "want"), [("PASS", "0/1", True), ("PASS", "0/0", False), ("NOCALL", "0/1", False), ("PASS", "./1", True), ("PASS", ".", False), ("PASS", None, False)])
def test_call_positive(spark, filters, gt, want):
    df = spark.createDataFrame([(filters, gt)], "f string, g string")
    assert first(df.select(A.call_positive(F.col("f"), F.col("g")))) is want


def test_filter_reason(spark):
    row = one(spark, r=".&PREDICTIONSHIFTx0.243571>0.2&STRINGENCY&QualityScore<12").select(*A.filter_reason(F.col("r"))).first()
    assert row["reason_prediction_shift_value"] == pytest.approx(0.243571)
    assert (row["reason_stringency"], row["reason_quality_score"], row["reason_coverage"]) == (1, 1, 0)


def test_ratio(spark):
    df = spark.createDataFrame([("1", "0"), ("x", "2"), ("3", "4")], "a string, b string")
    assert [r[0] for r in df.select(A.ratio(F.col("a"), F.col("b"))).collect()] == [None, None, 0.75]


def test_entropy(spark):
    assert first(one(spark, s="ACGTNNAAAC").select(F.round(X.entropy(F.lit("AACCGGTT")), 6))) == 2.0
    assert first(one(spark, s="NN").select(X.entropy(F.col("s")))) is None


def genome(spark, seq, contig="1", size=16):
    return spark.createDataFrame([(contig, k // size, seq[k : k + size]) for k in range(0, len(seq), size)], "contig string, chunk long, seq string")


@pytest.mark.parametrize(
    ("seq", "pos", "ref", "alt", "base", "ref_len", "alt_len", "hp"),
    [("CCCAAAAAGGG", 3, "CA", "C", "A", 5, 4, True), ("GAC", 1, "GA", "G", "A", 1, 0, False), ("TCCCCAG", 1, "T", "TC", "C", 4, 5, True), ("ACGT", 2, "C", "CTA", None, None, None, False)],
)
def test_context(spark, seq, pos, ref, alt, base, ref_len, alt_len, hp):
    rows = spark.createDataFrame([("1", pos, ref, alt)], "chrom string, pos int, ref string, alt string")
    got = G.with_context(rows, genome(spark, seq), size=16).first()
    assert (got["hp_base"], got["hp_ref_len"], got["hp_alt_len"], got["is_homopolymer_indel"]) == (base, ref_len, alt_len, hp)


def plain_normal(seq, pos, ref, alt):
    def trim(pos, ref, alt):
        while min(len(ref), len(alt)) > 1 and ref[-1] == alt[-1]:
            ref, alt = ref[:-1], alt[:-1]
        while min(len(ref), len(alt)) > 1 and ref[0] == alt[0]:
            pos, ref, alt = pos + 1, ref[1:], alt[1:]
        return pos, ref, alt

    now = trim(pos, ref, alt)
    while len(now[1]) != len(now[2]) and now[0] > 1:
        base = seq[now[0] - 2]
        new = trim(now[0] - 1, base + now[1], base + now[2])
        if new[0] >= now[0]:
            break
        now = new
    return now


def test_left_normalisation(spark):
    import random

    rng = random.Random(8)
    seq = "".join(rng.choice("AAC") for _ in range(300)) + "A" * 200
    rows = []
    for k in range(120):
        pos, n = rng.randint(1, 480), rng.randint(1, 4)
        if k % 2:
            ref, alt = seq[pos - 1], seq[pos - 1] + "".join(rng.choice("AC") for _ in range(n))
        else:
            ref, alt = seq[pos - 1 : pos + n], seq[pos - 1]
        rows.append((k, "1", pos, ref, alt))
    got = G.normalized(spark.createDataFrame(rows, "k int, chrom string, pos int, ref string, alt string"), genome(spark, seq), size=16, reach=8).collect()
    assert {r["k"]: (r["pos"], r["ref"], r["alt"]) for r in got} == {k: plain_normal(seq, p, r, a) for k, _, p, r, a in rows}


CIGAR = "array<struct<op:int,len:int>>"


def events(spark, cigar, seq, start=0, most=50):
    df = spark.createDataFrame([(cigar, seq, start)], f"cigar {CIGAR}, seq string, s int")
    return [(e["pos"], e["inserted"], e["deleted"]) for e in first(df.select(R.indel_events(R.placed(F.col("cigar"), F.col("s")), F.col("seq"), most)))]


def test_cigar_events(spark):
    assert events(spark, [(0, 3), (1, 1), (0, 4)], "AACTGTTA") == [(3, "T", None)]
    assert events(spark, [(0, 2), (2, 2), (0, 3)], "AATTA") == [(2, None, 2)]
    assert events(spark, [(0, 2), (3, 2), (0, 3)], "AATTA") == []
    assert events(spark, [(0, 2), (2, 60), (0, 3)], "AATTA") == []


def test_flow_walk(spark):
    df = one(spark, s="AACCCGTT", fo="TACG" * 4).withColumn("zm", F.expr("transform(sequence(0, 15), x -> cast(256 * case when x in (1, 4) then 2 when x = 2 then 3 else 1 end as smallint))"))
    table = first(df.select(R.flow_table(F.col("s"), F.col("fo"), F.lit(1), F.col("zm"))))
    assert [r["called"] for r in table] == [2, 3, 1, 2] and table[0]["flow_index"] == 1 and table[0]["flow_base"] == "A" and table[0]["query_start"] == 0 and [r["signal"] for r in table] == [2, 3, 1, 2]
    assert first(df.select(R.flow_table(F.col("s"), F.col("fo"), F.lit(16), F.col("zm")))) is None


def test_candidate_flow_distance(spark):
    rows = [(0, "A", 1.0, 1, 0, 1), (1, "C", 1.0, 4, 1, 5), (2, "A", 0.0, 0, 5, 5), (3, "G", 1.0, 1, 5, 6)]
    df = spark.createDataFrame([(rows,)], f"t array<{R.FLOW}>")
    at = lambda q, b: first(df.select(R.candidate_flow(F.col("t"), F.lit(q), F.lit(b))))
    assert at(5, "A") == 2 and at(0, "A") == 0 and at(3, "A") == 2 and at(2, "A") == 0 and at(5, "T") is None
    assert at(9, "C") is None and at(7, "C") == 1


def test_burdens_half_open(spark):
    df = spark.createDataFrame([([(0, 4), (1, 3), (0, 4)], "ACGTTTTACGA")], f"c {CIGAR}, s string")
    made = lambda end: first(df.select(R.burdens(R.placed(F.col("c"), F.lit(0)), F.col("s"), F.lit("ACGTACGT"[:end]), F.lit(0), F.lit(end))))
    assert made(4)["indel"] == 0.0 and made(8)["indel"] == pytest.approx(3 / 11) and made(8)["mismatch"] == pytest.approx(1 / 8)


def test_flow_tables_of_many_reads():
    import random

    import pyarrow as pa

    def plain(seq, order, zf, zm):
        if None in (seq, order, zf) or zm is None or not 0 <= zf < min(len(order), len(zm)):
            return None
        rows = []
        for k in range(zf, min(len(order), len(zm))):
            left = seq.lstrip(order[k].upper())
            rows.append((k, order[k].upper(), zm[k] / 256, len(seq) - len(left)))
            seq = left
            if not seq:
                break
        return rows

    rng = random.Random(1)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    for size in (0, 1, 300):
        rows = [(rng.choice([None, some(12, "ACGTN"), "AAACC"]), rng.choice([None, "TACG" * rng.randint(0, 6), "tacgTG"]), rng.choice([None, 0, 1, 3, 30, -1]), rng.choice([None, [rng.randint(-5, 700) for _ in range(rng.randint(0, 24))]])) for _ in range(size)]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int16()))
        got = R._walked(*(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))).to_pylist()
        assert [g and [(x["flow_index"], x["flow_base"], x["signal"], x["called"]) for x in g] for g in got] == [plain(*r) for r in rows]
        assert all(x["query_end"] - x["query_start"] == x["called"] for g in got if g for x in g)


@pytest.fixture(scope="module")
def odd_flows(spark):
    """Reads with missing parts, without bases, with short signals, orders of several kinds and places outside."""
    rng, rows = random.Random(5), []
    for k in range(2000):
        seq = rng.choice([None, "", "ACGTN", "acg"]) if k % 9 == 0 else "".join(b * rng.choice([1, 1, 2, 5]) for b in rng.choices("ACGT", k=rng.randint(1, 12)))
        order = None if k % 31 == 1 else rng.choice(["TACG" * 8, "tacg" * 8, "TTACGGA" * 5, "A", ""])
        rows.append((k, seq, order, None if k % 29 == 2 else rng.choice([0, 0, 1, 3, 40, -1]), None if k % 23 == 3 else [rng.randint(-5, 600) for _ in range(rng.choice([0, 1, 6, 32, 40]))], None if k % 19 == 4 else rng.randint(-3, 20), rng.choice(["A", "t", "G", None, "", "AC"])))
    return spark.createDataFrame(rows, "k long, seq string, fo string, zf int, zm array<short>, p int, b string").repartition(3)


def test_the_walk_tells_what_the_table_tells(spark, odd_flows):
    c, given = F.col, (F.col("seq"), F.col("fo"), F.col("zf"), F.col("zm"))
    made = odd_flows.withColumn("t", R.flow_table(*given)).localCheckpoint()
    made = made.withColumns({"place": R.candidate_flow(c("t"), c("p"), c("b"))}).localCheckpoint()
    said = made.select("k", "place", R.reconstructed(c("t")).alias("rebuilt"), R.offset_signals(c("t"), c("place"), 3).alias("x"), R.neighbour_noise(c("t"), c("place"), 3).alias("noise"), R.offset_signals(c("t"), c("p"), 2).alias("y"), R.neighbour_noise(c("t"), c("p"), 2).alias("other"))
    own, evidence, near = made.select("*", R.flow_used(*given).alias("used"), R.flow_place(*given, c("p"), c("b")).alias("at")), R.flow_evidence(*given, c("p"), c("b"), 3), R.flow_near(*given, c("p"), 2)
    own = own.select("k", "at", "used", F.left("seq", c("used")).alias("rebuilt"), evidence.alias("e"), near.alias("n"))
    told = {r["k"]: r for r in said.collect()}
    found = 0
    for r in own.collect():
        want, e, n = told[r["k"]], r["e"], r["n"]
        assert (r["at"], r["rebuilt"]) == (want["place"], want["rebuilt"]) and (e["place"], e["used"]) == (want["place"], r["used"])
        assert (list(e["signals"]), e["noise"]) == (list(want["x"]), want["noise"])
        assert (list(n["signals"]), n["noise"]) == (list(want["y"]), want["other"])
        found += want["place"] is not None
    assert found > 50


def test_flow_rows_are_those_of_the_tables(spark, odd_flows):
    given = (F.col("seq"), F.col("fo"), F.col("zf"), F.col("zm"))
    rows = odd_flows.select("k", F.inline_outer(R.flow_table(*given))).where("flow_index IS NOT NULL")
    got = R.flow_rows(odd_flows, "k", *given)
    assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("name", ["candidate_flow", "flow_offsets", "flow_reconstruct", "flow_decode"])
def test_flow_queries_make_no_tables(spark, tmp_path, name):
    """Flow tables of all reads don't go back to the JVM as arrays, whose lambdas took most of the time; one walk a read."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from seqweave.plans import sequence_queries as Q

    pq.write_table(pa.table({"l_orderkey": [1, 2, 3], "l_partkey": [4, 5, 6], "l_suppkey": [7, 8, 9], "l_linenumber": pa.array([1, 2, 3], pa.int32()), "l_quantity": [1.0, 2.0, 3.0], "l_discount": [0.1, 0.2, 0.3]}), tmp_path / "lineitem.parquet")
    plan = Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Generate" not in plan
    assert len([x for x in plan.splitlines() if "ArrowEvalPython" in x or "MapInArrow" in x]) == 1
