"""Running sums and quantiles over ranges, against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.operators import calls as C
from seqweave.operators import metrics as M
from seqweave.operators.ranges import quantiles, running


@pytest.fixture(scope="module")
def rows():
    """A hot group, small ones, a null one, ties, nulls and NaN-free negatives."""
    rng = random.Random(3)
    names = ["hot"] * 600 + ["a", "b", None] * 20 + ["one"]
    return [(g, rng.choice([-0.0, 0.0, None, rng.randint(-9, 9) / 4, rng.random()]), k) for k, g in enumerate(names)]


def groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_running(spark, rows, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == 1)
    try:
        df = spark.createDataFrame(rows, "g string, v double, k int").repartition(parts)
        got = {r["k"]: (r["s"], r["n"]) for r in running(df.withColumn("one", F.lit(1)), ["g"], [F.col("k").desc()], {"s": "k"}, {"n": "one"}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    for members in groups(rows).values():
        for r in members:
            assert got[r[2]] == (sum(x[2] for x in members if x[2] >= r[2]), len(members))


def test_quantiles(spark, rows):
    shares = {"low": 0.025, "q1": 0.25, "mid": 0.5, "top": 1.0}
    df = spark.createDataFrame(rows, "g string, v double, k int")
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", shares).collect()}
    for g, members in groups(rows).items():
        values = [r[1] for r in members if r[1] is not None]
        assert (g in got) == bool(values)
        for name, share in shares.items() if values else ():
            assert got[g][name] == pytest.approx(np.quantile(values, share), abs=1e-12)
    assert quantiles(df.where("false"), ["g"], "v", shares).count() == 0
    whole = quantiles(df, [], "v", {"mid": 0.5}).first()["mid"]
    assert whole == pytest.approx(np.median([r[1] for r in rows if r[1] is not None]), abs=1e-12)


@pytest.mark.parametrize("most", [1, 2, 3, 10, 97])
def test_evenly(spark, rows, most):
    df = spark.createDataFrame(rows, "g string, v double, k int")
    got = sorted(r["k"] for r in C.evenly(df, ["g"], ["k"], most).collect())
    want = []
    for members in groups(rows).values():
        ks = sorted(r[2] for r in members)
        n = len(ks)
        want += ks if n <= most else [ks[p] for p in sorted({round(i * (n - 1) / max(most - 1, 1)) for i in range(most)})]
    assert got == sorted(want)


def test_average_precision_of_a_null_group(spark):
    rng = random.Random(4)
    scored = [(g, rng.randint(0, 1), rng.randint(0, 9) / 10) for g in ["a", None] for _ in range(80)] + [("none", 0, 0.5)]
    got = {r["g"]: r["average_precision"] for r in M.average_precision(spark.createDataFrame(scored, "g string, label int, probability double"), ["g"]).collect()}
    for g in ("a", None):
        mine = [(p, y) for h, y, p in scored if h == g]
        total, before, area = sum(y for _, y in mine), 0, 0.0
        for t in sorted({p for p, _ in mine}, reverse=True):
            hits = sum(y for p, y in mine if p >= t)
            area += (hits - before) / total * hits / sum(p >= t for p, _ in mine)
            before = hits
        assert got[g] == pytest.approx(area)
    assert got["none"] is None


def test_control_deltas(spark):
    frame = spark.createDataFrame([("x", "HG002", 1.0, "7"), ("x", "HG002", 4.0, "?"), ("x", "AOHC", 10.0, "9"), ("y", "AOHC", 3.0, "1"), (None, "HG002", 5.0, "2")], "locus_id string, truth_profile string, vcf_A double, bam_B string")
    got = {(r["locus_id"], r["vcf_A"]): r for r in C.with_control_deltas(frame, ["vcf_A", "bam_B"]).collect()}
    assert got["x", 10.0]["paired_delta__vcf_A"] == 7.5 and got["x", 10.0]["paired_delta__bam_B"] == 2.0 and got["x", 4.0]["paired_delta__bam_B"] is None
    assert got["y", 3.0]["na_median__vcf_A"] is None and got[None, 5.0]["paired_delta__vcf_A"] is None
    assert C.with_control_deltas(frame, []).columns == frame.columns
