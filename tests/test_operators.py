"""Interval, metric and fold operators."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqweave.operators import calls as C
from seqweave.operators import folds, intervals
from seqweave.operators import metrics as M

SPANS = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)), min_size=1, max_size=12)


def table(spark, rows):
    return spark.createDataFrame([("1", a, b) for a, b in rows], "contig string, start long, end long")


def test_merge(spark):
    got = intervals.merged(table(spark, [(10, 20), (20, 30), (5, 5), (40, 41)])).collect()
    assert sorted((r["start"], r["end"]) for r in got) == [(10, 30), (40, 41)]


@given(SPANS, SPANS)
@settings(max_examples=4, deadline=None)
def test_joins_match_brute_force(spark, a, b):
    a, b = [(s, s + n) for s, n in a], [(s, s + n) for s, n in b]
    merged = intervals.merged(table(spark, b))
    plain = [(r["start"], r["end"]) for r in merged.collect()]
    assert intervals.merged(merged).count() == len(plain)
    q = spark.createDataFrame([(k, "1", s, e) for k, (s, e) in enumerate(a)], "k int, contig string, a long, b long")
    inside = {r["k"] for r in intervals.joined(q, merged, "left_semi", True, "a", "b", width=7).collect()}
    assert inside == {k for k, (s, e) in enumerate(a) if any(x <= s and y >= max(e, s + 1) for x, y in plain)}
    over = sorted((r["k"], r["__s"]) for r in intervals.joined(q, merged, "inner", False, "a", "b", width=7).collect())
    assert over == sorted((k, x) for k, (s, e) in enumerate(a) for x, y in plain if x < e and y > s)


def scored(spark, labels, scores, called=None):
    called = called or [False] * len(labels)
    return spark.createDataFrame([(1, y, float(p), c) for y, p, c in zip(labels, scores, called, strict=True)], "g int, label int, probability double, original_called boolean")


def test_thresholds(spark):
    df = scored(spark, [1, 1, 0, 0], [0.95, 0.8, 0.7, 0.2])
    assert M.fp_budget_threshold(df, ["g"], 0).first()["threshold"] == 0.8
    none = scored(spark, [0, 1], [0.9, 0.5])
    assert M.fp_budget_threshold(none, ["g"], 0).first()["threshold"] == math.nextafter(0.9, math.inf)
    assert M.fp_budget_threshold(scored(spark, [1], [0.5], [True]), ["g"], 0, called="original_called").first()["threshold"] == math.inf


def test_addon_never_loses_a_call(spark):
    rows = M.addon_calls(scored(spark, [1, 1, 0], [0.01, 0.9, 0.1], [True, False, False]), F.lit(0.5)).collect()
    assert [r["rescued"] for r in rows] == [False, True, False] and [r["final_called"] for r in rows] == [True, True, False]


def test_average_precision_with_missed_truth(spark):
    df = spark.createDataFrame([("a", 1, 0.9, 1), ("b", 0, 0.8, 1)], "k string, label int, probability double, g int")
    truth = spark.createDataFrame([("a", 1), ("c", 1)], "k string, g int")
    assert M.average_precision(df, ["g"]).first()[1] == 1.0
    assert M.end_to_end_average_precision(df, truth, ["k", "g"], ["g"]).first()["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_published_counts(spark):
    """Rates from the published confusion counts."""
    rows = [("HP", True, k < 2) for k in range(20)] + [("NON_HP", True, k < 35) for k in range(44)] + [("NON_HP", False, True)]
    df = spark.createDataFrame(rows, "evaluation_stratum string, is_truth boolean, called boolean")
    got = {r["evaluation_stratum"]: r for r in M.strata_metrics(df, {"ORIGINAL": "called"}).collect()}
    assert (got["ALL"]["TP"], got["ALL"]["FP"], got["ALL"]["FN"]) == (37, 1, 27) and got["ALL"]["sensitivity"] == 0.578125 and got["ALL"]["precision"] == pytest.approx(0.9736842105)
    assert got["HP"]["sensitivity"] == 0.1 and got["NON_HP"]["sensitivity"] == pytest.approx(0.7954545455)


def test_even_sample(spark):
    df = spark.range(5).selectExpr("1 AS g", "id")
    assert sorted(r["id"] for r in C.evenly(df, ["g"], ["id"], 3).collect()) == [0, 2, 4]
    assert sorted(r["id"] for r in C.evenly(spark.range(6).selectExpr("1 AS g", "id"), ["g"], ["id"], 3).collect()) == [0, 2, 5]
    assert C.evenly(df, ["g"], ["id"], 0).count() == 5


def test_folds_keep_loci_apart(spark):
    rows = [(f"p{k}", 1) for k in range(3)] * 2 + [(f"n{k}", 0) for k in range(3)] * 2
    df = spark.createDataFrame(rows, "locus_id string, label int")
    out = folds.locus_folds(df, 5).collect()
    assert len({r["fold"] for r in out}) == 3 and len({(r["locus_id"], r["fold"]) for r in out}) == 6
    split = folds.locus_split(df, 0.25).collect()
    assert {(r["split"], r["label"]) for r in split} == {("train", 0), ("train", 1), ("test", 0), ("test", 1)} and len({(r["locus_id"], r["split"]) for r in split}) == 6
    with pytest.raises(ValueError):
        folds.locus_folds(df.where("label = 1"))


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5), (1, 6)], "k int, v int")
    with pytest.raises(ValueError):
        M.one_to_one(a, b, ["k"])


def test_thresholds_that_no_score_reaches_are_null_in_the_queries(spark, tmp_path):
    """More negatives at the highest score than the budget: the SQL has no threshold there."""
    import duckdb

    from seqweave.plans import metric_queries as Q

    # One order and line, so one score, of 60 loci; a second run keeps its budget.
    rows = [(1, k, 1, "N", "O", 0.0) for k in range(60)] + [(k, 5 * k, 2, "N", "O", 0.0) for k in range(40)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_tax double").withColumn("l_shipdate", F.lit("1994-01-01").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    for name in ("fp_budget_threshold", "addon_threshold"):
        got = {r["run"]: r["threshold"] for r in Q.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == dict(duck.sql(Q.SQL[name]).fetchall()) and got[1] is None and got[2] is not None
