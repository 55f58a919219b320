"""The jobs: reruns, growing input, limits to some runs, and awkward rows."""

import re

import pytest
from pyspark.sql import functions as F

from jobs import callset_release as R
from jobs import homopolymer_targets as H

CONFIG = {"columns": {c: c for c in R._NEEDED}, "false_positives": 1}
CALLS = "run string, locus_id string, ord long, probability double, label int, original_called boolean, stratum string, control boolean"


def rows_of(df, *without):
    return sorted((tuple(r) for r in df.drop(*without).collect()), key=repr)


def calls(spark, runs=("a", "b")):
    rows = [(r, f"l{k}", k, (k * 37 % 101) / 101, k % 3 % 2, k % 5 == 0, "HP" if k % 2 else "NON_HP", k % 4 > 0) for r in runs for k in range(60)]
    rows += [("a", "l7", 99, 0.995, 1, False, "HP", True), ("a", "l7", 98, 0.995, 1, False, "HP", True), (None, "l1", 1, 0.9, 1, True, "HP", True), ("a", None, 1, 0.9, 1, True, "HP", True), ("a", "null label", 1, 0.99, None, False, None, False), ("a", "null score", 1, None, 1, None, "HP", None)]
    return spark.createDataFrame(rows, CALLS)


def test_release_reruns_and_replaces_runs(spark, tmp_path):
    source, out = f"file://{tmp_path}/calls", f"file://{tmp_path}/out"
    calls(spark).write.parquet(source)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    first = rows_of(R.together(*R.release(spark, source, out, CONFIG)))
    assert rows_of(R.together(*R.release(spark, source, out, CONFIG))) == first and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    # Run b is delivered again with its scores turned round: only its partitions change, whatever the table has for a.
    again = calls(spark, ("b",)).where("run = 'b'").withColumn("probability", 1 - F.col("probability"))
    again.write.parquet(f"{source}2")
    second = R.together(*R.release(spark, f"{source}2", out, CONFIG, ["b"]))
    assert rows_of(second.where("run = 'a'")) == [r for r in first if "a" in r] and rows_of(second.where("run = 'b'")) != [r for r in first if "b" in r]


def test_release_keeps_budget_and_calls(spark):
    got = R.released(calls(spark).where("run IS NOT NULL AND locus_id IS NOT NULL"), 1)
    kept = [r.asDict() for r in got.collect()]
    assert len(kept) == len({(r["run"], r["locus_id"]) for r in kept})
    for run in ("a", "b"):
        mine = [r for r in kept if r["run"] == run]
        false = [r for r in mine if r["control"] and r["label"] == 0 and r["rescued"]]
        assert len(false) <= 1 and all(r["final_called"] for r in mine if r["original_called"]) and all(r["probability"] >= r["threshold"] for r in mine if r["rescued"])
        # One budget of threshold lower, and there would be a second one.
        left = sorted((r["probability"] for r in mine if r["control"] and r["label"] == 0 and not r["original_called"]), reverse=True)
        assert mine[0]["threshold"] > left[1]
    assert next(r for r in kept if r["run"] == "a" and r["locus_id"] == "l7")["ord"] == 98


def test_release_of_nothing_and_of_a_run_without_controls(spark, tmp_path):
    few = spark.createDataFrame([("c", "x", 1, 0.9, 1, False, "HP", False)], CALLS)
    assert [r["rescued"] for r in R.released(few, 1).collect()] == [False]
    few.limit(0).write.parquet(f"{tmp_path}/none")
    assert R.together(*R.release(spark, f"{tmp_path}/none", f"{tmp_path}/out", CONFIG)).count() == 0


def test_configs_are_checked(tmp_path):
    (tmp_path / "c.json").write_text('{"columns": {}, "false_positives": 1}')
    with pytest.raises(ValueError, match="lacks"):
        R.config_of(tmp_path / "c.json")
    with pytest.raises(ValueError, match="lacks"):
        H.config_of(tmp_path / "c.json")
    assert R.config_of() and H.config_of()


def plain_targets(rows, least, size):
    out = []
    for k, text, grp in rows:
        upper = (text or "").translate(str.maketrans("acgt", "ACGT"))
        for m in re.finditer(r"A+|C+|G+|T+", upper):
            if m.end() - m.start() >= least:
                piece = upper[m.start() // size * size :][:size]
                gc, at = sum(map(piece.count, "GC")), sum(map(piece.count, "AT"))
                out.append((None if k is None else str(k), grp, m.group()[0], m.start(), m.end(), m.end() - m.start(), gc / (gc + at)))
    return sorted(out, key=repr)


TEXTS = [(1, "ACGTTTTTAacc\n\U0001F600ggg", "x"), (2, None, "x"), (3, "", None), (4, "N" * 9 + "a" * 40, "y"), (None, "TTTT", "y"), (5, "no runs", "y"), (5, "AAAA", "y"), (5, "AAAA", "y"), (6, "C" * 10_000 + "é" + "G" * 8192, "y")]


@pytest.mark.parametrize("size", [1, 4, 7, 4096])
def test_targets_as_plain(spark, size):
    df = spark.createDataFrame([(k, t, g, "z") for k, t, g in TEXTS], "doc_id long, text string, lang string, base string").repartition(3)
    for least in (1, 3):
        assert rows_of(H.targets_of(df, {**H.config_of(), "piece": size, "min_run": least})) == plain_targets(TEXTS, least, size)


def test_targets_of_growing_input(spark, tmp_path):
    source, out, config = f"file://{tmp_path}/in", f"file://{tmp_path}/out", {**H.config_of(), "files_per_batch": 1}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame(TEXTS[:4]).coalesce(1).write.parquet(source)
    H.update(spark, source, out, config)
    wanted = lambda rows: plain_targets(rows, 2, 4096)
    targets = lambda: rows_of(H.output_of(spark, out).where("part = 'targets'").select("contig", "grp", "base", "start0", "end0", "length", "gc"))
    assert targets() == wanted(TEXTS[:4])
    files = {p.name for p in (tmp_path / "out" / "targets").rglob("*.parquet")}
    frame(TEXTS[4:]).repartition(2).write.mode("append").parquet(source)
    H.update(spark, source, out, config)
    assert targets() == wanted(TEXTS) and files < {p.name for p in (tmp_path / "out" / "targets").rglob("*.parquet")}
    after = rows_of(H.output_of(spark, out))
    H.update(spark, source, out, config)
    assert rows_of(H.output_of(spark, out)) == after
    counts = H.output_of(spark, out).where("part = 'counts'").agg(F.sum("runs"), F.sum("bases")).first()
    assert tuple(counts) == (len(wanted(TEXTS)), sum(r[5] for r in wanted(TEXTS)))


def test_a_batch_that_is_repeated_replaces_itself(spark, tmp_path):
    """The commit of a batch is lost after its writes: the next run takes it again, under its number."""
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").coalesce(1).write.parquet(source)
    H.update(spark, source, out, H.config_of())
    first = rows_of(H.output_of(spark, out))
    for p in (tmp_path / "out" / "checkpoint" / "commits").glob("*0*"):
        p.unlink()
    H.update(spark, source, out, H.config_of())
    assert rows_of(H.output_of(spark, out)) == first
