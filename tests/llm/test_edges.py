"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest

from seqweave.llm import queries
from seqweave.llm.queries import QUERIES

PER_ROW = ["op1_toxicity", "op2_quality_rules", "op3_line_dedup", "op7_quality_classifier", "op8_simhash", "op9_lm_scoring", "op10_license_scans", "op11_piecewise_hash"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __text string, __id long"
LONG = "\n".join(f"line {i} of a long text with words {i * 7919 % 1009}" for i in range(20_000))
ROWS = [
    (1, None, None, None, None, None, None), (2, "", "en", "a", 0, "x", 1), (3, " \n\t\n", "en", "a", 4, "x", 1), (4, "one", "en", "a", 3, "x", 1), (5, LONG, "en", "a", len(LONG), "x", 1),
    (6, "a b c d e f g h\na b c d e f g h", "en", "a", 31, "x", 1), (7, "same text here for two rows", "en", "a", 9, "x", 1), (7, "same text here for two rows", "en", "a", 9, "x", 1),
    (None, "no id at all", None, None, None, None, None), (8, "\x00\x00 nul é中\U0001F600 <|endoftext|> All rights reserved", "en", "a", 9, "x", 1), (9, "#" * 5000, "en", "a", 5000, "x", 1),
]
LABELS = "doc_id long, quality int, toxic int"


def write(spark, path, docs, labels=(), benchmark=(), conversations=()):
    spark.createDataFrame(list(docs), DOCS).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(conversations), "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    labels = [(k, k % 2, (k + 1) % 2) for k in range(1, 9)] + [(None, None, None), (7, 1, None)]
    return write(spark, tmp_path_factory.mktemp("edges"), ROWS, labels, [(1, None), (2, ""), (3, "a few words")], [(1, 0, None, None), (None, None, "user", "> quoted"), (1, 1, "user", ">>>"), (1, 1, "user", ">>>")])


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("nothing"), [])


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_a_document(spark, edges, name):
    got = QUERIES[name](spark, edges).collect()
    assert len(got) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"}))
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0


@pytest.mark.parametrize("name", ["op4_quotation", "op5_packing", "op6_decontamination"])
def test_edge_rows_pass(spark, edges, name):
    got = QUERIES[name](spark, edges).collect()
    assert {"op4_quotation": len(got) == 4, "op5_packing": len(got) >= len(ROWS), "op6_decontamination": not got}[name]


def test_defined_values(spark, edges):
    rules = {r["doc_id"]: r for r in QUERIES["op2_quality_rules"](spark, edges).collect()}
    assert rules[1]["n_words"] == 0 and rules[1]["kept"] is False and rules[6]["n_dup_lines"] == 1 and rules[6]["n_repeat_words"] == 16
    lines = {r["doc_id"]: r for r in QUERIES["op3_line_dedup"](spark, edges).collect()}
    assert lines[1]["n_lines"] == 1 and lines[3]["n_lines"] == 3 and lines[5]["n_lines"] == 20_000
    prints = {r["doc_id"]: r for r in QUERIES["op8_simhash"](spark, edges).collect()}
    assert prints[1]["fingerprint"] == "0" * 16 and prints[3]["component_id"] == 1 and prints[7]["component_id"] == 7
    scores = {r["doc_id"]: r for r in QUERIES["op9_lm_scoring"](spark, edges).collect()}
    assert scores[1]["n_tokens"] == 1 and scores[1]["score"] <= 0
    found = {r["doc_id"]: r for r in QUERIES["op10_license_scans"](spark, edges).collect()}
    assert found[8]["base_labels"] == "reserved" and found[1]["labels"] == "" and found[1]["first_word"] is None


def test_repairs_of_edge_rows(spark, edges):
    got = {r["conv_id"]: r for r in QUERIES["op12_turn_repair"](spark, edges).collect()}
    assert set(got) == {1, None} and got[1]["cost"] >= 0 and got[None]["gaps"] == 0


def test_pipeline_on_edges(spark, edges):
    got = QUERIES["pipeline"](spark, edges).collect()
    assert all(r["length"] <= 2048 for r in got)


def test_every_operator_has_one_query():
    assert sorted(QUERIES) == sorted([*(n for n in QUERIES if n.startswith("op")), "pipeline"]) and len(QUERIES) == 13
    assert set(queries.ORACLES) <= set(QUERIES)
