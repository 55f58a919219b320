"""Clashing extra columns in every table, and texts longer than a slice."""

import hashlib

import pytest

from seqweave.llm.queries import QUERIES

SAID = "the quick brown fox jumps over the lazy dog while fifteen other animals watch from a far away hill"
DOCS = [(k, f"{SAID}\nnumber {k} of many lines\n{'good' if k % 2 else 'bad'} text {k * 7919 % 1009}") for k in range(1, 41)]
LABELS = [(k, k % 2, (k + 1) % 2) for k in range(1, 41)]
BENCHMARK = [(1, SAID), (2, "nothing that any document says, in a sentence of more than thirteen words, at least not here")]
TALK = [(1, 0, "user", "Is it so? I think that it is, and have thought so for long."), (1, 1, "assistant", "> Is it so? I think that it is, and have thought so for long.\n\nYes."), (2, 0, "user", "Hi.")]


def write(spark, path, more):
    """The four tables, with extra columns of clashing names if asked for."""

    def table(name, rows, schema, extra):
        if more:
            rows, schema = [(*r, *("x" for _ in extra)) for r in rows], ", ".join([schema, *(f"{c} string" for c in extra)])
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")

    table("documents", DOCS, "doc_id long, text string", ["lang", "__text", "item_id", "conv_id", "toxic", "hash", "n"])
    table("labels", LABELS, "doc_id long, quality int, toxic int", ["text", "__id", "__label", "score", "held_out"])
    table("benchmark", BENCHMARK, "item_id long, text string", ["doc_id", "__text", "hash", "pos", "seed", "words", "n"])
    table("conversations", TALK, "conv_id long, turn long, role string, text string", ["doc_id", "__text", "hash", "pos", "line", "level", "flag", "n", "fault"])
    return str(path)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    return [write(spark, tmp_path_factory.mktemp("clash"), more) for more in (False, True)]


@pytest.mark.parametrize("name", ["op1_toxicity", "op4_quotation", "op6_decontamination", "op7_quality_classifier", "op12_turn_repair"])
def test_extra_columns_change_nothing(spark, both, name):
    plain, clashing = ([r.asDict() for r in QUERIES[name](spark, path).collect()] for path in both)
    assert plain and sorted(map(str, plain)) == sorted(map(str, clashing))


def test_a_text_longer_than_a_slice(spark, tmp_path):
    """4 MB in one text, alone in its slice, beside short ones and a null."""
    text = "\n".join(f"line {k} says {k * 7919 % 100_003} and all rights reserved" for k in range(95_000))
    assert len(text) > 4 << 20
    rows = [(1, "short"), (2, text), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    of = lambda name: {r["doc_id"]: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    words = len(text.split())
    scans, lines, prints = of("op10_license_scans"), of("op3_line_dedup"), of("op8_simhash")
    assert scans[2]["n_words"] == words and scans[2]["n_base"] == 95_000 and scans[2]["last_word"] == words - 3
    assert lines[2]["n_lines"] == 95_000 and lines[2]["n_dropped"] == 0 and lines[2]["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert len(prints) == 3 and of("op11_piecewise_hash")[2]["n_chars"] == len(text)
