"""Whole licences as templates: exact counts by steps, bounded memory, and texts of a folder."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from seqweave.llm import licenses


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(1, 4)), max_size=40), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_sliding_counts(rows, width):
    q = np.array([a for a, _ in rows], np.int64)
    v = np.cumsum([b for _, b in rows]).astype(np.int64)
    until = np.searchsorted(v, v + width)
    assert licenses._least(q, until).tolist() == [min(q[i:u]) for i, u in enumerate(until)]
    assert licenses._different(q, until).tolist() == [len(set(q[i:u].tolist())) for i, u in enumerate(until)]


def long_licence(seed, n):
    rng = random.Random(seed)
    return " ".join(f"clause{min(int(rng.paretovariate(0.6)), 1500)}" for _ in range(n))


def test_a_long_template_needs_little_memory():
    """5,600 words, as the longest common licences have, within a text of half a million."""
    licence = long_licence(1, 5600)
    text = long_licence(2, 250_000) + " " + licence + " " + long_licence(3, 250_000)
    templates = licenses.TEMPLATES | {"long": licence}
    ordered = licenses.Templates(templates, {w: 1 for w in licenses._word_list(templates)})
    tracemalloc.start()
    got = licenses.scan(pa.array([text, licence, long_licence(4, 900)]), ordered)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    assert [x.split(",") for x in got[5].to_pylist()][:2] == [["long"], ["long"]] and got[6].to_pylist()[:2] == [1.0, 1.0] and got[5].to_pylist()[2] == ""


def test_index_keeps_what_every_template_alone_finds():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    templates = {f"t{k}": " ".join(rng.choices(words, k=rng.randint(3, 25))) for k in range(40)}
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)] + [templates["t3"], templates["t9"] + " " + templates["t4"]]
    counts = {w: sum(w.decode() in t.split() for t in texts) for w in licenses._word_list(templates)}
    together = licenses.scan(pa.array(texts), licenses.Templates(templates, counts))
    alone = [licenses.scan(pa.array(texts), licenses.Templates({k: v}, {w: counts[w] for w in licenses._word_list({k: v})}))[5].to_pylist() for k, v in templates.items()]
    assert together[5].to_pylist() == [",".join(sorted(x for x in column if x)) for column in zip(*alone, strict=True)]


def test_templates_of_a_folder(spark, tmp_path):
    """Whole licence texts are read by Spark and scanned over a table; a template without words meets nothing."""
    licence = long_licence(7, 400)
    (tmp_path / "one-1.0.txt").write_text(licence)
    (tmp_path / "blank").write_text(" \n")
    templates = licenses.read_templates(spark, str(tmp_path))
    assert templates == {"one-1.0": licence, "blank": " \n"}
    docs = spark.createDataFrame([(1, "before " + licence.replace(" ", "\n* ") + " after"), (2, licence[: len(licence) // 2]), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scanned(docs, ["doc_id"], templates=templates).collect()}
    assert got[1] == ("one-1.0", 1.0) and got[2][0] == "" and got[3] == ("", 0.0)
