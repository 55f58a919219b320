"""Recall of the pipeline's near-duplicate stage by similarity, on planted pairs."""

import random

import pytest

import corpus_pipeline
from seqweave.llm import simhash

SIMILARITIES = (0.8, 0.85, 0.9, 0.95)


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def planted(rng, least, most):
    """Two word lists with a Jaccard similarity in the range."""
    while True:
        a = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(150, 500))]
        b = a[:]
        while jaccard(a, b) >= most:
            b[rng.randrange(len(b))] = f"x{rng.randint(0, 10**6)}"
        if jaccard(a, b) >= least:
            return a, b


@pytest.mark.parametrize("similarity", SIMILARITIES)
def test_recall_of_planted_pairs(spark, similarity):
    rng = random.Random(int(similarity * 100))
    pairs = [planted(rng, similarity, similarity + 0.02) for _ in range(100)]
    rows = [(2 * k + j, " ".join(w)) for k, pair in enumerate(pairs) for j, w in enumerate(pair)]
    apart = [planted(rng, 0.6, 0.78) for _ in range(30)]
    rows += [(1000 + 2 * k + j, " ".join(w)) for k, pair in enumerate(apart) for j, w in enumerate(pair)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    c = corpus_pipeline
    gone = {r[0] for r in simhash.verified_copies(df, "doc_id", "text", c.SHINGLE, c.RADIUS, c.PARTS, c.SIMILARITY, c.BANDS, c.LEAST).collect()}
    assert not {k for k in gone if k >= 1000 or k % 2 == 0}
    assert len(gone) >= 95


def test_bands_alone_find_what_prints_miss(spark):
    rng = random.Random(9)
    a, b = planted(rng, 0.8, 0.82)
    far = [(1, " ".join(a)), (2, " ".join(b)), (3, ""), (4, None), (5, "one")]
    df = spark.createDataFrame(far, "doc_id long, text string")
    found = lambda **more: {r["doc_id"]: r["__component"] for r in simhash.near_duplicates(df, shingle=5, radius=0, parts=2, **more).collect()}
    assert found() == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5} and found(bands=12) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
