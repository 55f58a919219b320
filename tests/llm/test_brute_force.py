"""Operators against plain rewritings, round trips and held-out accuracy, on small tables."""

import random
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from seqweave.llm import decontamination, hmm, labelled, licenses, line_dedup, packing, quality_classifier, quality_rules, quotation, simhash, toxicity
from seqweave.llm.common import SPACE_SPLIT_LOWER, split_words

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ANY_TEXT = st.lists(st.text(st.sampled_from("abAB \t\n\x0b\x00.é中'<|>19"), max_size=40), max_size=8)


@given(ANY_TEXT)
@settings(max_examples=60, deadline=None)
def test_words(texts):
    words = split_words(pa.array(texts, pa.string()), SPACE_SPLIT_LOWER)
    codes, names = words.coded()
    got = [[names[c].as_py() for c in codes[a:b]] for a, b in pairwise(words.docs.tolist())]
    assert got == [t.encode().translate(LOWER).split() for t in texts]


def plain_repeats(words, window):
    covered, longest = set(), 0
    for n in range(1, len(words)):
        at = {}
        for i in range(len(words) - n + 1):
            at.setdefault(tuple(words[i : i + n]), []).append(i)
        twice = [i for v in at.values() if len(v) > 1 for i in v]
        if not twice:
            break
        longest = n
        if n == window:
            covered = {i + k for i in twice for k in range(n)}
    return len(covered), longest


@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_suffix_array_repeats(texts):
    found = quality_rules.measures(pa.array([" ".join("abc"[x] for x in t) for t in texts]), quality_rules.Rules(window=4))
    for d, t in enumerate(texts):
        assert (found["n_repeat_words"][d], found["longest_repeat"][d]) == plain_repeats(t, 4)


def test_very_long_repetitive_texts():
    found = quality_rules.measures(pa.array(["a b c " * 60_000, "one two", "x " * 100_000]), quality_rules.Rules())
    assert found["n_repeat_words"].tolist() == [180_000, 0, 100_000] and found["longest_repeat"].tolist() == [179_997, 0, 99_999] and not found["kept"].any()


def test_line_runs_levels_and_batches(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", fan_in=2)
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "text string")
    seen = Counter()
    for k in range(5):
        batch = [f"shared\nown {k} {j}\n Often " if j % 2 else f"own {k} {j}" for j in range(4)]
        got = sorted(r[0] for r in runs.admit(frame(batch), at_least=3).select("text").collect())
        gone = {x for x, n in seen.items() if n >= 3}
        assert got == sorted("\n".join(x for x in t.split("\n") if x.strip().lower() not in gone) for t in batch)
        seen.update(x for t in batch for x in {y.strip().lower() for y in t.split("\n")})
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {r[0]: r[1] for r in runs._merged([r for level in runs.levels for r in level]).groupBy("__n").count().collect()}[10] == 2


def test_best_two_fit_keeps_all_and_packs_tightly():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 200, 5000), minlength=257)
    plan = packing.best_two_fit(counts, 256)
    used = np.zeros_like(counts)
    for lengths, times in plan:
        assert sum(lengths) <= 256 and times > 0
        for n in lengths:
            used[n] += times
    assert (used == counts).all()
    assert sum(t for _, t in plan) <= -(-int((counts * np.arange(257)).sum()) // 256) * 1.01 + 1
    # 6 + 3 leaves a gap of 1; two pieces of 2 fill the place of the 3.
    assert sorted(packing.best_two_fit(np.bincount([6, 3, 2, 2], minlength=11), 10)[0][0]) == [2, 2, 6]


def test_packing_round_trip(spark):
    rng = random.Random(2)
    texts = [(k, " ".join(rng.choice(["alpha", "Beta,", "naïve", "don't", "42", "…"]) for _ in range(rng.randint(0, 900)))) for k in range(60)]
    rows = packing.packed(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"], capacity=256, with_ids=True).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for k, t in texts:
        pieces = sorted((r["__piece"], r["__start"], r["__ids"]) for r in rows if r["doc_id"] == k)
        whole = [i for p in pieces for i in p[2]]
        assert whole == [*tokenizer.encode(t, add_special_tokens=False).ids, 0] and all(len(p[2]) == 256 for p in pieces[:-1])
    by = {}
    for r in rows:
        by.setdefault(r["__sequence"], []).append((r["__offset"], r["__length"]))
    for v in by.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(v)) and sum(n for _, n in v) <= 256


@given(ANY_TEXT)
@settings(max_examples=25, deadline=None)
def test_encoder_is_the_tokenizer(texts):
    encoder = packing.Encoder(packing.tokenizer_path())
    texts = [*texts, "a<|endoftext|>b", "X<|ENDOFTEXT|>'LL", ",é,"]
    ids, bounds = encoder.ids(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in pairwise(bounds.tolist())] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_bit_sliced_blocks():
    rng = np.random.default_rng(3)
    for radius in (0, 3, 4, 6):
        centres = rng.integers(0, 1 << 63, 40).astype(np.uint64)
        fp = np.concatenate([centres, *(centres ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(4)), rng.integers(0, 1 << 63, 100).astype(np.uint64)])
        fp = np.unique(fp)
        block = np.sort(rng.integers(0, 3, len(fp)))
        a, b = simhash.block_links(fp, block, radius)
        place = {int(x): i for i, x in enumerate(fp)}
        near = [(i, j) for i in range(len(fp)) for j in range(i) if block[i] == block[j] and int(fp[i] ^ fp[j]).bit_count() <= radius]
        group = lambda pairs: simhash._roots(len(fp), np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)).tolist()
        assert group(near) == group([(place[int(x)], place[int(y)]) for x, y in zip(a, b, strict=True)])


def test_simhash_components_with_split_blocks(spark, tmp_path):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), 4, 6, f"file://{tmp_path}/links", most=16)
    roots = {r["node"]: r["root"] for r in simhash.components(edges, f"file://{tmp_path}/roots").collect()}
    flat = [x[0] for x in signed]
    near = [(i, j) for i in range(len(flat)) for j in range(i) if bin((flat[i] ^ flat[j]) & (1 << 64) - 1).count("1") <= 4]
    want = simhash._roots(len(flat), np.array([p[0] for p in near]), np.array([p[1] for p in near]))
    got = [roots.get(x, x) for x in flat]
    assert [[a == b for b in want] for a in want] == [[a == b for b in got] for a in got]


def test_verified_copies(spark):
    rng = random.Random(9)
    base = [f"word{rng.randrange(900)}" for _ in range(300)]
    docs = [(1, base), (2, base), (3, [*base[:150], "other", *base[151:]]), (4, [f"word{rng.randrange(900)}" for _ in range(300)]), (5, []), (6, [])]
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    assert {r[0] for r in simhash.verified_copies(rows, "doc_id", "text", 5, 7, 9, 0.8).collect()} == {2, 3, 6}


@given(st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=7), st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=7), st.sampled_from([0.3, 0.5, 0.8, 1.0]))
@settings(max_examples=80, deadline=None)
def test_leaders_find_all_similar_sets(first, others, similarity):
    sets = lambda lists: [{tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} for w in lists]
    texts = lambda lists: pa.array([" ".join("abcd"[x] for x in w) for w in lists], pa.string())
    leaders = simhash.Leaders(similarity)
    h, at = simhash.shingle_sets(texts(first), 2)
    for s, e in pairwise(at.tolist()):
        leaders.add(h[s:e])
    want = [any(len(a & b) >= similarity * len(a | b) - 1e-9 for b in sets(first)) for a in sets(others)]
    assert leaders.like(*simhash.shingle_sets(texts(others), 2)).tolist() == want


def test_verified_copies_unlike_the_head(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    word = lambda: f"word{rng.randrange(900)}"
    base = [word() for _ in range(300)]
    changed = lambda w, *places: [word() if k in places else x for k, x in enumerate(w)]
    # a and b are linked but under 0.8; near is at least 0.8 to b only; a family drifts, each text like the next one only.
    b = changed(base, *range(5, 300, 35))
    docs = [(1, base), (2, b), (3, b), (4, changed(b, 150)), (5, b), (5, base)]
    drift = [word() for _ in range(300)]
    for k in range(12):
        docs += [(10 + 2 * k, drift), (11 + 2 * k, drift)]
        drift = changed(drift, *range(10 + 2 * k, 300, 60))
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    # All in one component, whatever the fingerprints say.
    linked = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a: linked(*a).withColumn("__component", F.lit(1).cast("long")))
    sets = [(k, " ".join(w), {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for k, w in docs]
    kept: dict = {}
    for k, t, s in sorted(sets, key=lambda x: x[0]):
        if all(len(s & o) / len(s | o) < 0.8 for _, o in kept.values()):
            kept[t] = (k, s)
    stay = {k for k, _ in kept.values()}
    assert {1, 2} <= stay and not {3, 4, 5} & stay and len(stay) > 6
    for most in (1, 4, 64):
        assert {r[0] for r in simhash.verified_copies(rows, "doc_id", "text", 5, 7, 9, 0.8, most).collect()} == {k for k, _ in docs} - stay


def test_fingerprint():
    texts = ["", "One two", "the quick brown fox jumps over the lazy dog and runs away", "x y " * 500]
    for t, got in zip(texts, simhash.fingerprints_of(pa.array(texts)).tolist(), strict=True):
        w = t.encode().translate(LOWER).split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        assert got == sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def test_spaced_seeds_tolerate_substitutions(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(6)]
    docs, want = [], set()
    for d in range(60):
        text = [rng.choice(words) for _ in range(80)]
        if d % 2:
            k = d % 6
            piece = items[k][1].split()[5:18]
            for at in rng.sample(range(13), d % 4):
                piece[at] = "changed"
            text[20:20] = piece
            if d % 4 <= 2:
                want.add((d, k))
        docs.append((d, " ".join(text)))
    docs, items = spark.createDataFrame([*docs, (None, docs[1][1])], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: {tuple(r) for r in decontamination.leaks(docs, items, ["doc_id"]).collect()}
    got = rows()
    assert {r[:2] for r in got} == want | {(None, k) for d, k in want if d == 1}
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    assert rows() == got


def test_repetitive_texts_and_items(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "other words here " + "the " * 3000), (2, "the " * 12), (3, "a b " * 500)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the " * 200), (2, "b a " * 20)], "item_id long, text string")
    for most in (1_000_000, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", most)
        assert {tuple(r) for r in decontamination.leaks(docs, items, ["doc_id"]).collect()} == {(1, 1, 1, 13), (3, 2, 0, 13)}


def test_quotes_nest_and_thread(spark):
    rows = [(1, 0, "user", "First message here.\nSecond line there."), (1, 1, "assistant", "Ann wrote:\n> First message here.\nAn answer comes now."), (1, 2, "user", ">> First message here.\n> An answer comes now.\nThanks a lot."), (2, 0, "user", "First message here.")]
    got = {(r["__conv"], r["__turn"]): r for r in quotation.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 1]["__parent"] == 0 and got[1, 2]["__parent"] == 1 and got[1, 2]["__root"] == 0 and got[1, 2]["__depth"] == 2 and got[1, 2]["__levels"] == 2
    assert got[1, 1]["__clean"] == "An answer comes now." and got[2, 0]["__parent"] is None


def test_one_word_quotes_and_ties(spark):
    rows = [(1, 0, "user", "Thanks."), (1, 1, "user", "Thanks. And more of it."), (1, 2, "user", "> Thanks.\nYes"), (1, 3, "user", "> Yes\n> Thanks.\nNo"), (1, 4, "user", "> And more of it.\n\n> Yes"), (1, 5, "user", "> unsaid\nhm")]
    got = {r["__turn"]: r["__parent"] for r in quotation.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    # Turn 3 quotes two messages in one passage, of which neither is the whole; in turn 4 as much comes from turn 1 as from turn 2: the latest.
    assert got == {0: None, 1: None, 2: 0, 3: None, 4: 2, 5: None}


def test_quotes_as_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(12)
    said = ["Yes.", "No!", "Thanks a lot.", "How so? I see.", "Fine by me", "Ann wrote:", "two\nlines here", "The plan is good. Is it?", ""]
    rows = []
    for conv in range(60):
        texts: list[str] = []
        for turn in range(rng.randint(1, 9)):
            lines = [rng.choice(said)] if rng.random() < 0.7 else []
            for _ in range(rng.randint(0, 3) if texts else 0):
                lines += [*(["> " + x if rng.random() < 0.9 else ">" + x for x in rng.choice(texts).split("\n")]), *([rng.choice(said)] if rng.random() < 0.8 else [])]
            texts.append("\n".join(lines))
            rows.append((conv, turn, rng.choice(["user", "assistant"]), texts[-1] or None))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(quotation.OP4_SQL)
    got = quotation.op4_quotation(spark, str(tmp_path)).select(*want.columns)
    rows = sorted(want.fetchall())
    assert sorted(map(tuple, got.collect())) == rows and len({r[want.columns.index("depth")] for r in rows}) > 3


def test_hidden_markov_learns_from_all_parts(spark):
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choice("abcdefgh" if k % 2 else "stuvwxyz") for _ in range(40))) for k in range(90)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    one, *others = ({r["doc_id"]: r["__score"] for r in hmm.scored(x, ["doc_id"], x.doc_id % 5 > 0).collect()} for x in (rows.coalesce(1), rows.repartitionByRange(7, "doc_id"), rows.repartition(32)))
    assert len(one) == 90 and all(many == pytest.approx(one, rel=1e-6) for many in others)


def test_hidden_markov_scores(spark):
    """The whole model again: counts, classes, every Baum-Welch round and the forward recursion, text by text."""
    rng = random.Random(13)
    shape = hmm.Shape(states=3, classes=16, rounds=4)
    docs = [(k, " ".join(rng.choice(["Ab", "b", "c", "d", "é", "f"] if k % 3 else ["d", "x", "y", "z", "f"]) for _ in range(rng.choice([0, 1, 5, 30, 90]))) + (" odd" * (k == 7))) for k in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in hmm.scored(frame, ["doc_id"], frame.doc_id % 7 != 0, shape=shape).collect()}
    texts = {k: t.encode().translate(LOWER).split() for k, t in docs}
    counts = Counter(w for k, t in texts.items() if k % 7 for w in [*t, None])
    n, v = sum(counts.values()), len(counts)
    kind = lambda w: shape.classes if w is None else xxhash.xxh64_intdigest(w) % shape.classes if counts[w] else shape.classes + 1
    mass = np.zeros(shape.classes + 1)
    for w, c in counts.items():
        mass[kind(w)] += c + 1
    base = mass / mass.sum()
    p = hmm.first_params(base, shape)

    def recursion(seen):
        f, scale = np.zeros((len(seen), shape.states)), np.zeros(len(seen))
        for t, x in enumerate(seen):
            f[t] = (p.start if t == 0 else f[t - 1] @ p.move) * p.ratio[x]
            scale[t] = f[t].sum()
            f[t] /= scale[t]
        return f, scale

    for _ in range(shape.rounds):
        s, m, e = np.zeros(3), np.zeros((3, 3)), np.zeros((shape.classes + 2, 3))
        for k, t in texts.items():
            if k % 7:
                seen = [kind(w) for w in [*t, None]]
                f, scale = recursion(seen)
                g = np.ones_like(f)
                for i in range(len(seen) - 2, -1, -1):
                    g[i] = p.move @ (p.ratio[seen[i + 1]] * g[i + 1]) / scale[i + 1]
                s += (f * g)[0]
                for i, x in enumerate(seen):
                    e[x] += (f * g)[i]
                    if i:
                        m += np.outer(f[i - 1], p.ratio[x] * g[i]) * p.move / scale[i]
        p = hmm.updated(s, m, e, base, shape)
    for k, t in texts.items():
        plain = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in [*t, None])
        assert got[k]["__base"] == pytest.approx(plain) and got[k]["__score"] == pytest.approx(plain + np.log10(recursion([kind(w) for w in [*t, None]])[1]).sum(), rel=1e-7)
    # Every state shares out the base's whole mass: that of known tokens, by class, and that of one unseen word.
    known = mass / (n + v + 1)
    assert np.allclose((known[:, None] * p.ratio[:-1]).sum(axis=0) + p.ratio[-1] / (n + v + 1), 1) and np.allclose(p.move.sum(axis=1), 1) and np.isclose(p.start.sum(), 1)


def test_hidden_markov_counts():
    rng = np.random.default_rng(0)
    p = hmm.Params(np.array([0.5, 0.3, 0.2]), np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.3, 0.3, 0.4]]), rng.random((9, 3)) * 2)
    lengths = [1, 5, 64, 65, 200]
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    seen = rng.integers(0, 9, bounds[-1])
    segments = hmm.Segments(seen, bounds)
    starts, moves, emissions, total = segments.expected(p)
    s, m, e, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((9, 3)), []
    for a, b in pairwise(bounds.tolist()):
        x, n = seen[a:b], b - a
        f, g, c = np.zeros((n, 3)), np.ones((n, 3)), np.zeros(n)
        for t in range(n):
            f[t] = (p.start if t == 0 else f[t - 1] @ p.move) * p.ratio[x[t]]
            c[t] = f[t].sum()
            f[t] /= c[t]
        for t in range(n - 2, -1, -1):
            g[t] = p.move @ (p.ratio[x[t + 1]] * g[t + 1]) / c[t + 1]
        s += (f * g)[0]
        for t in range(n):
            e[x[t]] += (f * g)[t]
            if t:
                m += np.outer(f[t - 1], p.ratio[x[t]] * g[t]) * p.move / c[t]
        logs.append(np.log(c).sum())
    assert np.allclose(starts, s) and np.allclose(moves, m) and np.allclose(emissions, e) and np.isclose(total, sum(logs)) and np.allclose(segments.forward(p)[0], logs)


def test_base_scores(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "b c a", "", "c c c d"] * 5)], "doc_id long, text string")
    rows = hmm.scored(docs, ["doc_id"], docs.doc_id >= 0).collect()
    counts = Counter(w for t in ["a b", "b c a", "", "c c c d"] * 5 for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        t = ["a b", "b c a", "", "c c c d"][r["doc_id"] % 4].split()
        assert np.isclose(r["__base"], sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in [*t, None])) and r["__train_tokens"] == n
    assert sum(r["__score"] for r in rows) > sum(r["__base"] for r in rows)


def test_license_join_is_exact():
    rng = random.Random(6)
    templates = {"one": "red green blue white black", "two": "red red yellow", "three": "green blue cyan pink grey brown"}
    vocabulary = ["red", "green", "blue", "white", "black", "yellow", "cyan", "pink", "grey", "brown", "other", "more"]
    texts = ["\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    counts = Counter(w for t in texts for line in t.split("\n") for w in set(line.split()))
    ordered = licenses.Templates(templates, {w.encode(): counts[w] for w in {w for t in templates.values() for w in t.split()}}, 0.6)
    got = licenses.scan(pa.array(texts), ordered)
    for t, labels, score in zip(texts, got[5].to_pylist(), got[6].to_pylist(), strict=True):
        words, shares = t.split(), {}
        for k, notice in templates.items():
            own, width = set(notice.split()), int(np.ceil(1.25 * len(notice.split())))
            most = max((len(set(words[i : i + width]) & own) for i in range(len(words))), default=0)
            if most >= 0.6 * len(own) - 1e-9:
                shares[k] = most / len(own)
        assert labels == ",".join(sorted(shares)) and score == max(shares.values(), default=0)


def test_license_notices_may_be_wrapped():
    notice = licenses.TEMPLATES["mit-notice"].split()
    ordered = licenses.Templates(licenses.TEMPLATES, {w: 1 for w in licenses._word_list(licenses.TEMPLATES)})
    texts = ["before it " * 30 + "\n * ".join(" ".join(notice[k : k + 7]) for k in range(0, len(notice), 7)), " ".join(notice[:12]) + " other" * 40 + " ".join(notice[12:])]
    assert licenses.scan(pa.array(texts), ordered)[5].to_pylist() == ["mit-notice", ""]


def test_window_features():
    """Every window compressed by itself, counted text by text."""
    import zstandard

    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9)))
    common, bad = [word() for _ in range(60)], ["wretched", "vile", "rotten", "foul"]
    text = lambda share: ", ".join(rng.choice(bad) if rng.random() < share else rng.choice(common) for _ in range(rng.randint(1, 60)))
    rows = [(text(0.3), 1) for _ in range(150)] + [(text(0), 0) for _ in range(300)]
    model = toxicity.Model.learned(rows, {1: 300, 0: 3000})
    assert b"wretched" in model.toxic and b"wretched" not in model.ordinary and b"\x37\xa4\x30\xec" not in model.ordinary + model.toxic
    ordinary, both = (toxicity._compressor(x) for x in (model.ordinary, model.ordinary + model.toxic))
    texts = [t for t, _ in rows[::9]] + ["", None, "?!"]
    got = model.features(pa.array(texts, pa.string()))
    for t, row in zip(texts, got, strict=True):
        words = "".join(c.lower() if c.isalnum() else " " for c in t or "").encode().split()
        data = b"  " + b"".join(w + b"  " for w in words) if words else b""
        starts = range(0, max(len(data) - (toxicity.WINDOW - toxicity.STRIDE), 1), toxicity.STRIDE) if words else []
        saved = [len(ordinary.compress(data[k : k + toxicity.WINDOW])) - len(both.compress(data[k : k + toxicity.WINDOW])) for k in starts]
        n = max(len(saved), 1)
        counts = [sum(x >= q for x in saved) for q in toxicity.SAVED]
        want = [*np.log1p(counts), *np.sqrt(np.array(counts) / n), sum(saved) / n, max([*saved, 0]) / 10, np.log1p(sum(max(x, 0) for x in saved))]
        assert np.allclose(row, want), t
    scores = model.scores(pa.array([t for t, _ in rows]))
    assert sum((x >= 0.5) == y for x, (_, y) in zip(scores, rows, strict=True)) > 0.9 * len(rows)
    assert zstandard.ZstdError and toxicity.Model.learned(rows[148:153], {1: 1, 0: 3}).scores(pa.array(["any"])).tolist() == [0.25]


def test_regression_is_plain_ftrl():
    rng = random.Random(15)
    text = lambda y: " ".join(rng.choice(["Good", "fine", "text"] if y else ["BUY!!", "now", "now"]) + rng.choice(["", "x", "."]) for _ in range(rng.randint(0, 12)))
    rows = [(text(k % 3 > 0), int(k % 3 > 0)) for k in range(60)]
    how = quality_classifier.Ftrl(epochs=2)
    model = quality_classifier.Model.learned(rows, {0: 200, 1: 100}, how)
    size, mask = 1 << quality_classifier.BITS, (1 << 64) - 1

    def features(t):
        out, before, shape_before, last = Counter(), 0, 0, None
        words = t.encode().split()
        for k, w in enumerate(words):
            h, s = xxhash.xxh64_intdigest(w), quality_classifier._shape(w) * 2 + (k > 0 and w == last)
            pair = lambda a, b, c: (a * b + c) & mask if k else c & mask
            for x in (h, pair(before, 3, h + 1), s + (1 << 40), pair(shape_before, 64, s + (1 << 50))):
                out[(((x ^ (x >> 29)) * 0x9E3779B97F4A7C15) & mask) >> (64 - quality_classifier.BITS)] += 1
            before, shape_before, last = h, s, w
        return {**{i: how.scale * c / (4 * len(words)) for i, c in out.items()}, size: 1.0}

    z, n = Counter(), Counter()
    sampled = Counter(y for _, y in rows)
    weight = {0: 200 / sampled[0], 1: 100 / sampled[1]}
    mean = 300 / len(rows)

    def at(i):
        return 0.0 if abs(z[i]) <= how.l1 else (np.sign(z[i]) * how.l1 - z[i]) / ((how.beta + n[i] ** 0.5) / how.alpha + how.l2)

    order = np.random.default_rng(17)
    for _ in range(how.epochs):
        for d in order.permutation(len(rows)).tolist():
            x = features(rows[d][0])
            w = {i: at(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - rows[d][1]) * v * weight[rows[d][1]] / mean
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / how.alpha * w[i]
                n[i] += g * g
    texts = [t for t, _ in rows] + ["", "new words Now"]
    want = [1 / (1 + np.exp(-sum(at(i) * v for i, v in features(t).items()))) for t in texts]
    assert np.allclose(model.scores(pa.array(texts)), want)


#: Least precision and recall of label 1 among held-out rows.
FOUND = {"toxic": (0.8, 0.6), "quality": (0.9, 0.9)}


@pytest.mark.parametrize("kind", sorted(FOUND))
def test_held_out_accuracy(spark, kind):
    path = "/root/testdata/sf0.01"
    name = {"toxic": toxicity.op1_toxicity, "quality": quality_classifier.op7_quality_classifier}[kind]
    labels = {r["doc_id"]: r[kind] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = [(r["predicted"], labels[r["doc_id"]]) for r in name(spark, path).collect() if r["held_out"] and r["doc_id"] in labels]
    # Of label 1, as most labels are 0 and a constant answer would be right often.
    hits, said, there = sum(p * y for p, y in rows), sum(p for p, _ in rows), sum(y for _, y in rows)
    print(kind, len(rows), hits, said, there)
    assert said and there and hits / said >= FOUND[kind][0] and hits / there >= FOUND[kind][1]


def test_samples_of_repeated_ids_are_stable(spark):
    """Of several texts of one id always the same is learned from, however the table is split."""
    from pyspark.sql import functions as F

    rows = [(k % 10, f"text {k}") for k in range(60)]
    marks = spark.createDataFrame([(k, 1) for k in range(10)], "doc_id long, toxic int")
    found = []
    for order, parts in ((rows, 1), (rows[::-1], 7), (sorted(rows, key=lambda r: r[1][::-1]), 3)):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        found.append(labelled.sample(docs, marks, "toxic", F.lit(False), {1: 100}, 100)[0])
    assert found[0] == found[1] == found[2] and len(found[0]) == 10


def test_runs_leave_the_catalogue_on_failure(spark, monkeypatch):
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(line_dedup.LineRuns, "cleaned", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        line_dedup.deduplicated(spark.createDataFrame([(1, "a\nb"), (2, "a")], "doc_id long, text string"), 2)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_samples_leave_held_out_rows(spark):
    from pyspark.sql import functions as F

    from seqweave.llm.common import held_out_by

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    rows, counts = labelled.sample(docs, marks, "toxic", held_out_by(F.col("doc_id"), 5, 0), {0: 100, 1: 3}, 100)
    free = [k for k in range(50) if zlib.crc32(str(k).encode()) % 5]
    assert {t for t, y in rows if y == 0} == {f"text {k}" for k in free if k % 2 == 0} and sum(y for _, y in rows) == 3 and sum(counts.values()) == len(free)


def plain_bands(text):
    """Each band's number with the least hashes of the shingles that make its key."""
    words = text.encode().translate(LOWER).split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + corpus_pipeline.SHINGLE]), 42) for i in range(max(1, len(words) - corpus_pipeline.SHINGLE + 1))]
    factors = [xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 7) | 1 for k in range(corpus_pipeline.BANDS * corpus_pipeline.LEAST)]
    lows = [min(x * f % (1 << 64) for x in h) for f in factors]
    return {(k, *lows[k * corpus_pipeline.LEAST : (k + 1) * corpus_pipeline.LEAST]) for k in range(corpus_pipeline.BANDS)}


def test_pipeline_is_its_stages_by_hand(spark, tmp_path):
    """Each stage again in plain Python, over texts with copies, drifting copies, common lines and leaks."""
    rng = random.Random(16)
    words = [f"w{k}" for k in range(300)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    items = [prose(40) for _ in range(4)]
    base = [prose(120) for _ in range(12)]
    docs = {}
    for k in range(150):
        w = list(rng.choice(base)) if k % 3 == 0 else prose(rng.randint(10, 90))
        for _ in range(rng.choice([0, 0, 1, 2, 5]) if k % 3 == 0 else 0):
            w[rng.randrange(len(w))] = rng.choice(words)
        if k % 7 == 0:
            piece = rng.choice(items)[5 : 5 + rng.choice([12, 13, 20])]
            for at in rng.sample(range(len(piece)), rng.choice([0, 2, 4])):
                piece[at] = "other"
            w[8:8] = piece
        if k % 11 == 0:
            w = w + w[:40]
        docs[k] = " ".join(w) + rng.choice(["", "\nshared line", "\n  Shared LINE \nown " + str(k)])
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want, frames, left = docs, {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, left, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        frames[name] = {r["doc_id"]: r["text"] for r in left.collect()}

    def good(t):
        w = t.split()
        covered, longest = plain_repeats(w, 8)
        return len(w) >= 20 and 100 * covered <= 30 * len(w) and longest <= 60 and 100 * longest <= 25 * len(w)

    want = {k: t for k, t in want.items() if good(t)}
    assert frames["quality_rules"] == want and len(want) < len(docs)
    key = lambda x: x.strip().lower()
    held = Counter(x for t in want.values() for x in {key(y) for y in t.split("\n")} if x)
    want = {k: "\n".join(x for x in t.split("\n") if held[key(x)] < 10) for k, t in want.items()}
    assert frames["line_dedup"] == want and held["shared line"] >= 10
    prints = dict(zip(want, simhash.fingerprints_of(pa.array(list(want.values())), corpus_pipeline.SHINGLE).tolist(), strict=True))
    ids = list(want)
    bands = [plain_bands(want[k]) for k in ids]
    near = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= corpus_pipeline.RADIUS or bands[i] & bands[j]]
    roots = simhash._roots(len(ids), np.array([p[0] for p in near], np.int64), np.array([p[1] for p in near], np.int64))
    shingles = {k: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for k, t in want.items()}
    stay: dict = {}
    for k, root in sorted(zip(ids, roots.tolist(), strict=True)):
        if all(r != root or len(shingles[k] & shingles[o]) < 0.8 * len(shingles[k] | shingles[o]) for o, r in stay.items()):
            stay[k] = root
    want = {k: t for k, t in want.items() if k in stay}
    assert frames["simhash_near_dedup"] == want and len(stay) < len(ids)
    leaks = lambda w: any(sum(a == b for a, b in zip(w[i : i + 13], v[j : j + 13], strict=True)) >= 11 for v in items for i in range(len(w) - 12) for j in range(len(v) - 12))
    kept = {k: t for k, t in want.items() if not leaks(t.split())}
    assert frames["decontamination"] == kept and len(kept) < len(want)
    from tokenizers import Tokenizer

    tokenizer, sequences = Tokenizer.from_file(packing.tokenizer_path()), {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = [*tokenizer.encode(kept[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["doc_id"]))
    assert sorted(x[2] for v in sequences.values() for x in v) == sorted(kept)
    for v in sequences.values():
        v.sort()
        assert v[0][0] == 0 and v[-1][0] + v[-1][1] <= 2048 and all(a[0] + a[1] == b[0] for a, b in pairwise(v))


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(7)
    words = [f"word{k}" for k in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = {k: prose(60) for k in range(40)}
    docs[40] = docs[0]
    docs[41] = " ".join(["again and again we say so here now"] * 20)
    items = [(1, prose(30))]
    docs[42] = docs[3] + " " + items[0][1] + " " + prose(40)
    for k in range(12):
        docs[k] += "\nThe footer that all share"
    docs[40] += "\nThe footer that all share"
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, frames = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, str(tmp_path))
        assert out.columns == left.columns
        out.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        frames[name] = {r["doc_id"]: r["text"] for r in left.collect()}
    assert set(frames["quality_rules"]) == set(docs) - {41}
    assert frames["line_dedup"][0] == docs[0].split("\n")[0]
    assert set(frames["simhash_near_dedup"]) == set(frames["line_dedup"]) - {40}
    assert set(frames["decontamination"]) == set(frames["simhash_near_dedup"]) - {42}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(frames["decontamination"])
