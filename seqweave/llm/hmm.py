"""Language-model scores by a hidden Markov model over word classes, trained by Baum-Welch on the whole corpus.

Base: add-one unigram probabilities p(w) = (c + 1) / (N + V + 1) from the training texts. The hidden Markov model
shares them: a state emits a class of words (a fixed number of hash buckets, and the end of text) with its own
probability, and the class emits its words in proportion to p. So a text's probability is the base's times the
likelihood ratio of its classes, found by the scaled forward recursion; words never seen in training are a class that
no state prefers. Everything that tasks hold of the model is states * classes numbers, whatever the vocabulary.

The corpus is turned once into parts: the words of some texts as places in the part's own list of different words,
64-bit hashes of those words, and their counts in training texts. Counts meet by hash, and go back to the parts that
hold the word, so a word crosses the network once a part and not once an occurrence. Each Baum-Welch round reads the
parts and sums expected counts over all of them.

Exactness: forward and backward run in segments. A segment's transfer matrix links its ends, so all segments of all
texts advance together, and the result is the plain recursion's.

Null and empty texts are the end token alone. Without training texts p(end) is 1 and so is the ratio. Repeated rows
count and are scored one by one; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_SPLIT_LOWER, documents, held_out_by, per_doc, shared_dir, slices, split_words, stored

PART_BYTES = 6 << 20
SEGMENT = 64


@dataclass(frozen=True)
class Shape:
    """states and word classes (besides the end of text); Baum-Welch rounds, each over all of the corpus."""

    states: int = 4
    classes: int = 4096
    rounds: int = 8
    prior: float = 50.0


@dataclass
class Params:
    start: np.ndarray  # state
    move: np.ndarray  # state, state
    ratio: np.ndarray  # class, state: emission probability over the base's; the last class is that of unseen words


def first_params(base: np.ndarray, shape: Shape) -> Params:
    """base: the base's probability of each class. A fixed perturbation sets the states apart."""
    k = shape.states
    rng = np.random.default_rng(17)
    emit = base[:, None] * np.exp(0.5 * rng.standard_normal((len(base), k)))
    emit /= np.maximum(emit.sum(axis=0), 1e-300)
    move = np.full((k, k), 0.01 / max(k - 1, 1))
    np.fill_diagonal(move, 0.99 if k > 1 else 1.0)
    return Params(np.full(k, 1 / k), move, ratio_of(emit, base))


def ratio_of(emit: np.ndarray, base: np.ndarray) -> np.ndarray:
    ratio = np.divide(emit, base[:, None], out=np.ones_like(emit), where=base[:, None] > 0)
    return np.vstack([np.maximum(ratio, 1e-12), np.ones(emit.shape[1])])


class Segments:
    """Texts cut into segments, longest first, laid out so that step t of all segments is one slice."""

    def __init__(self, observed: np.ndarray, bounds: np.ndarray):
        n = np.diff(bounds)
        per = -(-n // SEGMENT)
        first = np.concatenate(([0], np.cumsum(per)))
        self.doc = np.repeat(np.arange(len(n)), per)
        self.index = np.arange(first[-1]) - first[self.doc]
        begin = bounds[self.doc] + self.index * SEGMENT
        length = np.minimum(bounds[self.doc + 1] - begin, SEGMENT)
        by = np.argsort(-length, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.doc, self.index, self.begin, self.length = self.doc[by], self.index[by], begin[by], length[by]
        self.active = [int(np.searchsorted(-self.length, -t, "left")) for t in range(SEGMENT)]  # segments longer than t
        self.of = [place[first[:-1][per > j] + j] for j in range(int(per.max(initial=0)))]  # segment j of each text that has one
        self.docs_of = [np.flatnonzero(per > j) for j in range(int(per.max(initial=0)))]
        self.observed, self.texts = observed, len(n)

    def likelihoods(self, p: Params) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each step the classes of all segments that long, and what each state makes of them."""
        seen = [self.observed[self.begin[:a] + t] for t, a in enumerate(self.active) if a]
        return seen, [p.ratio[s] for s in seen]

    def transfers(self, p: Params, made: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each segment's transfer matrix, scaled, and the log of its scale. A text's first segment takes no move."""
        k = len(p.start)
        m = np.where((self.index == 0)[:, None, None], np.eye(k), p.move)
        log = np.zeros(len(m))
        for t, step in enumerate(made):
            a = len(step)
            if t:
                m[:a] = (m[:a].reshape(-1, k) @ p.move).reshape(a, k, k)
            m[:a] *= step[:, None, :]
            if t % 8 == 7:
                top = m[:a].max(axis=(1, 2))
                m[:a] /= top[:, None, None]
                log[:a] += np.log(top)
        return m, log

    def forward(self, p: Params, made: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The log likelihood ratio of each text, the state before each segment, and the transfer matrices."""
        m, log = self.transfers(p, self.likelihoods(p)[1] if made is None else made)
        total = np.zeros(self.texts)
        before = np.zeros((len(m), len(p.start)))
        now = np.tile(p.start, (self.texts, 1))
        for segments, docs in zip(self.of, self.docs_of, strict=True):
            before[segments] = now[docs]
            after = np.einsum("ni,nij->nj", now[docs], m[segments])
            norm = after.sum(axis=1)
            total[docs] += np.log(norm) + log[segments]
            now[docs] = after / norm[:, None]
        return total, before, m

    def expected(self, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of start states, moves and emissions, and the summed log likelihood ratio."""
        k = len(p.start)
        each = np.ones((k, 1))  # a product with it sums over states
        seen, made = self.likelihoods(p)
        total, before, m = self.forward(p, made)
        behind = np.ones((len(m), k))
        now = np.ones((self.texts, k))
        for segments, docs in zip(self.of[::-1], self.docs_of[::-1], strict=True):
            behind[segments] = now[docs]
            back = np.einsum("nij,nj->ni", m[segments], now[docs])
            now[docs] = back / back.sum(axis=1)[:, None]
        head = self.index == 0
        ahead: list[np.ndarray] = []
        alpha = before
        for t, like in enumerate(made):
            step = alpha[: len(like)] @ p.move
            if t == 0:
                step[head] = before[head]
            step *= like
            step /= step @ each
            ahead.append(step)
            alpha = step
        moves, starts = np.zeros((k, k)), np.zeros(k)
        emissions = np.zeros((len(p.ratio), k))
        beta = behind
        for t in range(len(ahead) - 1, -1, -1):
            a = len(made[t])
            gamma = ahead[t] * beta[:a]
            gamma /= gamma @ each
            for s in range(k):
                emissions[:, s] += np.bincount(seen[t], weights=gamma[:, s], minlength=len(p.ratio))
            right = made[t] * beta[:a]
            back = right @ p.move.T
            left = ahead[t - 1][:a] if t else before
            if t == 0:
                starts += gamma[head].sum(axis=0)
                left, right = left[~head], right[~head]
                norm = (left * back[~head]) @ each
            else:
                norm = (left * back) @ each
            moves += p.move * ((left / norm).T @ right)
            beta[:a] = back / (back @ each)
        return starts, moves, emissions, float(total.sum())


def updated(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, base: np.ndarray, shape: Shape) -> Params:
    """Maximum a posteriori parameters; the prior keeps every state near the base where it has seen little."""
    emit = emissions[:-1] + shape.prior * base[:, None]
    emit /= np.maximum(emit.sum(axis=0), 1e-300)
    moves = moves + 1.0 / len(moves)
    starts = starts + 1.0 / len(starts)
    return Params(starts / starts.sum(), moves / moves.sum(axis=1)[:, None], ratio_of(emit, base))


def packed_codes(codes: np.ndarray) -> bytes:
    """The low bytes of all codes, then the next ones, as far as any is used: with small codes for frequent words the
    later planes compress to little."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    used = max((k + 1 for k in range(4) if planes[k].any()), default=1)
    return np.ascontiguousarray(planes[:used]).tobytes()


def unpacked_codes(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    out = np.zeros((n, 4), np.uint8)
    out[:, : len(blob) // n] = np.frombuffer(blob, np.uint8).reshape(-1, n).T
    return out.view("<u4").ravel().astype(np.int64)


def _parts(keep: list[str], classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, b in enumerate(slices(batches, "__text", PART_BYTES)):
            words = split_words(b.column("__text"), SPACE_SPLIT_LOWER)
            codes, names = words.coded()
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names.to_pylist()), np.uint64, len(names)).view(np.int64)
            learn = b.column("__learn").to_numpy(zero_copy_only=False).astype(bool)
            by = np.argsort(-np.bincount(codes, minlength=len(names)), kind="stable")
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            codes, hashes = place[codes], hashes[by]
            counts = np.bincount(codes[np.repeat(learn, words.counts)], minlength=len(names))
            blob = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
            lists = [pa.array([b.column(c).to_pylist()], pa.list_(b.column(c).type)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | k], pa.int64()), *lists, blob(learn, "u1"), blob(words.counts, "<i4"), pa.array([packed_codes(codes)], pa.binary()), blob(_classes(hashes, classes), "<u2"), blob(hashes, "<i8"), blob(counts, "<i4")],
                ["__part", *keep, "__learn", "__sizes", "__codes", "__kinds", "__hashes", "__counts"],
            )

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different word of each part."""
    for b in batches:
        for part, hashes, counts in zip(b.column("__part"), b.column("__hashes"), b.column("__counts"), strict=True):
            h, c = np.frombuffer(hashes.as_py(), "<i8"), np.frombuffer(counts.as_py(), "<i4")
            for s in range(0, len(h), 1 << 16):
                e = min(s + (1 << 16), len(h))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(e - s, part.as_py())), pa.array(np.arange(s, e, dtype=np.int32)), pa.array(h[s:e]), pa.array(c[s:e].astype(np.int64))], ["__part", "__k", "__h", "__n"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and place, as one list of counts a part."""
    part, held = None, []

    def row():
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.concatenate(held).astype("<i8").tobytes()], pa.binary())], ["__part", "__totals"])

    for b in batches:
        parts, n = b.column("__part").to_numpy(), b.column("__n").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)])) if len(parts) else np.zeros(1, np.int64)
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and parts[s] != part:
                yield row()
                held = []
            part = int(parts[s])
            held.append(n[s:e])
    if held:
        yield row()


def _classes(hashes: np.ndarray, classes: int) -> np.ndarray:
    return (hashes.view(np.uint64) % np.uint64(classes)).astype(np.int64)


def _with_ends(values: np.ndarray, sizes: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """values with `end` after each text's, and where each text now begins."""
    bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.empty(bounds[-1], values.dtype)
    is_end = np.zeros(len(out), bool)
    is_end[bounds[1:] - 1] = True
    out[is_end] = end
    out[~is_end] = values
    return out, bounds


def _learned_segments(row: dict, classes: int) -> Segments | None:
    sizes = np.frombuffer(row["__sizes"], "<i4").astype(np.int64)
    learn = np.frombuffer(row["__learn"], "u1").astype(bool)
    if not learn.any():
        return None
    kinds = np.frombuffer(row["__kinds"], "<u2").astype(np.int64)[unpacked_codes(row["__codes"], int(sizes.sum()))]
    observed, bounds = _with_ends(kinds[np.repeat(learn, sizes)], sizes[learn], classes)
    return Segments(observed, bounds)


def _expectations(params: Params, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for row in _rows(b):
                segments = _learned_segments(row, classes)
                if segments is None:
                    continue
                starts, moves, emissions, log = segments.expected(params)
                flat = np.concatenate([starts, moves.ravel(), emissions.ravel(), [log]])
                total = flat if total is None else total + flat
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "v"])

    return run


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    for k in range(b.num_rows):
        yield {c: b.column(c)[k].as_py() for c in b.schema.names if c.startswith("__")}


@dataclass
class Model:
    params: Params
    classes: int
    tokens: int  # N
    words: int  # V
    ends: int  # how often the end token was seen


def train(parts: DataFrame, totals: DataFrame, shape: Shape) -> Model:
    """parts: of `_parts`; totals: __h and __n of each training word."""
    found = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("__n"), F.lit(0))).first()
    ends = parts.select(F.sum(F.length(F.replace(F.hex("__learn"), F.lit("00"), F.lit(""))) / 2)).first()[0]
    ends = int(ends or 0)
    words, tokens = int(found[0]) + (ends > 0), int(found[1]) + ends
    # The classes' mass under the base: a row a class.
    mass = np.zeros(shape.classes + 1)
    kind = F.pmod(F.col("__h"), F.lit(shape.classes))
    # A negative hash stands for itself plus 2 ** 64, as unsigned.
    kind = F.pmod(kind + F.when(F.col("__h") < 0, F.lit((1 << 64) % shape.classes)).otherwise(F.lit(0)), F.lit(shape.classes))
    for r in totals.groupBy(kind.alias("c")).agg(F.sum(F.col("__n") + 1).alias("m")).collect():
        mass[r["c"]] = r["m"]
    mass[-1] = ends + 1 if ends else 0
    base = mass / max(mass.sum(), 1)
    params = first_params(base, shape)
    if not ends:
        params.ratio[:] = 1.0
        return Model(params, shape.classes, tokens, words, ends)
    columns = ["__part", "__learn", "__sizes", "__codes", "__kinds"]
    k, c = shape.states, shape.classes + 2
    for _ in range(shape.rounds):
        summed = np.zeros(k + k * k + c * k + 1)
        for r in parts.select(*columns).mapInArrow(_expectations(params, shape.classes), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            summed[r["i"]] = r["v"]
        params = updated(summed[:k], summed[k : k + k * k].reshape(k, k), summed[k + k * k : -1].reshape(c, k), base, shape)
    return Model(params, shape.classes, tokens, words, ends)


def part_scores(row: dict, totals: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text of a part: tokens, tokens seen in training, base score and score, in log10."""
    sizes = np.frombuffer(row["__sizes"], "<i4").astype(np.int64)
    codes = unpacked_codes(row["__codes"], int(sizes.sum()))
    known = totals > 0
    kinds = np.where(known, np.frombuffer(row["__kinds"], "<u2").astype(np.int64), model.classes + 1)
    observed, bounds = _with_ends(kinds[codes], sizes, model.classes if model.ends else model.classes + 1)
    whole = np.log10(model.tokens + model.words + 1)
    each, _ = _with_ends((np.log10(totals + 1) - whole)[codes], sizes, np.log10(model.ends + 1) - whole)
    seen, _ = _with_ends(known[codes].astype(np.int64), sizes, int(model.ends > 0))
    base = np.add.reduceat(each, bounds[:-1]) if len(sizes) else np.zeros(0)
    ratio, _, _ = Segments(observed, bounds).forward(model.params)
    return sizes + 1, per_doc(seen, bounds), base, base + ratio / np.log(10)


def scored(docs: DataFrame, keep: list[str], learn: Column, text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """The columns `keep` of every row, then __learn, __n_tokens, __n_known, __train_tokens, __base and __score. learn is
    a condition on docs: the rows to train on."""
    path = shared_dir(docs.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in docs.select(*keep).schema.fields}
    lists = "".join(f"`{c}` array<{t}>, " for c, t in types.items())
    source = docs.select(*keep, docs[text].alias("__text"), F.coalesce(learn, F.lit(False)).alias("__learn"))
    # Written once: a part's places hold for its own list of words only.
    parts = stored(source.mapInArrow(_parts(keep, shape.classes), f"__part long, {lists}__learn binary, __sizes binary, __codes binary, __kinds binary, __hashes binary, __counts binary"), f"{path}/parts")
    listed = parts.select("__part", "__hashes", "__counts").mapInArrow(_listed, "__part long, __k int, __h long, __n long")
    totals = stored(listed.where("__n > 0").groupBy("__h").agg(F.sum("__n").alias("__n")), f"{path}/totals")
    model = train(parts, totals, shape)
    back = listed.drop("__n").join(totals, "__h", "left").select("__part", "__k", F.coalesce("__n", F.lit(0)).alias("__n"))
    back = back.repartition("__part").sortWithinPartitions("__part", "__k").mapInArrow(_gathered, "__part long, __totals binary")
    joined = parts.select("__part", *keep, "__learn", "__sizes", "__codes", "__kinds").join(back, "__part", "left")
    names = [*keep, "__learn", "__n_tokens", "__n_known", "__train_tokens", "__base", "__score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, row in enumerate(_rows(b)):
                counts = np.frombuffer(row["__totals"] or b"", "<i8")
                n, known, base, score = part_scores(row, counts, model)
                learnt = np.frombuffer(row["__learn"], "u1").astype(bool)
                kept = [b.column(c)[k].values for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(learnt), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base), pa.array(score)], names)

    fields = ", ".join(f"`{c}` {t}" for c, t in types.items())
    return joined.mapInArrow(run, f"{fields}, __learn boolean, __n_tokens long, __n_known long, __train_tokens long, __base double, __score double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = scored(docs, ["doc_id"], ~held_out_by(docs.doc_id, 7, 2))
    return out.select("doc_id", (~F.col("__learn")).alias("held_out"), F.col("__n_tokens").alias("n_tokens"), F.col("__n_known").alias("n_known"), F.col("__train_tokens").alias("train_tokens"), F.col("__base").alias("base_score"), F.col("__score").alias("score"))
