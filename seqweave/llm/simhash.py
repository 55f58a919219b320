"""SimHash near-dedup: fingerprints, bit-sliced comparison within blocks, and connected components.

Candidates: the 64 bits are cut into `parts` groups. Fingerprints that differ in at most `radius` bits agree on at
least parts - radius of them, so each fingerprint goes into one block for each choice of that many groups and no pair
is missed. Equal fingerprints are one node. A block of more than `most` fingerprints is split into sub-blocks and
every pair of sub-blocks is compared, so a task holds at most 2 * most of one block whatever its size.

Comparison: a run of blocks is stored as 64 bit planes, one bit a fingerprint. For each shift d the planes are XORed
with themselves d places on, which compares every fingerprint with the d-th after it; carry-save adders count the
differing bits of all lanes at once, and words of 64 lanes leave the count once every lane exceeds the radius. Links
leave a task as stars (member, smallest member), never as all pairs.

Defined cases: null or empty texts have fingerprint zero and link like any other. Fewer words than a shingle: the
whole sequence is the one shingle. Repeated rows and equal texts share a fingerprint and so a component. A component is
named by its smallest id; null ids are ignored for that. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_SPLIT_LOWER, documents, shared_dir, slices, split_words, stored

#: Rows that a task compares at once, besides what completes its last block.
RUN_ROWS = 1 << 16
#: Rows of a list small enough to broadcast.
BROADCAST_ROWS = 100_000
#: Characters of a component that a task judges, and of the texts of a component taken in a round.
SALT_CHARS, TAKEN_CHARS = 1 << 19, 4 << 20
_BYTES = np.uint64(0x0101010101010101)


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The XXH64 values (seed 42) of all texts' shingles, repeats included, and where each text's begin."""
    words = split_words(texts, SPACE_SPLIT_LOWER)
    joined, starts, ends = words.joined()
    counts = words.counts
    n_shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    bounds = np.concatenate(([0], np.cumsum(n_shingles)))
    first = np.repeat(words.docs[:-1] - bounds[:-1], n_shingles) + np.arange(bounds[-1])
    last = np.minimum(first + shingle, np.repeat(words.docs[1:], n_shingles)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(first))
    return h, bounds


def fingerprints_of(texts: pa.Array, shingle: int = 4) -> np.ndarray:
    """A bit is 1 if it is set in over half the hashes of the text's shingles."""
    return _prints(*shingle_hashes(texts, shingle))


def _prints(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n_shingles = np.diff(bounds)
    out = np.zeros(len(n_shingles), np.uint64)
    if not len(h):
        return out
    # Byte counters: eight bits of a hash are summed at once, over at most 255 hashes.
    doc = np.repeat(np.arange(len(n_shingles)), n_shingles)
    place = np.arange(len(h)) - bounds[doc]
    cut = np.flatnonzero((place % 255 == 0))
    of = doc[cut]
    some = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    for k in range(8):
        part = np.add.reduceat((h >> np.uint64(k)) & _BYTES, cut)
        sums = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), some, axis=0)
        over = (2 * sums > n_shingles[of[some]][:, None]).astype(np.uint64)
        for j in range(8):
            out[of[some]] |= over[:, j] << np.uint64(8 * j + k)
    return out


def band_keys(h: np.ndarray, bounds: np.ndarray, bands: int, least: int) -> pa.ListArray:
    """For each text a key a band, made of the least of its shingles' hashes under so many permutations. Two texts of
    Jaccard similarity J share a band with probability J to the power of `least`. Texts without words have none."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    keys = np.zeros((len(full), bands), np.uint64)
    for k in range(bands * least):
        factor = np.uint64(xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 7) | 1)
        low = np.minimum.reduceat(h * factor, bounds[:-1][full]) if len(full) else np.zeros(0, np.uint64)
        keys[:, k // least] = (keys[:, k // least] ^ low) * np.uint64(0x9E3779B97F4A7C15)
        keys[:, k // least] ^= keys[:, k // least] >> np.uint64(29)
    sizes = np.zeros(len(bounds) - 1, np.int64)
    sizes[full] = bands
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 4, bands: int = 0, least: int = 5) -> DataFrame:
    """The columns `keep` of each row and its fingerprint __fp, as a signed long; with bands, also __bands, their keys."""
    schema = docs.select(*keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            h, bounds = shingle_hashes(b.column("__text"), shingle)
            more = [band_keys(h, bounds, bands, least)] if bands else []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(_prints(h, bounds).view(np.int64)), *more], names)

    names = [*keep, "__fp", *(["__bands"] if bands else [])]
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, f"{fields}, __fp long" + (", __bands array<long>" if bands else ""))


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: bit i of plane k is bit k of fingerprint i."""
    n = len(fp)
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    packed = np.zeros((64, -(-n // 64) * 8), np.uint8)
    packed[:, : -(-n // 8)] = np.packbits(bits.T, axis=1, bitorder="little")
    return packed.view("<u8")


def _ahead(planes: np.ndarray, d: int) -> np.ndarray:
    """The planes moved so that lane i holds what lane i + d held."""
    w, r = divmod(d, 64)
    out = np.zeros_like(planes)
    out[:, : planes.shape[1] - w] = planes[:, w:] >> np.uint64(r)
    if r:
        out[:, : planes.shape[1] - w - 1] |= planes[:, w + 1 :] << np.uint64(64 - r)
    return out


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three bits in every lane."""
    t = a ^ b
    return t ^ c, (a & b) | (t & c)


def within(planes: np.ndarray, d: int, lanes: np.ndarray, radius: int) -> np.ndarray:
    """The lanes, of those set in the packed mask `lanes`, that differ in at most radius bits from the lane d ahead."""
    at = np.flatnonzero(lanes)
    words = lanes[at]
    other = _ahead(planes, d)[:, at]
    own = planes[:, at]
    one, two, four, over = (np.zeros(len(at), np.uint64) for _ in range(4))
    for k in range(0, 64, 4):
        x = own[k : k + 4] ^ other[k : k + 4]
        one, t = _add(one, x[0], x[1])
        one, u = _add(one, x[2], x[3])
        two, v = _add(two, t, u)
        over |= four & v
        four ^= v
        if k % 16 == 12:
            beyond, equal = over.copy(), ~over
            for c, b in ((four, 4), (two, 2), (one, 1)):
                if radius & b:
                    equal &= c
                else:
                    beyond |= equal & c
                    equal &= ~c
            words &= ~beyond
            live = words != 0
            if not live.any():
                return np.zeros(0, np.int64)
            if k < 60 and live.mean() < 0.7:
                at, words, own, other = at[live], words[live], own[:, live], other[:, live]
                one, two, four, over = one[live], two[live], four[live], over[live]
    bits = np.unpackbits(words.view(np.uint8), bitorder="little")
    found = np.flatnonzero(bits)
    return at[found // 64] * 64 + found % 64


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def block_links(fp: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what links within each block; equal block numbers stand together."""
    size = np.diff(np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)))
    size = np.repeat(size, size)
    where = np.flatnonzero(size > 1)
    fp, block = fp[where], block[where]
    n = len(fp)
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if n else np.zeros(0, np.int64)
    left = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n))) - np.arange(n) if n else np.zeros(0, np.int64)  # of the block, from here on
    root = np.arange(n)
    rows = np.arange(n)
    planes = bit_planes(fp)
    d, kept_a, kept_b, waiting = 1, [], [], 0
    while True:
        here = left[rows] > d
        if not here.any():
            break
        # Rows that still have partners at this distance, with the partners; compacted once they are under half.
        if here.sum() * 2 < len(rows):
            need = np.zeros(n, bool)
            need[rows[here]] = True
            whole = np.repeat(np.maximum.reduceat(need, first), np.diff(np.append(first, n)))
            if whole.sum() < len(rows):
                rows = np.flatnonzero(whole)
                planes = bit_planes(fp[rows])
                here = left[rows] > d
        mask = np.zeros(planes.shape[1] * 8, np.uint8)
        packed = np.packbits(here, bitorder="little")
        mask[: len(packed)] = packed
        lanes = within(planes, d, mask.view("<u8"), radius)
        if len(lanes):
            kept_a.append(rows[lanes])
            kept_b.append(rows[lanes + d])
            waiting += len(lanes)
        if waiting > 1 << 20:
            root = _roots(n, np.concatenate([np.arange(n), *kept_a]), np.concatenate([root, *kept_b]))
            kept_a, kept_b, waiting = [], [], 0
        d += 1
    if waiting:
        root = _roots(n, np.concatenate([np.arange(n), *kept_a]), np.concatenate([root, *kept_b]))
    member = np.flatnonzero(root != np.arange(n))
    return fp[member], fp[root[member]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps: list[np.ndarray] = []
        blocks: list[np.ndarray] = []
        rows = 0

        def flush(final: bool):
            nonlocal fps, blocks, rows
            if not rows:
                return None
            fp, block = np.concatenate(fps), np.concatenate(blocks)
            change = np.flatnonzero((block[1:] != block[:-1]).any(axis=1)) + 1
            cut = len(fp) if final else (int(change[-1]) if len(change) else 0)
            number = np.zeros(len(fp), np.int64)
            number[change] = 1
            a, b = block_links(fp[:cut], np.cumsum(number)[:cut], radius) if cut else (fp[:0], fp[:0])
            fps, blocks, rows = [fp[cut:]], [block[cut:]], len(fp) - cut
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        due = RUN_ROWS
        for batch in batches:
            fps.append(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            blocks.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "key", "pair")], axis=1))
            rows += batch.num_rows
            if rows >= due:
                out = flush(False)
                due = max(RUN_ROWS, 2 * rows)
                if out.num_rows:
                    yield out
        out = flush(True)
        if out is not None and out.num_rows:
            yield out

    return run


def links(distinct: DataFrame, radius: int, parts: int, path: str, most: int = 2048) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose connected components are those of all pairs within
    the radius."""
    edges = np.linspace(0, 64, parts + 1).astype(int)
    masks = []
    for chosen in combinations(range(parts), parts - radius):
        m = sum(((1 << int(edges[p + 1])) - (1 << int(edges[p]))) for p in chosen)
        masks.append(m - (1 << 64) if m >> 63 else m)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)))
    rows = distinct.select("fp", F.inline(tables))
    hot = stored(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), f"{path}/hot")
    n_hot = hot.count()
    if n_hot:
        hot = hot.withColumn("cuts", F.ceil(F.col("n") / most).cast("int")).drop("n")
        cut = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, ["t", "key"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
        cut = cut.withColumn("own", own)
        # Sub-blocks own and j meet in the block numbered min * cuts + max.
        pair = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.least(F.col("own"), j).cast("long") * F.col("cuts") + F.greatest(F.col("own"), j))
        rows = cut.select("fp", "t", "key", F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair)).alias("pair"))
    else:
        rows = rows.withColumn("pair", F.lit(0).cast("long"))
    sorted_rows = rows.repartition("t", "key", "pair").sortWithinPartitions("t", "key", "pair", "fp")
    return sorted_rows.mapInArrow(_compare(radius), "a long, b long")


def components(edges: DataFrame, path: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it reaches.

    Large-star and small-star rounds. A node's smallest neighbour is an aggregate joined back, so a hub's neighbours
    need not meet in one task. Every round is a table in the shared folder.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{path}/edges-0")
    before = None
    for k in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # As tables, so that the joins deal out both sides themselves and can split a hub.
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{path}/low-{k}")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stored(large.distinct(), f"{path}/large-{k}")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), f"{path}/lower-{k}")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        now = stored(small.distinct(), f"{path}/edges-{k}")
        after = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, parts: int = 6, keep: tuple[str, ...] = (), bands: int = 0, least: int = 5) -> DataFrame:
    """doc_id, the columns `keep`, __fp and __component of every row: the smallest id among those that links of at most
    radius bits reach. With bands, fingerprints of texts that share a band's key are linked as well."""
    path = shared_dir(docs.sparkSession)
    made = fingerprints(docs.select(docs[doc_id].alias("__id"), docs[text].alias("text"), *keep), ["__id", *keep], "text", shingle, bands, least)
    prints = stored(made, f"{path}/prints")
    distinct = stored(prints.groupBy("__fp").agg(F.min("__id").alias("least")).withColumnRenamed("__fp", "fp"), f"{path}/distinct")
    found = links(distinct.select("fp"), radius, parts, path)
    roots = components(found.unionByName(_banded(prints, path)) if bands else found, path)
    of = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(of.groupBy("root").agg(F.min("least").alias("__component")), f"{path}/named")
    of = stored(of.join(named, "root").select(F.col("fp").alias("__fp"), "__component"), f"{path}/components")
    return prints.join(of, "__fp").select(F.col("__id").alias(doc_id), *keep, "__fp", "__component")


def _banded(prints: DataFrame, path: str) -> DataFrame:
    """Links from the fingerprints that share a band's key to the smallest of them: a row a member, never a pair."""
    rows = stored(prints.select("__fp", F.posexplode("__bands").alias("t", "key")).distinct(), f"{path}/bands")
    low = stored(rows.groupBy("t", "key").agg(F.min("__fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), f"{path}/band-heads")
    return rows.join(low, ["t", "key"]).where(F.col("__fp") != F.col("b")).select(F.col("__fp").alias("a"), "b")


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text, as hashes, and where each text's begin; without words one of its own kind."""
    h, bounds = shingle_hashes(texts, shingle)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    none = np.flatnonzero(np.diff(bounds) == 0)
    doc, h = np.concatenate((doc, none)), np.concatenate((h, np.zeros(len(none), np.uint64)))
    by = np.lexsort((h, doc))
    doc, h = doc[by], h[by]
    fresh = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
    return h[fresh], np.searchsorted(doc[fresh], np.arange(len(texts) + 1))


class Leaders:
    """Shingle sets that stay, with an index from shingle to set."""

    def __init__(self, similarity: float):
        self.similarity, self.sets, self.index = similarity, [], None

    def add(self, shingles: np.ndarray) -> None:
        self.sets.append(shingles)
        self.index = None

    def like(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which sets (h between bounds) have a Jaccard similarity of at least `similarity` to one of these."""
        n, k = len(bounds) - 1, len(self.sets)
        if not n or not k:
            return np.zeros(n, bool)
        if self.index is None:
            size = np.array([len(s) for s in self.sets])
            flat, of = np.concatenate(self.sets), np.repeat(np.arange(k), size)
            by = np.argsort(flat, kind="stable")
            self.index = flat[by], of[by], size
        flat, of, size = self.index
        first, last = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
        shared = np.concatenate(([0], np.cumsum(last - first)))[bounds]
        out = np.zeros(n, bool)
        d = 0
        while d < n:
            # As many sets at once as share about a million shingles with these, one at least.
            e = min(max(int(np.searchsorted(shared, shared[d] + (1 << 20), "right")) - 1, d + 1), n, d + max(1, (1 << 22) // k))
            f = first[bounds[d] : bounds[e]]
            g = last[bounds[d] : bounds[e]] - f
            doc = np.repeat(np.repeat(np.arange(e - d), np.diff(bounds[d : e + 1])), g)
            at = np.arange(g.sum()) - np.repeat(np.cumsum(g) - g, g) + np.repeat(f, g)
            both = np.bincount(doc * k + of[at], minlength=(e - d) * k).reshape(e - d, k)
            own = np.diff(bounds[d : e + 1])[:, None]
            out[d:e] = (both >= self.similarity * (own + size[None, :] - both) - 1e-9).any(axis=1)
            d = e
        return out


STAYS, GOES, WAITS = 0, 1, 2


def _judged(shingle: int, similarity: float):
    """For rows sorted by __component, __salt and __n: those with an __n are taken one by one and stay unless they are like
    one that stays; then the others, which come after, go if they are like one that stays, else wait."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, Leaders(similarity)
        for b in slices(batches, "__a"):
            h, bounds = shingle_sets(b.column("__a"), shingle)
            component, salt = (b.column(c).to_numpy(zero_copy_only=False) for c in ("__component", "__salt"))
            taken = b.column("__n").is_valid().to_numpy(zero_copy_only=False)
            verdict = np.full(b.num_rows, WAITS, np.int32)
            cut = np.flatnonzero((component[1:] != component[:-1]) | (salt[1:] != salt[:-1]) | (taken[1:] != taken[:-1])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
                if group != (component[s], salt[s]):
                    group, leaders = (component[s], salt[s]), Leaders(similarity)
                if not taken[s]:
                    verdict[s:e][leaders.like(h[bounds[s] : bounds[e]], bounds[s : e + 1] - bounds[s])] = GOES
                    continue
                gone = leaders.like(h[bounds[s] : bounds[e]], bounds[s : e + 1] - bounds[s])
                fresh = Leaders(similarity)
                for d in range(s, e):
                    own = h[bounds[d] : bounds[d + 1]]
                    if not gone[d - s]:
                        fresh.add(own)
                        leaders.add(own)
                        gone[d - s + 1 :] |= fresh.like(h[bounds[d + 1] : bounds[e]], bounds[d + 1 : e + 1] - bounds[d + 1])
                        fresh = Leaders(similarity)
                    verdict[d] = GOES if gone[d - s] else STAYS
            # What is taken is judged under every salt, and told under the first.
            keep = pa.array(~taken | (salt == 0))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names), pa.array(verdict)], [*b.schema.names, "__verdict"]).filter(keep)

    return run


def verified_copies(docs: DataFrame, doc_id: str, text: str, shingle: int, radius: int, parts: int, similarity: float, bands: int = 0, least: int = 5, most: int = 512) -> DataFrame:
    """The distinct ids (column doc_id) of documents of which no text stays.

    Components nominate; the shingles themselves decide. A fingerprint alone finds a pair at the least similarity seldom
    (its bits differ in about ten places at 0.8), so texts that share a band's key are nominated, too. Equal texts are one, under their smallest id. Within a
    component texts are taken by rising id: one stays unless it is at least so similar to one that stays before it. So a
    chain of links drops no text that differs from all that stay, and no two that stay in a component are similar.

    Every round takes the next texts of all components, one at first, then eight times as many, `most` and `TAKEN_CHARS`
    at most. Those of them that stay meet all that wait, as an index of their shingles that the others stream past: no
    pair becomes a row. A component of more than `SALT_CHARS` is dealt out in so many parts, each with its own copy of
    what was taken.
    """
    path = shared_dir(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(text, F.lit("")).alias("__a")).where("__id IS NOT NULL")
    rows = rows.select("*", F.xxhash64("__a").alias("__t1"), F.xxhash64(F.lit(1), "__a").alias("__t2"))
    key, unit = ["__t1", "__t2"], ["__component", "__t1", "__t2"]
    rows = rows.withColumn("__chars", F.length("__a"))
    groups = stored(near_duplicates(rows, "__id", "__a", shingle, radius, parts, (*key, "__chars"), bands, least).drop("__fp", "__bands"), f"{path}/groups")
    units = stored(groups.groupBy(*unit, "__chars").agg(F.min("__id").alias("__id")), f"{path}/units")
    sizes = units.groupBy("__component").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("__chars") / SALT_CHARS).cast("int").alias("__salts"))
    several = stored(sizes.where("n > 1").select("__component", F.greatest("__salts", F.lit(1)).alias("__salts")), f"{path}/several")
    kept = units.join(several, "__component", "left_anti").select("__id")
    names = [*unit, "__chars", "__id", "__salts", "__a"]
    nominated = units.join(several, "__component")
    waiting = stored(rows.select("__id", *key, "__a").join(nominated, ["__id", *key]).dropDuplicates(["__id", *key]).select(*names), f"{path}/waiting")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in waiting.schema.fields) + ", __n int, __salt int, __verdict int"
    k, take = 0, 1
    while waiting.count():
        k += 1
        place = F.row_number().over(Window.partitionBy("__component").orderBy("__id", *key))
        taken = waiting.select(*unit, "__id", "__chars").withColumn("__n", place).where(F.col("__n") <= take)
        running = F.sum("__chars").over(Window.partitionBy("__component").orderBy("__n"))
        taken = stored(taken.withColumn("__sum", running).where((F.col("__n") == 1) | (F.col("__sum") <= TAKEN_CHARS)).select(*unit, "__n"), f"{path}/taken-{k}")
        both = waiting.join(taken, unit, "left")
        own = F.pmod(F.xxhash64(*key), F.col("__salts")).cast("int")
        salts = F.when(F.col("__n").isNull(), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("__salts") - 1))
        both = both.select(*names, "__n", F.explode(salts).alias("__salt"))
        dealt = both.repartition("__component", "__salt").sortWithinPartitions("__component", "__salt", F.col("__n").asc_nulls_last())
        judged = stored(dealt.mapInArrow(_judged(shingle, similarity), out), f"{path}/judged-{k}")
        kept = kept.unionByName(judged.where(F.col("__verdict") == STAYS).select("__id"))
        waiting = judged.where(F.col("__verdict") == WAITS).select(*names)
        take = min(8 * take, most)
    return groups.join(stored(kept, f"{path}/stays"), "__id", "left_anti").select(F.col("__id").alias(doc_id)).distinct()


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__component").alias("component_id"))
