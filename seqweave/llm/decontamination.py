"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A seed is a hash of the words that a mask picks from a place on; words that the mask skips may differ. The two fixed
masks hit every aligned window of 13 words in which at most two differ, wherever those are. Seeds of all texts join
those of all items; around each hit, windows of 13 aligned words are compared word by word, and one with 11 equal
words is a leak. A seed's row holds 24 bytes; where the benchmark has more than `BROADCAST_SEEDS`, seeds meet by a
shuffled join of key, place and seed instead of a broadcast, and the words of the texts that were hit are fetched after
it. Places of an item with the same seed and the same words around it are one, so repetitive items don't multiply hits.

Words are runs of letters and digits, lower-cased. Null or empty texts, texts or items of fewer than 13 words and an
empty benchmark give no leaks. Repeated rows of one key are one row of the result. Other columns play no part.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
SPAN = 1 + min(m[-1] for m in MASKS)
WINDOW = 13
EQUAL = 11
BROADCAST_SEEDS = 1_000_000


def word_hashes(text: Column) -> Column:
    """One 64-bit hash a word; a text without words gives one hash, of nothing."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(hashed: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, place __i and __seed, for each place and mask."""
    n = F.size("__words")
    places = F.when(n >= WINDOW, F.sequence(F.lit(0), n - SPAN)).otherwise(F.array().cast("array<int>"))
    at = hashed.select(*dict.fromkeys([*keep, "__words"]), F.explode(places).alias("__i"))
    seeds = F.array(*(F.xxhash64(F.lit(k), *(F.get("__words", F.col("__i") + o) for o in mask)) for k, mask in enumerate(MASKS)))
    return at.select(*keep, "__i", F.explode(seeds).alias("__seed"))


def _near() -> Column:
    """The words around a hit: windows of 13 that hold the seed start up to 13 - SPAN words before it."""
    return F.transform(F.sequence(F.lit(SPAN - WINDOW), F.lit(WINDOW - 1)), lambda p: F.get("__words", F.col("__i") + p))


def leaks(docs: DataFrame, items: DataFrame, keys: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """keys, __item, __first (where the first leaking window starts, in words from 0) and __equal (most equal words of
    a window), for each pair of a text and an item that it leaks."""
    doc = docs.select(*keys, word_hashes(docs[text]).alias("__words"))
    item = items.select(items[item_id].alias("__item"), word_hashes(items[item_text]).alias("__words"))
    bench = _seeds(item, ["__item", "__words"]).groupBy("__seed", "__item", _near().alias("__around")).agg(F.min("__i").alias("__j")).drop("__around")
    small = bench.count() <= BROADCAST_SEEDS
    if small:
        hits = _seeds(doc, [*keys, "__words"]).join(F.broadcast(bench), "__seed")
    else:
        found = _seeds(doc, keys).join(bench, "__seed").select(*(F.col(k).alias(f"__key{n}") for n, k in enumerate(keys)), "__item", "__i", "__j").distinct()
        same = [doc[k].eqNullSafe(found[f"__key{n}"]) for n, k in enumerate(keys)]
        hits = doc.join(found, reduce(and_, same))
    back = WINDOW - SPAN
    hits = hits.select(*keys, "__item", "__i", "__j", _near().alias("__near"))
    item = item.where(F.size("__words") >= WINDOW).withColumnRenamed("__words", "__theirs")
    pairs = hits.join(F.broadcast(item) if small else item, "__item")
    # A place outside either text makes every window that holds it fail.
    same = F.transform(F.sequence(F.lit(0), F.lit(back + WINDOW - 1)), lambda p: F.coalesce((F.get("__near", p) == F.get("__theirs", F.col("__j") + p - back)).cast("int"), F.lit(-WINDOW)))
    pairs = pairs.select(*keys, "__item", "__i", same.alias("__same"))
    sums = F.transform(F.sequence(F.lit(1), F.lit(back + 1)), lambda s: F.aggregate(F.slice("__same", s, WINDOW), F.lit(0), lambda a, x: a + x))
    pairs = pairs.select(*keys, "__item", "__i", sums.alias("__sums"))
    first = F.array_position(F.transform("__sums", lambda x: x >= EQUAL), True)
    pairs = pairs.select(*keys, "__item", (F.col("__i") - back + first - 1).alias("__start"), F.array_max("__sums").alias("__most")).where(F.col("__most") >= EQUAL)
    return pairs.groupBy(*keys, "__item").agg(F.min("__start").alias("__first"), F.max("__most").alias("__equal"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select("doc_id", F.col("__item").alias("item_id"), F.col("__first").cast("long").alias("first_word"), F.col("__equal").cast("long").alias("best_equal"))


#: Eleven equal words of thirteen hold a run of four, so equal four-word runs give every alignment to compare.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents
), b AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS v FROM benchmark
), dg AS (
  SELECT doc_id, i, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 13)
), bg AS (
  SELECT item_id, j, array_to_string(v[j : j + 3], ' ') AS g FROM (SELECT item_id, v, unnest(range(1, len(v) - 2)) AS j FROM b WHERE len(v) >= 13)
), diag AS (
  SELECT DISTINCT doc_id, item_id, i - j AS s FROM dg JOIN bg USING (g)
), win AS (
  SELECT doc_id, item_id, s, w, v, unnest(range(greatest(1, 1 - s), least(len(v) - 12, len(w) - 12 - s) + 1)) AS j FROM diag JOIN d USING (doc_id) JOIN b USING (item_id)
), eq AS (
  SELECT doc_id, item_id, j + s - 1 AS start, list_sum(list_transform(range(0, 13), lambda p: CASE WHEN w[j + s + p] = v[j + p] THEN 1 ELSE 0 END)) AS n FROM win
)
SELECT doc_id, item_id, CAST(min(start) AS BIGINT) AS first_word, CAST(max(n) AS BIGINT) AS best_equal FROM eq WHERE n >= 11 GROUP BY doc_id, item_id
"""
