"""Quality rules over whole texts, with repetition measured on a word-level suffix array.

The suffix array of a run of texts is built by prefix doubling on numpy arrays; every text's suffixes sort among
themselves. Adjacent suffixes' longest common prefixes give, for each suffix, the longest LCP interval that it lies
in, that is the longest repeated substring that starts there. The union of those spans of at least `window` words is
the repeated part of the text.

Defined cases: a null or empty text has no words, so all counts are 0 and it is not kept. Repeated rows are judged
one by one. Other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import SPACE_SPLIT, documents, slices, split_words, text_bytes

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Rules:
    """Limits. A text fails the base rules with fewer than min_words words or more than max_repeat_percent of them in
    repeated windows; the suffix-array verdict also limits the longest repeated substring, in words and as a part of
    the text."""

    window: int = 8
    min_words: int = 20
    max_repeat_percent: int = 30
    max_longest_words: int = 60
    max_longest_percent: int = 25
    symbols: str = "#*$%&|<>"


def suffix_ranks(codes: np.ndarray, docs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all differ, and the suffix array.

    docs: the text of each word. Suffixes of one text are ranked together; a suffix that ends counts as different
    from every other, as the end of a text is a symbol of its own.
    """
    n = len(codes)
    key = docs.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    last = np.append(docs[1:] != docs[:-1], True) if n else np.zeros(0, bool)
    ends = np.flatnonzero(last)
    end = ends[np.searchsorted(ends, np.arange(n))] + 1 if n else np.zeros(0, np.int64)
    small = np.int32 if n < 1 << 31 else np.int64  # a level is kept for each doubling
    levels, h = [rank.astype(small)], 1
    while True:
        same = ~new
        open_ = same.copy()
        open_[:-1] |= same[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            return levels, order
        who = order[at]
        inside = who + h < end[who]
        second = np.where(inside, rank[np.minimum(who + h, n - 1)] + n, n - 1 - who)  # an ended suffix comes before, and apart from all
        first = rank[who]
        by = np.lexsort((second, first))
        who, first, second = who[by], first[by], second[by]
        order[at] = who
        differs = np.ones(len(at), bool)
        differs[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[at] = differs
        rank = rank.copy()
        rank[who] = np.maximum.accumulate(np.where(differs, at, 0))
        levels.append(rank.astype(small))
        h *= 2


def longest_repeats(codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each word's place, the length of the longest substring starting there that its text holds twice or more."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    levels, order = suffix_ranks(codes, docs)
    a, b = order[:-1].copy(), order[1:].copy()
    pairs = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[pairs], b[pairs]
    common = np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        common[ok] += 1 << k
        a[ok] += 1 << k
        b[ok] += 1 << k
    lcp = np.zeros(n + 1, np.int64)  # lcp[p]: of the suffixes at p - 1 and p
    lcp[pairs + 1] = common
    out = np.empty(n, np.int64)
    out[order] = np.maximum(lcp[:-1], lcp[1:])
    return out


def measures(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    n = len(texts)
    words = split_words(texts, SPACE_SPLIT)
    codes, _ = words.coded()
    doc = np.repeat(np.arange(n), words.counts)
    longest = longest_repeats(codes, doc)
    until = np.maximum.accumulate(np.where(longest >= rules.window, np.arange(len(codes)) + longest, 0)) if len(codes) else longest
    covered = np.bincount(doc[until > np.arange(len(codes))], minlength=n)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc, longest)
    lead = (words.chars & 0xC0) != 0x80
    chars_before = np.concatenate(([0], np.cumsum(lead)))
    word_chars = np.diff(chars_before[words.offsets[words.docs]])
    raw, offsets = text_bytes(texts)
    symbol = np.zeros(256, bool)
    symbol[list(rules.symbols.encode())] = True
    n_symbols = np.diff(np.searchsorted(np.flatnonzero(symbol[raw]), offsets))
    # Lines with a word that equal an earlier one of their text.
    cut = np.zeros(256, np.uint8) + 1
    cut[0x0A] = 0
    breaks = np.flatnonzero(raw == 0x0A)
    starts = np.concatenate((offsets[:-1], breaks + 1))
    line_doc = np.concatenate((np.arange(n), np.searchsorted(offsets, breaks, "right") - 1))
    by = np.lexsort((starts, line_doc))
    starts, line_doc = starts[by], line_doc[by]
    ends = np.append(starts[1:] - 1, offsets[-1])
    last = np.append(line_doc[1:] != line_doc[:-1], True) if len(starts) else np.zeros(0, bool)
    ends[last] = offsets[line_doc[last] + 1]
    blank = np.concatenate(([0], np.cumsum(SPACE_SPLIT[raw] != 0)))
    worded = blank[ends] > blank[starts]
    starts, ends, line_doc = starts[worded], ends[worded], line_doc[worded]
    data = raw.tobytes()
    seen = pa.array([data[s:e] for s, e in zip(starts, ends, strict=True)], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = np.unique(line_doc * (len(seen) + 1) + seen)
    n_dup_lines = np.bincount(line_doc, minlength=n) - np.bincount(distinct // (len(seen) + 1), minlength=n)
    n_words = words.counts
    failed = (n_words < rules.min_words) | (100 * covered > rules.max_repeat_percent * n_words)
    verdict = (most <= rules.max_longest_words) & (100 * most <= rules.max_longest_percent * n_words)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": covered, "longest_repeat": most, "base_failed": failed, "kept": ~failed & verdict}


def judged(docs: DataFrame, keep: list[str], text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The columns `keep` of each row, then its measures and verdict. Narrow: no shuffle."""
    schema = docs.select(*keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    source = docs.select(*keep, docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            found = measures(b.column("__text"), rules)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(v) for v in found.values())], [*keep, *found])

    return source.mapInArrow(run, f"{fields}, {SCHEMA}")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir), ["doc_id"])
    return out.drop("longest_repeat")


#: A repeated substring of more than L words exists just where a window of L + 1 words is found twice.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id
), lim AS (
  SELECT doc_id, w, CAST(least(60, len(w) * 25 // 100) AS BIGINT) AS most FROM d WHERE len(w) >= 20
), lon AS (
  SELECT DISTINCT doc_id FROM (SELECT doc_id, array_to_string(w[i : i + most], ' ') AS g FROM (SELECT doc_id, w, most, unnest(range(1, len(w) - most + 1)) AS i FROM lim))
  GROUP BY doc_id, g HAVING count(*) > 1
), lines AS (
  SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY doc_id
), base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, lon.doc_id IS NOT NULL AS too_long
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lon USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT too_long AS kept FROM judged
"""
