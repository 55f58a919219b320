"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

A template is the set of a notice's words. A block is a run of `SLACK` times as many words as the notice has, wherever
it starts, over line ends, as notices are wrapped; at a text's end it is shorter. A text meets a template if one of its
blocks holds at least `CONTAINED` of it. Template words are ordered by their frequency in the whole corpus, rarest first. Prefix
filter: a block that meets a template of n words, of which it needs k, holds one of its first n - k + 1. Length filter:
the block holds at least k template words, repeats included. Positional filter: if the rarest one that it shares is the
template's q-th, at most n - q + 1 are left, and those must reach k. What is left is counted exactly, so no block that
meets a template is missed. Words meet templates inside a task; nothing but one count for each template word is
shuffled.

Null and empty texts have no word, no label and score 0. A label's score is 1 for a base phrase, else the largest
contained share of the templates met. Repeated rows are judged alike; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_SPLIT_LOWER, Words, documents, slices, split_words

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public notices, by label.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
CONTAINED, SLACK = 0.8, 1.25

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: str) -> list[bytes]:
    """The words of a text, in order."""
    found = split_words(pa.array([text], pa.string()), ALNUM_SPLIT_LOWER)
    codes, names = found.coded()
    return [names[c].as_py() for c in codes.tolist()]


def _word_list(templates: dict[str, str]) -> list[bytes]:
    return sorted({w for t in templates.values() for w in words_of(t)})


def frequencies(docs: DataFrame, templates: dict[str, str], text: str = "text") -> dict[bytes, int]:
    """How many texts of the corpus hold each template word: a row a word, as many as the templates have."""
    vocabulary = _word_list(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for b in slices(batches, "__text"):
            words, listed, _, _ = _listed(b.column("__text"), vocabulary)
            doc, at = np.repeat(np.arange(b.num_rows), words.counts), listed >= 0
            total += np.bincount(np.unique(doc[at] * len(vocabulary) + listed[at]) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], ["word", "n"])

    rows = docs.select(docs[text].alias("__text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return {w: counts.get(k, 0) for k, w in enumerate(vocabulary)}


def _listed(texts: pa.Array, vocabulary: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, pa.Array]:
    """The texts' words, the place of each in the vocabulary (-1: none), and as places in the list of their own."""
    words = split_words(texts, ALNUM_SPLIT_LOWER)
    codes, names = words.coded()
    place = pc.fill_null(pc.index_in(names, pa.array(vocabulary, names.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return words, place[codes] if len(codes) else codes, codes, names


class Templates:
    """Templates over words in the corpus's order, rarest first, with an index from prefix words to templates."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], contained: float = CONTAINED, slack: float = SLACK):
        self.order = sorted(counts, key=lambda w: (counts[w], w))
        rank = {w: k for k, w in enumerate(self.order)}
        said = {k: words_of(t) for k, t in templates.items()}
        self.labels = sorted(k for k, v in said.items() if v)
        self.sets = [np.array(sorted({rank[w] for w in said[k]}), np.int64) for k in self.labels]
        self.need = [ceil(contained * len(s) - 1e-9) for s in self.sets]
        self.width = [ceil(slack * len(said[k]) - 1e-9) for k in self.labels]
        prefixes = [s[: len(s) - n + 1] for s, n in zip(self.sets, self.need, strict=True)]
        self.asked = np.concatenate([np.zeros(0, np.int64), *prefixes])
        self.asking = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])

    def met(self, words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, template, share) of every text that meets a template, with the largest share of its blocks. words: for
        each word of all texts its place in the order, or -1; docs: its text.

        Only templates that share a prefix word with the texts are looked at; memory is a few numbers a word, whatever
        a template's length.
        """
        at = np.flatnonzero(words >= 0)
        there = np.zeros(len(self.order), bool)
        there[words[at]] = True
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in np.unique(self.asking[there[self.asked]]).tolist():
            own, need, width = self.sets[k], self.need[k], self.width[k]
            q = np.minimum(np.searchsorted(own, words[at]), len(own) - 1)
            same = own[q] == words[at]
            q, here = q[same], at[same]
            doc = docs[here]
            v = here + doc * width  # no block spans two texts
            rare = v[q <= len(own) - need]
            # What has a word of the prefix within a block's width, before or after it.
            after = np.searchsorted(rare, v)
            near = (rare[np.minimum(after, len(rare) - 1)] - v < width) & (after < len(rare)) | (after > 0) & (v - rare[np.maximum(after - 1, 0)] < width)
            v, q, doc = v[near], q[near], doc[near]
            place = np.arange(len(v))
            until = np.searchsorted(v, v + width)
            able = (until - place >= need) & (len(own) - _least(q, until) >= need)
            if able.any():
                shared = _different(q, until)
                start = np.flatnonzero(able & (shared >= need))
                found.append((doc[start], np.full(len(start), k), shared[start] / len(own)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _least(q: np.ndarray, until: np.ndarray) -> np.ndarray:
    """The least of q[i : until[i]] for each i: two overlapping spans of a power of two cover it."""
    length = until - np.arange(len(q))
    out, spans, span = q.copy(), q, 1
    while span * 2 <= (length.max() if len(q) else 0):
        spans = np.minimum(spans[: len(spans) - span], spans[span:])
        span *= 2
        fit = np.flatnonzero((length >= span) & (length < 2 * span))
        out[fit] = np.minimum(spans[fit], spans[until[fit] - span])
    return out


def _different(q: np.ndarray, until: np.ndarray) -> np.ndarray:
    """How many different values q[i : until[i]] holds, for each i. A place is the first of its value for starts behind the
    value's last place, as far back as blocks reach it: one step up and one down a place, summed."""
    n = len(q)
    by = np.argsort(q, kind="stable")
    before = np.full(n, -1)
    before[by[1:]] = np.where(q[by[1:]] == q[by[:-1]], by[:-1], -1)
    begin = np.maximum(before + 1, np.searchsorted(until, np.arange(n), side="right"))
    steps = np.bincount(begin, minlength=n + 1) - np.bincount(np.arange(1, n + 1), minlength=n + 1)
    return np.cumsum(steps)[:n]


def scan(texts: pa.Array, templates: Templates) -> list[pa.Array]:
    n = len(texts)
    words, listed, codes, names = _listed(texts, templates.order)
    counts = words.counts
    doc = np.repeat(np.arange(n), counts)
    places: list[np.ndarray] = []
    base: list[set[str]] = [set() for _ in range(n)]
    for phrase, label in PHRASES.items():
        wanted = pc.index_in(pa.array([w.encode() for w in phrase.split()], names.type), names).to_pylist() if len(names) else [None]
        if None in wanted or len(codes) < len(wanted):
            continue
        last = len(codes) - len(wanted) + 1
        hit = np.ones(last, bool)
        for k, c in enumerate(wanted):
            hit &= codes[k : k + last] == c
        hit &= doc[:last] == doc[len(wanted) - 1 :]
        at = np.flatnonzero(hit)
        places.append(at)
        for d in np.unique(doc[at]).tolist():
            base[d].add(label)
    at = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
    n_base = np.bincount(doc[at], minlength=n)
    within = at - words.docs[doc[at]]
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(first, doc[at], within)
    np.maximum.at(last, doc[at], within)
    labels = [set(s) for s in base]
    score = np.where(n_base > 0, 1.0, 0.0)
    owner, which, share = templates.met(listed, doc)
    np.maximum.at(score, owner, share)
    for key in np.unique(owner * len(templates.labels) + which).tolist():
        labels[key // len(templates.labels)].add(templates.labels[key % len(templates.labels)])
    none = n_base == 0
    text = lambda s: ",".join(sorted(s))
    return [pa.array(counts), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([text(s) for s in base]), pa.array([text(s) for s in labels]), pa.array(score)]


def scanned(docs: DataFrame, keep: list[str], text: str = "text", templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """The columns `keep` of every row and its licenses."""
    templates = templates or TEMPLATES
    ordered = Templates(templates, frequencies(docs, templates, text), contained)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *scan(b.column("__text"), ordered)], [*keep, *names])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, f"{fields}, {SCHEMA}")


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Licence texts of a folder on any file system, by file name: a catalogue of whole texts for `scanned`, as bounded as
    the number of licences."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.txt)?$", 1).alias("label"), "value").collect()
    return {r["label"]: r["value"] for r in rows}


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir), ["doc_id"])


_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in TEMPLATES.items())
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w FROM d
), p(label, phrase) AS (
  VALUES ('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']), ('reserved', ['all', 'rights', 'reserved'])
), hits AS (
  SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, label, phrase, unnest(range(1, len(w) - len(phrase) + 2)) AS i FROM w, p WHERE len(w) >= len(phrase))
  WHERE w[i : i + len(phrase) - 1] = phrase
), base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY doc_id
), tpl AS (
  SELECT label, list_distinct(v) AS s, len(v) AS n FROM (SELECT label, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS v FROM (VALUES {_TEMPLATE_ROWS}) AS x(label, text))
), able AS (
  SELECT doc_id, w, label, s, ceil({CONTAINED} * len(s) - 1e-9) AS need, CAST(ceil({SLACK} * n - 1e-9) AS BIGINT) AS width FROM w, tpl WHERE len(list_intersect(w, s)) >= ceil({CONTAINED} * len(s) - 1e-9)
), met AS (
  SELECT doc_id, label, max(len(list_intersect(w[i : i + width - 1], s)) / len(s)) AS share FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM able)
  WHERE len(list_intersect(w[i : i + width - 1], s)) >= need GROUP BY doc_id, label
), lab AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM hits UNION ALL SELECT doc_id, label FROM met) GROUP BY doc_id
), best AS (
  SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN lab USING (doc_id) LEFT JOIN best USING (doc_id)
"""
