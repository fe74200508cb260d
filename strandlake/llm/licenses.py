"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a run of as many consecutive words as a template has (the whole text, where that is shorter); every start is a
block. A block meets a template where its distinct words contain at least CONTAINMENT of the template's distinct words.
The join finds all such pairs. Tokens are ordered by their global frequency: counts over all documents, of the templates'
words only, since no other word adds to an intersection. Then, of a template of m words that asks for k common ones:

- prefix filter: a block that meets it holds one of its m - k + 1 rarest words. An index from these words to templates
  gives the candidates, so a text is compared with no template that it has no rare word of;
- length filter: a text of fewer than k words can't meet it;
- positional filter: where the rarest common word is the i-th of the template, only the m - i - 1 more frequent ones can
  be common besides; and no more than the places within a block's reach that hold one of these. A place that can't add
  up to k is no candidate.

Texts with candidates are verified exactly: each place of a template's word opens and closes a range of starts for which it
is the last place of that word in the block, so one running sum gives the size of the intersection at every start, in
time linear in the text, however many blocks meet. Each maximal run of starts that meet is one finding, with its best block.

Words are compared as 64-bit hashes of their bytes. Documents are never shuffled: the templates and their index are a
parameter of the library (a few thousand words), which is all that is broadcast.

Words are runs of ASCII letters, digits and code points from 128 on, with A-Z lower-cased. Defined results: a null or
empty text has no words, labels or findings and score 0; repeated rows are judged alike; equal templates each match; no
templates leave the phrases alone; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Words, documents, words_of
from .resample import BLANK

CONTAINMENT = 0.9
_ROWS, _SIEVE = 1024, 16

#: Phrases that name a license, by label. Fixed values.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Notices as their licenses ask to give them, by label. Fixed values.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]


def words_in(column: pa.Array) -> Words:
    return words_of(column, BLANK, LOWER)


def _hashes(text: str) -> np.ndarray:
    return words_in(pa.array([text])).hash


class Template:
    """A template in the global order: its words' ranks, rarest first, and what a block must have."""

    def __init__(self, label: str, words: np.ndarray, ranks: np.ndarray, containment: float):
        self.label, self.n = label, len(words)
        self.ranks = np.sort(ranks)
        self.m = len(self.ranks)
        self.k = max(1, math.ceil(containment * self.m - 1e-9))
        self.prefix = self.ranks[: self.m - self.k + 1]


class Scanner:
    """Templates with an index by rare words, and phrases; a plain value that Spark ships."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], frequency: dict[int, int], containment: float = CONTAINMENT):
        texts = [(label, _hashes(text)) for label, text in templates]
        texts = [(label, h) for label, h in texts if len(h)]
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in texts)]))
        # Rarest first; words equally frequent by hash, which is the same everywhere.
        order = np.lexsort((vocabulary, [frequency.get(int(h.view(np.int64)), 0) for h in vocabulary])) if len(vocabulary) else np.zeros(0, np.int64)
        self.words = vocabulary
        self.rank = np.empty(len(vocabulary), np.int64)
        self.rank[order] = np.arange(len(vocabulary))
        self.templates = [Template(label, h, self.rank[np.searchsorted(vocabulary, np.unique(h))], containment) for label, h in texts]
        self.prefixes = np.zeros((len(self.templates), len(vocabulary)), bool)
        self.members = np.full((len(self.templates), len(vocabulary)), -1, np.int64)  # place of a word in a template, by rank
        for i, t in enumerate(self.templates):
            self.prefixes[i, t.prefix] = True
            self.members[i, t.ranks] = np.arange(t.m)
        self.rare = self.prefixes.any(0)
        self.sieve = np.zeros(1 << _SIEVE, bool)
        self.sieve[vocabulary >> np.uint64(64 - _SIEVE)] = True
        self.phrases = [(label, _hashes(phrase)) for label, phrase in phrases.items()]

    def places(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Where a word of some template stands, and the word's rank."""
        at = np.flatnonzero(self.sieve[w.hash >> np.uint64(64 - _SIEVE)])
        k = np.searchsorted(self.words, w.hash[at])
        known = self.words[np.minimum(k, len(self.words) - 1)] == w.hash[at] if len(self.words) else np.zeros(len(at), bool)
        return at[known], self.rank[k[known]]

    def candidates(self, i: int, w: Words, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Rows that may hold a block that meets template i; `at` and `rank` are the places of its words."""
        t = self.templates[i]
        place = self.members[i, rank]
        row = w.row[at]
        size = np.diff(w.first)[row]
        hits = np.flatnonzero((place <= t.m - t.k) & (size >= t.k))  # prefix and length
        # Places of its words, in the block's reach, around a hit that would be the rarest common word.
        low = np.searchsorted(at, np.maximum(at[hits] - t.n + 1, w.first[row[hits]]))
        high = np.searchsorted(at, np.minimum(at[hits] + t.n, w.first[row[hits] + 1]))
        most = np.minimum(t.m - place[hits], high - low)
        return np.unique(row[hits[most >= t.k]])

    def blocks(self, i: int, w: Words, at: np.ndarray, rank: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Row, first and last start of each run of blocks that meet template i, its greatest intersection, and where."""
        t = self.templates[i]
        row = w.row[at]
        mine = np.flatnonzero(np.isin(row, rows))
        at, rank, row = at[mine], rank[mine], row[mine]
        order = np.lexsort((at, rank, row))
        before = np.full(len(at), -1, np.int64)
        same = (row[order][1:] == row[order][:-1]) & (rank[order][1:] == rank[order][:-1])
        before[order[1:][same]] = at[order[:-1][same]]
        # Starts for which this is the block's first place of its word: after the place before, and within reach.
        first, last = w.first[row], np.maximum(w.first[row], w.first[row + 1] - t.n)
        low, high = np.maximum(np.maximum(before + 1, at - t.n + 1), first), np.minimum(at, last)
        real = low <= high
        edge = np.r_[low[real], high[real] + 1]
        step = np.r_[np.ones(real.sum(), np.int64), np.full(real.sum(), -1, np.int64)]
        order = np.lexsort((-step, edge))
        edge, total = edge[order], np.cumsum(step[order])
        keep = np.r_[edge[1:] != edge[:-1], True]
        edge, total = edge[keep], total[keep]
        meets = np.flatnonzero(total >= t.k)
        if not len(meets):
            return
        rows_of = w.row[edge[meets]]
        cuts = np.flatnonzero((np.diff(meets) > 1) | (np.diff(rows_of) > 0)) + 1
        for run in np.split(meets, cuts):
            best = run[int(total[run].argmax())]
            yield int(w.row[edge[run[0]]]), int(edge[run[0]]), int(edge[run[-1] + 1] - 1), int(total[best]), int(edge[best])

    def scan(self, texts: pa.Array) -> list[dict]:
        """For each text its words, phrases and blocks."""
        w = words_in(texts)
        sizes = np.diff(w.first)
        out = [{"n_words": int(n), "phrases": [], "blocks": []} for n in sizes]
        for label, phrase in self.phrases:
            hit = np.flatnonzero(w.hash[: max(0, len(w.hash) - len(phrase) + 1)] == phrase[0]) if len(phrase) else []
            for k in range(1, len(phrase)):
                hit = hit[w.hash[hit + k] == phrase[k]]
            for p in np.asarray(hit).tolist():
                r = int(w.row[p])
                if w.row[p + len(phrase) - 1] == r:
                    out[r]["phrases"].append({"label": label, "start_word": p - int(w.first[r])})
        at, rank = self.places(w)
        if not self.rare[rank].any():
            return out
        for i in np.flatnonzero(self.prefixes[:, np.unique(rank)].any(1)).tolist():
            t = self.templates[i]
            mine = self.members[i, rank] >= 0
            rows = self.candidates(i, w, at[mine], rank[mine])
            if not len(rows):
                continue
            for r, first, last, common, best in self.blocks(i, w, at[mine], rank[mine], rows):
                a = int(w.first[r])
                out[r]["blocks"].append({"label": t.label, "template": i, "start_word": best - a, "n_words": min(t.n, int(sizes[r])), "containment": common / t.m, "first_start": first - a, "last_start": last - a})
        return out


def frequencies(docs: DataFrame, templates: list[tuple[str, str]], text: str = "text") -> dict[int, int]:
    """How often each word of the templates occurs in all documents; a row for each such word leaves a task."""
    wanted = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_hashes(t) for _, t in templates)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted) + 1, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                h = words_in(batch.column(0).slice(a, _ROWS)).hash
                k = np.searchsorted(wanted, h)
                k[wanted[np.minimum(k, len(wanted) - 1)] != h] = len(wanted)
                total += np.bincount(k, minlength=len(wanted) + 1)
        at = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(wanted[at].view(np.int64)), pa.array(total[at])], ["word", "n"])

    if not len(wanted):
        return {}
    counted = docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def learn(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT) -> Scanner:
    """A scanner whose words are ordered by their frequency in these documents."""
    return Scanner(templates, phrases, frequencies(docs, templates), containment)


_BLOCK = [("label", "string", pa.string()), ("template", "int", pa.int32()), ("start_word", "long", pa.int64()), ("n_words", "long", pa.int64()), ("containment", "double", pa.float64()), ("first_start", "long", pa.int64()), ("last_start", "long", pa.int64())]
_PHRASE = [("label", "string", pa.string()), ("start_word", "long", pa.int64())]
FOUND = f"n_words long, phrases array<struct<{','.join(f'{n}:{k}' for n, k, _ in _PHRASE)}>>, blocks array<struct<{','.join(f'{n}:{k}' for n, k, _ in _BLOCK)}>>"


def found(scanner: Scanner, text: Column, spark: SparkSession) -> Column:
    """A struct column of n_words, phrases (label, start_word) and blocks (label, template, best block, range of starts)."""
    shared = spark.sparkContext.broadcast(scanner)
    lists = [pa.list_(pa.struct([(n, k) for n, _, k in fields])) for fields in (_PHRASE, _BLOCK)]
    kind = pa.struct([("n_words", pa.int64()), ("phrases", lists[0]), ("blocks", lists[1])])

    @F.arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for a in range(0, len(texts), _ROWS):
            out += shared.value.scan(texts.slice(a, _ROWS))
        return pa.array(out, kind)

    return run(text)


def licensed(docs: DataFrame, scanner: Scanner, text: str = "text") -> DataFrame:
    """doc_id with words, phrases, labels of both kinds, score and blocks.

    The score is the greatest containment of what was found: 1 for a phrase, which is there in full.
    """
    rows = docs.select("doc_id", found(scanner, F.col(text), docs.sparkSession).alias("_f")).select("doc_id", "_f.*")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    start = F.col("phrases.start_word")
    best = F.greatest(F.when(F.size("phrases") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        joined(F.col("phrases.label")).alias("base_labels"), joined(F.concat("phrases.label", "blocks.label")).alias("labels"), best.alias("score"), "blocks",
    )


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return licensed(docs, learn(docs)).drop("blocks")
