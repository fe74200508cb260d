"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams (1 to 3 bytes of lower-cased words with a blank on either
side). A document's own most frequent n-grams are compared with each profile by the out-of-place distance: the sum of
the differences in rank, with a fixed penalty for an n-gram that the profile lacks. The nearest profile wins.

Profiles are learned from a bounded sample of labelled documents (TRAIN_DOCS for each language, chosen by a hash of
doc_id, whole texts); counting is a Spark aggregation, and only the finished profiles reach the driver and are
broadcast: PROFILE n-grams for each language. Their size follows the number of languages, not of documents.

Defined results: a text that is null, empty or without a letter is `und` with score 0, as is every text where nothing
was labelled; ties go to the language that sorts first; repeated rows are predicted alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, buffer_of, documents

PROFILE = 300
TRAIN_DOCS = 600
UNKNOWN = "und"
_PIECE = 1 << 20

#: ASCII letters in lower case and the bytes of all other letters; the rest is blank.
_LETTERS = LOWER.copy()
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def gram_counts(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a text's bytes; a code is length and bytes in one number."""
    x = np.full(len(text) + 2, 0x20, np.uint8)
    x[1:-1] = _LETTERS[text]
    blank = x == 0x20
    x = x[~(blank & np.r_[False, blank[:-1]])]
    codes, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for a in range(0, len(x), _PIECE):
        y = x[a : a + _PIECE + 2].astype(np.uint32)
        n = min(_PIECE, len(x) - a)
        one = y[:n]
        two = (y[:-1] << 8 | y[1:])[:n]
        three = (y[:-2] << 16 | y[1:-1] << 8 | y[2:])[:n][y[1:-1][:n] != 0x20]
        found = np.sort(np.concatenate([one[one != 0x20] | 1 << 24, two | 2 << 24, three | 3 << 24]))
        at = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
        new, times = found[at], np.diff(np.r_[at, len(found)])
        if a:
            codes, back = np.unique(np.concatenate([codes, new]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, times])).astype(np.int64)
        else:
            codes, counts = new, times
    return codes, counts


def top_grams(text: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """Codes by descending count, then ascending code."""
    codes, counts = gram_counts(text)
    if not len(codes):
        return codes
    order = np.sort((counts.max() - counts).astype(np.uint64) << np.uint64(32) | codes)
    return (order[:size] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def has_letter(text: np.ndarray) -> bool:
    folded = _LETTERS[text]
    return bool(((folded >= 97) & (folded <= 122)).any()) or bool((folded >= 128).any()) and any(map(str.isalpha, text.tobytes().decode(errors="replace")))


class Profiles:
    """Languages, and the rank of each profile n-gram in each language; size marks an absent one."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.languages = sorted(profiles)
        self.size = size
        self.codes = np.array(sorted({c for p in profiles.values() for c in p}), np.uint32)
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), size, np.int32)
        for k, name in enumerate(self.languages):
            self.ranks[np.searchsorted(self.codes, np.array(profiles[name], np.uint32)), k] = np.arange(len(profiles[name]))

    def predict(self, text: np.ndarray) -> tuple[str, float]:
        if not self.languages or not len(text) or not has_letter(text):
            return UNKNOWN, 0.0
        grams = top_grams(text, self.size)
        at = np.searchsorted(self.codes, grams)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == grams
        ranks = self.ranks[np.where(known, at, len(self.codes))]
        apart = np.abs(ranks - np.arange(len(grams), dtype=np.int32)[:, None])
        apart[ranks == self.size] = self.size
        total = apart.sum(0)
        best = int(total.argmin())
        return self.languages[best], float(1 - total[best] / (self.size * len(grams)))


def learn(labelled: DataFrame, per_language: int = TRAIN_DOCS, size: int = PROFILE) -> Profiles:
    """Profiles from rows of doc_id, text, lang; rows without text or lang don't count."""
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(per_language) / F.count("*")).alias("_share"))
    bucket = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20))
    picked = rows.join(F.broadcast(counts), "lang").where(bucket < F.col("_share") * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffer_of(batch.column(0))
            for i, name in enumerate(batch.column(1).to_pylist()):
                codes, times = gram_counts(data[at[i] : at[i + 1]])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(times.astype(np.int64))], ["lang", "gram", "n"])

    grams = picked.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in grams.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(profiles, size)


def predicted(profiles: Profiles, text: Column, spark: SparkSession) -> Column:
    """A struct column of lang_pred and score for a text column."""
    shared = spark.sparkContext.broadcast(profiles)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        data, at = buffer_of(texts)
        found = [shared.value.predict(data[at[i] : at[i + 1]]) for i in range(len(texts))]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], fields=list(kind))

    return run(text)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    profiles = learn(docs.where(~F.col("held_out")))
    return docs.withColumn("_p", predicted(profiles, F.col("text"), spark)).select("doc_id", "held_out", "_p.lang_pred", "_p.score")
