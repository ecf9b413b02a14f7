"""Language ID by a bit-sliced Bloom filter of byte 4-grams.

Each slot of the filter holds one bit for every language, so that the slots of an n-gram, and-ed, are the mask of all
languages that contain it. A text's language is the one whose bit is most often set, after what chance would set of a
filter that full has been taken off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import mixed, parts, per_row, utf8

#: Slots of the filter, hash functions, and documents of each language that it is fitted on (about, chosen by hash).
SLOTS, HASHES, SAMPLE = 1 << 18, 2, 1500
#: Part of a language's 4-grams from which one belongs to it (so each language has 1 / RARE at most), and how much rarer than in its most frequent language.
RARE, AGAINST = 2e-5, 0.08
UNKNOWN = "und"

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[:128] = [ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)]


def grams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-grams (as integers) of texts in lower case, other ASCII as blanks; and whether each counts: within a text, one blank at most."""
    b = _BYTES[buf]
    if len(b) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    n = len(b) - 3
    wide = b.astype(np.uint32)
    gram = wide[:n] | wide[1 : n + 1] << np.uint32(8) | wide[2 : n + 2] << np.uint32(16) | wide[3:] << np.uint32(24)
    blank = (b == 32).view(np.uint8)
    use = blank[:n] + blank[1 : n + 1] + blank[2 : n + 2] + blank[3:] <= 1
    for k in (1, 2, 3):
        ends = at[1:-1] - k
        use[ends[(ends >= 0) & (ends < n)]] = False
    return gram, use


def slots(gram: np.ndarray) -> list[np.ndarray]:
    h = mixed(gram.astype(np.uint64))
    return [(h >> np.uint64(20 * k)) & np.uint64(SLOTS - 1) for k in range(HASHES)]


class Filter:
    """The fitted filter: languages, and for each 64 of them the slots' masks."""

    def __init__(self, grams_of: dict[str, np.ndarray]):
        self.names = sorted(grams_of)
        self.masks = np.zeros((-(-len(self.names) // 64) or 1, SLOTS), np.uint64)
        for i, name in enumerate(self.names):
            for s in slots(grams_of[name]):
                self.masks[i // 64, s.astype(np.int64)] |= np.uint64(1 << i % 64)
        full = [((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.names))]
        self.chance = np.array(full) ** HASHES
        if len(self.names) <= 8:
            self.masks = self.masks.astype(np.uint8)  # a small filter stays in the processor's cache

    def predict(self, buf: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is the language's part of all languages' corrected counts."""
        rows = len(at) - 1
        if not self.names:
            return [UNKNOWN] * rows, np.zeros(rows)
        gram, use = grams(buf, at)
        where = np.flatnonzero(use)
        at = np.searchsorted(where, at)
        n = np.diff(at)
        places = slots(gram[where])
        hits = np.zeros((rows, len(self.names)))
        for word, slot in enumerate(self.masks):
            mask = slot[places[0]]
            for p in places[1:]:
                mask &= slot[p]
            for i in range(64 * word, min(64 * word + 64, len(self.names))):
                hits[:, i] = per_row((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), at)
        true = np.clip((hits - n[:, None] * self.chance) / np.maximum(1 - self.chance, 1e-9), 0, None)
        best = true.argmax(1)
        total = true.sum(1)
        score = np.divide(true[np.arange(rows), best], total, out=np.zeros(rows), where=total > 0)
        return [self.names[i] for i in best], score


def fit(docs: DataFrame, sample: int = SAMPLE) -> Filter:
    """The filter from rows with text and lang, about `sample` documents of each language.

    The driver gets counts by language, and for each language the 4-grams over RARE, of which there are 1 / RARE at most.
    """
    docs = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    counts = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return Filter({})
    part = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n)))), F.col("lang"))
    some = docs.where(F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 30)) < part * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            for lang in pc.unique(b.column("lang")).to_pylist():
                own = b.filter(pc.equal(b.column("lang"), lang))
                gram, use = grams(*utf8(own.column("text")))
                found, n = np.unique(gram[use], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    text = F.lower("text").alias("text")
    rate = some.select("doc_id", text, "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = {r[0]: r[1] for r in rate.groupBy("lang").agg(F.sum("n")).collect()}
    if not total:
        return Filter({k: np.zeros(0, np.uint32) for k in counts})
    of = F.element_at(F.create_map(*(F.lit(x) for k, n in total.items() for x in (k, float(n)))), F.col("lang"))
    kept = rate.withColumn("p", F.col("n") / of).where((F.col("p") >= RARE) & (F.col("n") > 1)).toPandas()
    top = kept.groupby("gram")["p"].transform("max")
    kept = kept[kept["p"] >= AGAINST * top]
    return Filter({k: kept.loc[kept["lang"] == k, "gram"].to_numpy(np.uint32) for k in counts})


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred, score of each document; the rest of its columns are not read.

    `und` with score 0 if the text is null, empty or without a letter, or if nothing was learned; of languages with
    equal counts the first by name; repeated rows come out repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS masks, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            names, score = shared.value.predict(*utf8(b.column("text")))
            letter = b.column("letter").to_pylist()
            out = [x if ok else UNKNOWN for x, ok in zip(names, letter)]
            score = [float(s) if ok else 0.0 for s, ok in zip(score, letter)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return docs.select("doc_id", F.lower("text").alias("text"), letter).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
