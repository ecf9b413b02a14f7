"""The counts of functions.quality.counts() for a column of texts, by an array of classes instead of a dozen regular expressions.

A chunk of texts is taken as one array of code points, so memory goes with a chunk (or the longest text), not the batch.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import charclass as cc

NAMES = ["chars", "indic", "arabic", "latin", "bad", "private", "replaced", "foreign", "orphans", "indic_words", "mixed", "words"]
DDL = f"struct<{','.join(f'{n}:int' for n in NAMES)}>"
OUT = pa.struct([(n, pa.int32()) for n in NAMES])
SPACE, LATIN, BAD, INDIC, ARABIC, PRIVATE, REPLACED, FOREIGN, MARK, BASE = (1 << k for k in range(10))
#: Code points of a chunk, unless one text has more.
CHUNK = 1 << 20


@cache
def unassigned() -> tuple[tuple[int, int], ...]:
    """Runs of code points to which the JVM's Unicode has no character; texts have no surrogates."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    known = SparkSession.active()._jvm.java.util.regex.Pattern.compile(cc.UNASSIGNED + "+").matcher(every).replaceAll("")
    gone = np.ones(0x110000, bool)
    gone[np.frombuffer(known.encode("utf-32-le"), "<u4")] = False
    gone[0xD800:0xE000] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return tuple((int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2]))


@cache
def _classes(none: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each code point the number of its set of flags, and the flags of each number."""

    def of(inside: str) -> np.ndarray:
        out = np.zeros(0x110000, bool)
        for a, b in re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", inside):
            out[int(a, 16) : int(b or a, 16) + 1] = True
        return out

    blank, latin, bad, indic, arabic = map(of, (cc.WS, cc.LATIN, cc.BAD, cc.INDIC, cc.ARABIC))
    for a, b in none:
        bad[a : b + 1] = True
    bad &= ~(blank | latin)
    good = ~(blank | latin | bad)
    replaced = np.arange(0x110000) == cc.REPLACEMENT
    parts = {SPACE: blank, LATIN: latin, BAD: bad, INDIC: indic & good, ARABIC: arabic & good, PRIVATE: of(cc.PRIVATE), REPLACED: replaced, FOREIGN: good & ~(indic | arabic | of(cc.COMMON)), MARK: of(cc.MARK), BASE: of(cc.BASE)}
    flags = sum(np.where(on, flag, 0) for flag, on in parts.items())
    sets, number = np.unique(flags, return_inverse=True)
    return number.astype(np.uint8), sets


def count(texts: list[str], none: tuple[tuple[int, int], ...]) -> np.ndarray:
    """A row of NAMES for each text."""
    number, sets = _classes(none)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n, starts = len(texts), np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    kind = number[points]
    per = np.bincount(row * np.int64(len(sets)) + kind, minlength=n * len(sets)).reshape(n, len(sets))
    total = lambda flag: per @ ((sets & flag) > 0).astype(np.int64)
    out = np.zeros((n, len(NAMES)), np.int64)
    for k, flag in ((1, INDIC), (2, ARABIC), (3, LATIN), (4, BAD), (5, PRIVATE), (6, REPLACED), (7, FOREIGN)):
        out[:, k] = total(flag)
    out[:, 0] = sizes - total(SPACE)
    is_a = lambda flag: ((sets & flag) > 0)[kind]
    blank = is_a(SPACE)
    first = np.zeros(len(points) + 1, bool)
    first[starts] = True
    first = first[:-1]
    begins = ~blank
    begins[1:] &= blank[:-1] | first[1:]
    of_word = row[begins]
    out[:, 11] = np.bincount(of_word, minlength=n)
    if out[:, 1].any():
        word = np.cumsum(begins) - 1
        has = lambda flag: np.bincount(word[is_a(flag)], minlength=len(of_word)) > 0
        indic = has(INDIC)
        out[:, 9] = np.bincount(of_word[indic], minlength=n)
        out[:, 10] = np.bincount(of_word[indic & has(FOREIGN)], minlength=n)
        based = np.zeros(len(points), bool)
        based[1:] = is_a(BASE)[:-1] & ~first[1:]
        out[:, 8] = np.bincount(row[is_a(MARK) & ~based], minlength=n) * (out[:, 1] > 0)
    return out


def counts_of(text: Column) -> Column:
    """The struct of quality.counts(); null text counts as empty."""
    none = unassigned()

    def run(texts: pa.Array) -> pa.Array:
        out, some, size = [np.zeros((0, len(NAMES)), np.int64)], [], 0
        for t in texts.cast(pa.binary()):
            some.append((t.as_py() or b"").decode("utf-8", "replace"))
            size += len(some[-1])
            if size >= CHUNK:
                out.append(count(some, none))
                some, size = [], 0
        if some:
            out.append(count(some, none))
        every = np.concatenate(out).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in every.T], fields=list(OUT))

    return F.arrow_udf(run, DDL)(text)
