"""Secret scans: three fixed patterns, and strings that a Markov model of random characters explains better than one of identifiers.

Both models are chains of order 2 over character classes of their own (each printable ASCII character is a symbol),
trained by counting on labelled samples: `random` ones are drawn here from the alphabets that keys are made of, by a
fixed seed; `ordinary` ones are identifiers from a bounded sample of the documents, without what the patterns find, and
names as programs have them, put together from those.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import parts

KINDS = ("assign", "access", "hex", "random")
_word = "".join  # letters in either case, ASCII only
ASSIGN = re.compile(
    "(?:%s)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    % "|".join(_word(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
#: What may be a secret by its looks: long enough, with a letter, not within a longer word.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}")
IDENTIFIER = re.compile(r"[A-Za-z0-9+/_=-]{4,64}")
HINTS = ("passw", "secret", "token", "api")
ALPHABETS = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "-_")
#: Documents in the sample of ordinary identifiers, and identifiers taken of each.
SAMPLE, EACH = 2000, 200
#: Mean log-likelihood ratio of a character, in nats, from which a candidate is a secret.
LEAST = 0.9


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of what the patterns find, in code points."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as disjoint ones, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def overlaps(spans: list[tuple[int, int]], s: int, e: int) -> bool:
    """Whether one of some disjoint spans in order has a place of s..e."""
    k = bisect_left(spans, (e,))
    return k > 0 and spans[k - 1][1] > s


def training_strings(n: int = 4000, seed: int = 7) -> list[str]:
    """Labelled random strings."""
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABETS[i % len(ALPHABETS)], k=rng.randrange(16, 48))) for i in range(n)]


def identifier_forms(words: list[str], n: int = 8000, seed: int = 11) -> list[str]:
    """Names as programs have them, put together from plain words: snake, kebab and camel case, constants, with and without a number."""
    rng, plain = random.Random(seed), [w.lower() for w in words if w.isalpha() and w.isascii() and len(w) <= 12]
    out = []
    for i in range(n if plain else 0):
        parts = rng.choices(plain, k=rng.randrange(2, 5))
        form = ("_".join(parts), "-".join(parts), parts[0] + "".join(p.capitalize() for p in parts[1:]), "".join(p.capitalize() for p in parts), "_".join(parts).upper(), "/".join(parts))[i % 6]
        out.append(form + (f"{rng.choice(('', '_', '-'))}{rng.randrange(100)}" if rng.random() < 0.4 else ""))
    return out


class Chains:
    """Log-likelihood ratio of random against ordinary, by two chains of order 2."""

    def __init__(self, random_strings: list[str], ordinary: list[str]):
        self.ratio = self._logs(random_strings) - self._logs(ordinary)

    @staticmethod
    def _codes(s: str) -> np.ndarray:
        return np.frombuffer(b"\x20\x20" + s.encode("latin-1", "replace"), np.uint8).astype(np.int64) % 128

    @classmethod
    def _logs(cls, strings: list[str]) -> np.ndarray:
        """Smoothed: order 2 backs off to order 1, and that to 0."""
        three = np.zeros((128, 128, 128), np.float32)
        for s in strings:
            c = cls._codes(s)
            np.add.at(three, (c[:-2], c[1:-1], c[2:]), 1)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 0.5) / (one.sum() + 64)
        p2 = (two + 8 * p1) / (two.sum(1, keepdims=True) + 8)
        p3 = (three + 8 * p2[None]) / (three.sum(2, keepdims=True) + 8)
        return np.log(p3).astype(np.float32)

    def score(self, s: str) -> float:
        """Mean ratio of a character."""
        c = self._codes(s)
        return float(self.ratio[c[:-2], c[1:-1], c[2:]].mean())


def ordinary_sample(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Identifiers from about `sample` documents, chosen by hash; at most EACH of a document, so bounded."""
    texts = docs.select("doc_id", "text").where("text is not null")
    n = texts.count()
    some = texts.where(F.pmod(F.xxhash64(F.lit("ordinary"), "doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, n))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                for s, _, e in reversed(base_spans(t)):
                    t = t[:s] + " " + t[e:]
                found = IDENTIFIER.findall(t)
                out += found if len(found) <= EACH else [found[k * len(found) // EACH] for k in range(EACH)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["word"])

    # Counted before they are collected: one row for each distinct word, of which the sample's bound holds.
    rows = some.select("text").mapInArrow(run, "word string").groupBy("word").count().collect()
    return sorted(w for w, n in ((r[0], r[1]) for r in rows) if not (n == 1 and len(w) >= 16 and re.search("[0-9]", w)))


def scan(docs: DataFrame, chains: Chains | None = None) -> DataFrame:
    """doc_id, text's spans as structs (kind, start, end, score) by start, then kind; code points, end exclusive.

    A null text counts as empty and has no spans; repeated rows come out repeated. Spans of kind `random` are those
    that the chains add, where no pattern has found anything; spans of the patterns have no score.
    """
    if chains is None:
        words = ordinary_sample(docs)
        chains = Chains(training_strings(), words + identifier_forms(words))
    shared = docs.sparkSession.sparkContext.broadcast(chains.ratio)  # 8 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chains.__new__(Chains)
        own.ratio = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float32())]))
        for part in parts(batches):
            out = []
            for t in part.column("text").to_pylist():
                found = [(*x, None) for x in base_spans(t)] if t else []
                if t:
                    taken = merged((s, e) for s, _, e, _ in found)
                    for m in CANDIDATE.finditer(t):
                        s, e = m.span()
                        if not overlaps(taken, s, e) and (score := own.score(m[0])) >= LEAST:
                            found.append((s, 3, e, score))
                out.append([{"kind": KINDS[k], "start": s, "end": e, "score": r} for s, k, e, r in sorted(found, key=lambda x: x[:3])])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,score:float>>")


def report(spans: DataFrame) -> DataFrame:
    """Counts and digests of what scan() returns, a row for each of its rows; without spans counts are 0 and both lists empty."""
    joined = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(joined(lambda x: x.kind != "random").cast("binary"), 256)
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), base.alias("base_sha256"), joined(lambda x: x.kind.isNotNull()).alias("spans"), count("random"))
