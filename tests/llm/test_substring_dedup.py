from collections import Counter
import hashlib
import random

import numpy as np
import pytest

from leafmill.llm import substrings
from leafmill.llm.common import parts
from leafmill.llm.queries import op8_substring_dedup
from tests.conftest import SMALL
from tests.llm.cases import HARD, documents, empty, hard

DEPTH = substrings.DEPTH


def slow(texts):
    """(length, removed bytes, spans, what stays) of each text."""
    data = [(t or "").encode() for t in texts]
    seen, twice = set(), set()
    for d in data:
        for i in range(len(d) - DEPTH + 1):
            w = hash(d[i : i + DEPTH])
            (twice if w in seen else seen).add(w)
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - DEPTH + 1):
            if hash(d[i : i + DEPTH]) in twice:
                gone[i : i + DEPTH] = True
        keep = np.frombuffer(d, np.uint8)[~gone[:-1]].tobytes()
        out.append((len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), keep))
    return out


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh éü日") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, long = [prose(rng.randrange(60, 130)) for _ in range(4)], prose(900)
    texts = [prose(30) + s + prose(40) for s in shared for _ in range(3)]
    texts += [shared[0][5:] + shared[1], shared[2] + shared[2], prose(400), long, long[300:1200], "x" * 399, "x" * 400, "x" * 401, "ab" * 500, "", None]
    exact = (prose(200).encode()[:DEPTH]).decode(errors="ignore")
    texts += [prose(20) + exact + prose(20), prose(10) + exact[:-1] + "!", exact, prose(900), prose(3) + long]
    return texts


@pytest.mark.parametrize("seed, chunk", [(1, 1 << 20), (2, 2000), (3, 1)])
def test_against_brute_force(spark, monkeypatch, seed, chunk):
    """Whether documents meet in one slice or only after the shuffle."""
    texts = fixture(seed)
    monkeypatch.setattr("leafmill.llm.common.parts.__defaults__", ("text", chunk))
    df = documents(spark, *texts).repartition(1 if chunk > 10_000 else 6)
    got = {r["doc_id"]: r for r in substrings.report(df).collect()}
    for i, (n, removed, spans, keep) in enumerate(slow(texts)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, hashlib.sha256(keep).hexdigest()), i


def test_one_passage_in_very_many_documents(spark):
    """More than HOT contexts of one passage, in several slices."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = noise(700)
    texts = [noise(rng.randrange(300)) + passage[rng.randrange(60) : 700 - rng.randrange(60)] + noise(rng.randrange(300)) for _ in range(60)] + ["z" * 1000] * 5
    got = {r["doc_id"]: r for r in substrings.report(documents(spark, *texts).repartition(5)).collect()}
    for i, (n, removed, spans, keep) in enumerate(slow(texts)):
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (removed, spans, hashlib.sha256(keep).hexdigest()), i


def test_documents(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op8_substring_dedup(spark, SMALL).collect()}
    want = slow([r["text"] for r in rows])
    assert len(got) == len(rows) and any(w[1] for w in want)
    for r, (n, removed, spans, keep) in zip(rows, want):
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == (n, removed, spans, hashlib.sha256(keep).hexdigest())


def test_hard_cases(spark):
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in substrings.report(hard(spark)).collect())
    want = sorted((i or 0, n, removed, hashlib.sha256(keep).hexdigest()) for (i, *_), (n, removed, _, keep) in zip(HARD, slow([t for _, t, *_ in HARD])))
    assert got == want
    assert sorted((r["doc_id"] or 0, bytes(r["kept"])) for r in substrings.remove(hard(spark)).collect()) == sorted((i or 0, keep) for (i, *_), (*_, keep) in zip(HARD, slow([t for _, t, *_ in HARD])))
    assert substrings.report(empty(spark)).count() == substrings.remove(empty(spark)).count() == 0
    twice = [(1, "q" + "w" * 50 + "text" * 200)] * 2 + [(None, "text that is long " * 30)] * 2
    r = substrings.report(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert all(x["n_removed"] == x["n_bytes"] for x in r) and len(r) == 4


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 1000, 400).astype(np.uint64)
    for width in (1, 2, 7, 64, 399, 400):
        assert substrings.sliding_min(x, width).tolist() == [int(x[i : i + width].min()) for i in range(400 - width + 1)]


@pytest.mark.parametrize("limit, remembered", [(900, 1 << 19), (900, 40), (5000, 1 << 19)])
def test_digits_that_come_again_and_again(monkeypatch, limit, remembered):
    """Passes over many slices in one task, and over two tasks: the same windows as by brute force, though hot digits are sent twice only."""
    import pyarrow as pa

    monkeypatch.setattr(substrings, "parts", lambda batches: parts(batches, limit=limit))
    monkeypatch.setattr(substrings, "REMEMBERED", remembered)
    rng = random.Random(limit + remembered)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = [noise(700), noise(450), "z" * 900]
    texts = [noise(rng.randrange(300)) + rng.choice(shared) + noise(rng.randrange(300)) for _ in range(60)] + [noise(600) for _ in range(10)] + [rng.choice(shared)[20:-15] for _ in range(20)]
    rng.shuffle(texts)
    batch = lambda ids, **more: pa.table({"doc_id": pa.array(ids, pa.int64()), "same": pa.array(ids, pa.int64()), "text": [texts[i] for i in ids], **more}).combine_chunks().to_batches()
    halves = [list(range(45)), list(range(45, len(texts)))]

    def shuffled(rows, *by):
        return pa.Table.from_batches(rows).sort_by([(k, "ascending") for k in by]).to_batches(max_chunksize=50)

    sent = [b for ids in halves for b in substrings._first_pass(iter(batch(ids)))]
    found = pa.Table.from_batches(list(substrings._second_pass(iter(shuffled(sent, "c1", "c2", "hull"))))).to_pylist()
    marks = {i: [r for r in found if r["doc_id"] == i and r["kind"] in (substrings.LAST, substrings.SHOW)] for i in range(len(texts))}
    kind = pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32()), ("kind", pa.int32())]))
    last = []
    for ids in halves:
        ids = [i for i in ids if marks[i]]
        if ids:
            last += substrings._third_pass(iter(batch(ids, marks=pa.array([[{k: r[k] for k in ("s", "n", "kind")} for r in marks[i]] for i in ids], kind))))
    done = [r for r in found if r["kind"] == substrings.REPEATED]
    if last:
        done += pa.Table.from_batches(list(substrings._last_pass(iter(shuffled(last, "c1", "c2"))))).to_pylist()
    got = {i: {w for r in done if r["doc_id"] == i for w in range(r["s"], r["s"] + r["n"])} for i in range(len(texts))}
    count = Counter(t[w : w + 400] for t in texts for w in range(len(t) - 399))
    assert got == {i: {w for w in range(len(t) - 399) if count[t[w : w + 400]] > 1} for i, t in enumerate(texts)}
