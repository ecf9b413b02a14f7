import random

import numpy as np
import pytest

from leafmill.llm import decontam
from leafmill.llm.queries import op2_decontamination
from tests.llm.cases import HARD, documents, empty, hard

LARGER = "/root/testdata/sf0.01"


def words(text):
    return "".join(c.lower() if c.isascii() else c for c in "".join(c if not c.isascii() or c.isalnum() else " " for c in text or "")).split()


def slow_distance(item, text):
    """Edits of the whole item against the best part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_match_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(300):
        item, text = (rng.integers(0, 5, rng.integers(1, 30)).astype(np.uint64) for _ in range(2))
        limit = int(rng.integers(0, 8))
        want, got = slow_distance(item.tolist(), text.tolist()), decontam.edit_match(item, text, limit)
        assert (got is None) == (want > limit)
        if got:
            part = text[got[1] : got[2]].tolist()
            row = list(range(len(part) + 1))  # the part it names is within that distance as a whole
            for i, x in enumerate(item.tolist(), 1):
                new = [i]
                for j, y in enumerate(part, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
            assert got[0] == want == row[-1]


def edited(rng, item, share, vocabulary):
    out = list(item)
    for _ in range(int(len(item) * share)):
        at = rng.randrange(len(out))
        match rng.randrange(3):
            case 0:
                out[at] = rng.choice(vocabulary)
            case 1:
                out.insert(at, rng.choice(vocabulary))
            case _:
                del out[at]
    return out


@pytest.mark.parametrize("share, least", [(0.0, 1.0), (0.05, 1.0), (0.1, 0.98), (0.15, 0.95), (0.2, 0.9)])
def test_recall(spark, share, least):
    """Of planted items with a share of edits, those found; and nothing that isn't within the limit."""
    rng = random.Random(int(share * 100))
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))] for _ in range(60)]
    texts, planted = [], []
    for k in range(120):
        filler = lambda: [rng.choice(vocabulary) for _ in range(rng.randrange(80))]
        texts.append(" ".join([*filler(), *edited(rng, items[k % 60], share, vocabulary), *filler()]))
        planted.append(k % 60)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(documents(spark, *texts), bench).collect()}
    within = [(d, i) for d, i in enumerate(planted) if slow_distance(items[i], words(texts[d])) <= int(0.2 * len(items[i]) + 1e-9)]
    assert len(within) > 50 and sum(x in got for x in within) / len(within) >= least
    for (d, i), r in got.items():
        assert slow_distance(items[i], words(texts[d])) == r["distance"] <= int(0.2 * len(items[i]) + 1e-9)
        assert texts[d].encode()[r["start"] : r["end"]].decode().strip() == texts[d].encode()[r["start"] : r["end"]].decode()


def test_documents(spark):
    """Every item that stands in a text word by word is found, and whatever is found is within the limit."""
    texts = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in op2_decontamination(spark, LARGER).collect()}
    said = {d: " " + " ".join(t) + " " for d, t in texts.items()}
    exact = {(d, i) for d, t in said.items() for i, x in items.items() if x and f" {' '.join(x)} " in t}
    assert exact and exact <= set(got) and all(got[x] == 0 for x in exact)
    for (d, i), k in got.items():
        assert slow_distance(items[i], texts[d]) == k <= int(0.2 * len(items[i]) + 1e-9)


def test_short_and_odd_items(spark):
    bench = spark.createDataFrame([(1, "only three words"), (2, None), (3, ""), (None, "no id here at all"), (4, "...!"), (5, "one")], "item_id long, text string")
    df = documents(spark, "Here are ONLY, three; words in it", "one more", "no id here at all", None, "")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(df, bench).collect()}
    assert got == {(0, 1), (1, 5)}
    assert {r["doc_id"] for r in decontam.clean(df, bench).collect()} == {2, 3, 4}
    assert decontam.leaks(df, bench.limit(0)).count() == 0 and decontam.clean(df, bench.limit(0)).count() == 5


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontam.blocks, "__defaults__", (2, decontam.LETTERS))
    items = [(i, f"item {i} " + " ".join(f"w{i}x{k}" for k in range(12))) for i in (1, 2, 2, 3, 4, 5)]
    df = documents(spark, *(f"before {t} after" for _, t in items[2:]))
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert sorted(set(got)) == [(0, 2), (1, 3), (2, 4), (3, 5)]


def test_hard_cases(spark):
    bench = spark.createDataFrame([(9, "a second line which is long enough")], "item_id long, text string")
    got = decontam.leaks(hard(spark), bench).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 4, 8]
    kept = decontam.clean(hard(spark), bench)
    assert kept.columns == hard(spark).columns and kept.count() == len(HARD) - 4
    assert decontam.leaks(empty(spark), bench).count() == decontam.clean(empty(spark), bench).count() == 0


@pytest.mark.parametrize("length, shortest", [(5, 5), (8, 5), (8, 8), (10, 10), (14, 5), (15, 15), (16, 15), (19, 15), (20, 20), (39, 5), (59, 15), (64, 64), (65, 5), (100, 15), (200, 8)])
def test_nothing_within_the_limit_is_missed(length, shortest):
    """Items of each length with as many edits as are allowed, also beside a shorter item: all are found, with the distance of a brute force."""
    rng = random.Random(length * 100 + shortest)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(length)] for _ in range(60)]
    texts = [[*rng.choices(vocabulary, k=rng.randrange(30)), *edited(rng, x, 0.2, vocabulary), *rng.choices(vocabulary, k=rng.randrange(30))] for x in items]
    index = decontam.Index(list(enumerate(" ".join(x) for x in [*items, rng.choices(vocabulary, k=shortest)])))
    found = [decontam.words(np.frombuffer(" ".join(t).encode(), np.uint8))[0] for t in texts]
    got = {(d, i): k for d, i, k, *_ in index.matches(np.concatenate(found), np.cumsum([0, *map(len, found)]))}
    limit = int(0.2 * length + 1e-9)
    want = {(i, i): k for i, x in enumerate(items) if (k := slow_distance(x, texts[i])) <= limit}
    assert len(want) == 60 and want == {x: k for x, k in got.items() if x[0] == x[1]}


def test_walks_follow_the_target():
    """The number of walks rises with the recall asked for, and with it planted windows are found."""
    assert decontam.walks_needed(20, 0) <= 3 < decontam.walks_needed(20, 4, 0.9) < decontam.walks_needed(20, 4, 0.999) <= decontam.WALKS
    rng, r = np.random.default_rng(3), random.Random(3)
    for length in (5, 12, 30, 60, 90):
        vocabulary = rng.integers(1, 1 << 62, 3000, dtype=np.uint64).tolist()
        items = [r.choices(vocabulary, k=length) for _ in range(200)]
        index = decontam.Index([(i, " ".join(map(str, x))) for i, x in enumerate(items)])
        texts = [decontam.words(np.frombuffer(" ".join(map(str, edited(r, x, 0.2, vocabulary))).encode(), np.uint8))[0] for x in items]
        got = {(d, i) for d, i, *_ in index.matches(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))}
        assert sum((i, i) in got for i in range(200)) >= 198


def test_blocks_are_bounded(spark):
    """By rows and by characters; equal ids may be parted, alike rows are one with their number, and nothing is left out."""
    rows = [(i // 3, f"text {i % 7} " + "x" * (i % 5) * 30) for i in range(60)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    for size, letters in ((1000, 1 << 20), (7, 1 << 20), (1000, 300), (4, 10)):
        got = list(decontam.blocks(bench, size, letters))
        assert all(len(x) <= size and (len(x) == 1 or sum(len(t) for _, t, _ in x) <= letters) for x in got)
        assert sorted((i, t) for x in got for i, t, n in x for _ in range(n)) == sorted(rows)
