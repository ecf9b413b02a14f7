import random

import numpy as np
import pytest
import xxhash

from leafmill.llm import common, simhash
from leafmill.llm.queries import op10_simhash
from tests.conftest import SMALL
from tests.llm.cases import CLASH, HARD, documents, empty, hard


def slow_print(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    found = [w for w in low.split(" ") if w]
    if not found:
        return 0
    parts = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, limit=2):
    """Smallest id reachable, for rows of (id, fingerprint)."""
    prints = sorted({f for _, f in rows})
    up = {f: f for f in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= limit and find(a) != find(b):
                up[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [(i, f, least.get(find(f))) for i, f in rows]


def test_documents(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = slow_components([(i, slow_print(t)) for i, t in texts])
    got = op10_simhash(spark, SMALL).collect()
    assert sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got) == sorted(want)
    assert len({c for *_, c in want}) < 200


@pytest.mark.parametrize("cell, limit", [(4096, 2), (4, 2), (4096, 5), (3, 1)])
def test_links_are_whole(spark, monkeypatch, cell, limit):
    """Chains of near fingerprints, also where buckets are dealt into blocks."""
    rng = random.Random(cell * limit)
    prints = []
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(12):
            prints.append(f)
            for _ in range(rng.randrange(limit + 2)):
                f ^= 1 << rng.randrange(64)
    rows = [(i, f) for i, f in enumerate(prints)]
    rng.shuffle(rows)
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(common, "HOT", 8 if cell < 10 else 200_000)
    monkeypatch.setattr(simhash, "FEW", 0 if cell < 10 else 100_000)
    df = spark.createDataFrame([(i, [simhash._signed(f)]) for i, f in rows], "doc_id long, fp array<long>")
    first = {r["fp"][0]: r["first"] for r in simhash.classes(df, limit).collect()}
    assert {(i, first[simhash._signed(f)]) for i, f in rows} == {(i, c) for i, _, c in slow_components(rows, limit)}


def test_cells_may_span_batches():
    """Groups come out whole wherever batches end."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    key = np.sort(rng.integers(0, 12, 200))
    cell = np.zeros(200, np.int64)
    fp = rng.integers(0, 1 << 62, (200, 2))
    table = pa.table({"key": key, "cell": cell, "node": np.arange(200), "fp": pa.array(fp.tolist(), pa.list_(pa.int64()))})
    for size in (1, 3, 50, 200):
        got = list(simhash._groups(iter(table.to_batches(max_chunksize=size)), 2))
        assert [(k, n.tolist(), f.view(np.int64).tolist()) for k, n, f in got] == [(k, np.flatnonzero(key == k).tolist(), fp[key == k].tolist()) for k in np.unique(key).tolist() if (key == k).sum() > 1]


def test_a_link_always_has_a_chain():
    """Within the limit some start's chain keeps its budgets, and its first segments are equal."""
    rng = random.Random(3)
    for limit in (1, 2, 3, 8):
        budget = simhash.ring_budget(simhash.SEGMENTS, limit)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), rng.randrange(limit + 1)))
            assert any(simhash.chained(np.array([x], np.uint64), s, budget).size for s in range(simhash.SEGMENTS))


def test_components_of_long_paths(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (7, 7)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, n)} | {(1001, 1000)}


@pytest.mark.parametrize("alone, hot", [(200_000, 200_000), (60, 200_000), (0, 200_000), (0, 8)])
def test_components_in_one_task_or_by_rounds(spark, monkeypatch, alone, hot):
    """Paths, hubs, repeats, loops and negative nodes: the same roots either way, also where hubs are dealt out."""
    monkeypatch.setattr(simhash, "ALONE", alone)
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(alone + hot)
    pairs = [(100, k) for k in range(101, 130)] + [(k, k + 1) for k in range(-20, 5)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    pairs += [(b, a) for a, b in pairs[::3]] + [(500, 500), (1 << 40, 1 << 33)]
    rng.shuffle(pairs)
    up = {x: x for p in pairs for x in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted((x, r) for x, r in up.items() if x != r)
    assert simhash.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_few_links_take_few_jobs(spark):
    """Each round costs the driver the plans and tasks of several jobs, which links that one task can join are not worth."""
    order = list(range(400))
    random.Random(3).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    spark.sparkContext.setJobGroup("few links", "")
    try:
        assert {r["root"] for r in simhash.components(links).collect()} == {0}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 8


def near_copies(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    texts, group = [], []
    for g in range(12):
        words = [rng.choice(vocabulary) for _ in range(300)]
        for k in range(4):
            own = list(words)
            for _ in range(k * 2):
                own[rng.randrange(300)] = rng.choice(vocabulary)
            texts.append(" ".join(own))
            group.append(g)
    return texts, group


def test_chains_prune_before_the_full_distance():
    """Candidates left after each step fall, none within the limit is lost, and few of the others reach the full count."""
    rng = np.random.default_rng(6)
    budget = simhash.ring_budget(simhash.SEGMENTS, 2)
    known = int((budget == 0).sum())
    far = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) << np.uint64(4 * known)  # equal in the key's stretch only
    near = np.array([sum(1 << int(b) for b in rng.choice(np.arange(4 * known, 64), 2, replace=False)) for _ in range(500)], np.uint64)
    x, left = np.concatenate([far, near]), []
    alive = simhash.chained(x, 0, budget, known, left)
    assert len(left) == simhash.SEGMENTS - 1 - known and left == sorted(left, reverse=True) and left[0] < 0.4 * len(x) and left[3] < 0.05 * len(x)
    assert len(alive) == left[-1] < 0.05 * len(x)
    # What the key's own chain loses within the limit is found by the chain from another start.
    lost = np.setdiff1d(np.flatnonzero(np.bitwise_count(x) <= 2), alive)
    assert all(any(simhash.chained(x[[i]], s, budget).size for s in range(simhash.SEGMENTS)) for i in lost.tolist())


def test_prints_near_is_the_full_distance():
    rng = np.random.default_rng(2)
    own = rng.integers(0, 1 << 32, 16, dtype=np.uint32)
    others = np.repeat(own[None], 600, 0)
    for row, k in zip(others, rng.integers(60, 220, 600)):
        for bit in rng.choice(512, k, replace=False).tolist():
            row[bit // 32] ^= np.uint32(1 << bit % 32)
    near = simhash.prints_near(own, others)
    assert near.tolist() == (np.bitwise_count(others ^ own).sum(1) <= simhash.NEAR).tolist() and 0 < near.sum() < 600


def test_recall_at_the_threshold():
    """Pairs of a similarity of just 0.8: all but a few share a key and pass chains and limit."""
    rng, found, total = np.random.default_rng(8), 0, 300
    for _ in range(total):
        n = int(rng.integers(20, 400))
        shared = rng.integers(0, 1 << 63, round(n * 1.6 / 1.8), dtype=np.uint64)
        sets = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, n - len(shared), dtype=np.uint64)])) for _ in range(2)]
        prints = np.array([[simhash.majority(simhash._again(h, s)) for s in simhash.SEEDS] for h in sets], np.uint64).view(np.uint32)
        found += (simhash.bands(sets[0]) == simhash.bands(sets[1])).any() and simhash.prints_near(prints[0], prints[1:]).all()
    assert found / total >= 0.97


@pytest.mark.parametrize("hot", [200_000, 3])
def test_beside(spark, monkeypatch, hot):
    """Hot keys or not, each row gets what is told for its key."""
    monkeypatch.setattr(common, "HOT", hot)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 20 + [2, 3, 3, None])], "k long, i long")
    told = spark.createDataFrame([(1, 20, "a"), (3, 2, "c"), (9, 50, "z")], "k long, n long, what string")
    got = sorted((r["i"], r["what"]) for r in common.beside(rows, told, "k", "i").collect())
    assert got == [(i, "a") for i in range(20)] + [(20, None), (21, "c"), (22, "c"), (23, None)]


def test_keep_one(spark):
    texts, group = near_copies()
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    kept = {r["doc_id"] for r in simhash.keep_one(documents(spark, *(texts[i] for i in order))).collect()}
    assert len(kept) == 12 and {group[order[i]] for i in kept} == set(range(12))
    assert kept == {min(p for p, i in enumerate(order) if group[i] == g) for g in range(12)}


def test_hard_cases(spark):
    got = simhash.near_duplicates(hard(spark)).collect()
    want = slow_components([(i, slow_print(t)) for i, t, *_ in HARD])
    assert sorted((r["doc_id"] or 0, int(r["fingerprint"], 16), r["component_id"]) for r in got) == sorted((i or 0, f, c) for i, f, c in want)
    kept = simhash.keep_one(hard(spark)).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:20]) for r in kept) == sorted([(0, HARD[5][1][:20]), (1, HARD[0][1][:20]), (2, ""), (4, HARD[4][1][:20]), (5, HARD[6][1][:20]), (7, HARD[8][1][:20]), (7, HARD[9][1][:20])])
    assert kept[0].__fields__ == hard(spark).columns and all(r["same"].startswith("same") for r in kept) and len(CLASH) > 10
    assert simhash.near_duplicates(empty(spark)).count() == simhash.keep_one(empty(spark)).count() == 0


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def around(rng, n):
    """A text of n words, the last copy with random words replaced that is at 0.8 or above, and the first below."""
    a = [f"w{rng.getrandbits(40)}" for _ in range(n)]
    last = b = a
    while jaccard(" ".join(a), " ".join(b)) >= 0.8:
        last, b = b, list(b)
        b[rng.randrange(n)] = f"w{rng.getrandbits(40)}"
    return " ".join(a), " ".join(last), f"z{rng.getrandbits(40)}", " ".join(b)


@pytest.mark.parametrize("some, block", [(32, 1 << 20), (0, 200)])
def test_only_true_links_and_nearly_all(spark, monkeypatch, some, block):
    """Against a brute force: at exactly 0.8 one of two stays, just below it both do, for short texts and longer ones."""
    monkeypatch.setattr(simhash, "SOME", some)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng, texts = random.Random(4), []
    for shared, extra in [(4, 1), (8, 2), (40, 10), (80, 20), (200, 50)] * 12:  # one contained in the other: exactly 0.8
        w = [f"w{rng.getrandbits(40)}" for _ in range(shared + extra + 4)]
        texts += [" ".join(w), " ".join(w[: shared + 4])]
    exactly = len(texts) // 2
    for n in [10, 12, 20, 40, 100, 300] * 8:
        texts += around(rng, n)
    kept = {r["doc_id"] for r in simhash.keep_one(documents(spark, *texts)).collect()}
    want = slow_kept(texts)
    assert all(jaccard(texts[2 * i], texts[2 * i + 1]) == 0.8 for i in range(exactly)) and len(want) > 100
    assert sum(2 * i + 1 not in kept for i in range(exactly)) / exactly >= 0.97
    assert want <= kept and len(kept - want) <= 0.02 * len(want)


def slow_kept(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (t.split() for t in texts)]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {find(i) for i in range(len(sets))}
