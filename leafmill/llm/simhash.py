"""SimHash near-duplicates with pigeonring filtering.

A fingerprint of 64 bits is a ring of segments. If two fingerprints differ in at most T bits, then on the ring of m
segments some segment begins a chain whose first k segments, for every k up to m, differ in at most k * T / m bits.
While that budget is below one the segments are equal, so the longest such stretch is a key to join by. Candidates
follow the chain on from there, a segment at a time; what leaves its budget goes, and only what is left has all its
bits counted.

Equal fingerprints are one node. A bucket of a key is not expanded into pairs: its nodes are compared in blocks of
bounded size, inside a task, and only a spanning forest of the links comes out. Components are then found without
bringing links to the driver: a number of links with a fixed bound by one task, more by alternating star contraction
over tables.

keep_one() has another measure, the Jaccard similarity of sets of shingles. At 0.8 a bit of SimHash differs with a
probability of 0.15: keys long enough to keep buckets small would be needed by the hundred. Bands of minimal hashes
bring candidates together instead; they go through chains of longer fingerprints, then through the full distance, and
what is left is compared by the sets themselves, so that only true links make components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import common
from leafmill.llm.common import Roots, beside, cut, mixed, parts, spare

SEGMENTS = 16
#: Fingerprints of a bucket that meet in one cell, and buckets larger than that which are broadcast.
CELL, FEW = 4096, 100_000
#: Links whose components one task finds.
ALONE = 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words make one shingle; none, none."""
    found = (text or "").encode().translate(_LOWER).split(b" ")
    found = [w for w in found if w]
    if not found:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(found), len(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends[: n - words].tolist()]
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())), np.uint64, n - words + 1)


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, an array of one 64-bit fingerprint (as signed long); a text without words has zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            out = [[_signed(majority(shingle_hashes(text, words)))] for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp array<long>")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _again(h: np.ndarray, seed: int) -> np.ndarray:
    x = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ring_budget(segments: int, limit: int) -> np.ndarray:
    """Bits that the first k segments of a chain may differ in, k from 1."""
    return np.array([k * limit // segments for k in range(1, segments + 1)])


def chained(x: np.ndarray, start: int, budget: np.ndarray, known: int = 0, left: list[int] | None = None) -> np.ndarray:
    """Positions of the differences (xors) that hold the budget along the chain from segment `start`.

    The chain grows by a segment at a time over what is left, up to the last but one: with that the distance is whole.
    The first `known` segments are equal. How many are left after each step is added to `left`.
    """
    m = len(budget)
    width = 64 // m
    alive, total = np.arange(len(x)), np.zeros(len(x), np.uint8)
    for k in range(known, m - 1):
        total = total + np.bitwise_count((x >> np.uint64(width * ((start + k) % m))) & np.uint64((1 << width) - 1))
        ok = total <= budget[k]
        alive, total, x = alive[ok], total[ok], x[ok]
        if left is not None:
            left.append(len(alive))
        if not len(alive):
            break
    return alive


def _groups(batches: Iterator[pa.RecordBatch], lanes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """key, nodes and fingerprints (a row of lanes each) of every cell with two rows or more; rows come sorted by cell."""
    held: list[tuple[np.ndarray, ...]] = []

    def parted(rows: list[tuple[np.ndarray, ...]], last: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        key, cell, node, fp = (np.concatenate(c) for c in zip(*rows))
        edge = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        # The last cell may go on in the next batch.
        for k in np.flatnonzero(end - begin > 1).tolist():
            if last or k < len(begin) - 1:
                yield int(key[begin[k]]), node[begin[k] : end[k]], fp[begin[k] : end[k]]
        rows[:] = [] if last else [tuple(c[begin[-1] :] for c in (key, cell, node, fp))]

    for b in batches:
        if b.num_rows:
            fp = np.asarray(b.column("fp").flatten()).view(np.uint64).reshape(-1, lanes)
            rows = b.column("key").to_numpy(), b.column("cell").to_numpy(), b.column("node").to_numpy(), fp
            whole = len(held) and held[0][0][0] == rows[0][-1] and held[0][1][0] == rows[1][-1]
            held.append(rows)
            if not whole:  # else all of it belongs to the cell that is held
                yield from parted(held, False)
    if held:
        yield from parted(held, True)


def _cell_links(batches: Iterator[pa.RecordBatch], shift: int, budget: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each cell's links: the key's chain first, the full distance of what it leaves."""
    known = int((budget == 0).sum())
    for key, node, fp in _groups(batches, 1):
        start, own = (key % (1 << 64)) >> shift, fp[:, 0].copy()
        roots, links = Roots(len(node)), []
        for i in range(len(node) - 1):
            x = own[i + 1 :] ^ own[i]
            near = chained(x, start, budget, known)
            near = near[np.bitwise_count(x[near]) <= budget[-1]]
            for j in (near + i + 1).tolist():
                if roots.find(i) != roots.find(j):
                    roots.join(i, j)
                    links.append((node[i], node[j]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])


def links(nodes: DataFrame, limit: int) -> DataFrame:
    """a, b: links between nodes (node long, fp array<long>) that join what differs in at most `limit` bits.

    This is exact: there is a key for each start on the ring, the chain's stretch without budget.
    """
    budget = ring_budget(SEGMENTS, limit)
    length = int((budget == 0).sum())
    width = 64 // SEGMENTS
    shift = width * length
    if not length:
        raise ValueError(f"{SEGMENTS} segments are too few for a limit of {limit} bits")

    def key(start: int) -> Column:
        x, at = F.col("fp")[0], width * start
        turned = x if at == 0 else F.shiftrightunsigned(x, at).bitwiseOR(F.shiftleft(x, 64 - at))
        return turned.bitwiseAND(F.lit((1 << shift) - 1)).bitwiseOR(F.lit(_signed(start << shift)).cast("long"))

    keys = F.array(*(key(s) for s in range(SEGMENTS)))
    # A bucket of more than CELL nodes is dealt into blocks; each pair of blocks is a cell.
    large = cut(nodes.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CELL).withColumn("blocks", F.ceil(F.col("n") / CELL).cast("int")))
    keyed = nodes.select("node", "fp", F.explode(keys).alias("key"))
    # Such buckets are few: known, they go to all tasks if they are.
    told = keyed.join(F.broadcast(large.drop("n")), "key", "left") if large.count() <= FEW else beside(keyed, large, "key", "node")
    cells = _dealt(told)
    found = cells.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(lambda x: _cell_links(x, shift, budget), "a long, b long")
    return found.distinct()


def _dealt(told: DataFrame) -> DataFrame:
    """The rows with their cells: one of each bucket, but of those with a number of blocks one for each pair of them."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.shiftleft(F.least(j, block).cast("long"), 32).bitwiseOR(F.greatest(j, block).cast("long")))
    return told.withColumn("cell", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs))).drop("blocks")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all links v, u: what components() returns."""
    rows = [(b.column("v").to_numpy(), b.column("u").to_numpy()) for b in batches if b.num_rows]
    if rows:
        v, u = (np.concatenate(c) for c in zip(*rows))
        node, at = np.unique(np.concatenate([v, u]), return_inverse=True)
        roots = Roots(len(node))
        for x, y in zip(at[: len(v)].tolist(), at[len(v) :].tolist()):
            roots.join(x, y)
        root = node[[roots.find(k) for k in range(len(node))]]
        own = root != node
        yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(root[own])], ["node", "root"])


def components(found: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable by links a, b; roots and nodes without links are left out.

    Up to ALONE links are joined in one task. More go through alternating large and small star: every node hooks its
    larger neighbours, then its smaller ones, on the smallest node it knows. Rounds are cut by checkpoints; it ends when
    a round changes nothing. Links of hubs are dealt over all tasks; there is none while there are no more links than a
    hub has.
    """
    around = lambda links: links.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
    pair = lambda v, u: F.struct(F.col(v).alias("v"), F.col(u).alias("u"))
    # Each row's pairs in one pass: a union would have all that is below planned and scanned once for each side.
    pairs = lambda links, *of: links.select(F.inline(F.array(*of)))
    edges = cut(found.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    mark, count = None, edges.count()
    if count <= ALONE:
        return edges.coalesce(1).mapInArrow(_joined, "node long, root long")
    hooked = lambda links, told: beside(links, told, "v", "u") if 2 * count > common.HOT else links.join(told.drop("n"), "v")
    for _ in range(rounds):
        # In each link, v is larger than u.
        least = around(pairs(edges, pair("v", "u"), pair("u", "v"))).withColumn("m", F.least("v", "m"))
        large = hooked(edges.select(F.col("u").alias("v"), F.col("v").alias("u")), least).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        edges = cut(pairs(hooked(large, around(large)), pair("u", "m"), pair("v", "m")).where("v <> u").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark, count = tuple(now), now[0]
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def classes(prints: DataFrame, limit: int) -> DataFrame:
    """fp, n (its rows), first: for each distinct fingerprint the smallest doc_id of its component. prints: doc_id, fp.

    Null ids are never the smallest unless there is no other.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    nodes = cut(prints.groupBy("fp").agg(least.alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    tree = components(links(nodes.select("node", "fp"), limit))
    rooted = nodes.join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min("least").alias("best"), F.count("*").alias("n"))
    return beside(rooted.select("fp", F.col("n").alias("rows"), "root"), best, "root", "fp").select("fp", F.col("rows").alias("n"), F.col("best.doc_id").alias("first"))


def near_duplicates(docs: DataFrame, words: int = 3, limit: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id reachable over links of at most `limit` bits.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows come out repeated; rows
    with equal ids and different texts are different nodes. Only doc_id and text are read.
    """
    prints = cut(fingerprints(docs, words))
    found = beside(prints, classes(prints, limit), "fp", "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


#: For keep_one: words of a shingle, and the similarity of a link as a fraction.
WORDS, SIMILARITY = 5, (4, 5)
#: Keys of a set, each of so many minimal hashes: at a similarity of 0.8 two sets of any size have one in common with probability 0.999.
BANDS, ROWS = 24, 6
#: In cells of more than SOME sets, pairs go through SimHash first: of 512 bits those at a similarity of 0.8 differ in 78 on average (in 96 with
#: 4 and 5 shingles, the worst case), give or take 9. NEAR lies four of these beyond the worst. Segments of a chain before the full distance.
SEEDS, NEAR, SOME, CHAIN = tuple(range(42, 50)), 132, 2, 4
#: Shingles of a group of candidates that meet in one block.
BLOCK = 1 << 20

_TIMES = np.random.default_rng(5).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The set of five-word shingles, as sorted hashes."""
    return np.unique(shingle_hashes(text, WORDS))


def bands(h: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; those of the empty set are zeros."""
    if not len(h):
        return np.zeros(BANDS, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(h), 1 << 10):
        np.minimum(least, (h[i : i + (1 << 10), None] * _TIMES[0]).min(0), out=least)
    return mixed((mixed(least) * _TIMES[1]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is SIMILARITY or more, exactly."""
    over, under = SIMILARITY
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * under >= over * (len(a) + len(b) - both)


def _sketches(docs: DataFrame, same: Column) -> DataFrame:
    """doc_id, same (a long), digest of the set of shingles, its size n and its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            keys = pa.ListArray.from_arrays(np.arange(0, BANDS * len(sets) + 1, BANDS, dtype=np.int32), np.concatenate([bands(h) for h in sets]))
            digest = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("same"), digest, pa.array([len(h) for h in sets], pa.int64()), keys], ["doc_id", "same", "digest", "n", "keys"])

    return docs.select("doc_id", "text", same.alias("same")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, same long, digest binary, n long, keys array<long>")


def _slice_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch: a, b, the first node of a key and another one; then key, a, the first nodes alone."""
    for batch in batches:
        if batch.num_rows:
            key = batch.column("keys").flatten().to_numpy()
            node = np.repeat(batch.column("node").to_numpy(), BANDS)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            head = node[first][np.cumsum(first) - 1]
            for columns in ((None, head[~first], node[~first]), (key[first], node[first], None)):
                n = len(columns[1])
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], ["key", "a", "b"])


def candidates(nodes: DataFrame) -> DataFrame:
    """a, b: links between nodes (node, keys) that share a key; all nodes of a key are joined, by links as many as nodes."""
    found = cut(nodes.select("node", "keys").mapInArrow(_slice_links, "key long, a long, b long"))
    across = found.where("b is null").select(F.min("a").over(Window.partitionBy("key")).alias("a"), F.col("a").alias("b"))
    return found.where("b is not null").select("a", "b").union(across.where("a <> b")).distinct()


def prints_near(own: np.ndarray, others: np.ndarray, limit: int = NEAR) -> np.ndarray:
    """Which of some fingerprints differ from one in at most `limit` bits. Rows of equal segments, as unsigned numbers.

    A chain of CHAIN segments from some start has to keep its budgets before all bits are added up.
    """
    apart = np.bitwise_count(others ^ own)
    m = apart.shape[1]
    ring, budget = np.concatenate([apart, apart[:, : CHAIN - 1]], 1), ring_budget(m, limit)
    total, ok = np.zeros(apart.shape, np.uint16), np.ones(apart.shape, bool)
    for k in range(CHAIN):
        total += ring[:, k : k + m]
        ok &= total <= budget[k]
    near = ok.any(1)
    near[near] = apart[near].sum(1, dtype=np.int64) <= limit
    return near


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between sets that are similar, as many as it takes to join what all such links join."""
    over, under = SIMILARITY
    size, label, out = np.array([len(h) for h in sets]), np.arange(len(sets)), []
    fp = np.array([[majority(_again(h, s)) for s in SEEDS] for h in sets], np.uint64).view(np.uint32) if len(sets) > SOME else None
    for i in range(len(sets) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        rest = rest[np.minimum(size[rest], size[i]) * under >= over * np.maximum(size[rest], size[i])]
        if fp is not None:
            rest = rest[prints_near(fp[i], fp[rest])]
        while len(rest):
            j, rest = int(rest[0]), rest[1:]
            if similar(sets[i], sets[j]):
                label[label == label[j]] = label[i]
                out.append((i, j))
                rest = rest[label[rest] != label[i]]
    return out


def _true_links(cell: pa.Table) -> pa.Table:
    node, at = np.unique(cell.column("node").to_numpy(), return_index=True)
    found = forest([shingles(t) for t in cell.column("text").take(pa.array(at)).to_pylist()])
    return pa.table({"a": pa.array([int(node[i]) for i, _ in found], pa.int64()), "b": pa.array([int(node[j]) for _, j in found], pa.int64())})


def buckets(groups: DataFrame) -> DataFrame:
    """node, id, tie, bucket, blocks: in which buckets the sets of candidate groups (node, root, n, keys, least) meet.

    A group of up to BLOCK shingles is one bucket, in which each pair is in reach. Of a larger one, which may hang
    together by a few links only, each key is a bucket, dealt into blocks if that is too large itself.
    """
    size = groups.groupBy("root").agg(F.sum("n").alias("all"), F.count("*").alias("n")).where(F.col("all") > BLOCK)
    told = beside(groups.select("node", "n", "keys", "least", "root"), size, "root", "node")
    which = F.when(F.col("all").isNull(), F.array("root")).otherwise(F.array_distinct("keys"))
    sets = cut(told.select("node", F.col("n").alias("size"), F.col("least.doc_id").alias("id"), F.col("least.tie").alias("tie"), F.explode(which).alias("bucket")))
    met = sets.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("all")).where("n > 1")
    known = beside(sets, met, "bucket", "node").where("all is not null")
    return known.select("node", "id", "tie", "bucket", F.when(F.col("all") > BLOCK, F.ceil(F.col("all") / BLOCK).cast("int")).alias("blocks"))


def own_texts(docs: DataFrame, same: Column, members: DataFrame) -> DataFrame:
    """node, bucket, cell, text of members (node, bucket, cell, id, tie)."""
    own = docs.select("doc_id", "text", same.alias("same"))
    return own.join(members, (own["same"] == members["tie"]) & own["doc_id"].eqNullSafe(members["id"])).select("node", "bucket", "cell", "text")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, one of each group of near copies (linked by five-word shingles, Jaccard similarity 0.8 or more): that of the smallest id.

    Rows come out with all their columns. Of equal rows one stays; rows with equal ids and different texts are different
    documents. Documents without a word are copies of each other. A document without an id stays only if its group has
    no id at all, and then one of them.
    """
    text = lambda df: F.xxhash64(F.lit("copy"), df["text"])
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("same").alias("tie")))
    sets = _sketches(docs, text(docs)).groupBy("digest").agg(least.alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = cut(sets.withColumn("node", F.monotonically_increasing_id()).drop("digest"))
    tree = cut(components(candidates(nodes)))
    tree = tree.union(tree.select(F.col("root").alias("node"), "root").distinct()).distinct()
    groups = cut(nodes.join(tree, "node"))
    texts = own_texts(docs, text(docs), _dealt(buckets(groups)))
    linked = texts.groupBy("bucket", "cell").applyInArrow(_true_links, "a long, b long")
    rooted = nodes.select("node", "least").join(components(linked), "node", "left")
    best = rooted.groupBy(F.coalesce("root", "node")).agg(F.min("least").alias("best"))
    # As one column, in which nulls are equal, id and text deal the rows out for the join and for what equal rows leave, once for both.
    key = spare(docs, "key")
    kept = best.select(F.struct(F.col("best.doc_id").alias("doc_id"), F.col("best.tie").alias("same")).alias(key))
    whole = docs.withColumn(key, F.struct("doc_id", text(docs).alias("same")).cast(kept.schema[key].dataType))
    return whole.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
