"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of words. The CGK embedding of a window walks over it: in step j it puts out the word at the
pointer and moves on if a random bit of (j, word) says so. Two windows whose words differ by few edits put out the
same in most steps, so edit distance becomes Hamming distance. A key is a few sampled steps of one walk; keys of
enough walks agree at least once with the target recall, for which the number of walks is worked out by planting as
many edits as are allowed.

A window has the size of the item. Items of more than WIDEST words are cut into even windows, of which one at least
has no more than its share of the edits. Only places of a text are walked from at which an item may begin: an edit
takes two pairs of neighbouring words at most from an item, so a stretch with fewer of the benchmark's pairs than that
leaves holds none; and the first word that is kept is one of the item's first, one more than may be lost. Candidates are verified by the exact edit distance of the whole item against the text around.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, mixed, parts, utf8

SIMILARITY, RECALL = 0.8, 0.999
#: Words of a window at most; sampled steps of a key; walks at most; edited windows that the number of walks is worked out on.
WIDEST, SAMPLED, WALKS, PLANTS = 64, 2, 192, 1000
#: Items, and characters of their texts, that are looked for in one pass over the documents; more take more passes.
BLOCK, LETTERS = 20_000, 16 << 20

_WORD = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _WORD[_b] = ord(chr(_b).lower()) if _b < 128 else _b


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some bytes, and where they begin and end: runs of ASCII letters and digits in lower case and of other code points."""
    b = _WORD[buf]
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = b != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first, last
    # Horner's rule for all words at a time: sum of byte * base ** position, then the power of the word's place taken off.
    base, inverse = _powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_MIX[b] * base, out=total[1:])
    return mixed((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64)), first, last


_MIX = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_B = 0x5851F42D4C957F2D
_table = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    if len(_table[0]) <= n:
        for k, base in enumerate((_B, pow(_B, -1, 1 << 64))):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            _table[k] = np.cumprod(x)
    return _table[0][:n], _table[1][:n]


def steps_of(size: int | np.ndarray) -> int | np.ndarray:
    """Steps of a walk over a window from which samples are taken: it is at its end seldom."""
    return (3 * size + 1) // 2


@cache
def walks(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers, one for each walk and step, and for each window size and walk which steps are sampled."""
    rng = np.random.default_rng(seed)
    most = steps_of(WIDEST)
    times = rng.integers(1, 1 << 62, (WALKS, most), dtype=np.uint64) | np.uint64(1)
    sampled = np.zeros((WIDEST + 1, WALKS, most), bool)
    for size in range(1, WIDEST + 1):
        for walk in range(WALKS):
            sampled[size, walk, rng.choice(steps_of(size), min(SAMPLED, size), replace=False)] = True
    return times, sampled


def keys(word: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray, walk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sampled embedding of windows of `size` words by the named walks, and whether all samples lie before the window's end."""
    times, sampled = walks()
    order = np.argsort(-size, kind="stable")
    at, end, size, walk = start[order], end[order], size[order], walk[order]
    steps = steps_of(size)
    key, whole = size.astype(np.uint64) << np.uint64(32) | walk.astype(np.uint64), np.ones(len(at), bool)
    for j in range(int(steps.max(initial=0))):
        m = int(np.searchsorted(-steps, -j, "left"))  # those that have a step j
        inside = at[:m] < end[:m]
        c = word[np.minimum(at[:m], end[:m] - 1)]
        put = sampled[size[:m], walk[:m], j]
        key[:m] = np.where(put, (key[:m] ^ c) * np.uint64(_B) + np.uint64(j + 1), key[:m])
        whole[:m] &= inside | ~put
        at[:m] += inside & ((c * times[walk[:m], j]) >> np.uint64(63)).astype(bool)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return mixed(key)[back], whole[back]


def edited(rng: np.random.Generator, words: list[int], edits: int) -> list[int]:
    """The words after random edits."""
    out = list(words)
    for _ in range(edits):
        at, kind, word = int(rng.integers(0, max(1, len(out)))), int(rng.integers(0, 3)), int(rng.integers(1, 1 << 62))
        out[at : at + (kind != 1)] = [] if kind == 2 else [word]
    return out


@cache
def walks_needed(size: int, edits: int, recall: float = RECALL) -> int:
    """The least number of walks with which PLANTS windows with as many random edits share a key in the part of them that the recall asks for."""
    rng = np.random.default_rng(size * 1000 + edits)
    plain = rng.integers(1, 1 << 62, (PLANTS, size), dtype=np.uint64)
    other = []
    for x in plain.tolist():  # from the first kept word on, where walks begin
        kept, y = set(x), edited(rng, x, edits)
        other.append(y[next((i for i, w in enumerate(y) if w in kept), 0) :])
    length = np.array([len(x) for x in other])
    word = np.concatenate([plain.ravel(), np.array([w for x in other for w in x], np.uint64), np.ones(1, np.uint64)])
    begin = plain.size + np.concatenate([[0], np.cumsum(length)[:-1]])
    first = np.full(PLANTS, WALKS)
    for low in range(0, WALKS, 32):
        left = np.flatnonzero(first == WALKS)
        n, lot = len(left), min(32, WALKS - low)
        walk, of = np.tile(np.arange(low, low + lot), n), np.repeat(left, lot)
        sizes = np.full(len(of), size)
        a, whole = keys(word, of * size, of * size + size, sizes, walk)
        b, also = keys(word, begin[of], np.maximum(begin[of] + np.minimum(length[of], size), begin[of] + 1), sizes, walk)
        same = ((a == b) & whole & also).reshape(n, lot)
        hit = same.any(1)
        first[left[hit]] = low + same[hit].argmax(1)
        if (first == WALKS).sum() <= (1 - recall) * PLANTS:
            break
    return min(WALKS, int(np.sort(first)[min(PLANTS - 1, int(recall * PLANTS) - 1)]) + 1)


def _grid(size: int) -> int:
    """The next size for which walks are counted: each up to 8, then in steps of an eighth."""
    step = 1 << max(0, size.bit_length() - 4)
    return min(WIDEST, -(-size // step) * step)


def edit_match(item: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int, int] | None:
    """(distance, first, last) of the best match of the whole item within the text, if within the limit; least distance, then leftmost end."""
    n = len(item)

    def best(pattern: np.ndarray, within: list, free: bool) -> tuple[int, int]:
        """Bit-parallel columns: distance of the pattern to what ends at each place; `free` lets matches begin anywhere."""
        masks: dict[int, int] = {}
        for i, c in enumerate(pattern.tolist()):
            masks[c] = masks.get(c, 0) | 1 << i
        full, top = (1 << n) - 1, 1 << n - 1
        up, down, score, found = full, 0, n, (n, 0)
        for k, c in enumerate(within):
            eq = masks.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | ~(xh | up) & full, up & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = (ph << 1 | (not free)) & full, mh << 1 & full
            up, down = mh | ~(xv | ph) & full, ph & xv
            if score < found[0]:
                found = score, k + 1
        return found

    within = text.tolist()
    distance, end = best(item, within, True)
    if distance > limit:
        return None
    _, length = best(item[::-1], within[:end][::-1], False)
    return distance, end - length, end


def _own(salt: np.ndarray, word: np.ndarray) -> np.ndarray:
    return ((word ^ salt) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(41)).astype(np.int64)


def _pairs(word: np.ndarray, bits: int) -> np.ndarray:
    """Slots of all pairs of neighbouring words."""
    return ((word[:-1] * np.uint64(_B) ^ word[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _single(word: np.ndarray, bits: int) -> np.ndarray:
    """Slots of single words."""
    return (word * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - bits)).astype(np.int64)


class Index:
    """Keys of all windows of some items, (id, text) each, and the pairs of words of each window size."""

    def __init__(self, items: list[tuple], similarity: float = SIMILARITY, recall: float = RECALL):
        self.ids = [i for i, _ in items]
        self.words = [words(np.frombuffer((t or "").encode(), np.uint8))[0] for _, t in items]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.limits = ((1 - similarity) * self.sizes + 1e-9).astype(np.int64)
        self.longest = int(self.sizes.max(initial=0))
        item = np.flatnonzero(self.sizes)
        count = -(-self.sizes[item] // WIDEST)
        of = np.repeat(item, count)
        k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        n, m = self.sizes[of], np.repeat(count, count)
        first, end = n * k // m, n * (k + 1) // m
        size = end - first
        #: Edits of a window of each size, and pairs of the benchmark that are left of it at least.
        self.edits = np.zeros(WIDEST + 1, np.int64)
        np.maximum.at(self.edits, size, self.limits[of] // m)
        self.pairs_left = np.arange(WIDEST + 1) - 1 - 2 * self.edits
        self.walks = np.zeros(WIDEST + 1, np.int64)
        for s in np.unique(size).tolist():
            even = _grid(s)
            self.walks[s] = walks_needed(even, -(-int(self.edits[s]) * even // s), recall)
        at = np.concatenate([[0], np.cumsum(self.sizes)])
        every = np.concatenate([*self.words, np.zeros(1, np.uint64)])
        #: Slots hold a bit for each window size that has the pair, and that has the word among those of which one is kept.
        self.bits = max(16, int(size.sum()).bit_length() + 4)
        bit = np.uint64(1) << (size - 1).astype(np.uint64)
        self.pairs, self.firsts = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        for table, slot, n in ((self.pairs, _pairs(every, self.bits), size - 1), (self.firsts, _single(every, self.bits), np.minimum(size, self.edits[size] + 1))):
            place = np.repeat(at[of] + first - np.cumsum(n) + n, n) + np.arange(n.sum())
            np.bitwise_or.at(table, slot[place], np.repeat(bit, n))
        reps = self.walks[size]
        part = np.repeat(np.arange(len(of)), reps)
        walk = np.arange(len(part)) - np.repeat(np.cumsum(reps) - reps, reps)
        key, whole = keys(every, (at[of] + first)[part], (at[of] + end)[part], size[part], walk)
        key, part = key[whole], part[whole]
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.offset = key[order], of[part][order], first[part][order]
        self.salts = mixed(np.arange(1, len(items) + 1, dtype=np.uint64))
        self.own = np.zeros(1 << 23, bool)  # the words of each item; a false hit only costs a verification
        for i, w in enumerate(self.words):
            self.own[_own(self.salts[i], w)] = True
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.key >> np.uint64(42)).astype(np.int64)] = True

    def starts(self, word: np.ndarray, at: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places from which an item's window may stand, and its size: all others hold too few of the benchmark's pairs."""
        out = []
        sizes = np.flatnonzero(self.walks).tolist()
        mask, begins = self.pairs[_pairs(word, self.bits)], self.firsts[_single(word, self.bits)]
        mask[doc_of[1:] != doc_of[:-1]] = 0
        hit = np.flatnonzero(mask)
        mask = mask[hit]
        for s in sizes:
            need, reach = int(self.pairs_left[s]), s + int(self.edits[s]) - 2
            if need < 1:
                place = np.arange(len(word))
            else:
                own = hit[mask >> np.uint64(s - 1) & np.uint64(1) > 0]
                if len(own) < need:
                    continue
                low, high = own[: len(own) - need + 1], own[need - 1 :]
                ok = (high - low <= reach) & (doc_of[low] == doc_of[high])
                low, high = low[ok], high[ok]
                begin = np.maximum(high - reach, at[doc_of[low]])
                n = low - begin + 1
                place = np.unique(np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum()))
            place = place[begins[place] >> np.uint64(s - 1) & np.uint64(1) > 0]
            out.append((place, np.full(len(place), s)))
        place, size = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        return place, size

    def candidates(self, word: np.ndarray, at: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, item and supposed first word of what shares a key, each once."""
        pairs = []
        place, size = self.starts(word, at, doc_of)
        for low in range(0, len(place), 2048):
            p, s = place[low : low + 2048], size[low : low + 2048]
            reps = self.walks[s]
            of = np.repeat(np.arange(len(p)), reps)
            walk = np.arange(len(of)) - np.repeat(np.cumsum(reps) - reps, reps)
            k, whole = keys(word, p[of], np.minimum(p + s, at[doc_of[p] + 1])[of], s[of], walk)
            hit = np.flatnonzero(whole & self.seen[(k >> np.uint64(42)).astype(np.int64)])
            left, right = np.searchsorted(self.key, k[hit], "left"), np.searchsorted(self.key, k[hit], "right")
            n = right - left
            x = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
            q = np.repeat(p[of[hit]], n)
            begin = q - self.offset[x] + self.longest  # items may begin before the batch's first word
            pairs.append(np.unique((doc_of[q] << 16 | self.item[x]) << 32 | begin))  # BLOCK items, and words of a batch, have room
        found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return found >> 48, found >> 32 & 0xFFFF, (found & 0xFFFFFFFF) - self.longest

    def regions(self, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, item, first and end word of what is to be verified: candidates of an item that lie close together are one."""
        doc, item, begin = self.candidates(word, at, np.repeat(np.arange(len(at) - 1), np.diff(at)))
        limit, size = self.limits[item], self.sizes[item]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > 2 * limit[1:] + 1)
        lead = np.flatnonzero(new)
        last = np.append(lead[1:], len(doc)) - 1 if len(doc) else lead
        return doc[lead], item[lead], np.maximum(at[doc[lead]], begin[lead] - limit[lead]), np.minimum(at[doc[lead] + 1], begin[last] + (size + limit)[last])

    def matches(self, word: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, distance, first word, end word): for each document and item the best match, words counted in the batch. at: first word of each document."""
        if not len(self.key) or not len(word):
            return []
        doc, item, first, end = self.regions(word, at)
        limit, size = self.limits[item], self.sizes[item]
        # Each kept word of an item needs a partner in the text: where too few words are the item's own, no alignment is within the limit.
        keep = np.zeros(len(doc), bool)
        for lot in range(0, len(doc), 4096):
            some = slice(lot, lot + 4096)
            place = first[some, None] + np.arange(int((end - first)[some].max(initial=0)))
            known = self.own[_own(self.salts[item[some], None], word[np.minimum(place, len(word) - 1)])]
            keep[some] = (known & (place < end[some, None])).sum(1) >= (size - limit)[some]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        counts: dict[int, Counter] = {}
        for x in np.flatnonzero(keep).tolist():
            d, i, a = int(doc[x]), int(item[x]), int(first[x])
            near = word[a : int(end[x])]
            if (counts.setdefault(i, Counter(self.words[i].tolist())) & Counter(near.tolist())).total() < len(self.words[i]) - int(limit[x]):
                continue
            if (m := edit_match(self.words[i], near, int(limit[x]))) is not None:
                mine = (m[0], a + m[1], a + m[2])
                if (d, i) not in found or mine < found[d, i]:
                    found[d, i] = mine
        return [(d, i, *m) for (d, i), m in sorted(found.items())]


def _batches(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray, np.ndarray, np.ndarray]]:
    for b in parts(batches):
        buf, at = utf8(b.column("text"))
        # A byte between texts ends their words.
        apart = np.insert(buf, at[1:-1], 0) if len(at) > 2 else buf
        moved = at + np.arange(len(at))
        word, first, last = words(apart)
        yield b, index.matches(word, np.searchsorted(first, moved)), first, last, moved


def blocks(benchmark: DataFrame, size: int = BLOCK, letters: int = LETTERS) -> Iterator[list[tuple]]:
    """The items as (id, text, rows that are alike), in blocks of at most `size` and about `letters` characters; items without id or text are left out."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").groupBy("item_id", "text").agg(F.count("*").alias("n"))
    rest = items
    while True:
        ahead = rest.orderBy("item_id", "text")
        lengths = [r[0] for r in ahead.limit(size).select(F.length("text")).collect()]
        if not lengths:
            return
        count = max(1, int(np.searchsorted(np.cumsum(lengths), letters, "right")))
        block = [tuple(r) for r in ahead.limit(count).collect()]
        yield block
        if len(lengths) < size and count >= len(lengths):
            return
        last, text = block[-1][:2]
        rest = items.where((F.col("item_id") > last) | (F.col("item_id") == last) & (F.col("text") > text))


def _in_turn(out: DataFrame, benchmark: DataFrame, similarity: float, recall: float, pass_over) -> DataFrame:
    """`pass_over` (what there is, broadcast index and counts) for each block of items; what is there is written before the next index takes the place of the last."""
    before = None
    for block in blocks(benchmark):
        if before is not None:
            out = cut(out)
            before.destroy()
        before = out.sparkSession.sparkContext.broadcast((Index([x[:2] for x in block], similarity, recall), [x[2] for x in block]))
        out = pass_over(out, before)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, similarity, distance (words), start, end (bytes of the text's UTF-8): the best match of each item in each document that holds it.

    An item is held if some part of the text is within floor((1 - similarity) * n) word edits of its n words; of those
    with as many random edits the part `recall` is found, of those with fewer more. Null and empty texts and items
    without words hold nothing and are held by nothing; repeated rows give repeated matches; other columns are not
    read. The benchmark is broadcast in blocks of BLOCK items, one pass over the documents and one index at a time.
    """
    kind, of = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {of}, similarity double, distance int, start int, end int"

    def pass_over(out: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, times = shared.value
            for b, found, first, last, at in _batches(batches, index):
                if found:
                    ids = b.column("doc_id").to_pylist()
                    rows = [(ids[d], index.ids[i], 1 - k / len(index.words[i]), k, int(first[s] - at[d]), int(last[e - 1] - at[d])) for d, i, k, s, e in found for _ in range(times[i])]
                    kinds = [b.schema.field("doc_id").type, None, pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "item_id", "similarity", "distance", "start", "end"])

        return out.union(docs.select("doc_id", "text").mapInArrow(run, schema))

    return _in_turn(docs.sparkSession.createDataFrame([], schema), benchmark, similarity, recall, pass_over)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The documents that hold no item, with all their columns.

    What holds an item is as with leaks(). Null and empty texts and texts without words stay, repeated rows stay
    repeated; without any item all documents stay.
    """

    def pass_over(out: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, found, *_ in _batches(batches, shared.value[0]):
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in found]] = False
                yield b.filter(pa.array(keep))

        return out.mapInArrow(run, docs.schema)

    return _in_turn(docs, benchmark, similarity, recall, pass_over)
