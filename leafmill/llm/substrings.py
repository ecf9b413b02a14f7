"""Suffix-array dedup, depth-limited: which windows of DEPTH bytes occur more than once, and nothing beyond.

A suffix array sorted only through its first DEPTH bytes is all that is needed: its groups of equal keys are exactly
the repeated windows. The sort is a radix sort, most significant digit first, that drops a suffix as soon as it is
alone. A window's digits are not its bytes from left to right, of which there would be a row for each position of the
corpus, but these, from the most significant:

1. its anchor (the smallest 16-gram by hash, leftmost) with the anchor's offset in steps of BLOCK, and the content
   that all windows of that offset share (the core). Neighbouring windows have these in common, so a run of up to
   BLOCK windows is one row; runs whose core is alone are dropped.
2. the content of the run as a whole (the hull): if it occurs again, so does every window of the run.
3. for what is left, the window itself.

Digits are fingerprints: 96 bits of two independent polynomials modulo 2 ** 64. Each pass is a partition by the
digit, a sort, and one look at the neighbours in sorted order. Before it, what repeats is settled in two levels: each
slice of documents sends on one row for each digit, and each task no more than two for a digit that it comes by again
and again; so a passage that all documents share sends two rows for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, mixed, parts, utf8

DEPTH, GRAM, BLOCK = 400, 16, 128
#: Different hulls of one core in one slice from which they go to the last digit at once.
HOT = 8
#: Digits that a task remembers; a slice has about 20,000.
REMEMBERED = 1 << 19
#: What a row is: one of those to be judged; one that only shows that its digit exists; a settled one; one for the last digit.
JUDGE, SHOW, REPEATED, LAST = 0, 1, 2, 3

_MIX = [mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_BASE = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0][0]) <= n:
        _powers.clear()
        for base in _BASE:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                x = np.full(n + 1, b, np.uint64)
                x[0] = 1
                pair.append(np.cumprod(x))
            _powers.append(tuple(pair))
    return _powers[lane]


class Hashes:
    """Hashes of any range of some bytes, from sums over prefixes."""

    def __init__(self, buf: np.ndarray):
        self.sums, self.back = [], []
        for lane in (0, 1):
            power, inverse = _power(lane, len(buf) + 1)
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(_MIX[lane][buf] * power[: len(buf)], out=total[1:])
            self.sums.append(total)
            self.back.append(inverse)

    def of(self, lane: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[lane][end] - self.sums[lane][start]) * self.back[lane][start]

    def digit(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits."""
        salt = np.asarray(salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mixed(self.of(0, start, end) ^ salt).view(np.int64), (mixed(self.of(1, start, end)) >> np.uint64(33)).astype(np.int32)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours: from blocks' minima to the left and to the right."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    full = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    grid = full.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor and step: first start, last start, core (64 and 32 bits), hull."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int64))
    n = len(buf) - DEPTH + 1
    if n < 1:
        return none
    h = Hashes(buf)
    sums, back = h.sums[0], h.back[0]
    order = mixed((sums[GRAM:] - sums[:-GRAM]) * back[: len(buf) - GRAM + 1])
    order &= np.uint64(0xFFFFFFFF00000000)
    order |= np.arange(len(order), dtype=np.uint64)
    anchor = (sliding_min(order, DEPTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(n)
    inside = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(at) >= DEPTH)
    np.add.at(inside, at[long], 1)
    np.add.at(inside, np.minimum(at[long + 1] - DEPTH + 1, n), -1)
    inside = np.cumsum(inside[:n], dtype=np.int8) > 0
    step = (anchor - start) // BLOCK
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (step[1:] != step[:-1]) | ~inside[:-1]
    new[at[(at > 0) & (at < n)]] = True
    new &= inside
    first = np.flatnonzero(new)
    if not len(first):
        return none
    stop = np.ones(n + 1, bool)  # where a run can't go on
    stop[:n] = new | ~inside
    ends = np.flatnonzero(stop)
    last = ends[np.searchsorted(ends, first, "right")] - 1
    a, k = anchor[first], step[first]
    core = h.digit(a - BLOCK * k, a - BLOCK * k - BLOCK + 1 + DEPTH, k + 1)
    hull, _ = h.digit(first, last + DEPTH, ((a - first) << 20 | (a - last)) + 7)
    return first, last, *core, hull


def _same() -> Column:
    return F.xxhash64(F.lit("bytes"), "text").alias("same")


ROW = "c1 long, c2 int, hull long, kind int, doc_id {}, same long, s int, n int"


def _pack(batch: pa.RecordBatch, at: np.ndarray, first: np.ndarray, n: np.ndarray, kind, c1, c2, hull) -> Iterator[pa.RecordBatch]:
    """Rows of ROW; starts become offsets within their document."""
    doc = np.searchsorted(at, first, "right") - 1
    names = ["c1", "c2", "hull", "kind", "doc_id", "same", "s", "n"]
    for i in range(0, len(first), 50_000):
        j = slice(i, i + 50_000)
        take = pa.array(doc[j])
        arrays = [pa.array(c1[j]), pa.array(c2[j]), pa.array(hull[j]), pa.array(kind[j].astype(np.int32)), batch.column("doc_id").take(take), batch.column("same").take(take), pa.array((first[j] - at[doc[j]]).astype(np.int32)), pa.array(n[j].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(arrays, names)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the group of each row, and each group's size."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    group = np.cumsum(new) - 1
    return group, np.bincount(group)


def _joined(first: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that follow each other in a document as one; and which of the rows begin one."""
    order = np.argsort(first)
    f, n = first[order], n[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1] + n[:-1]) | np.isin(f[1:], at)
    begin = np.flatnonzero(new)
    return f[begin], np.add.reduceat(n, begin) if len(begin) else n, order[begin]


class Seen:
    """Digits that a task has sent on: of those sent twice any further window is repeated, and need not be sent.

    Of the latest REMEMBERED at most; a digit that is forgotten is only sent again. Digits are pairs of numbers.
    """

    def __init__(self):
        self.once, self.twice = ((np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2))

    @staticmethod
    def _among(a: np.ndarray, b: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Of two digits with one first number only one is held, so a look at one place is enough."""
        if not len(held[0]):
            return np.zeros(len(a), bool)
        at = np.minimum(np.searchsorted(held[0], a), len(held[0]) - 1)
        return (held[0][at] == a) & (held[1][at] == b)

    @staticmethod
    def _with(held: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(held[0]) + len(a) <= REMEMBERED:
            a, b = np.concatenate([held[0], a]), np.concatenate([held[1], b])
        key, at = np.unique(a[-REMEMBERED:], return_index=True)
        return key, b[-REMEMBERED:][at]

    def known(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._among(a, b, self.twice)

    def sent(self, a: np.ndarray, b: np.ndarray) -> None:
        """Different digits that have just been sent."""
        again = self._among(a, b, self.once)
        if again.any():
            self.twice = self._with(self.twice, a[again], b[again])
        self.once = self._with(self.once, a[~again], b[~again])


def _spread(c1: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Settled rows only pass through: any partition will do."""
    return mixed(c1.view(np.uint64) ^ (first.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = Seen()
    for b in parts(batches):
        buf, at = utf8(b.column("text"))
        first, last, c1, c2, hull = runs(buf, at)
        if not len(first):
            continue
        order = np.lexsort((hull, c2, c1))
        first, n, c1, c2, hull = first[order], (last - first + 1)[order], c1[order], c2[order], hull[order]
        core, _ = _groups(c1, c2)
        whole, size = _groups(c1, c2, hull)
        lead = np.ones(len(first), bool)
        lead[1:] = whole[1:] != whole[:-1]
        kinds = np.bincount(core[lead])  # different hulls of each core
        one = mixed(hull.view(np.uint64) ^ c2.astype(np.uint64)).view(np.int64)
        known = seen.known(c1 ^ one, one)
        lead &= ~known
        twice = known | (size[whole] > 1)
        hot = kinds[core] >= HOT
        kind = np.where(twice, np.where(lead, SHOW, REPEATED), JUDGE)
        begins = np.ones(len(first), bool)
        begins[1:] = core[1:] != core[:-1]
        # Of a hot core all hulls that are alone here are judged by the last digit; one is shown for all of them.
        alone = hot & ~twice
        head = np.zeros(len(kinds), np.int64) - 1
        at_alone = np.flatnonzero(alone)
        head[core[at_alone][::-1]] = at_alone[::-1]
        show = np.zeros(len(first), bool)
        show[head[head >= 0]] = True
        send = (kind == JUDGE) & ~alone | (kind == SHOW) | show
        new = np.flatnonzero(send)
        new = new[np.concatenate([[True], whole[new[1:]] != whole[new[:-1]]])] if len(new) else new
        seen.sent((c1 ^ one)[new], one[new])
        yield from _pack(b, at, first[send], n[send], np.where(show | (kind == SHOW), SHOW, JUDGE)[send], c1[send], c2[send], hull[send])
        for what, rows in ((REPEATED, twice), (LAST, alone)):
            if rows.any():
                f, m, i = _joined(first[rows], n[rows], at)
                yield from _pack(b, at, f, m, np.full(len(f), what), _spread(c1[rows][i], f), np.full(len(f), -1, np.int32), hull[rows][i])


def _neighbours(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each batch of sorted rows, and for the first k keys whether the row before and the row after agree in them: [before1, after1, before2, ...]."""
    held: pa.RecordBatch | None = None
    prior: tuple | None = None

    def judged(b: pa.RecordBatch, prior: tuple | None, later: tuple | None):
        same_before, same_after, out = np.ones(b.num_rows, bool), np.ones(b.num_rows, bool), []
        for k, name in enumerate(keys):
            x = b.column(name).to_numpy()
            eq = x[1:] == x[:-1]
            same_before[1:] &= eq
            same_after[:-1] &= eq
            same_before[0] &= prior is not None and prior[k] == x[0]
            same_after[-1] &= later is not None and later[k] == x[-1]
            out += [same_before.copy(), same_after.copy()]
        return out

    ends = lambda b, i: tuple(b.column(k)[i].as_py() for k in keys)
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            yield held, judged(held, prior, ends(b, 0))
            prior = ends(held, held.num_rows - 1)
        held = b
    if held is not None:
        yield held, judged(held, prior, None)


SPAN = ["doc_id", "same", "s", "n", "kind"]


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges runs by core and hull. Settled runs whose core has other hulls are shown to the last digit too."""
    for b, (_, _, core_before, core_after, hull_before, hull_after) in _neighbours(batches, ["c1", "c2", "hull"]):
        kind = b.column("kind").to_numpy()
        told = kind >= REPEATED
        core, whole = core_before | core_after, hull_before | hull_after
        judge = kind == JUDGE
        out = np.where(told, kind, np.where(judge & whole, REPEATED, np.where(judge & core, LAST, -1)))
        # One row at either end of a class of equal hulls speaks for it.
        shown = ~told & (whole | (kind == SHOW)) & (core_before & ~hull_before | core_after & ~hull_after)
        for rows, what in ((np.flatnonzero(out >= 0), None), (np.flatnonzero(shown), SHOW)):
            if len(rows):
                t = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*(t.column(c) for c in SPAN[:4]), pa.array((out[rows] if what is None else np.full(len(rows), what)).astype(np.int32))], SPAN)


def _third_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last digit of all windows of the runs in `marks`."""
    seen = Seen()
    for b in parts(batches):
        buf, at = utf8(b.column("text"))
        marks = b.column("marks")
        of = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(marks.offsets)))
        s, n, what = (np.asarray(marks.flatten().field(k)).astype(np.int64) for k in ("s", "n", "kind"))
        base = np.repeat(at[of] + s, n)
        start = base + np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
        kind = np.repeat(np.where(what == LAST, JUDGE, SHOW), n)
        if not len(start):
            continue
        order = np.lexsort((kind, start))  # a window that is both judged and shown is judged
        start, kind = start[order], kind[order]
        new = np.concatenate([[True], start[1:] != start[:-1]])
        start, kind = start[new], kind[new]
        c1, c2 = Hashes(buf).digit(start, start + DEPTH)
        order = np.lexsort((kind, c2, c1))
        start, kind, c1, c2 = start[order], kind[order], c1[order], c2[order]
        group, size = _groups(c1, c2)
        lead = np.concatenate([[True], group[1:] != group[:-1]])
        known = seen.known(c1, c2.astype(np.int64))
        twice = known | (size[group] > 1)
        one = np.ones(len(start), np.int64)
        send = lead & ~known
        seen.sent(c1[send], c2[send].astype(np.int64))
        yield from _pack(b, at, start[send], one[send], np.where(twice, SHOW, kind)[send], c1[send], c2[send], np.zeros(int(send.sum()), np.int64))
        if (rows := twice & (kind == JUDGE)).any():
            f, m, i = _joined(start[rows], one[rows], at)
            yield from _pack(b, at, f, m, np.full(len(f), REPEATED), _spread(c1[rows][i], f), np.full(len(f), -1, np.int32), np.zeros(len(f), np.int64))


def _last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, (_, _, before, after) in _neighbours(batches, ["c1", "c2"]):
        kind = b.column("kind").to_numpy()
        rows = np.flatnonzero((kind == REPEATED) | (kind == JUDGE) & (before | after))
        if len(rows):
            t = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([t.column(c) for c in SPAN[:4]], SPAN[:4])


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, same (a hash of the text), runs: array of (s, n), n windows from byte s on that occur elsewhere.

    Null and short texts have none. Equal rows are documents of their own, so each repeats the other.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", _same())
    row, span = ROW.format(kind), f"doc_id {kind}, same long, s int, n int, kind int"
    found = texts.mapInArrow(_first_pass, row).repartition("c1").sortWithinPartitions("c1", "c2", "hull").mapInArrow(_second_pass, span)
    found = cut(found)
    marks = found.where(F.col("kind").isin(LAST, SHOW)).groupBy("doc_id", "same").agg(F.collect_list(F.struct("s", "n", "kind")).alias("marks"))
    marked = _beside(texts, marks, "inner")
    last = marked.mapInArrow(_third_pass, row).repartition("c1").sortWithinPartitions("c1", "c2").mapInArrow(_last_pass, f"doc_id {kind}, same long, s int, n int")
    every = found.where(F.col("kind") == REPEATED).select(*SPAN[:4]).union(last)
    return every.groupBy("doc_id", "same").agg(F.collect_list(F.struct("s", "n")).alias("runs"))


def _beside(texts: DataFrame, other: DataFrame, how: str) -> DataFrame:
    other = other.withColumnsRenamed({"doc_id": "__id", "same": "__same"})
    return texts.join(other, texts["doc_id"].eqNullSafe(other["__id"]) & (texts["same"] == other["__same"]), how).drop("__id", "__same")


def removed_spans(found: list[dict] | None) -> list[tuple[int, int]]:
    """The bytes that runs of windows cover, as maximal spans."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["s"] + x["n"] - 1 + DEPTH) for x in found or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list, bytes]]]]:
    for b in parts(batches, limit=4 << 20):
        out = []
        for text, found in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
            data, spans, pieces, at = (text or "").encode(), removed_spans(found), [], 0
            for s, e in spans:
                pieces.append(data[at:s])
                at = e
            out.append((len(data), spans, b"".join([*pieces, data[at:]])))
        yield b, out


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, kept (bytes: a span may begin within a character), spans removed (start, end in bytes).

    Null and empty texts have nothing to keep and no span; of repeated rows each repeats the others, and each comes
    out; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _kept(batches):
            spans = [[{"start": s, "end": e} for s, e in x] for _, x, _ in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for *_, x in rows], pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "kept", "spans"])

    texts = docs.select("doc_id", "text", _same())
    return _beside(texts, repeated(docs), "left").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept binary, spans array<struct<start:int,end:int>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay, for every document; null is empty, repeated rows come out repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _kept(batches):
            columns = [[n for n, _, _ in rows], [n - len(k) for n, _, k in rows], [len(x) for _, x, _ in rows]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array([hashlib.sha256(k).hexdigest() for *_, k in rows])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    texts = docs.select("doc_id", "text", _same())
    return _beside(texts, repeated(docs), "left").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
