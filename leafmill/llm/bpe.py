"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding by offsets.

The pattern of the public rank files splits a text into contractions, letter runs, number runs, runs of other
characters (each of the three with at most one space before it) and white space. Here no regex does that: a table
gives each code point its class, one look ahead turns classes into symbols, and an automaton over the symbols says
where pieces begin. The automaton runs on all blocks of the text at once: a first pass composes each block's
transition function (for every state at the block's start, the state at its end), the functions are then chained
from block to block, and a second pass reads off the boundaries from the known states.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import parts

RANKS = "byte_bpe_multi_50k.tiktoken"
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols: the classes 0 to 2; an apostrophe that can begin a contraction of 1 or 2 letters; a blank (U+0020) or other
# white space that is the last of its run with text after it; any other white space; and what stands between texts.
SHORT, LONG, BLANK, LAST, GAP, END = 3, 4, 5, 6, 7, 8
# States: in a run of letters, numbers, others or white space; after a blank that the next run takes in; after a piece
# that is complete; one or two letters of a contraction to come.
IN_L, IN_N, IN_O, IN_S, TAKES, DONE, ONE, TWO = range(8)
STATES, SYMBOLS = 8, 9


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece begins here", at symbol * STATES + state."""
    to, begins = np.zeros((SYMBOLS, STATES), np.uint8), np.ones((SYMBOLS, STATES), bool)
    for symbol, run in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
        to[symbol] = run
        begins[symbol, [run, TAKES]] = False
    to[LETTER, TWO], to[LETTER, ONE] = ONE, DONE
    begins[LETTER, [ONE, TWO]] = False
    for symbol, rest in ((SHORT, ONE), (LONG, TWO)):
        to[symbol] = rest
        to[symbol, [IN_O, TAKES]] = IN_O
        begins[symbol, [IN_O, TAKES]] = False
    to[BLANK], to[LAST], to[GAP], to[END] = TAKES, DONE, IN_S, DONE
    begins[GAP, IN_S] = False
    return to.ravel(), begins.ravel()


TO, BEGINS = _automaton()


@cache
def classes() -> np.ndarray:
    """The class of each code point, by the edition of Unicode that the tiktoken library has (Python's may be older)."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for name, kind in (("L", LETTER), ("N", NUMBER)):
        of = tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        out[[ord(c) for c in of.decode(of.encode_ordinary(every))]] = kind
    out[SPACES] = SPACE
    return out


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The automaton's symbol of each code point; `ends` are positions just after each text, where END stands."""
    kind = classes()[points]
    out = kind.copy()
    text_next = np.zeros(len(points), bool)
    text_next[:-1] = kind[1:] != SPACE
    text_next[ends - 1] = False  # what follows a text is END
    space = kind == SPACE
    out[space] = np.where(text_next[space], np.where(points[space] == 32, BLANK, LAST), GAP)
    if (at := np.flatnonzero(points == 39)).size:
        after = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = after[at + 1], after[at + 2]
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        out[at[long]], out[at[short]] = LONG, SHORT
    out[ends] = END
    return out


def starts(symbol: np.ndarray, block: int = 256) -> np.ndarray:
    """Where pieces begin, by a scan over transition functions."""
    n = len(symbol)
    rows = -(-n // block)
    grid = np.full(rows * block, END, np.uint8)
    grid[:n] = symbol
    steps = np.ascontiguousarray(grid.reshape(rows, block).T).astype(np.intp) * STATES
    # A block's function: where each of the states at its start has gone at its end.
    goes = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for step in steps:
        goes = TO[step[:, None] + goes]
    # The functions one after another give the state at each block's start.
    state, at = DONE, np.empty(rows, np.uint8)
    for i, f in enumerate(goes.tolist()):
        at[i] = state
        state = f[state]
    out = np.empty((block, rows), bool)
    for i, step in enumerate(steps):
        key = step + at
        out[i] = BEGINS[key]
        at = TO[key]
    return np.flatnonzero(out.T.ravel()[:n])


class Merges(dict):
    """The packed ids of a piece, by its bytes; kept while the cache has room."""

    def __init__(self, ranks: dict[bytes, int], room: int = 500_000):
        super().__init__()
        self.ranks, self.room = ranks, room

    def __missing__(self, piece: bytes) -> bytes:
        out = struct.pack(f"<{len(ids := self.merged(piece))}I", *ids)
        if len(piece) <= 64:
            if len(self) >= self.room:
                self.clear()
            self[piece] = out
        return out

    def merged(self, piece: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        if n <= 100:  # plain lists are fastest for words; a heap keeps long pieces from taking quadratic time
            get, none = ranks.get, len(ranks) << 8
            found = [piece[i : i + 1] for i in range(n)]
            pairs = [get(piece[i : i + 2], none) for i in range(n - 1)]
            while pairs and (least := min(pairs)) < none:
                i = pairs.index(least)
                found[i] += found.pop(i + 1)
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = get(found[i] + found[i + 1], none)
                if i:
                    pairs[i - 1] = get(found[i - 1] + found[i], none)
            return [ranks[x] for x in found]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or after[j] != end:
                continue  # a part of this pair has been merged meanwhile
            alive[j], after[i] = False, end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:end])) is not None:
                heapq.heappush(heap, (r, k, end))
        return [ranks[piece[i : after[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.merges, self.pieces = Merges(ranks), {v: k for k, v in ranks.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        begin = starts(symbols(points, ends))
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        byte = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=byte[1:])
        at = byte[begin]
        data = "\0".join([*texts, ""]).encode()
        bounds = at.tolist()
        found = [data[a:b] for a, b in zip(bounds, [*bounds[1:], len(data)])]
        out, first = [], 0
        for last in np.searchsorted(at, byte[ends]).tolist():  # the piece there is what ends the text
            out.append(b"".join(map(self.merges.__getitem__, found[first:last])))
            first = last + 1
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """Where each id's bytes begin in the text's UTF-8, and the end of the last: any range of ids decodes alone."""
        return np.cumsum([0, *(len(self.pieces[i]) for i in np.frombuffer(ids, "<u4").tolist())])


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for part in parts(batches):
        yield part.column("doc_id"), [t or "" for t in part.column("text").to_pylist()]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (packed), n_tokens, offsets of each token in the text's UTF-8, decoded_sha256 of the bytes that the ids decode to.

    A null text counts as an empty one and has no ids; repeated rows come out repeated; only doc_id and text are read.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        c = codec(path)
        for doc_id, texts in _texts(batches):
            ids = c.encode(texts)
            offsets = pa.array([c.offsets(x) for x in ids], pa.list_(pa.int64()))
            digests = pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), offsets, digests], ["doc_id", "ids", "n_tokens", "offsets", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long, offsets array<long>, decoded_sha256 string")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and packed ids; null ids are none."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        c = codec(path)
        for b in batches:
            text = [c.decode(x or b"").decode(errors="replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the decoded bytes: encoded and decoded in one pass over the texts.

    Nulls, repeats and other columns are treated as by encode().
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        c = codec(path)
        for doc_id, texts in _texts(batches):
            ids = c.encode(texts)
            digest = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (ids, map(c.decode, ids))]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array(x, pa.string()) for x in digest)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
