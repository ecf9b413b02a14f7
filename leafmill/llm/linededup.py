"""Line dedup: of each line, the document with the smallest id keeps it.

Documents become (hash of key, document, position) rows; a range partition by hash with a secondary sort by document
and position lets one pass over each partition stream first occurrences; what goes back to the documents is a
compressed bitmap of the lines to keep, never text.

Before the shuffle each slice of documents settles what it can: of the occurrences of a key in the slice only those
in its smallest document can be kept, so only they travel. A line that a third of the corpus shares thus sends one
document's rows for each slice.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, parts, spare

LEAST = 10
STRIP = " \t\n\v\f\r"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Text that is settled at a time, before the shuffle.
SLICE = 8 << 20


def _key(line: str) -> str:
    line = line.strip(STRIP)
    return line.lower() if line.isascii() else line.translate(LOWER)


def _same() -> Column:
    """Tells documents with the same id apart."""
    return F.xxhash64(F.lit("line"), "text").alias("same")


def _occurrences(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """For each slice: rows (hash, doc_id, same, at) of the smallest document of each key, with hash null for lines already known to go."""
    digest = xxhash.xxh3_128_digest
    for part in parts(batches, limit=SLICE):
        ids, same = part.column("doc_id").to_pylist(), part.column("same").to_pylist()
        first: dict[bytes, int] = {}
        rows: list[tuple[bytes, int, int]] = []
        for k, text in enumerate(part.column("text").to_pylist()):
            mine = ids[k]
            if not text or mine is None:
                continue
            for at, line in enumerate(text.split("\n")):
                if len(line) >= least and len(key := _key(line)) >= least:
                    rows.append((h := digest(key.encode()), k, at))
                    if (old := first.get(h)) is None or mine < ids[old]:
                        first[h] = k
        gone: dict[int, list[int]] = {}
        out: list[tuple] = []
        for h, k, at in rows:
            if ids[first[h]] == ids[k]:
                out.append((h, ids[k], same[k], [at]))
            else:
                gone.setdefault(k, []).append(at)
        out += [(None, ids[k], same[k], at) for k, at in gone.items()]
        if out:
            kinds = [pa.binary(), part.schema.field("doc_id").type, pa.int64(), pa.list_(pa.int32())]
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 20_000]), kinds)], ["h", "doc_id", "same", "at"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by hash, document and position: everything but the first document's rows of a hash goes. One row is held."""
    now, kept = None, None
    for b in batches:
        hs, ids = b.column("h").to_pylist(), b.column("doc_id").to_pylist()
        go = []
        for i, h in enumerate(hs):
            if h is None:
                go.append(i)
            elif h != now:
                now, kept = h, ids[i]
            elif ids[i] != kept:
                go.append(i)
        if go:
            yield b.take(pa.array(go)).select(["doc_id", "same", "at"])


def bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, same (a hash of the text), keep: zlib of a bitmap, bit k of byte k / 8 for line k, of documents that lose lines.

    Lines of a key with fewer than `least` code points stay. Null and empty texts, and documents without an id, have no
    lines to lose nor to claim. Rows with equal ids count as one document: they keep the same lines of a key.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text", _same()).mapInArrow(lambda x: _occurrences(x, least), f"h binary, doc_id {kind}, same long, at array<int>")
    found = cut(found)  # the range partition reads it twice: for its bounds, then to deal rows out
    settled = found.where("h is null").select("doc_id", "same", "at")
    ranged = found.where("h is not null").repartitionByRange("h").sortWithinPartitions("h", "doc_id", "at").mapInArrow(_stream, f"doc_id {kind}, same long, at array<int>")
    lines = settled.union(ranged).groupBy("doc_id", "same").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at in b.column("at").to_pylist():
                bits = np.ones(-(-(max(at) + 1) // 8) * 8, np.uint8)
                bits[at] = 0
                out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("same"), pa.array(out, pa.binary())], ["doc_id", "same", "keep"])

    return lines.mapInArrow(pack, f"doc_id {kind}, same long, keep binary")


def kept_lines(text: str | None, keep: bytes | None) -> tuple[list[str], int]:
    """The lines that stay, and how many there were; lines beyond the bitmap stay."""
    lines = (text or "").split("\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return [x for k, x in enumerate(lines) if k >= len(bits) or bits[k]], len(lines)


def _with_bitmaps(docs: DataFrame, least: int) -> tuple[DataFrame, str]:
    """The documents with a column for their bitmaps, and its name."""
    maps, keep = bitmaps(docs, least), spare(docs, "keep")
    maps = maps.select(F.col("doc_id").alias(i := spare(docs, "id")), F.col("same").alias(s := spare(docs, "same")), F.col("keep").alias(keep))
    joined = docs.join(maps, (docs["doc_id"] == maps[i]) & (F.xxhash64(F.lit("line"), docs["text"]) == maps[s]), "left")
    return joined.drop(i, s), keep


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the lines that stay, for every document.

    A null or empty text is one empty line, which stays. Null and equal ids are treated as by bitmaps(); every row comes
    out, and columns other than doc_id and text are not read.
    """

    told, name = _with_bitmaps(docs.select("doc_id", "text"), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, limit=4 << 20):
            rows = []
            for text, keep in zip(b.column("text").to_pylist(), b.column(name).to_pylist()):
                kept, n = kept_lines(text, keep)
                rows.append((n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return told.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents with their lines dropped; other columns as they were, null texts stay null, n_chars (if there) follows the text.

    Null and equal ids are treated as by bitmaps(); repeated rows stay repeated, and a document that loses all its
    lines stays with an empty text.
    """
    names, schema = docs.columns, docs.schema
    told, name = _with_bitmaps(docs, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, limit=4 << 20):
            texts, maps = b.column("text").to_pylist(), b.column(name).to_pylist()
            new = [t if k is None else "\n".join(kept_lines(t, k)[0]) for t, k in zip(texts, maps)]
            columns = {c: b.column(c) for c in names} | {"text": pa.array(new, pa.string())}
            if "n_chars" in columns:
                kind = columns["n_chars"].type
                columns["n_chars"] = pa.array([n if t is None or k is None else len(t) for t, k, n in zip(new, maps, columns["n_chars"].to_pylist())], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return told.mapInArrow(run, schema)


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.first AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
