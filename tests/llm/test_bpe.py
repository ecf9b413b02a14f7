import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import bpe
from leafmill.llm.queries import op3_byte_bpe
from tests.conftest import SMALL
from tests.llm.cases import HARD, empty, hard

PATH = public_tokenizers.path(bpe.RANKS)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = st.sampled_from(["'", "'s", "'ll", "'RE", " ", "  ", "\n", " ", "　", "\u0085", "\x1c", "a", "Zé", "12", "٣", "½", "!", "日本", "́", "\U0001f600", "\0", "don't", "\t", "ß", "ⅷ", "<|endoftext|>"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.lists(PIECES, max_size=12).map("".join)), max_size=8))
def test_as_the_library_does(reference, texts):
    codec = bpe.codec(PATH)
    got = codec.encode(texts)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()
        ends = codec.offsets(ids)
        assert ends[0] == 0 and ends[-1] == len(t.encode()) and all(codec.decode(ids[4 * k : 4 * k + 4]) == t.encode()[ends[k] : ends[k + 1]] for k in range(len(ends) - 1))


@pytest.mark.parametrize("block", [1, 2, 7, 256])
def test_blocks_of_the_scan_do_not_matter(block):
    text = "It's 12 o'clock,  isn't it?\n\n  Yes'll do !"
    points = np.frombuffer((text + "\0").encode("utf-32-le"), "<u4")
    s = bpe.symbols(points, np.array([len(text)]))
    assert bpe.starts(s, block).tolist() == bpe.starts(s, 1000).tolist()


@pytest.mark.parametrize("piece", [b"a" * 500, b"ab" * 300, bytes(range(256)) * 2])
def test_long_pieces_merge_as_short_ones(reference, piece):
    codec = bpe.codec(PATH)
    whole = codec.merges.merged(piece)
    assert b"".join(codec.pieces[i] for i in whole) == piece
    if piece.isascii():
        assert whole == reference.encode_ordinary(piece.decode())


def test_documents(spark, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = op3_byte_bpe(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_hard_cases(spark):
    tokens = bpe.encode(hard(spark))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in bpe.decode(tokens).collect()) == sorted((i or 0, t or "") for i, t, *_ in HARD)
    assert [r["n_tokens"] for r in tokens.where("doc_id = 2").collect()] == [0]
    assert bpe.encode(empty(spark)).count() == bpe.round_trip(empty(spark)).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first()["text"] == ""
