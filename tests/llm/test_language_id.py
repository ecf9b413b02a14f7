import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import langid
from leafmill.llm.queries import op1_language_id
from tests.conftest import SMALL
from tests.llm.cases import HARD, empty, hard

LARGER = "/root/testdata/sf0.01"


def filter_of(texts):
    out = {}
    for k, t in texts.items():
        gram, use = langid.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        out[k] = np.unique(gram[use])
    return langid.Filter(out)


@pytest.mark.parametrize("n", [3, 9, 70])
def test_the_mask_holds_every_language_that_has_a_gram(n):
    """No false negatives, few false positives, for masks of one byte, of one word and of two."""
    rng = np.random.default_rng(n)
    sets = {f"l{i:02d}": rng.integers(0, 1 << 32, 300, dtype=np.uint32) for i in range(n)}
    f = langid.Filter(sets)
    for i, name in enumerate(f.names):
        for other in (sets[name], rng.integers(0, 1 << 32, 300, dtype=np.uint32)):
            slots = langid.slots(other)
            mask = np.bitwise_and.reduce([f.masks[i // 64][s] for s in slots])
            hit = (mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)
            assert hit.all() if other is sets[name] else hit.mean() < 0.01


def test_counts_are_corrected_for_chance():
    """A filter whose slots are half full of a language doesn't make that language of any text."""
    rng = np.random.default_rng(1)
    text = "the quick brown fox jumps over the lazy dog " * 5
    gram, use = langid.grams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    f = langid.Filter({"full": rng.integers(0, 1 << 32, 400_000, dtype=np.uint32), "en": np.unique(gram[use])})
    names, score = f.predict(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert names == ["en"] and score[0] > 0.9


def test_held_out_accuracy(spark):
    got = op1_language_id(spark, LARGER).join(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r["held_out"] and r["lang"] and r["text"] and any(c.isalpha() for c in r["text"])]
    assert len(held) > 150 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_texts_do_not_depend_on_their_neighbours():
    f = filter_of({"en": "the house is in the street where people live", "de": "das haus steht in der strasse wo leute wohnen"})
    texts = ["the street", "", "die strasse der leute", "x"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    names, score = f.predict(buf, at)
    for t, n, s in zip(texts, names, score):
        one, own = f.predict(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert (one[0], own[0]) == (n, s)


def test_hard_cases(spark):
    model = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    got = langid.identify(hard(spark), model).collect()
    assert len(got) == len(HARD)
    of = [(r["doc_id"], r["lang_pred"]) for r in got]
    assert of[1] == (2, "und") and of[2] == of[3] == (3, "und") and of[7] == (6, "und") and of[8] == (7, "de")
    assert langid.identify(empty(spark), model).count() == 0
    nothing = langid.fit(empty(spark))
    assert {r["lang_pred"] for r in langid.identify(hard(spark), nothing).collect()} == {"und"}
    assert langid.fit(hard(spark).withColumn("lang", F.lit(None).cast("string"))).names == []
