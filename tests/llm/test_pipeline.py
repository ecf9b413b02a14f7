import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from leafmill.llm import bpe, linededup, quality, simhash
from tests.conftest import SMALL
from tests.llm.cases import hard
from tests.llm.test_decontamination import slow_distance, words
from tests.llm.test_line_dedup import slow as slow_lines
from tests.llm.test_simhash import slow_kept


def low(text):
    """A-Z in lower case, and each run of ASCII white space as a blank."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return " ".join(w for w in re.split("[\\x20\\x09-\\x0D]+", text) if w)


def test_stages_one_after_another(spark, tmp_path):
    """Each stage against a brute force over what it got, but for the classifier, whose decisions are held against the labels."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {"": docs.collect()}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    rows = lambda name: {r["doc_id"]: r["text"] for r in seen[name]}
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "encode"]
    for name in list(seen)[1:-1]:
        assert seen[name][0].__fields__ == seen[""][0].__fields__

    whole = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.fit(whole, spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = {r["doc_id"] for r in quality.scores(whole, model).collect() if r["predicted"]}
    assert set(rows("quality")) == good and 0 < len(good) < 200
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert np.mean([(i in good) == (q == 1) for i, q in labels.items()]) > 0.9

    assert rows("line_dedup") == dict(slow_lines(list(rows("quality").items())))
    came, kept = rows("line_dedup"), set(rows("near_dedup"))
    assert all(came[i] == t for i, t in rows("near_dedup").items())
    ids = sorted(came)
    assert kept == {ids[k] for k in slow_kept([low(came[i]) for i in ids])} and len(kept) < len(ids)

    items = [words(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    within = lambda item, text: (Counter(item) & Counter(text)).total() >= len(item) - len(item) // 5 and slow_distance(item, text) <= len(item) // 5
    held = {i: any(within(x, words(t)) for x in items) for i, t in rows("near_dedup").items()}
    assert set(rows("decontaminate")) == {i for i, h in held.items() if not h} and any(held.values())

    codec = bpe.codec(public_tokenizers.path(bpe.RANKS))
    texts = rows("decontaminate")
    assert {r["doc_id"]: codec.decode(bytes(r["ids"])).decode() for r in seen["encode"]} == {i: t or "" for i, t in texts.items()}
    sha = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in seen["encode"]} == sha
    assert all(len(r["offsets"]) == r["n_tokens"] + 1 and r["offsets"][-1] == len((texts[r["doc_id"]] or "").encode()) for r in seen["encode"])


def test_run_has_the_rows_of_the_stages(spark):
    got = pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids", "offsets", "ids_sha256", "decoded_sha256"] and got.count() > 20
    assert got.where(F.col("n_tokens") * 4 != F.length("ids")).count() == 0


def test_hard_documents_go_through(spark, tmp_path):
    docs = hard(spark).withColumn("n_chars", F.length("text").cast("long"))
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() <= 11
    for stage in (linededup.dedup, simhash.keep_one):
        assert stage(hard(spark).limit(0)).count() == 0
