import hashlib
import random

import duckdb
import pytest

from leafmill.llm import linededup
from leafmill.llm.queries import op4_line_dedup
from tests.conftest import SMALL
from tests.llm.cases import HARD, empty, hard


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def slow(rows):
    """What stays of each (id, text)."""
    first, seen = {}, {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), i), i)
                seen.setdefault(key(line), set()).add(i)
    gone = lambda i, k: i is not None and len(k) >= 10 and len(seen[k]) > 1 and first[k] != i
    return [(i, "\n".join(x for x in (t or "").split("\n") if not gone(i, key(x)))) for i, t in rows]


@pytest.mark.parametrize("cut_at", [60, 8 << 20])
def test_against_brute_force(spark, monkeypatch, cut_at):
    """Whether documents are settled in one slice or in many."""
    rng = random.Random(cut_at)
    lines = [f"line number {k} of some" for k in range(25)] + ["short", "", "  LINE number 1 of some\t", "ÄÖÜ äöü ÄÖÜ", "äöü äöü äöü", " padded line ", "\x1cpadded line"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(8)))) for i in range(80)]
    rows += [(i, "one line that very many share") for i in range(100, 160)] + rows[:3]
    monkeypatch.setattr(linededup, "SLICE", cut_at)
    # The limit is read where the function is pickled, so it goes along as a default here.
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((r["doc_id"], r["text"]) for r in linededup.dedup(df).collect())
    assert got == sorted(slow(rows))


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SMALL}/documents.parquet')")
    want = {tuple(r) for r in con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({linededup.SQL})").fetchall()}
    got = op4_line_dedup(spark, SMALL).collect()
    assert len(got) == 200 and {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got} == want and any(r["n_dropped"] for r in got)


def test_hard_cases(spark):
    rows = [(i, t) for i, t, *_ in HARD]
    df = hard(spark)
    got = linededup.dedup(df).collect()
    want = [(i, None if t is None else kept) for (i, t), (_, kept) in zip(rows, slow(rows))]
    order = lambda x: sorted(x, key=repr)
    assert order((r["doc_id"], r["text"]) for r in got) == order(want)
    assert {(r["same"][4:], r["id_"][3:]) for r in got} == {(str(i), str(i)) for i in range(len(rows))} and got[0].__fields__ == df.columns
    digests = order((r["doc_id"], r["kept_sha256"]) for r in linededup.report(df).collect())
    assert digests == order((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in want)
    assert linededup.dedup(empty(spark)).count() == linededup.report(empty(spark)).count() == linededup.bitmaps(empty(spark)).count() == 0


def test_lengths_follow_the_text(spark):
    df = spark.createDataFrame([(1, "a line of ten\nb", 15), (2, "a line of ten\nc", 15)], "doc_id long, text string, n_chars long")
    assert [(r["text"], r["n_chars"]) for r in linededup.dedup(df).orderBy("doc_id").collect()] == [("a line of ten\nb", 15), ("c", 1)]
