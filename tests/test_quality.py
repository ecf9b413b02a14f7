"""Profiles, verdicts and routes: fixed cases, and a plain Python version over whole texts."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from leafmill.functions import charclass as cc
from leafmill.functions import quality as Q
from leafmill.plans.quality_queries import injected
from tests.conftest import SMALL

HINDI = "हिंदी में लिखा हुआ एक साधारण वाक्य जो पृष्ठ पर दिखता है और पढ़ा जा सकता है"
ENGLISH = "A plain sentence with a rupee sign ₹ and an arrow → in it, long enough to be judged."


def kind(c):
    inside = lambda ranges: any(a <= ord(c) <= b for a, b in ranges)
    if c.isspace():
        return "space"
    if c in "\u200c\u200d":
        return "indic"
    if unicodedata.category(c) in ("Cc", "Cn", "Co") or c in "\ufffd\ufffe\uffff":
        return "bad"
    for name, ranges in (("indic", cc.INDIC_RANGES), ("arabic", cc.ARABIC_RANGES), ("latin", [(0x21, 0x7E)]), ("common", cc.COMMON_RANGES)):
        if inside(ranges):
            return name
    return "foreign"


def plain(text):
    kinds = [kind(c) for c in text]
    n = sum(k != "space" for k in kinds)
    mark = lambda i: kinds[i] == "indic" and unicodedata.category(text[i]) in ("Mn", "Mc")
    base = lambda i: kinds[i] == "indic" and (text[i] in "\u200c\u200d" or unicodedata.category(text[i])[0] in "LM")
    words = [{kind(c) for c in w} for w in text.split()]
    return {
        "chars": n,
        **{f"{k}_chars": kinds.count(k) for k in ("indic", "arabic", "latin")},
        "orphan_marks": sum(mark(i) and (i == 0 or not base(i - 1)) for i in range(len(text))),
        "indic_words": sum("indic" in w for w in words),
        "mixed_script_words": sum({"indic", "foreign"} <= w for w in words),
        "words": len(words),
        "_bad": 100 * kinds.count("bad") / max(n, 1),
        "_foreign": 100 * kinds.count("foreign") / max(n, 1),
    }


def test_profile_is_that_of_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", injected(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text"))
    rows = Q.with_metrics(docs).select("text", "metrics.*").collect()
    assert len(rows) == 200
    for r in rows:
        want = plain(r["text"])
        for k, v in want.items():
            if k[0] == "_":
                assert abs(r[f"{k[1:]}_pct"] - v) <= 0.0501
            else:
                assert r[k] == v, (k, r["text"][:80])


def test_java_knows_white_space_as_python_does(value):
    every = "".join(chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000)
    assert value(F.regexp_replace(F.col("t"), f"[^{cc.SPACE}]+", ""), "t string", every) == "".join(c for c in every if c.isspace())


def verdict(spark, text, fonts=()):
    df = spark.createDataFrame([(text, list(fonts))], "text string, fonts array<string>")
    return Q.with_metrics(df).select(Q.verdict(F.col("metrics"), F.col("fonts")).alias("v")).first()["v"]


@pytest.mark.parametrize("text", [ENGLISH, HINDI, None, ""])
def test_healthy_layers_pass(spark, text):
    assert verdict(spark, text)["usable"]


@pytest.mark.parametrize(
    "text, said",
    [
        ("\ue000\ue001" * 30, "private-use characters 100%"),
        ("readable text " * 5 + "\ufffd" * 20, "replacement characters U+FFFD"),
        ("Ã¤Ã¶Ã¼ßéèñ" * 10, "outside the supported scripts"),
        ("abcdefghijklmnopqrstuvwxyzabcdef " * 6, "words implausibly long (mean 32.0 characters)"),
        ("a b c d e f g h i j k l m n o p", "words implausibly short (mean 1.0 characters)"),
        ("् क ् ख ् ग ् घ " * 3, "combining marks detached"),
        ("हिéंदी " * 6, "Indic words contain stray non-Indic letters"),
        ("text with controls \x01\x02\x03\x04", "private-use characters 0%"),
    ],
)
def test_bad_layers_fail_with_a_reason(spark, text, said):
    v = verdict(spark, text)
    assert not v["usable"] and said in v["reason"]


def test_fonts_and_arabic(spark):
    v = verdict(spark, ENGLISH, ["KrutiDev010", "Arial", "O'Preeti", "KrutiDev010", None])
    assert v["reason"].endswith("legacy Indic font 'KrutiDev010', \"O'Preeti\")")
    assert verdict(spark, "سلام دنیا یہ ایک جملہ ہے")["warnings"][0].startswith("Arabic-script")


LONG = "word " * 40


@pytest.mark.parametrize(
    "text, cover, paths, force, ocr, said",
    [
        (LONG, 0.0, 0, True, True, "OCR forced"),
        ("", 0.5, 0, False, True, "no text layer"),
        ("", 0.0, 60, False, True, "no text layer (vector graphics only"),
        ("", 0.01, 10, False, False, "blank page"),
        (None, None, None, False, False, "blank page"),
        ("short", 0.2, 0, False, True, "text layer too short (5 characters)"),
        ("short", 0.0, 0, False, False, "short text layer (5 characters), no images"),
        ("word " * 10, 0.625, 0, False, True, "images cover 62% of the page"),
        ("\ue000" * 200, 0.0, 0, False, True, "text layer failed"),
        (LONG, 0.0, 0, False, False, "text layer valid (160 characters)"),
        (LONG, 0.9, 0, False, False, "text layer valid (160 characters)"),
    ],
)
def test_routes(spark, text, cover, paths, force, ocr, said):
    df = spark.createDataFrame([(text, cover, paths)], "text string, cover double, paths int")
    r = Q.with_route(df, F.col("text"), F.col("cover"), F.col("paths"), force=force).first()["route"]
    assert (r["ocr"], r["reason"].startswith(said) or said in r["reason"]) == (ocr, True)
    assert len(r["warnings"]) == (cover == 0.9)


def test_profile_keeps_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("a b", 1)], "text string, chars int")
    assert Q.with_metrics(df).columns == ["text", "chars", "metrics"]
    assert Q.with_metrics(df.limit(0)).count() == 0


def test_counts_by_classes_are_those_by_expressions(spark):
    import random

    from leafmill.functions import charcount
    from leafmill.functions import quality as Q

    rng = random.Random(7)
    pools = ["ab z.!~", " \t\n\x1c\x85\xa0\u2003\u3000", "\x00\x01\x7f\x9f\ue000\ufffd\ufffe\U000f0000\U0010ffff", "\u0939\u093f\u0902\u094d\u0915\u200c\u200d\u0978\u0af9\ua8ff", "\u0633\u0644\ufe8d\u061d", "\xd7\u2013\u20ac\u25a0", "\xe9\u4e2d\U0001f600\u0378\u1c80\U0001faf9"]
    texts = ["", " ", *("".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 60))) for _ in range(600)), *map(chr, range(1, 0xD800, 7)), *("a" + chr(c) for c in range(0xE000, 0x30000, 11))]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "k int, t string")
    told = Q.counts(Q.sorted_out(Q.pieces(F.col("t"))))
    got = df.select("k", "t", charcount.counts_of(F.col("t")).alias("new"), told.alias("old")).collect()
    assert len(got) == len(texts) + 1 and not [r for r in got if r["new"] != r["old"]]
