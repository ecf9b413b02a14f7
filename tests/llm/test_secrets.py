import hashlib
import random
import re

from leafmill.llm import secrets
from leafmill.llm.queries import op9_secret_scan
from tests.llm.cases import HARD, empty, hard

LARGER = "/root/testdata/sf0.01"

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def slow(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_base_spans_of_all_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    got = op9_secret_scan(spark, LARGER).collect()
    assert len(got) == 1000 and any(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got)
    for r in got:
        want = slow(texts[r["doc_id"]])
        said = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in want) for x in range(3)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if not x.startswith("random")] == (said.split(",") if said else [])


def test_odd_matches():
    texts = ['PassWord = "abcdefgh"', "my_token:short", "apikey=12345678 API_KEY:'x.y-z/w+='", "AKIA" + "A1" * 6, "AKIAabc", "f" * 31, "0f" * 20 + "g", "tokentoken=abcdefghi", "ſecret=abcdefgh", "toKen=abcdefgh", "secret=AKIA" + "Z" * 20, "password==abcdefgh"]
    for t in texts:
        assert secrets.base_spans(t) == slow(t), t


def chains():
    words = ["create", "session", "user", "server", "documentation", "createSession", "getUserById", "snake_case_name", "http_server_2", "2024-01-01", "organisation", "version_12", "utf8_string_length", "MAX_BUFFER_SIZE", "section-3-heading", "anotherVeryLongIdentifierName"]
    return secrets.Chains(secrets.training_strings(), words * 20 + secrets.identifier_forms(words))


def test_the_ratio_tells_keys_from_names():
    c, rng = chains(), random.Random(99)
    keys = ["".join(rng.choices(a, k=32)) for a in secrets.ALPHABETS for _ in range(50)]
    names = ["userSessionServer2", "SESSION_DOCUMENTATION_7", "server/user/create_12", "createSessionDocumentation", "snake_case_server_name2", "get_version_by_user_id_12", "section-3-documentation"]
    assert sum(c.score(k) >= secrets.LEAST for k in keys) / len(keys) > 0.95 and all(c.score(n) < secrets.LEAST for n in names)


def test_the_method_adds_spans_beside_the_base(spark):
    key = "xK9v2LqPz8TnR4wYb7Jd"
    df = spark.createDataFrame([(1, f"use {key} for it, and password={key}"), (2, "nothing but ordinary words_and_names here 2024")], "doc_id long, text string")
    got = secrets.report(secrets.scan(df, chains())).orderBy("doc_id").collect()
    assert got[0]["spans"] == "random:4:24,assign:37:66" and (got[0]["n_assign"], got[0]["n_random"]) == (1, 1) and got[1]["spans"] == ""


def test_overlaps():
    spans = secrets.merged([(5, 9), (1, 3), (2, 4), (20, 30)])
    assert spans == [(1, 4), (5, 9), (20, 30)]
    for s in range(35):
        for e in range(s + 1, 36):
            assert secrets.overlaps(spans, s, e) == any(a < e and b > s for a, b in spans)


def test_hard_cases(spark):
    got = secrets.report(secrets.scan(hard(spark))).collect()
    assert len(got) == len(HARD) and [r["spans"] for r in got if r["doc_id"] == 2] == [""]
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    assert secrets.report(secrets.scan(empty(spark))).count() == 0


def test_scan_finds_keys_of_any_length_and_without_digits(spark):
    """Part of the random keys that scan() finds whole, by length; one of letters only is a key too."""
    rng, rows = random.Random(12), []
    for n in (16, 20, 32, 64, 512, 513, 1600, 5000):
        rows += [(n, "".join(rng.choices(secrets.ALPHABETS[1], k=n))) for _ in range(60)]
    rows += [(-n, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=n))) for n in (20, 32, 64) for _ in range(60)]
    df = spark.createDataFrame([(i, f"see {k} there") for i, (_, k) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in secrets.scan(df, chains()).collect()}
    found = {n: [got[i] == [("random", 4, 4 + abs(n))] for i, (m, _) in enumerate(rows) if m == n] for n in {m for m, _ in rows}}
    share = {n: sum(x) / len(x) for n, x in found.items()}
    assert all(x >= (0.9 if abs(n) <= 20 else 0.95) for n, x in share.items()), share
