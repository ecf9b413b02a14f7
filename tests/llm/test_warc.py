import gzip
import io

import duckdb
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from leafmill.llm import warc
from leafmill.llm.queries import op7_warc
from tests.conftest import SMALL


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SMALL}/pages.parquet')")
    columns = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = set(con.execute(f"select {columns} from ({warc.SQL})").fetchall())
    assert {tuple(r) for r in op7_warc(spark, SMALL).select(*columns.split(", ")).collect()} == want


PAGES = [(1, "http://a", "x" * 200), (2, None, "x" * 200), (3, "http://c\nd", "x" * 200), (4, "http://d", "é" * 50), (5, "u", "é" * 50), (6, "u", None), (7, "u", ""), (8, "u", "short"), (9, "u", "short"), (None, "u", "x" * 200), (4, "http://d", "é" * 50), (10, "u", "y\r\n\r\n" * 90_000)]


@pytest.fixture
def archive(spark, tmp_path):
    df = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string")
    warc.archive(df.repartition(3), str(tmp_path / "w"))
    return tmp_path / "w"


def test_hard_cases(spark, archive):
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_back(spark, str(archive)).collect()), key=repr)
    want = []
    for i, _, h in PAGES:
        n = len((h or "").encode())
        same = [j for j, _, g in PAGES if g == h and j is not None]
        again = i is not None and n >= 100 and min(same) != i
        want.append((i, n, "revisit" if again else "response", min(same) if again else None))
    assert got == sorted(want, key=repr)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.archive(none, str(archive) + "-none")
    assert warc.read_back(spark, str(archive) + "-none").count() == 0


def test_members_are_gzip_and_headers_say_what_they_hold(spark, archive):
    text = b"".join(gzip.decompress(p.read_bytes()) for p in archive.glob("*.warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == len(PAGES) and b"WARC-Target-URI: http://c d\r\n" in text
    read = spark.read.format("warc").option("path", str(archive)).load()
    assert read.count() == len(PAGES) and read.where("record_id = '<urn:x-page:8>'").first()["payload"] == b"short"
    row = read.where("target_uri = 'http://d' and record_type = 'response'").first()
    assert row["payload"].decode() == "é" * 50 and row["headers"]["warc-type"] == "response"


def test_filters_are_pushed_and_payloads_skipped(spark, archive):
    reader = warc.WarcReader(str(archive), True)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("target_uri",), ("http://a", "u")), GreaterThan(("payload_bytes",), 5)]))
    assert [type(f) for f in left] == [GreaterThan] and reader.equal == {"warc-type": ["revisit"]} and reader.among == {"warc-target-uri": [{"http://a", "u"}]}
    assert len(reader.partitions()) == len(list(archive.glob("*.warc.gz")))
    warc.register(spark)
    plan = spark.read.format("warc").option("path", str(archive)).load().where("record_type = 'revisit'")
    assert {r["record_type"] for r in plan.collect()} == {"revisit"}
    assert "Filter" not in plan._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0].replace("isnotnull", "") or plan.count() == 3


class Counting(io.BytesIO):
    bytes_read = 0

    def read(self, n=-1):
        out = super().read(n)
        self.bytes_read += len(out)
        return out


def test_unwanted_records_are_not_read():
    """Past a record that isn't wanted the reader seeks: its payload is neither read nor inflated."""
    import random

    noise = random.Random(1).randbytes(3_000_000)
    data = warc.member(warc.record("response", {"WARC-Record-ID": "<a>"}, noise)) + warc.member(warc.record("metadata", {"WARC-Record-ID": "<b>"}, b"small"))
    raw = Counting(data)
    found = list(warc.records(raw, lambda h: h["warc-type"] == "metadata"))
    assert [h["warc-record-id"] for h, _ in found] == ["<b>"] and raw.bytes_read < len(data) / 3
    assert [b for _, b in warc.records(Counting(data), payload=False)] == [None, None]
    assert warc.payload_of(*list(warc.records(io.BytesIO(data)))[0]) == noise


def test_archives_of_others(tmp_path, spark):
    """Plain records, records in one member each without lengths, and folded headers."""
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nX-Long: a\r\n b\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 30\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "other.txt").write_text("no archive")
    warc.register(spark)
    rows = spark.read.format("warc").option("path", str(tmp_path)).load().collect()
    assert sorted((r["record_type"], r["payload"]) for r in rows) == [("response", b"hello")] * 2 + [("warcinfo", b"info")] * 2
    assert {r["headers"].get("x-long") for r in rows} == {"a b", None}
    for cut in (gzip.compress(two)[:-30], two[:40]):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(cut)))


def test_writing_again_and_adding(spark, archive):
    row = spark.read.format("warc").option("path", str(archive)).load().where("record_id = '<urn:x-page:8>'").withColumn("headers", F.lit(None).cast("map<string,string>"))
    row.write.format("warc").option("path", str(archive)).mode("append").save()
    assert spark.read.format("warc").option("path", str(archive)).load().count() == len(PAGES) + 1
    (archive / "left-by-a-lost-task.warc.gz").write_bytes(b"torn")
    assert spark.read.format("warc").option("path", str(archive)).load().count() == len(PAGES) + 1
    assert pafs.FileSystem.from_uri(f"file://{archive}")[0].get_file_info(f"{archive}/_manifest.json").size > 0
