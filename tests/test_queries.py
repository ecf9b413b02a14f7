"""Every query of the catalogue against its SQL on the smallest tables, and the entry point."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from leafmill.plans.catalogue import QUERIES, SQL
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if isinstance(x, (int, float)) or hasattr(x, "dtype") else x


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got)
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_nothing_but_the_entry_names_the_subpackage():
    root = Path(entry.__file__).parent
    assert not [p for p in (root / "leafmill").rglob("*.py") if "llm" not in p.relative_to(root).parts and "leafmill.llm" in p.read_text()]


@pytest.mark.parametrize("name", ["read_pdf", "read_docx", "read_markdown"])
def test_files_are_made_and_read_once(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    stages = [line for line in plan.splitlines() if "ArrowEvalPython [" in line]
    assert len(stages) == len({line.partition("ArrowEvalPython")[2].partition("(")[0] + line.partition("(")[2][:20] for line in stages}) == 5
    assert sum("run(c_custkey" in line for line in stages) == 1 and "Join" not in plan


def test_pictures_wider_than_16_bits():
    from leafmill.plans.flow_queries import picture
    from leafmill.sources.images import frames

    for key in (65532, 65537, 2_499_997, 5_399_997, 5_399_991, 5_399_993, 5_399_994):
        assert frames(picture(key, "", ""))[0] == (key + 1, 40)
    whole = picture(65537, "", "")
    assert frames(whole.replace(b"Exif\0\0", b"Exif\0\1"))[0] == (0, 40)  # nobody says how wide it is
