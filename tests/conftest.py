import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from leafmill.session import local_session, show_package_to_workers  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    show_package_to_workers(session)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """What an expression makes of columns given by name: value(expr, "name type, ...", row)."""

    def of(expression, schema, *row):
        return spark.createDataFrame([row], schema).select(expression.alias("x")).first()["x"]

    return of
