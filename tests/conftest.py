import os
import sys
from pathlib import Path

import pytest

HERE = str(Path(__file__).resolve().parent.parent)
sys.path[:0] = [HERE, str(Path(__file__).resolve().parent)]
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ticketspark.session import local_session

    session = local_session("tests", cpus=4, spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over one text."""

    def value(make, *texts):
        from pyspark.sql import functions as F

        row = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
        out = row.select(make(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first()["v"]
        return out.asDict(True) if hasattr(out, "asDict") else out

    return value
