import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelcast.session import build_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "panelcast-tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SF


@pytest.fixture
def panel_of(spark):
    """Panel from {series: list of values}, one value per day from 2023-01-02, a Monday."""

    def build(series, start=dt.date(2023, 1, 2), step=1):
        rows = [
            (name, start + dt.timedelta(days=i * step), None if v is None else float(v))
            for name, values in series.items() for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, "series_id string, ds date, y double")

    return build
