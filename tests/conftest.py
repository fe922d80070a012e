from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tabwright import build_session

    session = build_session("tests", "8")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def stations(spark, tmp_path_factory):
    from sample import STATION_CSV
    from tabwright.sources.readers import read_csv

    path = tmp_path_factory.mktemp("stations") / "stations.csv"
    path.write_text(STATION_CSV)
    return read_csv(spark, str(path))
