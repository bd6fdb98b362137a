import pytest

from tsweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture
def panel_of(spark):
    """A panel frame from ``{series: [values]}``, one row per day."""

    def make(series, start="2024-01-01"):
        rows = [(key, i, v if v is None else float(v)) for key, values in series.items() for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "series_id string, seq bigint, value double")
        return df.selectExpr("series_id", f"timestamp_ntz'{start}' + make_dt_interval(int(seq)) AS ts", "seq", "value")

    return make
