import pytest

from stintwise.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def long_series(spark):
    """Series beyond five rows count as long within the test; few ranges keep it short."""
    spark.conf.set("stintwise.series.maxRows", "5")
    spark.conf.set("stintwise.series.maxRanges", "12")
    yield
    spark.conf.unset("stintwise.series.maxRows")
    spark.conf.unset("stintwise.series.maxRanges")
