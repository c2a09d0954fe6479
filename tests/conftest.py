import pytest

from chronolane.session import session


@pytest.fixture(scope="session")
def spark():
    spark = session("4", "4g", 4)
    yield spark
    spark.stop()
