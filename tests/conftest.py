import pytest

from textquarry.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    yield session
    session.stop()
