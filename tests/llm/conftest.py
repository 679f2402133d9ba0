import pytest

from .awkward import frame


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
