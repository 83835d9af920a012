import pytest

from scholia.session import Scratch


@pytest.fixture
def scratch(spark):
    made = Scratch(spark, "test")
    yield made
    made.drop()
