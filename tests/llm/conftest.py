import pytest

from strandloom.llm import common


@pytest.fixture(scope="session", autouse=True)
def scratch_is_deleted(spark):
    yield
    common.release(spark)
