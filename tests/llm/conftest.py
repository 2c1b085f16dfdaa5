import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from veilspark.llm._spark import ship

    ship(spark)
