import pytest


@pytest.fixture
def frame(spark):
    """frame(rows, schema): a small table over three partitions."""
    from contentgauge.llm.common import prepare

    prepare(spark)
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
