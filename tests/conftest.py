import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session

    session = local_session(4, shuffle_partitions=4)
    session.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    yield session


@pytest.fixture(autouse=True)
def clear_cache(spark):
    yield
    spark.catalog.clearCache()


@pytest.fixture(scope="session")
def small():
    """The golden table: id, a, b, c, y."""
    return [(1, 1.0, 2.0, 5.0, 0), (2, 2.0, 4.0, 1.0, 0), (3, 3.0, 6.0, 4.0, 0), (4, 4.0, 8.0, 2.0, 1), (5, 5.0, 10.0, 6.0, 1), (6, 6.0, 13.0, 3.0, 1)]


@pytest.fixture(scope="session")
def golden(spark, small):
    return spark.createDataFrame(small, "id bigint, a double, b double, c double, y int")
