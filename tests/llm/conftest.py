import contextlib

import pytest


@pytest.fixture
def no_broadcast(spark):
    """Makes all joins shuffle, as they do with tables too large to be told to every task."""

    @contextlib.contextmanager
    def shuffled(yes=True):
        key = "spark.sql.autoBroadcastJoinThreshold"
        was = spark.conf.get(key)
        if yes:
            spark.conf.set(key, "-1")
        try:
            yield
        finally:
            spark.conf.set(key, was)

    return shuffled
