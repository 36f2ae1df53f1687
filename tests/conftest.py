import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillroll.session import local_session  # noqa: E402
from tillroll.sources.tables import RevenueTables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, memory="4g")


@pytest.fixture
def tables(spark):
    made = RevenueTables(spark, f"t{uuid.uuid4().hex[:12]}")
    made.create()
    yield made
    spark.sql(f"DROP DATABASE IF EXISTS `{made.database}` CASCADE")
