import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from spanforge.session import ROWS_PER_TASK_KEY, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("4", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture
def small_tasks(spark):
    """Treat groups of more than five rows as too large for a task."""
    spark.conf.set(ROWS_PER_TASK_KEY, "5")
    yield spark
    spark.conf.unset(ROWS_PER_TASK_KEY)
