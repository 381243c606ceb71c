from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("statepath-tests")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="statepath-tests-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden(spark):
    """Three subjects, seven steps; subject C has a gap in TIME."""
    steps = spark.createDataFrame(
        [
            ("A", 0, 0, 0, 1),
            ("A", 1, 1, 1, 2),
            ("B", 0, 0, 0, 1),
            ("B", 1, 0, 1, 1),
            ("B", 2, 1, 0, 4),
            ("C", 0, 1, 1, 2),
            ("C", 2, 0, 0, 1),
        ],
        "ID string, TIME int, CLUSTER int, ACTION int, RISK int",
    )
    ends = spark.createDataFrame(
        [("A", "home", 0), ("B", "expired", 10), ("C", "home", 0)],
        "ID string, end_state string, Reward int",
    )
    return steps, ends


@pytest.fixture(scope="session")
def golden_model(golden):
    from statepath.operators import transitions
    from statepath.storage import materialize

    steps, ends = golden
    p = transitions.transition_probabilities(transitions.next_state(steps, ends))
    return materialize(p), materialize(transitions.reward_table(steps, ends))


def rows(df, *order):
    """Rows as tuples, sorted by the given columns (all if none), doubles to 6 places."""
    listed = [
        tuple(round(v, 6) if isinstance(v, float) else v for v in row)
        for row in (df.orderBy(*order) if order else df).collect()
    ]
    return listed if order else sorted(listed, key=lambda r: tuple((v is None, v) for v in r))
