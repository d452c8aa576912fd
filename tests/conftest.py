import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from lexiloom import runtime

    made = runtime.session("tests", "4", 4)
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture
def rows(spark):
    """Rows of a DataFrame made of tuples and a schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)
