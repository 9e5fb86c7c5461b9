import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from veriloom import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    built = session.build(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
    )
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()


@pytest.fixture(scope="session")
def column_values(spark):
    """Evaluate a column function over a list of values, in order."""
    from pyspark.sql import functions as F

    def evaluate(function, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r.o for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]

    return evaluate
