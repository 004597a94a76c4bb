import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def grid_cells(spark, array, layer="a", gaps=True):
    """Cell table of a numpy array; NaN gives no row."""
    import numpy as np

    rows = [
        (layer, int(r), int(c), float(array[r, c]))
        for r, c in np.ndindex(array.shape)
        if not (gaps and np.isnan(array[r, c]))
    ]
    return spark.createDataFrame(rows, "layer string, row long, col long, value double")


def as_array(cells, shape, column="value"):
    import numpy as np

    out = np.full(shape, np.nan)
    for row in cells.collect():
        v = row[column]
        out[row["row"], row["col"]] = np.nan if v is None else v
    return out
