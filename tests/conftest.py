import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sparsequery.session import create_session

    s = create_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def small(spark):
    """Five rows and three columns; rows 3 and 4 are empty."""
    cells = spark.createDataFrame([(i, f"cell_{i}", "TBTBT"[i], float(3 + 4 * i)) for i in range(5)], "cell_integer_id bigint, cell_id string, cell_type string, total_counts double")
    genes = spark.createDataFrame([(i, f"gene_{i}") for i in range(3)], "gene_integer_id int, gene_id string")
    e = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0), (2, 2, 4.0)], "cell_integer_id bigint, gene_integer_id int, value double")
    return {"cells": cells, "genes": genes, "expression": e}


@pytest.fixture()
def ds(spark, small):
    from sparsequery.dataset import Dataset

    return Dataset(spark, dict(small), (5, 3))
