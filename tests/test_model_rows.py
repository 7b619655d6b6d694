"""Model queries read their rows from one table, written once, and only the columns they need."""
import os

import pytest

from checks import CHECKS, models

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_rows_of_a_model_are_built_once(spark, monkeypatch):
    built = []
    build = models.matrix
    monkeypatch.setattr(models, "matrix", lambda *a: built.append(build(*a)) or built[-1])
    out = CHECKS["forest_held_out"](spark, SF)
    files = out.inputFiles()
    assert len(built) == 1 and files and all("/matrix-" in f for f in files)
    assert set(spark.read.parquet(os.path.dirname(files[0])).columns) == {"iy", "ix", "ts", "cell_id", "y_residuo", *models.FEATURES}
