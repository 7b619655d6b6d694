"""Shared by the tests of the language-data operators."""

import os

SF = "/root/testdata/sf0.001"
HAVE = os.path.isdir(SF)


def documents(spark, rows, extra=True):
    """Rows of (doc_id, text); extra columns whose names the operators use themselves."""
    schema = "doc_id bigint, text string" + (", score double, digest string, doc bigint, n bigint" if extra else "")
    return spark.createDataFrame([(*r, 0.5, "x", 7, 1) if extra else r for r in rows], schema)
