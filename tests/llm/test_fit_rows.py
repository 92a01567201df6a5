"""The classifier is fitted on one row of each chosen id."""

import numpy as np
from pyspark.sql import functions as F

from pixelwell.llm import quality_fm


def test_fit_takes_one_row_of_each_id(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i} " * (1 + i % 3)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    once = quality_fm.fit_quality(docs, labels, F.lit(True))
    often = quality_fm.fit_quality(docs.unionAll(docs.where("doc_id = 3").crossJoin(spark.range(40)).select("doc_id", "text")), labels, F.lit(True))
    assert once.w0 == often.w0 and np.array_equal(once.w, often.w) and np.array_equal(once.v, often.v)
