"""The pipeline's near stage keeps one row of each group: with null ids, repeated ids and repeated rows."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline

STAGE = dict(corpus_pipeline.STAGES)


def test_one_row_of_each_group_stays(spark):
    words = [f"w{k}" for k in range(40)]
    a, near_a, c, d = " ".join(words), " ".join([*words, "end"]), " ".join(reversed(words)), " ".join(f"d{k}" for k in range(30))
    rows = [(1, a), (2, near_a), (3, c), (3, c), (4, a), (4, "only here " + c[:60]), (None, a), (None, d), (None, d), (None, d + " more"), (5, None), (5, None), (6, ""), (7, " \n "), (8, near_a), (9, c + " more"), (10, "e f g"), (10, "E  f g")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, label int").withColumn("fp", F.lit("mine"))
    out = STAGE["near"](spark, docs, "")
    got = Counter((r.doc_id, r.text) for r in out.collect())
    one_of = [k for k in got if k[0] is None], [k for k in got if k[0] == 10]
    assert out.columns == docs.columns and list(map(len, one_of)) == [1, 1] and set(got.values()) == {1}
    assert {k for k in got if k[0] not in (None, 10)} == {(1, a), (3, c), (4, "only here " + c[:60]), (5, None), (6, ""), (7, " \n ")}
    assert one_of[0][0][1] in (d, d + " more")
