import random

import numpy as np

from unionlog.llm import quality_classifier as C


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = C.op1_quality_classifier(spark, sf).toPandas()
    marks = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id")
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    test = marks[marks.held_out]
    assert (test.predicted == test.quality).mean() > max(0.9, (test.quality == 1).mean())
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_context_vectors_by_hand():
    _, lexical, shapes = C._worker()
    text = b"one TWO three! one"
    words, a, b = C.document_units(text)
    sums = C.context_sums([text])
    index = [lexical[x] + shapes[y] for x, y in zip(a, b)]
    assert np.allclose(sums[a[1]], index[0] + index[2] + index[3])
    assert np.allclose(sums[a[0]], index[1] + index[2] + index[1] + index[2])
    assert C.units(b"ab!!") != C.units(b"ab") and C.units(b"AB") % C.SHAPES != C.units(b"ab") % C.SHAPES


def test_nulls_and_missing_labels(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(("good", "fine", "text") if i % 2 else ("BAD!!", "JUNK$$")) for _ in range(20)), "s") for i in range(300)]
    rows += [(None, None, None), (1000, None, "s"), (1000, None, "s"), (1001, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = C.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 300)
    assert len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1
    assert {r.score for r in C.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert C.classify(docs.limit(0), labels).count() == 0
