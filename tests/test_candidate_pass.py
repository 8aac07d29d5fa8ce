"""Sentence candidates, their labels and counted features in one pass over documents."""

import random

import pytest

from irengine.operators import sbd

SCHEMA = "doc_id long, text string, sentences array<string>"


def texts(seed, n):
    rng = random.Random(seed)
    for k in range(n):
        lines = ["".join(rng.choice('аБeF. !"…😀1') for _ in range(rng.randrange(15))) for _ in range(rng.randrange(6))]
        yield k, "\n".join(lines), [x for x in lines if x]


@pytest.mark.parametrize("ids", ["own", "shared"])
def test_labels_in_one_pass(spark, monkeypatch, ids):
    monkeypatch.setattr(sbd, "CHUNK_BYTES", 40)
    rows = [(k // 2 if ids == "shared" else k, t, s) for k, t, s in texts(3, 40)]
    docs = spark.createDataFrame(rows + [(100, None, ["a"]), (101, "x.", None)] + [(None, "y.", ["y."])] * (ids == "shared"), SCHEMA)
    got = sbd.labelled_candidates(docs)
    assert ("Join" in got._jdf.queryExecution().executedPlan().toString()) == (ids == "shared")
    want = sbd.label(sbd.candidates(docs), sbd.labels_first(docs)).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.where("label = 1").count()


def test_counted_rows_stand_for_all(spark):
    docs = spark.createDataFrame([(i, "One two. Three v. four. Five", ["One two.", "Three v. four.", "Five"]) for i in range(20)], SCHEMA)
    judged = sbd.labelled_candidates(docs)
    few = sbd.counted(judged)
    assert few.count() == 3 and {r.n for r in few.collect()} == {20}
    assert sbd.predict(few, sbd.fit(few, trees=2, depth=2)).where("predicted <> label").count() == 0


def test_places_of_many_classes(spark):
    df = spark.createDataFrame([([5, 7, 900_000],), ([],)], "x array<int>").coalesce(1)
    assert [r[0] for r in df.select(sbd.class_places(df.x, [5, 900_000])).collect()] == [[1, 0, 2], []]
