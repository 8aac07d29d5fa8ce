"""The n-gram models pass over their texts a few times only, however many trees they grow."""

from irengine.operators import classify


def test_trees_do_not_read_texts(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = [(k, "good fine words here" if k % 2 else "bad ugly noise there", float(k % 2)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label double").coalesce(1)
    read = []
    for trees in (1, 3):
        seen.value = 0
        models = classify.fit_voting(docs.mapInArrow(count, docs.schema), kinds=("char",), trees=trees, depth=1)
        read.append(seen.value // 40)
    print("passes", read)
    assert read[0] == read[1] <= 3
    assert classify.vote(docs, models).join(docs, "doc_id").where("predicted <> label").count() == 0
