"""The pipeline against its stages done by hand: brute force where rules decide, one model call per stage where models do."""

import zlib
from array import array

import numpy as np
import sentencepiece

import corpus_pipeline
from irengine.llm import op4_quality_rules, op5_quality_classifier, op8_minhash, queries

from .helpers import ODD, base_statistics, frame, near_components, overlap_pairs


def by_hand(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    verdict = {r.doc_id: r.kept for r in op4_quality_rules.quality_rules(docs, labels).collect()}
    rows = [(i, t) for i, t in rows if verdict[i]]
    for _, t in rows:
        s = base_statistics(t)
        assert s[0] >= 10 and 100 * s[4] <= 20 * s[0]
    model = op5_quality_classifier.fit(docs, labels)  # of the whole corpus, as in the pipeline
    scores = {r.doc_id: r.score for r in op5_quality_classifier.score(frame(spark, rows), model).collect()}
    rows = [(i, t) for i, t in rows if scores[i] >= 0.5]
    component = near_components(rows, 80)
    rows = [(i, t) for i, t in rows if component[i] == i]
    leaks = {d for d, _ in overlap_pairs(rows, items)}
    rows = [(i, t) for i, t in rows if i not in leaks]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    return sorted((i, len(library.encode(t)), len(t.encode()), True) for i, t in rows)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((r.doc_id, r.n_pieces, r.n_bytes, r.round_trip) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == by_hand(spark, docs, sf_dir)
    assert 0 < len(got) < docs.count()


def test_columns_stay(spark, sf_dir):
    docs = frame(spark, [(i, f"plain words number {i} with enough of them to pass all of the rules " + " ".join(f"w{i}x{k}" for k in range(40))) for i in range(30)] + [(None, "a b c d e f g h i j k l"), (99, None)], clashing=True)
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < 4:
            assert docs.columns == columns
    assert docs.count() > 0


def test_empty(spark, sf_dir):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near-dedup", "decontamination", "sentencepiece"]


def test_near_dedup_follows_its_threshold(spark, sf_dir, monkeypatch):
    """Pairs of similarity 0.80 to 0.85 go only if the stage's threshold is 80."""
    rows = []
    for b in range(20):
        w, k = [f"b{b}w{i}" for i in range(204)], 14 + b % 3
        rows += [(2 * b, " ".join(w)), (2 * b + 1, " ".join([*w[:60], *(f"b{b}n{i}" for i in range(k)), *w[60 + k :]]))]
    w = [f"c{i}" for i in range(204)]
    rows += [(100, " ".join(w)), (101, " ".join([*w[:60], *(f"cn{i}" for i in range(22)), *w[82:]]))]  # under 0.8
    for percent, left in ((85, 42), (80, 22)):
        monkeypatch.setattr(corpus_pipeline, "NEAR_PERCENT", percent)
        want = set(near_components(rows, percent).values())
        assert len(want) == left
        assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), sf_dir).collect()} == want


def test_encodings_are_the_output(spark, sf_dir):
    """The last stage returns the library's ids, of odd texts and over slices of a batch too."""
    rows = [r for r in ODD if r[0] != 6] + [(1000 + i, f"row number {i} of many, with ▁ and 日本") for i in range(1200)]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    out = corpus_pipeline.sentencepiece(spark, frame(spark, rows, clashing=True), sf_dir)
    assert out.dtypes[:2] == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = out.collect()
    texts = dict(r for r in rows if r[0] is not None)
    assert len(got) == len(rows)
    for r in got:
        assert r.n_pieces == len(r.ids) and r.round_trip and r.ids_crc32 == zlib.crc32(array("I", r.ids).tobytes())
        if r.doc_id is not None:
            assert r.ids == library.encode(texts[r.doc_id] or "")


def test_rows_are_judged_by_themselves(spark, sf_dir):
    """Rows that share an id, or have none, stand for themselves; of repeated rows one stays."""
    good = [" ".join(f"w{b}x{i}" for i in range(60)) for b in range(5)]
    bad = "few words"
    rows = [(1, good[0]), (1, bad), (1, good[1]), (2, good[2]), (2, good[2]), (None, good[3]), (None, bad), (None, good[0]), (3, good[2]), (4, None)]
    model = (np.zeros((op4_quality_rules.N_FEATS + 1, 2)), [[0.0, 0.0], [0.0, 0.0]])
    docs = op4_quality_rules.keep(frame(spark, rows, clashing=True), model)
    assert docs.columns == frame(spark, rows, clashing=True).columns
    assert sorted(((r.doc_id or 0), r.text) for r in docs.collect()) == sorted((i or 0, t) for i, t in rows if t not in (bad, None))
    left = op8_minhash.keep(docs, 80)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(1, good[0]), (1, good[1]), (2, good[2]), (0, good[3])])
    assert op8_minhash.keep(frame(spark, []), 80).count() == 0
