import base64
import gzip

import pytest

from irengine.sources import documents as d
from irengine.sources.tables import read_table, shared_root, spread
from irengine.streaming import jobs


def test_message_round_trip():
    raw = d.build_message("u", None, "text " * 50)
    assert d.parse_message(memoryview(raw)) == {"url": "u", "body": None, "text": "text " * 50}
    extra = raw + bytes([4 << 3 | 0, 200, 1]) + bytes([5 << 3 | 5, 0, 0, 0, 0])  # fields that no one asked for
    assert d.parse_message(memoryview(extra))["url"] == "u"
    with pytest.raises(ValueError):
        d.parse_message(memoryview(b""))
    with pytest.raises(ValueError):
        list(d.frames(b"\x09\x00\x00\x00abc"))
    assert list(d.frames(b"")) == []


def test_framed_files(spark, tmp_path):
    one = [d.build_message(f"a{i}", "body", None) for i in range(3)]
    two = [d.build_message(f"b{i}", None, "текст") for i in range(2)]
    (tmp_path / "1.bin").write_bytes(d.frame(one))
    (tmp_path / "2.gz").write_bytes(d.frame(two, compress=True))
    (tmp_path / "3.bin").write_bytes(b"")
    docs = d.with_doc_ids(d.read_framed(spark, str(tmp_path)))
    assert [(r.doc_id, r.url, r.text) for r in docs.orderBy("doc_id").collect()] == [(1, "a0", None), (2, "a1", None), (3, "a2", None), (4, "b0", "текст"), (5, "b1", "текст")]
    assert [tuple(r) for r in d.lengths(docs.where("doc_id in (1, 5)")).orderBy("url").collect()] == [("a0", 4, 0), ("b1", 0, 5)]


def test_text_formats(spark, tmp_path):
    page = base64.b64encode("<p>é</p>".encode()).decode()
    with gzip.open(tmp_path / "p.csv.gz", "wt") as f:
        f.write(f"id\tmark\turl\thtml\n-5\t1\thttp://x\t{page}\n")
    assert tuple(d.read_labelled_pages(spark, str(tmp_path / "p.csv.gz")).first()) == (-5, 1, "http://x", "<p>é</p>")
    (tmp_path / "t.jsonl").write_text('{"Paragraph": "A. B", "Sentences": ["A.", "B"]}\n')
    assert d.read_jsonl(spark, str(tmp_path / "t.jsonl"), d.PARAGRAPH_TRAIN).first().Sentences == ["A.", "B"]
    (tmp_path / "u.txt").write_text("http://a\n\n http://b \n")
    assert [r.url for r in d.read_urls(spark, str(tmp_path / "u.txt")).collect()] == ["http://a", "http://b"]
    assert d.read_urls(spark, str(tmp_path / "u.txt"), seed=1).count() == 2
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/C1").write_text("line one\nline two\n")
    assert d.read_texts(spark, str(tmp_path / "texts")).first().text.startswith("line one\nline two")


def test_sinks(spark, tmp_path):
    counts = spark.createDataFrame([("a", 100), ("b", 300), ("c", 99)], "feature string, cnt long")
    d.write_features(counts, str(tmp_path / "fea"))
    assert sorted(map(tuple, d.read_features(spark, str(tmp_path / "fea")).collect())) == [("a", 100), ("b", 300)]
    scores = spark.createDataFrame([(1, 0.5), (2, None)], "doc_id long, score double")
    d.write_submission(scores, str(tmp_path / "sub"), 0.1)
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "sub"), header=True, inferSchema=True).collect())) == [(1, 1), (2, 0)]
    pairs = spark.createDataFrame([(1, 2, 18)], "id1 long, id2 long, n_same long")
    urls = spark.createDataFrame([(1, "u1"), (2, "u2")], "doc_id long, url string")
    assert tuple(d.duplicate_lines(pairs, urls).first()) == ("u1", "u2", 0.9)


def test_index_stream(spark, tmp_path):
    folder = tmp_path / "in"
    for k, rows in enumerate(([(1, "a b")], [(2, "b c"), (3, None)])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(folder))
        docs = spark.readStream.schema("doc_id long, text string").parquet(str(folder))
        jobs.index_stream(docs, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
        assert jobs.read_stream_index(spark, str(tmp_path / "ix")).count() == (2, 4)[k]


def test_admission_stream(spark, tmp_path):
    folder = str(tmp_path / "arrivals")
    schema = "seq long, cluster string, accepted boolean"
    quota = {"a": 2.0}
    for rows in ([(1, "a", False), (2, "a", True), (3, "a", False)], [(4, "a", False), (5, "b", False), (6, "a", True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        out = jobs.admit_stream(spark.readStream.schema(schema).parquet(folder), quota, schema)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r.seq: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True}


def test_term_counts(spark):
    assert {(r.term, r.n) for r in jobs.term_counts(spark.createDataFrame([("a a",), ("a b",)], "text string")).collect()} == {("a", 3), ("b", 1)}


def test_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "many.parquet"))
    assert read_table(spark, str(tmp_path), "one").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    plan = read_table(spark, str(tmp_path), "many", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and read_table(spark, str(tmp_path), "one").count() == 100


def test_tables_beyond_the_bound_are_never_shuffled(spark, tmp_path):
    """Fewer files than cores, but more bytes than the bound: the scan stays a scan."""
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    df = spark.read.parquet(str(tmp_path / "one.parquet"))
    assert "Repartition" in spread(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in spread(df, most=100)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("members", [1, 3])
def test_frames_are_a_stream(members):
    """Plain and zipped files, also of several zipped members, give the messages one after another; a cut one is an error."""
    messages = [d.build_message(f"u{i}", "b" * i, "t") for i in range(900)]
    assert [bytes(m) for m in d.frames(d.frame(messages))] == messages
    parts = [d.frame(messages[k::members]) for k in range(members)]
    packed = b"".join(map(gzip.compress, parts))
    assert [bytes(m) for m in d.frames(packed)] == [m for k in range(members) for m in messages[k::members]]
    for bad in (d.frame(messages)[:-1], packed[:-40], b"\x01\x00", b"\xff\xff\xff\xff"):
        with pytest.raises(ValueError):
            list(d.frames(bad))
    assert list(d.frames(b"")) == []


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        shared_root(Session)
    Session.sparkContext.master = "local[2]"
    assert shared_root(Session) == shared_root(Session) and shared_root(Session).startswith("file://")
    Session.conf.get = staticmethod(lambda key, default=None: "hdfs://x/y/")
    assert shared_root(Session) == "hdfs://x/y"
