"""Texts of pages are made in bounded steps, and histograms read their rows once."""

from pyspark.sql import functions as F

from irengine.functions import html
from irengine.operators import classify
from irengine.sources.tables import BATCH_ROWS, read_table


def test_pages_in_steps(spark, monkeypatch):
    pages = [f"<html><head><title>t{k}</title></head><body>{'x ' * k}<a>a{k}</a></body></html>" for k in range(30)] + [None, ""]
    monkeypatch.setattr(html, "CHUNK_BYTES", 100)
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, h string").coalesce(1)
    got = {r.k: tuple(r.t) for r in df.select("k", html.page_texts(F.col("h")).alias("t")).collect()}
    assert got == {k: html.parse_page(p) for k, p in enumerate(pages)}


def test_rows_of_a_batch(spark, sf_dir):
    read_table(spark, sf_dir, "pages")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(BATCH_ROWS)


def test_histogram_reads_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame([(k % 3 == 0, k / 10) for k in range(60)], "is_class boolean, v double").mapInArrow(count, "is_class boolean, v double")
    got = classify.histogram(rows, F.col("v"), 1, 0, 6).collect()
    assert seen.value == 60
    assert sum(r.density for r in got if r.is_class) == 1 and sum(r.n for r in got) == 60
