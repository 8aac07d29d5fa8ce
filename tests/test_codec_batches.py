"""Codecs over many lists at once, and the index written in one pass."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from irengine.functions import codecs as c
from irengine.operators import index


@pytest.mark.parametrize("codec", sorted(c.MANY))
@pytest.mark.parametrize("chunk", [1, 60, 1 << 17])
def test_lists_together_as_alone(monkeypatch, codec, chunk):
    monkeypatch.setattr(c, "CHUNK", chunk)
    rng = random.Random(2)
    lists = [[rng.choice((1, 2, rng.randrange(1, 90), rng.randrange(1, 1 << 27))) for _ in range(rng.choice((1, 3, 70)))] for _ in range(50)]
    first = np.append(0, np.cumsum([len(x) for x in lists]))
    pack, unpack = c.MANY[codec]
    data, at = c._by_chunk(pack, np.array(sum(lists, [])), first, np.uint8)
    assert [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] == [c.CODECS[codec][0](x) for x in lists]
    back, again = c._by_chunk(unpack, data, at, np.int64)
    assert back.tolist() == sum(lists, []) and again.tolist() == first.tolist()


@pytest.mark.parametrize("codec", sorted(c.MANY))
def test_columns_with_nulls(spark, codec):
    df = spark.createDataFrame([(0, [1, 5]), (1, None), (2, [3])], "k int, v array<long>").coalesce(1)
    coded = df.select("k", c.encode(F.col("v"), codec).alias("b"))
    got = coded.select("k", c.decode(F.col("b"), codec).alias("v"), c.decode(F.col("b"), codec, running=True).alias("s"))
    assert sorted((r.k, r.v, r.s) for r in got.collect()) == [(0, [1, 5], [1, 6]), (1, None, None), (2, [3], [3])]


def test_index_reads_its_lists_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    lists = spark.createDataFrame([(f"t{k}", 0, [1, 2]) for k in range(50)], "term string, block long, gaps array<long>")
    index.write_index(lists.mapInArrow(count, lists.schema), str(tmp_path / "ix"))
    assert seen.value == 50 and [p.name for p in tmp_path.iterdir()] == ["ix"]
    assert sorted(map(tuple, index.read_terms(spark, str(tmp_path / "ix"), ["t3"]).collect())) == [("t3", 0), ("t3", 2)]


def test_null_in_a_list_is_an_error():
    with pytest.raises(ValueError):
        c._flat(pa.array([[1, None]], pa.list_(pa.int64())))
