import random

import pytest
from pyspark.sql import functions as F

from irengine.functions import codecs as c
from irengine.operators import index

HEX = lambda b: b.hex(" ").upper()


@pytest.mark.parametrize(("value", "code"), [(1, "81"), (127, "FF"), (128, "81 00"), (300, "82 2C"), (16383, "FF 7F"), (16384, "81 00 00"), (2**28 - 1, "FF 7F 7F 7F")])
def test_varbyte(value, code):
    assert HEX(c.varbyte_encode([value])) == code
    assert c.varbyte_decode(bytes.fromhex(code)) == [value]


def test_leb128():
    assert HEX(c.leb128_encode([300])) == "AC 02"
    assert c.leb128_decode(bytes.fromhex("AC0205")) == [300, 5]


@pytest.mark.parametrize(
    ("values", "code"),
    [([1, 2, 3], "92 03 00 00"), ([1] * 28, "F1 FF FF FF"), ([1] * 29, "F1 FF FF FF 11 00 00 00"), ([100, 1], "47 0E 00 00"), ([300, 5], "C9 B2 00 00"), ([600, 5], "8E 25 14 00"), ([2**28 - 1], "FF FF FF FF")],
)
def test_simple9(values, code):
    assert HEX(c.simple9_encode(values)) == code
    assert c.simple9_decode(c.simple9_encode(values)) == values


@pytest.mark.parametrize("bad", [[], [0], [2**28]])
def test_simple9_rejects(bad):
    with pytest.raises(ValueError):
        c.simple9_encode(bad)


@pytest.mark.parametrize(("value", "bits"), [(1, "11"), (2, "011"), (3, "0011"), (4, "1011"), (11, "001011"), (40, "100100011"), (44, "010010011"), (67, "1010100011"), (75, "0101010011")])
def test_fibonacci_code(value, bits):
    data = c.fibonacci_encode([value])
    assert "".join(f"{x:08b}" for x in data)[: len(bits)] == bits
    assert c.fibonacci_decode(data) == [value]


def test_fibonacci_list():
    assert HEX(c.fibonacci_encode(c.gaps([4, 48, 115, 190]))) == "B4 9D 46 A9 80"


@pytest.mark.parametrize("codec", sorted(c.CODECS))
def test_random_round_trip(codec):
    rng = random.Random(1)
    pack, unpack = c.CODECS[codec]
    for n in (1, 7, 1500):
        gaps = [rng.choice((1, rng.randrange(1, 100), rng.randrange(1, 1 << 20))) for _ in range(n)]
        assert unpack(pack(gaps)) == gaps
        assert c.gaps(c.ungap(gaps)) == gaps


@pytest.mark.parametrize("codec", sorted(c.CODECS))
def test_postings_round_trip(spark, codec):
    rows = [("a", d) for d in (0, 1, 5, 70_000, 140_000)] + [("b", 65_535), ("b", 65_536)]
    posts = spark.createDataFrame(rows, "term string, doc_id long")
    lists = index.posting_lists(posts)
    back = index.decode_postings(index.encode_postings(lists, codec), codec)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert lists.groupBy("term").count().where("term = 'a'").first()["count"] == 3  # a common term is cut into blocks


def test_index_files(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, None)], "doc_id long, text string")
    index.write_index(index.posting_lists(index.postings(docs)), str(tmp_path / "ix"))
    assert sorted(map(tuple, index.read_terms(spark, str(tmp_path / "ix"), ["b", "zz"]).collect())) == [("b", 0), ("b", 1)]
    assert index.doc_info(docs).first() == (2, 3)
    gaps = {(r.term, r.doc_id): r.gap for r in index.with_gaps(index.postings(docs)).collect()}
    assert gaps == {("a", 0): 1, ("b", 0): 1, ("b", 1): 1, ("c", 1): 2}


def test_gaps_across_blocks(spark):
    rows = [("t", d) for d in (3, 70_000, 70_001, 200_000)]
    got = index.with_gaps(spark.createDataFrame(rows, "term string, doc_id long")).orderBy("doc_id").collect()
    assert [r.gap for r in got] == [4, 69_997, 1, 129_999]


def test_varbyte_size(spark):
    sizes = spark.createDataFrame([(x,) for x in (1, 127, 128, 16384, 2**28 - 1, 2**28)], "g long").select(c.varbyte_size(F.col("g")))
    assert [r[0] for r in sizes.collect()] == [len(c.varbyte_encode([x])) for x in (1, 127, 128, 16384, 2**28 - 1, 2**28)]
