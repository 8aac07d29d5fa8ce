from pyspark.sql import functions as F

from irengine.functions import text as tx
from irengine.functions import urls as u
from irengine.functions.html import PageParser, html_words, page_texts, parse_page, zlib_size


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_words(spark):
    assert one(spark, tx.words, "Ёлка_1 ½x foo-bar") == ["ёлка_1", "½x", "foo", "bar"]
    assert one(spark, tx.alnum_words, "a_b c1") == ["a", "b", "c1"]
    assert one(spark, tx.words, None) is None
    assert one(spark, tx.words, "") == []


def test_normalise(spark):
    assert one(spark, tx.join_numbers, "1 2 3 4") == "12 34"
    assert one(spark, tx.join_numbers, "40 000") == "40000"
    assert one(spark, tx.normalise, "A&nbsp;B, «C» 1 2") == "a b   c  12"


def test_split_variants(spark):
    assert one(spark, tx.split_dump, "A b.c-d?") == ["a", "b", "c", "d", ""]
    assert one(spark, tx.space_tokens, "a  b\t c\n") == ["a", "b", "c"]
    assert one(spark, tx.short_tokens, "short " + "x" * 11) == ["short"]
    assert one(spark, tx.squeezed_text, "a\r\nb  Ёж! (1|2)") == "a b ж 1 2 "


def test_sentences(spark):
    text = "One. Two? Three! Mr. Smith e.g. this.\nFour"
    assert one(spark, tx.sentences, text) == ["One.", "Two?", "Three! Mr. Smith e.g. this.", "Four"]
    assert one(spark, lambda c: tx.sentence_words(c, ["the"]), "The the cat cat") == ["The", "cat", "cat"]


def test_lemmas(spark):
    got = spark.createDataFrame([(["aa", "b", "aa"],), (None,)], "t array<string>").select(tx.lemmas(F.col("t"), str.upper)).collect()
    assert [r[0] for r in got] == [["AA", "B", "AA"], None]


def test_url_parts(spark):
    url = "http://lenta.example/news/2013/10/16/meteorite/"
    assert one(spark, u.count_segments, url) == 5
    assert one(spark, u.segments, url) == ["news", "2013", "10", "16", "meteorite"]
    assert one(spark, u.segments, "http://x.example") == []
    assert one(spark, u.segments, "http://x.example/a/?b=/c#d") == ["a"]
    assert one(spark, u.count_segments, "") == 0
    assert one(spark, u.params, "http://x.example/a?p=1&q") == ["p=1", "q="]
    assert one(spark, u.params, "http://x.example/a?p=b=c#f?z=1") == ["p=b"]
    assert one(spark, u.param_names, "http://x.example/?") == [""]
    assert one(spark, u.extension, "_printed.htm") == "htm"
    assert one(spark, u.extension, "none") == ""
    assert one(spark, u.unescape, "a%20b+c") == "a b+c"
    assert one(spark, u.unescape, "bad%zz") == "bad%zz"


def test_url_features(spark):
    got = one(spark, u.features, "http://x.example/a1b/7/b:c%20d.htm?k=v")
    assert set(got) >= {"segments:3", "param_name:k", "param:k=v", "segment_name_0:a1b", "segment_substr[0-9]_0:1", "segment_[0-9]_1:1", "segment_ext_2:htm", "segment_len_1:1", "subsegmenst_2:2", "subsegment_name_2:c d.htm", "segment_lang_2:rus", "commas:0", "underscore:0", "correct:False", "subsegmenst_0:0"}
    plain = one(spark, lambda c: u.features(c, False), "http://x.example/7")
    assert not any(f.startswith(("commas", "subsegmenst", "correct")) for f in plain)


def test_feature_tables(spark):
    pages = spark.createDataFrame([("http://x.example/a",)] * 3 + [("http://x.example/B",), (None,)], "url string")
    counts = {r.feature: r.cnt for r in u.feature_counts(pages).collect()}
    assert counts["segment_name_0:a"] == 3 and counts["segment_name_0:b"] == 1
    mined = u.mine_features(pages, pages, n=3, least=4).collect()
    assert [r.cnt for r in mined] == sorted((r.cnt for r in mined), reverse=True)
    golden = spark.createDataFrame([("segment_name_0:a",), ("missing",)], "feature string")
    assert u.golden_recall(u.feature_counts(pages), golden).first().recall == 0.5


PAGE = '<html><head><title>Big &amp; Title</title><style>p{}</style></head><body><p>One<br>two  three<br/><a href="/x">link text</a><script>var x;</script>&eacute;end</p></body></html>'


def test_html():
    text, content, visible, title, anchor, all_data = parse_page(PAGE)
    assert "One \ntwo three \n\nlink text" in text and "p{}" in text and "&" not in text
    assert "var x" not in content and "Big & Title" in content
    assert "Title" not in visible and "éend" in visible
    assert title.split() == ["Big", "Title"] and anchor.split() == ["link", "text"]
    assert "var x;" in all_data


def test_html_odd_input():
    assert parse_page(None) == ("",) * 6
    assert parse_page("<a><b>unclosed")[0] == "unclosed"
    assert parse_page("</p></p>x")[1] == "x"
    p = PageParser()
    p.feed("<html><title>not in head</title>")
    assert p.found["title"] == []


def test_html_columns(spark):
    df = spark.createDataFrame([(PAGE,), (None,)], "h string")
    assert df.select(page_texts(F.col("h"))["anchor"]).collect()[0][0].strip() == "link text"
    assert df.select(html_words(F.col("h"))).collect()[0][0][:2] == ["big", "title"]
    assert df.select(zlib_size(F.col("h"))).collect()[1][0] is None
