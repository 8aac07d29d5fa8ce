import random

import pytest

from irengine.operators import index
from irengine.plans import boolean as b


@pytest.mark.parametrize(
    ("query", "shown"),
    [("foxy & lady | madam", "(foxy & lady) | madam"), ("foxy & (lady | madam)", "foxy & (lady | madam)"), ("one & two & three & four", "((one & two) & three) & four"), ("foxy & !(lady | madam)", "foxy & !(lady | madam)"), ("(a|b)&(c|d)", "(a | b) & (c | d)"), ("A | b & !c", "a | (b & !c)"), ("!!a", "!!a")],
)
def test_parse_and_show(query, shown):
    assert b.show(b.parse(query)) == shown
    assert b.show(b.parse(shown)) == shown


@pytest.mark.parametrize("bad", ["", "a b", "a &", "(a", "a)", "!", "a | | b", "()"])
def test_errors(bad):
    with pytest.raises(b.QueryParseError):
        b.parse(bad)


def _random_query(rng, depth=3):
    kind = rng.random()
    if depth == 0 or kind < 0.25:
        return rng.choice("abcdz")
    if kind < 0.45:
        return "!" + _random_query(rng, depth - 1) if rng.random() < 0.5 else f"!({_random_query(rng, depth - 1)})"
    return f"({_random_query(rng, depth - 1)} {rng.choice('&|')} {_random_query(rng, depth - 1)})"


def test_three_ways_agree(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.sample("abcd", rng.randrange(5))) for _ in range(12)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    posts = index.postings(docs).cache()
    has = {w: {i for i, t in enumerate(texts) if t and w in t.split()} for w in "abcdz"}
    everything = set(range(len(texts)))

    def truth(node):
        if isinstance(node, b.Term):
            return has[node.word]
        if isinstance(node, b.Not):
            return everything - truth(node.arg)
        return truth(node.left) & truth(node.right) if node.op == "&" else truth(node.left) | truth(node.right)

    queries = ["a & (b | c)", "!!a", "z", "!z", *(_random_query(rng) for _ in range(4))]
    for q in queries:
        want = truth(b.parse(q))
        assert {r.doc_id for r in b.search(posts, docs, q).collect()} == want, q
        assert {r.doc_id for r in b.search_sets(posts, docs, q).collect()} == want, q
    many = b.search_many(posts, docs, queries).collect()
    for q in queries:
        assert {r.doc_id for r in many if r.query == q} == truth(b.parse(q))


def test_lost_or_case(spark):
    """An OR below an AND must not lose documents that only its second branch still has."""
    posts = spark.createDataFrame([("a", 12), ("b", 3), ("b", 12), ("c", 7)], "term string, doc_id long")
    universe = spark.range(1, 13).withColumnRenamed("id", "doc_id")
    found = lambda q: sorted(r.doc_id for r in b.search(posts, universe, q).collect())
    assert found("a & (b|c)") == [12]
    assert found("!b") == [1, 2, *range(4, 12)]
    assert found("nothing") == []
    assert found("!nothing") == list(range(1, 13))


def test_urls(spark):
    urls = spark.createDataFrame([(1, "u1"), (2, "u2")], "doc_id long, url string")
    assert [tuple(r) for r in b.with_urls(spark.createDataFrame([(2,), (1,)], "doc_id long"), urls).collect()] == [(1, "u1"), (2, "u2")]
