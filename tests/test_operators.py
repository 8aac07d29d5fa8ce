import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from irengine.operators import classify, dedup, rank, sbd, scan, segments


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---------------------------------------------------------------- running totals
@pytest.mark.parametrize("keys", [(), ("k",)])
def test_running_total(spark, keys):
    rng = random.Random(5)
    data = [(rng.choice("aab"), rng.randrange(60), rng.randrange(4)) for _ in range(300)]
    df = spark.createDataFrame(data, "k string, o int, v int")
    got = Counter(map(tuple, scan.running_total(df, "o", {"s": F.col("v")}, keys, pieces=7).collect()))
    want = Counter((k, o, v, sum(z for x, y, z in data if y < o and (not keys or x == k))) for k, o, v in data)
    assert got == want


def test_running_total_empty(spark):
    assert scan.running_total(spark.createDataFrame([], "k string, o int, v int"), "o", {"s": F.col("v")}).collect() == []


# ---------------------------------------------------------------- near duplicates
def test_murmur():
    assert dedup.murmur3_32(b"foo") == -156908512
    assert dedup.murmur3_32(b"") == 0
    items = [bytes(range(n)) for n in range(40)] + [b"\xff" * 9, b"foo"]
    assert dedup.murmur3_many(items).tolist() == [dedup.murmur3_32(x) for x in items] and dedup.murmur3_many([]).tolist() == []


def test_shingles_need_six_words(spark):
    df = spark.createDataFrame([(0, "a b c d e"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", dedup.shingles(F.col("text")).alias("s")).collect()}
    assert got[0] == [] and got[1] == ["a b c d e"]
    assert [r.doc_id for r in dedup.signatures(df).collect()] == [1]


@pytest.mark.parametrize("hash_fn", ["md5", "mmh3"])
def test_pairs_against_brute_force(spark, hash_fn):
    import hashlib

    rng = random.Random(7)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 + str(rng.randrange(9)) for _ in range(120)] for _ in range(4)]
    texts = []
    for w in base:
        for k in (0, 0, 1, 3, 40):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = "zz"
            texts.append(" ".join(v))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def h(s):
        return int(hashlib.md5(s.encode()).hexdigest()[:8], 16) if hash_fn == "md5" else dedup.murmur3_32(s.encode())

    sigs = []
    for t in texts:
        w = t.split()
        hs = [h(" ".join(w[i : i + 5])) for i in range(len(w) - 5)]
        sigs.append([min(hs, key=lambda x, p=p: x % p) for p in dedup.MODULI])
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sum(a == b for a, b in zip(sigs[i], sigs[j], strict=True)) >= 16}
    member = {r.doc_id: r.class_id for r in dedup.membership(docs, hash_fn).collect()}
    pairs = {(r.id1, r.id2) for r in dedup.near_duplicate_pairs(docs, hash_fn).collect()}
    got = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if member[i] == member[j] or tuple(sorted((member[i], member[j]))) in pairs}
    assert got == want and want


def test_pair_jaccard(spark):
    a = spark.createDataFrame([(1, 2), (3, 4)], "id1 long, id2 long")
    b = spark.createDataFrame([(2, 1), (5, 6)], "id1 long, id2 long")
    assert tuple(dedup.pair_jaccard(a, b).first()) == (1, 3, 1 / 3)


# ---------------------------------------------------------------- ranking
def _dense(sentences, threshold, rounds):
    n = len(sentences)
    live = [s for s in sentences if s]
    df = Counter(t for s in live for t in set(s))
    w = [{t: c / len(s) * math.log(len(live) / df[t]) for t, c in Counter(s).items()} for s in sentences]
    sim = np.zeros((n, n))
    for i, j in itertools.product(range(n), repeat=2):
        a, b = (math.sqrt(sum(x * x for x in w[k].values())) for k in (i, j))
        sim[i, j] = sum(x * w[j].get(t, 0) for t, x in w[i].items()) / (a * b) if a and b else 0
    m = (sim > threshold).astype(float)
    np.fill_diagonal(m, 1)
    p = np.full(n, 1 / n)
    for _ in range(rounds):
        p = p @ (m / m.sum(1, keepdims=True))
    return sim, m, p


def test_lexrank_against_dense(spark):
    rng = random.Random(2)
    text = "\n".join(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 6))) + "." for _ in range(40)) + "\n\n???\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "only one.")], "doc_id long, text string")
    sents = [[w.lower() for w in s.replace(".", " ").replace("?", " ").split()] for s in text.split("\n") if s.strip()]
    sim, m, p = _dense(sents, 0.3, 3)
    got = {r.sent: r.score for r in rank.lexrank(docs, rounds=3, eps=0.0).where("doc_id = 1").collect()}
    order = sorted(got)
    assert len(order) == len(sents)
    assert np.allclose([got[k] for k in order], p)
    degree = rank.sentence_similarity(docs).where("doc_id = 1").orderBy("sent").collect()
    assert [r.n_similar for r in degree] == [int(x) - 1 for x in m.sum(1)]
    np.fill_diagonal(sim, 0)
    assert np.allclose([r.max_sim for r in degree], sim.max(1))
    assert rank.lexrank(docs).where("doc_id = 4").first().score == 1.0
    assert rank.summaries(docs, 3).where("doc_id = 1").count() == 3


def test_lexrank_repeated_lines(spark):
    text = "\n".join(["same words here."] * 5_000 + ["other thing now."])
    got = rank.sentence_similarity(spark.createDataFrame([(1, text)], "doc_id long, text string")).groupBy("n_similar").count().collect()
    assert {(r.n_similar, r["count"]) for r in got} == {(4_999, 5_000), (0, 1)}


def test_tf_idf(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, None)], "doc_id long, text string")
    assert rows(rank.tf(docs)) == [(1, "a", 2 / 3), (1, "b", 1 / 3), (2, "a", 0.5), (2, "c", 0.5)]
    assert dict(rows(rank.idf(docs)))["a"] == pytest.approx(math.log(3 / 2))
    top = rank.tfidf_top(docs, 1).collect()
    assert {(r.doc_id, r.term) for r in top} == {(1, "b"), (2, "c")}


# ---------------------------------------------------------------- classification
def test_naive_bayes(spark):
    docs = spark.createDataFrame([(1, "x x y", True), (2, "y z", False), (3, "x", None), (4, None, True)], "doc_id long, text string, is_class boolean")
    model = classify.nb_model(docs)
    assert rows(model) == [("x", 2, 0), ("y", 1, 1), ("z", 0, 1)]
    got = dict(rows(classify.nb_scores(docs.select("doc_id", "text"), model)))
    assert got[1] == pytest.approx((2 * math.log(2) + math.log(0.5)) / 3)
    assert got[2] == pytest.approx(math.log(0.5)) and got[4] is None
    assert dict(rows(classify.keyword_rule(docs, "z"))) == {1: False, 2: True, 3: False, 4: False}
    first, second = rows(classify.random_rule(docs)), rows(classify.random_rule(docs))
    assert first == second and all(0 <= s < 1 for _, s in first)


def test_sweep_and_auc(spark):
    rng = random.Random(4)
    data = [(i, rng.choice([0.1, 0.2, 0.5, 0.9]), rng.random() < 0.4) for i in range(60)] + [(99, None, True)]
    df = spark.createDataFrame(data, "doc_id long, score double, is_class boolean")
    known = [(s, y) for _, s, y in data if s is not None]
    for r in classify.threshold_sweep(df, [0.0, 0.2, 0.95]).collect():
        tp = sum(s > r.threshold and y for s, y in known)
        fp = sum(s > r.threshold and not y for s, y in known)
        fn = sum(s <= r.threshold and y for s, y in known)
        assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, fn, len(known) - tp - fp - fn)
        assert r.prec == (tp / (tp + fp) if tp else 0.0) and r.recall == (tp / (tp + fn) if tp else 0.0)
    won = [(a > b) + (a == b) / 2 for a, x in known if x for b, y in known if not y]
    assert classify.auc(df).first().auc == pytest.approx(sum(won) / len(won))
    assert classify.auc(df.where("false")).first().auc is None
    assert len(classify.steps(-1, 1, 0.1)) in (20, 21)


def test_histogram(spark):
    df = spark.createDataFrame([(True, 0.0), (True, 9.9), (True, 10.0), (True, 31.0), (False, 30.0), (None, 1.0)], "is_class boolean, v double")
    got = {(r.is_class, r.bin): (r.n, r.density) for r in classify.histogram(df, F.col("v"), 10, 0, 30).collect()}
    assert got == {(True, 0): (2, 2 / 30), (True, 1): (1, 1 / 30), (False, 2): (1, 1 / 10)}


def test_page_features(spark):
    page = "<html><head><title>A b</title></head><body><a>link one</a> ab abc</body></html>"
    r = classify.page_features(spark.createDataFrame([(1, page), (2, None)], "id long, html string"), "html", "id").orderBy("id").collect()
    assert (r[0].words_num, r[0].title_words_num, r[0].anchor_words_num) == (6, 2, 2)
    assert r[0].avg_word_len == pytest.approx(14 / 6) and 0 < r[0].compression_level < 1.2
    assert r[1].words_num == 0 and r[1].avg_word_len is None


def test_char_grams(spark):
    got = spark.createDataFrame([("aB  c",), ("",)], "t string").select(classify.char_grams(F.col("t"))).collect()
    assert got[0][0] == ["a", "b", " ", "c", "ab", "b ", " c", "ab ", "b c"] and got[1][0] == []


def test_voting(spark):
    docs = spark.createDataFrame([(i, ("good fine word" if i % 2 else "bad awful word") + f" n{i % 5}", float(i % 2)) for i in range(40)], "doc_id long, text string, label double")
    models = classify.fit_voting(docs, trees=2, vocabulary=64)
    got = {r.doc_id: r.predicted for r in classify.vote(docs, models).collect()}
    assert all(got[i] == i % 2 for i in range(40))


# ---------------------------------------------------------------- segments
def test_quota(spark):
    stats = spark.createDataFrame([("a", 100, 50), ("b", 10, 0), ("c", 40, 40)], "cluster string, size long, n_pos long")
    got = {r.cluster: r.quota for r in segments.quotas(stats, 1000).collect()}
    p25 = np.percentile([100, 10, 40], 25)
    q = np.array([50 / (100 + p25), 0, 40 / (40 + p25)])
    q = np.maximum(q * 1000 / q.sum(), 100)
    assert np.allclose([got[k] for k in "abc"], q * 1000 / q.sum())


def test_admission_against_loop(spark):
    rng = random.Random(8)
    arrivals = [(i, rng.choice(["a", "a", "b", "c", None]), rng.random() < 0.2) for i in range(400)]
    quota = {"a": 20.5, "b": 7.0}
    df = spark.createDataFrame(arrivals, "seq long, cluster string, accepted boolean")
    q = spark.createDataFrame(list(quota.items()), "cluster string, quota double")
    got = {r.seq: r.admitted for r in segments.admit(df, q, "seq").collect()}
    used, want, fetched, seen = Counter(), {}, 0, set()
    for i, c, ok in arrivals:
        want[i] = ok or (c is not None and quota.get(c, 0) > used[c])
        if want[i] and not ok:
            used[c] += 1
        if fetched < 50:
            seen.add(i)
            fetched += want[i]
    assert got == want
    stopped = segments.stop_after(segments.admit(df, q, "seq"), "seq", 50)
    assert {r.seq for r in stopped.collect()} == seen


def test_band_widens_once(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 50), ("c", 95), ("d", 7), ("e", 1)], "feature string, cnt long")
    assert {r.feature for r in segments.band(counts, F.lit(100)).collect()} == {"a", "b", "d"}
    assert {r.feature for r in segments.band(counts, F.lit(100), least=1).collect()} == {"b"}


def test_define_segments(spark):
    pos = spark.createDataFrame([(f"http://x.example/news/{i}",) for i in range(60)], "url string")
    neg = spark.createDataFrame([(f"http://x.example/img/a{i}b.jpg",) for i in range(60)], "url string")
    model = segments.define_segments(pos, neg, 20, clusters=2)
    arrivals = pos.unionAll(neg).withColumn("seq", F.xxhash64("url"))
    done = segments.simulate(model, arrivals, "seq", 1_000)
    assert done.where("admitted and url like '%news%'").count() == 60
    r = segments.evaluation(done.withColumn("positive", F.contains("url", F.lit("news"))), 100, 60).first()
    assert r.recall == 1.0


# ---------------------------------------------------------------- sentence boundaries
def test_candidates(spark):
    text = 'Аб. В г. Омск? "Да" т.д. конец!'
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "no marks")], "doc_id long, text string")
    got = sbd.candidates(docs).orderBy("pos").collect()
    assert [r.pos for r in got] == [i for i, c in enumerate(text) if c in sbd.MARKS]
    assert all(r.mark == text[r.pos] for r in got)
    for r in got:
        assert [c for c in r.w if c is not None] == list(text[max(0, r.pos - 5) : r.pos + 7])
        assert r.letter == next((c for c in text[r.pos :] if c.isalpha()), None)
    flags = {r.pos: r for r in sbd.abbreviation_hots(sbd.flags(sbd.candidates(docs))).collect()}
    assert flags[2].next_upper == 1 and flags[7].year == 1 and flags[7].next_upper == 1 and flags[len(text) - 1].eof == 1
    assert sum(flags[7].abbr_one) == 1 and sum(flags[text.index("т.д.") + 3].abbr_three) == 1
    codes = {r[0]: r[1] for r in sbd.candidates(docs).select("pos", sbd.window_codes()).collect()}
    assert codes[2] == [0] * 7 and codes[7] == [ord(c) for c in text[2:9]]
    assert codes[len(text) - 1][-1] == 0


def test_labels_and_rules(spark):
    docs = spark.createDataFrame([(1, "One. Two three. Four", ["One.", "Two three.", "Four"])], "doc_id long, text string, sentences array<string>")
    assert set(rows(sbd.labels_first(docs))) == set(rows(sbd.labels_running(docs))) == {(1, 3), (1, 14), (1, 19)}
    judged = sbd.label(sbd.candidates(docs), sbd.labels_first(docs))
    for rule in (sbd.rule_upper, sbd.rule_blank, sbd.rule_good_end):
        assert {r.predicted for r in rule(judged).collect()} == {1}
    assert sbd.errors(sbd.rule_upper(judged)).count() == 0
    assert rows(sbd.last_characters(docs)) == [(".", 2), ("r", 1)]


def test_abbreviations(spark):
    docs = spark.createDataFrame([(1, "на ул. Мира и т. д. или т.п. все " * 6)], "doc_id long, text string")
    assert dict(rows(sbd.abbreviations(sbd.candidates(docs)))) == {"ул.": 6, "т.": 6, "т. д.": 6, "д.": 6, "т.п.": 6}


def test_patterns(spark):
    docs = spark.createDataFrame([(1, "Смотри А. Пушкин жил… в г. Омск и т.д. да.")], "doc_id long, text string")
    got = {r.pos: r for r in sbd.pattern_flags(sbd.candidates(docs)).collect()}
    assert got[8].initial_upper == 1 and got[25].abbr_0 == 1 and got[max(got)].ellipsis == 1


def test_model(spark):
    docs = spark.createDataFrame([(i, "One two. Three v. four. Five", ["One two.", "Three v. four.", "Five"]) for i in range(20)], "doc_id long, text string, sentences array<string>")
    judged = sbd.label(sbd.candidates(docs), sbd.labels_first(docs))
    assert sbd.predict(judged, sbd.fit(judged, trees=2, depth=2)).where("predicted <> label").count() == 0


def test_registered_models_are_whole(spark, monkeypatch):
    """The queries fit their models with the operators' own settings."""
    from irengine import queries

    class Fitted(Exception):
        pass

    def stop(rows, **options):
        raise Fitted(options)

    monkeypatch.setattr(classify, "fit_voting", stop)
    monkeypatch.setattr(sbd, "fit", stop)
    for table in ("documents", "labelled"):
        monkeypatch.setattr(queries, table, lambda spark, sf_dir, *a: spark.createDataFrame([(1, "One. Two", True)], "doc_id long, text string, is_class boolean"))
    for name in ("voting_spam", "sbd_model"):
        with pytest.raises(Fitted) as e:
            queries.QUERIES[name](spark, "")
        assert e.value.args == ({},)
