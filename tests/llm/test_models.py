"""Operators 4 to 7: exact parts against brute force, learnt parts on held-out rows."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from irengine.llm import common, crf, op4_quality_rules, op5_quality_classifier, op6_toxicity, op7_language_id, queries

from .helpers import ODD, base_statistics, crc_mod, frame


@pytest.fixture(scope="module")
def corpus():
    """Good prose, shouting junk, and insults among prose: (doc_id, text, quality, toxic)."""
    rng = random.Random(6)
    stems = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    rows = []
    for i in range(500):
        lines = [" ".join(rng.choice(stems) for _ in range(rng.randrange(8, 20))) + "." for _ in range(rng.randrange(3, 8))]
        good = i % 4 != 0
        if not good:
            lines = [x.upper().replace(" ", "!! ") if i % 8 else " | ".join(x.split()) for x in lines]
        toxic = i % 5 == 1
        if toxic:
            for k in range(len(lines)):
                w = lines[k].split(" ")
                w.insert(rng.randrange(len(w)), rng.choice(["zzkrank", "vvidiot", "qqstupid"]))
                lines[k] = " ".join(w)
        rows.append((i, "\n".join(lines), int(good), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs = frame(spark, [(i, t) for i, t, _, _ in corpus] + [(10_000 + k, t) for k, (_, t) in enumerate(ODD)], clashing=True)
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in corpus] + [(None, 1, 1), (20_000, None, None)], "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text")
    return docs, labels


# ---------------------------------------------------------------- the field
def test_viterbi_and_marginals():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        u, a = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        score = lambda y: sum(u[i, t] for i, t in enumerate(y)) + sum(a[s, t] for s, t in itertools.pairwise(y))  # noqa: B023, E731
        paths = list(itertools.product((0, 1), repeat=n))
        assert tuple(crf.viterbi(u.tolist(), a.tolist())) == max(paths, key=score)
        f, b = crf._messages(u[None], a, np.ones((1, n), bool))
        z = np.logaddexp(*f[0, -1])
        total = sum(math.exp(score(y)) for y in paths)
        assert math.isclose(math.exp(z), total)
        for i in range(n):
            assert math.isclose(math.exp(f[0, i, 1] + b[0, i, 1] - z), sum(math.exp(score(y)) for y in paths if y[i]) / total)
    assert crf.viterbi([], [[0, 0], [0, 0]]) == []


@pytest.mark.parametrize("strength", [0.0, 0.3, 2.0, 6.0])
def test_toxic_marginals(strength):
    """Lanes that start a little early give the chain's own marginals, over texts of any length."""
    rng = np.random.default_rng(3)
    a = np.array([[strength, -strength], [-strength, strength]]) + rng.normal(size=(2, 2)) * 0.1
    sizes = [1, 0, 5, 700, 2, 0, 129, 128, 1]
    first = np.cumsum([0, *sizes])
    odds = rng.normal(size=first[-1]) * 2
    got = op6_toxicity.marginals(odds, first, a)
    for lo, hi in itertools.pairwise(first):
        if hi > lo:
            u = np.stack([np.zeros(hi - lo), odds[lo:hi]], 1)
            f, b = crf._messages(u[None], a, np.ones((1, hi - lo), bool))
            z = np.logaddexp(*f[0, -1])
            assert np.allclose(got[lo:hi], np.exp(f[0, :, 1] + b[0, :, 1] - z), atol=1e-9)
    assert len(op6_toxicity.marginals(np.zeros(0), np.array([0, 0]), a)) == 0


def test_toxic_documents_by_hand():
    """Features, odds, marginals, score and spans of texts, one word at a time."""
    rng = np.random.default_rng(5)
    model = (rng.normal(size=op6_toxicity.NONE + 1).astype(np.float32), np.array([[0.3, -0.2], [-0.4, 0.6]]), np.array([0.3, 0.5, -0.2, 0.1, -0.4]))
    model[0][-1] = 0
    texts = ["A bad word, WORSE words!", None, "", "123 _ 45", "été ÉTÉ İstanbul déjà-vu x", "one", "a" * 500 + " b" * 700]
    got = list(op6_toxicity.documents(model, pa.array(texts)))
    for t, (score, places) in zip(texts, got, strict=True):
        w = list(re.finditer(r"[^\W\d_]+", t or ""))
        assert [m.group() for m in w] == ["".join(x) for x in re.findall(r"[^\W\d_]+", t or "")]
        if not w:
            assert (score, places) == (0.0, [])
            continue
        single = op6_toxicity.Words(*common.code_points(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])))
        assert list(zip(single.starts.tolist(), single.ends.tolist(), strict=True)) == [m.span() for m in w]
        odds = [sum(float(model[0][f]) for f in row) for row in single.feats.tolist()]
        u = np.array([[0.0, x] for x in odds])
        f, b = crf._messages(u[None], model[1], np.ones((1, len(w)), bool))
        p = np.exp(f[0, :, 1] + b[0, :, 1] - np.logaddexp(*f[0, -1]))
        top, mass = min(max(p.max(), 1e-4), 1 - 1e-4), float((p * p).sum())
        x = [math.log(top / (1 - top)), math.log1p(10 * mass), math.log1p(1000 * mass / (len(p) + 50)), math.log1p(len(p)), 1.0]
        assert math.isclose(score, 1 / (1 + math.exp(-float(np.dot(x, model[2])))), rel_tol=1e-6)
        assert places == [m.span() for m, q in zip(w, p, strict=True) if q >= 0.5]


def test_toxic_features():
    """Equal words have equal features of form and affixes; neighbours and case make the others."""
    cut = lambda t: op6_toxicity.Words(*common.code_points(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))).feats
    x = cut("Stupid stupid stupidly so")
    assert x[0, 0] == x[1, 0] and x[0, 1] != x[1, 1] and x[0, 0] != x[2, 0]
    k = 4 + op6_toxicity.PREFIXES.index(5)
    assert x[0, k] == x[1, k] == x[2, k] and x[3, k] == op6_toxicity.NONE
    assert x[0, 2] == op6_toxicity.NONE == x[3, 3] and x[1, 2] == cut("stupid a")[1, 2]
    k = 4 + len(op6_toxicity.PREFIXES)
    assert x[2, k] == cut("madly x")[0, k] != x[1, k] and len(set(x[:, -1])) == 1


# ---------------------------------------------------------------- operator 4
def test_base_statistics(spark, tables):
    docs, labels = tables
    rng = random.Random(2)
    junk = [(30_000 + k, "".join(rng.choice(["a", "b", " ", " ", "\n", "#", "é", "\t"]) for _ in range(rng.randrange(200)))) for k in range(150)]
    rows = [*ODD, *junk]
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in op4_quality_rules.quality_rules(frame(spark, rows)).collect())
    want = []
    for i, t in rows:
        s = base_statistics(t)
        want.append((i or -1, *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    assert got == sorted(want)


def test_quality_rules(spark, tables, corpus):
    docs, labels = tables
    got = op4_quality_rules.quality_rules(docs, labels).collect()
    assert len(got) == len(corpus) + len(ODD)
    kept = {r.doc_id: r.kept for r in got}
    assert all(not r.kept for r in got if r.base_failed)
    good = [kept[i] for i, _, q, _ in corpus if q]
    bad = [kept[i] for i, _, q, _ in corpus if not q]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    shares = [r.content_share for r in got if not r.base_failed]
    assert all(0 <= s <= 1 for s in shares)


def test_quality_rules_verdict_is_share(spark, tables):
    docs, labels = tables
    for r in op4_quality_rules.quality_rules(docs, labels).collect():
        assert r.kept == (not r.base_failed and r.content_share >= 0.5)


@pytest.mark.parametrize("text_labels", [[], [(1, 1, 1)]])
def test_without_both_labels(spark, text_labels):
    labels = spark.createDataFrame(text_labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, ODD)
    assert all(r.kept == (not r.base_failed) for r in op4_quality_rules.quality_rules(docs, labels).collect())
    assert {r.score for r in op5_quality_classifier.quality_classifier(docs, labels).collect()} == {0.5}
    assert {r.score for r in op6_toxicity.toxicity(docs, labels).collect()} == {0.0}


# ---------------------------------------------------------------- operators 5 and 6
def check_contract(rows, mod, held, threshold):
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (r.doc_id is not None and crc_mod(r.doc_id, mod) == held)


def test_quality_classifier(spark, tables, corpus):
    docs, labels = tables
    got = op5_quality_classifier.quality_classifier(docs, labels).collect()
    assert len(got) == len(corpus) + len(ODD)
    check_contract(got, 3, 1, 0.5)
    truth = {i: q for i, _, q, _ in corpus}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_toxicity(spark, tables, corpus):
    docs, labels = tables
    got = op6_toxicity.toxicity(docs, labels).collect()
    check_contract(got, 3, 1, 0.7)
    truth = {i: (x, t) for i, t, _, x in corpus}
    held = [(r, *truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted for r, y, _ in held if y]) > 0.9
    assert np.mean([r.predicted for r, y, _ in held if not y]) < 0.02
    insults = {"zzkrank", "vvidiot", "qqstupid"}
    tagged = [text[s.begin : s.end].lower() for r, _, text in held for s in r.spans]
    there = sum(w.lower() in insults for _, _, text in held for w in text.split())
    assert np.mean([w in insults for w in tagged]) > 0.9 and sum(w in insults for w in tagged) > 0.9 * there


def test_affixes_reach_unseen_words():
    """A stem that clean texts have by chance counts once it recurs, with endings that were never seen."""
    rng = random.Random(8)
    filler = [f"{a}{b}" for a in "bcdfgh" for b in ("ana", "eni", "olo", "uru")]
    ends = [a + b + c for a in "kmnprt" for b in "aeiou" for c in "lsvz"]
    sample = []
    for k in range(900):
        w = [rng.choice(filler) for _ in range(60)]
        own = ends[:60] if k < 600 else ends[60:]
        if k % 3 == 0:
            for _ in range(5):
                w[rng.randrange(60)] = "grolm" + rng.choice(own)
        elif rng.random() < 0.05:
            w[rng.randrange(60)] = "grolm" + rng.choice(own)
        sample.append((" ".join(w), int(k % 3 == 0)))
    model = op6_toxicity.train(sample[:600])
    flagged = [(s >= 0.7, y) for (s, _), (_, y) in zip(op6_toxicity.documents(model, pa.array([t for t, _ in sample[600:]])), sample[600:], strict=True)]
    assert np.mean([f for f, y in flagged if y]) > 0.9 and np.mean([f for f, y in flagged if not y]) < 0.03


def test_labels_of_held_rows_are_not_learnt(spark, tables, corpus):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    for op in (op5_quality_classifier.quality_classifier, op6_toxicity.toxicity):
        assert sorted((r.doc_id or 0, r.score) for r in op(docs, labels).collect()) == sorted((r.doc_id or 0, r.score) for r in op(docs, flipped).collect())


# ---------------------------------------------------------------- operator 7
def ppm_bits(text, train, order=op7_language_id.ORDER):
    """Code length by plain recursion over counts, method C."""
    counts = [{} for _ in range(order + 1)]
    for t in train:
        b = b" " * order + t.encode()
        for i in range(order, len(b)):
            for n in range(order + 1):
                counts[n].setdefault(b[i - n : i], {}).setdefault(b[i], 0)
                counts[n][b[i - n : i]][b[i]] += 1

    def cost(ctx, x):
        n = len(ctx)
        own = counts[n].get(ctx)
        shorter = (lambda: cost(ctx[1:], x)) if n else (lambda: 8.0)
        if own is None:
            return shorter()
        total, kinds = sum(own.values()), len(own)
        return -math.log2(own[x] / (total + kinds)) if x in own else -math.log2(kinds / (total + kinds)) + shorter()

    b = b" " * order + text.encode()
    return sum(cost(b[i - order : i], b[i]) for i in range(order, len(b)))


def test_code_lengths():
    train = [["the cat sat on the mat", "a dog and the cat"], ["der hund und die katze", "das ist ein haus"]]
    trees = op7_language_id.Trees(["en", "de"], train)
    texts = ["the dog", "die katze im haus", "xyz!", "été", "t"]
    raw, off = common.byte_view(pa.array(texts))
    bits = trees.bits(raw[off[0] : off[-1]], off - off[0])
    for t, row in zip(texts, bits, strict=True):
        assert np.allclose(row, [ppm_bits(t, x) for x in train]), t


def test_six_hundred_languages(spark, monkeypatch):
    """Every language is learnt, however many there are."""
    rng = random.Random(5)
    rows = []
    for k in range(600):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)]
        rows += [(k * 2 + j, " ".join(rng.choice(own) for _ in range(40)), f"l{k:03}") for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in op7_language_id.language_id(docs).collect()}
    learnt = {x for i, _, x in rows if crc_mod(i, 5)}
    assert all(got[i] == x for i, _, x in rows if x in learnt) and len(learnt) > 550


def brute_language(text, by):
    """(language, score) by plain recursion."""
    if text is None or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    bits = {x: ppm_bits(text, t) for x, t in by.items()}
    best = min(bits, key=lambda x: (bits[x], x))
    size = len(text.encode())
    return best, 1 / sum(2 ** -min(1000, (b - bits[best]) * min(size, 64) / size) for b in bits.values())


def test_language_operator_by_hand(spark):
    rng = random.Random(12)
    words = {"en": ["the", "cat", "sat", "on", "mat"], "de": ["der", "hund", "und", "katze", "über"], "fr": ["le", "chat", "été", "où", "une"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randrange(1, 12))), x) for i, x in enumerate(rng.choices(list(words), k=60))]
    rows += [(100, None, "en"), (101, "12 !", "de"), (102, "", None), (103, "the der le", None), (104, "Ωμέγα", None), (0, rows[0][1], rows[0][2])]
    by = {x: [t for t in dict.fromkeys((i, t) for i, t, lang in sorted(rows, key=lambda r: (r[0], r[1] or "")) if lang == x and t is not None and crc_mod(i, 5))] for x in sorted(words)}
    by = {x: [t for _, t in v] for x, v in by.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as th", "1 as size", "2 as u")
    got = [(r.doc_id, r.lang_pred, r.score) for r in op7_language_id.language_id(docs).collect()]
    want = [(i, *brute_language(t, by)) for i, t, _ in rows]
    for g, w in zip(sorted(got, key=lambda r: (r[0], r[1], r[2])), sorted(want, key=lambda r: (r[0], r[1], r[2])), strict=True):
        assert g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=1e-6), (g, w)


def test_language_query(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op7_language_id"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.9
    assert all(r.held_out == (crc_mod(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, x) for i, t, x in [(1, "the cat sat", "en"), (2, "der hund und", "de"), (4, "the dog", "en"), (5, None, "en"), (6, "123 !?", "en"), (7, "", None), (None, "the cat", None), (8, "Ωμέγα", None)]], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in op7_language_id.language_id(docs).collect()}
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {5, 6, 7} and got[5].score == 0.0
    assert got[None].lang_pred == "en" and got[8].lang_pred in ("en", "de")
    nothing = op7_language_id.language_id(docs.where("false")).collect()
    assert nothing == []
    assert {r.lang_pred for r in op7_language_id.language_id(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


@pytest.mark.parametrize("name", ["op4_quality_rules", "op5_quality_classifier", "op6_toxicity"])
def test_queries(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    df = queries.QUERIES[name](spark, sf_dir)
    kinds = dict(df.dtypes)
    assert df.count() == n
    want = {"op4_quality_rules": {"n_words": "bigint", "base_failed": "boolean", "kept": "boolean"}}.get(name, {"held_out": "boolean", "score": "double", "predicted": "int"})
    assert want.items() <= kinds.items()


# ---------------------------------------------------------------- samples
def test_long_texts_are_learnt_from(spark, corpus):
    """A table of very long texts only: the models are as good as on short ones."""
    by = {(q, x): [t for _, t, a, b in corpus if (a, b) == (q, x)] for _, _, q, x in corpus}
    rng = random.Random(3)
    rows = []
    for i, (_, _, q, x) in enumerate(corpus[:120]):
        text = ""
        while len(text) <= 35_000:
            text += rng.choice(by[q, x]) + "\n"
        rows.append((i, text, q, x))
    assert all(len(t) > 30_000 for _, t, _, _ in rows)
    docs = spark.createDataFrame([(i, t, "xx" if q else "yy") for i, t, q, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    truth = {i: (q, x) for i, _, q, x in rows}
    quality = op5_quality_classifier.quality_classifier(docs, labels).collect()
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in quality]) > 0.9 and {r.score for r in quality} != {0.5}
    toxic = op6_toxicity.toxicity(docs, labels).collect()
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in toxic]) > 0.9
    assert {r.lang_pred for r in op7_language_id.language_id(docs).collect()} == {"xx", "yy"}
    assert op4_quality_rules.fit(docs, labels) is not None


def test_one_id_many_times(spark):
    """A document id that is repeated 20,000 times, with one text or with many, brings no more than the bound."""
    docs = spark.createDataFrame([(7, "same text")] * 20_000 + [(8, f"text {i}") for i in range(5_000)] + [(10, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 1), (10, 0)] * 3, "doc_id long, quality int")
    got = [(r.y, r.doc_id, r.text) for r in common.labelled(docs, labels, "quality", 100, 1 << 20).collect()]
    assert len(got) == len(set(got)) <= 101 and {y for y, _, _ in got} == {0, 1}
    small = [(r.y, r.text) for r in common.labelled(docs, labels, "quality", 1, 1).collect()]
    assert sorted(y for y, _ in small) == [0, 1]  # one row of each label, whatever the bound of bytes


def test_null_texts_are_replaced(spark):
    """Null texts are no candidates, so that they take no one's place."""
    docs = spark.createDataFrame([(i, None if i % 3 else f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(300)], "doc_id long, quality int")
    usable = sum(1 for i in range(0, 300, 3) if crc_mod(i, 3) != 1)
    assert common.labelled(docs, labels, "quality", 500, 1 << 20).count() == usable


@pytest.mark.parametrize("op", [op4_quality_rules.quality_rules, op5_quality_classifier.quality_classifier, op6_toxicity.toxicity])
def test_empty_documents(spark, op):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert op(frame(spark, []), labels).collect() == []
    assert op(frame(spark, []), labels.where("false")).collect() == []


def test_quality_scores_by_hand(spark, corpus):
    """Scores from a plain loop over words, pairs, triples and grams."""
    sample = [(op5_quality_classifier.bags(pa.array([t]))[0], q) for _, t, q, _ in corpus[:80]]
    model = op5_quality_classifier.train(sample)
    texts = [t for _, t, _, _ in corpus[80:90]] + [t for _, t in ODD if t is None or len(t) < 1000]
    got = [r.score for r in op5_quality_classifier.score(frame(spark, list(enumerate(texts))).coalesce(1), model).orderBy("doc_id").collect()]
    for t, s in zip(texts, got, strict=True):
        codes = np.array([ord(c) for c in t or ""], np.uint32)
        bucket, at = op5_quality_classifier.features(codes, np.array([0, len(codes)]))
        w = re.findall(r"[^ \t-\r]+", t or "")
        pairs, triples = max(0, len(w) - 1), sum(len(set(w[i : i + 3])) < 3 for i in range(len(w) - 2))
        grams = sum(len(x) for x in w) + sum(len(x) - 1 for x in w)
        assert len(bucket) == len(w) + pairs + triples + grams
        mean = sum(float(model[0][b]) for b in bucket) / max(1, len(bucket))
        assert math.isclose(s, 1 / (1 + math.exp(-max(-40.0, min(40.0, mean + model[1])))), rel_tol=1e-4)


def test_quality_training_by_hand():
    """One step of the gradient descent, written out."""
    ids, counts = np.array([3, 9], np.int32), np.array([1, 3], np.int32)
    sample = [((ids, counts), 1), ((np.array([5], np.int32), np.array([2], np.int32)), 0)]
    table, bias = op5_quality_classifier.train(sample, epochs=1, rate=0.5, seed=2)
    rng = np.random.default_rng(2)
    d = op5_quality_classifier.DIM
    emb = rng.uniform(-1 / d, 1 / d, (1 << op5_quality_classifier.BUCKETS_LOG2, d)).astype(np.float32).astype(float)
    out, b = np.zeros((d, 2)), np.zeros(2)
    for k, i in enumerate(rng.permutation(2)):
        lr = 0.5 * (1 - k / 2)
        (own, n), y = sample[i]
        mean = sum(c * emb[j] for j, c in zip(own, n, strict=True)) / n.sum()
        z = mean @ out + b
        p = np.exp(z) / np.exp(z).sum() - np.eye(2)[y]
        grad = out @ p
        out, b = out - lr * np.outer(mean, p), b - lr * 0.1 * p
        for j, c in zip(own, n, strict=True):
            emb[j] -= lr * 50 * c / n.sum() * grad
    assert np.allclose(table, emb @ (out[:, 1] - out[:, 0]), atol=1e-5) and math.isclose(bias, b[1] - b[0], abs_tol=1e-6)


def test_line_verdict_by_hand(spark, corpus):
    """Shares and verdicts from line features and a Viterbi over all paths."""
    rng = np.random.default_rng(4)
    model = (rng.normal(size=(op4_quality_rules.N_FEATS + 1, 2)), [[0.4, -0.3], [-0.2, 0.1]])
    texts = ["\n".join(t.split("\n")[:6]) for _, t, _, _ in corpus[:40]] + [t for _, t in ODD if t is None or len(t) < 300]
    got = op4_quality_rules.quality_rules(frame(spark, list(enumerate(texts))), model=model).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        x = op4_quality_rules.line_features(pa.array([t]))[0]
        lines = [re.findall(r"[^ \t-\r]+", y) for y in (t or "").split("\n")]
        sizes = [len(y) for y in lines if y]
        assert len(x) == len(sizes) == r.n_lines
        u = model[0][x].sum(1) if len(x) else np.zeros((0, 2))
        score = lambda y: sum(u[i, k] for i, k in enumerate(y)) + sum(model[1][i][j] for i, j in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(x)), key=score) if len(x) else ()
        share = sum(n for n, k in zip(sizes, best, strict=True) if not k) / sum(sizes) if sizes else 0.0
        assert math.isclose(r.content_share, share) and r.n_boilerplate_lines == sum(best)
        assert r.kept == (not r.base_failed and share >= 0.5)
