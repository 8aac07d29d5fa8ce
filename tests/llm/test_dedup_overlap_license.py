"""Operators 2, 8 and 10 against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from irengine.llm import components, op2_decontamination, op8_minhash, op10_license, queries

from .helpers import ODD, frame, near_components, overlap_pairs, shingle_set, words


# ---------------------------------------------------------------- operator 2
def test_masks_lose_nothing():
    """Every window of 13 with at most two substitutions lets one mask see only equal words."""
    import itertools

    for bad in itertools.combinations(range(13), 2):
        assert any(all(at + o not in bad for o in m) for m in op2_decontamination.MASKS for at in range(13 - m[-1]))
    for n in range(op2_decontamination.MASKED, 13):  # short items, all words equal
        assert any(n > m[-1] for m in op2_decontamination.MASKS)


@pytest.fixture(scope="module")
def contaminated():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate((7, 8, 10, 13, 14, 30, 30))] + [(5, None), (None, "no id here"), (8, ""), (9, "w3 w4 changed w5 w6"), (10, "two")]
    items.append(items[5])
    docs = []
    for k in range(40):
        w = say(rng.randrange(60))
        _, item = items[k % 7]
        cut = item.split()
        for _ in range(k % 4):
            cut[rng.randrange(len(cut))] = "changed"
        if k % 3:
            w[len(w) // 2 : len(w) // 2] = cut
        docs.append((k, "; ".join(w).upper() if k % 2 else " ".join(w)))
    docs += [(100, docs[4][1]), (4, docs[4][1]), (101, items[6][1]), (102, "one two"), (103, "see, no id here at all"), (104, "say W3 w4 changed, w5 w6!"), *[r for r in ODD if r[0] != 7 and r[0] is not None]]
    return docs, items


def test_overlaps(spark, contaminated):
    docs, items = contaminated
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as h", "2 as seed", "3 as place")
    got = [tuple(r) for r in op2_decontamination.decontaminate(frame(spark, docs, clashing=True), bench).collect()]
    want = overlap_pairs(dict(enumerate(docs)).values(), dict(enumerate(items)).values())
    assert {(d, i): m for d, i, m in got} == want and want
    assert got.count((4, *next(g[1:] for g in got if g[0] == 4))) == 2  # a repeated row is reported again


def test_shuffled_joins_agree(spark, contaminated, monkeypatch):
    docs, items = contaminated
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, op2_decontamination.decontaminate(frame(spark, docs), bench).collect()))
    monkeypatch.setattr(op2_decontamination, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, op2_decontamination.decontaminate(frame(spark, docs), bench).collect())) == want


def test_clean(spark, contaminated):
    docs, items = contaminated
    bench = spark.createDataFrame(items, "item_id long, text string")
    all_docs = frame(spark, [*docs, (None, None)], clashing=True)
    kept = op2_decontamination.clean(all_docs, bench)
    leaks = {k for k, _ in overlap_pairs([(k, t) for k, (_, t) in enumerate(docs)], [(i or 99, t) for i, t in items])}
    assert any(t == "see, no id here at all" for k, (_, t) in enumerate(docs) if k in leaks)  # an item without an id leaks too
    assert kept.columns == all_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for k, (d, _) in enumerate(docs) if k not in leaks)
    assert kept.where("doc_id is null").count() == 1


def test_no_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op2_decontamination.decontaminate(frame(spark, ODD), none).count() == 0
    assert op2_decontamination.clean(frame(spark, ODD), none).count() == len(ODD)
    assert op2_decontamination.decontaminate(frame(spark, []), none).count() == 0


# ---------------------------------------------------------------- operator 8
def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(11)
    rows = []

    def variant(w, k):
        v = list(w)
        for _ in range(k):
            v[rng.randrange(len(v))] = f"n{rng.randrange(10**6)}"
        return " ".join(v)

    for b in range(6):
        w = [f"v{rng.randrange(3000)}" for _ in range(rng.choice((30, 150, 400)))]
        for k in (0, 0, 0, 1, 1, 2, 3, 4, 6, 8, 12):
            rows.append((len(rows) * 7 + 3, variant(w, k)))
        drift = list(w)
        for _ in range(12):  # a chain: each text is near the one before
            drift[rng.randrange(len(drift))] = f"d{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 + 3, " ".join(drift)))
        del b
    rows += [(90_001, "Few Words Here"), (90_002, "few words here"), (90_003, "few words"), (90_004, ""), (90_005, None), (90_006, " \n"), (90_007, "word " * 30_000), (90_008, "word " * 20_000)]
    rng.shuffle(rows)
    return rows


def check_near(got, rows):
    want = near_components(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    for r in got:
        assert r.n_shingles == len(shingle_set(dict(rows)[r.doc_id]))
        assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("block", [op8_minhash.BLOCK, 4])
def test_near_duplicates(spark, copies, block):
    """With tiny blocks, a group is spread over many pairs of blocks; the links stay the same."""
    check_near(op8_minhash.near_duplicates(frame(spark, copies, clashing=True), block=block).collect(), copies)


@pytest.mark.parametrize("block", [op8_minhash.BLOCK, 4])
def test_lower_threshold(spark, copies, block):
    got = op8_minhash.near_duplicates(frame(spark, copies), percent=80, block=block).collect()
    assert {r.doc_id: r.component_id for r in got} == near_components(copies, 80) != near_components(copies)


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    """Near copies of few, very long words: no task gets more of their text than a few blocks' worth, and all are found."""
    word = F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: F.repeat(F.concat(F.lit("w"), i.cast("string"), F.when(i == F.col("id"), F.lit("x")).otherwise(F.lit("y"))), 8000))
    docs = spark.range(40).repartition(20).select(F.col("id").alias("doc_id"), F.array_join(word, " ").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    seen, confirmed = [], op8_minhash.confirmed

    def watched(rows, keys, percent):
        seen.append(rows.groupBy(*keys).agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] or 0)
        return confirmed(rows, keys, percent)

    monkeypatch.setattr(op8_minhash, "confirmed", watched)
    got = op8_minhash.near_duplicates(docs, 80).collect()
    assert size > 150e6 and 0 < max(seen) < 100e6
    assert {(r.doc_id, r.component_id, r.n_shingles) for r in got} == {(i, 0, 116) for i in range(40)}


def test_bands_follow_the_threshold():
    assert op8_minhash.banding(85) == (36, 7)
    for percent in range(50, 100):
        bands, rows = op8_minhash.banding(percent)
        assert bands * rows <= op8_minhash.HASHES and (1 - (percent / 100) ** rows) ** bands <= 1e-6


def test_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(1, base), (1, base), (2, base), (None, base), (None, None), (3, None), (3, None), (4, "other text of six words here")]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in op8_minhash.near_duplicates(frame(spark, rows)).collect())
    assert len(got) == len(rows)
    assert [g for g in got if g[0] > 0] == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 4, True)]
    assert op8_minhash.near_duplicates(frame(spark, [])).count() == 0


def test_estimate_corrects_collisions():
    rng = np.random.default_rng(0)
    a = {*range(1000)}
    b = {*range(150, 1150)}
    h = lambda s: np.array(sorted((x * 0x9E3779B97F4A7C15) % 2**64 for x in s), np.uint64)
    with np.errstate(over="ignore"):
        sigs = [op8_minhash.minima(h(s)).astype(np.uint8) for s in (a, b)]
    assert abs(op8_minhash.estimate(sigs[0], sigs[1][None])[0] - 850 / 1150) < 0.12
    other = rng.integers(0, 256, (200, op8_minhash.HASHES), np.uint8)
    assert abs(op8_minhash.estimate(sigs[0], other).mean()) < 0.01


def test_op8_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    q = queries.QUERIES["op8_minhash"](spark, sf_dir)
    assert q.dtypes[:4] == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    check_near(q.collect(), rows)


# ---------------------------------------------------------------- operator 10
def brute_license(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    cut = lambda t: re.findall(op10_license.WORD, t)
    w = cut(lowered)
    places = [(i, label) for phrase, label in op10_license.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    base = {label for _, label in places}
    met, share = set(base), [1.0] if base else [0.0]
    blocks = [[]]
    for line in lowered.split("\n"):
        if cut(line):
            blocks[-1] += cut(line)
        else:
            blocks.append([])
    for have in map(set, blocks):
        for label, template in op10_license.TEMPLATES:
            t = set(template.split())
            if 100 * len(t & have) >= op10_license.PERCENT * len(t):
                met.add(label)
                share.append(len(t & have) / len(t))
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(met)), max(share)


def test_license_scan(spark):
    rng = random.Random(4)
    rows = list(ODD)
    for k in range(300):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            _, t = rng.choice(op10_license.TEMPLATES)
            w = t.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(["x", "the", "license"])
            if rng.random() < 0.3:
                rng.shuffle(w)
            parts.append(rng.choice([" ", "-", "  "]).join(w).upper() if rng.random() < 0.5 else ", ".join(w))
        parts.append(rng.choice(["Under the MIT License.", "apache\nlicense version 2", "Apache License, Version 2.0", "xcc by nc", "cc-BY-nc éa", "under the mit licenses"]))
        rng.shuffle(parts)
        rows.append((1000 + k, rng.choice(["\n", " ", "\n\n", "\n *\n"]).join(parts)))
    got = [tuple(r) for r in op10_license.license_scan(frame(spark, rows, clashing=True)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(repr, sorted(got, key=lambda r: repr(r)))) == sorted(repr((i, *brute_license(t))) for i, t in rows)
    assert key(got[0])
    assert op10_license.license_scan(frame(spark, [])).collect() == []
    assert len(op10_license.license_scan(frame(spark, rows), templates=[]).collect()) == len(rows)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""


def test_wrapped_notices(spark):
    rng = random.Random(8)
    rows = [(1, MIT), (2, BSD), (3, MIT.replace("copy\nof", "copy\n\nof")), (4, "Some text.\n *\n" + MIT + "\n\n" + BSD), (5, MIT.replace(" ", "\n")), (6, "// " + MIT.replace("\n", "\n// "))]
    for k in range(150):
        w = " ".join(rng.choice(op10_license.TEMPLATES)[1] for _ in range(2)).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "x"
        rows.append((1000 + k, "".join(x + rng.choice([" ", " ", ", ", "\n", "\n \n" if rng.random() < 0.2 else " "]) for x in w)))
    got = {r.doc_id: r.labels for r in op10_license.license_scan(frame(spark, rows, clashing=True)).collect()}
    assert got == {i: brute_license(t)[5] for i, t in rows}
    assert [got[i] for i in (1, 2, 3, 4, 5, 6)] == ["mit", "bsd-3", "", "bsd-3,mit", "mit", "mit"]


@pytest.mark.parametrize("percent", [50, 75, 100])
def test_other_thresholds(spark, monkeypatch, percent):
    """The filters lose no block at any threshold, with random templates over few words."""
    rng = random.Random(percent)
    say = lambda n: " ".join(rng.choice("abcdefghijkl") for _ in range(n))
    templates = [(f"t{k}", say(rng.randrange(1, 12))) for k in range(12)]
    rows = [(i, "\n\n".join(say(rng.randrange(0, 9)) for _ in range(3))) for i in range(120)]
    got = sorted((r.doc_id, r.labels, round(r.score, 9)) for r in op10_license.license_scan(frame(spark, rows), percent, templates).collect())
    monkeypatch.setattr(op10_license, "TEMPLATES", templates)
    monkeypatch.setattr(op10_license, "PERCENT", percent)
    assert got == sorted((i, brute_license(t)[5], round(brute_license(t)[6], 9)) for i, t in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.ORACLE_SQL[name])
    assert df.columns == [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))
    assert words("a b") == ["a", "b"]
