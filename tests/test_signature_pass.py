"""Min-hash signatures in one pass."""

import hashlib
import random

import pytest

from irengine.operators import dedup


@pytest.mark.parametrize("hash_fn", ["md5", "mmh3"])
def test_hashes_of_shingles(spark, monkeypatch, hash_fn):
    monkeypatch.setattr(dedup, "CHUNK_BYTES", 300)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("ab", "é", "x" * 5_000, "word")) for _ in range(n)) for n in (0, 3, 5, 6, 40, 7, 60)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    h = (lambda b: int(hashlib.md5(b).hexdigest()[:8], 16)) if hash_fn == "md5" else dedup.murmur3_32
    want = {k: [h(" ".join(w[i : i + 5]).encode()) for i in range(len(w) - 5)] for k, t in enumerate(texts) if t is not None for w in [t.split()]}
    assert {r.doc_id: r.hs for r in dedup.hashed_shingles(docs, hash_fn).collect()} == want
    sigs = {r.doc_id: r.sig for r in dedup.signatures(docs, hash_fn).collect()}
    assert sigs == {k: [min(hs, key=lambda x, p=p: x % p) for p in dedup.MODULI] for k, hs in want.items() if hs}


def test_membership_reads_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    docs = spark.createDataFrame([(k, "a b c d e f g" if k % 2 else f"{k} b c d e f g") for k in range(10)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dedup.membership(docs.mapInArrow(count, docs.schema)).collect()}
    assert seen.value == 10 and got == {k: 1 if k % 2 else k for k in range(10)}
