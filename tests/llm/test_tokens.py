"""Operators 1, 3 and 9: the libraries themselves are the reference."""

import random
import zlib
from array import array

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from irengine.llm import op1_sentencepiece as op1
from irengine.llm import op3_token_counts as op3
from irengine.llm import op9_token_output as op9
from irengine.llm import queries

from .helpers import ODD, frame

PIECES, BYTES = queries.PIECES, queries.BYTES


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    own = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rng = random.Random(1)
    junk = ["".join(rng.choice(" \n\tabzE'é1.,-ß▁<|😀 日\x0b") for _ in range(rng.randrange(80))) for _ in range(400)]
    return own + junk + [t for _, t in ODD if t is not None] + ["don't I'll we've 're", "tail ", " head", "a \n b", "x\n \n b", " \nfoo"]


def test_relational_lattice(spark, library, texts):
    words = sorted({w.replace(" ", "▁") for t in texts[:30] for w in op3.pretokens(t) if "\n" not in w})[:1500] + ["▁", "▁▁▁", "▁😀x"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.ids for r in op1.encode_words(df, op1.piece_table(spark, PIECES)).collect()}
    assert set(got) == set(words)
    for w, ids in got.items():
        if None not in ids:
            assert ids == library.encode(w[1:] if len(w) > 1 else "") or len(w) == 1, w


def test_worker_lattice(library, texts):
    encoder, decoder = op1.Encoder({}, PIECES), op1.Decoder(PIECES)
    for t in texts:
        if len(t) > 40_000:
            continue  # the library's own time; see test_long
        want = library.encode(t)
        assert list(encoder.text(t)) == want, t[:80]
        assert decoder.text(want) == t.replace("▁", " "), t[:80]


def test_long(library):
    encoder = op1.Encoder({}, PIECES)
    t = "word " * 30_000
    assert list(encoder.text(t)) == library.encode(t)


def test_joined_form(spark, library):
    """Relational throughout: every word by the lattice, every occurrence by the join."""
    docs = frame(spark, ODD + [(50, " a\n\n b"), (51, "▁x▁▁y ▁"), (52, "don't\nstop   now ")], clashing=True)
    got = sorted(((r.doc_id or 0, r.ids) for r in op1.encode_joined(docs, PIECES).collect()))
    want = sorted((r.doc_id or 0, list(op1.Encoder({}, PIECES).text(r.text or ""))) for r in docs.collect())
    assert got == want
    assert op1.encode_joined(frame(spark, []), PIECES).count() == 0


def test_encode_decode_frames(spark, library):
    docs = frame(spark, [r for r in ODD if r[0] not in (7, 8)], clashing=True)
    enc = op1.encode(docs, PIECES)
    got = sorted((r.doc_id or 0, r.ids) for r in enc.collect())
    assert got == sorted((i or 0, library.encode(t or "")) for i, t in ODD if i not in (7, 8))
    back = sorted((r.doc_id or 0, r.text) for r in op1.decode(enc, PIECES).collect())
    assert back == sorted((i or 0, (t or "").replace("▁", " ")) for i, t in ODD if i not in (7, 8))


def test_op1_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op1_sentencepiece"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_pieces, r.ids_crc32, r.n_bytes, r.round_trip) == (len(ids), zlib.crc32(array("I", ids).tobytes()), len(docs[r.doc_id].encode()), True)


@pytest.mark.parametrize("op", [lambda d: op1.round_trip(d, PIECES), lambda d: op3.token_counts(d, PIECES), lambda d: op9.token_output(d, BYTES)])
def test_empty_table(spark, op):
    assert op(frame(spark, [])).collect() == []


def test_op3_counts(spark, sf_dir, library, texts):
    docs = frame(spark, [(i, t) for i, t in enumerate(texts) if len(t) < 40_000] + [(-1, None), (-2, "word " * 30_000)], clashing=True)
    got = {r.doc_id: r for r in op3.token_counts(docs, PIECES, limit=100).collect()}
    for i, t in enumerate(texts):
        if len(t) < 40_000:
            n = len(library.encode(t))
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 100), t[:60]
    assert (got[-1].n_bytes, got[-1].n_tokens) == (0, 0)
    assert got[-2].n_tokens == len(library.encode("word " * 30_000))
    q = queries.QUERIES["op3_token_counts"](spark, sf_dir)
    assert q.dtypes[:4] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]


def test_op3_tiers_do_not_matter(texts):
    full, none = op3.Lengths({}, PIECES), op3.Lengths({" the": 1, " of": 1}, PIECES)
    for t in texts[:100]:
        assert sum(map(full.__getitem__, op3.pretokens(t))) == sum(map(none.__getitem__, op3.pretokens(t)))


def test_op9_encoder(bpe, texts):
    encoder = op9.Encoder(BYTES)
    for t in texts:
        want = bpe.encode(t, add_special_tokens=False).ids if len(t) < 60_000 else None
        if want is not None:
            assert list(array("I", encoder.text(t))) == want, t[:80]


def test_op9_generations(bpe, texts, monkeypatch):
    monkeypatch.setattr(op9, "CACHE", 50)
    encoder = op9.Encoder(BYTES)
    for t in texts[:40]:
        assert list(array("I", encoder.text(t))) == bpe.encode(t, add_special_tokens=False).ids
        assert len(encoder) <= 50 and len(encoder.old) <= 50


def _expected(bpe, rows):
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*bpe.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    return out


def test_op9_files(spark, bpe, tmp_path):
    rows = [r for r in ODD if r[0] != 8]
    got = op9.token_output(frame(spark, rows, clashing=True), BYTES, f"file://{tmp_path}/ids")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == _expected(bpe, rows)
    assert sorted(op9.lookup(spark, f"file://{tmp_path}/ids", 6).first().ids) == sorted([*bpe.encode(dict(rows)[6], add_special_tokens=False).ids, 2])
    assert op9.lookup(spark, f"file://{tmp_path}/ids", 999).count() == 0


def test_op9_query(spark, sf_dir, bpe):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op9_token_output"](spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(map(tuple, got.collect())) == _expected(bpe, rows)
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTES and F is not None


def test_words_fold_side_by_side(spark):
    """The relational fold, over the words of whole batches: no step of it is an interpreted lambda, and it agrees with the worker's walk."""
    rng = random.Random(6)
    words = {"▁" * rng.randrange(3) + "".join(rng.choice("aeinrst☃") for _ in range(rng.randrange(1, 60))) for _ in range(500)}
    df = spark.createDataFrame([(w,) for w in words if len(w) <= op1.LONGEST], "word string")
    folded = op1.encode_words(df, op1.piece_table(spark, PIECES))
    plan = folded._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan.replace("Aggregate", "")
    worker = op1.Lattice(PIECES)
    for r in folded.collect():
        flat = [x for c, i in zip(_cuts(worker, r.word), r.ids, strict=True) for x in ([i] if i is not None else [worker.byte[b] for b in c.encode()])]
        assert flat == worker.encode(r.word)


def _cuts(worker, word):
    return worker.split(word)
