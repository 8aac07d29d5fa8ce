"""Operator 1, SentencePiece encoding and decoding over a lattice of pieces.

A word's lattice has an edge for every substring of at most MAX_PIECE characters
that is a piece. Two forms walk it:

* :func:`encode_words` is relational: explode the bounded substrings of distinct words, equi-join
  them to the piece table, group the edges by word, and fold them, the words of an Arrow batch side by side.
* :class:`Lattice` walks the same edges in a Python worker, for words of more than LONGEST characters and for
  words that the broadcast table lacks.

Two plans bring words' ids to their documents. :func:`round_trip` and :func:`encode_checked` broadcast the FREQUENT
most frequent words of a sample (encoded by the relational form), and workers encode the rest as they meet it and
remember it: no document is shuffled. :func:`encode_joined` is relational throughout: all distinct words of the
corpus pass through the relational lattice, and every word occurrence is equi-joined to its ids.

The public model is of the merge (BPE) kind: its scores are merge ranks, and the
path with the best sum of scores (the Viterbi path) is not what the library returns. Both forms
therefore keep the lattice but choose the library's path. The fold's state is the set of borders that are left, as bits; each
step takes out the border inside the best edge that has just one. In the worker, an edge may follow another if the two pieces,
put together, are still split there by the merges; each border has one path at most that leads to it, so a walk that tries
the longest edge first and gives up a border for good when nothing may follow finds the library's path.

A word is a run of spaces with the characters up to the next space; no piece holds
a space mark after another character, and newlines are byte pieces of their own,
so words encode independently. Characters that are no piece become byte pieces.

Null or empty text: no pieces, round trip true. Very long texts and words are encoded whole. Repeated rows are encoded
alike, each by itself; of merges with equal scores the left one comes first. Other columns, whatever their names, are
ignored. An empty table gives an empty result. Texts that hold the
space mark itself decode to spaces in its place, as with the library.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irengine.llm.common import as_ids, lean, materialise
from irengine.llm.op3_token_counts import pretokens, processor

MAX_PIECE = 16
LONGEST = 60  # characters of a word that the relational form folds: its borders are the bits of one number
FREQUENT = 65_536  # words that the relational form encodes for the broadcast: a few MB
SAMPLE_DOCS = 2_000  # texts that the frequent words are chosen from; no influence on results
CACHE = 200_000  # words in each of the two generations of a worker's cache, and pairs of pieces
SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, round_trip boolean"
ENCODED = "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, n_bytes long, round_trip boolean"
SLICE = 500  # rows whose ids are held at once


def pieces(path: str) -> list[tuple[int, str, float]]:
    """(id, piece, score) of all normal pieces."""
    m = processor(path)
    return [(i, m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(pieces(path), "id int, piece string, score double")


# ---------------------------------------------------------------- relational form
def lattice_edges(words: DataFrame, table: DataFrame) -> DataFrame:
    """(word, edges): all pieces in each distinct word of LONGEST characters at most, and its single characters.

    Words stay where the distinct ones were dealt to, from their substrings to the grouped edges.
    """
    n = F.length("word")
    at = F.explode(F.sequence(F.lit(0), n - 1)).alias("s")
    cut = words.where(n.between(1, LONGEST)).select("word", at).select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_PIECE), n - F.col("s")))).alias("k"))
    subs = cut.select("word", "s", (F.col("s") + F.col("k")).alias("e"), F.expr("substring(word, s + 1, k)").alias("piece"))
    # the vocabulary is fixed by the model (32,000 short rows), whatever the data
    edges = subs.join(F.broadcast(table), "piece", "left").where("id is not null or e = s + 1")
    return edges.groupBy("word").agg(F.collect_list(F.struct("s", "e", "id", "score")).alias("edges"))


def fold_edges(lattice: DataFrame) -> DataFrame:
    """(word, ids): folds each lattice; id null stands for a character that is no piece.

    The state is the set of borders that are left; each step takes out the one inside the best edge
    whose ends are borders with one border in between. The words of a batch take their steps together.
    """

    def run(batches):
        for batch in batches:
            edges = batch.column("edges")
            size = pc.list_value_length(edges).to_numpy()
            s, e, score = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False) for x in map(edges.flatten().field, ("s", "e", "score")))
            ids, word = edges.flatten().field("id"), np.repeat(np.arange(len(batch)), size)
            order = np.lexsort((-e, s, -score, word))  # of each word the best edge first, of equal merges the left one
            s, e, word = s[order].astype(np.int64), e[order].astype(np.int64), word[order]
            borders = (np.int64(2) << pc.utf8_length(batch.column("word")).to_numpy().astype(np.int64)) - 1
            one = np.int64(1)
            ends, inner = (one << s) | (one << e), (one << e) - (one << (s + 1))
            open_ = np.flatnonzero(inner)
            while len(open_):
                left = borders[word[open_]]
                held = left & inner[open_]
                there = ((left & ends[open_]) == ends[open_]) & (held != 0)  # an edge that has lost an end, or has no border inside, never gets one again
                open_, held = open_[there], held[there]
                fits = open_[(held & (held - 1)) == 0]
                best = fits[np.append(True, np.diff(word[fits]) > 0)[: len(fits)]]
                borders[word[best]] &= ~inner[best]
                going = np.zeros(len(batch), bool)
                going[word[best]] = True
                open_ = open_[going[word[open_]]]
            left = borders[word]
            path = np.flatnonzero(((left & ends) == ends) & ((left & inner) == 0))
            path = path[np.lexsort((s[path], word[path]))]
            first = np.append(0, np.cumsum(np.bincount(word[path], minlength=len(batch))))
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), ids.take(pa.array(order[path])))], ["word", "ids"])

    return lattice.mapInArrow(run, "word string, ids array<int>")


def encode_words(words: DataFrame, table: DataFrame) -> DataFrame:
    """(word, ids) of each distinct word of ``words`` of LONGEST characters at most (one column ``word``, spaces written as the space mark)."""
    return fold_edges(lattice_edges(words.select("word").where("word is not null").distinct(), table))


# ---------------------------------------------------------------- worker form
_WORKER: dict = {}


class Lattice:
    """The same lattice and choice of path, for one word at a time."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.ids = {p: i for i, p, _ in pieces(path)}
        self.score = {p: s for _, p, s in pieces(path)}
        self.byte = [processor(path).piece_to_id(f"<0x{x:02X}>") for x in range(256)]
        self.together: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # what a piece begins with -> whether it is a piece that the merges make from its characters
        self.heads = dict.fromkeys((p[:i] for p in self.ids for i in range(2, len(p) + 1)), False) | {p: True for p in self.ids if len(p) > 1 and self.whole(p)}

    def merges(self, text: str, stop: int = 1) -> list[str]:
        """The merges themselves, until ``stop`` parts are left; only ever applied to one or two pieces."""
        parts = list(text)
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts(self, piece: str) -> tuple[str, str]:
        """The two parts that the last merge of a piece joins."""
        x = self.halves.get(piece)
        if x is None:
            x = self.halves[piece] = tuple(self.merges(piece, 2))
        return x

    def apart(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a, that is, whether the merges of a + b end in these two.

        Merges are undone from the last one; at each, the pair at the border must not have been a better merge.
        """
        x = self.together.get((a, b))
        if x is None:
            if len(self.together) >= CACHE:
                self.together.clear()
            x = self.together[a, b] = self.merges(a + b) == [a, b] if "▁▁" in a or "▁▁" in b else self._apart(a, b)
        return x

    def _apart(self, a: str, b: str) -> bool:
        score = self.score
        if a + b in score:
            return False
        while len(a) > 1 or len(b) > 1:
            sa = score[a] if len(a) > 1 else 1.0  # characters are there from the start
            sb = score[b] if len(b) > 1 else 1.0
            if sa < sb:
                a, last, ties = self.parts(a)[1], sa, False
            else:
                b, last, ties = self.parts(b)[0], sb, True  # of equal merges the left one comes first
            s = score.get(a + b)
            if s is not None and (s > last or ties and s == last):
                return False
        return True

    def whole(self, piece: str) -> bool:
        """Whether the merges make the piece from its characters."""
        return self.merges(piece) == [piece]

    def following(self, word: str, at: int) -> list[str]:
        """The pieces that start at a place, shortest first; a character that is none stands for itself."""
        out, heads = [word[at : at + 1]], self.heads
        for e in range(at + 2, len(word) + 1):
            p = word[at:e]
            if p not in heads:
                break
            if heads[p]:
                out.append(p)
        return out

    def split(self, word: str) -> list[str]:
        """The path: longest edges first, and a border that leads nowhere is given up for good."""
        together, dead = self.together, set()
        path: list[str] = []
        open_: list[list[str]] = [self.following(word, 0)]  # edges yet to be tried after each piece of the path
        at, n = 0, len(word)
        while at < n:
            if open_[-1]:
                p = open_[-1].pop()
                if at + len(p) not in dead and (not path or together.get((path[-1], p)) or self.apart(path[-1], p)):
                    path.append(p)
                    at += len(p)
                    open_.append(self.following(word, at) if at < n else [])
            else:
                dead.add(at)
                open_.pop()
                at -= len(path.pop())
        return path

    def encode(self, word: str) -> list[int]:
        out: list[int] = []
        for p in self.split(word):
            i = self.ids.get(p)
            out += [i] if i is not None else [self.byte[x] for x in p.encode()]
        return out


class Encoder(dict):
    """Word as it stands in the text -> its ids as packed 32-bit integers.

    A Python worker keeps one for all tasks that it runs. What it learns is held in two generations
    of at most CACHE words: a full young one becomes the old one, and words met again move back.
    """

    def __init__(self, frequent: dict[str, list[int]], path: str) -> None:
        super().__init__({w: array("I", ids).tobytes() for w, ids in frequent.items()})
        self.most, self.lattice, self.old, self.frequent = CACHE + len(self), Lattice(path), {}, dict(self)
        self.newline = array("I", [self.lattice.byte[10]]).tobytes()

    @classmethod
    def of(cls, shared, path: str) -> Encoder:
        """The worker's encoder for a model, with the broadcast table of frequent words."""
        if _WORKER.get("for") != (path, shared.id if hasattr(shared, "id") else id(shared)):
            _WORKER["for"] = (path, shared.id if hasattr(shared, "id") else id(shared))
            _WORKER["encoder"] = cls(shared.value, path)
        return _WORKER["encoder"]

    def __missing__(self, word: str) -> bytes:
        if "\n" in word:
            head, *rest = word.split("\n")
            return self[head] + b"".join(self.newline + (self.bare(x) if x else b"") for x in rest)
        return self.keep(word, self.old.get(word) or self.fresh(word))

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
            self.update(self.frequent)
        self[word] = ids
        return ids

    def fresh(self, word: str) -> bytes:
        inside, marked = self.lattice.inside, word.replace(" ", "▁")
        at = len(word) - 1
        while at > 1 and not word[at].isalnum() and marked[at - 1 : at + 1] in inside:
            at -= 1
        if at > 1 and not word[at].isalnum():  # no piece holds the two characters around this place, so no merge crosses it
            return self[word[:at]] + self.bare(word[at:])
        return array("I", self.lattice.encode(marked)).tobytes()

    def bare(self, word: str) -> bytes:
        """Ids of a word that no space mark precedes; kept under a newline, which no other key begins with."""
        key = "\n" + word
        x = self.get(key)
        if x is None:
            x = self.keep(key, self.old.get(key) or array("I", self.lattice.encode(word)).tobytes())
        return x

    def text(self, text: str) -> array:
        return array("I", b"".join(map(self.__getitem__, pretokens(text))))


class Decoder:
    """Ids -> text: pieces joined, byte pieces as bytes, space marks as spaces, the first one dropped."""

    def __init__(self, path: str) -> None:
        m = processor(path)
        self.table = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]

    def text(self, ids) -> str:
        return b"".join(map(self.table.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


def words_of(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, at, word): the words of every text in order, spaces as the space mark; words that follow a newline have none.

    A newline is a word of its own.
    """
    marked = F.concat(F.lit("▁"), F.regexp_replace("text", " ", "▁"))
    return docs.where("text <> ''").select(*keys, F.posexplode(F.regexp_extract_all(marked, F.lit("\n|▁+[^▁\n]*|[^▁\n]+"), F.lit(0))).alias("at", "word"))


def frequent_words(docs: DataFrame, path: str, top: int = FREQUENT) -> dict[str, list[int]]:
    """Encodings of the most frequent words of a bounded sample of whole texts, from the relational form."""
    spark = docs.sparkSession
    words = words_of(docs.where("text is not null").limit(SAMPLE_DOCS)).where(F.startswith("word", F.lit("▁")) & (F.length("word") <= LONGEST))
    chosen = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)
    table = encode_words(materialise(chosen.select("word"), "frequent").repartition(2 * spark.sparkContext.defaultParallelism, "word"), piece_table(spark, path)).toArrow()
    return {w.replace("▁", " "): ids for w, ids in zip(table.column("word").to_pylist(), table.column("ids").to_pylist(), strict=True) if None not in ids}


def encode_joined(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) of every document, relational throughout.

    Distinct words pass through the lattice once (those of more than LONGEST characters, or with characters that are no
    piece, in a worker), then every occurrence is joined to its ids and documents are put together again.
    """
    spark = docs.sparkSession
    rows = materialise(as_ids(docs).withColumn("row", F.monotonically_increasing_id()), "joined-docs")
    words = words_of(rows, "row")
    distinct = materialise(words.select("word").distinct(), "words")
    lattice = encode_words(distinct, piece_table(spark, model_path))

    def rest(batches):
        worker = Lattice(model_path)
        newline = [worker.byte[10]]
        for batch in batches:
            ids = [newline if w == "\n" else worker.encode(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    known = materialise(lattice, "lexicon")
    bad = F.exists("ids", lambda x: x.isNull())
    others = distinct.join(known.where(~bad), "word", "left_anti").mapInArrow(rest, "word string, ids array<int>")
    lexicon = materialise(known.where(~bad).union(others), "lexicon")
    put = words.join(lexicon, "word").groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    return rows.select("row", "doc_id").join(put, "row", "left").select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    docs = as_ids(docs)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, model_path))

    @lean
    def run(batches):
        encoder = Encoder.of(shared, model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [encoder.text(x.as_py() or "").tolist() for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    @lean
    def run(batches):
        decoder = Decoder(model_path)
        for batch in batches:
            text = [decoder.text(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def _checked(docs: DataFrame, model_path: str, with_ids: bool) -> DataFrame:
    """Every text encoded, its ids decoded again and compared."""
    docs = as_ids(docs)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, model_path))

    @lean
    def run(batches):
        encoder, decoder = Encoder.of(shared, model_path), Decoder(model_path)
        for batch in batches:
            # ids of a whole batch would be held at once; without them a batch is a few numbers per row
            for lo in range(0, batch.num_rows, SLICE if with_ids else max(batch.num_rows, 1)):
                part = batch.slice(lo, SLICE) if with_ids else batch
                rows, packed = [], []
                for x in part.column("text"):
                    text = x.as_py() or ""
                    ids = encoder.text(text)
                    rows.append((len(ids), zlib.crc32(ids.tobytes()), len(text.encode()), decoder.text(ids) == text.replace("▁", " ")))
                    if with_ids:
                        packed.append(ids.tobytes())
                n, crc, size, same = zip(*rows, strict=True) if rows else ((), (), (), ())
                arrays = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_pieces", "ids_crc32", "n_bytes", "round_trip"]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(packed), np.int32))
                    arrays.insert(1, pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), flat))
                    names.insert(1, "ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, ENCODED if with_ids else SCHEMA)


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, n_bytes, round_trip) of every text."""
    return _checked(docs, model_path, with_ids=False)


def encode_checked(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, n_pieces, ids_crc32, n_bytes, round_trip): :func:`round_trip` with the ids themselves, in one pass."""
    return _checked(docs, model_path, with_ids=True)
