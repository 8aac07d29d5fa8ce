"""Sentence boundaries: candidates, labels, features, rules, and boosted trees.

One Arrow pass over the code points of whole batches finds the candidates; they carry a short window
around them (``w``, the mark at W_MARK), so that features never touch the text again.
Positions are 0-based. Characters outside the text are null in the window.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irengine.functions.codecs import running_sums

# Marks, sentence-ending marks, and Russian abbreviations in four shapes.
MARKS = ("!", '"', ".", "?", "»", "…")
GOOD_ENDS = ("!", "…", ".", "?")
ABBREVIATIONS = {
    "one": (" г. ", " т. ", " н. ", " д. ", " ч. ", " м. ", " е. ", " в. ", " с. ", " э. ", " п. "),
    "two": (" им. ", " ст. ", " др. ", " ул. ", " вв. ", " см. ", " гг. ", " кв. ", " св. ", " км. ", " мм. "),
    "three": (" т.е. ", " т.д. ", " т.п. ", " л.д. ", " т.к ", " т.н. ", " p.m. "),
    "four": (" т. д. ", " т. е. ", " н. э. ", " т. п. ", " т. н "),
}
_MARK_CLASS = r'[\.!?"»…]'
_BEFORE, _AFTER = 5, 6
W_MARK = _BEFORE


CHUNK_BYTES = 1 << 20  # of text in one step of a pass (or one longer text)


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def _chunks(col: pa.Array) -> Iterator[tuple[int, str, np.ndarray]]:
    """(first row, text, offsets): runs of rows of a string column without nulls as one text, with the offsets of the rows in it."""
    first = np.append(0, np.cumsum(pc.binary_length(col).to_numpy()))
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + CHUNK_BYTES, "right")) - 1)
        texts = col.slice(lo, hi - lo)
        yield lo, "".join(texts.to_pylist()), np.append(0, np.cumsum(pc.utf8_length(texts).to_numpy())).astype(np.int64)
        lo = hi


def candidates(docs: DataFrame, text: str = "text", reach: int | None = None, sentences: str | None = None) -> DataFrame:
    """(doc_id, pos, mark, w, size, letter): every mark with its window, the paragraph's length, and the first letter after it.

    With ``reach`` also ``snippet``: so many characters on each side of the mark, as far as the text goes.
    With ``sentences`` also ``label``: 1 where the first occurrence of one of the row's own gold sentences ends.
    """
    marks = np.array([ord(m) for m in MARKS], np.uint32)
    span = np.arange(-_BEFORE, _AFTER + 1)

    def cut(ids: pa.Array, whole: str, off: np.ndarray, gold: pa.Array | None) -> pa.RecordBatch:
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at = np.flatnonzero(np.isin(codes, marks))
        doc = np.searchsorted(off, at, "right") - 1
        places = at[:, None] + span
        inside = (places >= off[doc, None]) & (places < off[doc + 1, None])
        w = codes[np.clip(places, 0, len(codes) - 1)]
        letters = np.append(np.flatnonzero(_letters()[codes]), len(codes))
        after = letters[np.searchsorted(letters, at)]
        has_letter = after < off[doc + 1]
        after = codes[np.minimum(after, len(codes) - 1)]
        known = np.flatnonzero(np.bincount(np.concatenate([w.reshape(-1), after])))
        alphabet, number = pa.array([chr(c) for c in known], pa.string()), np.zeros(int(known.max(initial=0)) + 1, np.int32)
        number[known] = np.arange(len(known))
        chars = alphabet.take(pa.array(number[w.reshape(-1)], mask=~inside.reshape(-1)))
        out = {
            "doc_id": ids.take(pa.array(doc)), "pos": pa.array(at - off[doc], pa.int32()), "mark": alphabet.take(pa.array(number[codes[at]])),
            "w": pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(span), pa.int32()), chars), "size": pa.array(np.diff(off)[doc], pa.int32()), "letter": alphabet.take(pa.array(number[after], mask=~has_letter)),
        }
        if reach is not None:
            bounds = zip(np.maximum(at - reach, off[doc]).tolist(), np.minimum(at + reach + 1, off[doc + 1]).tolist(), strict=True)
            out["snippet"] = pa.array([whole[x:y] for x, y in bounds], pa.string())
        if gold is not None:
            ends = np.zeros(len(codes), bool)
            for k, found in enumerate(gold.to_pylist()):
                ends[[int(off[k]) + x for x in _ends(whole[off[k] : off[k + 1]], found)]] = True
            out["label"] = pa.array(ends[at].astype(np.int32))
        return pa.RecordBatch.from_pydict(out)

    def run(batches):
        for batch in batches:
            for lo, whole, off in _chunks(batch.column("text")):
                rows = batch.slice(lo, len(off) - 1)
                yield cut(rows.column("doc_id"), whole, off, rows.column("sentences") if sentences else None)

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", snippet string" * (reach is not None) + ", label int" * (sentences is not None)
    columns = ["doc_id", F.col(text).alias("text"), *([F.col(sentences).alias("sentences")] if sentences else [])]
    return docs.where(F.col(text) != "").select(*columns).mapInArrow(run, f"doc_id {kind}, pos int, mark string, w array<string>, size int, letter string{more}")


def _ends(text: str, sentences: list[str | None] | None) -> list[int]:
    """Places of the last characters of the sentences' first occurrences."""
    found = [(text.find(s), len(s)) for s in dict.fromkeys(sentences or ()) if s]
    return [at + n - 1 for at, n in found if at >= 0]


def labels_first(docs: DataFrame, sentences: str = "sentences", text: str = "text") -> DataFrame:
    """(doc_id, pos): the end of the first occurrence of each gold sentence."""

    def run(batches):
        for batch in batches:
            ends = [_ends(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("sentences").to_pylist(), strict=True)]
            doc = np.repeat(np.arange(len(ends)), [len(e) for e in ends])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(doc, pa.int64())), "pos": pa.array([x for e in ends for x in e], pa.int32())})

    rows = docs.where(F.col(text).isNotNull() & (F.size(sentences) > 0)).select("doc_id", F.col(text).alias("text"), F.col(sentences).alias("sentences"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pos int").distinct()


def labelled_candidates(docs: DataFrame, sentences: str = "sentences", text: str = "text", reach: int | None = None) -> DataFrame:
    """:func:`candidates` with the ``label`` that :func:`labels_first` gives them.

    Where every document has an id of its own, its text and gold sentences are enough, and candidates are never
    shuffled; rows that share an id share their labels, and rows without one have none, so there the labels are joined.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return candidates(docs, text, reach, sentences)
    return label(candidates(docs, text, reach), labels_first(docs, sentences, text))


def labels_running(docs: DataFrame, sentences: str = "sentences") -> DataFrame:
    """(doc_id, pos): ends of gold sentences that follow one another with one separator in between.

    Every sentence moves the end by its length and one; the running sums of a document are taken in one pass.
    """
    steps = F.transform(sentences, lambda s: (F.length(s) + 1).cast("long"))
    return docs.where(F.size(sentences) > 0).select("doc_id", F.explode(running_sums(steps)).alias("end")).select("doc_id", (F.col("end") - 2).cast("int").alias("pos"))


def label(cands: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds a 0/1 ``label``."""
    return cands.join(gold.select("doc_id", "pos").distinct().withColumn("label", F.lit(1)), ["doc_id", "pos"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


# ---------------------------------------------------------------- character tests
def _at(k: int) -> Column:
    return F.get("w", F.lit(W_MARK + k))


def _is(k: int, what: str) -> Column:
    """Whether the character k places from the mark is of a kind; false outside the text."""
    kinds = {"upper": r"^\p{Lu}", "lower": r"^\p{Ll}", "digit": "^[0-9]", "letter": r"^\p{L}", "mark": f"^{_MARK_CLASS}"}
    test = _at(k).rlike(kinds[what]) if what in kinds else _at(k) == what
    return F.coalesce(test, F.lit(False))


def _all(*tests: tuple[int, str]) -> Column:
    out = F.lit(True)
    for k, what in tests:
        out = out & _is(k, what)
    return out


def _around(low: int, high: int) -> Column:
    """The text from ``low`` to before ``high`` around the mark; missing characters are left out."""
    return F.array_join(F.slice("w", W_MARK + low + 1, high - low), "")


#: Feature -> alternatives, each a list of (place, kind).
LIST_ITEM = [
    [(0, "."), (1, " "), (2, "digit"), (3, "."), (4, " "), (5, "upper")],
    [(0, "."), (1, " "), (2, "digit"), (3, "digit"), (4, "."), (5, " "), (6, "upper")],
    [(0, "."), (1, " "), (2, "digit"), (3, "."), (4, "upper")],
    [(0, "."), (1, " "), (2, "digit"), (3, "digit"), (4, "."), (5, "upper")],
]
FLAGS = {
    "next_space": [[(1, " ")]],
    "next_upper": [[(1, " "), (2, "upper")]],
    "next_mark": [[(1, "mark")]],
    "initials": [[(-4, "upper"), (-3, "."), (-2, " "), (-1, "upper"), (0, ".")], [(-3, "upper"), (-2, "."), (-1, "upper"), (0, ".")]],
    "digit_before": [[(-1, "digit"), (0, ".")]],
    "year": [[(-2, " "), (-1, "г"), (0, "."), (1, " ")]],
    "list_item": LIST_ITEM,
    "upper_upper": [[(-1, "upper"), (0, "."), (1, " "), (2, "upper")]],
    "name_upper": [[(-2, "upper"), (-1, "lower"), (0, "."), (1, " "), (2, "upper")]],
}
#: The looser variant of the same flags.
LOOSE_FLAGS = FLAGS | {"next_upper": [[(2, "upper")]], "initials": [[(-2, "."), (-1, "upper"), (0, ".")]], "year": [[(-1, "г"), (0, "."), (1, " ")]]}


def flags(cands: DataFrame, table: dict | None = None) -> DataFrame:
    """Adds 0/1 columns: ``eof``, ``good_end`` and the flags of the table."""
    cols = {"eof": F.col("pos") == F.col("size") - 1, "good_end": F.col("mark").isin(*GOOD_ENDS)}
    for name, shapes in (FLAGS if table is None else table).items():
        cols[name] = F.lit(False)
        for shape in shapes:
            cols[name] = cols[name] | _all(*shape)
    return cands.withColumns({n: c.cast("int") for n, c in cols.items()})


def one_hot(value: Column, words: tuple[str, ...]) -> Column:
    """array<int>: which of the words the value is; all 0 if none."""
    codes = F.array(*[F.array(*[F.lit(int(i == k)) for i in range(1, len(words) + 1)]) for k in range(len(words) + 1)])
    return F.get(codes, F.coalesce(F.array_position(F.array(*map(F.lit, words)), value), F.lit(0)).cast("int"))


def fit_classes(rows: DataFrame, value: str, most: int = 10_000) -> list:
    """The distinct values of a column in order, at most ``most`` of them: the places of a one-hot code."""
    found = [r[0] for r in rows.select(value).where(F.col(value).isNotNull()).distinct().orderBy(value).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{value} has more than {most} values")
    return found


def class_place(value: Column, classes: list) -> Column:
    """Place of the value's 1 in its one-hot code, from 1 on; 0 for a value that was not there when the classes were fitted."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, classes)), value), F.lit(0)).cast("int")


def class_places(values: Column, classes: list) -> Column:
    """array<int>: :func:`class_place` of every number of an array, for any number of classes in order."""
    known = np.array(classes, np.int64)

    @F.arrow_udf("array<int>")
    def run(batch: pa.Array) -> pa.Array:
        x = batch.flatten().cast(pa.int64()).to_numpy()
        at = np.searchsorted(known, x)
        hit = np.append(known, -1)[at] == x
        first = np.append(0, np.cumsum(pc.list_value_length(batch).to_numpy()))
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.where(hit, at + 1, 0), pa.int32()))

    return run(values)


def abbreviation_hots(cands: DataFrame) -> DataFrame:
    """Adds an array for each of the four shapes of abbreviations that end at the mark, with the blanks around them.

    Entries without the blank after their last full stop can never equal the text cut out, as they stand.
    """
    reach = {"one": 2, "two": 3, "three": 4, "four": 5}
    inside = lambda n: (F.col("pos") >= n) & (F.col("pos") + 1 < F.col("size"))
    return cands.withColumns({f"abbr_{name}": one_hot(F.when(inside(n), _around(-n, 2)), ABBREVIATIONS[name]) for name, n in reach.items()})


def mark_hot(cands: DataFrame) -> DataFrame:
    return cands.withColumn("mark_hot", one_hot(F.col("mark"), MARKS))


def window_codes(low: int = -5, high: int = 2) -> Column:
    """array<int>: code points from ``low`` to before ``high``; missing ones on the right are 0. Empty if the window starts before the text."""
    codes = F.array(*[F.coalesce(F.ascii(_at(k)), F.lit(0)) for k in range(low, high)])
    return F.when(F.col("pos") + low < 0, F.array_repeat(F.lit(0), high - low)).otherwise(codes)


# Patterns over the text three places before to four after the mark (five and six where given); value at the paragraph's end.
# The backslash before "э" of the seventh abbreviation is left out: it changes nothing, and RE2 does not read it.
PATTERNS: dict[str, tuple[str, int, int, int]] = {
    "ellipsis": (r"\.\.\. ", -3, 4, 1),
    "bracket": (r"[а-я|]\)\. [А-Я|Ё][^\.]", -3, 4, 1),
    "initial_upper": (r"[А-Я|Ё]\. [А-Я|Ё][^\.]", -3, 4, 1),
    "mark_upper": (r'[\.!?"»…] [А-Я|Ё][^\.]', -3, 4, 1),
    "short_name": (r"[А-Я|Ё][а-я|ё]\. [А-Я|Ё][^\.]", -3, 4, 0),
    "two_initials": (r"[А-Я|Ё]\.[А-Я|Ё]\. [А-Я|Ё][^\.]", -5, 6, 0),
    "abbr_0": (r" г\.", -3, 4, 0),
    "abbr_1": (r"гг\.", -3, 4, 0),
    "abbr_2": (r"т\.д\.", -3, 4, 0),
    "abbr_3": (r"т\.к\.", -3, 4, 0),
    "abbr_4": (r"т\.п\.", -3, 4, 0),
    "abbr_5": (r"т\.е\.", -3, 4, 0),
    "abbr_6": (r"н\.э.", -3, 4, 0),
    "abbr_7": (r"вв\.", -3, 4, 0),
    "abbr_8": (r" в\.", -3, 4, 0),
    "abbr_9": (r" им\.", -3, 4, 0),
    "abbr_10": (r" м\.", -3, 4, 0),
    "abbr_11": (r" ул\.", -3, 4, 0),
    "stop_quote": (r"\.»", -3, 4, 1),
    "ellipsis_quote": (r"…»", -3, 4, 1),
}


def pattern_flags(cands: DataFrame) -> DataFrame:
    """Adds 0/1 columns from patterns over the window, and ``good_end``, ``eof``, ``tiny`` (paragraph under 10 characters)."""
    last = F.col("pos") + 1 >= F.col("size")
    windows = {(low, high): f"__cut{low}_{high}" for _, low, high, _ in PATTERNS.values()}
    # a window that starts before the text is empty; each is cut once, for all of its patterns
    cands = cands.withColumns({c: F.when(F.col("pos") + low < 0, "").otherwise(_around(low, high)) for (low, high), c in windows.items()})

    def hit(p: str, low: int, high: int, at_end: int) -> Column:
        return F.when(last, at_end).otherwise(F.col(windows[low, high]).rlike(p).cast("int"))

    cols = {"good_end": F.col("mark").isin(*GOOD_ENDS).cast("int"), "eof": (F.col("pos") == F.col("size") - 1).cast("int"), "tiny": (F.col("size") < 10).cast("int")}
    return cands.withColumns(cols | {n: hit(*x) for n, x in PATTERNS.items()}).drop(*windows.values())


# ---------------------------------------------------------------- rules
def _blank(k: int) -> Column:
    """End of text, space or newline."""
    return _at(k).isNull() | _at(k).isin(" ", "\n")


def _capital() -> Column:
    return F.coalesce(F.col("letter").rlike(r"^\p{Lu}"), F.lit(False))


def rule_upper(cands: DataFrame) -> DataFrame:
    """Adds ``predicted``: 1 at the end, or before a blank if the next letter is a capital."""
    return cands.withColumn("predicted", ((F.col("pos") + 1 >= F.col("size")) | (_at(1).isin(" ", "\n") & _capital())).cast("int"))


def rule_blank(cands: DataFrame) -> DataFrame:
    """Adds ``predicted``: 1 if one of the next two places is blank, or after a good end before a capital letter."""
    return cands.withColumn("predicted", (_blank(2) | _blank(1) | (F.col("mark").isin(*GOOD_ENDS) & _capital())).cast("int"))


def rule_good_end(cands: DataFrame) -> DataFrame:
    """Adds ``predicted``: 1 for a good end before the end or a space that the end, a space or a letter follows."""
    after = _at(2).isNull() | (_at(2) == " ") | _is(2, "letter")
    return cands.withColumn("predicted", (F.col("mark").isin(*GOOD_ENDS) & (_at(1).isNull() | (_at(1) == " ")) & after).cast("int"))


# ---------------------------------------------------------------- statistics
def abbreviations(cands: DataFrame, least: int = 6) -> DataFrame:
    """(word, cnt): lower-case shapes ``x.``, ``xy.``, ``x.y.``, ``x. y.`` between blanks, found ``least`` times or more."""
    shapes = [([(-2, " "), (-1, "lower")], -1, 3), ([(-3, " "), (-2, "lower"), (-1, "lower")], -2, 3), ([(-4, " "), (-3, "lower"), (-2, "."), (-1, "lower")], -3, 4), ([(-5, " "), (-4, "lower"), (-3, "."), (-2, " "), (-1, "lower")], -4, 5)]
    found = [F.when(_all(*s, (0, "."), (1, " ")) & (F.col("pos") >= reach), _around(low, 1)) for s, low, reach in shapes]
    rows = cands.select(F.explode(F.array_compact(F.array(*found))).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def last_characters(docs: DataFrame, sentences: str = "sentences") -> DataFrame:
    """(last_char, cnt) over all gold sentences."""
    return docs.select(F.explode(sentences).alias("s")).where("s <> ''").groupBy(F.expr("right(s, 1)").alias("last_char")).agg(F.count("*").alias("cnt"))


def errors(judged: DataFrame) -> DataFrame:
    """(doc_id, pos, label, predicted, snippet) of the candidates that were judged wrongly; without a snippet of their own, their window."""
    snippet = F.col("snippet") if "snippet" in judged.columns else _around(-_BEFORE, _AFTER + 1)
    return judged.where("predicted <> label").select("doc_id", "pos", "label", "predicted", snippet.alias("snippet"))


# ---------------------------------------------------------------- model
def features(cands: DataFrame) -> DataFrame:
    """Adds ``codes``, whole numbers: flags, abbreviations, mark, and window code points."""
    rows = mark_hot(abbreviation_hots(flags(cands)))
    parts = [F.array("eof", "good_end", *FLAGS), *(F.col(f"abbr_{n}") for n in ABBREVIATIONS), F.col("mark_hot"), window_codes()]
    return rows.withColumn("codes", F.concat(*parts))


def counted(labelled: DataFrame) -> DataFrame:
    """(codes, label, n): how many labelled candidates have the same features and label. Texts repeat their contexts, so these are far fewer."""
    return features(labelled).groupBy("codes", "label").agg(F.count("*").alias("n"))


def feature_vector(rows: DataFrame) -> DataFrame:
    """Adds the vector ``features`` to candidates, or to rows that have ``codes``."""
    rows = rows if "codes" in rows.columns else features(rows)
    return rows.withColumn("features", array_to_vector(F.col("codes").cast("array<double>")))


def fit(labelled: DataFrame, trees: int = 20, depth: int = 5) -> GBTClassificationModel:
    """Boosted trees over :func:`feature_vector` of labelled candidates, or of the rows of :func:`counted`, each weighing as much as it stands for."""
    rows = labelled if "n" in labelled.columns else counted(labelled)
    rows = feature_vector(rows).select("features", F.col("label").cast("double").alias("label"), F.col("n").cast("double").alias("weight")).persist()
    try:
        return GBTClassifier(maxIter=trees, maxDepth=depth, seed=0, weightCol="weight").fit(rows)
    finally:
        rows.unpersist()


def predict(cands: DataFrame, model: GBTClassificationModel) -> DataFrame:
    return model.transform(feature_vector(cands)).withColumn("predicted", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "prediction", "features", "codes")
