"""Page and document classification: models, page features, metrics, histograms."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from irengine.functions import text as tx
from irengine.functions.html import page_texts, zlib_size
from irengine.operators.scan import running_total
from irengine.sources.tables import discard, shared_root

#: Rows of a word model that may be broadcast (some 50 bytes each); beyond, the join shuffles.


# ---------------------------------------------------------------- naive Bayes
def nb_model(docs: DataFrame, label: str = "is_class", words: Column | None = None) -> DataFrame:
    """(word, c_pos, c_neg): occurrences of each word by class; rows without a label don't count."""
    w = tx.alnum_words(F.col("text")) if words is None else words
    rows = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("boolean").alias("y"), F.explode(w).alias("word"))
    return rows.groupBy("word").agg(F.count_if("y").alias("c_pos"), F.count_if(~F.col("y")).alias("c_neg"))


def nb_scores(docs: DataFrame, model: DataFrame, words: Column | None = None) -> DataFrame:
    """(doc_id, score): mean log-odds of the known words of a document; null if it has none.

    A word counts once for each occurrence and is known if the positive class has it. How the model is joined is left to
    adaptive execution, which knows its size without running it first, and splits common words if it is not broadcast.
    """
    w = tx.alnum_words(F.col("text")) if words is None else words
    odds = model.where("c_pos > 0").select("word", F.ln(F.col("c_pos") / (F.col("c_neg") + 1)).alias("odds"))
    found = docs.select("doc_id", F.explode(w).alias("word")).join(odds, "word").groupBy("doc_id").agg(F.avg("odds").alias("score"))
    return docs.select("doc_id").join(found, "doc_id", "left")


def keyword_rule(docs: DataFrame, keyword: str, words: Column | None = None) -> DataFrame:
    """(doc_id, predicted): whether the keyword is one of the document's words."""
    w = tx.alnum_words(F.col("text")) if words is None else words
    return docs.select("doc_id", F.coalesce(F.array_contains(w, keyword), F.lit(False)).alias("predicted"))


def random_rule(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, score): a number in [0, 1) that depends on the document's id alone: 32 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "doc_id").cast("binary")), 1, 8), 16, 10).cast("long")
    return docs.select("doc_id", (bits / (1 << 32)).alias("score"))


def decide(scores: DataFrame, threshold: float) -> DataFrame:
    """Adds ``predicted``: 1 if score > threshold; a null score is 0."""
    return scores.withColumn("predicted", F.coalesce((F.col("score") > threshold).cast("int"), F.lit(0)))


# ---------------------------------------------------------------- metrics
def steps(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... up to stop, by repeated addition."""
    out, x = [], start
    while x <= stop:
        out.append(x)
        x += step
    return out


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where either is 0."""
    return F.when((a == 0) | (b == 0), 0.0).otherwise(F.try_divide(a, b))


def threshold_sweep(scores: DataFrame, thresholds: list[float], label: str = "is_class") -> DataFrame:
    """Precision, recall and F1 of both classes, and macro F1, for each threshold (score > threshold is positive).

    A score is reduced to the number of thresholds below it, so one aggregation to at
    most as many rows as thresholds serves them all. Null scores or labels don't count.
    """
    cuts = sorted(thresholds)
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t < F.col("score")))
    seen = scores.where(F.col("score").isNotNull() & F.col(label).isNotNull()).select(below.alias("k"), F.col(label).cast("boolean").alias("y"))
    counts = seen.groupBy("k").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    each = counts.select("p", "n", F.posexplode(F.transform(F.array(*map(F.lit, cuts)), lambda t, i: F.struct(t.alias("threshold"), (F.col("k") > i).alias("above")))).alias("i", "t"))
    sums = {"tp": ("p", True), "fp": ("n", True), "fn": ("p", False), "tn": ("n", False)}
    table = each.groupBy("i", F.col("t.threshold").alias("threshold")).agg(*[F.sum(F.when(F.col("t.above") == up, F.col(c)).otherwise(0)).alias(name) for name, (c, up) in sums.items()])
    c = F.col
    table = table.withColumns({"prec": _ratio(c("tp"), c("tp") + c("fp")), "recall": _ratio(c("tp"), c("tp") + c("fn")), "not_prec": _ratio(c("tn"), c("tn") + c("fn")), "not_recall": _ratio(c("tn"), c("tn") + c("fp"))})
    table = table.withColumns({"f1": _ratio(2 * c("prec") * c("recall"), c("prec") + c("recall")), "not_f1": _ratio(2 * c("not_prec") * c("not_recall"), c("not_prec") + c("not_recall"))})
    return table.withColumn("macro_f1", (c("f1") + c("not_f1")) / 2).drop("i")


def auc(scores: DataFrame, label: str = "is_class") -> DataFrame:
    """One row (n_pos, n_neg, auc): the chance that a positive outscores a negative, ties counting half."""
    groups = scores.where(F.col("score").isNotNull() & F.col(label).isNotNull()).groupBy("score").agg(F.count_if(F.col(label).cast("boolean")).alias("p"), F.count_if(~F.col(label).cast("boolean")).alias("n"))
    ranked = running_total(groups, "score", {"lower": F.col("n")})
    won = F.sum(F.col("p") * (F.col("lower") + F.col("n") / 2))
    return ranked.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_neg"), F.try_divide(won, F.sum("p") * F.sum("n")).alias("auc"))


def histogram(rows: DataFrame, value: Column, width: float, low: float, high: float, label: str = "is_class") -> DataFrame:
    """(label, bin, n, density): counts of values in [low, high] by class; the last bin is closed, density integrates to 1 over the class."""
    last = round((high - low) / width) - 1
    kept = rows.select(F.col(label).alias(label), value.alias("v")).where(F.col(label).isNotNull() & (F.col("v") >= low) & (F.col("v") <= high))
    counts = kept.groupBy(label, F.least(F.floor((F.col("v") - low) / width), F.lit(last)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    # the counts are at most one row for each bin and class
    total = F.sum("n").over(Window.partitionBy(label))
    return counts.select(label, "bin", "n", (F.col("n") / (total * width)).alias("density"))


# ---------------------------------------------------------------- page features
def page_features(pages: DataFrame, page: str = "html", *keep: str) -> DataFrame:
    """(keep, words_num, avg_word_len, title_words_num, anchor_words_num, compression_level, clean_text, short_words)."""
    t = pages.select(*keep, F.col(page).alias("__html"), page_texts(F.col(page)).alias("t"))
    w = t.select(*keep, "__html", "t", tx.alnum_words(F.col("t.text")).alias("w"))
    n = F.size("w")
    letters = F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x))
    size = F.octet_length("__html")
    return w.select(
        *keep, n.cast("long").alias("words_num"), F.try_divide(letters, n).alias("avg_word_len"), F.size(tx.space_tokens(F.col("t.title"))).cast("long").alias("title_words_num"), F.size(tx.space_tokens(F.col("t.anchor"))).cast("long").alias("anchor_words_num"),
        F.try_divide(zlib_size(F.col("__html")), size).alias("compression_level"), tx.squeezed_text(F.col("t.all_data")).alias("clean_text"), tx.short_tokens(F.col("t.all_data")).alias("short_words"),
    )


def word_count_rule(docs: DataFrame, words: Column | None = None) -> DataFrame:
    """(doc_id, score): the number of words; 800 is the usual threshold."""
    w = tx.alnum_words(F.col("text")) if words is None else words
    return docs.select("doc_id", F.size(w).cast("double").alias("score"))


# ---------------------------------------------------------------- n-gram models
def char_grams(text: Column, most: int = 3) -> Column:
    """All runs of 1 to ``most`` characters of the lower-cased text, white space squeezed."""
    squeezed = F.regexp_replace(F.lower(text), r"\s+", " ")
    chars = F.when(squeezed == "", F.array().cast("array<string>")).otherwise(F.split(squeezed, "", -1))

    def of(c: Column, n: int) -> Column:
        # element by element: slice() would copy the whole array for every gram
        cut = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))
        return F.when(F.size(c) >= n, cut).otherwise(F.array().cast("array<string>"))

    def grams(c: Column) -> Column:
        return F.concat(c, *[of(c, n) for n in range(2, most + 1)])

    return tx.let(chars, grams)


def ngram_pipeline(kind: str, label: str = "label", trees: int = 20, depth: int = 3, vocabulary: int = 1 << 16) -> Pipeline:
    """TF-IDF of 1- to 3-grams of words (in 10 to 80 % of texts) or characters, with boosted trees.

    Input columns: ``tokens`` (words, or :func:`char_grams`) and the label.
    """
    stages = []
    if kind == "word":
        stages += [NGram(n=n, inputCol="tokens", outputCol=f"g{n}") for n in (1, 2, 3)]
        stages += [CountVectorizer(inputCol=f"g{n}", outputCol=f"v{n}", minDF=0.1, maxDF=0.8, vocabSize=vocabulary) for n in (1, 2, 3)]
        stages += [VectorAssembler(inputCols=["v1", "v2", "v3"], outputCol="tf")]
    else:
        stages += [CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=vocabulary)]
    return Pipeline(stages=[*stages, IDF(inputCol="tf", outputCol="tfidf"), Normalizer(p=2.0, inputCol="tfidf", outputCol="features"), GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, maxBins=16, seed=0)])


def _tokens(docs: DataFrame, kind: str) -> DataFrame:
    return docs.withColumn("tokens", tx.words(F.col("text")) if kind == "word" else char_grams(F.col("text")))


def fit_voting(docs: DataFrame, label: str = "label", kinds: tuple[str, ...] = ("word", "char"), **options) -> dict[str, PipelineModel]:
    """One fitted pipeline for each kind of n-gram; rows need ``text`` and a 0/1 label."""
    known = docs.where(F.col("text").isNotNull() & F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    return {k: _fitted(ngram_pipeline(k, label, **options), _tokens(known, k), label) for k in kinds}


def _fitted(pipeline: Pipeline, rows: DataFrame, label: str) -> PipelineModel:
    """The pipeline's model. Counts of grams are made once and kept in the shared folder: weights and trees, which pass
    over their input again and again, read these and not the texts."""
    spark, stages = rows.sparkSession, pipeline.getStages()
    at = next(i for i, s in enumerate(stages) if isinstance(s, IDF))
    counting = Pipeline(stages=stages[:at]).fit(rows)
    path = f"{shared_root(spark)}/irengine/grams-{uuid.uuid4().hex}"
    counting.transform(rows).select("tf", label).write.parquet(path)
    learning = Pipeline(stages=stages[at:]).fit(spark.read.parquet(path))
    discard(spark, path)
    return PipelineModel([*counting.stages, *learning.stages])


def vote(docs: DataFrame, models: dict[str, PipelineModel], threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted): mean of the models' class-1 probabilities, thresholded; no join is needed."""
    kept = ["doc_id", "text"]
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for k, model in models.items():
        out = model.transform(_tokens(out, k)).withColumn(f"p_{k}", vector_to_array("probability")[1])
        kept.append(f"p_{k}")
        out = out.select(*kept)
    score = sum((F.col(f"p_{k}") for k in models), F.lit(0.0)) / len(models)
    return out.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def train_test(df: DataFrame, test: float = 0.33, seed: int = 0) -> list[DataFrame]:
    return df.randomSplit([1 - test, test], seed)


def hash_split(docs: DataFrame, test: float = 0.33, seed: int = 0) -> DataFrame:
    """(doc_id, is_test): a split that is the same in every run, whatever the order of rows."""
    return random_rule(docs, seed).select("doc_id", (F.col("score") < test).alias("is_test"))
