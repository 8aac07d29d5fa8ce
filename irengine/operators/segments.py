"""URL segments: clustering by frequent features, quotas per cluster, admission in arrival order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from irengine.functions import urls as u
from irengine.operators.scan import running_total

CLUSTERS = 10
MIN_QUOTA = 100


def band(counts: DataFrame, n: Column, low: float = 0.1, high: float = 0.9, least: int = 10) -> DataFrame:
    """(feature, cnt) with low * n < cnt < high * n; if fewer than ``least`` are, low is divided by 1.5 once.

    ``n`` is the number of URLs. Every feature kept is held by more than low / 1.5 of all
    URLs, so there are at most 15 times as many as features in one URL.
    """
    cnt = F.col("cnt")
    inside = (cnt > low * n) & (cnt < high * n)
    few = counts.agg(F.count_if(inside) < least).scalar()
    return counts.where((cnt < high * n) & ((cnt > low * n) | (few & (cnt > low / 1.5 * n)))).select("feature", "cnt")


def membership(features: Column, chosen: list[str]) -> Column:
    """array<double> of 0 and 1: which of the chosen features are among a URL's features."""
    return F.transform(F.array(*map(F.lit, chosen)), lambda f: F.array_contains(features, f).cast("double"))


def cluster_stats(rows: DataFrame, positive: str = "positive", cluster: str = "cluster") -> DataFrame:
    """(cluster, size, n_pos)."""
    return rows.groupBy(cluster).agg(F.count("*").alias("size"), F.count_if(F.col(positive)).alias("n_pos"))


def quotas(stats: DataFrame, quota: float, least: float = MIN_QUOTA, cluster: str = "cluster") -> DataFrame:
    """(cluster, size, n_pos, quota): shares of the whole quota by the rate of positives, small clusters smoothed.

    rate = n_pos / (size + 25th percentile of sizes); scaled to the quota, raised to ``least``, scaled
    again. There is one row for each cluster, so the windows over all of them are small.
    """
    p25 = stats.agg(F.expr("percentile(size, 0.25)").alias("x")).scalar()
    whole = Window.partitionBy()
    rate = stats.withColumn("q", F.col("n_pos") / (F.col("size") + p25))
    first = rate.withColumn("q", F.coalesce(F.try_divide(F.col("q") * quota, F.sum("q").over(whole)), F.lit(0.0)))
    raised = first.withColumn("q", F.greatest("q", F.lit(float(least))))
    return raised.select(cluster, "size", "n_pos", (F.col("q") * quota / F.sum("q").over(whole)).alias("quota"))


def admit(arrivals: DataFrame, quota: DataFrame, order: str, cluster: str = "cluster", accepted: str = "accepted") -> DataFrame:
    """Adds ``admitted``: rows the model accepts always are; others while their cluster has quota left, in arrival order.

    A cluster takes a row if fewer than quota rows of it were taken before, so the first ceil(quota)
    unaccepted rows pass. ``order`` must be unique within a cluster; rows of unknown clusters have no quota.
    """
    spare = F.when(F.coalesce(F.col(accepted), F.lit(False)), 0).otherwise(1)
    ranked = running_total(arrivals, order, {"__before": spare}, (cluster,))
    out = ranked.join(F.broadcast(quota.select(cluster, F.col("quota").alias("__quota"))), cluster, "left")
    taken = F.coalesce(F.col(accepted), F.lit(False)) | F.coalesce(F.col("__before") < F.col("__quota"), F.lit(False))
    return out.select(*arrivals.columns, taken.alias("admitted"))


def stop_after(admitted: DataFrame, order: str, most: int) -> DataFrame:
    """Rows up to and with the one that fills the global quota: the rest is never asked for."""
    ranked = running_total(admitted, order, {"__fetched": F.col("admitted").cast("int")})
    return ranked.where(F.col("__fetched") < most).select(*admitted.columns)


def evaluation(fetched: DataFrame, most: int, n_pos: int, positive: str = "positive") -> DataFrame:
    """One row: share of the quota that was used, recall of positives, and their harmonic mean."""
    rates = fetched.agg((F.count_if("admitted") / most).alias("fetch_rate"), F.try_divide(F.count_if(F.col("admitted") & F.col(positive)), F.lit(n_pos)).alias("recall"))
    return rates.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("fetch_rate") * F.col("recall"), F.col("fetch_rate") + F.col("recall")), F.lit(0.0)))


# ---------------------------------------------------------------- the whole model
@dataclass
class SegmentModel:
    """What :func:`define_segments` has learnt; all of it is small, whatever the number of URLs."""

    chosen: list[str]
    kmeans: KMeansModel
    forests: dict[int, RandomForestClassificationModel | bool]
    quota: DataFrame
    lower: bool = True

    def assign(self, pages: DataFrame) -> DataFrame:
        """Adds ``cluster`` and ``accepted``."""
        url = F.lower("url") if self.lower else F.col("url")
        rows = pages.withColumn("__x", array_to_vector(membership(u.features(F.coalesce(url, F.lit(""))), self.chosen)))
        out = self.kmeans.transform(rows)
        # every forest scores a row, and the row's own cluster chooses: no shuffle by cluster
        verdict = F.lit(False)
        for c, forest in self.forests.items():
            if isinstance(forest, bool):
                verdict = F.when(F.col("cluster") == c, F.lit(forest)).otherwise(verdict)
                continue
            out = forest.transform(out).withColumnRenamed("__p", f"__p{c}").drop("__raw", "__prob")
            verdict = F.when(F.col("cluster") == c, F.col(f"__p{c}") == 1.0).otherwise(verdict)
        return out.select(*pages.columns, "cluster", verdict.alias("accepted"))


def define_segments(positives: DataFrame, unknown: DataFrame, quota: float, clusters: int = CLUSTERS, seed: int = 0, lower: bool = True) -> SegmentModel:
    """Choose features, cluster URLs, share out the quota, and fit a small forest in each cluster."""
    rows = positives.select("url", F.lit(True).alias("positive")).unionAll(unknown.select("url", F.lit(False).alias("positive"))).where("url is not null")
    n = rows.agg(F.count("*")).scalar()
    chosen = sorted(r.feature for r in band(u.feature_counts(rows, lower=lower), n).collect())
    if not chosen:
        raise ValueError("no feature lies in the frequency band")
    url = F.lower("url") if lower else F.col("url")
    x = rows.select("positive", F.col("positive").cast("double").alias("label"), array_to_vector(membership(u.features(url), chosen)).alias("__x")).persist()
    kmeans = KMeans(k=clusters, seed=seed, featuresCol="__x", predictionCol="cluster").fit(x)
    assigned = kmeans.transform(x)
    stats = cluster_stats(assigned)
    shares = quotas(stats, quota)
    forests: dict[int, RandomForestClassificationModel | bool] = {}
    for r in stats.collect():
        own = assigned.where(F.col("cluster") == r["cluster"])
        if r.n_pos in (0, r["size"]):
            forests[r["cluster"]] = r.n_pos > 0
        else:
            forests[r["cluster"]] = RandomForestClassifier(maxDepth=5, numTrees=3, seed=seed, featuresCol="__x", labelCol="label", predictionCol="__p", rawPredictionCol="__raw", probabilityCol="__prob").fit(own)
    few = shares.sparkSession.createDataFrame(shares.collect(), shares.schema)
    x.unpersist()
    return SegmentModel(chosen, kmeans, forests, few, lower)


def simulate(model: SegmentModel, arrivals: DataFrame, order: str, most: int) -> DataFrame:
    """Admission of a stream of URLs in arrival order, until ``most`` have been fetched."""
    return stop_after(admit(model.assign(arrivals), model.quota, order), order, most)


def kmeans_assign(rows: DataFrame, vector: str, k: int = CLUSTERS, seed: int = 0) -> DataFrame:
    """Adds ``cluster``, from k-means over an array column."""
    x = rows.withColumn("__x", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="cluster").fit(x).transform(x).drop("__x")
