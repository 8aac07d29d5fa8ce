"""URL functions and features, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irengine.functions.text import let


def _count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def _chop(c: Column) -> Column:
    """Without one slash at the end."""
    return F.regexp_replace(c, "/$", "")


def count_segments(url: Column) -> Column:
    return F.when(url == "", 0).otherwise(_count(_chop(url), "/") - 2)


def segments(url: Column) -> Column:
    """Path segments; none for a URL that is only a host."""
    rest = F.regexp_replace(F.regexp_replace(_chop(url), "^[^:]*:", ""), "^//", "")
    path = F.when(F.instr(rest, "/") > 0, F.regexp_replace(rest, "^[^/]*/", "")).otherwise("")
    path = _chop(F.substring_index(F.substring_index(path, "?", 1), "#", 1))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/", -1))


def query_pieces(url: Column) -> Column:
    """The pieces between the first ``?`` and the first ``#``, split at ``&``."""
    after = F.when(F.instr(url, "?") > 0, F.regexp_replace(F.substring_index(F.regexp_replace(url, r"^[^?]*\?", "?"), "#", 1), r"^\?", ""))
    return F.when(after.isNull(), F.array().cast("array<string>")).otherwise(F.split(after, "&", -1))


def param_names(url: Column) -> Column:
    return F.transform(query_pieces(url), lambda x: F.substring_index(x, "=", 1))


def params(url: Column) -> Column:
    """``name=value`` strings; the value ends at a second ``=``."""
    return F.transform(query_pieces(url), lambda x: F.concat(F.split_part(x, F.lit("="), F.lit(1)), F.lit("="), F.split_part(x, F.lit("="), F.lit(2))))


def extension(segment: Column) -> Column:
    return F.when(F.instr(segment, ".") > 0, F.substring_index(segment, ".", -1)).otherwise("")


def count_commas(url: Column) -> Column:
    return _count(url, ",")


def count_underscores(url: Column) -> Column:
    return _count(url, "_")


def has_escapes(segment: Column) -> Column:
    return segment.rlike("%[0-9A-Fa-f]{2}")


def unescape(segment: Column) -> Column:
    """Percent-decoding that leaves invalid escapes and ``+`` as they are."""
    return F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)


def subsegments(segment: Column) -> Column:
    return F.when(F.instr(segment, ":") > 0, F.split(segment, ":", -1)).otherwise(F.array().cast("array<string>"))


_DIGITS = r"^[0-9]+\z"
_DIGITS_INSIDE = r"^[^0-9]+[0-9]+[^0-9]+\z"


def features(url: Column, extended: bool = True) -> Column:
    """array<string> of ``name[_position]:value`` features of one URL."""

    def of_segment(s: Column, i: Column) -> Column:
        tag = lambda name: F.concat(F.lit(name + "_"), i.cast("string"), F.lit(":"))
        plain, ext = unescape(s), extension(s)
        inside = plain.rlike(_DIGITS_INSIDE)
        out = [
            F.concat(tag("segment_name"), s),
            F.when(s.rlike(_DIGITS), F.concat(tag("segment_[0-9]"), F.lit("1"))),
            F.when(inside, F.concat(tag("segment_substr[0-9]"), F.lit("1"))),
            F.when(ext != "", F.concat(tag("segment_ext"), ext)),
            F.when((ext != "") & inside, F.concat(tag("segment_ext_substr[0-9]"), ext)),
            F.concat(tag("segment_len"), F.length(s).cast("string")),
        ]
        if not extended:
            return F.array_compact(F.array(*out))
        subs = subsegments(plain)
        out += [F.concat(tag("subsegmenst"), F.size(subs).cast("string")), F.when(has_escapes(s), F.concat(tag("segment_lang"), F.lit("rus")))]
        return F.concat(F.array_compact(F.array(*out)), F.transform(subs, lambda x: F.concat(tag("subsegment_name"), x)))

    prefix = lambda name: lambda x: F.concat(F.lit(name + ":"), x)
    whole = [F.concat(F.lit("segments:"), count_segments(url).cast("string"))]
    if extended:
        whole += [F.concat(F.lit("commas:"), count_commas(url).cast("string")), F.concat(F.lit("underscore:"), count_underscores(url).cast("string")), F.lit("correct:False")]
    by_segment = let(segments(url), lambda x: F.flatten(F.transform(x, of_segment)))
    return F.concat(F.array(*whole), F.transform(param_names(url), prefix("param_name")), F.transform(params(url), prefix("param")), by_segment)


def feature_rows(pages: DataFrame, lower: bool = True, extended: bool = True) -> DataFrame:
    """(url, feature), one row for each occurrence."""
    url = F.lower("url") if lower else F.col("url")
    return pages.where("url is not null").select(url.alias("url")).select("url", F.explode(features(F.col("url"), extended)).alias("feature"))


def feature_counts(*tables: DataFrame, lower: bool = True, extended: bool = True) -> DataFrame:
    """(feature, cnt) over the union of URL tables."""
    rows = tables[0].select("url")
    for t in tables[1:]:
        rows = rows.unionAll(t.select("url"))
    return feature_rows(rows, lower, extended).groupBy("feature").agg(F.count("*").alias("cnt"))


def mine_features(quota_urls: DataFrame, all_urls: DataFrame, n: int = 1000, least: int = 100, seed: int = 0) -> DataFrame:
    """Frequent features of n URLs drawn from each list, by falling count.

    URLs are drawn without replacement in the order of a hash with the seed, so that a draw can be repeated.
    """
    draw = lambda i: F.md5(F.concat_ws(":", F.lit(seed + i), "url").cast("binary"))
    picked = [t.select("url").where("url is not null").orderBy(draw(i), "url").limit(n) for i, t in enumerate((quota_urls, all_urls))]
    return feature_counts(*picked).where(F.col("cnt") >= least).orderBy(F.desc("cnt"), "feature")


def golden_recall(found: DataFrame, golden: DataFrame) -> DataFrame:
    """One row: share of golden features that were found."""
    hit = golden.join(found.select("feature").distinct().withColumn("hit", F.lit(1)), "feature", "left")
    return hit.agg(F.count("hit").alias("n_hit"), F.count("*").alias("n")).withColumn("recall", F.try_divide("n_hit", "n"))
