"""The engine's registered queries, each over whole tables, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irengine.functions import codecs, urls
from irengine.functions import text as tx
from irengine.functions.html import page_texts, zlib_size
from irengine.operators import classify, dedup, index, rank, sbd, segments
from irengine.plans import boolean
from irengine.sources import documents as sources
from irengine.sources.tables import read_table as table
from irengine.sources.tables import shared_root
from irengine.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def labelled(spark: SparkSession, sf_dir: str, label: str = "toxic") -> DataFrame:
    """(doc_id, text, is_class)."""
    y = table(spark, sf_dir, "labels").select("doc_id", (F.col(label) == 1).alias("is_class"))
    return documents(spark, sf_dir).join(y, "doc_id")


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/irengine/{name}-{uuid.uuid4().hex}"


W = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
A = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_POSTS = f"posts as (select doc_id, unnest(list_distinct({W.format('text')})) as term from documents where text is not null)"

# ---------------------------------------------------------------- tokens and index
@query(f"select doc_id, len({W.format('text')})::bigint as n_tokens, len(list_distinct({W.format('text')}))::bigint as n_terms from documents")
def tokenize_stats(spark, sf_dir):
    w = documents(spark, sf_dir).select("doc_id", tx.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.when(F.col("w").isNotNull(), F.size("w").cast("long")).alias("n_tokens"), F.when(F.col("w").isNotNull(), F.size(F.array_distinct("w")).cast("long")).alias("n_terms"))


@query(f"with {_POSTS} select term, count(*)::bigint as df, min(doc_id) as min_doc, max(doc_id) as max_doc from posts group by term")
def index_df(spark, sf_dir):
    return index.dictionary(index.postings(documents(spark, sf_dir)))


@query(f"with {_POSTS} select term, doc_id, (doc_id - lag(doc_id, 1, -1) over (partition by term order by doc_id))::bigint as gap from posts")
def index_gaps(spark, sf_dir):
    return index.with_gaps(index.postings(documents(spark, sf_dir)))


@query(f"""with {_POSTS}, g as (select term, doc_id - lag(doc_id, 1, -1) over (partition by term order by doc_id) as gap from posts)
select term, sum(case when gap < 128 then 1 when gap < 16384 then 2 when gap < 2097152 then 3 when gap < 268435456 then 4 else 5 end)::bigint as n_bytes from g group by term""")
def index_varbyte_size(spark, sf_dir):
    gaps = index.with_gaps(index.postings(documents(spark, sf_dir)))
    return gaps.groupBy("term").agg(F.sum(codecs.varbyte_size(F.col("gap"))).cast("long").alias("n_bytes"))


def _round_trip(codec: str):
    def run(spark, sf_dir):
        lists = index.posting_lists(index.postings(documents(spark, sf_dir)))
        return index.decode_postings(index.encode_postings(lists, codec), codec)

    return run


for _codec in codecs.CODECS:
    query(f"with {_POSTS} select term, doc_id from posts", f"codec_roundtrip_{_codec}")(_round_trip(_codec))


@query()
def codec_sizes(spark, sf_dir):
    """Bytes of all postings under each codec, and of the gaps as text under zlib."""
    lists = index.posting_lists(index.postings(documents(spark, sf_dir)))
    plain = F.array_join(F.col("gaps").cast("array<string>"), " ")
    sizes = [F.sum(F.octet_length(codecs.encode(F.col("gaps"), c))).alias(c) for c in codecs.CODECS]
    return lists.agg(*sizes, F.sum(zlib_size(plain)).alias("zlib"), F.sum(F.size("gaps")).alias("n_postings"))


@query(f"with {_POSTS}, b as (select distinct unnest({W.format('text')}) as term from benchmark) select distinct term from b where term in (select term from posts)")
def index_membership(spark, sf_dir):
    """Benchmark terms that the index knows."""
    probes = index.postings(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).select("term").distinct()
    return index.contains(index.postings(documents(spark, sf_dir)), probes, "term")


# ---------------------------------------------------------------- boolean search
BOOLEAN = {
    "bool_term": "the", "bool_and": "the & of", "bool_or": "der | le", "bool_not": "!the", "bool_and_not": "the & !of",
    "bool_complex": "(the | der) & !of", "bool_double_neg": "!!the", "bool_brackets": "(the | le) & (of | de)", "bool_unknown": "zzzunknown | !zzzunknown & und",
}


def _has(word: str) -> str:
    return f"coalesce(list_contains({W.format('text')}, '{word}'), false)"


def boolean_sql(text: str) -> str:
    """Condition over a document's words."""
    ops = {"&": "and", "|": "or", "!": "not"}
    return " ".join(t if t in "()" else ops.get(t) or _has(t) for t in boolean.tokenize(text))


def _search(text: str):
    def run(spark, sf_dir):
        docs = documents(spark, sf_dir)
        return boolean.search(index.postings(docs), docs, text)

    return run


for _name, _text in BOOLEAN.items():
    query(f"select distinct doc_id from documents where {boolean_sql(_text)}", _name)(_search(_text))


@query("select query, count(*)::bigint as n from (" + " union all ".join(f"select distinct '{t}' as query, doc_id from documents where {boolean_sql(t)}" for t in BOOLEAN.values()) + ") group by query")
def bool_batch(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return boolean.search_many(index.postings(docs), docs, list(BOOLEAN.values())).groupBy("query").agg(F.count("*").alias("n"))


@query(f"select distinct doc_id from documents where {boolean_sql('(the | der) & !of')}")
def bool_set_plan(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return boolean.search_sets(index.postings(docs), docs, "(the | der) & !of")


# ---------------------------------------------------------------- normalisation
_NORM = "lower(regexp_replace(regexp_replace(regexp_replace({}, '([0-9])\\s+([0-9])', '\\1\\2', 'g'), '&[0-9A-Z_a-z]+;', ' ', 'g'), '[!-/:-@\\[-`{{-~«»]', ' ', 'g'))"


@query(f"select doc_id, md5({_NORM.format('text')}) as digest, length({_NORM.format('text')})::bigint as n_chars from documents")
def norm_text(spark, sf_dir):
    n = documents(spark, sf_dir).select("doc_id", tx.normalise(F.col("text")).alias("t"))
    return n.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("n_chars"))


@query("""with t as (select doc_id, text, list_filter(list_transform(string_split(text, ' '), lambda x: regexp_replace(x, '\\s+$', '')), lambda x: x <> '') as w from documents where text is not null)
select doc_id, len(regexp_split_to_array(lower(text), '[\\s.,\\-_?]+'))::bigint as n_dump, len(w)::bigint as n_space, len(list_filter(w, lambda x: strlen(x) < 11))::bigint as n_short,
 md5(regexp_replace(regexp_replace(regexp_replace(text, '[(\\r\\n|)]+', ' ', 'g'), '[^0-9A-Za-zА-Яа-я ]', '', 'g'), ' +', ' ', 'g')) as digest from t""")
def token_variants(spark, sf_dir):
    d, t = documents(spark, sf_dir).where("text is not null"), F.col("text")
    return d.select("doc_id", F.size(tx.split_dump(t)).cast("long").alias("n_dump"), F.size(tx.space_tokens(t)).cast("long").alias("n_space"), F.size(tx.short_tokens(t)).cast("long").alias("n_short"), F.md5(tx.squeezed_text(t).cast("binary")).alias("digest"))


# ---------------------------------------------------------------- near duplicates
_SHINGLES = f"""w as (select doc_id, {W.format(_NORM.format('text'))} as w from documents where text is not null),
sh as (select doc_id, unnest(range(len(w) - 5)) as pos, w from w where len(w) > 5),
h as (select doc_id, pos, ('0x' || md5(array_to_string(w[pos + 1:pos + 5], ' '))[1:8])::bigint as h from sh)"""
_SIG = "sig as (select doc_id, [" + ", ".join(f"arg_min(h, (h % {p})::hugeint * 100000000 + pos)" for p in dedup.MODULI) + "] as sig from h group by doc_id)"
_CLASSES = "cls as (select sig, min(doc_id) as class_id, count(*) as n from sig group by sig)"
_PAIRS = "pairs as (select a.class_id as id1, b.class_id as id2, count(*)::bigint as n_same from (select class_id, unnest(sig) as h, unnest(range(20)) as i from cls) a join (select class_id, unnest(sig) as h, unnest(range(20)) as i from cls) b on a.h = b.h and a.i = b.i and a.class_id < b.class_id group by all having count(*) >= 16)"


@query(f"with {_SHINGLES} select doc_id, count(*)::bigint as n_shingles from h group by doc_id")
def shingle_count(spark, sf_dir):
    d = documents(spark, sf_dir).where("text is not null").select("doc_id", F.size(dedup.shingles(F.col("text"))).cast("long").alias("n_shingles"))
    return d.where("n_shingles > 0")


@query(f"with {_SHINGLES}, {_SIG} select doc_id, array_to_string(sig, ',') as sig from sig")
def minhash_signature(spark, sf_dir):
    return dedup.signatures(documents(spark, sf_dir)).select("doc_id", F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("sig"))


@query(f"with {_SHINGLES}, {_SIG}, {_CLASSES}, {_PAIRS} select * from pairs")
def near_dup_pairs(spark, sf_dir):
    return dedup.near_duplicate_pairs(documents(spark, sf_dir))


@query(f"with {_SHINGLES}, {_SIG}, {_CLASSES} select doc_id, class_id from sig join cls using (sig)")
def near_dup_members(spark, sf_dir):
    return dedup.membership(documents(spark, sf_dir))


@query()
def near_dup_pairs_mmh3(spark, sf_dir):
    return dedup.near_duplicate_pairs(documents(spark, sf_dir), "mmh3")


@query()
def near_dup_agreement(spark, sf_dir):
    """How far the pair sets of the two hash functions agree."""
    d = documents(spark, sf_dir)
    return dedup.pair_jaccard(dedup.near_duplicate_pairs(d), dedup.near_duplicate_pairs(d, "mmh3"))


# ---------------------------------------------------------------- URLs
_CHOP = "regexp_replace(url, '/$', '')"
_PATH = f"(case when contains(regexp_replace(regexp_replace({_CHOP}, '^[^:]*:', ''), '^//', ''), '/') then regexp_replace(split_part(split_part(regexp_replace(regexp_replace(regexp_replace({_CHOP}, '^[^:]*:', ''), '^//', ''), '^[^/]*/', ''), '?', 1), '#', 1), '/$', '') else '' end)"
_SEGS = f"(case when {_PATH} = '' then [] else string_split({_PATH}, '/') end)"
_QUERY = "(case when contains(url, '?') then string_split(split_part(regexp_replace(url, '^[^?]*\\?', ''), '#', 1), '&') else [] end)"
_N = "(case when url = '' then 0 else length({c}) - length(replace({c}, '{x}', '')) end)"
_U = "u as (select page_id, lower(url) as url from pages where url is not null)"


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.lower("url").alias("url"))


@query(f"with {_U}, s as (select page_id, url, {_SEGS} as s from u) select page_id, (case when url = '' then 0 else length({_CHOP}) - length(replace({_CHOP}, '/', '')) - 2 end)::bigint as n_segments, array_to_string(s, '|') as segments from s")
def url_segments(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.count_segments(F.col("url")).cast("long").alias("n_segments"), F.array_join(urls.segments(F.col("url")), "|").alias("segments"))


@query(f"with {_U} select page_id, unnest(list_transform({_QUERY}, lambda x: split_part(x, '=', 1) || '=' || split_part(x, '=', 2))) as param from u")
def url_params(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.explode(urls.params(F.col("url"))).alias("param"))


@query(f"with {_U} select page_id, {_N.format(c='url', x=',')}::bigint as commas, {_N.format(c='url', x='_')}::bigint as underscores, len({_QUERY})::bigint as n_params from u")
def url_counts(spark, sf_dir):
    c = F.col("url")
    return _pages(spark, sf_dir).select("page_id", urls.count_commas(c).cast("long").alias("commas"), urls.count_underscores(c).cast("long").alias("underscores"), F.size(urls.query_pieces(c)).cast("long").alias("n_params"))


_EXT = "(case when contains(s, '.') then regexp_extract(s, '[^.]*$') else '' end)"
# the segments of these tables hold no escapes of '%', so their decoded form is the form as it stands
_FEATURES = f"""{_U}, seg as (select url, s, (i - 1)::varchar as i from (select url, unnest(seg) as s, unnest(range(1, len(seg) + 1)) as i from (select url, {_SEGS} as seg from u))),
d as (select url, s, i, url_decode(s) as d, {_EXT} as ext, regexp_full_match(url_decode(s), '[^0-9]+[0-9]+[^0-9]+') as inside, (case when contains(url_decode(s), ':') then string_split(url_decode(s), ':') else [] end) as subs from seg),
f as (select unnest(list_concat(['segments:' || (case when url = '' then 0 else length({_CHOP}) - length(replace({_CHOP}, '/', '')) - 2 end), 'commas:' || {_N.format(c='url', x=',')}, 'underscore:' || {_N.format(c='url', x='_')}, 'correct:False'],
 list_concat(list_transform({_QUERY}, lambda x: 'param_name:' || split_part(x, '=', 1)), list_transform({_QUERY}, lambda x: 'param:' || split_part(x, '=', 1) || '=' || split_part(x, '=', 2))))) as feature from u
union all select unnest(list_filter([ 'segment_name_' || i || ':' || s, case when regexp_full_match(s, '[0-9]+') then 'segment_[0-9]_' || i || ':1' end, case when inside then 'segment_substr[0-9]_' || i || ':1' end, case when ext <> '' then 'segment_ext_' || i || ':' || ext end,
 case when ext <> '' and inside then 'segment_ext_substr[0-9]_' || i || ':' || ext end, 'segment_len_' || i || ':' || length(s), 'subsegmenst_' || i || ':' || len(subs), case when d <> s then 'segment_lang_' || i || ':rus' end ], lambda x: x is not null)) from d
union all select 'subsegment_name_' || i || ':' || unnest(subs) from d)"""


@query(f"with {_FEATURES} select feature, count(*)::bigint as cnt from f group by feature")
def url_features(spark, sf_dir):
    return urls.feature_counts(table(spark, sf_dir, "pages"))


@query(f"with {_FEATURES} select feature, count(*)::bigint as cnt from f group by feature order by cnt desc, feature limit 20")
def url_feature_topk(spark, sf_dir):
    return urls.feature_counts(table(spark, sf_dir, "pages")).orderBy(F.desc("cnt"), "feature").limit(20)


_BAND = "n as (select count(*) as n from u), c as (select feature, count(*)::bigint as cnt from f group by feature), few as (select count(*) filter (where cnt > 0.1 * n and cnt < 0.9 * n) < 10 as few from c, n)"


@query(f"with {_FEATURES}, {_BAND} select feature, cnt from c, n, few where cnt < 0.9 * n and (cnt > 0.1 * n or (few and cnt > 0.1 / 1.5 * n))")
def url_feature_band(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where("url is not null")
    return segments.band(urls.feature_counts(pages), pages.agg(F.count("*")).scalar())


# ---------------------------------------------------------------- quotas
def _arrivals(spark, sf_dir) -> DataFrame:
    """Pages in order of page_id; their first segment is the cluster, a query string marks the positives, https the accepted."""
    c = F.col("url")
    return _pages(spark, sf_dir).select("page_id", F.coalesce(F.get(urls.segments(c), F.lit(0)), F.lit("")).alias("cluster"), F.contains(c, F.lit("?")).alias("positive"), F.startswith(c, F.lit("https")).alias("accepted"))


_QUOTA, _MOST = 60.0, 100
_ARRIVALS = f"{_U}, arr as (select page_id, coalesce({_SEGS}[1], '') as cluster, contains(url, '?') as positive, starts_with(url, 'https') as accepted from u)"
_ALLOC = f"""st as (select cluster, count(*)::bigint as size, (count(*) filter (where positive))::bigint as n_pos from arr group by cluster),
r as (select *, n_pos / (size + (select quantile_cont(size, 0.25) from st)) as q from st), r2 as (select *, greatest(coalesce(q * {_QUOTA} / nullif(sum(q) over (), 0), 0), 5) as q2 from r),
al as (select cluster, size, n_pos, q2 * {_QUOTA} / sum(q2) over () as quota from r2)"""
_ADMIT = "ad as (select a.*, accepted or coalesce((sum(case when accepted then 0 else 1 end) over (partition by a.cluster order by page_id)) - (case when accepted then 0 else 1 end) < quota, false) as admitted from arr a left join al using (cluster))"


@query(f"with {_ARRIVALS}, {_ALLOC} select cluster, size, n_pos, round(quota, 6) as quota from al")
def quota_alloc(spark, sf_dir):
    q = segments.quotas(segments.cluster_stats(_arrivals(spark, sf_dir)), _QUOTA, 5)
    return q.withColumn("quota", F.round("quota", 6))


def _admitted(spark, sf_dir) -> DataFrame:
    arrivals = _arrivals(spark, sf_dir)
    return segments.admit(arrivals, segments.quotas(segments.cluster_stats(arrivals), _QUOTA, 5), "page_id")


@query(f"with {_ARRIVALS}, {_ALLOC}, {_ADMIT} select page_id, cluster, positive, accepted, admitted from ad")
def quota_admit(spark, sf_dir):
    return _admitted(spark, sf_dir)


_STOP = f"sp as (select * from (select *, coalesce(sum(admitted::int) over (order by page_id rows between unbounded preceding and 1 preceding), 0) as fetched from ad) where fetched < {_MOST})"


@query(f"with {_ARRIVALS}, {_ALLOC}, {_ADMIT}, {_STOP} select page_id, cluster, positive, accepted, admitted from sp")
def quota_stop(spark, sf_dir):
    return segments.stop_after(_admitted(spark, sf_dir), "page_id", _MOST)


@query(f"with {_ARRIVALS}, {_ALLOC}, {_ADMIT}, {_STOP}, e as (select count(*) filter (where admitted) / {_MOST} as fetch_rate, (count(*) filter (where admitted and positive)) / (select count(*) filter (where positive) from arr) as recall from sp) select round(fetch_rate, 6) as fetch_rate, round(recall, 6) as recall, round(2 * fetch_rate * recall / (fetch_rate + recall), 6) as f1 from e")
def quota_evaluation(spark, sf_dir):
    n_pos = _arrivals(spark, sf_dir).where("positive").count()
    e = segments.evaluation(segments.stop_after(_admitted(spark, sf_dir), "page_id", _MOST), _MOST, n_pos)
    return e.select(*[F.round(c, 6).alias(c) for c in e.columns])


@query()
def kmeans_segments(spark, sf_dir):
    """Segments learnt from pages with and without a query string, and the admission of all pages by them."""
    pages = table(spark, sf_dir, "pages").where("url is not null").select("page_id", "url")
    has = F.contains("url", F.lit("?"))
    model = segments.define_segments(pages.where(has), pages.where(~has), 100)
    return segments.simulate(model, pages, "page_id", 1_000)


@query()
def kmeans_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return segments.kmeans_assign(rows, "embedding").groupBy("cluster", "label").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- term statistics, summaries
_TF = f"w as (select doc_id, {W.format('text')} as w from documents where text is not null), tf as (select doc_id, term, count(*) / n as tf from (select doc_id, len(w) as n, unnest(w) as term from w) group by doc_id, term, n)"
_IDF = "df as (select term, count(*) as df from tf group by term), idf as (select term, ln((select count(*) from documents) / df) as idf from df)"


@query(f"with {_TF} select doc_id, term, tf from tf")
def tf(spark, sf_dir):
    return rank.tf(documents(spark, sf_dir))


@query(f"with {_TF}, {_IDF} select term, round(idf, 6) as idf from idf")
def idf(spark, sf_dir):
    return rank.idf(documents(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query(f"with {_TF}, {_IDF}, x as (select doc_id, term, round(tf * idf, 9) as tfidf from tf join idf using (term)), r as (select doc_id, (row_number() over (partition by doc_id order by tfidf desc, term))::int as rank, term, tfidf from x) select doc_id, rank, term, round(tfidf, 6) as tfidf from r where rank <= 3")
def tfidf_top_terms(spark, sf_dir):
    return rank.tfidf_top(documents(spark, sf_dir)).withColumn("tfidf", F.round("tfidf", 6))


# RE2 has no look-behind: blanks after abbreviations are marked first, then the others split
_SENTENCES = "list_transform(string_split(regexp_replace(regexp_replace(regexp_replace({}, '([0-9A-Za-z_]\\.[0-9A-Za-z_].)([\\t\\n\\v\\f\\r ])', '\\1' || chr(2) || '\\2', 'g'), '([A-Z][a-z]\\.)([\\t\\n\\v\\f\\r ])', '\\1' || chr(2) || '\\2', 'g'), '([.?])[\\t\\n\\v\\f\\r ]', '\\1' || chr(1), 'g'), chr(1)), lambda x: replace(x, chr(2), ''))"
_SENT = f"raw as (select doc_id, {_SENTENCES.format('text')} as ss from documents where text is not null), sent as (select doc_id, (i - 1)::int as sent, s as sentence from (select doc_id, unnest(ss) as s, unnest(range(1, len(ss) + 1)) as i from raw) where trim(s) <> '')"


@query(f"with {_SENT} select doc_id, sent, sentence from sent")
def sentence_split(spark, sf_dir):
    return rank.sentence_rows(documents(spark, sf_dir))


_STOPWORDS = ["the", "of", "and", "der", "die", "le", "la", "de", "el"]


@query(f"with {_SENT} select doc_id, sent, len(list_filter(regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_]+'), lambda x: x not in {tuple(_STOPWORDS)}))::bigint as n_words from sent")
def sentence_words(spark, sf_dir):
    return rank.sentence_rows(documents(spark, sf_dir)).select("doc_id", "sent", F.size(tx.sentence_words(F.col("sentence"), _STOPWORDS)).cast("long").alias("n_words"))


_GRAPH = f"""{_SENT}, ws as (select doc_id, sent, {W.format('sentence')} as ws from sent), live as (select * from ws where len(ws) > 0),
stf as (select doc_id, sent, term, count(*) / n as tf from (select doc_id, sent, len(ws) as n, unnest(ws) as term from live) group by doc_id, sent, term, n),
sdf as (select doc_id, term, count(*) as df from stf group by doc_id, term), tot as (select doc_id, count(*) as n from live group by doc_id),
wt as (select doc_id, sent, term, tf * ln(n / df) as w from stf join sdf using (doc_id, term) join tot using (doc_id) where df < n),
un as (select doc_id, sent, term, w / sqrt(sum(w * w) over (partition by doc_id, sent)) as u from wt),
sim as (select a.doc_id, a.sent as i, b.sent as j, sum(a.u * b.u) as sim from un a join un b on a.doc_id = b.doc_id and a.term = b.term and a.sent <> b.sent group by a.doc_id, a.sent, b.sent),
ed as (select doc_id, i, j from sim where sim > 0.3)"""


@query(f"with {_GRAPH} select sent.doc_id, sent.sent, coalesce(n, 0)::bigint as n_similar, round(coalesce(best, 0.0), 6) as max_sim from sent left join (select doc_id, i, count(*) filter (where sim > 0.3) as n, max(sim) as best from sim group by doc_id, i) s on s.doc_id = sent.doc_id and s.i = sent.sent")
def sent_cosine(spark, sf_dir):
    return rank.sentence_similarity(documents(spark, sf_dir)).withColumn("max_sim", F.round("max_sim", 6))


_WALK = "al as (select doc_id, i, j from ed union all select doc_id, sent, sent from sent), deg as (select doc_id, i, count(*) as deg from al group by doc_id, i), p0 as (select doc_id, sent as k, 1 / count(*) over (partition by doc_id) as p from sent), " + ", ".join(f"p{r + 1} as (select al.doc_id, al.j as k, sum(p / deg) as p from al join p{r} on p{r}.doc_id = al.doc_id and p{r}.k = al.i join deg on deg.doc_id = al.doc_id and deg.i = al.i group by al.doc_id, al.j)" for r in range(3))


@query(f"with {_GRAPH}, {_WALK} select doc_id, k as sent, round(p, 6) as score from p3")
def lexrank_scores(spark, sf_dir):
    return rank.lexrank(documents(spark, sf_dir), rounds=3, eps=0.0).withColumn("score", F.round("score", 6))


@query(f"with {_GRAPH}, {_WALK}, r as (select doc_id, k as sent, (row_number() over (partition by doc_id order by round(p, 9) desc, k))::int as rank from p3) select doc_id, rank, sent from r where rank <= 3")
def lexrank_topk(spark, sf_dir):
    return rank.top_sentences(rank.lexrank(documents(spark, sf_dir), rounds=3, eps=0.0)).drop("score")


@query()
def lexrank_summaries(spark, sf_dir):
    """Summaries of conversations: turns joined in order are the document."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    joined = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return rank.summaries(joined)


# ---------------------------------------------------------------- classification
_LAB = "lab as (select d.doc_id, d.text, l.toxic = 1 as is_class from documents d join labels l using (doc_id))"
_NB = f"tok as (select doc_id, is_class, unnest({A.format('text')}) as word from lab where text is not null), nb as (select word, (count(*) filter (where is_class))::bigint as c_pos, (count(*) filter (where not is_class))::bigint as c_neg from tok where is_class is not null group by word)"
_SCORES = "sc as (select lab.doc_id, any_value(lab.is_class) as is_class, avg(case when c_pos > 0 then ln(c_pos / (c_neg + 1)) end) as score from lab left join tok using (doc_id) left join nb using (word) group by lab.doc_id)"


def _scored(spark, sf_dir) -> DataFrame:
    docs = labelled(spark, sf_dir)
    scores = classify.nb_scores(docs, classify.nb_model(docs))
    return scores.join(docs.select("doc_id", "is_class"), "doc_id")


@query(f"with {_LAB}, {_NB} select word, c_pos, c_neg from nb")
def nb_model(spark, sf_dir):
    return classify.nb_model(labelled(spark, sf_dir))


@query(f"with {_LAB}, {_NB}, {_SCORES} select doc_id, is_class, round(score, 6) as score, coalesce((score > -0.775)::int, 0) as predicted from sc")
def nb_scores(spark, sf_dir):
    return classify.decide(_scored(spark, sf_dir), -0.775).withColumn("score", F.round("score", 6)).select("doc_id", "is_class", "score", "predicted")


_CUTS = classify.steps(-6.0, 2.0, 0.25)
_RATIO = "(case when {a} = 0 or {b} = 0 then 0.0 else {a} / {b} end)"
def _sweep(cuts: list[float]) -> str:
    return f"""th as (select unnest({cuts})::double as threshold), k as (select threshold, (count(*) filter (where score > threshold and is_class))::bigint as tp, (count(*) filter (where score > threshold and not is_class))::bigint as fp,
 (count(*) filter (where not score > threshold and is_class))::bigint as fn, (count(*) filter (where not score > threshold and not is_class))::bigint as tn from sc, th where score is not null and is_class is not null group by threshold),
m as (select *, {_RATIO.format(a='tp', b='(tp + fp)')} as prec, {_RATIO.format(a='tp', b='(tp + fn)')} as recall, {_RATIO.format(a='tn', b='(tn + fn)')} as not_prec, {_RATIO.format(a='tn', b='(tn + fp)')} as not_recall from k),
f as (select *, {_RATIO.format(a='(2 * prec * recall)', b='(prec + recall)')} as f1, {_RATIO.format(a='(2 * not_prec * not_recall)', b='(not_prec + not_recall)')} as not_f1 from m)"""


_SWEEP = _sweep(_CUTS)


@query(f"with {_LAB}, {_NB}, {_SCORES}, {_SWEEP} select round(threshold, 6) as threshold, tp, fp, fn, tn, round(prec, 6) as prec, round(recall, 6) as recall, round(not_prec, 6) as not_prec, round(not_recall, 6) as not_recall, round(f1, 6) as f1, round(not_f1, 6) as not_f1, round((f1 + not_f1) / 2, 6) as macro_f1 from f")
def nb_threshold_sweep(spark, sf_dir):
    t = classify.threshold_sweep(_scored(spark, sf_dir), _CUTS)
    return t.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in t.dtypes])


@query(f"with {_LAB}, {_NB}, {_SCORES}, {_SWEEP} select round(threshold, 6) as threshold, round((f1 + not_f1) / 2, 6) as macro_f1 from f order by round((f1 + not_f1) / 2, 6) desc, threshold limit 1")
def macro_f1(spark, sf_dir):
    """The best threshold of the sweep."""
    t = classify.threshold_sweep(_scored(spark, sf_dir), _CUTS).select(F.round("threshold", 6).alias("threshold"), F.round("macro_f1", 6).alias("macro_f1"))
    return t.orderBy(F.desc("macro_f1"), "threshold").limit(1)


@query(f"with {_LAB}, {_NB}, {_SCORES}, p as (select score from sc where is_class and score is not null), n as (select score from sc where not is_class and score is not null) select (select count(*) from p)::bigint as n_pos, (select count(*) from n)::bigint as n_neg, round(avg(case when p.score > n.score then 1.0 when p.score = n.score then 0.5 else 0.0 end), 6) as auc from (select round(score, 9) as score from p) p, (select round(score, 9) as score from n) n")
def auc_rank(spark, sf_dir):
    return classify.auc(_scored(spark, sf_dir).withColumn("score", F.round("score", 9))).withColumn("auc", F.round("auc", 6))


@query(f"select doc_id, coalesce(list_contains({A.format('text')}, 'the'), false) as predicted from documents")
def keyword_rule(spark, sf_dir):
    return classify.keyword_rule(documents(spark, sf_dir), "the")


_RANDOM = "('0x' || md5('0:' || doc_id)[1:8])::bigint / 4294967296"


@query(f"select doc_id, {_RANDOM} as score from documents")
def random_rule(spark, sf_dir):
    return classify.random_rule(documents(spark, sf_dir))


@query(f"with x as (select doc_id, len({A.format('text')})::double as score from documents) select doc_id, score, coalesce((score > 800)::int, 0) as predicted from x where score is not null")
def word_count_rule(spark, sf_dir):
    return classify.decide(classify.word_count_rule(documents(spark, sf_dir).where("text is not null")), 800)


def _histogram_sql(value: str, width: float, low: float, high: float) -> str:
    last = round((high - low) / width) - 1
    return f"""with {_LAB}, v as (select is_class, {A.format('text')} as w from lab where is_class is not null and text is not null), x as (select is_class, {value} as v from v),
c as (select is_class, least(floor((v - {low}) / {width}), {last})::bigint as bin, count(*)::bigint as n from x where v between {low} and {high} group by all)
select is_class, bin, n, round(n / (sum(n) over (partition by is_class) * {width}), 9) as density from c"""


def _histogram(value, width, low, high):
    def run(spark, sf_dir):
        rows = labelled(spark, sf_dir).where("text is not null").select("is_class", tx.alnum_words(F.col("text")).alias("w"))
        return classify.histogram(rows, value(), width, low, high).withColumn("density", F.round("density", 9))

    return run


query(_histogram_sql("len(w)", 10, 0, 3000), "hist_words")(_histogram(lambda: F.size("w"), 10, 0, 3000))
query(_histogram_sql("list_sum(list_transform(w, lambda y: length(y))) / nullif(len(w), 0)", 0.25, 0, 25), "hist_avg_len")(_histogram(lambda: F.try_divide(F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)), F.size("w")), 0.25, 0, 25))


@query()
def page_visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page_texts(F.col("html")).alias("t")).select("page_id", "t.*")


@query()
def page_features(spark, sf_dir):
    return classify.page_features(table(spark, sf_dir, "pages"), "html", "page_id")


@query()
def voting_spam(spark, sf_dir):
    """Soft vote of the word and character n-gram models, learnt from the labelled documents, over all documents."""
    train = labelled(spark, sf_dir, "quality").select("doc_id", "text", F.col("is_class").cast("double").alias("label"))
    models = classify.fit_voting(train)
    return classify.vote(documents(spark, sf_dir), models, 0.61)


# ---------------------------------------------------------------- sentence boundaries
_M = '[.!?"»…]'
_CH = f"""ch as (select doc_id, text as par, string_split(text, '') as c, length(text) as size from documents where text <> ''),
cand as (select doc_id, par, c, size, pos from (select *, unnest(range(size)) as pos from ch) where c[pos + 1] in ('!', '"', '.', '?', '»', '…'))"""


def _c(k: int) -> str:
    """The character k places from the mark; null outside the text (index 0 or past the end gives null, negative ones are barred)."""
    return f"(case when pos + {k + 1} > 0 then c[pos + {k + 1}] end)"


def _test(k: int, what: str) -> str:
    kinds = {"upper": "\\p{Lu}", "lower": "\\p{Ll}", "digit": "[0-9]", "letter": "\\p{L}", "mark": _M}
    return f"coalesce(regexp_full_match({_c(k)}, '{kinds[what]}'), false)" if what in kinds else f"coalesce({_c(k)} = '{what}', false)"


def _flag_sql(shapes) -> str:
    return "(" + " or ".join("(" + " and ".join(_test(k, w) for k, w in s) + ")" for s in shapes) + ")::int"


def _flags_query(flags: dict) -> str:
    cols = ", ".join(f"{_flag_sql(s)} as {n}" for n, s in flags.items())
    return f"with {_CH} select doc_id, pos::int as pos, (pos = size - 1)::int as eof, (c[pos + 1] in ('!', '…', '.', '?'))::int as good_end, {cols} from cand"


def _cands(spark, sf_dir) -> DataFrame:
    return sbd.candidates(documents(spark, sf_dir))


_LETTER = f"cl as (select doc_id, pos, size, c, nullif(regexp_extract(par[pos + 1:], '\\p{{L}}'), '') as letter from cand)"


@query(f"with {_CH}, {_LETTER} select doc_id, pos::int as pos, c[pos + 1] as mark, letter from cl")
def sbd_candidates(spark, sf_dir):
    return _cands(spark, sf_dir).select("doc_id", "pos", "mark", "letter")


@query(_flags_query(sbd.FLAGS))
def sbd_flags(spark, sf_dir):
    return sbd.flags(_cands(spark, sf_dir)).select("doc_id", "pos", "eof", "good_end", *sbd.FLAGS)


@query(_flags_query(sbd.LOOSE_FLAGS))
def sbd_flags_loose(spark, sf_dir):
    return sbd.flags(_cands(spark, sf_dir), sbd.LOOSE_FLAGS).select("doc_id", "pos", "eof", "good_end", *sbd.LOOSE_FLAGS)


def _cut(low: int, high: int) -> str:
    return f"par[pos + {low + 1}:pos + {high}]"


_PATTERN_COLS = ", ".join(f"(case when pos + 1 >= size then {end} when pos + {low} < 0 then 0 else regexp_matches({_cut(low, high)}, '{p}')::int end) as {n}" for n, (p, low, high, end) in sbd.PATTERNS.items())


@query(f"with {_CH} select doc_id, pos::int as pos, (c[pos + 1] in ('!', '…', '.', '?'))::int as good_end, (pos = size - 1)::int as eof, (size < 10)::int as tiny, {_PATTERN_COLS} from cand")
def sbd_patterns(spark, sf_dir):
    return sbd.pattern_flags(_cands(spark, sf_dir)).select("doc_id", "pos", "good_end", "eof", "tiny", *sbd.PATTERNS)


_CAP = "coalesce(regexp_full_match(letter, '\\p{Lu}'), false)"
_BL = "({0} is null or {0} in (' ', chr(10)))"


@query(f"with {_CH}, {_LETTER} select doc_id, pos::int as pos, (pos + 1 >= size or (coalesce({_c(1)} in (' ', chr(10)), false) and {_CAP}))::int as predicted from cl")
def sbd_rule_a(spark, sf_dir):
    return sbd.rule_upper(_cands(spark, sf_dir)).select("doc_id", "pos", "predicted")


@query(f"with {_CH}, {_LETTER} select doc_id, pos::int as pos, ({_BL.format(_c(2))} or {_BL.format(_c(1))} or (c[pos + 1] in ('!', '…', '.', '?') and {_CAP}))::int as predicted from cl")
def sbd_rule_b(spark, sf_dir):
    return sbd.rule_blank(_cands(spark, sf_dir)).select("doc_id", "pos", "predicted")


@query(f"with {_CH} select doc_id, pos::int as pos, (c[pos + 1] in ('!', '…', '.', '?') and ({_c(1)} is null or {_c(1)} = ' ') and ({_c(2)} is null or {_c(2)} = ' ' or {_test(2, 'letter')}))::int as predicted from cand")
def sbd_rule_c(spark, sf_dir):
    return sbd.rule_good_end(_cands(spark, sf_dir)).select("doc_id", "pos", "predicted")


def _gold(spark, sf_dir) -> DataFrame:
    """Lines stand in for gold sentences."""
    d = documents(spark, sf_dir).where("text is not null")
    return d.select("doc_id", "text", F.filter(F.split("text", "\n", -1), lambda s: s != "").alias("sentences"))


_LINES = "ln as (select doc_id, text, unnest(string_split(text, chr(10))) as s from documents where text is not null), gold as (select distinct doc_id, strpos(text, s) + length(s) - 2 as pos from ln where s <> '')"


@query(f"with {_CH}, {_LINES} select cand.doc_id, cand.pos::int as pos, (gold.pos is not null)::int as label from cand left join gold on gold.doc_id = cand.doc_id and gold.pos = cand.pos")
def sbd_labels(spark, sf_dir):
    return sbd.labelled_candidates(_gold(spark, sf_dir)).select("doc_id", "pos", "label")


@query("with ln as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') as ss from documents where text is not null) select doc_id, unnest(list_transform(range(1, len(ss) + 1), lambda i: (list_sum(list_transform(ss[1:i], lambda x: length(x))) + i - 2)::int)) as pos from ln")
def sbd_labels_running(spark, sf_dir):
    return sbd.labels_running(_gold(spark, sf_dir))


@query("with ln as (select doc_id, text, unnest(string_split(text, chr(10))) as s from documents where text is not null) select right(s, 1) as last_char, count(*)::bigint as cnt from ln where s <> '' group by 1")
def sbd_last_char(spark, sf_dir):
    return sbd.last_characters(_gold(spark, sf_dir))


@query(f"""with {_CH}, x as (select unnest(list_filter([case when {_test(-2, ' ')} and {_test(-1, 'lower')} and pos >= 3 then {_cut(-1, 1)} end, case when {_test(-3, ' ')} and {_test(-2, 'lower')} and {_test(-1, 'lower')} then {_cut(-2, 1)} end,
 case when {_test(-4, ' ')} and {_test(-3, 'lower')} and {_test(-2, '.')} and {_test(-1, 'lower')} then {_cut(-3, 1)} end, case when {_test(-5, ' ')} and {_test(-4, 'lower')} and {_test(-3, '.')} and {_test(-2, ' ')} and {_test(-1, 'lower')} then {_cut(-4, 1)} end], lambda y: y is not null)) as word from cand where c[pos + 1] = '.' and {_test(1, ' ')})
select word, count(*)::bigint as cnt from x group by word having count(*) > 5""")
def sbd_abbrev(spark, sf_dir):
    return sbd.abbreviations(_cands(spark, sf_dir))


@query(f"with {_CH}, {_LETTER}, {_LINES}, j as (select cl.doc_id, cl.pos::int as pos, (gold.pos is not null)::int as label, (cl.pos + 1 >= size or (coalesce({_c(1).replace('pos', 'cl.pos')} in (' ', chr(10)), false) and {_CAP}))::int as predicted from cl left join gold on gold.doc_id = cl.doc_id and gold.pos = cl.pos) select label, predicted, count(*)::bigint as n from j group by label, predicted")
def sbd_confusion(spark, sf_dir):
    """The first rule against the labels."""
    judged = sbd.rule_upper(sbd.labelled_candidates(_gold(spark, sf_dir)))
    return judged.groupBy("label", "predicted").agg(F.count("*").alias("n"))


@query(f"""with {_CH}, {_LETTER}, {_LINES}, j as (select cl.doc_id, cl.pos, c, (gold.pos is not null)::int as label, (cl.pos + 1 >= size or (coalesce({_c(1).replace('pos', 'cl.pos')} in (' ', chr(10)), false) and {_CAP}))::int as predicted from cl left join gold on gold.doc_id = cl.doc_id and gold.pos = cl.pos)
select doc_id, pos::int as pos, label, predicted, array_to_string(c[greatest(pos - 14, 1):pos + 16], '') as snippet from j where label <> predicted""")
def sbd_errors(spark, sf_dir):
    return sbd.errors(sbd.rule_upper(sbd.labelled_candidates(_gold(spark, sf_dir), reach=15)))


@query()
def sbd_model(spark, sf_dir):
    """Boosted trees learnt from the labelled candidates and applied to all of them."""
    path = shared_folder(spark, "sbd-counts")
    sbd.counted(sbd.labelled_candidates(_gold(spark, sf_dir))).write.parquet(path)
    rows = spark.read.parquet(path)
    model = sbd.fit(rows)
    return sbd.predict(rows, model).groupBy("label", "predicted").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- streaming
@query(f"with {_POSTS} select term, doc_id from posts")
def stream_index(spark, sf_dir):
    """All documents, taken as a stream, indexed batch by batch, and read back."""
    path = shared_folder(spark, "stream-index")
    docs = spark.readStream.schema("doc_id long, text string").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/documents.parque[t]")
    jobs.index_stream(docs, f"{path}/index", f"{path}/checkpoint").awaitTermination()
    return jobs.read_stream_index(spark, f"{path}/index")


# ---------------------------------------------------------------- stored index, sinks and what readers make of them
_STORED = ("the", "der", "le", "zzzunknown")


@query(f"with {_POSTS} select term, doc_id from posts where term in {_STORED}")
def index_lookup(spark, sf_dir):
    """The index written to the shared folder, and a few of its terms read back through the pushed-down filter."""
    path = shared_folder(spark, "index")
    index.write_index(index.posting_lists(index.postings(documents(spark, sf_dir))), path)
    return index.read_terms(spark, path, list(_STORED))


_REPORT = "(der | the) & !das"


@query(f"with documents as (select page_id as doc_id, url, html as text from pages), f as (select distinct doc_id, url from documents where {boolean_sql(_REPORT)}) select '{_REPORT}' as query, (select count(*) from (select distinct doc_id from f))::bigint as n_found, doc_id, url from f")
def search_report(spark, sf_dir):
    """What a user gets: the query, how many documents it finds, and their URLs in ascending order."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", F.col("html").alias("text"))
    found = boolean.search(index.postings(pages), pages, _REPORT)
    return boolean.with_urls(found, pages).select(F.lit(_REPORT).alias("query"), F.lit(found.count()).cast("long").alias("n_found"), "doc_id", "url")


@query("select page_id as id, contains(url, '?')::int as mark, url, md5(html) as digest from pages where url is not null and html is not null")
def labelled_pages_round_trip(spark, sf_dir):
    path = shared_folder(spark, "labelled-pages")
    pages = table(spark, sf_dir, "pages").where("url is not null and html is not null")
    pages.select(F.col("page_id").alias("id"), F.contains("url", F.lit("?")).cast("int").alias("mark"), "url", F.regexp_replace(F.base64(F.encode("html", "UTF-8")), r"[\r\n]", "").alias("html")).write.csv(path, sep="\t", header=True, quote="")
    return sources.read_labelled_pages(spark, path).select("id", "mark", "url", F.md5(F.col("html").cast("binary")).alias("digest"))


@query("select doc_id, md5(text) as digest from documents")
def jsonl_round_trip(spark, sf_dir):
    path = shared_folder(spark, "jsonl")
    documents(spark, sf_dir).write.json(path)
    return sources.read_jsonl(spark, path, "doc_id long, text string").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("select trim(url) as url, count(*)::bigint as n from pages where url is not null and trim(url) <> '' group by 1")
def url_list_round_trip(spark, sf_dir):
    path = shared_folder(spark, "urls")
    table(spark, sf_dir, "pages").where("url is not null").select("url").write.text(path)
    return sources.read_urls(spark, path, seed=1).groupBy("url").agg(F.count("*").alias("n"))


@query(f"with {_FEATURES} select feature, count(*)::bigint as cnt from f group by feature having count(*) >= 10")
def feature_file_round_trip(spark, sf_dir):
    path = shared_folder(spark, "features")
    sources.write_features(urls.feature_counts(table(spark, sf_dir, "pages")), path, least=10)
    return sources.read_features(spark, path)


@query(f"with {_LAB}, {_NB}, {_SCORES} select doc_id as \"Id\", coalesce((score > -0.775)::int, 0) as \"Prediction\" from sc")
def submission_round_trip(spark, sf_dir):
    path = shared_folder(spark, "submission")
    sources.write_submission(_scored(spark, sf_dir), path, -0.775)
    return spark.read.csv(path, header=True, schema="Id long, Prediction int")


@query(f"with {_SHINGLES}, {_SIG}, {_CLASSES}, {_PAIRS} select 'doc/' || id1 as url1, 'doc/' || id2 as url2, n_same / 20 as measure from pairs")
def duplicate_report(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return sources.duplicate_lines(dedup.near_duplicate_pairs(docs), docs.select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url")))


@query("select url, coalesce(length(html), 0)::int as body_length, coalesce(length(url), 0)::int as text_length from pages")
def document_lengths(spark, sf_dir):
    return sources.lengths(table(spark, sf_dir, "pages").select("url", F.col("html").alias("body"), F.col("url").alias("text")))


# ---------------------------------------------------------------- mining, splits, sweeps
_DRAWN = """u as (select lower(url) as url from ((select url from pages where contains(url, '?') order by md5('0:' || url), url limit 1000) union all (select url from pages where not contains(url, '?') order by md5('1:' || url), url limit 1000)))"""
_MINED = _FEATURES.replace(_U, _DRAWN, 1)


def _mined(spark, sf_dir, least: int) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where("url is not null").select("url")
    has = F.contains("url", F.lit("?"))
    return urls.mine_features(pages.where(has), pages.where(~has), least=least)


@query(f"with {_MINED} select feature, count(*)::bigint as cnt from f group by feature having count(*) >= 20")
def url_feature_mining(spark, sf_dir):
    return _mined(spark, sf_dir, 20)


@query(f"with {_MINED}, found as (select feature from f group by feature having count(*) >= 20), golden as (select feature from f group by feature having count(*) >= 10) select (select count(*) from golden where feature in (select feature from found))::bigint as n_hit, (select count(*) from golden)::bigint as n, round((select count(*) from golden where feature in (select feature from found)) / (select count(*) from golden), 6) as recall")
def url_golden_recall(spark, sf_dir):
    """Features of 20 URLs or more against those of 10 or more."""
    r = urls.golden_recall(_mined(spark, sf_dir, 20), _mined(spark, sf_dir, 10).select("feature"))
    return r.withColumn("recall", F.round("recall", 6))


@query(f"select doc_id, {_RANDOM} < 0.33 as is_test from documents")
def hash_split(spark, sf_dir):
    return classify.hash_split(documents(spark, sf_dir))


_WIDE_CUTS = classify.steps(0.0, 3000.0, 100.0)


@query(f"with {_LAB}, sc as (select doc_id, is_class, len({A.format('text')})::double as score from lab where text is not null), {_sweep(_WIDE_CUTS)} select round(threshold, 6) as threshold, tp, fp, fn, tn, round((f1 + not_f1) / 2, 6) as macro_f1 from f")
def word_count_sweep(spark, sf_dir):
    docs = labelled(spark, sf_dir).where("text is not null")
    scored = classify.word_count_rule(docs).join(docs.select("doc_id", "is_class"), "doc_id")
    return classify.threshold_sweep(scored, _WIDE_CUTS).select(F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", "tn", F.round("macro_f1", 6).alias("macro_f1"))


# ---------------------------------------------------------------- codes of sentence candidates
def _joined(c) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


_HOTS = ", ".join(f"array_to_string(list_transform({list(sbd.ABBREVIATIONS[name])}, lambda x: coalesce(((case when pos >= {n} and pos + 1 < size then {_cut(-n, 2)} end) = x)::int, 0)), ',') as abbr_{name}" for name, n in (("one", 2), ("two", 3), ("three", 4), ("four", 5)))


@query(f"with {_CH} select doc_id, pos::int as pos, {_HOTS}, array_to_string(list_transform({list(sbd.MARKS)}, lambda x: (c[pos + 1] = x)::int), ',') as mark_hot from cand")
def sbd_hots(spark, sf_dir):
    """One-hot codes of abbreviations and marks."""
    rows = sbd.mark_hot(sbd.abbreviation_hots(_cands(spark, sf_dir)))
    return rows.select("doc_id", "pos", *[_joined(F.col(c)).alias(c) for c in (*(f"abbr_{n}" for n in sbd.ABBREVIATIONS), "mark_hot")])


def _codes_sql(low: int, high: int) -> str:
    return f"(case when pos + {low} < 0 then list_transform(range({high - low}), lambda k: 0) else list_transform(range({low}, {high}), lambda k: coalesce(unicode(c[pos + k + 1]), 0)) end)"


@query(f"with {_CH} select doc_id, pos::int as pos, array_to_string({_codes_sql(-5, 2)}, ',') as narrow, array_to_string({_codes_sql(-4, 6)}, ',') as wide from cand")
def sbd_windows(spark, sf_dir):
    return _cands(spark, sf_dir).select("doc_id", "pos", _joined(sbd.window_codes(-5, 2)).alias("narrow"), _joined(sbd.window_codes(-4, 6)).alias("wide"))


@query(f"""with {_CH}, cw as (select doc_id, pos, c[pos + 1] as mark, {_codes_sql(-5, 2)} as codes from cand), fit as (select list_sort(list(distinct mark)) as marks from cw where doc_id % 2 = 0), fit2 as (select list_sort(list(distinct x)) as codes from (select unnest(codes) as x from cw where doc_id % 2 = 0))
select doc_id, pos::int as pos, coalesce(list_position(fit.marks, mark), 0)::int as mark_place, array_to_string(list_transform(cw.codes, lambda x: coalesce(list_position(fit2.codes, x), 0)), ',') as code_places from cw, fit, fit2""")
def sbd_fitted_codes(spark, sf_dir):
    """Encoders fitted on documents with even ids and applied to all: where the 1 of each one-hot code stands, 0 for what was not seen."""
    rows = _cands(spark, sf_dir).select("doc_id", "pos", "mark", sbd.window_codes(-5, 2).alias("codes"))
    seen = rows.where("doc_id % 2 = 0")
    marks, codes = sbd.fit_classes(seen, "mark"), sbd.fit_classes(seen.select(F.explode("codes").alias("code")), "code")
    return rows.select("doc_id", "pos", sbd.class_place(F.col("mark"), marks).alias("mark_place"), _joined(sbd.class_places(F.col("codes"), codes)).alias("code_places"))


# ---------------------------------------------------------------- the walk to its end
_STEPS = 60
_LONG_WALK = _WALK.split(", p1 as")[0] + f", walk as (select doc_id, k, p, 0 as r from p0 union all select al.doc_id, al.j as k, sum(walk.p / deg) as p, walk.r + 1 as r from walk join al on walk.doc_id = al.doc_id and walk.k = al.i join deg on deg.doc_id = al.doc_id and deg.i = al.i where walk.r < {_STEPS} group by al.doc_id, al.j, walk.r)"


@query(f"with recursive {_GRAPH}, {_LONG_WALK} select doc_id, k as sent, round(p, 6) as score from walk where r = {_STEPS}")
def lexrank_long(spark, sf_dir):
    """So many steps that the walk has settled."""
    return rank.lexrank(documents(spark, sf_dir), rounds=_STEPS, eps=0.0).withColumn("score", F.round("score", 6))


@query()
def lexrank_converged(spark, sf_dir):
    """Scores at convergence, as the operator gives them."""
    return rank.lexrank(documents(spark, sf_dir)).withColumn("score", F.round("score", 6))


def _page_histogram(value: str, width: float, low: float, high: float):
    def run(spark, sf_dir):
        """Pages with a query string are the class."""
        pages = classify.page_features(table(spark, sf_dir, "pages").where("url is not null"), "html", "url")
        rows = pages.select(F.contains("url", F.lit("?")).alias("is_class"), value)
        return classify.histogram(rows, F.col(value), width, low, high)

    return run


for _name, _args in {"hist_title_words": ("title_words_num", 1, 0, 30), "hist_anchor_words": ("anchor_words_num", 10, 0, 300), "hist_ratio": ("compression_level", 0.01, 0, 1)}.items():
    query(name=_name)(_page_histogram(*_args))
