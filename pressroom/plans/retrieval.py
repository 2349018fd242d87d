"""Queries: text and vector retrieval, the fresh pool, candidate generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions.scalars import content_key, draw_sql
from ..functions.text import join_fields, join_stripped, tokens
from ..functions.vectors import dot
from ..operators import beyond, bm25, candidates, impressions, pool, semantic
from ..sources import adapters as A
from ..sources.adapters import ctes
from ..sources.shared import stored

K = config.CANDIDATES_K
r6 = lambda c: F.round(F.col(c) if isinstance(c, str) else c, 6)


def _docs(spark, sf):
    return A.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")


def _items(spark, sf):
    """Benchmark items as queries: q, term, qtf."""
    q = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), F.explode(tokens(F.col("text"))).alias("term"))
    return q.groupBy("q", "term").agg(F.count("*").alias("qtf"))


def tokenize_terms(spark, sf):
    return _docs(spark, sf).select(F.col("doc").alias("doc_id"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def text_fields(spark, sf):
    """Fields joined without and with the empty ones, and a key of the content."""
    c = A.catalogue(spark, sf)
    empty = F.when(F.col("art") % 3 == 0, "").otherwise(F.col("abstract"))
    return c.select("art", join_fields(F.col("title"), empty, F.col("category")).alias("joined"), join_stripped(F.col("title"), empty, F.col("category")).alias("stripped"), content_key(F.col("title"), F.col("abstract")).alias("key"))


def bm25_postings_stats(spark, sf):
    index = bm25.build(_docs(spark, sf))
    return index.terms.select("term", "df", r6("idf").alias("idf"))


def bm25_topk(spark, sf):
    return bm25.top_of_documents(_docs(spark, sf), _items(spark, sf), 10).select("q", F.col("doc").alias("doc_id"), "rank", r6("score").alias("score"))


def bm25_subset_score(spark, sf):
    """Each item against every document that is the best for some item, and one that isn't there."""
    docs, terms = _docs(spark, sf), _items(spark, sf)
    items = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("q"))
    best = stored(bm25.top_of_documents(docs, terms, 1).select("doc").distinct())  # one an item at most
    scores = bm25.score(bm25.of_some(docs, best, terms), terms)
    wanted = items.crossJoin(F.broadcast(best)).unionByName(items.select("q", F.lit(-1).cast("bigint").alias("doc")))
    return bm25.subset(scores, wanted).select("q", F.col("doc").alias("doc_id"), r6("score").alias("score"))


def _user_histories(spark, sf):
    """q (user), history (articles) as of the user's last impression."""
    last = A.histories(spark, sf, impressions.latest(A.orders(spark, sf), "usr"))
    return last.select(F.col("usr").alias("q"), F.transform("history", lambda x: x["art"]).alias("history"))


def _part_docs(spark, sf):
    return A.catalogue(spark, sf).select(F.col("art").alias("doc"), join_fields(F.col("title"), F.col("abstract")).alias("text"))


def _query(method):
    def run(spark, sf):
        index = bm25.build(_part_docs(spark, sf)) if method == "tfidf_keywords" else None
        return bm25.query_terms(_user_histories(spark, sf), A.catalogue(spark, sf), method, config.QUERY_WINDOW, index, config.KEYWORDS).select(F.col("q").alias("usr"), "term", "qtf")

    return run


query_direct, query_recency_weighted, query_tfidf = _query("direct"), _query("recency_weighted"), _query("tfidf_keywords")


def l2_normalise(spark, sf):
    e = F.col("e")
    return A.vectors(spark, sf).select("vec", F.round(F.get(e, F.lit(0)), 6).alias("first"), r6(F.aggregate(e, F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(dot(e, e)).alias("length"))


def embedding_coverage(spark, sf):
    v = A.vectors(spark, sf).select(F.col("vec").alias("art"), F.lit(1).alias("has"))
    return A.catalogue(spark, sf).join(v, "art", "left").agg(F.count("*").alias("articles"), F.count("has").alias("with_vector"))


def _vec_histories(spark, sf):
    n = A.table(spark, sf, "embeddings").count()
    return A.histories(spark, sf).where("size(history) > 0").select(F.col("imp").alias("q"), F.transform("history", lambda x: F.pmod(x["art"], F.lit(n))).alias("history"))


def _pool(method):
    def run(spark, sf):
        v = A.vectors(spark, sf)
        u = semantic.pooled(_vec_histories(spark, sf), v, method)
        e = F.col("e")
        return u.select(F.col("q").alias("imp"), r6(F.get(e, F.lit(0))).alias("first"), r6(F.get(e, F.lit(63))).alias("last"), r6(F.aggregate(e, F.lit(0.0), lambda a, x: a + x)).alias("total"))

    return run


user_mean_pool, user_max_pool, user_decay_pool = _pool("mean"), _pool("max"), _pool("decay")


def cosine_topk(spark, sf):
    """Each vector's nearest ten, itself included."""
    v = A.vectors(spark, sf)
    return semantic.cosine_top(v.select(F.col("vec").alias("q"), "e"), v, 10).select("q", "vec", "rank", r6("score").alias("score"))


def _times(spark, sf):
    return A.events(spark, sf).where("kind = 'view'").select("event_id", "t")


def fresh_pool_window(spark, sf):
    d = A.displays(spark, sf)
    return pool.at_times(pool.segments(d, 6, 24, 10), _times(spark, sf).select("t").distinct()).select("t", "art", F.col("shown").cast("bigint").alias("shown"), F.col("shown_back").cast("bigint").alias("shown_back"), F.col("clicked").cast("bigint").alias("clicked"))


def _ranked(spark, sf, hours=6):
    d = A.displays(spark, sf)
    return pool.ranked(pool.at_times(pool.segments(d, hours, 24, 10), _times(spark, sf).select("t").distinct()), K)


def fresh_pool_popular(spark, sf):
    return _ranked(spark, sf).where("not backfill").select("t", "art", "rank", "score")


def fresh_pool_backfill(spark, sf):
    return _ranked(spark, sf, 1).where("backfill").select("t", "art", "rank", "score")


def candidates_popular(spark, sf):
    """Impressions are views; used_fallback tells that the longer window was drawn on."""
    out = candidates.build("popular", _times(spark, sf).withColumnRenamed("event_id", "q"), A.displays(spark, sf), K, 6)
    return out.select(F.col("q").alias("imp"), F.array_join(F.col("candidates").cast("array<string>"), " ").alias("candidates"), F.size("candidates").cast("bigint").alias("n"), "used_fallback")


def _bm25_lists(spark, sf):
    """q, list: the query's best documents as (art, rank, score), in the order of rank."""
    index = bm25.build(_part_docs(spark, sf))
    q = bm25.query_terms(_user_histories(spark, sf), A.catalogue(spark, sf), "tfidf_keywords", config.QUERY_WINDOW, index, config.KEYWORDS)
    lists, members = bm25.lists_of_distinct(index, q, K)
    return members.join(lists, "rep").select("q", "list")


def _users(spark, sf):
    return A.orders(spark, sf).select(F.col("usr").alias("q")).distinct()


def candidates_bm25(spark, sf):
    index = bm25.build(_part_docs(spark, sf))
    out = candidates.bm25(_users(spark, sf), _user_histories(spark, sf), A.catalogue(spark, sf), A.shown(spark, sf), index, K)
    return out.select(F.col("q").alias("usr"), "art", "rank", "score", "used_fallback")


def candidates_semantic(spark, sf):
    n = A.table(spark, sf, "embeddings").count()
    h = _user_histories(spark, sf).where("size(history) > 0").select("q", F.transform("history", lambda x: F.pmod(x, F.lit(n))).alias("history"))
    out = candidates.semantic_(_users(spark, sf), h, A.vectors(spark, sf), A.shown(spark, sf), K)
    return out.select(F.col("q").alias("usr"), "art", "rank", "score", "used_fallback")


def candidates_bm25_fresh(spark, sf):
    """The pool ranked by BM25 of the user's purchased articles, ties by draw, then the backfill; without a query, as in popular."""
    h = A.events(spark, sf).where("kind = 'purchase'").groupBy("usr").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "art"))), lambda x: x["art"]).alias("history")).withColumnRenamed("usr", "q")
    views = A.events(spark, sf).where("kind = 'view'").select(F.col("event_id").alias("q"), "usr", "t")
    out = candidates.bm25_fresh(views, h, A.catalogue(spark, sf), A.displays(spark, sf), bm25.build(_part_docs(spark, sf)), K, hours=6)
    return out.select(F.col("q").alias("imp"), "art", "rank", "score", "used_fallback")


def candidates_long(spark, sf):
    """Wide and long again: scores go through float."""
    wide = _bm25_lists(spark, sf).select("q", F.col("list.art").alias("candidates"), F.col("list.score").cast("array<float>").alias("scores"))
    return pool.long(wide).select(F.col("q").alias("usr"), "art", "rank", F.round(F.col("score").cast("double"), 4).alias("score"))


def intra_list_diversity(spark, sf):
    n = A.table(spark, sf, "embeddings").count()
    lists = A.shown(spark, sf).groupBy("imp").agg(F.collect_list(F.pmod("art", F.lit(n))).alias("vecs"))
    return beyond.diversity(lists, A.vectors(spark, sf)).select("imp", r6("diversity").alias("diversity"))


QUERIES = {f.__name__: f for f in (
    tokenize_terms, text_fields, bm25_postings_stats, bm25_topk, bm25_subset_score, l2_normalise, embedding_coverage, cosine_topk, fresh_pool_window, fresh_pool_popular, fresh_pool_backfill,
    candidates_popular, candidates_bm25, candidates_semantic, candidates_bm25_fresh, candidates_long, intra_list_diversity,
)} | {"query_direct": query_direct, "query_recency_weighted": query_recency_weighted, "query_tfidf": query_tfidf, "user_mean_pool": user_mean_pool, "user_max_pool": user_max_pool, "user_decay_pool": user_decay_pool}

_TOK = r"regexp_extract_all(lower({}), '([\p{{L}}\p{{N}}_]+)')"


def _index(docs: str) -> str:
    """Common table expressions of BM25 over docs (doc, text)."""
    return f"""tk as (select doc, {_TOK.format('text')} w from ({docs})), st as (select count(*) n, avg(len(w)) avgdl from tk),
po as (select term, doc, count(*) tf, max(l) len from (select doc, len(w) l, unnest(w) term from tk) group by term, doc),
te as (select term, count(*) df, ln(((select n from st) - count(*) + 0.5) / (count(*) + 0.5) + 1) idf from po group by term)"""


_DOCS = _index("select doc_id doc, text from documents")
_PARTS = _index("select p_partkey doc, concat_ws(' ', nullif(p_name, ''), nullif(p_type, '')) as text from part")
_ITEMS = f"qt as (select q, term, count(*) qtf from (select item_id q, unnest({_TOK.format('text')}) term from benchmark) group by q, term)"
_SCORE = "sc as (select q, doc, round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)))), 9) score from qt join te using (term) join po using (term), st group by q, doc)"
_TOP = f"tp as (select q, doc art, row_number() over (partition by q order by score desc, doc) rank, score from sc where score > 0 qualify rank <= {K})"
_USER = ctes("orders", "shown", "history") + ", la as (select usr q, imp from ord qualify row_number() over (partition by usr order by t desc, imp desc) = 1), uh as (select q, art, row_number() over (partition by q order by i) k, count(*) over (partition by q) n from hist join la using (imp)), uw as (select q, art, k - greatest(n - 10, 0) i from uh where k > n - 10)"
_WORDS = f"tw as (select p_partkey art, {_TOK.format('p_name')} w from part), fl as (select q, i, unnest(w) term, generate_subscripts(w, 1) j from uw join tw using (art))"
_KEYS = "ky as (select q, term, count(*) tf, min(i * 10000 + j) at_ from fl group by q, term), qt as (select q, term, cast(1 as bigint) qtf from ky join te using (term) qualify row_number() over (partition by q order by round(tf * idf, 9) desc, at_) <= 10)"
_PAD = f"""qs as (select distinct usr q from ord), hv as (select q, list(art) has, count(*) n from tp group by q),
pp as (select art, row_number() over (order by sum(label) desc, art) pr from shown group by art qualify pr <= {2 * K}),
fi as (select q, art, coalesce(n, 0) + row_number() over (partition by q order by pr) rank from qs left join hv using (q), pp where not coalesce(list_contains(has, art), false) and coalesce(n, 0) < {K}),
al as (select q, art, rank, score from tp union all select q, art, rank, 0.0 from fi where rank <= {K})
select q usr, art, rank, score, hv.q is null used_fallback from al left join hv using (q)"""
_VECH = ctes("orders", "shown", "history", "vectors") + ", m as (select count(*) m from embeddings), hv0 as (select imp q, ((art % m) + m) % m vec, pow(0.7, n - i) w from hist, m)"
_UNIT = "pl as (select q, list(x order by d) v from dm group by q), un as (select q, [x / case when s = 0 then 1 else s end for x in v] e from (select q, v, sqrt(list_sum([x * x for x in v])) s from pl))"


def _pool_sql(agg: str, head: str = _VECH) -> str:
    return f"{head}, ds as (select q, w, unnest(e) x, generate_subscripts(e, 1) d from hv0 join vec using (vec)), dm as (select q, d, {agg} x from ds group by q, d), {_UNIT}"


_POOLED = " select q imp, round(e[1], 6) first, round(e[64], 6) last, round(list_sum(e), 6) total from un"
_H = 3_600_000_000


def _pool_at(w: int) -> str:
    return ctes("events", "displays") + f""", ts as (select distinct t from ev where kind = 'view'),
fp as (select q.t, art, count(*) filter (e.t >= q.t - {w * _H}) shown, count(*) shown_back, count(*) filter (click = 1 and e.t >= q.t - {w * _H} and e.t < q.t - 600000000) clicked from ts q join dis e on e.t < q.t and e.t >= q.t - {24 * _H} group by q.t, art),
rk as (select *, cast(shown = 0 as int) tier, row_number() over (partition by t order by cast(shown = 0 as int), case when shown = 0 then shown_back else clicked end desc, shown desc, art) rank from fp qualify rank <= {K})"""


ORACLES = {
    "tokenize_terms": f"select doc_id, term, count(*) tf from (select doc_id, unnest({_TOK.format('text')}) term from documents) group by all",
    "text_fields": "with p as (select *, case when p_partkey % 3 = 0 then '' else p_type end y from part) select p_partkey art, concat_ws(' ', nullif(p_name, ''), nullif(y, ''), nullif(p_brand, '')) joined, trim(p_name || ' ' || y || ' ' || p_brand) stripped, substr(sha1(p_name || '|' || p_type), 1, 10) \"key\" from p",
    "bm25_postings_stats": f"with {_DOCS} select term, df, round(idf, 6) idf from te",
    "bm25_topk": f"with {_DOCS}, {_ITEMS}, {_SCORE} select q, doc doc_id, row_number() over (partition by q order by score desc, doc) rank, round(score, 6) score from sc where score > 0 qualify rank <= 10",
    "bm25_subset_score": f"with {_DOCS}, {_ITEMS}, {_SCORE}, be as (select distinct doc from (select doc from sc where score > 0 qualify row_number() over (partition by q order by score desc, doc) = 1)), wa as (select item_id q, doc from benchmark, be union all select item_id, -1 from benchmark) select wa.q, wa.doc doc_id, round(coalesce(score, 0.0), 6) score from wa left join sc on wa.q = sc.q and wa.doc = sc.doc",
    "query_direct": f"{_USER}, {_WORDS} select q usr, term, count(*) qtf from fl group by q, term",
    "query_recency_weighted": f"{_USER}, {_WORDS} select q usr, term, cast(sum(i) as bigint) qtf from fl group by q, term",
    "query_tfidf": f"{_USER}, {_WORDS}, {_PARTS}, {_KEYS} select q usr, term, qtf from qt",
    "l2_normalise": ctes("vectors") + " select vec, round(e[1], 6) first, round(list_sum(e), 6) total, round(list_sum([x * x for x in e]), 6) length from vec",
    "embedding_coverage": "select count(*) articles, count(vec_id) with_vector from part left join embeddings on p_partkey = vec_id",
    "user_mean_pool": _pool_sql("avg(x)") + _POOLED,
    "user_max_pool": _pool_sql("max(x)") + _POOLED,
    "user_decay_pool": _pool_sql("sum(x * w) / sum(w)") + _POOLED,
    "cosine_topk": ctes("vectors") + ", s as (select a.vec q, b.vec, round(list_dot_product(a.e, b.e), 9) score from vec a, vec b) select q, vec, row_number() over (partition by q order by score desc, vec) rank, round(score, 6) score from s qualify rank <= 10",
    "fresh_pool_window": _pool_at(6) + " select t, art, shown, shown_back, clicked from fp",
    "fresh_pool_popular": _pool_at(6) + " select t, art, rank, cast(clicked as double) score from rk where tier = 0",
    "fresh_pool_backfill": _pool_at(1) + " select t, art, rank, 0.0::double score from rk where tier = 1",
    "candidates_popular": _pool_at(6) + " select event_id imp, string_agg(cast(rk.art as varchar), ' ' order by rank) candidates, count(*) n, bool_or(tier = 1) used_fallback from ev join rk using (t) where kind = 'view' group by event_id",
    "candidates_bm25": f"{_USER}, {_WORDS}, {_PARTS}, {_KEYS}, {_SCORE}, {_TOP}, {_PAD}",
    "candidates_semantic": _pool_sql("avg(x)", ctes("orders", "shown", "history", "vectors") + ", m as (select count(*) m from embeddings), la as (select usr q, imp from ord qualify row_number() over (partition by usr order by t desc, imp desc) = 1), hv0 as (select q, ((art % m) + m) % m vec, 1.0 w from hist join la using (imp), m)")
    + f", sc as (select q, vec, round(list_dot_product(un.e, vec.e), 9) score from un, vec), tp as (select q, vec art, row_number() over (partition by q order by score desc, vec) rank, score from sc qualify rank <= {K}), {_PAD}",
    "candidates_bm25_fresh": _pool_at(6) + f""", pu as (select usr q, art, row_number() over (partition by usr order by t, art) k, count(*) over (partition by usr) n from ev where kind = 'purchase'), uw as (select q, art, k - greatest(n - 10, 0) i from pu where k > n - 10), {_WORDS}, {_PARTS}, {_KEYS}, {_SCORE},
has as (select distinct q from qt), x as (select event_id imp, fp.art, usr, shown, shown_back, clicked, has.q is not null own, case when shown = 0 then 0.0 when has.q is not null then coalesce(sc.score, 0.0) else clicked end s
  from ev join fp using (t) left join has on usr = has.q left join sc on usr = sc.q and fp.art = sc.doc where kind = 'view')
select imp, art, row_number() over (partition by imp order by cast(shown = 0 as int), s desc, case when shown = 0 then -shown_back when own then {draw_sql(0, 'imp', 'art')} else -shown end, art) rank, round(s, 6) score, not own used_fallback from x qualify rank <= {K}""",
    "candidates_long": f"{_USER}, {_WORDS}, {_PARTS}, {_KEYS}, {_SCORE}, {_TOP} select q usr, art, rank, round(cast(cast(score as float) as double), 4) score from tp",
    "intra_list_diversity": ctes("orders", "shown", "vectors") + ", m as (select count(*) m from embeddings), l as (select imp, pos, e from shown, m, vec where vec = art % m) select o.imp, round(1 - avg(list_dot_product(a.e, b.e)), 6) diversity from (select distinct imp from shown) o left join l a on o.imp = a.imp left join l b on o.imp = b.imp and a.pos < b.pos group by o.imp",
}
