"""The registered queries of the engine's own operators and the SQL that they are compared with.

Passages are ``documents`` (id = doc_id), their vectors ``embeddings`` (vec_id = doc_id), and metadata both the
typed columns of documents and the JSON in ``chunks.metadata`` and ``events.props``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions import vector as vx
from plumbline.operators import bm25, expansion, hybrid, rag, vectors
from plumbline.operators.filters import Json, Typed, compile_filter
from plumbline.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

QUERY = "vector database search"
PROBE = 7  # vec_id of the query vector
ALPHA = 0.7
BATCH = [(1, "vector database"), (2, "the index of the archive"), (3, "hybrid search score"), (4, "rust"), (5, "nothing zzzyx")]


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """The documents for work on their texts."""
    return table(spark, d, "documents", "doc_id")


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def probe(spark: SparkSession, d: str) -> list[float]:
    return vecs(spark, d).where(F.col("vec_id") == PROBE).select("embedding").first()[0]


# text and BM25 --------------------------------------------------------------------------------------------------

_TOKENS = "list_filter(list_transform(regexp_extract_all({0}, '[a-zA-Z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 1)"
_T = f"t AS (SELECT doc_id, {_TOKENS.format('text')} AS toks FROM documents)"


def _bm25_sql(where: str = "true", query_: str = QUERY) -> str:
    terms = ", ".join(f"('{t}')" for t in bm25.query_tokens(query_))
    return f"""pool AS (SELECT * FROM documents WHERE {where}),
q AS (SELECT term, count(*) AS qtf FROM (VALUES {terms}) v(term) GROUP BY term),
tok AS (SELECT doc_id, coalesce({_TOKENS.format("text")}, []) AS toks FROM pool),
stat AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM tok),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
part AS (SELECT tf.doc_id, qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avgdl)) AS s
  FROM tf JOIN df USING (term) JOIN q USING (term) JOIN tok USING (doc_id) CROSS JOIN stat),
bm AS (SELECT tok.doc_id, coalesce(sum(s), 0.0) AS score FROM tok LEFT JOIN part USING (doc_id) GROUP BY 1)"""


@query(f"WITH {_T} SELECT doc_id, coalesce(len(toks), -1)::BIGINT AS n_tokens, coalesce(len(list_distinct(toks)), -1)::BIGINT AS n_distinct FROM t")
def tokenize_docs(spark, d):
    t = texts(spark, d).select("doc_id", tx.tokens("text").alias("t"))
    return t.select("doc_id", F.coalesce(F.size("t"), F.lit(-1)).cast("long").alias("n_tokens"), F.coalesce(F.size(F.array_distinct("t")), F.lit(-1)).cast("long").alias("n_distinct"))


@query(f"WITH {_T} SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM t) GROUP BY 1, 2")
def term_frequencies(spark, d):
    return bm25.term_frequencies(texts(spark, d), "doc_id")


@query(f"WITH {_T} SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(toks) AS term FROM t) GROUP BY 1")
def term_doc_freq(spark, d):
    return bm25.document_frequencies(bm25.term_frequencies(texts(spark, d), "doc_id"))


@query(f"WITH {_T} SELECT count(*) AS n, coalesce(sum(len(toks)), 0)::BIGINT AS total_tokens, round(avg(coalesce(len(toks), 0)), 6) AS avgdl FROM t")
def corpus_stats(spark, d):
    return bm25.corpus_stats(texts(spark, d), "doc_id").withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH {_T} SELECT doc_id, coalesce(len(toks), 0)::BIGINT AS dl FROM t")
def document_lengths(spark, d):
    return bm25.document_lengths(texts(spark, d), "doc_id")


@query(f"WITH {_bm25_sql()} SELECT doc_id, round(score, 4) AS score FROM bm")
def bm25_scores_all(spark, d):
    return bm25.scores(texts(spark, d), QUERY, "doc_id").select("doc_id", F.round("score", 4).alias("score"))


@query(f"WITH {_bm25_sql()} SELECT doc_id, round(score, 4) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM bm WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def bm25_topk(spark, d):
    return bm25.search(texts(spark, d), QUERY, 10, "doc_id").select("doc_id", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {_bm25_sql(query_='search search index')} SELECT doc_id, round(score, 4) AS score FROM bm")
def bm25_dup_terms(spark, d):
    return bm25.scores(texts(spark, d), "search search index", "doc_id").select("doc_id", F.round("score", 4).alias("score"))


_BATCH_SQL = ", ".join(f"({i}, '{q}')" for i, q in BATCH)


@query(
    f"""WITH {_T}, qs AS (SELECT * FROM (VALUES {_BATCH_SQL}) v(query_id, query)),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKENS.format("query")}) AS term FROM qs) GROUP BY 1, 2),
stat AS (SELECT count(*)::DOUBLE AS n, avg(coalesce(len(toks), 0)) AS avgdl FROM t),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, tf.doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term) JOIN t USING (doc_id) CROSS JOIN stat GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id::INT AS query_id, doc_id, round(score, 4) AS score, rank::INT AS rank FROM r WHERE rank <= 10"""
)
def bm25_batch(spark, d):
    own = texts(spark, d)
    asked = spark.createDataFrame(BATCH, "query_id int, query string")
    found = bm25.search_many(bm25.term_frequencies(own, "doc_id"), bm25.document_lengths(own, "doc_id"), asked, 10, "doc_id")
    return found.select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


# vectors --------------------------------------------------------------------------------------------------------

_DOT = "round(list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9)"
_PROBED = f"FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {PROBE}) p"


@query(f"SELECT vec_id, {_DOT} AS score, row_number() OVER (ORDER BY {_DOT} DESC, vec_id)::INT AS rank {_PROBED} ORDER BY {_DOT} DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return vectors.top_k(vecs(spark, d), probe(spark, d), 10, "vec_id").select("vec_id", "score", "rank")


@query(f"SELECT vec_id, round(1 - list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS distance {_PROBED}")
def vector_distance(spark, d):
    q = vx.literal(probe(spark, d))
    return vecs(spark, d).select("vec_id", F.round(1 - vx.dot("embedding", q), 9).alias("distance"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_dot_product(embedding::DOUBLE[], qe::DOUBLE[]), 9) AS score FROM embeddings CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, rank::INT AS rank FROM r WHERE rank <= 10"""
)
def vector_topk_batch(spark, d):
    own = vecs(spark, d)
    asked = own.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.top_k_many(own, asked, 10, "vec_id").select("query_id", "vec_id", "score", "rank")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return vecs(spark, d).select("vec_id", F.round(vx.norm("embedding"), 6).alias("norm"))


@query(
    """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, greatest(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 1e-12) AS norm FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(v, lambda x, i: i * x / norm)), 5) AS weighted, round(v[1] / norm, 6) AS first FROM n"""
)
def vector_normalize(spark, d):
    v = vecs(spark, d).select("vec_id", vx.normalized("embedding").alias("v"))
    return v.select("vec_id", F.round(_weighted("v"), 5).alias("weighted"), F.round(F.col("v")[0], 6).alias("first"))


def _weighted(vector: str):
    """A sum in which every element counts by its place."""
    return F.aggregate(F.transform(vector, lambda x, i: (i + 1) * x.cast("double")), F.lit(0.0), lambda s, x: s + x)


@query(
    """SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x, i: i * CASE WHEN vec_id % 2 = 1 THEN (x + embedding[65 - i]::DOUBLE) / 2 ELSE x END)), 5) AS weighted FROM embeddings"""
)
def mean_pooling(spark, d):
    tokens = F.array(F.col("embedding"), F.reverse("embedding"))
    mask = F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"))
    return vecs(spark, d).select("vec_id", vx.mean_pooled(tokens, mask, 64).alias("v")).select("vec_id", F.round(_weighted("v"), 5).alias("weighted"))


@query()
def ivf_topk(spark, d):
    """The approximate answers to the queries of vector_topk_batch."""
    own = vecs(spark, d)
    asked = own.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vectors.InvertedFile.build(own, "vec_id", lists=16)
    return index.search_many(asked, 10, complexity=128).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


# metadata filters -----------------------------------------------------------------------------------------------

FILTERS = {
    "filter_eq": ("lang=en", "lang = 'en'"),
    "filter_ne": ("lang!=en", "lang IS NULL OR lang <> 'en'"),
    "filter_gt": ("n_chars>3000", "n_chars > 3000"),
    "filter_gte": ("n_chars>=1000", "n_chars >= 1000"),
    "filter_lt": ("n_chars<500", "n_chars < 500"),
    "filter_lte": ("n_chars<=500", "n_chars <= 500"),
    "filter_in": ("source in [wiki,forum,blog]", "source IN ('wiki', 'forum', 'blog')"),
    "filter_not_in": ("source not_in [wiki,forum,blog]", "source IS NULL OR source NOT IN ('wiki', 'forum', 'blog')"),
    "filter_contains": ("path~/stream/", "contains(path, '/stream/')"),
    "filter_starts": ("path^harbor", "starts_with(path, 'harbor')"),
    "filter_ends": ("path:*.md", "ends_with(path, '.md')"),
    "filter_star_contains": ("path:*queue*", "contains(path, 'queue')"),
    "filter_star_starts": ("source:crawl*", "starts_with(source, 'crawl')"),
    "filter_exists": ("path?", "path IS NOT NULL"),
    "filter_missing_field": ("absent?", "false"),
    "filter_missing_ne": ("absent!=1", "true"),
    "filter_and": ("lang=en,n_chars>500,path$.md", "lang = 'en' AND n_chars > 500 AND ends_with(path, '.md')"),
    "filter_and_word": ("lang=de AND n_chars<2000", "lang = 'de' AND n_chars < 2000"),
    "filter_or": ("lang=fr OR source=wiki AND n_chars>100", "lang = 'fr' OR (source = 'wiki' AND n_chars > 100)"),
    "filter_type_mismatch": ("n_chars>=abc,lang<=5", "n_chars IS NOT NULL AND lang IS NOT NULL"),
    "filter_type_mismatch_gt": ("n_chars>abc OR lang=5", "false"),
}


def _filter_query(name: str, text: str, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        own = docs(spark, d)
        return own.where(compile_filter(text, Typed(own))).select("doc_id")

    QUERIES[name] = run
    SQL[name] = f"SELECT doc_id FROM documents WHERE {where}"


for _name, (_text, _where) in FILTERS.items():
    _filter_query(_name, _text, _where)

_META = "SELECT chunk_id, ingested_at, CASE WHEN json_valid(metadata) THEN metadata::JSON END AS m FROM chunks"
JSON_FILTERS = {
    "filter_json_number": ("start_line>50", "TRY_CAST(m->>'start_line' AS DOUBLE) > 50"),
    "filter_json_in": ("language in [rust,go],chunk_type=ast", "m->>'language' IN ('rust', 'go') AND m->>'chunk_type' = 'ast'"),
    "filter_json_not_in": ("language not_in [rust,go]", "m->>'language' IS NULL OR m->>'language' NOT IN ('rust', 'go')"),
    "filter_json_mismatch": ("language>=5", "json_type(m, '$.language') IS NOT NULL"),
    "filter_json_strict_eq": ("start_line=abc OR language=5", "false"),
    "filter_json_exists": ("part?", "json_type(m, '$.part') IS NOT NULL"),
    "filter_json_ends": ("source:*.py", "ends_with(m->>'source', '.py')"),
    "filter_json_text_order": ("language>java", "m->>'language' > 'java'"),
}


def _json_query(name: str, text: str | dict, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "chunks").where(compile_filter(text, Json("metadata"))).select("chunk_id", "ingested_at")

    QUERIES[name] = run
    SQL[name] = f"SELECT chunk_id, ingested_at FROM ({_META}) WHERE {where}"


for _name, (_text, _where) in JSON_FILTERS.items():
    _json_query(_name, _text, _where)
_json_query(
    "filter_json_form",
    {"and": [{"field": "chunk_type", "op": "eq", "value": "ast"}, {"or": [{"field": "start_line", "op": "lte", "value": 10}, {"field": "name", "op": "startswith", "value": "s"}]}]},
    "m->>'chunk_type' = 'ast' AND (TRY_CAST(m->>'start_line' AS DOUBLE) <= 10 OR coalesce(starts_with(m->>'name', 's'), false))",
)


@query("SELECT event_id FROM events WHERE TRY_CAST(props->>'k' AS DOUBLE) > 50")
def filter_json_events(spark, d):
    return table(spark, d, "events").where(compile_filter("k>50", Json("props"))).select("event_id")


@query("""SELECT chunk_id, ingested_at, m->>'a' IS NULL AS missing FROM (SELECT chunk_id, ingested_at, json_object('a', json_object('b', chunk_id)) AS o, '{}'::JSON AS m FROM chunks) WHERE (o->'a'->>'b')::BIGINT > 100""")
def filter_json_nested(spark, d):
    own = table(spark, d, "chunks").withColumn("o", F.to_json(F.struct(F.struct(F.col("chunk_id").alias("b")).alias("a"))))
    return own.where(compile_filter("a.b>100", Json("o"))).select("chunk_id", "ingested_at", F.lit(True).alias("missing"))


# search ---------------------------------------------------------------------------------------------------------


def _prefilter_sql(where: str, k: int) -> str:
    return f"""SELECT d.doc_id, {_DOT} AS score FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id
CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {PROBE}) p WHERE {where} ORDER BY {_DOT} DESC, d.doc_id LIMIT {k}"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return vecs(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding")


@query(_prefilter_sql("lang = 'en' AND n_chars > 500", 10))
def prefilter_knn(spark, d):
    from plumbline.operators.search import SearchOptions, search

    found = search(docs(spark, d), _vectors(spark, d), probe(spark, d), SearchOptions(10, filter="lang=en,n_chars>500"), key="doc_id")
    return found.select("doc_id", "score")


@query(
    f"""WITH near AS (SELECT e.vec_id, {_DOT} AS score {_PROBED} ORDER BY score DESC, e.vec_id LIMIT 50)
SELECT doc_id, score FROM near JOIN documents ON doc_id = vec_id WHERE lang = 'en' AND n_chars > 500 ORDER BY score DESC, doc_id LIMIT 10"""
)
def postfilter_knn(spark, d):
    from plumbline.operators.search import SearchOptions, search

    found = search(docs(spark, d), _vectors(spark, d), probe(spark, d), SearchOptions(10, filter="lang=en,n_chars>500", post_filter=True), key="doc_id")
    return found.select("doc_id", "score")


def _hybrid_sql(where: str | None, k: int, alpha: float = ALPHA) -> str:
    """Without a filter vectors of missing passages are ranked too and dropped at the end."""
    within = "WHERE e.vec_id IN (SELECT doc_id FROM pool)" if where else ""
    return f"""WITH {_bm25_sql(where or 'true')},
near AS (SELECT e.vec_id AS doc_id, {_DOT} AS v {_PROBED} {within} ORDER BY v DESC, doc_id LIMIT {5 * k}),
best AS (SELECT doc_id FROM bm WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT {5 * k}),
cand AS (SELECT doc_id, v FROM near UNION ALL SELECT doc_id, 0.0 FROM best WHERE doc_id NOT IN (SELECT doc_id FROM near)),
span AS (SELECT min(score) AS lo, max(score) AS hi FROM bm), vs AS (SELECT min(v) AS lo, max(v) AS hi FROM cand),
f AS (SELECT cand.doc_id, v, {alpha} * (v - vs.lo) / greatest(vs.hi - vs.lo, 1e-6) + {1 - alpha} * (coalesce(score, 0) - span.lo) / greatest(span.hi - span.lo, 1e-6) AS score
  FROM cand LEFT JOIN bm USING (doc_id) CROSS JOIN vs CROSS JOIN span)
SELECT f.doc_id, round(f.score, 6) AS score, (row_number() OVER (ORDER BY round(f.score, 9) DESC, v DESC, f.doc_id))::INT AS rank FROM f JOIN pool USING (doc_id)
QUALIFY row_number() OVER (ORDER BY round(f.score, 9) DESC, v DESC, f.doc_id) <= {k}"""


def _hybrid(spark: SparkSession, d: str, condition: str | None, k: int, alpha: float = ALPHA) -> DataFrame:
    from plumbline.operators.search import SearchOptions, search

    found = search(texts(spark, d), _vectors(spark, d), probe(spark, d), SearchOptions(k, filter=condition, hybrid=True, hybrid_alpha=alpha, query_text=QUERY), key="doc_id")
    return found.select("doc_id", F.round("score", 6).alias("score"), "rank")


@query(_hybrid_sql("lang = 'en' AND n_chars > 500", 10))
def hybrid_search_filtered(spark, d):
    """The flagship: filter, exact vector ranking, BM25 over the same pool, fusion, late materialisation."""
    return _hybrid(spark, d, "lang=en AND n_chars>500", 10)


@query(_hybrid_sql(None, 10))
def hybrid_search(spark, d):
    return _hybrid(spark, d, None, 10)


@query(_hybrid_sql("source = 'wiki'", 5, 0.0))
def hybrid_text_only(spark, d):
    """Alpha 0: the order of BM25 among the candidates."""
    return _hybrid(spark, d, "source=wiki", 5, 0.0)


@query(_hybrid_sql("source = 'wiki'", 5, 1.0))
def hybrid_vector_only(spark, d):
    """Alpha 1: the order of the vectors among the candidates."""
    return _hybrid(spark, d, "source=wiki", 5, 1.0)


@query(
    f"""WITH {_bm25_sql()}, span AS (SELECT min(score) AS lo, max(score) AS hi FROM bm)
SELECT doc_id, round((score - lo) / greatest(hi - lo, 1e-6), 6) AS scaled FROM bm CROSS JOIN span"""
)
def minmax_normalize(spark, d):
    s = bm25.scores(texts(spark, d), QUERY, "doc_id")
    span = s.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi")))
    return s.withColumn("_s", span.scalar()).select("doc_id", F.round(hybrid.minmax(F.col("score"), F.col("_s.lo"), F.col("_s.hi")), 6).alias("scaled"))


@query(
    f"""WITH {_bm25_sql()}, near AS (SELECT e.vec_id AS doc_id, {_DOT} AS score {_PROBED} ORDER BY score DESC, doc_id LIMIT 25),
best AS (SELECT doc_id FROM bm WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT 25)
SELECT doc_id, score FROM near UNION ALL SELECT doc_id, 0.0 FROM best WHERE doc_id NOT IN (SELECT doc_id FROM near)"""
)
def candidate_union(spark, d):
    near = vectors.top_k(_vectors(spark, d), probe(spark, d), 25, "doc_id").select("doc_id", "score")
    best = bm25.search(texts(spark, d), QUERY, 25, "doc_id")
    return hybrid.candidates_of(near, best, "doc_id").select("doc_id", "score")


@query()
def recompute_topk(spark, d):
    from plumbline.operators.embed import HashingProvider, embed_column, embed_query
    from plumbline.operators.search import recompute_search

    own = HashingProvider(64)
    found = recompute_search(texts(spark, d), embed_query(own, QUERY), lambda t: embed_column(own, t), 10, key="doc_id", filter="lang=en")
    return found.select("doc_id", F.round("score", 6).alias("score"), "rank")


# joins, ids, updates --------------------------------------------------------------------------------------------


@query("SELECT e.vec_id, e.label, d.lang, length(d.text) AS chars FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 50 = 0")
def passage_lookup(spark, d):
    """The whole join. Its SQL only knows every fiftieth vector."""
    hits = vecs(spark, d).select("vec_id", "label")
    return hits.join(docs(spark, d), F.col("doc_id") == F.col("vec_id")).select("vec_id", "label", "lang", F.length("text").cast("long").alias("chars"))


@query("SELECT v.vec_id, coalesce(c.id, v.vec_id::VARCHAR) AS id FROM (SELECT DISTINCT vec_id FROM vectors) v LEFT JOIN (SELECT chunk_id, arg_max(id, ingested_at) AS id FROM chunks GROUP BY 1) c ON c.chunk_id = v.vec_id")
def position_ids(spark, d):
    from plumbline.sources.exchange import positions_to_ids

    ids = table(spark, d, "chunks").groupBy(F.col("chunk_id").alias("ordinal")).agg(F.max_by("id", "ingested_at").alias("id"))
    return positions_to_ids(table(spark, d, "vectors").select(F.col("vec_id").alias("ordinal")).distinct(), ids).select(F.col("ordinal").alias("vec_id"), "id")


@query("SELECT chunk_id, arg_max(index_name, ingested_at) AS index_name, max(ingested_at) AS ingested_at FROM chunks GROUP BY 1")
def latest_passages(spark, d):
    return table(spark, d, "chunks").groupBy("chunk_id").agg(F.max_by("index_name", "ingested_at").alias("index_name"), F.max("ingested_at").alias("ingested_at"))


@query("SELECT doc_id, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS id FROM documents")
def sequential_ids(spark, d):
    from plumbline.operators.ids import numbered

    return numbered(docs(spark, d).select("source", "doc_id"), ["source", "doc_id"]).select("doc_id", "id")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) + (SELECT max(chunk_id) FROM chunks) AS id FROM documents")
def update_ids(spark, d):
    """Ids of an update go on after the last id of the index."""
    from plumbline.operators.ids import numbered

    last = table(spark, d, "chunks").agg(F.max("chunk_id")).first()[0] or 0
    return numbered(docs(spark, d).select("doc_id"), ["doc_id"], start=last + 1)


@query("SELECT m.index_name, m.passage_count AS stated, coalesce(c.n, 0) AS counted, m.dimensions FROM index_meta m LEFT JOIN (SELECT index_name, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY 1) c USING (index_name)")
def index_status(spark, d):
    counted = table(spark, d, "chunks").groupBy("index_name").agg(F.countDistinct("chunk_id").alias("n"))
    return table(spark, d, "index_meta").join(counted, "index_name", "left").select("index_name", F.col("passage_count").alias("stated"), F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("counted"), "dimensions")


# expansion and symbols ------------------------------------------------------------------------------------------

_CODE_LIKE = "contains(w, '_') OR (regexp_matches(w, '[0-9]') AND regexp_matches(w, '[\\p{L}\\p{M}]')) OR w IN (" + ", ".join(f"'{x}'" for x in tx.CODE_WORDS) + ")"
_STOP = ", ".join(f"'{x}'" for x in tx.STOPWORDS)


@query(
    f"""WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS w FROM documents)
SELECT w AS term, count(*) AS cnt FROM w WHERE strlen(w) >= 4 AND w NOT IN ({_STOP}) AND NOT regexp_matches(w, '^\\p{{N}}+$') AND NOT ({_CODE_LIKE}) GROUP BY 1 ORDER BY cnt DESC, term LIMIT 50"""
)
def key_terms_topn(spark, d):
    return expansion.top_key_terms(texts(spark, d), 50)


_W = "[\\p{L}\\p{M}\\p{N}_]"
_SYMBOLS = " UNION ALL ".join("SELECT unnest(regexp_extract_all(text, '" + p.replace("\\w", _W) + "', 1)) AS s FROM chunks" for p in tx.SYMBOL_PATTERNS)


@query(f"SELECT s AS symbol, count(*) AS cnt FROM ({_SYMBOLS}) WHERE strlen(s) >= 3 AND NOT starts_with(s, 'test_') AND NOT starts_with(s, '_') GROUP BY 1 ORDER BY cnt DESC, symbol LIMIT 100")
def code_symbols(spark, d):
    return expansion.top_symbols(table(spark, d, "chunks", "chunk_id"), 100)


@query()
def expand_query(spark, d):
    rows = [(q, expansion.expand(q, texts(spark, d), "doc_id")) for q in ("vector database", "hybrid search", "a query of more than three words")]
    return spark.createDataFrame(rows, "query string, expanded string")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> ''))::BIGINT AS n_words FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^ -~\\n\\r\\t]')")
def query_words(spark, d):
    """Words of all texts by Unicode white space. Its SQL only knows texts of printable ASCII."""
    own = texts(spark, d).where(F.col("text").isNotNull())
    return own.select("doc_id", F.size(tx.query_words("text")).cast("long").alias("n_words"))


@query(
    f"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS w FROM documents)
SELECT w AS word, ({_CODE_LIKE}) AS code_like, strlen(w) >= 4 AND w NOT IN ({_STOP}) AND NOT regexp_matches(w, '^\\p{{N}}+$') AND NOT ({_CODE_LIKE}) AS key_term FROM w WHERE w <> ''"""
)
def word_classes(spark, d):
    """Every distinct word, whether it looks like code, and whether it may become an expansion term."""
    own = texts(spark, d).select(F.explode(tx.words("text")).alias("word")).distinct()
    return own.select("word", tx.looks_like_code("word").alias("code_like"), tx.is_key_term("word").alias("key_term"))


# chunks and files -----------------------------------------------------------------------------------------------


def _chunked(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    from plumbline.operators.chunking import chunk_table

    return chunk_table(texts(spark, d), ["doc_id"], "text", "path", 256, 128, strategy)


@query()
def chunk_simple(spark, d):
    return _chunked(spark, d, "simple")


@query()
def chunk_code(spark, d):
    """The code chunker over every block; blocks without source fall back to prose."""
    from plumbline.operators.chunking import chunk_table

    own = table(spark, d, "code_blocks").where("content is not null")
    return chunk_table(own, ["block_id", "ingested_at"], "content", "source", 256, 64, "ast", keep_tail=True)


@query(
    """WITH small AS (SELECT lang, count(*) AS docs FROM documents WHERE text IS NOT NULL AND strlen(text) <= 1024 GROUP BY 1)
SELECT lang, docs AS chunks, docs FROM small"""
)
def chunk_stats(spark, d):
    """Chunks and documents by language, over all texts. Its SQL only knows texts of one chunk."""
    from plumbline.operators.chunking import chunk_table

    chunks = chunk_table(texts(spark, d), ["lang", "doc_id"], "text", None, 256, 128, "simple")
    return chunks.groupBy("lang").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"))


_EXT = "regexp_extract(m->>'source', '[^/](\\.[^./]+)$', 1)"


@query(f"SELECT {_EXT} AS ext, count(*) AS chunks, count(DISTINCT m->>'source') AS files, (count(*) // count(DISTINCT m->>'source'))::BIGINT AS per_file FROM ({_META}) WHERE m->>'source' IS NOT NULL GROUP BY 1 ORDER BY chunks DESC, ext LIMIT 10")
def build_stats(spark, d):
    """Chunks and files of the ten commonest extensions."""
    from plumbline.sources.files import extension_stats

    return extension_stats(table(spark, d, "chunks").select(F.get_json_object("metadata", "$.source").alias("source")), "source")


def _language_sql() -> str:
    return "CASE " + " ".join(f"WHEN {_EXT} = '.{k}' THEN '{v}'" for k, v in tx.LANGUAGES.items()) + " END"


@query(f"SELECT {_language_sql()} AS language, count(*) AS n FROM ({_META}) WHERE m->>'source' IS NOT NULL GROUP BY 1")
def languages(spark, d):
    own = table(spark, d, "chunks").select(F.get_json_object("metadata", "$.source").alias("source")).where("source is not null")
    return own.groupBy(tx.language("source").alias("language")).agg(F.count("*").alias("n"))


_FILE = "regexp_extract(source, '[^/](\\.[^./]+)$', 1)"


def _types_sql(types: list[str]) -> str:
    return ", ".join(f"'{t}'" for t in types)


def _file_rules_sql() -> str:
    from plumbline.sources.files import SKIPPED_FOLDERS, TYPES

    folders = "|".join(f.replace(".", "\\.") for f in SKIPPED_FOLDERS)
    return f"""SELECT source, max(strlen(content)) AS size, bool_or({_FILE} <> '' AND {_FILE} <> '.rb' AND {_FILE} IN ({_types_sql(TYPES)}) AND strlen(content) <= CASE WHEN {_FILE} = '.json' THEN 10240 ELSE 1048576 END) AS read,
bool_or(regexp_matches(source, '/({folders})/')) AS skipped, bool_or(regexp_matches(source, '(^|/)\\.[^/]')) AS hidden FROM code_blocks WHERE source IS NOT NULL AND content IS NOT NULL GROUP BY 1"""


@query(_file_rules_sql())
def file_rules(spark, d):
    """The listing rules of the build command, over the paths of code blocks: type and size, folders, hidden names."""
    from plumbline.sources import files

    own = table(spark, d, "code_blocks").where("source is not null and content is not null").withColumn("size", F.octet_length("content").cast("long"))
    rules = own.select("source", "size", files.allowed("source", "size", excluded=[".rb"]).alias("read"), files.in_skipped_folder("source").alias("skipped"), files.is_hidden("source").alias("hidden"))
    return rules.groupBy("source").agg(F.max("size").alias("size"), F.bool_or("read").alias("read"), F.bool_or("skipped").alias("skipped"), F.bool_or("hidden").alias("hidden"))


@query("SELECT index_name, coalesce(embedding_options::JSON->>'document_prefix', '') AS document_prefix, try_cast(backend_kwargs::JSON->>'complexity' AS INT) AS complexity FROM index_meta")
def index_options(spark, d):
    """Prefix and complexity of each index from its open metadata."""
    m = table(spark, d, "index_meta")
    prefix = F.coalesce(F.get_json_object("embedding_options", "$.document_prefix"), F.lit(""))
    return m.select("index_name", prefix.alias("document_prefix"), F.get_json_object("backend_kwargs", "$.complexity").try_cast("int").alias("complexity"))


@query(
    """SELECT v.vec_id, v.ingested_at, coalesce(len(embedding), -1)::BIGINT AS width, embedding IS NOT NULL AND len(embedding) = m.dimensions AS fits,
coalesce(len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0, false) AS broken, coalesce(len(list_filter(embedding, lambda x: x <> 0)) = 0, false) AS zero
FROM vectors v JOIN index_meta m USING (index_name)"""
)
def vector_checks(spark, d):
    """The checks of the embedding writer on every row: width, finite elements, not all zero."""
    rows = table(spark, d, "vectors").join(table(spark, d, "index_meta").select("index_name", "dimensions"), "index_name")
    return rows.select("vec_id", "ingested_at", vx.checks("embedding", "dimensions").alias("c")).select("vec_id", "ingested_at", "c.*")


# output ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents WHERE NOT contains(text, chr(0))")
def truncate_preview(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", tx.preview("text", 200).alias("preview"))


def _ranked(own: DataFrame) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    return own.where("text is not null").withColumn("rank", F.row_number().over(w)).where("rank <= 5")


_RANKED = "SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE text IS NOT NULL QUALIFY rank <= 5"


@query(f"SELECT source, md5(string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank)) AS context FROM ({_RANKED}) GROUP BY 1")
def rag_context(spark, d):
    """The numbered context of the first five passages of each source (by hash)."""
    return _ranked(docs(spark, d)).groupBy("source").agg(F.md5(rag.context_column("rank", "text")).alias("context"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"SELECT source, md5({_quoted(rag.LEAD)} || string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) || {_quoted(rag.ASK)} || source || {_quoted(rag.CLOSE)}) AS prompt FROM ({_RANKED}) WHERE source IS NOT NULL GROUP BY 1")
def rag_prompt(spark, d):
    rows = _ranked(docs(spark, d)).where("source is not null").groupBy("source").agg(rag.context_column("rank", "text").alias("context"))
    return rows.select("source", F.md5(rag.prompt_column("context", F.col("source"))).alias("prompt"))


@query(f"WITH {_bm25_sql()} SELECT bm.doc_id, 'passage: ' || left(text, 40) AS prefixed, printf('%.4f', round(score, 4)) AS shown FROM bm JOIN documents USING (doc_id) WHERE score > 0 ORDER BY round(score, 9) DESC, bm.doc_id LIMIT 10")
def result_lines(spark, d):
    from plumbline.operators.embed import with_prefix

    hits = bm25.search(texts(spark, d), QUERY, 10, "doc_id").join(texts(spark, d), "doc_id")
    return hits.select("doc_id", with_prefix(F.substring("text", 1, 40), "passage: ").alias("prefixed"), F.format_string("%.4f", F.round("score", 4)).alias("shown"))


@query("SELECT chunk_id, ingested_at, k AS key, m->>k AS value FROM (SELECT *, unnest(json_keys(m)) AS k FROM (" + _META + "))")
def metadata_entries(spark, d):
    """Metadata as key and value, numbers as text."""
    own = table(spark, d, "chunks").select("chunk_id", "ingested_at", F.from_json("metadata", "map<string,string>", {"mode": "PERMISSIVE"}).alias("m"))
    return own.select("chunk_id", "ingested_at", F.explode("m").alias("key", "value"))


