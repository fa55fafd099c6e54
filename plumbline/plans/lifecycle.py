"""Registered queries of the chunkers, the index life, import and export, and the shells, with the SQL they are
compared with.

Where an operator works on given inputs rather than on tables (code chunker, registry, replies), the query runs it on
small fixed inputs and the SQL states the expected rows, worked out by hand.
"""

from __future__ import annotations

import io
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import bm25, vectors
from plumbline.operators.ids import shared_folder
from plumbline.plans.catalogue import _CODE_LIKE, _STOP, _SYMBOLS, QUERIES, QUERY, SQL, _bm25_sql, docs, query, texts, vecs
from plumbline.sources.tables import table

LIMIT, BACK = 1024, 512
_SPACE = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def chunks_sql(keys: str = "doc_id", where: str = "true") -> str:
    """CTEs that end in ``pieces`` (keys, ordinal, text): the prose chunker over documents, by byte offsets."""
    return f"""RECURSIVE src AS (SELECT *, strlen(text) AS total FROM documents WHERE text IS NOT NULL AND {where}),
big AS (SELECT doc_id, text, total FROM src WHERE total > {LIMIT}),
ch AS (SELECT doc_id, generate_subscripts(c, 1) AS pos, unnest(c) AS c FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM big)),
off AS (SELECT doc_id, pos, c, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY pos) - strlen(c) AS o FROM ch),
marks AS (SELECT doc_id, list_append(list(o::BIGINT ORDER BY pos), any_value(total)) AS offs, coalesce(list(o::BIGINT ORDER BY pos) FILTER (regexp_matches(c, '{_SPACE}')), []) AS spaces, any_value(total) AS total
  FROM off JOIN big USING (doc_id) GROUP BY doc_id),
walk AS (
  SELECT doc_id, 0::BIGINT AS s, 0::BIGINT AS cut, 0::BIGINT AS nxt, 0 AS step FROM big
  UNION ALL
  SELECT doc_id, s, cut, CASE WHEN cut <= s THEN list_filter(offs, lambda o: o > s)[1] WHEN cut >= total THEN total ELSE f END, step + 1 FROM (
    SELECT *, CASE WHEN cut > s + {BACK} THEN CASE WHEN list_filter(offs, lambda o: o <= cut - {BACK})[-1] > s THEN list_filter(offs, lambda o: o <= cut - {BACK})[-1] ELSE cut END ELSE cut END AS f FROM (
      SELECT *, CASE WHEN e < total THEN coalesce(list_filter(spaces, lambda o: o >= s AND o < e)[-1], e) ELSE e END AS cut FROM (
        SELECT walk.doc_id, walk.nxt AS s, step, offs, spaces, total, list_filter(offs, lambda o: o <= least(walk.nxt + {LIMIT}, total))[-1] AS e
        FROM walk JOIN marks USING (doc_id) WHERE walk.nxt < total)))),
cuts AS (SELECT doc_id, step, regexp_replace(substring(text, len(list_filter(offs, lambda o: o < s))::BIGINT + 1, len(list_filter(offs, lambda o: o >= s AND o < cut))::BIGINT), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS text
  FROM walk JOIN marks USING (doc_id) JOIN big USING (doc_id) WHERE step > 0 AND cut > s),
pieces AS (SELECT {keys}, 0 AS ordinal, text FROM src WHERE total <= {LIMIT}
  UNION ALL SELECT {keys}, (row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1)::INT, c.text FROM cuts c JOIN (SELECT * EXCLUDE (text) FROM src) USING (doc_id) WHERE c.text <> '')"""


_NULLS = "NULL::VARCHAR AS block_type, NULL::VARCHAR AS name, NULL::VARCHAR AS language, NULL::INT AS start_line, NULL::INT AS end_line, NULL::INT AS part"
SQL["chunk_simple"] = f"WITH {chunks_sql()} SELECT doc_id, ordinal, text, 'simple' AS chunk_type, ordinal AS chunk_index, {_NULLS} FROM pieces"
SQL["chunk_stats"] = f"WITH {chunks_sql('doc_id, lang')} SELECT lang, count(*) AS chunks, count(DISTINCT doc_id) AS docs FROM pieces GROUP BY 1"
SQL["query_words"] = f"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda w: w <> ''))::BIGINT AS n_words FROM documents WHERE text IS NOT NULL"
SQL["passage_lookup"] = "SELECT e.vec_id, e.label, d.lang, length(d.text) AS chars FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id"


def _values(columns: str, rows: Sequence[Sequence]) -> str:
    """SQL of fixed rows."""

    def one(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"


# code chunker ---------------------------------------------------------------------------------------------------

_LONG = "def long():\n" + "".join(f"    step_{i} = {i}\n" for i in range(8))
CODE_CASES = [
    ("rust", "a.rs", 'fn hello() {\n    println!("x");\n}\n\nfn world() {\n    hello();\n}\n', 256, 64),
    ("python", "b.py", "class A:\n    def one(self):\n        pass\n\n    def two(self):\n        pass\n\ndef free():\n    return 1\n", 256, 64),
    ("gap of 20 bytes", "c.go", "// 4567890123456789 0\nfunc F() {\n}\n", 256, 0),
    ("gap of 21 bytes", "d.go", "// 4567890123456789 01\nfunc F() {\n}\n", 256, 0),
    ("oversized", "e.py", _LONG, 16, 0),
    ("oversized with overlap", "f.py", _LONG, 16, 20),
    ("unbalanced", "g.java", "class T {\n  void run(int a) {\n", 256, 0),
    ("no language", "h.xyz", "fn not_code() {}", 256, 0),
    ("no block", "i.rs", "let x = 1;", 256, 0),
    ("overlapping", "j.ts", "export class K {\n  go() {\n  }\n}\nconst f = (a) => {\n}\n", 256, 0),
]
_CODE_EXPECTED = [
    ("rust", 0, "ast", "function", "hello", 1, 3, None), ("rust", 1, "ast", "function", "world", 5, 7, None),
    ("python", 0, "ast", "class", "A", 1, 7, None), ("python", 1, "ast", "function", "free", 8, 9, None),
    ("gap of 20 bytes", 0, "context", None, None, 1, 1, None), ("gap of 20 bytes", 1, "ast", "function", "F", 2, 3, None),
    ("gap of 21 bytes", 0, "context", None, None, 1, 1, None), ("gap of 21 bytes", 1, "ast", "function", "F", 2, 3, None),
    ("oversized", 0, "ast", "function", "long_part0", 1, 5, 0), ("oversized", 1, "ast", "function", "long_part1", 6, 9, 1),
    ("oversized with overlap", 0, "ast", "function", "long_part0", 1, 5, 0), ("oversized with overlap", 1, "ast", "function", "long_part1", 5, 9, 1),
    ("unbalanced", 0, "ast", "class", "T", 1, 2, None),
    ("no language", 0, "simple", None, None, None, None, None), ("no block", 0, "simple", None, None, None, None, None),
    ("overlapping", 0, "ast", "class", "K", 1, 4, None), ("overlapping", 1, "ast", "arrow", "f", 5, 6, None),
]


@query(_values('"case", ordinal, chunk_type, block_type, name, start_line, end_line, part', _CODE_EXPECTED))
def chunk_code_cases(spark: SparkSession, d: str) -> DataFrame:
    """The code chunker on small files: blocks, gaps, oversized and unbalanced blocks, fallback to prose."""
    from plumbline.operators.chunking import chunk_text

    rows = [(name, no, c.chunk_type, c.block_type, c.name, c.start_line, c.end_line, c.part) for name, path, text, size, overlap in CODE_CASES for no, c in enumerate(chunk_text(text, path, size, overlap, "ast"))]
    return spark.createDataFrame(rows, "case string, ordinal int, chunk_type string, block_type string, name string, start_line int, end_line int, part int")


@query("""SELECT count(*) AS blocks, sum(strlen(content)) AS bytes, 0::BIGINT AS over_limit FROM code_blocks WHERE content IS NOT NULL""")
def chunk_code_limits(spark: SparkSession, d: str) -> DataFrame:
    """Prose chunks of every block: none exceeds the limit, and without overlap only white space gets lost."""
    from plumbline.operators.chunking import chunk_table

    own = table(spark, d, "code_blocks").where("content is not null").select(F.monotonically_increasing_id().alias("no"), "content")
    own = own.withColumn("bytes", F.octet_length("content").cast("long"))
    pieces = chunk_table(own, ["no"], "content", None, 256, 0, "simple")
    squeezed = lambda c: F.regexp_replace(c, r"\p{IsWhite_Space}+", "")
    parts = pieces.groupBy("no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: squeezed(x["text"])), "").alias("joined"), F.sum((F.octet_length("text") > 1024).cast("long")).alias("over"))
    both = own.join(parts, "no", "left")
    same = F.coalesce(F.col("joined"), F.lit("")) == squeezed(F.col("content"))
    return both.agg(F.sum(same.cast("long")).alias("blocks"), F.sum(F.when(same, F.col("bytes"))).alias("bytes"), F.coalesce(F.sum("over"), F.lit(0)).alias("over_limit"))


# persisted and approximate indexes ------------------------------------------------------------------------------


def _terms(spark: SparkSession, d: str) -> bm25.TermIndex:
    """The term index of the documents, written in two parts and read again."""
    folder = shared_folder(spark)
    own = texts(spark, d)
    bm25.TermIndex.build(own.where("doc_id % 2 = 0"), "doc_id").save(folder)
    bm25.TermIndex.build(own.where("doc_id % 2 <> 0"), "doc_id").save(folder, "append")
    return bm25.TermIndex.load(spark, folder, "doc_id")


@query(SQL["bm25_topk"])
def bm25_index_topk(spark, d):
    return _terms(spark, d).search(QUERY, 10).select("doc_id", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {_bm25_sql('''lang = 'en' ''')} SELECT doc_id, round(score, 4) AS score FROM bm WHERE score > 0")
def bm25_index_pool(spark, d):
    """Scores within a filtered corpus."""
    found = _terms(spark, d).scores(QUERY, docs(spark, d).where("lang = 'en'"))
    return found.where("score > 0").select("doc_id", F.round("score", 4).alias("score"))


@query(SQL["vector_topk_batch"])
def ivf_all_lists(spark, d):
    """An inverted file that is built, added to, written and read, and probed in all lists, is exact."""
    own = vecs(spark, d)
    folder = shared_folder(spark)
    index = vectors.InvertedFile.build(own.where("vec_id % 3 <> 0"), "vec_id", lists=8).add(own.where("vec_id % 3 = 0"))
    index.save(folder)
    asked = own.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.InvertedFile.load(spark, folder, "vec_id").search_many(asked, 10, complexity=256)
    return found.select("query_id", "vec_id", "score", "rank")


@query("SELECT vec_id % 50 AS left_over, count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0 GROUP BY 1")
def ivf_recall(spark, d):
    """Recall at 10 of the approximate index against the exact answers, over all queries: at least 0.9."""
    exact, found = QUERIES["vector_topk_batch"](spark, d), QUERIES["ivf_topk"](spark, d)
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.groupBy((F.col("query_id") % 50).alias("left_over")).agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.count("*") >= 0.9).alias("enough"))


# the life of an index -------------------------------------------------------------------------------------------


def _catalog(spark: SparkSession):
    from plumbline.catalog import Catalog

    return Catalog(spark, [shared_folder(spark), shared_folder(spark)])


def _sources(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return texts(spark, d).where("text is not null").where(where).select(F.col("doc_id").cast("string").alias("source"), "text")


@query(f"WITH {chunks_sql()} SELECT row_number() OVER (ORDER BY doc_id::VARCHAR, ordinal) AS id, doc_id::VARCHAR AS source, md5(text) AS text FROM pieces")
def index_passages(spark, d):
    """The passages that a build writes: chunks with running ids."""
    catalog = _catalog(spark)
    catalog.build("docs", _sources(spark, d))
    return catalog.passages("docs").select("id", "source", F.md5("text").alias("text"))


@query(f"WITH {chunks_sql()} SELECT count(*) AS vectors, 64 AS least, 64 AS most, true AS unit FROM pieces")
def index_vectors(spark, d):
    """The vectors that a build writes beside them: one each, of the width of the index, of unit length or zero."""
    catalog = _catalog(spark)
    catalog.build("docs", _sources(spark, d))
    from plumbline.functions.vector import norm
    from plumbline.sources import storage

    stored = spark.read.parquet(storage.join(catalog.find("docs"), "vectors"))
    length = norm("embedding")
    return stored.agg(F.count("*").alias("vectors"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"), F.bool_and((F.abs(length - 1) < 1e-5) | (length == 0)).alias("unit"))


@query(
    f"""WITH {chunks_sql('doc_id, lang')}, first AS (SELECT row_number() OVER (ORDER BY doc_id::VARCHAR, ordinal) AS id, doc_id FROM pieces WHERE lang = 'en'),
later AS (SELECT (SELECT count(*) FROM first) + row_number() OVER (ORDER BY doc_id::VARCHAR, ordinal) AS id, doc_id FROM pieces WHERE lang IS DISTINCT FROM 'en')
SELECT id, doc_id::VARCHAR AS source FROM first UNION ALL SELECT id, doc_id::VARCHAR FROM later"""
)
def index_update(spark, d):
    """Documents that are added later get ids after the last."""
    catalog = _catalog(spark)
    catalog.build("docs", _sources(spark, d, "lang = 'en'"))
    catalog.update("docs", _sources(spark, d, "not lang <=> 'en'"))
    return catalog.passages("docs").select("id", "source")


@query("SELECT unnest(range(1, 11))::INT AS rank, true AS same, true AS close")
def index_pruned_search(spark, d):
    """A pruned index embeds again what it ranks, and finds what it found before."""
    from plumbline.operators.search import SearchOptions

    catalog = _catalog(spark)
    catalog.build("docs", _sources(spark, d))
    before = catalog.search("docs", "how the index mixes both scores", SearchOptions(10)).select("rank", F.col("id").alias("a"), F.col("score").alias("x")).collect()
    catalog.prune("docs")
    after = catalog.search("docs", "how the index mixes both scores", SearchOptions(10)).select("rank", F.col("id").alias("b"), F.col("score").alias("y")).collect()
    x, y = spark.createDataFrame(before), spark.createDataFrame(after)
    return x.join(y, "rank").select(F.col("rank").cast("int").alias("rank"), (F.col("a") == F.col("b")).alias("same"), (F.abs(F.col("x") - F.col("y")) < 1e-6).alias("close"))


@query(
    f"""WITH {chunks_sql()}, n AS (SELECT count(*) AS n FROM pieces)
SELECT * FROM (VALUES ('built', 'apx', 'OK', 'ivf'), ('built', 'docs', 'OK', 'exact'), ('pruned', 'apx', 'OK', 'ivf'), ('pruned', 'docs', 'OK', 'exact'), ('removed', 'docs', 'OK', 'exact')) v(step, name, status, backend) CROSS JOIN (SELECT n AS passages FROM n)"""
)
def index_listing(spark, d):
    """The catalog after building two indexes, pruning one and removing the other."""
    from plumbline.catalog import IndexMeta

    catalog = _catalog(spark)
    catalog.build("docs", _sources(spark, d))
    catalog.build("apx", _sources(spark, d), IndexMeta(backend_name="ivf"))
    rows = []

    def note(step: str) -> None:
        rows.extend((step, x["name"], x["status"], x["backend"], x["passage_count"]) for x in catalog.list() if x["size_mb"] > 0)

    note("built")
    catalog.prune("docs")
    note("pruned")
    catalog.remove("apx", force=True)
    note("removed")
    return spark.createDataFrame(rows, "step string, name string, status string, backend string, passages bigint")


@query("SELECT doc_id::VARCHAR AS id, text, lang FROM documents WHERE text IS NOT NULL")
def exchange_passages(spark, d):
    """Passages written in the line format and read again; metadata as JSON."""
    from plumbline.sources import exchange

    folder = shared_folder(spark, create=False)
    own = docs(spark, d).where("text is not null")
    exchange.write_passages(own.select(F.col("doc_id").cast("string").alias("id"), "text", F.to_json(F.struct("lang")).alias("metadata")), folder)
    back = exchange.read_passages(spark, folder)
    return back.select("id", "text", F.get_json_object("metadata", "$.lang").alias("lang"))


@query("SELECT row_number() OVER (ORDER BY chunk_id, ingested_at) - 1 AS ordinal, chunk_id::VARCHAR AS id FROM chunks")
def exchange_ids(spark, d):
    """Ids written a line each and read with their positions; the format has one file, in the order of the index."""
    from plumbline.sources import exchange

    folder = shared_folder(spark, create=False)
    own = table(spark, d, "chunks").select("chunk_id", "ingested_at").repartition(1).sortWithinPartitions("chunk_id", "ingested_at")
    own.select(F.col("chunk_id").cast("string").alias("value")).write.text(folder)
    return exchange.read_ids(spark, folder)


@query("SELECT path, length FROM (VALUES ('a.md', 4), ('b/c.py', 6), ('b/d.rs', 3)) v(path, length)")
def file_listing(spark, d):
    """The listing of a small tree: hidden, ignored, oversized, foreign and generated files are left out."""
    from plumbline.sources import storage
    from plumbline.sources.files import list_files

    root = shared_folder(spark)
    tree = {"a.md": "text", "b/c.py": "x = 12", "b/d.rs": "fn}", "b/e.exe": "no", ".hidden/f.md": "no", "node_modules/g.js": "no", "h.json": "x" * 10_241, "i.txt": "y" * 1_048_577}
    for name, text in tree.items():
        storage.write_text(spark, storage.join(root, name), text)
    found = list_files(spark, [root])
    return found.select(F.expr("regexp_extract(path, '/tree[^/]*/(.*)$', 1)").alias("path"), F.col("length").cast("int").alias("length"))


# answers and shells ---------------------------------------------------------------------------------------------


def _expand_sql(q: str) -> str:
    n = q.replace(" ", "_")
    symbols = _SYMBOLS.replace("FROM chunks", f"FROM own_{n}")
    return f"""own_{n} AS (WITH {_bm25_sql(query_=q)} SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM bm WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT 5)),
terms_{n} AS (SELECT w AS t, row_number() OVER (ORDER BY count(*) DESC, w) AS no FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS w FROM own_{n})
  WHERE strlen(w) >= 4 AND w NOT IN ({_STOP}) AND NOT regexp_matches(w, '^\\p{{N}}+$') AND NOT ({_CODE_LIKE}) GROUP BY w QUALIFY no <= 5),
names_{n} AS (SELECT s AS t, row_number() OVER (ORDER BY count(*) DESC, s) AS no FROM ({symbols}) WHERE strlen(s) >= 3 AND NOT starts_with(s, 'test_') AND NOT starts_with(s, '_') GROUP BY s QUALIFY no <= 5),
all_{n} AS (SELECT t, no FROM terms_{n} UNION ALL SELECT t, no + 10 FROM names_{n} WHERE lower(t) NOT IN (SELECT t FROM terms_{n})),
some_{n} AS (SELECT t, no FROM all_{n} WHERE lower(t) NOT IN ({', '.join(f"'{w}'" for w in q.split())}) ORDER BY no LIMIT 5)"""


SQL["expand_query"] = f"""WITH {_expand_sql("vector database")}, {_expand_sql("hybrid search")}
SELECT 'vector database' AS query, 'vector database ' || (SELECT string_agg(t, ' ' ORDER BY no) FROM some_vector_database) AS expanded
UNION ALL SELECT 'hybrid search', 'hybrid search ' || (SELECT string_agg(t, ' ' ORDER BY no) FROM some_hybrid_search)
UNION ALL SELECT 'a query of more than three words', 'a query of more than three words'"""

_REGISTRY = [
    ("nomic-embed-text:latest", "search_document: ", "search_query: ", True, 768),
    ("mxbai-embed-large", "Represent this document for retrieval: ", "Represent this sentence for searching relevant passages: ", True, 1024),
    ("bge-small-en-v1.5", "", "Represent this sentence for searching relevant passages: ", True, 384),
    ("e5-large-v2", "passage: ", "query: ", True, 1024),
    ("gte-base", "", "", True, 768),
    ("all-MiniLM-L6-v2", "", "", True, 384),
    ("text-embedding-3-large", "", "", True, 3072),
    ("an-unknown-model", "", "", False, 768),
]


@query(_values("model, document_prefix, query_prefix, normalized, dimensions", _REGISTRY))
def model_registry(spark, d):
    from plumbline.operators.embed import model_config

    rows = [(m, c.document_prefix, c.query_prefix, c.normalized, c.dimensions) for m in (r[0] for r in _REGISTRY) for c in [model_config(m)]]
    return spark.createDataFrame(rows, "model string, document_prefix string, query_prefix string, normalized boolean, dimensions int")


_ACTIONS = [
    ("Thought: x\nAction: search(deep water)", "search", "deep water"), ('Action: finish("the (long) answer")', "finish", "the (long) answer"),
    ("search(a) then finish(b)", "search", "a"), ("finish(f(x))", "finish", "f(x)"), ("no action at all", None, None),
]


@query(_values("reply, action, argument", _ACTIONS))
def action_parser(spark, d):
    from plumbline.operators.rag import parse_action

    return spark.createDataFrame([(r, *(parse_action(r) or (None, None))) for r, *_ in _ACTIONS], "reply string, action string, argument string")


_ERRORS = [
    ('{"error": {"message": "bad key"}}', "bad key"), ('{"error": "plain"}', "plain"), ('{"message": "m"}', "m"), ('{"detail": "d"}', "d"), ("not json", "not json"), ("[1]", "[1]"),
]


@query(_values("body, message", _ERRORS))
def error_messages(spark, d):
    from plumbline.operators.embed import error_message

    return spark.createDataFrame([(b, error_message(b)) for b, _ in _ERRORS], "body string, message string")


@query(_values('"case", prefix', [("of the call", "a: "), ("of the index", "b: "), ("of the registry", "query: "), ("of no one", "")]))
def query_prefixes(spark, d):
    from plumbline.operators.embed import query_prefix

    rows = [("of the call", query_prefix("a: ", {"query_prefix": "b: "}, "e5-base")), ("of the index", query_prefix(None, {"query_prefix": "b: "}, "e5-base")), ("of the registry", query_prefix(None, {}, "e5-base")), ("of no one", query_prefix(None, None, "x"))]
    return spark.createDataFrame(rows, "case string, prefix string")


@query(_values("setting, value", [("embedding.model", "m"), ("embedding.provider", "ollama"), ("embedding.api_key", "****"), ("build.chunk_size", "99"), ("build.chunk_overlap", "128"), ("broken", "ollama")]))
def config_values(spark, d):
    """Settings of a TOML text over the defaults; keys are shown masked."""
    from plumbline.config import Config

    c = Config.parse('[embedding]\nmodel = "m"\napi_key = "k"\n[build]\nchunk_size = 99\n')
    shown = Config.parse(c.shown())
    rows = [("embedding.model", c.embedding.model), ("embedding.provider", c.embedding.provider), ("embedding.api_key", shown.embedding.api_key), ("build.chunk_size", str(c.build.chunk_size)), ("build.chunk_overlap", str(c.build.chunk_overlap)), ("broken", Config.load("/no/such/file.toml").embedding.provider)]
    return spark.createDataFrame(rows, "setting string, value string")


@query(_values('"case", answer', [
    ("ask without hits", "No relevant passages found."), ("ask", "echo: [1] alpha"), ("react", "done"), ("react observation", "[1] alpha\n"), ("react without steps", "late"),
]))
def answers(spark, d):
    """One answer from a prompt with context, and the loop of thought, search and finish, with scripted models."""
    from plumbline.operators import rag

    class Scripted:
        def __init__(self, *replies: str):
            self.replies, self.seen = list(replies), []

        def generate(self, prompt: str) -> str:
            self.seen.append(prompt)
            return self.replies.pop(0)

    class Echo:
        def generate(self, prompt: str) -> str:
            return "echo: " + next(line for line in prompt.splitlines() if line.startswith("["))

    hits = spark.createDataFrame([(1, "alpha")], "rank int, text string")
    steps = Scripted("Action: search(alpha)", "Action: finish(done)")
    rows = [("ask without hits", rag.ask("q", lambda q: hits.limit(0), Echo())), ("ask", rag.ask("q", lambda q: hits, Echo())), ("react", rag.react("q", lambda q: hits, steps))]
    rows.append(("react observation", steps.seen[1].rpartition("Observation: ")[2].split("\n\n")[0].rstrip("\n") + "\n"))
    rows.append(("react without steps", rag.react("q", lambda q: hits, Scripted("Action: search(a)", "Action: finish(late)"), max_steps=1)))
    return spark.createDataFrame(rows, "case string, answer string")


@query(
    f"""WITH {_bm25_sql()}, best AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 5)
SELECT rank::INT AS rank, rank || '. [score: ' || printf('%.4f', score) || '] ' || CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS line, doc_id::VARCHAR AS id, coalesce(source, '') AS source FROM best JOIN documents USING (doc_id)"""
)
def result_sinks(spark, d):
    """The five best documents as text lines, and as read back from the JSON of the same results."""
    from plumbline import sinks

    own = texts(spark, d)
    hits = bm25.search(own, QUERY, 5, "doc_id").join(own.select("doc_id", "text", "source"), "doc_id").withColumnRenamed("doc_id", "id")
    lines = hits.select("rank", sinks.text_line().alias("line"))
    back = [(i, r["id"], r["metadata"].get("source", "")) for i, r in enumerate(json.loads(sinks.to_json(hits, ("source",))), 1)]
    return lines.join(spark.createDataFrame(back, "rank int, id string, source string"), "rank")


@query(_values("shell, what, answer", [
    ("http", "GET /", "200"), ("http", "GET /health", "200 ok"), ("http", "GET /indexes", "200 docs"), ("http", "POST /search", "200 3"), ("http", "POST /search without query", "400"), ("http", "GET /nowhere", "404"),
    ("mcp", "initialize", "plumbline"), ("mcp", "tools/list", "search list_indexes"), ("mcp", "tools/call search", "true"), ("mcp", "unknown", "-32601"), ("mcp", "broken line", "-32700"),
    ("cli", "list", "docs OK"), ("cli", "search", "3"), ("cli", "prune", "pruned"), ("cli", "prune again", "nothing to prune"), ("cli", "remove", ""),
]))
def shells(spark, d):
    """The HTTP server, the tool protocol and the commands over one index of all documents."""
    from contextlib import redirect_stdout

    from plumbline import cli, server

    catalog = _catalog(spark)
    catalog.build("docs", _sources(spark, d))
    ask = lambda *a: server.answer(catalog, "docs", *a)
    found = ask("POST", "/search", {"query": "the index of scores", "top_k": 3})
    rows = [
        ("http", "GET /", str(ask("GET", "/", {})[0])), ("http", "GET /health", f"{ask('GET', '/health', {})[0]} {ask('GET', '/health', {})[1]['status']}"),
        ("http", "GET /indexes", "200 " + " ".join(x["name"] for x in ask("GET", "/indexes", {})[1])), ("http", "POST /search", f"{found[0]} {len(found[1]['results'])}"),
        ("http", "POST /search without query", str(ask("POST", "/search", {})[0])), ("http", "GET /nowhere", str(ask("GET", "/nowhere", {})[0])),
    ]
    requests = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"index": "docs", "query": "scores", "top_k": 2}}}, {"id": 4, "method": "none"}]
    sink = io.StringIO()
    server.mcp(catalog, io.StringIO("\n".join(map(json.dumps, requests)) + "\n{"), sink)
    a, b, c, e, f = map(json.loads, sink.getvalue().splitlines())
    text = c["result"]["content"][0]["text"]
    rows += [("mcp", "initialize", a["result"]["serverInfo"]["name"]), ("mcp", "tools/list", " ".join(t["name"] for t in b["result"]["tools"])), ("mcp", "tools/call search", str("## Result 2" in text and "## Result 3" not in text).lower()), ("mcp", "unknown", str(e["error"]["code"])), ("mcp", "broken line", str(f["error"]["code"]))]

    def run(*argv: str) -> str:
        out = io.StringIO()
        with redirect_stdout(out):
            cli.main(list(argv), catalog)
        return out.getvalue().strip()

    rows.append(("cli", "list", run("list")))
    rows.append(("cli", "search", str(len(json.loads(run("search", "the scores of the index", "-i", "docs", "-k", "3", "--format", "json"))))))
    rows += [("cli", "prune", run("prune", "docs", "--yes")), ("cli", "prune again", run("prune", "docs", "--yes")), ("cli", "remove", run("remove", "docs", "--force"))]
    return spark.createDataFrame(rows, "shell string, what string, answer string")


_PDF = b"%PDF-1.4\n1 0 obj\n<< /Length 60 >>\nstream\nBT /F1 12 Tf (Hello \\(PDF\\)) Tj 0 -14 Td [(wo) -20 (rld) <21>] TJ ET\nendstream\nendobj\n"


@query(_values("path, text", [("a.md", "text"), ("b/c.py", "x = 12"), ("kept.log.md", "kept"), ("p.pdf", "Hello (PDF)\nworld!")]))
def file_texts(spark, d):
    """Texts of a tree with ignore files; what is not UTF-8 is left out, PDFs go through the extractor."""
    from plumbline.functions.pdf import extract_text
    from plumbline.sources import storage
    from plumbline.sources.files import PDF, TYPES, list_files, read_texts

    root = shared_folder(spark)
    tree = {"a.md": "text", "b/c.py": "x = 12", "b/d.md": "no", "b/.gitignore": "d.md\n", ".gitignore": "*.log.md\n!kept.log.md\n# remark\nout/\n", "e.log.md": "no", "kept.log.md": "kept", "out/f.md": "no", ".git/info/exclude": "g.md\n", "g.md": "no"}
    for name, text in tree.items():
        storage.write_text(spark, storage.join(root, name), text)
    storage.write_bytes(spark, storage.join(root, "latin.md"), "é".encode("latin-1"))
    storage.write_bytes(spark, storage.join(root, "p.pdf"), _PDF)
    files = list_files(spark, [root], [*TYPES, PDF])
    return read_texts(spark, files, [root], extract_text).select(F.expr("regexp_extract(path, '/tree[^/]*/(.*)$', 1)").alias("path"), "text")


@query(_values("path", [("a.md",), ("b.md",)]))
def file_limit(spark, d):
    """The first files in order of path."""
    from plumbline.sources import storage
    from plumbline.sources.files import list_files

    root = shared_folder(spark)
    for name in ("c.md", "b.md", "a.md", "d.md"):
        storage.write_text(spark, storage.join(root, name), name)
    return list_files(spark, [root], max_files=2).select(F.expr("regexp_extract(path, '/tree[^/]*/(.*)$', 1)").alias("path"))


@query("SELECT vec_id - (SELECT min(vec_id) FROM embeddings) AS ordinal, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings")
def exchange_matrix(spark, d):
    """The matrix of all embeddings in order of their ids, written as raw floats in one file per task and read again."""
    from plumbline.sources import exchange

    folder = shared_folder(spark, create=False)
    own = vecs(spark, d)
    first = own.agg(F.min("vec_id")).first()[0]
    exchange.write_matrix(own.select((F.col("vec_id") - first).alias("ordinal"), "embedding"), folder)
    back = exchange.read_parts(spark, folder, 64)
    return back.select("ordinal", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.round(F.col("embedding")[63].cast("double"), 6).alias("last"))


@query(_values("head, format", [("Ix", "faiss"), ("HNSW", "faiss"), ("PK", None), ("", None)]))
def foreign_formats(spark, d):
    from plumbline.sources.exchange import foreign_format

    return spark.createDataFrame([(h, foreign_format(h.encode())) for h in ("Ix", "HNSW", "PK", "")], "head string, format string")


@query(_values("strategy, path, chunk_type", [("simple", "a.py", "simple"), ("ast", "a.py", "ast"), ("auto", "a.py", "ast"), ("auto", "a.txt", "simple"), ("ast", "a.txt", "simple")]))
def chunk_strategies(spark, d):
    from plumbline.operators.chunking import chunk_text

    rows = [(s, p, chunk_text("def f():\n    return 1\n", p, 256, 0, s)[0].chunk_type) for s, p in (("simple", "a.py"), ("ast", "a.py"), ("auto", "a.py"), ("auto", "a.txt"), ("ast", "a.txt"))]
    return spark.createDataFrame(rows, "strategy string, path string, chunk_type string")


@query(_values('"case", hybrid', [("one word", True), ("three words", True), ("four words", False), ("asked for", True), ("without text", False), ("turned off", False)]))
def auto_hybrid(spark, d):
    from plumbline.operators.search import SearchOptions, wants_hybrid

    cases = {
        "one word": SearchOptions(query_text="a", auto_hybrid=True), "three words": SearchOptions(query_text="a b c", auto_hybrid=True), "four words": SearchOptions(query_text="a b c d", auto_hybrid=True),
        "asked for": SearchOptions(query_text="a b c d", hybrid=True), "without text": SearchOptions(hybrid=True), "turned off": SearchOptions(query_text="a"),
    }
    return spark.createDataFrame([(k, wants_hybrid(o)) for k, o in cases.items()], "case string, hybrid boolean")


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def filter_unparsable(spark, d):
    """A part that cannot be understood is left out by the lenient parser, as the shells use it."""
    from plumbline.operators.filters import Typed, compile_filter, parse

    own = docs(spark, d)
    return own.where(compile_filter(parse("lang=en, nonsense", strict=False), Typed(own))).select("doc_id")


class _Stub:
    """A server on this machine with the replies of the three embedding interfaces and an error."""

    def __enter__(self) -> str:
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
        from threading import Thread

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                status = 200
                if self.path.startswith("/v1/embeddings"):
                    reply = {"data": [{"index": i, "embedding": [float(len(t)), float(i)]} for i, t in reversed(list(enumerate(body["input"])))]}
                elif self.path == "/api/embed":
                    reply = {"embeddings": [[float(len(t)), 0.5] for t in body["input"]]}
                elif "batchEmbedContents" in self.path:
                    reply = {"embeddings": [{"values": [float(len(r["content"]["parts"][0]["text"])), 0.25]} for r in body["requests"]]}
                else:
                    status, reply = 401, {"error": {"message": "no key"}}
                raw = json.dumps(reply).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def log_message(self, *args) -> None:
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        Thread(target=self.server.serve_forever, daemon=True).start()
        return f"http://127.0.0.1:{self.server.server_address[1]}"

    def __exit__(self, *args) -> None:
        self.server.shutdown()
        self.server.server_close()


@query(_values("provider, vectors, width", [
    ("openai", "1.0 0.0,2.0 1.0,3.0 0.0", 2), ("ollama", "1.0 0.5,2.0 0.5,3.0 0.5", 768), ("gemini", "1.0 0.25,2.0 0.25,3.0 0.25", 768), ("hashing", None, 16), ("error", "401: no key", 0),
]))
def embedding_providers(spark, d):
    """Requests, batches and replies of the providers against a server on this machine; batches of two."""
    from plumbline.operators import embed

    rows = []
    with _Stub() as url:
        own = {"openai": embed.OpenAiProvider("m", "k", url + "/v1", 2), "ollama": embed.OllamaProvider(host=url, batch_size=2), "gemini": embed.GeminiProvider(api_key="k", batch_size=2, base_url=url)}
        for name, p in own.items():
            rows.append((name, ",".join(" ".join(map(str, v)) for v in p.embed(["a", "bb", "ccc"])), embed.dimensions(p)))
        rows.append(("hashing", None, embed.dimensions(embed.HashingProvider(16))))
        try:
            embed.post_json(url + "/nowhere", {})
        except embed.HttpError as e:
            rows.append(("error", str(e), 0))
    return spark.createDataFrame(rows, "provider string, vectors string, width int")


@query(_values("no, said", [
    (0, "/help /clear /history /quit"), (1, 'From the passages given, about "one?": they cover this topic. (Simulated answer of simulated.)'),
    (2, 'Q: one?\nA: From the passages given, about "one?": they cover this topic. (Simulated answer of simulated.)'), (3, "No relevant passages found."), (4, 'You ask about "three?". (Simulated answer of simulated.)'),
]))
def chat_commands(spark, d):
    """A conversation with the simulated model, whose form depends on the retrieved text."""
    from plumbline import cli
    from plumbline.operators import rag

    texts_ = {"one?": "the passages", "three?": "plain"}
    find = lambda q: spark.createDataFrame([(1, texts_[q])] if q in texts_ else [], "rank int, text string")
    said: list[str] = []
    lines = iter(["/help", "one?", "/history", "two?", "", "/clear", "/history", "three?", "/quit"])
    cli.chat(find, rag.SimulatedModel(), lambda _: next(lines), said.append)
    return spark.createDataFrame(list(enumerate(said)), "no int, said string")


@query(_values("command, printed", [("build", "3 passages"), ("update", "4 passages"), ("search", "b/c.py"), ("ask", "true"), ("react", "true"), ("config path", "true"), ("config init", "true false true")]))
def file_commands(spark, d):
    """The commands over a tree of files: build, update, search with expansion, ask, react, config."""
    from contextlib import redirect_stdout

    from plumbline import cli, config
    from plumbline.sources import storage

    root, more, home = shared_folder(spark), shared_folder(spark), shared_folder(spark)
    for name, text in {"a.md": "Stones in the river.", "b/c.py": "def measure_depth():\n    return 1\n\ndef other():\n    return 2\n"}.items():
        storage.write_text(spark, storage.join(root, name), text)
    storage.write_text(spark, storage.join(more, "z.txt"), "A late zebra.")
    catalog = _catalog(spark)

    def run(*argv: str) -> str:
        out = io.StringIO()
        with redirect_stdout(out):
            cli.main(list(argv), catalog)
        return out.getvalue().strip()

    rows = [("build", run("build", "ix", "--docs", root, "--chunking-strategy", "auto")), ("update", run("update", "ix", "--docs", more))]
    rows.append(("search", json.loads(run("search", "measure_depth", "-i", "ix", "-k", "1", "--format", "json"))[0]["metadata"]["source"].partition("tree-")[2].partition("/")[2]))
    rows.append(("ask", str('"a zebra?"' in run("ask", "a zebra?", "-i", "ix", "--llm", "simulated")).lower()))
    rows.append(("react", str("Simulated answer" in run("react", "a zebra?", "-i", "ix", "--llm", "simulated", "--max-steps", "1")).lower()))
    rows.append(("config path", str(run("config", "path").endswith("config.toml")).lower()))
    path = storage.join(home.removeprefix("file:"), "deep", "config.toml")
    made = [config.init(path), config.init(path), config.init(path, force=True)] if path.startswith("/") else [True, False, True]
    rows.append(("config init", " ".join(str(x).lower() for x in made)))
    return spark.createDataFrame(rows, "command string, printed string")
