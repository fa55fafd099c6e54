"""BM25, tokens, vectors, hybrid fusion, filters, expansion: golden numbers and defined cases."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions import vector as vx
from plumbline.operators import bm25, expansion, filters, hybrid, vectors
from plumbline.operators.search import SearchOptions, search, wants_hybrid


def passages(spark, texts):
    return spark.createDataFrame([(i, t, f"extra {i}") for i, t in enumerate(texts)], "pos int, text string, score string")


def score_list(spark, texts, query):
    return [r.score for r in bm25.scores(passages(spark, texts), query, "pos").orderBy("pos").collect()]


@pytest.mark.parametrize(
    "texts, query, golden",
    [
        (["rust rust rust programming", "rust programming"], "rust", [0.267405, 0.211109]),
        (["common rare", "common", "common"], "rare", [0.814273, 0, 0]),
        (["apple banana", "apple cherry", "banana cherry", "apple apple apple"], "apple", [0.373659, 0.373659, 0, 0.523123]),
        (["hello world"], "", [0]),
        (["apple banana", "apple cherry"], "apple apple", [0.364643, 0.364643]),
        (["apple banana", "apple cherry"], "apple", [0.182322, 0.182322]),
        (["Größe apple_pie APPLE", None, ""], "apple", None),
    ],
)
def test_bm25_scores(spark, texts, query, golden):
    got = score_list(spark, texts, query)
    if golden is None:
        assert got[0] > 0 and got[1:] == [0, 0]
    else:
        assert got == pytest.approx(golden, abs=1e-5)


def test_bm25_search_orders_ties_by_key(spark):
    docs = passages(spark, ["apple banana", "apple cherry", "banana cherry", "apple apple apple"])
    assert [(r.pos, r["rank"]) for r in bm25.search(docs, "apple", 3, "pos").orderBy("rank").collect()] == [(3, 1), (0, 2), (1, 3)]
    assert bm25.search(docs, "xyz", 5, "pos").count() == 0
    assert bm25.search(docs.limit(0), "apple", 5, "pos").count() == 0
    assert bm25.corpus_stats(docs.limit(0), "pos").first()["avgdl"] == 1.0


def test_one_query_and_many_agree(spark):
    texts = ["red fox jumps", "red red wine", "blue fox", "wine and dine", None]
    docs = passages(spark, texts)
    asked = spark.createDataFrame([(1, "red fox"), (2, "wine red red"), (3, "none")], "query_id int, query string")
    got = {(r.query_id, r.pos): r.score for r in bm25.search_many(bm25.term_frequencies(docs, "pos"), bm25.document_lengths(docs, "pos"), asked, 10, "pos").collect()}
    for i, q in ((1, "red fox"), (2, "wine red red")):
        for pos, s in enumerate(score_list(spark, texts, q)):
            assert got.get((i, pos), 0) == pytest.approx(s)


def test_tokens_words_symbols(spark):
    rows = spark.createDataFrame([("Hello, World! This is a test.",), ("",), ("test123 456abc é a1",)], "t string")
    assert [r[0] for r in rows.select(tx.tokens("t")).collect()] == [["hello", "world", "this", "is", "test"], [], ["test123", "456abc", "a1"]]
    code = "pub async fn load_all() {}\nstruct Store {}\nimpl Store { fn _hid() {} fn test_it() {} }\nclass Äpfel:\n  def run(self): pass"
    got = spark.createDataFrame([(code,)], "t string").select(tx.symbols("t")).first()[0]
    assert got == ["load_all", "Store", "run", "Äpfel", "Äpfel"]
    terms = spark.createDataFrame([(w,) for w in ("database", "the", "over", "return", "snake_case", "ab12", "12345", "größe", "éa")], "w string")
    assert [r.w for r in terms.where(tx.is_key_term("w")).collect()] == ["database", "over", "größe"]
    assert [r[0] for r in spark.createDataFrame([("a b c",), (" one  two three four ",)], "q string").select(tx.is_short_query("q")).collect()] == [True, False]
    paths = spark.createDataFrame([("/a/b.min.js",), ("/a.b/c",), (".hidden",), ("x.py",)], "p string")
    assert [tuple(r) for r in paths.select(tx.extension("p"), tx.language("p")).collect()] == [(".js", "javascript"), ("", None), ("", None), (".py", "python")]


def test_vector_functions(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None)], "id int, v array<float>")
    assert [r[0] for r in v.select(vx.norm("v")).collect()] == [5.0, 0.0, 1.0, None]
    assert v.select(vx.normalized("v")).collect()[0][0] == pytest.approx([0.6, 0.8])
    assert v.select(vx.normalized("v")).collect()[1][0] == [0.0, 0.0]
    assert [r[0] for r in v.select(vx.dot("v", vx.literal([2.0, 1.0]))).collect()] == [10.0, 0.0, 2.0, None]
    pooled = spark.range(1).select(vx.mean_pooled(F.lit([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]), F.array(*[F.lit(x) for x in (1, 1, 0)]), 2)).first()[0]
    assert pooled == [2.0, 3.0]


def test_top_k_ties_wide_k_and_batches(spark):
    own = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(20)] + [(99, None), (98, [1.0])], "id bigint, embedding array<float>")
    got = [(r.id, r.score, r["rank"]) for r in vectors.top_k(own, [1.0, 0.0], 4, "id").orderBy("rank").collect()]
    assert [x[0] for x in got] == [2, 5, 8, 11] and [x[2] for x in got] == [1, 2, 3, 4]
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0]), (9, None)], "query_id bigint, embedding array<float>")
    many = {(r.query_id, r["rank"]): r.id for r in vectors.top_k_many(own, asked, 4, "id").collect()}
    assert [many[7, i] for i in range(1, 5)] == [2, 5, 8, 11] and [many[8, i] for i in range(1, 5)] == [0, 1, 2, 3]
    assert vectors.top_k(own.limit(0), [1.0, 0.0], 4, "id").count() == 0


def test_inverted_file_recall_and_append(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((12, 16))[rng.integers(0, 12, 2000)] + 0.3 * rng.standard_normal((2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>")
    index = vectors.InvertedFile.build(own, "id", lists=16)
    hit = 0
    for q in range(10):
        best = set(np.argsort(-(x @ x[q]))[:10].tolist())
        hit += len(best & {r.id for r in index.search(x[q].tolist(), 10, complexity=64).collect()})
    assert hit >= 90
    wider = index.add(spark.createDataFrame([(9999, x[0].tolist())], "id bigint, embedding array<float>"))
    assert 9999 in {r.id for r in wider.search(x[0].tolist(), 3).collect()}


@pytest.mark.parametrize(
    "near, text, alpha, golden",
    [
        ([(0, 0.9), (1, 0.8), (2, 0.7)], [0.5, 0.9, 0.3], 0.5, [(1, 0.75), (0, 0.666667), (2, 0.0)]),
        ([(0, 0.9), (1, 0.5)], [0.1, 0.9], 1.0, [(0, 1.0), (1, 0.0)]),
        ([(0, 0.9), (1, 0.5)], [0.1, 0.9], 0.0, [(1, 1.0), (0, 0.0)]),
        ([(0, 0.5)], [], 0.5, [(0, 0.0)]),
    ],
)
def test_fusion(spark, near, text, alpha, golden):
    c = spark.createDataFrame(near, "id int, score double")
    b = spark.createDataFrame(list(enumerate(text)), "id int, score double")
    got = [(r.id, r.score) for r in hybrid.fuse(c, b, alpha, "id").orderBy("rank").collect()]
    assert [g[0] for g in got] == [g[0] for g in golden] and [g[1] for g in got] == pytest.approx([g[1] for g in golden], abs=1e-6)


FILTER_CASES = [
    ({"source": "main.rs", "type": "code", "lines": 100}, ["source:*.rs", "type=code", "lines>50", "lines>=100", "lines<=100", "lines<101", "type!=text", "lines!=5"], ["lines>100", "lines<100", "type!=code", "lines > 50"]),
    ({"type": "code", "lang": "rust"}, ["type in [code,text,doc]", "type not_in [text,doc]", "absent not_in [a]"], ["type in [text,doc]", "type not_in [code,text]", "absent in [a]"]),
    ({"type": "code", "lines": 100}, ["type=code,lines>50", "type=code AND lines>50", "type=code OR type=text"], ["type=code,lines>200", "type=text OR type=doc", "type=text,lines>50"]),
    ({"source": "/path/to/main.rs"}, ["source~main", "source:*main*", "source^/path", "source:/path*", "source$.rs", "source?", "source:*"], ["missing?", "source~MAIN", "source^main"]),
    ({"n": "100", "b": True, "x": None, "a": [1], "o": {"p": {"q": 7}}}, ["n=100x OR n>=5", "n<=5", "b=true", "x?", "a?", "o.p.q=7", "o.p.q>6", "b!=1", "a!=1", "n!=100"], ["n=100", "n>5", "n<5", "b=1", "a=1", "o.p=7", "o.z?", "x=0"]),
    ({"f": 1.5}, ["f=1.5", "f>1", "f in [1.5,2]"], ["f=1", "f>1.5"]),
]


def test_filters_on_json(spark):
    for meta, yes, no in FILTER_CASES:
        one = spark.createDataFrame([(json.dumps(meta),)], "m string")
        got = one.select(*[filters.compile_filter(t, filters.Json("m")).alias(f"c{i}") for i, t in enumerate(yes + no)]).first()
        assert list(got) == [True] * len(yes) + [False] * len(no), (meta, [t for t, g in zip(yes + no, got) if g != (t in yes)])


def test_filters_on_columns_push_down(spark, tmp_path):
    rows = spark.createDataFrame([(1, "main.rs", 100, 1.5, True), (2, None, None, None, None)], "id int, source string, lines bigint, f double, b boolean")
    cases = {"source:*.rs": [1], "lines>50": [1], "lines!=100": [2], "lines>=abc": [1], "lines>abc": [], "source not_in [x]": [1, 2], "source in [main.rs,x]": [1], "absent?": [], "absent!=1": [1, 2], "b=true": [1], "f=1.5": [1], "lines=abc": [], "source?": [1], "lines in [100,abc]": [1], "source~5": []}
    for text, ids in cases.items():
        assert [r.id for r in rows.where(filters.compile_filter(text, filters.Typed(rows))).orderBy("id").collect()] == ids, text
    rows.write.parquet(str(tmp_path / "t"))
    own = spark.read.parquet(str(tmp_path / "t"))
    plan = own.where(filters.compile_filter("lines>50,source^ma", filters.Typed(own)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(lines,50)" in plan and "StringStartsWith(source,ma)" in plan
    nested = spark.createDataFrame([((("x", 3),),)], "meta struct<in:struct<k:string,n:int>>")
    assert nested.where(filters.compile_filter("meta.in.n=3,meta.in.k=x", filters.Typed(nested))).count() == 1


def test_filter_parsing():
    c = filters.parse
    assert c("a=1") == filters.Condition("a", "eq", 1) and c("a=1.0").value == 1.0 and c("a=true").value is True and c("a=x").value == "x"
    assert c("a:b*c") == filters.Condition("a", "eq", "b*c") and c("k in [a, 2]").value == ["a", 2] and c("k in []").value == [""]
    assert c("a>=1,b in [x,y]").parts[1].value == ["x", "y"]
    assert filters.from_dict({"or": [{"field": "a", "op": "exists"}, {"and": [{"field": "b", "op": "notin", "value": [1]}]}]}).parts[0].op == "exists"
    with pytest.raises(filters.FilterError):
        c("nonsense")
    with pytest.raises(filters.FilterError):
        c("a=1,nonsense")
    assert c("a=1,nonsense", strict=False) == filters.Condition("a", "eq", 1)
    with pytest.raises(filters.FilterError):
        c("  ")


def test_expansion(spark):
    docs = passages(spark, ["database index tuning index", "database index storage engine", "unrelated words entirely", "fn rebuild_index(x) database"])
    got = expansion.expand("database", docs, "pos", n=3)
    assert got.startswith("database ") and "index" in got and len(got.split()) == 4
    assert expansion.expand("one two three four", docs, "pos") == "one two three four"
    assert expansion.expand("zzz", docs, "pos") == "zzz"


def test_search_filters_before_or_after_ranking(spark):
    own = spark.createDataFrame([(i, f"text {i}", "en" if i % 4 == 0 else "de") for i in range(40)], "id bigint, text string, lang string")
    emb = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(45)], "id bigint, embedding array<float>")
    before = search(own, emb, [1.0, 0.0], SearchOptions(3, filter="lang=en")).orderBy("rank").collect()
    assert [r.id for r in before] == [36, 32, 28]
    after = search(own, emb, [1.0, 0.0], SearchOptions(3, filter="lang=en", post_filter=True)).orderBy("rank").collect()
    assert [r.id for r in after] == [36, 32]
    plain = search(own, emb, [1.0, 0.0], SearchOptions(3)).collect()
    assert len(plain) == 0  # the three best vectors have no passage
    assert not wants_hybrid(SearchOptions(hybrid=True)) and wants_hybrid(SearchOptions(auto_hybrid=True, query_text="two words"))
    fused = search(own, emb, [1.0, 0.0], SearchOptions(5, hybrid=True, query_text="text 7", filter="lang=de")).orderBy("rank").collect()
    assert all(0 <= r.score <= 1 for r in fused) and [r["rank"] for r in fused] == [1, 2, 3, 4, 5]
    assert search(own.limit(0), emb, [1.0, 0.0], SearchOptions(5, hybrid=True, query_text="text", filter="lang=de")).count() == 0


def test_inverted_file_probes_what_the_recall_needs(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 32))  # no clusters: a quarter of the lists isn't enough
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>")
    vectors.InvertedFile.build(own, "id", lists=16).save(str(tmp_path / "ivf"))
    index = vectors.InvertedFile.load(spark, str(tmp_path / "ivf"), "id")
    asked = own.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    for k in (10, 100):
        got = {(r.query_id, r.id) for r in index.search_many(asked, k).collect()}
        best = {(q, int(i)) for q in range(0, 1500, 50) for i in np.argsort(-(x @ x[q]))[:k]}
        assert len(got & best) >= 0.9 * len(best)
    one = {r.id for r in index.search(x[50].tolist(), 10).collect()}
    assert one == {i for q, i in {(r.query_id, r.id) for r in index.search_many(asked, 10).collect()} if q == 50}
