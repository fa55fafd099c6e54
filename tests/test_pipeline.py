"""Chunkers, sources, catalog, shells, streaming, answers."""

from __future__ import annotations

import io
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline import cli, config, server, sinks
from plumbline.catalog import BuildOptions, Catalog, IndexMeta
from plumbline.operators import chunking, embed, ids, rag
from plumbline.operators.search import SearchOptions
from plumbline.sources import exchange, files
from plumbline.streaming import append


# chunkers


def test_simple_chunker():
    c = lambda t, s, o: [x.text for x in chunking.simple_chunks(t, s, o)]
    assert c("", 4, 2) == [""] and c("  abcd  ", 2, 0) == ["  abcd  "]
    assert c("aaaa bbbb cccc dddd", 2, 0) == ["aaaa", "bbbb", "cccc", "dddd"]
    assert c("x" * 40, 4, 0) == ["x" * 16, "x" * 16, "x" * 8]
    assert c(" " + "x" * 20, 2, 0) == ["x" * 8, "x" * 8, "x" * 4]
    assert c("é" * 9, 2, 0) == ["éééé", "éééé", "é"]
    assert c("aaaa bbbb cccc", 2, 1) == ["aaaa", "bbbb", "bbbb", "cccc"]  # the second start lies before a space
    assert c("aa bb cc dd ee", 3, 1) == ["aa bb cc dd", "c dd ee"]
    assert [x.chunk_index for x in chunking.simple_chunks("aaaa bbbb cccc", 2, 0)] == [0, 1, 2]


@given(st.text(alphabet="ab é語\n\t", max_size=300), st.integers(1, 12), st.integers(0, 14))
@settings(max_examples=120, deadline=None)
def test_simple_chunks_end_and_keep_the_limit(text, size, overlap):
    out = chunking.simple_chunks(text, size, overlap)
    assert all(len(c.text.encode()) <= size * 4 for c in out) or len(out) == 1
    kept = "".join(c.text for c in out)
    assert set(text.split()) == set() or kept


RUST = 'use std::io;\n\nfn hello() {\n    println!("hi {}", 1);\n}\n\nfn second() {\n    hello();\n}\n'
PYTHON = "import os, sys, json\n# a comment line\n\nclass A:\n    def one(self):\n        pass\n\n    def two(self):\n        pass\n\ndef free():\n    return 1\n"


def test_code_chunker():
    rust = chunking.code_chunks(RUST, "a/main.rs", 256, 64)
    assert [(c.chunk_type, c.name, c.start_line, c.end_line) for c in rust] == [("ast", "hello", 3, 5), ("ast", "second", 7, 9)]
    py = chunking.code_chunks(PYTHON, "m.py", 256, 64)
    assert [(c.chunk_type, c.block_type, c.name) for c in py] == [("context", None, None), ("ast", "class", "A"), ("ast", "function", "free")]
    assert py[0].start_line == 1 and py[0].end_line == 3
    assert chunking.code_chunks("no blocks here", "x.py", 256, 64)[0].chunk_type == "simple"
    assert chunking.code_chunks(RUST, "x.unknown", 256, 64)[0].chunk_type == "simple"
    unbalanced = chunking.code_blocks(["fn f() {"] + ["x"] * 80, "rust")
    assert (unbalanced[0].start_line, unbalanced[0].end_line) == (0, 50)
    tail = chunking.code_chunks(RUST + "// the end of this file, which is kept\n", "a.rs", 256, 64, keep_tail=True)
    assert tail[-1].chunk_type == "context" and "kept" in tail[-1].text


@pytest.mark.parametrize("overlap", [0, 19, 20, 128])
def test_oversized_blocks_end(overlap):
    text = "fn big() {\n" + "\n".join("    let value = compute(1234567);" for _ in range(60)) + "\n}\n"
    parts = chunking.code_chunks(text, "a.rs", 256, overlap)
    assert [c.part for c in parts] == list(range(len(parts))) and parts[0].name == "big_part0" and parts[-1].end_line == 62
    covered = {n for c in parts for n in range(c.start_line, c.end_line + 1)}
    assert covered == set(range(1, 63))


def test_chunk_table_and_function(spark):
    docs = spark.createDataFrame([(1, RUST, "m.rs", "x"), (2, None, "n.md", "x"), (3, "", "n.md", "x"), (4, "word " * 900, None, "x")], "id bigint, text string, path string, name string")
    rows = chunking.chunk_table(docs, ["id"], "text", "path").collect()
    assert {r.id for r in rows} == {1, 3, 4} and sorted(r.ordinal for r in rows if r.id == 1) == [0, 1]
    chunking.register(spark)
    docs.createOrReplaceTempView("chunk_docs")
    got = spark.sql("SELECT id, c.name FROM chunk_docs, LATERAL chunk_text(text, path, 256, 64, 'auto') c WHERE id = 1").collect()
    assert sorted(r[1] for r in got) == ["hello", "second"]
    with pytest.raises(ValueError):
        chunking.chunk_text("x", "y", strategy="none")
    assert chunking.chunk_table(docs.limit(0), ["id"]).count() == 0


def test_numbered(spark):
    rows = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "v int").repartition(5)
    assert [(r.v, r.id) for r in ids.numbered(rows, ["v"], "id", 1).orderBy("v").collect()] == [(i, i + 1) for i in range(50)]
    assert ids.numbered(rows.limit(0), ["v"]).count() == 0


# sources


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for name, content in {
        "a.py": PYTHON, "b.md": "# Title\n\nSome prose about vector search.\n", "c.bin": "x", "noext": "x", "big.json": "1" * 11000, "small.json": "{}", "node_modules/x.js": "var x", "sub/d.rs": RUST, "skip/e.py": "e = 1", "logs/f.txt": "f",
        ".hidden/g.py": "g = 1", ".gitignore": "skip/\n*.txt\n!logs/keep.txt\n", "logs/keep.txt": "keep this",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    (root / "bad.md").write_bytes(b"\xff\xfe\xfa bad")
    return root


def test_listing_and_reading(spark, tree):
    names = lambda df: sorted(r.path.removeprefix(str(tree) + "/") for r in df.collect())
    listed = files.list_files(spark, [str(tree)])
    assert names(listed) == ["a.py", "b.md", "bad.md", "logs/keep.txt", "small.json", "sub/d.rs"]
    assert names(files.list_files(spark, [str(tree)], types=[".py", ".rs"], excluded=[".rs"])) == ["a.py"]
    assert names(files.list_files(spark, [str(tree)], max_files=2)) == ["a.py", "b.md"]
    assert "node_modules/x.js" in names(files.list_files(spark, [str(tree)], pruned=False))
    read = files.read_texts(spark, listed, [str(tree)])
    assert names(read) == ["a.py", "b.md", "logs/keep.txt", "small.json", "sub/d.rs"]
    (tree / "p.pdf").write_bytes(b"%PDF text inside")
    with_pdf = files.list_files(spark, [str(tree)], types=[".pdf"])
    assert files.read_texts(spark, with_pdf, [str(tree)], pdf=lambda raw: " " + raw[5:].decode()).first().text == "text inside"


def test_exchange(spark, tmp_path):
    path = str(tmp_path / "x.passages.jsonl")
    with open(path, "w") as f:
        f.write('{"id": "1", "text": "one", "metadata": {"k": 1}}\n{"id": "2", "text": "two"}\nbroken\n{"id": "1", "text": "uno", "metadata": null}\n')
    own = exchange.read_passages(spark, path)
    assert {(r.id, r.text, r.metadata) for r in own.collect()} == {("1", "uno", "null"), ("2", "two", "null")}
    exchange.write_passages(own, str(tmp_path / "out"))
    assert {(r.id, r.text) for r in exchange.read_passages(spark, str(tmp_path / "out")).collect()} == {("1", "uno"), ("2", "two")}
    np.arange(12, dtype="<f4").tofile(str(tmp_path / "m.embeddings"))
    m = exchange.read_matrix(spark, str(tmp_path / "m.embeddings"), 4).orderBy("ordinal").collect()
    assert [r.embedding for r in m] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    (tmp_path / "ids.txt").write_text("a\nb\n")
    got = exchange.positions_to_ids(spark.range(3).withColumnRenamed("id", "ordinal"), exchange.read_ids(spark, str(tmp_path / "ids.txt")))
    assert [r.id for r in got.orderBy("ordinal").collect()] == ["a", "b", "2"]
    assert exchange.foreign_format(b"IxFI....") == "faiss" and exchange.foreign_format(b"PAR1") is None


# catalog and shells


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, [str(tmp_path / "local"), str(tmp_path / "home")])


def test_index_life(spark, catalog, tree):
    meta = catalog.build("code", [str(tree)], IndexMeta(), BuildOptions(strategy="auto", document_prefix="passage: "))
    assert meta.passage_count == catalog.passages("code").count() and [r.id for r in catalog.passages("code").orderBy("id").collect()] == list(range(1, meta.passage_count + 1))
    with pytest.raises(FileExistsError):
        catalog.build("code", [str(tree)])
    top = catalog.search("code", "vector search prose", SearchOptions(2)).orderBy("rank").first()
    assert top.source.endswith("b.md")
    more = spark.createDataFrame([("new.md", "An unusual zebra appears.")], "source string, text string")
    assert catalog.update("code", more).passage_count == meta.passage_count + 1
    assert catalog.passages("code").agg(F.countDistinct("id")).first()[0] == meta.passage_count + 1
    before = catalog.search("code", "unusual zebra", SearchOptions(3)).orderBy("rank").collect()
    assert catalog.prune("code") and not catalog.prune("code")
    after = catalog.search("code", "unusual zebra", SearchOptions(3, filter="source$.md")).orderBy("rank").collect()
    assert after[0].source == before[0].source == "new.md"
    assert catalog.get("code", 1)["id"] == 1
    with pytest.raises(KeyError):
        catalog.get("code", 10**9)
    assert [x["status"] for x in catalog.list()] == ["OK"]
    with pytest.raises(ValueError):
        catalog.remove("code", confirm="other")
    catalog.remove("code", confirm="code")
    with pytest.raises(FileNotFoundError):
        catalog.find("code")


def test_approximate_backend(spark, catalog):
    docs = spark.createDataFrame([(f"f{i}.md", f"passage number {i} about topic{i % 7} and word{i % 13}") for i in range(300)], "source string, text string")
    catalog.build("apx", docs, IndexMeta(backend_name="ivf", backend_kwargs={"graph_degree": 8}))
    query = "topic3 word5 passage"
    got = {r.id for r in catalog.search("apx", query, SearchOptions(5, complexity=256)).collect()}
    catalog.build("plain", docs)
    exact = {r.id for r in catalog.search("plain", query, SearchOptions(5)).collect()}
    assert got == exact
    catalog.update("apx", spark.createDataFrame([("z.md", "zebra crossing quagga")], "source string, text string"))
    assert catalog.search("apx", "zebra crossing quagga", SearchOptions(1)).first().source == "z.md"
    catalog.build("old", docs.limit(5), IndexMeta(backend_name="diskann"))
    with pytest.raises(ValueError):
        catalog.update("old", docs.limit(1))
    with pytest.raises(FileNotFoundError):
        embed.provider("local", model="/nowhere")


def test_wrong_width_is_an_error(spark, catalog):
    docs = spark.createDataFrame([("a.md", "text")], "source string, text string")
    with pytest.raises(Exception, match="wrong width"):
        catalog.build("w", docs, IndexMeta(dimensions=8), BuildOptions(embedding={"dimensions": 4}))


def test_commands_server_and_tools(spark, catalog, tree, capsys):
    assert cli.main(["build", "ix", "--docs", str(tree), "--chunking-strategy", "auto"], catalog) == 0
    capsys.readouterr()
    cli.main(["search", "vector search", "-i", "ix", "--format", "json", "--filter", "source$.md"], catalog)
    assert json.loads(capsys.readouterr().out)[0]["metadata"]["source"].endswith("b.md")
    cli.main(["search", "hello", "-i", "ix", "--no-expand", "--show-metadata"], catalog)
    assert "[score:" in capsys.readouterr().out
    cli.main(["ask", "what is hello?", "-i", "ix", "--llm", "simulated"], catalog)
    assert "what is hello?" in capsys.readouterr().out
    status, data = server.answer(catalog, "ix", "POST", "/search", {"query": "vector search", "filter": "nonsense"})
    assert status == 200 and len(data["results"]) == 5
    assert server.answer(catalog, "ix", "GET", "/health", {})[1] == {"status": "ok"}
    assert server.answer(catalog, "ix", "POST", "/search", {})[0] == 400 and server.answer(catalog, "ix", "GET", "/x", {})[0] == 404
    out = io.StringIO()
    requests = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"index": "ix", "query": "hello"}}}, {"id": 4, "method": "none"}]
    server.mcp(catalog, io.StringIO("\n".join(map(json.dumps, requests)) + "\n{"), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, None] and "Result 1" in replies[2]["result"]["content"][0]["text"]
    said: list[str] = []
    lines = iter(["/help", "question?", "/history", "/clear", "/quit"])
    cli.chat(lambda q: catalog.search("ix", q, SearchOptions(2)), rag.SimulatedModel(), lambda _: next(lines), said.append)
    assert len(said) == 3
    assert sinks.to_markdown(catalog.search("ix", "hello", SearchOptions(1)), ("source",)).startswith("## Result 1")


def test_config(tmp_path):
    c = config.Config.parse('[embedding]\nprovider = "openai"\napi_key = "k"\n[build]\nchunk_size = 99\nunknown = 1\n')
    assert (c.embedding.provider, c.build.chunk_size, c.build.chunk_overlap) == ("openai", 99, 128)
    assert '"k"' not in c.shown() and config.Config.parse(c.to_toml()) == c
    bad = tmp_path / "c.toml"
    bad.write_text("= broken")
    with pytest.warns(UserWarning):
        assert config.Config.load(str(bad)) == config.Config()
    assert config.init(str(tmp_path / "d" / "c.toml")) and not config.init(str(tmp_path / "d" / "c.toml"))


# embedding and answers


def test_models_and_messages(spark):
    m = embed.model_config
    assert m("text-embedding-nomic-embed-text-v1.5").normalized and m("text-embedding-nomic-embed-text") == m("text-embedding-nomic-embed-text-v1") == m("no-such-model") == embed.ModelConfig()
    assert m("mxbai-embed-large").dimensions == m("bge-large-en").dimensions == 1024 and m("gte-base").dimensions == m("e5-base-v2").dimensions == 768 and m("text-embedding-3-large").dimensions == 3072
    assert m("e5-small").document_prefix == "passage: " and m("bge-base-en").document_prefix == "" and m("all-minilm") == embed.ModelConfig("", "", True, 384)
    assert m("nomic-embed-text:latest").query_prefix == "search_query: " and m("bge-small-en-v1.5").dimensions == 384 and m("multilingual-e5-large").dimensions == 1024
    assert m("text-embedding-3-large").dimensions == 3072 and m("unknown") == embed.ModelConfig() and m("mxbai-embed-large").dimensions == 1024 and m("gte-base").dimensions == 768
    assert embed.query_prefix("x", {"query_prefix": "y"}, "e5-small") == "x" and embed.query_prefix(None, {"query_prefix": "y"}, "e5-small") == "y" and embed.query_prefix(None, None, "e5-small") == "query: "
    assert embed.error_message('{"error": {"message": "m"}}') == "m" and embed.error_message('{"detail": "d"}') == "d" and embed.error_message("plain") == "plain"
    own = embed.HashingProvider(16)
    rows = spark.createDataFrame([("hello world",), (None,), ("",)], "t string").select(embed.embed_column(own, "t").alias("v")).collect()
    assert np.linalg.norm(rows[0].v) == pytest.approx(1, abs=1e-6) and rows[1].v is None and rows[2].v == [0.0] * 16


def test_actions_and_answers(spark):
    p = rag.parse_action
    assert p('Action: search("big cats")') == ("search", "big cats") and p("finish(the (only) answer)") == ("finish", "the (only) answer")
    assert p("search(a) finish(b)") == ("search", "a") and p("nothing") is None
    hits = spark.createDataFrame([(2, "second"), (1, "first"), (10, "tenth")], "rank int, text string")
    assert rag.context(hits).first()[0] == "[1] first\n\n[2] second\n\n[10] tenth"
    assert rag.ask("q?", lambda q: hits.limit(0), rag.SimulatedModel()) == rag.NOTHING_FOUND
    assert "q?" in rag.ask("q?", lambda q: hits, rag.SimulatedModel())
    assert rag.snippet("é" * 200, 301) == "é" * 150 + "..."

    class Scripted:
        def __init__(self, *replies):
            self.replies, self.seen = list(replies), []

        def generate(self, prompt):
            self.seen.append(prompt)
            return self.replies.pop(0)

    model = Scripted("Thought: x\nAction: search(cats)", "hm", "finish(done)")
    assert rag.react("q", lambda q: hits, model) == "done" and "[10] tenth" in model.seen[1]
    assert rag.react("q", lambda q: hits, Scripted("The answer is 4")) == "The answer is 4"
    assert rag.react("q", lambda q: hits, Scripted("hm", "finish(late)"), max_steps=1) == "late"


def test_stream(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    docs = spark.createDataFrame([("a.py", PYTHON), ("b.md", "text")], "source string, text string")
    docs.write.parquet(source)
    for _ in range(2):
        append.append_stream(append.stream_documents(spark, source), target, check, embed.HashingProvider(8)).awaitTermination()
    first = append.read_appended(spark, target).count()
    assert first == 4
    docs.limit(1).write.mode("append").parquet(source)
    append.append_stream(append.stream_documents(spark, source), target, check, embed.HashingProvider(8)).awaitTermination()
    assert append.read_appended(spark, target).count() == first


def _documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_chunk_stats_cut_long_texts(spark, tmp_path):
    import __spark_entry__ as e

    cases = [(1, "short", "en"), (2, "word " * 1000, "en"), (3, "ein Wört " * 700, "de"), (4, None, "de"), (5, "", None)]
    d = _documents(spark, tmp_path, [(i, t, lang, "s") for i, t, lang in cases])
    expected = {}
    for _, t, lang in cases:
        if t is not None:
            n, docs = expected.get(lang, (0, 0))
            expected[lang] = (n + len(chunking.simple_chunks(t, 256, 128)), docs + 1)
    got = {r.lang: (r.chunks, r.docs) for r in e.queries()["chunk_stats"](spark, d).collect()}
    assert got == expected and got["en"][0] > 2


def test_query_words_split_at_unicode_white_space(spark, tmp_path):
    import __spark_entry__ as e

    cases = [(i, f"{c}één{c}{c}zwei{c}") for i, c in enumerate(chunking.SPACES)] + [(100, "a\x1cb\u200bc\ufeffd"), (101, "語 é\u3000x y"), (102, " \u2003"), (103, "")]
    d = _documents(spark, tmp_path, [(i, t, "en", "s") for i, t in cases] + [(104, None, "en", "s")])
    got = {r.doc_id: r.n_words for r in e.queries()["query_words"](spark, d).collect()}
    assert got == {i: len([w for w in chunking.SPACE.split(t) if w]) for i, t in cases} and got[0] == 2 and got[100] == 1


def test_passage_lookup_joins_every_vector(spark, tmp_path):
    import __spark_entry__ as e

    d = _documents(spark, tmp_path, [(i, "é" * i, "en", "s") for i in range(1, 8)])
    spark.createDataFrame([(i, f"l{i}") for i in range(5)], "vec_id bigint, label string").write.parquet(f"{d}/embeddings.parquet")
    got = {tuple(r) for r in e.queries()["passage_lookup"](spark, d).collect()}
    assert got == {(i, f"l{i}", "en", i) for i in range(1, 5)}


def test_registered_queries_have_oracles():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "hybrid_search_filtered" in e.queries()
