"""Persisted term statistics, query blocks, storage, PDF text, ignore rules; small registered queries against their SQL."""

from __future__ import annotations

import os

import numpy as np
import pytest

from plumbline.functions.pdf import extract_text
from plumbline.operators import bm25, embed, vectors
from plumbline.operators.ids import checkpointed, shared_folder
from plumbline.plans import catalogue, lifecycle
from plumbline.sources import storage
from plumbline.sources.files import ignore_rules

DATA = "/root/testdata/sf0.001"
SMALL = [
    "chunk_code_cases", "model_registry", "action_parser", "error_messages", "query_prefixes", "config_values", "answers", "file_listing", "file_texts", "file_limit", "foreign_formats",
    "chunk_strategies", "auto_hybrid", "embedding_providers", "chat_commands", "file_commands",
]


@pytest.mark.parametrize("name", SMALL)
def test_fixed_cases_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    found = catalogue.QUERIES[name](spark, DATA)
    expected = duckdb.sql(lifecycle.SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key) == sorted(duckdb.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM expected").fetchall(), key=key)


def test_term_index_agrees_with_the_scan_of_texts(spark):
    rows = [(i, " ".join(["red", "blue", "green", "red"][: i % 5] + [f"w{i % 3}"]), "a" if i % 2 else "b") for i in range(40)] + [(90, None, "a"), (91, "", "b")]
    docs = spark.createDataFrame(rows, "id bigint, text string, kind string")
    folder = shared_folder(spark)
    bm25.TermIndex.build(docs.where("id < 20"), "id").save(folder)
    bm25.TermIndex.build(docs.where("id >= 20"), "id").save(folder, "append")
    index = bm25.TermIndex.load(spark, folder, "id")
    for query in ("red", "blue blue w1", "nothing here", ""):
        for pool in (None, docs.where("kind = 'a'")):
            plain = {r.id: round(r.score, 9) for r in bm25.scores(pool if pool is not None else docs, query, "id").collect()}
            got = {r.id: round(r.score, 9) for r in index.scores(query, pool).collect()}
            assert {k: v for k, v in plain.items() if v} == {k: v for k, v in got.items() if k is not None}
            assert (None in got) == (0 in plain.values())
    empty = bm25.TermIndex.build(docs.limit(0), "id")
    assert empty.scores("red").count() == 0


def test_query_blocks_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, (0.1 * rng.standard_normal(4)).round(2).tolist()) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(50)]
    own = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    asked = own.selectExpr("id as query_id", "embedding")
    whole = sorted(map(tuple, vectors.top_k_many(own, asked, 5, "id").collect()))
    monkeypatch.setattr(vectors, "QUERY_BYTES", 600)
    assert sorted(map(tuple, vectors.top_k_many(own, asked, 5, "id").collect())) == whole
    assert [r[1] for r in whole if r[0] == 103] == [100, 101, 102, 103, 104]


def test_lists_grow_with_the_vectors(spark):
    own = spark.range(2_500).selectExpr("id", "array(cast(rand(1) as float), cast(rand(2) as float)) as embedding")
    assert len(vectors.InvertedFile.build(own, "id").centroids) == 50


def test_storage(spark, tmp_path):
    root = f"file:{tmp_path}/s"
    assert storage.names(spark, root) == [] and not storage.exists(spark, root)
    storage.write_text(spark, storage.join(root, "a", "b.txt"), "é\n")
    assert storage.read_text(spark, storage.join(root, "a", "b.txt")) == "é\n" and storage.size(spark, root) == 3
    assert storage.names(spark, root) == ["a"] and storage.is_folder(spark, storage.join(root, "a"))
    assert storage.delete(spark, root) and not storage.exists(spark, root)
    assert storage.is_absolute("/x") and storage.is_absolute("hdfs://h/x") and not storage.is_absolute("x/y")


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpointed(Frame())
    assert shared_folder(spark) != shared_folder(spark)


def test_pdf_text():
    import zlib

    body = zlib.compress(b"BT (a\\)b) Tj T* <4142> Tj 0 -1 Td [(c) 3 (\\144)] TJ ET")
    assert extract_text(b"%PDF\nstream\n" + body + b"\nendstream") == "a)b\nAB\ncd"
    assert extract_text(b"no pdf") == "" and extract_text(b"") == ""


def test_global_ignore_rules(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    os.makedirs(tmp_path / "config" / "git")
    (tmp_path / "config" / "git" / "ignore").write_text("*.tmp\n")
    os.makedirs(tmp_path / "r" / ".git" / "info")
    (tmp_path / "r" / ".git" / "info" / "exclude").write_text("# x\n!keep.tmp\n")
    root = str(tmp_path / "r")
    assert ignore_rules(root) == [(root, "*.tmp", False), (root, "keep.tmp", True)]


def test_widths(monkeypatch):
    own = embed.OllamaProvider("bge-m3:latest")
    assert embed.dimensions(own) == 1024 and embed.dimensions(embed.OpenAiProvider("text-embedding-3-large")) == 3072
    other = embed.OllamaProvider("strange")
    monkeypatch.setattr(type(other), "embed", lambda self, texts: [[0.0] * 7 for _ in texts])
    assert embed.dimensions(other) == 7
