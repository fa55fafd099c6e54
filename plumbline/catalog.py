"""The life of an index: create, append, prune, remove, list, search.

An index is a folder with ``passages`` (id BIGINT, source, text, chunk columns), ``vectors`` (id, embedding), ``bm25``
(the persisted term statistics), ``ivf`` for approximate backends, and ``meta.json``. Everything heavy is written by
Spark jobs; the driver handles only the metadata document. Roots are local paths or URIs of shared storage.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.pdf import extract_text
from plumbline.operators import embed as emb
from plumbline.operators.chunking import chunk_table
from plumbline.operators.expansion import expand
from plumbline.operators.bm25 import TermIndex
from plumbline.operators.ids import numbered
from plumbline.operators.search import SearchOptions, recompute_search, search, wants_hybrid
from plumbline.operators.vectors import InvertedFile
from plumbline.sources import storage
from plumbline.sources.files import PDF, TYPES, list_files, read_texts

HOME = ".plumbline/indexes"
#: Names of approximate backends: all are inverted files here; the names of graph indexes are kept for old commands.
APPROXIMATE = ("ivf", "hnsw", "diskann")


@dataclass
class IndexMeta:
    """``passage_count`` is what was written; ``backend_name`` exact, or approximate (APPROXIMATE)."""

    version: str = "1.0"
    backend_name: str = "exact"
    embedding_model: str = "hashing"
    embedding_mode: str = "hashing"
    dimensions: int = 64
    passage_count: int = 0
    backend_kwargs: dict | None = None
    embedding_options: dict | None = None
    is_recompute: bool = False
    is_pruned: bool = False

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> IndexMeta:
        data = json.loads(storage.read_text(spark, storage.join(folder, "meta.json")))
        return cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__})

    def save(self, spark: SparkSession, folder: str) -> None:
        storage.write_text(spark, storage.join(folder, "meta.json"), json.dumps(asdict(self), indent=2))


@dataclass
class BuildOptions:
    chunk_size: int = 256
    chunk_overlap: int = 128
    strategy: str = "simple"
    file_types: Sequence[str] | None = None
    exclude_types: Sequence[str] = ()
    include_hidden: bool = False
    max_files: int | None = None
    max_file_size_kb: int = 1024
    document_prefix: str | None = None
    recompute: bool = False
    force: bool = False
    embedding: dict = field(default_factory=dict)
    pdf: Callable[[bytes], str] | None = extract_text


class Catalog:
    """Indexes under roots: by default the working folder first, then home."""

    def __init__(self, spark: SparkSession, roots: Sequence[str] | None = None):
        self.spark = spark
        self.roots = list(roots or [os.path.join(os.getcwd(), HOME), os.path.join(os.path.expanduser("~"), HOME)])

    # resolution and listing

    def find(self, name: str) -> str:
        """Folder of an index: under the first root, then an absolute path, then under the other roots."""
        absolute = storage.is_absolute(name)
        places = ["" if absolute else storage.join(self.roots[0], name), name if absolute else "", *("" if absolute else storage.join(r, name) for r in self.roots[1:])]
        for folder in places:
            if folder and storage.exists(self.spark, storage.join(folder, "meta.json")):
                return folder
        raise FileNotFoundError(f"no index {name!r}")

    def list(self) -> list[dict]:
        """name, folder, status (OK or INCOMPLETE), passages, backend and bytes of all indexes."""
        out = []
        for root in self.roots:
            for name in storage.names(self.spark, root):
                folder = storage.join(root, name)
                if not storage.is_folder(self.spark, folder):
                    continue
                size = storage.size(self.spark, folder)
                ok = storage.exists(self.spark, storage.join(folder, "meta.json")) and storage.is_folder(self.spark, storage.join(folder, "passages"))
                meta = IndexMeta.load(self.spark, folder) if ok else None
                out.append({"name": name, "folder": folder, "status": "OK" if ok else "INCOMPLETE", "passage_count": meta and meta.passage_count, "backend": meta and meta.backend_name, "size_mb": round(size / 1e6, 3)})
        return out

    # building

    def _provider(self, meta: IndexMeta, options: dict | None = None):
        own = {"dimensions": meta.dimensions} if meta.embedding_mode == "hashing" else {"model": meta.embedding_model}
        return emb.provider(meta.embedding_mode, **{**own, **(options or {})})

    def _chunks(self, docs: DataFrame, o: BuildOptions) -> DataFrame:
        return chunk_table(docs, ["source"], "text", "source", o.chunk_size, o.chunk_overlap, o.strategy)

    def _documents(self, paths: Sequence[str], o: BuildOptions) -> DataFrame:
        types = o.file_types or [*TYPES, *([PDF] if o.pdf else [])]
        files = list_files(self.spark, paths, types, o.exclude_types, o.include_hidden, o.max_files, o.max_file_size_kb)
        return read_texts(self.spark, files, paths, o.pdf).select(F.col("path").alias("source"), "text")

    def _write(self, folder: str, chunks: DataFrame, meta: IndexMeta, o: BuildOptions, start: int, mode: str) -> int:
        rows = numbered(chunks, ["source", "ordinal"], "id", start)
        rows.write.mode(mode).parquet(storage.join(folder, "passages"))
        written = self.spark.read.parquet(storage.join(folder, "passages")).where(F.col("id") >= start)
        TermIndex.build(written, "id").save(storage.join(folder, "bm25"), mode)
        if not meta.is_recompute:
            prefix = (meta.embedding_options or {}).get("document_prefix", "")
            vectors = rows.select("id", emb.embed_column(self._provider(meta, o.embedding), "text", prefix).alias("embedding"))
            vectors = vectors.withColumn("embedding", F.when(F.size("embedding") == meta.dimensions, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("wrong width: "), F.size("embedding")))))
            vectors.write.mode(mode).parquet(storage.join(folder, "vectors"))
            if meta.backend_name in APPROXIMATE:
                self._write_lists(folder, meta, start)
        return rows.count()

    def _write_lists(self, folder: str, meta: IndexMeta, start: int) -> None:
        """The inverted file: built with the index, later vectors go to the lists of the existing centroids."""
        path, stored = storage.join(folder, "ivf"), self.spark.read.parquet(storage.join(folder, "vectors"))
        if storage.is_folder(self.spark, path):
            index = InvertedFile.load(self.spark, path, "id")
            InvertedFile.build_with(index.centroids, stored.where(F.col("id") >= start), "id").save(path, "append")
        else:
            InvertedFile.build(stored, "id", lists=(meta.backend_kwargs or {}).get("lists")).save(path)

    def build(self, name: str, docs: DataFrame | Sequence[str], meta: IndexMeta | None = None, options: BuildOptions | None = None) -> IndexMeta:
        """Creates an index from files or from a table (source, text). An existing one is an error without force."""
        o, meta = options or BuildOptions(), meta or IndexMeta()
        folder = storage.join(self.roots[0], name)
        if storage.exists(self.spark, folder):
            if not o.force:
                raise FileExistsError(f"index {name!r} exists")
            storage.delete(self.spark, folder)
        prefix = o.document_prefix if o.document_prefix is not None else emb.model_config(meta.embedding_model).document_prefix
        meta.is_recompute = o.recompute
        meta.embedding_options = {**(meta.embedding_options or {}), "document_prefix": prefix, "chunk_size": o.chunk_size, "chunk_overlap": o.chunk_overlap, "strategy": o.strategy}
        frame = docs if isinstance(docs, DataFrame) else self._documents(docs, o)
        meta.passage_count = self._write(folder, self._chunks(frame, o), meta, o, 1, "errorifexists")
        meta.save(self.spark, folder)
        return meta

    def update(self, name: str, docs: DataFrame | Sequence[str], options: BuildOptions | None = None) -> IndexMeta:
        """Appends documents with the same pipeline, prefix and provider; ids go on after the last."""
        folder = self.find(name)
        meta, o = IndexMeta.load(self.spark, folder), options or BuildOptions()
        if meta.backend_name == "diskann":
            raise ValueError("this backend cannot be updated: build the index anew")
        frame = docs if isinstance(docs, DataFrame) else self._documents(docs, o)
        last = self.passages(name).agg(F.max("id")).first()[0] or 0
        meta.passage_count += self._write(folder, self._chunks(frame, o), meta, o, last + 1, "append")
        meta.save(self.spark, folder)
        return meta

    def prune(self, name: str) -> bool:
        """Drops the stored vectors; searches then embed what the filter leaves. False if there are none."""
        folder = self.find(name)
        meta = IndexMeta.load(self.spark, folder)
        stored = storage.join(folder, "vectors")
        if meta.is_pruned or not storage.is_folder(self.spark, stored):
            return False
        storage.delete(self.spark, stored)
        storage.delete(self.spark, storage.join(folder, "ivf"))
        meta.is_pruned = True
        meta.save(self.spark, folder)
        return True

    def places(self, name: str) -> list[str]:
        """All folders of that name."""
        return [f for f in (storage.join(r, name) for r in self.roots) if storage.is_folder(self.spark, f)]

    def remove(self, name: str, force: bool = False, confirm: str | None = None, folder: str | None = None) -> None:
        """Deletes an index. Its name must be repeated unless forced; of several ``folder`` must be the one that is meant."""
        found = self.places(name)
        if not found:
            raise FileNotFoundError(f"no index {name!r}")
        if folder is None and len(found) > 1 or folder is not None and folder not in found:
            raise ValueError(f"{name!r} is ambiguous: {found}")
        if not force and confirm != name:
            raise ValueError("repeat the name of the index to remove it")
        storage.delete(self.spark, folder or found[0])

    # reading

    def passages(self, name: str) -> DataFrame:
        return self.spark.read.parquet(storage.join(self.find(name), "passages"))

    def terms(self, name: str) -> TermIndex | None:
        """The persisted term statistics; None for an index of an earlier version without them."""
        path = storage.join(self.find(name), "bm25")
        return TermIndex.load(self.spark, path, "id") if storage.is_folder(self.spark, path) else None

    def get(self, name: str, id_: int) -> dict:
        rows = self.passages(name).where(F.col("id") == id_).limit(1).collect()
        if not rows:
            raise KeyError(id_)
        return rows[0].asDict()

    def search(self, name: str, query: str, options: SearchOptions | None = None, expand_query: bool = False, prefix: str | None = None) -> DataFrame:
        """Search by text: expansion and hybrid for short queries if asked for; pruned indexes rank exactly only."""
        folder = self.find(name)
        meta, o = IndexMeta.load(self.spark, folder), options or SearchOptions()
        passages = self.passages(name)
        own = self._provider(meta)
        head = emb.query_prefix(prefix, meta.embedding_options, meta.embedding_model)
        if meta.is_pruned or meta.is_recompute:
            stored = (meta.embedding_options or {}).get("document_prefix", "")
            return recompute_search(passages, emb.embed_query(own, query, head), lambda t: emb.embed_column(own, t, stored), o.top_k, filter=o.filter)
        o = SearchOptions(**{**o.__dict__, "query_text": o.query_text or query})
        o = SearchOptions(**{**o.__dict__, "hybrid": wants_hybrid(o)})
        terms = self.terms(name)
        text = expand(query, passages, "id", terms=terms) if expand_query else query
        o = SearchOptions(**{**o.__dict__, "query_text": text, "auto_hybrid": False})
        vectors = self.spark.read.parquet(storage.join(folder, "vectors"))
        lists = storage.join(folder, "ivf")
        index = InvertedFile.load(self.spark, lists, "id") if storage.is_folder(self.spark, lists) else None
        return search(passages, vectors, emb.embed_query(own, text, head), o, index=index, terms=terms)
