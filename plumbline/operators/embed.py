"""Embedding providers, prefixes and the model registry.

A provider turns texts into vectors in batches; ``embed_column`` runs one inside a pandas UDF, created once in each
worker. Without network the hashing provider gives deterministic vectors; HTTP providers are used when asked for.
"""

from __future__ import annotations

import json
import os
import re
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ModelConfig:
    document_prefix: str = ""
    query_prefix: str = ""
    normalized: bool = False
    dimensions: int = 768


_BGE_QUERY = "Represent this sentence for searching relevant passages: "
_MXBAI_DOCUMENT = "Represent this document for retrieval: "

#: Model name -> (document prefix, query prefix, normalised, width), the models' own conventions.
MODELS: dict[str, ModelConfig] = {
    "nomic-embed-text": ModelConfig("search_document: ", "search_query: ", True, 768),
    "nomic-embed-text-v1": ModelConfig("search_document: ", "search_query: ", True, 768),
    "nomic-embed-text-v1.5": ModelConfig("search_document: ", "search_query: ", True, 768),
    "text-embedding-nomic-embed-text-v1.5": ModelConfig("search_document: ", "search_query: ", True, 768),
    "mxbai-embed-large": ModelConfig(_MXBAI_DOCUMENT, _BGE_QUERY, True, 1024),
    "mxbai-embed-large-v1": ModelConfig(_MXBAI_DOCUMENT, _BGE_QUERY, True, 1024),
    "bge-small-en": ModelConfig("", _BGE_QUERY, True, 384),
    "bge-base-en": ModelConfig("", _BGE_QUERY, True, 768),
    "bge-large-en": ModelConfig("", _BGE_QUERY, True, 1024),
    "bge-small-en-v1.5": ModelConfig("", _BGE_QUERY, True, 384),
    "bge-base-en-v1.5": ModelConfig("", _BGE_QUERY, True, 768),
    "bge-large-en-v1.5": ModelConfig("", _BGE_QUERY, True, 1024),
    "e5-small": ModelConfig("passage: ", "query: ", True, 384),
    "e5-base": ModelConfig("passage: ", "query: ", True, 768),
    "e5-large": ModelConfig("passage: ", "query: ", True, 1024),
    "e5-small-v2": ModelConfig("passage: ", "query: ", True, 384),
    "e5-base-v2": ModelConfig("passage: ", "query: ", True, 768),
    "e5-large-v2": ModelConfig("passage: ", "query: ", True, 1024),
    "multilingual-e5-small": ModelConfig("passage: ", "query: ", True, 384),
    "multilingual-e5-base": ModelConfig("passage: ", "query: ", True, 768),
    "multilingual-e5-large": ModelConfig("passage: ", "query: ", True, 1024),
    "gte-small": ModelConfig("", "", True, 384),
    "gte-base": ModelConfig("", "", True, 768),
    "gte-large": ModelConfig("", "", True, 1024),
    "all-minilm": ModelConfig("", "", True, 384),
    "all-MiniLM-L6-v2": ModelConfig("", "", True, 384),
    "all-MiniLM-L12-v2": ModelConfig("", "", True, 384),
    "text-embedding-3-small": ModelConfig("", "", True, 1536),
    "text-embedding-3-large": ModelConfig("", "", True, 3072),
    "text-embedding-ada-002": ModelConfig("", "", True, 1536),
}


def model_config(model: str) -> ModelConfig:
    """Prefixes and width of a known model; a ``:tag`` is dropped; unknown models have none and 768."""
    return MODELS.get(model.split(":", 1)[0], ModelConfig())


#: Widths of models that their providers document beside the registry.
WIDTHS = {"nomic-embed-text": 768, "mxbai-embed-large": 1024, "all-minilm": 384, "bge-m3": 1024, "snowflake-arctic-embed": 1024, "text-embedding-004": 768, "embedding-001": 768}


def dimensions(own, probe: str = "width") -> int:
    """Width of a provider's vectors: its own, that of a known model, else that of the reply to a probe."""
    if isinstance(getattr(own, "dimensions", None), int):
        return own.dimensions
    base = own.model.split(":", 1)[0]
    known = MODELS[base].dimensions if base in MODELS else WIDTHS.get(base)
    return known or len(own.embed([probe])[0])


def with_prefix(text: str | Column, prefix: str) -> Column:
    """The prompt template before the text; an empty template changes nothing."""
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(prefix), t) if prefix else t


def query_prefix(explicit: str | None, stored: dict | None, model: str) -> str:
    """Of the call, else of the index's options, else of the registry."""
    if explicit is not None:
        return explicit
    return (stored or {}).get("query_prefix") or model_config(model).query_prefix


class HttpError(RuntimeError):
    pass


def error_message(body: str) -> str:
    """error.message, error, message or detail of a JSON error reply; else the reply itself."""
    try:
        data = json.loads(body)
    except ValueError:
        return body
    if not isinstance(data, dict):
        return body
    error = data.get("error")
    if isinstance(error, dict) and isinstance(error.get("message"), str):
        return error["message"]
    return next((x for x in (error, data.get("message"), data.get("detail")) if isinstance(x, str)), body)


def post_json(url: str, payload: dict, headers: dict[str, str] | None = None, timeout: float = 120.0) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.loads(reply.read())
    except urllib.error.HTTPError as e:
        raise HttpError(f"{e.code}: {error_message(e.read().decode('utf-8', 'replace'))}") from e


@dataclass
class HashingProvider:
    """Deterministic vectors without a model: signed hashes of the tokens, of unit length."""

    dimensions: int = 64
    model: str = "hashing"
    batch_size: int = 1000

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            for token in re.findall("[a-z0-9]{2,}", (text or "").lower()):
                h = int.from_bytes(blake2b(token.encode(), digest_size=8).digest(), "little")
                row[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        norms = np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)
        return (out / norms).tolist()


@dataclass
class OpenAiProvider:
    """Any server with the OpenAI embeddings interface."""

    model: str = "text-embedding-3-small"
    api_key: str = ""
    base_url: str = "https://api.openai.com/v1"
    batch_size: int = 100

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for lo in range(0, len(texts), self.batch_size):
            reply = post_json(f"{self.base_url.rstrip('/')}/embeddings", {"model": self.model, "input": texts[lo : lo + self.batch_size]}, {"Authorization": f"Bearer {self.api_key}"} if self.api_key else None)
            out += [r["embedding"] for r in sorted(reply["data"], key=lambda r: r.get("index", 0))]
        return out


@dataclass
class OllamaProvider:
    model: str = "nomic-embed-text"
    host: str = "http://localhost:11434"
    batch_size: int = 32

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for lo in range(0, len(texts), self.batch_size):
            out += post_json(f"{self.host.rstrip('/')}/api/embed", {"model": self.model, "input": texts[lo : lo + self.batch_size]})["embeddings"]
        return out


@dataclass
class GeminiProvider:
    model: str = "text-embedding-004"
    api_key: str = ""
    batch_size: int = 100
    base_url: str = field(default="https://generativelanguage.googleapis.com/v1beta")

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for lo in range(0, len(texts), self.batch_size):
            requests = [{"model": f"models/{self.model}", "content": {"parts": [{"text": t}]}} for t in texts[lo : lo + self.batch_size]]
            reply = post_json(f"{self.base_url}/models/{self.model}:batchEmbedContents?key={self.api_key}", {"requests": requests})
            out += [e["values"] for e in reply["embeddings"]]
        return out


@dataclass
class LocalProvider:
    """A model on disk: a folder with model.onnx and tokenizer.json. Masked mean pooling, then unit length by default."""

    model: str
    batch_size: int = 32
    normalize: bool = True

    def __post_init__(self):
        if not os.path.isfile(os.path.join(self.model, "model.onnx")):
            raise FileNotFoundError(f"no model.onnx in {self.model}")

    def _load(self):
        if not hasattr(self, "_session"):
            import onnxruntime
            from tokenizers import Tokenizer

            self._session = onnxruntime.InferenceSession(os.path.join(self.model, "model.onnx"))
            self._tokenizer = Tokenizer.from_file(os.path.join(self.model, "tokenizer.json"))
            self._tokenizer.enable_padding()
            self._tokenizer.enable_truncation(512)
        return self._session, self._tokenizer

    def embed(self, texts: list[str]) -> list[list[float]]:
        session, tokenizer = self._load()
        known = {i.name for i in session.get_inputs()}
        out: list[list[float]] = []
        for lo in range(0, len(texts), self.batch_size):
            rows = tokenizer.encode_batch(texts[lo : lo + self.batch_size])
            ids, mask = (np.array([getattr(r, k) for r in rows], dtype=np.int64) for k in ("ids", "attention_mask"))
            given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            hidden = session.run(None, {k: v for k, v in given.items() if k in known})[0]
            pooled = (hidden * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
            if self.normalize:
                pooled = pooled / np.maximum(np.sqrt((pooled * pooled).sum(1, keepdims=True)), 1e-12)
            out += pooled.tolist()
        return out


PROVIDERS = {"hashing": HashingProvider, "openai": OpenAiProvider, "ollama": OllamaProvider, "gemini": GeminiProvider, "local": LocalProvider}


def provider(mode: str, **options):
    if mode not in PROVIDERS:
        raise ValueError(f"unknown embedding provider: {mode}")
    return PROVIDERS[mode](**{k: v for k, v in options.items() if v is not None})


def embed_column(own, text: str | Column, prefix: str = "") -> Column:
    """The vectors of a text column; null text gives null. A reply of another length than its batch is an error."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            given = texts[texts.notna()]
            vectors = own.embed(given.tolist()) if len(given) else []
            if len(vectors) != len(given):
                raise ValueError(f"{len(vectors)} vectors for {len(given)} texts")
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            for i, v in zip(given.index, vectors):
                out.at[i] = v
            yield out

    return run(with_prefix(text, prefix))


def embed_query(own, text: str, prefix: str = "") -> list[float]:
    return own.embed([prefix + text])[0]
