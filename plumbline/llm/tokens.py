"""Token counts by a public tokenizer; the folder of its files is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("PLUMBLINE_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the byte-level vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


def encoder(folder: str = TOKENIZERS):
    """The tokenizer, loaded once in each process."""
    if folder not in _loaded:
        import tiktoken

        with open(os.path.join(folder, RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[folder] = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[folder]


def with_token_counts(df: DataFrame, keys: list[str], text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """keys plus n_tokens BIGINT; null and empty texts have no tokens."""
    narrow = df.select(*keys, F.col(text).alias("_text"))
    schema = narrow.drop("_text").schema.add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "n_tokens"])

    return narrow.mapInArrow(count, schema)
