"""Results as text, JSON or Markdown. Results are bounded by top_k."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import preview


def text_line(rank: str = "rank", score: str = "score", text: str = "text", size: int = 200) -> Column:
    return F.concat(F.col(rank).cast("string"), F.lit(". [score: "), F.format_string("%.4f", F.col(score)), F.lit("] "), preview(text, size))


def to_text(results: DataFrame, metadata: tuple[str, ...] = ()) -> str:
    """One line per result; metadata columns follow, source first."""
    lines = []
    for r in results.withColumn("_line", text_line()).orderBy("rank").collect():
        lines.append(r["_line"])
        lines += [f"   {k}: {r[k]}" for k in sorted(metadata, key=lambda k: (k != "source", k)) if r[k] is not None]
    return "\n".join(lines)


def to_dicts(results: DataFrame, metadata: tuple[str, ...] = ()) -> list[dict]:
    rows = results.orderBy("rank").collect()
    return [{"id": str(r["id"]), "score": float(r["score"]), "text": r["text"], "metadata": {k: r[k] for k in metadata if r[k] is not None}} for r in rows]


def to_json(results: DataFrame, metadata: tuple[str, ...] = ()) -> str:
    return json.dumps(to_dicts(results, metadata), indent=2, ensure_ascii=False, default=str)


def to_markdown(results: DataFrame, metadata: tuple[str, ...] = ()) -> str:
    parts = [f"## Result {i} (score: {r['score']:.4f})\n" + (f"Source: {r['metadata']['source']}\n" if "source" in r["metadata"] else "") + f"\n{r['text']}" for i, r in enumerate(to_dicts(results, metadata), 1)]
    return "\n\n".join(parts) or "No results found."
