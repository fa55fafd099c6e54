"""Query expansion from the passages that BM25 ranks first."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import is_key_term, symbols, words
from plumbline.operators import bm25


def top_key_terms(texts: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(term, cnt) of the n most frequent key terms, ties in alphabetic order."""
    terms = texts.select(F.explode(words(text)).alias("term")).where(is_key_term("term"))
    return terms.groupBy("term").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "term").limit(n)


def top_symbols(texts: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(symbol, cnt) of the n most frequent names of definitions, counted once per pattern that finds them."""
    found = texts.select(F.explode(symbols(text)).alias("symbol"))
    return found.groupBy("symbol").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "symbol").limit(n)


def expansion_terms(query: str, passages: DataFrame, n: int = 5, text: str = "text") -> list[str]:
    """At most n terms that are new to the query: key terms first, then symbols. n rows each reach the driver."""
    terms = [r["term"] for r in top_key_terms(passages, n, text).collect()]
    terms += [r["symbol"] for r in top_symbols(passages, n, text).collect() if r["symbol"].lower() not in terms]
    own = {w.lower() for w in query.split()}
    return [t for t in terms if t.lower() not in own][:n]


def expand(query: str, docs: DataFrame, key: str, text: str = "text", passages: int = 5, n: int = 5, terms: bm25.TermIndex | None = None) -> str:
    """The query with new terms of its BM25 top passages; longer queries and those without hits stay as they are."""
    if len(query.split()) > 3 or not re.search(r"\S", query):
        return query
    found = terms.search(query, passages) if terms else bm25.search(docs, query, passages, key, text)
    best = [r[key] for r in found.select(key).collect()]  # a handful
    return " ".join([query, *expansion_terms(query, docs.where(F.col(key).isin(best)), n, text)]) if best else query
