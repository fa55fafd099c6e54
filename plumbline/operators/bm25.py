"""BM25: corpus statistics, scores and ranked search.

score(d, q) = Σ over all token occurrences of q with df > 0 of ln((N − df + 0.5)/(df + 0.5) + 1) · tf · (k1 + 1) /
(tf + k1 · (1 − b + b · dl / avgdl)).

For one query no inverted index is needed: the length and the frequencies of the few query terms are counted by
patterns in each row, and the only exchange is the one-row aggregate of N, the lengths and the document frequencies.
``materialize`` writes these few numbers per row to the checkpoint folder, so that a plan that uses the scores several
times (hybrid search does) reads the texts once.
For many queries, and for an index that is kept, the term table is used: ``TermIndex`` stores (term, key, tf) sorted
by term in partitions by a hash of the term, the lengths, and their sums; a query reads the rows of its own terms.

Defined cases: null texts are documents without tokens; an empty query scores 0 everywhere; an empty corpus has an
average length of 1.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import tokens
from plumbline.operators.ids import checkpointed

K1, B = 1.2, 0.75


def query_tokens(query: str) -> list[str]:
    return [t.lower() for t in re.findall("[a-zA-Z0-9]+", query) if len(t) > 1]


def document_lengths(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, _length(text).cast("long").alias("dl"))


def term_frequencies(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf): every distinct term of every document."""
    return docs.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row: n, total_tokens, avgdl (1.0 for an empty corpus)."""
    total = document_lengths(docs, key, text).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_tokens"))
    return total.withColumn("avgdl", F.when(F.col("n") > 0, F.col("total_tokens") / F.col("n")).otherwise(F.lit(1.0)))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _length(text: str) -> Column:
    """Number of tokens: maximal runs of two or more ASCII letters or digits."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[a-zA-Z0-9]{2,}")), F.lit(0))


def _frequency(text: str, term: str) -> Column:
    whole = f"(?i){term}(?![a-z0-9])(?<![a-z0-9]{term})"
    return F.coalesce(F.regexp_count(F.col(text), F.lit(whole)), F.lit(0))


def scores(docs: DataFrame, query: str, key: str, text: str = "text", materialize: bool = False) -> DataFrame:
    """(key, score) of every document, zeros kept."""
    wanted = Counter(query_tokens(query))
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("score"))
    counts = [_frequency(text, w).cast("double").alias(f"_f{i}") for i, w in enumerate(wanted)]
    own = docs.select(key, _length(text).cast("double").alias("_dl"), *counts)
    own = checkpointed(own) if materialize else own
    stats = own.agg(
        F.struct(
            F.count("*").cast("double").alias("n"),
            F.when(F.count("*") > 0, F.greatest(F.avg("_dl"), F.lit(1e-12))).otherwise(1.0).alias("avgdl"),
            *[F.sum((F.col(f"_f{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(wanted))],
        )
    )
    own = own.withColumn("_s", stats.scalar())
    parts = [F.when(F.col(f"_f{i}") > 0, idf(F.col("_s.n"), F.col(f"_s.df{i}")) * weight(F.col(f"_f{i}"), F.col("_dl"), F.col("_s.avgdl")) * q).otherwise(0.0) for i, q in enumerate(wanted.values())]
    return own.select(key, sum(parts, F.lit(0.0)).alias("score"))


def search(docs: DataFrame, query: str, k: int, key: str, text: str = "text") -> DataFrame:
    """(key, score, rank) of the k best documents with a positive score, ties by key."""
    best = scores(docs, query, key, text, materialize=True).where("score > 0").orderBy(F.desc(F.round("score", 9)), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), key)))


def search_many(tf: DataFrame, lengths: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    """(query_id, key, score, rank): the k best documents of each row (query_id, query) of queries.

    ``tf`` and ``lengths`` are the persisted statistics. Only terms that some query asks for are joined; the top k
    of each query is limited before and after the exchange.
    """
    asked = queries.select("query_id", F.explode(tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    hits = checkpointed(tf.join(asked.select("term").distinct(), "term", "left_semi"))  # used twice
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    total = lengths.agg(F.struct(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl")))
    rows = hits.join(df, "term").join(lengths, key).join(asked, "term").withColumn("_s", total.scalar())
    part = idf(F.col("_s.n"), F.col("df")) * weight(F.col("tf").cast("double"), F.col("dl").cast("double"), F.col("_s.avgdl")) * F.col("qtf")
    summed = rows.groupBy("query_id", key).agg(F.sum(part).alias("score"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)))
    return ranked.where(F.col("rank") <= k)


class TermIndex:
    """The persisted statistics of a corpus: terms (bucket, term, key, tf), lengths (key, dl), stats (n, total_tokens).

    Keys must not repeat. ``stats`` has a row per write, which are added up.
    """

    BUCKETS = 64

    def __init__(self, terms: DataFrame, lengths: DataFrame, stats: DataFrame, key: str):
        self.terms, self.lengths, self.stats, self.key = terms, lengths, stats, key

    @staticmethod
    def bucket(term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(TermIndex.BUCKETS)).cast("int")

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str = "text") -> TermIndex:
        tf = term_frequencies(docs, key, text).withColumn("bucket", cls.bucket(F.col("term")))
        lengths = document_lengths(docs, key, text)
        return cls(tf, lengths, lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_tokens")), key)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Range partitioning keeps the rows of a term together and splits frequent ones over several files."""
        self.terms.repartitionByRange("bucket", "term", self.key).sortWithinPartitions("bucket", "term", self.key).write.mode(mode).partitionBy("bucket").parquet(f"{path}/terms")
        self.lengths.write.mode(mode).parquet(f"{path}/lengths")
        self.stats.write.mode(mode).parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: str) -> TermIndex:
        return cls(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/lengths"), spark.read.parquet(f"{path}/stats"), key)

    def scores(self, query: str, pool: DataFrame | None = None) -> DataFrame:
        """(key, score) of the documents that have a term of the query, and one row (null, 0) if there are others.

        With ``pool`` (rows with the key) the corpus is that of the pool. Nothing but the rows of the query's terms is
        read, and with a pool the lengths.
        """
        key, wanted = self.key, Counter(query_tokens(query))
        spark = self.terms.sparkSession
        asked = spark.createDataFrame(list(wanted.items()), "term string, qtf int")  # as many rows as terms
        buckets = sorted({r[0] for r in asked.select(self.bucket(F.col("term"))).collect()})
        hits = self.terms.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(wanted))).select("term", key, "tf")
        lengths, stats = self.lengths, self.stats
        if pool is not None:
            keys = pool.select(key)
            hits, lengths = hits.join(keys, key, "left_semi"), lengths.join(keys, key, "left_semi")
            stats = lengths.agg(F.count("*").alias("n"), F.sum("dl").alias("total_tokens"))
        hits = checkpointed(hits)  # used three times
        total = stats.agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.try_divide(F.sum("total_tokens"), F.sum("n")), F.lit(1.0)).alias("avgdl")))
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        rows = hits.join(F.broadcast(df), "term").join(F.broadcast(asked), "term").join(lengths, key).withColumn("_s", total.scalar())
        part = idf(F.col("_s.n"), F.col("df")) * weight(F.col("tf").cast("double"), F.col("dl").cast("double"), F.col("_s.avgdl")) * F.col("qtf")
        found = rows.groupBy(key).agg(F.sum(part).alias("score"))
        none = hits.agg(F.count_distinct(key).alias("_m")).withColumn("_s", total.scalar()).where("_m < _s.n")
        return found.unionByName(none.select(F.lit(None).cast(dict(self.terms.dtypes)[key]).alias(key), F.lit(0.0).alias("score")))

    def search(self, query: str, k: int, pool: DataFrame | None = None) -> DataFrame:
        """(key, score, rank) of the k best documents, ties by key."""
        order = [F.desc(F.round("score", 9)), self.key]
        best = self.scores(query, pool).where("score > 0").orderBy(*order).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
