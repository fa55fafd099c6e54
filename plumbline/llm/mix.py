"""Problem 7: select documents so that sources reach target shares of the total tokens.

1. Water filling: source s gets x_s = min(max_repeats · T_s, λ · share_s) tokens, λ chosen so that the x_s sum to
   the wanted total (T_s: tokens of the source). Sources that cannot fill their share give all they may, and the
   others share the rest in proportion to their targets.
2. Every document of the source gets ⌊x_s / T_s⌋ whole copies for certain.
3. The rest of x_s is drawn by Pareto order sampling: document i has inclusion probability
   π_i = min(1, c_s · n_tokens^length_exponent), c_s such that the expected tokens are the rest of x_s although some
   documents are certain (found from the lengths that occur in the source), a uniform number u_i from a hash of its id
   and the seed, and the rank q_i = (u_i / (1 − u_i)) / (π_i / (1 − π_i)). Documents are taken by ascending rank
   until their tokens make up the rest, the last one only if it comes nearer to the target.

Scale: the cut in the order of ranks is found from a histogram of the ranks (at most ``RANK_BUCKETS`` rows a
source), and only the one bucket in which it falls is sorted, so a source with a third of all documents is never
sorted in one task. Tables as large as mix_targets are the only ones brought into one task.

Defined cases: documents with null source, null or empty text, or of sources that are not named give nothing;
repeated doc_ids count once; a target that is null, not above 0, or may be repeated less than once gets nothing;
targets are taken in proportion to their sum; a source named twice gets the sum of its shares and the larger
max_repeats; empty tables give no rows (in the report: zero shares).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.llm.common import checkpointed
from plumbline.llm.tokens import TOKENIZERS, with_token_counts

RANK_BUCKETS = 1 << 16
RANK_SPAN = 40.0  # log ranks beyond ±RANK_SPAN share the outermost buckets


def water_fill(capacity: list[float], share: list[float], total: float) -> list[float]:
    """x_s = min(capacity_s, λ share_s) with Σ x_s = min(total, Σ capacity_s)."""
    out = [0.0] * len(share)
    left, weight = total, sum(share)
    for i in sorted((i for i in range(len(share)) if share[i] > 0), key=lambda i: capacity[i] / share[i]):
        out[i] = min(capacity[i], left * share[i] / weight if weight > 0 else 0.0)
        left -= out[i]
        weight -= share[i]
    return out


def _quotas(stats: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    clean = (
        targets.where("source is not null and target_share > 0 and not isnan(target_share) and max_repeats >= 1")
        .groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").cast("long").alias("max_repeats"))
    )
    joined = clean.join(stats, "source", "left").na.fill(0, ["tokens", "docs"])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source")
        total = float(total_tokens if total_tokens is not None else pdf.tokens.sum())
        pdf["quota"] = water_fill((pdf.tokens * pdf.max_repeats).astype(float).tolist(), pdf.target_share.tolist(), total)
        pdf["target_share"] = pdf.target_share / pdf.target_share.sum()
        return pdf

    joined = joined.withColumn("all_targets", F.lit(1))  # one group, of as many rows as targets
    schema = StructType([*joined.schema.fields, StructField("quota", DoubleType())])
    one = joined.groupBy("all_targets").applyInPandas(fill, schema).drop("all_targets")
    ratio = F.when(F.col("tokens") > 0, F.col("quota") / F.col("tokens")).otherwise(0.0)
    return one.withColumn("whole", F.floor(ratio + 1e-9)).withColumn("rest", F.greatest(F.lit(0.0), F.col("quota") - F.col("whole") * F.col("tokens")))


def inclusion_factors(lengths: DataFrame, quotas: DataFrame, exponent: float) -> DataFrame:
    """(source, factor): c with Σ min(1, c · n^exponent) · n = rest, from (source, n_tokens, docs).

    If the documents longer than n are certain, c is what is left of the rest over the weights of the others; the
    largest n that is not certain under its own c has the right one. A source has as many rows as lengths.
    """
    weight = F.pow(F.col("n_tokens").cast("double"), F.lit(float(exponent)))
    down = Window.partitionBy("source").orderBy(F.desc("n_tokens"))
    rows = lengths.join(F.broadcast(quotas.select("source", "rest")), "source").where("rest > 0.5").withColumn("weight", weight).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    longer = F.coalesce(F.sum("tokens").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum(F.col("weight") * F.col("tokens")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("factor", (F.col("rest") - longer) / others)
    return rows.where("factor * weight < 1").groupBy("source").agg(F.max_by("factor", "n_tokens").alias("factor"))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, length_exponent: float = 0.5, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """The selection (doc_id, source, n_tokens, copies) and the quotas per named source.

    ``total_tokens``: wanted size of the mix; default: the tokens of all named sources, each document once.
    """
    usable = docs.where("doc_id is not null and source is not null and text is not null and text <> ''").select("doc_id", "source", "text")
    usable = usable.join(targets.select("source"), "source", "left_semi")
    counted = with_token_counts(usable, ["doc_id", "source"], folder=folder)
    counted = checkpointed(counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("d")).select("doc_id", "d.source", "d.n_tokens").where("n_tokens > 0"))
    size = F.pow(F.col("n_tokens").cast("double"), F.lit(float(length_exponent)))
    stats = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    quotas = checkpointed(_quotas(stats, targets, total_tokens))

    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    factors = inclusion_factors(counted.groupBy("source", "n_tokens").agg(F.count("*").alias("docs")), quotas, length_exponent)
    quotas_ = quotas.join(factors, "source", "left")
    pi = F.least(F.lit(1.0), F.coalesce(F.col("factor") * size, F.lit(1.0)))
    log_rank = F.when(pi >= 1.0, F.lit(-RANK_SPAN)).otherwise(F.log(u) - F.log1p(-u) - F.log(pi) + F.log1p(-pi))
    bucket = F.floor((F.least(F.greatest(log_rank, F.lit(-RANK_SPAN)), F.lit(RANK_SPAN)) + RANK_SPAN) / (2 * RANK_SPAN) * (RANK_BUCKETS - 1)).cast("int")
    ranked = counted.join(F.broadcast(quotas_.select("source", "whole", "rest", "factor")), "source").withColumn("log_rank", F.when(F.col("rest") > 0.5, log_rank)).withColumn("bucket", F.when(F.col("rest") > 0.5, bucket))

    # where the tokens taken in order of rank reach the rest of the quota
    histogram = ranked.where("bucket is not null").groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
    cut = histogram.withColumn("upto", upto).where("upto >= rest and upto - tokens < rest")
    cut = cut.select("source", F.col("bucket").alias("cut_bucket"), (F.col("upto") - F.col("tokens")).alias("before"))
    placed = ranked.join(cut, "source", "left")
    plain = placed.where("cut_bucket is null or bucket is null or bucket <> cut_bucket").withColumn("drawn", F.when(F.col("bucket") < F.coalesce(F.col("cut_bucket"), F.lit(RANK_BUCKETS)), 1).otherwise(0))
    edge = placed.where("bucket = cut_bucket")
    order = Window.partitionBy("source").orderBy("log_rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("before") + F.sum("n_tokens").over(order)
    edge = edge.withColumn("drawn", F.when(reached - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0))
    both = plain.unionByName(edge).withColumn("copies", (F.col("whole") + F.coalesce(F.col("drawn"), F.lit(0))).cast("int"))
    return both.where("copies > 0").select("doc_id", "source", "n_tokens", "copies"), quotas


def share_report(selection: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per named source: its target and actual share, tokens, documents and the most copies of one document."""
    got = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.count("*").alias("mixed_docs"), F.max("copies").alias("most_copies"))
    rows = quotas.select("source", "target_share", "max_repeats", F.col("tokens").alias("source_tokens")).join(got, "source", "left").na.fill(0, ["mixed_tokens", "mixed_docs", "most_copies"])
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # as many rows as targets
    return rows.withColumn("actual_share", F.when(total > 0, F.col("mixed_tokens") / total).otherwise(0.0)).select("source", "target_share", "actual_share", "max_repeats", "source_tokens", "mixed_tokens", "mixed_docs", "most_copies")
