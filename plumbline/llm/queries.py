"""The registered queries of the training-data problems and the SQL that some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, latest, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# 1. Splitting oversized items -----------------------------------------------------------------------------------


@query
def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all oversized chunks and blocks."""
    from plumbline.llm.split import items_of, split_oversized

    return split_oversized(items_of(table(spark, d, "chunks"), table(spark, d, "code_blocks")), table(spark, d, "chunker_settings"))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The items that the splitter had to cut: each has a second piece."""
    return p1_pieces(spark, d).where("piece_no = 1").select("item_kind", "item_id")


SQL["p1_found"] = """
WITH items AS (
  SELECT 'chunk' AS item_kind, chunk_id AS item_id, index_name, text FROM chunks
  UNION ALL SELECT 'block', block_id, index_name, content FROM code_blocks)
SELECT DISTINCT item_kind, item_id FROM items LEFT JOIN chunker_settings USING (index_name)
WHERE strlen(text) > 4 * coalesce(chunk_size, 256)"""


# 2. Nearest vectors ---------------------------------------------------------------------------------------------


@query
def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors of the same index for every usable vector."""
    from plumbline.llm.knn import nearest

    return nearest(table(spark, d, "vectors"), table(spark, d, "index_meta"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of at least 0.85 cosine of which one is among the five nearest of the other."""
    from plumbline.llm.knn import similar_pairs

    return similar_pairs(p2_nearest(spark, d))


SQL["p2_found"] = """
WITH arrivals AS (SELECT vec_id, arg_max({'i': index_name, 'e': embedding}, ingested_at) AS r FROM vectors GROUP BY vec_id),
v AS (
  SELECT vec_id, r.i AS index_name, r.e::DOUBLE[] AS e, sqrt(list_dot_product(r.e::DOUBLE[], r.e::DOUBLE[])) AS norm
  FROM arrivals JOIN index_meta m ON m.index_name = r.i
  WHERE len(r.e) = m.dimensions AND len(list_filter(r.e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(r.e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.e, b.e) / (a.norm * b.norm) AS cosine
  FROM v a JOIN v b ON a.index_name = b.index_name AND a.vec_id <> b.vec_id),
near AS (SELECT a, b, cosine FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM near WHERE cosine >= 0.85"""


# 3. Files nobody wrote by hand here -----------------------------------------------------------------------------


@query
def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """Features, evidence and verdict of every file of program code."""
    from plumbline.llm.handwritten import judge_files

    return judge_files(table(spark, d, "chunks", "chunk_id"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that are generated, minified, copied from elsewhere, or data saved as code."""
    return p3_files(spark, d).where("elsewhere").select("source")


# 4. Near-duplicates ---------------------------------------------------------------------------------------------


@query
def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's class of equal word sets, with the number of its copies and of its links to other classes."""
    from plumbline.llm.neardup import similar_classes

    return similar_classes(table(spark, d, "chunks", "chunk_id"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks whose sets of words have a similarity of at least 0.7."""
    from plumbline.llm.neardup import similar_chunks

    return similar_chunks(table(spark, d, "chunks", "chunk_id"))


SQL["p4_found"] = """
WITH arrivals AS (
  SELECT chunk_id, arg_max(text, ingested_at) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id),
w AS (
  SELECT DISTINCT chunk_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z0-9]+'))) AS word FROM arrivals),
words AS (SELECT chunk_id, word FROM w WHERE length(word) > 1),
n AS (SELECT chunk_id, count(*) AS n FROM words GROUP BY chunk_id),
shared AS (
  SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS k FROM words a JOIN words b ON a.word = b.word AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM shared JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b
WHERE 10 * k >= 7 * (x.n + y.n - k)"""


# 5. Credentials -------------------------------------------------------------------------------------------------


def _items(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.llm.secrets import all_items

    return all_items(table(spark, d, "chunks", "chunk_id"), table(spark, d, "code_blocks", "block_id"))


@query
def p5_credentials(spark: SparkSession, d: str) -> DataFrame:
    """Every credential with its place in the text and its score."""
    from plumbline.llm.secrets import find

    return find(_items(spark, d))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines on which credentials begin."""
    return p5_credentials(spark, d).select("item_kind", "item_id", "line_no").distinct()


@query
def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts that hold credentials, with these masked."""
    from plumbline.llm.secrets import redact

    return redact(_items(spark, d))


@query
def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """By kind of item, the masked texts that have another length or other changes than to asterisks."""
    from plumbline.llm.secrets import redact

    items = _items(spark, d)
    before = latest(items, ["item_kind", "item_id"], "ingested_at", "text").withColumnRenamed("text", "before")
    both = redact(items).join(before, ["item_kind", "item_id"])
    changed = F.exists(F.arrays_zip(F.split("before", "").alias("a"), F.split("text", "").alias("b")), lambda x: (x["a"] != x["b"]) & (x["b"] != "*"))
    broken = both.select("item_kind", ((F.length("before") != F.length("text")) | changed).cast("long").alias("broken"))
    kinds = spark.createDataFrame([("chunk", 0), ("block", 0)], "item_kind string, broken bigint")
    return broken.unionByName(kinds).groupBy("item_kind").agg(F.sum("broken").alias("broken"))


SQL["p5_checks"] = "SELECT unnest(['chunk', 'block']) AS item_kind, 0::BIGINT AS broken"


# 6. Packing -----------------------------------------------------------------------------------------------------


@query
def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in the sequences of each limit."""
    from plumbline.llm.pack import pack

    return pack(table(spark, d, "documents", "doc_id"), table(spark, d, "pack_limits"))


@query
def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the sequences of each limit are filled."""
    from plumbline.llm.pack import fill_report

    return fill_report(p6_pack(spark, d))


@query
def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per limit: documents placed, sequences over the capacity, documents cut without need or not whole."""
    packed = checkpointed(p6_pack(spark, d))
    bins = packed.groupBy("limit_name", "container").agg((F.sum("n_tokens") > F.max("capacity_tokens")).cast("long").alias("over")).groupBy("limit_name").agg(F.sum("over").alias("over_full"))
    per = packed.groupBy("limit_name", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("last"), F.count("*").alias("parts"), F.max("capacity_tokens").alias("capacity"))
    cut = ((F.col("parts") > 1) & (F.col("n") <= F.col("capacity"))).cast("long")
    docs = per.groupBy("limit_name").agg(F.count("*").alias("docs"), F.sum(cut).alias("cut_without_need"), F.sum((F.col("n") != F.col("last")).cast("long")).alias("not_whole"))
    return docs.join(bins, "limit_name").select("limit_name", "docs", "over_full", "cut_without_need", "not_whole")


SQL["p6_checks"] = """
SELECT limit_name, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS docs, 0::BIGINT AS over_full, 0::BIGINT AS cut_without_need, 0::BIGINT AS not_whole
FROM pack_limits WHERE limit_name IS NOT NULL AND capacity_tokens >= 1"""


# 7. Mixing ------------------------------------------------------------------------------------------------------


@query
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The selected documents with their numbers of copies."""
    from plumbline.llm.mix import mix

    return mix(table(spark, d, "documents", "doc_id"), table(spark, d, "mix_targets"))[0]


@query
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each named source."""
    from plumbline.llm.mix import mix, share_report

    return share_report(*mix(table(spark, d, "documents", "doc_id"), table(spark, d, "mix_targets")))


@query
def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per named source: whether its quota is met to half its longest document and no document comes too often."""
    from plumbline.llm.mix import mix, share_report

    selection, quotas = mix(table(spark, d, "documents", "doc_id"), table(spark, d, "mix_targets"))
    selection = checkpointed(selection)
    longest = selection.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    rows = share_report(selection, quotas).join(quotas.select("source", "quota"), "source").join(longest, "source", "left")
    met = F.abs(F.col("mixed_tokens") - F.col("quota")) <= F.coalesce(F.col("longest"), F.lit(0)) / 2 + 1
    return rows.select("source", met.alias("quota_met"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"))


SQL["p7_checks"] = "SELECT DISTINCT source, true AS quota_met, true AS repeats_kept FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 AND max_repeats >= 1"


# 8. Spam pages --------------------------------------------------------------------------------------------------


@query
def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Spam share, mean PMI and share of repeated collocations of every document."""
    from plumbline.llm.spam import score_pages

    return score_pages(table(spark, d, "documents", "doc_id"))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents most of whose words are keyword, link or tag spam."""
    return p8_scores(spark, d).where("is_spam").select("doc_id")
