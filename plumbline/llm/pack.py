"""Problem 6: fill sequences of fixed token capacity with documents.

Cost-balanced packing: a document of n tokens costs n + n²/attention_scale (linear layers plus attention inside
the document). Documents go in descending order to the sequence of the lowest cost that still has room; sequences
without room for the current size are parked by their room and return when the sizes have come down to it. The
number of sequences a group starts with is the least that could hold its tokens; one is opened only when no open
sequence has room.

Scale: documents are spread over groups of a bounded number of items by a hash of their id, and each group is
packed by itself in one task, so no task sees more than about ``group_items`` items, whatever the corpus holds;
a group leaves at most a few sequences partly empty. The group number of a limit follows from the number of its
items. A document over the capacity is cut into pieces of exactly the capacity and a rest; no other is cut.

Defined cases: null, empty and tokenless texts get no row; repeated doc_ids count once (the longest text);
limits with a null name or a capacity under one are left out, of a repeated limit the largest capacity counts;
empty tables give no rows. Ties are broken by doc_id and piece number.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plumbline.llm.tokens import TOKENIZERS, with_token_counts

GROUP_ITEMS = 20_000
ATTENTION_SCALE = 4096.0


def assign(sizes: list[int], capacity: int, scale: float = ATTENTION_SCALE) -> list[int]:
    """The sequence of each item; sizes descend and keep the capacity."""
    count = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    open_ = [(0.0, i) for i in range(count)]  # a heap by cost
    room = [capacity] * count
    parked: list[tuple[int, float, int]] = []  # a heap by descending room
    out = []
    for n in sizes:
        while parked and -parked[0][0] >= n:
            _, cost, i = heapq.heappop(parked)
            heapq.heappush(open_, (cost, i))
        while open_ and room[open_[0][1]] < n:
            cost, i = heapq.heappop(open_)
            heapq.heappush(parked, (-room[i], cost, i))
        if open_:
            cost, i = heapq.heappop(open_)
        else:
            cost, i = 0.0, len(room)
            room.append(capacity)
        room[i] -= n
        out.append(i)
        if room[i]:
            heapq.heappush(open_, (cost + n + n * n / scale, i))
    return out


def pack(docs: DataFrame, limits: DataFrame, group_items: int = GROUP_ITEMS, folder: str = TOKENIZERS) -> DataFrame:
    """limit_name, capacity_tokens, container, doc_id, part_no, parts, token_start, n_tokens."""
    counted = with_token_counts(docs.where("doc_id is not null and text is not null and text <> ''"), ["doc_id"], folder=folder)
    counted = counted.groupBy("doc_id").agg(F.max("n_tokens").alias("doc_tokens")).where("doc_tokens > 0")
    caps = limits.where("limit_name is not null and capacity_tokens >= 1").groupBy("limit_name").agg(F.max("capacity_tokens").cast("long").alias("capacity_tokens"))
    # every document goes into a container of each limit: the list of limits is one value of the plan
    caps = caps.agg(F.sort_array(F.collect_list(F.struct("limit_name", "capacity_tokens"))).alias("limits"))
    cap = F.col("limit.capacity_tokens")
    items = (
        counted.select("doc_id", "doc_tokens", F.explode(caps.scalar()).alias("limit"))
        .withColumn("parts", F.ceil(F.col("doc_tokens") / cap).cast("int"))
        .select("limit.limit_name", "limit.capacity_tokens", "doc_id", "doc_tokens", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part_no"))
        .withColumn("token_start", F.col("part_no") * F.col("capacity_tokens"))
        .withColumn("n_tokens", F.least("capacity_tokens", F.col("doc_tokens") - F.col("token_start")))
    )
    # full pieces fill a sequence alone; the others are spread over groups of bounded size
    rows = docs.select("doc_id").where("doc_id is not null").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / group_items)).cast("long").alias("groups"))
    items = items.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", F.lit(6)), rows.scalar()).cast("int"))
    columns = ["limit_name", "capacity_tokens", "bin_group", "doc_id", "part_no", "parts", "token_start", "n_tokens"]
    shown = ["limit_name", "capacity_tokens", "container", "doc_id", "part_no", "parts", "token_start", "n_tokens"]
    full = items.where("n_tokens = capacity_tokens").withColumn("container", F.concat_ws("/", "limit_name", F.lit("full"), "doc_id", "part_no"))
    rest = items.where("n_tokens < capacity_tokens").select(*columns)
    schema = StructType([*rest.schema.fields, StructField("bin_no", LongType())])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "part_no"], ascending=[False, True, True])
        return pdf.assign(bin_no=assign(pdf.n_tokens.tolist(), int(pdf.capacity_tokens.iloc[0])))

    packed = rest.groupBy("limit_name", "capacity_tokens", "bin_group").applyInPandas(fill, schema)
    return packed.withColumn("container", F.concat_ws("/", "limit_name", "bin_group", "bin_no")).select(shown).unionByName(full.select(shown))


def fill_report(packed: DataFrame) -> DataFrame:
    """Per limit: sequences used, the least that could hold the tokens, and the share of capacity filled."""
    bins = packed.groupBy("limit_name", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    return bins.groupBy("limit_name", "capacity_tokens").agg(F.count("*").alias("bins"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens")).select(
        "limit_name", "capacity_tokens", "bins", "items", "tokens",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"),
        F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6).alias("fill"),
    )
