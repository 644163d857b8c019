"""Sharding by global byte-size prefix sums.

Documents are put in ascending order of doc_id by a range partitioning of slim rows (no
texts), written once to the shared folder so that a lost executor can't change the order.
Each partition's totals (rows and bytes) go through one prefix sum over the partitions; a
document's global first byte is its partition's plus the running sum inside. The total is
cut at equal targets: shard = floor(n_shards * (first byte + size / 2) / total). Shards
are contiguous in doc_id, and each differs from the target by less than a document.

Law ``bytes``: sizes near equal. Equal texts are not kept together: a group of copies may
hold a third of all bytes, which no shard of equal size could take.

Defined cases: a null text counts 0 bytes plus 1 and has the crc of the empty text; a null
doc_id comes first; repeated doc_ids are ordered by crc, then by size; rows that tie in all three are
told apart by nothing but their slots. A very long text is one row like any other. An empty table
gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeloom.llm.common import stored, whole_text

N_SHARDS = 16


def shard(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: a row for each document."""
    text = whole_text(docs).cast("binary")
    slim = docs.select(docs["doc_id"].alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    ordered = slim.repartitionByRange("doc_id", "text_crc32").withColumn("part", F.spark_partition_id())
    ordered = stored(ordered, "shard-order")
    # A row for each partition: the number of partitions, not of documents.
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    earlier = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"{c}_before")
    before = totals.select(F.col("part").alias("p"), earlier("bytes"), earlier("rows"), F.sum("bytes").over(every).alias("total"))
    inside = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    running = ordered.withColumn("b", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("r", F.coalesce(F.count("*").over(inside), F.lit(0)))
    placed = running.join(before, F.col("part") == F.col("p"))
    first = F.col("bytes_before") + F.col("b")
    cut = F.least(F.lit(n_shards - 1), F.expr(f"{n_shards} * (2 * (bytes_before + b) + size) div (2 * total)")).cast("int")
    numbered = stored(placed.select("doc_id", "size", "text_crc32", cut.alias("shard"), (F.col("rows_before") + F.col("r")).alias("row"), first.alias("first_byte")), "shard-rows")
    starts = numbered.groupBy("shard").agg(F.min("row").alias("shard_row")).withColumnRenamed("shard", "s")  # n_shards rows
    joined = numbered.join(F.broadcast(starts), F.col("shard") == F.col("s"))
    slot, grown = F.col("row") - F.col("shard_row"), F.lit(None).cast("int")
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), grown.alias("grown_shard"), "first_byte")
