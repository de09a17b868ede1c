"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The jump consistent hash of each unsigned 64-bit key: with one more shard, keys move only into the new one."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.uint64).copy()
    bucket, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = ahead[live]
        key[live] = key[live] * _STEP + np.uint64(1)
        ahead[live] = ((bucket[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[ahead[live] < shards]
    return bucket


def assign(rows: DataFrame, shards: int, key: str = "key") -> DataFrame:
    """rows with `shard` and `grown_shard` (with one more shard), both int, from a long column `key`. No shuffle."""

    def run(batches):
        for batch in batches:
            k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            shard = pa.array(jump(k, shards).astype(np.int32))
            grown = pa.array(jump(k, shards + 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, shard, grown], [*batch.schema.names, "shard", "grown_shard"])

    from pyspark.sql.types import IntegerType, StructType

    schema = StructType([*rows.schema.fields]).add("shard", IntegerType()).add("grown_shard", IntegerType())
    return rows.mapInArrow(run, schema)


def shard_documents(docs: DataFrame, shards: int = 16, slice_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): law is `key`, so doc_id and shard count decide the shard.

    size: UTF-8 bytes plus 1 (null text: 1, checksum 0). slot numbers each shard's rows from 0 without gaps, in an order
    fixed by doc_id, checksum and size. Numbering is dealt over slices of doc_id's hash, sized by `slice_rows`, with each
    slice's start from the slices' counts, so no task sees a whole shard. Equal doc_ids share a shard; a null doc_id is
    hashed like a value. Rows that repeat get a slot each; an empty table gives no rows.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(docs["doc_id"].cast("long")).alias("key"),
    )
    total = docs.count()
    slices = max(1, -(-total // (shards * slice_rows)))
    slices = max(slices, min(64, -(-total // 2000)))
    placed = assign(base, shards).withColumn("slice", F.pmod(F.hash("key", F.lit(7)), F.lit(slices)))
    from pyspark.sql import Window

    within = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")))
    ahead = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "slice").count().select("shard", "slice", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    return within.join(starts, ["shard", "slice"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard"
    )
