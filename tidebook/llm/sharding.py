"""Sharding by jump consistent hashing: no ring table, and appending a shard moves only the rows that
the new shard takes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import filed, place, stored

#: Fixed values of the published hash: the multiplier of its generator.
MULTIPLIER = 2862933555777941757
#: Rows of a file that are numbered together.
BLOCK_ROWS = 1 << 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. One more shard takes 1/(shards + 1) of the keys, others stay."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.uint64, copy=True)
    out, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    left = np.arange(len(key))
    while len(left):
        out[left] = ahead[left]
        key[left] = key[left] * np.uint64(MULTIPLIER) + np.uint64(1)
        ahead[left] = ((out[left] + 1) * (float(1 << 31) / ((key[left] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        left = left[ahead[left] < shards]
    return out


def jump_udf(shards: int):
    @F.pandas_udf(T.IntegerType())
    def shard_of(key: pd.Series) -> pd.Series:
        return pd.Series(jump(key.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard_of


def key_of(docs: DataFrame, id_col: str) -> Column:
    """64-bit key: integers as they are, other ids by their hash; null as 0."""
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    key = F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    return F.coalesce(key, F.lit(0).cast("long"))


def written_order(file: str) -> list[Column]:
    """Files as they were written: by folder, then by the part number as a number (part-100000 comes after part-99999), then
    by name; files without one come first in their folder."""
    part = F.regexp_extract(file, r"part-([0-9]{1,18})[^/]*$", 1)
    return [F.regexp_replace(file, r"[^/]*$", ""), F.when(part != "", part.cast("long")), F.col(file)]


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    The law is `key`: id and shard count decide the shard, so repeated rows and rows of one id share
    it. Integer ids are keys themselves, others are hashed to 64 bits; null ids are keyed by 0, as id 0 is.
    Size: UTF-8 bytes of the text (null: none) plus 16. Slots run gapless from 0 in each shard, in the
    order of the rows in docs: by folder, part number of the file, name and index in it, so a table that was written in training
    order is numbered in that order, however many files it has. grown_shard is the shard with one shard more. Empty input gives no rows;
    other columns are not read.
    """
    docs = filed(docs.select(id_col, text_col))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 16
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        key_of(docs, id_col).alias("key"),
        place(docs).alias("place"),
    )
    rows = rows.select(
        "doc_id", "size", "text_crc32", "place.file", "place.row", jump_udf(shards)("key").alias("shard"), jump_udf(shards + 1)("key").alias("grown_shard")
    )
    # Slots in two steps, as a shard is too large for one task: rows are numbered within (shard, block of
    # a file), whatever their ids, and blocks are offset by the sizes of those before.
    rows = stored(rows.withColumn("block", F.floor(F.col("row") / BLOCK_ROWS)), "shards", narrow=False)
    block = rows.groupBy("shard", "file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(*written_order("file"), "block").rowsBetween(Window.unboundedPreceding, -1)
    block = block.select("shard", "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "file", "block").orderBy("row")
    numbered = rows.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(block, ["shard", "file", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("base") + F.col("at")).alias("slot"),
        "grown_shard",
    )
