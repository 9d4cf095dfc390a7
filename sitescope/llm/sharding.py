"""Sharding by minimax contiguous partition (DataFrame operations only).

Law: ``bytes``. Equal texts are one group and never part. Groups are ordered
by text digest; the atomic units are the 65,536 digest prefixes in that order,
so the ordered size list is bounded whatever the corpus holds. The smallest
shard capacity for which a greedy sweep needs no more than the wanted number
of shards is found by binary search over that list, and the list is cut there.

Defined results: a null text has size 1 and the checksum of the empty text,
and shares its group; rows with equal id and text get neighbouring slots; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import plain_text

PREFIX_DIGITS = 4  # hexadecimal digits of the digest: 65,536 ordered units
PART_ROWS, MOST_PARTS = 128, 4096  # a unit is numbered in parts of about so many rows, so many parts at most


def smallest_capacity(sizes: np.ndarray, n_shards: int) -> int:
    """Least capacity with which a greedy sweep over ``sizes`` in order fills at most ``n_shards``."""
    ends = np.cumsum(sizes, dtype=np.int64)
    if len(ends) == 0:
        return 0
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // n_shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(ends, middle, n_shards)) < n_shards:
            high = middle
        else:
            low = middle + 1
    return low


def greedy_cuts(ends: np.ndarray, capacity: int, n_shards: int) -> list[int]:
    """First unit of each shard but the first; stops once ``n_shards`` cuts were needed."""
    cuts, at, filled = [], 0, 0
    while len(cuts) < n_shards:
        at = int(np.searchsorted(ends, filled + capacity, side="right"))
        if at >= len(ends):
            break
        cuts.append(at)
        filled = int(ends[at - 1])
    return cuts


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``."""
    spark = docs.sparkSession
    text = plain_text(docs, text_col)
    unit = F.conv(F.substring(F.md5(F.encode(text, "utf-8")), 1, PREFIX_DIGITS), 16, 10).cast("int")
    rows = docs.select(docs[id_col].alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(text, "utf-8")).alias("crc"), unit.alias("unit"))

    # at most 65,536 rows come to the driver, whatever the input
    totals = rows.groupBy("unit").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy("unit").collect()
    units = np.array([r["unit"] for r in totals], dtype=np.int64)
    counts = np.array([r["n"] for r in totals], dtype=np.int64)
    sizes = np.array([r["size"] for r in totals], dtype=np.int64)
    cuts = greedy_cuts(np.cumsum(sizes, dtype=np.int64), smallest_capacity(sizes, n_shards), n_shards)
    shard = np.searchsorted(np.array(cuts, dtype=np.int64), np.arange(len(units)), side="right")
    before = np.cumsum(counts) - counts
    first = before - before[np.searchsorted(shard, shard)] if len(units) else before
    parts = np.minimum(MOST_PARTS, -(-counts // PART_ROWS))
    schema = T.StructType([T.StructField(n, T.LongType() if n == "first" else T.IntegerType())
                           for n in ("unit", "shard", "first", "parts")])
    plan = spark.createDataFrame([(int(u), int(s), int(f), int(p)) for u, s, f, p in
                                  zip(units, shard, first, parts, strict=True)], schema)

    placed = rows.join(F.broadcast(plan), "unit")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id", "crc"), F.col("parts").cast("long")).cast("int"))
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("unit", "part").orderBy("id", "crc")) - 1)
    offsets = placed.groupBy("unit", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("unit", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    return numbered.join(offsets, ["unit", "part"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("skip") + F.col("nth")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
