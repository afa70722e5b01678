"""Sharding by extendible hashing, in DataFrame operations only.

A row's hash is a string of bits. A shard is a prefix of it; a shard over its byte limit is split on the next bit, again
and again, and no other shard is. The directory lists all prefixes of one length with the shard that each belongs to.
Sums are taken by prefix (with partial sums in each task), first at a length that most shards don't exceed, then, for
rows in shards that are still too large, a few bits further.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, staged

#: Bits of the key's hash; as many bits of a row number's hash follow, so that equal keys can be told apart.
KEY_BITS = 60
#: Bits by which the directory grows in a further round.
STEP_BITS = 8


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; null: as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")



def assign_shards(rows: DataFrame, key: str, size: str, limit: int) -> DataFrame:
    """rows with shard (the prefix as a string of 0 and 1; all rows in one: empty), shard_depth, shard_bytes, shard_rows.

    Every shard has at most limit bytes, except where one row alone has more. Rows of one key lie in one shard as long
    as they fit; beyond that they are told apart by their row numbers. Null sizes count as 0; a null key is a key like
    any other. An empty table gives an empty one. All columns of rows stay; those named like the new ones are replaced.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    new = ("shard", "shard_depth", "shard_bytes", "shard_rows")
    rows = rows.drop(*new).withColumns({"_h1": key_hash(F.col(key)), "_h2": F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - KEY_BITS), "_size": F.coalesce(F.col(size).cast("long"), F.lit(0))})
    pending = rows = staged(rows, "shard-rows")
    total = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("bytes")).first()["bytes"]
    low, high = 0, min(KEY_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 2)
    done = []
    while True:
        part, held = ("_h1", high) if high <= KEY_BITS else ("_h2", high - KEY_BITS)  # the bits that this round splits on
        pending = pending.withColumns({"_a": F.shiftrightunsigned("_h1", KEY_BITS - min(high, KEY_BITS)), "_b": F.shiftrightunsigned("_h2", 2 * KEY_BITS - max(high, KEY_BITS)) if high > KEY_BITS else F.lit(0).cast("long")})
        cells = staged(pending.groupBy("_a", "_b").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n")), "shard-cells")
        name = "_a" if part == "_h1" else "_b"
        above = cells.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(high - low)))).withColumn("node", F.expr(f"shiftright({name}, up)"))
        same = F.lit(0).cast("long") if part == "_h1" else F.col("_a")
        nodes = above.groupBy("up", same.alias("root"), "node").agg(F.sum("bytes").alias("node_bytes"), F.sum("n").alias("node_rows"))
        split = (F.col("node_bytes") > limit) & (F.col("node_rows") > 1)
        # a prefix's sum is never more than that of a shorter one, so the depth of a cell's shard counts the split ones
        walked = above.withColumn("root", same).join(nodes, ["up", "root", "node"])
        best = F.min(F.when(~split, F.struct((-F.col("up")).alias("short"), "node", "node_bytes", "node_rows")))
        directory = walked.groupBy("_a", "_b").agg(F.sum(split.cast("int")).alias("splits"), best.alias("leaf"))
        last = high == 2 * KEY_BITS  # rows that no bit tells apart stay together
        directory = staged(directory.select("_a", "_b", (F.lit(low) + F.col("splits")).alias("shard_depth"), "leaf"), "shard-directory")
        placed = pending.join(directory, ["_a", "_b"])
        settled = F.lit(True) if last else F.col("leaf").isNotNull()
        bits = F.when(F.col("shard_depth") <= KEY_BITS, F.lpad(F.bin(F.expr(f"shiftright(_h1, {KEY_BITS} - least(shard_depth, {KEY_BITS}))")), F.least("shard_depth", F.lit(KEY_BITS)), F.lit("0"))).otherwise(
            F.concat(F.lpad(F.bin("_h1"), KEY_BITS, "0"), F.lpad(F.bin(F.expr(f"shiftright(_h2, {2 * KEY_BITS} - greatest(shard_depth, {KEY_BITS}))")), F.col("shard_depth") - KEY_BITS, F.lit("0")))
        )
        done.append(placed.where(settled).withColumns({"shard": bits, "shard_bytes": F.coalesce(F.col("leaf.node_bytes"), F.col("_size")), "shard_rows": F.coalesce(F.col("leaf.node_rows"), F.lit(1))}))
        if last or directory.where("leaf is null").isEmpty():
            break
        pending = staged(placed.where("leaf is null").drop("_a", "_b", "shard_depth", "leaf"), "shard-pending")
        low, high = high + 1, min(high + STEP_BITS, KEY_BITS if high < KEY_BITS else 2 * KEY_BITS)
    own = [x for x in rows.columns if x not in ("_h1", "_h2", "_size")]
    out = done[0].select(*own, *new)
    for more in done[1:]:
        out = out.unionByName(more.select(*own, *new))
    return out


def write_shards(docs: DataFrame, folder: str, limit: int, key: str = "doc_id") -> None:
    """Writes docs as Parquet, a folder for each shard. Each shard is written by one task, which its limit bounds."""
    sized = docs.withColumn("_bytes", F.octet_length("text"))
    sharded = assign_shards(sized, key, "_bytes", limit).drop("_bytes")
    sharded.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(folder)


#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    sizes = documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return assign_shards(sizes, "doc_id", "n_bytes", SHARD_BYTES).select("doc_id", "n_bytes", "shard", F.col("shard_depth").cast("int").alias("shard_depth"), "shard_bytes", "shard_rows")


OP9_SQL = f"""
WITH hashed AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h
  FROM documents
), nodes AS (
  SELECT d, h >> (60 - d) AS node, CAST(sum(n_bytes) AS BIGINT) AS node_bytes, count(*) AS node_rows
  FROM hashed, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS d) GROUP BY 1, 2
), depths AS (
  SELECT hashed.*, (SELECT CAST(count(*) AS INTEGER) FROM nodes WHERE node = h >> (60 - d) AND node_bytes > {SHARD_BYTES} AND node_rows > 1) AS depth
  FROM hashed
)
SELECT doc_id, n_bytes, lpad(bin(h >> (60 - depth)), depth, '0') AS shard, depth AS shard_depth, node_bytes AS shard_bytes, node_rows AS shard_rows
FROM depths JOIN nodes ON d = depth AND node = h >> (60 - depth)
"""
