"""Karmarkar-Karp sharding (operator 10): equal texts stay together, and the shards' bytes come out near equal.

Groups of equal texts are told by a 128-bit digest (texts that should ever share one share a shard, which breaks no law). The few
groups with more than 1 / (GIANTS * shards) of all bytes, fewer than GIANTS * shards by that, go first: the differencing method runs
over them, always combining the two partial partitions with the largest spread, one in the opposite order, until one is left. All
other groups are dealt to blocks by a hash, and each block runs the same method, beginning with its part of what the shards still
differ by as one more partial partition. So blocks need nothing of each other, and the shards' sums differ by what the blocks'
spreads, a few bytes each, add up to.

Cases: null text has 0 bytes (size 1) and is a group with the empty text, but for the digest it is the empty text; repeated rows
count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


#: Groups that the driver places are fewer than so many for each shard.
GIANTS = 2_000


def differencing(parts: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """For each partial partition (its sums), the shard that each of its sums goes to. All have the same number of sums."""
    n = len(parts)
    if not n:
        return []
    k = len(parts[0])
    # nodes: (sums ascending, how the sums of its two halves, or of the part itself, come to lie in it)
    made: list = []
    heap = []
    for i, p in enumerate(parts):
        order = tuple(sorted(range(k), key=p.__getitem__))
        sums = tuple(p[j] for j in order)
        made.append(order)
        heap.append((sums[0] - sums[-1], i, sums))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    slots = range(k)
    while len(heap) > 1:
        _, a, x = pop(heap)
        _, b, y = pop(heap)
        both = [u + v for u, v in zip(x, reversed(y), strict=True)]
        order = sorted(slots, key=both.__getitem__)
        sums = tuple(both[j] for j in order)
        made.append((a, b, order))
        push(heap, (sums[0] - sums[-1], len(made) - 1, sums))
    # from the root down: where slot j of a node ends
    where: dict[int, list[int]] = {len(made) - 1: list(slots)}
    out: list = [None] * n
    for node in range(len(made) - 1, -1, -1):
        final = where.pop(node)
        if node < n:
            own = [0] * k
            for j, at in enumerate(made[node]):
                own[at] = final[j]
            out[node] = tuple(own)
        else:
            a, b, order = made[node]
            left, right = [0] * k, [0] * k
            for j, at in enumerate(order):
                left[at] = final[j]
                right[k - 1 - at] = final[j]
            where[a], where[b] = left, right
    return out


def water_level(sums: list[int], rest: int) -> float:
    """The height at which `rest` more bytes, poured over the shards' sums, come to stand."""
    s = sorted(sums)
    for n in range(1, len(s) + 1):
        level = (sum(s[:n]) + rest) / n
        if n == len(s) or level <= s[n]:
            return level
    raise AssertionError


def shard_groups(groups: DataFrame, shards: int, per_block: int = 5_000) -> DataFrame:
    """groups (key, bytes) -> key, shard. Keys are distinct."""
    spark = groups.sparkSession
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    blocks = max(1, -(-n // per_block))
    limit = total // (GIANTS * shards)
    large = groups.where(F.col("bytes") > limit).select("key", "bytes").orderBy("key").collect()  # fewer than GIANTS * shards: each has more than that share of all bytes
    at = differencing([(r["bytes"], *[0] * (shards - 1)) for r in large])
    sums = [0] * shards
    for r, x in zip(large, at, strict=True):
        sums[x[0]] += r["bytes"]
    rest = total - sum(sums)
    level = water_level(sums, rest)
    wanted = [level - x for x in sums]

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
        own = pdf["bytes"].tolist()
        share = sum(own) / max(1, rest)
        given = tuple(round((max(wanted) - w) * share) for w in wanted)  # the block's part of what the shards differ by
        at = differencing([given, *((b, *[0] * (shards - 1)) for b in own)])
        shard = {slot: k for k, slot in enumerate(at[0])}
        return pd.DataFrame({"key": pdf["key"], "shard": [shard[x[0]] for x in at[1:]]})

    small = groups.where(F.col("bytes") <= limit).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    out = small.select("block", "key", "bytes").groupBy("block").applyInPandas(run, "key binary, shard int")
    if large:
        out = out.unionByName(spark.createDataFrame([(r["key"], x[0]) for r, x in zip(large, at, strict=True)], "key binary, shard int"))
    return out


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = C.staged(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), C.crc_of_text().cast("long").alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("key"), F.monotonically_increasing_id().alias("_tie")), "sizes")
    groups = C.staged(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    shard_of = C.staged(shard_groups(groups, shards).join(groups.select("key", "n"), "key"), "group-shards")
    C.drop_stage(groups)
    placed = C.staged(C.joined(rows, shard_of, "key", "n").select("doc_id", "size", "text_crc32", "shard", "_tie"), "sharded")
    C.drop_stage(rows)
    C.drop_stage(shard_of)
    n = placed.count()
    return C.ranked(placed, ["shard"], ["doc_id", "text_crc32", "size", "_tie"], C.blocks_for(spark, n, 500_000), "slot").drop("_tie")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharded(C.documents(spark, sf_dir))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_karmarkar_karp_shards": op10_shards}
SQL: dict[str, str] = {}
