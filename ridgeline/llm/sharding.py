"""Sharding: a uniform shuffle with exact shard sizes by a hypergeometric communication matrix.

1. Rows fall into source blocks by a hash of the row; a block's rows are counted.
2. The driver draws how many rows each block sends to each shard: a multivariate hypergeometric draw, block by block,
   from what room the shards have left. It holds blocks x shards integers, whatever the number of rows.
3. Each block permutes its rows by a seeded hash and deals them out by its row of the matrix.
4. Each shard permutes what it got: rows are ranked by a second hash. The rank is found in `cells` slices of the
   hash's range, so that a shard is no single task, and the slices' counts, added up, give the slot.

Permutations are ranks of seeded hashes over the whole row, not of rand(), so a task that runs again deals as before.
Blocks are hash blocks, not physical partitions, for the same reason. Rows that are equal in all columns are
interchangeable. Law `rows`: shard sizes are at most one apart. Nulls are hashed as nulls; an empty table gives none.
Extra columns are carried along, whatever their names; columns named shard or slot are replaced.
Groups (equal texts) are dealt row by row, as a uniform shuffle must.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import documents, written


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good + bad are good: inversion outwards from the mode, O(deviation). Probabilities
    are exact but for the rounding of lgamma, which grows with the numbers: about 1e-3 of p at 1e12 rows."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    u = rng.random() - p
    up, down, p_up, p_down = mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """counts: rows of each block. Row sums are the counts, column sums the shard sizes, at most one apart."""
    rng, total = random.Random(seed), sum(counts)
    room = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = []
    for n in counts:
        row, left, rest = [], n, sum(room)
        for k in range(shards):
            got = left if k == shards - 1 else hypergeometric(rng, room[k], rest - room[k], left)
            rest -= room[k]
            room[k] -= got
            left -= got
            row.append(got)
        matrix.append(row)
    return matrix


def shuffle_shards(df: DataFrame, shards: int = 8, seed: int = 17, blocks: int | None = None, cells: int | None = None, key: list[str] | None = None) -> DataFrame:
    """df with the columns shard int and slot long. key: columns that tell rows apart (all by default).

    blocks and cells (powers of two) follow the number of rows where they are not given: at least 512 blocks and 4096
    cells of all shards, of about two million rows at most.
    """
    spark = df.sparkSession
    if blocks is None or cells is None:
        rows = df.count()
        blocks = blocks or max(512, 1 << (rows // 2_000_000).bit_length())
        cells = cells or max(512, 1 << (rows // (shards * 2_000_000)).bit_length())
    names = [c for c in df.columns if c not in ("shard", "slot")]
    # plain names inside, so that no column of df clashes with a working one
    plain = {c: f"c{i}" for i, c in enumerate(names)}
    df = df.select(*[F.col(f"`{c}`").alias(p) for c, p in plain.items()])
    row = [F.col(plain[c]) for c in key or names]
    mixed = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *row)
    dealt = df.withColumns({"_b": F.pmod(mixed(1), F.lit(blocks)).cast("int"), "_r": mixed(2), "_q": mixed(3)})
    sizes = {r["_b"]: r["n"] for r in dealt.groupBy("_b").agg(F.count("*").alias("n")).collect()}  # at most `blocks` rows
    order = sorted(sizes)
    matrix = communication_matrix([sizes[b] for b in order], shards, seed)
    ends = [(b, [sum(r[: k + 1]) for k in range(shards)]) for b, r in zip(order, matrix)]
    ends = spark.createDataFrame(ends, T.StructType([T.StructField("_b", T.IntegerType()), T.StructField("_ends", T.ArrayType(T.LongType()))]))
    ranked = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy("_r", "_q", *row)))
    sent = ranked.join(F.broadcast(ends), "_b").withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_k"))).cast("int"))
    sent = sent.withColumn("_c", _cell(F.col("_q"), cells)).drop("_b", "_r", "_k", "_ends")
    sent = written(sent, "shards")
    n = sent.groupBy("shard", "_c").agg(F.count("*").alias("n")).collect()  # at most shards x cells rows
    before, base = {}, []
    for s, c, k in sorted(map(tuple, n)):
        base.append((s, c, before.get(s, 0)))
        before[s] = before.get(s, 0) + k
    base = spark.createDataFrame(base, "shard int, _c int, _base long")
    at = F.row_number().over(Window.partitionBy("shard", "_c").orderBy("_q", *row))
    slot = sent.withColumn("_at", at).join(F.broadcast(base), ["shard", "_c"])
    return slot.select(*[F.col(p).alias(c) for c, p in plain.items()], "shard", (F.col("_base") + F.col("_at") - 1).cast("long").alias("slot"))


def _cell(q: Column, cells: int) -> Column:
    """The slice of the range of a signed 64-bit hash, in its order. cells: a power of two."""
    bits = cells.bit_length() - 1
    return (F.shiftright(q, 64 - bits) + (cells >> 1)).cast("int")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law `rows`; texts are measured where they are read and never move."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    out = shuffle_shards(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
