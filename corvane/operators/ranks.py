"""Order statistics of whole tables without a sort of them: counts by bucket, of which there are BUCKETS at most
whatever the table's size, tell the bucket that holds the rank, and only its rows are looked at again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: Rows of a bucket that are few enough to be sorted.
FEW = 10_000


def _bucket_of(counts: list[tuple[int, int]], rank: int) -> tuple[int, int, int]:
    """(bucket, its rows, rank in it) of the row of that rank, from 1."""
    for b, c in sorted(counts):
        if rank <= c:
            return b, c, rank
        rank -= c
    raise ValueError("the rank is beyond the table")


def hashed_at(keys: DataFrame, rank: int) -> str:
    """The value of that rank (from 1) of a column `k` of texts that begin with a hash in hexadecimal digits."""
    rest, digits = keys.select("k"), 0
    while True:
        by = F.conv(F.substring("k", digits + 1, 4), 16, 10).cast("int")
        counts = rest.groupBy(by.alias("b")).count().collect()
        b, n, rank = _bucket_of([(r[0], r[1]) for r in counts], rank)
        rest, digits = rest.where(by == b), digits + 4
        if n <= FEW or digits >= 32:
            # beyond 32 digits a bucket holds one key only
            return rest.orderBy("k").offset(rank - 1).first()[0] if n <= FEW else rest.first()[0]


def number_at(values: DataFrame, rank: int) -> int:
    """The value of that rank (from 1) of a column `v` of whole numbers without nulls."""
    rest = values.select(F.col("v").cast("decimal(20,0)").alias("v"))
    while True:
        low, high, n = rest.agg(F.min("v"), F.max("v"), F.count("v")).first()
        if low == high:
            return int(low)
        if n <= FEW:
            return int(rest.orderBy("v").offset(rank - 1).first()[0])
        width = (int(high) - int(low)) // BUCKETS + 1
        by = F.floor((F.col("v") - F.lit(low)) / F.lit(width)).cast("int")
        b, _, rank = _bucket_of([(r[0], r[1]) for r in rest.groupBy(by.alias("b")).count().collect()], rank)
        rest = rest.where(by == b)


def narrowed(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, v double, c, r: the 0-based rank sought among the c's summed) that are left when each group keeps the
    one of BUCKETS even steps from its least to its greatest v that holds the rank; r is the rank among those."""
    edges = rows.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    step = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS))).otherwise(0)
    placed = rows.join(edges, by).withColumn("b", step.cast("int"))
    counts = placed.groupBy(*by, "b").agg(F.sum("c").alias("in"), F.first("r").alias("rank"))
    counts = counts.withColumn("upto", F.sum("in").over(Window.partitionBy(*by).orderBy("b")))  # BUCKETS rows a group at most
    found = counts.where("upto > rank AND upto - in <= rank").select(*by, "b", F.expr("rank - (upto - in)").alias("left"))
    return placed.join(found, [*by, "b"]).select(*by, "v", "c", F.col("left").alias("r"))


def hash_key(key: Column, seed: str) -> Column:
    """md5(seed|key) and the key: the order of samples and splits."""
    return F.concat(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary")), key.cast("string"))
