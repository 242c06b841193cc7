"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1.  Each partition of the input counts its rows.
2.  The driver draws how many rows each partition sends to each shard: row after row of the matrix from the
    multivariate hypergeometric law, without replacement from what each shard may still take.  Given these
    counts, a uniform permutation of all rows deals out its rows just so.
3.  Each partition permutes its rows: batch by batch it draws the batch's share of its counts, again
    hypergeometrically, and deals them in random order.  Nothing larger than a batch is held.
4.  Rows meet by (shard, cell), a cell being a random part of a shard of CELL rows at most, about, and are permuted
    again by a random key; the counts of the cells before a row, and its place in its cell, are its slot.

The matrix has partitions x shards numbers; rows and texts never come to the driver.  The frame is written to the
checkpoint folder once, before it is counted.  All draws depend on the seed and the partition's number alone, so
a task that reads it again, for the counts of cells or after a loss, deals its rows alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import common as C

CELL = 50_000
#: Largest side of a hypergeometric draw that numpy makes.
SIDE = 10**9 - 1


def matrix(counts: list[int], shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows each partition sends to each shard, size of each shard); sizes differ by one at most."""
    n = sum(counts)
    size = np.array([n // shards + (k < n % shards) for k in range(shards)], np.int64)
    draw, left = np.random.default_rng(seed), size.copy()
    out = np.zeros((len(counts), shards), np.int64)
    for i, c in enumerate(counts):
        out[i] = _deal(draw, left, c)
        left -= out[i]
    return out, size


def _deal(draw: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """n draws without replacement from urns of `left`; one urn after the other, for any sizes."""
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for k, x in enumerate(left.tolist()):
        rest -= x
        take = _taken(draw, x, rest, n)
        out[k], n = take, n - take
    return out


def _taken(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are among the `good`.  Beyond what numpy draws, by inversion of the
    same law around its mode, over 40 spreads on either side (the rest holds under 1e-300)."""
    if good + bad == 0 or n == 0:
        return 0
    if max(good, bad) <= SIDE:
        return int(draw.hypergeometric(good, bad, n))
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), lo), hi)
    spread = (n * good * bad * max(1, good + bad - n) / ((good + bad) ** 2 * max(1, good + bad - 1))) ** 0.5
    width = int(40 * spread) + 100
    up = np.arange(mode, min(hi, mode + width), dtype=np.float64)
    down = np.arange(mode, max(lo, mode - width), -1, dtype=np.float64)
    rise = np.cumsum(np.log((good - up) / (up + 1)) + np.log((n - up) / (bad - n + up + 1)))
    fall = np.cumsum(np.log(down / (good - down + 1)) + np.log((bad - n + down) / (n - down + 1)))
    weight = np.exp(np.concatenate([fall[::-1], [0.0], rise]))
    total = np.cumsum(weight)
    return mode - len(fall) + int(np.searchsorted(total, draw.random() * total[-1], "right"))


def shuffle_into_shards(rows: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """`rows` with two more columns: shard (int, from 0) and slot (long, gapless from 0 in each shard).
    Shard sizes differ by one at most and every assignment is equally likely.

    Nulls anywhere, repeated rows and ties do not matter: rows are told apart by place alone.  A column of
    the input that is called shard, slot, __cell or __key is replaced.  An empty table gives no rows."""
    spark = rows.sparkSession
    rows = C.cut(rows.drop("shard", "slot", "__cell", "__key"))
    count = {r[0]: r[1] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    parts = sorted(count)
    sent, size = matrix([count[p] for p in parts], shards, seed)
    cells = max(1, -(-int(size.max(initial=0)) // CELL), -(-2 * C.shuffle_width(spark) // shards))
    plan = spark.sparkContext.broadcast({p: sent[i] for i, p in enumerate(parts)})
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in (("shard", T.IntegerType()), ("__cell", T.IntegerType()), ("__key", T.LongType())))])

    def deal(batches):
        p = TaskContext.get().partitionId()
        draw, left = np.random.default_rng([seed, p]), plan.value.get(p, np.zeros(shards, np.int64)).copy()
        for b in batches:
            if not len(b):
                continue
            share = _deal(draw, left, len(b))
            left -= share
            shard = draw.permutation(np.repeat(np.arange(shards), share)).astype(np.int32)
            cell, key = draw.integers(0, cells, len(b), dtype=np.int32), draw.integers(-(2**63), 2**63 - 1, len(b))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard), pa.array(cell), pa.array(key)], schema.names)

    dealt = rows.mapInArrow(deal, schema)
    before = dealt.groupBy("shard", "__cell").count().withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("__cell")) - F.col("count"))
    place = F.row_number().over(Window.partitionBy("shard", "__cell").orderBy("__key", *[c for c, t in rows.dtypes if t in ("bigint", "string")]))
    out = dealt.withColumn("__place", place - 1)
    # one number for each cell: at most a row for every CELL rows, and joined by the same keys
    out = out.join(before.drop("count"), ["shard", "__cell"]).withColumn("slot", (F.col("before") + F.col("__place")).cast("long"))
    return out.select(*rows.columns, "shard", "slot")
