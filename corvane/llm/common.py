"""Shared pieces of the training-data operators: vectorised text hashing over
Arrow buffers, reliable checkpoints, bounded Bloom filters for pruning.

Text is treated as UTF-8 bytes straight from the Arrow buffer, so no Python
string is built for a word.  A word is a maximal run of bytes other than space
and 0x09-0x0D; A-Z count as a-z.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Bytes of text hashed at once: bounds the temporary arrays at about 40 times this.
BLOCK = 1 << 18
#: Longer words are hashed one by one with xxHash.
LONG_WORD = 256

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = U(int(_rng.integers(1, 2**62)) * 2 + 1)
_SHINGLE = _rng.integers(1, 2**62, 64, dtype=np.uint64) * U(2) + U(1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(29))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        base, n = int(_BASE), max(n, BLOCK + 1)
        steps = np.full(n, _BASE, np.uint64)
        steps[0] = 1
        back = np.full(n, pow(base, -1, 2**64), np.uint64)
        back[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return _powers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _spans(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[cuts] = True
    edge[[0, -1]] = True
    open_, close = solid.copy(), solid.copy()
    open_[1:] &= ~solid[:-1] | edge[1:-1]
    close[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(open_), np.flatnonzero(close) + 1


def _hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * power[: len(raw)], out=total[1:])
    out = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]].tobytes().lower())
    return out


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row) of each word; rows longer than BLOCK go piece by piece."""
    parts = []
    for i, j in slices(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        while True:
            stop = b
            if b - a > 2 * BLOCK:  # one long row: cut it at white space
                gap = np.flatnonzero(_SPACE[raw[a + BLOCK : b]])
                stop = a + BLOCK + int(gap[0]) if len(gap) else b
            piece = raw[a:stop]
            cuts = offsets[i : j + 1] - a
            s, e = _spans(piece, cuts[(cuts > 0) & (cuts < len(piece))])
            rows = np.searchsorted(offsets[i : j + 1], s + a, "right") - 1 + i
            parts.append((_hash_spans(piece, s, e), s + a, e + a, rows))
            if stop >= b:
                break
            a = stop
    if not parts:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def distinct(x: np.ndarray) -> np.ndarray:
    """np.unique, by one sort, which is several times faster than numpy's hashing and sorting."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its sorted distinct shingles of `size` words, as 64-bit hashes.
    A row of fewer words has the whole sequence as its one shingle; no words, none."""
    for i, j in slices(offsets):
        a, b = offsets[i], offsets[j]
        w, _, _, rows = words(raw[a:b], offsets[i : j + 1] - a)
        at = np.searchsorted(rows, np.arange(j - i + 1))
        full = np.zeros(0, np.uint64)
        if len(w) >= size:
            full = w[: len(w) - size + 1] * _SHINGLE[0]
            for k in range(1, size):
                full = full + w[k : len(w) - size + 1 + k] * _SHINGLE[k]
            full = mix(full)
        for r in range(j - i):
            n = at[r + 1] - at[r]
            if n >= size:
                yield i + r, distinct(full[at[r] : at[r + 1] - size + 1])
            elif n:
                short = (w[at[r] : at[r + 1]] * _SHINGLE[size : size + n]).sum(dtype=np.uint64)
                yield i + r, mix(np.array([short + U(n)], np.uint64))
            else:
                yield i + r, full[:0]


def signature(ids: np.ndarray) -> int:
    """One signed 64-bit number for a set of hashes."""
    s = mix(np.array([mix(ids ^ U(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + U(len(ids))], np.uint64))
    return int(s.view(np.int64)[0])


#: Rows of an Arrow batch: with whole texts in them, this bounds a Python worker's memory.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches of this session small enough for rows that hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only where it is unset
    and one machine is the whole cluster."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corvane-checkpoint-")  # one machine: driver and executors share it
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def keep(df: DataFrame) -> DataFrame:
    """A frame of short lineage that is read several times: it stays on the executors' disks, and what is lost is made
    again.  unpersist() it after its last use.  Unlike cut() it leaves no file a partition in the shared folder; on a
    local store Spark starts processes to set each file's rights."""
    return df.persist(StorageLevel.DISK_ONLY)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours in the shared folder, whatever store that is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a pruning filter: about 16 a key between these bounds, so 8 MB at most; false positives only cost time.
BLOOM_LEAST, BLOOM_MOST = 20, 26
BLOOM_PARTS = 32


def _bloom_places(keys: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    h = mix(keys.astype(np.int64).view(np.uint64) + U(0x51ED270B))
    return h & U(size - 1), (h >> U(19)) & U(size - 1), (h >> U(38)) & U(size - 1)


def bloom_of(keys: DataFrame) -> bytes:
    """A Bloom filter (compressed) of the one long column of `keys`, which is read twice.  At most BLOOM_PARTS tasks
    build it, all at once; they are joined piece by piece in as many, so one filter in all comes to the driver."""
    size = 1 << min(BLOOM_MOST, max(BLOOM_LEAST, (16 * keys.count()).bit_length()))
    piece = size // 8 // BLOOM_PARTS

    def build(batches):
        bits = np.zeros(size, bool)
        for b in batches:
            for p in _bloom_places(b.column(0).drop_null().to_numpy(zero_copy_only=False), size):
                bits[p] = True
        packed = np.packbits(bits, bitorder="little")
        parts = [zlib.compress(packed[k * piece : (k + 1) * piece].tobytes(), 1) for k in range(BLOOM_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOOM_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["k", "bits"])

    def join(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[k] = got.get(k, np.uint8(0)) | bloom_bits(x)
        parts = [zlib.compress(x.tobytes(), 1) for x in got.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array(parts, pa.binary())], ["k", "bits"])

    schema = "k int, bits binary"
    built = keys.coalesce(BLOOM_PARTS).mapInArrow(build, schema)
    bits = np.zeros((BLOOM_PARTS, piece), np.uint8)
    for k, x in built.repartition(min(BLOOM_PARTS, shuffle_width(keys.sparkSession)), "k").mapInArrow(join, schema).collect():
        bits[k] = bloom_bits(x)
    return zlib.compress(bits.tobytes(), 1)


def bloom_bits(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def bloom_has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for p in _bloom_places(keys, 8 * len(bits)):
        found &= (bits[p >> U(3)] >> (p & U(7)).astype(np.uint8)) & 1 > 0
    return found


def split_by_keys(docs: DataFrame, keys: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in `keys`, rows whose key is not), told apart by a bounded filter, so that
    only the first need a shuffle.  A null key is in the second."""
    packed = docs.sparkSession.sparkContext.broadcast(bloom_of(keys))

    def side(wanted: bool):
        def run(batches):
            bits = bloom_bits(packed.value)
            for b in batches:
                at = b.column(b.schema.get_field_index(key))
                hit = bloom_has(bits, at.fill_null(0).to_numpy(zero_copy_only=False))
                hit &= at.is_valid().to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(hit == wanted))

        return docs.mapInArrow(run, docs.schema)

    return side(True), side(False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an undirected graph given as edges (a, b); root is the smallest node
    of its connected component.  Alternating large-star and small-star rounds; each round is written to
    the checkpoint folder; nothing but the count of changed edges comes to the driver."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        e = cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
