"""Scores by cross-entropy difference of two matched n-gram models.

A target and a background corpus are counted alike, whole, over one shared vocabulary: all words of the
target of two occurrences or more; every other word is the unknown word in both models.  Both are bigram models
with the same Dirichlet smoothing towards their own unigrams,

    p(w | u) = (c(u, w) + MU p(w)) / (c(u) + MU),    p(w) = (c(w) + 1) / (N + V)

c(u) being the sum of all pairs that begin with u.  So both models are normalised, and nothing that is counted
is left out: the pairs of words stay in a table, by hash bucket, that grows with the input as the number of its
buckets does.  Only what there is one of for each word of the vocabulary (hash, unigram, c(u)) is broadcast.

To score, a task sends the distinct pairs of some HELD words, once each however often they occur, to the
buckets; the counts come back to where the rows of those words, as ids, wait for them.  A document's score is the mean over its words of the target model's loss less the background model's, in nats: the lower,
the more like the target.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common as C

#: Bytes of text for each bucket, of which there are 2 ** LEAST_BITS at least.
BUCKET_BYTES, LEAST_BITS = 1 << 23, 6
MU = 200.0
#: Words that a task counts before it sends its counts on.
HELD = 2_000_000
UNKNOWN, START = 0, 1

U = np.uint64
#: In place of a word after u: the key of c(u).
ANY = U(0xFFFFFFFF)


def _bits(texts: DataFrame) -> int:
    """log2 of the number of buckets for what these texts hold."""
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(LEAST_BITS, (size // BUCKET_BYTES).bit_length())


def _by_bucket(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket and, where h is sorted, by h; first place of each bucket and the end)."""
    k = C.mix(h) >> U(64 - bits)
    order = np.argsort(k, kind="stable")
    return order, np.searchsorted(k[order], np.arange((1 << bits) + 1).astype(U))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers as compressed bytes, all first bytes before all second ones; of the first column, if
    there are more, the steps."""
    x = np.stack([c.astype(U) for c in columns])
    if len(x) > 1:
        x[0, 1:] = x[0, 1:] - x[0, :-1]
    return zlib.compress(x.view(np.uint8).reshape(*x.shape, 8).transpose(0, 2, 1).tobytes(), 1)


def _unpacked(p: bytes, columns: int) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(p), np.uint8)
    x = raw.reshape(columns, 8, len(raw) // (8 * columns)).transpose(0, 2, 1).copy().view(U)[:, :, 0]
    if columns > 1:
        x[0] = np.cumsum(x[0], dtype=U)
    return x


def _counted(texts: DataFrame, keys_of, side: int, bits: int, more=None) -> DataFrame:
    """(k, side, counts) rows: packed counts of what keys_of(raw, at) yields, and of what more(h, c) adds to
    them, by hash bucket."""

    def run(batches):
        keys = keys_of()
        held, weight = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            if more:
                h, c = (np.concatenate(x) for x in zip((h, c), more(h, c)))
                order = np.argsort(h)
                h, c = h[order], c[order]
            order, edge = _by_bucket(h, bits)
            h, c = h[order], c[order]
            rows = [(i, side, _packed(h[edge[i] : edge[i + 1]], c[edge[i] : edge[i + 1]])) for i in np.flatnonzero(np.diff(edge)).tolist()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["k", "side", "p"])

        for b in batches:
            raw, at = C.text_buffer(b.column(0))
            for i, j in C.slices(at):
                x = keys(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                held.append(x)
                weight += len(x)
                if weight > HELD:
                    yield flush()
                    held, weight = [], 0
        if weight:
            yield flush()

    return texts.mapInArrow(run, "k int, side int, p binary")


def _summed(counted: DataFrame, bits: int) -> DataFrame:
    """(k, p) rows, one a bucket: hashes, rising, then their target counts, then their background counts."""

    def run(batches):
        parts: dict[int, list] = {}
        for b in batches:
            for k, side, p in zip(*(b.column(i).to_pylist() for i in range(3))):
                parts.setdefault(k, []).append((side, _unpacked(p, 2)))
        for k, got in parts.items():
            h, at = np.unique(np.concatenate([p[0] for _, p in got]), return_inverse=True)
            c = np.concatenate([p[1] for _, p in got]).astype(np.float64)
            target = np.concatenate([np.full(p.shape[1], side == 0) for side, p in got])
            both = [np.bincount(at, c * x, len(h)).astype(U) for x in (target, ~target)]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(h, *both)], pa.binary())], ["k", "p"])

    return counted.repartition(1 << bits, "k").mapInArrow(run, "k int, p binary")


def _picked(table: DataFrame, pick) -> tuple[np.ndarray, np.ndarray]:
    """(entries that pick(h, t, b) says, by hash, counts of all others) of a table."""

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                x = _unpacked(p, 3)
                hit = pick(*x)
                yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()) for y in (x[:, hit], x[1:, ~hit].sum(1))], ["p", "rest"])

    rows = table.select("p").mapInArrow(run, "p binary, rest binary").collect()
    x = np.concatenate([np.frombuffer(r[0], U).reshape(3, -1) for r in rows] or [np.zeros((3, 0), U)], axis=1)
    return x[:, np.argsort(x[0])], sum((np.frombuffer(r[1], U) for r in rows), np.zeros(2, U))


class Vocabulary:
    """Words by hash; the more frequent, the smaller an id (`rank`, and 2)."""

    def __init__(self, words: np.ndarray, rank: np.ndarray) -> None:
        self.words, self.rank = words, rank
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[words >> U(42)] = True

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), UNKNOWN, np.int64)
        at = np.flatnonzero(self.maybe[h >> U(42)])
        if len(at):
            p = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
            hit = self.words[p] == h[at]
            out[at[hit]] = self.rank[p[hit]] + 2
        return out

    def pairs(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word before, word, row) of each word; START before the first of a row."""
        h, _, _, row = C.words(raw, at)
        w = self.ids(h)
        return _before(w, row), w, row


def _before(w: np.ndarray, row: np.ndarray) -> np.ndarray:
    before = np.append(START, w[:-1]) if len(w) else w
    if len(w):
        before[1:][row[1:] != row[:-1]] = START
    return before


def _key(before: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (before.astype(U) << U(32)) | w.astype(U)


class Model(dict):
    """The parts of the models; the unigrams of all words as one array are there to look at."""

    def __missing__(self, name):
        if name != "unigram":
            raise KeyError(name)
        return (self["counts"] + 1) / (self["counts"].sum(1, keepdims=True) + self["counts"].shape[1])


def fit(target: DataFrame, background: DataFrame) -> dict:
    """The two models over `text` of both frames: arrays over the vocabulary, and the table of all pairs in the
    checkpoint folder.  Null texts are skipped."""
    spark = target.sparkSession
    both = [x.where("text IS NOT NULL").select("text") for x in (target, background)]
    bits = _bits(both[0].union(both[1]))

    def hashes():
        return lambda raw, at: C.words(raw, at)[0]

    counted = _counted(both[0], hashes, 0, bits).union(_counted(both[1], hashes, 1, bits))
    (words, *found), rest = _picked(_summed(counted, bits), lambda h, t, b: t >= 2)
    order = np.lexsort((words, -(found[0] + found[1]).astype(np.int64)))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    counts = np.stack([np.concatenate([[r, 0], c[order]]) for r, c in zip(rest, found)]).astype(np.float64)  # unknown, start, words
    sent = spark.sparkContext.broadcast((words, rank))

    def pairs():
        vocabulary = Vocabulary(*sent.value)
        return lambda raw, at: _key(*vocabulary.pairs(raw, at)[:2])

    def contexts(h, c):
        u, at = np.unique(h >> U(32), return_inverse=True)
        return (u << U(32)) | ANY, np.bincount(at, c, len(u)).astype(np.int64)

    counted = _counted(both[0], pairs, 0, bits, contexts).union(_counted(both[1], pairs, 1, bits, contexts))
    folder = f"{C.checkpoint_dir(spark)}/pairs-{uuid.uuid4()}"
    _summed(counted, bits).write.parquet(folder)
    table = spark.read.parquet(folder)
    (keys, *found), _ = _picked(table, lambda h, t, b: h & ANY == ANY)
    context = np.zeros(counts.shape)
    context[:, (keys >> U(32)).astype(np.int64)] = found
    return Model(words=words, rank=rank, counts=counts, context=context, pairs=table, bits=bits)


def _losses(model: dict, key: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Two rows: the loss of each pair, of which the corpora hold c, under the target and the background model."""
    before, w = (key >> U(32)).astype(np.int64), (key & ANY).astype(np.int64)
    return -np.log((c + MU * model["unigram"][:, w]) / (model["context"][:, before] + MU))


def _distinct(w: np.ndarray, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct pairs, place of each word's among them, row of each word) of rows of n words."""
    row = np.repeat(np.arange(len(n)), n)
    return *np.unique(_key(_before(w, row), w), return_inverse=True), row


_ROWS = "k int, side int, flush long, p binary, ids array<long>, n array<long>"
_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
_TABLE, _PAIRS, _TEXTS = 0, 1, 2


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], ["k", "side", "flush", "p", "ids", "n"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) of every row; score is the mean difference.

    Null and empty texts have no words and null losses; null doc_ids are kept; repeated rows each get a row;
    extra columns are ignored; an empty table gives an empty result."""
    context, bits = docs.sparkSession.sparkContext, model["bits"]
    words = context.broadcast((model["words"], model["rank"]))
    terms = context.broadcast({"unigram": model["unigram"], "context": model["context"]})

    def ask(batches):
        vocabulary = Vocabulary(*words.value)
        flush = TaskContext.get().partitionId() << 32
        held, ids, n, weight = [], [], [], 0

        def sent():
            w = np.concatenate(held)
            h = _distinct(w, n)[0]
            order, edge = _by_bucket(h, bits)
            h = h[order]
            for k in np.flatnonzero(np.diff(edge)).tolist():
                x = h[edge[k] : edge[k + 1]]
                yield k, _PAIRS, flush, _packed(x, np.zeros(len(x), U)), None, None
            # the rows travel with their pairs, so that both are of one reading of the input
            yield flush % 7919 % (1 << bits), _TEXTS, flush, _packed(w), ids, n

        for b in batches:
            raw, at = C.text_buffer(b.column(1))
            for i, j in C.slices(at):
                _, w, row = vocabulary.pairs(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                held.append(w)
                ids += b.column(0).slice(i, j - i).to_pylist()
                n += np.bincount(row, minlength=j - i).tolist()
                weight += len(w) + j - i
                if weight > HELD:
                    yield _batch(list(sent()))
                    held, ids, n, weight, flush = [], [], [], 0, flush + 1
        if weight:
            yield _batch(list(sent()))

    def answer(batches):
        at, table = -1, np.zeros((3, 0), U)
        for b in batches:
            for k, side, flush, p, ids, n in zip(*(x.to_pylist() for x in b.columns)):
                if k != at:
                    at, table = k, np.zeros((3, 0), U)
                if side == _TABLE:
                    table = _unpacked(p, 3)
                elif side == _TEXTS:
                    yield _batch([(-1, side, flush, p, ids, n)])
                else:
                    key = _unpacked(p, 2)[0]
                    c = np.zeros((2, len(key)), U)
                    if table.shape[1]:
                        i = np.minimum(np.searchsorted(table[0], key), table.shape[1] - 1)
                        c = np.where(table[0, i] == key, table[1:, i], U(0))
                    yield _batch([(k, side, flush, _packed(c[0], c[1]), None, None)])

    def mean(got: pa.Table) -> pa.Table:
        got = got.sort_by("k").to_pydict()
        n = np.array(got["n"][0], np.int64)
        h, place, row = _distinct(_unpacked(got["p"][0], 1)[0].astype(np.int64), n)
        order, _ = _by_bucket(h, bits)
        c = np.zeros((2, len(h)))
        c[:, order] = np.concatenate([_unpacked(p, 2) for p in got["p"][1:]] or [np.zeros((2, 0), U)], axis=1)
        loss = _losses(terms.value, h, c)
        with np.errstate(invalid="ignore"):
            x, y = (np.bincount(row, side[place], len(n)) / n for side in loss)
        none = n == 0
        return pa.table(
            [pa.array(got["ids"][0], pa.int64()), pa.array(n), *(pa.array(v, mask=none) for v in (x, y, x - y))],
            ["doc_id", "n_words", "target_loss", "background_loss", "score"],
        )

    asked = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(ask, _ROWS)
    table = model["pairs"].selectExpr("k", f"{_TABLE} AS side", "CAST(NULL AS LONG) AS flush", "p", "CAST(NULL AS ARRAY<LONG>) AS ids", "CAST(NULL AS ARRAY<LONG>) AS n")
    answered = table.union(asked).repartition(1 << bits, "k").sortWithinPartitions("k", "side").mapInArrow(answer, _ROWS)
    return answered.groupBy("flush").applyInArrow(mean, "doc_id long, n_words long, target_loss double, background_loss double, score double")
