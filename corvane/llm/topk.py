"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Each partition indexes its own vectors, in blocks of BLOCK.  Dimension d has two inverted lists: one of what
vectors exceed the block's minimum by, one of what they fall short of its maximum by, so impacts are never
negative.  Both are kept in segments by LEVELS levels of how far they lie above the middle (the mean); one edge for
all lists, so that each level has an equal share of the postings.  A vector above the middle of d is met in the first
list, one below it in the second; the rest of a list, under its middle, never has to be read.

Segments are processed by descending level.  After each, a vector's accumulator is the part of its score that has
been read, and the unread part is at most (Cauchy and Schwarz) the length of the query times the length of what the
vector has in unread levels.  A vector is a possible member while accumulator plus that reaches a score that k others
have: one of earlier blocks of the partition, or, with half of the postings read, of the best accumulators, scored
exactly.  Processing stops when that proof leaves few possible members, or at the last segment; they are then rescored
exactly, so where it stops never changes the result.  Accumulators are floats of 32 bits, and the bound allows for
their rounding.

Scores are whole numbers.  Where they could pass 2^53, up to which floats add exactly, nothing is pruned and all
vectors of the block are scored with integers of any size; a score beyond a long is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import common as C

BLOCK, LEVELS, TOGETHER = 8192, 8, 256
#: Bytes of query vectors that are broadcast at once; one wave is one pass over the rows.
WAVE = 32 << 20


def usable(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, lengths, components one after the other) of the vectors that take part: not null, not empty, all
    components finite; components as whole numbers."""
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    lens = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64) if column.null_count else np.diff(column.offsets.to_numpy()).astype(np.int64)
    row = np.repeat(np.arange(len(column)), lens)
    good = (lens > 0) & (np.bincount(row, ~np.isfinite(values), len(column)) == 0)
    return np.flatnonzero(good), lens[good], np.floor(scale * values[good[row]])


class Index:
    """Inverted lists of one block: for each dimension one of what vectors exceed its minimum by, and one of what they
    fall short of its maximum by; each a list of (vector, impact), by descending level, what lies under the middle last."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        low, high, middle = x.min(0), x.max(0), np.rint(x.mean(0))
        off = x - middle
        far = np.abs(off)
        level = np.searchsorted(np.quantile(far, np.arange(1, LEVELS) / LEVELS), far, "right")
        self.middle, self.lists = middle, []
        self.shift = np.concatenate([middle - low, high - middle])  # of each list's impacts to its middle
        for impact, above, lev in zip([*(x - low).T, *(high - x).T], [*off.T, *-off.T], [*level.T, *level.T]):
            vector = np.flatnonzero(impact > 0)  # what adds nothing has no posting
            lev = np.where(above > 0, lev, -1)[vector]
            order = np.argsort(-lev, kind="stable")
            edge = np.searchsorted(-lev[order], -np.arange(LEVELS - 1, -3, -1))  # of each segment, the highest first
            self.lists.append((vector[order], impact[vector][order], edge))
        square = far * far
        self.size = np.sqrt(square.sum(1))
        #: The length of what each vector has below each level.
        self.rest = np.sqrt([np.where(level < n, square, 0).sum(1) for n in range(LEVELS - 1, -1, -1)])
        #: Postings that were added to accumulators, over all queries so far.
        self.read = 0

    def search(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (scores, ids) of the block's best members; `floor`: a score that k others reach."""
        count, width = len(self.ids), q.shape[1]
        if max(np.abs(q).max(initial=0), 1) * max(np.abs(self.x).max(initial=0), 1) * 2 * width >= 2**53:
            whole = [[int(v) for v in x] for x in self.x.tolist()]
            scores = [[sum(a * b for a, b in zip(map(int, w), x)) for x in whole] for w in q.tolist()]
            return [self._best(np.flatnonzero(self.ids != o), np.array(s, object), k) for s, o in zip(scores, own)]
        weight = np.concatenate([q, -q], 1).T.astype(np.float32)  # of each list in each query
        length = np.sqrt((q * q).sum(1))
        need = floor - q @ self.middle  # what a member's accumulator reaches in the end
        live = np.arange(len(q))
        got = np.zeros((count, len(q)), np.float32)
        found: list = [None] * len(q)
        few = max(4 * k, count // 16)
        for n in range(LEVELS):
            for (vector, impact, edge), shift, w in zip(self.lists, self.shift, weight):
                s = slice(edge[n], edge[n + 1])
                if s.stop > s.start:
                    got[vector[s]] += (impact[s] - shift).astype(np.float32)[:, None] * w
                    self.read += (s.stop - s.start) * len(live)
            if n == LEVELS // 2 - 1 and count > 8 * k:
                need = np.maximum(need, self._seeds(got, q[live], own[live], k) - q[live] @ self.middle)
            # 32-bit floats: at most width + 4 roundings of sums that stay below size * length each
            room = self.rest[n] * (1 + 1e-9) + (width + 4) * 2.0**-22 * self.size
            last = n == LEVELS - 1
            if not last and (got[::16] + np.outer(room[::16], length) >= need).mean() > 0.125:
                continue  # too early, by a sample
            may = got + np.outer(room, length) >= need
            stop = (may.sum(0) <= few) | last
            for i, row in zip(np.flatnonzero(stop), may[:, stop].T):
                at = np.flatnonzero(row)
                at = at[self.ids[at] != own[live[i]]]
                score = np.zeros(count)
                score[at] = self.x[at] @ q[live[i]]
                found[live[i]] = self._best(at, score, k)
            if stop.all():
                break
            if stop.any():
                live, got, weight, need, length = live[~stop], got[:, ~stop], weight[:, ~stop], need[~stop], length[~stop]
        return found

    def _seeds(self, got: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that k other vectors have: of those whose accumulators are best, the k-th."""
        top = np.argpartition(got.T, len(self.ids) - 4 * k, axis=1)[:, -4 * k :]
        score = np.einsum("ijd,id->ij", self.x[top], q)
        score[self.ids[top] == own[:, None]] = -np.inf
        return np.partition(score, 3 * k, axis=1)[:, 3 * k]

    def _best(self, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if score.dtype != object and len(at) > k:
            at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
        best = sorted(at.tolist(), key=lambda i: (-score[i], self.ids[i]))[:k]
        return score[best], self.ids[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows of `vectors` by integer inner product,
    ties to the smaller vec_id.  Both frames have vec_id long and embedding array; components x become
    floor(scale * x).

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do null vec_ids.  Only
    vectors of the query's length are compared with it.  Repeated vec_ids are each a candidate, but never for their
    own id.  Extra columns are ignored.  With no queries or no vectors the result is empty.  Queries are sent in
    waves of about WAVE bytes, read from the checkpoint folder one at a time, so what is broadcast does not grow."""
    spark = vectors.sparkSession

    def rows_of(batches):
        """(ids, lengths, components) of each batch, without null ids."""
        for b in batches:
            ids = b.column(0)
            b = b.filter(ids.is_valid())
            rows, lens, x = usable(b.column(1), scale)
            yield b.column(0).to_numpy(zero_copy_only=False)[rows].astype(np.int64), lens, x

    def packed(batches):
        held, size = [], 0

        def flush():
            columns = [np.concatenate(c).tobytes() for c in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], ["i", "n", "x"])

        for part in rows_of(batches):
            held.append(part)
            size += part[2].nbytes
            if size >= WAVE:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    parts = max(1, queries.count() // 4096)
    waves = C.cut(queries.select("vec_id", "embedding").coalesce(parts).mapInArrow(packed, "i binary, n binary, x binary").withColumn("w", F.monotonically_increasing_id()))
    out = None
    for w in sorted(r[0] for r in waves.select("w").collect()):
        sent = spark.sparkContext.broadcast(tuple(waves.where(F.col("w") == w).select("i", "n", "x").first()))

        def run(batches, sent=sent):
            qi, qn = (np.frombuffer(x, np.int64) for x in sent.value[:2])
            values = np.frombuffer(sent.value[2], np.float64)
            begin = np.cumsum(qn) - qn
            groups = {int(n): np.flatnonzero(qn == n) for n in np.unique(qn)}
            q = {n: values[begin[at][:, None] + np.arange(n)] for n, at in groups.items()}
            best = [([], [])] * len(qi)
            floor = np.full(len(qi), -np.inf)
            held: dict[int, list] = {n: [] for n in groups}

            def take(n):
                ids, x = (np.concatenate(c) for c in zip(*held[n]))
                held[n] = []
                for a in range(0, len(ids), BLOCK):
                    index = Index(ids[a : a + BLOCK], x[a : a + BLOCK])
                    for c in range(0, len(groups[n]), TOGETHER):
                        at = groups[n][c : c + TOGETHER]
                        for j, (score, vec) in zip(at.tolist(), index.search(q[n][c : c + TOGETHER], qi[at], floor[at], k)):
                            both = sorted(zip([*best[j][0], *score.tolist()], [*best[j][1], *vec.tolist()]), key=lambda y: (-y[0], y[1]))[:k]
                            best[j] = [y[0] for y in both], [y[1] for y in both]
                            if len(both) == k and abs(both[-1][0]) < 2**53:
                                floor[j] = both[-1][0]

            total = 0
            for ids, lens, x in rows_of(batches):
                start = np.cumsum(lens) - lens
                for n in np.unique(lens).tolist():
                    if n in held:
                        at = np.flatnonzero(lens == n)
                        held[n].append((ids[at], x[start[at][:, None] + np.arange(n)]))
                        total += len(at)
                if total >= BLOCK:
                    for n in held:
                        if held[n]:
                            take(n)
                    total = 0
            for n in held:
                if held[n]:
                    take(n)
            sizes = [len(s) for s, _ in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qi, sizes)), pa.array([v for _, vs in best for v in vs], pa.int64()), pa.array([int(s) for ss, _ in best for s in ss], pa.int64()), pa.array(np.repeat(np.arange(len(qi)), sizes).astype(np.int64))],
                ["query_id", "vec_id", "score", "q"],
            )

        each = vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score long, q long").withColumn("w", F.lit(w))
        out = each if out is None else out.union(each)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("w", "q").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
