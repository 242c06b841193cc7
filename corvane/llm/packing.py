"""Order-preserving packing of token streams into windows, by dynamic programming.

The documents of a partition, in order of (doc_id, text), form one stream of tokens.  Windows of at most
`window` tokens are cut from it.  A cut may be made after a document (free), after a sentence or line
(SENTENCE), or, inside stretches of over STEP tokens without such a place, at every STEP tokens (HARD):
the penalties for truncation.  A window costs its padding, which is nothing at a power of two and
`window` less its length otherwise, plus SEQUENCE.  With P the places and f the least cost of a cut there,

    f(j) = penalty(j) + SEQUENCE + min( min { f(i) + P(i) : P(j) - P(i) <= window } + window - P(j),
                                        f(i) where P(j) - P(i) is a power of two )

and the inner minimum slides, so a monotone queue gives it in constant time.  The stream is solved in
stretches of SOLVE tokens; the last window of a stretch is left open and solved with the next.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corvane.llm import common as C

SENTENCE, HARD, SEQUENCE, STEP = 1, 4, 16, 16
SOLVE = 200_000
#: Bytes of text encoded at once.
BLOCK = 4 << 20
_HALVES = 2  # powers of two below the window that are tried


def cut_windows(places: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Indexes of the places to cut at, the last one included.  `places` are positions after which a cut
    may be made, rising from above 0, never more than `window` apart."""
    n = len(places) + 1
    all_at = np.append(0, places)
    at, pen = all_at.tolist(), [0, *(penalty + SEQUENCE).tolist()]
    # the places that lie just so far back, where there are any
    powers: list[tuple] = [()] * n
    for k in range(1, _HALVES + 1):
        i = np.searchsorted(all_at, all_at - (window >> k))
        hit = np.flatnonzero(all_at[i] == all_at - (window >> k))
        for j, x in zip(hit.tolist(), i[hit].tolist()):
            powers[j] += (x,)
    best, back, lead = [0] * n, [0] * n, [0] * n  # lead: f(i) + P(i)
    # The queue's first never leaves from behind: every later place leads by more.
    queue, head, first, low, reach = [0], 0, 0, window, window
    for j in range(1, n):
        p = at[j]
        while p > reach:
            head += 1
            first = queue[head]
            low, reach = lead[first] + window, at[first] + window
        cost, i = low - p, first
        for x in powers[j]:
            if best[x] < cost:
                cost, i = best[x], x
        best[j] = cost = cost + pen[j]
        back[j] = i
        lead[j] = cost = cost + p
        while lead[queue[-1]] >= cost:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j - 1)
        j = back[j]
    return cuts[::-1]


def places_of(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of a stream and the penalty of a cut at each."""
    doc = np.zeros(len(ids), bool)
    doc[doc_ends - 1] = True
    natural = np.flatnonzero(ends[ids] | doc) + 1
    gaps = np.diff(natural, prepend=0)
    wide = np.flatnonzero(gaps > STEP)
    more = (gaps[wide] - 1) // STEP
    step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    places = np.append(natural, np.repeat(natural[wide] - gaps[wide], more) + step * STEP)
    penalty = np.full(len(places), HARD, np.int64)
    penalty[: len(natural)] = np.where(doc[natural - 1], 0, SENTENCE)
    order = np.argsort(places, kind="stable")
    return places[order], penalty[order]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: its place in the document (start, length), in tokens, and in its
    sequence (sequence_id, offset); with_ids adds the ids themselves.  A document is its ids by
    `tokenizer` (a path), then end_id.

    Nothing is shuffled: a partition packs its own rows, so its last sequence may be short.  Null and empty
    texts are the end_id alone; a null doc_id is kept; repeated rows are packed each; other columns are
    ignored; an empty table gives no rows.  Memory is bounded by SOLVE tokens, BLOCK bytes and the longest text."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches):
        from corvane.llm.tokens import byte_bpe

        coder = byte_bpe(tokenizer, ranks)
        ends = coder.sentence_ends
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        none = np.zeros(0, np.int64)
        # of the documents in hand: doc_id, tokens before those in hand, tokens in hand, tokens in all, ids in hand
        open_: list[tuple] = [(pa.array([], pa.int64()), none, none, none, np.zeros(0, "<u4"))]
        weight = 0

        def solve(final: bool):
            nonlocal sequence, open_, weight
            names = pa.concat_arrays([x[0] for x in open_])
            start, size, total, ids = (np.concatenate([x[k] for x in open_]) for k in range(1, 5))
            flat = ids.view(np.uint8).data
            doc_ends = np.cumsum(size)
            places, penalty = places_of(ids, doc_ends, ends)
            bounds = places[cut_windows(places, penalty, window)]
            if not final:
                bounds = bounds[:-1]
            done = int(bounds[-1]) if len(bounds) else 0
            edges = np.union1d(bounds, doc_ends[doc_ends <= done])
            begin = np.append(0, edges[:-1]) if len(edges) else edges
            which = np.searchsorted(doc_ends, begin, "right")
            begins = doc_ends - size
            seq = np.searchsorted(bounds, begin, "right")
            seq_begin = np.append(0, bounds)[seq]
            columns = [
                names.take(pa.array(which)),
                pa.array(begin - begins[which] + start[which], pa.int64()),
                pa.array(edges - begin, pa.int64()),
                pa.array([zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(begin.tolist(), edges.tolist())], pa.int64()),
                pa.array(total[which], pa.int64()),
                pa.array(sequence + seq, pa.int64()),
                pa.array(begin - seq_begin, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, done), pa.int32()), pa.array(ids[:done].astype(np.int32))))
            sequence += len(bounds)
            k = int(np.searchsorted(doc_ends, done, "right"))
            skip = np.maximum(0, done - begins[k:])
            open_, weight = [(names.slice(k), start[k:] + skip, size[k:] - skip, total[k:], ids[done:])], len(ids) - done
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

        for b in batches:
            names, texts = b.column(0).cast(pa.int64()), b.column(1)
            _, at = C.text_buffer(texts)
            for i, j in C.slices(at, BLOCK):
                ids, edge = coder.encode_flat(texts.slice(i, j - i))
                ids = np.insert(ids, edge[1:], end_id)
                edge = edge + np.arange(len(edge))
                size, k = np.diff(edge), 0
                while k < j - i:
                    # up to the document that brings the weight over SOLVE
                    m = min(j - i, max(k + 1, int(np.searchsorted(edge, edge[k] + SOLVE - weight, "right"))))
                    open_.append((names.slice(i + k, m - k), np.zeros(m - k, np.int64), size[k:m], size[k:m], ids[edge[k] : edge[m]]))
                    weight += int(edge[m] - edge[k])
                    k = m
                    if weight > SOLVE:
                        yield solve(False)
        if weight:
            yield solve(True)

    return docs.select("doc_id", "text").sortWithinPartitions("doc_id", "text").mapInArrow(run, schema)
