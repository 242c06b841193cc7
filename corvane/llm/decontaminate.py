"""Benchmark decontamination by q-gram lemma filtering in overlapping diagonal bands.

Documents and benchmark items are compared as letters and digits, in lower case, without anything between
them.  An item is cut into overlapping segments of SEGMENT bytes (an item up to MERGE bytes is one segment).  A
segment of m bytes within k = floor(rate m) edits of a region shares at least m - q + 1 - k q of its q-grams
with it, and their diagonals (place in the document less place in the item) spread over at most k.  Bands of
2 (k + 1) diagonals, each overlapping half of the next, hold any such spread whole.  So:

1.  every position's q-gram is looked up in the index of benchmark q-grams (a bitmap first);
2.  hits are counted by document, segment, band and stretch of the document;
3.  bands that reach the lemma's bound are verified by banded alignment of the segment with the region.

A document is contaminated by an item when one of the item's segments is verified.  Items under LEAST bytes, for which
the lemma leaves no bound, are found as they are: their first q-gram (or, under q bytes, all of them) is looked up and
the rest compared; the words around them must end where they begin and begin where they end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common as C

Q, RATE = 12, 0.05
SEGMENT, STRIDE, MERGE = 100, 50, 130
#: Shorter items allow no edit and must stand as whole words.
LEAST = 40
#: Hits that are counted at once.
HITS = 1 << 21
#: Bytes of benchmark text that one pass over the documents searches for (about 40 bytes of index for each).
WAVE = 4 << 20

U = np.uint64
_KEEP = np.zeros(256, bool)
_KEEP[48:58] = _KEEP[97:123] = True
_KEEP[128:] = True


def squeeze(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters and digits in lower case, row offsets in them, where each stood in the lower-case texts, row offsets
    there)."""
    raw, at = C.text_buffer(pc.utf8_lower(column.fill_null("")))
    keep = np.flatnonzero(_KEEP[raw])
    return raw[keep], np.searchsorted(keep, at), keep, at


def grams(raw: np.ndarray, q: int) -> np.ndarray:
    if len(raw) < q:
        return np.zeros(0, np.uint64)
    out = []
    power, inverse = C._power_tables(C.BLOCK + q + 1)
    for a in range(0, len(raw) - q + 1, C.BLOCK):
        piece = raw[a : a + C.BLOCK + q - 1]
        total = np.zeros(len(piece) + 1, U)
        np.cumsum(C._VALUE[piece] * power[: len(piece)], out=total[1:])
        out.append(C.mix((total[q:] - total[:-q]) * inverse[: len(piece) - q + 1]))
    return np.concatenate(out)


def _found(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of g the first place in the sorted h, and how many are equal."""
    lo = np.searchsorted(h, g)
    return lo, np.searchsorted(h, g, "right") - lo


def _counted(row: np.ndarray, seg: np.ndarray, band: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((band, seg, row))
    row, seg, band = row[order], seg[order], band[order]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (seg[1:] != seg[:-1]) | (band[1:] != band[:-1]))) if len(row) else order
    return row[new], seg[new], band[new], np.add.reduceat(count[order], new) if len(new) else count


class Segments:
    """The searchable index of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float) -> None:
        self.q = q
        raw, at, _, _ = squeeze(pa.array([t for _, t in items], pa.string()))
        self.raw = raw
        spans, short = [], {}
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if b - a < LEAST:
                if b > a:
                    short.setdefault(min(q, b - a), []).append((int(grams(raw[a:b], min(q, b - a))[0]), a, b - a, items[i][0]))
                continue
            starts = [a] if b - a <= MERGE else [*range(a, b - SEGMENT, STRIDE), b - SEGMENT]
            spans += [(i, s, b if b - a <= MERGE else s + SEGMENT) for s in starts]
        spans = np.array(spans, np.int64).reshape(-1, 3)
        self.short = {m: [np.array(x, t) for x, t in zip(zip(*sorted(v)), (U, np.int64, np.int64, np.int64))] for m, v in short.items()}
        self.item = np.array([x for x, _ in items], np.int64)[spans[:, 0]] if len(items) else np.zeros(0, np.int64)
        self.start, self.size = spans[:, 1], spans[:, 2] - spans[:, 1]
        self.k = np.floor(rate * self.size).astype(np.int64)
        self.need = self.size - q + 1 - self.k * q
        # postings: gram -> (segment, place in the segment)
        g = grams(raw, q)
        seg = np.repeat(np.arange(len(spans)), np.maximum(self.size - q + 1, 0))
        place = np.concatenate([np.arange(n - q + 1) for n in self.size] or [np.zeros(0, np.int64)]).astype(np.int64)
        h = g[self.start[seg] + place] if len(seg) else np.zeros(0, U)
        order = np.argsort(h, kind="stable")
        self.h, self.seg, self.place = h[order], seg[order], place[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.h >> U(42)] = True

    def hits(self, g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, posting) of every shared q-gram, about HITS at a time."""
        at = np.flatnonzero(self.maybe[g >> U(42)])
        lo, n = _found(self.h, g[at])
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        total = np.append(0, np.cumsum(n))
        cuts = np.unique(np.minimum(np.searchsorted(total, np.arange(0, total[-1] + HITS, HITS)), len(at)))
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield np.repeat(at[i:j], n[i:j]), np.repeat(lo[i:j] - total[i:j] + total[i], n[i:j]) + np.arange(total[j] - total[i])

    def regions(self, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, segment, lowest diagonal of the band) of the regions that meet the lemma's bound."""
        parts = []
        for pos, post in self.hits(grams(raw, self.q)):
            row = np.searchsorted(at, pos, "right") - 1
            ok = pos + self.q <= at[row + 1]
            pos, post, row = pos[ok], post[ok], row[ok]
            seg = self.seg[post]
            diagonal = pos - self.place[post] + 2 * SEGMENT  # over 0
            band = diagonal // (self.k[seg] + 1)
            # band b holds the diagonals of b and b + 1: a hit counts in two bands
            parts.append(_counted(np.tile(row, 2), np.tile(seg, 2), np.append(band, band - 1), np.ones(2 * len(row), np.int64)))
        if not parts:
            return
        row, seg, band, count = _counted(*(np.concatenate(x) for x in zip(*parts))) if len(parts) > 1 else parts[0]
        good = count >= np.maximum(self.need[seg], 1)
        row, seg, band = row[good], seg[good], band[good]
        yield from zip(row.tolist(), seg.tolist(), (band * (self.k[seg] + 1) - 2 * SEGMENT).tolist())

    def exact(self, raw: np.ndarray, at: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, start, end) of the first place of each short item in each row; begins: where words begin, and the
        end."""
        for m, (h, start, size, item) in self.short.items():
            g = grams(raw, m)
            pos = np.flatnonzero(begins[: len(g)])
            lo, n = _found(h, g[pos])
            which = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            pos = np.repeat(pos, n)
            row = np.searchsorted(at, pos, "right") - 1
            end = pos + size[which]
            ok = end <= at[row + 1]
            ok[ok] = begins[end[ok]]
            pos, which, row = pos[ok], which[ok], row[ok]
            for j in range(int(size[which].max(initial=0))):
                same = (j >= size[which]) | (raw[np.minimum(pos + j, len(raw) - 1)] == self.raw[np.minimum(start[which] + j, len(self.raw) - 1)])
                pos, which, row = pos[same], which[same], row[same]
            _, first = np.unique(np.stack([row, item[which]]), axis=1, return_index=True)
            for i in first.tolist():
                yield int(row[i]), int(item[which[i]]), int(pos[i]), int(pos[i] + size[which[i]])

    def align(self, raw: np.ndarray, at: np.ndarray, found: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end) of the best alignment of each segment with its region, within the band."""
        row, seg, low = (np.array(x, np.int64) for x in zip(*found))
        k = self.k[seg]
        low = low - k
        width = int((4 * k + 2).max())  # the band, and k on either side
        size = self.size[seg]
        lane = np.arange(width)
        far = 1 << 20
        cost = np.zeros((len(seg), width), np.int64)  # the alignment may start anywhere
        cost[lane[None, :] >= (4 * k + 2)[:, None]] = far
        for i in range(int(size.max())):
            live = i < size
            t = low[:, None] + i + lane[None, :]
            inside = (t >= at[row][:, None]) & (t < at[row + 1][:, None])
            same = raw[np.clip(t, 0, len(raw) - 1)] == self.raw[np.minimum(self.start[seg] + i, len(self.raw) - 1)][:, None]
            # a diagonal step eats one of each; from the lane above, only the segment moves on
            step = np.where(inside, cost + ~same, far)
            skip = np.append(cost[:, 1:], np.full((len(seg), 1), far), 1) + 1
            now = np.minimum(step, skip)
            now = np.minimum.accumulate(now - lane, axis=1) + lane  # or only the document does
            now[lane[None, :] >= (4 * k + 2)[:, None]] = far
            cost = np.where(live[:, None], now, cost)
        best = cost.argmin(1)
        return cost[np.arange(len(seg)), best], low + size + best


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, q: int = Q) -> DataFrame:
    """(doc_id, item_id, edits, segments, start, end): for each document (row) and item found in it, the
    fewest edits of a verified segment, how many segments were verified, and the bytes of the lower-case
    text that the verified segments span.

    Nothing of the documents is shuffled or sampled; the benchmark is read in waves of at most WAVE bytes, and
    each wave is one pass.  Null and empty texts hold nothing; null item texts and items
    without letters are not searched for; a null doc_id is kept in the result; repeated rows each give rows; repeated item_ids
    count as one item; extra columns are ignored; with an empty table the result is empty."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, edits int, segments int, start long, end long"

    def one_pass(items: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)

        def run(batches):
            index = Segments(sent.value, q, rate)
            for b in batches:
                ids = b.column(0).to_pylist()
                whole, at, keep, first = squeeze(b.column(1))
                begins = np.append(np.diff(keep, prepend=-2) > 1, True)
                begins[at] = True
                for i, j in C.slices(at):
                    raw, cut = whole[at[i] : at[j]], at[i : j + 1] - at[i]
                    found = list(index.regions(raw, cut)) if len(index.seg) else []
                    got: dict[tuple[int, int], list[int]] = {}
                    for a in range(0, len(found), 2000):
                        part = found[a : a + 2000]
                        edits, ends = index.align(raw, cut, part)
                        for (r, s, _), e, end in zip(part, edits.tolist(), ends.tolist()):
                            if e > index.k[s]:
                                continue
                            begin, end = max(int(end - index.size[s] - e), int(cut[r])), min(end, int(cut[r + 1]))
                            x = got.setdefault((r, int(index.item[s])), [e, 0, begin, end, set()])
                            x[0], x[2], x[3] = min(x[0], e), min(x[2], begin), max(x[3], end)
                            x[4].add(s)
                    for r, item, begin, end in index.exact(raw, cut, begins[at[i] : at[j] + 1]):
                        got[(r, item)] = [0, 0, begin, end, {begin}]
                    rows = []
                    for (r, item), (e, _, s, t, segs) in got.items():
                        lo, hi = int(keep[at[i] + s]), int(keep[at[i] + t - 1]) + 1
                        rows.append((ids[i + r], item, e, len(segs), lo - int(first[i + r]), hi - int(first[i + r])))
                    columns = list(zip(*rows)) if rows else [()] * 6
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in schema.split(", ")])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    out, items, weight = None, [], 0
    rows = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        items.append((item, text))
        weight += len(text.encode())
        if weight >= WAVE:
            out = one_pass(items) if out is None else out.union(one_pass(items))
            items, weight = [], 0
    if items or out is None:
        out = one_pass(items) if out is None else out.union(one_pass(items))
    return out


def contaminated_ids(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    return leaks(docs, benchmark, **how).where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
