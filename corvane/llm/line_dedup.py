"""Line deduplication by winnowing over line hashes.

A *line* is a stretch of text up to a line break or the end of a sentence, with the white space after it.
Its hash is of its words (A-Z as a-z).  From each line a *stretch* reaches over the fewest lines that hold
MIN_WORDS words.  Of every WINDOW stretches in succession the one of least hash is a fingerprint, and so is
any line of LONG words or more.  A run is found whole if WINDOW stretches or a line of LONG words lie in it: any
run of 42 words, then, as without such a line two lines and a stretch have 11 + 11 + 20 at most.

1.  Fingerprints travel packed to buckets of their hash.  A task sends the first of each hash that it holds; its
    later ones have an earlier copy right there.  So a frequent line is one entry a task, never a hot bucket.
2.  Fingerprints that occur twice are extended both ways, to where the next guaranteed fingerprint of a common
    run must lie: WINDOW - 1 lines back, and as far as no whole stretch follows ahead.  Each of these longer
    spans is joined by the hash of its lines in the same way, so the copy that matches furthest is found even
    where the first holder of the fingerprint itself matches no further.
3.  A span that occurs at an earlier (doc_id, line) is deleted.  A deleted line always has an equal one earlier,
    so the first copy of every line stays.

Rows are told apart by doc_id and a hash of the text; rows equal in both are one document here and are
treated alike.  Rows with a null doc_id or text are left as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import common as C

WINDOW, LONG, MIN_WORDS = 3, 12, 10
#: Spans that a task holds before it sends them on.
HELD = 500_000

U = np.uint64
#: Lines a to e of a document; want: whether the answer is asked for.
SPAN = np.dtype([("h", U), ("doc", np.int64), ("key", np.int64), ("a", np.int32), ("e", np.int32), ("want", np.uint8)])
#: The answer: whether there is an earlier copy, and in which document.
HIT = np.dtype([("doc", np.int64), ("key", np.int64), ("a", np.int32), ("e", np.int32), ("early", np.uint8), ("ref", np.int64)])
#: What travels: SPAN and HIT packed, and documents with the arrays of their lines.
SPANS, HITS, LINES = 0, 1, 2
ROWS = "k int, kind int, doc_id long, key long, p binary, n binary, at binary"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def _batch(rows: list) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], NAMES)


def cut_lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, words, first byte, row) of each line; a line reaches to the next one's first byte."""
    w, start, end, row = C.words(raw, at)
    if not len(w):
        z = np.zeros(0, np.int64)
        return w, z, z, z
    last = raw[end - 1]
    stop = (last == 46) | (last == 33) | (last == 63)
    breaks = np.append(0, np.cumsum(raw == 10))
    first = np.ones(len(w), bool)
    first[1:] = stop[:-1] | (row[1:] != row[:-1]) | (breaks[start[1:]] > breaks[end[:-1]])
    new = np.flatnonzero(first)
    n = np.diff(np.append(new, len(w)))
    # an order-sensitive hash of the words of a line
    place = np.arange(len(w)) - np.repeat(new, n)
    h = C.mix(np.add.reduceat(C.mix(w + C.mix(place.astype(U))), new) + n.astype(U))
    return h, n, start[new], row[new]


class Lines:
    """The lines of many documents, one after the other."""

    def __init__(self, h: np.ndarray, n: np.ndarray, row: np.ndarray, min_words: int) -> None:
        self.n, self.row, self.min_words = n, row, min_words
        self.last = np.searchsorted(row, row, "right")  # the end of each line's document
        self.first = np.searchsorted(row, row)
        self.words = np.append(0, np.cumsum(n))
        self.end = np.searchsorted(self.words, self.words[:-1] + min_words)  # of the stretch from each line
        self.whole = self.end <= self.last
        power, self.back = C._power_tables(len(h) + 1)
        self.total = np.zeros(len(h) + 1, U)
        np.cumsum(C.mix(h) * power[: len(h)], out=self.total[1:])

    def hash(self, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The hash of the lines from a up to e, wherever they stand."""
        return C.mix((self.total[e] - self.total[a]) * self.back[a] + (e - a).astype(U))

    def fingerprints(self) -> np.ndarray:
        """The lines from which fingerprints reach, one stretch each."""
        start = np.flatnonzero(self.whole)  # in each document, all lines up to some one
        pick = self.n[start] >= max(LONG, self.min_words)
        x, row = self.hash(start, self.end[start]), self.row[start]
        at = np.flatnonzero(row[: len(row) - WINDOW + 1] == row[WINDOW - 1 :]) if len(row) >= WINDOW else start[:0]
        if len(at):
            pick[at + np.stack([x[at + i] for i in range(WINDOW)]).argmin(0)] = True
        new = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else start[:0]
        count = np.diff(np.append(new, len(row)))
        for m in range(1, WINDOW):
            at = new[count == m]
            if len(at):
                pick[at + np.stack([x[at + i] for i in range(m)]).argmin(0)] = True
        return start[pick]

    def longer(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of `line`, from, to) of the spans that extend the stretches from `line`."""
        which, a, e = [], [], []
        for r in range(1, WINDOW):
            at = np.flatnonzero(line - r >= self.first[line])
            which.append(at)
            a.append(line[at] - r)
            e.append(self.end[line[at]])
        beyond = np.minimum(line + WINDOW, self.last[line] - 1)
        most = np.minimum(np.where(self.whole[beyond] & (line + WINDOW == beyond), self.end[beyond] - 1, self.last[line]), self.last[line])
        n = np.maximum(most - self.end[line], 0)
        at = np.repeat(np.arange(len(line)), n)
        which.append(at)
        a.append(line[at])
        e.append(self.end[line[at]] + 1 + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n))
        return tuple(np.concatenate(x) for x in (which, a, e))  # type: ignore[return-value]


def _by_document(x: np.ndarray, buckets: int, kind: int) -> list:
    k = ((C.mix(x["doc"].astype(U) ^ C.mix(x["key"].astype(U))) >> U(32)) * U(buckets)) >> U(32)
    order = np.argsort(k, kind="stable")
    x, edge = x[order], np.searchsorted(k[order], np.arange(buckets + 1).astype(U))
    return [(i, kind, None, None, x[edge[i] : edge[i + 1]].tobytes(), None, None) for i in np.flatnonzero(np.diff(edge)).tolist()]


def _groups(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spans by hash and place, without repeats; the first of each one's hash; the spans of its hash)."""
    p = p[np.lexsort((p["want"], p["e"], p["a"], p["key"], p["doc"], p["h"]))]
    again = np.zeros(len(p), bool)
    again[:-1] = (p["h"][1:] == p["h"][:-1]) & (p["doc"][1:] == p["doc"][:-1]) & (p["key"][1:] == p["key"][:-1]) & (p["a"][1:] == p["a"][:-1])
    p = p[~again]  # of equal ones the one that wants an answer, or has been met again, is last
    new = np.flatnonzero(np.append(True, p["h"][1:] != p["h"][:-1]))
    size = np.diff(np.append(new, len(p)))
    return p, np.repeat(new, size), np.repeat(size, size)


def _hits(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), HIT)
    for c in ("doc", "key", "a", "e"):
        out[c] = p[c]
    out["early"] = (p["doc"] != first["doc"]) | (p["key"] != first["key"]) | (p["a"] != first["a"])
    out["ref"] = first["doc"]
    return out


def _send(p: np.ndarray, buckets: int) -> list:
    """Rows for what a task holds: the first span of each hash, and hits for the others.  A span that has been met
    again here wants an answer either way."""
    p, first, size = _groups(p)
    one = first == np.arange(len(p))
    sent, later = p[one], ~one & (p["want"] > 0)
    rows = _by_document(_hits(p[later], p[first[later]]), buckets, HITS)
    sent["want"] = np.where((size[one] > 1) & (sent["want"] > 0), 2, sent["want"])
    k = ((sent["h"] >> U(32)) * U(buckets)) >> U(32)  # rises with h
    edge = np.searchsorted(k, np.arange(buckets + 1).astype(U))
    return rows + [(i, SPANS, None, None, sent[edge[i] : edge[i + 1]].tobytes(), None, None) for i in np.flatnonzero(np.diff(edge)).tolist()]


def _joined(rows: DataFrame, buckets: int, every: bool) -> DataFrame:
    """Hits for the spans of `rows` (other rows pass): with `every`, for all that occur twice, else only for those
    with an earlier copy that want an answer."""

    def run(batches):
        got: dict[int, list] = {}
        for b in batches:
            other = b.filter(pc.not_equal(b.column(1), SPANS))
            if len(other):
                yield pa.RecordBatch.from_arrays(other.columns, NAMES)
            spans = b.filter(pc.equal(b.column(1), SPANS))
            for k, p in zip(spans.column(0).to_pylist(), spans.column(4).to_pylist()):
                got.setdefault(k, []).append(np.frombuffer(p, SPAN))
        while got:
            _, parts = got.popitem()
            p, first, size = _groups(np.concatenate(parts))
            want = (size > 1) | (p["want"] > 1) if every else (first != np.arange(len(p))) & (p["want"] > 0)
            if want.any():
                yield _batch(_by_document(_hits(p[want], p[first[want]]), buckets, HITS))

    return rows.repartition(buckets, "k").mapInArrow(run, ROWS)


def _fingerprints(docs: DataFrame, buckets: int, min_words: int) -> DataFrame:
    def run(batches):
        held, weight = [], 0
        for b in batches:
            b = b.filter(pc.and_(b.column(0).is_valid(), b.column(1).is_valid()))
            ids, keys = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            raw, at = C.text_buffer(b.column(1))
            for i, j in C.slices(at):
                h, n, _, row = cut_lines(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                lines = Lines(h, n, row, min_words)
                a = lines.fingerprints()
                p = np.zeros(len(a), SPAN)
                p["h"], p["a"], p["e"], p["want"] = lines.hash(a, lines.end[a]), a - lines.first[a], lines.end[a] - lines.first[a], 1
                p["doc"], p["key"] = ids[i + row[a]], keys[i + row[a]]
                held.append(p)
                weight += len(p)
            if weight > HELD:
                yield _batch(_send(np.concatenate(held), buckets))
                held, weight = [], 0
        if weight:
            yield _batch(_send(np.concatenate(held), buckets))

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(run, ROWS)


def _lines(docs: DataFrame, ids: DataFrame, buckets: int) -> DataFrame:
    """Hash, words and first byte of the lines, packed, of the documents with a doc_id of `ids` (and of a few others,
    by a bounded filter)."""
    bloom = docs.sparkSession.sparkContext.broadcast(C.bloom_of(ids))

    def run(batches):
        bits = C.bloom_bits(bloom.value)
        seen: set = set()
        for b in batches:
            b = b.filter(pc.and_(b.column(0).is_valid(), b.column(1).is_valid()))
            b = b.filter(pa.array(C.bloom_has(bits, b.column(0).to_numpy(zero_copy_only=False))))
            ids, keys = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            doc = np.zeros(len(b), SPAN)
            doc["doc"], doc["key"] = ids, keys
            k = ((C.mix(doc["doc"].astype(U) ^ C.mix(doc["key"].astype(U))) >> U(32)) * U(buckets)) >> U(32)
            raw, at = C.text_buffer(b.column(1))
            for i, j in C.slices(at):
                h, n, start, row = cut_lines(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                edge = np.searchsorted(row, np.arange(j - i + 1))
                out = []
                for r in range(j - i):
                    s, who = slice(edge[r], edge[r + 1]), (int(ids[i + r]), int(keys[i + r]))
                    if s.stop > s.start and who not in seen:
                        if len(seen) < 200_000:
                            seen.add(who)
                        out.append((int(k[i + r]), LINES, *who, h[s].tobytes(), n[s].astype(np.int32).tobytes(), (start[s] - (at[i + r] - at[i])).astype(np.int32).tobytes()))
                yield _batch(out)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(run, ROWS)


def _met(batches):
    """For batches of one partition, sorted by bucket and kind: (documents with hits, of each hit the row, the hits).
    A document that comes twice counts once."""
    at, parts, where, hits = None, [], None, None
    for b in batches:
        kinds, ks = b.column(1).to_pylist(), b.column(0).to_pylist()
        rows, spans = [], []
        for r, (k, kind) in enumerate(zip(ks, kinds)):
            if k != at:
                at, parts, where = k, [], None
            if kind == HITS:
                parts.append(np.frombuffer(b.column(4)[r].as_buffer(), HIT))
                continue
            if where is None:
                x = np.concatenate(parts) if parts else np.zeros(0, HIT)
                x = x[np.lexsort((x["a"], x["key"], x["doc"]))]
                new = np.flatnonzero(np.append(True, (x["doc"][1:] != x["doc"][:-1]) | (x["key"][1:] != x["key"][:-1]))) if len(x) else []
                ends = np.append(new[1:], len(x)) if len(x) else []
                where = dict(zip(zip(x["doc"][new].tolist(), x["key"][new].tolist()), zip(new, ends))) if len(x) else {}
                hits = x
            s = where.pop((b.column(2)[r].as_py(), b.column(3)[r].as_py()), None)
            if s:
                rows.append(r)
                spans.append(hits[s[0] : s[1]])
        if rows:
            yield b.take(pa.array(rows)), np.repeat(np.arange(len(rows)), [len(x) for x in spans]), np.concatenate(spans)


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed arrays, and how many each row has."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(parts), np.array([len(x) for x in parts])


def _sorted(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(buckets, "k").sortWithinPartitions("k", "kind")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, first_line, n_lines, n_words, start, end, ref_id): the runs of lines to delete.  start and
    end are bytes of the text; key is xxhash64 of the text; ref_id holds an earlier copy (of the longest part,
    where spans that overlap were joined).

    Empty texts have no lines.  An empty table gives no runs."""
    spark = docs.sparkSession
    buckets = C.shuffle_width(spark)

    def ids(batches):
        for b in batches:
            for p in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(p.as_buffer(), HIT)["doc"]))], ["doc_id"])

    hits = C.cut(_joined(_fingerprints(docs, buckets, min_words), buckets, True))
    touched = C.cut(hits.select("p").coalesce(C.BLOOM_PARTS).mapInArrow(ids, "doc_id long"))

    def extend(batches):
        held, weight = [], 0
        for b, of, hit in _met(batches):
            (h, m), (n, _) = _flat(b.column(4), U), _flat(b.column(5), np.int32)
            row = np.repeat(np.arange(len(b)), m)
            lines = Lines(h, n, row, min_words)
            base = np.cumsum(m) - m
            early = hit["early"] > 0
            gone = np.zeros(len(h) + 1, np.int64)
            np.add.at(gone, base[of[early]] + hit["a"][early], 1)
            np.add.at(gone, base[of[early]] + hit["e"][early], -1)
            kept = np.append(0, np.cumsum(np.cumsum(gone[:-1]) == 0))
            line = base[of] + hit["a"]
            which, a, e = lines.longer(line)
            p = np.zeros(len(a), SPAN)
            p["h"], p["a"], p["e"], p["want"] = lines.hash(a, e), a - base[of[which]], e - base[of[which]], kept[e] > kept[a]
            p["doc"], p["key"] = hit["doc"][which], hit["key"][which]
            held.append(p)
            weight += len(p)
            need = np.unique(np.append(of[early], of[which[p["want"] > 0]]))
            some = b.take(pa.array(need))
            yield _batch(_by_document(hit[early], buckets, HITS))
            yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.nulls(len(some), pa.binary()), *some.columns[5:]], NAMES)
            if weight > HELD:
                yield _batch(_send(np.concatenate(held), buckets))
                held, weight = [], 0
        if weight:
            yield _batch(_send(np.concatenate(held), buckets))

    longer = C.cut(_sorted(hits.union(_lines(docs, touched, buckets)), buckets).mapInArrow(extend, ROWS))
    ends = _joined(longer.where(F.col("kind") != LINES), buckets, False)

    def merge(batches):
        for b, of, hit in _met(batches):
            n, m = _flat(b.column(5), np.int32)
            at, _ = _flat(b.column(6), np.int32)
            row, base = np.repeat(np.arange(len(b)), m), np.cumsum(m) - m
            words, last = np.append(0, np.cumsum(n)), base + m
            a, e = base[of] + hit["a"], base[of] + hit["e"]
            gone = np.zeros(len(n) + 1, np.int64)
            np.add.at(gone, a, 1)
            np.add.at(gone, e, -1)
            gone = np.cumsum(gone[:-1]) > 0
            edge = row[1:] != row[:-1]
            start = np.flatnonzero(gone & np.append(True, edge | ~gone[:-1]))
            end = np.flatnonzero(gone & np.append(edge | ~gone[1:], True)) + 1
            run = np.searchsorted(start, a, "right") - 1
            order = np.lexsort((hit["ref"], e - a, run))  # the longest last
            ref = hit["ref"][order][np.searchsorted(run[order], np.arange(len(start)), "right") - 1]
            r = row[start]
            first = base[r]
            yield pa.RecordBatch.from_arrays(
                [b.column(2).take(pa.array(r)), b.column(3).take(pa.array(r)), pa.array((start - first).astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(words[end] - words[start]),
                 pa.array(np.where(start == first, 0, at[start]).astype(np.int64)), pa.array(np.where(end == last[r], -1, at[np.minimum(end, len(at) - 1)]).astype(np.int64)), pa.array(ref)],
                ["doc_id", "key", "first_line", "n_lines", "n_words", "start", "end", "ref_id"],
            )

    whole = _sorted(ends.union(longer.where(F.col("kind") == LINES)), buckets)
    return whole.mapInArrow(merge, "doc_id long, key long, first_line int, n_lines int, n_words long, start long, end long, ref_id long")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies of repeated runs deleted from `text`, n_chars (where there is one) counted
    anew; all other columns and rows as they were.  A document that is nothing but repeats ends as "".  Only
    documents with something to delete are shuffled."""
    runs = C.cut(repeated_runs(docs, min_words).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("__gone")))
    touched, rest = C.split_by_keys(docs, runs.select("doc_id").distinct())
    here = (F.col("t.doc_id") == F.col("r.doc_id")) & (F.xxhash64("t.text") == F.col("r.key"))
    joined = touched.alias("t").join(runs.alias("r"), here, "left").select("t.*", "r.__gone")
    schema = T.StructType(docs.schema.fields)
    text_at, n_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def apply(batches):
        for b in batches:
            texts = []
            for text, gone in zip(b.column(text_at).to_pylist(), b.column(len(schema)).to_pylist()):
                if gone:
                    raw, out, last = text.encode(), [], 0
                    for x in sorted(gone, key=lambda x: x["start"]):
                        out.append(raw[last : x["start"]])
                        last = x["end"] if x["end"] >= 0 else len(raw)
                    text = b"".join([*out, raw[last:]]).decode().rstrip()
                texts.append(text)
            columns = b.columns[: len(schema)]
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if n_at is not None:
                columns[n_at] = pa.array([None if t is None else len(t) for t in texts], columns[n_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.mapInArrow(apply, schema).union(rest)
