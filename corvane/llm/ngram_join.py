"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles.  Two link when their Jaccard similarity reaches the
threshold; the result is each document's connected component under those links.

1.  A document is named by the signature of its set, so exact copies are one node from here on.
2.  One order of all shingles: those in a bounded table of frequent shingles come last, by rising
    count; the others come first, by hash.  Any one order gives right results.
3.  With threshold t, a set of n shingles and tau = ceil(t n), two linked sets share at least l
    shingles within their first n - tau + l, for every l <= tau.  Each document picks the l (up to
    MAX_MATCH) of least estimated cost: the postings it meets plus the expected verifications, which
    fall as 1/l because a candidate must share l shingles.  Its prefix has that length; a pair goes
    by the smaller l of the two.
    More than that, a pair of n and m shingles must have o = ceil(t (n + m) / (1 + t)) in common, so for any c its first
    c common shingles lie in the first n - o + c and m - o + c.  With the largest c that both prefixes reach, only
    matches at such places count, and there must be c of them.
4.  Prefix postings travel packed (arrays, not rows) to buckets of the shingle hash.  In lists of at
    most SMALL members all pairs count one match each.  In wider lists each member is only paired
    with a few pivots, the members with the most frequent shingles; whole lists come back in step 6.
5.  Candidate pairs are verified exactly by merging both shingle sets; links are joined to components.
6.  Wide lists whose members all lie in one component need no more work.  In the others one representative of each
    component is verified against the list's most central one.  Then members of different components meet, each
    from its shortest lists on, as far as it can still have the matches it needs; what their sketches tell apart
    never becomes a row, the rest is verified.

Nulls and texts without words: no shingles, linked with nothing, the component is the own doc_id.
A null doc_id stays in the result with a null component and links nothing.  Repeated rows
each get a row.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import common as C

MAX_MATCH = 8
SMALL = 16
PIVOTS = 3
#: Frequent shingles kept for ordering and cost: 12 bytes each, so 12 MB at most.
FREQUENT = 1 << 20
#: Postings a verification costs as much as.
VERIFY_COST = 40.0
#: Bits of a node's sketch.
SKETCH = 1024
#: Members of one posting list that one bucket holds, about; longer lists are salted.
LIST_SHARE = 20_000

U = np.uint64


def sketch(ids: np.ndarray) -> np.ndarray:
    """SKETCH bits, those set that some shingle falls on.  Each bit that another set's sketch lacks is a shingle at
    least that it lacks."""
    bits = np.zeros(SKETCH, bool)
    bits[(ids >> U(20)) & U(SKETCH - 1)] = True
    return np.packbits(bits).view(np.int64)


def _digest(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, sig, bits) of each row, and the packed local counts of shingles met twice or more."""

    def run(batches):
        held: list[np.ndarray] = []

        def repeated():
            if not held:
                return None
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            h, c = h[c > 1], c[c > 1]
            return (h.tobytes(), c.astype(np.uint32).tobytes()) if len(h) else None

        def out(ids, ns, sigs, bits, counts):
            k = len(ids)
            extra = [counts] if counts else []
            offsets = np.append(np.arange(k + 1), [k] * len(extra)).astype(np.int32) * (SKETCH // 64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(len(extra), pa.int64())]),
                    pa.array(list(ns) + [None] * len(extra), pa.int64()),
                    pa.array(list(sigs) + [None] * len(extra), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(bits.reshape(-1))),
                    pa.array([None] * k + [x[0] for x in extra], pa.binary()),
                    pa.array([None] * k + [x[1] for x in extra], pa.binary()),
                ],
                ["doc_id", "n", "sig", "bits", "hot", "hot_n"],
            )

        seen: set[int] = set()
        weight = 0
        for b in batches:
            raw, at = C.text_buffer(b.column(1))
            ns, sigs, bits = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64), np.zeros((len(b), SKETCH // 64), np.int64)
            for r, ids in C.shingle_sets(raw, at, size):
                ns[r] = len(ids)
                sigs[r] = C.signature(ids) if len(ids) else 0
                bits[r] = sketch(ids)
                if len(ids) and sigs[r] not in seen:  # copies would only add noise to the counts
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(int(sigs[r]))
                    held.append(ids)
                    weight += len(ids)
            counts = None
            if weight > 2_000_000:
                counts, weight = repeated(), 0
            yield out(b.column(0), ns.tolist(), sigs.tolist(), bits, counts)
        if counts := repeated():
            yield out(pa.nulls(0, pa.int64()), [], [], np.zeros(0, np.int64), counts)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig long, bits array<long>, hot binary, hot_n binary")


def _frequent(packed: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT shingles of highest count, by hash.  Each of the buckets sends its own share of them,
    so the driver gets at most FREQUENT entries."""

    def deal(batches):
        for b in batches:
            parts: dict[int, list] = {}
            for h, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, c = np.frombuffer(h, U), np.frombuffer(c, np.uint32)
                edge = np.searchsorted(h, np.arange(buckets + 1).astype(U) * U(2**64 // buckets))
                for k in range(buckets):
                    s = slice(edge[k], edge[k + 1] if k < buckets - 1 else len(h))
                    if s.stop > s.start:
                        parts.setdefault(k, []).append((h[s], c[s]))
            rows = [(k, *_sum(v)) for k, v in parts.items()]
            yield _rows(rows, "k h c", [pa.int32(), pa.binary(), pa.binary()])

    def top(batches):
        got = [
            (np.frombuffer(h, U), np.frombuffer(c, np.uint32))
            for b in batches
            for h, c in zip(b.column("h").to_pylist(), b.column("c").to_pylist())
        ]
        if got:
            h, c = (np.frombuffer(x, t) for x, t in zip(_sum(got), (U, np.uint32)))
            keep = np.lexsort((h, -c.astype(np.int64)))[: FREQUENT // buckets]
            yield _rows([(h[keep].tobytes(), c[keep].tobytes())], "h c", [pa.binary()] * 2)

    dealt = packed.mapInArrow(deal, "k int, h binary, c binary").repartition(buckets, "k")
    got = dealt.mapInArrow(top, "h binary, c binary").collect()
    h = np.concatenate([np.frombuffer(r[0], U) for r in got] or [np.zeros(0, U)])
    c = np.concatenate([np.frombuffer(r[1], np.uint32) for r in got] or [np.zeros(0, np.uint32)])
    order = np.argsort(h)
    return h[order], c[order]


def _sum(parts: list) -> tuple[bytes, bytes]:
    h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return h.tobytes(), np.bincount(at, np.concatenate([p[1] for p in parts]), len(h)).astype(np.uint32).tobytes()


def _rows(rows: list, names: str, kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names.split())


class Order:
    """The common order of shingles, and each document's choice of l."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, percent: int) -> None:
        self.h, self.c, self.percent = hashes, counts, percent
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[hashes >> U(42)] = True

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), np.int64)
        at = np.flatnonzero(self.maybe[ids >> U(42)])
        if len(at):
            p = np.minimum(np.searchsorted(self.h, ids[at]), len(self.h) - 1)
            hit = self.h[p] == ids[at]
            out[at[hit]] = self.c[p[hit]]
        return out

    def prefix(self, ids: np.ndarray) -> tuple[np.ndarray, int, int, np.ndarray]:
        """(shingles, l, centrality 0-255, counts): the first n - tau + l in order."""
        n = len(ids)
        tau = -(-self.percent * n // 100)
        c = self.counts(ids)
        hot = c > 1
        central = int(255 * hot.mean())
        most = min(MAX_MATCH, tau)
        first = n - tau + 1
        if not central and not hot.any() or n - int(hot.sum()) >= first + most - 1:
            ids = ids[~hot][:first]
            return ids, 1, central, np.ones(len(ids), np.int64)
        order = np.concatenate([np.flatnonzero(~hot), np.flatnonzero(hot)[np.lexsort((ids[hot], c[hot]))]])
        ids, c = ids[order][: first + most - 1], c[order][: first + most - 1]
        met = np.cumsum(c)[first - 1 :]
        steps = np.arange(1, len(met) + 1)
        l = 1 + int(np.argmin(met + VERIFY_COST * (met - np.arange(first, first + len(met))) / steps))
        return ids[: first + l - 1], l, central, c[: first + l - 1]


#: Postings that a task holds before it sends them on.
HELD = 1_000_000

POSTING = np.dtype([("h", U), ("sig", np.int64), ("n", np.uint32), ("at", np.uint32), ("l", np.uint8), ("cent", np.uint8), ("salt", np.uint8)])


def _pack(p: np.ndarray) -> bytes:
    """Postings by node, column by column: the upper 48 bits of hashes as they are, and what a node's postings have in
    common compressed.  With the bucket, which is of the whole hash, more than 48 bits tell shingles apart; sets are
    compared by all 64."""
    p = p[np.argsort(p["sig"], kind="stable")]
    sig, h = p["sig"].copy(), p["h"].copy()
    sig[1:] -= p["sig"][:-1]
    planes = [sig.view(np.uint8).reshape(-1, 8).T.tobytes(), *(p[c].copy().view(np.uint8).reshape(-1, 4).T.tobytes() for c in ("n", "at"))]
    return h.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() + zlib.compress(b"".join(planes + [p[c].tobytes() for c in ("l", "cent", "salt")]), 1)


def _unpack(n: int, packed: bytes) -> np.ndarray:
    p = np.zeros(n, POSTING)
    h = np.zeros((n, 8), np.uint8)
    h[:, 2:] = np.frombuffer(packed, np.uint8, 6 * n).reshape(n, 6)
    p["h"] = h.view(U)[:, 0]
    rest = np.frombuffer(zlib.decompress(memoryview(packed)[6 * n :]), np.uint8)
    p["sig"] = np.cumsum(rest[: 8 * n].reshape(8, n).T.copy().view(np.int64)[:, 0])
    p["n"] = rest[8 * n : 12 * n].reshape(4, n).T.copy().view(np.uint32)[:, 0]
    p["at"] = rest[12 * n : 16 * n].reshape(4, n).T.copy().view(np.uint32)[:, 0]
    for i, c in enumerate(("l", "cent", "salt")):
        p[c] = rest[(16 + i) * n : (17 + i) * n]
    return p


def _postings(docs: DataFrame, order, percent: int, size: int, buckets: int) -> DataFrame:
    def run(batches):
        table = Order(*order.value, percent)
        seen: set[int] = set()
        held, weight = [], 0

        def flush():
            p = np.concatenate(held)
            held.clear()
            k = ((C.mix(p["h"] + p["salt"].astype(U)) >> U(32)) * U(buckets)) >> U(32)
            by = np.argsort(k, kind="stable")
            p, edge = p[by], np.searchsorted(k[by], np.arange(buckets + 1).astype(U))
            return _rows([(i, int(edge[i + 1] - edge[i]), _pack(p[edge[i] : edge[i + 1]])) for i in range(buckets) if edge[i + 1] > edge[i]], "k n p", [pa.int32(), pa.int32(), pa.binary()])

        for b in batches:
            raw, at = C.text_buffer(b.column(0))
            for _, ids in C.shingle_sets(raw, at, size):
                if not len(ids) or (sig := C.signature(ids)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sig)
                h, l, cent, c = table.prefix(ids)
                p = np.zeros(len(h), POSTING)
                p["h"], p["at"], p["sig"], p["n"], p["l"], p["cent"] = h, np.arange(len(h)), sig, len(ids), l, cent
                if c[-1] > LIST_SHARE:  # counts rise along the prefix
                    p["salt"] = np.where(c > LIST_SHARE, 1 + (sig % 251) % np.clip(c // LIST_SHARE, 1, 250), 0)
                held.append(p)
                weight += len(h)
            if weight > HELD:
                yield flush()
                weight = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "k int, n int, p binary").repartition(buckets, "k")


def _fits(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(which matches of a and b count, the number of matches that their nodes need)."""
    n, m = a["n"].astype(np.int64), b["n"].astype(np.int64)
    both = -(-percent * (n + m) // (100 + percent))
    need = both + np.minimum(a["l"] + percent * -n // 100, b["l"] + percent * -m // 100)
    ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (a["sig"] != b["sig"])
    return ok & (a["at"] < n - both + need) & (b["at"] < m - both + need), need


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """kind 0: pair (x, y) with its matches c here and the l that it needs.  kind 1: pair of a wide list with a pivot,
    alike.  kind 2: member (list x, node y) of a wide list, with its size c, l, place and centrality."""

    def run(batches):
        got = []
        for b in batches:
            for k, n, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                got.append(_unpack(n, x))
                got[-1]["h"] |= U(k & 0xFFFF)  # lists of different buckets stay apart
        if not got:
            return
        p = np.concatenate(got)
        got.clear()
        p = p[np.lexsort((p["sig"], p["salt"], p["h"]))]
        same = (p["h"][1:] == p["h"][:-1]) & (p["salt"][1:] == p["salt"][:-1])
        p = p[np.concatenate([[True], ~(same & (p["sig"][1:] == p["sig"][:-1]))])]
        starts = np.flatnonzero(np.concatenate([[True], (p["h"][1:] != p["h"][:-1]) | (p["salt"][1:] != p["salt"][:-1])]))
        lens = np.diff(np.append(starts, len(p)))
        xs, ys, ls, kinds = [], [], [], []

        def add(a, b, kind):
            ok, need = _fits(a, b, percent)
            a, b = a[ok], b[ok]
            xs.append(np.minimum(a["sig"], b["sig"]))
            ys.append(np.maximum(a["sig"], b["sig"]))
            ls.append(need[ok])
            kinds.append(np.full(len(a), kind, np.int8))

        for m in range(2, SMALL + 1):
            at = starts[lens == m]
            for i in range(m if len(at) else 0):
                for j in range(i + 1, m):
                    add(p[at + i], p[at + j], 0)
        for at, m in zip(starts[lens > SMALL], lens[lens > SMALL]):
            g = p[at : at + m]
            rank = np.lexsort((C.mix(g["sig"].view(U)), -g["cent"].astype(np.int16)))
            for i in rank[:PIVOTS]:
                add(np.repeat(g[i : i + 1], m), g, 1)
        if xs:
            x, y, l, kind = (np.concatenate(v) for v in (xs, ys, ls, kinds))
            if len(x):
                by = np.lexsort((kind, y, x))
                x, y, l, kind = x[by], y[by], l[by], kind[by]
                new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (kind[1:] != kind[:-1])]))
                count = np.diff(np.append(new, len(x)))
                yield from _out(kind[new], x[new], y[new], count, l[new])
        wide = np.repeat(lens > SMALL, lens)
        if wide.any() or (p["salt"] > 0).any():
            g = p[wide | (p["salt"] > 0)]
            yield from _out(np.full(len(g), 2, np.int8), g["h"].view(np.int64), g["sig"], g["n"], g["l"], g["at"], g["cent"])

    def _out(kind, x, y, c, l, at=None, cent=None):
        zero = np.zeros(len(x), np.int32)
        for i in range(0, len(x), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind[j]), pa.array(x[j], pa.int64()), pa.array(y[j], pa.int64()), pa.array(c[j].astype(np.int64)), pa.array(l[j].astype(np.int32)), pa.array((zero if at is None else at.astype(np.int32))[j]), pa.array((zero if cent is None else cent.astype(np.int32))[j])],
                ["kind", "x", "y", "c", "l", "at", "cent"],
            )

    return postings.mapInArrow(run, "kind byte, x long, y long, c long, l int, at int, cent int")


def _verify(docs: DataFrame, digest: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (x, y) whose sets are similar enough, by merging the whole sets; cut."""
    spark = docs.sparkSession
    nodes = pairs.select(F.col("x").alias("sig")).union(pairs.select("y")).distinct()
    # One document stands for each set.  Only those are read again, told by a bounded filter; the few others
    # that pass it find no pair, or repeat one.
    keepers = digest.where("n > 0 AND doc_id IS NOT NULL").join(nodes, "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    bloom = spark.sparkContext.broadcast(C.bloom_of(C.cut(keepers.select("doc_id"))))

    def sets(batches):
        bits = C.bloom_bits(bloom.value)
        seen: set[int] = set()
        for b in batches:
            ids = b.column(0)
            hit = C.bloom_has(bits, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(hit))
            raw, at = C.text_buffer(b.column(1))
            rows, weight = [], 0
            for _, s in C.shingle_sets(raw, at, size):
                if not len(s) or (sig := C.signature(s)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(sig)
                rows.append((sig, s.tobytes()))
                weight += s.nbytes
                if weight > 8 << 20:
                    yield _rows(rows, "sig ids", [pa.int64(), pa.binary()])
                    rows, weight = [], 0
            yield _rows(rows, "sig ids", [pa.int64(), pa.binary()])

    found = C.keep(docs.select("doc_id", "text").mapInArrow(sets, "sig long, ids binary"))
    found.count()  # else both sides of the join below would make it at once

    def test(batches):
        for b in batches:
            ok = []
            for p, q in zip(b.column("ids_x"), b.column("ids_y")):
                p, q = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(found.select(F.col("sig").alias("x"), F.col("ids").alias("ids_x")), "x")
    similar = C.cut(left.join(found.select(F.col("sig").alias("y"), F.col("ids").alias("ids_y")), "y").mapInArrow(test, "x long, y long"))
    found.unpersist()
    return similar


def _met(member: DataFrame, matches: DataFrame, digest: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one open list and different components that may be similar, by their places in the list,
    the matches that they can have, and their sketches.

    A node has at most `cap` matches with any other from a list on, taking its lists from the shortest to the
    longest: those lists, and the most that one pair of small lists gave it.  Two nodes that need more meet in a
    shorter list, or nowhere.  A pair that shares too little is told by sketches before it becomes a row."""
    best = matches.select(F.col("x").alias("sig"), "c").union(matches.select("y", "c")).groupBy("sig").agg(F.max("c").alias("most"))
    ranked = member.join(member.groupBy("h").agg(F.count("*").alias("size")), "h")
    ranked = ranked.withColumn("left", F.count("*").over(Window.partitionBy("sig").orderBy(F.desc("size"), "h")))
    bits = digest.join(member.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.first("bits").alias("bits"))
    rows = ranked.join(best, "sig", "left").join(bits, "sig").withColumn("cap", F.col("left") + F.coalesce("most", F.lit(0)))
    rows = C.cut(rows.select("h", "root", "sig", "n", "k", "u", "cap", "bits"))
    met = rows.join(rows.select("h", *(F.col(c).alias(f"{c}2") for c in rows.columns if c != "h")), "h")
    both = f"(({percent} * (n + n2) + {99 + percent}) div {100 + percent})"
    lacks = " + ".join(f"bit_count(bits[{i}] & ~bits2[{i}])" for i in range(SKETCH // 64))
    return met.where(f"root < root2 AND {_COUNTS} AND 100 * n >= {percent} * n2 AND 100 * n2 >= {percent} * n AND {both} + least(k, k2) <= least(cap, cap2) AND n - ({lacks}) >= {both}")


#: _fits in SQL, with k = l - ceil(t n) and u = place - n: a match counts where u < min(k, k2), and u < k always holds.
_COUNTS = "u < k2 AND u2 < k"


def _placed(rows: DataFrame, percent: int) -> DataFrame:
    return rows.withColumn("k", F.expr(f"l - (({percent} * n + 99) div 100)")).withColumn("u", F.expr("at - n"))


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id long, text string): see the module.
    percent: the least Jaccard similarity, in hundredths; size: words a shingle."""
    spark = docs.sparkSession
    buckets = C.shuffle_width(spark)
    both = C.cut(_digest(docs, size))
    digest, sketches = both.where("hot IS NULL").select("doc_id", "n", "sig"), both.where("n > 0").select("sig", "bits")
    order = spark.sparkContext.broadcast(_frequent(both.where("hot IS NOT NULL").select("hot", "hot_n"), buckets))
    made = C.keep(_candidates(_postings(docs, order, percent, size, buckets), percent))

    # Pairs that also meet in a wide list have matches that are not counted here; the wide lists find them.  A pair
    # of a wide list with a pivot waits for those too, unless what is seen here bears it out by half.
    counted = made.where("kind < 2").groupBy("x", "y").agg(F.sum(F.expr("if(kind = 0, c, 0)")).alias("c"), F.sum(F.expr("if(kind = 1, c, 0)")).alias("pivot"), F.max("l").alias("l"))
    pairs = C.cut(counted.where("c >= l OR pivot > 0 AND 2 * (c + pivot) >= l").select("x", "y"))
    links = _verify(docs, digest, pairs, percent, size)
    roots = C.cut(C.components(links.toDF("a", "b")))

    matches = made.where("kind = 0").groupBy("x", "y").agg(F.sum("c").alias("c"))
    wide = made.where("kind = 2").select(F.col("x").alias("h"), F.col("y").alias("sig"), F.col("c").alias("n"), "l", "at", "cent")
    for last in (False, True):
        member = _placed(wide, percent).join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        open_ = member.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
        member = member.join(open_, "h", "left_semi")
        if not last:  # a representative of each component against the most central one of the list
            member = member.groupBy("h", "root").agg(F.max_by(F.struct("sig", "n", "k", "u", "cent"), F.struct("cent", F.xxhash64("sig"))).alias("m")).select("h", "root", "m.*")
            best = member.groupBy("h").agg(F.max_by(F.struct("root", "sig", "n", "k", "u"), F.struct("cent", "n", "sig")).alias("m")).select("h", *(F.col(f"m.{c}").alias(f"{c}2") for c in ("root", "sig", "n", "k", "u")))
            met = member.join(best, "h").where(f"root <> root2 AND {_COUNTS} AND 100 * least(n, n2) >= {percent} * greatest(n, n2)")
        else:
            member = C.cut(member)
            here = member.select("sig").distinct()
            matches = matches.join(here.withColumnRenamed("sig", "x"), "x", "left_semi").join(here.withColumnRenamed("sig", "y"), "y", "left_semi")
            met = _met(member, matches, sketches, percent)
        met = met.select(F.least("sig", "sig2").alias("x"), F.greatest("sig", "sig2").alias("y")).distinct()
        more = C.cut(met.join(pairs, ["x", "y"], "left_anti"))
        if more.isEmpty():
            continue
        pairs = pairs.union(more)
        links = links.union(_verify(docs, digest, more, percent, size))
        roots = C.cut(C.components(links.toDF("a", "b")))
    made.unpersist()

    named = digest.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    named = named.withColumn("root", F.when(F.col("n") > 0, F.col("root")))
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
