"""Each operator on small tables with nulls, empty and long texts, ties, repeats and clashing columns, against
plain versions."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from corvane.llm import common as C

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, RANKS, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, shard int, n long, h string, key int"


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame([(i, t, 5, 1, "x", 2) for i, t in rows], schema).repartition(parts)


def sentence(r, n, words=400):
    return " ".join(f"w{r.randrange(words)}" + r.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Rows with every kind of trouble."""
    r = random.Random(1)
    base = sentence(r, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [(1, base), (2, base), (2, base), (3, " ".join(near)), (4, ""), (5, None), (6, "two words"), (7, "TWO  words\n"), (8, " \t\n"), (9, sentence(r, 9000)), (None, base), (None, None), (10, "é" * 3000), (11, base + " " + sentence(r, 15))]
    return rows + [(20 + i, sentence(r, 60)) for i in range(20)]


def shingles(text, size=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in sets}


def test_words_and_shingles(odd):
    import pyarrow as pa

    raw, at = C.text_buffer(pa.array([t for _, t in odd]))
    got = dict(C.shingle_sets(raw, at))
    assert [len(got[k]) for k in range(len(odd))] == [len(shingles(t)) for _, t in odd]
    known = {s for _, t in odd for s in shingles(t)}
    assert len(np.unique(np.concatenate(list(got.values())))) == len(known)


def test_long_row_is_cut_alike(monkeypatch):
    import pyarrow as pa

    text = sentence(random.Random(3), 4000) + " " + "y" * 700 + " Z"
    whole = C.words(*C.text_buffer(pa.array([text, "a b"])))
    monkeypatch.setattr(C, "BLOCK", 512)
    small = C.words(*C.text_buffer(pa.array([text, "a b"])))
    assert all((a == b).all() for a, b in zip(whole, small))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {n: m for n, m in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: find(n) for e in edges if e[0] != e[1] for n in e} == got
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, odd):
    from corvane.llm.ngram_join import near_duplicates

    got = near_duplicates(frame(spark, odd)).collect()
    assert len(got) == len(odd)
    want = brute_components(odd)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t)) for _, t in odd)
    assert near_duplicates(frame(spark, odd).limit(0)).count() == 0


def test_near_duplicates_in_wide_lists(spark, monkeypatch):
    """Many variants of a few bases that share a passage: lists too wide for pairs, several components."""
    from corvane.llm import ngram_join as N

    r = random.Random(4)
    passage = sentence(r, 30, 10**6)
    rows = []
    for b in range(3):
        base = (passage + " " + sentence(r, 50, 10**6)).split()
        for _ in range(30):
            v = list(base)
            for _ in range(r.choice([0, 1, 2, 5])):
                v[r.randrange(30, 80)] = f"z{r.random()}"
            rows.append((len(rows), " ".join(v)))
    for most, share in ((8, 20_000), (1, 5)):
        monkeypatch.setattr(N, "MAX_MATCH", most)
        monkeypatch.setattr(N, "LIST_SHARE", share)
        got = {x.doc_id: x.component_id for x in N.near_duplicates(frame(spark, rows)).collect()}
        assert got == brute_components(rows)


def test_prefixes_share_as_promised():
    """Any two linked sets reach the asked number of matches at places that count."""
    from corvane.llm.ngram_join import POSTING, Order, _fits, _pack, _unpack

    r = np.random.default_rng(1)
    for trial in range(60):
        hot = np.unique(r.integers(1, 2**62, 30, dtype=np.uint64))
        order = Order(hot, r.integers(2, 500, len(hot)).astype(np.uint32), 75)
        n = int(r.integers(4, 120))
        base = np.unique(np.concatenate([r.integers(1, 2**62, n, dtype=np.uint64), r.choice(hot, 10)]))
        keep = base[r.random(len(base)) < 0.9]
        other = np.unique(np.concatenate([keep, r.integers(1, 2**62, max(1, n // 20), dtype=np.uint64)]))
        both = len(np.intersect1d(base, other))
        if 100 * both < 75 * (len(base) + len(other) - both):
            continue
        sides = []
        for x in (base, other):
            ids, l, _, _ = order.prefix(x)
            p = np.zeros(len(ids), POSTING)
            p["h"], p["at"], p["n"], p["l"], p["sig"] = ids, np.arange(len(ids)), len(x), l, len(sides)
            sides.append(p)
        a, b = sides
        _, i, j = np.intersect1d(a["h"], b["h"], return_indices=True)
        ok, need = _fits(a[i], b[j], 75)
        assert len(need) and ok.sum() >= need[0] >= min(a["l"][0], b["l"][0])
        assert (_unpack(len(a), _pack(a))["h"] == a["h"] >> np.uint64(16) << np.uint64(16)).all()


def test_leaks(spark):
    from corvane.llm.decontaminate import leaks

    r = random.Random(6)
    items = [(i, " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(40))) for i in range(4)]
    edited = items[2][1].replace(items[2][1].split()[3], "zz", 1)
    clean = [sentence(r, 300) for _ in range(5)]
    docs = [(i, t) for i, t in enumerate(clean)]
    docs += [(10, clean[0] + " " + items[0][1].upper().replace(" ", "!! ") + " " + clean[1]), (11, "x " + edited), (12, None), (13, ""), (None, items[1][1]), (10, clean[0]), (14, "é ç " + items[3][1][80:280] + " ñ")]
    bench = spark.createDataFrame([*items, (7, None), (8, "short"), (None, "a"), (2, items[2][1])], "item_id long, text string")
    got = leaks(frame(spark, docs), bench).collect()
    assert sorted((x.doc_id is not None, x.doc_id or 0, x.item_id) for x in got) == [(False, 0, 1), (True, 10, 0), (True, 11, 2), (True, 14, 3)]
    span = next(x for x in got if x.doc_id == 10)
    assert docs[5][1].lower().encode()[span.start : span.end].decode().replace("!!", "") == items[0][1]
    assert leaks(frame(spark, docs), bench.limit(0)).count() == 0
    assert leaks(frame(spark, docs).limit(0), bench).count() == 0


def test_alignment_is_edit_distance():
    """The banded alignment gives the least edit distance of a segment to any part of its region."""
    from corvane.llm.decontaminate import Segments

    r = random.Random(8)
    for _ in range(20):
        item = "".join(r.choice("abcdefghijklmnop") for _ in range(100))
        text = list(item)
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(text))
            text[k : k + 1] = r.choice([[], ["q"], ["q", text[k]]])
        text = "zzzz" + "".join(text) + "zzzzz"
        index = Segments([(1, item)], 12, 0.05)
        raw, at = C.text_buffer(__import__("pyarrow").array([text]))
        row = [0] * (len(text) + 1)
        for c in item:
            new = [row[0] + 1]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        found = list(index.regions(raw, at))
        assert bool(found) or min(row) > 5
        if found:
            assert min(index.align(raw, at, found)[0]) == min(row)


@pytest.mark.parametrize("hits", [1 << 21, 5])
def test_leaks_against_all_alignments(spark, monkeypatch, hits):
    """The whole result, against the edit distance of every segment to every part of every document."""
    from corvane.llm import decontaminate as D

    monkeypatch.setattr(D, "HITS", hits)
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))
    items = [(k, words(n)) for k, n in enumerate((9, 12, 25, 50, 70))] + [(5, "Forty two"), (6, "Q7"), (7, words(5)), (8, "..."), (9, "forty two"), (10, None)]
    docs = []
    for i in range(40):
        text = list(r.choice(items[:5])[1])
        for _ in range(r.choice([0, 1, 2, 4, 8, 12])):
            k = r.randrange(len(text))
            text[k : k + 1] = r.choice([[], ["q"], ["q", text[k]]])
        docs.append((i, f"{words(5)} {''.join(text)}! {words(4)}"))
    docs += [(100, "it is forty, TWO."), (101, "fortytwo"), (102, "sixforty two"), (103, "forty twos"), (104, "x q7 y"), (105, f"so {items[7][1]}"), (106, f"so{items[7][1]}"), (107, ""), (108, None)]

    letters = lambda t: re.sub("[^a-z0-9]", "", (t or "").lower())

    def near(seg, text, k):
        row = [0] * (len(text) + 1)
        for c in seg:
            new = [row[0] + 1]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return min(row) <= k

    want = set()
    for i, t in docs:
        flat = letters(t)
        for item, x in items:
            x = letters(x)
            if len(x) >= D.LEAST:
                cuts = [(0, len(x))] if len(x) <= D.MERGE else [(a, a + D.SEGMENT) for a in [*range(0, len(x) - D.SEGMENT, D.STRIDE), len(x) - D.SEGMENT]]
                if any(near(x[a:b], flat, int(D.RATE * (b - a))) for a, b in cuts):
                    want.add((i, item))
            elif x:
                spread = r"(?<![a-z0-9])" + "[^a-z0-9]*".join(x) + r"(?![a-z0-9])"
                if re.search(spread, (t or "").lower()):
                    want.add((i, item))
    got = D.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want) > 30
    text = dict(docs)
    for x in got:
        if x.item_id in (5, 6, 9):
            assert letters(text[x.doc_id][x.start : x.end]) == letters(dict(items)[x.item_id])


def test_toxicity(spark):
    from corvane.llm.toxicity import fit, score

    r = random.Random(9)
    rows, labels = [], []
    for i in range(200):
        words = sentence(r, 80).split(" ")
        bad = i % 5 == 0
        for _ in range(2 if bad else 0):
            words[r.randrange(80)] = r.choice(["vilename", "vilename,", "gruntling"])
        if i % 7 == 1 and not bad:
            words[5:5] = ["kind", "vilename"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = frame(spark, rows)
    model = fit(docs, spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int"))
    probe = [(1, "you v1lеname you"), (2, "a kind vilename here"), (3, ""), (4, None), (None, "VILENAME"), (5, "vilenameless-ness is fine"), (5, "gru​ntling " * 3), (6, "fine text")]
    got = score(frame(spark, probe, parts=1), model).collect()
    assert len(got) == len(probe) and all(0 <= x.score <= 1 for x in got)
    by = {x.doc_id: x.predicted for x in got}
    assert (by[1], by[2], by[3], by[4], by[None], by[5], by[6]) == (1, 0, 0, 0, 1, 1, 0)
    empty = fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert score(docs, empty).where("predicted = 0").count() == 200
    assert score(docs.limit(0), model).count() == 0


def test_lexicon_against_a_plain_matcher():
    """Every place of every entry, by looking at each place of the folded text."""
    from corvane.llm.toxicity import Fold, Lexicon, fold

    r = random.Random(12)
    weights = {"".join(r.choice("abo") for _ in range(r.randint(2, 5))) + r.choice(["", "*"]): r.random() + 1 for _ in range(25)}
    lexicon = Lexicon({"weights": weights, "before": [("ab", "abo")], "after": [], "coefficients": [0.0, 1.0, 1.0]})
    for _ in range(200):
        text = "".join(r.choice("aabbo0@ .,é") for _ in range(60))
        flat, places = fold(text, Fold()), {}
        for word, weight in weights.items():
            n = len(word.rstrip("*"))
            for s in range(len(flat) - n + 1):
                free = (s == 0 or not text[s - 1].isalnum()) and (word[-1] == "*" or s + n == len(text) or not text[s + n].isalnum())
                if flat[s : s + n] == word.rstrip("*") and free:
                    places.setdefault(s, []).append((weight, word, s + n))
        assert sorted(lexicon.matches(text)) == sorted((w, s, e) for s, found in places.items() for _, w, e in [max(found)])
        counts = {}
        for found in places.values():
            for _, w, _ in found:
                counts[w] = counts.get(w, 0) + 1
        assert lexicon.entries(text) == counts
        for w, s, e in lexicon.matches(text):
            before, after = re.search(r"(\S*)\s*$", text[:s])[1], re.match(r"\s*(\S*)", text[e:])[1]
            assert lexicon.neighbours(text, s, e) == (fold(before, Fold()), fold(after, Fold()))


def test_cumulative_link_finds_the_likelihood():
    """No other weights or thresholds nearby do better, by a plain sum over documents; grades come out in order."""
    from corvane.llm.quality import cumulative_link

    r = np.random.default_rng(4)
    n, k = 300, 5
    x = r.normal(0, 1, (n, k))
    latent = x @ np.array([1.5, -1.0, 0.5, 0.0, 0.0]) + r.logistic(0, 1, n)
    y = np.searchsorted([-1.0, 0.5, 2.0], latent)
    d, f = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    weights, thresholds = cumulative_link(d, f, x.ravel(), y, 4, 3000, 0.0)

    def loss(w, t):
        total = 0.0
        for i in range(n):
            s = sum(w[j] * x[i, j] for j in range(k))
            p = [1 / (1 + np.exp(-(c - s))) for c in t]
            total -= np.log(([*p, 1.0][y[i]]) - ([0.0, *p][y[i]]))
        return total / n

    best = loss(weights, thresholds)
    assert list(thresholds) == sorted(thresholds) and weights[0] > 0.8 and weights[1] < -0.4
    for _ in range(40):
        w, t = weights.copy(), np.sort(thresholds + r.normal(0, 0.05, 3))
        w[:k] += r.normal(0, 0.05, k)
        assert loss(w, t) > best - 2e-4


def test_quality(spark):
    from corvane.llm import quality as Q

    r = random.Random(10)
    rows = [(i, " ".join(r.choice(["good", "fair", "mild"]) if r.random() < (i % 4) / 4 + 0.1 else r.choice(["bad", "junk"]) for _ in range(60))) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 4) for i in range(240)] + [(None, 1), (1, None)], "doc_id long, quality int")
    docs = frame(spark, rows)
    model = Q.fit(docs, labels)
    assert model["grades"] == [0, 1, 2, 3] and (np.diff(model["thresholds"]) > 0).all()
    got = {x.doc_id: x for x in Q.grade(docs, model, at_least=2).collect()}
    wanted = [i % 4 for i in range(240)]
    assert np.corrcoef([got[i].expected_grade for i in range(240)], wanted)[0, 1] > 0.9
    assert np.mean([got[i].selected == (i % 4 >= 2) for i in range(240)]) > 0.9
    odd = frame(spark, [(1, None), (1, ""), (None, "x"), (2, "good " * 5000)])
    assert Q.grade(odd, model).count() == 4
    kept = Q.keep_good(docs, model, at_least=2)
    assert kept.columns == docs.columns and kept.count() == sum(x.selected for x in got.values())
    none = Q.fit(docs, labels.limit(0))
    assert Q.grade(docs, none).count() == 240 and Q.grade(docs.limit(0), model).count() == 0


def test_sharding(spark):
    from corvane.llm.sharding import matrix, shuffle_into_shards

    sent, size = matrix([5, 0, 17, 3], 4, 1)
    assert sent.sum(1).tolist() == [5, 0, 17, 3] and sent.sum(0).tolist() == size.tolist() == [7, 6, 6, 6]
    mean = np.mean([matrix([10, 30], 2, s)[0][0, 0] for s in range(400)])
    assert abs(mean - 5) < 0.3
    rows = [(i % 50 if i % 9 else None, None if i % 5 == 0 else "same") for i in range(203)]
    docs = frame(spark, rows)
    for n in (1, 8):
        got = shuffle_into_shards(docs, n).collect()
        assert len(got) == 203
        for s in range(n):
            assert sorted(x.slot for x in got if x.shard == s) == list(range(203 // n + (s < 203 % n)))
    assert sorted(map(repr, ((x.doc_id, x.text) for x in got))) == sorted(map(repr, rows))
    assert shuffle_into_shards(docs.limit(0), 8).count() == 0


def test_sharding_query_moves_texts(spark, monkeypatch):
    import zlib

    from corvane.llm import queries, sharding

    moved, shuffle = [], sharding.shuffle_into_shards
    monkeypatch.setattr(sharding, "shuffle_into_shards", lambda rows, *a: moved.append(rows) or shuffle(rows, *a))
    got = queries.op5_hypergeometric_sharding(spark, SF).collect()
    assert moved[0].columns == ["doc_id", "text"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda d, t: (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((x.doc_id, x["size"], x.text_crc32) for x in got) == sorted(digest(*x) for x in docs)


def test_cuts_are_optimal():
    from corvane.llm import packing as K

    r = random.Random(11)
    for _ in range(60):
        places = np.cumsum([r.randint(1, 7) for _ in range(r.randint(1, 14))])
        penalty = np.array([r.choice([0, 1, 4]) for _ in places])
        window = 16
        powers = {window >> k for k in range(1, K._HALVES + 1)}

        def cost(cuts, places=places, penalty=penalty, powers=powers):
            total, last = 0, 0
            for k in cuts:
                n = places[k] - last
                if n > window:
                    return None
                total += penalty[k] + K.SEQUENCE + (0 if n in powers else window - n)
                last = places[k]
            return total

        every = (c + (len(places) - 1,) for n in range(len(places)) for c in itertools.combinations(range(len(places) - 1), n))
        assert cost(K.cut_windows(places, penalty, window)) == min(x for x in map(cost, every) if x is not None)


def test_packing_round_trip(spark, odd, monkeypatch):
    from tokenizers import Tokenizer

    from corvane.llm.packing import pack

    odd = [*odd, (50, "a<|endoftext|>b  c"), (51, "it's  we'll \r\n")]
    docs = frame(spark, [(i, t) for i, t in odd if i is not None and t is not odd[2][1]] + [(None, "x y")])
    got = pack(docs, BPE, RANKS, with_ids=True).collect()
    library = Tokenizer.from_file(BPE)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for d, t in texts.items():
        want = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((p for p in got if p.doc_id == d), key=lambda p: p.start)
        assert [x for p in mine for x in p.ids] == want
        for p in mine:
            assert p.doc_tokens == len(want) and p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    for _, pieces in itertools.groupby(sorted(got, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        at = 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        assert at <= 1024
    assert pack(docs.limit(0), BPE, RANKS).count() == 0


def test_encoders_equal_the_libraries():
    import pyarrow as pa
    import sentencepiece

    from corvane.llm import tokens as T

    r = random.Random(12)
    alphabets = ["ab 's ", "a  ñ😀 \n\t", "x   y\x1c", "aб 中1 \r\n", "<|endoftext|> a", "it's we'll ١٢ é ́", "\x85 a　\xa0 b é ", "a b c.d\n", "a ▁b", "<s> </s>", " ", "xyz"]
    texts = ["".join(r.choice(a) for _ in range(r.randint(0, 80))) for a in alphabets for _ in range(25)] + ["a<|endoftext|> b", "", "a b"]
    bpe = T.ByteBpe(BPE, RANKS)
    assert bpe.encode(pa.array(texts)) == [np.array(e.ids, "<u4").tobytes() for e in bpe.library.encode_batch(texts, add_special_tokens=False)]
    pieces = T.Pieces(PIECE)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = [len(x) for x in library.encode(texts)]
    assert pieces.proven and pieces.counts(texts) == want
    for t in texts + ["x" * 500 + " y " + "word " * 200, "z" * 3000]:
        assert T.count_huge(t, pieces, chunk=24, overlap=4) == len(library.encode(t))


def test_ids_need_no_string_a_word(monkeypatch):
    import sys

    import pyarrow as pa

    from corvane.llm import tokens as T

    bpe, held = T.ByteBpe(BPE, RANKS), []
    plain = bpe._plain
    monkeypatch.setattr(bpe, "_plain", lambda text: held.append(sys.getallocatedblocks()) or plain(text))
    column = pa.array([" ".join(f"word{i % 50}" for i in range(200_000))])
    before = sys.getallocatedblocks()
    assert bpe.encode(column) == [plain(column[0].as_py()).tobytes()]
    assert max(held) - before < 20_000


@pytest.mark.parametrize("known, solve", [(200_000, 200_000), (3, 200_000), (3, 40)])
def test_packing_in_small_steps(monkeypatch, known, solve):
    import pyarrow as pa

    from corvane.llm import packing as K
    from corvane.llm import tokens as T

    class Table:
        """Runs what mapInArrow gets, in this process."""

        def __init__(self, batches):
            self.batches = batches

        def select(self, *columns):
            return self

        sortWithinPartitions = select

        def mapInArrow(self, run, schema):
            return [x for b in run(iter(self.batches)) for x in b.to_pylist()]

    r = random.Random(21)
    words = ["a", "b.", "it's", "", "中文", "x\ny", "n\n", "\nm", "<|endoftext|>", "<b>", " ", "\xa0"]
    texts = [None, "", " ", "a  b\n \nc", *(" ".join(r.choice(words) for _ in range(r.randint(0, 90))) for _ in range(60))]
    ids = [None if i % 9 == 4 else i // 2 for i in range(len(texts))]
    batch = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(T, "KNOWN_UNITS", known)
    monkeypatch.setattr(K, "SOLVE", solve)
    monkeypatch.setattr(K, "BLOCK", 500)
    T.byte_bpe.cache_clear()
    batches = [batch.slice(0, 0), batch.slice(0, 7), batch.slice(7, 30), batch.slice(37)]
    got = K.pack(Table(batches), BPE, RANKS, window=32, with_ids=True)
    T.byte_bpe.cache_clear()
    library = T.ByteBpe(BPE).library
    rows = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in zip(ids, texts)]
    assert [x for p in got for x in p["ids"]] == [x for _, row in rows for x in row]
    want = iter(rows)
    for p in got:
        if p["start"] == 0:
            doc, row = next(want)
        assert (p["doc_id"], p["doc_tokens"], p["ids"]) == (doc, len(row), row[p["start"] : p["start"] + p["length"]])
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
    assert next(want, None) is None
    for _, pieces in itertools.groupby(got, key=lambda p: p["sequence_id"]):
        pieces = list(pieces)
        assert [p["offset"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p["length"] for p in pieces) <= 32
    assert [p["sequence_id"] for p in got] == sorted(p["sequence_id"] for p in got)


def test_token_counts(spark, odd):
    import sentencepiece

    from corvane.llm.tokens import token_counts

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = token_counts(frame(spark, odd), PIECE, huge=2000).collect()
    want = sorted((repr(i), len((t or "").encode()), len(library.encode(t or ""))) for i, t in odd)
    assert sorted((repr(x.doc_id), x.n_bytes, x.n_tokens) for x in got) == want
    assert all(x.over_limit == (x.n_tokens > 4096) for x in got)
    assert token_counts(frame(spark, odd).limit(0), PIECE).count() == 0


def test_lm_scores(spark):
    from corvane.llm.lm_score import fit, score

    r = random.Random(13)
    target = frame(spark, [(i, " ".join(r.choice(["sun", "moon", "star"]) for _ in range(40))) for i in range(30)] + [(1, None)])
    docs = frame(spark, [(i, " ".join(r.choice(["sun", "dirt", "mud"]) for _ in range(40))) for i in range(60)] + [(90, "moon star sun moon"), (91, "mud dirt mud dirt"), (92, ""), (93, None), (None, "sun")])
    model = fit(target, docs)
    assert np.allclose(model["unigram"].sum(1), 1)
    got = {x.doc_id: x for x in score(docs, model).collect()}
    assert len(got) == 65 and got[90].score < got[91].score and got[92].score is None and got[93].n_words == 0
    p = lambda s, u, w: (0, 0)  # noqa: E731, F841
    # brute force of one document
    n, texts = {}, [[x.text for x in f.collect()] for f in (target, docs)]
    known = sorted({w for w in " ".join(t or "" for t in texts[0]).split()})
    for side in (0, 1):
        uni, bi = {}, {}
        for t in texts[side]:
            last = "<s>"
            for w in (t or "").split():
                w = w if w in known else "?"
                uni[w], bi[last, w] = uni.get(w, 0) + 1, bi.get((last, w), 0) + 1
                last = w
        total, loss, last = sum(uni.values()), 0, "<s>"
        for w in "moon star sun moon".split():
            c = sum(v for (a, _), v in bi.items() if a == last)
            loss -= np.log((bi.get((last, w), 0) + 200 * (uni.get(w, 0) + 1) / (total + len(known) + 2)) / (c + 200))
            last = w
        n[side] = loss / 4
    assert np.isclose(got[90].score, n[0] - n[1], atol=1e-5)
    assert score(docs.limit(0), model).count() == 0
    assert score(docs, fit(target.limit(0), docs)).count() == 65


def test_lm_models_hold_every_pair(spark, monkeypatch):
    from corvane.llm import lm_score as L

    # 70,000 words that the target repeats, and the pairs of the later ones: over what 16 bits hold
    monkeypatch.setattr(L, "HELD", 50_000)
    words = [f"w{i}" for i in range(70_000)]
    rows = [(i, " ".join(words[i : i + 1000])) for i in range(0, 70_000, 1000)]
    target, docs = frame(spark, rows + rows), frame(spark, [*rows, (1, "w5 w5"), (2, None)])
    model = L.fit(target, docs)
    assert len(model["words"]) == 70_000 and model["unigram"].shape == (2, 70_002)
    got = {x.doc_id: x for x in L.score(docs, model).collect()}
    assert len(got) == 72 and got[1].n_words == 2 and got[2].score is None
    # of each row: the first word after START, of 140 and 71 rows, and 999 pairs seen twice and once
    n = ((140_000, 140, 2, 2), (70_002, 71, 1, 1))
    for i in range(1000, 70_000, 1000):
        for loss, (total, starts, first, rest) in zip((got[i].target_loss, got[i].background_loss), n):
            p = (rest + 1) / (total + 70_002)
            each = -np.log((rest + 200 * p) / (rest + 200))
            assert np.isclose(loss, (999 * each - np.log((first + 200 * p) / (starts + 200))) / 1000, atol=1e-5)
    monkeypatch.setattr(L, "BUCKET_BYTES", 1000)
    assert L._bits(docs.select("text")) > L.LEAST_BITS


def test_hypergeometric_draws(monkeypatch):
    """Chi-square of many draws against the law, by numpy and by inversion; sums for sizes that numpy refuses."""
    from math import comb

    from corvane.llm import sharding as S

    for side in (S.SIDE, 1):
        monkeypatch.setattr(S, "SIDE", side)
        draw = np.random.default_rng(5)
        for good, bad, n in ((9, 14, 8), (30, 5, 20), (3, 50, 2), (6, 6, 12)):
            got = np.bincount([S._taken(draw, good, bad, n) for _ in range(4000)], minlength=n + 1)
            want = np.array([comb(good, k) * comb(bad, n - k) / comb(good + bad, n) * 4000 for k in range(n + 1)])
            assert got[want == 0].sum() == 0
            big = want > 5
            assert ((got - want)[big] ** 2 / want[big]).sum() < 40
    monkeypatch.undo()
    counts = [3 * 10**10, 10**10 + 7, 5, 0, 6 * 10**9]
    sent, size = S.matrix(counts, 7, 3)
    assert sent.sum(1).tolist() == counts and sent.sum(0).tolist() == size.tolist() and sent.min() >= 0
    assert abs(sent[0, 0] - counts[0] / 7) < 10 * (counts[0] / 7) ** 0.5


def test_line_dedup(spark):
    from corvane.llm.line_dedup import cut_lines, dedup_lines, repeated_runs

    r = random.Random(14)
    passage = "\n".join(sentence(r, 9, 10**6).replace("\n", " ") for _ in range(6))
    long = " ".join(f"q{i}" for i in range(60)) + "."
    rows = [(i, f"{sentence(r, 40, 10**6)}\n{passage}\n{sentence(r, 30, 10**6)}") for i in range(5)]
    rows += [(10, f"own words here.\n{long}\nmore."), (11, f"other start.\n{long}\nother end."), (12, "Short line.\nAnd one."), (13, "Short line.\nTwo."), (14, None), (15, ""), (None, passage), (16, passage), (16, passage), (17, f"{long} {long}\n")]
    docs = frame(spark, rows)
    got = dedup_lines(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    by = {}
    for x in got.collect():
        by.setdefault(x.doc_id, []).append(x.text)
    assert by[0] == [rows[0][1]] and by[10] == [rows[5][1]] and by[12] == ["Short line.\nAnd one."] and by[13] == ["Short line.\nTwo."]
    for i in range(1, 5):
        assert passage.split("\n")[2] not in by[i][0] and by[i][0].startswith(rows[i][1][:20])
    assert by[11] == ["other start.\nother end."] and by[14] == [None] and by[15] == [""] and by[None] == [passage] and by[16] == ["", ""] and by[17] == [""]
    # every line that was there is still somewhere
    lines = lambda ts: set(np.concatenate([cut_lines(*C.text_buffer(__import__("pyarrow").array([t])))[0] for t in ts if t] or [np.zeros(0, np.uint64)]).tolist())
    assert lines([t for i, t in rows]) == lines([t for ts in by.values() for t in ts])
    assert repeated_runs(docs.limit(0)).count() == 0


def brute_runs(rows, window, long, least):
    """(lines that some earlier equal run of `least` words or more covers, those of them that are guaranteed)."""
    import pyarrow as pa

    import xxhash

    key = lambda t: (xxhash.xxh64(t, seed=42).intdigest() ^ 2**63) - 2**63
    docs = []
    for i, t in sorted({x for x in rows if x[0] is not None and x[1]}, key=lambda x: (x[0], key(x[1]))):
        h, n, _, _ = cut_lines_of(pa.array([t]))
        docs.append((i, h.tolist(), n.tolist()))
    every, sure = set(), set()
    for x, (i, h, n) in enumerate(docs):
        for y, (j, g, _) in enumerate(docs[: x + 1]):
            for d in range(-len(g) + 1, len(h)):  # h[p] against g[p - d]
                p = max(0, d)
                while p < min(len(h), len(g) + d):
                    e = p
                    while e < min(len(h), len(g) + d) and h[e] == g[e - d]:
                        e += 1
                    if e > p and sum(n[p:e]) >= least and (x != y or d > 0):
                        every.update((i, k) for k in range(p, e))
                        starts = sum(sum(n[k:e]) >= least for k in range(p, e))
                        if starts >= window or max(n[p:e]) >= long:
                            sure.update((i, k) for k in range(p, e))
                    p = max(e, p + 1)
    return every, sure


def cut_lines_of(column):
    from corvane.llm.line_dedup import cut_lines

    return cut_lines(*C.text_buffer(column))


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_finds_all_runs(spark, seed, monkeypatch):
    """Against all pairs of documents, with lines that also stand alone in earlier documents."""
    from corvane.llm import line_dedup as L

    if seed % 2:
        monkeypatch.setattr(L, "HELD", 60)  # many small flushes, so that copies meet in buckets too
    r = random.Random(seed)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(r.choice([1, 2, 3, 6, 6, 9, 11, 13]))) + "\n"
    pool = [line() for _ in range(60)]
    passages = [[r.choice(pool) for _ in range(r.randrange(2, 12))] for _ in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 6)):
            kind = r.randrange(4)
            x = r.choice(passages)
            a = r.randrange(len(x))
            parts += [line()] if kind == 0 else [r.choice(pool)] if kind == 1 else x if kind == 2 else x[a : a + 5]
        rows.append((i if i else 7, "".join(parts)))
    six = [" ".join(f"p{k}_{m}" for m in range(6)) + ".\n" for k in range(6)]
    rows += [(1000 + k, f"alone {k}.\n{x}") for k, x in enumerate(six)] + [(2000, "before.\n" + "".join(six)), (2001, "after.\n" + "".join(six))]
    every, sure = brute_runs(rows, L.WINDOW, L.LONG, L.MIN_WORDS)
    got = set()
    for x in L.repeated_runs(frame(spark, rows)).collect():
        got.update((x.doc_id, k) for k in range(x.first_line, x.first_line + x.n_lines))
    assert sure <= got <= every and len(sure) > 100
    assert {(2001, k) for k in range(1, 7)} <= got


def test_topk(spark):
    from corvane.llm.topk import search

    r = np.random.default_rng(15)
    vectors = [(int(i), [float(x) for x in r.normal(0, 0.3, 16)]) for i in range(300)] + [(7, [0.5] * 16), (1000, None), (1001, [float("nan")] * 16), (1002, [None, *[0.1] * 15]), (None, [0.1] * 16), (1003, [])]
    vectors += [(2000 + i, vectors[3][1]) for i in range(8)]  # ties
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, q string, score int").repartition(3)
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()]
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in search(df, df.where("vec_id % 50 = 0")).collect())
    want = []
    for i, q in good:
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for j, v in good if j != i)[:5]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)
    assert search(df, df.limit(0)).count() == 0 and search(df.limit(0), df.where("vec_id = 0")).count() == 0


def test_topk_with_unequal_lengths_and_large_values(spark, monkeypatch):
    """Vectors meet those of their length whatever the order of rows; sums beyond 2^53 are exact; small blocks and waves."""
    from corvane.llm import topk as K

    monkeypatch.setattr(K, "BLOCK", 16)
    monkeypatch.setattr(K, "WAVE", 400)
    r = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in r.normal(0, 1, r.choice([2, 3, 7]))]) for i in range(150)] + [(400, [1.0]), (1, [1.0, 1.0]), (50, [0.3, 0.1])]
    vectors += [(1000 + i, [float(x) for x in r.normal(0, 1e5, 5)]) for i in range(60)] + [(1100, [1e5 + 0.123, 3.0, 1.0, 0.0, -9e4])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors]
    want = []
    for i, q in good:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))[:5]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in K.search(df, df.where("vec_id % 50 = 0")).collect())
    assert got == sorted(want)
    x = np.floor(r.normal(0, 100, (40, 6)))
    index = K.Index(np.arange(40), x)
    assert all((np.diff(v[1][e[0] : e[1]]).size == 0 or v[1][: e[1]].min(initial=1e9) >= v[1][e[1] :].max(initial=0)) for v in index.lists for e in [v[2]])
    assert sum(len(v[0]) for v in index.lists) == sum(int((y > 0).sum()) for y in (x - x.min(0), x.max(0) - x))


def test_topk_proof_comes_before_the_last_postings():
    """On vectors without structure each query reads under three quarters of a posting a vector and dimension, and the
    members are those of the dense product; so they are with an outlier, few values, many ties and repeated ids."""
    from corvane.llm import topk as K

    r = np.random.default_rng(8)
    for kind in ("normal", "outlier", "sparse", "copies", "small"):
        x = np.floor(r.normal(0, 32, (6 if kind == "small" else 2000, 64)))
        ids = r.permutation(len(x))
        if kind == "outlier":
            x[3] *= 10_000
        elif kind == "sparse":
            x *= r.random(x.shape) < 0.05
        elif kind == "copies":
            x, ids = x[r.integers(0, 50, len(x))], np.where(np.arange(len(x)) < 300, ids[0], ids)
        q, own = x[:: len(x) // 6], ids[:: len(x) // 6]
        want = [sorted((-s, i) for s, i in zip((x @ v).tolist(), ids.tolist()) if i != o)[:5] for v, o in zip(q, own.tolist())]
        for floor in ([-np.inf] * len(q), [-w[4][0] for w in want]):
            index = K.Index(ids, x)
            found = index.search(q, own, np.array(floor), 5)
            assert [[(-s, i) for s, i in zip(*(c.tolist() for c in f))] for f in found] == want
            assert kind != "normal" or index.read <= 0.75 * x.size * len(q)


def test_registered():
    from corvane.llm import queries

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_pipeline_keeps_what_it_should(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = P.quality(spark, docs, SF)
    assert good.columns == docs.columns
    assert good.join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * docs.join(labels.where("quality = 1"), "doc_id").count()
    kept = P.near(spark, docs, SF).select("doc_id").collect()
    want = {m for m in brute_components([(r.doc_id, r.text) for r in docs.collect()]).values()}
    assert {r.doc_id for r in kept} == want
    clean = {r.doc_id for r in P.leaks(spark, docs, SF).select("doc_id").collect()}
    items = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean == {r.doc_id for r in docs.collect() if not any(t in r.text.lower() for t in items)}
    assert P.run(spark, SF).where(F.col("length") > 1024).count() == 0


def test_pipeline_ends_in_token_ids(spark):
    import zlib

    import corpus_pipeline as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    pieces = {}
    for x in P.packing(spark, docs, SF).collect():
        assert len(x.ids) == x.length and zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32
        pieces.setdefault(x.doc_id, []).append((x.start, x.ids))
    library = Tokenizer.from_file(BPE)
    for d, t in docs.select("doc_id", "text").collect():
        assert [i for _, ids in sorted(pieces[d]) for i in ids] == [*library.encode(t or "", add_special_tokens=False).ids, 0]


def test_near_keeps_what_documents_give_again_out_of_the_shared_folder(spark, monkeypatch):
    """Candidates and sets, which have a part for each split of the documents, are no files of the shared folder, and
    nothing of them stays on the executors."""
    from corvane.llm import common as C
    from corvane.llm import ngram_join as J

    cut, columns = C.cut, []
    monkeypatch.setattr(C, "cut", lambda df: (columns.append(df.columns), cut(df))[1])
    before = {*spark.sparkContext._jsc.getPersistentRDDs()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    rows += [(10_000 + i, t + " and more") for i, (_, t) in enumerate(rows[:40])]
    got = {r.doc_id: r.component_id for r in J.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows) and got[10_000] != 10_000
    assert not [c for c in columns if "ids" in c or "kind" in c] and ["x", "y"] in columns
    cut_now = {k for k, v in dict(spark.sparkContext._jsc.getPersistentRDDs()).items() if v.getStorageLevel().useDisk() and not v.getStorageLevel().useMemory()}
    assert cut_now <= before


def test_near_judges_rows_that_share_an_id(spark):
    import corpus_pipeline as P

    r = random.Random(31)
    a, b, c, d = (sentence(r, 40) for _ in range(4))
    # id 7 is shared by three texts, one of which is a copy of a smaller id's
    docs = frame(spark, [(1, a), (7, a), (7, b), (7, c), (7, c), (8, d), (9, d), (None, d)])
    got = sorted((x.doc_id, x.text) for x in P.near(spark, docs, SF).collect())
    assert got == sorted([(1, a), (7, b), (7, c), (8, d)])


def test_pipeline_stages_with_odd_rows(spark, odd):
    """Null and repeated ids, rows that share an id only, empty texts and tables, columns of their own."""
    import corpus_pipeline as P

    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = odd + [(None, f"some words ahead. {item} and after"), (7, f"again {item}"), (21, sentence(random.Random(77), 80)), (21, sentence(random.Random(78), 80))]
    docs = frame(spark, rows)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name != "packing":
            assert stage(spark, docs, SF).columns == docs.columns
    as_pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    sort = lambda x: sorted(x, key=str)
    assert sort(as_pairs(P.leaks(spark, docs, SF))) == sort(x for x in rows if not x[1] or item not in x[1])
    got = as_pairs(P.near(spark, docs, SF))
    named = [(k, t) for k, (_, t) in enumerate(rows)]
    root = brute_components(named)
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(root[k], []).append((i is None, i or 0, t or "", i, t))
    assert sort(got) == sort(min(g)[3:] for g in groups.values())
    assert sort(x for x in as_pairs(P.lines(spark, docs, SF)) if x[0] is None) == sort(x for x in rows if x[0] is None and x[1] and x[1].strip())
    pieces = P.packing(spark, docs, SF)
    assert pieces.where("start = 0").count() == len(rows)


def test_bloom_filter_is_built_in_few_jobs(spark):
    """One job a part, one after the other, leaves a cluster idle for longer the more partitions there are."""
    keys = np.random.default_rng(5).integers(-(2**63), 2**63, 3000)
    df = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "k long").repartition(40)
    sc = spark.sparkContext
    sc.setJobGroup("bloom", "bloom")
    try:
        bits = C.bloom_bits(C.bloom_of(df))
    finally:
        sc._jsc.sc().clearJobGroup()
    size = 1 << C.BLOOM_LEAST
    plain = np.zeros(size, bool)
    for p in C._bloom_places(keys, size):
        plain[p] = True
    assert np.array_equal(bits, np.packbits(plain, bitorder="little"))
    assert len(sc.statusTracker().getJobIdsForGroup("bloom")) <= 8
    assert not C.bloom_bits(C.bloom_of(df.where("k IS NULL"))).any()
    assert C.bloom_has(bits, keys).all()


def test_features_count_words_as_a_plain_version_does(odd):
    import pyarrow as pa

    from corvane.llm import quality as Q

    texts = [t for _, t in odd] + ["a b A c.  b a", "é É é"]
    raw, at = C.text_buffer(pa.array(texts, pa.string()))
    rows, hashed, _ = Q.features(raw, at)
    n = len(texts)
    styles = hashed[-7 * n :].reshape(7, n)
    assert (rows[-7 * n :].reshape(7, n) == np.arange(n)).all()
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        many = max(len(words), 1)
        unique, long = 1 - (len(words) - len(set(words))) / many, np.log2(1 + len(words))
        often = max((words.count(w) for w in set(words)), default=0) / many
        for k, c in ((3, min(int(unique * 10), 9) * 8 + min(int(long // 2), 7)), (4, min(int(often * 10), 9))):
            assert styles[k, i] == int(C.mix(np.array([(k + 1 << 32) + c], np.uint64))[0] >> np.uint64(64 - Q.BITS))


def test_distinct_is_unique():
    for n in (0, 1, 2, 1000):
        x = np.random.default_rng(n).integers(0, 300, n).astype(np.uint64)
        assert np.array_equal(C.distinct(x), np.unique(x))
