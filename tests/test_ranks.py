"""Order statistics, splits, bootstrap and similarities against plain versions."""

import difflib
import hashlib
import random

from pyspark.sql import functions as F

from corvane.operators import corpus as C
from corvane.operators import evalstats as E
from corvane.operators import ranks


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 20)
    monkeypatch.setattr(ranks, "BUCKETS", 64)
    r = random.Random(1)
    values = [r.choice([r.randrange(50), r.randrange(-(2**62), 2**62), 7]) for _ in range(1500)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 700, 1499, 1500):
        assert ranks.number_at(df, k) == sorted(values)[k - 1]
    keys = [hashlib.md5(f"s|{i}".encode()).hexdigest() + str(i) for i in range(900)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for k in (1, 450, 900):
        assert ranks.hashed_at(df, k) == sorted(keys)[k - 1]


def test_splits(spark):
    df = spark.range(2000).withColumnRenamed("id", "pos")
    order = sorted(range(2000), key=lambda i: hashlib.md5(f"s|{i}".encode()).hexdigest() + str(i))
    got = {r.pos: r.split for r in C.split_exact(df, F.col("pos"), {"a": 300, "b": 500}, "c", "s").collect()}
    assert got == {i: "a" if k < 300 else "b" if k < 800 else "c" for k, i in enumerate(order)}
    assert {r.pos for r in C.ratio_cap(df, 400, 0.2, F.col("pos"), "s").collect()} == set(order[:100])
    assert C.ratio_cap(df, 0, 0.2, F.col("pos"), "s").count() == 0 and C.ratio_cap(df, 10**6, 0.5, F.col("pos"), "s").count() == 2000
    got = {r.pos: r.split for r in C.temporal_split(df, "pos", 0.75).collect()}
    assert got == {i: "train" if i < 1500 else "val" for i in range(2000)}
    assert C.temporal_split(df.limit(0)).count() == 0 and C.split_exact(df.limit(0), F.col("pos"), {"a": 3}, "c", "s").count() == 0
    assert C.split_exact(df, F.col("pos"), {"a": 5000}, "c", "s").where("split = 'a'").count() == 2000
    plan = C.split_exact(df, F.col("pos"), {"a": 300}, "c", "s")._jdf.queryExecution().toString()
    assert "Window" not in plan and "TakeOrdered" not in plan and "Exchange" not in plan


def test_bootstrap_covers_the_truth(spark, monkeypatch):
    monkeypatch.setattr(E, "DRAWS", 37)
    r = random.Random(2)
    rows = [(g, r.choices(["A", "B", "tie"], [6, 3, 1])[0]) for g in ("x", "y") for _ in range(200)] + [("z", "tie")] * 3
    got = {x.g: x for x in E.bootstrap(spark.createDataFrame(rows, "g string, winner string"), ["g"], 300).collect()}
    assert "z" not in got or got["z"].lo is None
    for g in ("x", "y"):
        a, b = (sum(v == w for h, v in rows if h == g) for w in "AB")
        rate, spread = a / (a + b), (a * b / (a + b) ** 3) ** 0.5
        assert got[g].n == 200 and abs(got[g].lo - (rate - 1.96 * spread)) < 0.03 and abs(got[g].hi - (rate + 1.96 * spread)) < 0.03


def test_margins(spark):
    r = random.Random(3)
    rows = [(g, r.random(), r.choice([r.random(), 0.5])) for g in "ab" for _ in range(301)]
    df = spark.createDataFrame(rows, "g string, score_chosen double, score_rejected double")
    for by in (["g"], []):
        for x in E.pairwise_accuracy(df, by).collect():
            m = sorted(a - b for g, a, b in rows if not by or g == x.g)
            assert x.n == len(m) and x.median_margin == m[len(m) // 2] and abs(x.accuracy - sum(v > 0 for v in m) / len(m)) < 1e-12


def test_similarities(spark):
    from corvane.functions.similarity import highest_similarity, sequence_similarity

    texts = ["The  quick fox", "the quick ox", "", "lazy dog", None, "THE QUICK FOX"]
    flat = lambda t: " ".join(t.lower().split())
    pairs = [(a, b) for a in texts for b in texts]
    got = spark.createDataFrame(pairs, "a string, b string").withColumn("s", sequence_similarity(F.col("a"), F.col("b"))).collect()
    for x in got:
        want = None if x.a is None or x.b is None else difflib.SequenceMatcher(None, flat(x.a), flat(x.b)).ratio()
        assert x.s == want
    rows = [(a, [b for b in texts if b != a] if k else []) for a in texts for k in (0, 1)] + [("x", None)]
    for x in spark.createDataFrame(rows, "a string, b array<string>").withColumn("s", highest_similarity(F.col("a"), F.col("b"))).collect():
        want = None if x.a is None else max((difflib.SequenceMatcher(None, flat(x.a), flat(y)).ratio() for y in x.b or [] if y is not None), default=0.0)
        assert x.s == want
