"""Rows and sizes that the small tables lack: each query against its SQL, each operator against a plain version."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from corvane.operators import corpus as C
from corvane.operators import sessions as S
from corvane.plans import registry

entry._library()


def same(spark, folder, name, table, df):
    """The rows of a query over one table, which are those of its SQL."""
    df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    got = registry.QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    rel = con.sql(registry.ORACLES[name]).select(", ".join(columns))
    assert rows == sorted(rel.fetchall(), key=repr)
    return rows


def test_artists_of_songs_without_text(spark, tmp_path):
    rows = [(1, "src1", "x", "la"), (2, " SRC7 ", "x", None), (3, "x", "Src1", ""), (4, None, "src7", " \t"), (5, "src1\t", None, "la"), (6, None, None, "la"), (7, "src2", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    assert same(spark, tmp_path, "f15_artist_match", "documents", docs) == [(1,), (2,), (3,), (4,)]
    assert [r.doc_id for r in C.artist_match(docs, ["Src1 "], ("source", "lang"), "text").collect()] == [1, 5]


LOGS = {"gapless": ([0, 1, 59, 30], [1, 2, 3]), "mixed": ([1, 5, 700, -40], [1, 1, 1, 2]), "one turn": ([1], [7]), "all apart": ([601], [1])}


def log_of(spark, kind, n):
    steps, users = LOGS[kind]
    r, at, rows = random.Random(kind), 0, []
    for i in range(n):
        at += r.choice(steps)
        rows.append((3 * i, at, r.choice(users), f"t{i % 7}"))
    rows[n // 2] = (rows[n // 2][0], None, *rows[n // 2][2:])
    r.shuffle(rows)
    return spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string").selectExpr("event_id", "CAST(timestamp_seconds(at) AS TIMESTAMP_NTZ) AS ts", "user_id", "event_type")


def in_one_task(df):
    return max(df.rdd.glom().map(len).collect())


@pytest.mark.parametrize("kind", LOGS)
@pytest.mark.parametrize("name", ["w2_sessionize", "w1_merge_one_log"])
def test_one_log_in_ranges(spark, tmp_path, monkeypatch, name, kind):
    monkeypatch.setattr(S, "RANGE", 150, raising=False)
    rows = same(spark, tmp_path, name, "events", log_of(spark, kind, 3000))
    if kind == "gapless":
        assert in_one_task(registry.QUERIES[name](spark, str(tmp_path))) < len(rows) / 2


def test_draws_are_shared_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3 % 2, int(i % 7 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    spark.sparkContext.setJobGroup("draws", "draws")
    same(spark, tmp_path, "a11_bootstrap", "labels", rows)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(k) for j in status.getJobIdsForGroup("draws") for k in status.getJobInfo(j).stageIds]
    assert max(x.numTasks for x in stages if x) >= 100
