"""Queries of the sources and sinks: tables are written as the sources' files and read back."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corvane.plans.registry import query, table
from corvane.plans.texts import conversation_messages
from corvane.sources import readers as R
from corvane.sources import writers as W


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one; on a single machine without one, a temporary folder."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corvane-")
    return f"{base}/files-{uuid.uuid4()}"


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file of its own name, in whatever store the path is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()


_TURNS = "conv_id bigint, turn bigint, role string, text string"
_ALL = "SELECT conv_id, turn, role, text FROM conversations"


@query('SELECT conv_id * 1000 + turn AS id, role AS sender, text, conv_id AS ts FROM conversations')
def s1_chat_export(spark, sf_dir):
    """Exports of about 10,000 messages each, wrapped in an object or (every other one) bare arrays."""
    rows, path = table(spark, sf_dir, "conversations"), scratch(spark)
    message = F.struct(F.lit("message").alias("type"), F.expr("conv_id * 1000 + turn").alias("id"), F.col("role").alias("from"), "text", F.col("conv_id").cast("string").alias("date_unixtime"))
    packed = rows.groupBy(F.expr(f"conv_id % {max(8, rows.count() // 10_000)}").alias("part")).agg(F.collect_list(message).alias("messages"))
    packed.select("part", F.when(F.col("part") % 2 == 0, F.to_json(F.struct("messages"))).otherwise(F.to_json("messages")).alias("value")).write.partitionBy("part").text(path)
    return R.records(R.chat_export(spark, path)).select("id", F.col("from").alias("sender"), "text", "ts")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS text FROM nation")
def s3_zipped_export(spark, sf_dir):
    """The first .json member of an archive."""
    path, packed = scratch(spark), io.BytesIO()
    rows = [{"type": "message", "id": r.n_nationkey, "text": r.n_name} for r in table(spark, sf_dir, "nation").collect()]  # a table of 25 rows
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("export/result.json", json.dumps({"messages": rows}))
        z.writestr("export/other.json", "[]")
    put(spark, f"{path}/export.zip", packed.getvalue())
    return R.records(R.zipped_export(spark, path)).select("id", "text")


@query("SELECT conv_id, turn, text FROM conversations")
def s4_jsonl_round_trip(spark, sf_dir):
    path = scratch(spark)
    W.write_jsonl(table(spark, sf_dir, "conversations"), path)
    return R.jsonl(spark, path, _TURNS, drop=["role"])


@query(_ALL)
def s5_tolerant_jsonl(spark, sf_dir):
    """Lines among blank and malformed ones."""
    rows, path = table(spark, sf_dir, "conversations"), scratch(spark)
    good = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    bad = rows.select(F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"conv_id": '), "conv_id", F.lit(', "text": "cut'))).otherwise("").alias("value"))
    good.union(bad).write.text(path)
    return R.jsonl(spark, path, _TURNS, tolerant=True).where("conv_id IS NOT NULL")


@query(_ALL)
def s6_json_array_round_trip(spark, sf_dir):
    path = scratch(spark)
    W.write_json_array(table(spark, sf_dir, "conversations").withColumn("pos", F.expr("conv_id * 1000 + turn")), path, "pos")
    return R.json_array(spark, path, _TURNS)


@query(_ALL)
def s7_csv_folder(spark, sf_dir):
    """Quotes, commas and line breaks within fields."""
    path = scratch(spark)
    table(spark, sf_dir, "conversations").write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return R.csv_folder(spark, f"{path}/*.csv", _TURNS)


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'v1_vs_v2' ELSE 'v1' END AS version_a, 'v3' AS version_b, n_name AS prompt_id, CASE n_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS winner FROM nation")
def s8_rating_files(spark, sf_dir):
    """Versions from file names, the first one the longest; ratings of another kind give no rows."""
    path, rows = scratch(spark), table(spark, sf_dir, "nation").collect()  # a table of 25 rows
    for k, name in enumerate(("v1_vs_v2_vs_v3", "v1_vs_v3")):
        put(spark, f"{path}/ratings_{name}.json", json.dumps([{"prompt_id": r.n_name, "winner": ("A", "B", "tie")[r.n_nationkey % 3]} for r in rows if r.n_nationkey % 2 == k]).encode())
    put(spark, f"{path}/ratings_v9_vs_default.json", json.dumps([{"prompt_id": "x", "winner": "bestof"}]).encode())
    return R.pairwise_ratings(spark, f"{path}/ratings_*.json").select("version_a", "version_b", "prompt_id", "winner")


@query("SELECT 'b.json' AS first, 'deep/c.json' AS found, true AS missing")
def s9_find_path(spark, sf_dir):
    path = scratch(spark)
    for name in ("b.json", "deep/c.json", "other/c.json"):
        put(spark, f"{path}/{name}", b"[]")
    first = R.find_path(spark, [f"{path}/a.json", f"{path}/b.json", f"{path}/deep/c.json"])
    found = R.find_path(spark, [f"{path}/a.json"], "c.json", path)
    none = R.find_path(spark, [], "d.json", path)
    return spark.createDataFrame([(first.removeprefix(f"{path}/"), found[found.index("deep") :], none is None)], "first string, found string, missing boolean")


@query("SELECT 'You are Ann.' || chr(10) || 'Be short.' AS prompt")
def s12_prompt_file(spark, sf_dir):
    path = scratch(spark)
    put(spark, f"{path}/prompt.txt", "\n  You are Ann.\nBe short.  \n".encode())
    return R.prompt_file(spark, path)


@query("SELECT * FROM (VALUES ('rap_0001', 'rap', 'sing A'), ('rap_0002', 'rap', 'play A'), ('rap_0003', 'rap', 'sing B'), ('rap_0004', 'rap', 'play B'), ('fact_0001', 'fact', 'Who?')) v(id, category, said)")
def s13_literals(spark, sf_dir):
    both = R.literals(spark, "rap", ["A", "B"], ["sing {slot}", "play {slot}"]).union(R.literals(spark, "fact", ["Who?"]))
    return both.select("id", "category", F.col("context")[0].alias("said"))


@query("SELECT conv_id, CAST(count(*) AS INTEGER) AS n, string_agg(turn || role, ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def s14_grouped(spark, sf_dir):
    path = scratch(spark)
    W.write_jsonl(table(spark, sf_dir, "conversations"), path)
    out = R.grouped(R.jsonl(spark, path, _TURNS), "conv_id")
    return out.select("conv_id", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda r: F.concat(r["turn"], r["role"])), ",").alias("turns"))


@query("SELECT 'now' AS kept, doc_id FROM labels WHERE toxic = 0 UNION ALL SELECT 'bak', doc_id FROM labels")
def k4_replace_in_place(spark, sf_dir):
    """A table written as Parquet, then overwritten by a part of itself; the old one stays beside it."""
    path = scratch(spark)
    W.write_columns(table(spark, sf_dir, "labels"), path)
    W.replace(spark.read.parquet(path).where("toxic = 0"), path)
    kept = lambda name, at: spark.read.parquet(at).select(F.lit(name).alias("kept"), "doc_id")
    return kept("now", path).union(kept("bak", f"{path}.bak"))


@query("SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'accepted' WHEN 'user' THEN 'rejected' ELSE 'failures' END AS status FROM conversations")
def k6_routed_append(spark, sf_dir):
    """Two appends to one folder for each status."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "conversations").withColumn("status", F.expr("CASE role WHEN 'assistant' THEN 'accepted' WHEN 'user' THEN 'rejected' ELSE 'failures' END"))
    for half in (0, 1):
        W.write_routed(rows.where(F.col("turn") % 2 == half), path)
    return spark.read.schema("conv_id bigint, turn bigint, status string").json(path)


@query("SELECT conv_id AS pos, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) || chr(10) || chr(10) AS value FROM conversations GROUP BY conv_id ORDER BY conv_id LIMIT 200")
def k8_calibration_text(spark, sf_dir):
    return W.calibration_text(conversation_messages(spark, sf_dir), "conv_id")


@query("SELECT '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS report FROM region")
def k9_report(spark, sf_dir):
    return spark.createDataFrame([(W.report(table(spark, sf_dir, "region").orderBy("r_regionkey")),)], "report string")
