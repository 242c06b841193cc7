"""Sinks.  Nothing here sends data anywhere but to the given path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import render_chat


def write_jsonl(df: DataFrame, path: str, order: str | None = None, mode: str = "errorifexists") -> None:
    """JSON lines (UTF-8); with `order`, one file in that order."""
    out = df.repartition(1).sortWithinPartitions(order) if order else df
    out.write.mode(mode).json(path, ignoreNullFields=False)


def write_json_array(df: DataFrame, path: str, order: str, mode: str = "errorifexists") -> None:
    """One JSON array, one element a line, written by one task as a stream of lines."""
    body = df.select(F.col(order).alias("__k"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    n = body.count()
    lines = body.repartition(1).sortWithinPartitions("__k").withColumn("__i", F.monotonically_increasing_id())
    lines = lines.select(F.concat(F.when(F.col("__i") == 0, "[\n").otherwise(""), F.lit(" "), "value", F.when(F.col("__i") == n - 1, "\n]").otherwise(",")).alias("value"))
    if n == 0:
        lines = df.sparkSession.createDataFrame([("[]",)], "value string")
    lines.write.mode(mode).text(path)


def write_columns(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path, partitionBy=partition_by)


def write_routed(df: DataFrame, path: str, route: str = "status", mode: str = "append") -> None:
    """Rows appended to one folder per value of `route` (accepted, failures, rejected), in one pass."""
    df.write.mode(mode).partitionBy(route).json(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def replace(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Overwrite what df may have been read from: write beside it, keep the old as <path>.bak, swap."""
    spark = df.sparkSession
    new, old = f"{path}.new", f"{path}.bak"
    df.write.mode("overwrite").format(kind).save(new)
    fs, target = _path(spark, path)
    backup, fresh = _path(spark, old)[1], _path(spark, new)[1]
    if fs.exists(backup):
        fs.delete(backup, True)
    if fs.exists(target) and not fs.rename(target, backup):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(fresh, target):
        raise OSError(f"{new} could not be put in place")


def single_candidate(rows: DataFrame, idx: int = 1) -> DataFrame:
    """Multi-candidate generations as single ones: the candidate of that idx, else the first."""
    one = F.coalesce(F.try_element_at(F.filter("candidates", lambda c: c["idx"] == idx), F.lit(1)), F.try_element_at("candidates", F.lit(1)))
    rest = [c for c in rows.columns if c != "candidates"]
    return rows.select(*rest, one.alias("c")).select(*rest, F.col("c.response").alias("response"), F.col("c.seed").alias("seed"))


def calibration_text(examples: DataFrame, order: str, most: int = 200) -> DataFrame:
    """The first `most` examples with messages, rendered, each followed by a blank line."""
    first = examples.where(F.size("messages") > 0).orderBy(order).limit(most)
    return first.select(F.col(order).alias("pos"), F.concat(render_chat(F.col("messages")), F.lit("\n\n")).alias("value"))


def report(df: DataFrame, most: int = 50) -> str:
    """A Markdown table of the first rows."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
