"""The log operators as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.rules import RulePack
from corvane.operators.prefs import route


def stream_sessions(events: DataFrame, sender: str, ts: str, gap: int = 3600, late: str = "1 hour") -> DataFrame:
    """Sessions by gap of each sender of an event stream: start, end (of the last event) and n.  Events exactly
    `gap` seconds apart belong together, as in split_sessions; `late` bounds the state kept."""
    s = F.session_window(ts, f"{gap} seconds")
    return events.withWatermark(ts, late).groupBy(s, sender).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")).drop("session_window")


def stream_routed(generated: DataFrame, rules: RulePack, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Generated rows appended as they come to one folder per status.  Rows of a prompt already accepted are
    skipped: the sink's own accepted rows are anti-joined in each batch, so a restart goes on where it was."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = route(batch, rules).withColumn("batch", F.lit(number))
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/status=accepted")
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            done = spark.read.json(f"{path}/status=accepted").where(F.col("batch") < number).select("prompt_id").where("prompt_id IS NOT NULL").distinct()
            rows = rows.join(done, "prompt_id", "left_anti")
        # of one prompt's accepted rows in a batch the first text in order stays; rows without a prompt all do
        w = Window.partitionBy("prompt_id").orderBy(*sorted(c for c, t in batch.dtypes if t in ("string", "bigint", "int")))
        once = F.expr("coalesce(status = 'accepted' AND prompt_id IS NOT NULL, false)")
        rows = rows.where(once).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").union(rows.where(~once))
        # a batch that runs again replaces its own files
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("status", "batch").json(path)

    writer = generated.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_unstable(metrics: DataFrame, most: float = 50.0) -> DataFrame:
    """Log rows of a metric stream (step, name, value) at which training should stop."""
    return metrics.where(F.isnan("value") | (F.abs("value") == float("inf")) | ((F.col("name") == "margin") & (F.abs("value") > most)))
