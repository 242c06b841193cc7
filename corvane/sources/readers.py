"""Scans: chat exports, JSON lines and arrays, CSV folders, rating files, prompts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import flatten_variant, strip


def _documents(raw: DataFrame) -> DataFrame:
    """(file, pos, message) of whole JSON documents: `messages` of an object, or the elements of an array."""
    v = F.parse_json("value")
    raw = raw.select("file", v.alias("v"))
    inner = F.coalesce(F.when(F.schema_of_variant("v").startswith("OBJECT"), F.try_variant_get("v", "$.messages", "variant")), F.col("v"))
    raw = raw.select("file", inner.alias("m"))
    raw.createOrReplaceTempView("__corvane_exports")
    return raw.sparkSession.sql("SELECT file, pos, value AS message FROM __corvane_exports, LATERAL variant_explode(m)")


def chat_export(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, message VARIANT) of JSON chat exports, wrapped in an object or bare arrays."""
    return _documents(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value"))


def _first_json(content: pd.Series) -> pd.Series:
    def one(data: bytes) -> str | None:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            name = next((n for n in z.namelist() if n.endswith(".json")), None)
            return z.read(name).decode("utf-8") if name else None

    return content.map(one)


def zipped_export(spark: SparkSession, path: str) -> DataFrame:
    """As chat_export, of the first .json member of each zip archive."""
    raw = spark.read.format("binaryFile").load(path)
    return _documents(raw.select(F.col("path").alias("file"), F.pandas_udf(_first_json, "string")("content").alias("value")).where("value IS NOT NULL"))


def records(messages: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Typed records of messages of type 'message', in order of (file, pos).  A sender that is absent is
    `unknown`; one that is null stays null."""

    def get(name: str, kind: str = "string") -> Column:
        return F.try_variant_get("message", f"$.{name}", kind)

    sender = F.when(F.try_variant_get("message", "$.from", "variant").isNull(), F.lit(unknown)).otherwise(get("from"))
    said = get("text", "variant")
    filled = lambda name: F.coalesce(get(name) != "", F.lit(False))
    return messages.where(get("type") == "message").select(
        "file", "pos", get("id", "bigint").alias("id"), sender.alias("from"), get("from_id").alias("from_id"),
        F.when(said.isNull(), F.lit("")).otherwise(flatten_variant(said)).alias("text"),
        F.coalesce(F.expr("try_cast(try_variant_get(message, '$.date_unixtime', 'string') AS BIGINT)"), F.lit(0)).alias("ts"),
        get("date").alias("date"), get("reply_to_message_id", "bigint").alias("reply_to"),
        (filled("file") | filled("photo")).alias("has_media"), get("media_type").alias("media_type"),
        get("sticker_emoji").alias("sticker_emoji"), filled("forwarded_from").alias("forwarded"),
    )


def media_only(recs: DataFrame) -> DataFrame:
    """Records with media and no text."""
    return recs.where(F.col("has_media") & (strip(F.col("text")) == ""))


def jsonl(spark: SparkSession, path: str, schema: str | None = None, tolerant: bool = False, drop: Iterable[str] = ()) -> DataFrame:
    """JSON lines; blank lines are skipped; `tolerant` also skips malformed ones (which needs a schema);
    `drop`: columns to leave out."""
    reader = spark.read.schema(schema) if schema else spark.read
    if tolerant:
        if not schema:
            raise ValueError("a tolerant scan needs a schema")
        reader = reader.option("mode", "DROPMALFORMED")
    return reader.json(path).drop(*drop)


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def csv_folder(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """All CSV files of a pattern, with headers and quoted line breaks."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.csv(pattern, header=True, multiLine=True, quote='"', escape='"')


RATING_FILE = r"^ratings_(.+)_vs_(.+)\.json$"


def rating_versions(name: Column) -> tuple[Column, Column]:
    """(A, B) of ratings_<A>_vs_<B>.json; A takes the longest prefix."""
    return F.regexp_extract(name, RATING_FILE, 1), F.regexp_extract(name, RATING_FILE, 2)


def pairwise_ratings(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, version_a, version_b, pos, prompt_id, winner, category, tier) of pairwise rating files.  Files
    whose rows are of another kind of rating (without A, B or tie) give none."""
    schema = "array<struct<prompt_id:string,winner:string,category:string,tier:string>>"
    raw = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", schema).alias("r"))
    a, b = rating_versions(F.col("file"))
    rows = raw.select("file", a.alias("version_a"), b.alias("version_b"), F.posexplode("r").alias("pos", "r")).where("version_a <> ''")
    return rows.select("file", "version_a", "version_b", "pos", "r.*").where("winner IN ('A', 'B', 'tie')")


def prompt_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(strip(F.col("value")).alias("prompt"))


def literals(spark: SparkSession, category: str, items: list[str], templates: list[str] | None = None) -> DataFrame:
    """(id, category, context) prompts from configuration: each item, in each template's {slot} if given."""
    texts = [t.replace("{slot}", i) for i in items for t in templates] if templates else list(items)
    rows = [(f"{category}_{k:04d}", category, [t]) for k, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "id string, category string, context array<string>")


#: Name, temperature, top_p, top_k and repetition penalty of the default four candidates.
SAMPLING = (("plain", 0.7, 0.9, 40, 1.1), ("loose", 0.9, 0.95, 50, 1.1), ("tight", 0.5, 0.85, 30, 1.15), ("wild", 1.1, 0.98, 80, 1.05))


def parameter_grid(spark: SparkSession, temperatures: list[float] | None = None, penalties: list[float] | None = None) -> DataFrame:
    """(idx, name, temperature, top_p, top_k, repetition_penalty): the default candidates, or every pair of the given
    temperatures and penalties."""
    rows = SAMPLING
    if temperatures is not None:
        rows = [(f"t{t}_p{p}", t, 0.9, 40, p) for t in temperatures for p in penalties or [1.1]]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], "idx int, name string, temperature double, top_p double, top_k int, repetition_penalty double")


def grouped(rows: DataFrame, key: str = "prompt_id") -> DataFrame:
    """One row per key with all its rows as an array in a fixed order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows"))


def find_path(spark: SparkSession, candidates: Iterable[str], name: str | None = None, root: str | None = None) -> str | None:
    """The first candidate that exists, in any store that Spark reads, else the first file called `name` under
    `root`, by path."""
    conf, make = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for c in candidates:
        if make(c).getFileSystem(conf).exists(make(c)):
            return str(c)
    if not (name and root):
        return None
    files, found = make(root).getFileSystem(conf).listFiles(make(root), True), []
    while files.hasNext():
        at = files.next().getPath()
        if at.getName() == name:
            found.append(at.toString())
    return min(found, default=None)
