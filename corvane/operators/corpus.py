"""Building training sets: chunks, near-duplicate runs, deduplication, mixing, sampling, splits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators.ranks import hash_key, hashed_at, number_at


def chunks(df: DataFrame, lines: str, size: int = 5, stride: int = 3, least: int = 4) -> DataFrame:
    """One row per window of `size` lines, every `stride` lines; rows of fewer lines, but `least`, are one."""
    n = F.size(lines)
    starts = F.when(n >= size, F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(stride))).when(n >= least, F.array(F.lit(0)))
    return df.withColumn("start", F.explode(starts)).withColumn("chunk", F.slice(lines, F.col("start") + 1, F.lit(size)))


def chunk_examples(df: DataFrame, key: Column, artist: Column, names: list[str], templates: list[str]) -> DataFrame:
    """Chunks as messages in three forms by hash of the key: 40 % a title and two lines, 50 % a request and two
    lines, 10 % a request alone; the answer is the rest, in line or by lines."""
    form = X.hash_uniform(F.concat(key, F.lit("|form")))
    inline = X.hash_uniform(F.concat(key, F.lit("|join"))) < 0.5
    head, rest = F.slice("chunk", 1, 2), F.slice("chunk", F.lit(3), F.greatest(F.size("chunk") - 2, F.lit(0)))
    ask = X.chat_trigger(names, templates, artist, key)
    user = (
        F.when(form < 0.4, F.concat(F.lit("["), artist, F.lit("]\n"), F.array_join(head, "\n")))
        .when(form < 0.9, F.concat(ask, F.lit("\n"), F.array_join(head, "\n")))
        .otherwise(ask)
    )
    answer = F.when(form < 0.9, X.join_lines(rest, inline)).otherwise(X.join_lines(F.col("chunk"), inline))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.withColumn("messages", F.array(message("user", user), message("assistant", answer)))


def artist_match(songs: DataFrame, artists: list[str], columns: tuple[str, ...], lyric: str | None = None, key: Callable[[Column], Column] = lambda c: F.lower(X.strip(c))) -> DataFrame:
    """Songs whose artist, in any of the columns, is among those wanted (case and ends apart, or by another `key` of
    names); with a column `lyric`, only those that have one."""
    wanted = sorted({a.lower().strip() for a in artists})
    hit = reduce(lambda a, b: a | b, (F.coalesce(key(F.col(c)).isin(wanted), F.lit(False)) for c in columns))
    return songs.where(hit if lyric is None else hit & F.coalesce(X.strip(F.col(lyric)) != "", F.lit(False)))


def missing_artists(songs: DataFrame, artists: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Wanted artists (column `artist`) that no song has."""
    have = reduce(DataFrame.union, (songs.select(F.lower(X.strip(F.col(c))).alias("k")) for c in columns)).distinct()
    return artists.withColumn("k", F.lower(X.strip(F.col("artist")))).join(have, "k", "left_anti").drop("k")


def overlap_runs(prompts: DataFrame, keys: list[str], threshold: float = 0.85) -> DataFrame:
    """prompts (context array, pos) with run (from 1): a run goes on while neighbours share `threshold` of the
    lines of one of them."""
    w = Window.partitionBy(*keys).orderBy("pos")
    near = X.containment(F.lag("context").over(w), F.col("context")) >= threshold
    marked = prompts.withColumn("__new", (~F.coalesce(near, F.lit(False))).cast("int"))
    return marked.withColumn("run", F.sum("__new").over(w)).drop("__new")


def even_spaced(runs: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """Up to `most` rows of each run, evenly spaced with the first and the last, with run_size.  round() is half
    to even, and equal picks are one."""
    w = Window.partitionBy(*keys, "run")
    at = runs.withColumn("__i", F.row_number().over(w.orderBy("pos")) - 1).withColumn("run_size", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("run_size") - 1) / (most - 1)).cast("long"))
    return at.where((F.col("run_size") <= most) | F.array_contains(picks, F.col("__i").cast("long"))).drop("__i")


def first_wins(df: DataFrame, key: Column | str, order: str = "pos") -> DataFrame:
    """The first row of each key, in order.  Only the key decides, so rows with a null key are one group."""
    return _nth(df, key, F.col(order).asc())


def last_wins(df: DataFrame, key: Column | str, order: str = "pos") -> DataFrame:
    return _nth(df, key, F.col(order).desc())


def _nth(df: DataFrame, key: Column | str, order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedup_examples(examples: DataFrame, order: str = "pos") -> DataFrame:
    """The first of examples with equal messages."""
    keyed = examples.withColumn("__key", X.message_key(F.col("messages")))
    return first_wins(keyed, "__key", order).drop("__key")


def hash_rank(df: DataFrame, key: Column, seed: str, by: list[str] | None = None) -> DataFrame:
    """df with hash_rank: the rank (from 1) of md5(seed|key), in each group of `by`.  For samples and splits over
    a whole table use sample_exact and split_exact, which need no single task."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))
    return df.withColumn("hash_rank", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(order, key)))


def sample_exact(df: DataFrame, key: Column, k: int, seed: str) -> DataFrame:
    """k rows without replacement (all, if fewer), those of least md5(seed|key)."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary")), key).limit(k)


def shuffled(df: DataFrame, key: Column, seed: str) -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary")), key)


def ratio_cap(part: DataFrame, n_other: int, ratio: float, key: Column, seed: str) -> DataFrame:
    """Of `part`, as many rows as make up `ratio` of the whole beside n_other others, at most: those whose
    md5(seed|key) is up to one order statistic.  Rows of one key stay or go together."""
    n = int(n_other * ratio / (1 - ratio))
    if n == 0:
        return part.limit(0)
    keyed = part.withColumn("__k", hash_key(key, seed))
    if keyed.where("__k IS NOT NULL").count() > n:
        keyed = keyed.where(F.col("__k") <= hashed_at(keyed.where("__k IS NOT NULL").select(F.col("__k").alias("k")), n))
    return keyed.drop("__k")


def split_exact(df: DataFrame, key: Column, sizes: dict[str, int], rest: str, seed: str) -> DataFrame:
    """df with `split`: the given number of rows for each name, in order of md5(seed|key), then `rest`.  The bounds
    are order statistics, so nothing is sorted or joined.  Rows of one key, or without, are in one part."""
    k = hash_key(key, seed)
    keys = df.select(k.alias("k")).where("k IS NOT NULL")
    n, done, label = keys.count(), 0, F.lit(None).cast("string")
    for name, size in sizes.items():
        done = min(done + size, n)
        if done:
            label = F.when(label.isNull() & (k <= hashed_at(keys, done)), F.lit(name)).otherwise(label)
    return df.withColumn("split", F.coalesce(label, F.lit(rest)))


def val_size(n: int, least: int = 50, share: float = 0.05) -> int:
    return max(least, int(share * n))


def temporal_split(df: DataFrame, order: str = "pos", share: float = 0.9) -> DataFrame:
    """df with `split`: the first int(share n) rows in order (a whole number) are 'train', the others 'val'.  The cut is
    one order statistic, found by counts of buckets; rows of one place, or without, are in one part."""
    values = df.select(F.col(order).alias("v")).where("v IS NOT NULL")
    k = int(share * values.count())
    if k == 0:
        return df.withColumn("split", F.lit("val"))
    return df.withColumn("split", F.when(F.col(order) <= number_at(values, k), "train").otherwise("val"))


def blind_order(df: DataFrame, array: str, key: Column, seed: str) -> DataFrame:
    """df with the elements of an array of structs (with idx) in an order by hash, and a fair coin `flip`."""
    tag = lambda x: F.struct(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"), F.lit("|"), x["idx"].cast("string")).cast("binary")).alias("h"), x.alias("x"))
    mixed = F.transform(F.array_sort(F.transform(array, tag)), lambda t: t["x"])
    return df.withColumn(array, mixed).withColumn("flip", X.hash_uniform(F.concat(F.lit(f"{seed}|flip|"), key.cast("string"))) < 0.5)


def longest(df: DataFrame, c: str, order: str = "pos") -> DataFrame:
    """The row with the longest text, the first of several."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.length(c), -F.col(order)))
    return df.agg(best.alias("r")).where("r IS NOT NULL").select("r.*")


def replicate(df: DataFrame, times: Column) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).where(times > 0)


def within_cap(df: DataFrame, tokens: Column, most: int) -> DataFrame:
    """Rows of at most `most` tokens; what cannot be counted goes."""
    return df.where(tokens <= most)


def all_senders(*parts: DataFrame, column: str = "sender") -> DataFrame:
    """Every sender of any part, once; null is one of them."""
    return reduce(DataFrame.union, (p.select(column) for p in parts)).distinct()


def missing_files(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Rows of `local` whose `name` the other listing lacks; a null name is never there."""
    return local.join(remote.select("name").distinct(), "name", "left_anti")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def position_ids(df: DataFrame, prefix: str, order: str = "pos") -> DataFrame:
    """df with id prefix_0001 from the line number `pos`, gaps allowed."""
    return df.withColumn("id", F.format_string(f"{prefix}_%04d", F.col(order) + 1))


def hold_out(prompts: DataFrame, key: Column, n: int, seed: str, where: Column) -> DataFrame:
    """prompts with held_out: true for n of those that `where` selects, by hash."""
    chosen = sample_exact(prompts.where(where), key, n, seed).select(key.alias("__held"))
    return prompts.join(chosen, key == F.col("__held"), "left").withColumn("held_out", F.col("__held").isNotNull()).drop("__held")


def subset_mix(base: DataFrame, other: DataFrame, share: float, key: Column, seed: str) -> DataFrame:
    """base and a share of other's rows, by hash."""
    return base.unionByName(other.where(X.hash_uniform(F.concat(F.lit(f"{seed}|"), key.cast("string"))) < share))
