"""Evaluation statistics.  Percentiles are of the rank that the names say: upper_median is the element of
0-based rank n div 2 in rising order, rank_pick the one of int(share n).  They are exact aggregates, so no
window sees a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions.rules import artifact_flags
from corvane.operators.ranks import narrowed


def _picked(counts: DataFrame, by: list[str], value: str, ranks: dict[str, str]) -> DataFrame:
    """For each group the values at 0-based ranks (SQL expressions of __n) of a table of distinct values with
    counts (c).  Runs of equal values are summed by value range, so a group of any size is a sum over its
    distinct values."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(value)
    at = counts.withColumn("__hi", F.sum("c").over(w)).withColumn("__n", F.sum("c").over(Window.partitionBy(*by)))
    inside = lambda r: F.expr(f"__hi > {r} AND __hi - c <= {r}")
    return at.groupBy(*by).agg(*(F.max(F.when(inside(r), F.col(value))).alias(name) for name, r in ranks.items()))


def _at_rank(rows: DataFrame, by: list[str]) -> DataFrame:
    """The v of rank r of each group, of the few rows (v, c, r) that are left of it."""
    from pyspark.sql import Window

    upto = rows.withColumn("__hi", F.sum("c").over(Window.partitionBy(*by).orderBy("v")))
    return upto.where("__hi > r AND __hi - c <= r").select(*by, "v")


def date_range(df: DataFrame, c: Column) -> DataFrame:
    """The first and the last date of a table; null with none."""
    return df.agg(F.min(c).alias("first"), F.max(c).alias("last"))


def top_clusters(found: DataFrame, least: int, most: int) -> DataFrame:
    """The `most` largest groups of clusters() of at least that many texts, by falling size; of equal sizes the one seen
    first comes first."""
    return found.where(F.col("n") >= least).orderBy(F.desc("n"), "first_pos").limit(most)


def list_stats(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """n, min, upper median, max, mean by group; by counts of distinct values."""
    counts = df.select(*by, value.alias("v")).where("v IS NOT NULL").groupBy(*by, "v").agg(F.count("*").alias("c"))
    picks = _picked(counts, by, "v", {"upper_median": "int(__n div 2)"})
    basic = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    return basic.join(picks, by) if by else basic.crossJoin(F.broadcast(picks))


def series_stats(df: DataFrame, by: list[str], value: Column, least: float) -> DataFrame:
    """n, mean, interpolated median, sample standard deviation, and how many are `least` or more."""
    return df.select(*by, value.alias("v")).groupBy(*by).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_samp("v").alias("stdev"), F.count_if(F.col("v") >= least).alias("n_at_least"),
    )


def type_counts(df: DataFrame, column: str, order: str) -> DataFrame:
    """Values by falling count; of equal counts the one seen first comes first."""
    return df.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def histogram(df: DataFrame, by: list[str], value: Column, edges: list[float]) -> DataFrame:
    """Counts in the buckets [edge, next edge); what lies outside, the last edge included, is in none."""
    bucket = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        bucket = F.when((value >= edges[i]) & (value < edges[i + 1]), F.lit(i)).otherwise(bucket)
    return df.withColumn("bucket", bucket).where("bucket IS NOT NULL").groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def entropy(df: DataFrame, by: list[str], c: Column) -> DataFrame:
    """Shannon entropy in bits of the words of a text column: counts first, so the sum is over distinct words."""
    counts = df.select(*by, F.explode(X.words(c)).alias("w")).groupBy(*by, "w").agg(F.count("*").alias("c"))
    # -sum(p log p) = log n - sum(c log c) / n, one pass over the counts
    return counts.groupBy(*by).agg((F.log2(F.sum("c").cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / F.sum("c")).alias("vocab_entropy"))


def guardrails(df: DataFrame, by: list[str], text: str, patterns: dict[str, str]) -> DataFrame:
    """n, the percentage of texts that each pattern finds, mean, upper median and p95 of lengths, and entropy."""
    c = F.col(text)
    rates = df.groupBy(*by).agg(F.count("*").alias("n"), *((F.count_if(c.rlike(p)) * 100 / F.count("*")).alias(name) for name, p in patterns.items()), F.avg(F.length(c)).alias("mean_length"))
    counts = df.select(*by, F.length(c).alias("v")).groupBy(*by, "v").agg(F.count("*").alias("c"))
    picks = _picked(counts, by, "v", {"median_length": "int(__n div 2)", "length_p95": "least(int(floor(__n * 0.95D)), int(__n - 1))"})
    return rates.join(picks, by).join(entropy(df, by, c), by, "left").fillna({"vocab_entropy": 0.0})


def side_by_side(stats: DataFrame, version: str, metrics: list[str], versions: list[str]) -> DataFrame:
    """One row per metric with one column per version."""
    long = stats.select(version, F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))))).alias("metric", "value"))
    return long.groupBy("metric").pivot(version, versions).agg(F.max("value"))


def win_rates(ratings: DataFrame, by: list[str]) -> DataFrame:
    """Wins of A and B, ties, and A's rate among decided rows (null with none), super-tier wins too."""
    a, b = F.col("winner") == "A", F.col("winner") == "B"
    extra = []
    if "tier" in ratings.columns:
        extra = [F.count_if(a & (F.col("tier") == "super")).alias("super_a"), F.count_if(b & (F.col("tier") == "super")).alias("super_b")]
    return ratings.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(a).alias("wins_a"), F.count_if(b).alias("wins_b"), F.count_if(F.col("winner") == "tie").alias("ties"),
        (F.count_if(a) / F.nullif(F.count_if(F.col("winner") != "tie"), F.lit(0))).alias("win_rate"), *extra,
    )


#: Draws that one row stands for at most.
DRAWS = 10_000
#: Tasks that share the draws.  Their rows are few and short, so a number left open would be merged to one task.
TASKS = 240


def bootstrap(ratings: DataFrame, by: list[str], resamples: int = 1000, seed: str = "42", confidence: float = 0.95) -> DataFrame:
    """n, lo and hi of A's win rate by percentile bootstrap: `resamples` draws of n rows with replacement, ties
    among them.  A rate needs the counts of a resample only, so a draw md5(seed|resample|i) mod n is A below the
    number of A's, not a tie below that of both, and no row is numbered or met.  Rates are told by rank."""
    won = lambda x: F.count_if(F.col("winner") == x)
    sizes = ratings.groupBy(*by).agg(F.count("*").alias("__n"), won("A").alias("__a"), F.count_if(F.col("winner") != "tie").alias("__ab"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("__n") - 1, F.lit(0)), F.lit(DRAWS).cast("long")))
    drawn = sizes.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("__from", block).repartition(TASKS, "__b", "__from")
    drawn = drawn.withColumn("__k", F.explode(F.sequence("__from", F.least(F.col("__from") + DRAWS, "__n") - 1)))
    drawn = drawn.withColumn("__i", F.pmod(X.hash_number(F.concat_ws("|", F.lit(seed), "__b", "__k")), F.col("__n")))
    rates = drawn.groupBy(*by, "__b").agg((F.count_if(F.expr("__i < __a")) / F.nullif(F.count_if(F.expr("__i < __ab")), F.lit(0))).alias("rate"))
    counts = rates.where("rate IS NOT NULL").groupBy(*by, "rate").agg(F.count("*").alias("c"))
    tail = (1 - confidence) / 2
    picks = _picked(counts, by, "rate", {"lo": f"int(floor({tail:.6f}D * __n + 1e-9D))", "hi": f"int(floor({1 - tail:.6f}D * __n + 1e-9D))"})
    sized = sizes.select(*by, F.col("__n").alias("n"))
    return sized.join(picks, by) if by else sized.crossJoin(F.broadcast(picks))


def bestof_summary(ratings: DataFrame, gate: float = 0.60) -> DataFrame:
    """Wins of bestof and default, ties, skips, the rate, and whether it passes the gate."""
    best, plain = F.count_if(F.col("winner") == "bestof"), F.count_if(F.col("winner") == "default")
    rate = best / F.nullif(best + plain, F.lit(0))
    return ratings.agg(
        best.alias("wins_bestof"), plain.alias("wins_default"), F.count_if(F.col("winner") == "tie").alias("ties"), F.count_if(F.col("winner") == "skip").alias("skips"),
        rate.alias("win_rate"), F.coalesce(rate >= gate, F.lit(False)).alias("passes"),
    )


def wins_by_model(ratings: DataFrame) -> DataFrame:
    return ratings.where("decision = 'best'").groupBy(F.col("best_model").alias("model")).agg(F.count("*").alias("wins"))


def win_table(ratings: DataFrame) -> DataFrame:
    """wins, present (candidate rows of the rated prompts) and their share, by model."""
    present = ratings.select(F.explode("all_candidates").alias("c")).groupBy(F.col("c.model").alias("model")).agg(F.count("*").alias("present"))
    out = present.join(wins_by_model(ratings), "model", "full_outer").fillna(0, ["wins", "present"])
    return out.withColumn("win_share", F.col("wins") / F.nullif(F.col("present"), F.lit(0)))


def losses_of(ratings: DataFrame, model: str) -> DataFrame:
    """Rated prompts where another model won, with the model's own candidate and the winner."""
    own = F.try_element_at(F.filter("all_candidates", lambda c: c["model"] == model), F.lit(1))
    won = F.try_element_at(F.filter("all_candidates", lambda c: (c["model"] == F.col("best_model")) & (c["candidate_idx"] == F.col("best_candidate_idx"))), F.lit(1))
    return ratings.where((F.col("decision") == "best") & (F.col("best_model") != model)).select("prompt_id", own.alias("own"), won.alias("winner")).where("own IS NOT NULL")


def artifacts(df: DataFrame, text: str, order: str, identity: str, examples: int = 3) -> DataFrame:
    """For each kind of artifact its count and its first few texts."""
    flags = artifact_flags(F.col(text), identity)
    kinds = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in flags.items())), lambda x: x.isNotNull())
    hit = df.select(F.col(order).alias("o"), F.col(text).alias("t"), F.explode(kinds).alias("artifact"))
    from pyspark.sql import Window

    # each task keeps its own first few of a kind before they meet
    few = hit.withColumn("n", F.row_number().over(Window.partitionBy("artifact").orderBy("o"))).where(F.col("n") <= examples)
    few = few.groupBy("artifact").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("examples"))
    return hit.groupBy("artifact").agg(F.count("*").alias("n")).join(few, "artifact")


def experiment_summary(rows: DataFrame) -> DataFrame:
    """By model: rows, counters of status, reject reason and finish reason, empty answers, mean cost, cost of a
    thousand, mean tokens; means ignore what is missing and are 0 with nothing."""

    def counter(c: str) -> DataFrame:
        n = rows.where(F.col(c).isNotNull()).groupBy("model", c).agg(F.count("*").alias("n"))
        return n.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"{c}_counts"))

    mean = lambda c: F.coalesce(F.avg(F.col(f"usage.{c}")), F.lit(0.0))
    out = rows.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("response", F.lit("")) == "").alias("empty"), mean("cost").alias("avg_cost"),
        (mean("cost") * 1000).alias("cost_per_1000"), mean("prompt_tokens").alias("avg_prompt_tokens"), mean("completion_tokens").alias("avg_completion_tokens"),
    )
    for c in ("status", "reject_reason", "finish_reason"):
        out = out.join(counter(c), "model", "left")
    return out


def status_counts(rows: DataFrame) -> DataFrame:
    """Rows by status, and rejected ones by reason as reject:<reason>."""
    a = rows.groupBy(F.col("status").alias("key")).agg(F.count("*").alias("n"))
    return a.union(rows.where("reject_reason IS NOT NULL").groupBy(F.concat(F.lit("reject:"), "reject_reason").alias("key")).agg(F.count("*").alias("n")))


def clusters(df: DataFrame, text: str, sender: str, order: str, least_len: int = 8, most_len: int = 200, least: int = 3, senders: int = 3) -> DataFrame:
    """Groups of texts with one template: n, distinct senders, the three most frequent (ties by first seen), a
    text of middle length, and whether `senders` or more sent it, which tells a bot.

    The middle text is the one of rank n div 2 by length, ties in order; ranks come from counts by (template,
    length), so a template that a third of all rows share is still summed in parts."""
    c = F.col(text)
    rows = df.where(F.length(X.strip(c)).between(least_len, most_len)).select(X.normalize(c).alias("template"), F.col(sender).alias("sender"), F.col(order).alias("pos"), c.alias("text"), F.length(c).alias("len"))
    by_sender = rows.groupBy("template", "sender").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    from pyspark.sql import Window

    ranked = by_sender.withColumn("__n", F.row_number().over(Window.partitionBy("template").orderBy(F.desc("n"), "first")))
    top = F.array_sort(F.collect_list(F.when(F.col("__n") <= 3, F.struct("__n", F.col("sender").cast("string").alias("sender"), "n"))))
    sized = ranked.groupBy("template").agg(F.sum("n").alias("n"), F.count("sender").alias("n_senders"), F.min("first").alias("first_pos"), F.transform(top, lambda x: F.concat(x["sender"], F.lit(":"), x["n"])).alias("top_senders"))
    sized = sized.where(F.col("n") >= least)
    w = Window.partitionBy("template").orderBy("len")
    at = rows.join(sized.select("template", F.col("n").alias("size")), "template").groupBy("template", "len", "size").agg(F.count("*").alias("c"))
    at = at.withColumn("hi", F.sum("c").over(w)).where("hi > size div 2 AND hi - c <= size div 2").select("template", "len", (F.expr("size div 2") - (F.col("hi") - F.col("c")) + 1).alias("nth"))
    nth = rows.join(at, ["template", "len"]).withColumn("__n", F.row_number().over(Window.partitionBy("template", "len").orderBy("pos"))).where("__n = nth").select("template", F.col("text").alias("sample"))
    return sized.join(nth, "template").withColumn("suspect", F.col("n_senders") >= senders)


def pair_diagnostics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Of pairs (chosen, rejected as texts): lengths, their ratio, which is longer, distinct shares, very short
    and very long ones, identical ones."""
    a, b = F.length("chosen"), F.length("rejected")
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(a).alias("mean_chosen"), F.avg(b).alias("mean_rejected"), F.median(a).alias("median_chosen"), F.median(b).alias("median_rejected"),
        F.stddev_samp(a).alias("stdev_chosen"), F.stddev_samp(b).alias("stdev_rejected"), (F.avg(a) / F.nullif(F.avg(b), F.lit(0.0))).alias("length_ratio"),
        F.count_if(a > b).alias("chosen_longer"), F.count_if(a < b).alias("rejected_longer"), F.count_if(a == b).alias("equal_length"),
        (F.countDistinct("chosen") / F.count("*")).alias("distinct_chosen"), F.count_if(a < 5).alias("very_short"), F.count_if(a > 500).alias("very_long"),
        (F.count_if(F.col("chosen") == F.col("rejected")) / F.count("*")).alias("identical_share"),
    )


def check_pairs(pairs: DataFrame, most_identical: float = 0.05) -> None:
    """Raise unless less than that share of pairs is identical."""
    r = pair_diagnostics(pairs, []).first()
    if r["n"] and r["identical_share"] >= most_identical:
        raise ValueError(f"{r['identical_share']:.1%} of pairs are identical")


def pairwise_accuracy(scored: DataFrame, by: list[str]) -> DataFrame:
    """Of pairs scored (score_chosen, score_rejected): accuracy, mean and upper median of the margin."""
    rows = scored.withColumn("margin", F.col("score_chosen") - F.col("score_rejected"))
    keys = by or ["__all"]
    counts = rows.withColumn("__all", F.lit(0)).where("margin IS NOT NULL").groupBy(*keys, F.col("margin").cast("double").alias("v")).agg(F.count("*").alias("c"))
    counts = counts.join(counts.groupBy(*keys).agg(F.expr("sum(c) div 2").alias("r")), keys)
    picks = _at_rank(narrowed(narrowed(counts, keys), keys), keys).withColumnRenamed("v", "median_margin")
    basic = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("margin") > 0).cast("int")).alias("accuracy"), F.avg("margin").alias("mean_margin"))
    return basic.join(picks, by, "left") if by else basic.crossJoin(F.broadcast(picks.drop("__all")))


def grid_summary(rows: DataFrame, label: str, text: str, patterns: dict[str, str]) -> DataFrame:
    c = F.col(text)
    return rows.groupBy(label).agg(F.count("*").alias("n"), F.avg(F.length(c)).alias("avg_length"), (100 * F.countDistinct(c) / F.count("*")).alias("distinct_pct"), *(F.count_if(c.rlike(p)).alias(k) for k, p in patterns.items()))


def pattern_rates(pairs: DataFrame, pattern: str) -> DataFrame:
    """Share of contexts, chosen and rejected texts that a pattern finds."""
    hit = lambda c: (F.count_if(c) / F.count("*"))
    return pairs.agg(hit(F.exists("context", lambda x: x.rlike(pattern))).alias("context"), hit(F.col("chosen").rlike(pattern)).alias("chosen"), hit(F.col("rejected").rlike(pattern)).alias("rejected"))
