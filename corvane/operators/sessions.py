"""Turns, sessions and windows over ordered message logs.

Order is the column `pos`, never the timestamp: times may tie or run backwards.  Windows are partitioned by
`keys` (a chat, a user); one huge log without a key is cut into ranges of pos, and what crosses their ends is
carried on (split_log), so that no task sees all rows, with or without gaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.rules import is_quality_response
from corvane.functions.text import strip


def _island(df: DataFrame, keys: list[str], new: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("pos")
    return df.withColumn("__new", new.cast("int")).withColumn(name, F.sum("__new").over(w)).drop("__new")


def merge_consecutive(records: DataFrame, keys: list[str], gap: int = 60, sender: str = "from") -> DataFrame:
    """One row per turn: records of one sender, each less than `gap` seconds after the one before it.  text is
    joined by line breaks, ts the last, end_pos too; all other columns are the first record's."""
    w = Window.partitionBy(*keys).orderBy("pos")
    same = F.lag(F.col(sender)).over(w).eqNullSafe(F.col(sender)) & (F.col("ts") - F.lag("ts").over(w) < gap)
    marked = _island(records.withColumn("__first", F.row_number().over(w) == 1), keys, F.col("__first") | ~F.coalesce(same, F.lit(False)), "turn_no").drop("__first")
    return _joined(_as_turns(marked), [*keys, "turn_no"])


def merge_consecutive_of_log(log: DataFrame, gap: int = 60, sender: str = "from") -> DataFrame:
    """merge_consecutive of one log without keys.  A turn is put together in each range before its parts meet."""
    same = lambda a, b: a[sender].eqNullSafe(b[sender]) & F.coalesce(b["ts"] - a["ts"] < gap, F.lit(False))
    marked = split_log(log, lambda a, b: ~same(a, b), "ts", sender).withColumnRenamed("__island", "turn_no").drop("__before", "__size", "__start")
    parts = _joined(_as_turns(marked), ["__range", "turn_no"]).drop("__range")
    return _joined(parts.repartition(max(8, log.count() // RANGE + 1), "turn_no"), ["turn_no"])


def _as_turns(records: DataFrame) -> DataFrame:
    return records.withColumns({"end_pos": F.col("pos"), "n_merged": F.lit(1).cast("long"), "text": F.coalesce("text", F.lit(""))})


def _joined(turns: DataFrame, keys: list[str]) -> DataFrame:
    """The turns of each key as one: texts in order, the last ts, the first of all other columns."""
    rest = [c for c in turns.columns if c not in (*keys, "pos", "end_pos", "ts", "n_merged", "text")]
    said = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return turns.groupBy(*keys).agg(
        F.min("pos").alias("pos"),
        F.max("end_pos").alias("end_pos"),
        F.max_by("ts", "pos").alias("ts"),
        F.sum("n_merged").alias("n_merged"),
        F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("text"),
        *(F.min_by(c, "pos").alias(c) for c in rest),
    )


def split_sessions(turns: DataFrame, keys: list[str], gap: int = 3600, least: int = 5) -> DataFrame:
    """turns with session_id (from 1, in order) and seq (from 0): a session ends where the next turn comes more
    than `gap` seconds later; sessions of fewer than `least` turns are left out."""
    w = Window.partitionBy(*keys).orderBy("pos")
    far = F.coalesce(F.col("ts") - F.lag("ts").over(w) > gap, F.lit(True))
    out = _island(turns, keys, far, "session_id")
    s = Window.partitionBy(*keys, "session_id")
    out = out.withColumn("seq", F.row_number().over(s.orderBy("pos")) - 1).withColumn("session_size", F.count("*").over(s))
    return out.where(F.col("session_size") >= least)


#: Rows of a range of a log without keys, about.
RANGE = 50_000


def _ranged(log: DataFrame, least: int) -> DataFrame:
    """log with __range, rising with pos, a range RANGE rows or so (in `least` ranges at least): more rows make more
    ranges and as many partitions, not larger ones.  The bounds are approximate quantiles, searched by halving."""
    from pyspark.ml.feature import Bucketizer

    at = F.col("pos").cast("double")
    n = max(least, log.count() // RANGE + 1)
    bounds = log.agg(F.percentile_approx(at, [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] or []
    edges = [float("-inf"), *sorted(set(bounds)), float("inf")]
    if len(edges) == 2:
        return log.withColumn("__range", F.lit(0))
    cut = Bucketizer(splits=edges, inputCol="__at", outputCol="__range", handleInvalid="keep").transform(log.withColumn("__at", at))
    return cut.withColumn("__range", F.when(at.isNull(), 0).otherwise(F.col("__range").cast("int"))).drop("__at").repartition(n, "__range")


def split_log(log: DataFrame, new: Callable[[Column, Column], Column], *by: str, slices: int = 8) -> DataFrame:
    """The rows of one log without keys in islands: `new` tells of the `by` columns (a struct) of the row before and of
    a row whether the row begins one (null: it does); the first row does.  Added are __range and

    * __island, from 1, in order,
    * __before, the rows of the island in ranges before this one,
    * __size and __start, the rows and the first pos of an island that crosses the end of a range, else null.

    Each range is walked on its own; only a row a range comes to the driver, where islands are carried on."""
    ranged = _ranged(log, slices)
    w = Window.partitionBy("__range").orderBy("pos")
    now = F.struct(*by)
    fresh = lambda before, x: F.coalesce(new(before, x), F.lit(True))
    # the first row of a range is no beginning here; the walk below tells whether it is one
    marked = ranged.withColumn("__i", F.row_number().over(w)).withColumn("__new", F.when(F.col("__i") == 1, F.lit(False)).otherwise(fresh(F.lag(now).over(w), now)))
    ends = marked.groupBy("__range").agg(
        F.min_by(now, "__i").alias("first"), F.max_by(now, "__i").alias("last"), F.min_by("pos", "__i").alias("pos"), F.count("*").alias("n"), F.count_if("__new").alias("gaps"),
        F.min(F.when(F.col("__new"), F.col("__i"))).alias("gap"), F.max(F.when(F.col("__new"), F.col("__i"))).alias("tail"), F.max_by(F.when(F.col("__new"), F.col("pos")), F.when(F.col("__new"), F.col("__i"))).alias("tail_pos"),
    )
    before = F.lag("last").over(Window.orderBy("__range"))  # a row a range
    walk = ends.select("__range", "pos", "n", "gaps", "gap", "tail", "tail_pos", fresh(before, F.col("first")).alias("new")).orderBy("__range").collect()

    island, found, pieces = 0, {}, []
    for k, r in enumerate(walk):
        if k == 0 or r["new"]:
            island += 1
            found[island] = [r["pos"], 0, 0]
        own = found[island]
        pieces.append((r["__range"], island, own[1], r["gaps"]))
        own[1] += r["gap"] - 1 if r["gaps"] else r["n"]
        own[2] += 1
        if r["gaps"]:
            island += r["gaps"]
            found[island] = [r["tail_pos"], r["n"] - r["tail"] + 1, 1]
    whole = lambda i: (found[i][1], found[i][0]) if found[i][2] > 1 else (None, None)
    rows = [(r, i, b, g, *whole(i), *whole(i + g)) for r, i, b, g in pieces]
    pos = log.schema["pos"].dataType.simpleString()
    carried = log.sparkSession.createDataFrame(rows, f"__range int, __base long, __held long, __gaps long, __hn long, __hp {pos}, __tn long, __tp {pos}")

    out = marked.withColumn("__k", F.sum(F.col("__new").cast("int")).over(w)).join(F.broadcast(carried), "__range")
    head, tail = F.col("__k") == 0, F.col("__k") == F.col("__gaps")
    return out.select(
        *log.columns, "__range", (F.col("__base") + F.col("__k")).alias("__island"), F.when(head, F.col("__held")).otherwise(0).alias("__before"),
        F.when(head, F.col("__hn")).when(tail, F.col("__tn")).alias("__size"), F.when(head, F.col("__hp")).when(tail, F.col("__tp")).alias("__start"),
    )


def split_at_gaps(records: DataFrame, gap: int, slices: int) -> DataFrame:
    """records of one log with a key `part`, such that no two records within `gap` of each other (in order of pos)
    have different parts.  A log without gaps is one part: for turns and sessions take the functions of a log."""
    near = lambda a, b: F.coalesce(b["ts"] - a["ts"] <= gap, F.lit(True))
    return split_log(records, lambda a, b: ~near(a, b), "ts", slices=slices).select(*records.columns, F.col("__island").alias("part"))


def split_sessions_of_log(log: DataFrame, gap: int = 3600, least: int = 5) -> DataFrame:
    """split_sessions of one log without keys, with session_start, the first pos of the session."""
    rows = split_log(log, lambda a, b: b["ts"] - a["ts"] > gap, "ts")
    s = Window.partitionBy("__range", "__island")
    return rows.select(
        *log.columns, F.col("__island").alias("session_id"), (F.row_number().over(s.orderBy("pos")) - 1 + F.col("__before")).alias("seq"),
        F.coalesce("__size", F.count("*").over(s)).alias("session_size"), F.coalesce("__start", F.min("pos").over(s)).alias("session_start"),
    ).where(F.col("session_size") >= least)


def anonymize(turns: DataFrame, session: list[str], sender: str = "from") -> DataFrame:
    """turns with from_token <user_N>, N by first appearance of the sender in the session."""
    first = F.min("seq").over(Window.partitionBy(*session, sender))
    out = turns.withColumn("__first", first)
    n = F.dense_rank().over(Window.partitionBy(*session).orderBy("__first"))
    return out.withColumn("from_token", F.concat(F.lit("<user_"), n, F.lit(">"))).drop("__first")


def context_windows(turns: DataFrame, session: list[str], size: int, sender: str = "from") -> DataFrame:
    """turns with `context`: the up to `size` turns before each in its session, as {seq, from, text} in order."""
    w = Window.partitionBy(*session).orderBy("seq").rowsBetween(-size, -1)
    item = F.struct(F.col("seq"), F.col(sender).alias("from"), F.col("text"))
    return turns.withColumn("context", F.collect_list(item).over(w))


def flat_windows(turns: DataFrame, session: list[str], size: int = 15, least: int = 10, sender: str = "from") -> DataFrame:
    """One row per turn with `least` or more turns before it: context_text (`name: text` lines), target_text."""
    out = context_windows(turns, session, size, sender).where(F.col("seq") >= least)
    line = F.transform("context", lambda x: F.concat(F.coalesce(x["from"].cast("string"), F.lit("None")), F.lit(": "), x["text"]))
    return out.select(
        *session, F.col("seq").alias("target_seq"), F.col(sender).alias("target_from"), F.size("context").alias("n_context"),
        F.array_join(line, "\n").alias("context_text"), F.col("text").alias("target_text"),
    )


def multiturn_windows(turns: DataFrame, session: list[str], sizes: tuple[int, ...] = (10, 15), least: int = 2, sender: str = "from") -> DataFrame:
    """One row per target turn of quality and window size: context, start, response.  A size whose window starts
    where the next smaller one does is skipped, and windows of fewer than `least` turns."""
    sizes = tuple(sorted(sizes))
    response = strip(F.col("text"))
    out = context_windows(turns, session, sizes[-1], sender).where((F.col("seq") >= least) & (response != "") & is_quality_response(response))
    starts = F.array(*(F.struct(F.lit(s).alias("size"), F.greatest(F.lit(0), F.col("seq") - s).alias("start")) for s in sizes))
    fresh = F.filter(starts, lambda x, i: (i == 0) | (x["start"] != F.element_at(starts, F.greatest(i, F.lit(1)))["start"]))
    out = out.withColumn("__w", F.explode(fresh)).withColumn("n_context", (F.col("seq") - F.col("__w.start")).cast("int"))
    out = out.where(F.col("n_context") >= least)
    context = F.slice("context", F.size("context") - F.col("n_context") + 1, F.col("n_context"))
    return out.select(
        *session, F.col("seq").alias("target_seq"), F.col(sender).alias("target_from"), F.col("__w.size").alias("window"),
        F.col("__w.start").alias("start"), "n_context", context.alias("context"), response.alias("response"),
    )


MESSAGES = "array<struct<role:string,content:string>>"


def _fold(turned: Column) -> Column:
    """Neighbouring messages of one role as one, joined by line breaks."""

    def add(acc: Column, m: Column) -> Column:
        last = F.element_at(acc, -1)
        merged = F.struct(last["role"].alias("role"), F.concat(last["content"], F.lit("\n"), m["content"]).alias("content"))
        n = F.size(acc)
        return F.when((n > 0) & (F.try_element_at(acc, F.lit(-1))["role"] == m["role"]), F.concat(F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(m)))

    return F.aggregate(turned, F.array().cast(MESSAGES), lambda acc, m: F.when(F.size(acc) == 0, F.array(m)).otherwise(add(acc, m)))


def fold_roles(windows: DataFrame, system: str | None = None, tokens: bool = False) -> DataFrame:
    """windows (context, target_from, response) with `messages`: the target author's earlier turns are the
    assistant's, but for the last of the context and a first one; all others are the user's, with the name in
    front; neighbours of one role are joined.  tokens: every turn keeps its author's name, and the response is
    joined to an assistant turn before it."""
    n = F.size("context")
    name = lambda x: F.coalesce(x["from"].cast("string"), F.lit("None"))
    joint = " " if tokens else ": "

    def role(x: Column, i: Column) -> Column:
        theirs = x["from"].eqNullSafe(F.col("target_from")) & ((i > 0) if tokens else (i > 0) & (i < n - 1))
        said = F.concat(name(x), F.lit(joint), x["text"])
        return F.struct(F.when(theirs, "assistant").otherwise("user").alias("role"), (said if tokens else F.when(theirs, x["text"]).otherwise(said)).alias("content"))

    turned = F.transform("context", role)
    answer = F.struct(F.lit("assistant").alias("role"), (F.concat(F.col("target_from").cast("string"), F.lit(joint), F.col("response")) if tokens else F.col("response")).alias("content"))
    folded = _fold(F.concat(turned, F.array(answer))) if tokens else F.concat(_fold(turned), F.array(answer))
    if system is not None:
        folded = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), folded)
    return windows.withColumn("messages", folded)
