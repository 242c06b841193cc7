"""Queries of evaluation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import evalstats as E
from corvane.plans.registry import query, table
from corvane.plans.texts import FLAGS


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY event_type")
def a1_type_counts(spark, sf_dir):
    return E.type_counts(table(spark, sf_dir, "events"), "event_type", "event_id")


@query(
    """WITH l AS (SELECT role, length(text) AS v, row_number() OVER (PARTITION BY role ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY role) AS n FROM conversations)
    SELECT role, CAST(any_value(n) AS BIGINT) AS n, CAST(min(v) AS BIGINT) AS min, CAST(max(v) FILTER (i = n // 2) AS BIGINT) AS upper_median, CAST(max(v) AS BIGINT) AS max, avg(v) AS mean FROM l GROUP BY role"""
)
def a3_text_length_stats(spark, sf_dir):
    return E.list_stats(table(spark, sf_dir, "conversations"), ["role"], F.length("text").cast("long"))


@query("SELECT source, count(*) AS n, avg(length(text)) AS mean, median(length(text)) AS median, round(stddev_samp(length(text)), 6) AS stdev, CAST(count_if(length(text) >= 1000) AS BIGINT) AS n_at_least FROM documents GROUP BY source")
def a4_series_stats(spark, sf_dir):
    return E.series_stats(table(spark, sf_dir, "documents"), ["source"], F.length("text"), 1000).withColumn("stdev", F.round("stdev", 6))


@query(
    """WITH b AS (SELECT lang, CASE WHEN n >= 0 AND n < 500 THEN 0 WHEN n >= 500 AND n < 1000 THEN 1 WHEN n >= 1000 AND n < 5000 THEN 2 END AS bucket FROM (SELECT lang, length(text) AS n FROM documents))
    SELECT lang, bucket, count(*) AS n FROM b WHERE bucket IS NOT NULL GROUP BY lang, bucket"""
)
def a5_length_histogram(spark, sf_dir):
    return E.histogram(table(spark, sf_dir, "documents"), ["lang"], F.length("text"), [0, 500, 1000, 5000])


@query(
    """WITH p AS (SELECT a.turn, length(a.text) - length(b.text) AS d FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT CAST(CASE WHEN d < -100 THEN 0 WHEN d < 0 THEN 1 WHEN d < 100 THEN 2 ELSE 3 END AS INTEGER) AS bucket, count(*) AS n FROM p WHERE d >= -10000 AND d < 10000 GROUP BY 1"""
)
def a6_signed_difference_histogram(spark, sf_dir):
    a = table(spark, sf_dir, "conversations")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("other"))
    return E.histogram(a.join(b, ["conv_id", "turn"]), [], F.length("text") - F.col("other"), [-10000, -100, 0, 100, 10000])


_PATTERNS = {"digit_pct": "[0-9]", "capital_pct": "[A-Z][a-z]+ [A-Z]"}
_GUARD = """WITH l AS (SELECT {by}, text, length(text) AS v, row_number() OVER (PARTITION BY {by} ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {table}),
    s AS (SELECT {by}, count(*) AS n, count_if(regexp_matches(text, '[0-9]')) * 100 / count(*)::DOUBLE AS digit_pct, count_if(regexp_matches(text, '[A-Z][a-z]+ [A-Z]')) * 100 / count(*)::DOUBLE AS capital_pct, avg(v) AS mean_length,
        CAST(max(v) FILTER (i = n // 2) AS BIGINT) AS median_length, CAST(max(v) FILTER (i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)) AS BIGINT) AS length_p95 FROM l GROUP BY {by}),
    w AS (SELECT {by}, w, count(*) AS c FROM (SELECT {by}, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM {table}) GROUP BY {by}, w),
    t AS (SELECT {by}, w, c / sum(c) OVER (PARTITION BY {by}) AS p FROM w), e AS (SELECT {by}, round(-sum(p * log2(p)), 6) AS vocab_entropy FROM t GROUP BY {by})"""


def _guard(spark, sf_dir, name, by):
    g = E.guardrails(table(spark, sf_dir, name), [by], "text", _PATTERNS).withColumn("vocab_entropy", F.round("vocab_entropy", 6))
    return g.withColumn("median_length", F.col("median_length").cast("long")).withColumn("length_p95", F.col("length_p95").cast("long"))


@query(_GUARD.format(by="role", table="conversations") + " SELECT s.*, vocab_entropy FROM s JOIN e USING (role)")
def a7_guardrails(spark, sf_dir):
    return _guard(spark, sf_dir, "conversations", "role")


_METRICS = ("n", "digit_pct", "mean_length", "median_length", "vocab_entropy")


@query(
    _GUARD.format(by="lang", table="documents")
    + ", m AS (SELECT lang, unnest(['" + "', '".join(_METRICS) + "']) AS metric, unnest([" + ", ".join(f"CAST({m} AS DOUBLE)" for m in _METRICS) + "]) AS v FROM s JOIN e USING (lang))"
    + " SELECT metric, " + ", ".join(f"max(v) FILTER (lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM m GROUP BY metric"
)
def a9_side_by_side(spark, sf_dir):
    return E.side_by_side(_guard(spark, sf_dir, "documents", "lang"), "lang", list(_METRICS), ["de", "en", "es", "fr"])


_WINNER = "CASE event_type WHEN 'purchase' THEN 'A' WHEN 'error' THEN 'B' ELSE 'tie' END"


@query(
    f"""WITH r AS (SELECT user_id % 10 AS grp, {_WINNER} AS winner, CASE WHEN event_id % 5 = 0 THEN 'super' ELSE 'normal' END AS tier FROM events)
    SELECT grp, count(*) AS n, CAST(count_if(winner = 'A') AS BIGINT) AS wins_a, CAST(count_if(winner = 'B') AS BIGINT) AS wins_b, CAST(count_if(winner = 'tie') AS BIGINT) AS ties,
    count_if(winner = 'A') / nullif(count_if(winner <> 'tie'), 0)::DOUBLE AS win_rate, CAST(count_if(winner = 'A' AND tier = 'super') AS BIGINT) AS super_a, CAST(count_if(winner = 'B' AND tier = 'super') AS BIGINT) AS super_b FROM r GROUP BY grp"""
)
def a12_win_rate_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("user_id % 10 AS grp", f"{_WINNER} AS winner", "CASE WHEN event_id % 5 = 0 THEN 'super' ELSE 'normal' END AS tier")
    return E.win_rates(rows, ["grp"])


@query(
    """WITH n AS (SELECT count(*) AS n, count_if(toxic = 0 AND quality = 1) AS a, count_if(toxic = 0) AS ab FROM labels),
    d AS (SELECT b, a, ab, CAST('0x' || substr(md5('42|' || b || '|' || k), 1, 8) AS BIGINT) % n AS i FROM n, range(1000) x(b), range(n) y(k)),
    s AS (SELECT b, count_if(i < a) / nullif(count_if(i < ab), 0)::DOUBLE AS rate FROM d GROUP BY b),
    o AS (SELECT rate, row_number() OVER (ORDER BY rate) - 1 AS j FROM s) SELECT n, (SELECT rate FROM o WHERE j = 25) AS lo, (SELECT rate FROM o WHERE j = 975) AS hi FROM n"""
)
def a11_bootstrap(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").selectExpr("1 AS whole", "CASE WHEN toxic = 1 THEN 'tie' WHEN quality = 1 THEN 'A' ELSE 'B' END AS winner")
    return E.bootstrap(rows, ["whole"]).select("n", "lo", "hi")


@query(
    """WITH r AS (SELECT CASE WHEN toxic = 1 THEN 'tie' WHEN quality = 1 THEN 'bestof' WHEN doc_id % 9 = 0 THEN 'skip' ELSE 'default' END AS winner FROM labels)
    SELECT CAST(count_if(winner = 'bestof') AS BIGINT) AS wins_bestof, CAST(count_if(winner = 'default') AS BIGINT) AS wins_default, CAST(count_if(winner = 'tie') AS BIGINT) AS ties, CAST(count_if(winner = 'skip') AS BIGINT) AS skips,
    count_if(winner = 'bestof') / nullif(count_if(winner IN ('bestof', 'default')), 0)::DOUBLE AS win_rate, count_if(winner = 'bestof') / nullif(count_if(winner IN ('bestof', 'default')), 0)::DOUBLE >= 0.6 AS passes FROM r"""
)
def a13_bestof_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").selectExpr("CASE WHEN toxic = 1 THEN 'tie' WHEN quality = 1 THEN 'bestof' WHEN doc_id % 9 = 0 THEN 'skip' ELSE 'default' END AS winner")
    return E.bestof_summary(rows)


@query(
    """WITH c AS (SELECT conv_id, 'm' || turn % 3 AS model, turn FROM conversations), b AS (SELECT conv_id, 'm' || max(turn) % 3 AS best FROM conversations GROUP BY conv_id),
    p AS (SELECT model, count(*) AS present FROM c GROUP BY model), w AS (SELECT best AS model, count(*) AS wins FROM b GROUP BY best)
    SELECT model, present, coalesce(wins, 0) AS wins, coalesce(wins, 0) / present::DOUBLE AS win_share FROM p LEFT JOIN w USING (model)"""
)
def a15_win_table(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("model", F.concat(F.lit("m"), F.col("turn") % 3))
    rated = rows.groupBy("conv_id").agg(F.collect_list(F.struct("model", F.col("turn").alias("candidate_idx"))).alias("all_candidates"), F.max_by("model", "turn").alias("best_model"))
    return E.win_table(rated.withColumn("decision", F.lit("best")))


@query(
    "SELECT artifact, count(*) AS n, array_to_string((list(text ORDER BY doc_id))[1:3], '|') AS examples FROM (SELECT doc_id, text, unnest(list_filter(["
    + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in FLAGS.items())
    + "], lambda x: x IS NOT NULL)) AS artifact FROM documents) GROUP BY artifact"
)
def a16_artifacts(spark, sf_dir):
    return E.artifacts(table(spark, sf_dir, "documents"), "text", "doc_id", "thebot").select("artifact", "n", F.array_join("examples", "|").alias("examples"))


@query(
    """WITH r AS (SELECT event_type AS model, CASE WHEN event_id % 4 = 0 THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN value > 50 THEN value END AS cost, event_id FROM events)
    SELECT model, count(*) AS n, CAST(count_if(event_id % 6 = 0) AS BIGINT) AS empty, round(coalesce(avg(cost), 0), 6) AS avg_cost, round(coalesce(avg(cost), 0) * 1000, 3) AS cost_per_1000, CAST(count_if(status = 'rejected') AS BIGINT) AS n_rejected FROM r GROUP BY model"""
)
def a17_experiment_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_type AS model", "CASE WHEN event_id % 4 = 0 THEN 'rejected' ELSE 'accepted' END AS status", "CASE WHEN event_id % 6 <> 0 THEN 'x' END AS response",
        "named_struct('cost', CASE WHEN value > 50 THEN value END, 'prompt_tokens', event_id, 'completion_tokens', event_id) AS usage", "CAST(NULL AS STRING) AS reject_reason", "'stop' AS finish_reason",
    )
    out = E.experiment_summary(rows)
    return out.select("model", "n", "empty", F.round("avg_cost", 6).alias("avg_cost"), F.round("cost_per_1000", 3).alias("cost_per_1000"), F.col("status_counts")["rejected"].alias("n_rejected"))


@query(
    """WITH r AS (SELECT CASE WHEN length(text) > 500 THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN length(text) > 1000 THEN 'very_long' WHEN length(text) > 500 THEN 'too_long' END AS why FROM documents)
    SELECT status AS key, count(*) AS n FROM r GROUP BY status UNION ALL SELECT 'reject:' || why, count(*) FROM r WHERE why IS NOT NULL GROUP BY why"""
)
def a18_status_counts(spark, sf_dir):
    return E.status_counts(table(spark, sf_dir, "documents").selectExpr("CASE WHEN length(text) > 500 THEN 'rejected' ELSE 'accepted' END AS status", "CASE WHEN length(text) > 1000 THEN 'very_long' WHEN length(text) > 500 THEN 'too_long' END AS reject_reason"))


@query(
    r"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    f AS (SELECT source AS sender, doc_id * 100000 + i AS pos, line, length(line) AS len, lower(trim(regexp_replace(regexp_replace(regexp_replace(line, '\d+(?:[.,]\d+)?', 'D', 'g'), 'https?://\S+|t\.me/\S+|@[\w\pL\pN]+', '@', 'g'), '\s+', ' ', 'g'))) AS template FROM l WHERE length(trim(line)) BETWEEN 8 AND 200),
    o AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY len, pos) - 1 AS r, count(*) OVER (PARTITION BY template) AS n FROM f),
    s AS (SELECT template, sender, count(*) AS c, min(pos) AS first FROM f GROUP BY template, sender),
    k AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY c DESC, first) AS q FROM s),
    t AS (SELECT template, count(*) AS n_senders, string_agg(sender || ':' || c, ',' ORDER BY q) FILTER (q <= 3) AS top_senders FROM k GROUP BY template)
    SELECT template, CAST(o.n AS BIGINT) AS n, n_senders, top_senders, line AS sample, n_senders >= 3 AS suspect FROM o JOIN t USING (template) WHERE r = o.n // 2 AND o.n >= 3"""
)
def a19_clusters(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.withColumn("pos", F.col("doc_id") * 100000 + F.col("i") + 1)
    out = E.clusters(lines, "line", "source", "pos")
    return out.select("template", "n", "n_senders", F.array_join("top_senders", ",").alias("top_senders"), "sample", "suspect")


@query(
    """WITH p AS (SELECT a.conv_id, a.text AS chosen, b.text AS rejected FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')
    SELECT count(*) AS n, round(avg(length(chosen)), 6) AS mean_chosen, median(length(chosen)) AS median_chosen, round(stddev_samp(length(rejected)), 6) AS stdev_rejected, round(avg(length(chosen)) / avg(length(rejected)), 9) AS length_ratio,
    CAST(count_if(length(chosen) > length(rejected)) AS BIGINT) AS chosen_longer, CAST(count_if(length(chosen) < length(rejected)) AS BIGINT) AS rejected_longer, count(DISTINCT chosen) / count(*)::DOUBLE AS distinct_chosen, CAST(count_if(length(chosen) > 500) AS BIGINT) AS very_long FROM p"""
)
def a21_pair_diagnostics(spark, sf_dir):
    a = table(spark, sf_dir, "conversations")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("rejected"))
    out = E.pair_diagnostics(a.where("role = 'user'").withColumnRenamed("text", "chosen").join(b, ["conv_id", "turn"]), [])
    r = lambda c, n: F.round(c, n).alias(c)
    return out.select("n", r("mean_chosen", 6), "median_chosen", r("stdev_rejected", 6), r("length_ratio", 9), "chosen_longer", "rejected_longer", "distinct_chosen", "very_long")


@query(
    """WITH s AS (SELECT quality, length(text) % 89 - toxic * 10 AS a, length(text) % 83 AS b FROM labels JOIN documents USING (doc_id)),
    m AS (SELECT *, CAST(a - b AS DOUBLE) AS margin FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY margin) - 1 AS i, count(*) OVER (PARTITION BY quality) AS n FROM m)
    SELECT quality, any_value(n) AS n, avg(CASE WHEN margin > 0 THEN 1 ELSE 0 END) AS accuracy, avg(margin) AS mean_margin, max(margin) FILTER (i = n // 2) AS median_margin FROM o GROUP BY quality"""
)
def a24_pairwise_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    rows = rows.selectExpr("quality", "CAST(length(text) % 89 - toxic * 10 AS DOUBLE) AS score_chosen", "CAST(length(text) % 83 AS DOUBLE) AS score_rejected")
    return E.pairwise_accuracy(rows, ["quality"])


@query("SELECT lang, count(*) AS n, avg(length(text)) AS avg_length, 100 * count(DISTINCT text) / count(*)::DOUBLE AS distinct_pct, CAST(count_if(regexp_matches(text, '[0-9]{3}')) AS BIGINT) AS digits FROM documents GROUP BY lang")
def a25_grid_summary(spark, sf_dir):
    return E.grid_summary(table(spark, sf_dir, "documents"), "lang", "text", {"digits": "[0-9]{3}"})


@query("SELECT count_if(regexp_matches(source, '1')) / count(*)::DOUBLE AS context, count_if(regexp_matches(text, '[0-9]{3}')) / count(*)::DOUBLE AS chosen, count_if(regexp_matches(lang, 'e')) / count(*)::DOUBLE AS rejected FROM documents")
def a26_pattern_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.array("source").alias("context"), F.when(F.col("text").rlike("[0-9]{3}"), "hit 1e").otherwise("").alias("chosen"), F.when(F.col("lang").rlike("e"), "1").otherwise("").alias("rejected"))
    return E.pattern_rates(rows, "1")
