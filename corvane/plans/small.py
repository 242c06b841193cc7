"""Queries of the small operators: filters, look-ups, orders and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import rules as R
from corvane.functions import text as X
from corvane.operators import corpus as C
from corvane.operators import evalstats as E
from corvane.plans.registry import query, table
from corvane.sources import readers

_MARKED = """CASE turn % 7 WHEN 1 THEN text || ' Score Is 42%' WHEN 2 THEN '/start ' || text WHEN 3 THEN text || repeat('ㅤ', 3) WHEN 4 THEN '7777777' WHEN 5 THEN 'so said THEBOT, ' || text ELSE text END"""


@query(
    f"""WITH r AS (SELECT conv_id * 1000 + turn AS id, {_MARKED} AS text FROM conversations)
    SELECT id FROM r WHERE trim(text) <> '' AND NOT regexp_matches(text, '(?i)score is \\d+') AND NOT regexp_matches(text, '^/start\\b') AND NOT regexp_matches(text, '[ㅤᅟᅠ⠀]{{3,}}')
    AND NOT regexp_matches(text, '^({"|".join(f"{d}{{7,}}" for d in range(10))})$') AND NOT regexp_matches(text, '(?i)thebot')"""
)
def f4_enhanced_filter(spark, sf_dir):
    """Texts with marks that bots leave, and bots' names: templates, commands, filler, repeated digits."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS id", "role AS from", f"{_MARKED} AS text", "CAST(NULL AS BIGINT) AS reply_to")
    return R.chat_filter(rows, ["nobody"], [], R.leak_patterns(("score is {n}",), ("start",)), ["thebot"]).select("id")


@query(r"SELECT conv_id, turn FROM conversations WHERE len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) <= 30")
def f12_token_cap(spark, sf_dir):
    return C.within_cap(table(spark, sf_dir, "conversations"), F.size(X.words(F.col("text"))), 30).select("conv_id", "turn")


@query("SELECT source, count(*) AS n, min(doc_id) AS first_pos FROM documents GROUP BY source HAVING count(*) >= 3 ORDER BY n DESC, first_pos LIMIT 4")
def t2_top_clusters(spark, sf_dir):
    found = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_pos"))
    return E.top_clusters(found, 3, 4)


def _rated(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("model", F.concat(F.lit("m"), F.col("turn") % 3))
    best = F.max(F.struct("turn", "model")).alias("b")
    rated = rows.groupBy(F.col("conv_id").alias("prompt_id")).agg(F.array_sort(F.collect_list(F.struct("model", F.col("turn").alias("candidate_idx"), F.col("text").alias("response")))).alias("all_candidates"), best)
    return rated.select("prompt_id", "all_candidates", F.col("b.model").alias("best_model"), F.col("b.turn").alias("best_candidate_idx"), F.lit("best").alias("decision"))


@query(
    """WITH c AS (SELECT conv_id, turn, text, 'm' || turn % 3 AS model FROM conversations), b AS (SELECT conv_id, max(turn) AS best FROM conversations GROUP BY conv_id)
    SELECT b.conv_id AS prompt_id, (SELECT min(turn) FROM c WHERE c.conv_id = b.conv_id AND model = 'm1') AS own, best AS winner FROM b
    WHERE best % 3 <> 1 AND EXISTS (SELECT 1 FROM c WHERE c.conv_id = b.conv_id AND model = 'm1')"""
)
def j13_losses_of_a_model(spark, sf_dir):
    return E.losses_of(_rated(spark, sf_dir), "m1").select("prompt_id", F.col("own.candidate_idx").alias("own"), F.col("winner.candidate_idx").alias("winner"))


@query("SELECT model, count(*) AS wins FROM (SELECT 'm' || max(turn) % 3 AS model FROM conversations GROUP BY conv_id) GROUP BY model")
def a14_wins_by_model(spark, sf_dir):
    return E.wins_by_model(_rated(spark, sf_dir))


@query(
    """WITH p AS (SELECT text AS chosen, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS rejected FROM conversations)
    SELECT count(*) AS n, avg(length(chosen)) / avg(length(rejected)) AS length_ratio, CAST(count_if(length(chosen) < 5) AS BIGINT) AS very_short, count_if(chosen = rejected) / count(*)::DOUBLE AS identical_share FROM p WHERE rejected IS NOT NULL"""
)
def a23_check_pairs(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").select(F.col("text").alias("chosen"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("rejected"))
    pairs = rows.where("rejected IS NOT NULL")
    E.check_pairs(pairs)
    return E.pair_diagnostics(pairs, []).select("n", "length_ratio", "very_short", "identical_share")


@query("SELECT min(ts) AS first, max(ts) AS last FROM events")
def a2_date_range(spark, sf_dir):
    return E.date_range(table(spark, sf_dir, "events"), F.col("ts"))


@query("SELECT conv_id, string_agg('m' || turn % 3 || ':' || turn, ',' ORDER BY turn % 3, turn) AS shown FROM conversations GROUP BY conv_id")
def w15_default_order(spark, sf_dir):
    shown = X.default_order(F.shuffle("all_candidates"))
    return _rated(spark, sf_dir).select(F.col("prompt_id").alias("conv_id"), F.array_join(F.transform(shown, lambda c: F.concat(c["model"], F.lit(":"), c["candidate_idx"])), ",").alias("shown"))


@query("WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(t[greatest(len(t) - 2, 1):], ',') AS last_three, array_to_string(t[greatest(len(t) - 14, 1):], ',') AS buffer FROM c")
def r6_last_messages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return turns.select("conv_id", joined(X.last_of(F.col("t"), 3)).alias("last_three"), joined(X.last_of(F.col("t"))).alias("buffer"))


@query("SELECT role AS sender FROM conversations UNION SELECT event_type FROM events")
def u5_all_senders(spark, sf_dir):
    return C.all_senders(table(spark, sf_dir, "conversations").selectExpr("role AS sender"), table(spark, sf_dir, "events").selectExpr("event_type AS sender"))


@query(
    """SELECT * FROM (VALUES (1, 't0.5_p1.1', 0.5::DOUBLE, 1.1::DOUBLE), (2, 't0.5_p1.2', 0.5, 1.2), (3, 't0.9_p1.1', 0.9, 1.1), (4, 't0.9_p1.2', 0.9, 1.2)) v(idx, name, temperature, repetition_penalty)"""
)
def p20_parameter_grid(spark, sf_dir):
    return readers.parameter_grid(spark, [0.5, 0.9], [1.1, 1.2]).select("idx", "name", "temperature", "repetition_penalty")


@query("""WITH r AS (SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN ' ' || role || ' ' ELSE '' END, ',' ORDER BY turn) AS arg FROM conversations GROUP BY conv_id)
    SELECT conv_id, array_to_string(list_filter(list_transform(string_split(arg, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM r""")
def p23_arguments(spark, sf_dir):
    said = F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), "role", F.lit(" "))).otherwise("").alias("x"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(said, lambda s: s["x"]), ",").alias("arg"))
    return rows.select("conv_id", F.array_join(X.arguments(F.col("arg")), "|").alias("parts"))


@query(r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'v' || doc_id WHEN 1 THEN 'v' || doc_id || '-multi' ELSE '' END AS version FROM labels""")
def p24_version_of(spark, sf_dir):
    name = F.expr("CASE doc_id % 3 WHEN 0 THEN 'thebot-v' || doc_id || '-gen' WHEN 1 THEN 'thebot-v' || doc_id || '-multi-gen' ELSE 'other-v1-gen' END")
    return table(spark, sf_dir, "labels").select("doc_id", X.version_of(name, "thebot").alias("version"))


@query("SELECT conv_id, turn, trim(text) AS said FROM conversations")
def p33_strip_speaker_tokens(spark, sf_dir):
    marked = F.concat(F.expr("CASE turn % 3 WHEN 0 THEN ' <user_' || (turn + 1) || '> ' WHEN 1 THEN '<user_2><bot> ' ELSE '' END"), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.strip_speaker_tokens(marked).alias("said"))


@query("SELECT doc_id, 'doc_' || doc_id AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j14_missing_files(spark, sf_dir):
    named = lambda t: table(spark, sf_dir, t).select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("name"))
    return C.missing_files(named("documents"), named("labels"))
