"""Queries of ratings, preference pairs, routing and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import rules as R
from corvane.functions import text as X
from corvane.operators import prefs as P
from corvane.operators import ranking as K
from corvane.plans.registry import query, table

_POISON, _SPAM = "idiot|moron", "MIT License"


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def j1_anti_join_replies(spark, sf_dir):
    theirs = table(spark, sf_dir, "customer").where("c_acctbal < 0").selectExpr("c_custkey AS o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(theirs, "o_custkey", "left_anti")


_PAIRS = f"""WITH r AS (SELECT doc_id AS pos, doc_id AS prompt_id, CASE WHEN toxic = 1 THEN 'tie' WHEN quality = 1 THEN 'A' ELSE 'B' END AS winner FROM labels),
    g AS (SELECT doc_id, text, source FROM documents),
    j AS (SELECT r.*, a.text AS ta, b.text AS tb, a.source AS ca FROM r LEFT JOIN g a ON a.doc_id = r.prompt_id LEFT JOIN g b ON b.doc_id = r.prompt_id + 1),
    c AS (SELECT *, CASE WHEN winner = 'A' THEN ta ELSE tb END AS chosen, CASE WHEN winner = 'A' THEN tb ELSE ta END AS rejected FROM j),
    x AS (SELECT *, CASE WHEN winner = 'tie' THEN 'tie' WHEN ta IS NULL OR tb IS NULL THEN 'missing_gen' WHEN chosen = rejected THEN 'identical' WHEN regexp_matches(ca, '{_POISON}|{_SPAM}') THEN 'poison_context'
        WHEN regexp_matches(chosen, '{_POISON}|{_SPAM}') THEN 'poison_chosen' WHEN regexp_matches(rejected, '{_POISON}|{_SPAM}') THEN 'poison_rejected' END AS reason FROM c)"""


def rated(spark, sf_dir):
    """Labels as ratings of a document (A) against the next one (B)."""
    docs = table(spark, sf_dir, "documents")
    a = docs.select(F.lit("a").alias("version"), F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.array("source").alias("context"), F.col("text").alias("response"), F.lit(False).alias("held_out"))
    b = a.withColumn("version", F.lit("b")).withColumn("id", F.col("id") - 1)
    ratings = table(spark, sf_dir, "labels").selectExpr("doc_id AS pos", "doc_id AS prompt_id", "'a' AS version_a", "'b' AS version_b", "CASE WHEN toxic = 1 THEN 'tie' WHEN quality = 1 THEN 'A' ELSE 'B' END AS winner", "'chat' AS category", "CASE WHEN doc_id % 7 = 0 THEN 'super' END AS tier")
    return P.rated_pairs(ratings, a.union(b), _POISON, _SPAM)


@query(_PAIRS + " SELECT prompt_id, coalesce(reason, 'kept') AS reason, md5(chosen) AS chosen_md5 FROM x")
def j2_prefs_from_ratings(spark, sf_dir):
    return rated(spark, sf_dir).select("prompt_id", F.coalesce("reason", F.lit("kept")).alias("reason"), F.md5(F.col("chosen").cast("binary")).alias("chosen_md5"))


@query(_PAIRS + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM x GROUP BY 1")
def a22_reject_reasons(spark, sf_dir):
    return P.reasons(rated(spark, sf_dir))


@query(
    _PAIRS
    + """, k AS (SELECT pos, ca AS prompt, chosen, pos % 7 = 0 AS super FROM x WHERE reason IS NULL),
    f AS (SELECT *, CASE WHEN length(chosen) < 5 THEN 'too_short' WHEN length(chosen) > 500 THEN 'too_long' WHEN regexp_matches(chosen, 'MIT License') THEN 'spam' END AS why FROM k),
    d AS (SELECT *, row_number() OVER (PARTITION BY md5('user:' || prompt || '|||assistant:' || chosen) ORDER BY pos) AS n FROM f WHERE why IS NULL)
    SELECT pos, CAST(unnest(range(1, 2 + CAST(super AS INTEGER))) AS INTEGER) AS copy FROM d WHERE n = 1"""
)
def f9_augment(spark, sf_dir):
    pairs = P.preference_rows(rated(spark, sf_dir), "ratings").withColumn("pos", F.col("prompt_id"))
    examples, _ = P.augment(pairs, _POISON, _SPAM, {"super": 2})
    return examples.select("pos", "copy")


@query(
    """WITH c AS (SELECT conv_id, turn AS idx, text FROM conversations WHERE role = 'assistant'), b AS (SELECT conv_id, (conv_id % 4) * 2 + 1 AS best FROM (SELECT DISTINCT conv_id FROM conversations)),
    w AS (SELECT b.conv_id, b.best, c.text AS chosen FROM b LEFT JOIN c ON c.conv_id = b.conv_id AND c.idx = b.best)
    SELECT w.conv_id, c.idx, CASE WHEN w.conv_id NOT IN (SELECT conv_id FROM c) THEN 'missing_gen' WHEN w.chosen IS NULL THEN 'missing_best' WHEN c.idx IS NULL THEN 'no_other' WHEN c.text = w.chosen THEN 'identical' ELSE 'kept' END AS reason
    FROM w LEFT JOIN c ON c.conv_id = w.conv_id AND c.idx <> w.best AND w.chosen IS NOT NULL"""
)
def j12_best_vs_rest(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    gens = rows.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("idx"), F.col("text").alias("response")))).alias("candidates"))
    gens = gens.withColumn("pos", F.col("id")).withColumn("context", F.array(F.lit("fine")))
    ratings = table(spark, sf_dir, "conversations").select("conv_id").distinct().selectExpr("conv_id AS pos", "conv_id AS prompt_id", "(conv_id % 4) * 2 + 1 AS best_candidate_idx", "CAST(NULL AS STRING) AS decision")
    out = P.best_vs_rest(ratings, gens, "zzqq")
    kept = gens.select(F.col("id").alias("prompt_id"), F.explode("candidates").alias("c")).select("prompt_id", F.col("c.idx").alias("idx"), F.col("c.response").alias("rejected"))
    out = out.join(kept, ["prompt_id", "rejected"], "left")
    return out.select(F.col("prompt_id").alias("conv_id"), "idx", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j7_resume_anti_join(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("prompt_id"), F.struct(F.when(F.col("doc_id") % 2 == 1, F.col("doc_id")).alias("prompt_id")).alias("_meta"))
    return P.resume(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("prompt_id")), done).select(F.col("prompt_id").alias("doc_id"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT page_id FROM pages) AND doc_id NOT IN (SELECT doc_id FROM labels)")
def j6_rateable(spark, sf_dir):
    multi, best = table(spark, sf_dir, "documents").selectExpr("doc_id AS id"), table(spark, sf_dir, "pages").selectExpr("page_id AS id")
    return P.rateable(multi, best, table(spark, sf_dir, "labels").selectExpr("doc_id AS prompt_id")).select(F.col("id").alias("doc_id"))


@query(
    """WITH r AS (SELECT doc_id AS pos, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id // 2 END AS prompt_id, CASE WHEN length(text) > 500 THEN 'too_long' ELSE 'other' END AS reason FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY pos) AS n FROM r WHERE reason = 'too_long' AND (prompt_id IS NULL OR prompt_id NOT IN (SELECT doc_id FROM labels)))
    SELECT pos FROM n WHERE prompt_id IS NULL OR n = 1"""
)
def j8_promote_rejected(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id AS pos", "CASE WHEN doc_id % 10 <> 0 THEN doc_id div 2 END AS prompt_id", "CASE WHEN length(text) > 500 THEN 'too_long' ELSE 'other' END AS reject_reason")
    return P.promote(rows, table(spark, sf_dir, "labels").selectExpr("doc_id AS prompt_id"), ["too_long"]).select("pos")


@query("SELECT item_id, model, idx FROM benchmark, (VALUES ('m1'), ('m2')) m(model), (VALUES (1), (2), (3)) c(idx)")
def j10_grid(spark, sf_dir):
    models = spark.createDataFrame([("m1",), ("m2",)], "model string")
    return P.grid(table(spark, sf_dir, "benchmark").select("item_id"), models, spark.range(1, 4).select(F.col("id").cast("int").alias("idx")))


@query(
    r"""WITH g AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 0 THEN NULL WHEN turn % 7 = 1 THEN '' ELSE text END AS content, CASE WHEN turn % 11 = 0 THEN 'timeout' END AS error FROM conversations),
    s AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN content IS NULL THEN 'empty_content' END AS failure FROM g),
    t AS (SELECT *, CASE WHEN failure IS NULL THEN CASE WHEN content = '' THEN 'empty' WHEN length(content) < 5 THEN 'too_short' WHEN length(trim(content)) > 500 THEN 'too_long' END END AS reject FROM s)
    SELECT CASE WHEN failure IS NOT NULL THEN 'failures' WHEN reject IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS status, coalesce(failure, reject, '') AS why, count(*) AS n FROM t GROUP BY 1, 2"""
)
def k5_route(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "CASE WHEN turn % 7 = 0 THEN NULL WHEN turn % 7 = 1 THEN '' ELSE text END AS content", "CASE WHEN turn % 11 = 0 THEN 'timeout' END AS error")
    out = P.route(rows, R.post_filter())
    return out.groupBy("status", F.coalesce("failure", "reject_reason", F.lit("")).alias("why")).agg(F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT conv_id, turn, CASE WHEN length(text) > 500 THEN 'rejected' ELSE 'accepted' END AS status FROM conversations WHERE role = 'assistant')
    SELECT conv_id, coalesce(min(turn) FILTER (status = 'accepted'), max(turn)) AS turn, CASE WHEN bool_or(status = 'accepted') THEN 'accepted' ELSE 'rejected' END AS status FROM a GROUP BY conv_id"""
)
def r5_settle_attempts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr("conv_id", "turn", "CASE WHEN length(text) > 500 THEN 'rejected' ELSE 'accepted' END AS status")
    return P.settle_attempts(rows, ["conv_id"], "turn").select("conv_id", "turn", "status")


@query("SELECT source, arg_min(doc_id, struct_pack(a := -(n % 97), b := doc_id)) AS doc_id, max(n % 97) AS score FROM (SELECT source, doc_id, length(text) AS n FROM documents) GROUP BY source")
def t1_best_of_n(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", (F.length("text") % 97).cast("long").alias("score"))
    return K.best_of(docs, ["source"], "score", "doc_id").select("source", "doc_id", "score")


_RANK = """WITH c AS (SELECT conv_id, turn, CAST('0x' || substr(md5('score|' || text), 1, 8) AS BIGINT) / 4294967296.0 AS s FROM conversations WHERE role = 'assistant'),
    b AS (SELECT conv_id, arg_min(turn, struct_pack(a := -s, b := turn)) AS best_idx, max(s) AS best_score FROM c GROUP BY conv_id)"""


def ranked(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("idx"), F.col("text").alias("response")))).alias("candidates"))
    return K.rank_candidates(rows.withColumn("context", F.lit("")), lambda context, response: K.hash_scorer(response))


@query(_RANK + " SELECT conv_id, best_idx, best_score FROM b")
def t1_rank_candidates(spark, sf_dir):
    return ranked(spark, sf_dir).select("conv_id", "best_idx", "best_score")


@query(_RANK + " SELECT best_idx, count(*) AS n, count(*) / (SELECT count(*) FROM b)::DOUBLE AS share, count(*) / (SELECT count(*) FROM b)::DOUBLE > 0.8 AS lopsided FROM b GROUP BY best_idx")
def a20_winner_histogram(spark, sf_dir):
    return K.winner_histogram(ranked(spark, sf_dir))


@query("SELECT conv_id, text AS response FROM conversations WHERE turn = 1")
def k7_single_candidate(spark, sf_dir):
    from corvane.sources.writers import single_candidate

    rows = table(spark, sf_dir, "conversations").where("turn >= 1").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("idx"), F.col("text").alias("response"), F.lit(7).alias("seed"))).alias("candidates"))
    return single_candidate(rows).select("conv_id", "response").where(F.col("response").isNotNull())


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS original_assistant FROM conversations GROUP BY conv_id")
def e2_last_exchange(spark, sf_dir):
    from corvane.plans.texts import conversation_messages

    return conversation_messages(spark, sf_dir).select("conv_id", P.last_exchange(F.col("messages")).alias("x")).select("conv_id", "x.original_assistant")


@query("SELECT event_id FROM events WHERE isnan(value) OR abs(value) > 95")
def r7_unstable_steps(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("margin"), F.col("value")).alias("values"))
    return K.unstable_steps(rows, 95.0).select("event_id")


@query("SELECT conv_id, string_agg(speaker, ',' ORDER BY first) AS speakers FROM (SELECT conv_id, role AS speaker, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def p27_participants(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", "[:\n]", " "))
    said = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(X.participants(F.array_join(F.transform(said, lambda m: m["line"]), "\n")), ",").alias("speakers"))
