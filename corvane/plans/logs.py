"""Queries over ordered logs: turns, sessions, windows, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import sessions as S
from corvane.plans.registry import query, table

HOURS = 3600


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: the user is the chat, the type both sender and text, seconds rounded down."""
    seconds = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"
    return table(spark, sf_dir, "events").selectExpr("user_id", "event_id AS pos", f"{seconds} AS ts", "event_type AS from", "event_type AS text")


_LOG = """WITH log AS (SELECT user_id, event_id AS pos, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS sender, event_type AS text FROM events)"""


def _turns_sql(keys: str, gap: int, sender: str = "sender") -> str:
    return f"""{_LOG},
    m AS (SELECT *, CASE WHEN lag({sender}) OVER w = {sender} AND ts - lag(ts) OVER w < {gap} THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (PARTITION BY {keys} ORDER BY pos)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY pos) AS turn_no FROM m),
    turns AS (SELECT user_id, turn_no, min(pos) AS pos, max(pos) AS end_pos, arg_max(ts, pos) AS ts, count(*) AS n_merged, string_agg(text, chr(10) ORDER BY pos) AS text, arg_min(sender, pos) AS sender
              FROM (SELECT * REPLACE ({'user_id' if keys == 'user_id' else '0'} AS user_id) FROM i) GROUP BY user_id, turn_no)"""


@query(_turns_sql("user_id", 6 * HOURS) + " SELECT user_id, CAST(turn_no AS BIGINT) AS turn_no, pos, end_pos, ts, n_merged, text, sender FROM turns")
def w1_merge_consecutive(spark, sf_dir):
    turns = S.merge_consecutive(event_log(spark, sf_dir), ["user_id"], 6 * HOURS)
    return turns.select("user_id", "turn_no", "pos", "end_pos", "ts", "n_merged", "text", F.col("from").alias("sender"))


@query(
    f"""{_LOG},
    m AS (SELECT *, CASE WHEN lag(user_id) OVER w = user_id AND ts - lag(ts) OVER w < 60 THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (ORDER BY pos)),
    i AS (SELECT *, sum(new) OVER (ORDER BY pos) AS turn_no FROM m)
    SELECT min(pos) AS pos, max(pos) AS end_pos, count(*) AS n_merged, string_agg(text, chr(10) ORDER BY pos) AS text FROM i GROUP BY turn_no"""
)
def w1_merge_one_log(spark, sf_dir):
    """One log of all users, walked in ranges, so that no task sees all of it."""
    return S.merge_consecutive_of_log(event_log(spark, sf_dir), 60, "user_id").select("pos", "end_pos", "n_merged", "text")


@query(
    f"""{_LOG},
    m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY pos) <= 600 THEN 0 ELSE 1 END AS new FROM log),
    i AS (SELECT *, sum(new) OVER (ORDER BY pos) AS s FROM m),
    n AS (SELECT *, count(*) OVER (PARTITION BY s) AS session_size, row_number() OVER (PARTITION BY s ORDER BY pos) - 1 AS seq, min(pos) OVER (PARTITION BY s) AS session_start FROM i)
    SELECT session_start, seq, pos, user_id, session_size FROM n WHERE session_size >= 5"""
)
def w2_sessionize(spark, sf_dir):
    out = S.split_sessions_of_log(event_log(spark, sf_dir), 600, 5)
    return out.select("session_start", F.col("seq").cast("long").alias("seq"), "pos", "user_id", "session_size")


_SESSIONS = (
    _turns_sql("user_id", HOURS)
    + f""", sm AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY pos) <= {24 * HOURS} THEN 0 ELSE 1 END AS snew FROM turns),
    si AS (SELECT *, sum(snew) OVER (PARTITION BY user_id ORDER BY pos) AS session_id FROM sm),
    ss AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY pos) - 1 AS seq, count(*) OVER (PARTITION BY user_id, session_id) AS session_size FROM si),
    s AS (SELECT * FROM ss WHERE session_size >= 4)"""
)


def event_sessions(spark, sf_dir):
    turns = S.merge_consecutive(event_log(spark, sf_dir), ["user_id"], HOURS)
    return S.split_sessions(turns, ["user_id"], 24 * HOURS, 4)


@query(
    _SESSIONS
    + """ SELECT a.user_id, CAST(a.session_id AS BIGINT) AS session_id, a.seq AS target_seq, a.sender AS target_from, CAST(count(*) AS INTEGER) AS n_context,
    string_agg(b.sender || ': ' || b.text, chr(10) ORDER BY b.seq) AS context_text, a.text AS target_text
    FROM s a JOIN s b ON a.user_id = b.user_id AND a.session_id = b.session_id AND b.seq BETWEEN a.seq - 5 AND a.seq - 1 WHERE a.seq >= 3 GROUP BY ALL"""
)
def w3_flat_windows(spark, sf_dir):
    """Events to turns to sessions to windows of context and target."""
    out = S.flat_windows(event_sessions(spark, sf_dir), ["user_id", "session_id"], 5, 3)
    return out.withColumn("target_seq", F.col("target_seq").cast("long"))


@query(
    _SESSIONS
    + """, w AS (SELECT * FROM s, (VALUES (3), (6)) v(win)), x AS (SELECT *, greatest(0, seq - win) AS start FROM w WHERE seq >= 2 AND length(text) BETWEEN 3 AND 300),
    y AS (SELECT *, lag(start) OVER (PARTITION BY user_id, session_id, seq ORDER BY win) AS prev FROM x)
    SELECT user_id, CAST(session_id AS BIGINT) AS session_id, seq AS target_seq, CAST(win AS INTEGER) AS win, start, CAST(seq - start AS INTEGER) AS n_context FROM y WHERE (prev IS NULL OR prev <> start) AND seq - start >= 2"""
)
def w4_multiturn_windows(spark, sf_dir):
    out = S.multiturn_windows(event_sessions(spark, sf_dir), ["user_id", "session_id"], (3, 6), 2)
    return out.select("user_id", "session_id", F.col("target_seq").cast("long").alias("target_seq"), F.col("window").alias("win"), F.col("start").cast("long").alias("start"), "n_context")


@query(
    _SESSIONS
    + """, c AS (SELECT a.user_id, a.session_id, a.seq AS target_seq, a.sender AS target, a.text AS response, b.seq, b.sender, b.text,
          row_number() OVER (PARTITION BY a.user_id, a.session_id, a.seq ORDER BY b.seq) AS j, count(*) OVER (PARTITION BY a.user_id, a.session_id, a.seq) AS n
          FROM s a JOIN s b ON a.user_id = b.user_id AND a.session_id = b.session_id AND b.seq BETWEEN greatest(0, a.seq - 6) AND a.seq - 1 WHERE a.seq >= 2 AND length(a.text) BETWEEN 3 AND 300),
    r AS (SELECT *, CASE WHEN sender = target AND j > 1 AND j < n THEN 'assistant' ELSE 'user' END AS role FROM c),
    g AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY user_id, session_id, target_seq ORDER BY j)),
    h AS (SELECT *, sum(new) OVER (PARTITION BY user_id, session_id, target_seq ORDER BY j) AS grp FROM g),
    k AS (SELECT user_id, session_id, target_seq, grp, response, any_value(role) AS role, string_agg(CASE WHEN role = 'assistant' THEN text ELSE sender || ': ' || text END, chr(10) ORDER BY j) AS content FROM h GROUP BY user_id, session_id, target_seq, grp, response)
    SELECT user_id, CAST(session_id AS BIGINT) AS session_id, target_seq, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>', chr(10) ORDER BY grp) || chr(10) || '<|im_start|>assistant' || chr(10) || response || '<|im_end|>' AS chat
    FROM k GROUP BY user_id, session_id, target_seq, response"""
)
def w5_role_fold(spark, sf_dir):
    windows = S.multiturn_windows(event_sessions(spark, sf_dir), ["user_id", "session_id"], (6,), 2)
    return S.fold_roles(windows).select("user_id", "session_id", F.col("target_seq").cast("long").alias("target_seq"), X.render_chat(F.col("messages")).alias("chat"))


@query(
    _SESSIONS
    + """, c AS (SELECT a.user_id, a.session_id, a.seq AS target_seq, b.seq AS seq, b.sender, CASE WHEN b.sender = a.sender AND b.seq > greatest(0, a.seq - 6) THEN 'assistant' ELSE 'user' END AS role, b.text
          FROM s a JOIN s b ON a.user_id = b.user_id AND a.session_id = b.session_id AND b.seq BETWEEN greatest(0, a.seq - 6) AND a.seq WHERE a.seq >= 2 AND length(a.text) BETWEEN 3 AND 300),
    g AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY user_id, session_id, target_seq ORDER BY seq)),
    h AS (SELECT *, sum(new) OVER (PARTITION BY user_id, session_id, target_seq ORDER BY seq) AS grp FROM g),
    k AS (SELECT user_id, session_id, target_seq, grp, any_value(role) AS role, string_agg(sender || ' ' || text, chr(10) ORDER BY seq) AS content FROM h GROUP BY user_id, session_id, target_seq, grp)
    SELECT user_id, CAST(session_id AS BIGINT) AS session_id, target_seq, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>', chr(10) ORDER BY grp) AS chat FROM k GROUP BY user_id, session_id, target_seq"""
)
def w6_token_fold(spark, sf_dir):
    windows = S.multiturn_windows(event_sessions(spark, sf_dir), ["user_id", "session_id"], (6,), 2)
    return S.fold_roles(windows, tokens=True).select("user_id", "session_id", F.col("target_seq").cast("long").alias("target_seq"), X.render_chat(F.col("messages")).alias("chat"))


@query(
    _SESSIONS
    + """, f AS (SELECT *, min(seq) OVER (PARTITION BY user_id, session_id, sender) AS first FROM s)
    SELECT user_id, CAST(session_id AS BIGINT) AS session_id, seq, '<user_' || dense_rank() OVER (PARTITION BY user_id, session_id ORDER BY first) || '>' AS from_token FROM f"""
)
def p25_anonymize(spark, sf_dir):
    out = S.anonymize(event_sessions(spark, sf_dir), ["user_id", "session_id"])
    return out.select("user_id", "session_id", F.col("seq").cast("long").alias("seq"), "from_token")


@query(
    """SELECT user_id, min(ts) AS first_ts, count(*) AS n_before FROM
    (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events) e
    WHERE ts < coalesce((SELECT min(CAST(floor(epoch(ts)) AS BIGINT)) FROM events WHERE event_type = 'error'), 1e18) GROUP BY user_id"""
)
def f6_before_first_mark(spark, sf_dir):
    from corvane.functions.rules import before_first

    log = event_log(spark, sf_dir)
    early, _ = before_first(log, log.where("from = 'error'"))
    return early.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n_before"))
