"""Hand-made rows with the results worked out by hand."""

import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from corvane.functions import rules as R
from corvane.functions import text as X
from corvane.operators import corpus, evalstats, prefs, sessions


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_strip_and_normalize(spark):
    r = one(
        spark,
        a=X.strip(F.lit(" \n a b \t\x1c")), b=X.collapse(F.lit(" a \n  b ")), c=X.normalize(F.lit("I am 5,5% at https://x.y/7 @Bob  ok")), d=F.length(F.lit("😀a")),
        e=X.token_count(F.lit("it's здесь, ok")),
    )
    assert (r.a, r.b, r.c, r.d) == ("a b", "a b", "i am d% at @ @ ok", 2)
    assert r.e == 6


def test_flatten_variant(spark):
    texts = ['"plain"', '["x ", {"type": "bold", "text": "y"}, {"type": "z"}, 4]', "[]", "7", '"[abc]"', "null"]
    rows = spark.createDataFrame([Row(i=i, j=t) for i, t in enumerate(texts)])
    got = [r.t for r in rows.orderBy("i").select(X.flatten_variant(F.parse_json("j")).alias("t")).collect()]
    assert got == ["plain", "x y", "", "", "[abc]", ""]


def test_cyrillic_case_and_rules(spark):
    assert one(spark, a=F.lit("СПАМ").rlike(r"(?iuU)спам")).a
    pack = R.post_filter(spam="(?iu)купи", profanity="(?iuU)чёрт")
    rows = spark.createDataFrame([Row(i=i, t=t) for i, t in enumerate(["", "abc", "x" * 501, "漢字 text", "КУПИ слона", "I'm sorry, no", "mild text", "вот чёрт возьми"])])
    got = [r.r for r in rows.orderBy("i").select(pack.reason(F.col("t")).alias("r")).collect()]
    assert got == ["empty", "too_short", "too_long", "cjk", "spam", "refusal", "no_profanity", None]


def test_quality_response(spark):
    rows = spark.createDataFrame([Row(i=i, t=t) for i, t in enumerate(["ok", "fine", "😀😀 😀", "/start now", "x" * 301])])
    assert [r.q for r in rows.orderBy("i").select(R.is_quality_response(F.col("t")).alias("q")).collect()] == [False, True, False, False, False]


def test_leak_patterns(spark):
    leaks = R.leak_patterns(("I am {n}% x",), ("cmd",))
    rows = spark.createDataFrame([Row(i=i, t=t) for i, t in enumerate(["i AM 5% X!", "/cmd go", "/cmdx", "2222222", "222222", "ㅤㅤㅤ", "fine"])])
    assert [r.q for r in rows.orderBy("i").select(F.col("t").rlike("|".join(leaks)).alias("q")).collect()] == [True, True, False, True, False, True, False]


def test_split_and_join_lines(spark):
    r = one(spark, a=X.split_lines(F.lit("One two. Three!\"Four\" five... 6")), b=X.split_lines(F.lit(" a \r\n\r b")), c=X.join_lines(F.array(F.lit("a,"), F.lit("b!")), F.lit(True)))
    assert r.a == ["One two", "Three!", '"Four" five... 6']
    assert (r.b, r.c) == (["a", "b"], "a. b")


def test_compact_transcript(spark):
    schema = "m array<struct<role:string,name:string,content:string>>"
    rows = [([("user", "Ann", "hi"), ("assistant", None, "yo"), ("user", "Bo", "well")],), ([("assistant", "Z", "alone")],), ([("user", None, "u")],)]
    got = [r.t for r in spark.createDataFrame(rows, schema).select(X.compact_transcript(F.col("m")).alias("t")).collect()]
    assert got == ["Ann: hi\nassistant: yo\nBo: well", "Z: alone", "user: u"]


def test_merge_and_sessions_order_by_position(spark):
    rows = [(1, 0, "a", 100, "x"), (1, 1, "a", 159, "y"), (1, 2, "a", 219, "z"), (1, 3, "b", 200, "back"), (1, 4, "b", 190, "again"), (1, 5, None, 9000, "n"), (1, 6, None, 9001, None)]
    recs = spark.createDataFrame(rows, "chat int, pos int, from string, ts long, text string")
    turns = sessions.merge_consecutive(recs, ["chat"], 60).orderBy("pos").collect()
    assert [(t.pos, t.end_pos, t.ts, t.text) for t in turns] == [(0, 1, 159, "x\ny"), (2, 2, 219, "z"), (3, 4, 190, "back\nagain"), (5, 6, 9001, "n\n")]
    cut = sessions.split_sessions(sessions.merge_consecutive(recs, ["chat"], 60), ["chat"], 8811, 1).orderBy("pos").collect()
    assert [(t.session_id, t.seq) for t in cut] == [(1, 0), (1, 1), (1, 2), (1, 3)]


def test_role_fold(spark):
    context = [(0, "t", "mine first"), (1, "o", "hey"), (2, "t", "mine"), (3, "t", "more"), (4, "t", "last")]
    rows = spark.createDataFrame([(context, "t", "answer")], "context array<struct<seq:int,from:string,text:string>>, target_from string, response string")
    got = sessions.fold_roles(rows, "sys").first().messages
    assert [(m.role, m.content) for m in got] == [("system", "sys"), ("user", "t: mine first\no: hey"), ("assistant", "mine\nmore"), ("user", "t: last"), ("assistant", "answer")]


def test_split_at_gaps_equals_one_window(spark):
    import random

    r = random.Random(5)
    ts, rows = 0, []
    for i in range(500):
        ts += r.choice([1, 5, 700])
        rows.append((i, f"u{r.randint(0, 1)}", ts, "t"))
    recs = spark.createDataFrame(rows, "pos int, from string, ts long, text string")
    whole = sessions.merge_consecutive(recs.withColumn("k", F.lit(1)), ["k"], 60).select("pos", "end_pos")
    parts = sessions.merge_consecutive(sessions.split_at_gaps(recs, 60, 7), ["part"], 60).select("pos", "end_pos")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_upper_median_and_even_spacing(spark):
    rows = spark.createDataFrame([(v,) for v in (1, 2, 3, 10)], "v int")
    assert evalstats.list_stats(rows, [], F.col("v")).first().upper_median == 3
    runs = spark.createDataFrame([(1, i, 1) for i in range(9)], "k int, pos int, run int")
    assert [r.pos for r in corpus.even_spaced(runs, ["k"], 8).orderBy("pos").collect()] == sorted({round(i * 8 / 7) for i in range(8)})


def test_attempts_and_promotion(spark):
    rows = spark.createDataFrame([("p", 1, "rejected"), ("p", 2, "accepted"), ("p", 3, "accepted"), ("q", 1, "failures"), ("q", 2, "rejected")], "prompt_id string, attempt int, status string")
    got = {(r.prompt_id, r.attempt) for r in prefs.settle_attempts(rows, ["prompt_id"]).collect()}
    assert got == {("p", 2), ("q", 2)}
    retry = spark.createDataFrame([("a_cand1_cand2", None, 0), ("a", None, 1), (None, "text", 2)], "prompt_id string, user_context string, pos int").withColumn("_retry_prompt_id", F.lit(None).cast("string"))
    assert prefs.retry_prompts(retry).count() == 2


def test_sources_and_sinks(spark, tmp_path):
    from corvane.sources import readers, writers

    export = {"name": "c", "messages": [
        {"id": 1, "type": "message", "from": "A", "text": ["x", {"text": "y"}], "date_unixtime": "12"},
        {"id": 2, "type": "service"}, {"id": 3, "type": "message", "text": "z", "date_unixtime": "bad", "photo": ""}, {"id": 4, "type": "message", "from": None, "text": "", "file": "f"}]}
    (tmp_path / "a.json").write_text(json.dumps(export))
    recs = readers.records(readers.chat_export(spark, str(tmp_path / "a.json"))).orderBy("pos").collect()
    assert [(r.id, r["from"], r.text, r.ts, r.has_media) for r in recs] == [(1, "A", "xy", 12, False), (3, "Unknown", "z", 0, False), (4, None, "", 0, True)]
    (tmp_path / "bare.json").write_text(json.dumps(export["messages"]))
    assert readers.records(readers.chat_export(spark, str(tmp_path / "bare.json"))).count() == 3
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("result.json", json.dumps(export))
    assert readers.records(readers.zipped_export(spark, str(tmp_path / "z.zip"))).count() == 3
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert readers.jsonl(spark, str(tmp_path / "l.jsonl"), "a int", tolerant=True).count() == 2
    (tmp_path / "ratings_v1_vs_x_vs_v2.json").write_text('[{"prompt_id": "p", "winner": "A"}, {"prompt_id": "q", "winner": "bestof"}]')
    r = readers.pairwise_ratings(spark, str(tmp_path / "ratings_*.json")).collect()
    assert [(x.version_a, x.version_b, x.winner) for x in r] == [("v1_vs_x", "v2", "A")]
    df = spark.createDataFrame([(2, "б"), (1, None)], "i int, t string")
    writers.write_json_array(df, str(tmp_path / "out"), "i")
    (part,) = (tmp_path / "out").glob("part-*")
    assert json.loads(part.read_text()) == [{"i": 1, "t": None}, {"i": 2, "t": "б"}]
    writers.write_columns(df, str(tmp_path / "t"))
    writers.replace(spark.read.parquet(str(tmp_path / "t")).where("i = 1"), str(tmp_path / "t"))
    assert (spark.read.parquet(str(tmp_path / "t")).count(), spark.read.parquet(str(tmp_path / "t.bak")).count()) == (1, 2)
    assert "| i | t |" in writers.report(df)


def test_streams(spark, tmp_path):
    from corvane.streaming import jobs

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"u": "a", "t": "2024-01-01T00:00:00Z"}\n{"u": "a", "t": "2024-01-01T00:01:00Z"}\n{"u": "a", "t": "2024-01-01T00:02:01Z"}\n')
    events = spark.readStream.schema("u string, t timestamp").json(str(tmp_path / "in"))
    q = jobs.stream_sessions(events, "u", "t", 60).writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("sess").collect()) == [1, 2]
    (tmp_path / "gen").mkdir()
    schema = "prompt_id string, content string, error string"
    for k in range(2):  # a batch holds two good rows of one prompt, of which one stays; the second run sees it again and skips it
        (tmp_path / f"gen/{k}.json").write_text('{"prompt_id": "p", "content": "a good answer"}\n{"prompt_id": "p", "content": "another good one"}\n{"prompt_id": "r%d", "content": "no"}\n' % k)
        source = spark.readStream.schema(schema).json(str(tmp_path / "gen"))
        jobs.stream_routed(source, R.post_filter(), str(tmp_path / "routed"), str(tmp_path / "cp")).awaitTermination(60)
    rows = spark.read.json(str(tmp_path / "routed"))
    assert {(r.status, r["count"]) for r in rows.groupBy("status").count().collect()} == {("accepted", 1), ("rejected", 2)}
