"""Queries of text functions, rule packs and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import rules as R
from corvane.functions import text as X
from corvane.plans.registry import query, table

_CHAT = "string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn)"


def conversation_messages(spark, sf_dir):
    """(conv_id, messages) of the conversations, in order of turn."""
    rows = table(spark, sf_dir, "conversations")
    said = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return rows.groupBy("conv_id").agg(F.transform(said, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


@query(f"SELECT conv_id, {_CHAT} AS chat, {_CHAT.replace('chr(10) ORDER', chr(39) + chr(39) + ' ORDER').replace('|im_end|>' + chr(39), '|im_end|>' + chr(39) + ' || chr(10)')} AS chat_lines FROM conversations GROUP BY conv_id")
def p4_render_chat(spark, sf_dir):
    return conversation_messages(spark, sf_dir).select("conv_id", X.render_chat(F.col("messages")).alias("chat"), X.render_chat_lines(F.col("messages")).alias("chat_lines"))


@query("""SELECT conv_id, md5(string_agg(role || ':' || text, '|||' ORDER BY turn)) AS message_key FROM conversations GROUP BY conv_id""")
def p16_message_key(spark, sf_dir):
    return conversation_messages(spark, sf_dir).select("conv_id", X.message_key(F.col("messages")).alias("message_key"))


@query(
    """SELECT conv_id, '<|im_start|>user' || chr(10) || string_agg(text, chr(10) ORDER BY turn) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || 'ok' || '<|im_end|>' AS lines_form,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) || chr(10) || '<|im_start|>assistant' || chr(10) || 'ok' || '<|im_end|>' AS messages_form,
    '<start_of_turn>user' || chr(10) || 'Be brief.' || chr(10) || chr(10) || string_agg(text, chr(10) ORDER BY turn) || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS folded_form
    FROM conversations GROUP BY conv_id"""
)
def p5_serialize(spark, sf_dir):
    from pyspark.sql.types import ArrayType, StringType

    texts = F.transform("messages", lambda m: m["content"])
    return conversation_messages(spark, sf_dir).select(
        "conv_id", X.serialize(texts, F.lit("ok"), ArrayType(StringType())).alias("lines_form"), X.serialize(F.col("messages"), F.lit("ok"), None).alias("messages_form"),
        X.render_folded_system(F.lit("Be brief."), texts).alias("folded_form"),
    )


@query(
    """SELECT conv_id, '<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) ||
    string_agg('<|im_start|>' || role || chr(10) || CASE WHEN role = 'user' AND turn % 3 = 0 THEN 'u' || turn || ': ' || trim(text) ELSE trim(text) END || '<|im_end|>', chr(10) ORDER BY turn) FILTER (role <> 'system')
    || chr(10) || '<|im_start|>assistant' || chr(10) AS request,
    string_agg(CASE WHEN turn % 3 = 0 THEN 'u' || turn ELSE role END || ': ' || text, chr(10) ORDER BY turn) AS everyone,
    coalesce(string_agg(CASE WHEN turn % 3 = 0 THEN 'u' || turn ELSE role END || ': ' || text, chr(10) ORDER BY turn) FILTER (role <> 'assistant'), '') AS people
    FROM conversations GROUP BY conv_id"""
)
def p8_requests_and_transcripts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("name", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("u"), "turn")))
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "name", F.col("text").alias("content"))))
    rows = rows.groupBy("conv_id").agg(said.alias("m"))
    return rows.select("conv_id", X.render_request(F.lit("Be brief."), F.col("m")).alias("request"), X.transcript(F.col("m")).alias("everyone"), X.transcript(F.col("m"), bots=False).alias("people"))


@query(
    r"""WITH l AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Assistant: ' || text WHEN 1 THEN 'name: ' || text WHEN 2 THEN 'Ann B: ' || text WHEN 3 THEN 'bot:  name: x: ' || text ELSE text END AS c FROM conversations),
    a AS (SELECT *, trim(regexp_replace(c, '^\s*(?:assistant|bot)\s*:\s*', '', 'is')) AS u FROM l), b AS (SELECT *, CASE WHEN u <> '' THEN u ELSE c END AS c1, u <> c AND u <> '' AS ch1 FROM a),
    d AS (SELECT *, trim(regexp_replace(c1, '^\s*name\s*:\s*', '', 'is')) AS u2 FROM b), e AS (SELECT *, CASE WHEN u2 <> '' THEN u2 ELSE c1 END AS c2, u2 <> c1 AND u2 <> '' AS ch2 FROM d),
    f AS (SELECT *, trim(regexp_replace(c2, '^\s*[A-ZА-ЯЁ][^:\n]{1,40}:\s+', '', 's')) AS u3 FROM e)
    SELECT conv_id, turn, CASE WHEN u3 <> '' THEN u3 ELSE c2 END AS cleaned, concat_ws(',', CASE WHEN ch1 THEN 'bot_prefix' END, CASE WHEN ch2 THEN 'name_prefix' END, CASE WHEN u3 <> '' AND u3 <> c2 THEN 'speaker_prefix' END) AS changes FROM f"""
)
def p11_normalize_response(spark, sf_dir):
    c = F.expr("CASE turn % 5 WHEN 0 THEN 'Assistant: ' || text WHEN 1 THEN 'name: ' || text WHEN 2 THEN 'Ann B: ' || text WHEN 3 THEN 'bot:  name: x: ' || text ELSE text END")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalize_response(c).alias("r"))
    return rows.select("conv_id", "turn", F.col("r.cleaned").alias("cleaned"), F.array_join("r.changes", ",").alias("changes"))


@query(
    r"""WITH l AS (SELECT conv_id, turn, '<bot> <think>' || role || chr(10) || 'x</think>  ' || text || '<|im_end|> <|im_start|>user' || chr(10) || text AS c FROM conversations),
    m AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(c, '<think>.*?</think>\s*', '', 'gs'), '<\|im_start\|>.*', '', 'gs'), '<\|im_end\|>', '', 'g') AS d FROM l)
    SELECT conv_id, turn, trim(regexp_replace(trim(d), '^<bot>\s*', '')) AS stripped, trim(regexp_replace(d, '^\s*(?:<bot>|bot:|name:)\s*', '', 'i')) AS cleaned FROM m"""
)
def p9_strip_tokens(spark, sf_dir):
    c = F.expr("'<bot> <think>' || role || '\n' || 'x</think>  ' || text || '<|im_end|> <|im_start|>user' || '\n' || text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.strip_tokens(c).alias("stripped"), X.clean_response(c).alias("cleaned"))


@query(
    r"""SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '\d+(?:[.,]\d+)?', 'D', 'g'), 'https?://\S+|t\.me/\S+|@[\w\pL\pN]+', '@', 'g'), '\s+', ' ', 'g'))) AS template,
    CAST(length(text) AS BIGINT) AS n_chars, length(text) / 3.0 AS estimate,
    CASE WHEN length(replace(text, chr(10), ' | ')) > 80 THEN substr(replace(text, chr(10), ' | '), 1, 79) || '…' ELSE replace(text, chr(10), ' | ') END AS preview,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, concat_ws('::', CAST(doc_id AS VARCHAR), source, '1') AS uid FROM documents
"""
)
def p3_normalize_and_small_functions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    t = F.col("text")
    return docs.select(
        "doc_id", X.normalize(t).alias("template"), F.length(t).cast("long").alias("n_chars"), X.token_estimate(t).alias("estimate"), X.preview(t).alias("preview"),
        X.escape_html(t).alias("escaped"), X.uid(F.col("doc_id").cast("string"), F.col("source"), F.lit(1)).alias("uid"),
    )


@query(
    """SELECT item_id, (42 + CAST('0x' || substr(md5('prompt_' || item_id), 1, 8) AS BIGINT)) % 2147483647 AS seed,
    list_extract(['a', 'b', 'c'], CAST(1 + CAST('0x' || substr(md5('prompt_' || item_id), 1, 8) AS BIGINT) % 3 AS INTEGER)) AS choice FROM benchmark"""
)
def p15_prompt_seed(spark, sf_dir):
    key = F.concat(F.lit("prompt_"), "item_id")
    return table(spark, sf_dir, "benchmark").select("item_id", X.prompt_seed(42, key).alias("seed"), X.choose(F.array(*map(F.lit, "abc")), key).alias("choice"))


@query("SELECT conv_id, turn, text AS flat, '' AS other FROM conversations")
def p1_flatten_text(spark, sf_dir):
    """Texts given as a VARIANT string, or as a list of strings and {text} parts, come out whole."""
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    listed = F.concat(F.lit("["), F.to_json(F.struct(head.alias("text"))), F.lit(', {"type": "custom"}, 7, '), F.to_json(F.array(tail)).substr(F.lit(2), F.length(F.to_json(F.array(tail))) - 2), F.lit("]"))
    plain = F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2)
    v = F.parse_json(F.when(F.col("turn") % 2 == 0, listed).otherwise(plain))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.flatten_variant(v).alias("flat"), X.flatten_variant(F.parse_json(F.lit('{"text": 5}'))).alias("other"))


_BLANK = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TRIM = lambda x: f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


@query(
    rf"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\r?\n|\r'), lambda x: {_TRIM("x")}), lambda x: x <> '') AS lines FROM documents),
    s AS (SELECT doc_id, text, lines, list_filter(string_split(regexp_replace(text, '([.!?]){_BLANK}*([А-ЯA-Z«"])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {_TRIM("x")} <> '') AS parts FROM l)
    SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines,
    array_to_string(CASE WHEN len(lines) > 1 THEN lines ELSE list_filter(list_transform(parts, lambda x: regexp_replace({_TRIM("x")}, '\.+$', '')), lambda x: length(x) > 1) END, '|') AS lines FROM s"""
)
def p12_split_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"), F.array_join(X.split_lines(F.col("text")), "|").alias("lines"))


@query(
    """WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS ids FROM conversations),
    u AS (SELECT conv_id, turn, ids, unnest(range(1, len(ids))) AS i FROM w), m AS (SELECT conv_id, turn, max(i) AS at FROM u WHERE ids[i] = 2 AND ids[i + 1] = 4 GROUP BY conv_id, turn)
    SELECT w.conv_id, w.turn, CAST(len(ids) AS INTEGER) AS n, CAST(CASE WHEN m.at IS NULL THEN len(ids) ELSE m.at + 1 END AS INTEGER) AS masked,
    CAST(coalesce(list_sum(ids[CASE WHEN m.at IS NULL THEN len(ids) ELSE m.at + 1 END + 1:]), 0) AS BIGINT) AS label_sum FROM w LEFT JOIN m ON w.conv_id = m.conv_id AND w.turn = m.turn"""
)
def p28_label_mask(spark, sf_dir):
    ids = F.transform(F.split("text", " "), F.length)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("ids")).withColumn("labels", X.label_mask(F.col("ids"), [2, 4]))
    kept = F.filter("labels", lambda x: x >= 0)
    return rows.select("conv_id", "turn", F.size("ids").alias("n"), (F.size("ids") - F.size(kept)).alias("masked"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("label_sum"))


@query(
    r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS t FROM conversations)
    SELECT conv_id, turn, array_to_string(t[greatest(len(t) - 9, 1):], ' ') AS ends, array_to_string(t[1:10], ' ') AS starts FROM w"""
)
def p32_truncate_tokens(spark, sf_dir):
    t = X.words(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.truncate_tokens(t, 10), " ").alias("ends"), F.array_join(X.truncate_tokens(t, 10, "start"), " ").alias("starts"))


@query()
def p17_sequence_similarity(spark, sf_dir):
    """Each benchmark item with the next one."""
    from corvane.functions.similarity import sequence_similarity

    b = table(spark, sf_dir, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(other, "item_id").select("item_id", F.round(sequence_similarity(F.col("text"), F.col("other")), 6).alias("ratio"))


@query("SELECT conv_id, turn FROM conversations WHERE length(text) BETWEEN 3 AND 300 AND NOT regexp_matches(text, '^/\\w') AND regexp_matches(text, '[A-Za-z0-9,.]')")
def f7_quality_filter(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(R.is_quality_response(F.col("text"))).select("conv_id", "turn")


@query(
    r"""WITH t AS (SELECT CASE doc_id % 11 WHEN 1 THEN 'Ну ИЗВИНИ, ' || left(text, 100) WHEN 2 THEN 'Я, как  языковая модель' ELSE text END AS text FROM documents)
    SELECT coalesce(CASE WHEN text = '' THEN 'empty' WHEN length(text) < 5 THEN 'too_short' WHEN length(text) > 500 THEN 'too_long' WHEN regexp_matches(text, '[一-鿿㐀-䶿]') THEN 'cjk'
    WHEN regexp_matches(text, 'MIT License|[0-9]{4}') THEN 'spam' WHEN regexp_matches(text, '(извини|i\s+cannot|i''?m\s+sorry|как\s+ии|как\s+(?:языковая|ai|искусственный)|language\s+model|i''?m\s+(?:an?|just)\s+a)', 'i') THEN 'refusal' END, 'accepted') AS reason, count(*) AS n FROM t GROUP BY 1"""
)
def f8_post_filter_reasons(spark, sf_dir):
    reason = R.post_filter(spam="MIT License|[0-9]{4}").reason(F.col("text"))
    docs = table(spark, sf_dir, "documents").selectExpr("CASE doc_id % 11 WHEN 1 THEN 'Ну ИЗВИНИ, ' || left(text, 100) WHEN 2 THEN 'Я, как  языковая модель' ELSE text END AS text")
    return docs.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, bool_or(regexp_matches(text, '[0-9]')) AS any_digit, coalesce(bool_or(regexp_matches(text, '[0-9]')) FILTER (role = 'assistant'), false) AS assistant_digit FROM conversations GROUP BY conv_id""")
def f11_message_filters(spark, sf_dir):
    return conversation_messages(spark, sf_dir).select("conv_id", R.any_message(F.col("messages"), "[0-9]").alias("any_digit"), R.any_assistant(F.col("messages"), "[0-9]").alias("assistant_digit"))


@query(
    """WITH r AS (SELECT conv_id * 1000 + turn AS id, role AS sender, text, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 - turn % 3 END AS reply_to FROM conversations)
    SELECT id, sender FROM r WHERE trim(text) <> '' AND sender <> 'assistant' AND NOT contains(lower(text), 'zzq') AND NOT regexp_matches(text, '[0-9]{5}') AND (reply_to IS NULL OR reply_to NOT IN (SELECT id FROM r WHERE sender = 'assistant'))"""
)
def f3_chat_filter(spark, sf_dir):
    reply = "CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 - turn % 3 END AS reply_to"
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS id", "role AS from", "text", reply)
    return R.chat_filter(rows, ["assistant"], ["zzq"], ["[0-9]{5}"]).select("id", F.col("from").alias("sender"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '/[^?]*[0-9].*$') AND url LIKE 'http%/%1%'")
def f18_glob_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("path", F.col("url"))
    return R.matching_paths(pages, ["http*/*1*"]).where(F.col("url").rlike("/[^?]*[0-9].*$")).select("page_id", "url")


#: The SQL of the artifact flags.
FLAGS = {
    "speaker_prefix": rf"regexp_matches(text, '^[А-ЯA-ZЁ][^:\n]{{1,40}}:{_BLANK}+')",
    "bot_identity": "regexp_matches(text, 'thebot')",
    "markdown": rf"(contains(text, '```') OR contains(text, '**') OR regexp_matches(text, '(?:^|[\n\r\x{{85}}\x{{2028}}\x{{2029}}]){_BLANK}*[-*]{_BLANK}+'))",
    "emoji": r"regexp_matches(text, '[\x{1F300}-\x{1FAFF}]')",
    "too_short": f"length({_TRIM('text')}) < 5",
    "too_long_300": "length(text) > 300",
}


@query("SELECT " + ", ".join(f"CAST(count_if({v}) AS BIGINT) AS {k}" for k, v in FLAGS.items()) + " FROM documents")
def f19_artifact_flags(spark, sf_dir):
    flags = R.artifact_flags(F.col("text"), "thebot")
    return table(spark, sf_dir, "documents").agg(*(F.count_if(v).alias(k) for k, v in flags.items()))
