"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from corvane.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out), "toxic")
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.quality import fit, grade

    docs = table(spark, sf_dir, "documents")
    return grade(docs, fit(docs, table(spark, sf_dir, "labels"), "quality"))


def op5_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.sharding import shuffle_into_shards

    shuffled = shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return shuffled.selectExpr(
        "doc_id", "CAST(coalesce(octet_length(text), 0) + 1 AS BIGINT) AS size", "crc32(CAST(coalesce(text, '') AS BINARY)) AS text_crc32",
        "'rows' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard",
    )


def op6_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.lm_score import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(table(spark, sf_dir, "conversations"), docs))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.line_dedup import repeated_runs

    return repeated_runs(table(spark, sf_dir, "documents")).drop("key")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.topk import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_ngram_jaccard_join, op3_toxicity, op4_quality_classifier, op5_hypergeometric_sharding, op6_sequence_packing, op7_lm_scoring, op8_token_counts, op9_line_dedup, op10_exact_topk)}
_INTS = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] END) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
        r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, e.y FROM r JOIN e ON r.m = e.x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(m) FROM r WHERE r.d = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)""",
    "op10_exact_topk": f"""
        WITH v AS (SELECT vec_id, {_INTS} AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id,
                     CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
              FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
