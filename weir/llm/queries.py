"""The numbered queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import bpe, byte_bpe, exact_dedup, hard_negatives, jaccard_join, language, lexical, lm_score, mtree, packing, quality, sharding, url_filter
from weir.llm.common import held_out, materialise, table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is: in the folder that TOKENIZER_DIR names, else where the installed files are."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return str(Path(folder) / name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = mtree.usable(table(spark, sf_dir, "embeddings"))
    return mtree.top_k(data, data.filter("vec_id % 100 = 0"), 10)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards_by_bytes(table(spark, sf_dir, "documents"), 24, 8)
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language.predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.*")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.json")
    found = packing.pack(table(spark, sf_dir, "documents"), lambda: packing.byte_bpe(path), 2048, 1)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality.score(F.col("text"), trees).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= quality.KEEP).cast("int"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    data = materialise(hard_negatives.usable(table(spark, sf_dir, "embeddings"), 256, F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))
    return hard_negatives.mine(data, data.filter("vec_id % 100 = 0"), 5, 10, 30, 90)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = byte_bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select("doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_top_k, op2_bpe, op3_sharding, op4_language, op5_url_filter, op6_jaccard_join, op7_lm_score, op8_packing, op9_quality, op10_exact_dedup, op11_hard_negatives, op12_byte_bpe, op13_lexical, pipeline)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_TERMS = _WORDS.replace(r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

ORACLES = {
    "op1_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                   FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
             s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
             e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             c(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.doc_id)
        SELECT c.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id""",
    "op7_lm_score": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
             p AS (SELECT r, unnest(w) AS w, unnest(list_concat([NULL], w[1:len(w) - 1])) AS v FROM d WHERE len(w) > 0),
             u AS (SELECT w, count(*) AS n FROM p GROUP BY 1), b AS (SELECT v, w, count(*) AS n FROM p GROUP BY 1, 2),
             f AS (SELECT v, count(*) AS n FROM p GROUP BY 1), t AS (SELECT count(*) AS n FROM p),
             s AS (SELECT r, CASE WHEN b.n >= 2 THEN ln(b.n) - ln(f.n) ELSE ln(0.4) + ln(u.n) - ln(t.n) END AS s, CASE WHEN b.n >= 2 THEN 0 ELSE 1 END AS back
                   FROM p JOIN b ON b.v IS NOT DISTINCT FROM p.v AND b.w = p.w JOIN f ON f.v IS NOT DISTINCT FROM p.v JOIN u ON u.w = p.w, t),
             a AS (SELECT r, sum(s) AS s, sum(back) AS back FROM s GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(back, 0) AS BIGINT) AS n_backoff, round(coalesce(s, 0), 4) AS log_score, CASE WHEN len(w) > 0 THEN round(s / len(w), 4) END AS mean_log_score
        FROM d LEFT JOIN a ON a.r = d.r""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, CAST(list_sum(list_transform(list_zip(a.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                   FROM v a JOIN v d ON a.vec_id <> d.vec_id WHERE a.vec_id % 100 = 0),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
             r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
                   FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, place FROM r
        JOIN (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY positive_score DESC, positive_id) AS INTEGER) AS place FROM p) USING (anchor_id, positive_id)
        WHERE rank <= 10""",
    "op13_lexical": f"""
        WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents), n AS (SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0),
             g AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM n),
             f AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS t FROM d) GROUP BY 1, 2),
             q AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
             w AS (SELECT t, CAST(floor(1000 * ln((2 * g.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY t, g.n),
             s AS (SELECT item_id, f.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n.n * g.n) // g.l)))) AS BIGINT) AS score
                   FROM q JOIN f USING (t) JOIN w USING (t) JOIN n ON n.doc_id = f.doc_id, g GROUP BY 1, 2)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
}
