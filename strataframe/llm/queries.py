"""The registered queries of this package: each operator over its whole table with its production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import (
    bpe, bytecnn, chat, hardnegatives, idstore, lexicalscan, matroska, packing, tokengroups, toxicity, urlrules, vamana, wrappers)
from strataframe.llm.labelled import remainder
from strataframe.session import fresh_path
from strataframe.sources.tables import read_table

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SEQUENCE = 2048


def scored(rows: DataFrame, fold: int, rest: int, threshold: float) -> DataFrame:
    held = F.coalesce(remainder(F.col("doc_id"), fold) == rest, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    model = toxicity.fit_from(docs, read_table(spark, sf, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return scored(toxicity.score_documents(docs, model), 3, 1, 0.7)


def op2_tokengroups(spark: SparkSession, sf: str) -> DataFrame:
    found = tokengroups.similar_components(read_table(spark, sf, "documents"), words=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op3_bpe(spark: SparkSession, sf: str, path: str = WORDS) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf, "documents"), path)


def op4_matroska(spark: SparkSession, sf: str) -> DataFrame:
    return matroska.media_digests(matroska.store_media(read_table(spark, sf, "documents")))


def op5_wrappers(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.extract_main(read_table(spark, sf, "pages"))


def op6_packing(spark: SparkSession, sf: str, path: str = BYTES) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf, "documents"), path, SEQUENCE, end_id=0)


def op7_chat(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversation_digests(chat.format_conversations(turns))


def op8_planes(spark: SparkSession, sf: str, path: str = WORDS) -> DataFrame:
    folder = fresh_path(spark, "idstore")
    idstore.write_store(read_table(spark, sf, "documents"), folder, path, keeps_space=False, end_id=2)
    return idstore.read_documents(spark, folder)


def op9_vamana(spark: SparkSession, sf: str) -> DataFrame:
    return vamana.nearest(read_table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_bytecnn(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    net = bytecnn.fit_from(docs, read_table(spark, sf, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return scored(bytecnn.score_documents(docs, net), 5, 0, 0.3)


def op11_strassen(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(read_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_ahocorasick(spark: SparkSession, sf: str) -> DataFrame:
    return lexicalscan.search(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"), k=10)


def op13_urlrules(spark: SparkSession, sf: str) -> DataFrame:
    listed = spark.sql("SELECT * FROM VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), "
                       "('com', '/fr/', 'allow'), ('com', '/de/', 'block') AS t(host, path, verdict)")
    return urlrules.judge(read_table(spark, sf, "pages"), listed)


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_tokengroups, op3_bpe, op4_matroska, op5_wrappers, op6_packing, op7_chat,
    op8_planes, op9_vamana, op10_bytecnn, op11_strassen, op12_ahocorasick, op13_urlrules)}

ORACLES = {
    "op11_strassen": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          [floor(x::DOUBLE * 256) FOR x IN embedding] AS v
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                     AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.label, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
        p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE own = label
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id,
               row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
               s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> p.own
          AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        QUALIFY rank <= 3""",
    "op12_ahocorasick": r"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(
                     translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        c AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS l FROM t),
        d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
                     translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
              FROM tf, c GROUP BY term, docs),
        s AS (SELECT item_id, tf.doc_id,
                     sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // l))))::BIGINT AS score
              FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d ON d.doc_id = tf.doc_id, c GROUP BY item_id, tf.doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op13_urlrules": """
        WITH r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS t(h, p, v)),
        a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
        u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
        l AS (SELECT host, path, max(struct_pack(n := length(h || p), h := length(h), rule := h || p, v := v)) AS best
              FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
              GROUP BY host, path)
        SELECT page_id, u.host, u.path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict
        FROM u LEFT JOIN l ON u.host = l.host AND u.path = l.path""",
}
