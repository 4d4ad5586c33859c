"""Registered queries of the training-data operators over the whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilframe.llm import (chat_format, common, decontaminate, exact_dedup, hard_negatives, jaccard_join, language_id, license_scan, line_dedup,
                            packing, record_files, secret_scan, toxicity, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.line_report(read(spark, sf, "documents"), **line_dedup.FUZZY)


@query
def op2_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf, "documents"), k=4, num=85, den=100)


@query
def op3_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: whether a benchmark item leaks into it, the largest coverage, and the leaked items."""
    found = decontaminate.annotate(read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "benchmark"))
    return found.select("row.doc_id", (F.size("items") > 0).alias("contaminated"), "coverage", F.size("items").cast("long").alias("n_items"),
                        F.array_join("items", ",").alias("items"))


@query
def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf, "documents"))


ORACLES["op4_exact_dedup"] = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t"""


@query
def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_novel")


@query
def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    learned = language_id.prototypes(docs.where(~held_out()))
    return language_id.predict(docs, learned, [F.col("doc_id"), held_out().alias("held_out")])


@query
def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    done = chat_format.format_chats(turns.unionByName(own))
    back = done.select("conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"),
                       chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(c: str) -> str:
    out = f"replace({c}, '\\', '\\0')"
    for k, s in enumerate(chat_format.CONTROL, 1):
        out = f"replace({out}, '{s}', '\\{k}')"
    return out


ORACLES["op8_chat_format"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace({_sql_escape("role")}, chr(10), '\\n') AS er, {_sql_escape("text")} AS et FROM t),
w AS (SELECT *, lag(er) OVER (PARTITION BY conv_id ORDER BY turn, er, et) AS before FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, er, et)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, er, et) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(et) + CASE WHEN before = er THEN {len(chat_format.SEP)}
                ELSE {len(chat_format.OPEN) + len(chat_format.CLOSE) + 2} + length(er) END) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id"""


@query
def op9_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan(read(spark, sf, "documents"))


def _sql_canonical(c: str) -> str:
    out = f"regexp_replace({c}, '(?im)^[^a-z0-9\\n]*(copyright\\b|\\(c\\)|©)[^\\n]*(19|20)[0-9][0-9][^\\n]*$', ' ', 'g')"
    out = f"(' ' || regexp_replace(lower({out}), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' ')"
    for a, b in license_scan.SPELLINGS:
        out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLES["op9_license_scan"] = f"""
WITH k(license_id, body) AS (VALUES {', '.join(f"({_literal(i)}, {_literal(b)})" for i, _, b in license_scan.KNOWN)}),
known AS (SELECT {_sql_canonical('body')} AS c, min(license_id) AS license_id FROM k GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
whole AS (SELECT rid, doc_id, t, {_sql_canonical('t')} AS c FROM d),
line AS (SELECT rid, {_sql_canonical('l')} AS c FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)),
hit AS (SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n_notices FROM line JOIN known USING (c) GROUP BY rid)
SELECT doc_id, license_id, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM whole LEFT JOIN known USING (c) LEFT JOIN hit USING (rid)"""


def toxicity_model(spark: SparkSession, sf: str) -> toxicity.Model:
    labels = read(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")).where(~held_out())
    return toxicity.learn(read(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id"))


@query
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    found = toxicity.score(read(spark, sf, "documents"), toxicity_model(spark, sf), [F.col("doc_id"), held_out().alias("held_out")])
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select("doc_id", "held_out", "score", "predicted", "worst_start", "worst_end", "worst_score")


@query
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(read(spark, sf, "embeddings"))


@query
def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf, "embeddings").select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


ORACLES["op12_hard_negatives"] = """
WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score
      FROM k a JOIN k b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3"""


@query
def op13_record_files(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/records-{uuid.uuid4().hex}"
    record_files.write(read(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return record_files.write_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset")
