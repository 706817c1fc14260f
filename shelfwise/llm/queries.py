"""Registered queries of the llm operators and their SQL twins.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (chat, decontam, langcrf, lexsearch, licenses, mixing, pq, runs, simhash, suffix, tokenrecords,
                           urlrules, warc)
from shelfwise.session import checkpoint_dir

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *,
    length(regexp_replace(regexp_replace(replace(text, '~', '~0'), '<(\||/?s>)', '~1\1', 'g'),
                          '\[(/?INST\])', '~2\1', 'g'))
    + length(replace(regexp_replace(regexp_replace(replace(role, '~', '~0'), '<(\||/?s>)', '~1\1', 'g'),
                                    '\[(/?INST\])', '~2\1', 'g'), chr(10), '~3')) AS chars
  FROM turns),
chats AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars + 16) AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_text,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss
  FROM escaped GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(all_text) AS turns_sha256,
       CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM chats
"""


@query("op1_chat_format", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role"), F.col("text"))
    both = turns.union(spark.range(2).select(
        F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"),
        F.lit("</s>[INST] ok [/INST]")))
    return chat.digest(chat.format_chats(both.withColumn("parts", chat.text_part("text"))))


@query("op2_decontaminate")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.select(F.col("id").alias("doc_id"), "item_id", "position", "similarity", "distance")


@query("op3_licenses")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select(F.col("id").alias("doc_id"),
                        simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT)
                 >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM p),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS target FROM coded)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN target IS NULL OR page_id IS NOT DISTINCT FROM target THEN 'response' ELSE 'revisit' END
         AS record_type,
       CASE WHEN target IS NULL OR page_id IS NOT DISTINCT FROM target THEN NULL ELSE target END AS refers_to
FROM grouped
"""


@query("op5_warc", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), min_bytes=0)


# Words are counted as the gaps left when runs of other bytes become one
# separator; the fixed point of the resharing is the first source, by the
# ratio of its cap to its weight, that stays below its cap.
OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM per),
weighed AS (
  SELECT source, source_size, 3 * source_size AS most,
         CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM placed),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY CAST(most AS DOUBLE) / w, w, source) AS k FROM weighed),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - (sum(most) OVER (ORDER BY k) - most) AS DOUBLE)
            / CAST(sum(w) OVER () - (sum(w) OVER (ORDER BY k) - w) AS DOUBLE) AS level
  FROM ranked),
fixed AS (SELECT arg_min(level, k) AS level FROM levels WHERE NOT w * level > most),
targets AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), w * (SELECT level FROM fixed)) AS target
  FROM weighed),
rated AS (
  SELECT d.doc_id, d.size, d.source, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)
           / 4503599627370496.0::DOUBLE AS draw,
         CAST(('0x' || substr(md5('mix:' || coalesce(d.source, 'null')), 1, 13)) AS BIGINT)
           / 4503599627370496.0::DOUBLE AS first
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, draw) - 1 AS k FROM rated),
classed AS (
  SELECT *, min(k) OVER (PARTITION BY source, size) AS low, count(*) OVER (PARTITION BY source, size) AS n
  FROM ordered),
counted AS (
  SELECT *, floor((low + n) * (rate - floor(rate)) + first) - floor(low * (rate - floor(rate)) + first) AS copied
  FROM classed),
limited AS (
  SELECT *, max(CASE WHEN k - low < copied THEN draw END) OVER (PARTITION BY source, size) AS most FROM counted)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw <= most THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM limited
"""


@query("op6_mixing", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(_table(spark, sf_dir, "documents"))
    return p.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                    (F.col("size") * F.col("copies")).alias("taken"))


@query("op7_url_filter")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_table(spark, sf_dir, "pages"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langcrf.identify(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), langcrf.held_out(F.col("id")).alias("held_out"),
                        "lang_pred", "score")


@query("op9_embedding_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95).withColumnRenamed(
        "id", "vec_id")


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_digest(_table(spark, sf_dir, "documents"), length=200).withColumnRenamed(
        "id", "doc_id")


@query("op11_token_records")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/token-records-{uuid.uuid4().hex}"
    tokenrecords.write(_table(spark, sf_dir, "documents"), folder,
                       public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenrecords.digest(spark, folder).withColumnRenamed("id", "doc_id")


OP12_SQL = r"""
WITH listed AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS terms
  FROM documents),
total AS (
  SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms
  FROM listed),
long AS (
  SELECT r, doc_id, 25 + (75 * CAST(len(terms) AS BIGINT) * n_docs) // n_terms AS m FROM listed, total
  WHERE len(terms) > 0),
freq AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM listed)
  GROUP BY r, term),
asked AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS terms
  FROM benchmark),
wanted AS (
  SELECT q, item_id, term, CAST(count(*) AS BIGINT) AS times
  FROM (SELECT q, item_id, unnest(terms) AS term FROM asked) GROUP BY q, item_id, term),
weighed AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM freq, total GROUP BY term),
scored AS (
  SELECT q, item_id, r, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM wanted JOIN weighed USING (term) JOIN freq USING (term) JOIN long USING (r)
  GROUP BY q, item_id, r, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_lexical_search", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.planted_repeats(_table(spark, sf_dir, "documents")),
                               min_length=6, min_exponent=4)
    return runs.digest(found).withColumnRenamed("id", "doc_id")
