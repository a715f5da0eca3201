"""The subpackage's queries, by name, and the SQL that states their results where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from queuelake.llm import bpe, chat, extraction, merkle, minhash, mixing, quality, secrets, sharding, vectors
from queuelake.llm.common import save


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = save(mixing.keyed(docs).select("doc_id", "source", "__ql_size", "__ql_hash"))
    plan = mixing.thresholds(rows, mixing.source_plan(rows))
    return mixing.mix_columns(mixing.apply_thresholds(rows, plan)).select("doc_id", "size", "source_size", "target", "taken")


#: Sorts each source by hash and takes the longest run whose sum doesn't pass what is left, or one hash more if that comes nearer.
#: Level: three weights and a cap of twice the size; with sources sorted by size over weight, the capped ones are a prefix.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, source,
        CAST(length(regexp_replace(regexp_replace(t, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || t), 1, 15) AS BIGINT) AS h FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM k GROUP BY source),
o AS (SELECT *, source_size / w AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
        coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM s),
l AS (SELECT arg_min((budget - 2 * before) / free, ratio) FILTER (WHERE (budget - 2 * before) / free <= 2 * ratio) AS level FROM o),
p AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w * coalesce(level, 1e300)) AS target FROM s, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS times FROM p),
g AS (SELECT source, h, sum(size) AS hs FROM k GROUP BY source, h),
c AS (SELECT g.source, g.h, sum(hs) OVER (PARTITION BY g.source ORDER BY g.h) AS cum, hs, target - times * source_size AS rest
      FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source),
e AS (SELECT source, h, cum <= rest AND NOT (rest <= 0) OR (cum > rest AND cum - hs < rest AND cum - rest < rest - (cum - hs)) AS more FROM c)
SELECT k.doc_id, k.size, q.source_size, q.target, k.size * (q.times + CASE WHEN more THEN 1 ELSE 0 END) AS taken
FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source JOIN e ON k.source IS NOT DISTINCT FROM e.source AND k.h = e.h
"""


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


#: All pairs by brute force; components by spreading the least id along links.
OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), bpe.vocabulary())


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(_table(spark, sf_dir, "documents"))


def op8_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    return chat.digests(chat.read_back(chat.format_chats(turns.unionByName(extra))))


#: Escaping lengthens a text by one character for each control character.
OP8_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, length(regexp_replace(text, '[&<>|\\[\\]]', 'xx', 'g')) AS n, length(regexp_replace(role, '[&<>|\\[\\]]', 'xx', 'g')) AS rn,
        coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) <> role, TRUE) AS opens FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + 7 + CASE WHEN opens THEN rn + 9 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.mark(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


#: One step of SQL's splitmix64 finaliser over column ``x`` of ``table``: unsigned 64-bit products, by way of 128 bits.
_STEP = "SELECT * REPLACE (CAST(CAST(xor(x, x >> {shift}) AS UHUGEINT) * {factor} % 18446744073709551616 AS UBIGINT) AS x) FROM ({table})"


def _mixed_sql(table: str) -> str:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        table = _STEP.format(shift=shift, factor=factor, table=table)
    return f"SELECT * REPLACE (xor(x, x >> 31) AS x) FROM ({table})"


def _nibble(c: int) -> int:
    for _ in range(4):
        c = c >> 1 ^ 0xEDB88320 * (c & 1)
    return c


#: CRC-32 by half bytes, the low one first; then a row of ``s`` for each round of each row's walk, until a sixth round ends below n.
OP10_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g'), '.'), lambda d: CAST(instr('0123456789ABCDEF', d) - 1 AS BIGINT))) AS digits FROM documents),
c AS (SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(digits, lambda a, d: xor(a >> 4, {[_nibble(i) for i in range(16)]}[(xor(a, d) & 15) + 1]))) AS crc FROM t),
d AS (SELECT *, CAST(row_number() OVER (ORDER BY doc_id NULLS LAST, crc, size) - 1 AS UBIGINT) AS r FROM c),
w AS (SELECT CAST(count(*) AS UBIGINT) AS n, greatest(2, length(bin(greatest(count(*), 1) - 1))) AS bits FROM d),
p AS (SELECT n, CAST(bits // 2 AS UBIGINT) AS lb, CAST((1::BIGINT << (bits // 2)) - 1 AS UBIGINT) AS lm, CAST((1::BIGINT << (bits - bits // 2)) - 1 AS UBIGINT) AS hm FROM w),
k AS ({_mixed_sql(f"SELECT CAST(i AS INT) AS i, CAST((CAST(i + 1 AS UHUGEINT) * {0x9E3779B97F4A7C15} + {sharding.SEED}) % 18446744073709551616 AS UBIGINT) AS x FROM range(6) AS g(i)")}),
s(r, low, high, i) AS (SELECT r, r & lm, r >> lb, 0 FROM d, p
    UNION ALL SELECT r, low, high, CASE WHEN i = 5 AND (high << lb) | low >= n THEN 0 ELSE i + 1 END
    FROM (SELECT r, i, n, lb, CASE WHEN i % 2 = 0 THEN xor(low, x & lm) ELSE low END AS low, CASE WHEN i % 2 = 1 THEN xor(high, x & hm) ELSE high END AS high
        FROM ({_mixed_sql("SELECT s.r, s.i, s.low, s.high, xor(CASE WHEN s.i % 2 = 1 THEN s.low ELSE s.high END, k.x) AS x FROM s JOIN k ON s.i = k.i")}), p))
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(((high << lb) | low) % 16 AS INT) AS shard, CAST(((high << lb) | low) // 16 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM d JOIN s ON d.r = s.r AND s.i = 6, p
"""


QUERIES = {
    "op1_quality": op1_quality,
    "op2_extract": op2_extract,
    "op3_secrets": op3_secrets,
    "op4_mix_sources": op4_mix_sources,
    "op5_vectors": op5_vectors,
    "op6_bpe": op6_bpe,
    "op7_fingerprints": op7_fingerprints,
    "op8_format_chats": op8_format_chats,
    "op9_minhash": op9_minhash,
    "op10_shard": op10_shard,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op4_mix_sources": OP4_SQL, "op5_vectors": OP5_SQL, "op8_format_chats": OP8_SQL, "op10_shard": OP10_SQL}
